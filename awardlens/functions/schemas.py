"""Fixed table schemas. Column order is part of the contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType

KINDS: dict[str, DataType] = {"string": StringType(), "double": DoubleType(), "date": DateType(), "int": IntegerType(), "long": LongType(), "timestamp_ntz": TimestampNTZType()}


def schema(columns: str) -> StructType:
    """From names and types, without a session."""
    return StructType([StructField(name, KINDS[kind]) for name, kind in (c.split() for c in columns.split(","))])


AWARDS = schema(
    "award_id string, parent_award_id string, recipient_name string, recipient_uei string, awarding_agency string, "
    "awarding_sub_agency string, award_type string, award_description string, naics_code string, naics_description string, "
    "total_obligation double, base_and_all_options_value double, period_of_performance_start date, "
    "period_of_performance_end date, award_date date, competition_type string, number_of_offers int, "
    "modification_number string, pulled_at timestamp_ntz"
)
ENTITIES = schema(
    "uei string, legal_business_name string, dba_name string, physical_address_line1 string, physical_city string, "
    "physical_state string, physical_zip string, business_type string, entity_structure string, registration_date date, "
    "expiration_date date, cage_code string, exclusion_status string, last_pulled_at timestamp_ntz"
)
SNAPSHOTS = schema("uei string, snapshot_date date, legal_business_name string, physical_address_line1 string, physical_city string, physical_state string, physical_zip string, cage_code string")
RESULT = schema("uei string, detector string, score double, details string")

#: Landed files hold number_of_offers as a 64-bit number; it is range-checked on load.
AWARDS_LANDING = StructType([StructField(f.name, LongType() if f.name == "number_of_offers" else f.dataType) for f in AWARDS])

KEYS = {"awards": ["award_id"], "entities": ["uei"], "entity_snapshots": ["uei", "snapshot_date"]}
TABLES = {"awards": AWARDS, "entities": ENTITIES, "entity_snapshots": SNAPSHOTS}


def aligned(df: DataFrame, target: StructType) -> DataFrame:
    """``df`` in ``target``'s column order and types; a value that doesn't fit becomes null, a missing column is null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in target])
