"""Award and entity records in JSON, one per line, mapped to their tables.

Award records are read as variants, which keep the difference between a missing key, null, 0 and "0": alternatives are
taken in order where a value is null, empty, zero or false, and the last one stands if all are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import award_date, blank_to_null, business_types, entity_date, number, whole_number
from ..functions.schemas import AWARDS, ENTITIES

RAW_ENTITY = (
    "ueiSAM string, entityRegistration struct<ueiSAM:string, uei:string, legalBusinessName:string, dbaName:string, registrationDate:string, "
    "activationDate:string, registrationExpirationDate:string, expirationDate:string, cageCode:string, exclusionStatusFlag:string>, "
    "coreData struct<physicalAddress:struct<addressLine1:string, city:string, stateOrProvinceCode:string, state:string, zipCode:string, zip:string>, "
    "generalInformation:struct<entityStructureDesc:string, entityStructureCode:string>, "
    "businessTypes:struct<businessTypeList:array<struct<businessTypeDesc:string, businessTypeCode:string>>>>"
)


#: The keys of award records; all are taken from a record in one pass over it.
KEYS = (
    "generated_internal_id", "Award ID", "award_id", "parent_award_id", "Parent Award ID", "Parent IDV Agency Name", "Recipient Name", "Recipient UEI", "recipient_uei",
    "Awarding Agency", "Awarding Sub Agency", "Contract Award Type", "Award Type", "Description", "naics_description", "NAICS Description", "Total Obligations", "Award Amount",
    "Base and All Options Value", "Start Date", "End Date", "Action Date", "Base Obligation Date", "Extent Competed", "Number of Offers Received", "Mod Number", "modification_number",
)
RAW_AWARD = f"struct<{', '.join(f'`{k}`: string' for k in KEYS)}, NAICS: struct<code: string, description: string>>"


class _Value:
    """A record's value under a key: its text, and whether it counts as there.

    Its kind is looked up only where the text leaves open whether the value is a text or a number but 0.
    """

    def __init__(self, key: str) -> None:
        self.text = F.col(f"r.`{key}`")
        self.kind = F.schema_of_variant(F.try_variant_get("v", f'$["{key}"]', "variant"))
        open_ = F.substring(self.text, 1, 1).isin("0", "-", "t", "f", "[", "{")
        counts = (self.kind == "STRING") | F.coalesce(self.text.try_cast("double") != 0, F.lit(False))
        self.there = F.coalesce((self.text != "") & (self.text != "{}") & (~open_ | counts), F.lit(False))


def first_there(*keys: str) -> Column:
    """The text of the first key whose value is there, else of the last key."""
    values = [_Value(k) for k in keys]
    out = values[-1].text
    for v in reversed(values[:-1]):
        out = F.when(v.there, v.text).otherwise(out)
    return out


def text_of(key: str) -> Column:
    return _Value(key).text


def _offers(key: str) -> Column:
    """Numbers are cut to whole ones; texts must be whole."""
    v = _Value(key)
    return F.when(v.kind == "STRING", whole_number(v.text)).otherwise(v.text.try_cast("double").try_cast("int"))


def award_records(records: DataFrame, agency: str, pulled_at: Column, line: str = "value", metric: str = "json") -> DataFrame:
    """Awards of a column of JSON text. Text that is no JSON, and records without an id, are left out.

    The latter are observed under ``metric`` as dropped. Nulls are no records; repeated ones stay; other columns are left out.
    """
    # the generators keep the optimiser from repeating the parse, and the pass over a record, in every column
    rows = records.select(F.explode(F.array(F.try_parse_json(line))).alias("v")).filter("v is not null")
    rows = rows.select("v", F.explode(F.array(F.try_variant_get("v", "$", RAW_AWARD))).alias("r"))
    nested = F.col("r.NAICS").isNotNull()  # an object
    code = F.when(nested, F.col("r.NAICS.code")).otherwise(blank_to_null(F.try_variant_get("v", '$["NAICS"]', "string")))
    from_object = F.when(nested, F.col("r.NAICS.description"))
    name, other = _Value("naics_description"), _Value("NAICS Description")
    made = {
        "award_id": first_there("generated_internal_id", "Award ID", "award_id"),
        "parent_award_id": first_there("parent_award_id", "Parent Award ID", "Parent IDV Agency Name"),
        "recipient_name": text_of("Recipient Name"),
        "recipient_uei": first_there("Recipient UEI", "recipient_uei"),
        "awarding_agency": F.when(_Value("Awarding Agency").there, text_of("Awarding Agency")).otherwise(F.lit(agency)),
        "awarding_sub_agency": text_of("Awarding Sub Agency"),
        "award_type": first_there("Contract Award Type", "Award Type"),
        "award_description": text_of("Description"),
        "naics_code": code,
        "naics_description": F.when(name.there, name.text).when(other.there, other.text).otherwise(from_object),
        "total_obligation": number(first_there("Total Obligations", "Award Amount")),
        "base_and_all_options_value": number(text_of("Base and All Options Value")),
        "period_of_performance_start": award_date(text_of("Start Date")),
        "period_of_performance_end": award_date(text_of("End Date")),
        "award_date": award_date(first_there("Action Date", "Base Obligation Date")),
        "competition_type": text_of("Extent Competed"),
        "number_of_offers": _offers("Number of Offers Received"),
        "modification_number": first_there("Mod Number", "modification_number"),
        "pulled_at": pulled_at.cast("timestamp_ntz"),
    }
    return rows.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in AWARDS]).observe(metric, F.count_if(F.col("award_id").isNull()).alias("dropped")).filter(F.col("award_id").isNotNull())


def _either(*paths: str) -> Column:
    """The first text that is neither null nor empty, else the last."""
    out = F.col(paths[-1])
    for p in reversed(paths[:-1]):
        out = F.when(F.col(p) != "", F.col(p)).otherwise(out)
    return out


def entity_records(records: DataFrame, pulled_at: Column, line: str = "value") -> DataFrame:
    """Entities of a column of JSON text; records without an identifier are left out."""
    rows = records.select(F.from_json(line, RAW_ENTITY).alias("r")).select("r.*")
    reg, core = "entityRegistration.", "coreData."
    made = {
        "uei": _either(reg + "ueiSAM", reg + "uei", "ueiSAM"),
        "legal_business_name": F.col(reg + "legalBusinessName"),
        "dba_name": F.col(reg + "dbaName"),
        "physical_address_line1": F.col(core + "physicalAddress.addressLine1"),
        "physical_city": F.col(core + "physicalAddress.city"),
        "physical_state": _either(core + "physicalAddress.stateOrProvinceCode", core + "physicalAddress.state"),
        "physical_zip": _either(core + "physicalAddress.zipCode", core + "physicalAddress.zip"),
        "business_type": business_types(core + "businessTypes.businessTypeList"),
        "entity_structure": _either(core + "generalInformation.entityStructureDesc", core + "generalInformation.entityStructureCode"),
        "registration_date": entity_date(_either(reg + "registrationDate", reg + "activationDate")),
        "expiration_date": entity_date(_either(reg + "registrationExpirationDate", reg + "expirationDate")),
        "cage_code": F.col(reg + "cageCode"),
        "exclusion_status": F.col(reg + "exclusionStatusFlag"),
        "last_pulled_at": pulled_at.cast("timestamp_ntz"),
    }
    return rows.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in ENTITIES]).filter(F.col("uei").isNotNull() & (F.col("uei") != ""))


def json_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path)
