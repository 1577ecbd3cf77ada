"""The driver's tables as awards and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schemas import AWARDS, ENTITIES

AS_OF = "2002-01-01"
NEW_AWARDS_FROM = "2001-01-01"  # awards from then on are what a later load brings

TYPES = {"O": "DELIVERY ORDER"}
COMPETITION = {"1-URGENT": "Not Competed", "2-HIGH": "FULL AND OPEN COMPETITION", "3-MEDIUM": "Full and Open Competition after Exclusion of Sources", "4-NOT SPECIFIED": "NOT AVAILABLE FOR COMPETITION"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts) -> Column:
    return F.concat_ws("-", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])


BROADCAST_IDS = 2_000_000  # of suppliers, some 80 MB

#: The tables that line items are joined with, and by which keys.
PARTS = {"part": ("l_partkey", "p_partkey"), "orders": ("l_orderkey", "o_orderkey"), "supplier": ("l_suppkey", "s_suppkey"), "nation": ("s_nationkey", "n_nationkey")}


def awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as awards."""
    return as_awards(with_parts(spark, sf_dir, line_items(spark, sf_dir), *PARTS))


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with ``obligation``, made before they are shuffled, as less is shuffled then."""
    amount = F.when((F.col("l_linenumber") == 6) & (F.col("l_returnflag") == "R"), -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    return _table(spark, sf_dir, "lineitem").withColumn("obligation", F.when(F.col("l_quantity") != 1, amount))


def with_parts(spark: SparkSession, sf_dir: str, rows: DataFrame, *names: str) -> DataFrame:
    """Line items joined with the named tables; those without a match in one are left out."""
    for name in names:
        table = _table(spark, sf_dir, name)
        if name == "supplier" and table.count() <= BROADCAST_IDS:  # else all line items are shuffled once more for them; footers count
            table = F.broadcast(table)
        rows = rows.join(table, F.col(PARTS[name][0]) == F.col(PARTS[name][1]))
    return rows


def as_awards(rows: DataFrame, pulls: bool = False) -> DataFrame:
    """Awards of line items with all their parts; with ``pulls`` under ids of two parts, which repeat, and with their column ``late``."""
    priority, number = F.col("o_orderpriority"), F.col("l_linenumber")
    competition = F.lit(None).cast("string")
    for key, text in COMPETITION.items():
        competition = F.when(priority == key, text).otherwise(competition)
    day = F.to_date("l_shipdate")
    made = {
        "award_id": _text("l_orderkey", "l_linenumber") if pulls else _text("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")),
        "parent_award_id": F.concat(F.lit("P"), F.col("l_orderkey").cast("string")),
        "recipient_uei": F.concat(F.lit("C"), F.col("o_custkey").cast("string")),
        "awarding_agency": F.col("n_name"),
        "award_type": F.when(F.col("l_linestatus") == "O", TYPES["O"]).otherwise("Definitive Contract"),
        "naics_code": F.col("p_type"),
        "total_obligation": F.col("obligation"),
        "award_date": day,
        "period_of_performance_end": F.date_add(day, F.col("l_quantity").cast("int")),
        "competition_type": competition,
        "modification_number": F.when(number == 1, "0").when(number != 7, F.concat(F.lit("P0000"), (number - 1).cast("string"))),
        "pulled_at": F.col("l_shipdate").cast("timestamp_ntz"),
    }
    extra = ["late"] if pulls else []
    return rows.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in AWARDS], *extra)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entities. Every seventh registers under another id than its awards have, so that some awards have no entity."""
    rows = _table(spark, sf_dir, "customer")
    registered = F.when(F.col("c_custkey") % 10 != 0, F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") * 37 % 2400).cast("int")))
    made = {"uei": F.concat(F.when(F.col("c_custkey") % 7 == 0, "X").otherwise("C"), F.col("c_custkey").cast("string")), "legal_business_name": F.col("c_name"), "registration_date": registered, "last_pulled_at": registered.cast("timestamp_ntz")}
    return rows.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTITIES])


AWARDS_SQL = """base AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
pulls AS (SELECT l_orderkey || '-' || l_linenumber AS pull_id, l_partkey, l_suppkey,
  l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS award_id,
  'P' || l_orderkey AS parent_award_id, 'C' || o_custkey AS recipient_uei, n_name AS awarding_agency,
  CASE WHEN l_linestatus = 'O' THEN 'DELIVERY ORDER' ELSE 'Definitive Contract' END AS award_type, p_type AS naics_code,
  CASE WHEN l_quantity = 1 THEN NULL WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS total_obligation,
  l_shipdate::DATE AS award_date, l_shipdate::DATE + l_quantity::INT AS period_of_performance_end,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Not Competed' WHEN '2-HIGH' THEN 'FULL AND OPEN COMPETITION' WHEN '3-MEDIUM' THEN 'Full and Open Competition after Exclusion of Sources' WHEN '4-NOT SPECIFIED' THEN 'NOT AVAILABLE FOR COMPETITION' END AS competition_type,
  CASE l_linenumber WHEN 1 THEN '0' WHEN 7 THEN NULL ELSE 'P0000' || (l_linenumber - 1) END AS modification_number, l_shipdate AS pulled_at FROM base),
awards AS (SELECT * EXCLUDE (pull_id, l_partkey, l_suppkey) FROM pulls),
positive AS (SELECT * FROM awards WHERE recipient_uei IS NOT NULL AND total_obligation > 0)"""

ENTITIES_SQL = """entities AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN 'X' ELSE 'C' END || c_custkey AS uei, c_name AS legal_business_name,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE DATE '1995-01-01' + (c_custkey * 37 % 2400)::INT END AS registration_date FROM customer)"""
