"""Leading-digit goodness of fit: recipients whose award amounts don't begin as Benford's law has it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import EXPECTED_DIGITS, clamp, deviation, json_details, kolmogorov_survival, leading_digit
from .results import positive_awards, result

LEAST_AWARDS = 30


def digit_histogram(awards: DataFrame) -> DataFrame:
    """(uei, n, d1 .. d9): one aggregation with partial sums in each task."""
    digits = positive_awards(awards).select(F.col("recipient_uei").alias("uei"), leading_digit("total_obligation").alias("digit")).filter(F.col("digit").between(1, 9))
    return digits.groupBy("uei").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("digit") == d).alias(f"d{d}") for d in range(1, 10)])


def benford_statistics(awards: DataFrame, least: int = LEAST_AWARDS) -> DataFrame:
    """The histogram of recipients with ``least`` awards and more, with ks_statistic, p_value and score."""
    counts = [F.col(f"d{d}") for d in range(1, 10)]
    rows = digit_histogram(awards).filter(F.col("n") >= least).withColumn("ks_statistic", deviation(counts, F.col("n")))
    rows = rows.withColumn("p_value", kolmogorov_survival(F.col("ks_statistic") * F.sqrt(F.col("n").cast("double"))))
    return rows.withColumn("score", clamp(1 - F.col("p_value")))


def detect_benford(awards: DataFrame, least: int = LEAST_AWARDS) -> DataFrame:
    """Every recipient with enough awards, fitting or not; no awards give an empty result.

    Awards without a recipient or a positive amount are passed over; repeated awards count each; other columns have no effect.
    """
    names = F.array(*[F.lit(str(d)) for d in range(1, 10)])
    observed = F.map_from_arrays(names, F.array(*[F.col(f"d{d}") / F.col("n") for d in range(1, 10)]))
    expected = F.map_from_arrays(names, F.array(*[F.lit(p) for p in EXPECTED_DIGITS]))
    details = json_details(observed_distribution=observed, expected_distribution=expected, ks_statistic=F.col("ks_statistic"), p_value=F.col("p_value"), n_transactions=F.col("n"))
    return result(benford_statistics(awards, least), "benford", details)
