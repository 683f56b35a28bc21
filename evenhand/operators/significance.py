"""Chi-square test of predictions against groups, from the group cube."""

import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T


@F.pandas_udf(T.DoubleType())
def chi2_tail(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution, one value per audit.

    Uses the closed forms for integer degrees of freedom, summed in log space."""

    def tail(x, k):
        if x is None or k is None or math.isnan(x) or math.isnan(k):
            return 1.0
        x, k = float(x), int(k)
        if x <= 0:
            return 1.0
        half = x / 2.0
        odd = k % 2
        terms = [
            (j + odd / 2.0) * math.log(half) - half - math.lgamma(j + 1 + odd / 2.0)
            for j in range(k // 2)
        ]
        head = math.erfc(math.sqrt(half)) if odd else 0.0
        return min(1.0, head + math.fsum(math.exp(t) for t in terms))

    return pd.Series([tail(x, k) for x, k in zip(stat, dof)], dtype="float64")


def chi_square_columns() -> list:
    """Aggregates over sided groups (see ``with_sides``) giving the statistic.

    With one degree of freedom each deviation is pulled in by at most a half
    (Yates). Fewer than two groups or one kind of prediction leaves it null."""
    rate = "(sample_pos / sample_size)"
    deviation = f"abs(pred_pos - n * {rate})"
    corrected = f"if(group_count = 2, greatest({deviation} - 0.5D, 0D), {deviation})"
    testable = "group_count > 1 AND sample_pos > 0 AND sample_pos < sample_size"
    term = f"{corrected} * {corrected} / (n * {rate} * (1 - {rate}))"
    return [
        F.expr(f"sum(CASE WHEN {testable} THEN {term} END)").alias("chi2"),
        F.expr(f"max(CASE WHEN {testable} THEN group_count - 1 END)").alias("dof"),
    ]


def p_value(stat="chi2", dof="dof"):
    """p-value column; 1.0 where no test is possible."""
    return F.when(F.col(stat).isNull(), F.lit(1.0)).otherwise(chi2_tail(F.col(stat), F.col(dof)))


def chi_square(sided: DataFrame, keys) -> DataFrame:
    """Statistic, degrees of freedom and p-value per key and attribute."""
    return (
        sided.groupBy(*keys, "attribute", "attribute_ord")
        .agg(*chi_square_columns())
        .withColumn("p_value", p_value())
    )
