"""Bootstrap confidence intervals drawn from the cube.

Resampling rows with replacement changes a metric only through the cell counts,
and each cell count of a row resample is close to Poisson with the observed
count as mean (the Poisson bootstrap). So replicates are drawn per cube cell:
the cost does not depend on the number of rows, cells are independent, and no
task ever holds a whole audit. Each cell seeds its own generator from its key,
which makes the draws independent of partitioning and of retries.
"""

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from evenhand.operators import metrics as M

RESAMPLES = 1000
CONFIDENCE = 0.95
SEED = 42
FEWEST_VALID = 10
_CELL_BATCH = 64


def replicate_counts(df: DataFrame, key_columns, count_columns, resamples, seed) -> DataFrame:
    """``resamples`` Poisson draws of every count of every row.

    Adds ``replicate``; the counts come back resampled."""
    key = F.xxhash64(F.lit(seed), *[F.col(c) for c in key_columns])
    kept = [c for c in df.columns if c not in count_columns]
    schema = T.StructType(
        [df.schema[c] for c in kept]
        + [T.StructField("replicate", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in count_columns]
    )

    def draw(batches):
        for batch in batches:
            for start in range(0, len(batch), _CELL_BATCH):
                part = batch.iloc[start : start + _CELL_BATCH]
                means = part[list(count_columns)].to_numpy(dtype="float64")
                draws = np.stack(
                    [
                        np.random.default_rng(int(s) & 0xFFFFFFFFFFFFFFFF).poisson(
                            m, size=(resamples, len(m))
                        )
                        for s, m in zip(part["_seed"], means)
                    ]
                )
                out = part[kept].loc[part.index.repeat(resamples)].reset_index(drop=True)
                out["replicate"] = np.tile(np.arange(resamples, dtype="int32"), len(part))
                for i, c in enumerate(count_columns):
                    out[c] = draws[:, :, i].reshape(-1)
                yield out

    # cells are few bytes but many draws each: spread them by hand, since adaptive
    # execution would pack them into one task by size
    spread = df.sparkSession.sparkContext.defaultParallelism
    return df.withColumn("_seed", key).repartition(spread, *key_columns).mapInPandas(draw, schema)


def _intervals(replicates: DataFrame, point: DataFrame, keys, names, confidence) -> DataFrame:
    """Percentile interval per metric; a wide one if hardly any resample is valid."""
    tail = (1.0 - confidence) / 2.0
    finite = [F.expr(f"if(isnan({n}) OR abs({n}) = double('inf'), NULL, {n}) AS {n}") for n in names]
    bounds = replicates.select(*keys, *finite).groupBy(*keys).agg(
        *[
            F.expr(f"struct(count({n}) AS valid, percentile({n}, array({tail!r}D, {1.0 - tail!r}D)) AS at) AS _ci_{n}")
            for n in names
        ],
    )
    rows = ", ".join(
        f"named_struct('name', '{n}',"
        f" 'ci_lower', if(_ci_{n}.valid >= {FEWEST_VALID}, _ci_{n}.at[0], greatest(0D, {n} - 0.1D)),"
        f" 'ci_upper', if(_ci_{n}.valid >= {FEWEST_VALID}, _ci_{n}.at[1], {n} + 0.1D))"
        for n in names
    )
    joined = point.select(*keys, *names).join(bounds, list(keys), "left")
    return joined.select(*keys, F.expr(f"inline(array({rows}))"))


def group_intervals(
    sided: DataFrame,
    keys,
    names=None,
    resamples=RESAMPLES,
    confidence=CONFIDENCE,
    seed=SEED,
    point: DataFrame | None = None,
) -> DataFrame:
    """Intervals of the registered group metrics: keys, name, ci_lower, ci_upper.

    ``point`` may hand in the values themselves, as ``group_metrics`` gives them."""
    names = [m.name for m in M.registered() if not names or m.name in names]
    cells = ["tp", "fp", "tn", "fn"]
    draws = replicate_counts(
        sided.select(*keys, "group_value", "is_priv", *cells),
        [*keys, "group_value"],
        cells,
        resamples,
        seed,
    )
    # a group may vanish from a resample
    counts = draws.selectExpr(
        "*", "tp + fp + tn + fn AS n", "tp + fp AS pred_pos", "tp + fn AS true_pos"
    ).where("n > 0")
    replicates = M.group_metrics(counts, [*keys, "replicate"], names, replicate=True)
    point = M.group_metrics(sided, keys, names) if point is None else point
    return _intervals(replicates, point, keys, names, confidence)


def calibration_intervals(
    bins: DataFrame, keys, resamples=RESAMPLES, confidence=CONFIDENCE, seed=SEED
) -> DataFrame:
    """Interval of the calibration gap, resampling the score-bin cube itself."""
    cells = ["true_priv", "false_priv", "true_unpriv", "false_unpriv"]
    draws = replicate_counts(
        bins.select(
            *keys,
            "score_bin",
            "true_priv",
            (F.col("n_priv") - F.col("true_priv")).alias("false_priv"),
            "true_unpriv",
            (F.col("n_unpriv") - F.col("true_unpriv")).alias("false_unpriv"),
        ),
        [*keys, "score_bin"],
        cells,
        resamples,
        seed,
    )
    counts = draws.withColumn("n_priv", F.col("true_priv") + F.col("false_priv")).withColumn(
        "n_unpriv", F.col("true_unpriv") + F.col("false_unpriv")
    )
    replicates = M.calibration_gap(counts, [*keys, "replicate"])
    point = M.calibration_gap(bins, keys)
    return _intervals(replicates, point, keys, ["calibration_gap"], confidence)

