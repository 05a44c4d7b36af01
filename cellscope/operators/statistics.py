"""Rank statistics, nulls and effect sizes over cell tables.

Random draws are keyed hashes of a replicate number and the row's key, so every engine and every
run gets the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cellscope.functions.digests import CHUNK, keyed_ints
from cellscope.functions.shipping import ship
from cellscope.operators.ordered import mean_ranks
from cellscope.operators.scaling import average_rank, with_totals

SLACK = 1e-12
#: Rows of two numbers that may be broadcast, where the caller knows a bound.
BROADCAST_ROWS = 2_000_000


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all the columns are numbers."""
    tests = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in columns]
    return df.where(reduce(lambda a, b: a & b, tests))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson's correlation, null where either side does not vary."""
    return F.when((F.var_pop(x) > 0) & (F.var_pop(y) > 0), F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None, min_n: int = 0, degenerate: float | None = None) -> DataFrame:
    """(by.., n, rho): rank correlation with ties at their mean rank.

    Below ``min_n`` rows rho is null; where a side is constant it is ``degenerate``.
    """
    by = by or []
    ranked = finite(df, x, y).select(*by, average_rank(F.col(x), *by).alias("__x"), average_rank(F.col(y), *by).alias("__y"))
    rho = safe_corr(F.col("__x"), F.col("__y"))
    if degenerate is not None:
        rho = F.coalesce(rho, F.lit(degenerate))
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), rho.alias("rho"))
    return out.withColumn("rho", F.when(F.col("n") >= min_n, F.col("rho")))


def spearman_of_rows(df: DataFrame, x: str, y: str, min_n: int = 0) -> DataFrame:
    """``spearman`` of a table that grows with the observations: no window sees the whole of it."""
    rows = finite(df, x, y).select(x, y)
    ranked = rows.join(mean_ranks(rows, x).withColumnRenamed("__rank", "__x"), x).join(mean_ranks(rows, y).withColumnRenamed("__rank", "__y"), y)
    out = ranked.agg(F.count("*").alias("n"), safe_corr(F.col("__x"), F.col("__y")).alias("rho"))
    return out.withColumn("rho", F.when(F.col("n") >= min_n, F.col("rho")))


def permutation_null(df: DataFrame, score: str, outcome: str, keys: list[str], replicates: int, most: int | None = None) -> DataFrame:
    """One row: rho, p (no smoothing), mean and deviation of the null, and the least p above 0.

    Replicate r pairs the outcome's rows with the score's ranks in the order of md5(r:key).
    The table must be of cells; replicates run in parallel, one window partition each. ``most`` is a
    bound on its rows, as the grid gives it: up to BROADCAST_ROWS the ranks are broadcast, beyond it
    or without one the join is left to the planner.
    """
    base = finite(df, score, outcome).select(F.concat_ws(",", *keys).alias("key"), average_rank(F.col(score)).alias("rs"), average_rank(F.col(outcome)).alias("ro"))
    base = base.withColumn("place", F.row_number().over(Window.orderBy("key")))
    draws = base.crossJoin(F.broadcast(base.sparkSession.range(replicates).select(F.col("id").alias("b"))))
    shuffled = draws.select("b", "rs", F.row_number().over(Window.partitionBy("b").orderBy(F.md5(F.concat_ws(":", F.col("b").cast("string"), "key")), "key")).alias("place"))
    ranks = base.select("place", "ro")
    ranks = F.broadcast(ranks) if most is not None and most <= BROADCAST_ROWS else ranks
    null = shuffled.join(ranks, "place").groupBy("b").agg(safe_corr(F.col("rs"), F.col("ro")).alias("rho_b"))
    seen = base.agg(safe_corr(F.col("rs"), F.col("ro")).alias("rho"), F.count("*").alias("n"))
    return null.where("rho_b IS NOT NULL").crossJoin(F.broadcast(seen)).groupBy("rho", "n").agg(
        F.avg((F.abs("rho_b") >= F.abs("rho") - SLACK).cast("double")).alias("p"), F.avg("rho_b").alias("null_mean"), F.stddev_pop("rho_b").alias("null_sd")
    ).withColumn("p_floor", F.lit(1.0 / replicates))


def tercile_contrast(df: DataFrame, score: str, outcome: str, by: list[str] | None = None, least: int = 6) -> DataFrame:
    """Mean outcome in the top and the bottom third of a score, and their ratio.

    Cut at linear quantiles with a slack, so that points on a cut count whatever their last bit.
    """
    by = by or []
    rows = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    cuts = rows.groupBy(*by).agg(F.percentile(score, F.lit(1 / 3)).alias("__lo"), F.percentile(score, F.lit(2 / 3)).alias("__hi"))
    joined = rows.join(F.broadcast(cuts), by) if by else rows.crossJoin(F.broadcast(cuts))
    out = joined.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.when(F.col(score) >= F.col("__hi") - SLACK, F.col(outcome))).alias("top"), F.avg(F.when(F.col(score) <= F.col("__lo") + SLACK, F.col(outcome))).alias("bottom")
    ).where(f"n >= {least}")
    return out.withColumn("ratio", F.when(F.col("bottom") > 0, F.try_divide("top", "bottom")))


def lift(df: DataFrame, score: str, value: str, keys: list[str], share: float = 0.2) -> DataFrame:
    """Share of a total held by the top rows against their share of rows; null without a total."""
    some = with_totals(df, __n=F.count("*"), __total=F.sum(value)).withColumn("__k", F.greatest(F.lit(1), F.rint(F.col("__n") * share).cast("bigint")))
    place = F.row_number().over(Window.orderBy(F.col(score).desc(), *keys))
    top = some.withColumn("__place", place).where("__place <= __k").groupBy("__n", "__total", "__k").agg(F.sum(value).alias("held"))
    captured = F.try_divide(F.col("held").cast("double"), F.nullif("__total", F.lit(0)))
    area = F.col("__k") / F.col("__n")
    return top.select(F.col("__k").alias("topk"), F.col("__n").alias("n_cells"), captured.alias("captured"), area.alias("area_baseline"), (captured / area).alias("lift_vs_area"))


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Dealt over the tasks, as a small file is one partition and each row meets every replicate."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def sign_flip_p(pairs: DataFrame, replicates: int, by: list[str] | None = None) -> DataFrame:
    """Two-sided paired sign-flip test on the mean of ``d`` over ``unit``: (by.., mean_diff, p).

    The sign of a unit in a replicate is the last bit of their hash. Each task adds up all replicates
    over its own units."""
    by = by or []
    ship(pairs.sparkSession)
    rows = _spread(pairs.where("d IS NOT NULL").select(*by, F.coalesce(F.col("unit").cast("string"), F.lit("")).alias("unit"), F.col("d").cast("double").alias("d")), "unit")
    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("b", T.LongType()), T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = {}, {}
        for batch in batches:
            d, units = batch["d"].to_numpy(), batch["unit"].to_pylist()
            keys = list(zip(*[batch[c].to_pylist() for c in by])) if by else [()] * len(d)
            for key in dict.fromkeys(keys):
                at = np.flatnonzero([k == key for k in keys]) if by else np.arange(len(d))
                total = sums.setdefault(key, np.zeros(replicates))
                counts[key] = counts.get(key, 0) + len(at)
                mine = d[at]
                for some, members, drawn in keyed_ints("sign", 0, replicates, [units[i] for i in at]):
                    total[some] += mine[members].sum() - 2.0 * ((drawn & np.uint32(1)).astype(np.float64) @ mine[members])
        for key, total in sums.items():
            columns = [pa.array([k] * replicates, t) for k, t in zip(key, types)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(replicates)), pa.array(total), pa.array(np.full(replicates, counts[key]))], names=[*by, "b", "s", "n"])

    types = [to_arrow_type(rows.schema[c].dataType) for c in by]
    means = rows.mapInArrow(add, schema).groupBy(*by, "b").agg(F.abs(F.sum("s") / F.sum("n")).alias("m"))
    seen = F.broadcast(pairs.groupBy(*by).agg(F.avg("d").alias("mean_diff"), F.max(F.abs("d")).alias("most")))
    joined = means.join(seen, by) if by else means.crossJoin(seen)
    return joined.groupBy(*by, "mean_diff", "most").agg(F.avg((F.col("m") >= F.abs("mean_diff") - SLACK).cast("double")).alias("p")).select(
        *by, "mean_diff", F.when((F.col("most") < 1e-8) | (F.col("mean_diff") == 0), 1.0).otherwise(F.col("p")).alias("p")
    )


def bootstrap_interval(pairs: DataFrame, replicates: int, by: list[str] | None = None) -> DataFrame:
    """(by.., lo, hi), the 95 % interval of the mean of ``d``: draw i of replicate b is the row at hash mod n.

    Every replicate draws from all rows, so ``d`` goes to every worker, eight bytes a row; the tasks share
    the replicates, and no draw is a row of a table."""
    by = by or []
    spark = pairs.sparkSession
    ship(spark)
    rows = pairs.select(*by, F.col("d").cast("double").alias("d"), "unit").toArrow()
    types = [to_arrow_type(pairs.schema[c].dataType) for c in by]
    rows = rows.sort_by([(c, "ascending") for c in [*by, "unit"]]) if len(rows) else rows
    d = rows["d"].to_numpy()
    keys = list(zip(*[rows[c].to_pylist() for c in by])) if by else [()] * len(d)
    starts = [i for i in range(len(d)) if i == 0 or keys[i] != keys[i - 1]] if by else [0][: len(d)]
    groups = spark.sparkContext.broadcast([(keys[i], d[i:j]) for i, j in zip(starts, [*starts[1:], len(d)])])
    del rows, keys

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch["b"].to_numpy()
            if not len(b):
                continue
            first, last = int(b[0]), int(b[-1]) + 1
            for key, values in groups.value:
                n, given = len(values), ~np.isnan(values)
                whole = given.all()
                values = values if whole else np.where(given, values, 0.0)
                total, count = np.zeros(last - first), np.zeros(last - first)
                for slot in range(0, n, CHUNK):
                    for some, _, drawn in keyed_ints("boot", first, last, [str(i) for i in range(slot, min(n, slot + CHUNK))]):
                        at = (drawn % np.uint32(n)).astype(np.intp)
                        total[some] += values[at].sum(axis=1)
                        count[some] += at.shape[1] if whole else given[at].sum(axis=1)
                columns = [pa.array([k] * len(b), t) for k, t in zip(key, types)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.divide(total, count, out=np.full(len(b), np.nan), where=count > 0))], names=[*by, "m"])

    tasks = min(replicates, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    schema = T.StructType([*[pairs.schema[c] for c in by], T.StructField("m", T.DoubleType())])
    means = spark.range(0, replicates, 1, tasks).select(F.col("id").alias("b")).mapInArrow(draw, schema).where(~F.isnan("m"))
    return means.groupBy(*by).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
