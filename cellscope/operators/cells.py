"""From observations to cells: binning, the train/test cell table, rarefaction, range sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellscope.functions.scalars import SPECIES_RANKS
from cellscope.operators.scaling import min_max, min_max_within, with_totals

KEYS = ["gi", "gj"]


def bin_of(degrees: Column, res: float) -> Column:
    """Index of the grid row or column; floors, so negatives go down."""
    return F.floor(degrees / res).cast("int")


def centre(index: Column, res: float) -> Column:
    return (index + 0.5) * res


def index_of_centre(degrees: Column, res: float) -> Column:
    return F.rint(degrees / res - 0.5).cast("int")


def grid_size(res: float) -> int:
    """The most cells that coordinates on the globe can fall into."""
    return (int(180 / res) + 1) * (int(360 / res) + 1)


def binned(obs: DataFrame, res: float) -> DataFrame:
    return obs.withColumns({"gi": bin_of(F.col("lat"), res), "gj": bin_of(F.col("lon"), res)})


def clean(obs: DataFrame, ranks: tuple[str, ...] = SPECIES_RANKS) -> DataFrame:
    """Rows with a taxon, a date and a species-level rank."""
    return obs.where(F.col("taxon").isNotNull() & F.col("day").isNotNull() & F.col("rank").isin(*ranks))


def by_cell_and_taxon(obs: DataFrame, split: str, keys: list[str] = KEYS) -> DataFrame:
    """One pass over observations: counts before and after the split, and the last day before."""
    before = F.col("day") < F.lit(split).cast("date")
    return obs.groupBy(*keys, "taxon").agg(
        F.count_if(before).alias("n_before"), F.count_if(~before).alias("n_after"), F.max(F.when(before, F.col("day"))).alias("last")
    )


def chao_unseen(f1: Column, f2: Column) -> Column:
    """Unseen species by Chao's estimate; the bias-corrected form without doubletons."""
    a = F.try_divide(f1 * f1, 2.0 * F.nullif(f2, F.lit(0)))
    return F.greatest(F.lit(0.0), F.when(f2 > 0, a).otherwise(f1 * (f1 - 1) / 2.0))


def _missed(n: Column, c: Column, k: int) -> Column:
    """The chance that k draws out of n observations miss a species that has c of them."""
    out = F.lit(1.0)
    for i in range(k):
        out = out * (F.greatest(n - c - i, F.lit(0)) / F.greatest(n - i, F.lit(1)).cast("double"))
    return out


def expected_new(n: Column, counts: Column, k: int) -> Column:
    """Expected distinct species among k draws without replacement out of n observations, summed
    over species with the given counts: the sum of 1 - C(n - c, k) / C(n, k). Null below k.

    Rounded to nine places, so that equal expectations tie whatever the order of the sum."""
    return F.when(n >= k, F.round(F.aggregate(counts, F.lit(0.0), lambda s, c: s + 1 - _missed(n, c, k)) + 1e-12, 9))


def expected_new_of(n: Column, histogram: Column, k: int) -> Column:
    """``expected_new`` of a histogram, an array of (c, m): m species have c observations each."""
    return F.when(n >= k, F.round(F.aggregate(histogram, F.lit(0.0), lambda s, e: s + e["m"] * (1 - _missed(n, e["c"], k))) + 1e-12, 9))


def _by_cell(taxa: DataFrame, keys: list[str]) -> DataFrame:
    """From (cell, taxon) to cells by way of (cell, count of a new taxon), so that a cell holds a
    histogram of counts, not a list of all its taxa."""
    new, counted = (F.col("n_before") == 0) & (F.col("n_after") > 0), F.col("__c").isNotNull()
    counts = taxa.groupBy(*keys, F.when(new, F.col("n_after")).alias("__c")).agg(
        F.sum("n_before").alias("n_train"), F.max("last").alias("last"), F.count_if(F.col("n_before") == 1).alias("f1"), F.count_if(F.col("n_before") == 2).alias("f2"),
        F.sum("n_after").alias("n_test"), F.count(F.lit(1)).alias("__m"),
    )
    return counts.groupBy(*keys).agg(
        F.sum("n_train").alias("n_train"), F.max("last").alias("last"), F.sum("f1").alias("f1"), F.sum("f2").alias("f2"), F.sum("n_test").alias("n_test"),
        F.sum(F.when(counted, F.col("__m")).otherwise(0)).alias("new_species"), F.collect_list(F.when(counted, F.struct(F.col("__c").alias("c"), F.col("__m").alias("m")))).alias("new_counts"),
    )


def _all_cells(obs: DataFrame, split: str, res: float, k: int, extra: list[str]) -> DataFrame:
    """Aggregations and no join: (cell, taxon), which carries both sides of the split, then cell."""
    cells = _by_cell(by_cell_and_taxon(binned(obs, res), split, [*extra, *KEYS]), [*extra, *KEYS])
    return cells.select(
        *extra, *KEYS, centre(F.col("gi"), res).alias("clat"), centre(F.col("gj"), res).alias("clon"), "n_train",
        F.datediff(F.lit(split).cast("date"), F.col("last")).cast("bigint").alias("days_since"), chao_unseen(F.col("f1"), F.col("f2")).alias("chao_unseen"), "n_test", "new_species",
        (F.col("n_test") > 0).alias("revisited"), F.try_divide(F.col("new_species").cast("double"), F.nullif("n_test", F.lit(0))).alias("new_rate"),
        expected_new_of(F.col("n_test"), F.col("new_counts"), k).alias("rare_newK"),
    )


#: Cells seen before the split, if any row lies after it.
_BOTH_SIDES = "n_train > 0 AND __all_test > 0"


def cell_table(obs: DataFrame, split: str, res: float, k: int = 5, keys: list[str] | None = None) -> DataFrame:
    """The backtest's cells: what was known before the split, what was new after it.

    Only cells seen before the split appear; without rows on either side the table is empty.
    """
    return with_totals(_all_cells(obs, split, res, k, keys or []), __all_test=F.sum("n_test")).where(_BOTH_SIDES).drop("__all_test")


def backtest_cells(obs: DataFrame, split: str, res: float, k: int = 5) -> DataFrame:
    """``cell_table`` with scarcity, staleness and their mean; density as the control that points the
    other way.

    All whole-table values come from one aggregate that reads the columns of the cells themselves, so
    both share the exchange by cell and taxon: the observations are scanned and shuffled once. Cells
    without rows before the split are null there and so enter no range.
    """
    n = F.nullif("n_train", F.lit(0))
    out = min_max(_all_cells(obs, split, res, k, []), {"__all_test": F.sum("n_test")}, scarcity=F.try_divide(F.lit(1.0), n), staleness=F.col("days_since"), density=n)
    return out.where(_BOTH_SIDES).drop("__all_test").withColumn("priority", (F.col("scarcity") + F.col("staleness")) / 2)


def nested_backtests(obs: DataFrame, splits: tuple[str, ...], res: float, times: tuple[int, ...], k: int = 5) -> DataFrame:
    """(res, split, gi, gj, priority, rare_newK): ``backtest_cells`` of several splits on the grids of
    ``res`` times 1, 2, 4, .., whose cells are whole cells of the finer ones.

    Observations are scanned and shuffled once, by the widest cell and taxon, for all of them; ranges
    are windows over the cells of a grid and split."""
    at = lambda c, m: F.floor(F.col(c) / m).cast("int")
    wide = ["__wi", "__wj"]
    fine = binned(obs, res).select(*KEYS, "taxon", "day", *[at(c, max(times)).alias(w) for c, w in zip(KEYS, wide)]).repartition(*wide, "taxon")
    grids = F.inline(F.array(*[F.struct(F.lit(res * m).alias("res"), *[at(c, m).alias(c) for c in KEYS]) for m in times]))
    rows = fine.select(*wide, "taxon", "day", grids)
    before = [F.col("day") < F.lit(s).cast("date") for s in splits]
    taxa = rows.groupBy(*wide, "res", *KEYS, "taxon").agg(
        F.count("day").alias("n"), *[F.count_if(b).alias(f"b{i}") for i, b in enumerate(before)], *[F.max(F.when(b, F.col("day"))).alias(f"l{i}") for i, b in enumerate(before)]
    )
    sides = [F.struct(F.lit(s).alias("split"), F.col(f"b{i}").alias("n_before"), (F.col("n") - F.col(f"b{i}")).alias("n_after"), F.col(f"l{i}").alias("last")) for i, s in enumerate(splits)]
    by = ["res", "split"]
    cells = _by_cell(taxa.select("res", *KEYS, F.inline(F.array(*sides))), [*by, *KEYS])
    cells = cells.select(*by, *KEYS, "n_train", F.datediff(F.col("split").cast("date"), F.col("last")).alias("days_since"), "n_test", expected_new_of(F.col("n_test"), F.col("new_counts"), k).alias("rare_newK"))
    out = min_max_within(cells, by, scarcity=F.try_divide(F.lit(1.0), F.nullif("n_train", F.lit(0))), staleness=F.col("days_since"))
    out = out.withColumn("__all_test", F.sum("n_test").over(Window.partitionBy(*by))).where(_BOTH_SIDES)
    return out.select(*by, *KEYS, ((F.col("scarcity") + F.col("staleness")) / 2).alias("priority"), "rare_newK")


def range_rarity(obs: DataFrame, res: float) -> DataFrame:
    """(taxon, n_cells, rarity): inverse number of cells, scaled to mean 1."""
    ranges = binned(obs, res).select("taxon", *KEYS).distinct().groupBy("taxon").agg(F.count("*").alias("n_cells"))
    mean = F.broadcast(ranges.agg(F.avg(1.0 / F.col("n_cells")).alias("__mean")))
    return ranges.crossJoin(mean).select("taxon", "n_cells", (1.0 / F.col("n_cells") / F.col("__mean")).alias("rarity"))


def weighted_rarefaction(obs: DataFrame, weights: DataFrame, split: str, res: float, k: int = 5) -> DataFrame:
    """(gi, gj, w_newK, rare_newK, mean_weight): expected weight of new species in k draws.

    ``weights`` is (taxon, weight); taxa that it lacks weigh 1.
    """
    taxa = by_cell_and_taxon(binned(obs, res), split)
    effort = taxa.groupBy(*KEYS).agg(F.sum("n_before").alias("n_train"), F.sum("n_after").alias("n_test")).where(f"n_train > 0 AND n_test >= {k}")
    new = taxa.where("n_before = 0 AND n_after > 0").join(weights, "taxon", "left")
    per = effort.join(new, KEYS, "left").select(
        *KEYS, expected_new(F.col("n_test"), F.array(F.coalesce("n_after", F.lit(0))), k).alias("e"), F.coalesce("weight", F.lit(1.0)).alias("w")
    )
    out = per.groupBy(*KEYS).agg(F.round(F.sum(F.col("e") * F.col("w")) + 1e-12, 7).alias("w_newK"), F.round(F.sum("e") + 1e-12, 7).alias("rare_newK"))
    return out.withColumn("mean_weight", F.try_divide(F.col("w_newK"), F.nullif("rare_newK", F.lit(0.0))))
