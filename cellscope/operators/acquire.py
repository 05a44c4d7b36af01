"""Active discovery: greedy acquisition over coordinates and vectors.

A run is sequential by nature, so each seed is one group of a grouped Arrow function that runs
its strategies in turn, in parallel with the other seeds. A group holds the whole candidate pool, of
any size, as flat arrays: eight bytes a component and a record, and some sixty more a record.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscope.functions.shipping import ship
from cellscope.operators import statistics as S
from cellscope.operators.ordered import bin_of, running, tasks_for

STRATEGIES = ("random", "spatial_coverage", "spatial_coverage_raw", "embedding_novelty", "embedding_kmeanspp", "combined", "combined_raw")
#: The distances that each strategy reads.
NEEDS = {"random": (), "spatial_coverage": ("geo",), "spatial_coverage_raw": ("raw",), "embedding_novelty": ("emb",), "embedding_kmeanspp": ("emb",), "combined": ("geo", "emb"), "combined_raw": ("raw", "emb")}


def _draw(*parts: object) -> float:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / float(1 << 52)


def _z(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    sd = x[mask].std()
    return np.where(mask, (x - x[mask].mean()) / sd if sd > 1e-12 else 0.0, -np.inf)


def run_one(strategy: str, seed: int, keys: np.ndarray, lat: np.ndarray, lon: np.ndarray, unit: np.ndarray, species: np.ndarray, budget: int) -> list[tuple[int, int, int]]:
    """(step, key, species so far) of one run; the first pick depends on the seed only."""
    n = len(keys)
    rad = np.radians(lat), np.radians(lon)
    cos = np.cos(rad[0])
    far = {k: np.full(n, np.inf) for k in NEEDS[strategy]}
    open_, seen, out = np.ones(n, bool), set(), []
    pick = min(int(_draw("start", seed) * n), n - 1) if n else 0
    order = iter(heapq.nsmallest(budget + 1, range(n), key=lambda i: (_draw("pick", seed, int(keys[i])), i)) if strategy == "random" else ())
    for step in range(min(budget, n)):
        if step:
            if strategy == "random":
                pick = next(i for i in order if open_[i])
            elif strategy == "embedding_kmeanspp":
                w = np.where(open_, np.maximum(far["emb"], 0) ** 2, 0.0)
                w = w if w.sum() > 0 else open_.astype(float)
                pick = int(min(np.searchsorted(np.cumsum(w), _draw("d2", seed, step) * w.sum(), "right"), n - 1))
            else:
                score = {
                    "spatial_coverage": lambda: far["geo"], "spatial_coverage_raw": lambda: far["raw"], "embedding_novelty": lambda: far["emb"],
                    "combined": lambda: _z(far["geo"], open_) + _z(far["emb"], open_), "combined_raw": lambda: _z(far["raw"], open_) + _z(far["emb"], open_),
                }[strategy]()
                pick = int(np.argmax(np.where(open_, score, -np.inf)))
        open_[pick] = False
        seen.add(species[pick])
        out.append((step, int(keys[pick]), len(seen)))
        if len(seen) >= budget:
            break
        if "geo" in far:
            h = np.sin((rad[0] - rad[0][pick]) / 2) ** 2 + cos * cos[pick] * np.sin((rad[1] - rad[1][pick]) / 2) ** 2
            far["geo"] = np.minimum(far["geo"], 2 * np.arcsin(np.sqrt(np.clip(h, 0, 1))))
        if "raw" in far:
            far["raw"] = np.minimum(far["raw"], np.sqrt((lat - lat[pick]) ** 2 + (lon - lon[pick]) ** 2))
        if "emb" in far:
            # a row's product does not depend on its place, so equal vectors tie
            far["emb"] = np.minimum(far["emb"], 1 - np.einsum("nd,d->n", unit, unit[pick]))
    return out


def _arrays(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Keys, coordinates, unit vectors and species codes in the order of the keys."""
    keys = rows["vec_id"].to_numpy()
    order = np.argsort(keys, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    unit, at = None, 0
    for chunk in rows["embedding"].chunks:
        if len(chunk):
            v = chunk.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(chunk), -1)
            v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
            unit = np.empty((len(order), v.shape[1])) if unit is None else unit
            unit[place[at : at + len(chunk)]] = v
            at += len(chunk)
    species = pc.fill_null(rows["species"].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    return keys[order], rows["lat"].to_numpy()[order].astype(float), rows["lon"].to_numpy()[order].astype(float), unit, species[order]


def discovery_runs(pool: DataFrame, strategies: tuple[str, ...], seeds: int, budget: int) -> DataFrame:
    """(strategy, seed, step, vec_id, n_species) of every run over a pool (vec_id, species, lat,
    lon, embedding)."""
    ship(pool.sparkSession)
    if not any("emb" in NEEDS[s] for s in strategies):
        pool = pool.withColumn("embedding", F.array(F.lit(1.0)))  # vectors that no strategy reads stay unread
    given = pool.withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(seeds - 1).cast("long"))))

    def go(key: tuple, rows: pa.Table) -> pa.Table:
        seed, given = key[0].as_py(), _arrays(rows)
        found = [(s, seed, *f) for s in strategies for f in run_one(s, seed, *given, budget)]
        names = ("strategy", "seed", "step", "vec_id", "n_species")
        return pa.table([pa.array([f[i] for f in found], pa.int64() if i else pa.string()) for i in range(5)], names=names)

    return given.groupBy("seed").applyInArrow(go, "strategy string, seed long, step long, vec_id long, n_species long")


def curve_area(curves: DataFrame, budget: int) -> DataFrame:
    """(strategy, seed, auc, at_budget): mean of the curve, padded with its last value."""
    per = curves.groupBy("strategy", "seed").agg(F.sum("n_species").alias("s"), F.count("*").alias("n"), F.max("n_species").alias("at_budget"))
    return per.select("strategy", "seed", ((F.col("s") + F.greatest(F.lit(0), F.lit(budget) - F.col("n")) * F.col("at_budget")) / float(budget)).alias("auc"), "at_budget")


#: The better one at the budget stands for the name; of equals the first.
BEST = {"best_embedding": ("embedding_novelty", "embedding_kmeanspp"), "best_spatial": ("spatial_coverage", "spatial_coverage_raw")}
CONTRASTS = (
    ("coverage_vs_random", "spatial_coverage", "random"), ("best_embedding_vs_coverage", "best_embedding", "spatial_coverage"), ("combined_vs_coverage", "combined", "spatial_coverage"),
    ("kmeanspp_vs_kcenter", "embedding_kmeanspp", "embedding_novelty"), ("haversine_vs_raw_spatial", "spatial_coverage", "spatial_coverage_raw"),
    ("best_embedding_vs_best_spatial", "best_embedding", "best_spatial"), ("combined_vs_best_spatial", "combined", "best_spatial"), ("combined_raw_vs_best_spatial", "combined_raw", "best_spatial"),
    ("combined_raw_vs_combined", "combined_raw", "combined"),
)
ALPHA = 0.05


def contrasts(per_seed: DataFrame, replicates: int) -> DataFrame:
    """(contrast, a, b, mean_diff, lo, hi, p, wins, ties, losses, n_seeds, b_mean) of the nine pairs
    of strategies, on species at the budget, paired by seed: per_seed (strategy, seed, at_budget)."""
    means = {r["strategy"]: r["m"] for r in per_seed.groupBy("strategy").agg(F.avg("at_budget").alias("m")).collect()}  # one row a strategy
    named = {k: max(v, key=lambda s: means[s]) for k, v in BEST.items()}
    chosen = per_seed.sparkSession.createDataFrame([(c, named.get(a, a), named.get(b, b)) for c, a, b in CONTRASTS], "contrast string, a string, b string")
    side = lambda x: per_seed.select(F.col("strategy").alias(x), "seed", F.col("at_budget").cast("double").alias(f"{x}_n"))
    d = F.broadcast(chosen).join(side("a"), "a").join(side("b"), ["b", "seed"]).select("contrast", "a", "b", F.col("seed").alias("unit"), (F.col("a_n") - F.col("b_n")).alias("d"), "b_n").persist()
    key, pairs = ["contrast"], d.select("contrast", "unit", "d")
    count = d.groupBy("contrast", "a", "b").agg(F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") == 0).alias("ties"), F.count_if(F.col("d") < 0).alias("losses"), F.count("*").alias("n_seeds"), F.avg("b_n").alias("b_mean"))
    out = count.join(S.sign_flip_p(pairs, replicates, key), key).join(S.bootstrap_interval(pairs, replicates, key), key)
    return out.select("contrast", "a", "b", "mean_diff", "lo", "hi", "p", "wins", "ties", "losses", "n_seeds", "b_mean")


def headline(found: DataFrame) -> DataFrame:
    """(best_spatial, best_spatial_mean, embedding_beats, combined_beats, verdict) of ``contrasts``: a
    strategy beats the best spatial one by a mean difference above 0 with p below ALPHA; the verdict
    says so in words."""
    beats = lambda c: F.bool_or((F.col("contrast") == c) & (F.col("mean_diff") > 0) & (F.col("p") < ALPHA))
    best = F.col("contrast") == "combined_vs_best_spatial"
    out = found.agg(
        F.max(F.when(best, F.col("b"))).alias("best_spatial"), F.max(F.when(best, F.col("b_mean"))).alias("best_spatial_mean"),
        beats("best_embedding_vs_best_spatial").alias("embedding_beats"), beats("combined_vs_best_spatial").alias("combined_beats"),
    )
    who = F.concat_ws(" and ", F.when(F.col("embedding_beats"), "embedding"), F.when(F.col("combined_beats"), "combined"))
    said = F.when(who != "", F.concat(who, F.lit(" acquisition beats "), F.col("best_spatial"))).otherwise(F.concat(F.lit("no strategy beats "), F.col("best_spatial")))
    return out.withColumn("verdict", F.concat(said, F.lit(f" at p < {ALPHA}")))


def accumulation(order: DataFrame, by: list[str], source: DataFrame | None = None) -> DataFrame:
    """Running number of distinct species along ``step``; rows of one step are taken by species, equal rows are one.

    ``source`` has the steps in a cheaper form, for the bins of the running total and the number of tasks."""
    from pyspark.sql import Window

    source = order if source is None else source
    place, tasks = bin_of(source, "step"), tasks_for(source)
    first = F.row_number().over(Window.partitionBy(*by, "species").orderBy("step")) == 1
    flagged = order.repartition(tasks, *by, "species").distinct().withColumn("__new", first.cast("long"))
    return running(flagged, place, "__new", ["step", "species"], by, tasks).withColumnRenamed("__sum", "n_species").drop("__new")
