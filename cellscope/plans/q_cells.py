"""Backtest queries: cells, priority, rarefaction, nulls, effect sizes, sensitivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellscope.operators import cells as C
from cellscope.operators import statistics as S
from cellscope.operators.scaling import impact_percentile, min_max
from cellscope.plans.base import query
from cellscope.plans.views import COARSE, RANKS, RES, SPLIT, cells_sql, obs

#: Permutations of the full null, and of the small one.
FULL_PERMS = 2000
PERMS = 200


def _obs(spark, sf):
    return C.clean(obs(spark, sf), RANKS)


def _cells(spark, sf, res=RES, split=SPLIT):
    return C.backtest_cells(_obs(spark, sf), split, res)


_CELL_DOUBLES = "clat clon chao_unseen new_rate rare_newK scarcity staleness density priority"


@query("dom1_backtest_cells", f"WITH {cells_sql(RES)} SELECT * FROM cells", _CELL_DOUBLES)
def dom1(spark, sf):
    return _cells(spark, sf)


@query("dom2_priority", f"WITH {cells_sql(COARSE)} SELECT gi, gj, scarcity, staleness, density, priority FROM cells", "scarcity staleness density priority")
def dom2(spark, sf):
    return _cells(spark, sf, COARSE).select("gi", "gj", "scarcity", "staleness", "density", "priority")


@query("dom3_rarefied_new", f"WITH {cells_sql(RES)} SELECT gi, gj, n_test, rare_newK FROM cells WHERE rare_newK IS NOT NULL", "rare_newK")
def dom3(spark, sf):
    return _cells(spark, sf).where("rare_newK IS NOT NULL").select("gi", "gj", "n_test", "rare_newK")


TOP_SQL = f"""WITH {cells_sql(RES)}, ranked AS (SELECT *, CASE WHEN max(priority) OVER () - min(priority) OVER () < 1e-9 THEN 0.0e0 ELSE (row_number() OVER (ORDER BY priority, gi, gj) - 1) / greatest(count(*) OVER () - 1, 1)::DOUBLE END AS score FROM cells)
SELECT gi, gj, clat, clon, n_train, priority, score FROM ranked ORDER BY score DESC, gi, gj LIMIT 40"""


@query("top1_cells_to_visit", TOP_SQL, "clat clon priority score")
def top_cells(spark, sf):
    ranked = impact_percentile(_cells(spark, sf), "priority", "score", C.KEYS)
    return ranked.orderBy(F.col("score").desc(), "gi", "gj").limit(40).select("gi", "gj", "clat", "clon", "n_train", "priority", "score")


_BIN = f"WITH {cells_sql(RES)}"


@query("agg1_count_per_cell", f"{_BIN} SELECT gi, gj, count(*) AS n FROM binned GROUP BY ALL")
def agg1(spark, sf):
    return C.binned(obs(spark, sf), RES).groupBy("gi", "gj").agg(F.count("*").alias("n"))


@query("agg2_last_seen", f"{_BIN} SELECT gi, gj, max(day) AS last_day, date_diff('day', max(day), DATE '{SPLIT}') AS days_since FROM binned WHERE day < DATE '{SPLIT}' GROUP BY gi, gj")
def agg2(spark, sf):
    last = C.binned(obs(spark, sf), RES).where(F.col("day") < F.lit(SPLIT).cast("date")).groupBy("gi", "gj").agg(F.max("day").alias("last_day"))
    return last.withColumn("days_since", F.datediff(F.lit(SPLIT).cast("date"), "last_day").cast("bigint"))


@query("agg3_species_of_cell", f"WITH {cells_sql(COARSE)} SELECT gi, gj, count(DISTINCT taxon) AS n_species, array_to_string(list_sort(list(DISTINCT taxon)), ',') AS species FROM binned GROUP BY gi, gj")
def agg3(spark, sf):
    sets = C.binned(obs(spark, sf), COARSE).groupBy("gi", "gj").agg(F.sort_array(F.collect_set("taxon")).alias("s"))
    return sets.select("gi", "gj", F.size("s").cast("bigint").alias("n_species"), F.array_join("s", ",").alias("species"))


@query("agg4_range_size", f"{_BIN} SELECT taxon, count(DISTINCT (gi, gj)) AS n_cells FROM binned GROUP BY taxon")
def agg4(spark, sf):
    return C.range_rarity(obs(spark, sf), RES).select("taxon", "n_cells")


@query("agg5_chao_unseen", f"{_BIN} SELECT gi, gj, f1, f2, greatest(0.0e0, CASE WHEN f2>0 THEN f1*f1/(2.0e0*f2) ELSE f1*(f1-1)/2.0e0 END) AS chao_unseen FROM raw", "chao_unseen")
def agg5(spark, sf):
    taxa = C.by_cell_and_taxon(C.binned(obs(spark, sf), RES), SPLIT).where("n_before > 0")
    counts = taxa.groupBy("gi", "gj").agg(F.count_if(F.col("n_before") == 1).alias("f1"), F.count_if(F.col("n_before") == 2).alias("f2"))
    return counts.withColumn("chao_unseen", C.chao_unseen(F.col("f1"), F.col("f2")))


_RARITY = "rar AS (SELECT taxon, n_cells, 1.0e0/n_cells / avg(1.0e0/n_cells) OVER () AS rarity FROM (SELECT taxon, count(DISTINCT (gi, gj)) AS n_cells FROM binned GROUP BY taxon))"


@query("agg6_range_rarity", f"{_BIN}, {_RARITY} SELECT * FROM rar", "rarity")
def agg6(spark, sf):
    return C.range_rarity(obs(spark, sf), RES)


def _weighted_sql(weights: str) -> str:
    k = 5
    parts = " * ".join(f"(greatest(e.n_test - n.n_after - {i}, 0) / CAST(greatest(e.n_test - {i}, 1) AS DOUBLE))" for i in range(k))
    return f"""{_BIN}, {weights}, eff AS (SELECT gi, gj, n_test FROM raw WHERE n_test >= {k}), nw AS (SELECT t.gi, t.gj, t.n_after, coalesce(w.weight, 1.0e0) AS w FROM taxa t LEFT JOIN wt w USING (taxon) WHERE n_before=0 AND n_after>0),
s AS (SELECT e.gi, e.gj, round(coalesce(sum(CASE WHEN n.w IS NOT NULL THEN n.w*(round(1 - {parts} + 1e-12, 9)) END), 0) + 1e-12, 7) AS w_newK, round(coalesce(sum(CASE WHEN n.w IS NOT NULL THEN round(1 - {parts} + 1e-12, 9) END), 0) + 1e-12, 7) AS rare_newK FROM eff e LEFT JOIN nw n USING (gi, gj) GROUP BY 1, 2)
SELECT gi, gj, w_newK, rare_newK, w_newK/nullif(rare_newK, 0) AS mean_weight FROM s"""


@query("dom4_weighted_rarefaction", _weighted_sql(f"{_RARITY}, wt AS (SELECT taxon, rarity AS weight FROM rar)"), "w_newK rare_newK mean_weight")
def dom4(spark, sf):
    o = _obs(spark, sf)
    return C.weighted_rarefaction(o, C.range_rarity(o, RES).select("taxon", F.col("rarity").alias("weight")), SPLIT, RES)


_THREAT_SQL = "wt AS (SELECT DISTINCT taxon, CASE taxon % 9 WHEN 1 THEN 2.0e0 WHEN 2 THEN 4.0e0 WHEN 3 THEN 8.0e0 WHEN 4 THEN 16.0e0 ELSE 1.0e0 END AS weight FROM obs)"


def _threat(o):
    from cellscope.functions.scalars import THREAT_WEIGHTS, lookup

    codes = F.get(F.array(*[F.lit(c) for c in ("LC", "NT", "VU", "EN", "CR")]), (F.col("taxon") % 9).cast("int"))
    return o.select("taxon").distinct().select("taxon", lookup(codes, THREAT_WEIGHTS, 1.0).cast("double").alias("weight"))


@query("dom10_threat_weighted", _weighted_sql(_THREAT_SQL), "w_newK rare_newK mean_weight")
def dom10(spark, sf):
    o = _obs(spark, sf)
    return C.weighted_rarefaction(o, _threat(o), SPLIT, RES)


def _rank_sql(table: str, pairs: list[tuple[str, str, str]], where: str = "TRUE") -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS pair, count(*) AS n, CASE WHEN var_pop(rx)>0 AND var_pop(ry)>0 THEN corr(rx, ry) END AS rho FROM (SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1)/2.0e0 AS rx, rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1)/2.0e0 AS ry FROM {table} WHERE {x} IS NOT NULL AND {y} IS NOT NULL AND {where})"
        for name, x, y in pairs
    )
    return rows


_PAIRS = [("priority~new", "priority", "new_species"), ("priority~rarefied", "priority", "rare_newK"), ("staleness~rarefied", "staleness", "rare_newK"), ("scarcity~rate", "scarcity", "new_rate"), ("density~rate", "density", "new_rate"), ("chao~rate", "chao_unseen", "new_rate")]


def _rhos(cells, pairs):
    """(pair, n, rho) of all pairs in one pass, each ranked in a partition of its own."""
    sides = [F.struct(F.lit(name).alias("pair"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for name, x, y in pairs]
    found = S.spearman(cells.select(F.inline(F.array(*sides))), "x", "y", ["pair"])
    named = cells.sparkSession.createDataFrame([(name,) for name, _, _ in pairs], "pair string")
    return named.join(found, "pair", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("agg12_spearman", f"WITH {cells_sql(COARSE)} {_rank_sql('cells', _PAIRS)}", "rho")
def agg12(spark, sf):
    return _rhos(_cells(spark, sf, COARSE), _PAIRS)


def _perm_sql(x: str, y: str, n: int = PERMS, table: str = "cells") -> str:
    return f"""base AS (SELECT gi||','||gj AS key, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1)/2.0e0 AS rs, rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1)/2.0e0 AS ro FROM {table} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
placed AS (SELECT *, row_number() OVER (ORDER BY key) AS place FROM base),
sh AS (SELECT b, rs, row_number() OVER (PARTITION BY b ORDER BY md5(b||':'||key), key) AS place FROM placed, range({n}) t(b)),
nul AS (SELECT b, corr(sh.rs, placed.ro) AS rho_b FROM sh JOIN placed USING (place) GROUP BY b), seen AS (SELECT corr(rs, ro) AS rho, count(*) AS n FROM base)
SELECT rho, n, avg(CASE WHEN abs(rho_b) >= abs(rho) - 1e-12 THEN 1.0e0 ELSE 0.0e0 END) AS p, avg(rho_b) AS null_mean, stddev_pop(rho_b) AS null_sd, {1 / n!r}e0 AS p_floor FROM nul, seen GROUP BY rho, n"""


@query("dom6_permutation_null", f"WITH {cells_sql(COARSE)}, {_perm_sql('priority', 'rare_newK')}", "rho p null_mean null_sd p_floor")
def dom6(spark, sf):
    return S.permutation_null(_cells(spark, sf, COARSE), "priority", "rare_newK", C.KEYS, PERMS, C.grid_size(COARSE))


@query("dom6_permutation_null_full", f"WITH {cells_sql(COARSE)}, {_perm_sql('priority', 'rare_newK', FULL_PERMS)}", "rho p null_mean null_sd p_floor")
def dom6_full(spark, sf):
    return S.permutation_null(_cells(spark, sf, COARSE), "priority", "rare_newK", C.KEYS, FULL_PERMS, C.grid_size(COARSE))


def _tercile_sql(x: str, y: str, table: str = "cells") -> str:
    return f"""SELECT n, top, bottom, CASE WHEN bottom > 0 THEN top/bottom END AS ratio FROM (SELECT count(*) AS n, avg({y}) FILTER (WHERE {x} >= hi - 1e-12) AS top, avg({y}) FILTER (WHERE {x} <= lo + 1e-12) AS bottom
 FROM {table}, (SELECT quantile_cont({x}, {1 / 3!r}) AS lo, quantile_cont({x}, {2 / 3!r}) AS hi FROM {table} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) WHERE {x} IS NOT NULL AND {y} IS NOT NULL) WHERE n >= 6"""


@query("agg11_tercile_ratio", f"WITH {cells_sql(COARSE)} {_tercile_sql('priority', 'rare_newK')}", "top bottom ratio")
def agg11(spark, sf):
    return S.tercile_contrast(_cells(spark, sf, COARSE), "priority", "rare_newK")


def _lift_sql(x: str) -> str:
    return f"""SELECT k AS topk, n AS n_cells, CAST(sum(new_species) AS DOUBLE)/nullif(any_value(total), 0) AS captured, CAST(k AS DOUBLE)/n AS area_baseline, CAST(sum(new_species) AS DOUBLE)/nullif(any_value(total), 0) / (CAST(k AS DOUBLE)/n) AS lift_vs_area FROM
 (SELECT *, greatest(1, CAST(round_even(n*0.2e0, 0) AS BIGINT)) AS k FROM (SELECT new_species, count(*) OVER () AS n, CAST(sum(new_species) OVER () AS BIGINT) AS total, row_number() OVER (ORDER BY {x} DESC, gi, gj) AS place FROM cells)) WHERE place <= k GROUP BY k, n"""


@query("agg13_lift", f"WITH {cells_sql(COARSE)} {_lift_sql('priority')}", "captured area_baseline lift_vs_area")
def agg13(spark, sf):
    return S.lift(_cells(spark, sf, COARSE), "priority", "new_species", C.KEYS)


@query("agg13_lift_density", f"WITH {cells_sql(COARSE)} {_lift_sql('density')}", "captured area_baseline lift_vs_area")
def agg13d(spark, sf):
    return S.lift(_cells(spark, sf, COARSE), "density", "new_species", C.KEYS)


_REPORT = f"""WITH {cells_sql(COARSE)}, rk AS (SELECT * FROM cells WHERE rare_newK IS NOT NULL), rev AS (SELECT * FROM cells WHERE revisited),
q AS (SELECT quantile_cont(priority, {1 / 3!r}) AS lo, quantile_cont(priority, {2 / 3!r}) AS hi FROM rev)
SELECT (SELECT count(*) FROM cells) AS n_cells, (SELECT count(*) FROM rev) AS n_revisited, (SELECT count(*) FROM rk) AS n_cells_rarefied, (SELECT count(*) FROM obs WHERE day < DATE '{SPLIT}') AS n_train, (SELECT count(*) FROM obs WHERE day >= DATE '{SPLIT}') AS n_test,
(SELECT CAST(sum(new_species) AS BIGINT) FROM cells) AS total_new_species, (SELECT median(new_rate) FROM rev, q WHERE priority >= hi - 1e-12) AS rate_median_top, (SELECT median(new_rate) FROM rev, q WHERE priority <= lo + 1e-12) AS rate_median_bottom"""


@query("dom7_backtest_report", _REPORT, "rate_median_top rate_median_bottom")
def dom7(spark, sf):
    o, before = obs(spark, sf), F.col("day") < F.lit(SPLIT).cast("date")
    cells = _cells(spark, sf, COARSE)
    raw = o.agg(F.count_if(before).alias("n_train"), F.count_if(~before).alias("n_test"))
    cut = cells.where("revisited").agg(F.percentile("priority", F.lit(1 / 3)).alias("lo"), F.percentile("priority", F.lit(2 / 3)).alias("hi"))
    rev = F.col("revisited")
    body = cells.crossJoin(F.broadcast(cut)).agg(
        F.count("*").alias("n_cells"), F.count_if(rev).alias("n_revisited"), F.count("rare_newK").alias("n_cells_rarefied"), F.sum("new_species").alias("total_new_species"),
        F.median(F.when(rev & (F.col("priority") >= F.col("hi") - 1e-12), F.col("new_rate"))).alias("rate_median_top"), F.median(F.when(rev & (F.col("priority") <= F.col("lo") + 1e-12), F.col("new_rate"))).alias("rate_median_bottom"),
    )
    return body.where("n_cells >= 10").crossJoin(F.broadcast(raw))


GRIDS, SPLITS = (2.5, 5.0), ("1998-05-01", "1998-07-01")
_SENS = " UNION ALL ".join(
    f"(WITH {cells_sql(g, s)} SELECT {g}e0 AS res, '{s}' AS split, n, rho FROM ({_rank_sql('cells', [('x', 'priority', 'rare_newK')])}))" for g in GRIDS for s in SPLITS
)


@query("dom8_sensitivity", _SENS, "res rho")
def dom8(spark, sf):
    cells = C.nested_backtests(_obs(spark, sf), SPLITS, GRIDS[0], tuple(int(g / GRIDS[0]) for g in GRIDS))
    found = S.spearman(cells, "priority", "rare_newK", ["res", "split"])
    every = spark.createDataFrame([(g, s) for g in GRIDS for s in SPLITS], "res double, split string")
    return every.join(found, ["res", "split"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


_CONS = f"""WITH w AS ({_weighted_sql(f'{_RARITY}, wt AS (SELECT taxon, rarity AS weight FROM rar)')}), p AS (WITH {cells_sql(RES)} SELECT gi, gj, priority FROM cells), j AS (SELECT * FROM p JOIN w USING (gi, gj))
{_rank_sql('j', [('weighted', 'priority', 'w_newK'), ('unweighted', 'priority', 'rare_newK'), ('rarity', 'priority', 'mean_weight')])}"""


@query("dom9_conservation_backtest", _CONS, "rho")
def dom9(spark, sf):
    j = _cells(spark, sf).select("gi", "gj", "priority").join(dom4(spark, sf), ["gi", "gj"])
    return _rhos(j, [("weighted", "priority", "w_newK"), ("unweighted", "priority", "rare_newK"), ("rarity", "priority", "mean_weight")])


# composites: norms are taken after the rarefied filter
_AXES = "ax AS (SELECT *, ((gi*7+gj*13)%101+101)%101/100.0e0 AS app_env, ((gi*3+gj*5)%89+89)%89/88.0e0 AS app_urgency, ((gi*11+gj*17)%97+97)%97/96.0e0 AS app_discover FROM cells WHERE rare_newK IS NOT NULL)"


def _norm_sql(c: str) -> str:
    return f"coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0)"


_COMP = f"WITH {cells_sql(COARSE)}, {_AXES} SELECT gi, gj, 0.8e0*{_norm_sql('scarcity')} + 0.7e0*{_norm_sql('app_env')} + 0.3e0*{_norm_sql('app_urgency')} AS app_leakfree, 0.8e0*{_norm_sql('app_discover')} + 0.7e0*{_norm_sql('app_env')} + 0.3e0*{_norm_sql('app_urgency')} AS app_shipped, {_norm_sql('scarcity')} AS discover_leakfree, {_norm_sql('app_env')} AS env, {_norm_sql('app_urgency')} AS urgency, {_norm_sql('density')} AS opportunistic_density, rare_newK FROM ax"


def with_axes(cells):
    gi, gj = F.col("gi"), F.col("gj")
    return cells.withColumns({"app_env": F.pmod(gi * 7 + gj * 13, F.lit(101)) / 100.0, "app_urgency": F.pmod(gi * 3 + gj * 5, F.lit(89)) / 88.0, "app_discover": F.pmod(gi * 11 + gj * 17, F.lit(97)) / 96.0})


def composites(rows):
    n = min_max(rows, n_s=F.col("scarcity"), n_e=F.col("app_env"), n_u=F.col("app_urgency"), n_a=F.col("app_discover"), n_d=F.col("density"))
    mix = lambda d: 0.8 * F.col(d) + 0.7 * F.col("n_e") + 0.3 * F.col("n_u")
    return n.select("gi", "gj", mix("n_s").alias("app_leakfree"), mix("n_a").alias("app_shipped"), F.col("n_s").alias("discover_leakfree"), F.col("n_e").alias("env"), F.col("n_u").alias("urgency"), F.col("n_d").alias("opportunistic_density"), "rare_newK")


SCORES = ("app_leakfree", "app_shipped", "discover_leakfree", "env", "urgency", "opportunistic_density")


@query("dom15_app_composites", _COMP, " ".join(SCORES) + " rare_newK")
def dom15(spark, sf):
    return composites(with_axes(_cells(spark, sf, COARSE)).where("rare_newK IS NOT NULL"))


@query("dom15_app_score_rhos", f"WITH comp AS ({_COMP}) " + _rank_sql("comp", [(s, s, "rare_newK") for s in SCORES]), "rho")
def dom15r(spark, sf):
    return _rhos(dom15(spark, sf), [(s, s, "rare_newK") for s in SCORES])


_TERC6 = " UNION ALL ".join(f"SELECT '{s}' AS score, * FROM ({_tercile_sql(s, 'rare_newK', 'comp')})" for s in SCORES)


@query("dom15_app_score_terciles", f"WITH comp AS ({_COMP}) {_TERC6}", "top bottom ratio")
def dom15t(spark, sf):
    long = dom15(spark, sf).unpivot("rare_newK", list(SCORES), "score", "value")
    return S.tercile_contrast(long, "value", "rare_newK", ["score"])


_REGION = f"""WITH {cells_sql(COARSE)}, regions AS (SELECT *, CASE WHEN gj < -38 THEN 'west' ELSE 'east' END AS region FROM cells WHERE rare_newK IS NOT NULL),
r AS (SELECT region, rank() OVER (PARTITION BY region ORDER BY priority) + (count(*) OVER (PARTITION BY region, priority) - 1)/2.0e0 AS rx, rank() OVER (PARTITION BY region ORDER BY rare_newK) + (count(*) OVER (PARTITION BY region, rare_newK) - 1)/2.0e0 AS ry FROM regions)
SELECT region, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY region"""


@query("dom16_regions", _REGION, "rho")
def dom16(spark, sf):
    cells = _cells(spark, sf, COARSE).where("rare_newK IS NOT NULL").withColumn("region", F.when(F.col("gj") < -38, "west").otherwise("east"))
    return S.spearman(cells, "priority", "rare_newK", ["region"])


CANDIDATES = {"current_default": (0.8, 0.7, 0.3), "discover_only": (1.0, 0.0, 0.0), "balanced_proposal": (1.0, 0.3, 0.1)}
_TUNE = f"""WITH {cells_sql(COARSE)}, {_AXES}, reg AS (SELECT *, CASE WHEN gj < -38 THEN 'west' ELSE 'east' END AS region FROM ax),
nn AS (SELECT region, rare_newK, {', '.join(f"coalesce(({c} - min({c}) OVER w) / nullif(max({c}) OVER w - min({c}) OVER w, 0), 0) AS {a}" for c, a in (('scarcity', 's'), ('app_env', 'e'), ('app_urgency', 'u')))} FROM reg WINDOW w AS (PARTITION BY region)),
long AS ({' UNION ALL '.join(f"SELECT region, '{c}' AS candidate, {w[0]}e0*s + {w[1]}e0*e + {w[2]}e0*u AS v, rare_newK FROM nn" for c, w in CANDIDATES.items())}),
r AS (SELECT region, candidate, rank() OVER (PARTITION BY region, candidate ORDER BY v) + (count(*) OVER (PARTITION BY region, candidate, v) - 1)/2.0e0 AS rx, rank() OVER (PARTITION BY region, candidate ORDER BY rare_newK) + (count(*) OVER (PARTITION BY region, candidate, rare_newK) - 1)/2.0e0 AS ry FROM long),
rho AS (SELECT region, candidate, corr(rx, ry) AS rho FROM r GROUP BY ALL), won AS (SELECT region, arg_max(candidate, rho) AS best FROM rho GROUP BY region)
SELECT candidate, avg(rho) AS mean_rho, (SELECT count(*) FROM won WHERE best = candidate) AS wins FROM rho GROUP BY candidate"""


@query("dom17_preset_tuning", _TUNE, "mean_rho")
def dom17(spark, sf):
    from pyspark.sql import Window

    cells = with_axes(_cells(spark, sf, COARSE).where("rare_newK IS NOT NULL")).withColumn("region", F.when(F.col("gj") < -38, "west").otherwise("east"))
    w = Window.partitionBy("region")
    norm = lambda c: F.coalesce(F.try_divide(F.col(c) - F.min(c).over(w), F.nullif(F.max(c).over(w) - F.min(c).over(w), F.lit(0.0))), F.lit(0.0))
    n = cells.select("region", "rare_newK", norm("scarcity").alias("s"), norm("app_env").alias("e"), norm("app_urgency").alias("u"))
    for name, (a, b, c) in CANDIDATES.items():
        n = n.withColumn(name, a * F.col("s") + b * F.col("e") + c * F.col("u"))
    long = n.unpivot(["region", "rare_newK"], list(CANDIDATES), "candidate", "v")
    rho = S.spearman(long, "v", "rare_newK", ["region", "candidate"])
    best = rho.groupBy("region").agg(F.max_by("candidate", "rho").alias("candidate")).groupBy("candidate").agg(F.count("*").alias("wins"))
    return rho.groupBy("candidate").agg(F.avg("rho").alias("mean_rho")).join(best, "candidate", "left").withColumn("wins", F.coalesce("wins", F.lit(0)))


_OBJ = ("scarcity", "staleness", "chao_unseen", "density")


@query("dom13_objective_matrix", f"WITH {cells_sql(COARSE)} " + _rank_sql("cells", [(f"{a}~{b}", a, b) for a in _OBJ for b in _OBJ if a < b]), "rho")
def dom13(spark, sf):
    return _rhos(_cells(spark, sf, COARSE), [(f"{a}~{b}", a, b) for a in _OBJ for b in _OBJ if a < b])


@query("dom14_objectives_by_targets", f"WITH {cells_sql(COARSE)} " + _rank_sql("cells", [(f"{a}~{b}", a, b) for a in _OBJ for b in ("new_rate", "rare_newK")]), "rho")
def dom14(spark, sf):
    return _rhos(_cells(spark, sf, COARSE), [(f"{a}~{b}", a, b) for a in _OBJ for b in ("new_rate", "rare_newK")])
