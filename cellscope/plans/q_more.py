"""Joins, sets, scalars, species, discovery, rasters, backlog, provenance, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellscope.functions import scalars as X
from cellscope.operators import acquire, backlog, provenance, raster, spatial, species, vectors
from cellscope.operators import cells as C
from cellscope.operators import statistics as S
from cellscope.operators.ordered import tasks_for
from cellscope.plans.base import query
from cellscope.plans.views import COARSE, OBS, POOL, RES, SPLIT, obs, pool, table
from cellscope.sources import files
from cellscope.sources.scratch import scratch

_BIN = f"WITH {OBS}, b AS (SELECT *, CAST(floor(lat/{RES}) AS INT) AS gi, CAST(floor(lon/{RES}) AS INT) AS gj FROM obs)"


def _b(spark, sf):
    return C.binned(obs(spark, sf), RES)


def _side(df, before=True):
    t = F.lit(SPLIT).cast("date")
    return df.where(F.col("day") < t if before else F.col("day") >= t)


# ---- projections and filters
@query("prj1_drop_null_keys", f"WITH {OBS} SELECT count(*) AS n FROM (SELECT CASE WHEN taxon % 7 = 0 THEN NULL ELSE taxon END AS taxon, CASE WHEN id % 11 = 0 THEN NULL ELSE day END AS day FROM obs) WHERE taxon IS NOT NULL AND day IS NOT NULL")
def prj1(spark, sf):
    holes = obs(spark, sf).select(F.when(F.col("taxon") % 7 != 0, F.col("taxon")).alias("taxon"), F.when(F.col("id") % 11 != 0, F.col("day")).alias("day"))
    return holes.dropna(subset=["taxon", "day"]).agg(F.count("*").alias("n"))


@query("prj2_coerced_dates", "SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE) AS day FROM orders")
def prj2(spark, sf):
    text = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", files.day_of(text).alias("day"))


@query("prj3_rank_filter", f"WITH {OBS} SELECT rank, count(*) AS n FROM obs WHERE rank IN ('A', 'R') GROUP BY rank")
def prj3(spark, sf):
    return C.clean(obs(spark, sf), ("A", "R")).groupBy("rank").agg(F.count("*").alias("n"))


@query("prj4_spatial_bins", f"{_BIN} SELECT id, gi, gj, (gi+0.5e0)*{RES} AS clat, (gj+0.5e0)*{RES} AS clon FROM b", "clat clon")
def prj4(spark, sf):
    return _b(spark, sf).select("id", "gi", "gj", C.centre(F.col("gi"), RES).alias("clat"), C.centre(F.col("gj"), RES).alias("clon"))


@query("prj5_index_of_centre", f"{_BIN} SELECT DISTINCT gi, gj, CAST(round_even(((gi+0.5e0)*{RES})/{RES} - 0.5e0, 0) AS INT) AS back_i FROM b")
def prj5(spark, sf):
    return _b(spark, sf).select("gi", "gj").distinct().withColumn("back_i", C.index_of_centre(C.centre(F.col("gi"), RES), RES))


@query("prj6_temporal_split", f"WITH {OBS} SELECT day < DATE '{SPLIT}' AS train, count(*) AS n FROM obs GROUP BY 1")
def prj6(spark, sf):
    return obs(spark, sf).groupBy((F.col("day") < F.lit(SPLIT).cast("date")).alias("train")).agg(F.count("*").alias("n"))


@query("prj7_effort_filter", f"{_BIN} SELECT gi, gj, count(*) AS n FROM b WHERE day >= DATE '{SPLIT}' GROUP BY ALL HAVING count(*) >= 5")
def prj7(spark, sf):
    return _side(_b(spark, sf), False).groupBy("gi", "gj").agg(F.count("*").alias("n")).where("n >= 5")


@query("prj8_too_few_cells", f"WITH {OBS}, n AS (SELECT grp, count(DISTINCT (CAST(floor(lat/20.0) AS INT), CAST(floor(lon/20.0) AS INT))) AS n FROM obs GROUP BY grp) SELECT grp, n FROM n WHERE n >= 10")
def prj8(spark, sf):
    return C.binned(obs(spark, sf), 20.0).groupBy("grp").agg(F.count_distinct("gi", "gj").alias("n")).where("n >= 10")


@query("prj11_sentinels", "SELECT p_partkey, CASE WHEN p_size = 5 OR p_size < 3 THEN NULL ELSE p_size::DOUBLE END AS v FROM part", "v")
def prj11(spark, sf):
    return table(spark, sf, "part").select("p_partkey", raster.masked(F.col("p_size").cast("double"), 5.0, 3.0).alias("v"))


@query("prj12_viewport", f"{_BIN} SELECT gi, gj, count(*) AS n FROM b WHERE lat BETWEEN 45 AND 50 AND lon BETWEEN -130 AND -110 AND (gi + gj) % 3 <> 0 GROUP BY ALL")
def prj12(spark, sf):
    cells = _b(spark, sf).where(F.col("lat").between(45, 50) & F.col("lon").between(-130, -110))
    hidden = cells.where("(gi + gj) % 3 = 0").select("gi", "gj").distinct()
    return cells.join(hidden, ["gi", "gj"], "left_anti").groupBy("gi", "gj").agg(F.count("*").alias("n"))


@query("prj14_guarded_scan", f"WITH {OBS} SELECT grp, count(*) AS n FROM obs WHERE rank = 'R' AND taxon % 3 = 0 GROUP BY grp")
def prj14(spark, sf):
    return obs(spark, sf).where((F.col("rank") == "R") & (F.col("taxon") % 3 == 0)).groupBy("grp").agg(F.count("*").alias("n"))


@query("prj15_finite_pairs", "SELECT count(*) AS n FROM part WHERE p_size <> 7 AND p_size <> 9")
def prj15(spark, sf):
    p = table(spark, sf, "part").select(F.when(F.col("p_size") == 7, float("nan")).otherwise(F.col("p_size").cast("double")).alias("x"), F.when(F.col("p_size") != 9, F.col("p_retailprice")).alias("y"))
    return S.finite(p, "x", "y").agg(F.count("*").alias("n"))


@query("prj16_flat_guard", f"{_BIN}, c AS (SELECT grp, gi, count(*) AS n FROM b GROUP BY ALL) SELECT grp, max(n) - min(n) > 0 AS varies FROM c GROUP BY grp")
def prj16(spark, sf):
    return _b(spark, sf).groupBy("grp", "gi").agg(F.count("*").alias("n")).groupBy("grp").agg((F.max("n") - F.min("n") > 0).alias("varies"))


@query("prj17_published_rounding", "SELECT p_partkey, coalesce(round_even(CASE WHEN p_size > 40 THEN NULL ELSE p_retailprice/7 END, 3), 0) AS sr, coalesce(round_even(CASE WHEN p_size < 5 THEN NULL ELSE p_retailprice/3 END, 0), -1) AS tr FROM part", "sr tr")
def prj17(spark, sf):
    from cellscope.operators.axes import published, published_travel

    p = table(spark, sf, "part")
    return p.select("p_partkey", published(F.when(F.col("p_size") <= 40, F.col("p_retailprice") / 7)).alias("sr"), published_travel(F.when(F.col("p_size") >= 5, F.col("p_retailprice") / 3)).alias("tr"))


# ---- joins and sets
@query("jn1_train_left_test", f"{_BIN}, tr AS (SELECT gi, gj, count(*) AS n_train FROM b WHERE day < DATE '{SPLIT}' GROUP BY 1, 2), te AS (SELECT gi, gj, count(*) AS n_test FROM b WHERE day >= DATE '{SPLIT}' GROUP BY 1, 2) SELECT gi, gj, n_train, coalesce(n_test, 0) AS n_test FROM tr LEFT JOIN te USING (gi, gj)")
def jn1(spark, sf):
    b = _b(spark, sf)
    n = lambda d, c: d.groupBy("gi", "gj").agg(F.count("*").alias(c))
    return n(_side(b), "n_train").join(n(_side(b, False), "n_test"), ["gi", "gj"], "left").withColumn("n_test", F.coalesce("n_test", F.lit(0)))


@query("jn5_backlog_full_outer", f"{_BIN}, a AS (SELECT gi, gj, count(*) AS n_need FROM b WHERE rank='N' AND id%5=0 GROUP BY 1, 2), d AS (SELECT gi, gj, count(*) AS n_done FROM b WHERE rank='R' AND id%7=0 GROUP BY 1, 2) SELECT gi, gj, coalesce(n_need, 0) AS n_need, coalesce(n_done, 0) AS n_done FROM a FULL JOIN d USING (gi, gj)")
def jn5(spark, sf):
    b = _b(spark, sf)
    n = lambda d, c: d.groupBy("gi", "gj").agg(F.count("*").alias(c))
    return n(b.where("rank='N' AND id%5=0"), "n_need").join(n(b.where("rank='R' AND id%7=0"), "n_done"), ["gi", "gj"], "full").fillna(0)


@query("jn7_weight_lookup", f"WITH {OBS} SELECT CASE taxon%5 WHEN 0 THEN 'CR' WHEN 1 THEN 'VU' WHEN 2 THEN 'DD' WHEN 3 THEN 'LC' ELSE NULL END AS code, sum(CASE taxon%5 WHEN 0 THEN 16.0e0 WHEN 1 THEN 4.0e0 ELSE 1.0e0 END) AS w FROM obs GROUP BY 1", "w")
def jn7(spark, sf):
    code = F.get(F.array(*[F.lit(c) for c in ("CR", "VU", "DD", "LC")]), (F.col("taxon") % 5).cast("int"))
    return obs(spark, sf).withColumn("code", code).groupBy("code").agg(F.sum(X.lookup(F.col("code"), X.THREAT_WEIGHTS, 1.0).cast("double")).alias("w"))


@query("jn10_recorded_semi", f"{_BIN} SELECT DISTINCT gi, gj FROM b WHERE (gi, gj) IN (SELECT (gi, gj) FROM b WHERE taxon % 50 = 0)")
def jn10(spark, sf):
    b = _b(spark, sf)
    return b.select("gi", "gj").distinct().join(b.where("taxon % 50 = 0").select("gi", "gj"), ["gi", "gj"], "left_semi")


@query("jn11_new_to_cell", f"{_BIN} SELECT DISTINCT gi, gj, taxon FROM b t WHERE day >= DATE '{SPLIT}' AND NOT EXISTS (SELECT 1 FROM b s WHERE s.day < DATE '{SPLIT}' AND s.gi=t.gi AND s.gj=t.gj AND s.taxon=t.taxon)")
def jn11(spark, sf):
    b = _b(spark, sf).select("gi", "gj", "taxon", "day")
    return _side(b, False).select("gi", "gj", "taxon").distinct().join(_side(b).select("gi", "gj", "taxon"), ["gi", "gj", "taxon"], "left_anti")


_RING = [("A", 42.0, -140.0), ("A", 60.0, -140.0), ("A", 62.0, -110.0), ("A", 44.0, -112.0), ("B", 44.0, -108.0), ("B", 70.0, -106.0), ("B", 66.0, -60.0), ("B", 46.0, -70.0)]


SQL_POLYGON = f"""{_BIN}, p AS (SELECT DISTINCT CAST(floor(lat/5.0) AS INT) AS gi, CAST(floor(lon/5.0) AS INT) AS gj FROM obs), v(poly, seq, y, x) AS (VALUES {', '.join(f"('{n}', {i}, {y}e0, {x}e0)" for i, (n, y, x) in enumerate(_RING))}),
e AS (SELECT poly, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM v WINDOW w AS (PARTITION BY poly ORDER BY seq)),
c AS (SELECT gi, gj, poly, (gj+0.5e0)*5 AS px, (gi+0.5e0)*5 AS py, e.* EXCLUDE (poly), least(1.0e0, greatest(0.0e0, (((gj+0.5e0)*5-x1)*(x2-x1)+((gi+0.5e0)*5-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) AS t FROM p, e),
d AS (SELECT gi, gj, poly, sum(CASE WHEN (y1>py)<>(y2>py) AND px < x1+(py-y1)*(x2-x1)/(y2-y1) THEN 1 ELSE 0 END) % 2 = 1 AS inside, min(sqrt(pow(px-x1-t*(x2-x1),2)+pow(py-y1-t*(y2-y1),2))) AS dd FROM c GROUP BY 1, 2, 3), f AS (SELECT *, CASE WHEN inside THEN 0 ELSE dd END AS d2 FROM d)
SELECT gi, gj, bool_or(inside) AS inside, arg_min(poly, (d2, poly)) AS poly, min(d2) AS distance FROM f GROUP BY 1, 2"""


@query("jn15_nearest_polygon", SQL_POLYGON, "distance")
def jn15(spark, sf):
    points = C.binned(obs(spark, sf), 5.0).select("gi", "gj").distinct().select("gi", "gj", C.centre(F.col("gj"), 5.0).alias("px"), C.centre(F.col("gi"), 5.0).alias("py"))
    ring = spark.createDataFrame([(n, i, x, y) for i, (n, y, x) in enumerate(_RING)], "poly string, seq int, x double, y double")
    return spatial.nearest_polygon(points, spatial.edges(ring), ["gi", "gj"])


_SPOTS = (("north", 65.0, -110.0), ("coast", 50.0, -125.0), ("lakes", 48.0, -85.0), ("plains", 51.0, -104.0))


@query("jn16_place_names", f"WITH {OBS}, p AS (SELECT DISTINCT CAST(floor(lat/5.0) AS INT) AS gi, CAST(floor(lon/5.0) AS INT) AS gj FROM obs), s(place, plat, plon) AS (VALUES {', '.join(f'({n!r}, {a}e0, {b}e0)' for n, a, b in _SPOTS)}), d AS (SELECT gi, gj, place, pow((gj+0.5e0)*5-plon, 2)+pow((gi+0.5e0)*5-plat, 2) AS d2 FROM p, s) SELECT gi, gj, arg_min(place, (d2, place)) AS place, min(d2) AS d2 FROM d GROUP BY 1, 2", "d2")
def jn16(spark, sf):
    points = C.binned(obs(spark, sf), 5.0).select("gi", "gj").distinct().select("gi", "gj", C.centre(F.col("gj"), 5.0).alias("px"), C.centre(F.col("gi"), 5.0).alias("py"))
    return spatial.nearest_place(points, spark.createDataFrame(list(_SPOTS), "place string, plat double, plon double"), ["gi", "gj"])


@query("jn18_box_neighbourhood", f"WITH {OBS}, s(place, plat, plon) AS (VALUES {', '.join(f'({n!r}, {a}e0, {b}e0)' for n, a, b in _SPOTS)}) SELECT place, count(*) AS n, count(DISTINCT taxon) AS n_species FROM obs, s WHERE abs(lat-plat) <= 2.5 AND abs(lon-plon) <= 2.5 GROUP BY place")
def jn18(spark, sf):
    near = species.band_join(obs(spark, sf), spark.createDataFrame(list(_SPOTS), "place string, plat double, plon double"), 2.5)
    return near.groupBy("place").agg(F.count("*").alias("n"), F.count_distinct("taxon").alias("n_species"))


@query("jn19_radius_filter", f"WITH {OBS} SELECT count(*) AS n FROM obs WHERE sqrt(pow(lat-55, 2)+pow(lon+100, 2)) <= 6")
def jn19(spark, sf):
    return obs(spark, sf).where(X.degrees_apart(F.col("lat"), F.col("lon"), F.lit(55.0), F.lit(-100.0)) <= 6).agg(F.count("*").alias("n"))


@query("set1_union_of_pulls", f"WITH {OBS}, u AS (SELECT id, 0 AS p FROM obs WHERE id % 3 = 0 UNION ALL SELECT id, 1 FROM obs WHERE id % 5 = 0) SELECT id, CAST(min(p) AS INT) AS pull FROM u GROUP BY id")
def set1(spark, sf):
    o = obs(spark, sf).select("id")
    return files.union_pulls(o.where("id % 3 = 0").withColumn("pull", F.lit(0)), o.where("id % 5 = 0").withColumn("pull", F.lit(1)))


@query("set3_union_of_cells", f"{_BIN} SELECT gi, gj FROM b WHERE grp='O' UNION SELECT gi, gj FROM b WHERE grp='F'")
def set3(spark, sf):
    b = _b(spark, sf)
    return b.where("grp='O'").select("gi", "gj").union(b.where("grp='F'").select("gi", "gj")).distinct()


@query("set4_distinct_pairs", f"{_BIN} SELECT DISTINCT gi, taxon FROM b")
def set4(spark, sf):
    return _b(spark, sf).select("gi", "taxon").distinct()


@query("set6_viewport_diff", f"{_BIN}, c AS (SELECT DISTINCT gi, gj FROM b) SELECT gi, gj FROM c WHERE gi BETWEEN 45 AND 55 EXCEPT SELECT gi, gj FROM c WHERE gi BETWEEN 50 AND 60")
def set6(spark, sf):
    c = _b(spark, sf).select("gi", "gj").distinct()
    return c.where("gi BETWEEN 45 AND 55").exceptAll(c.where("gi BETWEEN 50 AND 60"))


@query("set7_intersection", f"{_BIN} SELECT gi, gj FROM b WHERE grp='O' INTERSECT SELECT gi, gj FROM b WHERE grp='F'")
def set7(spark, sf):
    b = _b(spark, sf)
    return b.where("grp='O'").select("gi", "gj").intersect(b.where("grp='F'").select("gi", "gj"))


# ---- species
_AT, _H = (55.0, -100.0), 2.0
_IN = lambda h: f"abs(lat-{_AT[0]}e0) <= {h} AND abs(lon-({_AT[1]}e0)) <= {h}"


@query("dom31_species_prospects", f"WITH {OBS}, k AS (SELECT taxon, count(*) FILTER (WHERE {_IN(_H)}) AS here, count(*) FILTER (WHERE {_IN(3 * _H)}) AS region, count(*) AS total FROM obs GROUP BY taxon), s AS (SELECT taxon, CASE WHEN here>=2 THEN here ELSE 0 END AS here, region, here>=2 AS known, CASE WHEN here>=2 THEN here/greatest(1, region)::DOUBLE ELSE 0 END AS share FROM k WHERE total > 20 AND (here>=2 OR region>=3)) SELECT * FROM s ORDER BY known, share, region, taxon LIMIT 6", "share")
def dom31(spark, sf):
    return species.prospects(obs(spark, sf), _AT, _H, 6, 20)


_G5 = f"{OBS}, g5 AS (SELECT *, 'g'||(taxon%5) AS g FROM obs)"


def _grouped(spark, sf):
    return obs(spark, sf).withColumn("grp", F.concat(F.lit("g"), (F.col("taxon") % 5).cast("string")))


@query("dom32_gap_tree", f"WITH {_G5}, k AS (SELECT g AS grp, least(count(DISTINCT CASE WHEN {_IN(_H)} THEN taxon END), count(DISTINCT taxon)) AS c, count(DISTINCT taxon) AS n FROM g5 WHERE {_IN(4 * _H)} GROUP BY 1 HAVING count(DISTINCT taxon) >= 3) SELECT grp, c, n, CASE WHEN sum(c) OVER () > 0 THEN c/n::DOUBLE/(sum(c) OVER ()/(sum(n) OVER ())::DOUBLE) ELSE 0 END AS cov FROM k", "cov")
def dom32(spark, sf):
    return species.gap_tree(_grouped(spark, sf), _AT, _H, 4 * _H)


@query("dom29_least_covered_group", f"WITH {_G5}, c AS (SELECT g AS grp, CAST(floor(lat/{COARSE}) AS INT) AS gi, CAST(floor(lon/{COARSE}) AS INT) AS gj, count(DISTINCT taxon) AS s FROM g5 GROUP BY 1, 2, 3), m AS (SELECT grp, max(s) AS most FROM c GROUP BY 1), h AS (SELECT c.*, s/most::DOUBLE AS share FROM c JOIN m USING (grp)) SELECT gi, gj, arg_min(grp, (share, grp)) AS grp, min(share) AS share FROM h GROUP BY 1, 2", "share")
def dom29(spark, sf):
    c = C.binned(_grouped(spark, sf), COARSE).groupBy("grp", "gi", "gj").agg(F.count_distinct("taxon").alias("s"))
    return species.least_covered(c)


# ---- discovery
#: Picks and seeds of the full runs, and of the small ones that SQL can follow; replicates of the tests.
FULL_BUDGET, FULL_SEEDS = 300, 20
BUDGET, SEEDS = 20, 6
REPLICATES = 20_000


def _runs(spark, sf, strategies=acquire.STRATEGIES):
    return acquire.discovery_runs(pool(spark, sf), strategies, FULL_SEEDS, FULL_BUDGET).persist()


def _small_runs(spark, sf, strategy):
    return acquire.discovery_runs(pool(spark, sf), (strategy,), SEEDS, BUDGET)


_DOT = lambda a, b: f"list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


@query("scl4_cosine_distance", f"WITH {POOL} SELECT a.vec_id AS a, b.vec_id AS b, 1 - {_DOT('a.embedding', 'b.embedding')}/(sqrt({_DOT('a.embedding', 'a.embedding')})*sqrt({_DOT('b.embedding', 'b.embedding')})) AS distance FROM pool a JOIN pool b ON a.species = b.species AND a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id", "distance")
def scl4(spark, sf):
    p = pool(spark, sf)
    return vectors.distances_within(p, p.where("vec_id % 50 = 0"), "vec_id", "species", "embedding")


def _order_sql(seeds, budget):
    return f"""WITH {POOL}, seeds AS (SELECT CAST(s AS BIGINT) AS seed FROM range({seeds}) t(s)), n AS (SELECT count(*) AS n FROM pool),
st AS (SELECT seed, least(CAST(floor((('0x'||substr(md5('start:'||seed), 1, 13))::BIGINT/{float(1 << 52)!r}) * n) AS BIGINT), n-1) AS i FROM seeds, n), p AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM pool),
o AS (SELECT seed, vec_id, species, row_number() OVER (PARTITION BY seed ORDER BY CASE WHEN st.i = p.i THEN 0 ELSE 1 END, (('0x'||substr(md5('pick:'||seed||':'||vec_id), 1, 13))::BIGINT), p.i) - 1 AS step FROM st, p),
f AS (SELECT *, (row_number() OVER (PARTITION BY seed, species ORDER BY step) = 1)::INT AS new FROM o WHERE step < {budget}) SELECT seed, step, vec_id, CAST(sum(new) OVER (PARTITION BY seed ORDER BY step) AS BIGINT) AS n_species FROM f"""


_ORDER = _order_sql(SEEDS, BUDGET)


@query("dom36_random_acquisition", _ORDER)
def dom36(spark, sf):
    return _small_runs(spark, sf, "random").drop("strategy")


@query("dom36_random_acquisition_full", _order_sql(FULL_SEEDS, FULL_BUDGET))
def dom36_full(spark, sf):
    return _runs(spark, sf, ("random",)).drop("strategy")


def _center_sql(strategy: str, distance: str, seeds: int = SEEDS, budget: int = BUDGET) -> str:
    """k-center by recursion: the state holds the pick and each record's least distance so far."""
    step = f"list_transform(range(1, n + 1), lambda k: CASE WHEN k = {{p}} THEN -1e9::DOUBLE ELSE {{old}} END)"
    d = distance.replace("{p}", "np")
    first = step.format(p="np", old=d)
    then = step.format(p="np", old=f"least(md[k], {d})")
    return f"""WITH RECURSIVE {POOL}, u AS (SELECT *, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x/sqrt({_DOT('embedding', 'embedding')})) AS e FROM pool),
p AS (SELECT count(*) AS n, list(e ORDER BY vec_id) AS es, list(radians(lat) ORDER BY vec_id) AS la, list(radians(lon) ORDER BY vec_id) AS lo, list(lat ORDER BY vec_id) AS ya, list(lon ORDER BY vec_id) AS xo, list(vec_id ORDER BY vec_id) AS ids, list(species ORDER BY vec_id) AS sp FROM u),
st AS (SELECT CAST(s AS BIGINT) AS seed, least(CAST(floor((('0x'||substr(md5('start:'||s), 1, 13))::BIGINT/{float(1 << 52)!r}) * n) AS BIGINT), n-1) + 1 AS np FROM range({seeds}) t(s), p),
r AS (SELECT seed, 0 AS step, np AS pick, {first} AS md FROM st, p UNION ALL SELECT seed, step + 1, np, {then} FROM (SELECT *, list_position(md, list_max(md)) AS np FROM r WHERE step < {budget - 1}) q, p),
f AS (SELECT seed, step, ids[pick] AS vec_id, (row_number() OVER (PARTITION BY seed, sp[pick] ORDER BY step) = 1)::INT AS new FROM r, p)
SELECT '{strategy}' AS strategy, seed, CAST(step AS BIGINT) AS step, vec_id, CAST(sum(new) OVER (PARTITION BY seed ORDER BY step) AS BIGINT) AS n_species FROM f"""


_CENTERS = {
    "spatial_coverage": "2*asin(sqrt(least(1, greatest(0, pow(sin((la[k]-la[{p}])/2), 2) + cos(la[k])*cos(la[{p}])*pow(sin((lo[k]-lo[{p}])/2), 2)))))",
    "spatial_coverage_raw": "sqrt(pow(ya[k]-ya[{p}], 2) + pow(xo[k]-xo[{p}], 2))",
    "embedding_novelty": "1 - list_inner_product(es[k], es[{p}])",
}


def _greedy(name, strategy):
    if strategy == "spatial_coverage_raw":
        query(name, _center_sql(strategy, _CENTERS[strategy], FULL_SEEDS, FULL_BUDGET))(lambda spark, sf: _runs(spark, sf, (strategy,)))
        name += "_full"
    elif strategy in _CENTERS:
        query(name, _center_sql(strategy, _CENTERS[strategy]))(lambda spark, sf: _small_runs(spark, sf, strategy))
        name += "_full"
    query(name)(lambda spark, sf: _runs(spark, sf, (strategy,)))


for _n, _s in (("dom37_spatial_coverage", "spatial_coverage"), ("dom38_spatial_coverage_raw", "spatial_coverage_raw"), ("dom39_embedding_novelty", "embedding_novelty"), ("dom40_kmeanspp", "embedding_kmeanspp"), ("dom41_combined", "combined"), ("dom42_combined_raw", "combined_raw")):
    _greedy(_n, _s)


@query("agg21_curve_area")
def agg21(spark, sf):
    return acquire.curve_area(_runs(spark, sf), FULL_BUDGET)


@query("agg22_mean_curve")
def agg22(spark, sf):
    return _runs(spark, sf).groupBy("strategy", "step").agg(F.avg("n_species").alias("mean"), F.stddev_pop("n_species").alias("sd"))


@query("dom46_contrasts")
def dom46(spark, sf):
    return acquire.contrasts(acquire.curve_area(_runs(spark, sf), FULL_BUDGET), REPLICATES)


_PAIRS = "prs AS (SELECT c_custkey AS unit, (c_custkey*37 % 101 - 45)/10.0e0 AS d FROM customer)"
_HASH = lambda *p: "(('0x'||substr(md5(" + "||':'||".join(p) + "), 1, 8))::BIGINT % 2147483648)"


def _pairs(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("unit"), ((F.col("c_custkey") * 37 % 101 - 45) / 10.0).alias("d"))


@query("dom44_sign_flip", f"WITH {_PAIRS}, m AS (SELECT b, abs(avg(CASE WHEN {_HASH(chr(39) + 'sign' + chr(39), 'b', 'unit')} % 2 = 0 THEN d ELSE -d END)) AS m FROM prs, range({REPLICATES}) t(b) GROUP BY b), s AS (SELECT avg(d) AS mean_diff FROM prs) SELECT mean_diff, avg(CASE WHEN m >= abs(mean_diff) - 1e-12 THEN 1.0e0 ELSE 0 END) AS p FROM m, s GROUP BY mean_diff", "mean_diff p")
def dom44(spark, sf):
    return S.sign_flip_p(_pairs(spark, sf), REPLICATES)


@query("dom45_bootstrap", f"WITH {_PAIRS}, r AS (SELECT d, row_number() OVER (ORDER BY unit) - 1 AS i, count(*) OVER () AS n FROM prs), m AS (SELECT b, avg(x.d) AS m FROM (SELECT b, {_HASH(chr(39) + 'boot' + chr(39), 'b', 'i')} % n AS j FROM r, range({REPLICATES}) t(b)) q JOIN r x ON x.i = q.j GROUP BY b) SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m", "lo hi")
def dom45(spark, sf):
    return S.bootstrap_interval(_pairs(spark, sf), REPLICATES)


_CURVE = f"f AS (SELECT grp, id AS step, taxon AS species, (row_number() OVER (PARTITION BY grp, taxon ORDER BY id) = 1)::INT AS new FROM (SELECT DISTINCT grp, id, taxon FROM {{rows}})) SELECT grp, step, species, CAST(sum(new) OVER (PARTITION BY grp ORDER BY step, species) AS BIGINT) AS n_species FROM f"


@query("win12_accumulation", f"WITH {OBS}, {_CURVE.format(rows='obs')}")
def win12(spark, sf):
    o = obs(spark, sf).select("grp", F.col("id").alias("step"), F.col("taxon").alias("species"))
    return acquire.accumulation(o, ["grp"], o)


@query("win11_effort_curve", f"{_BIN}, c AS (SELECT gi, count(*) AS n, count(DISTINCT taxon) AS s FROM b GROUP BY gi) SELECT gi, CAST(sum(n) OVER (ORDER BY s DESC, gi) AS BIGINT) AS effort, CAST(sum(s) OVER (ORDER BY s DESC, gi) AS BIGINT) AS found FROM c")
def win11(spark, sf):
    c = _b(spark, sf).groupBy("gi").agg(F.count("*").alias("n"), F.count_distinct("taxon").alias("s"))
    w = Window.orderBy(F.col("s").desc(), "gi").rowsBetween(Window.unboundedPreceding, 0)
    return c.select("gi", F.sum("n").over(w).alias("effort"), F.sum("s").over(w).alias("found"))


@query("win14_recent_and_all", f"{_BIN} SELECT gi, gj, count(*) AS n_all, count(*) FILTER (WHERE day >= DATE '1997-01-01') AS n_recent FROM b GROUP BY ALL")
def win14(spark, sf):
    return _b(spark, sf).groupBy("gi", "gj").agg(F.count("*").alias("n_all"), F.count_if(F.col("day") >= F.lit("1997-01-01").cast("date")).alias("n_recent"))


@query("dom49_separability", f"WITH {POOL}, d AS (SELECT a.vec_id, a.species, b.species AS other, {_DOT('a.embedding', 'b.embedding')}/(sqrt({_DOT('a.embedding', 'a.embedding')})*sqrt({_DOT('b.embedding', 'b.embedding')})) AS c, b.vec_id AS bid FROM pool a JOIN pool b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), n AS (SELECT vec_id, species, arg_max(other, c) AS nearest FROM d GROUP BY 1, 2) SELECT count(*) AS n, avg((species = nearest)::INT) AS accuracy FROM n", "accuracy")
def dom49(spark, sf):
    p = pool(spark, sf)
    # every fiftieth record asks, all records answer
    found = vectors.nearest(p, p.where("vec_id % 50 = 0"), "vec_id", "species", "embedding")
    return found.agg(F.count("*").alias("n"), F.avg((F.col("own") == F.col("nearest")).cast("int")).alias("accuracy"))


RARE_BEFORE = "1995-07-01"


@query("dom50_rare_species", f"WITH {OBS}, r AS (SELECT taxon FROM obs WHERE day < DATE '{RARE_BEFORE}' GROUP BY taxon HAVING count(*) <= 3), o AS (SELECT * FROM obs JOIN r USING (taxon)), {_CURVE.format(rows='o')}")
def dom50(spark, sf):
    """The accumulation curve of the species that have at most three records before a day."""
    o = obs(spark, sf)
    steps = o.select(F.col("id").alias("step"))
    o = o.repartition(tasks_for(o), "taxon")
    rare = o.where(F.col("day") < F.lit(RARE_BEFORE).cast("date")).groupBy("taxon").agg(F.count(F.lit(1)).alias("n")).where("n <= 3").select("taxon")
    curve = o.join(rare, "taxon").select("grp", F.col("id").alias("step"), F.col("taxon").alias("species"))
    return acquire.accumulation(curve, ["grp"], steps)


# ---- rasters
_PIX = "pix AS (SELECT 'dense' AS layer, CAST(p_partkey // 50 AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col, CASE WHEN p_size = 5 THEN NULL ELSE p_retailprice END AS value FROM part UNION ALL SELECT 'sparse', CAST(p_partkey // 50 AS INT), CAST(p_partkey % 50 AS INT), CASE WHEN p_size = 5 THEN NULL WHEN p_size % 10 = 1 THEN p_size/50.0e0 ELSE 0 END FROM part UNION ALL SELECT 'empty', CAST(p_partkey // 50 AS INT), CAST(p_partkey % 50 AS INT), NULL FROM part UNION ALL SELECT 'zero', CAST(p_partkey // 50 AS INT), CAST(p_partkey % 50 AS INT), 0.0e0 FROM part)"


def pixels(spark, sf):
    p = table(spark, sf, "part")
    place = [F.floor(F.col("p_partkey") / 50).cast("int").alias("row"), (F.col("p_partkey") % 50).cast("int").alias("col")]
    void = F.col("p_size") == 5
    layers = {"dense": F.when(~void, F.col("p_retailprice")), "sparse": F.when(void, None).when(F.col("p_size") % 10 == 1, F.col("p_size") / 50.0).otherwise(0.0), "empty": F.lit(None).cast("double"), "zero": F.lit(0.0)}
    out = None
    for name, v in layers.items():
        one = p.select(F.lit(name).alias("layer"), *place, v.cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


_STATS = f"""WITH {_PIX}, s AS (SELECT layer, count(*) AS n, count(value) AS nv, count(*) FILTER (WHERE value > 0) AS np, min(value) AS minimum, max(value) AS maximum, quantile_cont(value, 0.02) AS p2, quantile_cont(value, 0.98) AS p98, quantile_cont(value, 0.98) FILTER (WHERE value > 0) AS ppos FROM pix GROUP BY layer),
z AS (SELECT *, coalesce(1 - np/nullif(nv, 0)::DOUBLE, 1) AS zf FROM s), b AS (SELECT *, zf > 0.5 AND np > 0 AS sparse_branch FROM z), c AS (SELECT *, CASE WHEN sparse_branch THEN ppos ELSE p98 END AS ce FROM b)
SELECT layer, minimum, maximum, p2, p98, round(100.0e0*nv/n, 4) AS valid_percent, round(zf, 4) AS zero_frac, sparse_branch, round(CASE WHEN nv=0 THEN 1 WHEN ce<=0 THEN greatest(1, maximum) ELSE ce END, 4) AS render_vmax, nv=0 AS empty FROM c"""


@query("agg14_display_stats", _STATS, "minimum maximum p2 p98 valid_percent zero_frac render_vmax")
def agg14(spark, sf):
    return raster.display_stats(pixels(spark, sf))


@query("agg16_utilisation", f"SELECT layer, least(1, greatest(0, coalesce((p98-p2)/render_vmax, 0))) AS utilisation FROM ({_STATS})", "utilisation")
def agg16(spark, sf):
    return raster.utilisation(raster.display_stats(pixels(spark, sf)))


@query("dom54_stac_items")
def dom54(spark, sf):
    return raster.stac_items(raster.display_stats(pixels(spark, sf)), F.concat(F.lit("https://x.org/data/"), F.col("layer"), F.lit(".Tif")), F.lit("EPSG:4326"))


@query("src18_pooled_mosaic", f"WITH {_PIX} SELECT row // 5 AS row, col // 5 AS col, max(v) AS value FROM (SELECT layer, row, col, avg((value > 0)::INT) OVER (PARTITION BY layer, row // 5, col // 5) AS v FROM pix WHERE layer IN ('dense', 'sparse') AND value IS NOT NULL) GROUP BY 1, 2", "value")
def src18(spark, sf):
    p = raster.pooled(pixels(spark, sf).where("layer IN ('dense', 'sparse') AND value IS NOT NULL"), 5, (F.col("value") > 0).cast("int"))
    return raster.mosaic(p.withColumn("layer", F.lit("all"))).drop("layer")


@query("src15_sub_grid_means", f"WITH {_PIX}, c AS (SELECT DISTINCT row // 4 AS gi, col // 4 AS gj FROM pix WHERE layer='dense'), k AS (SELECT -1.5e0 + 3.0e0*i/6 AS d FROM range(7) t(i)), pts AS (SELECT gi, gj, CAST(floor(gi*4+2.0e0+a.d) AS INT) AS row, CAST(floor(gj*4+2.0e0+b.d) AS INT) AS col FROM c, k a, k b) SELECT gi, gj, avg(value) AS mean, count(value) AS n_valid FROM pts LEFT JOIN (SELECT * FROM pix WHERE layer='dense') USING (row, col) GROUP BY 1, 2", "mean")
def src15(spark, sf):
    p = pixels(spark, sf).where("layer = 'dense'")
    c = p.select(F.floor(F.col("row") / 4).cast("int").alias("gi"), F.floor(F.col("col") / 4).cast("int").alias("gj")).distinct().withColumns({"clat": F.col("gi") * 4 + 2.0, "clon": F.col("gj") * 4 + 2.0})
    return raster.sub_grid_means(c, p, ["gi", "gj"], 1.5, 7, 0.0, 0.0, 1.0, 1.0)


@query("dom55_clip_summary", f"WITH {_PIX} SELECT layer, count(value) AS n, avg(value) AS mean, max(value) AS most FROM pix WHERE row BETWEEN 5 AND 20 AND col BETWEEN 10 AND 30 GROUP BY layer", "mean most")
def dom55(spark, sf):
    return pixels(spark, sf).where("row BETWEEN 5 AND 20 AND col BETWEEN 10 AND 30").groupBy("layer").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most"))


@query("src17_band_stack", f"WITH {_PIX} SELECT row, col, max(CASE WHEN layer='dense' THEN value*0.1e0 - 3 END) AS dense, max(CASE WHEN layer='sparse' THEN value*0.1e0 - 3 END) AS sparse FROM pix WHERE row < 10 GROUP BY 1, 2", "dense sparse")
def src17(spark, sf):
    scaled = pixels(spark, sf).where("row < 10").withColumn("value", F.col("value") * 0.1 - 3)
    return scaled.groupBy("row", "col").pivot("layer", ["dense", "sparse"]).agg(F.max("value"))


# ---- backlog
_NEEDS = "needs AS (SELECT event_id, CAST(user_id % 12 AS INT) AS gi, CAST(user_id % 7 AS INT) AS gj, ts AS created, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 5 AS INT) END AS idents, CASE event_id % 5 WHEN 0 THEN 'species' WHEN 1 THEN 'genus' WHEN 2 THEN 'family' WHEN 3 THEN 'order' ELSE 'class' END AS rank FROM events WHERE event_type <> 'click'), done AS (SELECT CAST(user_id % 12 AS INT) AS gi, CAST(user_id % 7 AS INT) AS gj FROM events WHERE event_type = 'click')"
REFERENCE = "2024-06-14 00:00:00"


def _needs(spark, sf):
    e = table(spark, sf, "events")
    cell = [(F.col("user_id") % 12).cast("int").alias("gi"), (F.col("user_id") % 7).cast("int").alias("gj")]
    rank = F.get(F.array(*[F.lit(r) for r in ("species", "genus", "family", "order", "class")]), (F.col("event_id") % 5).cast("int"))
    needs = e.where("event_type <> 'click'").select("event_id", *cell, F.col("ts").cast("timestamp").alias("created"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 5).cast("int").alias("idents"), rank.alias("rank"))
    return needs, e.where("event_type = 'click'").select(*cell)


_WAIT = f"(epoch_us(TIMESTAMP '{REFERENCE}') - epoch_us(created))/8.64e10"


@query("dom33_backlog_cells", f"WITH {_NEEDS}, a AS (SELECT gi, gj, count(*) AS n_need, median({_WAIT}) AS median_wait, avg((coalesce(idents, 0) <= 1)::INT) AS idle_share FROM needs GROUP BY 1, 2), d AS (SELECT gi, gj, count(*) AS n_done FROM done GROUP BY 1, 2), f AS (SELECT gi, gj, coalesce(n_need, 0) AS n_need, coalesce(n_done, 0) AS n_done, median_wait, idle_share FROM a FULL JOIN d USING (gi, gj)) SELECT gi, gj, n_need, n_done, n_need/(n_need+n_done)::DOUBLE AS backlog, median_wait, idle_share FROM f WHERE n_need+n_done >= 5", "backlog median_wait idle_share")
def dom33(spark, sf):
    return backlog.backlog_cells(*_needs(spark, sf), REFERENCE)


@query("dom34_confusability", f"WITH {_NEEDS}, w AS (SELECT -(CASE rank WHEN 'species' THEN 6 WHEN 'genus' THEN 5 WHEN 'family' THEN 4 WHEN 'order' THEN 3 ELSE 2 END) AS c, {_WAIT} AS wait FROM needs), r AS (SELECT rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1)/2.0e0 AS a, rank() OVER (ORDER BY wait) + (count(*) OVER (PARTITION BY wait) - 1)/2.0e0 AS b FROM w) SELECT count(*) AS n, corr(a, b) AS rho FROM r", "rho")
def dom34(spark, sf):
    return S.spearman_of_rows(backlog.with_wait(_needs(spark, sf)[0], REFERENCE), "coarse", "wait", min_n=12)


@query("agg17_backlog_summary", f"WITH {_NEEDS} SELECT rank, count(*) AS n, avg((coalesce(idents, 0) <= 1)::INT) AS idle_share, median({_WAIT}) AS median_wait FROM needs GROUP BY rank", "idle_share median_wait")
def agg17(spark, sf):
    return backlog.with_wait(_needs(spark, sf)[0], REFERENCE).groupBy("rank").agg(F.count("*").alias("n"), F.avg(F.col("idle").cast("double")).alias("idle_share"), F.median("wait").alias("median_wait"))


# ---- scalars
@query("scl_labels", "SELECT c_custkey, CASE WHEN x < 0.2 THEN 'gap' WHEN x < 0.6 THEN 'partial' ELSE 'ok' END AS coverage, CAST(floor(x*100) AS BIGINT)||'/100' AS score, replace(replace(c_name, '&', '&amp;'), '#', '#') AS name FROM (SELECT *, (c_custkey % 97)/97.0e0 AS x FROM customer)")
def scl_labels(spark, sf):
    x = (F.col("c_custkey") % 97) / 97.0
    return table(spark, sf, "customer").select("c_custkey", X.coverage_label(x).alias("coverage"), X.score_label(x).alias("score"), X.html_escape(F.col("c_name")).alias("name"))


@query("scl_text", "SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+?)(\\.[^./]*)?$', 1)) AS stem, CASE WHEN starts_with(url, 'https://') THEN replace(url, '&', '&amp;') ELSE '' END AS safe FROM pages")
def scl_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.stem_of_url(F.col("url")).alias("stem"), X.https_only(F.col("url")).alias("safe"))


@query("scl_display")
def scl_display(spark, sf):
    t = (F.col("c_custkey") % 97) / 96.0
    return table(spark, sf, "customer").select(
        "c_custkey", X.ramp_colour(t).alias("colour"), X.duration_label(t * 40).alias("time"), X.co2_label(t * 20 - 1).alias("co2"), X.lut_index(t, 0.9).alias("lut"), X.cell_key(t * 40 + 41, -t * 80).alias("key"),
        X.dominant_index(F.array(t, 1 - t, F.lit(0.4))).alias("main"), X.p_label(t / 100, 0.0005).alias("p"), X.epsg(F.concat(F.lit("EPSG:"), F.col("c_custkey").cast("string"))).alias("epsg"), X.tile_of(t * 40 + 41, -t * 80, 6)[0].alias("tile_x"),
    )


@query("scl7_staleness_score", f"{_BIN}, c AS (SELECT gi, count(*) AS a, count(*) FILTER (WHERE day >= DATE '1997-01-01') AS r FROM b GROUP BY gi) SELECT gi, CASE WHEN a >= 20 THEN (1 - least(r, a)/a::DOUBLE)*ln(1+a) END AS s FROM c", "s")
def scl7(spark, sf):
    c = _b(spark, sf).groupBy("gi").agg(F.count("*").alias("a"), F.count_if(F.col("day") >= F.lit("1997-01-01").cast("date")).alias("r"))
    return c.select("gi", X.staleness_score(F.col("a"), F.col("r")).alias("s"))


@query("scl5_cell_area", f"{_BIN} SELECT DISTINCT gi, pow(111.32e0*{RES}, 2)*cos(radians((gi+0.5e0)*{RES})) AS km2, CAST(round_even(0.37e0*pow(111.32e0*{RES}, 2)*cos(radians((gi+0.5e0)*{RES})), 0) AS BIGINT) AS implied FROM b", "km2")
def scl5(spark, sf):
    lat = C.centre(F.col("gi"), RES)
    return _b(spark, sf).select("gi").distinct().select("gi", X.cell_area_km2(lat, RES).alias("km2"), X.implied_records(F.lit(0.37), lat, RES).alias("implied"))


# ---- sources
@query("src1_csv_scan", f"WITH {OBS} SELECT id, lat, lon, taxon, day, rank FROM obs", "lat lon")
def src1(spark, sf):
    path = scratch(spark)
    obs(spark, sf).select("id", "lat", "lon", "taxon", "day", "rank").write.option("header", True).csv(path)
    return files.read_csv(spark, path).withColumn("day", files.day_of(F.col("day")))


@query("src2_files_by_group", f"WITH {OBS} SELECT CASE WHEN grp='O' THEN 'Aves' ELSE 'Insecta' END AS \"group\", CASE WHEN grp='O' THEN 'east' ELSE 'bc' END AS region, count(*) AS n FROM obs GROUP BY 1, 2")
def src2(spark, sf):
    path, o = scratch(spark), obs(spark, sf).select("id", "lat", "lon", "taxon", "day", "rank", "grp")
    for g, name in (("O", "inat_east_Aves.csv"), ("F", "inat_Insecta.csv")):
        o.where(F.col("grp") == g).drop("grp").write.option("header", True).csv(f"{path}/{name}")
    return files.count_by_group(spark, f"{path}/*.csv")


@query("src4_positional_json", f"WITH {OBS}, c AS (SELECT grp, floor(lat/5)*5.0e0 AS lat, floor(lon/5)*5.0e0 AS lon, count(*) AS n FROM obs GROUP BY ALL) SELECT grp, lat, lon, n::DOUBLE AS n_train FROM c", "lat lon n_train")
def src4(spark, sf):
    path = scratch(spark)
    zero = F.lit(0.0)
    o = obs(spark, sf).groupBy("grp", (F.floor(F.col("lat") / 5) * 5.0).alias("lat"), (F.floor(F.col("lon") / 5) * 5.0).alias("lon")).agg(F.count("*").alias("n_train"))
    rows = o.select("grp", "lat", "lon", *[zero.alias(c) for c in files.ROW[2:8]], "n_train")
    files.positional_json(rows).select("doc").write.text(path)
    return files.read_positional(spark, path).select("grp", "lat", "lon", "n_train")


@query("src5_keyset_pages", f"WITH {OBS} SELECT id, CAST((row_number() OVER (ORDER BY id DESC) - 1) // 200 AS INT) AS page FROM (SELECT id FROM obs ORDER BY id DESC LIMIT 1600)")
def src5(spark, sf):
    return files.keyset_pages(obs(spark, sf).select("id"), "id", 200, 8)


@query("src9_occurrence_cells", f"{_BIN} SELECT DISTINCT taxon, gi, gj FROM b")
def src9(spark, sf):
    return _b(spark, sf).select("taxon", "gi", "gj").distinct()


@query("agg29_manifest_hash", "SELECT sha256(string_agg(path||':'||h, chr(10) ORDER BY path||':'||h)) AS manifest_hash, count(*) AS n_files FROM (SELECT 'doc'||doc_id||'.txt' AS path, sha256(text) AS h FROM documents)")
def agg29(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return provenance.manifest_hash(d)


@query("hsh1_file_records")
def hsh1(spark, sf):
    return provenance.file_records(spark, f"{sf}/*.parquet")


@query("top2_top_fifth", f"{_BIN}, c AS (SELECT gi, gj, count(*) AS n FROM b GROUP BY ALL) SELECT gi, gj, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, gi, gj) AS r, greatest(1, count(*) OVER () // 5) AS k FROM c) WHERE r <= k")
def top2(spark, sf):
    from cellscope.operators.scaling import with_totals

    c = with_totals(_b(spark, sf).groupBy("gi", "gj").agg(F.count("*").alias("n")), __n=F.count("*"))
    return c.withColumn("r", F.row_number().over(Window.orderBy(F.col("n").desc(), "gi", "gj"))).where("r <= greatest(1, __n div 5)").select("gi", "gj", "n")


@query("agg20_best_candidate", f"{_BIN}, c AS (SELECT gi, count(*) FILTER (WHERE rank='A') AS a, count(*) FILTER (WHERE rank='N') AS n, count(*) FILTER (WHERE rank='R') AS r FROM b GROUP BY gi) SELECT CASE WHEN a >= n AND a >= r THEN 'a' WHEN n >= r THEN 'n' ELSE 'r' END AS best, count(*) AS wins FROM c GROUP BY 1")
def agg20(spark, sf):
    c = _b(spark, sf).groupBy("gi").agg(*[F.count_if(F.col("rank") == k.upper()).alias(k) for k in "anr"])
    most = F.greatest("a", "n", "r")
    return c.groupBy(F.when(F.col("a") == most, "a").when(F.col("n") == most, "n").otherwise("r").alias("best")).agg(F.count("*").alias("wins"))


@query("agg9_median_and_share", f"WITH {OBS} SELECT grp, median(lat) AS mid_lat, avg((rank='R')::INT) AS share FROM obs GROUP BY grp", "mid_lat share")
def agg9(spark, sf):
    return obs(spark, sf).groupBy("grp").agg(F.median("lat").alias("mid_lat"), F.avg((F.col("rank") == "R").cast("int")).alias("share"))


@query("agg10_quantiles", "SELECT p_brand, quantile_cont(p_retailprice, 0.02) AS p2, quantile_cont(p_retailprice, 0.5) AS p50, quantile_cont(p_retailprice, 0.98) AS p98 FROM part GROUP BY p_brand", "p2 p50 p98")
def agg10(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(*[F.percentile("p_retailprice", F.lit(q)).alias(n) for n, q in (("p2", 0.02), ("p50", 0.5), ("p98", 0.98))])
