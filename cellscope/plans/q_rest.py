"""Short forms of operators that other queries use inside, so that each can be run and checked alone."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellscope.functions import scalars as X
from cellscope.operators import acquire, provenance, raster
from cellscope.operators import axes as A
from cellscope.operators import cells as C
from cellscope.operators import impact as I
from cellscope.operators import scaling as W
from cellscope.operators import statistics as S
from cellscope.plans import q_cells, q_map, q_more
from cellscope.plans.base import query
from cellscope.sources.scratch import scratch
from cellscope.plans.views import COARSE, OBS, RES, SPLIT, cells_sql, obs, table

_BIN = f"WITH {OBS}, b AS (SELECT *, CAST(floor(lat/{RES}) AS INT) AS gi, CAST(floor(lon/{RES}) AS INT) AS gj FROM obs)"
_GRID = f"WITH {q_map.GRID}"
_START = q_map.START


def _b(spark, sf):
    return C.binned(obs(spark, sf), RES)


# ---- projections
@query("prj13_prospect_filter", f"WITH {OBS} SELECT taxon, count(*) AS n FROM obs GROUP BY taxon HAVING count(*) > 30")
def prj13(spark, sf):
    return obs(spark, sf).groupBy("taxon").agg(F.count("*").alias("n")).where("n > 30")


@query("prj18_present_columns", f"{_GRID} SELECT gi, gj, temp, loss FROM grid", "temp loss")
def prj18(spark, sf):
    g = q_map.grid(spark, sf)
    return g.select("gi", "gj", *[c for c in ("temp", "absent", "loss") if c in g.columns])


@query("prj19_schema_guard", "SELECT count(*) AS n FROM part")
def prj19(spark, sf):
    p, needed = table(spark, sf, "part"), {"p_partkey", "p_size"}
    if not needed <= set(p.columns):
        raise ValueError(f"missing columns: {sorted(needed - set(p.columns))}")
    return p.agg(F.count("*").alias("n"))


# ---- joins
_CELLS = f"WITH {cells_sql(COARSE)}"
_APP = "app AS (SELECT gi, gj, ((gi*7+gj*13)%101+101)%101/100.0e0 AS env FROM cells WHERE (gi+gj+1000)%3 <> 0)"


def _cells(spark, sf):
    return q_cells._cells(spark, sf, COARSE)


def _app(cells):
    return cells.where("(gi + gj + 1000) % 3 <> 0").select("gi", "gj", (F.pmod(F.col("gi") * 7 + F.col("gj") * 13, F.lit(101)) / 100.0).alias("env"))


@query("jn2_cells_with_axes", f"{_CELLS}, {_APP} SELECT gi, gj, n_train, env FROM cells JOIN app USING (gi, gj)", "env")
def jn2(spark, sf):
    cells = _cells(spark, sf)
    return cells.join(_app(cells), ["gi", "gj"]).select("gi", "gj", "n_train", "env")


@query("jn3_layer_or_proxy", f"{_CELLS}, {_APP} SELECT gi, gj, coalesce(env, scarcity) AS stale FROM cells LEFT JOIN app USING (gi, gj)", "stale")
def jn3(spark, sf):
    cells = _cells(spark, sf)
    return cells.join(_app(cells), ["gi", "gj"], "left").select("gi", "gj", F.coalesce("env", "scarcity").alias("stale"))


@query("jn4_gap_defaults", f"{_CELLS}, {_APP}, g AS (SELECT CAST(a.i AS INT) AS gi, CAST(b.j AS INT) AS gj FROM range(16, 34) a(i), range(-57, -20) b(j)) SELECT gi, gj, coalesce(env, 1.0e0) AS discover, coalesce(n_train, 0) AS n FROM g LEFT JOIN app USING (gi, gj) LEFT JOIN cells USING (gi, gj)", "discover")
def jn4(spark, sf):
    cells = _cells(spark, sf)
    grid = spark.range(16, 34).select(F.col("id").cast("int").alias("gi")).withColumn("gj", F.explode(F.sequence(F.lit(-57), F.lit(-21))))
    out = grid.join(_app(cells), ["gi", "gj"], "left").join(cells.select("gi", "gj", "n_train"), ["gi", "gj"], "left")
    return out.select("gi", "gj", F.coalesce("env", F.lit(1.0)).alias("discover"), F.coalesce("n_train", F.lit(0)).alias("n"))


@query("jn6_scored_with_discover", f"{_CELLS}, {_APP} SELECT gi, gj, priority, env FROM cells LEFT JOIN app USING (gi, gj) WHERE n_test >= 5", "priority env")
def jn6(spark, sf):
    cells = _cells(spark, sf)
    return cells.where("n_test >= 5").join(_app(cells), ["gi", "gj"], "left").select("gi", "gj", "priority", "env")


@query("jn8_status_by_occurrence", f"WITH {OBS}, {q_map._STATUS} SELECT status, count(DISTINCT (CAST(floor(lat/{COARSE}) AS INT), CAST(floor(lon/{COARSE}) AS INT))) AS n_cells FROM obs JOIN status USING (taxon) GROUP BY status")
def jn8(spark, sf):
    o = C.binned(obs(spark, sf), COARSE)
    return o.join(q_map._status(o), "taxon").groupBy("status").agg(F.count_distinct("gi", "gj").alias("n_cells"))


@query("jn9_hidden_cells", f"{_BIN} SELECT DISTINCT gi, gj FROM b WHERE (gi + gj) % 3 <> 0")
def jn9(spark, sf):
    keyed = _b(spark, sf).select("gi", "gj").distinct().withColumn("key", X.cell_key(C.centre(F.col("gi"), RES), C.centre(F.col("gj"), RES)))
    hidden = keyed.where("(gi + gj) % 3 = 0").select("key")
    return keyed.join(hidden, "key", "left_anti").select("gi", "gj")


@query("jn12_neighbourhood_only", f"WITH {OBS} SELECT DISTINCT taxon FROM obs WHERE {q_more._IN(6.0)} AND taxon NOT IN (SELECT taxon FROM obs WHERE {q_more._IN(2.0)})")
def jn12(spark, sf):
    from cellscope.operators.species import in_box

    o = obs(spark, sf)
    near = lambda h: o.where(in_box(F.col("lat"), F.col("lon"), q_more._AT, h)).select("taxon").distinct()
    return near(6.0).join(near(2.0), "taxon", "left_anti")


@query("jn17_correlation_matrix", f"{_GRID} SELECT corr(temp, rain) AS temp_rain, corr(temp, n_all) AS temp_n, corr(rain, n_all) AS rain_n FROM grid", "temp_rain temp_n rain_n")
def jn17(spark, sf):
    c = lambda a, b: S.safe_corr(F.col(a), F.col(b))
    return q_map.grid(spark, sf).agg(c("temp", "rain").alias("temp_rain"), c("temp", "n_all").alias("temp_n"), c("rain", "n_all").alias("rain_n"))


# ---- aggregates
@query("agg8_mean_species_weight", f"{_BIN} SELECT gi, avg(CASE taxon % 5 WHEN 0 THEN 16.0e0 WHEN 1 THEN 4.0e0 ELSE 1.0e0 END) AS w FROM (SELECT DISTINCT gi, taxon FROM b) GROUP BY gi", "w")
def agg8(spark, sf):
    code = F.get(F.array(F.lit("CR"), F.lit("VU")), (F.col("taxon") % 5).cast("int"))
    return _b(spark, sf).select("gi", "taxon").distinct().groupBy("gi").agg(F.avg(X.lookup(code, X.THREAT_WEIGHTS, 1.0).cast("double")).alias("w"))


@query("agg15_display_ceiling", f"SELECT layer, sparse_branch, render_vmax FROM ({q_more._STATS})", "render_vmax")
def agg15(spark, sf):
    return raster.display_stats(q_more.pixels(spark, sf)).select("layer", "sparse_branch", "render_vmax")


@query("agg26_median_over_groups", f"{_BIN}, c AS (SELECT grp, gi, count(*) AS n, count(DISTINCT taxon) AS s FROM b GROUP BY ALL), r AS (SELECT gi, corr(n, s) OVER (PARTITION BY grp) AS rho FROM c) SELECT median(rho) AS mid, count(*) FILTER (WHERE rho > 0.5) AS agreeing FROM r", "mid")
def agg26(spark, sf):
    c = _b(spark, sf).groupBy("grp", "gi").agg(F.count("*").alias("n"), F.count_distinct("taxon").alias("s"))
    r = c.join(c.groupBy("grp").agg(S.safe_corr(F.col("n"), F.col("s")).alias("rho")), "grp")
    return r.agg(F.median("rho").alias("mid"), F.count_if(F.col("rho") > 0.5).alias("agreeing"))


@query("agg27_verdict", f"WITH r AS ({q_cells._SENS}) SELECT min(rho) AS lo, max(rho) AS hi, median(rho) AS mid, CASE WHEN min(rho) > 0 THEN 'all positive' WHEN max(rho) < 0 THEN 'all negative' ELSE 'mixed' END AS verdict FROM r", "lo hi mid")
def agg27(spark, sf):
    verdict = F.when(F.min("rho") > 0, "all positive").when(F.max("rho") < 0, "all negative").otherwise("mixed")
    return q_cells.dom8(spark, sf).agg(F.min("rho").alias("lo"), F.max("rho").alias("hi"), F.median("rho").alias("mid"), verdict.alias("verdict"))


@query("agg28_points_into_cells", f"WITH {OBS}, {q_map._STALE} SELECT gi, gj, n_all, n_recent FROM st")
def agg28(spark, sf):
    return q_map._points(obs(spark, sf)).groupBy("gi", "gj").agg(F.sum("n").alias("n_all"), F.sum(F.when(F.col("recent"), F.col("n")).otherwise(0)).alias("n_recent"))


# ---- windows and orders
@query("win2_min_max_with_nulls", f"{_GRID} SELECT gi, gj, {q_map._norm('travel')} AS t FROM grid", "t")
def win2(spark, sf):
    return W.min_max(q_map.grid(spark, sf), t=F.col("travel")).select("gi", "gj", "t")


@query("win7_lexicographic_rank", f"{_GRID} SELECT gi, gj, (row_number() OVER (ORDER BY n_all DESC, temp, gi DESC, gj) - 1)/greatest(count(*) OVER () - 1, 1)::DOUBLE AS place FROM grid", "place")
def win7(spark, sf):
    return W.lexicographic_share(q_map.grid(spark, sf), [F.col("n_all").desc(), F.col("temp"), F.col("gi").desc(), F.col("gj")], "place").select("gi", "gj", "place")


@query("win8_ordinal_percentile", f"{_GRID} SELECT gi, gj, (row_number() OVER (ORDER BY temp, gi, gj) - 1)/greatest(count(*) OVER () - 1, 1)::DOUBLE AS p FROM grid", "p")
def win8(spark, sf):
    return W.impact_percentile(q_map.grid(spark, sf), "temp", "p", C.KEYS).select("gi", "gj", "p")


@query("win13_curve_readout", f"WITH o AS ({q_more._order_sql(q_more.FULL_SEEDS, q_more.FULL_BUDGET)}) SELECT seed, b.b AS at, o.n_species FROM o JOIN (VALUES (5), (10), (50)) b(b) ON o.step = least(b.b, {q_more.FULL_BUDGET}) - 1")
def win13(spark, sf):
    runs = q_more.dom36_full(spark, sf).withColumn("at", F.explode(F.array(F.lit(5), F.lit(10), F.lit(50))))
    return runs.where(F.col("step") == F.least(F.col("at"), F.lit(q_more.FULL_BUDGET)) - 1).select("seed", "at", "n_species")


@query("win13_curve_readout_full", f"WITH o AS ({q_more._order_sql(q_more.FULL_SEEDS, q_more.FULL_BUDGET)}) SELECT seed, b.b AS at, o.n_species FROM o JOIN (VALUES (5), (10), (50)) b(b) ON o.step = b.b - 1")
def win13_full(spark, sf):
    runs = q_more.dom36_full(spark, sf).withColumn("at", F.explode(F.array(F.lit(5), F.lit(10), F.lit(50))))
    return runs.where(F.col("step") == F.col("at") - 1).select("seed", "at", "n_species")


@query("top3_largest_and_smallest", f"{_GRID}, a AS (SELECT 'largest' AS kind, gi, gj, n_all FROM grid ORDER BY n_all DESC, gi, gj LIMIT 8), z AS (SELECT 'smallest' AS kind, gi, gj, n_all FROM grid ORDER BY n_all, gi, gj LIMIT 8) SELECT * FROM a UNION ALL SELECT * FROM z")
def top3(spark, sf):
    g = q_map.grid(spark, sf).select("gi", "gj", "n_all")
    end = lambda k, o: g.orderBy(o, "gi", "gj").limit(8).select(F.lit(k).alias("kind"), "gi", "gj", "n_all")
    return end("largest", F.col("n_all").desc()).unionByName(end("smallest", F.col("n_all").asc()))


@query("top10_best_strategy")
def top10(spark, sf):
    means = acquire.curve_area(q_more._runs(spark, sf), q_more.FULL_BUDGET).groupBy("strategy").agg(F.avg("auc").alias("auc"))
    return means.agg(F.max_by("strategy", F.struct("auc", "strategy")).alias("strategy"), F.max("auc").alias("auc"))


@query("set2_new_species_sets", f"{_BIN}, a AS (SELECT gi, list(DISTINCT taxon) FILTER (WHERE day < DATE '{SPLIT}') AS old, list(DISTINCT taxon) FILTER (WHERE day >= DATE '{SPLIT}') AS new FROM b GROUP BY gi) SELECT gi, CAST(len(list_filter(new, lambda x: NOT list_contains(old, x))) AS BIGINT) AS n_new FROM a")
def set2(spark, sf):
    before = F.col("day") < F.lit(SPLIT).cast("date")
    sets = _b(spark, sf).groupBy("gi").agg(F.collect_set(F.when(before, F.col("taxon"))).alias("old"), F.collect_set(F.when(~before, F.col("taxon"))).alias("new"))
    return sets.select("gi", F.size(F.array_except("new", "old")).cast("bigint").alias("n_new"))


@query("set5_ordered_dedup", f"{_GRID}, u AS (SELECT gi, row_number() OVER (ORDER BY n_all DESC, gi, gj) AS place FROM grid) SELECT gi, min(place) AS place FROM u GROUP BY gi ORDER BY place LIMIT 12")
def set5(spark, sf):
    u = q_map.grid(spark, sf).select("gi", F.row_number().over(Window.orderBy(F.col("n_all").desc(), "gi", "gj")).cast("bigint").alias("place"))
    return u.groupBy("gi").agg(F.min("place").alias("place")).orderBy("place").limit(12)


# ---- scalars
_ANG = f"2*asin(sqrt(least(1.0e0, greatest(0.0e0, pow(sin(radians(clat-{_START[0]}e0)/2),2) + cos(radians({_START[0]}e0))*cos(radians(clat))*pow(sin(radians(clon-({_START[1]}e0))/2),2)))))"


@query("scl2_distances", f"{_GRID} SELECT gi, gj, {_ANG} AS angle, sqrt(pow(clat-{_START[0]}e0, 2)+pow(clon-({_START[1]}e0), 2)) AS degrees FROM grid", "angle degrees")
def scl2(spark, sf):
    at = (F.lit(_START[0]), F.lit(_START[1]), F.col("clat"), F.col("clon"))
    return q_map.grid(spark, sf).select("gi", "gj", X.haversine_angle(*at).alias("angle"), X.degrees_apart(*at).alias("degrees"))


@query("scl8_inverse_density", f"{_GRID}, i AS (SELECT gi, gj, 1/(coalesce(density, 0)+0.001e0) AS v FROM grid) SELECT gi, gj, {q_map._norm('v')} AS proxy FROM i", "proxy")
def scl8(spark, sf):
    return W.min_max(q_map.grid(spark, sf), proxy=X.inverse_density(F.coalesce("density", F.lit(0.0)))).select("gi", "gj", "proxy")


@query("scl10_rate", "SELECT p_partkey, p_retailprice/nullif(p_size % 4, 0) AS r FROM part", "r")
def scl10(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.rate(F.col("p_retailprice"), F.col("p_size") % 4).alias("r"))


@query("scl11_wait_and_engagement", f"WITH {q_more._NEEDS} SELECT event_id, {q_more._WAIT} AS wait, coalesce(idents, 0) <= 1 AS idle, -(CASE rank WHEN 'species' THEN 6 WHEN 'genus' THEN 5 WHEN 'family' THEN 4 WHEN 'order' THEN 3 ELSE 2 END) AS coarse FROM needs", "wait")
def scl11(spark, sf):
    from cellscope.operators.backlog import with_wait

    return with_wait(q_more._needs(spark, sf)[0], q_more.REFERENCE).select("event_id", "wait", "idle", "coarse")


@query("scl14_weight_maps", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS w FROM customer")
def scl14(spark, sf):
    name = F.get(F.array(*[F.lit(s) for s in X.STATUS_WEIGHTS]), (F.col("c_custkey") % 4).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", X.lookup(name, X.STATUS_WEIGHTS, 0).cast("int").alias("w"))


@query("scl15_parsed_codes", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey AS INT) END AS epsg FROM customer")
def scl15(spark, sf):
    crs = F.when(F.col("c_custkey") % 3 == 0, "EPSG:none").otherwise(F.concat(F.lit("EPSG:"), F.col("c_custkey").cast("string")))
    return table(spark, sf, "customer").select("c_custkey", X.epsg(crs).alias("epsg"))


@query("scl23_nested_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def scl23(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("scl26_parsed_places", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 50.0e0 + c_custkey % 30 END AS lat FROM customer", "lat")
def scl26(spark, sf):
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat((F.lit(50) + F.col("c_custkey") % 30).cast("string"), F.lit(",-100"))).otherwise("x,y")
    return table(spark, sf, "customer").select("c_custkey", X.parse_place(text)["lat"].alias("lat"))


# ---- composites
_OBJ12 = f"{_CELLS}, {_APP} SELECT gi, gj, scarcity AS o_discover, staleness AS o_staleness, coalesce(env, 0) AS o_env FROM cells LEFT JOIN app USING (gi, gj)"


@query("dom12_objectives", _OBJ12, "o_discover o_staleness o_env")
def dom12(spark, sf):
    cells = _cells(spark, sf)
    return cells.join(_app(cells), ["gi", "gj"], "left").select("gi", "gj", F.col("scarcity").alias("o_discover"), F.col("staleness").alias("o_staleness"), F.coalesce("env", F.lit(0.0)).alias("o_env"))


@query("dom5_mean_rarity", f"SELECT gi, gj, mean_weight FROM ({q_cells._weighted_sql(f'{q_cells._RARITY}, wt AS (SELECT taxon, rarity AS weight FROM rar)')}) WHERE mean_weight IS NOT NULL", "mean_weight")
def dom5(spark, sf):
    return q_cells.dom4(spark, sf).where("mean_weight IS NOT NULL").select("gi", "gj", "mean_weight")


@query("dom24_travel_minutes", f"{_GRID} SELECT gi, gj, coalesce(round_even(travel, 0), -1) AS travel_min FROM grid", "travel_min")
def dom24(spark, sf):
    return q_map.grid(spark, sf).select("gi", "gj", A.published_travel(F.col("travel")).alias("travel_min"))


@query("dom26_outside_cells", f"SELECT gi, gj FROM ({q_more.SQL_POLYGON}) WHERE poly = 'B'")
def dom26(spark, sf):
    return q_more.jn15(spark, sf).where("poly = 'B'").select("gi", "gj")


@query("dom47_headline")
def dom47(spark, sf):
    return acquire.headline(q_more.dom46(spark, sf))


@query("dom51_richness_trend", f"{_BIN}, c AS (SELECT gi, count(DISTINCT taxon) AS s, avg(lat - gi) AS g FROM b GROUP BY gi), r AS (SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1)/2.0e0 AS a, rank() OVER (ORDER BY round(g, 9)) + (count(*) OVER (PARTITION BY round(g, 9)) - 1)/2.0e0 AS b FROM c) SELECT count(*) AS n, corr(a, b) AS rho FROM r", "rho")
def dom51(spark, sf):
    c = _b(spark, sf).groupBy("gi").agg(F.count_distinct("taxon").alias("s"), F.round(F.avg(F.col("lat") - F.col("gi")), 9).alias("g"))
    return S.spearman(c, "s", "g")


@query("dom56_band_diagnostics", f"{_GRID} SELECT CAST(floor(clat/0.5e0) AS INT) AS band, count(*) AS n, avg(n_all) AS mean_n, avg((coalesce(density, 0) = 0)::INT) AS zero FROM grid WHERE gi BETWEEN 17 AND 22 GROUP BY 1", "mean_n zero")
def dom56(spark, sf):
    g = q_map.grid(spark, sf).where("gi BETWEEN 17 AND 22")
    return g.groupBy(F.floor(F.col("clat") / 0.5).cast("int").alias("band")).agg(F.count("*").alias("n"), F.avg("n_all").alias("mean_n"), F.avg((F.coalesce("density", F.lit(0.0)) == 0).cast("int")).alias("zero"))


@query("dom57_provenance")
def dom57(spark, sf):
    return provenance.manifest_hash(provenance.file_records(spark, f"{sf}/*.parquet"))


@query("trp1_one_way_hours", f"WITH {q_map._TRIP0} SELECT gi, gj, km*1.35e0/5 AS walk, km*1.35e0/14 AS cycle, km*1.35e0/60 AS drive FROM km", "walk cycle drive")
def trp1(spark, sf):
    from cellscope.operators.trips import hours

    return q_map._near(spark, sf).select("gi", "gj", *[hours(F.col("km"), m).alias(m.lower()) for m in X.MODES])


@query("src14_point_sample", f"WITH {q_more._PIX}, p AS (SELECT p_partkey AS id, p_partkey % 60 + 0.5e0 AS px, p_partkey % 45 + 0.5e0 AS py FROM part) SELECT id, value FROM p LEFT JOIN (SELECT * FROM pix WHERE layer='dense') x ON x.col = floor(px) AND x.row = floor(py)", "value")
def src14(spark, sf):
    points = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 60 + 0.5).alias("px"), (F.col("p_partkey") % 45 + 0.5).alias("py"))
    return raster.sample(points, q_more.pixels(spark, sf).where("layer = 'dense'"), 0.0, 0.0, 1.0, 1.0).select("id", "value")


@query("src16_averaged_raster", f"WITH {q_more._PIX} SELECT row // 4 AS gi, col // 4 AS gj, avg(value) AS mean FROM pix WHERE layer = 'dense' GROUP BY 1, 2", "mean")
def src16(spark, sf):
    return raster.pooled(q_more.pixels(spark, sf).where("layer = 'dense'"), 4, F.col("value")).select(F.col("row").alias("gi"), F.col("col").alias("gj"), F.col("value").alias("mean"))


@query("src23_one_group", f"WITH {OBS} SELECT CAST(floor(lat/{COARSE}) AS INT) AS gi, count(*) AS n FROM obs WHERE grp = 'F' GROUP BY 1")
def src23(spark, sf):
    """A group's rows from a table partitioned by group: other groups' files are not read."""
    path = scratch(spark)
    C.binned(obs(spark, sf), COARSE).select("gi", "grp").write.partitionBy("grp").parquet(path)
    return spark.read.parquet(path).where("grp = 'F'").groupBy("gi").agg(F.count("*").alias("n"))


@query("dom30_preset_blend", f"WITH {q_map._MAP} SELECT gi, gj, {q_map._impact_sql(I.PRESETS['Conservation'])} AS impact FROM map", "impact")
def blend(spark, sf):
    return q_map.the_map(spark, sf).select("gi", "gj", I.impact(I.PRESETS["Conservation"]).alias("impact"))
