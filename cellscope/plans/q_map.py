"""Map axes, scaling, impact, presets, trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellscope.functions import scalars as X
from cellscope.operators import axes as A
from cellscope.operators import cells as C
from cellscope.operators import impact as I
from cellscope.operators import scaling as W
from cellscope.operators import trips as T
from cellscope.plans.base import query
from cellscope.plans.views import COARSE, OBS, obs

RECENT = "1997-01-01"

# the grid of a made-up map: layers by integer arithmetic on the cell's indexes
GRID = f"""{OBS}, counted AS (SELECT CAST(floor(lat/{COARSE}) AS INT) AS gi, CAST(floor(lon/{COARSE}) AS INT) AS gj, count(*) AS n_all, count(*) FILTER (WHERE day >= DATE '{RECENT}') AS n_recent FROM obs GROUP BY ALL),
grid AS (SELECT gi, gj, (gi+0.5e0)*{COARSE} AS clat, (gj+0.5e0)*{COARSE} AS clon, n_all, n_recent, CASE WHEN (gi+gj+1000)%5=0 THEN NULL ELSE n_all/1000.0e0 END AS density, ((gi*31+gj*17)%50+50)%50/50.0e0 AS temp, ((gi*13+gj*7)%40+40)%40/40.0e0 AS rain, CASE WHEN (gi*gj)%7=0 THEN NULL ELSE ((gi*5+gj*3)%60+60)%60/60.0e0 END AS loss, CASE WHEN (gi+2*gj+1000)%11=0 THEN NULL ELSE ((gi*19+gj*23)%600+600)%600/1.0e0 END AS travel FROM counted)"""


def grid(spark, sf):
    day = F.col("day") >= F.lit(RECENT).cast("date")
    counted = C.binned(obs(spark, sf), COARSE).groupBy("gi", "gj").agg(F.count("*").alias("n_all"), F.count_if(day).alias("n_recent"))
    gi, gj = F.col("gi"), F.col("gj")
    return counted.select(
        "gi", "gj", C.centre(gi, COARSE).alias("clat"), C.centre(gj, COARSE).alias("clon"), "n_all", "n_recent", F.when((gi + gj + 1000) % 5 != 0, F.col("n_all") / 1000.0).alias("density"),
        (F.pmod(gi * 31 + gj * 17, F.lit(50)) / 50.0).alias("temp"), (F.pmod(gi * 13 + gj * 7, F.lit(40)) / 40.0).alias("rain"),
        F.when((gi * gj) % 7 != 0, F.pmod(gi * 5 + gj * 3, F.lit(60)) / 60.0).alias("loss"), F.when((gi + 2 * gj + 1000) % 11 != 0, F.pmod(gi * 19 + gj * 23, F.lit(600)) / 1.0).alias("travel"),
    )


def _norm(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0) END"


@query("win1_min_max", f"WITH {GRID} SELECT gi, gj, {_norm('n_all::DOUBLE')} AS n01, {_norm('loss')} AS loss01 FROM grid", "n01 loss01")
def win1(spark, sf):
    return W.min_max(grid(spark, sf), n01=F.col("n_all"), loss01=F.col("loss")).select("gi", "gj", "n01", "loss01")


@query("win3_over_max", f"WITH {GRID} SELECT gi, gj, n_all/(max(n_all) OVER ())::DOUBLE AS share FROM grid", "share")
def win3(spark, sf):
    return W.over_max(grid(spark, sf), share=F.col("n_all")).select("gi", "gj", "share")


@query("win4_z_score", f"WITH {GRID} SELECT gi, gj, (temp - avg(temp) OVER ())/(stddev_pop(temp) OVER () + 1e-9) AS z FROM grid", "z")
def win4(spark, sf):
    return W.z_score(grid(spark, sf), z=F.col("temp")).select("gi", "gj", "z")


@query("win5_masked_z_score", f"WITH {GRID}, m AS (SELECT avg(temp) AS mu, stddev_pop(temp) AS sd FROM grid WHERE travel < 120) SELECT gi, gj, CASE WHEN travel < 120 THEN (temp - mu)/sd END AS z FROM grid, m", "z")
def win5(spark, sf):
    z = W.masked_z_score(grid(spark, sf), F.coalesce(F.col("travel") < 120, F.lit(False)), z=F.col("temp"))
    return z.select("gi", "gj", F.when(F.col("z") > float("-inf"), F.col("z")).alias("z"))


@query("win6_percentile_rank", f"WITH {GRID} SELECT gi, gj, CASE WHEN loss IS NULL THEN 0.0e0 ELSE (row_number() OVER (PARTITION BY loss IS NULL ORDER BY loss, gi, gj) - 1)/greatest(count(loss) OVER () - 1, 1)::DOUBLE END AS share FROM grid", "share")
def win6(spark, sf):
    return W.ordinal_share(grid(spark, sf), "loss", "share", C.KEYS).select("gi", "gj", "share")


@query("win10_average_rank", f"WITH {GRID} SELECT gi, gj, rank() OVER (ORDER BY temp) + (count(*) OVER (PARTITION BY temp) - 1)/2.0e0 AS r FROM grid", "r")
def win10(spark, sf):
    return grid(spark, sf).select("gi", "gj", W.average_rank(F.col("temp")).alias("r"))


_Z = "zz AS (SELECT *, (temp - avg(temp) OVER ())/(stddev_pop(temp) OVER () + 1e-9) AS z_t, (rain - avg(rain) OVER ())/(stddev_pop(rain) OVER () + 1e-9) AS z_r FROM grid), kde AS (SELECT a.gi, a.gj, sum(b.density * exp(-((a.z_t-b.z_t)*(a.z_t-b.z_t)+(a.z_r-b.z_r)*(a.z_r-b.z_r))/(2*0.25e0))) AS kde FROM zz a, zz b WHERE b.density > 0 GROUP BY 1, 2)"
_ENV = f"{_Z}, env AS (SELECT gi, gj, (row_number() OVER (ORDER BY s, gi, gj) - 1)/greatest(count(*) OVER () - 1, 1)::DOUBLE AS env FROM (SELECT gi, gj, round(-ln(kde + 1e-9), 9) AS s FROM kde))"


@query("jn14_climate_kde", f"WITH {GRID}, {_Z} SELECT * FROM kde", "kde")
def jn14(spark, sf):
    return A.climate_density(grid(spark, sf), ["temp", "rain"], "density").select("gi", "gj", "kde")


@query("dom18_env_surprisal", f"WITH {GRID}, {_ENV} SELECT * FROM env", "env")
def dom18(spark, sf):
    return A.env_surprisal(grid(spark, sf), ["temp", "rain"], "density").select("gi", "gj", "env")


@query("dom19_env_inverse", f"WITH {GRID}, {_Z}, v AS (SELECT gi, gj, 1.0e0/kde AS v FROM kde) SELECT gi, gj, {_norm('v')} AS env_inverse FROM v", "env_inverse")
def dom19(spark, sf):
    return A.env_inverse(grid(spark, sf), ["temp", "rain"], "density").select("gi", "gj", "env_inverse")


_TRAIN = f"tr AS (SELECT g.*, env, CAST(round_even(coalesce(density, 0) * ({111.32 * COARSE!r}*{111.32 * COARSE!r}*cos(radians(clat))), 0) AS BIGINT) AS n_train FROM grid g JOIN env USING (gi, gj))"
_DISC = f"{_ENV}, {_TRAIN}, disc AS (SELECT *, (row_number() OVER (ORDER BY n_train DESC, env, gi DESC, gj) - 1)/greatest(count(*) OVER () - 1, 1)::DOUBLE AS discover FROM tr)"


@query("dom20_discover_rank", f"WITH {GRID}, {_DISC} SELECT gi, gj, n_train, discover FROM disc", "discover")
def dom20(spark, sf):
    g = grid(spark, sf).withColumn("n_train", X.implied_records(F.coalesce("density", F.lit(0.0)), F.col("clat"), COARSE))
    return A.discover(A.env_surprisal(g, ["temp", "rain"], "density")).select("gi", "gj", "n_train", "discover")


_STATUS = "status AS (SELECT DISTINCT taxon, CASE taxon % 6 WHEN 0 THEN 'Endangered' WHEN 1 THEN 'Threatened' WHEN 2 THEN 'Special Concern' ELSE 'Not at Risk' END AS status FROM obs WHERE taxon % 4 = 0)"
_RISK = f"""{_STATUS}, worst AS (SELECT taxon, max(CASE status WHEN 'Endangered' THEN 3 WHEN 'Threatened' THEN 2 WHEN 'Special Concern' THEN 1 ELSE 0 END) AS w FROM status GROUP BY 1 HAVING w > 0),
risk AS (SELECT gi, gj, count(*) AS n_species, CAST(sum(w) AS DOUBLE) AS score_raw FROM (SELECT DISTINCT taxon, CAST(floor(lat/{COARSE}) AS INT) AS gi, CAST(floor(lon/{COARSE}) AS INT) AS gj FROM obs) JOIN worst USING (taxon) GROUP BY 1, 2), riskn AS (SELECT *, score_raw/max(score_raw) OVER () AS conservation FROM risk)"""


def _status(o):
    names = F.array(*[F.lit(s) for s in ("Endangered", "Threatened", "Special Concern", "Not at Risk", "Not at Risk", "Not at Risk")])
    return o.where("taxon % 4 = 0").select("taxon", F.get(names, (F.col("taxon") % 6).cast("int")).alias("status")).distinct()


@query("dom21_at_risk_layer", f"WITH {OBS}, {_RISK} SELECT * FROM riskn", "score_raw conservation")
def dom21(spark, sf):
    o = obs(spark, sf)
    return A.at_risk(C.binned(o, COARSE), _status(o))


_STALE = f"""pts AS (SELECT CAST(floor(lat/{COARSE}) AS INT) AS gi, CAST(floor(lon/{COARSE}) AS INT) AS gj, count(*) AS n, day >= DATE '{RECENT}' AS recent FROM obs GROUP BY ALL), st AS (SELECT gi, gj, CAST(sum(n) AS BIGINT) AS n_all, CAST(sum(CASE WHEN recent THEN n ELSE 0 END) AS BIGINT) AS n_recent FROM pts GROUP BY 1, 2),
sts AS (SELECT *, (1 - least(n_recent, n_all)/n_all::DOUBLE)*ln(1 + n_all) AS s FROM st WHERE n_all >= 20), stn AS (SELECT gi, gj, n_all, n_recent, s/coalesce(nullif(max(s) OVER (), 0), 1) AS staleness FROM sts)"""


def _points(o):
    return C.binned(o, COARSE).groupBy("gi", "gj", (F.col("day") >= F.lit(RECENT).cast("date")).alias("recent")).agg(F.count("*").alias("n"))


@query("dom22_staleness_layer", f"WITH {OBS}, {_STALE} SELECT * FROM stn", "staleness")
def dom22(spark, sf):
    return A.staleness_layer(_points(obs(spark, sf)))


@query("dom23_urgency", f"WITH {GRID}, u AS (SELECT gi, gj, coalesce(greatest(loss, 0), 0) AS l FROM grid) SELECT gi, gj, {_norm('l')} AS urgency FROM u", "urgency")
def dom23(spark, sf):
    return W.min_max(grid(spark, sf), urgency=F.coalesce(F.greatest("loss", F.lit(0.0)), F.lit(0.0))).select("gi", "gj", "urgency")


_MAP = f"""{GRID}, {_DISC}, {_RISK}, {_STALE}, px AS (SELECT *, 1/(coalesce(density, 0)+0.001e0) AS inv, coalesce(greatest(loss, 0), 0) AS l FROM disc), nn AS (SELECT *, {_norm('inv')} AS proxy, {_norm('l')} AS urg FROM px),
map AS (SELECT n.gi, n.gj, round_even(discover, 3) AS discover, coalesce(round_even(conservation, 3), 0) AS conservation, round_even(env, 3) AS env, round_even(coalesce(staleness, proxy), 3) AS staleness, round_even(urg, 3) AS urgency, coalesce(round_even(travel, 0), -1) AS travel_min, n_train FROM nn n LEFT JOIN riskn USING (gi, gj) LEFT JOIN stn USING (gi, gj))"""


def the_map(spark, sf):
    o = obs(spark, sf)
    # bounded by the grid, and read several times by what ranks it
    return A.map_grid(grid(spark, sf), A.at_risk(C.binned(o, COARSE), _status(o)), A.staleness_layer(_points(o)), ["temp", "rain"], COARSE).persist()


_AX = "discover conservation env staleness urgency travel_min"


@query("dom25_map_grid", f"WITH {_MAP} SELECT * FROM map", _AX)
def dom25(spark, sf):
    return the_map(spark, sf)


def _impact_sql(w: tuple[float, ...]) -> str:
    return " + ".join(f"{x}e0*{a}" for x, a in zip(w, I.AXES, strict=True))


_W = I.PRESETS["Spatial Gap"]
_RANKED = f"{_MAP}, imp AS (SELECT *, {_impact_sql(_W)} AS impact FROM map), rk AS (SELECT *, CASE WHEN max(impact) OVER () - min(impact) OVER () < 1e-9 THEN 0.0e0 ELSE (row_number() OVER (ORDER BY impact, gi, gj) - 1)/greatest(count(*) OVER () - 1, 1)::DOUBLE END AS score FROM imp)"


@query("dom27_impact", f"WITH {_RANKED} SELECT gi, gj, impact, score FROM rk", "impact score")
def dom27(spark, sf):
    return I.ranked(the_map(spark, sf), _W).select("gi", "gj", "impact", "score")


@query("win9_viewport_rank", f"WITH {_RANKED}, v AS (SELECT * FROM rk WHERE gi BETWEEN 18 AND 26 AND gj BETWEEN -50 AND -35) SELECT gi, gj, score, (row_number() OVER (ORDER BY impact, gi, gj) - 1)/greatest(count(*) OVER () - 1, 1)::DOUBLE AS local_score FROM v", "score local_score")
def win9(spark, sf):
    view = I.ranked(the_map(spark, sf), _W).where("gi BETWEEN 18 AND 26 AND gj BETWEEN -50 AND -35")
    return W.ordinal_share(view, "impact", "local_score", C.KEYS).select("gi", "gj", "score", "local_score")


_PRE = " UNION ALL ".join(f"SELECT '{n}' AS preset, gi, gj, {_impact_sql(w)} AS impact FROM map" for n, w in I.PRESETS.items())


@query("dom28_presets", f"WITH {_MAP}, p AS ({_PRE}) SELECT *, (row_number() OVER (PARTITION BY preset ORDER BY impact, gi, gj) - 1)/greatest(count(*) OVER (PARTITION BY preset) - 1, 1)::DOUBLE AS score FROM p", "impact score")
def dom28(spark, sf):
    return I.preset_scores(the_map(spark, sf))


@query("top6_contributions")
def top6(spark, sf):
    return the_map(spark, sf).select("gi", "gj", I.contributions((1.0, 0.5, 0.5, 0.6, 0.4)).alias("why"))


_GRP = f"""{OBS}, gb AS (SELECT grp, CAST(floor(lat/{COARSE}) AS INT) AS gi, CAST(floor(lon/{COARSE}) AS INT) AS gj, count(*) AS n, count(DISTINCT taxon) AS s FROM obs GROUP BY ALL)"""


@query("dom30_compare_goals", f"WITH {_GRP}, r AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY n) + (count(*) OVER (PARTITION BY grp, n) - 1)/2.0e0 AS a, rank() OVER (PARTITION BY grp ORDER BY s) + (count(*) OVER (PARTITION BY grp, s) - 1)/2.0e0 AS b FROM gb), c AS (SELECT grp, count(*) AS n, corr(a, b) AS rho FROM r GROUP BY grp) SELECT *, CASE WHEN count(*) FILTER (WHERE rho < 0) OVER () = count(*) OVER () THEN 'all differ' WHEN count(*) FILTER (WHERE rho < 0) OVER () = 0 THEN 'agree' ELSE 'some differ' END AS verdict FROM c", "rho")
def dom30(spark, sf):
    from cellscope.operators.statistics import spearman

    g = C.binned(obs(spark, sf), COARSE).groupBy("grp", "gi", "gj").agg(F.count("*").alias("n"), F.count_distinct("taxon").alias("s"))
    rho = W.with_totals(spearman(g, "n", "s", ["grp"]), __neg=F.count_if(F.col("rho") < 0), __all=F.count("*"))
    verdict = F.when(F.col("__neg") == F.col("__all"), "all differ").when(F.col("__neg") == 0, "agree").otherwise("some differ")
    return rho.withColumn("verdict", verdict).drop("__neg", "__all")


@query("agg18_group_rollup", f"WITH {_GRP} SELECT gi, gj, avg(n) AS mean_n, max(s) AS most_species FROM gb GROUP BY gi, gj", "mean_n")
def agg18(spark, sf):
    g = C.binned(obs(spark, sf), COARSE).groupBy("grp", "gi", "gj").agg(F.count("*").alias("n"), F.count_distinct("taxon").alias("s"))
    return g.groupBy("gi", "gj").agg(F.avg("n").alias("mean_n"), F.max("s").alias("most_species"))


# ---- trips from one start
START, BUDGET, CAP, RATIO = (55.0, -100.0), 10.0, 6.0, 0.5
_KM = f"2*6371.0e0*asin(sqrt(least(1.0e0, greatest(0.0e0, pow(sin(radians(clat-{START[0]}e0)/2),2) + cos(radians({START[0]}e0))*cos(radians(clat))*pow(sin(radians(clon-({START[1]}e0))/2),2)))))"
_TRIP0 = f"{_RANKED}, al AS (SELECT gi, gj, (gi+0.5e0)*{COARSE} AS clat, (gj+0.5e0)*{COARSE} AS clon, impact, score FROM rk), km AS (SELECT *, {_KM} AS km FROM al)"
_CAND = f"""{_TRIP0}, t AS (SELECT *, km*1.35e0/60 AS est_h FROM km WHERE km*1.35e0/60 <= {CAP * 1.5}), f AS (SELECT * FROM t WHERE 2*est_h <= {BUDGET - 0.5} OR NOT (SELECT bool_or(2*est_h <= {BUDGET - 0.5}) FROM t)),
a8 AS (SELECT *, 0 AS o FROM f ORDER BY impact DESC, gi, gj LIMIT 8), n4 AS (SELECT *, 1 AS o FROM f ORDER BY km, gi, gj LIMIT 4), u AS (SELECT * FROM a8 UNION ALL SELECT * FROM n4), cand AS (SELECT * FROM u WHERE (gi, gj, o) IN (SELECT (gi, gj, min(o)) FROM u GROUP BY gi, gj) ORDER BY o, CASE WHEN o=0 THEN -impact ELSE km END, gi, gj LIMIT 12)"""
_SCORED = f"{_CAND}, rt AS (SELECT gi, gj, 0.5e0 + gi%4 AS route_h, 40.0e0 + (gj%30+30)%30 AS route_km FROM grid WHERE (gi+gj+1000)%2=0), sc AS (SELECT c.gi, c.gj, km, impact, score, coalesce(route_h, est_h) AS one_h, coalesce(route_km, km*1.35e0) AS one_km, route_h IS NOT NULL AS real FROM cand c LEFT JOIN rt USING (gi, gj)), sd AS (SELECT *, {BUDGET}e0 - 2*one_h AS field_h, 2*one_km*0.18e0 AS co2 FROM sc)"


def _near(spark, sf):
    cells = I.ranked(the_map(spark, sf), _W).select("gi", "gj", C.centre(F.col("gi"), COARSE).alias("clat"), C.centre(F.col("gj"), COARSE).alias("clon"), "impact", "score")
    return T.with_distance(cells, *START).persist()


def _routes(spark, sf):
    return grid(spark, sf).where("(gi + gj + 1000) % 2 = 0").select("gi", "gj", (0.5 + F.col("gi") % 4).alias("route_h"), (40.0 + F.pmod("gj", F.lit(30))).alias("route_km"))


@query("scl1_haversine_km", f"WITH {_TRIP0} SELECT gi, gj, km FROM km", "km")
def scl1(spark, sf):
    return _near(spark, sf).select("gi", "gj", "km")


@query("trp2_greenest_mode", f"""WITH {_TRIP0} SELECT CASE WHEN bool_or(impact > 0 AND 2*km*1.35e0/5 <= {BUDGET - 0.5} AND km*1.35e0/5 <= {CAP * 1.5}) THEN 'Walk' WHEN bool_or(impact > 0 AND 2*km*1.35e0/14 <= {BUDGET - 0.5} AND km*1.35e0/14 <= {CAP * 1.5}) THEN 'Cycle' ELSE 'Drive' END AS mode FROM km""")
def trp2(spark, sf):
    return T.greenest_mode(_near(spark, sf), BUDGET, CAP)


@query("trp2_greenest_for_cell", f"WITH {_TRIP0} SELECT gi, gj, CASE WHEN 2*(km*1.35e0/5) <= {BUDGET - 0.5} THEN 'Walk' WHEN 2*(km*1.35e0/14) <= {BUDGET - 0.5} THEN 'Cycle' ELSE 'Drive' END AS mode FROM km")
def trp2c(spark, sf):
    return _near(spark, sf).select("gi", "gj", T.greenest_for(F.col("km"), BUDGET).alias("mode"))


@query("trp3_candidates", f"WITH {_CAND} SELECT gi, gj, km, impact, est_h FROM cand", "km impact est_h")
def trp3(spark, sf):
    return T.candidates(_near(spark, sf), "Drive", BUDGET, CAP).select("gi", "gj", "km", "impact", "est_h")


def _trips(spark, sf):
    return T.routed(T.candidates(_near(spark, sf), "Drive", BUDGET, CAP), "Drive", BUDGET, _routes(spark, sf))


_TD = "km impact score one_h one_km field_h co2"


@query("trp4_routed", f"WITH {_SCORED} SELECT * FROM sd", _TD)
def trp4(spark, sf):
    return _trips(spark, sf).select("gi", "gj", "km", "impact", "score", "one_h", "one_km", "real", "field_h", "co2")


@query("trp5_fitting", f"WITH {_SCORED} SELECT gi, gj, field_h FROM sd WHERE one_h <= {CAP} AND field_h >= 0.5 AND field_h >= {RATIO}*2*one_h", "field_h")
def trp5(spark, sf):
    return T.fitting(_trips(spark, sf), CAP, RATIO).select("gi", "gj", "field_h")


@query("trp6_best_trips", f"WITH {_SCORED} SELECT gi, gj, score*greatest(field_h, 0)/(1+co2) AS value FROM sd WHERE one_h <= {CAP} AND field_h >= 0.5 AND field_h >= {RATIO}*2*one_h ORDER BY value DESC, gi, gj LIMIT 5", "value")
def trp6(spark, sf):
    return T.best(T.fitting(_trips(spark, sf), CAP, RATIO), low_carbon=True).select("gi", "gj", "value")


@query("top7_farther_trips", f"WITH {_SCORED} SELECT gi, gj, one_h FROM sd WHERE one_h <= {CAP} ORDER BY one_h, gi, gj LIMIT 3", "one_h")
def top7(spark, sf):
    return T.farther(_trips(spark, sf), CAP).select("gi", "gj", "one_h")


@query("trp7_right_here", f"WITH {_TRIP0} SELECT gi, gj, km, 0.0e0 AS one_h, {BUDGET}e0 AS field_h FROM km ORDER BY km, gi, gj LIMIT 1", "km one_h field_h")
def trp7(spark, sf):
    return T.nearest(_near(spark, sf)).select("gi", "gj", "km", F.lit(0.0).alias("one_h"), F.lit(BUDGET).alias("field_h"))


@query("jn13_snap_to_cell", f"WITH {_TRIP0} SELECT gi, gj, abs(clat - 56.3e0) + abs(clon - (-99.0e0)) AS apart FROM km WHERE apart <= 2.5 ORDER BY apart, gi, gj LIMIT 1", "apart")
def jn13(spark, sf):
    return T.snap(_near(spark, sf), 56.3, -99.0, 2.5).select("gi", "gj", "apart")


@query("trp8_destination", f"WITH {_TRIP0}, d AS (SELECT *, abs(clat - 56.3e0) + abs(clon - (-99.0e0)) AS apart FROM km ORDER BY apart, gi, gj LIMIT 1) SELECT gi, gj, km*1.35e0/60 AS one_h, {BUDGET}e0 - 2*(km*1.35e0/60) AS field_h, 2*(km*1.35e0)*0.18e0 AS co2 FROM d", "one_h field_h co2")
def trp8(spark, sf):
    there = T.snap(_near(spark, sf), 56.3, -99.0, None).withColumn("est_h", T.hours(F.col("km"), "Drive"))
    return T.routed(there, "Drive", BUDGET).select("gi", "gj", "one_h", "field_h", "co2")


# ---- accessibility
_ACC = f"WITH {_RANKED}, a AS (SELECT rk.*, g.travel, g.n_all FROM rk JOIN grid g USING (gi, gj) WHERE g.travel IS NOT NULL)"


def _acc(spark, sf):
    g = grid(spark, sf).select("gi", "gj", "travel", "n_all").where("travel IS NOT NULL")
    return I.ranked(the_map(spark, sf), _W).join(g, ["gi", "gj"]).persist()


@query("agg19_frontier", f"{_ACC} SELECT h.h AS minutes, 100.0e0*avg((travel <= h.h)::INT) AS pct_cells, 100.0e0*sum(CASE WHEN travel <= h.h THEN n_all ELSE 0 END)/sum(n_all) AS pct_records, median(CASE WHEN travel <= h.h THEN travel END) AS median_travel FROM a, (VALUES (60), (120), (240), (480)) h(h) GROUP BY h.h", "pct_cells pct_records median_travel")
def agg19(spark, sf):
    steps = F.explode(F.array(*[F.lit(m) for m in (60, 120, 240, 480)]))
    within = F.col("travel") <= F.col("minutes")
    return _acc(spark, sf).withColumn("minutes", steps).groupBy("minutes").agg(
        (100.0 * F.avg(within.cast("int"))).alias("pct_cells"), (100.0 * F.sum(F.when(within, F.col("n_all")).otherwise(0)) / F.sum("n_all")).alias("pct_records"), F.median(F.when(within, F.col("travel"))).alias("median_travel")
    )


@query("scl9_return_on_travel", f"{_ACC} SELECT gi, gj, score/(1+travel/60) AS roi FROM a", "roi")
def scl9(spark, sf):
    return _acc(spark, sf).select("gi", "gj", X.return_on_travel(F.col("score"), F.col("travel")).alias("roi"))


@query("dom11_accessibility", f"{_ACC}, k AS (SELECT *, score/(1+travel/60) AS roi, greatest(1, count(*) OVER () // 5) AS k FROM a), p AS (SELECT travel, n_all FROM (SELECT *, row_number() OVER (ORDER BY score DESC, gi, gj) AS r FROM k) WHERE r <= k), q AS (SELECT travel, n_all FROM (SELECT *, row_number() OVER (ORDER BY roi DESC, gi, gj) AS r FROM k) WHERE r <= k) SELECT 'priority' AS ranking, median(travel) AS median_travel, CAST(sum(n_all) AS BIGINT) AS records FROM p UNION ALL SELECT 'roi', median(travel), CAST(sum(n_all) AS BIGINT) FROM q", "median_travel")
def dom11(spark, sf):
    from pyspark.sql import Window

    a = W.with_totals(_acc(spark, sf).withColumn("roi", X.return_on_travel(F.col("score"), F.col("travel"))), __n=F.count("*"))
    out = None
    for name, c in (("priority", "score"), ("roi", "roi")):
        top = a.withColumn("r", F.row_number().over(Window.orderBy(F.col(c).desc(), "gi", "gj"))).where("r <= greatest(1, __n div 5)")
        one = top.agg(F.lit(name).alias("ranking"), F.median("travel").alias("median_travel"), F.sum("n_all").alias("records"))
        out = one if out is None else out.unionByName(one)
    return out


@query("top9_argmax_raw_vs_roi", f"{_ACC}, s AS (SELECT gi, gj, score, score/(1+travel/60) AS roi FROM a) SELECT 'raw' AS kind, * FROM (SELECT gi, gj FROM s ORDER BY score DESC, gi, gj LIMIT 1) UNION ALL SELECT 'roi', * FROM (SELECT gi, gj FROM s ORDER BY roi DESC, gi, gj LIMIT 1)")
def top9(spark, sf):
    a = _acc(spark, sf).withColumn("roi", X.return_on_travel(F.col("score"), F.col("travel")))
    one = lambda k, c: a.orderBy(F.col(c).desc(), "gi", "gj").limit(1).select(F.lit(k).alias("kind"), "gi", "gj")
    return one("raw", "score").unionByName(one("roi", "roi"))


@query("agg24_latitude_transect", f"WITH {GRID} SELECT CAST(floor(clat/5.0e0) AS INT) AS band, count(*) AS n, avg(n_all) AS mean_n, avg((density IS NULL)::INT) AS unrecorded FROM grid GROUP BY 1", "mean_n unrecorded")
def agg24(spark, sf):
    return grid(spark, sf).groupBy(F.floor(F.col("clat") / 5.0).cast("int").alias("band")).agg(F.count("*").alias("n"), F.avg("n_all").alias("mean_n"), F.avg(F.col("density").isNull().cast("int")).alias("unrecorded"))


@query("agg25_axis_check", f"WITH {GRID} " + " UNION ALL ".join(f"SELECT '{c}' AS axis, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, avg(({c} <> 0)::INT) AS nonzero FROM grid" for c in ("temp", "rain", "loss", "n_all")), "lo hi nonzero")
def agg25(spark, sf):
    long = grid(spark, sf).select(*[F.col(c).cast("double").alias(c) for c in ("temp", "rain", "loss", "n_all")]).unpivot([], ["temp", "rain", "loss", "n_all"], "axis", "v")
    return long.groupBy("axis").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg((F.col("v") != 0).cast("int")).alias("nonzero"))


@query("prj10_land_mask", f"WITH {GRID} SELECT gi, gj FROM grid WHERE gi BETWEEN 17 AND 32 AND (travel IS NOT NULL OR coalesce(density, 0) > 0)")
def prj10(spark, sf):
    return A.land(grid(spark, sf), F.col("gi").between(17, 32), F.col("travel"), F.col("density")).select("gi", "gj")


@query("prj9_grid_enumeration", "SELECT CAST(gi AS INT) AS gi, CAST(gj AS INT) AS gj, (gi+0.5e0)*0.5e0 AS clat, (gj+0.5e0)*0.5e0 AS clon FROM range(82, 168) a(gi), range(-282, -103) b(gj)", "clat clon")
def prj9(spark, sf):
    rows = spark.range(82, 168).select(F.col("id").cast("int").alias("gi")).withColumn("gj", F.explode(F.sequence(F.lit(-282), F.lit(-104))))
    return rows.select("gi", "gj", C.centre(F.col("gi"), 0.5).alias("clat"), C.centre(F.col("gj"), 0.5).alias("clon"))


@query("dom52_live_proxy", f"WITH {OBS}, b AS (SELECT CAST(floor(lat/1.0) AS INT) AS gi, CAST(floor(lon/1.0) AS INT) AS gj, count(*) AS n, date_diff('day', max(day), DATE '1999-01-01') AS stale FROM obs GROUP BY ALL) SELECT gi, gj, (1.0e0/n)/max(1.0e0/n) OVER () AS scarcity, stale/(max(stale) OVER ())::DOUBLE AS staleness FROM b", "scarcity staleness")
def dom52(spark, sf):
    b = C.binned(obs(spark, sf), 1.0).groupBy("gi", "gj").agg(F.count("*").alias("n"), F.datediff(F.lit("1999-01-01").cast("date"), F.max("day")).alias("stale"))
    return W.over_max(b, scarcity=1.0 / F.col("n"), staleness=F.col("stale")).select("gi", "gj", "scarcity", "staleness")


@query("dom53_game_metrics", f"WITH {_GRP}, t AS (SELECT CAST(floor(lat/{COARSE}) AS INT) AS gi, CAST(floor(lon/{COARSE}) AS INT) AS gj, count(*) AS n, count(DISTINCT taxon) AS s FROM obs GROUP BY ALL) SELECT gi, gj, {_norm('(1.0e0/n)')} AS explorer, {_norm('s::DOUBLE')} AS taxonomic, {_norm('(s/n::DOUBLE)')} AS voi FROM t", "explorer taxonomic voi")
def dom53(spark, sf):
    t = C.binned(obs(spark, sf), COARSE).groupBy("gi", "gj").agg(F.count("*").alias("n"), F.count_distinct("taxon").alias("s"))
    return W.min_max(t, explorer=1.0 / F.col("n"), taxonomic=F.col("s"), voi=F.col("s") / F.col("n")).select("gi", "gj", "explorer", "taxonomic", "voi")
