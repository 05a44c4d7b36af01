"""Sinks that are read back, and scans of files and paged services."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellscope.functions import scalars as X
from cellscope.operators import cells as C
from cellscope.plans.base import NUDGE, PLACES, SQL, query
from cellscope.plans.q_more import _BIN, _b, dom32
from cellscope.plans.views import OBS, RES, obs, table
from cellscope.sources import files, pages
from cellscope.sources.scratch import scratch

_CELLS = f"{_BIN}, c AS (SELECT gi, gj, count(*) AS n, CASE WHEN count(*) > 2 THEN avg(lat) END AS mid FROM b GROUP BY ALL)"
_GROUPS = f"{_BIN}, c AS (SELECT grp, (gi+0.5e0)*{RES} AS lat, (gj+0.5e0)*{RES} AS lon, count(*)::DOUBLE AS n_train FROM b GROUP BY ALL)"


def _cells(spark, sf):
    return _b(spark, sf).groupBy("gi", "gj").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) > 2, F.avg("lat")).alias("mid"))


def _rows(spark, sf):
    rows = _b(spark, sf).groupBy("grp", C.centre(F.col("gi"), RES).alias("lat"), C.centre(F.col("gj"), RES).alias("lon")).agg(F.count(F.lit(1)).alias("n_train"))
    return rows.select("grp", "lat", "lon", *[F.lit(0.0).alias(c) for c in files.ROW[2:8]], "n_train")


@query("snk1_cell_csv", f"{_CELLS} SELECT * FROM c", "mid")
def snk1(spark, sf):
    path = scratch(spark)
    files.write_cells_csv(_cells(spark, sf), path)
    return files.read_cells_csv(spark, path, "gi int, gj int, n bigint, mid double")


@query("snk2_results_json", f"{_CELLS} SELECT gi, count(*) AS n_cells, sum(n)::BIGINT AS n, avg(mid) AS mid FROM c GROUP BY gi", "mid")
def snk2(spark, sf):
    path = scratch(spark)
    files.write_results_json(_cells(spark, sf).groupBy("gi").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n"), F.avg("mid").alias("mid")), path)
    return files.read_results_json(spark, path, "gi int, n_cells bigint, n bigint, mid double")


@query("snk3_group_json", f"{_GROUPS}, i AS (SELECT grp, count(*) AS n_cells FROM c GROUP BY grp) SELECT grp, lat, lon, n_train, n_cells FROM c JOIN i USING (grp)", "lat lon n_train")
def snk3(spark, sf):
    path = scratch(spark)
    files.write_groups(_rows(spark, sf), path)
    index = files.read_results_json(spark, f"{path}/index", "grp string, n_cells bigint")
    return files.read_positional(spark, f"{path}/groups/*").select("grp", "lat", "lon", "n_train").join(index, "grp")


@query("snk4_patched_column", f"{_GROUPS}, p AS (SELECT (gi+0.5e0)*{RES} AS lat, (gj+0.5e0)*{RES} AS lon, count(DISTINCT taxon)::DOUBLE AS w FROM b WHERE gi % 2 = 0 GROUP BY gi, gj) SELECT grp, lat, lon, CASE WHEN grp = 'F' THEN 0 ELSE coalesce(w, 0) END AS staleness FROM c LEFT JOIN p USING (lat, lon)", "lat lon staleness")
def snk4(spark, sf):
    path, patched = scratch(spark), scratch(spark)
    files.write_groups(_rows(spark, sf), path)
    value = _b(spark, sf).where("gi % 2 = 0").groupBy(C.centre(F.col("gi"), RES).alias("lat"), C.centre(F.col("gj"), RES).alias("lon")).agg(F.count_distinct("taxon").cast("double").alias("value"))
    files.patch_groups(spark, path, patched, value, "staleness", ("F",))
    return files.read_positional(spark, f"{patched}/groups/*").select("grp", "lat", "lon", "staleness")


@query("snk6_hidden_keys", f"{_BIN} SELECT DISTINCT printf('%.3f,%.3f', (gi+0.5e0)*{RES}, (gj+0.5e0)*{RES}) AS key FROM b WHERE (gi + gj) % 3 = 0")
def snk6(spark, sf):
    path = scratch(spark)
    hidden = _b(spark, sf).where("(gi + gj) % 3 = 0").select("gi", "gj").distinct()
    files.write_keys(hidden.select(X.cell_key(C.centre(F.col("gi"), RES), C.centre(F.col("gj"), RES)).alias("key")), path)
    return files.read_keys(spark, path)


@query("src3_tolerant_csv", f"WITH {OBS} SELECT id, lat, lon, taxon, rank FROM obs WHERE taxon % 7 <> 3", "lat lon")
def src3(spark, sf):
    """Rows that do not parse are skipped: here those whose number is a word."""
    path = scratch(spark)
    o = obs(spark, sf).select("id", "lat", "lon", F.when(F.col("taxon") % 7 == 3, "broken").otherwise(F.col("taxon").cast("string")).alias("taxon"), F.col("day").cast("string").alias("day"), "rank")
    o.write.option("header", True).csv(path)
    return files.read_csv(spark, path, tolerant=True).select("id", "lat", "lon", "taxon", "rank")


def _service(spark, name, table_of, schema, ranges, size):
    """A paged service over rows held in memory, as a deployment's fetcher would return them."""
    rows = sorted((tuple(r) for r in table_of.collect()), key=lambda r: -r[0])

    def fetch(below, least, most):
        return [r for r in rows if least <= r[0] < below][:most]

    pages.register(spark, name, schema, fetch, ranges, size)
    return spark.read.format(name).load()


@query("src5_paged_service", "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS place FROM supplier")
def src5_paged(spark, sf):
    """All records of a service of a fixed table, by keyset pages within id ranges."""
    return _service(spark, "suppliers", table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "id bigint, name string, place int", [(0, 300), (300, 700), (700, 1 << 40)], 50)


@query("src6_needs_id_service", "SELECT s_suppkey AS id, s_nationkey AS ident_count, coalesce(s_nationkey, 0) <= 1 AS unengaged FROM supplier WHERE s_acctbal < 5000")
def src6(spark, sf):
    """The same for the needs-identification grade, with what was done about each record."""
    rows = _service(spark, "needs_id", table(spark, sf, "supplier").where("s_acctbal < 5000").select("s_suppkey", "s_nationkey"), "id bigint, ident_count int", [(0, 500), (500, 1 << 40)], 200)
    return rows.withColumn("unengaged", F.coalesce("ident_count", F.lit(0)) <= 1)


@query("src11_name_keys", "SELECT p_name AS name, min(n_nationkey) AS key FROM (SELECT DISTINCT p_name, CASE WHEN p_partkey % 3 = 0 THEN ' ' || upper(n) || ' ' WHEN p_partkey % 3 = 1 THEN n ELSE n || '?' END AS p_name2, n_nationkey FROM (SELECT p_partkey, p_name, n_name AS n, n_nationkey FROM part JOIN nation ON n_nationkey = p_partkey % 25)) WHERE NOT ends_with(p_name2, '?') GROUP BY 1")
def src11(spark, sf):
    """Names in odd cases and spaces meet the backbone; names that it does not have are dropped."""
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))
    p = table(spark, sf, "part").join(F.broadcast(n), F.col("key") == F.col("p_partkey") % 25)
    k = F.col("p_partkey") % 3
    asked = p.select("p_name", F.when(k == 0, F.concat(F.lit(" "), F.upper("name"), F.lit(" "))).when(k == 1, F.col("name")).otherwise(F.concat("name", F.lit("?"))).alias("name"))
    found = files.match_names(asked.select("name").distinct(), n)
    return asked.join(F.broadcast(found), "name").groupBy(F.col("p_name").alias("name")).agg(F.min("key").alias("key"))


@query("src20_polygon_edges", "SELECT n_name AS country, 0 AS ring, e.x1, e.y1, e.x2, e.y2 FROM (SELECT n_name, n_nationkey::DOUBLE AS k FROM nation), LATERAL (VALUES (k, 0.0e0, k+1, 0.0e0), (k+1, 0.0e0, k+1, 2.0e0), (k+1, 2.0e0, k, 0.0e0)) e(x1, y1, x2, y2)", "x1 y1 x2 y2")
def src20(spark, sf):
    """A boundary file of a triangle for each nation, written and read back as edges by country."""
    path = scratch(spark)
    k = F.col("n_nationkey").cast("double")
    point = lambda x, y: F.array(x, F.lit(y))
    ring = F.array(point(k, 0.0), point(k + 1, 0.0), point(k + 1, 2.0), point(k, 0.0))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("n_name").alias("country")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    document = table(spark, sf, "nation").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))
    document.write.text(path)
    return files.read_polygons(spark, path)


@query("top5_groups_by_coverage", f"SELECT grp, cov, row_number() OVER (ORDER BY cov, grp) AS place FROM ({SQL['dom32_gap_tree']})", "cov")
def top5(spark, sf):
    """Groups in the order of their coverage, the least covered first, ties by name; groups are few."""
    from pyspark.sql import Window

    return dom32(spark, sf).select("grp", F.round(F.col("cov") + NUDGE, PLACES).alias("cov")).withColumn("place", F.row_number().over(Window.orderBy("cov", "grp")))
