"""Edge cases of the operators on small frames."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellscope.functions import scalars as X
from cellscope.operators import acquire, cells, impact, provenance, raster, scaling, spatial, species, statistics, trips
from cellscope.sources import files, pages
from cellscope.streaming import counters

OBS = "id long, lat double, lon double, taxon long, day date, rank string"


def obs(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, lat double, lon double, taxon long, day string, rank string").withColumn("day", F.col("day").cast("date"))


def test_bins_floor_negative_edges(spark):
    row = spark.range(1).select(cells.bin_of(F.lit(-123.75), 0.25).alias("a"), cells.bin_of(F.lit(-123.76), 0.25).alias("b"), cells.bin_of(F.lit(49.999), 0.25).alias("c")).first()
    assert tuple(row) == (-495, -496, 199)


def test_cell_table_needs_both_sides(spark):
    one_side = obs(spark, [(50.1, -100.1, 1, "2020-01-01", "species"), (50.1, -100.1, 2, "2020-01-02", "species")])
    assert cells.cell_table(one_side, "2021-01-01", 1.0).count() == 0
    assert cells.cell_table(one_side, "2019-01-01", 1.0).count() == 0


def test_cell_table_values(spark):
    rows = [(50.1, -100.1, t, "2020-01-01", "species") for t in (1, 1, 2, 3)] + [(50.2, -100.2, t, "2021-01-01", "species") for t in (1, 4, 4, 5)] + [(52.1, -100.1, 9, "2020-06-01", "species")]
    got = {r["gi"]: r for r in cells.backtest_cells(obs(spark, rows), "2020-12-31", 1.0, k=5).collect()}
    assert (got[50]["n_train"], got[50]["n_test"], got[50]["new_species"], got[50]["rare_newK"]) == (4, 4, 2, None)
    assert got[50]["chao_unseen"] == 2.0 and got[52]["chao_unseen"] == 0.0  # f1 = 2, f2 = 1; then f1 = 1, f2 = 0
    assert got[52]["new_rate"] is None and got[52]["revisited"] is False
    assert got[52]["scarcity"] == 1.0 and got[50]["staleness"] == 1.0 and got[50]["density"] == 1.0


def test_cells_seen_only_after_the_split_enter_no_range(spark):
    rows = [(50.1, -100.1, 1, "2020-01-01", "species"), (51.1, -100.1, 1, "2020-02-01", "species"), (51.1, -100.1, 2, "2020-02-01", "species"), (70.1, -100.1, 3, "2021-01-01", "species")]
    got = {r["gi"]: (r["n_train"], r["scarcity"], r["staleness"], r["density"], r["priority"]) for r in cells.backtest_cells(obs(spark, rows), "2020-12-31", 1.0).collect()}
    assert got == {50: (1, 1.0, 1.0, 0.0, 1.0), 51: (2, 0.0, 0.0, 1.0, 0.0)}
    for split in ("2019-01-01", "2022-01-01"):
        assert cells.backtest_cells(obs(spark, rows), split, 1.0).count() == 0


def test_cells_scan_the_observations_once(spark, tmp_path):
    rows = [(50.1 + i % 7, -100.1 - i % 5, i % 4, f"202{i % 2}-01-01", "species") for i in range(200)]
    obs(spark, rows).write.parquet(str(tmp_path / "obs"))
    df = cells.backtest_cells(spark.read.parquet(str(tmp_path / "obs")), "2020-12-31", 1.0)
    assert len(df.collect()) == 35
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1


def test_nested_backtests_equal_single_ones_in_one_scan(spark, tmp_path):
    rows = [(50.1 + i * 7 % 23 / 2, -100.1 - i * 5 % 31 / 2, i * i % 37, f"202{i % 3}-0{1 + i % 9}-11", "species") for i in range(3000)]
    obs(spark, rows).write.parquet(str(tmp_path / "obs"))
    given, splits = spark.read.parquet(str(tmp_path / "obs")), ("2021-03-01", "2022-05-01", "2019-01-01", "2030-01-01")
    df = cells.nested_backtests(given, splits, 2.5, (1, 2))
    got = {(r["res"], r["split"], r["gi"], r["gj"]): (r["priority"], r["rare_newK"]) for r in df.collect()}
    want = {(g, s, r["gi"], r["gj"]): (r["priority"], r["rare_newK"]) for g in (2.5, 5.0) for s in splits for r in cells.backtest_cells(given, s, g).collect()}
    assert got == want and {k[:2] for k in got} == {(g, s) for g in (2.5, 5.0) for s in splits[:2]}
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1


def test_cells_hold_a_histogram_of_counts(spark):
    """A cell with many new taxa keeps one entry for each number of observations."""
    rows = [(50.5, -100.5, 0, "2020-01-01", "species")] + [(50.5, -100.5, 1 + i // 2 if i < 200 else i, "2022-01-01", "species") for i in range(500)]
    taxa = cells.by_cell_and_taxon(cells.binned(obs(spark, rows), 1.0), "2021-01-01")
    [row] = cells._by_cell(taxa, cells.KEYS).collect()
    assert sorted((e["c"], e["m"]) for e in row["new_counts"]) == [(1, 300), (2, 100)] and row["new_species"] == 400
    plain, kept = cells.backtest_cells(obs(spark, rows), "2021-01-01", 1.0).first(), F.array(*[F.lit(2)] * 100, *[F.lit(1)] * 300)
    assert plain["rare_newK"] == spark.range(1).select(cells.expected_new(F.lit(500), kept, 5)).first()[0]


def test_expected_new_is_the_mean_over_all_draws(spark):
    from itertools import combinations

    counts, seen, k = [3, 1, 2], 2, 3
    bag = [s for s, c in enumerate(counts) for _ in range(c)] + [-1] * seen
    want = np.mean([len({x for x in c if x >= 0}) for c in combinations(bag, k)])
    row = spark.range(1).select(cells.expected_new(F.lit(len(bag)), F.array(*[F.lit(c) for c in counts]), k).alias("a"), cells.expected_new(F.lit(len(bag)), F.array(*[F.lit(c) for c in counts]), len(bag)).alias("all"), cells.expected_new(F.lit(2), F.array(F.lit(1)), k).alias("few")).first()
    assert abs(row["a"] - want) < 1e-8 and abs(row["all"] - 3) < 1e-8 and row["few"] is None


def test_scaling_of_constants_and_nulls(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, None), (3, 5.0, 3.0)], "k int, a double, b double")
    got = scaling.min_max(df, x=F.col("a"), y=F.col("b")).orderBy("k").collect()
    assert [r["x"] for r in got] == [0, 0, 0] and [r["y"] for r in got] == [0, None, 1]
    assert [r["s"] for r in scaling.ordinal_share(df, "b", "s", ["k"]).orderBy("k").collect()] == [0, 0, 1]
    assert {r["p"] for r in scaling.impact_percentile(df, "a", "p", ["k"]).collect()} == {0.0}
    assert [r["z"] for r in scaling.masked_z_score(df, F.col("k") < 3, z=F.col("a")).orderBy("k").collect()] == [0.0, 0.0, -math.inf]


def test_rank_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 2.0, 1.0), (3.0, 5.0, 1.0), (4.0, float("nan"), 1.0), (None, 1.0, 1.0)], "a double, b double, c double")
    got = statistics.spearman(df, "a", "b").first()
    assert got["n"] == 3 and abs(got["rho"] - math.sqrt(3) / 2) < 1e-12
    assert statistics.spearman(df, "a", "c").first()["rho"] is None
    assert statistics.spearman(df, "a", "c", degenerate=0.0).first()["rho"] == 0.0
    assert statistics.spearman(df, "a", "b", min_n=5).first()["rho"] is None


def test_lift_and_identical_pairs(spark):
    df = spark.createDataFrame([(i, float(i), 0) for i in range(10)], "k int, s double, v long")
    row = statistics.lift(df, "s", "v", ["k"]).first()
    assert row["topk"] == 2 and row["captured"] is None
    same = spark.createDataFrame([(i, 0.0) for i in range(5)], "unit int, d double")
    assert statistics.sign_flip_p(same, 50).first()["p"] == 1.0
    far = spark.createDataFrame([(i, 3.0) for i in range(12)], "unit int, d double")
    assert statistics.sign_flip_p(far, 400).first()["p"] < 0.02
    assert tuple(statistics.bootstrap_interval(far, 50).first()) == (3.0, 3.0)


def test_null_is_centred(spark):
    df = spark.createDataFrame([(i, i // 3, float(i % 17), float((i * 7) % 23)) for i in range(60)], "gi int, gj int, a double, b double")
    row = statistics.permutation_null(df, "a", "b", ["gi", "gj"], 100).first()
    assert abs(row["null_mean"]) < 0.1 and 0.08 < row["null_sd"] < 0.2 and 0 <= row["p"] <= 1


def test_raster_branches(spark):
    rows = [("dense", i, float(i)) for i in range(1, 101)] + [("sparse", i, 0.0 if i % 10 else 1.0 + i) for i in range(100)] + [("zero", i, 0.0) for i in range(10)] + [("empty", i, None) for i in range(4)]
    got = {r["layer"]: r for r in raster.display_stats(spark.createDataFrame(rows, "layer string, i int, value double")).collect()}
    assert got["dense"]["sparse_branch"] is False and abs(got["dense"]["render_vmax"] - 98.02) < 1e-9
    assert got["sparse"]["sparse_branch"] is True and got["sparse"]["render_vmax"] > 80
    assert got["zero"]["render_vmax"] == 1.0 and got["empty"]["render_vmax"] == 1.0 and got["empty"]["empty"] and got["empty"]["valid_percent"] == 0
    items = {r["layer"]: json.loads(r["item"]) for r in raster.stac_items(raster.display_stats(spark.createDataFrame(rows, "layer string, i int, value double")), F.concat(F.lit("http://x/A_"), F.col("layer"), F.lit(".tif?q")), F.lit("EPSG:x")).collect()}
    assert items["dense"]["id"] == "a_dense" and "proj:epsg" not in items["dense"]["properties"] and items["empty"]["properties"]["flag"] == "hide_empty"
    assert "minimum" not in items["empty"]["properties"]["raster:bands"][0]["statistics"]


def test_labels(spark):
    t = spark.range(1).select(
        X.duration_label(F.lit(0.5)).alias("a"), X.duration_label(F.lit(1.5)).alias("b"), X.duration_label(F.lit(50.0)).alias("c"), X.co2_label(F.lit(0.0)).alias("d"), X.co2_label(F.lit(3.25)).alias("e"), X.co2_label(F.lit(12.5)).alias("f"),
        X.ramp_colour(F.lit(0.0)).alias("g"), X.ramp_colour(F.lit(2.0)).alias("h"), X.html_escape(F.lit("<a href='x'>&\"")).alias("i"), X.https_only(F.lit("http://x")).alias("j"), X.dominant_index(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.5))).alias("k"),
        X.epsg(F.lit("EPSG:4326")).alias("l"), X.epsg(F.lit("none")).alias("m"), X.p_label(F.lit(0.0), 0.0005).alias("n"), X.cell_key(F.lit(49.125), F.lit(-120.5)).alias("o"),
    ).first()
    assert tuple(t) == ("30 min", "1h30", "2d 2h", "car-free", "~3.3 kg CO2", "~13 kg CO2", "rgb(255,255,217)", "rgb(8,29,88)", "&lt;a href=&#39;x&#39;&gt;&amp;&quot;", "", 1, 4326, None, "<0.0005", "49.125,-120.500")


def test_impact_and_contributions(spark):
    grid = spark.createDataFrame([(1, 1, 0.5, 0.0, 0.25, None, 1.0)], "gi int, gj int, discover double, conservation double, env double, staleness double, urgency double")
    row = grid.select(impact.impact((1.0, 1.0, 2.0, 1.0, 0.5)).alias("i"), impact.contributions((1.0, 1.0, 2.0, 1.0, 0.4)).alias("w"), impact.contributions((0.0, 1.0, 0.0, 1.0, 0.0)).alias("none")).first()
    assert tuple(row) == (1.5, "discover 50/100 · env 25/100 · urgency 100/100", "-")


def test_trips_never_dead_end(spark):
    far = spark.createDataFrame([(i, 0, 50.0 + i, -100.0, 1.0, 0.5) for i in range(9, 12)], "gi int, gj int, clat double, clon double, impact double, score double")
    near = trips.with_distance(far, 50.0, -100.0)
    assert trips.candidates(near, "Walk", 2.0).count() == 3 and trips.candidates(near, "Walk", 2.0, cap=1.0).count() == 0
    assert trips.greenest_mode(near, 2.0).first()["mode"] == "Drive"
    assert trips.snap(far, 59.1, -100.1, 0.45).first()["gi"] == 9 and trips.snap(far, 59.4, -100.1, 0.45).count() == 0


def test_band_join_equals_the_plain_condition(spark):
    rng = np.random.default_rng(0)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-3, 3, (300, 2)))]
    places = [(f"p{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-3, 3, (12, 2)))]
    got = {(r["id"], r["place"]) for r in species.band_join(spark.createDataFrame(pts, "id int, lat double, lon double"), spark.createDataFrame(places, "place string, plat double, plon double"), 0.375).collect()}
    assert got == {(i, p) for i, x, y in pts for p, a, b in places if abs(x - a) <= 0.375 and abs(y - b) <= 0.375}


def plain_nearest(x, y, rings):
    """(inside, name, distance) by all edges of all rings."""
    found = []
    for name, ring in rings.items():
        odd, least = False, math.inf
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
            t = min(1, max(0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
            least = min(least, math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1)))
        found.append((0.0 if odd else least, name, odd))
    d, name, _ = min(found)
    return any(f[2] for f in found), name, d


@pytest.mark.parametrize("strip", [0.3, 1.0, 50.0])
def test_nearest_polygon_equals_the_plain_loop(spark, strip):
    rng = np.random.default_rng(4)
    rings = {}
    for i in range(15):  # stars, some overlapping
        at, turn = rng.uniform(-20, 20, 2), np.sort(rng.uniform(0, 2 * math.pi, int(rng.integers(3, 12))))
        r = rng.uniform(0.5, 6, len(turn))
        rings[f"p{i:02d}"] = [(float(at[0] + a * math.cos(t)), float(at[1] + a * math.sin(t))) for a, t in zip(r, turn)]
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-40, 40, (400, 2)))]
    vertices = spark.createDataFrame([(n, i, *v) for n, ring in rings.items() for i, v in enumerate(ring)], "poly string, seq int, x double, y double")
    points = spark.createDataFrame([*pts, (-1, None, 1.0), (-2, 1.0, None)], "id int, px double, py double")
    got = {r["id"]: r for r in spatial.nearest_polygon(points, spatial.edges(vertices), ["id"], strip).collect()}
    assert len(got) == 402 and 0 < sum(r["inside"] for r in got.values()) < 400
    for i, x, y in pts:
        inside, name, d = plain_nearest(x, y, rings)
        assert (got[i]["inside"], got[i]["poly"]) == (inside, name) and abs(got[i]["distance"] - d) < 1e-9
    assert all((got[i]["inside"], got[i]["poly"], got[i]["distance"]) == (False, None, None) for i in (-1, -2))
    none = spatial.nearest_polygon(points, spatial.edges(vertices.limit(0)), ["id"]).collect()
    assert len(none) == 402 and all((r["inside"], r["poly"], r["distance"]) == (False, None, None) for r in none)


def test_null_is_the_same_however_the_ranks_are_joined(spark):
    df = spark.createDataFrame([(i, i // 3, float(i % 7), float((i * 5) % 11)) for i in range(40)], "gi int, gj int, a double, b double")
    plain = statistics.permutation_null(df, "a", "b", ["gi", "gj"], 20)
    sent = statistics.permutation_null(df, "a", "b", ["gi", "gj"], 20, cells.grid_size(2.5))
    assert np.allclose(plain.first(), sent.first(), atol=1e-12)


def test_correlations_of_columns_without_numbers(spark):
    from cellscope.plans.q_cells import _rhos

    df = spark.createDataFrame([(1.0, 2, None), (2.0, 3, None), (3.0, 3, float("nan"))], "a double, b long, c double")
    got = {r["pair"]: (r["n"], r["rho"]) for r in _rhos(df, [("ab", "a", "b"), ("ac", "a", "c")]).collect()}
    assert got["ac"] == (0, None) and got["ab"][0] == 3 and abs(got["ab"][1] - math.sqrt(3) / 2) < 1e-12
    assert {tuple(r) for r in _rhos(df.limit(0), [("ab", "a", "b")]).collect()} == {("ab", 0, None)}


def test_acquisition(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 7, float(40 + i % 9), float(-100 + i % 11), rng.standard_normal(8).tolist()) for i in range(60)]
    pool = spark.createDataFrame(rows, "vec_id long, species int, lat double, lon double, embedding array<double>")
    runs = acquire.discovery_runs(pool, acquire.STRATEGIES, 3, 10).collect()
    starts = {}
    for r in runs:
        if r["step"] == 0:
            starts.setdefault(r["seed"], set()).add(r["vec_id"])
    assert all(len(s) == 1 for s in starts.values())  # runs of one seed are paired
    per = {}
    for r in sorted(runs, key=lambda r: r["step"]):
        per.setdefault((r["strategy"], r["seed"]), []).append((r["vec_id"], r["n_species"]))
    assert len(per) == 21 and all(len({v for v, _ in p}) == len(p) <= 10 for p in per.values())
    assert all([n for _, n in p] == sorted(n for _, n in p) for p in per.values())


def test_acquisition_of_a_large_pool_equals_the_plain_loop(spark):
    n = 100_001
    pool = spark.range(n).select(F.col("id").alias("vec_id"), (F.col("id") % 7).alias("species"), (F.col("id") * 7919 % 4300 / 100.0).alias("lat"), (F.col("id") * 104729 % 8900 / 100.0).alias("lon"), F.array(F.sin("id"), F.cos(F.col("id") * 3)).alias("embedding"))
    got = acquire.discovery_runs(pool.repartition(5), ("spatial_coverage_raw", "embedding_novelty"), 2, 4).collect()
    i = np.arange(n)
    at, vec = np.stack([i * 7919 % 4300 / 100.0, i * 104729 % 8900 / 100.0], 1), np.stack([np.sin(i), np.cos(i * 3)], 1)
    vec /= np.sqrt((vec * vec).sum(axis=1, keepdims=True))
    apart = {"spatial_coverage_raw": lambda k: np.sqrt(((at - at[k]) ** 2).sum(axis=1)), "embedding_novelty": lambda k: 1 - vec @ vec[k]}
    for strategy, d in apart.items():
        for seed in range(2):
            run = [(r["vec_id"], r["n_species"]) for r in sorted(got, key=lambda r: r["step"]) if (r["strategy"], r["seed"]) == (strategy, seed)]
            far, seen = np.full(n, np.inf), set()
            assert len(run) == 4
            for step, (k, n_species) in enumerate(run):
                assert step == 0 or far[k] >= far.max() - 1e-12
                seen.add(k % 7)
                assert n_species == len(seen)
                far = np.minimum(far, d(k))


def test_sources(spark, tmp_path):
    (tmp_path / "inat_east_Aves.csv").write_text("id,lat,lon,taxon,day,rank\n1,50.0,-100.0,7,2020-01-01,species\n2,x,-100.0,7,bad,species\n")
    (tmp_path / "inat_Insecta.csv").write_text("id,lat,lon,taxon,day,rank\n3,50.0,-100.0,7,2020-13-01,species\n")
    both = files.read_by_group(spark, str(tmp_path / "*.csv"), files.OBS_SCHEMA).withColumn("d", files.day_of(F.col("day")))
    got = {r["id"]: (r["group"], r["region"], r["d"] is None) for r in both.collect()}
    assert got == {1: ("Aves", "east", False), 2: ("Aves", "east", True), 3: ("Insecta", "bc", True)}
    counted = files.count_by_group(spark, str(tmp_path / "*.csv"))
    assert sorted(tuple(r) for r in counted.collect()) == [("Aves", "east", 2), ("Insecta", "bc", 1)]
    assert files.read_csv(spark, str(tmp_path / "inat_east_Aves.csv"), tolerant=True).collect()[0]["id"] == 1
    assert [r["id"] for r in files.keyset_page(both, "id", 3, 5).collect()] == [2, 1]
    record = provenance.file_records(spark, str(tmp_path / "*.csv"))
    assert provenance.manifest_hash(record).first()["n_files"] == 2


def test_paged_service(spark):
    def fetch(below, least, size):
        return [(i, f"r{i}") for i in range(below - 1, least - 1, -1) if i % 3 == 0][:size]

    pages.register(spark, "paged_records", "id long, name string", fetch, [(0, 50), (50, 100)], size=4)
    assert sorted(r["id"] for r in spark.read.format("paged_records").load().collect()) == list(range(0, 100, 3))


def test_streamed_counts(spark, tmp_path):
    rows = [(i, 50.0 + i % 3, -100.0, f"2024-01-0{1 + i % 4} 10:00:00") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, t string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    stream = counters.read_landed(spark, str(tmp_path / "in"), "id long, lat double, lon double, ts timestamp")
    for name, out, mode in (("counts", counters.cell_counts(stream, 1.0), "complete"), ("days", counters.daily_counts(stream, 1.0), "complete")):
        q = out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert {r["gi"]: r["n"] for r in spark.table("counts").collect()} == {50: 14, 51: 13, 52: 13}
    assert spark.table("days").agg(F.sum("n")).first()[0] == 40


def test_corpus_package_is_optional():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "cellscope"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "cellscope.llm" not in path.read_text(), path


if __name__ == "__main__":
    pytest.main([__file__])
