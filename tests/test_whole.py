"""Queries that do the whole job: no id subsets, full numbers of replicates, runs and picks."""

import hashlib

import numpy as np
import pyarrow.parquet as pq

from cellscope.operators import acquire
from cellscope.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES = registry.queries()


def hash_int(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) % (1 << 31)


def flips(units, d, replicates):
    signs = np.array([[1.0 if hash_int("sign", b, u) % 2 == 0 else -1.0 for u in units] for b in range(replicates)])
    return float((np.abs((signs * d).mean(axis=1)) >= abs(d.mean()) - 1e-12).mean())


def interval(d, replicates):
    at = np.array([[hash_int("boot", b, i) % len(d) for i in range(len(d))] for b in range(replicates)])
    return np.percentile(d[at].mean(axis=1), [2.5, 97.5])


def customers():
    units = np.sort(pq.read_table(f"{DATA}/customer.parquet", columns=["c_custkey"])["c_custkey"].to_numpy())
    return units, (units * 37 % 101 - 45) / 10.0


def test_pair_tests_read_every_customer(spark):
    units, d = customers()
    got = QUERIES["dom44_sign_flip"](spark, DATA).first()
    assert abs(got["mean_diff"] - d.mean()) < 1e-6 and len(units) > 40
    assert abs(got["p"] - flips(units, d, 20_000)) < 1e-6
    got = QUERIES["dom45_bootstrap"](spark, DATA).first()
    assert np.abs(np.array([got["lo"], got["hi"]]) - interval(d, 20_000)).max() < 2e-6


def test_whole_observations_are_read(spark):
    t = pq.read_table(f"{DATA}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_partkey", "l_linestatus"]).to_pandas()
    curve = QUERIES["win12_accumulation"](spark, DATA).toPandas()
    assert len(curve) == len(t.drop_duplicates())
    assert curve.groupby("grp")["n_species"].max().to_dict() == t.groupby("l_linestatus")["l_partkey"].nunique().to_dict()
    assert QUERIES["src1_csv_scan"](spark, DATA).count() == len(t)
    assert {r["group"]: r["n"] for r in QUERIES["src2_files_by_group"](spark, DATA).collect()} == {"Aves": (t.l_linestatus == "O").sum(), "Insecta": (t.l_linestatus == "F").sum()}
    assert QUERIES["src9_occurrence_cells"](spark, DATA).select("taxon").distinct().count() == t.l_partkey.nunique()


def test_full_numbers_of_permutations_runs_and_picks(spark):
    assert abs(QUERIES["dom6_permutation_null_full"](spark, DATA).first()["p_floor"] - 1 / 2000) < 1e-6
    curves = QUERIES["agg22_mean_curve"](spark, DATA).toPandas()
    assert (curves.groupby("strategy")["step"].max() == 299).all()
    full = {n: QUERIES[n](spark, DATA).toPandas() for n in ("dom37_spatial_coverage_full", "dom41_combined")}
    assert all(len(f) == 20 * 300 and f["seed"].nunique() == 20 for f in full.values())
    curve = QUERIES["dom36_random_acquisition_full"](spark, DATA).toPandas()
    readout = QUERIES["win13_curve_readout_full"](spark, DATA).toPandas()
    assert readout[readout["at"] == 50].set_index("seed")["n_species"].to_dict() == curve[curve["step"] == 49].set_index("seed")["n_species"].to_dict()


def test_raw_coverage_makes_all_runs_and_picks(spark):
    runs = QUERIES["dom38_spatial_coverage_raw"](spark, DATA).toPandas()
    assert len(runs) == 20 * 300 and (runs.groupby("seed")["step"].max() == 299).all()


def test_readout_is_of_the_full_curve(spark):
    curve = QUERIES["dom36_random_acquisition_full"](spark, DATA).toPandas()
    readout = QUERIES["win13_curve_readout"](spark, DATA).toPandas()
    assert len(readout) == 3 * 20
    assert readout[readout["at"] == 50].set_index("seed")["n_species"].to_dict() == curve[curve["step"] == 49].set_index("seed")["n_species"].to_dict()


def test_contrasts_and_headline(spark):
    rng = np.random.default_rng(5)
    at = {s: rng.integers(20, 30, 12) for s in acquire.STRATEGIES}
    at["spatial_coverage_raw"] = at["spatial_coverage"] + 1
    at["embedding_novelty"] = at["spatial_coverage_raw"] + 5
    at["embedding_kmeanspp"] = at["spatial_coverage"]
    at["combined"] = at["spatial_coverage_raw"] + np.array([6] + [0, 1, -1] * 3 + [0, -1])  # ahead by noise only
    rows = [(s, i, int(v)) for s, vs in at.items() for i, v in enumerate(vs)]
    found = acquire.contrasts(spark.createDataFrame(rows, "strategy string, seed long, at_budget long"), 400)
    got = {r["contrast"]: r for r in found.collect()}
    best = {"best_embedding": "embedding_novelty", "best_spatial": "spatial_coverage_raw"}
    assert len(got) == 9
    for name, a, b in acquire.CONTRASTS:
        r, d = got[name], (at[best.get(a, a)] - at[best.get(b, b)]).astype(float)
        assert (r["a"], r["b"], r["n_seeds"]) == (best.get(a, a), best.get(b, b), 12)
        assert (r["wins"], r["ties"], r["losses"]) == ((d > 0).sum(), (d == 0).sum(), (d < 0).sum())
        assert abs(r["mean_diff"] - d.mean()) < 1e-9 and abs(r["p"] - (flips(range(12), d, 400) if d.any() else 1.0)) < 1e-9
        assert np.abs(np.array([r["lo"], r["hi"]]) - interval(d, 400)).max() < 1e-9
    noise = got["combined_vs_best_spatial"]
    assert noise["mean_diff"] > 0 and noise["p"] > 0.05
    head = acquire.headline(found).first()
    assert (head["best_spatial"], head["embedding_beats"], head["combined_beats"]) == ("spatial_coverage_raw", True, False)
    assert head["verdict"] == "embedding acquisition beats spatial_coverage_raw at p < 0.05"


def test_every_file_is_hashed(spark):
    import os

    got = {r["path"]: (r["sha256"], r["size_bytes"]) for r in QUERIES["hsh1_file_records"](spark, DATA).collect()}
    want = {}
    for name in os.listdir(DATA):
        if name.endswith(".parquet"):
            data = open(f"{DATA}/{name}", "rb").read()
            want[name] = (hashlib.sha256(data).hexdigest(), len(data))
    assert got == want
    lines = "\n".join(sorted(f"{k}:{h}" for k, (h, _) in want.items()))
    one = QUERIES["dom57_provenance"](spark, DATA).first()
    assert (one["manifest_hash"], one["n_files"]) == (hashlib.sha256(lines.encode()).hexdigest(), len(want))
