"""Blocks of vector distances, against plain loops."""

import numpy as np
import pytest

from cellscope.operators import vectors


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((300, 6))
    v[40] = v[0]  # a copy, and the copy's copy of another group
    v[41] = v[0]
    out = [(i, i % 4 if i % 9 else None, v[i].tolist()) for i in range(300)] + [(300, 1, None), (301, 1, [0.0] * 6), (302, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    return out, spark.createDataFrame(out, "vec_id long, species int, embedding array<double>").repartition(3)


def cosine(a, b):
    if a is None or b is None or None in a or None in b or not any(a) or not any(b):
        return None
    a, b = np.array(a), np.array(b)
    return 1 - a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))


def test_distances_within_a_group_and_the_nearest(spark, rows, monkeypatch):
    plain, df = rows
    monkeypatch.setattr(vectors, "PAIRS", 50)
    asking = df.where("vec_id % 20 = 0")
    got = {(r["a"], r["b"]): r["distance"] for r in vectors.distances_within(df, asking, "vec_id", "species", "embedding").collect()}
    want = {(a[0], b[0]): cosine(a[2], b[2]) for a in plain for b in plain if a[0] % 20 == 0 and a[0] != b[0] and a[1] is not None and a[1] == b[1]}
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (w is None) and (w is None or abs(got[k] - w) < 1e-12) for k, w in want.items())
    near = {r["q"]: (r["own"], r["nearest"]) for r in vectors.nearest(df, asking, "vec_id", "species", "embedding").collect()}
    assert len(near) == 16 and near[300] == (1, None)
    for q, own, v in plain:
        if q % 20 == 0 and q != 300:
            others = [(round(cosine(v, w), 12), k, g) for k, g, w in plain if k != q and cosine(v, w) is not None]
            assert near[q] == (own, min(others)[2])


def test_no_row_of_a_plan_is_a_pair_that_is_thrown_away(spark, rows):
    """The nearest are kept in the task that meets the pairs; a join made a row of each pair."""
    df = rows[1]
    plan = vectors.nearest(df, df.where("vec_id % 20 = 0"), "vec_id", "species", "embedding")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
