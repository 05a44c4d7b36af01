"""Keyed draws in bulk, against hashlib."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from cellscope.functions.digests import keyed_ints
from cellscope.operators import statistics


def plain(name, b, unit):
    return int(hashlib.md5(f"{name}:{b}:{unit}".encode()).hexdigest()[:8], 16) % (1 << 31)


def test_keyed_ints_equal_hashlib():
    for name, low, high, units in (("sign", 0, 120, ["0", "1", "-17", "12345", "x" * 40, "y" * 80, "", "é"]), ("boot", 95, 1020, [str(i) for i in range(60)]), ("a", 7, 8, ["z"])):
        got = np.full((high - low, len(units)), -1)
        for some, members, values in keyed_ints(name, low, high, units):
            got[some.start : some.stop][:, members] = values
        assert (got == [[plain(name, b, u) for u in units] for b in range(low, high)]).all()


def test_pair_tests_make_no_row_a_draw(spark):
    """The draws of a replicate are no rows of a plan: 20,000 of them for each unit do not fit in time."""
    pairs = spark.range(40).select(F.col("id").alias("unit"), (F.col("id") % 7 - 2.0).alias("d"))
    for df in (statistics.sign_flip_p(pairs, 300), statistics.bootstrap_interval(pairs, 300)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "md5" not in plan
