"""File hashes: large files in splits, one task each."""

import hashlib
import re

import numpy as np
import pytest

from cellscope.operators import provenance


def test_large_files_are_hashed_in_splits(spark, tmp_path):
    rng = np.random.default_rng(3)
    noise = rng.integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    given = {
        "noise.bin": noise, "end.bin": noise + b"\n", "ends.bin": noise[:99_999] + b"\n\n\n", "mark.bin": b"\xef\xbb\xbf" + noise, "marks.bin": b"\xef\xbb\xbf" * 2 + noise + b"\n",
        "returns.bin": b"\r\n\r" * 70_000, "ends_only.bin": b"\n" * 100_000, "zeros.bin": bytes(120_000), "one [a]{b}*.bin": noise[::-1], "packed.gz": noise, "small.bin": b"a",
    }
    for name, data in given.items():
        (tmp_path / name).write_bytes(data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = {r["path"]: (r["sha256"], r["size_bytes"]) for r in provenance.file_records(spark, str(tmp_path), whole=1_000).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {k: (hashlib.sha256(v).hexdigest(), len(v)) for k, v in given.items()}


def test_no_task_reads_a_whole_large_file(spark, tmp_path):
    """The plan's native part leaves large files out, the other reads one split a task."""
    (tmp_path / "large.bin").write_bytes(np.random.default_rng(4).integers(0, 256, 400_000, dtype=np.uint8).tobytes())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    read = []
    after = provenance._after
    try:
        provenance._after = lambda lines, split, state, n: read.append((n, (out := after(lines, split, state, n))[1])) or out
        found = provenance.file_records(spark, str(tmp_path), whole=1_000)
    finally:
        provenance._after = after
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(read) >= 8 and max(b - a for a, b in read) < 70_000 and read[-1][1] in (400_000, 400_001)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(length,1000\)", plan), plan


def test_a_hash_goes_on_from_its_state():
    data = bytes(range(256)) * 5
    first = provenance.Sha256()
    first.update(data[:333])
    then = provenance.Sha256(first.state)
    then.update(data[333:])
    assert then.hexdigest() == hashlib.sha256(data).hexdigest() == then.hexdigest()


if __name__ == "__main__":
    pytest.main([__file__])
