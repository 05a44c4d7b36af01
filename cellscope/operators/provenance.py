"""Hashes of files and of whole manifests.

SHA-256 takes a file's bytes in their order. Files of up to WHOLE bytes are hashed natively, each in
one task. A larger one is read in the splits of Spark's own reader, one task a split, each of which
goes on from the state that the one before it left: no task reads or holds a whole large file.
"""

from __future__ import annotations

import _hashlib
import ctypes
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscope.functions.shipping import ship

#: Bytes of a file that one task may hash whole, and large files hashed at once.
WHOLE, AT_ONCE = 128 << 20, 8
_RECORD = "path string, sha256 string, size_bytes long"
_STATE_BYTES = 112  # OpenSSL's SHA256_CTX
_BOM = b"\xef\xbb\xbf"


def _crypto() -> ctypes.CDLL | None:
    """The library of Python's own hashes, whose SHA-256 can stop and go on; None if it hides that."""
    try:
        lib = ctypes.CDLL(_hashlib.__file__)
        lib.SHA256_Update.argtypes = ctypes.c_void_p, ctypes.c_void_p, ctypes.c_size_t
        lib.SHA256_Init.argtypes = (ctypes.c_void_p,)
        lib.SHA256_Final.argtypes = ctypes.c_char_p, ctypes.c_void_p
        return lib
    except (OSError, AttributeError):
        return None


class Sha256:
    """SHA-256 that goes on from a saved ``state``."""

    def __init__(self, state: bytes | None = None):
        self._lib, self._ctx = _crypto(), ctypes.create_string_buffer(state or bytes(_STATE_BYTES), _STATE_BYTES)
        if state is None:
            self._lib.SHA256_Init(self._ctx)

    @property
    def state(self) -> bytes:
        return self._ctx.raw

    def update(self, data: bytes) -> None:
        self._lib.SHA256_Update(self._ctx, data, len(data))

    def update_at(self, address: int, size: int) -> None:
        self._lib.SHA256_Update(self._ctx, address, size)

    def hexdigest(self) -> str:
        out, ctx = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self.state, _STATE_BYTES)
        self._lib.SHA256_Final(out, ctx)
        return out.raw.hex()


def _literal(path: str) -> str:
    """A path whose glob characters stand for themselves."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _after(lines: DataFrame, split: int, state: bytes, read: int) -> tuple[bytes, int]:
    """State and bytes read after one more split; the line end last read is not yet hashed."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, n = Sha256(state), read
        for batch in batches:
            rows = batch.column(0).cast(pa.large_binary())
            if not len(rows):
                continue
            _, offsets, data = rows.buffers()
            at = np.frombuffer(offsets, np.int64)
            first, last = int(at[rows.offset]), int(at[rows.offset + len(rows)])
            if n:
                sha.update(b"\n")
            sha.update_at(data.address + first, last - first - 1)
            n += last - first
        yield pa.RecordBatch.from_pydict({"state": [sha.state], "n": [n]}, schema=pa.schema([("state", pa.binary()), ("n", pa.int64())]))

    found = lines.mapInArrow(go, "state binary, n long").rdd
    [row] = lines.sparkSession.sparkContext.runJob(found, list, [split])
    return bytes(row["state"]), row["n"]


def _chained(spark: SparkSession, path: str, size: int) -> str:
    """The hash of a file, split after split in the order of its bytes."""
    # lines keep their bytes as they are, whatever these mean; one file's splits come in its order
    lines = spark.read.option("lineSep", "\n").text(_literal(path)).select(F.concat("value", F.lit("\n")).cast("binary").alias("line"))
    splits = lines.rdd.getNumPartitions()
    for head in (b"", _BOM):  # the reader drops a byte order mark, which shows in the number of bytes
        sha, n = Sha256(), 0
        sha.update(head)
        state = sha.state
        for split in range(splits):
            state, n = _after(lines, split, state, n)
        if n + len(head) - size in (0, 1):
            sha = Sha256(state)
            if n and n + len(head) == size:  # else the last line has no end
                sha.update(b"\n")
            return sha.hexdigest()
    raise ValueError(f"{path}: {n} bytes read, {size} listed")


def file_records(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """(path, sha256, size_bytes) of every file under a path; Spark's reader passes over empty files.

    Files of more than ``whole`` bytes are hashed when this is called. Those that Spark's reader would
    decompress are hashed whole, as are all where Python's hashes do not show their state."""
    files = spark.read.format("binaryFile").load(path)
    native = lambda f: f.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))
    large = files.where(F.col("length") > whole).select("path", "length").collect() if _crypto() else []
    if not large:
        return native(files)
    ship(spark)
    jvm = spark.sparkContext._jvm
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration())
    coded = [r["path"] for r in large if codecs.getCodec(jvm.org.apache.hadoop.fs.Path(r["path"]))]
    plain = [r for r in large if r["path"] not in coded]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        hashes = list(pool.map(lambda r: _chained(spark, r["path"], r["length"]), plain))
    out = native(files.where(F.col("length") <= whole))  # the reader skips the content of others
    out = out.unionByName(native(spark.read.format("binaryFile").load([_literal(p) for p in coded]))) if coded else out
    return out.unionByName(spark.createDataFrame([(r["path"].rsplit("/", 1)[-1], h, r["length"]) for r, h in zip(plain, hashes)], _RECORD))


def manifest_hash(records: DataFrame) -> DataFrame:
    """One row: the hash of the sorted ``path:sha256`` lines and the number of files."""
    lines = F.sort_array(F.collect_list(F.concat_ws(":", "path", "sha256")))
    return records.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("manifest_hash"), F.count("*").alias("n_files"))
