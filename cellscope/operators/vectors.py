"""Distances of all records' vectors to those of some records that ask, in blocks.

The asking records go to every worker; the others stream past them in Arrow batches and meet them in
matrix products, so memory is bounded by a block and by the asking records. All vectors have one length;
a null one, or one with nulls, has no distance, nor has one without length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cellscope.functions.shipping import ship

#: Pairs of a block, and distances up to which two cosines are the same.
PAIRS, SAME = 1 << 20, 1e-12


def _units(column: pa.Array, size: int) -> np.ndarray:
    """Unit vectors as rows; not a number where there is none."""
    good = pc.fill_null(pc.equal(pc.list_value_length(column), size), False)
    flat = pc.filter(column, good).flatten()
    v = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    if flat.null_count:
        v[pc.is_null(flat).to_numpy(zero_copy_only=False).reshape(-1, size).any(axis=1)] = np.nan
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    out = np.full((len(column), size), np.nan)
    out[good.to_numpy(zero_copy_only=False)] = np.divide(v, length, out=np.full_like(v, np.nan), where=length > 0)
    return out


def _asked(rows: DataFrame, key: str, group: str, vector: str) -> tuple[np.ndarray, list, np.ndarray]:
    """Keys, groups and unit vectors on the driver: as many as ask."""
    t = rows.select(key, group, vector).toArrow()
    v = t[vector].combine_chunks()
    size = pc.max(pc.list_value_length(v)).as_py() or 1
    return t[key].to_numpy(), t[group].to_pylist(), _units(v, size)


def _spread(rows: DataFrame) -> DataFrame:
    """Dealt over the tasks, as a small file is one partition and each row meets every asking record."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def distances_within(rows: DataFrame, asking: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """(a, b, distance): cosine distance of each asking record to each other record of its group."""
    spark = rows.sparkSession
    ship(spark)
    keys, groups, units = _asked(asking.where(F.col(group).isNotNull()), key, group, vector)
    members: dict = {}
    for i, g in enumerate(groups):
        members.setdefault(g, []).append(i)
    sent = spark.sparkContext.broadcast({g: (keys[i], units[i]) for g, i in members.items()})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, found = batch[key].to_numpy(), batch[group].to_pylist()
            v = _units(batch[vector], units_size)
            places: dict = {}
            for i, g in enumerate(found):
                places.setdefault(g, []).append(i)
            for g, at in places.items():
                if g not in sent.value:
                    continue
                a, q = sent.value[g]
                step = max(1, PAIRS // len(a))
                for j in range(0, len(at), step):
                    some = at[j : j + step]
                    d = 1 - v[some] @ q.T
                    other = b[some][:, None] != a[None, :]
                    d, to, of = d[other], np.broadcast_to(b[some][:, None], other.shape)[other], np.broadcast_to(a, other.shape)[other]
                    yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(to), pa.array(d, mask=np.isnan(d))], names=["a", "b", "distance"])

    units_size, of = units.shape[1], rows.schema[key].dataType
    schema = T.StructType([T.StructField("a", of), T.StructField("b", of), T.StructField("distance", T.DoubleType())])
    return _spread(rows.select(key, group, vector).where(F.col(group).isNotNull())).mapInArrow(meet, schema)


def nearest(rows: DataFrame, asking: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """(q, own, nearest): the asking record, its group and the group of the nearest other record by
    cosine; of equally near ones that of the least key."""
    spark = rows.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(_asked(asking, key, group, vector))
    of, kind = rows.schema[key].dataType, rows.schema[group].dataType
    size, arrow = sent.value[2].shape[1], to_arrow_type(kind)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, own, q = sent.value
        n = len(keys)
        best, who, what, met = np.full(n, -np.inf), np.zeros(n, keys.dtype), np.full(n, None, object), np.zeros(n, bool)
        for batch in batches:
            order = np.argsort(batch[key].to_numpy(), kind="stable")
            b, v = batch[key].to_numpy()[order], _units(batch[vector], size)[order]
            groups = np.array(batch[group].to_pylist() + [None], object)[:-1][order]
            for low in range(0, len(b), 1024):
                some, w = b[low : low + 1024], v[low : low + 1024]
                for i in range(0, n, 1024):
                    j = slice(i, i + 1024)
                    c = w @ q[j].T
                    other = some[:, None] != keys[None, j]
                    met[j] |= other.any(axis=0)
                    c[~other | np.isnan(c)] = -np.inf
                    top = c.max(axis=0)
                    at = (c >= top - SAME).argmax(axis=0)  # rows are in the order of their keys
                    better = (top > best[j] + SAME) | ((top > -np.inf) & (top >= best[j] - SAME) & (some[at] < who[j]))
                    best[j], who[j], what[j] = np.where(better, top, best[j]), np.where(better, some[at], who[j]), np.where(better, groups[low + at], what[j])
        if met.any():
            found = best > -np.inf
            yield pa.RecordBatch.from_arrays([
                pa.array(keys[met]), pa.array([g for g, m in zip(own, met) if m], arrow), pa.array(1 - best[met], mask=~found[met]), pa.array(who[met]), pa.array(list(what[met]), arrow),
            ], names=["q", "own", "d", "id", "other"])

    schema = T.StructType([T.StructField("q", of), T.StructField("own", kind), T.StructField("d", T.DoubleType()), T.StructField("id", of), T.StructField("other", kind)])
    found = _spread(rows.select(key, group, vector)).mapInArrow(meet, schema)
    order = F.when(F.col("d").isNotNull(), F.struct(F.round("d", 12), "id"))
    return found.groupBy("q", "own").agg(F.min_by("other", order).alias("nearest"))
