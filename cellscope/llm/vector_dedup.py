"""Embedding near-duplicates by collision-counting projections.

1. Identical vectors of a label collapse to one class with a multiplicity, so copies cost nothing.
2. Unit vectors are projected on many random directions. Tables of a few quantised projections
   deal the classes of a label into cells. The number of projections grows with the logarithm of
   the label's classes, so that unlike vectors share a cell about once whatever the label's size;
   the number of tables grows with it, slowly, so that two vectors at the threshold share a cell
   of some table but for probability LOST.
3. In a cell, the projections are sorted one by one and collisions inside a window centred on each
   vector are counted for every pair; a pair whose count reaches a level is verified by its cosine
   in double precision. The level is calibrated so that a pair at the threshold falls short of it
   with probability MISS at most.
4. A pair is counted in the first table in which it meets, so link counts add up. A cell larger
   than BLOCK is cut into sub-blocks that meet two at a time; tasks emit link counts and the links
   of a spanning forest, never lists of pairs.

Recall of a pair exactly at cosine 0.98 is (1 - MISS) * (1 - LOST), above 0.9999 by design; nearer
pairs are safer.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows with
a null label or null id, link with nothing; vectors of unequal length never link; rows with one id
are one node; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscope.llm.components import connected_components
from cellscope.llm.shared import ship, spool
from cellscope.llm.textarrays import mix

COSINE = 0.98
CELL, LOST = 2.0, 1e-6
#: Unlike vectors that share a cell with a vector, in the mean.
STRANGERS = 2.0
DIRECTIONS, WINDOW, MISS = 48, 0.3, 1e-5
BLOCK = 1024
#: Rows that a task holds before it works them off, and the largest cell whose pairs are counted directly.
HELD, SMALL = 4096, 48
SEED = 11


@lru_cache(maxsize=16)
def directions(dim: int, n: int, seed: int = SEED) -> np.ndarray:
    """Gaussian directions, one a column; the same wherever they are drawn."""
    return np.random.Generator(np.random.PCG64([seed, dim, n])).standard_normal((dim, n))


def count_level(cosine: float = COSINE, n: int = DIRECTIONS, window: float = WINDOW, miss: float = MISS) -> int:
    """The largest count that a pair at the threshold reaches but for probability ``miss``.

    A projection of the difference of two unit vectors is normal with their distance as deviation.
    """
    p = math.erf(window / (math.sqrt(2 - 2 * cosine) * math.sqrt(2)))
    below = 0.0
    for level in range(n + 1):
        below += math.comb(n, level) * p**level * (1 - p) ** (n - level)
        if below > miss:
            return level
    return n


def same_cell(distance: float, cell: float = CELL) -> float:
    """The chance that one quantised projection puts two vectors of that distance into one cell."""
    r = cell / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def widths_for(n: int, cosine: float = COSINE, strangers: float = STRANGERS) -> int:
    """Projections of a table for a label of n classes: unrelated vectors are at a distance of about
    the root of two."""
    return max(2, math.ceil(math.log(max(1.0, n / strangers)) / -math.log(same_cell(math.sqrt(2)))))


def tables_for(widths: int, cosine: float = COSINE, lost: float = LOST) -> int:
    """Tables after which a pair at the threshold has met but for probability ``lost``."""
    return math.ceil(math.log(lost) / math.log1p(-(same_cell(math.sqrt(2 - 2 * cosine)) ** widths)))


def cell_keys(unit: np.ndarray, widths: int, tables: int, cell: float = CELL) -> np.ndarray:
    """The cell of each vector in each table as a 64-bit number."""
    dim = unit.shape[1]
    rng = np.random.Generator(np.random.PCG64([SEED, dim, tables, widths]))
    slots = np.floor(unit @ directions(dim, tables * widths, SEED + 1) / cell + rng.random(tables * widths)).astype(np.int64).view(np.uint64)
    keys = np.tile(np.arange(1, tables + 1, dtype=np.uint64), (len(unit), 1))
    for i in range(widths):
        keys = mix(keys ^ (slots[:, i::widths] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1)))
    return keys


def _units(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, vector as doubles in bytes, or null if it cannot link)."""
    for batch in batches:
        vectors = []
        for v, label, key in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
            ok = v is not None and label is not None and key is not None and len(v) and None not in v
            a = np.array(v, np.float64) if ok else None
            if ok and (not np.isfinite(a).all() or not a.any()):
                a = None
            if a is not None:
                # a power of two keeps directions exact and squares finite
                a = np.ldexp(a, -int(np.frexp(np.abs(a).max())[1])) + 0.0
            vectors.append(a.astype("<f8").tobytes() if a is not None else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary())], names=["vec_id", "label", "vector"])


def _celled(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """(id, cells) of classes (id, widths, vector), by dimension and widths."""
    for batch in batches:
        ids, widths, raw = (c.to_pylist() for c in batch.columns)
        kinds = np.array([(len(r), w) for r, w in zip(raw, widths, strict=True)], np.int64).reshape(-1, 2)
        for size, width in np.unique(kinds, axis=0).tolist():
            at = np.flatnonzero((kinds == (size, width)).all(axis=1))
            tables = tables_for(width, cosine)
            for lo in range(0, len(at), 4096):
                part = at[lo : lo + 4096]
                keys = cell_keys(_units([raw[i] for i in part]), width, tables)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * tables), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in part], pa.int64()), listed], names=["id", "cells"])


def collisions(mine: np.ndarray, theirs: np.ndarray, window: float) -> np.ndarray:
    """Counts, for each pair, of projections in which theirs lies in the window centred on mine.

    Each projection of theirs is sorted once; a window is then a run of the sorted order. Runs are
    added up as differences at their ends, put back in the order of ``theirs``.
    """
    n, m = len(mine), len(theirs)
    counts = np.zeros((n, m), np.int16)
    for j in range(mine.shape[1]):
        order = np.argsort(theirs[:, j], kind="stable")
        ordered = theirs[order, j]
        lo = np.searchsorted(ordered, mine[:, j] - window, "left")
        hi = np.searchsorted(ordered, mine[:, j] + window, "right")
        total = int((hi - lo).sum())
        if total:
            rows = np.repeat(np.arange(n), hi - lo)
            spots = order[np.arange(total) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
            counts.reshape(-1)[rows * m + spots] += 1  # a pair occurs once in a projection
    return counts


class _Forest:
    """Links that tie what was apart, as pairs of ids."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, self.parent, self.links = ids, np.arange(len(ids)), []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def tie(self, i: np.ndarray, j: np.ndarray) -> None:
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.parent[y] = x
                self.links.append((int(self.ids[x]), int(self.ids[y])))


def small_pairs(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs inside groups of rows, given the bounds of the groups."""
    sizes, one, two = np.diff(bounds), [], []
    for m in np.unique(sizes[sizes > 1]).tolist():
        at = bounds[:-1][sizes == m][:, None]
        i, j = np.triu_indices(m, 1)
        one.append((at + i).ravel())
        two.append((at + j).ravel())
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *one]), np.concatenate([none, *two])


def block_pairs(side: np.ndarray, sketch: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one large block whose collisions reach the level, 256 rows at a time."""
    a = np.flatnonzero((side == 0) | (side == 2))
    b = np.flatnonzero((side == 1) | (side == 2))
    for lo in range(0, len(a), 256):
        mine = a[lo : lo + 256]
        i, j = np.nonzero(collisions(sketch[mine], sketch[b], WINDOW) >= level)
        i, j = mine[i], b[j]
        keep = (side[i] != 2) | (i < j)
        yield i[keep], j[keep]


def _linked(groups: np.ndarray, table: np.ndarray, side: np.ndarray, ids: np.ndarray, copies: np.ndarray, cells: np.ndarray, unit: np.ndarray, cosine: float, level: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Multiplicities linked to each row within its group, and links of a spanning forest.

    Rows of a group are neighbours. Small groups are counted together, pair by pair; a large one
    by sorted projections. Either way a pair's collisions are the projections in which one lies
    in the window centred on the other."""
    linked = np.zeros(len(ids), np.int64)
    forest = _Forest(ids)
    sketch = unit @ directions(unit.shape[1], DIRECTIONS)

    def verify(i: np.ndarray, j: np.ndarray) -> None:
        # a pair counts where it met first
        before = np.arange(cells.shape[1]) < table[i][:, None]
        keep = ~((cells[i] == cells[j]) & before).any(axis=1)
        i, j = i[keep], j[keep]
        keep = (unit[i] * unit[j]).sum(axis=1) >= cosine
        i, j = i[keep], j[keep]
        np.add.at(linked, i, copies[j])
        np.add.at(linked, j, copies[i])
        forest.tie(i, j)

    bounds = np.concatenate([np.flatnonzero(np.diff(groups, prepend=groups[0] - 1)), [len(groups)]])
    large = (np.diff(bounds) > SMALL) | (side[bounds[:-1]] != 2)
    keep = np.repeat(~large, np.diff(bounds))
    at = np.flatnonzero(keep)
    inner = np.concatenate([[0], np.cumsum(np.diff(bounds)[~large])])
    i, j = small_pairs(inner)
    for lo in range(0, len(i), 65536):
        x, y = at[i[lo : lo + 65536]], at[j[lo : lo + 65536]]
        hit = (np.abs(sketch[x] - sketch[y]) <= WINDOW).sum(axis=1) >= level
        verify(x[hit], y[hit])
    for k in np.flatnonzero(large).tolist():
        a, b = bounds[k], bounds[k + 1]
        for x, y in block_pairs(side[a:b], sketch[a:b], level):
            verify(a + x, a + y)
    return linked, forest.links


def _counted(batches: Iterator[pa.RecordBatch], cosine: float, level: int) -> Iterator[pa.RecordBatch]:
    """Rows (table, cell, lo, hi, side, id, copies, cells, vector) by block pair; out come (a, b, n):
    n links of a where b is null, else a link."""
    now, group, held = None, 0, []

    def flush() -> Iterator[pa.RecordBatch]:
        for shape in sorted({(len(r[6]), len(r[5])) for r in held}):
            rows = [r for r in held if (len(r[6]), len(r[5])) == shape]
            groups, table, side, ids, copies = (np.array([r[k] for r in rows], np.int64) for k in range(5))
            linked, links = _linked(groups, table, side, ids, copies, np.array([r[5] for r in rows], np.int64), _units([r[6] for r in rows]), cosine, level)
            some = np.flatnonzero(linked)
            a = [*ids[some].tolist(), *(x for x, _ in links)]
            b = [*([None] * len(some)), *(y for _, y in links)]
            n = [*linked[some].tolist(), *([0] * len(links))]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])
        held.clear()

    for batch in batches:
        for table, cell, lo, hi, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (table, cell, lo, hi):
                if len(held) >= HELD:
                    yield from flush()
                now, group = (table, cell, lo, hi), group + 1
            held.append((group, table, *row))
    yield from flush()


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = vectors.schema["label"].dataType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").mapInArrow(_clean, f"vec_id long, label {kind}, vector binary")
    rows = spool(rows, "vectors")
    able = rows.where("vector IS NOT NULL").groupBy("vec_id", "label", "vector").agg(F.lit(1).alias("one"))
    # a class is named by the least id of its copies; one id with several vectors names its first class only
    classes = able.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = spool(classes.withColumn("id", F.xxhash64("label", "vector")), "classes")
    # one row a label and length; borders of n at which a projection more is taken
    counts_by = classes.groupBy("label", F.length("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    borders, widths = [], 2
    while 2**40 > (border := math.floor(STRANGERS * same_cell(math.sqrt(2)) ** -widths)):
        borders.append(border)
        widths += 1
    counts_by = counts_by.select(F.col("label").alias("l"), "size", (2 + F.size(F.filter(F.array(*[F.lit(b) for b in borders]), lambda b: F.col("n") > b))).alias("widths"))
    sized = classes.join(counts_by, (F.col("label") == F.col("l")) & (F.length("vector") == F.col("size"))).select("id", "widths", "vector")
    celled = spool(sized.mapInArrow(lambda it: _celled(it, cosine), "id long, cells array<long>"), "cells")
    spots = celled.join(classes.select("id", "label"), "id").select("id", "label", F.posexplode("cells").alias("table", "cell")).withColumn("cell", F.xxhash64("label", "cell")).drop("label")
    sizes = spots.groupBy("table", "cell").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("table", "cell", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts"))
    dealt = spots.join(sizes, ["table", "cell"]).withColumn("own", F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise(F.when(F.col("own") < F.col("other"), 0).otherwise(1))
    dealt = dealt.select("table", "cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), side.alias("side"), "id")
    full = dealt.join(celled, "id").join(classes.select("id", "copies", "vector"), "id").select("table", "cell", "lo", "hi", "side", "id", "copies", "cells", "vector")
    full = full.repartition(n, "table", "cell", "lo", "hi").sortWithinPartitions("table", "cell", "lo", "hi")
    level = count_level(cosine)
    found = spool(full.mapInArrow(lambda it: _counted(it, cosine, level), "a long, b long, n long"), "found")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    # components over ids: links between classes stand for links between their least ids
    names = classes.select("id", "least")
    links = found.where("b IS NOT NULL").join(names.select(F.col("id").alias("a"), F.col("least").alias("x")), "a").join(names.select(F.col("id").alias("b"), F.col("least").alias("y")), "b")
    own = able.join(classes.select("label", "vector", "id", "least", "copies"), ["label", "vector"]).select("vec_id", "id", "least", "copies")
    twice = rows.groupBy("vec_id").count().where("count > 1").select("vec_id")  # ids on several rows tie their classes
    ties = own.where("vec_id <> least").join(twice, "vec_id", "left_semi").select(F.col("vec_id").alias("a"), F.col("least").alias("b"))
    comp = connected_components(links.select(F.col("x").alias("a"), F.col("y").alias("b")).union(ties))
    per = own.join(counts, "id", "left").join(comp.select(F.col("id").alias("least"), "component"), "least", "left")
    per = per.groupBy("vec_id").agg(F.sum(F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.min(F.coalesce("component", "least")).alias("component"))
    out = rows.select("vec_id").join(per, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
