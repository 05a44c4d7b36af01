"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find grouping.

1. Each text becomes its set of five-word shingles and a SuperMinHash signature; equal sets
   collapse to one class under the smallest id.
2. Classes that agree in a band share a bucket. Each class is first verified against the smallest
   leader of its buckets, on full sets, in salted streams that hold one leader set at a time.
3. Buckets whose members are then still in different components have all their pairs across
   components verified, in bounded blocks. So no link inside a bucket is lost, no list of all
   pairs is made, and groups that the first pass has joined cost nothing more.
4. Links become components by minimum propagation.

Two classes of similarity s miss each other in all bands with probability (1 - s^4)^32, 5e-6 at
0.75.

Defined results: null, empty and blank texts have no shingles and link with nothing; rows with
one id are one node (each keeps its own row); a row with a null id has a null component and is
kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscope.llm.components import connected_components
from cellscope.llm.shared import ship, spool
from cellscope.llm.textarrays import chunks, distinct_sets, mix, shingle_hashes, span_hashes, word_spans

WORDS = 5
SIMILAR = (75, 100)
SLOTS, BANDS = 128, 32
#: Members of one verification stream, and members and bytes of sets that one block holds together.
STREAM, BLOCK, BLOCK_BYTES = 128, 256, 1 << 24
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def super_minhash(elements: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures of many sets at once, one row of ``slots`` values each.

    Element e draws r_0, r_1, ... and a random permutation of the slots; slot p(j) takes the
    minimum of j + r_j. A set stops after the first step j at which all its slots are below j + 1,
    as later values cannot be smaller: large sets need one or two steps.
    """
    n = len(offsets) - 1
    sign = np.full((n, slots), np.inf)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    flat = sign.reshape(-1)
    perm = None
    for j in range(slots):
        if not len(elements):
            break
        draw = mix(elements + np.uint64(int(_GOLD) * (2 * j + 1) % (1 << 64)))
        value = (draw >> np.uint64(12)).astype(np.float64) * 2.0**-52 + j
        k = j + ((mix(draw + _GOLD) >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            place = k
        else:
            at = np.arange(len(elements))
            place = perm[at, k].astype(np.int64)
            perm[at, k] = perm[:, j]
            perm[:, j] = place
        np.minimum.at(flat, owner * slots + place, value)
        open_sets = sign.max(axis=1) >= j + 1
        keep = open_sets[owner]
        if j == 0:
            first = place[keep]
            perm = np.tile(np.arange(slots, dtype=np.uint16), (len(first), 1))
            perm[np.arange(len(first)), first] = 0
            perm[:, 0] = first
        else:
            perm = perm[keep]
        elements, owner = elements[keep], owner[keep]
    return sign


def band_keys(sign: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of a signature; the band's number is part of it."""
    rows = sign.view(np.uint64).reshape(len(sign), bands, -1)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, (len(sign), 1))
    for i in range(rows.shape[2]):
        key = mix(key ^ rows[:, :, i]) + _GOLD
    return key


def _sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    starts, ends, firsts = word_spans(data, offsets)
    return distinct_sets(*shingle_hashes(span_hashes(data, starts, ends), firsts, words))


def _features(batches: Iterator[pa.RecordBatch], words: int, slots: int, bands: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in chunks(batch, "text"):
            sets = _sets(data, offsets, words)
            sizes = np.array([len(s) for s in sets], np.int64)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
            keys = band_keys(super_minhash(flat, bounds, slots), bands)
            keys[sizes == 0] = 0
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(m)]) for m in (mix(flat + _GOLD), mix(flat ^ _GOLD))]
            a, b = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), listed], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])


def features(docs: DataFrame, words: int = WORDS, slots: int = SLOTS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands) of every text; (set_a, set_b, n) names the set."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: _features(it, words, slots, bands), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, shingles): the sorted distinct shingle hashes of each text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([s.tobytes() for s in _sets(data, offsets, words)], pa.binary())], names=["id", "shingles"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "id long, shingles binary")


def _common(one: np.ndarray, many: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of one sorted set with each of many, laid end to end."""
    at = np.minimum(np.searchsorted(one, many), len(one) - 1)
    hits = np.concatenate([[0], np.cumsum(one[at] == many)])
    return hits[bounds[1:]] - hits[bounds[:-1]]


def _similar(common: np.ndarray, n: int, sizes: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    return similar[1] * common >= similar[0] * (n + sizes - common)


def _stream_links(batches: Iterator[pa.RecordBatch], similar: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows (leader, salt, member or null, shingles), leaders first: links that hold."""
    now, leaders = None, []
    for batch in batches:
        a, b = [], []
        for leader, salt, member, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (leader, salt):
                now, leaders = (leader, salt), []
            s = np.frombuffer(raw, np.uint64)
            if member is None:
                leaders.append(s)
            elif any(_similar(_common(x, s, np.array([0, len(s)])), len(x), np.array([len(s)]), similar)[0] for x in leaders):
                a.append(leader)
                b.append(member)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _block_links(rows: list[tuple], similar: tuple[int, int]) -> list[tuple[int, int]]:
    """Links across components in one block pair; rows are (side, id, component, shingles)."""
    rows.sort(key=lambda r: (len(r[3]), r[1]))
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    side = np.array([r[0] for r in rows])
    comp = np.array([r[2] for r in rows])
    out = []
    for i in range(len(rows) - 1):
        # larger sets only, none too large to be similar, other components, other side if there is one
        hi = int(np.searchsorted(sizes, sizes[i] * similar[1] // similar[0], "right"))
        want = np.arange(i + 1, hi)
        want = want[(comp[want] != comp[i]) & ((side[want] != side[i]) | (side[want] == 2))]
        if not len(want):
            continue
        part = np.concatenate([flat[bounds[j] : bounds[j + 1]] for j in want]) if len(want) < hi - i - 1 else flat[bounds[i + 1] : bounds[hi]]
        common = _common(sets[i], part, np.concatenate([[0], np.cumsum(sizes[want])]))
        for j in want[_similar(common, int(sizes[i]), sizes[want], similar)]:
            if comp[i] != comp[j]:
                out.append((rows[i][1], rows[j][1]))
                comp[comp == comp[j]] = comp[i]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], similar: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    now, held = None, []

    def flush() -> pa.RecordBatch:
        found = _block_links(held, similar) if len(held) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        for key, lo, hi, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (key, lo, hi):
                if held:
                    yield flush()
                now, held = (key, lo, hi), []
            held.append(tuple(row))
    if held:
        yield flush()


def _leader_links(first: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Verified links (a, b) of each class with the leader it is held against."""
    hot = first.groupBy("leader").agg(F.ceil(F.count("*") / STREAM).cast("int").alias("parts")).where("parts > 1")
    salted = first.join(hot, "leader", "left").select("leader", "id", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("salt"))
    members = salted.join(sets, "id").select("leader", "salt", F.col("id").alias("member"), "shingles")
    heads = salted.select("leader", "salt").distinct().join(sets.withColumnRenamed("id", "leader"), "leader").select("leader", "salt", F.lit(None).cast("long").alias("member"), "shingles")
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streams = heads.unionByName(members).repartition(n, "leader", "salt").sortWithinPartitions("leader", "salt", F.col("member").asc_nulls_first())
    return streams.mapInArrow(lambda it: _stream_links(it, similar), "a long, b long")


def _open_links(bucketed: DataFrame, first: DataFrame, found: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Links across components inside buckets that the leaders have not closed."""
    comp = connected_components(found)
    at = bucketed.join(comp, "id", "left").select("key", "id", "leader", "n_shingles", F.coalesce("component", "id").alias("comp"))
    at = spool(at, "members")
    keys = at.groupBy("key").agg(
        F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("id").alias("low_id"), F.max("id").alias("high_id"),
        F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("ids"), F.sum("n_shingles").alias("size"),
    ).where("lo <> hi")
    # buckets of the same members are one; a pair that was held against each other already is done
    keys = keys.groupBy("n", "ids", "low_id", "high_id").agg(F.min("key").alias("key"), F.max("size").alias("size"))
    tested = first.select(F.col("leader").alias("low_id"), F.col("id").alias("high_id"), F.lit(True).alias("tested"))
    keys = keys.join(tested, ["low_id", "high_id"], "left").where("n > 2 OR tested IS NULL").select("key", F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.col("n"), F.ceil(8 * F.col("size") / BLOCK_BYTES))).cast("int").alias("parts"))
    rows = at.join(keys, "key").withColumn("own", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise(F.when(F.col("own") < F.col("other"), 0).otherwise(1))
    rows = rows.select("id", "comp", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), side.alias("side"))
    rows = rows.join(sets, "id").select("key", "lo", "hi", "side", "id", "comp", "shingles")
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return rows.mapInArrow(lambda it: _blocks(it, similar), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR, slots: int = SLOTS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    feats = spool(features(docs, words, slots, bands), "features")
    full = feats.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = spool(full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "classes")
    members = classes.select("id", "n_shingles", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader <> last").select("key", "leader")
    bucketed = spool(members.join(buckets, "key").distinct(), "buckets")
    sets = spool(shingle_sets(docs.join(bucketed.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").distinct(), words), "sets")
    first = spool(bucketed.groupBy("id").agg(F.min("leader").alias("leader")).where("id <> leader"), "first")
    found = spool(_leader_links(first, sets, similar), "found")
    more = _open_links(bucketed, first, found, sets, similar)
    # one id may stand for several sets, and one set for several ids
    copies = full.join(classes.select("set_a", "set_b", "n_shingles", "id"), ["set_a", "set_b", "n_shingles"]).select("doc_id", "id").distinct()
    copies = spool(copies, "copies")
    comp = connected_components(found.union(more).union(copies.where("doc_id <> id").join(_repeated(feats), "doc_id", "left_semi").select("doc_id", "id")))
    named = copies.join(comp, "id", "left").select("doc_id", F.coalesce("component", "id").alias("component")).groupBy("doc_id").agg(F.min("component").alias("component"))
    out = feats.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _repeated(feats: DataFrame) -> DataFrame:
    """Ids that stand on several rows: their sets are tied together by explicit links."""
    return feats.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
