"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing cuts a sequence at places that depend on a few neighbouring symbols
only: labels 2k + bit, k the lowest bit in which a symbol differs from the one before, are taken
until six labels remain; phrases begin at local maxima, and runs of one symbol are phrases of
their own. Phrases are named by a hash of their content and parsed again, level by level. Equal
substrings so get equal phrase names inside, wherever they stand.

A fingerprint samples the distinct phrases of all levels by weight (bytes covered): in each bin
the phrase with the least exponential draw, given by its name, leaves a tag. The likeness of two
fingerprints is 2J / (1 + J), J the share of bins that agree: about the share of text in common.

Defined results: null counts as empty; the fingerprint of an empty text has no tags and is wholly
like another empty one, wholly unlike others; equal texts have equal fingerprints; rows with one
id follow each other in text order; a null id sorts after all others; a lone document follows
itself; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscope.llm.shared import ship
from cellscope.llm.textarrays import mix

BINS = 128
LEVELS = 6
#: From this length on (bytes) phrases of the first level weigh less, in inverse proportion, as they
#: are too common in long texts. The weight has no step, so near copies draw from like pools.
SHORT = 256
BATCH_BYTES = 1 << 20
_U = np.uint64


def _coin_table(bits: int) -> np.ndarray:
    """Labels for pairs (before, now) of ``bits``-bit symbols, at index before << bits | now."""
    now, before = np.meshgrid(np.arange(1 << bits), np.arange(1 << bits))
    differ = now ^ before
    k = np.where(differ, np.bitwise_count((differ & -differ) - 1), 0)
    return (2 * k + ((now >> k) & 1)).astype(np.uint8).reshape(-1)


_COINS = {bits: _coin_table(bits) for bits in (3, 4, 7, 8)}


def _toss(labels: np.ndarray, bits: int, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing on small labels; the first of a text is told by its lowest bit."""
    kind = np.uint16
    pair = labels.astype(kind)
    pair[1:] |= labels[:-1].astype(kind) << kind(bits)
    out = _COINS[bits][pair]
    out[first] = labels[first] & 1
    return out


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6 for bytes or 64-bit names."""
    if symbols.dtype == np.uint8:
        out = _toss(symbols, 8, first)
    else:
        differ = symbols.copy()
        differ[1:] ^= symbols[:-1]
        low = differ & (~differ + _U(1))
        k = (np.bitwise_count(low - _U(1)) & 63).astype(np.uint8)
        out = (2 * k + ((symbols >> k.astype(np.uint64)) & _U(1)).astype(np.uint8)).astype(np.uint8)
        out[first] = (symbols[first] & _U(1)).astype(np.uint8)
        out = _toss(out, 7, first)
    return _toss(_toss(out, 4, first), 3, first)


def phrase_starts(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Flags of the symbols that begin a phrase; ``first`` holds the places where texts begin."""
    n = len(symbols)
    labels = _labels(symbols, first)
    start = np.zeros(n, bool)
    start[1:] = labels[1:] > labels[:-1]
    peak = labels[:-1] >= labels[1:]
    peak[first[first > 0] - 1] = True  # the last symbol of a text has none after it
    start[:-1] &= peak
    same = np.zeros(n + 1, bool)  # same[i]: symbol i repeats symbol i - 1
    same[1:n] = symbols[1:] == symbols[:-1]
    same[first] = False
    start &= ~same[:-1]
    start |= same[1:] & ~same[:-1]  # a run begins
    start[1:] |= same[: n - 1] & ~same[1:n]  # the symbol after a run
    start[first] = True
    return start


def _names(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of phrases, symbol by symbol. A run counts by its symbol and length; other phrases
    are short, as labels below 6 have a local maximum every few places."""
    sizes = ends - starts
    names = mix(sizes.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    run = (sizes > 1) & (symbols[starts] == symbols[np.minimum(starts + 1, len(symbols) - 1)])
    steps = np.where(run, 1, sizes)
    live = np.arange(len(starts))
    for k in range(int(steps.max(initial=0))):
        live = live[steps[live] > k] if k else live
        names[live] = mix((names[live] ^ symbols[starts[live] + k].astype(np.uint64)) * _U(0xE7037ED1A0B428DB))
    return names


def parse(data: np.ndarray, offsets: np.ndarray, levels: int = LEVELS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, names, byte lengths, first phrase of each text closed by their number), level by level."""
    filled = offsets[:-1] < offsets[1:]
    symbols, at, bounds = data, None, offsets
    for level in range(1, levels + 1):
        if not len(symbols):
            return
        starts = np.flatnonzero(phrase_starts(symbols, bounds[:-1][filled]))
        ends = np.append(starts[1:], len(symbols))
        names = _names(symbols, starts, ends)
        at = starts if at is None else at[starts]
        yield level, names, np.diff(np.append(at, len(data))), np.searchsorted(starts, bounds)
        symbols, bounds = names, np.searchsorted(starts, bounds)


def sketches(data: np.ndarray, offsets: np.ndarray, bins: int = BINS, levels: int = LEVELS) -> np.ndarray:
    """Tags of many texts, one row of ``bins`` 16-bit numbers each; 0 marks an empty bin."""
    n = len(offsets) - 1
    best = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    first_weight = np.minimum(1.0, SHORT / np.maximum(np.diff(offsets), 1))
    for level, names, lengths, bounds in parse(data, offsets, levels):
        owner = np.repeat(np.arange(n), np.diff(bounds))
        if level == 1:
            lengths = lengths * first_weight[owner]
        draw = mix(names + _U(level))
        race = -np.log(((draw >> _U(40)).astype(np.float64) + 0.5) * 2.0**-24) / lengths
        entry = (race.astype(np.float32).view(np.uint32).astype(np.uint64) << _U(32)) | (draw & _U(0x7FFF)) + _U(1)
        np.minimum.at(best, owner * bins + ((draw >> _U(16)) & _U(bins - 1)).astype(np.int64), entry)
    tags = np.where(best == np.iinfo(np.uint64).max, _U(0), best & _U(0xFFFF))
    return tags.astype(">u2").reshape(n, bins)


def fingerprints(texts: list[str], bins: int = BINS, levels: int = LEVELS) -> np.ndarray:
    coded = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
    return sketches(np.frombuffer(b"".join(coded), np.uint8), offsets, bins, levels)


def as_text(tags: np.ndarray) -> str:
    return tags.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, from 0 to 1."""
    filled = ((a > 0) | (b > 0)).sum(axis=1)
    agree = ((a == b) & (a > 0)).sum(axis=1)
    return np.where(filled > 0, 2 * agree / np.maximum(filled + agree, 1), 1.0)


def edited(text: str, follower: str) -> str:
    """``text`` with its last third replaced by as much, or all, of the next document."""
    k = len(text) // 3
    return text[: len(text) - k] + follower[:k]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _emit(rows: list[tuple], tags: np.ndarray) -> pa.RecordBatch:
    """Results of the rows that their successor in the same part follows."""
    own = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
    texts = [edited(rows[i][3], rows[i + 1][3]) for i in own]
    changed = fingerprints(texts) if own else np.zeros((0, BINS), ">u2")
    mine, after = tags[own], tags[[i + 1 for i in own]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[i][2] for i in own], pa.int64()), pa.array([len(rows[i][3]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
            pa.array([as_text(t) for t in mine], pa.string()), pa.array([as_text(t) for t in changed], pa.string()),
            pa.array(likeness(mine, changed), pa.float64()), pa.array(likeness(mine, after), pa.float64()),
        ],
        names=NAMES,
    )


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, tail, doc_id, text) in order: each row meets the next one of its part."""
    rows: list[tuple] = []
    tags = np.zeros((0, BINS), ">u2")
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal rows, tags, size
        new = fingerprints([r[3] for r in rows[len(tags) :]])
        tags = np.concatenate([tags, new])
        if len(rows) > 1:
            yield _emit(rows, tags)
        rows, tags, size = rows[-1:], tags[-1:], 0

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(row)
            size += len(row[3])
            if size >= BATCH_BYTES:
                yield from flush()
    if rows:
        yield from flush()


def _parts(docs: DataFrame, n: int) -> tuple[DataFrame, list[tuple[int | None, int]]]:
    """Ids dealt to about n ranges in descending order, and each range's first id with the range
    before it (the last for the first), where that row is needed too."""
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.5 / n)), reverse=True)
    below = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]), lambda c: c > F.col("doc_id"))) if cuts else F.lit(0)
    dealt = docs.withColumn("part", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(below).cast("int"))
    heads = sorted((r["part"], r["head"]) for r in dealt.groupBy("part").agg(F.max("doc_id").alias("head")).collect())  # one row a range
    return dealt, [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): its fingerprint, that of its edited text, and
    their likeness to each other and to the next document in descending id order.

    Texts are shuffled once, by ranges of ids; only the first row of each range travels twice.
    """
    spark = docs.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt, heads = _parts(docs, 2 * n)
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    goes = F.broadcast(spark.createDataFrame(heads, "head long, goes int"))  # one row a range
    tails = docs.join(goes, F.col("doc_id").eqNullSafe(F.col("head"))).select(F.col("goes").alias("part"), F.lit(1).alias("tail"), "doc_id", "text")
    rows = dealt.select("part", F.lit(0).alias("tail"), "doc_id", "text").unionByName(tails)
    rows = rows.repartition(n, "part").sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), "text")
    return rows.mapInArrow(_follow, SCHEMA)
