"""Packing documents into token sequences by non-negative least squares.

1. Texts become token ids. A document gives as many full windows as it fills, and a rest.
2. Shallow combinations of up to three rest lengths that fill a window exactly are enumerated; a
   non-negative least-squares fit of repeat counts against the histogram of rests, rounded down,
   says how often each is used.
3. Rests that no combination takes are laid end to end, longest first, and cut at window ends, so
   only the last sequence has padding.

Sequences are numbered through a permutation (a step of about the golden section of their number,
coprime to it), so windows of one document and sequences of one combination lie apart and reading
by number is not reading by document or length. The last sequence of the line, the only one with
padding, is where the permutation puts it.

The histogram has one bin for each length, whatever the corpus; rests find their place from their
length and their rank among rests of that length, which are computed by counts of (part, length)
and never by sorting the corpus in one place.

Tokens are those of the tokenizer file; the file is read, never trained. Words (the tokenizer's
own pre-tokens) are split on arrays of code points and encoded once per worker and chunk.

Defined results: null and empty texts give the end id alone; repeated rows are packed one by one;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscope.llm.shared import ship, spool
from cellscope.llm.textarrays import LONG, LOW_BYTES, chunks, octets, span_hashes

WINDOW = 1024
END_ID = 0
#: Lengths that the least-squares fit sees; also the most pieces of one combination.
DEPTH = 3


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class HashIndex:
    """Numbers of 64-bit keys in order of arrival: open addressing, whole arrays at a time."""

    def __init__(self, bits: int = 16) -> None:
        self.keys = np.zeros(0, np.uint64)
        self._grow(bits)

    def _grow(self, bits: int) -> None:
        self.bits, self.slots = bits, np.full((1 << bits) + 64, -1, np.int32)
        if len(self.keys):
            self._place(self.keys, np.arange(len(self.keys), dtype=np.int32))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def _place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        at = self._home(keys)
        while len(at):
            if at.max() >= len(self.slots):  # a run reached the end
                self._grow(self.bits + 1)
                return
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]
            lost = self.slots[at] != numbers
            at, numbers = at[lost] + 1, numbers[lost]

    def add(self, keys: np.ndarray) -> None:
        """Distinct keys that are not in yet."""
        numbers = np.arange(len(self.keys), len(self.keys) + len(keys), dtype=np.int32)
        self.keys = np.concatenate([self.keys, keys])
        bits = self.bits
        while len(self.keys) * 3 > 1 << bits:
            bits += 1
        if bits > self.bits:
            self._grow(bits)
        else:
            self._place(keys, numbers)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        at = self._home(keys)
        out = self.slots[at]
        if not len(self.keys):
            return out
        wrong = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(wrong):
            at[wrong] += 1
            out[wrong] = self.slots[np.minimum(at[wrong], len(self.slots) - 1)]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[out[wrong]] != keys[wrong])]
        return out


class WordEncoder:
    """Token ids of texts under a byte-level BPE file, by its pre-tokens.

    Pre-token borders follow the classes of code points (letters, numbers, white space, others);
    each distinct pre-token is encoded once and kept while memory allows.
    """

    KEEP, KEEP_BYTES = 3_000_000, 1 << 26

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # the byte alphabet of byte-level BPE: printable bytes stand for themselves
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.bpe = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.clear()

    def clear(self) -> None:
        self.seen = HashIndex()
        self.where = np.zeros(0, np.int64)  # by number of the pre-token, in the ids
        self.sizes = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint16)
        self.bytes = np.zeros(0, np.uint8)  # of all pre-tokens, end to end
        self.byte_at = np.zeros(0, np.int64)
        self.byte_sizes = np.zeros(0, np.int64)

    _classes: np.ndarray | None = None

    @classmethod
    def classes(cls) -> np.ndarray:
        """0 other, 1 letter, 2 number, 3 white space, for every code point."""
        if cls._classes is None:
            import regex

            every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
            out = np.zeros(0x110000, np.uint8)
            for k, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
                for m in regex.finditer(pattern, every):
                    a, b = m.span()
                    shift = lambda i: i if i < 0xD800 else i + 0x800
                    out[shift(a) : shift(b - 1) + 1] = k
            cls._classes = out
        return cls._classes

    def borders(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Flags of the code points that begin a pre-token; ``first`` flags those that begin a text."""
        kind = self.classes()[points]
        n = len(points)
        before = np.empty(n, np.uint8)
        before[0] = 255
        before[1:] = kind[:-1]
        before[first] = 255
        blank = points == 32
        lead = np.zeros(n, bool)  # a single space right before, that the run may take along
        lead[1:] = blank[:-1]
        lead &= ~first
        white = kind == 3
        start = np.where(white, before != 3, (before != kind) & ~lead)
        # the last white space before a word stands alone, or leads the word if it is a space
        follows = np.zeros(n, bool)
        follows[:-1] = ~white[1:] & ~first[1:]
        start |= white & follows
        # contractions: they match where a pre-token begins with an apostrophe
        quotes = np.flatnonzero((points == 39) & start)
        if len(quotes):
            self._contractions(points, kind, start, first, quotes)
        return start

    @staticmethod
    def _contractions(points: np.ndarray, kind: np.ndarray, start: np.ndarray, first: np.ndarray, quotes: np.ndarray) -> None:
        n = len(points)
        for q in quotes.tolist():
            end = q + 1
            while end < n and end < q + 3 and kind[end] == 1 and not first[end]:
                end += 1
            word = "".join(map(chr, points[q + 1 : end]))
            size = next((len(x) for x in ("s", "t", "re", "ve", "m", "ll", "d") if word.startswith(x)), 0)
            if size:
                start[q + 1 : q + 1 + size] = False
                if q + 1 + size < n:
                    nxt = q + 1 + size
                    # what follows begins anew, unless a space there leads the next run (flagged already)
                    start[nxt] = True

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets by text)."""
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        special = {i: np.array(self.bpe.encode(texts[i], allowed_special="all"), np.uint16) for i in odd}
        plain = [("" if i in special else t) for i, t in enumerate(texts)] if odd else texts
        joined = "".join(plain)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(t) for t in plain], np.int64)
        at = np.concatenate([[0], np.cumsum(lengths)])
        if len(points):
            first = np.zeros(len(points), bool)
            first[at[:-1][lengths > 0]] = True
            starts = np.flatnonzero(self.borders(points, first))
            data = np.frombuffer(joined.encode(), np.uint8)
            byte_at = starts
            if len(data) != len(points):  # some take several bytes
                width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
                byte_at = (np.cumsum(width) - width)[starts]
            ids, sizes = self._lookup(data, byte_at, np.append(byte_at[1:], len(data)))
            token_at = np.concatenate([[0], np.cumsum(sizes)])
            offsets = token_at[np.searchsorted(starts, at)]
        else:
            ids, offsets = np.zeros(0, np.uint16), np.zeros(len(texts) + 1, np.int64)
        if special:
            parts = [special.get(i, ids[offsets[i] : offsets[i + 1]]) for i in range(len(texts))]
            ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, offsets

    def _lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each pre-token. A hash only says where to look: the bytes of a
        pre-token are compared with those that were encoded under it."""
        keys = span_hashes(data, starts, ends, lower=False)
        at = self.seen.find(keys)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            fresh, one = np.unique(keys[missing], return_index=True)
            if (len(self.seen.keys) + len(fresh) > self.KEEP or len(self.bytes) > self.KEEP_BYTES) and len(self.seen.keys):
                self.clear()
                return self._lookup(data, starts, ends)
            spots = missing[one]
            words = self._spans(data, starts[spots], ends[spots])
            self._keep(words, [self._piece(w) for w in words])
            self.seen.add(fresh)
            at[missing] = self.seen.find(keys[missing])
        long = np.flatnonzero(ends - starts > 7)  # shorter ones never share a hash
        if len(long):
            wrong = long[~self._same(data, starts[long], ends[long], at[long])]
            if len(wrong):
                at = at.astype(np.int64)
                words = self._spans(data, starts[wrong], ends[wrong])
                at[wrong] = len(self.seen.keys) + np.arange(len(wrong))
                return self._gather(at, [self._piece(w) for w in words])
        return self._gather(at, [])

    def _piece(self, word: bytes) -> list[int]:
        text = word.decode()
        return self.bpe.encode_ordinary(text) if text else []

    @staticmethod
    def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        raw = data.tobytes()
        return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def _keep(self, words: list[bytes], coded: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, coded), np.int32, len(coded))
        self.where = np.concatenate([self.where, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(coded), np.uint16, int(sizes.sum()))])
        spans = np.fromiter(map(len, words), np.int64, len(words))
        self.byte_at = np.concatenate([self.byte_at, len(self.bytes) + np.cumsum(spans) - spans])
        self.byte_sizes = np.concatenate([self.byte_sizes, spans])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(words), np.uint8)])

    def _same(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each span has the bytes that its entry was made from."""
        sizes, kept = ends - starts, self.byte_at[at]
        out = self.byte_sizes[at] == sizes
        mine, theirs, done = octets(data), octets(self.bytes), 0
        live = np.flatnonzero(out & (sizes <= LONG))
        while len(live):
            part = LOW_BYTES[np.minimum(sizes[live] - done, 8)]
            out[live] &= (mine[starts[live] + done] & part) == (theirs[kept[live] + done] & part)
            done += 8
            live = live[sizes[live] > done]
        for i in np.flatnonzero(out & (sizes > LONG)).tolist():
            out[i] = np.array_equal(data[starts[i] : ends[i]], self.bytes[kept[i] : kept[i] + sizes[i]])
        return out

    def _gather(self, at: np.ndarray, more: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of entries end to end; numbers past the last entry stand for ``more``."""
        where, all_sizes, ids = self.where, self.sizes, self.ids
        if more:
            extra = np.fromiter(map(len, more), np.int32, len(more))
            where, all_sizes = np.concatenate([where, len(ids) + np.cumsum(extra) - extra]), np.concatenate([all_sizes, extra])
            ids = np.concatenate([ids, np.fromiter(chain.from_iterable(more), np.uint16, int(extra.sum()))])
        sizes = all_sizes[at].astype(np.int64)
        stop = np.cumsum(sizes)
        index = np.repeat(where[at] - stop + sizes, sizes) + np.arange(stop[-1] if len(stop) else 0)
        return ids[index], sizes


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _tokenized(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """A row for each document: full windows' checksums, the rest's ids, ranks within the part."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    code = encoder(path)
    ranks = np.zeros(window, np.int64)
    full_before = 0
    for batch in batches:
        for rows, _, _ in chunks(batch, "text", 1 << 20):
            texts = pc.fill_null(rows.column(1).cast(pa.large_string()), "").to_pylist()
            ids, offsets = code.encode(texts)
            out: dict[str, list] = {k: [] for k in ("tokens", "full_rank", "full_crc", "rest", "rest_rank", "rest_ids")}
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                doc = np.append(ids[a:b], np.uint16(end_id)).astype("<u4")
                n = len(doc)
                full, rest = divmod(n, window)
                raw = doc.tobytes()
                out["tokens"].append(n)
                out["full_rank"].append(full_before)
                out["full_crc"].append([zlib.crc32(raw[4 * window * i : 4 * window * (i + 1)]) for i in range(full)])
                full_before += full
                out["rest"].append(rest)
                out["rest_rank"].append(int(ranks[rest]))
                ranks[rest] += 1
                out["rest_ids"].append(doc[full * window :].astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([part] * rows.num_rows, pa.int32()), *(pa.array(out[k], t) for k, t in (("tokens", pa.int64()), ("full_rank", pa.int64()), ("full_crc", pa.list_(pa.int64())), ("rest", pa.int32()), ("rest_rank", pa.int64()), ("rest_ids", pa.binary())))],
                names=["doc_id", "part", *out],
            )


TOKENIZED = "doc_id long, part int, tokens long, full_rank long, full_crc array<long>, rest int, rest_rank long, rest_ids binary"


def tokenize(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: _tokenized(it, path, window, end_id), TOKENIZED)


def combinations(lengths: np.ndarray, window: int = WINDOW, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Multisets of at most ``depth`` of the lengths whose sum is the window, in order.

    Pairs are all listed; of triples, those whose largest piece is paired with a split of the gap
    near its third points, its middle and its ends, so that their number stays near the number of
    lengths.
    """
    have = set(lengths.tolist())
    out = {(a, window - a) for a in have if 2 * a >= window and window - a in have}
    if depth >= 3:
        for a in have:
            gap = window - a
            for b in {gap // 2, gap // 3, gap // 4, gap // 5, gap // 8, 2 * gap // 5, 3 * gap // 7}:
                for b in (b, b + 1):
                    if b in have and gap - b in have and b > 0:
                        out.add(tuple(sorted((a, b, gap - b), reverse=True)))
    return sorted(out)


def fit_counts(histogram: np.ndarray, combos: list[tuple[int, ...]], rounds: int = 400) -> np.ndarray:
    """Repeat counts: non-negative least squares of the combinations against the histogram.

    Cyclic coordinate descent on ||A x - h||^2 with x >= 0; A is sparse (a few entries a column).
    Rounded down, then lowered where a bin would be overdrawn.
    """
    if not combos:
        return np.zeros(0, np.int64)
    columns = [np.unique(c, return_counts=True) for c in combos]
    x, left = np.zeros(len(combos)), histogram.astype(float).copy()
    norms = [float((n * n).sum()) for _, n in columns]
    scale = max(1.0, left.max())
    for _ in range(rounds):
        moved = 0.0
        for j, (bins, n) in enumerate(columns):
            step = max(-x[j], float((n * left[bins]).sum()) / norms[j])
            if step:
                x[j] += step
                left[bins] -= n * step
                moved = max(moved, abs(step))
        if moved < 1e-3 * scale:
            break
    counts = np.floor(x + 1e-9).astype(np.int64)
    free = histogram.astype(np.int64).copy()
    for j in np.argsort(-counts, kind="stable"):
        bins, n = columns[j]
        counts[j] = min(counts[j], int((free[bins] // n).min()))
        free[bins] -= counts[j] * n
    # greedy top-up with what the rounding left
    for j, (bins, n) in enumerate(columns):
        more = int((free[bins] // n).min())
        if more > 0:
            counts[j] += more
            free[bins] -= more * n
    return counts


def plan(histogram: np.ndarray, window: int = WINDOW) -> tuple[dict[int, list[tuple[int, int, int, int]]], dict[int, tuple[int, int]], int, int]:
    """From rests by length to places.

    Returns by length the runs (first rank, end rank, first sequence, offset) of combinations, by
    length (first rank left over, its position on the line of leftovers), the number of
    sequences before that line, and the number of all sequences.
    """
    lengths = np.flatnonzero(histogram[1:]) + 1
    combos = combinations(lengths, window)
    counts = fit_counts(histogram, combos)
    used = np.zeros(window + 1, np.int64)
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for combo, count in zip(combos, counts.tolist(), strict=True):
        if count:
            offset = 0
            for length in combo:
                runs.setdefault(length, []).append((int(used[length]), int(used[length]) + count, sequence, offset))
                used[length] += count
                offset += length
            sequence += count
    line, left, position = sequence, {}, 0
    for length in lengths[::-1].tolist():
        rest = int(histogram[length] - used[length])
        if rest:
            left[length] = (int(used[length]), position)
            position += rest * length
    return runs, left, line, line + -(-position // window)


def stride(n: int) -> int:
    """A step coprime to n, near its golden section: k * stride(n) % n permutes 0..n-1."""
    step = max(1, round(n * 0.6180339887498949))
    while math.gcd(step, n) != 1:
        step += 1
    return step


def _placed(batches: Iterator[pa.RecordBatch], planned: tuple, window: int, sequences: int) -> Iterator[pa.RecordBatch]:
    runs, left, line, total = planned
    step = stride(sequences) if sequences else 1
    starts = {k: np.array([r[0] for r in v]) for k, v in runs.items()}
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for batch in batches:
        out: list[list] = [[] for _ in names]

        def put(*row: int) -> None:
            for column, value in zip(out, row, strict=True):
                column.append(value)

        for doc, tokens, full_rank, crcs, rest, rank, raw, full_base, rest_base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for i, crc in enumerate(crcs):
                put(doc, i * window, window, crc, tokens, total + full_base + full_rank + i, 0)
            if not rest:
                continue
            begin, rank = len(crcs) * window, rank + rest_base
            ids = np.frombuffer(raw, "<u2").astype("<u4")
            if rest in left and rank >= left[rest][0]:
                position = left[rest][1] + (rank - left[rest][0]) * rest
                cut = min(rest, window - position % window)
                put(doc, begin, cut, zlib.crc32(ids[:cut].tobytes()), tokens, line + position // window, position % window)
                if cut < rest:
                    put(doc, begin + cut, rest - cut, zlib.crc32(ids[cut:].tobytes()), tokens, line + position // window + 1, 0)
            else:
                lo, _, sequence, offset = runs[rest][int(np.searchsorted(starts[rest], rank, "right")) - 1]
                put(doc, begin, rest, zlib.crc32(ids.tobytes()), tokens, sequence + rank - lo, offset)
        out[5] = [k * step % sequences for k in out[5]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece of
    every row of ``docs`` (doc_id, text)."""
    path = path or default_tokenizer()
    rows = spool(tokenize(docs, path, window, end_id), "tokens")
    full = rows.groupBy("part").agg(F.sum(F.size("full_crc")).cast("long").alias("n")).select("part", F.lit(0).alias("rest"), "n")
    rests = rows.where("rest > 0").groupBy("part", "rest").agg(F.count("*").alias("n"))
    counts = spool(full.union(rests), "counts")
    # ranks continue from part to part: full windows are dealt like rests of length 0
    from pyspark.sql import Window

    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = np.zeros(window + 1, np.int64)
    windows = 0
    for rest, n in counts.groupBy("rest").agg(F.sum("n")).collect():  # at most one row for each length
        if rest:
            histogram[rest] = n
        else:
            windows = n
    planned = plan(histogram, window)
    sequences = planned[3] + windows
    fulls = bases.where("rest = 0").select("part", F.col("base").alias("full_base"))
    placed = rows.join(fulls, "part").join(bases.select("part", "rest", F.col("base").alias("rest_base")), ["part", "rest"], "left")
    placed = placed.select("doc_id", "tokens", "full_rank", "full_crc", "rest", "rest_rank", "rest_ids", "full_base", F.coalesce("rest_base", F.lit(0)).alias("rest_base"))
    return placed.mapInArrow(lambda it: _placed(it, planned, window, sequences), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
