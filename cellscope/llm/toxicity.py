"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Kernel: gapped subsequences of three letters, weighted by DECAY ** span (span at most SPAN),
divided by the root of the squared weights of a string's own triples. Letters are folded (case,
accents, look-alikes such as 0 and @); other alphabets have classes of their own, an ideograph or
syllable is spelt as three of them; everything else is a gap that lengthens spans, so
``i-d!i.o.t`` stays near ``idiot``. Runs of single-letter words are read as one word; each
ideograph is a word.

A sentence is read as its spans: words and pairs of neighbouring words, the white space between
them a gap that subsequences cross. So both a word and a phrase of harmless words can be abuse,
and a word cut in two is still seen. A sentence scores as its worst span, a text as its worst
sentence; a logistic curve fitted on the training texts turns that into 0 to 1.

Training is on labelled sentences in the manner of multiple instances: a clean document's
sentences, and so all their spans, are clean; a toxic one has a toxic sentence, whose witnesses
are spans that toxic documents hold more often than chance explains. Landmarks are spans; features
are K(spans, landmarks) K(landmarks)^-1/2; a linear machine is fitted on them by dual coordinate
descent, then again with the clean spans that it got worst. As the kernel is an inner product over
letter triples, the machine folds into one weight per triple, and scoring needs no landmark.

Bounds of the fit: MAX_TOXIC + MAX_CLEAN labelled documents by hash order, of at most MAX_CHARS
characters each; LANDMARKS landmarks; of clean spans the USUAL most frequent, and the HARD nearest to
the positives, then the WORST by score, serve as negatives. All significant spans are positives
and words enter whole. Scoring reads every text whole.

Defined results: null, empty and wordless texts score as clean (0); without toxic or clean labels
every score is 0; repeated rows score alike; conflicting labels of one id count as toxic; null
ids are scored and never trained on; other columns, of any name, are kept where rows are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellscope.llm.near_dedup import WORDS, _sets, band_keys, super_minhash
from cellscope.llm.packing import HashIndex
from cellscope.llm.shared import column, ship, unused
from cellscope.llm.textarrays import chunks, span_hashes, word_spans

MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1500, 3000, 20_000
LANDMARKS, USUAL, HARD, WORST = 256, 600, 1200, 800
DECAY, SPAN = 0.6, 7
COST = 20.0
#: How fast a text that has witnesses stops asking for more.
DISCOUNT = 0.3
#: A longer word is read in windows of this many letters, half overlapping.
WIDTH = 24
#: Letters of a word that a triple crossing into its neighbour can hold.
REACH = SPAN - 2
#: Classes: 0 gap, 1-26 Latin letters, the others for the letters of all other scripts.
LETTERS = 64
_OTHER = LETTERS - 27

# Look-alikes of letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: Code points from _WIDE on are spelt in three classes (but for the private ones, which name classes).
_WIDE, _PRIVATE = 0x3000, 0xE000


def _letter_table() -> np.ndarray:
    """Classes of the code points below _WIDE."""
    import unicodedata

    out = np.zeros(_WIDE, np.uint8)
    for i in range(len(out)):
        c = LOOKALIKES.get(chr(i), chr(i))
        if c == "ß":
            c = "s"
        base = unicodedata.normalize("NFD", c)[0].lower()
        if "a" <= base <= "z":
            out[i] = ord(base) - 96
        elif base.isalpha():
            out[i] = 27 + ord(base) % _OTHER
    return out


_LETTER = _letter_table()


def spelt(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(classes of all words end to end, offsets by word)."""
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    codes = _LETTER[np.minimum(points, _WIDE - 1)]
    if not len(points) or points.max() < _WIDE:
        return codes, np.concatenate([[0], np.cumsum(sizes)])
    wide = points >= _WIDE
    named = wide & (points >= _PRIVATE) & (points < _PRIVATE + LETTERS)
    mark = wide & ((points < 0x3040) | ((points >= 0xFE30) & (points < 0xFE70)) | ((points >= 0xFFF0) & (points < 0x10000)) | ((points >= 0x1F000) & (points < 0x20000)))
    full = (points >= 0xFF01) & (points <= 0xFF5E)  # full-width forms of ASCII
    codes[named] = points[named] - _PRIVATE
    codes[mark] = 0
    codes[full] = _LETTER[points[full] - 0xFEE0]
    three = wide & ~named & ~mark & ~full
    times = np.where(three, 3, 1)
    at = np.repeat(np.arange(len(points)), times)
    digit = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    number = points.astype(np.int64)[at] * 7919 % _OTHER**3
    out = np.where(three[at], 27 + number // np.array([1, _OTHER, _OTHER**2])[digit] % _OTHER, codes[at]).astype(np.uint8)
    ends = np.concatenate([[0], np.cumsum(times)])[np.cumsum(sizes)]
    return out, np.concatenate([[0], ends])


def letters(words: list[str]) -> np.ndarray:
    """Words as rows of letter classes, padded with gaps."""
    codes, offsets = spelt(words)
    return _rows(codes, offsets[:-1], offsets[1:])


def _rows(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    out = np.zeros((len(starts), max(1, int(sizes.max(initial=1)))), np.uint8)
    inside = np.arange(out.shape[1]) < sizes[:, None]
    out[inside] = codes[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
    return out


def _triples(width: int, span: int = SPAN) -> Iterator[tuple[int, int, int]]:
    for i in range(width):
        for j in range(i + 1, min(width, i + span - 1)):
            for k in range(j + 1, min(width, i + span)):
                yield i, j, k


#: Triples that lie in both of two words, REACH letters each side of a gap.
CROSSING = [t for t in _triples(2 * REACH + 1) if t[0] < REACH < t[2] and t[1] != REACH]


def squares_of(rows: np.ndarray, triples: list | None = None) -> np.ndarray:
    """Squared weights of each row's triples; their root is what its features are divided by."""
    out = np.zeros(len(rows), np.float32)
    whole = rows > 0
    for i, j, k in triples or _triples(rows.shape[1]):
        out += (whole[:, i] & whole[:, j] & whole[:, k]) * np.float32(DECAY ** (2 * (k - i + 1)))
    return out


def project(rows: np.ndarray, weights: np.ndarray, triples: list | None = None) -> np.ndarray:
    """Inner products of the rows' unnormalised features with triple weights."""
    out = np.zeros(len(rows), np.float32)
    wide = rows.astype(np.int32)
    high, low = wide * LETTERS * LETTERS, wide * LETTERS
    for i, j, k in triples or _triples(rows.shape[1]):
        # class 0 has weight 0 in every triple
        out += np.float32(DECAY ** (k - i + 1)) * weights[high[:, i] + low[:, j] + wide[:, k]]
    return out


class Landmarks:
    """Normalised features of the landmarks, by the triples that they hold."""

    def __init__(self, spans: list[str]) -> None:
        rows = letters(spans).astype(np.int32)
        size = np.sqrt(squares_of(rows))
        found, owner, value = [], [], []
        for i, j, k in _triples(rows.shape[1]):
            at = np.flatnonzero((rows[:, i] > 0) & (rows[:, j] > 0) & (rows[:, k] > 0))
            found.append((rows[at, i] * LETTERS + rows[at, j]) * LETTERS + rows[at, k])
            owner.append(at)
            value.append(DECAY ** (k - i + 1) / size[at])
        self.triples, column = np.unique(np.concatenate(found), return_inverse=True)
        self.table = np.zeros((len(self.triples) + 1, len(spans)), np.float32)  # the last row is for other triples
        np.add.at(self.table, (column, np.concatenate(owner)), np.concatenate(value).astype(np.float32))
        self.at = np.full(LETTERS**3, len(self.triples), np.int32)
        self.at[self.triples] = np.arange(len(self.triples))

    def kernel(self, spans: list[str]) -> np.ndarray:
        """K(spans, landmarks)."""
        out = np.zeros((len(spans), self.table.shape[1]), np.float32)
        order = sorted(range(len(spans)), key=lambda i: len(spans[i]))
        for lo in range(0, len(order), 256):
            part = order[lo : lo + 256]
            rows = letters([spans[i] for i in part]).astype(np.int32)
            size = np.sqrt(squares_of(rows))
            sums = np.zeros((len(part), out.shape[1]), np.float32)
            for i, j, k in _triples(rows.shape[1]):
                sums += np.float32(DECAY ** (k - i + 1)) * self.table[self.at[(rows[:, i] * LETTERS + rows[:, j]) * LETTERS + rows[:, k]]]
            out[part] = sums / np.where(size > 0, size, 1)[:, None]
        return out

    def folded(self, coefficients: np.ndarray) -> np.ndarray:
        """One weight per triple for a combination of landmarks."""
        out = np.zeros(LETTERS**3, np.float32)
        out[self.triples] = self.table[:-1] @ coefficients.astype(np.float32)
        return out


@dataclass
class Parts:
    """What is known of each word: the margin of its worst window, sums and squares of its last
    and first window, and the letters at its end and beginning."""

    margin: np.ndarray
    tail: np.ndarray
    tail_squares: np.ndarray
    head: np.ndarray
    head_squares: np.ndarray
    end: np.ndarray
    start: np.ndarray

    FIELDS = ("margin", "tail", "tail_squares", "head", "head_squares", "end", "start")

    @classmethod
    def none(cls) -> Parts:
        return cls(np.zeros(0), *(np.zeros(0, np.float32) for _ in range(4)), *(np.zeros((0, REACH), np.uint8) for _ in range(2)))

    def plus(self, more: Parts) -> Parts:
        return Parts(*(np.concatenate([getattr(self, f), getattr(more, f)]) for f in self.FIELDS))


@dataclass
class Model:
    """Weights of triples, the offset of the machine, and the logistic curve; None: no labels."""

    weights: np.ndarray | None
    offset: float = 0.0
    slope: float = 1.0
    middle: float = 0.0

    def parts(self, words: list[str]) -> Parts:
        n = len(words)
        codes, offsets = spelt(words)
        starts, ends = offsets[:-1], offsets[1:]
        sizes = ends - starts
        # windows of each word: the whole, or WIDTH letters every half WIDTH, the last one at its end
        steps = np.where(sizes > WIDTH, -(-(sizes - WIDTH) // (WIDTH // 2)) + 1, 1)
        owner = np.repeat(np.arange(n), steps)
        first = np.cumsum(steps) - steps
        lo = starts[owner] + (np.arange(len(owner)) - first[owner]) * (WIDTH // 2)
        lo = np.minimum(lo, np.maximum(ends[owner] - WIDTH, starts[owner]))
        hi = np.minimum(lo + WIDTH, ends[owner])
        total, squares = np.zeros(len(owner), np.float32), np.zeros(len(owner), np.float32)
        edges = [0, 4, 6, 8, 10, 12, 16, 20, WIDTH]
        for low, high in zip(edges[:-1], edges[1:], strict=True):  # by width, so that short words cost little
            pick = np.flatnonzero((hi - lo > low) & (hi - lo <= high))
            for a in range(0, len(pick), 65536):
                part = pick[a : a + 65536]
                rows = _rows(codes, lo[part], hi[part])
                total[part], squares[part] = project(rows, self.weights), squares_of(rows)
        margin = np.full(n, -np.inf)
        np.maximum.at(margin, owner, _ratio(total, squares) + self.offset)
        last = first + steps - 1
        padded = np.concatenate([np.zeros(REACH, np.uint8), codes, np.zeros(REACH, np.uint8)])
        place = np.arange(REACH)
        end = np.where(place >= REACH - sizes[:, None], padded[ends[:, None] + place], 0)
        start = np.where(place < sizes[:, None], padded[starts[:, None] + REACH + place], 0)
        return Parts(margin, total[last], squares[last], total[first], squares[first], end.astype(np.uint8), start.astype(np.uint8))

    def pair_margins(self, parts: Parts, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Margins of the spans that words ``one`` and ``two`` (numbers in ``parts``) make, from the
        words' own sums and the triples that cross the gap between them."""
        out = np.empty(len(one))
        for lo in range(0, len(one), 65536):
            a, b = one[lo : lo + 65536], two[lo : lo + 65536]
            rows = np.zeros((len(a), 2 * REACH + 1), np.uint8)
            rows[:, :REACH], rows[:, REACH + 1 :] = parts.end[a], parts.start[b]
            total = parts.tail[a] + parts.head[b] + project(rows, self.weights, CROSSING)
            squares = parts.tail_squares[a] + parts.head_squares[b] + squares_of(rows, CROSSING)
            out[lo : lo + 65536] = _ratio(total, squares) + self.offset
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(margin), 1 / (1 + np.exp(-np.clip(self.slope * (margin - self.middle), -500, 500))), 0.0)


def _ratio(total: np.ndarray, squares: np.ndarray) -> np.ndarray:
    return np.where(squares > 0, total / np.sqrt(np.where(squares > 0, squares, 1)), 0)


_WORD = re.compile(r"[\u3000-\u9fff]|[^\x20\x09-\x0d\u3000-\u9fff]+")
_SPELT = re.compile(r"(?<![^\x20\x09-\x0d])(?:[^\x20\x09-\x0d\u3000-\u9fff][\x20\x09-\x0d]){2,}[^\x20\x09-\x0d\u3000-\u9fff](?![^\x20\x09-\x0d])")
_END = re.compile(r"(?<=[.!?|])[\x20\x09-\x0d]+|\n")


def sentences(text: str) -> list[list[str]]:
    """Words by sentence; spelt-out runs of single characters are one word."""
    text = _SPELT.sub(lambda m: re.sub(r"[\x20\x09-\x0d]", "", m[0]), text)
    return [w for w in (_WORD.findall(s) for s in _END.split(text)) if w]


_CLASS = np.array([""] + [chr(96 + k) for k in range(1, 27)] + [chr(_PRIVATE + k) for k in range(27, LETTERS)])


def folded(words: list[str]) -> list[str]:
    """The letters of words, a character for each class, gaps dropped."""
    codes, offsets = spelt(words)
    kept = np.concatenate([[0], np.cumsum(codes > 0)])
    flat = "".join(_CLASS[codes[codes > 0]].tolist())
    return [flat[a:b] for a, b in zip(kept[offsets[:-1]].tolist(), kept[offsets[1:]].tolist(), strict=True)]


def _surprise(a: float, n: int, b: float, m: int) -> float:
    """Twice the log-likelihood ratio of a in n and b in m texts against one common share."""

    def part(k: float, of: int, share: float) -> float:
        return (k * np.log(share) if k else 0.0) + ((of - k) * np.log1p(-share) if of > k else 0.0)

    return float(2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, (a + b) / (n + m)) - part(b, m, (a + b) / (n + m))))


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 120) -> np.ndarray:
    """Linear L2-loss machine by dual coordinate descent; the last column of x is constant."""
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    diagonal = (x * x).sum(axis=1) + 0.5 / cost
    order = np.random.Generator(np.random.PCG64(3))
    for _ in range(rounds):
        # rows beyond the margin that carry no weight would not move
        active = np.flatnonzero((alpha > 0) | (y * (x @ w) < 1))
        for i in order.permutation(active):
            step = max(-alpha[i], (1 - y[i] * (x[i] @ w) - alpha[i] * 0.5 / cost[i]) / diagonal[i])
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
    return w


def _one_of_near_copies(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The rows without those that share a band of signatures and three quarters of the shingles
    with an earlier row of the same label (a bounded sample, in memory)."""
    coded = [t.encode() for t, _ in rows]
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
    leaders: dict[tuple[int, int], int] = {}
    sets: dict[int, np.ndarray] = {}
    out = []
    for lo in range(0, len(rows), 256):
        part = coded[lo : lo + 256]
        found = _sets(np.frombuffer(b"".join(part), np.uint8), offsets[lo : lo + len(part) + 1] - offsets[lo], WORDS)
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in found])])
        keys = band_keys(super_minhash(np.concatenate(found) if found else np.zeros(0, np.uint64), bounds)).tolist()
        for i, (own, bands) in enumerate(zip(found, keys, strict=True)):
            y = rows[lo + i][1]
            near = {leaders[y, k] for k in bands if (y, k) in leaders} if len(own) else set()
            if any(4 * len(np.intersect1d(sets[j], own, assume_unique=True)) >= 3 * len(np.union1d(sets[j], own)) for j in near):
                continue
            sets[lo + i] = own
            for k in bands:
                leaders.setdefault((y, k), lo + i)
            out.append(rows[lo + i])
    return out


class _Spans:
    """Training texts as numbers of words (folded) and of pairs of them, with the texts they are in."""

    def __init__(self, texts: list[str], toxic: np.ndarray) -> None:
        number: dict[str, int] = {}
        split = [[[number.setdefault(w, len(number)) for w in s] for s in sentences(t)] for t in texts]
        names = folded(list(number))
        place = {w: i for i, w in enumerate(dict.fromkeys(names))}
        move = np.array([place[w] for w in names], np.int64)
        self.words = list(place)
        self.texts = [[move[s] for s in ss] for ss in split]
        n = max(1, len(self.words))
        has = np.array([len(w) > 0 for w in self.words], bool)

        def pairs(ss: list[np.ndarray]) -> np.ndarray:
            two = [s[:-1] * n + s[1:] for s in ss if len(s) > 1]
            found = np.concatenate(two) if two else np.zeros(0, np.int64)
            return found[has[found // n] & has[found % n]]

        per_word = [np.unique(np.concatenate(ss)) if ss else np.zeros(0, np.int64) for ss in self.texts]
        per_pair = [np.unique(pairs(ss)) for ss in self.texts]
        every = np.concatenate([np.zeros(0, np.int64), *per_pair])
        self.pairs, number_of = np.unique(every, return_inverse=True)
        cuts = np.cumsum([0, *map(len, per_pair)])
        self.text_pairs = [number_of[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.text_words = per_word
        self.word_in = [self._counts(per_word, toxic == k, n) for k in (0, 1)]
        self.pair_in = [self._counts(self.text_pairs, toxic == k, len(self.pairs)) for k in (0, 1)]
        self.first, self.second = self.pairs // n, self.pairs % n

    @staticmethod
    def _counts(per: list[np.ndarray], chosen: np.ndarray, n: int) -> np.ndarray:
        some = [p for p, c in zip(per, chosen, strict=True) if c]
        return np.bincount(np.concatenate([np.zeros(0, np.int64), *some]), minlength=n)

    def pair(self, i: int) -> str:
        return f"{self.words[self.first[i]][-WIDTH:]} {self.words[self.second[i]][:WIDTH]}"


def train(rows: list[tuple[str, int]], landmarks: int = LANDMARKS, rounds: int = 2) -> Model:
    """From (text, toxic) rows; the same model whatever their order. Equal texts and near copies
    of one label count once."""
    worst_of = Counter()
    for text, y in rows:
        worst_of[text] = max(worst_of[text], int(y > 0))
    rows = _one_of_near_copies(sorted(worst_of.items(), key=lambda r: (r[1], r[0])))
    toxic = np.array([y for _, y in rows], bool)
    if not len(rows) or toxic.all() or not toxic.any():
        return Model(None)
    spans = _Spans([t for t, _ in rows], toxic)
    n = [max(1, int((~toxic).sum())), max(1, int(toxic.sum()))]

    def significant(counts: list[np.ndarray], usable: np.ndarray, least: float) -> dict[int, float]:
        """Spans that are in toxic texts more often than chance explains among so many spans."""
        odds = np.log((counts[1] + 0.1) / n[1]) - np.log((counts[0] + 0.5) / n[0])
        some = np.flatnonzero(usable & (counts[1] >= 2) & (odds > 1))
        gain = {int(i): _surprise(int(counts[1][i]), n[1], int(counts[0][i]), n[0]) for i in some}
        return {i: g for i, g in gain.items() if g > least}

    letters_in = np.array([len(w) for w in spans.words])
    bad = significant(spans.word_in, letters_in >= 3, 2 * np.log(max(2, len(spans.words))) + 4)
    in_bad = np.isin(np.arange(len(spans.words)), list(bad))
    pair_size = letters_in[spans.first] + letters_in[spans.second]
    bad_pairs = significant(spans.pair_in, pair_size >= 3, 2 * np.log(max(2, len(spans.pairs))) + 4)
    # a pair must say more than its words
    bad_pairs = {i: g for i, g in bad_pairs.items() if g > max(bad.get(int(spans.first[i]), 0.0), bad.get(int(spans.second[i]), 0.0))}
    bad, bad_pairs = _witnesses(spans, toxic, bad, bad_pairs, n)
    named = lambda i: (spans.words[i], i)
    in_clean = {p for i in np.flatnonzero((spans.word_in[0] > 0) & (letters_in > WIDTH)) for p in _windows(spans.words[i])}
    # a long word is bad by windows that clean ones do not have
    worst = sorted(bad, key=lambda i: (-bad[i], *named(i)))
    positives = list(dict.fromkeys(p for i in worst for p in _windows(spans.words[i]) if letters_in[i] <= WIDTH or p not in in_clean))
    phrases = sorted(bad_pairs, key=lambda i: (-bad_pairs[i], spans.pair(i)))
    if not positives and not phrases:
        odd = np.flatnonzero((letters_in >= 3) & (spans.word_in[1] > 0))
        if not len(odd):
            return Model(None)
        # nothing stands out: the likeliest word, which the curve will weigh by what it is worth
        positives = [spans.words[min(odd, key=lambda i: (spans.word_in[0][i] - spans.word_in[1][i], spans.words[i]))]]
    said = [spans.pair(i) for i in phrases]
    is_bad = set(positives) | set(said)
    clean = [spans.words[i] for i in sorted(np.flatnonzero(spans.word_in[0] > 0), key=lambda i: (-spans.word_in[0][i], spans.words[i])) if letters_in[i] >= 3 and spans.words[i] not in is_bad]
    pieces = list(dict.fromkeys(p for w in clean for p in _windows(w)))
    usual = pieces[:USUAL]
    # clean spans nearest to the bad ones are the hardest: by letters, and pairs that share a word
    marks = Landmarks([*positives, *said][: landmarks // 2])
    near = Model(marks.folded(np.ones(marks.table.shape[1]))).parts(pieces).margin
    hard = [pieces[i] for i in np.lexsort((np.arange(len(pieces)), -near))[:HARD]]
    halves = [w for i in phrases for w in (spans.words[spans.first[i]], spans.words[spans.second[i]]) if w not in is_bad]
    hard_pairs = _sharing(spans, phrases, HARD)
    clean_pairs = np.flatnonzero(spans.pair_in[0] > 0)
    often = [spans.pair(i) for i in sorted(clean_pairs, key=lambda i: (-spans.pair_in[0][i], spans.pairs[i]))[: USUAL // 2]]
    negatives = list(dict.fromkeys([*halves, *hard, *usual, *hard_pairs, *often]))
    # the kernel sees inserted characters as gaps: let it learn where such words lie
    spaced = [" ".join(w)[:WIDTH] for w in [*usual, *hard[:300], "abcdefghijkl", "lmnopqrstuv"] if w not in is_bad]
    negatives = [w for w in dict.fromkeys([*negatives, *spaced]) if w not in is_bad]
    gapped = [g for w in positives for g in (" ".join(w)[:WIDTH], w[: len(w) // 2] + " " + w[len(w) // 2 :])]
    wanted = list(dict.fromkeys([*positives, *said, *gapped]))
    some = list(dict.fromkeys([*said[: landmarks // 4], *positives[: landmarks // 3], *halves[: landmarks // 8], *hard_pairs[: landmarks // 8]]))
    room = (landmarks - len(some)) // 2
    marks = Landmarks(list(dict.fromkeys([*some, *hard[:room], *usual[:room]])))
    value, vector = _spectrum(marks)
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    held = {p: float(spans.word_in[1][i]) for i in bad for p in _windows(spans.words[i])} | {spans.pair(i): float(spans.pair_in[1][i]) for i in phrases}
    known: dict[str, np.ndarray] = {}

    def nystroem(some: list[str]) -> np.ndarray:
        fresh = [w for w in some if w not in known]
        known.update(zip(fresh, marks.kernel(fresh) @ root, strict=True))
        return np.column_stack([np.array([known[w] for w in some]), np.ones(len(some))])

    model = Model(None)
    for _ in range(rounds):
        x = nystroem(wanted + negatives)
        y = np.array([1.0] * len(wanted) + [-1.0] * len(negatives))
        # a span stands for the texts that hold it
        cost = COST * np.where(y > 0, max(1.0, len(negatives) / len(wanted)) ** 0.5, 1.0) * np.array([held.get(v, 1.0) for v in wanted + negatives]) ** 0.5
        w = _svm(x, y, cost)
        model = Model(marks.folded(root @ w[:-1]), float(w[-1]))
        parts = model.parts(spans.words)
        pair_score = model.pair_margins(parts, spans.first, spans.second)
        score = np.where(letters_in >= 1, parts.margin, -np.inf)
        found = [(float(score[i]), spans.words[i]) for i in np.flatnonzero((spans.word_in[0] > 0) & ~in_bad & (score > -0.9))]
        held |= {spans.words[i]: float(spans.word_in[0][i]) for i in np.flatnonzero((spans.word_in[0] > 1) & ~in_bad)}
        found = [(s, p) for s, w in found for p in _windows(w)]
        # a pair that is no worse than its words says nothing that they do not
        some = np.flatnonzero((spans.pair_in[0] > 0) & (pair_score > np.maximum(-0.9, np.maximum(score[spans.first], score[spans.second]))) & ~in_bad[spans.first] & ~in_bad[spans.second])
        found += [(float(pair_score[i]), spans.pair(i)) for i in some[np.argsort(-pair_score[some], kind="stable")[:WORST]]]
        held |= {spans.pair(i): float(spans.pair_in[0][i]) for i in some[np.argsort(-pair_score[some], kind="stable")[:WORST]]}
        more = [v for _, v in sorted(found, key=lambda t: (-t[0], t[1]))[:WORST]]
        negatives = [v for v in dict.fromkeys([*negatives, *more]) if v not in is_bad]
    # the logistic curve on whole texts
    margin = np.array([max(score[a].max(initial=-2.0), pair_score[b].max(initial=-2.0)) for a, b in zip(spans.text_words, spans.text_pairs, strict=True)])
    model.slope, model.middle = _logistic(margin, toxic)
    return model


def _witnesses(spans: _Spans, toxic: np.ndarray, bad: dict[int, float], bad_pairs: dict[int, float], n: list[int]) -> tuple[dict[int, float], dict[int, float]]:
    """Of the significant words and pairs those that explain the toxic texts.

    The most significant is taken first; each text counts for less the more of the taken ones it
    holds, and it ends when none is significant any more. So a word that only goes along with the
    real ones, as in copies of one toxic text, is not a witness."""
    words, pairs = sorted(bad, key=lambda i: spans.words[i]), sorted(bad_pairs, key=lambda i: spans.pairs[i])
    if not words and not pairs:
        return {}, {}
    at = np.flatnonzero(toxic)
    has = np.zeros((len(at), len(words) + len(pairs)), np.float32)
    for row, t in enumerate(at):
        has[row, : len(words)] = np.isin(words, spans.text_words[t])
        has[row, len(words) :] = np.isin(pairs, spans.text_pairs[t])
    clean = np.concatenate([spans.word_in[0][words], spans.pair_in[0][pairs]])
    least = np.repeat([2 * np.log(max(2, len(spans.words))) + 4, 2 * np.log(max(2, len(spans.pairs))) + 4], [len(words), len(pairs)])
    place = {w: k for k, w in enumerate(words)}
    taken, times, out = np.zeros(has.shape[1], bool), np.zeros(len(at)), [{}, {}]
    while True:
        held = (1 / (1 + DISCOUNT * times)) @ has
        gain = np.where(taken, -np.inf, [_surprise(float(a), n[1], float(b), n[0]) if a / n[1] > b / n[0] else 0.0 for a, b in zip(held, clean, strict=True)]) - least
        best = int(np.argmax(gain))
        if gain[best] <= 0:
            return out[0], out[1]
        taken[best] = True
        times += has[:, best]
        if best < len(words):
            out[0][words[best]] = float(gain[best] + least[best])
        else:
            pair = pairs[best - len(words)]
            out[1][pair] = float(gain[best] + least[best])
            for word in {int(spans.first[pair]), int(spans.second[pair])} & place.keys():
                has[has[:, best] > 0, place[word]] = 0  # there the pair explains its words


def _windows(word: str) -> list[str]:
    return [word] if len(word) <= WIDTH else [word[max(0, min(k, len(word) - WIDTH)) :][:WIDTH] for k in range(0, len(word) - WIDTH // 2, WIDTH // 2)]


def _spectrum(marks: Landmarks) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of K(landmarks)."""
    table = marks.table[:-1].astype(np.float64)
    return np.linalg.eigh(table.T @ table)


def _sharing(spans: _Spans, phrases: list[int], most: int) -> list[str]:
    """Clean pairs that share a word with a bad one, the most frequent first, some for each."""
    out: list[str] = []
    if phrases:
        clean = np.flatnonzero((spans.pair_in[0] > 0) & ~np.isin(np.arange(len(spans.pairs)), phrases))
        by = {k: clean[np.isin(v[clean], v[phrases])] for k, v in (("first", spans.first), ("second", spans.second))}
        each = max(1, most // (2 * len(phrases)))
        for i in phrases:
            for k, v in (("first", spans.first), ("second", spans.second)):
                own = by[k][v[by[k]] == v[i]]
                out += [spans.pair(j) for j in own[np.lexsort((spans.pairs[own], -spans.pair_in[0][own]))[:each]]]
    return out


def _logistic(margin: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and middle by Newton steps on smoothed targets."""
    y = np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    weight = np.full(len(toxic), 1 / len(toxic))
    centre = margin.mean()
    x = np.column_stack([margin - centre, np.ones(len(margin))])
    b = np.zeros(2)

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(weight @ (np.logaddexp(0, z) - y * z) + 5e-7 * b @ b)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step, now, size = np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-6 * b), loss(b), 1.0
        while size > 1e-6 and loss(b + size * step) > now:
            size /= 2
        b += size * step
        if np.abs(size * step).max() < 1e-9:
            break
    if b[0] <= 1e-3:  # margins say nothing: every text has the share of toxic ones
        share = float(y.mean())
        return 1e-3, float(np.log((1 - share) / share) / 1e-3)
    return float(b[0]), float(centre - b[1] / b[0])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """The bounded sample: labelled rows outside the held-out fold, by hash order within a class."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.where(~held_out(F.col("doc_id")))
    picked = None
    for value, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        some = marked.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.where(F.col("text").isNotNull() & (F.length("text") <= MAX_CHARS)).select("doc_id", "text")
    # at most MAX_TOXIC + MAX_CLEAN ids
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    return [(r["text"], int(r["toxic"])) for r in rows]


class Scorer:
    """Margins of texts; what is known of words seen before is looked up by hash."""

    KEEP = 1_000_000

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.seen, self.parts = HashIndex(), Parts.none()

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        starts, ends, firsts = word_spans(data, offsets)
        out = np.full(len(offsets) - 1, -np.inf)
        if not len(starts):
            return out
        starts, ends, firsts = _joined(data, *_single_ideographs(data, starts, ends, firsts))
        keys = span_hashes(data, starts, ends)
        at = self.seen.find(keys)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            fresh, one = np.unique(keys[missing], return_index=True)
            if len(self.seen.keys) + len(fresh) > self.KEEP and len(self.seen.keys):
                self.clear()
                return self.texts(data, offsets)
            spots = missing[one]
            raw = data.tobytes()
            words = [raw[a:b].decode() for a, b in zip(starts[spots].tolist(), ends[spots].tolist(), strict=True)]
            self.parts = self.parts.plus(self.model.parts(words))
            self.seen.add(fresh)
            at[missing] = self.seen.find(keys[missing])
        # word i and the next one are a span unless a text or a sentence ends between them
        apart = np.zeros(len(starts), bool)
        apart[firsts[1:][firsts[1:] > 0] - 1] = True
        apart |= np.isin(data[ends - 1], (33, 46, 63, 124))
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        apart[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
        margin = self.parts.margin[at]
        go = np.flatnonzero(~apart)
        pairs, again = np.unique(at[go].astype(np.int64) << 32 | at[go + 1], return_inverse=True)
        margin[go] = np.maximum(margin[go], self.model.pair_margins(self.parts, pairs >> 32, pairs & 0xFFFFFFFF)[again])
        full = np.diff(firsts) > 0
        out[full] = np.maximum.reduceat(margin, firsts[:-1][full])
        return out


def _single_ideographs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut so that every character from U+3000 to U+9FFF is one of its own."""
    lead = np.flatnonzero((data >= 0xE3) & (data <= 0xE9))
    if not len(lead):
        return starts, ends, firsts
    after = lead + 3
    more = after[~np.isin(after, ends)]  # what follows in the same word
    begins = np.unique(np.concatenate([starts, lead, more]))
    stops = np.unique(np.concatenate([ends, lead[~np.isin(lead, starts)], after]))
    bounds = np.append(starts, len(data))[firsts]
    return begins, stops, np.searchsorted(begins, bounds)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of three or more words of one character, one space apart, become one word."""
    size, lead = ends - starts, data[starts]
    single = (size == 1) | ((size <= 4) & (lead >= 0xC0) & ((lead < 0xE3) | (lead > 0xE9)) & (size == np.select([lead >= 0xF0, lead >= 0xE0], [4, 3], 2)))
    link = np.zeros(len(starts), bool)  # link[i]: word i goes on from word i - 1
    link[1:] = single[1:] & single[:-1] & (starts[1:] == ends[:-1] + 1)
    link[firsts[:-1][firsts[:-1] < len(starts)]] = False
    lone = link.copy()  # a link with none before or after is a pair, and stays apart
    lone[1:] &= ~link[:-1]
    lone[:-1] &= ~link[1:]
    link &= ~lone
    head = np.flatnonzero(~link)
    tail = np.append(head[1:] - 1, len(starts) - 1)
    return starts[head], ends[tail], np.searchsorted(head, firsts)


def _scored(batches: Iterator[pa.RecordBatch], model: Model, place: int) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model) if model.weights is not None else None
    for batch in batches:
        for rows, data, offsets in chunks(batch, place, 1 << 20):
            p = model.probability(scorer.texts(data, offsets)) if scorer else np.zeros(rows.num_rows)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(p, pa.float64())], names=[*rows.schema.names, "score"])


def add_scores(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """``docs`` (text among its columns) with one more column, which must not be in it yet."""
    ship(docs.sparkSession)
    place = [c.lower() for c in docs.columns].index("text")
    names = [f"c{i}" for i in range(len(docs.columns))]  # some names cannot pass
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)] + [T.StructField("score", T.DoubleType())])
    return docs.toDF(*names).mapInArrow(lambda it: _scored(it, model, place), schema).toDF(*docs.columns, score)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text)."""
    model = train(training_rows(docs, labels))
    scored = add_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the limit, with their own columns."""
    model = train(training_rows(docs, labels))
    name = unused(docs, "__toxicity")
    return add_scores(docs, model, name).where(F.col(name) < limit).select(*[column(c) for c in docs.columns])
