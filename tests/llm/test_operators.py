"""Brute-force, round-trip and edge-case tests of the corpus operators."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellscope.llm import chat, fingerprints, html_text, license_scan, mixing, near_dedup, packing, stages, toxicity, url_filter, vector_dedup
from cellscope.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], schema)


def empty(spark):
    return spark.createDataFrame([], DOCS)


class Forest:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def tie(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


# ---- near-duplicates
def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_truth(rows):
    sets = {i: shingles(t) for i, t in rows}
    f = Forest(sets)
    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                f.tie(a, b)
    return {i: (len(sets[i]), f.root(i)) for i in sets}


def near_corpus(seed=5):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(30, 160))]
        for _ in range(rnd.randint(1, 9)):
            copy = list(base)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return [*texts, *texts[:5], None, "", " \n\t", "one two", "ONE  two", "a b c d e", "A\nb c d e", "x" * 5000, "é ü É", "É ü é"]


def test_near_duplicates_match_brute_force(spark):
    rows = list(enumerate(near_corpus()))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == near_truth(rows)


def test_unlinked_members_of_a_bucket_still_meet(spark, monkeypatch):
    """Chains: neighbours are similar, ends are not; small blocks and streams give the same."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "STREAM", 2)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(40)] + [(100 + i, " ".join(words[i : i + 30] + [f"z{i}"])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == near_truth(rows)


def test_near_duplicates_edges(spark):
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, "a b c d e f"), (4, "q r s"), (4, "t u v"), (5, "t u v")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 2, True), (3, 1, False), (4, 4, True), (4, 4, True), (5, 4, False)], key=str)


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(0)
    for size in (3, 40, 600):
        pool = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
        a, b = pool[:size], np.concatenate([pool[: size // 2], pool[size : size + size - size // 2]])
        sign = near_dedup.super_minhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 256)
        assert np.isfinite(sign).all()
        true = len(set(a) & set(b)) / len(set(a) | set(b))
        assert abs((sign[0] == sign[1]).mean() - true) < 0.12


def test_components_match_brute_force(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)] + [(500, i) for i in range(501, 540)]
    f = Forest({x for p in links for x in p})
    for a, b in links:
        f.tie(a, b)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    assert got == {i: f.root(i) for a, b in links if a != b for i in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- vectors
def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(25):
            base = rng.standard_normal(24)
            for _ in range(rng.integers(1, 7)):
                rows.append((n, (base + rng.standard_normal(24) * rng.choice([0, 0.05, 0.1, 0.14]) * 1.0).tolist(), label))
                n += 1
    rows += [(n, None, 0), (n + 1, [0.0] * 24, 0), (n + 2, [float("nan")] + [1.0] * 23, 0), (n + 3, [1.0] * 23 + [None], 1), (n + 4, [], 1), (n + 5, [1e300] * 24, 1), (n + 6, [1e-300] * 24, 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    f, count = Forest([r[0] for r in rows]), dict.fromkeys([r[0] for r in rows], 0)
    good = {i: np.array(v) / np.abs(np.array(v)).max() for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    kinds = {r[0]: r[2] for r in rows}
    for a in good:
        for b in good:
            if a < b and kinds[a] == kinds[b] and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= 0.98:
                f.tie(a, b)
                count[a] += 1
                count[b] += 1
    assert sum(count.values()) > 60
    assert got == {i: (count[i], f.root(i), f.root(i) == i) for i in count}


def test_vector_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 8)
    rng = np.random.default_rng(4)
    base = rng.standard_normal(16)
    rows = [(i, (base + rng.standard_normal(16) * 0.01).tolist(), 1) for i in range(60)] + [(100 + i, base.tolist(), 1) for i in range(5)] + [(200, base.tolist(), 2)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == {i: (64, 0) if i < 200 else (0, 200) for i, _, _ in rows}
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_collision_counts_match_brute_force():
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((30, 7)), rng.standard_normal((50, 7))
    assert (vector_dedup.collisions(a, b, 0.4) == (np.abs(a[:, None] - b[None]) <= 0.4).sum(axis=2)).all()


# ---- fingerprints
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_fingerprints_do_not_depend_on_neighbours(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    together = fingerprints.fingerprints(texts)
    for t, f in zip(texts, together, strict=True):
        assert (fingerprints.fingerprints([t])[0] == f).all()


def test_shared_passages_are_seen_at_any_offset():
    rnd = random.Random(1)
    text = lambda n: "".join(rnd.choice("abcdefghij klmno") for _ in range(n))
    passage, tags = text(3000), []
    for shift in (0, 1, 7, 100):
        tags.append(fingerprints.fingerprints([text(shift) + passage])[0])
    near = fingerprints.likeness(np.array([tags[0]] * 3), np.array(tags[1:]))
    assert (near > 0.85).all() and fingerprints.likeness(tags[0][None], fingerprints.fingerprints([text(3000)]))[0] < 0.1
    levels = [sorted(names.tolist()) for _, names, _, _ in fingerprints.parse(np.frombuffer(passage.encode(), np.uint8), np.array([0, 3000]))]
    moved = [set(names.tolist()) for _, names, _, _ in fingerprints.parse(np.frombuffer(("xyz" + passage + "q").encode(), np.uint8), np.array([0, 3004]))]
    for one, other in zip(levels[:4], moved[:4], strict=True):
        assert sum(x in other for x in one) >= len(one) - 8  # phrases at the ends only


def test_edited_texts(spark):
    texts = ["", "ab", "é" * 10, None, "word " * 400, "Ünder the bridge", "same", "same", "\U0001f600\U0001f601\U0001f602"]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ids = sorted(got, reverse=True)
    plain = {i: t or "" for i, t in rows}
    for i, nxt in zip(ids, [*ids[1:], ids[0]], strict=True):
        t = plain[i]
        k = len(t) // 3
        new = t[: len(t) - k] + plain[nxt][:k]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert got[i]["fingerprint"] == fingerprints.as_text(fingerprints.fingerprints([t])[0])
        assert got[i]["edited_fingerprint"] == fingerprints.as_text(fingerprints.fingerprints([new])[0])
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[18]["fingerprint"] == got[21]["fingerprint"] and got[21]["near_next"] == 1
    one = fingerprints.edited_fingerprints(spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    assert fingerprints.edited_fingerprints(empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (1, "c")], "doc_id long, text string")
    assert fingerprints.edited_fingerprints(odd).count() == 4


# ---- chat
CONTROL = st.sampled_from(["<s>", "</s>", "[INST]", "\\", "<|im_start|>", "<|im_end|>", "\n", "a", "<", "[", "n", "<<SYS>>", "INST]", "s>", "|", "\\n"])


@settings(max_examples=300, deadline=None)
@given(st.lists(CONTROL, max_size=8).map("".join))
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", ""]), st.lists(CONTROL, max_size=3).map("".join), st.integers(1, 60)), min_size=1, max_size=15))
def test_windows_hold_each_turn_once(turns):
    made = list(chat.windows(iter(turns), 100, 30))
    assert [t for w in made for t in chat.read_back(w["text"], w["n_repeated"])] == [t[:2] for t in turns]
    assert "".join(chat.unescape(w["text"][a:b]) for w in made for a, b in w["targets"]) == "".join(t[1] for t in turns if t[0] == "assistant")
    for w in made:
        assert w["n_tokens"] <= 100 or w["n_new"] == 1


def test_conversations(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "system", "be kind"), (-7, 0, "user", said), (-7, 1, "assistant", said), (2, 1, None, None), (2, None, "assistant", "x"), (None, 0, "user", "n")]
    rows += [(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "word " * (i % 300)) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_windows(df)).collect()}
    assert set(got) == {1, -7, 2, None}
    for conv in got:
        turns = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_windows(df.limit(0)).count() == 0
    assert got[1]["n_windows"] > 1


# ---- packing
def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_tokenizer())
    code = packing.WordEncoder(packing.default_tokenizer())
    rnd = random.Random(1)
    signs = "ab'sStdreé 漢 \n\t  12½.!?$ll'dvm\u200b\u3000\U0001f600é"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(4000)] + ["", "a<|endoftext|>b", "it's they'll we've'd 'sx  x\n\n y", "word " * 3000]
    ids, offsets = code.encode(texts)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


def check_packing(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(docs_of(spark, texts)).collect()
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        padding += 1024 - at
    return padding


def test_packing_round_trip(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rnd.choice([0, 3, 50, 700, 2500]))) for _ in range(120)] + [None, "", "x"] + ["same text " * 350] * 40
    assert check_packing(spark, texts) < 1024
    assert packing.pack(empty(spark)).count() == 0


def test_plan_places_every_rest_once():
    h = np.zeros(1025, np.int64)
    h[[700, 324, 512, 100, 24, 1000, 1]] = [50, 20, 9, 7, 30, 11, 5]
    runs, left, line, total = packing.plan(h)
    for length in np.flatnonzero(h):
        covered = sorted((a, b) for a, b, _, _ in runs.get(length, []))
        used = covered[-1][1] if covered else 0
        assert [a for a, _ in covered] == [0, *[b for _, b in covered]][: len(covered)]
        assert (length in left) == (used < h[length]) and used <= h[length]
    assert total * 1024 - (h * np.arange(1025)).sum() < 1024 and line <= total


# ---- toxicity
def toxic_corpus(n=500, seed=0):
    rnd = random.Random(seed)
    bad = ["stupid", "worthless", "moron", "scum", "pathetic"]
    words = ["".join(rnd.choice(["an", "er", "th", "ou", "ti", "on", "sh", "re"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    out = []
    for i in range(n):
        w = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        y = int(i % 4 == 0)
        for _ in range(2 * y):
            w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        out.append((i, " ".join(w) + ".", y))
    return out


@pytest.fixture(scope="module")
def toxic_model():
    return toxicity.train([(t, y) for _, t, y in toxic_corpus()])


def margins(model, texts):
    coded = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
    return model.probability(toxicity.Scorer(model).texts(np.frombuffer(b"".join(coded), np.uint8), offsets))


def test_gapped_insults_are_caught(toxic_model):
    bad = ["you st.u.pid one", "a wor-thless thing", "m o r o n", "p@thetic", "STUPID!", "what a mor*on an er"]
    good = ["", "then the other ones are shown", "an er th ou", "  \n ", "1234 5678"]
    assert (margins(toxic_model, bad) >= 0.5).all() and (margins(toxic_model, good) < 0.5).all()


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_corpus(600, 7)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, ""), (None, "an er")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len(got) == 603 and got[9001]["score"] == got[9002]["score"] == 0.0
    held = [(got[i]["predicted"], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert len(held) > 80 and sum(p == y for p, y in held) / len(held) > 0.97
    assert not any(r["predicted"] for r in toxicity.score_documents(docs, labels.limit(0)).collect())
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_labels_of_the_held_out_fold_are_not_read(spark):
    rows = toxic_corpus(200, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    a = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    b = spark.createDataFrame([(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    assert sorted(toxicity.training_rows(docs, a)) == sorted(toxicity.training_rows(docs, b))


# ---- pages
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body><header><a href=/>home</a></header><nav><ul><li><a href=x>x</a></li></ul></nav>
<div class="ad">Buy now the best thing</div><article><h1>Head &amp; line</h1><p><b>First   para&#233;.<br><p>Second &lt;b&gt; one<aside>side</aside><p>To.</p><form><label>Name</label></form><div class="comments"><p>I liked it very much indeed, all of it.</p></div></article><footer>&copy; x</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<article><p>cut off &am"), (4, "u", "<p>plain</p>"), (5, "u", "<article><p>" + "long " * 30000), (6, "u", "<article><p>a<"), (7, "u", "<<<>>")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = [(r["page_id"], r["text"]) for r in got]
    assert (1, "Head & line First paraé. Second <b> one To.") in texts and (2, "") in texts and (3, "") in texts and (4, "cut off &am") in texts and (4, "plain") in texts
    assert all(r["n_chars"] == len(r["text"]) for r in got) and len(got) == len(rows)
    assert dict(texts)[5] == ("long " * 30000).strip()


def test_tree_learns_its_table():
    tree = html_text.train()
    rows = html_text.labelled()
    assert sum(html_text.classify(tree, row[:-1]) == row[-1] for row in rows) >= 0.99 * len(rows) > 250


# ---- urls, mixing, licences
def test_urls(spark):
    urls = ["http://A.Example.NET/en/1?q", "https://x.example.net/fr/", "http://example.com/de/x#y", "ftp://h.org/fr/a", "http://org/fr/", "http://net", "http://net/", None, "no scheme", "http://", "a://b.ORG?x/fr/", "x://É.net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")).orderBy("page_id").collect()]
    assert got == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"), ("x.example.net", "/fr/", "net/", "block"), ("example.com", "/de/x", "example.com/de/", "block"), ("h.org", "/fr/a", "org/fr/", "allow"), ("org", "/fr/", "org/fr/", "allow"),
        ("net", "", None, "allow"), ("net", "/", "net/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b.org", "", None, "allow"), ("É.net", "/", "net/", "block"),
    ]


def test_bad_hosts_are_blocked(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i < 60 else f'h{i % 9}'}.test.com/a") for i in range(300)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i < 55 or i % 17 == 0 else 1, 0) for i in range(280)], "doc_id long, quality int, toxic int")
    got = url_filter.judge_urls(pages, labels).groupBy("host", "verdict").count().collect()
    assert {(r["host"], r["verdict"]) for r in got} == {("bad.test.com", "block")} | {(f"h{k}.test.com", "allow") for k in range(9)}


def test_poisson_counts(spark):
    docs = spark.createDataFrame([(i, "big" if i % 3 else "small", "t", i) for i in range(6000)], "doc_id long, source string, text string, copy_no long")
    out = mixing.mix_sources(docs, {"big": 1.0, "small": 3.0})
    assert out.columns == ["doc_id", "source", "text", "copy_no", "_copy_no", "mix_key"] and out.where("copy_no <> doc_id").count() == 0
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 1500) < 160 and abs(n["small"] - 4500) < 250
    cdf = spark.range(1).select(mixing.poisson_cdf(mixing.F.lit(2.5)).alias("c")).first()["c"]
    assert abs(cdf[0] - np.exp(-2.5)) < 1e-12 and abs(cdf[-1] - 1) < 1e-9
    assert mixing.mix_sources(empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, None, "x"), (1, "a", "x"), (1, "a", "x")], "doc_id long, source string, text string")
    assert set(mixing.mix_sources(odd).columns) == {"doc_id", "source", "text", "copy_no", "mix_key"}


def test_licences(spark):
    mit = next(text for name, text in license_scan.KNOWN if name == "MIT")
    texts = [mit.upper(), "Copyright (c) 2020 Someone\n" + mit.replace("sublicense", "sublicence").replace(" ", "  "), mit + " more", "x\nReleased under the MIT License.\nSPDX-License-Identifier: Apache-2.0", None, "", "licence to read"]
    got = [(r["license"], r["notices"], r["n_notices"]) for r in license_scan.scan_licenses(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got[0][0] == got[1][0] == "MIT" and got[2][0] is None
    assert got[3] == (None, "Apache-2.0,MIT", 2) and got[4] == got[5] == (None, "", 0) and got[6] == (None, "", 0)


# ---- stages
def test_stages_keep_columns(spark):
    texts = [f"a lone text number {i} of its own kind {i * 7} here" for i in range(30)] + ["the same words in one more copy"] * 4 + [None, ""]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = stages.one_of_each_group(docs)
    assert kept.columns == docs.columns and kept.count() == 30 + 1 + 2
    assert stages.without_toxic(docs, labels).count() == len(texts)
    again = stages.one_of_each_group(docs.union(docs.where("doc_id < 3")))
    assert again.count() == 33
    assert stages.mixed(docs).columns == docs.columns
    assert stages.packed(stages.mixed(docs)).where("length <= 0").count() == 0
