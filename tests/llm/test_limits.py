"""Hard cases: colliding words, borders of length, odd pages, scripts, column names, scale."""

import itertools
import math
import random

import numpy as np
import pytest

from cellscope.llm import fingerprints, html_text, mixing, near_dedup, packing, shared, stages, textarrays, toxicity, url_filter, vector_dedup

from .test_operators import margins


def thue_morse(n, zero="a", one="b"):
    return "".join(one if bin(i).count("1") & 1 else zero for i in range(n))


# ---- words that a polynomial modulo a power of two cannot tell apart
@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_thue_morse_words_are_told_apart(n):
    from tokenizers import Tokenizer

    a, b = thue_morse(n), thue_morse(n, "b", "a")
    texts = [a, b, f"{a} {b}", f"one two three four {a}", f"one two three four {b}"]
    library = Tokenizer.from_file(packing.default_tokenizer())
    ids, offsets = packing.WordEncoder(packing.default_tokenizer()).encode(texts)
    for t, lo, hi in zip(texts, offsets[:-1], offsets[1:], strict=True):
        assert ids[lo:hi].tolist() == library.encode(t, add_special_tokens=False).ids
    data = np.frombuffer("".join(texts[3:]).encode(), np.uint8)
    one, two = near_dedup._sets(data, np.array([0, len(texts[3].encode()), len(data)]), 5)
    assert one.tolist() != two.tolist()
    data = np.frombuffer(texts[2].encode(), np.uint8)
    starts, ends, _ = textarrays.word_spans(data, np.array([0, len(data)]))
    assert len(set(textarrays.span_hashes(data, starts, ends).tolist())) == 2


def test_a_wrong_hash_does_not_give_wrong_ids(monkeypatch):
    code = packing.WordEncoder(packing.default_tokenizer())
    texts = ["international", " organisation", "x" * 100, "y" * 100, "a bc"]
    want = [packing.WordEncoder(packing.default_tokenizer()).encode([t])[0].tolist() for t in texts]
    real = packing.span_hashes
    monkeypatch.setattr(packing, "span_hashes", lambda d, s, e, lower: np.where(e - s > 7, np.uint64(1) << np.uint64(63), real(d, s, e, lower=lower)))
    assert [code.encode([t])[0].tolist() for t in texts + texts] == want + want


@pytest.mark.parametrize("sizes", [range(1, 30), (63, 64, 65, 200)])
def test_span_hashes_see_every_byte(sizes):
    for n in sizes:
        base = bytes(97 + i % 23 for i in range(n))
        words = {base} | {base[:i] + b"~" + base[i + 1 :] for i in range(n)} | {base[:-1], base + b"a"} - {b""}
        data = np.frombuffer(b" ".join(words), np.uint8)
        starts, ends, _ = textarrays.word_spans(data, np.array([0, len(data)]))
        assert len(set(textarrays.span_hashes(data, starts, ends).tolist())) == len(words)
    data = np.frombuffer(b"WORD word WoRdWoRdWoRd wordwordword", np.uint8)
    starts, ends, _ = textarrays.word_spans(data, np.array([0, len(data)]))
    h = textarrays.span_hashes(data, starts, ends)
    assert h[0] == h[1] and h[2] == h[3] and len(set(textarrays.span_hashes(data, starts, ends, lower=False).tolist())) == 4


# ---- fingerprints
def test_likeness_has_no_border_of_length():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9)))
    means = []
    for n in range(100, 600, 5):
        texts = [" ".join(word() for _ in range(200))[: n + 1] for _ in range(40)]
        tags = fingerprints.fingerprints([t[:n] for t in texts] + texts)
        means.append(fingerprints.likeness(tags[:40], tags[40:]).mean())
    means = np.array(means)
    around = np.array([means[max(0, i - 4) : i + 5].mean() for i in range(len(means))])
    assert np.abs(means - around).max() <= 0.02


def plain_phrases(symbols):
    """Coin tossing symbol by symbol: the places where phrases begin."""

    def toss(seq):
        out = []
        for i, s in enumerate(seq):
            if i == 0:
                out.append(s & 1)
                continue
            differ = s ^ seq[i - 1]
            k = (differ & -differ).bit_length() - 1 if differ else 0
            out.append(2 * k + (s >> k & 1))
        return out

    labels = toss(toss(toss(symbols)))
    starts = {0}
    same = [i > 0 and symbols[i] == symbols[i - 1] for i in range(len(symbols))] + [False]
    for i in range(1, len(symbols)):
        peak = labels[i] > labels[i - 1] and (i + 1 == len(symbols) or labels[i] >= labels[i + 1])
        if peak and not same[i] or not same[i] and same[i + 1] or not same[i] and same[i - 1]:
            starts.add(i)
    return sorted(starts)


def test_phrases_and_likeness_match_brute_force():
    rnd = random.Random(4)
    for _ in range(60):
        text = bytes(rnd.choice(b"abcdefgh xyz") for _ in range(rnd.randint(1, 90))) + b"a" * rnd.randint(0, 5)
        got = np.flatnonzero(fingerprints.phrase_starts(np.frombuffer(text, np.uint8), np.array([0])))
        assert got.tolist() == plain_phrases(list(text))
    tags = fingerprints.fingerprints(["some text of a few words", "some text of a few other words", "", "zzz"])
    for x, y in itertools.product(tags, tags):
        both = [(int(a), int(b)) for a, b in zip(x, y, strict=True) if a or b]
        agree = sum(a == b for a, b in both)
        want = 2 * agree / (len(both) + agree) if both else 1.0
        assert abs(fingerprints.likeness(x[None], y[None])[0] - want) < 1e-12


def test_a_fingerprint_is_the_least_draw_of_each_bin():
    text = "the quick brown fox jumps over the lazy dog and runs away from it all".encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    best = {}
    for level, names, lengths, _ in fingerprints.parse(data, offsets):
        for name, size in zip(names, lengths.tolist(), strict=True):
            draw = int(textarrays.mix(np.array([name + np.uint64(level)]))[0])
            race = np.float32(-math.log(((draw >> 40) + 0.5) * 2.0**-24) / size)
            k = draw >> 16 & fingerprints.BINS - 1
            best[k] = min(best.get(k, (np.inf, 0)), (float(race), (draw & 0x7FFF) + 1))
    got = fingerprints.sketches(data, offsets)[0]
    assert {k: v for k, (_, v) in best.items()} == {i: int(t) for i, t in enumerate(got) if t}


# ---- toxicity
def kernel(a, b):
    """By all subsequences of three letters."""

    def weights(codes):
        out = {}
        for i, j, k in itertools.combinations(range(len(codes)), 3):
            if k - i + 1 <= toxicity.SPAN and codes[i] and codes[j] and codes[k]:
                out.setdefault((codes[i], codes[j], codes[k]), []).append(toxicity.DECAY ** (k - i + 1))
        return out

    x, y = weights(a), weights(b)
    size = lambda w: math.sqrt(sum(v * v for vs in w.values() for v in vs))
    return sum(sum(x[t]) * sum(y[t]) for t in x if t in y) / (size(x) * size(y) or 1)


def test_kernel_and_folded_weights_match_brute_force():
    marks, words = ["idiot", "green apple", "scumbag"], ["id-iot", "green", "a green apple", "xyz", "scum bag", "ab"]
    landmarks = toxicity.Landmarks(marks)
    got = landmarks.kernel(words)
    coefficients = np.array([0.7, -1.2, 0.4])
    model = toxicity.Model(landmarks.folded(coefficients), 0.0)
    for i, w in enumerate(words):
        want = [kernel(toxicity.letters([w])[0].tolist(), toxicity.letters([m])[0].tolist()) for m in marks]
        assert np.allclose(got[i], want, atol=1e-5)
        assert abs(model.parts([w]).margin[0] - np.dot(want, coefficients)) < 1e-4


def test_pairs_score_as_their_whole_string(limits_model):
    words = ["idiot", "no", "re-al", "a", "", "!!", "日本", "straße", "häu", "worthless"]
    parts = limits_model.parts(words)
    for i, j in itertools.product(range(len(words)), repeat=2):
        row = toxicity.letters([f"{words[i]} {words[j]}"])
        want = toxicity._ratio(toxicity.project(row, limits_model.weights), toxicity.squares_of(row))[0] + limits_model.offset
        assert abs(limits_model.pair_margins(parts, np.array([i]), np.array([j]))[0] - want) < 1e-4


_WORDS = random.Random(12)
VOCABULARY = ["".join(_WORDS.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(_WORDS.randint(3, 8))) for _ in range(800)]


def corpus(rnd, toxic, clean, spoil, vocabulary=VOCABULARY, allowed=lambda w: True):
    out = []
    for k in range(toxic + clean):
        w = [rnd.choice(vocabulary) for _ in range(60)]
        while not allowed(w):
            w = [rnd.choice(vocabulary) for _ in range(60)]
        if k < toxic:
            spoil(w)
        out.append((" ".join(w), int(k < toxic)))
    return out


def recall(rnd, *rest, **more):
    model = toxicity.train(corpus(rnd, 300, 600, *rest, **more))
    rows = corpus(rnd, 150, 300, *rest, **more)
    p, y = margins(model, [t for t, _ in rows]) >= 0.5, np.array([y for _, y in rows], bool)
    return (p & y).sum() / y.sum(), (p & ~y).sum() / (~y).sum()


@pytest.fixture(scope="module")
def limits_model():
    rnd = random.Random(2)
    return toxicity.train(corpus(rnd, 200, 400, lambda w: w.__setitem__(5, rnd.choice(["idiot", "worthless", "scum"]))))


def test_phrases_of_harmless_words_are_learned():
    rnd = random.Random(7)
    bad = [("rotten", "apple"), ("empty", "bucket"), ("green", "snake")]
    vocabulary = VOCABULARY + [w for p in bad for w in p] * 3

    def spoil(w):
        k = rnd.randrange(59)
        w[k : k + 2] = rnd.choice(bad)

    found, wrong = recall(rnd, spoil, vocabulary, lambda w: not set(zip(w, w[1:], strict=False)) & set(bad))
    assert found >= 0.9 and wrong <= 0.02


@pytest.mark.parametrize("first,last,size", [(0x4E00, 0x9FA5, (2, 4)), (0x430, 0x44F, (4, 8)), (0xAC00, 0xD7A3, (2, 4))])
@pytest.mark.parametrize("spaced", [True, False])
def test_other_scripts_are_learned(first, last, size, spaced):
    if not spaced and first != 0x4E00:
        pytest.skip("written with spaces")
    rnd, fixed = random.Random(7), random.Random(3)
    words = ["".join(chr(fixed.randint(first, last)) for _ in range(fixed.randint(*size))) for _ in range(500)]
    spoil = lambda w: w.__setitem__(rnd.randrange(60), rnd.choice(words[:4]))
    if spaced:
        found, wrong = recall(rnd, spoil, words[4:])
    else:
        rows = [[("".join(t.split()), y) for t, y in corpus(rnd, n, 2 * n, spoil, words[4:])] for n in (300, 150)]
        p, y = margins(toxicity.train(rows[0]), [t for t, _ in rows[1]]) >= 0.5, np.array([y for _, y in rows[1]], bool)
        found, wrong = (p & y).sum() / y.sum(), (p & ~y).sum() / (~y).sum()
    assert found >= 0.9 and wrong <= 0.02


def test_long_words_count_beyond_their_beginning():
    rnd = random.Random(5)
    heads = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(26)) for _ in range(4)]
    vocabulary = VOCABULARY + [h + t for h in heads for t in ("tableau", "windowed", "carpeting", "riverside")]
    found, wrong = recall(rnd, lambda w: w.__setitem__(rnd.randrange(60), rnd.choice(heads) + rnd.choice(["scumbag", "moronic", "filthhead"])), vocabulary)
    assert found >= 0.9 and wrong <= 0.02


def test_copies_of_a_toxic_text_do_not_make_its_words_toxic(limits_model):
    rnd = random.Random(9)
    rows = corpus(rnd, 200, 400, lambda w: w.__setitem__(5, rnd.choice(["idiot", "worthless", "scum"])))
    copied = rows[0][0].split()
    rows += [(" ".join(copied + [f"{rnd.choice(VOCABULARY)}{i}"]), 1) for i in range(40)]
    model = toxicity.train(rows)
    clean = [" ".join(rnd.choice(VOCABULARY) for _ in range(30)) + " " + " ".join(w for w in copied[8:20]) for _ in range(30)]
    assert (margins(model, clean) >= 0.5).mean() <= 0.05


# ---- pages
TEXT = "<h1>The title of it</h1>" + "".join(f"<p>{'word ' * n}</p>" for n in (45, 30, 3, 60))
OPEN = ('<div class="overflow-hidden">', '<article class="overflow-hidden">', '<div class="post has-sidebar">', '<div class="content with-sidebar">', '<div id="main" class="no-comments">', '<section class="related-work">', '<div class="side-by-side">', '<div data-state="not-hidden">')


@pytest.mark.parametrize("start", OPEN)
@pytest.mark.parametrize("before,after", [("", ""), ("<nav><a href=x>Home</a> <a href=y>About</a></nav>", "<footer>&copy; 2024 Foo</footer>"), ("<div><a href=x>Home</a> <a href=y>About</a></div><div>We use cookies to improve your visit. Accept</div>", "<div>Copyright 2024 Foo. All rights reserved.</div>")])
def test_names_of_containers_do_not_lose_the_article(start, before, after):
    text = html_text.main_text(f"<html><body>{before}{start}{TEXT}</{start[1:].split()[0]}>{after}</body></html>", html_text.train())
    assert text == "The title of it " + " ".join(["word"] * 138)


# hand-marked pages: [[ ]] around what belongs to the article
PAGES = (
    "<body><nav><a href=/>Home</a><a href=/n>News</a></nav><article><h1>[[River rises]]</h1><p>[[The river rose by two metres in the night and flooded the lower town.]]</p><p>[[Nobody was hurt.]]</p></article><footer>&copy; 2020 Gazette</footer>",
    "<div class='cookie-banner'><p>We use cookies. Accept</p></div><main><h2>[[On bread]]</h2><p>[[Mix flour, water and salt, then wait for a day until the dough has doubled.]]</p><ul><li>[[flour]]<li>[[water]]</ul></main><aside><p>Read our other long articles about cooking with fire and iron and clay</p></aside>",
    "<article><p>[[A short note.]]</p><section class='comments'><h3>2 comments</h3><p>I think that this is a very good note and I have read it three times already with joy</p><p>Me too</p></section></article>",
    "<header><h1>The Site</h1></header><div id='content'><p>[[Snow fell on the hills while the road below stayed dry and busy all day long.]]</p><form><input name=q><label>Search the site</label></form><p>[[It melted in a week.]]</p></div><div class='sidebar'><p>Weather today is mild with some clouds in the west</p></div>",
    "<article class='story'><p>[[Copyright law is old.]]</p><p>[[It says who may copy a work, for how long, and under what terms it may be sold.]]</p><div class='ad-slot'>Buy a fine new watch today</div><p>[[All rights reserved is a phrase.]]</p></article><div class='newsletter'>Subscribe to our newsletter for more</div>",
    "<div style='display:none'><p>not shown at all, though it has quite a number of words in it</p></div><article><p hidden>nor this</p><p aria-hidden='false'>[[This is shown.]]</p><p>[[So is this longer one, with a few more words than the last.]]</p></article>",
)


def test_hand_marked_pages():
    import re

    tree = html_text.train()
    for page in PAGES:
        want = " ".join(re.findall(r"\[\[(.*?)\]\]", page))
        assert html_text.main_text(page.replace("[[", "").replace("]]", ""), tree) == want


def test_neighbours_and_link_density_lead_on_unnamed_pages():
    def features(tree):
        return set() if isinstance(tree, int) else {html_text.FEATURES[tree[0]]} | features(tree[2]) | features(tree[3])

    assert {"words", "links", "words_before", "words_after"} <= features(html_text.train())


# ---- urls
def test_new_hosts_take_the_reputation_above_them(spark):
    rows = [(i, f"http://h{i % 40}.evil.com/a") for i in range(400)] + [(1000 + i, f"http://g{i % 40}.good.com/a") for i in range(400)]
    rows += [(5000, "http://new.evil.com/x"), (5001, "http://new.good.com/x"), (5002, "http://u@h.evil.com:80/"), (5003, None)]
    labels = spark.createDataFrame([(i, 0, 1) for i in range(400)] + [(1000 + i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), labels).where("page_id >= 5000").collect()}
    assert got == {5000: "block", 5001: "allow", 5002: "block", 5003: "allow"}


def test_public_suffixes(spark):
    hosts = ["shop.example.co.uk", "example.co.uk", "co.uk", "a.b.example.com", "localhost", "10.0.0.1", "x.example.org:8080", ""]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", url_filter.domain_of(url_filter.F.col("h")).alias("d"), url_filter.suffix_of(url_filter.F.col("h")).alias("s")).collect()
    assert [(r["d"], r["s"]) for r in rows] == [("example.co.uk", "co.uk"), ("example.co.uk", "co.uk"), ("co.uk", "co.uk"), ("example.com", "com"), ("localhost", "localhost"), ("10.0.0.1", "10.0.0.1"), ("example.org", "org"), ("", "")]


# ---- mixing
def test_rare_sources_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PARTS", 8)
    docs = spark.createDataFrame([(i, "big", "t") for i in range(3000)] + [(9000, "rare", "u"), (9001, "rare", "v")], "doc_id long, source string, text string")
    out = mixing.mix_sources(docs)
    n = {r["doc_id"]: r["count"] for r in out.where("source = 'rare'").groupBy("doc_id").count().collect()}
    assert all(abs(n[i] - 750.5) < 5 * 750.5**0.5 for i in (9000, 9001))
    assert out.select("doc_id", "copy_no").distinct().count() == out.count() == out.select("mix_key").distinct().count()
    monkeypatch.setattr(mixing, "PARTS", 10**6)
    assert sorted(map(tuple, mixing.mix_sources(docs).collect())) == sorted(map(tuple, out.collect()))


def test_copies_are_in_key_order_across_partitions(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}") for i in range(500)], "doc_id long, source string")
    keys = [r["mix_key"] for r in mixing.mix_sources(docs, partitions=7).collect()]
    assert keys == sorted(keys) and len(keys) > 400


# ---- vectors
def test_met_pairs_grow_with_the_rows():
    met = []
    for n in (5_000, 50_000, 500_000):
        widths = vector_dedup.widths_for(n)
        met.append(n * n / 2 * vector_dedup.tables_for(widths) * vector_dedup.same_cell(math.sqrt(2)) ** widths)
    assert met[1] < 15 * met[0] and met[2] < 15**2 * met[0]


@pytest.mark.parametrize("n", [50, 5_000, 500_000])
def test_pairs_at_the_threshold_are_met_and_counted(n):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((5000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = rng.standard_normal((5000, 64))
    g -= (g * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
    widths = vector_dedup.widths_for(n)
    tables = vector_dedup.tables_for(widths)
    met = (vector_dedup.cell_keys(x, widths, tables) == vector_dedup.cell_keys(y, widths, tables)).any(axis=1)
    d = vector_dedup.directions(64, vector_dedup.DIRECTIONS)
    counted = (np.abs(x @ d - y @ d) <= vector_dedup.WINDOW).sum(axis=1) >= vector_dedup.count_level()
    assert (met & counted).mean() >= 0.999


# ---- columns, storage
def test_columns_of_any_name_are_kept(spark):
    extra = ["score", "__toxicity", "__kept", "__again", "__source", "__cdf", "__parts", "__chunk", "copy_no", "mix_key", "kept", "component_id", "n", "a.b", "Leader"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in extra)
    docs = spark.createDataFrame([(i, f"text number {i % 7} of a few words", "en", f"s{i % 2}", 5, *range(i, i + len(extra))) for i in range(14)], schema)
    labels = spark.createDataFrame([(i, 1, int(i % 7 == 3)) for i in range(14)], "doc_id long, quality int, toxic int")
    for out in (stages.without_toxic(docs, labels), stages.one_of_each_group(docs), stages.mixed(docs)):
        rows = [tuple(r) for r in out.collect()]
        assert out.columns == docs.columns and rows and set(rows) <= {tuple(r) for r in docs.collect()}
    assert {"_copy_no", "_mix_key"} <= set(mixing.mix_sources(docs).columns)


def test_no_shared_folder_is_an_error_on_a_cluster(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda key, default=None: None)

    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(lambda: Conf)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)


def test_very_long_texts_meet(spark):
    words = [f"w{i}" for i in range(150_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-20])), (3, " ".join(words[75_000:])), (4, "short text of some words here")]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_sequences_are_permuted():
    for n in (1, 2, 3, 10, 97, 1000, 1 << 20):
        step = packing.stride(n)
        assert math.gcd(step, n) == 1 and (n < 50 or 0.5 < step / n < 0.75)
