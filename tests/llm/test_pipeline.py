"""The pipeline's rows against a plain version of its four stages."""

import hashlib
import math

import numpy as np

import corpus_pipeline
from cellscope.llm import mixing, packing, toxicity

from .test_operators import margins, near_truth, toxic_corpus


def copies_of(doc_id, mean):
    u = int(hashlib.md5(f"count{mixing.SEED}:{doc_id}:0".encode()).hexdigest()[:13], 16) / float(1 << 52)
    term = total = math.exp(-mean)
    k = 0
    while total <= u:
        k += 1
        term *= mean / k
        total += term
    return k


def test_pipeline_matches_plain_stages(spark, tmp_path):
    made = toxic_corpus(160, 11)
    texts = [t for _, t, _ in made]
    texts += texts[:12] + [t + " and one more" for t in texts[20:40]] + ["", "long " * 3000]
    rows = [(i, t, "en", "hot" if i % 3 else f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, _, y in made], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs, labels = (spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "labels"))
    score = margins(toxicity.train(toxicity.training_rows(docs, labels)), texts)
    clean = [r for r, p in zip(rows, score, strict=True) if p < 0.5]
    assert 90 < len(clean) < len(rows) - 20
    groups = near_truth([r[:2] for r in clean])
    one = [r for r in clean if groups[r[0]][1] == r[0]]
    assert len(one) < len(clean)
    by_source = {}
    for r in one:
        by_source[r[3]] = by_source.get(r[3], 0) + 1
    count = {r[0]: copies_of(r[0], len(one) / len(by_source) / by_source[r[3]]) for r in one}
    code = packing.encoder(packing.default_tokenizer())
    want = {}
    for r in one:
        if count[r[0]]:
            want[r[0]] = (len(code.encode([r[1]])[0]) + 1) * count[r[0]]
    found, windows = {}, {}
    for r in got:
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert found == want
    for pieces in windows.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert ends[-1] <= 1024 and [a for a, _ in sorted(pieces)] == [0, *ends[:-1].tolist()]


def test_pipeline_takes_nulls_repeated_rows_and_empty_tables(spark, tmp_path):
    schema, marks = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"
    rows = [(None, "no id here", None, None, None), (1, None, "en", "a", 0), (2, "two words", "en", "a", 9), (2, "two words", "en", "a", 9), (3, "", None, "b", 0), (4, "two words", "en", None, 9)]
    for name, docs, labels in (("odd", rows, [(2, None, None), (None, 1, 1)]), ("none", [], [])):
        spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame(labels, marks).write.parquet(str(tmp_path / name / "labels.parquet"))
        docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        clean = corpus_pipeline.toxicity(spark, docs, str(tmp_path / name))
        one = corpus_pipeline.near_duplicates(spark, clean, str(tmp_path / name))
        assert clean.count() == len(rows) * (name == "odd") and sorted((r["doc_id"] for r in one.collect()), key=str) == ([1, 2, 3, None] if name == "odd" else [])
        assert corpus_pipeline.mixing(spark, one, str(tmp_path / name)).columns == docs.columns
        assert corpus_pipeline.run(spark, str(tmp_path / name)).where("length <= 0").count() == 0
