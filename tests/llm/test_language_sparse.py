"""Language id: counts and probabilities against plain formulations, sparsity, and held-out accuracy on real rows."""

import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import language_id as L
from tests.llm.test_scans import LANGS, prose


def plain_counts(text):
    """Bucket to count, n-gram by n-gram, each hashed alone."""
    t, out = text.lower(), Counter()
    for n in (1, 2, 3):
        for i in range(len(t) - n + 1):
            gram = t[i : i + n]
            found = L.buckets([gram])
            out[int(found[-1])] += 1  # its longest n-gram comes last
    return out


def test_counts(monkeypatch):
    r = random.Random(3)
    texts = ["", "a", "ab", "Straße ΑΣ İx", "\x00 \n", *("".join(r.choice("abc éß中😀Σ") for _ in range(r.randint(0, 60))) for _ in range(60))]
    row, at, n = L.counts(texts)
    for i, t in enumerate(texts):
        assert dict(zip(at[row == i].tolist(), n[row == i].tolist())) == plain_counts(t)
    long = "".join(r.choice("abcdef gh") for _ in range(5000))
    whole = [x.tolist() for x in L.counts([long])]
    monkeypatch.setattr(L, "_GROUP_CHARS", 700)  # a long text is counted part by part
    assert [x.tolist() for x in L.counts([long])] == whole
    parts = [g for _, g in L.groups([*texts, long, "x", long])]
    assert [t for g in parts for t in g] == [*texts, long, "x", long] and [long] in parts


def test_the_model_is_sparse_and_right(spark):
    r = random.Random(5)
    rows = [(i, prose(r, lang := r.choice(list(LANGS)), r.randint(20, 120)), lang) for i in range(400)]
    model = L.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample=100)
    met = (model.idf < model.idf.max()).sum()
    assert model.langs == sorted(LANGS) and 0 < len(model.used) < 0.7 * met and (model.weights == 0).any()
    texts = [t for _, t, _ in rows[:50]] + ["", "qqq"]
    got = model.probabilities(texts)
    for t, p in zip(texts, got):
        x = np.zeros(L.DIMENSIONS)
        for b, n in plain_counts(t).items():
            x[b] = n * model.idf[b]
        x /= max(np.linalg.norm(x), 1e-9)
        dense = np.zeros((L.DIMENSIONS, len(model.langs)))
        dense[model.used] = model.weights
        assert np.allclose(L.softmax((x @ dense + model.bias) / model.temperature), p, atol=1e-4)


def test_held_out_rows_of_the_tables(spark):
    folder = "/root/testdata/sf0.01/documents.parquet"
    if not __import__("os").path.exists(folder):
        pytest.skip("no tables")
    docs = spark.read.parquet(folder)
    found = L.identify(docs).alias("f").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    right, n = found.selectExpr("sum(if(lang = lang_pred, 1, 0))", "count(*)").first()
    assert n > 250 and right / n > 0.98
