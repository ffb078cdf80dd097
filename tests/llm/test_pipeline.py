import random

import corpus_pipeline
from tests.llm.test_near_dedup import brute, edited

WORDS = [a + b for a in ("stone", "river", "cloud", "green", "paper", "light", "night", "house", "water", "glass") for b in ("", "s", "ing", "ed", "er", "ly")] + "the of and to a in is it that was for on are with as be this have".split() * 4


def test_stages(spark, tmp_path):
    r = random.Random(9)
    line = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    item = "which of these seven rivers flows through the glass house at night and why"
    shared = line(60)
    texts = ["\n".join(line(r.randint(20, 40)) for _ in range(4)) for _ in range(60)]
    copy = edited(r, texts[0].replace("\n", " ").split(), 1)
    texts += [texts[1], " ".join(copy), texts[2] + "\n" + shared, texts[3] + "\n" + shared, line(80) + " " + item + " " + line(30), "too short", "", None, "buy now " * 100]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    state, seen = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        state = stage(spark, state, str(tmp_path))
        if k < 4:
            assert state.columns == docs.columns
        state.write.parquet(str(tmp_path / f"s{k}"))
        state = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen.append({x.doc_id: x for x in state.collect()})
    good, lines, distinct, clean, last = seen
    assert set(good) == set(range(65))
    assert 60 not in lines  # all of its lines are those of an earlier document
    assert sum(shared in x.text for x in lines.values()) == 1 and all(x.n_chars == len(x.text) for x in lines.values())
    want = brute([(i, x.text) for i, x in lines.items()], 5)
    assert set(distinct) == {i for i, (_, c) in want.items() if c == i}
    assert set(distinct) - set(clean) == {64} and set(last) == set(clean)
    assert {tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {tuple(x) for x in last.values()}


def test_stages_on_nulls_repeats_and_clashing_columns(spark, tmp_path):
    r = random.Random(4)
    line = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    shared = line(60)
    long = "\n".join(line(30) for _ in range(4000))
    texts = [(1, None), (2, ""), (None, line(120)), (3, line(90)), (3, line(90)), (4, line(70) + "\n" + shared), (5, line(70) + "\n" + shared), (6, long)]
    texts += [texts[2], texts[3], (7, texts[3][1]), (None, texts[4][1])]
    schema = "doc_id bigint, text string, lang string, source string, n_chars int, line_dedup_n_dropped string, t1 string, row map<string,int>, doc array<string>"
    docs = spark.createDataFrame([(i, t, None if k % 2 else "en", "s", len(t or ""), "x", "y", {"a": k}, ["b"]) for k, (i, t) in enumerate(texts)], schema)
    spark.createDataFrame([(1, line(20))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, str(tmp_path))
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0
        if k < 4:
            assert got.columns == empty.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        kept[name] = [tuple(x) for x in got.select("doc_id", *["text"] * (k < 4)).collect()]
    key = lambda x: (str(x[0]), x[1] or "")
    assert sorted(kept["quality rules"], key=key) == sorted((x for x in texts[2:] if x[0] != 6), key=key)  # its few words repeat
    lines = sorted(kept["line dedup"], key=key)
    assert (1, None) in lines and (2, "") in lines and sum(shared in (t or "") for _, t in lines) == 1 and (5, texts[6][1].split("\n")[0]) in lines
    assert sorted(kept["minhash near-dedup"], key=key) == sorted([texts[0], texts[1], texts[2], texts[3], texts[4], texts[5], texts[6], texts[7]], key=key)
    assert sorted(kept["benchmark decontamination"], key=key) == sorted(texts, key=key)
    assert len(kept["sentencepiece codec"]) == len(texts)
