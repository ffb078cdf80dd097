"""Columns, sources, assembly and streams on Spark against the local runtime."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import JsonLines, TextFiles, Tokenizer
from tessera.functions import columns
from tessera.operators import vocabulary
from tessera.operators.assemble import Padding, assemble, not_rectangular
from tessera.plans import distinct_words, queries
from tessera.session import ship
from tessera.sources.files import documents, extract_field, extract_field_column, framed, has_border, lossy_utf8, read_documents
from tessera.streaming.encode import encode_stream, token_rates

from .texts import ALL


@pytest.fixture(scope="module")
def tok():
    return Tokenizer(queries.spec())


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame([*enumerate(ALL), (9999, None)], "id bigint, text string").repartition(5).cache()


def by_id(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def test_columns_equal_the_local_runtime(docs, tok):
    run, spec = tok.runtime, tok.spec
    ids = [run.encode(t) for t in ALL]
    for column, want in [(columns.encode("text", spec), ids), (columns.count_tokens("text", spec), [len(i) for i in ids]), (columns.tokenize("text", spec), [run.tokens(i) for i in ids]), (columns.normalize("text", spec), [run.normalize(t) for t in ALL]), (columns.decode(columns.encode("text", spec), spec), [run.decode(i) for i in ids])]:
        got = by_id(docs.select("id", column.alias("x")), "x")
        assert got.pop(9999) is None
        assert [got[i] for i in range(len(ALL))] == want
    got = by_id(docs.select("id", tok.encode_column(F.encode("text", "UTF-8"), max_length=7, truncation_side="left").alias("x")), "x")
    assert [got[i] for i in range(len(ALL))] == tok.encode_batch_list(ALL, max_length=7, truncation_side="left")


@pytest.mark.parametrize("definition", [None, {"type": "BertPreTokenizer"}, {"type": "WhitespaceSplit"}, {"type": "Digits", "individual_digits": True}], ids=str)
def test_pre_tokenizers(docs, definition):
    plain = docs.where("text rlike '^[ -~]*$'")
    exact, native = (by_id(plain.select("id", columns.pre_tokenize("text", definition, native=n).alias("x")), "x") for n in (False, True))
    assert exact == native


@pytest.mark.parametrize("padding", [None, Padding(), Padding("max_length", 0, "left"), Padding(multiple_of=8), Padding(batch=("even",), side="left")], ids=str)
@pytest.mark.parametrize("cut", [None, 12])
def test_assembly_equals_the_local_rows(docs, tok, padding, cut):
    if padding and padding.strategy == "max_length" and cut is None:
        pytest.skip("needs a length")
    rows = docs.where("text is not null").withColumn("even", F.col("id") % 2 == 0).withColumn("ids", columns.encode("text", tok.spec))
    got = {r.id: r for r in assemble(rows, tok.template, max_length=cut, padding=padding, special_tokens_mask=True).collect()}
    groups = [[i for i in range(len(ALL)) if i % 2 == k] for k in (0, 1)] if padding and padding.batch else [range(len(ALL))]
    for group in groups:
        want = tok.padded_rows([ALL[i] for i in group], cut=cut, pad=padding and padding.strategy, width=cut, multiple=padding and padding.multiple_of, side=padding.side if padding else "right")
        for k, i in enumerate(group):
            for name in want:
                assert got[i][name] == want[name][k], (i, name)


def test_frames(docs, tok, spark):
    out = tok.encode_frame(docs.where("text is not null"), max_length=9)
    shape = not_rectangular(out).first()
    assert shape.rows == len(ALL) and shape.width == shape.least == 9
    with pytest.raises(ValueError):
        tok.encode_frame(docs, padding="max_length")
    with pytest.raises(ValueError):
        tok.encode_frame(docs, max_length=1)
    assert tok.vocab_frame(spark).count() == tok.vocab_size


def test_distinct_words_and_lookups(docs, tok, spark):
    plain = docs.where("text is not null and not text like '%[%'")
    got = {}
    for r in distinct_words.encode_rows(plain, tok.spec, "id").orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.token_id)
    for r in plain.collect():
        assert got.get(r.id, []) == tok.runtime.encode(r.text)
    words = spark.createDataFrame([("[MASK]",), ("the",), ("nope-nope",)], "w string")
    assert {r.w: r.id for r in vocabulary.token_to_id(words, "w", tok.spec).collect()} == {"[MASK]": 4, "the": tok.token_to_id("the"), "nope-nope": None}
    with pytest.raises(ValueError):
        distinct_words.encode_rows(docs, Tokenizer.from_json(json.dumps(json.loads(tok.to_json()) | {"pre_tokenizer": None})).spec, "id")


@pytest.mark.parametrize("separator", ["<|endoftext|>", "\n\n", "\n", "abab", None])
@pytest.mark.parametrize("times", [1, 60])
def test_text_files(spark, tmp_path, tok, separator, times):
    parts = ["aaa\n", "bbb ab", "", "é中 x", "abababa c", "\n d"] * times
    held = (separator or "").join(parts) + (separator or "")
    (tmp_path / "a.txt").write_text(held, encoding="utf-8", newline="")
    (tmp_path / "b.txt").write_text("", encoding="utf-8")
    (tmp_path / "c.txt").write_text("last", encoding="utf-8")
    source = TextFiles([tmp_path / n for n in ("a.txt", "b.txt", "c.txt")], separator)
    want = held.split(separator) if separator else [held]
    want = want[:-1] if want[-1] == "" else want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b" if times > 1 else "128m")
    try:
        rows = read_documents(spark, source).orderBy("path", "doc_index").collect()
        ids = tok.encode_files(spark, source, add_special_tokens=False).orderBy("path", "doc_index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.text for r in rows] == [*want, "last"]
    assert [r.doc_index for r in rows] == [*range(len(want)), 0]
    assert [r.ids for r in ids] == [tok.runtime.encode(t) for t in [*want, "last"]]


def test_framing_and_bytes(spark, tmp_path):
    assert [has_border(s) for s in ("\n\n", "abab", "\n", "<|x|>")] == [True, True, False, False]
    one = spark.createDataFrame([("one\n\n\ntwo\n\nthree\n\n\n\nfour",)], "t string").select(framed("t", "\n\n").alias("x")).first().x
    assert one == ["one", "\ntwo", "three", "", "four"]
    raw = b"\xc3\xa9t\xc3\xa9 \xfe\xff spoilt \xe2\x82 part<|endoftext|>more \xc3"
    (tmp_path / "x").write_bytes(raw)
    for source, want in ((TextFiles(tmp_path / "x", b"<|endoftext|>"), raw.split(b"<|endoftext|>")), (tmp_path / "x", [raw])):
        assert [r.text for r in read_documents(spark, source).orderBy("doc_index").collect()] == [w.decode("utf-8", "replace") for w in want]
    assert spark.createDataFrame([(bytearray(raw),)], "b binary").select(lossy_utf8("b").alias("t")).first().t == raw.decode("utf-8", "replace")
    with pytest.raises(ValueError, match="No such file"):
        read_documents(spark, str(tmp_path / "nope.txt")).collect()
    with pytest.raises(ValueError):
        TextFiles("x", "")


def test_jsonl(spark, tmp_path):
    ship(spark)
    lines = []
    for i in range(120):
        lines.append(json.dumps(dict(meta={"n": [1, {"text": "no"}]}, text=f"é text {i}", id=i), ensure_ascii=i % 2 > 0))
        lines += ["   "] * (i % 40 == 3)
    (tmp_path / "a.jsonl").write_bytes("\r\n".join(lines).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900b")
    try:
        rows = read_documents(spark, JsonLines(tmp_path / "a.jsonl")).orderBy("doc_index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.doc_index, r.text) for r in rows] == [(i, f"é text {i}") for i in range(120)]
    assert extract_field('{"id": 1, "text": "a\\nb", "text": "c"}') == "a\nb"
    for bad, why in (('{"text": 3}', "invalid JSONL"), ('{"text": ', "invalid JSONL"), ('{"body": "x"}', "no string field"), ('{"text": "a"} x', "invalid JSONL"), ("[1]", "invalid JSONL"), (b'{"text": "\xff"}', "invalid JSONL"), ('{"text": NaN}', "invalid JSONL")):
        with pytest.raises(ValueError, match=why):
            extract_field(bad)
    df = spark.createDataFrame([('{"text": 3}',)], "l string")
    with pytest.raises(Exception, match="invalid JSONL"):
        df.select(extract_field_column("l")).collect()
    assert df.select(extract_field_column("l", strict=False).alias("x")).first().x == "3"


def test_documents_in_memory(spark):
    assert [r.text for r in documents(spark, ["a", b"\xff"]).orderBy("doc_index").collect()] == ["a", "�"]
    assert documents(spark, []).count() == 0
    with pytest.raises(TypeError):
        documents(spark, "a")


def test_streams(spark, tok, tmp_path):
    ship(spark)
    rows = [(i, f"the {'and ' * i}end", f"2024-01-01 00:0{i % 3}:10") for i in range(9)]
    spark.createDataFrame(rows, "id bigint, text string, at string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, text string, at string").parquet(str(tmp_path / "in")).withColumn("at", F.to_timestamp("at"))
    for name, df, mode in (("ids", encode_stream(stream, tok.spec, pad_to=8), "append"), ("rates", token_rates(stream, tok.spec, "at"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = by_id(spark.table("ids"), "input_ids")
    assert [got[i] for i in range(9)] == tok.encode_batch_padded([r[1] for r in rows], padding="max_length", max_length=8)["input_ids"].tolist()
    rates = {r.start.minute: (r.n_docs, r.n_tokens) for r in spark.table("rates").collect()}
    want = {m: (3, sum(len(tok.runtime.encode(r[1])) for r in rows if r[0] % 3 == m)) for m in range(3)}
    assert rates == want


def test_entry(spark):
    import __spark_entry__ as entry

    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 40
    assert entry.entry(spark).columns == ["lang", "n_docs", "n_tokens"]


def test_sql_functions(spark, docs, tok):
    tok.register(spark, "t_")
    docs.createOrReplaceTempView("texts")
    rows = spark.sql("SELECT id, text, t_encode(text) AS ids, t_count_tokens(text) AS n, t_tokenize(text) AS tokens, t_normalize_text(text) AS norm, t_decode(t_encode(text)) AS back FROM texts").collect()
    for r in rows:
        want = None if r.text is None else tok.runtime.encode(r.text)
        assert r.ids == want and (r.n is None if want is None else r.n == len(want))
        if want is not None:
            assert (r.tokens, r.norm, r.back) == (tok.tokenize(r.text), tok.runtime.normalize(r.text), tok.decode(want))
    one = spark.sql("SELECT id, pos, token_id, token FROM texts, LATERAL t_tokens(text) WHERE id < 9 OR id = 9999 ORDER BY id, pos").collect()
    assert [(r.id, r.pos, r.token_id, r.token) for r in one] == [(i, p, n, tok.id_to_token(n)) for i in range(9) for p, n in enumerate(tok.runtime.encode(ALL[i]))]


def test_longest_padding_reads_stored_ids(docs, tok):
    rows = docs.where("text is not null").withColumn("ids", columns.encode("text", tok.spec))
    plan = assemble(rows, tok.template, padding=Padding())._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan  # the texts are encoded once, into a stored table


@pytest.mark.parametrize("separator", ["\n\n", "\n\n\n", "=="])
def test_runs_of_one_character_are_read_in_splits(spark, tmp_path, separator):
    import random

    r, mark = random.Random(1), separator[0]
    held = {}
    for i in range(25):
        parts = [r.choice(["", mark, mark * 2, mark * 3, mark * 5, "a", "bc é", " x", "longer words here 中"]) for _ in range(r.randint(0, 60))]
        held[f"f{i:02d}"] = "".join(parts)
    held |= {"g0": "", "g1": mark, "g2": separator, "g3": separator + mark, "g4": "end" + mark, "g5": "end" + separator, "g6": separator * 3 + "x", "g7": "\ufeffbom" + separator + "x", "g8": mark * 400 + "z" + mark * 401}
    for name, text in held.items():
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    (tmp_path / "h0").write_bytes(b"\xc3" + separator.encode() + b"ok\xff")
    want = {}
    for name, text in [*held.items(), ("h0", "\ufffd" + separator + "ok\ufffd")]:
        parts = text.removeprefix("\ufeff").split(separator)
        want[name] = parts[:-1] if parts[-1] == "" else parts
    spark.conf.set("spark.sql.files.maxPartitionBytes", "37b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        df = read_documents(spark, TextFiles(tmp_path, separator))
        assert "binaryFile" not in df._jdf.queryExecution().toString()
        got = {}
        for x in df.orderBy("path", "doc_index").collect():
            got.setdefault(x.path.rsplit("/", 1)[1], []).append((x.doc_index, x.text))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, parts in want.items():
        assert got.get(name, []) == list(enumerate(parts)), name
