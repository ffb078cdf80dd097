"""The engine's queries over the test tables, and the same results as SQL for DuckDB.

The SQL is a formulation of its own: normalizing with strip_accents, cutting with RE2 classes, and longest match by a
recursive table of distinct words over the vocabulary's VALUES. Its character classes hold for the Latin texts of these
tables; the tests have the rest of Unicode.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import columns
from tessera.operators import vocabulary
from tessera.operators.assemble import Padding, assemble, elements, exploded, row_ids
from tessera.plans import distinct_words
from tessera.plans.spec import Template, TokenizerSpec, room_for_content
from tessera.session import fresh_folder, ship, spread
from tessera.sources.definitions import definition_from_vocab
from tessera.sources.files import JsonLines, TextFiles, extract_field_column, framed, lossy_utf8, read_documents
from tessera.tokenizer import Tokenizer

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CAP = 16


@lru_cache(1)
def spec() -> TokenizerSpec:
    tokens = resources.files("tessera").joinpath("data/vocab.txt").read_text(encoding="utf-8").removesuffix("\n").split("\n")
    return TokenizerSpec(definition_from_vocab(tokens))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    found = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return spread(found) if name in ("documents", "pages") else found


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# the SQL side

_PUNCT = r"!-/:-@\[-`{-~"
_BERT = rf"[{_PUNCT}]|[^\s{_PUNCT}]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@lru_cache(1)
def _vocab_rows() -> str:
    return "vocab(token, id) AS (VALUES " + ", ".join(f"({_quoted(t)}, {i})" for t, i in spec().runtime.vocab().items()) + ")"


def _norm(text: str) -> str:
    return f"lower(strip_accents(translate({text}, chr(9) || chr(10) || chr(13), '   ')))"


def _pieces_sql(pattern: str) -> str:
    found = f"regexp_extract_all(text, {_quoted(pattern)})"
    return f"SELECT doc_id, pos - 1 AS pos, piece FROM (SELECT doc_id, unnest({found}) AS piece, generate_subscripts({found}, 1) AS pos FROM documents)"


def _tokens_sql(source: str, keys: str, text: str = "text") -> str:
    """WITH clause that ends with tokens(keys, pos, token_id): content ids in order."""
    longest = max(map(len, spec().runtime.vocab()))
    found = f"regexp_extract_all(n, {_quoted(_BERT)})"
    return f"""WITH RECURSIVE {_vocab_rows()},
norm AS (SELECT {keys}, {_norm(text)} AS n FROM {source}),
pieces AS (SELECT {keys}, unnest({found}) AS w, generate_subscripts({found}, 1) AS wat FROM norm),
words AS (SELECT DISTINCT w FROM pieces),
steps(w, pos, ids) AS (
  SELECT w, 1, CAST([] AS INTEGER[]) FROM words WHERE length(w) <= 100
  UNION ALL
  SELECT s.w, coalesce(CAST(s.pos + max(k) FILTER (WHERE v.id IS NOT NULL) AS INTEGER), 1000),
    CASE WHEN max(v.id) IS NULL THEN NULL ELSE list_append(any_value(s.ids), CAST(arg_max(v.id, k) FILTER (WHERE v.id IS NOT NULL) AS INTEGER)) END
  FROM steps s CROSS JOIN (SELECT unnest(range(1, {longest + 1})) AS k) LEFT JOIN vocab v
    ON v.token = CASE WHEN s.pos = 1 THEN '' ELSE '##' END || substr(s.w, s.pos, k)
  WHERE s.pos <= length(s.w) AND k <= length(s.w) - s.pos + 1
  GROUP BY s.w, s.pos),
done AS (SELECT w, ids FROM steps WHERE pos = length(w) + 1),
word_ids AS (SELECT w, coalesce(ids, [1]) AS ids FROM words LEFT JOIN done USING (w)),
cut AS (SELECT {keys}, wat, unnest(ids) AS token_id, generate_subscripts(ids, 1) AS part FROM pieces JOIN word_ids USING (w)),
tokens AS (SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY wat, part) - 1 AS BIGINT) AS pos, token_id FROM cut)"""


def _rows_sql(source: str, keys: str, cap: int | None = None, left: bool = False) -> str:
    """The same, and all(keys), sizes(keys, n) of the cut contents and rows(keys, pos, token_id, special) with [CLS] and
    [SEP], before padding."""
    limit = "" if cap is None else f"WHERE pos >= n - {cap}" if left else f"WHERE pos < {cap}"
    shift = f"pos - greatest(n - {cap}, 0)" if left and cap is not None else "pos"
    used = "n" if cap is None else f"least(n, {cap})"
    return f"""{_tokens_sql(source, keys)},
full_sizes AS (SELECT {keys}, count(token_id) AS n FROM {source} LEFT JOIN tokens USING ({keys}) GROUP BY {keys}),
sizes AS (SELECT {keys}, {used} AS n FROM full_sizes),
content AS (SELECT {keys}, {shift} + 1 AS pos, token_id, 0 AS special FROM tokens JOIN full_sizes USING ({keys}) {limit}),
rows_ AS (SELECT * FROM content UNION ALL SELECT {keys}, 0, 2, 1 FROM sizes UNION ALL SELECT {keys}, n + 1, 3, 1 FROM sizes)"""


# normalizing and cutting


@query(f"SELECT doc_id, {_norm('text')} AS norm FROM documents")
def normalize_bert(spark, folder):
    return table(spark, folder, "documents").select("doc_id", columns.normalize("text", spec()).alias("norm"))


def _normalized(*steps: str) -> Query:
    def run(spark, folder):
        other = TokenizerSpec(_with(normalizer={"type": "Sequence", "normalizers": [dict(type=t) for t in steps]}))
        return table(spark, folder, "documents").select("doc_id", columns.normalize("text", other).alias("norm"))

    return run


# the texts hold no characters that only compatibility forms change, and marks only in letters that NFD takes apart
for _name, _steps, _sql in [
    ("normalize_nfc", ["NFC"], "nfc_normalize(text)"),
    ("normalize_nfd_nfc", ["NFD", "NFC"], "nfc_normalize(text)"),
    ("normalize_lowercase", ["Lowercase"], "lower(text)"),
    ("normalize_nfd_strip", ["NFD", "StripAccents"], "strip_accents(text)"),
    ("normalize_nfkd_strip", ["NFKD", "StripAccents", "Lowercase"], "lower(strip_accents(text))"),
    ("normalize_nfkc_lower", ["NFKC", "Lowercase", "StripAccents"], "lower(nfc_normalize(text))"),
]:
    QUERIES[_name], SQL[_name] = _normalized(*_steps), f"SELECT doc_id, {_sql} AS norm FROM documents"


def _with(**parts) -> str:
    import json

    return json.dumps(json.loads(spec().text) | parts)


def _pieces(definition: dict) -> Query:
    def run(spark, folder):
        docs = table(spark, folder, "documents").select("doc_id", columns.pre_tokenize("text", definition, native=True).alias("pieces"))
        return exploded(docs, "pieces", ["doc_id"], "piece")

    return run


_WORD = r"[^\s!-/:-@\[-^`{-~]"
for _name, _definition, _pattern in [
    ("pre_bert", {"type": "BertPreTokenizer"}, _BERT),
    ("pre_whitespace", {"type": "WhitespaceSplit"}, r"\S+"),
    ("pre_word", {"type": "Whitespace"}, rf"{_WORD}+|[!-/:-@\[-^`{{-~]+"),
    ("pre_punct_isolated", {"type": "Punctuation"}, rf"[{_PUNCT}]|[^{_PUNCT}]+"),
    ("pre_punct_contiguous", {"type": "Punctuation", "behavior": "Contiguous"}, rf"[{_PUNCT}]+|[^{_PUNCT}]+"),
    ("pre_punct_removed", {"type": "Punctuation", "behavior": "Removed"}, rf"[^{_PUNCT}]+"),
    ("pre_digits_isolated", {"type": "Digits", "individual_digits": True}, "[0-9]|[^0-9]+"),
    ("pre_digits_contiguous", {"type": "Digits"}, "[0-9]+|[^0-9]+"),
    ("pre_sequence", {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "Digits"}]}, r"[0-9]+|[^\s0-9]+"),
]:
    QUERIES[_name], SQL[_name] = _pieces(_definition), _pieces_sql(_pattern)


@query(f"{_tokens_sql('documents', 'doc_id')} SELECT w AS word, array_to_string(ids, ' ') AS ids FROM word_ids")
def wordpiece_words(spark, folder):
    bare = TokenizerSpec(_with(normalizer=None, added_tokens=[]))
    pieces = columns.pre_tokenize(columns.normalize("text", spec()), {"type": "BertPreTokenizer"}, native=True)
    words = table(spark, folder, "documents").select(F.explode(pieces).alias("word")).distinct()
    return words.select("word", F.array_join(columns.encode("word", bare), " ").alias("ids"))


# ids


def _ids(**options) -> Column:
    t = spec().runtime.template
    room = room_for_content(t if options.get("special", True) else Template(), options.get("max_length"))
    return row_ids(columns.encode("text", spec(), room, options.get("truncation_side", "right")), t, **options)


@query(f"{_tokens_sql('documents', 'doc_id')} SELECT doc_id, pos, token_id FROM tokens")
def encode_ids(spark, folder):
    return exploded(table(spark, folder, "documents").select("doc_id", _ids(special=False).alias("ids")), "ids", ["doc_id"])


@query(f"{_rows_sql('documents', 'doc_id')} SELECT doc_id, pos, token_id FROM rows_")
def encode_ids_special(spark, folder):
    return exploded(table(spark, folder, "documents").select("doc_id", _ids().alias("ids")), "ids", ["doc_id"])


@query(f"{_tokens_sql('documents', 'doc_id')} SELECT doc_id, pos, token_id FROM tokens")
def encode_distinct_words(spark, folder):
    return distinct_words.encode_rows(table(spark, folder, "documents"), spec(), "doc_id")


@query(f"{_tokens_sql('documents', 'doc_id')} SELECT doc_id, pos, token FROM tokens JOIN vocab ON id = token_id")
def tokenize_pieces(spark, folder):
    return exploded(table(spark, folder, "documents").select("doc_id", columns.tokenize("text", spec()).alias("tokens")), "tokens", ["doc_id"], "token")


@query(f"{_tokens_sql('documents', 'doc_id')} SELECT doc_id, count(token_id) AS n_tokens FROM documents LEFT JOIN tokens USING (doc_id) GROUP BY doc_id")
def num_tokens(spark, folder):
    return table(spark, folder, "documents").select("doc_id", columns.count_tokens("text", spec()).alias("n_tokens"))


@query(f"{_tokens_sql('documents', 'doc_id')} SELECT lang, count(DISTINCT doc_id) AS n_docs, count(token_id) AS n_tokens FROM documents LEFT JOIN tokens USING (doc_id) GROUP BY lang")
def token_counts_by_lang(spark, folder):
    counted = table(spark, folder, "documents").select("lang", columns.count_tokens("text", spec()).alias("n"))
    return counted.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))


@query(f"{_rows_sql('documents', 'doc_id', CAP - 2)} SELECT doc_id, pos, token_id FROM rows_")
def truncate_right(spark, folder):
    return exploded(table(spark, folder, "documents").select("doc_id", _ids(max_length=CAP).alias("ids")), "ids", ["doc_id"])


@query(f"{_rows_sql('documents', 'doc_id', CAP - 2, left=True)} SELECT doc_id, pos, token_id FROM rows_")
def truncate_left(spark, folder):
    return exploded(table(spark, folder, "documents").select("doc_id", _ids(max_length=CAP, truncation_side="left").alias("ids")), "ids", ["doc_id"])


@query(f"{_tokens_sql('part', 'p_partkey', 'p_name')} SELECT p_partkey, pos, token_id FROM tokens")
def encode_part_names(spark, folder):
    return exploded(table(spark, folder, "part").select("p_partkey", columns.encode("p_name", spec()).alias("ids")), "ids", ["p_partkey"])


@query(f"{_tokens_sql('pages', 'page_id', 'html')} SELECT page_id, count(token_id) AS n_tokens FROM pages LEFT JOIN tokens USING (page_id) GROUP BY page_id")
def encode_pages(spark, folder):
    return table(spark, folder, "pages").select("page_id", columns.count_tokens("html", spec()).alias("n_tokens"))


# rows


def _batch(spark, folder, source="benchmark", **options) -> DataFrame:
    docs = table(spark, folder, source).withColumn("ids", columns.encode("text", spec()))
    return assemble(docs, spec().runtime.template, special_tokens_mask=True, **options)


def _padded_sql(width: str, value: str = "coalesce(token_id, 0)", cap: int | None = None, left: bool = False) -> str:
    place = "pos + (w - n - 2)" if left else "pos"
    return f"""{_rows_sql('benchmark', 'item_id', cap)},
wide AS (SELECT item_id, n, greatest(n + 2, {width}) AS w FROM sizes),
slots AS (SELECT item_id, unnest(range(w)) AS pos FROM wide),
held AS (SELECT item_id, {place} AS pos, token_id, special FROM rows_ JOIN wide USING (item_id))
SELECT item_id, CAST(pos AS BIGINT) AS pos, CAST({value} AS BIGINT) AS value FROM slots LEFT JOIN held USING (item_id, pos)"""


_LONGEST = "(SELECT max(n) + 2 FROM sizes)"


def _values(df: DataFrame, column: str = "input_ids") -> DataFrame:
    return exploded(df, column, ["item_id"], "value")


@query(_padded_sql(_LONGEST))
def pad_longest(spark, folder):
    return _values(_batch(spark, folder, padding=Padding()))


@query(_padded_sql("64"))
def pad_max(spark, folder):
    return _values(_batch(spark, folder, padding=Padding("max_length"), max_length=64, truncation=False))


@query(_padded_sql("(SELECT CAST(ceil((max(n) + 2) / 16.0) * 16 AS BIGINT) FROM sizes)"))
def pad_multiple(spark, folder):
    return _values(_batch(spark, folder, padding=Padding(multiple_of=16)))


@query(_padded_sql(str(CAP), cap=CAP - 2, left=True))
def pad_left(spark, folder):
    return _values(_batch(spark, folder, padding=Padding("max_length", side="left"), max_length=CAP))


@query(_padded_sql(_LONGEST, "CASE WHEN token_id IS NULL THEN 0 ELSE 1 END"))
def attention_mask(spark, folder):
    return _values(_batch(spark, folder, padding=Padding()), "attention_mask")


@query(_padded_sql(_LONGEST, "0"))
def token_type_ids(spark, folder):
    return _values(_batch(spark, folder, padding=Padding()), "token_type_ids")


@query(_padded_sql(_LONGEST, "coalesce(special, 1)"))
def special_tokens_mask(spark, folder):
    return _values(_batch(spark, folder, padding=Padding()), "special_tokens_mask")


@query(f"""{_rows_sql('conversations', 'conv_id, turn')}
SELECT conv_id, turn, CAST(max(n) OVER (PARTITION BY conv_id) + 2 AS BIGINT) AS width, CAST(max(n) OVER (PARTITION BY conv_id) - n AS BIGINT) AS n_pad FROM sizes""")
def pad_by_conversation(spark, folder):
    rows = _batch(spark, folder, "conversations", padding=Padding(batch=("conv_id",)))
    real = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x)
    width = F.size("input_ids").cast("bigint")
    return rows.select("conv_id", "turn", width.alias("width"), (width - real).alias("n_pad"))


# decoding and lookups

_REPLACED = "piece"
for _old, _new in ((" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" do not", " don't"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re")):
    _REPLACED = f"replace({_REPLACED}, {_quoted(_old)}, {_quoted(_new)})"


def _decode_sql(skip: bool) -> str:
    return f"""{_rows_sql('benchmark', 'item_id')},
named AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS k, token FROM rows_ JOIN vocab ON id = token_id {'WHERE special = 0 AND id <> 1' if skip else ''}),
parts AS (SELECT item_id, k, CASE WHEN k = 1 THEN token WHEN starts_with(token, '##') THEN substr(token, 3) ELSE ' ' || token END AS piece FROM named)
SELECT item_id, string_agg({_REPLACED}, '' ORDER BY k) AS text FROM parts GROUP BY item_id"""


@query(_decode_sql(False))
def decode(spark, folder):
    ids = table(spark, folder, "benchmark").select("item_id", _ids().alias("ids"))
    return ids.select("item_id", columns.decode("ids", spec()).alias("text"))


@query(_decode_sql(True))
def decode_skip_special(spark, folder):
    ids = table(spark, folder, "benchmark").select("item_id", _ids().alias("ids"))
    return ids.select("item_id", columns.decode("ids", spec(), skip_special_tokens=True).alias("text"))


@query(_decode_sql(True))
def decode_by_join(spark, folder):
    rows = exploded(table(spark, folder, "benchmark").select("item_id", _ids().alias("ids")), "ids", ["item_id"])
    return vocabulary.decoded(rows, ["item_id"], spec(), skip_special_tokens=True)


@query(f"{_tokens_sql('benchmark', 'item_id')} SELECT item_id, string_agg(token, ' ' ORDER BY pos) AS text FROM tokens JOIN vocab ON id = token_id GROUP BY item_id")
def decode_join(spark, folder):
    other = TokenizerSpec(_with(decoder=None))
    ids = table(spark, folder, "benchmark").select("item_id", columns.encode("text", spec()).alias("ids"))
    return ids.select("item_id", columns.decode("ids", other).alias("text"))


@query(f"WITH {_vocab_rows()} SELECT token, id FROM vocab")
def vocab(spark, folder):
    return vocabulary.vocabulary(spark, spec()).select("token", "id")


@query(f"WITH {_vocab_rows()}, words AS (SELECT DISTINCT lower(word) AS word FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part)) SELECT word, id FROM words LEFT JOIN vocab ON token = word")
def token_to_id(spark, folder):
    words = table(spark, folder, "part").select(F.explode(F.split("p_name", " ")).alias("word")).select(F.lower("word").alias("word")).distinct()
    return vocabulary.token_to_id(words, "word", spec())


@query(f"WITH {_vocab_rows()} SELECT doc_id, token FROM labels LEFT JOIN vocab ON id = doc_id")
def id_to_token(spark, folder):
    return vocabulary.id_to_token(table(spark, folder, "labels").select("doc_id"), "doc_id", spec()).select("doc_id", "token")


# documents


@query("""WITH cut AS (SELECT doc_id, string_split(text, ' ') AS parts FROM documents),
kinds AS (SELECT doc_id, unnest(parts) AS piece, generate_subscripts(parts, 1) AS k, len(parts) AS n FROM cut),
rows_ AS (SELECT doc_id, 2 * k - 2 AS pos, 'text' AS kind, piece FROM kinds WHERE piece <> '' UNION ALL SELECT doc_id, 2 * k - 1, 'token', '[MASK]' FROM kinds WHERE k < n)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS BIGINT) AS pos, kind, piece FROM rows_""")
def added_tokens_split(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", columns.added_token_segments(F.replace("text", F.lit(" "), F.lit("[MASK]")), spec()).alias("parts"))
    return docs.select("doc_id", F.posexplode(elements("parts")).alias("pos", "part")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "part.kind", "part.piece")


@query("SELECT doc_id, text FROM documents")
def jsonl_extract(spark, folder):
    lines = table(spark, folder, "documents").select("doc_id", F.to_json(F.struct("doc_id", "text", F.struct(F.lit("no").alias("text")).alias("meta"))).alias("line"))
    return lines.select("doc_id", extract_field_column("line", "text").alias("text"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def jsonl_extract_lenient(spark, folder):
    return table(spark, folder, "events").select("event_id", extract_field_column("props", "k", strict=False).alias("k"))


@query("""WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
rows_ AS (SELECT doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) AS k, len(parts) AS n FROM cut)
SELECT doc_id, k - 1 AS pos, text FROM rows_ WHERE k < n OR text <> ''""")
def text_separator_docs(spark, folder):
    return exploded(table(spark, folder, "documents").select("doc_id", framed("text", "\n").alias("parts")), "parts", ["doc_id"], "text")


@query("SELECT doc_id, text || chr(65533) AS text FROM documents")
def lossy_utf8_docs(spark, folder):
    spoilt = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))
    return table(spark, folder, "documents").select("doc_id", lossy_utf8(spoilt).alias("text"))


@query("SELECT doc_id, (SELECT count(*) FROM (SELECT unnest(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9_]+')) AS w) WHERE w = 'the') AS n_the FROM documents")
def added_tokens_single_word(spark, folder):
    """A token that is looked for in normalized texts, as a word of its own, with the blanks around it."""
    number = 1_000_000
    token = {"id": number, "content": "The", "single_word": True, "lstrip": True, "rstrip": True, "normalized": True, "special": False}
    other = TokenizerSpec(_with(added_tokens=[token]))
    ids = table(spark, folder, "documents").select("doc_id", columns.encode("text", other).alias("ids"))
    return ids.select("doc_id", F.size(F.filter("ids", lambda i: i == number)).cast("bigint").alias("n_the"))


# files: documents are written out and read back


def _marked(spark, folder, text: str | Column = "text") -> DataFrame:
    """Documents with their id in front."""
    return table(spark, folder, "documents").select(F.concat_ws(" ", F.col("doc_id").cast("string"), text).alias("text"))


def _unmarked(df: DataFrame) -> DataFrame:
    cut = F.split("text", " ", 2)
    return df.select(F.get(cut, F.lit(0)).try_cast("bigint").alias("doc_id"), F.get(cut, F.lit(1)).alias("text"))  # null if there was no text


@query("SELECT doc_id, text FROM documents")
def read_text_files(spark, folder):
    path, sep = fresh_folder(spark, "files"), "<|endoftext|>"
    _marked(spark, folder).write.option("lineSep", sep).text(path)
    return _unmarked(read_documents(spark, TextFiles(path, sep)))


@query("SELECT doc_id, regexp_replace(text, '\\n+', ' ', 'g') AS text FROM documents")
def read_text_files_bordered(spark, folder):
    path, sep = fresh_folder(spark, "files"), "\n\n"
    _marked(spark, folder, F.regexp_replace("text", r"\n+", " ")).write.option("lineSep", sep).text(path)
    return _unmarked(read_documents(spark, TextFiles(path, sep)))


@query("SELECT item_id, text || chr(10) AS text FROM benchmark")
def read_whole_files(spark, folder):
    path = fresh_folder(spark, "files")
    table(spark, folder, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    return read_documents(spark, path).select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("bigint").alias("item_id"), "text")


@query("SELECT doc_id, text FROM documents")
def read_jsonl_files(spark, folder):
    path = fresh_folder(spark, "files")
    _marked(spark, folder).select(F.lit(1).alias("other"), F.col("text").alias("body"), F.struct("text").alias("meta")).write.json(path)
    return _unmarked(read_documents(spark, JsonLines(path, "body")))


@query(f"{_rows_sql('documents', 'doc_id')} SELECT CAST(count(*) AS BIGINT) AS n_ids, CAST(sum(token_id) AS BIGINT) AS id_sum FROM rows_ GROUP BY doc_id")
def encode_files(spark, folder):
    """Ids of each document of JSON Lines files; the reader knows no doc_id, so a row tells a document by its ids alone."""
    path = fresh_folder(spark, "files")
    table(spark, folder, "documents").select(F.coalesce("text", F.lit("")).alias("text")).write.json(path)
    ids = Tokenizer(spec()).encode_files(spark, JsonLines(path)).select("ids")
    return ids.select(F.size("ids").cast("bigint").alias("n_ids"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"))


@query("WITH cut AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS w FROM documents) SELECT doc_id, count(*) AS n_chunks FROM cut GROUP BY doc_id")
def chunk_counts(spark, folder):
    """The chunks that texts are cut into before they are looked up."""
    return table(spark, folder, "documents").select("doc_id", F.size(distinct_words.chunks("text")).cast("bigint").alias("n_chunks")).where("n_chunks > 0")
