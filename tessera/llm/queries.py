"""The queries of this subpackage, over whole tables with production parameters, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._common import table

PIECES = "piece_bpe_32k.model"
WORDS = "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import assess

    return assess(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import group

    return group(table(spark, sf_dir, "documents"), width=4)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import read_store, store_uri, write_store

    uri = store_uri(spark)
    write_store(table(spark, sf_dir, "documents"), vocabulary(WORDS), uri)
    return read_store(spark, uri)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op6_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode

    return encode(table(spark, sf_dir, "documents"), vocabulary(PIECES))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary(PIECES))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(table(spark, sf_dir, "documents")).drop("found")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find

    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup

    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", found.line_dedup_n_lines.alias("n_lines"), found.line_dedup_n_recurring.alias("n_recurring"), found.line_dedup_n_dropped.alias("n_dropped"), "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_minhash_near_dedup, op3_license_scan, op4_token_store, op5_language_id, op6_sentencepiece_codec, op7_token_counts, op8_secret_scan, op9_benchmark_decontamination, op10_line_dedup)}


def _near_dedup_sql(width: int = 4, percent: int = 80) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + {width - 1}], ' ') FOR i IN range(1, len(ws) - {width - 2})]) END AS s FROM cut),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
held AS (SELECT doc_id, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM held a JOIN held b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= {percent} * (p.n + q.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.other)
SELECT doc_id, n AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM reached JOIN sizes USING (doc_id) GROUP BY doc_id, n"""


def _secrets_sql() -> str:
    from .secrets import BASE, RULES

    parts = []
    for rank, (kind, regex, least) in enumerate(RULES):
        r = "'" + regex.replace("'", "''") + "'"
        value = f"regexp_extract_all(t, {r}, {2 if least else 0})"
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, e - n AS s, e FROM (
  SELECT doc_id, length(m) AS n, length(v) AS k, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, {r}) AS ms, {value} AS vs, string_split_regex(t, {r}) AS gs FROM texts WHERE regexp_matches(t, {r}))))
WHERE k >= {least}""")
    found = "coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank){}, '')"
    base = " FILTER (WHERE kind IN (" + ", ".join(f"'{k}'" for k in BASE) + "))"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL '.join(parts)})
SELECT doc_id, {counts}, sha256({found.format(base)}) AS base_sha256, {found.format('')} AS spans FROM texts LEFT JOIN spans USING (doc_id) GROUP BY doc_id"""


SQL: dict[str, str] = {"op2_minhash_near_dedup": _near_dedup_sql(), "op8_secret_scan": _secrets_sql()}
