"""The corpus queries over the driver tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import (
    embedding_dedup, html, line_dedup, mixing, ngram_join, packing, periodic_runs, quality, secret_scan, sharding,
    token_counts, urls, vector_codes,
)
from tidemark.session import literal_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(folder).rstrip('/')}/{name}.parquet")


@query("op1_embedding_near_dedup")
def embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query("op2_url_filters", r"""
WITH rules(rhost, rpath, rverdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (
  SELECT page_id, url, CASE WHEN position('://' IN url) > 0
                       THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, url,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
judged AS (
  SELECT host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule,
         max_by(rverdict, length(rhost || rpath)) AS verdict
  FROM (SELECT DISTINCT host, path FROM split) JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path)
SELECT s.page_id, s.host, s.path, j.rule, coalesce(j.verdict, 'allow') AS verdict, s.url
FROM split s LEFT JOIN judged j ON s.host = j.host AND s.path = j.path
""")
def url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    rules = literal_rows(spark, URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict", "url")


@query("op3_sharding")
def sharded(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"))


@query("op4_secret_scans")
def secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    base = [kind for kind, *_ in secret_scan.BASE]

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of_kinds(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(of_kinds(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(listed(of_kinds(*base)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


@query("op5_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, folder, "documents"))


@query("op6_mixing")
def mixed(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    domains = mixing.label_domains(table(spark, folder, "labels"))
    return mixing.mix(documents.select("doc_id", "text"), domains, mixing.CLEAN_WEIGHTS, most=1.0).select(
        "doc_id", "n_tokens", *[f"p_{d}" for d in mixing.CLEAN_WEIGHTS], "rate", "copies"
    )


@query("op7_packing")
def packed(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    vocabulary = str(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack_documents(table(spark, folder, "documents"), vocabulary)


@query("op8_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_html_extraction")
def html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = html.extract_text(table(spark, folder, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op10_line_dedup")
def line_dedup_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.drop_later_lines(documents).select("doc_id", "n_removed", "text")


@query("op11_periodic_runs")
def found_runs(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return periodic_runs.find_runs(documents, text=periodic_runs.repeat_tails(documents))


@query("op12_token_counts")
def counted_tokens(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    model = str(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.count_tokens(table(spark, folder, "documents"), model, limit=4096)


_FOUR = "struct_pack(a := x[1], b := x[2], c := x[3], d := x[4])"
_DISTANCE = " + ".join(f"(s.x.{c} - b.x.{c}) * (s.x.{c} - b.x.{c})" for c in "abcd")


def _round(number: int) -> str:
    """The assignment under codebook ``number`` and the codebook after it, as two named queries."""
    return f"""
assigned{number} AS (
  SELECT s.vec_id, s.p, any_value(s.x) AS x, min(({_DISTANCE}) * 64 + b.e) AS best
  FROM split s JOIN book{number} b ON b.p = s.p GROUP BY s.vec_id, s.p),
book{number + 1} AS (
  SELECT b.p, b.e, CASE WHEN n IS NULL THEN b.x ELSE struct_pack({", ".join(
      f"{c} := CAST(floor(CAST({c} AS DOUBLE) / n) AS BIGINT)" for c in "abcd")}) END AS x
  FROM book{number} b LEFT JOIN (
    SELECT p, best % 64 AS e, count(*) AS n, {", ".join(f"sum(x.{c}) AS {c}" for c in "abcd")}
    FROM assigned{number} GROUP BY p, best % 64) m ON m.p = b.p AND m.e = b.e)"""


@query("op13_vector_codes", f"""
WITH kept AS (
  SELECT vec_id, label, [CAST(floor(CAST(c AS DOUBLE) * 256) AS BIGINT) FOR c IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
split AS (
  SELECT vec_id, p, {_FOUR} AS x
  FROM (SELECT vec_id, t.p, v[4 * t.p + 1:4 * t.p + 4] AS x FROM kept, range(16) t(p))),
book0 AS (
  SELECT p, e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM split) WHERE e < 64),
{_round(0)},
{_round(1)},
{_round(2)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code,
         CAST(sum(best // 64) AS BIGINT) AS error FROM assigned2 GROUP BY vec_id),
books AS (
  SELECT sha256(string_agg(concat_ws(',', x.a, x.b, x.c, x.d), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
       codebooks_sha256
FROM coded c JOIN kept k ON k.vec_id = c.vec_id CROSS JOIN books
""")
def vector_code_rows(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress_vectors(table(spark, folder, "embeddings"))


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
