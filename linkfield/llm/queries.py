"""The registered queries of the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .embedding_dedup import near_duplicates
from .fingerprint import fingerprint_edits
from .hard_negatives import mine
from .html_wrapper import extract_main_text
from .line_dedup import MAX_RATIO, MIN_PAGES, drop_boilerplate_lines
from .mixing import mix_sources
from .ngram_join import jaccard_components
from .packing import pack_documents
from .secret_scan import scan_secrets
from .token_output import encode_and_read_back
from .toxicity import toxicity
from .url_filter import LOWER, UPPER, Rule, filter_urls
from .vector_codes import compress

URL_RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), "url", URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_epochs=3)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), capacity=2048, end_id=0)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read_back(table(spark, sf_dir, "documents"), end_id=1)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "n_lines", "n_dropped", "text")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


_ALL = (
    op1_url_filter, op2_source_mixing, op3_ngram_join, op4_embedding_dedup, op5_html_extraction, op6_fingerprints, op7_best_fit_packing,
    op8_token_output, op9_line_dedup, op10_toxicity, op11_hard_negatives, op12_vector_codes, op13_secret_scan,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"

OP1_SQL = f"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '{_URL}', 2), '') AS path FROM pages),
r(rhost, rpath, action) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.action}')" for r in URL_RULES)})
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(action, 'allow') AS verdict
FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) = 1
"""

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17') AS h FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM s),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (
  SELECT source, source_size, CASE WHEN level <= ratio THEN (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) * weight
         ELSE CAST(cap AS DOUBLE) END AS target FROM l),
p AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS prior
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       size * (whole + CASE WHEN CAST(2 * prior + size AS DOUBLE) <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END) AS taken,
       whole + CASE WHEN CAST(2 * prior + size AS DOUBLE) <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END AS repeats
FROM p
"""

OP9_SQL = f"""
WITH p AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
n AS (SELECT source, count(*) AS total FROM p GROUP BY source),
seen AS (SELECT source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x)))) AS line FROM p),
b AS (
  SELECT c.source, list(line) AS lines FROM (SELECT source, line, count(*) AS n FROM seen WHERE line <> '' GROUP BY source, line) c
  JOIN n ON n.source IS NOT DISTINCT FROM c.source WHERE c.n >= {MIN_PAGES} AND c.n > total * CAST({MAX_RATIO} AS DOUBLE) GROUP BY c.source),
d AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS ls,
         (SELECT any_value(lines) FROM b WHERE b.source IS NOT DISTINCT FROM documents.source) AS bad FROM documents),
k AS (SELECT *, CASE WHEN bad IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(bad, trim(x)) OR trim(x) = '') END AS kept FROM d)
SELECT doc_id, source, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped,
       CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text FROM k
"""

_WHOLE = """
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

OP11_SQL = f"""
WITH {_WHOLE},
l AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, q FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM l a JOIN l b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (
  SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND place <= 5 AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT * FROM n WHERE rank <= 5
"""


def _op12_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Rounds as common table expressions: c0 the first codebooks, a0 the first assignment, and so on."""
    out = f"""{_WHOLE},
x AS (SELECT vec_id, label, p, q[p * (len(q) // {parts}) + 1 : (p + 1) * (len(q) // {parts})] AS q FROM (SELECT *, unnest(range({parts})) AS p FROM v) w),
c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, q FROM x QUALIFY e < {entries})"""
    for r in range(rounds + 1):
        out += f""",
a{r} AS (
  SELECT x.vec_id, x.label, x.p, any_value(x.q) AS q, min(CAST(list_inner_product(x.q, x.q) - 2 * list_inner_product(x.q, c.q) + list_inner_product(c.q, c.q) AS BIGINT) * {entries} + c.e) AS best
  FROM x JOIN c{r} c ON c.p = x.p GROUP BY x.vec_id, x.label, x.p)"""
        if r < rounds:
            out += f""",
m{r} AS (SELECT p, best % {entries} AS e, i, floor(sum(q[i]) / count(*)) AS y FROM (SELECT *, unnest(range(1, len(q) + 1)) AS i FROM a{r}) u GROUP BY p, best % {entries}, i),
c{r + 1} AS (SELECT c.p, c.e, coalesce(n.q, c.q) AS q FROM c{r} c LEFT JOIN (SELECT p, e, list(y ORDER BY i) AS q FROM m{r} GROUP BY p, e) n ON n.p = c.p AND n.e = c.e)"""
    return f"""
WITH {out},
h AS (SELECT sha256(string_agg(array_to_string(list_transform(q, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}),
f AS (SELECT vec_id, label, string_agg(lpad(lower(hex(best % {entries})), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f CROSS JOIN h
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op2_source_mixing": OP2_SQL, "op9_line_dedup": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_vector_codes": _op12_sql()}
