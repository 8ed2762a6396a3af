"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import cws, licenses, lines, lm_score, mixing, packing, quality, simhash, spans, urls


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins over all documents."""
    return packing.pack(_docs(spark, sf_dir))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix's plan over all documents."""
    return mixing.mix_plan(_docs(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents, in the contract's columns."""
    found = simhash.near_groups(_docs(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' verdicts on all documents."""
    return quality.judge(_docs(spark, sf_dir))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of all documents, with a digest of what is kept."""
    kept = lines.dedup_lines(_docs(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return cws.fingerprints(_docs(spark, sf_dir))


def op4_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated runs of sentences."""
    return spans.dedup_spans(_docs(spark, sf_dir).select("doc_id", "text"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License templates found in all documents."""
    return licenses.scan(_docs(spark, sf_dir))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose number its path carries; bad is low quality or toxic."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("shown"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    shown = pages.select("url", urls.document_number(F.col("url")).alias("shown"))
    return urls.judge(pages, shown.join(labels, "shown").select("url", "bad"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return lm_score.score(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_lm_score": op2_lm_score,
    "op3_mix": op3_mix,
    "op4_spans": op4_spans,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_licenses": op7_licenses,
    "op8_urls": op8_urls,
    "op9_lines": op9_lines,
    "op10_fingerprint": op10_fingerprint,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL: dict[str, str] = {
    "op3_mix": f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(coalesce(text, '')) AS tie,
         -ln((CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)
         / CASE WHEN length(text) > 0 THEN greatest(0.1, CAST(length(translate(text, '{mixing.NOISE}', '')) AS DOUBLE) / length(text)) ELSE 0.1 END AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w, sum(source_size) OVER () AS total FROM s),
c AS (SELECT a.*, (SELECT max((b.total - coalesce((SELECT sum(3 * x.source_size) FROM r x WHERE 3.0 * x.source_size / x.w < 3.0 * b.source_size / b.w), 0))::DOUBLE
        / (SELECT sum(y.w) FROM r y WHERE 3.0 * y.source_size / y.w >= 3.0 * b.source_size / b.w))
        FROM r b) AS level FROM r a),
g AS (SELECT source, source_size, least(3.0 * source_size, level * w)::DOUBLE AS target FROM c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-9) AS BIGINT) ELSE 0 END AS epochs FROM g),
q AS (SELECT d.*, e.source_size, e.target, e.epochs, greatest(0, e.target - e.epochs * e.source_size) AS rest,
        sum(size) OVER (PARTITION BY d.source ORDER BY k, tie) AS reach
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN reach <= rest OR (reach - size < rest AND reach - rest < rest - (reach - size)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM q""",
    "op6_quality": f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS ws FROM t),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
v AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM f) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT s) AS n FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS s FROM t) WHERE regexp_matches(s, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
b AS (SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(x) - length(translate(x, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
        CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN v ON v.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id),
j AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
        10 * n_symbols > n_words OR 10 * n_dup_lines > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS strict_failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS bad FROM j GROUP BY source),
p AS (SELECT sum(bad) / sum(n) AS m, var_pop(bad / n) AS s FROM h),
k AS (SELECT m, CASE WHEN s > 0 THEN least(1e6, greatest(1.0, m * (1 - m) / s - 1)) ELSE 1e6 END AS z FROM p),
y AS (SELECT source, (bad + m * z) / (n + z) > m + {quality.HOST_SPREADS} * sqrt(m * (1 - m) / (z + 1)) AS rejected FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (rejected AND strict_failed) AS kept
FROM j JOIN y ON j.source IS NOT DISTINCT FROM y.source""",
    "op9_lines": f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], {_WHITE}), '{_UPPER}', '{_LOWER}') AS k
      FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM t)),
f AS (SELECT k, max(doc_id) AS owner FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, f.k IS NOT NULL AND l.doc_id <> f.owner AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
}
