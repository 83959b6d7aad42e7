"""The registered queries of the operators, one for each, over whole tables with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, language, mixing, multiset, quality, repeats, simhash, urls, warc
from .common import new_path, own_columns, table

#: Folder of the public vocabularies, a parameter of whoever runs the queries; by default that of ``public_tokenizers``.
TOKENIZERS = os.environ.get("TOKENIZERS")

#: (host, path, verdict)
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def vocabulary(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers  # only where no folder is given

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"), 400)


def op2_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.compare(table(spark, sf_dir, "documents"))


def op3_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shares = mixing.tempered(docs.groupBy("source").agg(F.count("*").alias("n")))
    return mixing.mixed(own_columns(docs, ["doc_id", "source"]), shares).select("doc_id", "source", "slot_time", "position")


def op4_token_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op5_url_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judged(table(spark, sf_dir, "pages"), rules)


def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(language.sample(docs))
    held_out = F.coalesce(language.fold(F.col("doc_id")) == 0, F.lit(False))
    found = language.identify(own_columns(docs, ["doc_id", "text"]), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.captures(warc.assemble(warc.read(spark, path))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri")


def op9_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_dedup, op2_multiset_fingerprints, op3_pfair_mixing, op4_token_fertility, op5_url_ranges, op6_bpe_automaton, op7_crf_language, op8_warc_captures, op9_simhash_anchors, op10_html_text)}

ORACLE_SQL = {
    "op1_suffix_dedup": """
WITH d AS (
  SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents
), w AS (
  SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 800)) AS m FROM (SELECT doc_id, h, unnest(range(n - 399)) AS i FROM d WHERE n >= 400)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS c FROM w) WHERE c > 1
), f AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM r
), g AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f
), s AS (
  SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY doc_id, run
), p AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM s GROUP BY doc_id
), k AS (
  SELECT doc_id, n, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    CASE WHEN n_spans IS NULL THEN [h] ELSE list_transform(range(n_spans + 1), lambda j: substr(h, CAST(2 * (CASE WHEN j = 0 THEN 0 ELSE ends[j] END) + 1 AS BIGINT), CAST(2 * ((CASE WHEN j = n_spans THEN n ELSE starts[j + 1] END) - (CASE WHEN j = 0 THEN 0 ELSE ends[j] END)) AS BIGINT))) END AS kept
  FROM d LEFT JOIN p USING (doc_id)
)
SELECT doc_id, n AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(array_to_string(kept, ''))) AS kept_sha256,
  decode(unhex(array_to_string(list_transform(kept, lambda x: regexp_replace(regexp_replace(x, '^([89AB][0-9A-F])+', ''), '([CD][0-9A-F]|E[0-9A-F]([89AB][0-9A-F])?|F[0-9A-F]([89AB][0-9A-F]){0,2})$', '')), ''))) AS text FROM k
""",
    "op3_pfair_mixing": """
WITH RECURSIVE supply AS (
  SELECT source, n, share, CAST(ceil(n / share) AS BIGINT) AS frames FROM (
    SELECT source, n, CAST(greatest(1, round(1000 * pow(n, 0.5) / sum(pow(n, 0.5)) OVER ())) AS BIGINT) AS share
    FROM (SELECT source, count(*) AS n FROM documents GROUP BY source))
), ends AS (
  SELECT until, coalesce(lag(until) OVER (ORDER BY until), 0) AS since, row_number() OVER (ORDER BY until) AS phase FROM (SELECT DISTINCT frames AS until FROM supply)
), active AS (
  SELECT phase, since, until, source, share, sum(share) OVER (PARTITION BY phase) AS frame,
         CASE WHEN frames = until THEN frames * share - n ELSE 0 END AS missing FROM ends JOIN supply ON frames >= until
), phases AS (
  SELECT phase, since, any_value(frame) AS frame, coalesce(sum((until - since) * any_value(frame)) OVER w, 0) AS slots_before,
         coalesce(sum((until - since) * any_value(frame) - sum(missing)) OVER w, 0) AS rows_before
  FROM active GROUP BY phase, since, until WINDOW w AS (ORDER BY phase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), sim AS (
  SELECT phase, source, share, frame, CAST(-1 AS BIGINT) AS t, CAST(0 AS BIGINT) AS used, false AS picked FROM active
  UNION ALL
  SELECT phase, source, share, frame, t, used + CAST(first AS BIGINT), first FROM (
    SELECT *, NOT shut AND row_number() OVER (PARTITION BY phase ORDER BY shut, deadline, source NULLS FIRST) = 1 AS first FROM (
      SELECT phase, source, share, frame, t + 1 AS t, used, used >= share OR (used * frame) // share > t + 1 AS shut, -((-(used + 1) * frame) // share) AS deadline FROM sim WHERE t + 1 < frame))
), slots AS (
  SELECT phase, source, t AS slot, used AS j FROM sim WHERE picked
), numbered AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents
), placed AS (
  SELECT d.doc_id, d.source, k, (k - 1) // share AS f, k - (k - 1) // share * share AS j FROM numbered d JOIN supply s ON d.source IS NOT DISTINCT FROM s.source
), timed AS (
  SELECT doc_id, p.source, k, f, slot, slots_before + (f - since) * frame + slot AS slot_time, rows_before + (f - since) * frame AS before
  FROM placed p JOIN slots s ON p.source IS NOT DISTINCT FROM s.source AND p.j = s.j JOIN phases h ON s.phase = h.phase
  WHERE s.phase = (SELECT min(phase) FROM ends WHERE until > p.f)
)
SELECT doc_id, source, CAST(slot_time AS BIGINT) AS slot_time, CAST(before + row_number() OVER (PARTITION BY f ORDER BY slot, k) AS BIGINT) AS position FROM timed
""",
    "op5_url_ranges": """
WITH split AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM split
), parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts
), rules(h, p, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN best USING (host, path)
""",
    "op8_warc_captures": """
WITH p AS (
  SELECT page_id, url, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS sha FROM pages
), f AS (
  SELECT sha, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY sha
)
SELECT page_id, n AS payload_bytes, sha AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to, url AS uri
FROM p LEFT JOIN f USING (sha)
""",
}
