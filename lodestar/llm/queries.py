"""The queries of this subpackage: opN_<name> for each operator, the pipeline, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, license_scan, line_dedup, media, merkle, packing, periodic_runs, quality, secret_scan, simhash, substring_dedup, token_counts, toxicity
from .common import table


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and licence templates of every document. score: 1 - 2^-(number of distinct labels)."""
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    base, starts = F.col("base_places.label"), F.col("base_places.start")
    labels = F.array_sort(F.array_distinct(F.concat(base, F.col("matches.label"))))
    return found.select(
        "doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), (F.lit(1.0) - F.pow(F.lit(0.5), F.size(labels))).alias("score"),
    )


def op2_sql() -> str:
    phrases = list(license_scan.BASE_PHRASES.items())
    regexes: dict[str, list[str]] = {}
    for label, markup in license_scan.TEMPLATES:
        regexes.setdefault(label, []).append(license_scan.TokenAutomaton(label, markup).regex())
    places = " UNION ALL ".join(f"SELECT doc_id, rid, i - 1 AS start, '{label}' AS label FROM places WHERE " + " AND ".join(f"w[i + {k}] = '{w}'" for k, w in enumerate(p.split())) for p, label in phrases)
    kinds = " UNION ALL ".join(f"SELECT rid, '{label}' AS label FROM words WHERE regexp_matches(norm, '{' | '.join(' (?:' + x + ')' for x in xs).replace(' | ', '|')}')" for label, xs in regexes.items())
    return f"""
WITH words AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS norm FROM (SELECT doc_id, row_number() OVER () AS rid,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents)),
places AS (SELECT doc_id, rid, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE {" OR ".join(f"norm LIKE '% {p} %'" for p, _ in phrases)}),
base AS ({places}),
b AS (SELECT rid, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY rid),
l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, count(DISTINCT label) AS n FROM (SELECT rid, label FROM base UNION ALL {kinds}) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, 1.0::DOUBLE - pow(0.5::DOUBLE, coalesce(n, 0)) AS score
FROM words LEFT JOIN b USING (rid) LEFT JOIN l USING (rid)"""


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the chain's categories; predicted: 1 if the last one, toxic, is 0.5 or more."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "abusive", "severe", F.col("toxic").alias("score"), (F.col("toxic") >= 0.5).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply_keep_bitmaps(docs, line_dedup.line_keep_bitmaps(docs), counts=("n_lines", "n_dropped"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = """
WITH docs AS (SELECT doc_id, row_number() OVER () AS rid, str_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, rid, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
d AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, coalesce(k.doc_id <> d.keeper, false) AS gone FROM k LEFT JOIN d USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = substring_dedup.without_repeats(docs, substring_dedup.repeated_pieces(docs))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = """
WITH docs AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, rid, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM docs)),
least AS (SELECT md5(k) AS k, min(doc_id) AS least FROM win GROUP BY 1),
cov AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS i FROM win JOIN least ON md5(win.k) = least.k WHERE least < doc_id),
gone AS (SELECT rid, list(i) AS g, count(*) AS n FROM cov GROUP BY rid),
kept AS (SELECT docs.rid, string_agg(word, ' ' ORDER BY i) AS t FROM (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs) docs ANTI JOIN cov USING (rid, i) GROUP BY docs.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM docs LEFT JOIN gone USING (rid) LEFT JOIN kept USING (rid)"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked (document, item) pairs."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > 512)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(secret_scan.told("base").cast("binary"), 256).alias("base_sha256"), secret_scan.told("found").alias("spans"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered())


def op12_sql(levels: int = 12, tops: int = 6) -> str:
    """Trees of up to 8^levels leaves and 8^tops trees; a CTE for each level's nodes, siblings and folded digests."""

    def enc(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def climb(p: str, n: int) -> str:
        """From {p}_n0 (tree, i, d) and {p}_f0 (tree, i, cur, proof, rest): {p}_n<n> and {p}_f<n>."""
        out = ""
        for k in range(n):
            run = "OVER (PARTITION BY tree, i // 8 ORDER BY i ROWS BETWEEN"
            out += f"""
{p}_s{k} AS MATERIALIZED (SELECT tree, i, d, count(*) OVER (PARTITION BY tree) > 1 AS more, coalesce(string_agg(d, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS bef, coalesce(string_agg(d, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS aft FROM {p}_n{k}),
{p}_n{k + 1} AS MATERIALIZED (SELECT tree, i // 8 AS i, CASE WHEN bool_or(more) THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d FROM {p}_s{k} GROUP BY tree, i // 8),
{p}_f{k + 1} AS MATERIALIZED (SELECT f.tree, f.i // 8 AS i, rid, CASE WHEN more THEN sha256(bef || cur || aft) ELSE cur END AS cur, CASE WHEN more THEN proof || bef || aft ELSE proof END AS proof FROM {p}_f{k} f JOIN {p}_s{k} USING (tree, i)),"""
        return out

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii((doc_id::VARCHAR)[k])::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda e, _: xor(e >> 1, 3988292384::BIGINT * (e & 1))))"
    head = " || ".join(enc(c) for c in merkle.FIELDS[:-1])
    return f"""
WITH docs AS (SELECT *, row_number() OVER () AS rid, CASE WHEN coalesce(xor({crc}, 4294967295) % 3 = 0, false) THEN {lower} ELSE text END AS later FROM documents),
hashed AS (SELECT rid, doc_id, coalesce('1' || lang, '0') AS tree, sha256({head} || {enc("text")}) AS leaf, sha256({head} || {enc("later")}) AS later FROM docs),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed),
a_n0 AS (SELECT tree, i, leaf AS d FROM leaves), a_f0 AS (SELECT tree, i, rid, later AS cur, '' AS proof FROM leaves),{climb("a", levels)}
t_n0 AS MATERIALIZED (SELECT '' AS tree, tree AS rid, d, row_number() OVER (ORDER BY tree) - 1 AS i FROM a_n{levels}),
t_f0 AS (SELECT t.tree, t.i, f.rid, cur, proof FROM a_f{levels} f JOIN t_n0 t ON f.tree = t.rid),{climb("t", tops)}
done AS (SELECT rid, cur, proof FROM t_f{tops})
SELECT doc_id, leaf, s.d AS subroot, r.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = r.d AS verified
FROM leaves JOIN done USING (rid) JOIN a_n{levels} s USING (tree) CROSS JOIN t_n{tops} r"""


def _periodic_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """The words to put in a document's places: a tail with a period, for ids whose CRC-32 in decimal ends in 0."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null ids keep their words in order."""
    found = periodic_runs.find_runs(table(spark, sf_dir, "documents"), reorder=_periodic_tail).withColumn("best", periodic_runs.longest_run())
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(F.try_divide(length * 1000, period)).cast("long").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_media_chunks": op1_media_chunks, "op2_license_scan": op2_license_scan, "op3_packing": op3_packing, "op4_toxicity_chain": op4_toxicity_chain, "op5_quality": op5_quality, "op6_line_dedup": op6_line_dedup, "op7_substring_dedup": op7_substring_dedup, "op8_decontamination": op8_decontamination, "op9_token_counts": op9_token_counts, "op10_simhash": op10_simhash, "op11_secret_scan": op11_secret_scan, "op12_merkle_manifest": op12_merkle_manifest, "op13_periodic_runs": op13_periodic_runs}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": op2_sql(), "op6_line_dedup": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op12_merkle_manifest": op12_sql()}
