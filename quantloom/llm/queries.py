"""Registered queries of the training-data operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from quantloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.packing import packed_documents

    return packed_documents(table(spark, sf_dir, "documents"))


@query
def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.mixing import mixture

    return mixture(table(spark, sf_dir, "documents"))


@query
def op3_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).drop("target_uri")


ORACLE["op3_warc_normaliser"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS digest FROM p),
     f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN d.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id > f.first THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.digest = f.digest
"""

#: Contract: one further conversation whose texts are control strings.
CONTROL_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.chat import read_back, written

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string")
    return read_back(written(rows.union(extra))).drop("n_tokens")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat earlier ones; removed_lines has unit:start+length of each in the original."""
    from quantloom.llm.line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents"))
    told = F.array_join(F.transform("removed", lambda x: F.concat(x.unit_no, F.lit(":"), x.start, F.lit("+"), x.n_chars)), ",")
    return out.select("doc_id", "n_removed", "chars_removed", told.alias("removed_lines"), "text")


ORACLE["op6_line_dedup"] = r"""
WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
     n AS (SELECT doc_id, text, parts, unnest(range(1, len(parts) + 1)) AS i FROM l),
     u AS (SELECT doc_id, text, i - 1 AS unit_no, parts[i] AS line, length(parts[i]) AS n_chars,
                  CAST(sum(length(parts[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(parts[i]) - 1 AS BIGINT) AS start,
                  trim(regexp_replace(translate(parts[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+', ' ', 'g')) AS plain
           FROM n),
     r AS (SELECT *, plain <> '' AND row_number() OVER (PARTITION BY plain ORDER BY doc_id, unit_no) > 1 AS gone FROM u)
SELECT doc_id, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed, CAST(coalesce(sum(n_chars) FILTER (WHERE gone), 0) AS BIGINT) AS chars_removed,
       coalesce(string_agg(unit_no || ':' || start || '+' || n_chars, ',' ORDER BY unit_no) FILTER (WHERE gone), '') AS removed_lines,
       CASE WHEN any_value(text) IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY unit_no) FILTER (WHERE NOT gone), '') END AS text
FROM r GROUP BY doc_id
"""


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.suffix_dedup import STAGE_WORDS, suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"), with_text=True, words=STAGE_WORDS)


@query
def op2_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"), unit=128, short=256)


@query
def op7_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.search import top_documents

    docs = table(spark, sf_dir, "documents")
    return top_documents(docs, docs.where("doc_id % 100 = 0"))


ORACLE["op7_bm25_search"] = r"""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS term
           FROM documents WHERE doc_id IS NOT NULL),
     tf AS (SELECT doc_id, term, count(*) AS n FROM w GROUP BY doc_id, term),
     dl AS (SELECT doc_id, sum(n) AS size FROM tf GROUP BY doc_id),
     st AS (SELECT (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS total, (SELECT sum(size) FROM dl) AS words),
     df AS (SELECT term, count(*) AS n FROM tf GROUP BY term),
     p AS (SELECT q.doc_id AS query_id, d.doc_id,
                  sum(CAST(floor(1000000 * (ln(1 + (st.total - df.n + 0.5::DOUBLE) / (df.n + 0.5::DOUBLE)) * (d.n * 2.2::DOUBLE / (d.n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (dl.size / (st.words / st.total::DOUBLE)))))) + 0.5::DOUBLE) AS BIGINT)) AS points
           FROM tf q JOIN tf d ON q.term = d.term AND q.doc_id <> d.doc_id JOIN df ON df.term = q.term JOIN dl ON dl.doc_id = d.doc_id, st
           WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, d.doc_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, doc_id) AS rank FROM p WHERE points > 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, points / 1000000.0::DOUBLE AS score FROM r WHERE rank <= 10
"""


@query
def op11_bloom_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.bloom_lines import line_dedup_bloom

    out = line_dedup_bloom(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE["op11_bloom_line_dedup"] = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
     n AS (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM l),
     u AS (SELECT doc_id, i, parts[i] AS line, trim(translate(parts[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM n),
     f AS (SELECT k, min(doc_id) AS first FROM u WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE doc_id > first) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE first IS NULL OR doc_id = first), '')) AS kept_sha256
FROM u LEFT JOIN f ON u.k = f.k GROUP BY doc_id
"""


def damaged(rows: DataFrame) -> DataFrame:
    """Contract: the conversations with a tenth or so of their rows damaged, and copies, how often a row stands."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    way = F.crc32(name.cast("binary")) % 20
    changed = F.when(way == 1, "").when(way == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(way == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" ")))
    return rows.where(way != 0).select("conv_id", "turn", role.alias("role"), changed.alias("text"), F.when(way == 3, 2).otherwise(1).alias("copies"))


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.repair import repaired

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repaired(damaged(rows), rows).drop("rows")


def planted_run(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Contract: a tenth of the documents repeat a stretch of words to their end. Null ids: none."""
    h, n = 1 if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.runs import periodic_runs, runs_digest

    out = periodic_runs(table(spark, sf_dir, "documents"), planted_run)
    top = ("start", "length", "period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"top.{x}").alias(x) for x in top),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"), runs_digest().alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
