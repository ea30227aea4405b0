"""The registered query of each document operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlake.llm.common import read_table, shared_dir


def op1_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlake.llm.webp import store_texts

    return store_texts(read_table(spark, sf_dir, "documents"), with_media=False)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlake.llm.quality import score_quality

    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlake.llm.toxicity import score_toxicity

    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlake.llm.maxent import score_documents

    return score_documents(read_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlake.llm.bpe import encode_documents

    return encode_documents(read_table(spark, sf_dir, "documents"), outputs=("ids_sha256", "decoded_sha256"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlake.llm.neardup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("group", "hash")


def op7_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlake.llm.simple8b import read_tokens, write_tokens

    path = shared_dir(spark)
    write_tokens(read_table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlake.llm.secrets import scan_secrets, spans_text

    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlake.llm.licenses import scan_licenses

    return scan_licenses(read_table(spark, sf_dir, "documents")).drop("detections")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlake.llm.decontaminate import scan_documents

    found = scan_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.col("n_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_items") >= 2).alias("contaminated"),
    )


QUERIES = {f.__name__: f for f in (op1_webp, op2_quality, op3_toxicity, op4_maxent, op5_bpe, op6_neardup, op7_simple8b, op8_secrets, op9_licenses, op10_decontaminate)}
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_CHUNKS = rf"regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op6_neardup": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_CHUNKS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + k - 1], ' ') AS shingle FROM
  (SELECT doc_id, ws, least(5, len(ws)) AS k, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 75 * (x.n + y.n - inter)),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d JOIN c ON d.doc_id = c.doc_id LEFT JOIN n ON d.doc_id = n.doc_id""",
    "op10_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM
  (SELECT item_id, ws, least(8, len(ws)) AS n, unnest(range(1, len(ws) - least(8, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win FROM
  (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN found ON d.doc_id = found.doc_id""",
}
