"""The queries of the numbered operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import beside
from . import chat, decontaminate, dual_tree, forest, html_text, interpolated_lm, lattice, packing, path_templates, quality_ratio, token_files, weak_toxicity, whitening
from .base import SMALL_BATCHES, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register the function, run with batches of bounded bytes."""
    QUERIES[run.__name__] = wraps(run)(lambda spark, folder: run(beside(spark, SMALL_BATCHES), folder))
    return run


_ODD = r"\### Assistant: </turn> ok"


def _escaped(column: str) -> str:
    return rf"replace(replace(replace({column}, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>')"


SQL["op1_chat_windows"] = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{_ODD}' UNION ALL SELECT -7, 1, 'assistant', '{_ODD}'),
s AS (SELECT *, length({_escaped('role')}) + length({_escaped('text')}) + 17 AS chars FROM c),
t AS (SELECT *, (chars + 3) // 4 AS tokens FROM s),
p AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS stop, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AND role = 'system' AS sys FROM t),
q AS (SELECT *, sum(tokens) OVER c AS total, max(CASE WHEN sys THEN tokens ELSE 0 END) OVER c AS fixed FROM p WINDOW c AS (PARTITION BY conv_id)),
r AS (SELECT *, CASE WHEN total > 4096 THEN greatest(4096 - fixed, 0) - least(512, greatest(4096 - fixed, 0) // 8) END AS space FROM q),
a AS (SELECT *, coalesce(CAST(tokens > space // 4 AS BIGINT), 0) AS alone, CASE WHEN space IS NULL THEN 0 ELSE (stop - 1) // greatest(space - space // 4, 1) END AS cell FROM r),
w AS (SELECT *, cell + 2 * sum(alone) OVER (PARTITION BY conv_id ORDER BY turn) - alone AS win FROM a),
v AS (SELECT conv_id, win, max(stop) AS last, lead(max(stop) - min(stop - tokens)) OVER (PARTITION BY conv_id ORDER BY win) AS coming FROM w GROUP BY conv_id, win),
l AS (SELECT w.*, last, coming, least(512, 4096 - fixed - coming) AS room FROM w JOIN v ON w.conv_id = v.conv_id AND w.win = v.win)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
       CAST(sum(chars) + sum(CASE WHEN coming IS NOT NULL AND last - (stop - tokens) <= room AND NOT sys THEN chars ELSE 0 END)
            + sum(CASE WHEN sys THEN chars ELSE 0 END) * (count(DISTINCT win) - 1) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id"""


@query
def op1_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    odd = spark.createDataFrame([(-7, 0, "user", _ODD), (-7, 1, "assistant", _ODD)], "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    return chat.conversation_digests(chat.format_windows(rows))


@query
def op2_line_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


@query
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.read_documents(token_files.write_ids(table(spark, folder, "documents")))


@query
def op4_quality_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return quality_ratio.judge(table(spark, folder, "documents"), table(spark, folder, "labels").filter("quality = 1"))


@query
def op5_lsh_forest(spark: SparkSession, folder: str) -> DataFrame:
    return forest.duplicate_components(table(spark, folder, "documents"), shingle=4)


@query
def op6_deleted_interpolation(spark: SparkSession, folder: str) -> DataFrame:
    return interpolated_lm.score_texts(table(spark, folder, "documents"), order=3)


@query
def op7_weak_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return weak_toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op8_path_templates(spark: SparkSession, folder: str) -> DataFrame:
    allow = [("org", "/"), ("com", "/fr/")]
    block = [("example.org", "/es/"), ("example.org", "/en/1"), ("com", "/de/")]
    return path_templates.judge_urls(table(spark, folder, "pages"), allow, block)


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL["op9_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS s
        FROM (SELECT item, w, least(len(w), 13) AS k, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
spot AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT doc_id, spot.k, i, item FROM spot JOIN win ON spot.s = win.s AND spot.k = win.k),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""


@query
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


@query
def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

SQL["op11_dual_tree"] = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
total AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS length FROM d WHERE len(t) > 0),
b AS (SELECT item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, docs),
m AS (SELECT doc_id, 100 - 50 + ((50 * len(t) * docs) // length) AS m FROM d, total),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM b JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""


@query
def op11_dual_tree(spark: SparkSession, folder: str) -> DataFrame:
    return dual_tree.ranked_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op12_jacobi_davidson(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


@query
def op13_lattice_hashing(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.linked_vectors(table(spark, folder, "embeddings"))
