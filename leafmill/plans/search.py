"""Search queries: benchmark items are queries, documents segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import search
from leafmill.plans._base import query, table
from leafmill.scratch import Tables

INDEX = r"""
tok AS (SELECT doc_id, source, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS token FROM documents),
size AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS size FROM documents),
post AS (SELECT token, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS token FROM benchmark),
df AS (SELECT token, count(*) AS df FROM post GROUP BY 1), st AS (SELECT count(*) AS docs, avg(size) AS mean FROM size)
"""
#: The same without diacritics.
FOLDED = INDEX.replace("lower(text)", "strip_accents(lower(text))")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", "text")


def index(spark: SparkSession, docs: DataFrame, key: str, tokenizer: str = "words", owner: str | None = None) -> search.Index:
    """A new index of the table, written once."""
    made = search.Index(spark, Tables(spark).path("index"), key, tokenizer)
    made.put(docs, "text", owner)
    return made


@query(f"""
WITH {INDEX}, s AS (
  SELECT item_id, doc_id, sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score, count(*) AS got
  FROM post JOIN df USING (token) JOIN q USING (token) JOIN size USING (doc_id), st GROUP BY 1, 2
), r AS (SELECT s.*, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s JOIN (SELECT item_id, count(*) AS need FROM q GROUP BY 1) USING (item_id) WHERE got = need)
SELECT item_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 20
""")
def segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best twenty segments of each query."""
    found = index(spark, table(spark, sf_dir, "documents"), "doc_id").search(queries(spark, sf_dir), "item_id", 20)
    return found.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"""
WITH {FOLDED}, s AS (
  SELECT item_id, doc_id, sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score, count(*) AS got
  FROM post JOIN df USING (token) JOIN q USING (token) JOIN size USING (doc_id), st GROUP BY 1, 2
), r AS (SELECT s.*, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s JOIN (SELECT item_id, count(*) AS need FROM q GROUP BY 1) USING (item_id) JOIN size USING (doc_id) WHERE got = need AND source = 'src3')
SELECT item_id, doc_id, round(score, 6) AS score, d.lang FROM r JOIN documents d USING (doc_id) WHERE rank <= 5
""")
def project_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of one project, joined to their documents; statistics are the whole index's, accents do not count."""
    asked = queries(spark, sf_dir).withColumn("whose", F.lit("src3"))
    found = index(spark, table(spark, sf_dir, "documents"), "doc_id", "unicode61", "source").search(asked, "item_id", 5, owner="whose")
    return found.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("item_id", "doc_id", F.round("score", 6).alias("score"), "lang")


@query(r"""
WITH turns AS (SELECT -(conv_id * 100 + turn) - 1 AS doc_id, text FROM conversations),
live AS (SELECT doc_id, text FROM documents WHERE doc_id % 10 NOT IN (3, 5) UNION ALL SELECT doc_id, text || ' Nachwort' FROM documents WHERE doc_id % 10 = 5 UNION ALL SELECT * FROM turns WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, 'zurück ' || text FROM documents WHERE doc_id % 10 = 3 AND doc_id % 3 = 0),
post AS (SELECT token, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS token FROM live) GROUP BY ALL)
SELECT CASE WHEN doc_id < 0 THEN 10 ELSE doc_id % 10 END AS shard, count(*) AS n, sum(tf)::BIGINT AS tf, count(DISTINCT token) AS tokens, md5(string_agg(DISTINCT doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR)) AS ids FROM post GROUP BY 1
""")
def index_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kept index through inserts, updates, deletions, returns and a merge of its segments; its live postings are those
    of an index that was built at once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    turns = table(spark, sf_dir, "conversations").select((-(F.col("conv_id") * 100 + F.col("turn")) - 1).alias("doc_id"), "text")
    kept = index(spark, docs, "doc_id", "unicode61")
    kept.drop(docs.where("doc_id % 10 = 3"))
    kept.put(docs.where("doc_id % 10 = 5").withColumn("text", F.concat("text", F.lit(" Nachwort"))), "text")
    kept.put(turns, "text")
    kept.drop(turns.where("doc_id % 7 = 0"))
    kept.put(docs.where("doc_id % 10 = 3 and doc_id % 3 = 0").withColumn("text", F.concat(F.lit("zurück "), "text")), "text")
    kept.compact()
    shard = F.when(F.col("doc_id") < 0, 10).otherwise(F.col("doc_id") % 10)
    ids = F.md5(F.array_join(F.sort_array(F.collect_set(F.col("doc_id").cast("string"))), ","))
    return kept.live_postings().groupBy(shard.alias("shard")).agg(F.count("*").alias("n"), F.sum("tf").alias("tf"), F.count_distinct("token").alias("tokens"), ids.alias("ids"))


@query(r"""
WITH drafts AS (SELECT conv_id, arg_max(text, turn) AS text, arg_min(text, turn) AS title FROM conversations GROUP BY 1),
tok AS (SELECT conv_id, unnest(list_filter(regexp_split_to_array(lower(title || chr(10) || text), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS token FROM drafts),
size AS (SELECT conv_id, count(*) AS size FROM tok GROUP BY 1), post AS (SELECT token, conv_id, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM post GROUP BY 1),
st AS (SELECT count(*) AS docs, avg(size) AS mean FROM size), q AS (SELECT DISTINCT conv_id AS query, token FROM (SELECT conv_id, unnest(list_filter(regexp_split_to_array(lower(title), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS token FROM drafts)),
s AS (SELECT query, p.conv_id, sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score, count(*) AS got FROM post p JOIN df USING (token) JOIN q USING (token) JOIN size USING (conv_id), st GROUP BY 1, 2)
SELECT query, conv_id, rank::INT AS rank FROM (SELECT s.*, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, conv_id) AS rank FROM s JOIN (SELECT query, count(*) AS need FROM q GROUP BY 1) USING (query) WHERE got = need) WHERE rank <= 5
""")
def draft_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts indexed by title and content, the last and the first turn of each conversation, searched by every title."""
    drafts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("content"), F.min_by("text", "turn").alias("title"))
    rows = drafts.withColumn("text", F.concat_ws("\n", "title", "content"))
    wanted = drafts.select(F.col("conv_id").alias("query"), F.col("title").alias("text"))
    return index(spark, rows, "conv_id").search(wanted, "query", 5).select("query", "conv_id", "rank")
