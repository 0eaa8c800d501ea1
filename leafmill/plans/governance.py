"""Version and impact queries: conversations are chapter versions; parts are records of which a new version doubles the
size and renames the brand of every seventh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators import governance
from leafmill.plans._base import query, table
from leafmill.scratch import Tables

CHANGES = """
changes AS (
  SELECT p_partkey, unnest(['p_brand', 'p_size', 'p_type']) AS field, unnest([p_brand, p_size::VARCHAR, p_type]) AS before,
         unnest([CASE WHEN p_partkey % 7 = 0 THEN 'Brand new' ELSE p_brand END, (p_size * 2)::VARCHAR, p_type]) AS after FROM part
), changed AS (SELECT *, field = 'p_size' AND p_partkey % 3 = 0 AS locked FROM changes WHERE coalesce(before, '') <> coalesce(after, ''))
"""


@query("""
WITH RECURSIVE v AS (SELECT conv_id, turn, string_split(lag(t) OVER (PARTITION BY conv_id ORDER BY turn), chr(10)) AS l, string_split(t, chr(10)) AS r FROM (SELECT conv_id, turn, replace(text, '. ', '.' || chr(10)) AS t FROM conversations)),
walk AS (
  SELECT conv_id, turn, l, r, 1::BIGINT AS i, 1::BIGINT AS j, []::VARCHAR[] AS kinds FROM v WHERE l IS NOT NULL
  UNION ALL
  SELECT conv_id, turn, l, r, i + (m IN ('same', 'removed', 'both') AND i <= len(l))::INT, j + (m IN ('same', 'added', 'both') AND j <= len(r))::INT,
         CASE WHEN m <> 'both' THEN [m] WHEN i <= len(l) AND j <= len(r) THEN ['removed', 'added'] WHEN i <= len(l) THEN ['removed'] ELSE ['added'] END
  FROM walk, (SELECT CASE WHEN i <= len(l) AND j <= len(r) AND l[i] = r[j] THEN 'same' WHEN i + 1 <= len(l) AND j <= len(r) AND l[i + 1] = r[j] THEN 'removed' WHEN j + 1 <= len(r) AND i <= len(l) AND l[i] = r[j + 1] THEN 'added' ELSE 'both' END AS m)
  WHERE i <= len(l) OR j <= len(r)
) SELECT conv_id, turn, kind, count(*) AS n FROM (SELECT conv_id, turn, unnest(kinds) AS kind FROM walk) GROUP BY ALL
""")
def version_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy line diffs of successive versions."""
    versions = table(spark, sf_dir, "conversations").withColumn("content", F.regexp_replace("text", r"\. ", ".\n"))
    rows = governance.diffs(governance.version_pairs(versions, "conv_id", "turn", "content"), ["conv_id", "turn"])
    return rows.groupBy("conv_id", "turn", "kind").agg(F.count("*").alias("n"))


@query("""
SELECT conv_id, turn, length(before)::INT AS size_before, length(after)::INT AS size_after FROM (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, text AS after FROM conversations) WHERE before IS NOT NULL
""")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = governance.version_pairs(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return pairs.select("conv_id", "turn", F.length("before").alias("size_before"), F.length("after").alias("size_after"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    fields = ["p_brand", "p_size", "p_type"]
    after = part.withColumn("p_brand", F.when(F.col("p_partkey") % 7 == 0, "Brand new").otherwise(F.col("p_brand"))).withColumn("p_size", F.col("p_size") * 2)
    locks = part.where("p_partkey % 3 = 0").select("p_partkey", F.lit("p_size").alias("field"))
    return governance.field_changes(governance.unpivoted(part, "p_partkey", fields, "value"), governance.unpivoted(after, "p_partkey", fields, "value"), "p_partkey", locks)


@query(f"WITH {CHANGES} SELECT p_partkey, field, before, after, locked, CASE WHEN locked THEN before ELSE after END AS value FROM changed")
def locked_field_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.merged(changes(spark, sf_dir))


@query("SELECT p_partkey, field, sha256(coalesce(value, '')) AS sha256 FROM (SELECT p_partkey, unnest(['p_brand', 'p_type']) AS field, unnest([p_brand, p_type]) AS value FROM part)")
def field_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.locks(governance.unpivoted(table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_type"], "value"), "p_partkey")


TERMS = r"""
log AS (SELECT 'src' || (conv_id % 20) AS source, conv_id * 1000 + turn AS ord, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before, coalesce(text, '') AS after FROM conversations),
words AS (SELECT source, ord, ws, i, lower(ws[i + 1]) AS term FROM (SELECT source, ord, list_concat(regexp_split_to_array(before, SEP), regexp_split_to_array(after, SEP)) AS ws FROM log), range(len(ws)) r(i)),
terms AS (SELECT source, term, min((ord, i)) AS place FROM words WHERE length(term) >= 2 GROUP BY 1, 2)
""".replace("SEP", r"""'[\s，。；、：,.!?！？;:"“”''‘’（）()《》]+'""")
HITS = f"{TERMS}, hits AS (SELECT d.source, d.doc_id, list(term ORDER BY place) AS ts FROM documents d JOIN terms t ON t.source = d.source AND contains(lower(d.text), term) GROUP BY ALL)"


def change_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the successive versions of all conversations change; every conversation belongs to one of the books."""
    turns = table(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    log = turns.select(F.concat(F.lit("src"), F.col("conv_id") % 20).alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), before.alias("before"), F.col("text").alias("after"))
    return governance.changed_terms(log, "source", "ord")


@query(f"WITH {HITS} SELECT source, doc_id, '引用了变更内容：' || array_to_string(ts[:3], '、') AS reason, len(ts) AS n_terms FROM hits")
def change_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return governance.mentions(docs, change_terms(spark, sf_dir), "source", "doc_id", "text").drop("terms")


@query(f"""
WITH {HITS}, own AS (SELECT source AS book, '引用了变更内容：' || array_to_string(list(term ORDER BY place)[:3], '、') AS own FROM (SELECT DISTINCT source FROM documents) JOIN terms USING (source) WHERE contains(lower(source), term) GROUP BY source), kids AS (SELECT source AS book, count(*) AS n FROM hits GROUP BY 1)
SELECT book, coalesce(own, n || ' 个章节引用了变更内容') AS reason FROM own FULL JOIN kids USING (book)
""")
def volume_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books whose name is mentioned, or that have chapters which mention a change."""
    docs, tables = table(spark, sf_dir, "documents").select("source", "doc_id", "text"), Tables(spark)
    terms = tables.save(change_terms(spark, sf_dir), "changed")  # read twice, made once
    found = governance.mentions(docs, terms, "source", "doc_id", "text", tables=tables)
    names = docs.select("source", F.col("source").alias("name"), F.lit("book").alias("id")).distinct()
    direct = governance.mentions(names, terms, "source", "id", "name", tables=tables).select(F.col("source").alias("book"), "reason")
    return governance.parent_impact(found.withColumnRenamed("source", "book"), direct, "book")


IMPACT = r"""
terms AS (SELECT project, term, min((ord, i)) AS place FROM (SELECT project, ord, i, lower(ws[i + 1]) AS term FROM (SELECT c_nationkey AS project, c_custkey AS ord, list_concat(regexp_split_to_array(c_mktsegment, SEP), regexp_split_to_array(c_name, SEP)) AS ws FROM customer WHERE c_custkey % 7 = 0), range(len(ws)) r(i)) WHERE length(term) >= 2 GROUP BY 1, 2),
items AS (
  SELECT c_nationkey AS project, 'volume' AS kind, c_custkey AS id, c_name AS title, c_name || ' ' || c_mktsegment AS text, NULL::BIGINT AS owner FROM customer
  UNION ALL SELECT c_nationkey, 'chapter', o_orderkey, '第 ' || o_orderkey || ' 章 · ' || o_orderstatus, o_orderpriority || ' of ' || CASE WHEN o_orderkey % 3 = 0 THEN c_mktsegment ELSE '' END, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT s_nationkey, 'character', s_suppkey, s_name, s_name, NULL FROM supplier
  UNION ALL SELECT c_nationkey, 'draft', o_orderkey, '第 ? 章 · ' || o_orderstatus, c_name || '!', NULL FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 5 = 0
), hits AS (SELECT i.project, kind, id, title, owner, '引用了变更内容：' || array_to_string(list(term ORDER BY place)[:3], '、') AS reason FROM items i JOIN terms t ON t.project = i.project AND contains(lower(text), term) GROUP BY ALL),
kids AS (SELECT project, owner AS id, count(*) AS n FROM hits WHERE kind = 'chapter' GROUP BY 1, 2)
""".replace("SEP", r"""'[\s，。；、：,.!?！？;:"“”''‘’（）()《》]+'""")


@query(f"""
WITH {IMPACT}, all_ AS (
  SELECT project, kind, id, title, reason FROM hits WHERE kind <> 'volume'
  UNION ALL SELECT i.project, 'volume', i.id, i.title, coalesce(h.reason, n || ' 个章节引用了变更内容') FROM items i LEFT JOIN hits h ON h.kind = 'volume' AND h.id = i.id LEFT JOIN kids k ON k.project = i.project AND k.id = i.id WHERE i.kind = 'volume' AND (h.reason IS NOT NULL OR n > 0)
) SELECT project, kind, count(*) AS n, md5(string_agg(id || title || reason, '|' ORDER BY id)) AS digest FROM all_ GROUP BY ALL
""")
def rewrite_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over plans, characters and drafts: segments of every seventh customer become their names."""
    customer = table(spark, sf_dir, "customer").withColumn("project", F.col("c_nationkey"))
    log = customer.where("c_custkey % 7 = 0").select("project", F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("before"), F.col("c_name").alias("after"))
    orders = table(spark, sf_dir, "orders").join(customer, F.col("c_custkey") == F.col("o_custkey"))
    volumes = customer.select("project", F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("text"))
    extra = F.when(F.col("o_orderkey") % 3 == 0, F.col("c_mktsegment")).otherwise("")
    base = orders.select("project", F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("number"), F.col("o_orderstatus").alias("title"), F.col("o_custkey").alias("volume_id"), F.concat("o_orderpriority", F.lit(" of "), extra).alias("text"), F.concat("c_name", F.lit("!")).alias("draft"))
    characters = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("project"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.col("s_name").alias("text"))
    drafts = base.where("id % 5 = 0").select("project", "id", F.lit(None).cast("long").alias("number"), "title", F.col("draft").alias("text"))
    terms = governance.changed_terms(log, "project", "ord")
    rows = governance.impact_report(terms, "project", volumes, base.drop("draft"), characters, drafts)
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("id").cast("long").alias("n"), F.concat("id", "title", "reason").alias("t")))), lambda x: x["t"]), "|")
    return rows.groupBy("project", "kind").agg(F.count("*").alias("n"), F.md5(told).alias("digest"))


@query("SELECT event_id, replace(props, 'page', 'leaf') AS props FROM events")
def json_id_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", governance.remapped_json(F.col("props"), F.lit("page"), F.lit("leaf")).alias("props"))


@query("SELECT doc_id, md5(text[:least(5, length(text))] || '[rewritten]' || text[least(12, length(text)) + 1:]) AS digest FROM documents")
def selection_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(governance.spliced(F.col("text"), F.least(F.lit(5), n), F.least(F.lit(12), n), F.lit("[rewritten]"))).alias("digest"))
