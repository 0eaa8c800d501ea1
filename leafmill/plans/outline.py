"""Plan queries: customers are volumes, their orders chapters and the line items scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators import outline
from leafmill.plans._base import query, table

CHAPTERS = """
chapters AS (
  SELECT o_custkey AS project, o_orderkey AS number, o_orderpriority LIKE '5%' AS weak_conflict, o_orderstatus = 'F' AS weak_hook, o_orderpriority, coalesce(n, 0) AS scenes
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
)"""
GAPS = "gaps AS (SELECT project, number, expected FROM (SELECT o_custkey AS project, (o_orderkey - first) AS number, rn AS expected FROM (SELECT o_custkey, o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) - 1 AS first, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)) WHERE number <> expected)"
DEVIATION = "dev AS (SELECT c_custkey AS project, coalesce(words, 0) AS words, 1000 AS target FROM customer LEFT JOIN (SELECT o_custkey, sum(l_quantity) AS words FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) ON o_custkey = c_custkey WHERE abs(coalesce(words, 0) - 1000) > greatest(500, 200))"
RHYTHM = "rhythm AS (SELECT project, number FROM (SELECT project, number, count(*) OVER w AS n, sum(weak_conflict::INT) OVER w AS c, sum(weak_hook::INT) OVER w AS h FROM chapters WINDOW w AS (PARTITION BY project ORDER BY number ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE n = 3 AND c >= 2 AND h >= 2)"
STATIC = "static AS (SELECT project, number FROM (SELECT *, lead(weak_hook) OVER w AS h, lead(scenes) OVER w AS s FROM chapters WINDOW w AS (PARTITION BY project ORDER BY number)) WHERE scenes = 1 AND s = 1 AND h = weak_hook)"


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("scenes"))
    rows = table(spark, sf_dir, "orders").join(scenes, "o_orderkey", "left")
    return rows.select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("number"), F.col("o_orderpriority").startswith("5").alias("weak_conflict"), (F.col("o_orderstatus") == "F").alias("weak_hook"), F.coalesce("scenes", F.lit(0)).alias("scenes"))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min("number").over(Window.partitionBy("project")) - 1
    return outline.number_gaps(chapters(spark, sf_dir).withColumn("number", F.col("number") - first), "project", "number")


def deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    volumes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project"), F.lit(1000).alias("target"))
    scenes = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("project"), "l_quantity")
    return outline.word_deviation(volumes, scenes, ["project"], "target", "l_quantity")


@query(f"WITH {GAPS} SELECT * FROM gaps")
def chapter_number_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps(spark, sf_dir)


@query(f"WITH {DEVIATION} SELECT project, round(words, 6)::DOUBLE AS words, target FROM dev")
def volume_word_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deviations(spark, sf_dir).select("project", F.round("words", 6).alias("words"), "target")


@query(f"WITH {CHAPTERS}, {RHYTHM} SELECT * FROM rhythm")
def weak_rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.weak_rhythm(chapters(spark, sf_dir), "project", "number", "weak_conflict", "weak_hook")


@query(f"WITH {CHAPTERS}, {STATIC} SELECT * FROM static")
def static_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.static_pairs(chapters(spark, sf_dir), "project", "number", ["weak_hook"], "scenes")


@query(f"""
WITH {CHAPTERS}, {GAPS}, {DEVIATION}, {RHYTHM}, {STATIC}
SELECT project, rule, severity, count(*) AS n FROM (
  SELECT project, 'number_gap' AS rule, 'error' AS severity FROM gaps UNION ALL SELECT project, 'word_deviation', 'warning' FROM dev
  UNION ALL SELECT project, 'weak_rhythm', 'warning' FROM rhythm UNION ALL SELECT project, 'static_pair', 'info' FROM static
) GROUP BY ALL
""")
def plan_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch = chapters(spark, sf_dir)
    return outline.quality_report(gaps(spark, sf_dir), deviations(spark, sf_dir), outline.weak_rhythm(ch, "project", "number", "weak_conflict", "weak_hook"), outline.static_pairs(ch, "project", "number", ["weak_hook"], "scenes"), "project")


@query("""
SELECT project, rule, count(*) AS n FROM (
  SELECT o_custkey AS project, 'duplicate_chapter' AS rule FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY o_custkey, o_orderkey % 50 HAVING count(*) > 1
  UNION ALL SELECT o_custkey, 'target_words' FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity::INT - 3 <= 0
) GROUP BY ALL
""")
def plan_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans as JSON of nested volumes, chapters and scenes, flattened again and validated; numbers repeat on purpose."""
    scenes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.lit("s").alias("title"), F.array(F.col("l_returnflag"), F.col("l_linestatus")).alias("characters"), (F.col("l_quantity").cast("int") - 3).alias("target_words"))).alias("scenes"))
    ch = table(spark, sf_dir, "orders").join(scenes, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", F.struct((F.col("o_orderkey") % 50).cast("int").alias("number"), F.lit("c").alias("title"), F.col("o_orderpriority").alias("conflict"), "scenes").alias("c"))
    plans = ch.groupBy(F.col("o_custkey").alias("project")).agg(F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("number"), F.lit("v").alias("title"), F.lit(1000).alias("target_words"), F.collect_list("c").alias("chapters"))).alias("volumes"))).alias("payload"))
    flat = outline.flattened(plans, "project", "payload")
    return outline.plan_violations(flat["volumes"], flat["chapters"], flat["scenes"], "project")


@query("SELECT c_mktsegment, count(DISTINCT c_custkey) AS volumes, count(DISTINCT o_orderkey) AS chapters, count(*) AS scenes FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def plan_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("chapters"), F.sum("n").alias("scenes"))
    rows = table(spark, sf_dir, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("volumes"), F.sum("chapters").alias("chapters"), F.sum("scenes").alias("scenes"))


@query("""
WITH p AS (SELECT p_brand AS project, CASE WHEN p_partkey % 13 = 0 THEN '　' WHEN p_partkey % 2 = 0 THEN ' ' || upper(p_type) || chr(160) ELSE p_type END AS name FROM part), n AS (SELECT project, lower(CASE WHEN name = '　' THEN '' ELSE trim(replace(name, chr(160), ' ')) END) AS name, count(*) AS n FROM p GROUP BY ALL)
SELECT 'place' AS kind, project, name, n, CASE WHEN name = '' THEN 'blank' ELSE 'repeated' END AS reason FROM n WHERE name = '' OR n > 1
UNION ALL SELECT 'source', l_orderkey::VARCHAR, l_suppkey::VARCHAR, count(*), 'repeated' FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1
""")
def repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of one name in a project, in any case and with any space around it, and sources that a check lists twice."""
    part, n = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.when(n % 13 == 0, "　").when(n % 2 == 0, F.concat(F.lit(" "), F.upper("p_type"), F.lit("\u00a0"))).otherwise(F.col("p_type"))
    places = outline.repeated(part.select(F.col("p_brand").alias("project"), name.alias("name")), ["project"], "name", fold=True)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("project"), F.col("l_suppkey").cast("string").alias("name"))
    tagged = lambda df, kind: df.select(F.lit(kind).alias("kind"), "project", "name", "n", "reason")
    return tagged(places, "place").unionByName(tagged(outline.repeated(lines, ["project"], "name"), "source"))
