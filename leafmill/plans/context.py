"""Context queries: a customer is a project, its orders in time are chapters; facts hold from the order on, summaries for
ten chapters, line items are passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators import context
from leafmill.plans._base import query, table
from leafmill.scratch import Tables

CH = """
ch AS (SELECT o_custkey AS project, o_orderkey AS id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INT AS number, o_orderpriority, o_orderstatus, o_totalprice FROM orders),
targets AS (SELECT project, number AS target FROM ch),
facts AS (SELECT project, id, o_orderpriority || ' of ' || id AS text, number AS valid_from, CASE WHEN number % 3 = 0 THEN number + 5 END AS valid_through, number + (id % 2)::INT AS revealed_at, number % 50 AS priority FROM ch),
sums AS (SELECT project, id, CASE WHEN number % 2 = 0 THEN 'volume' ELSE 'chapter' END AS layer, 'summary ' || o_orderstatus || ' ' || id AS text, number + 1 AS valid_from, number + 10 AS valid_through, 1 AS priority FROM ch),
pass AS (SELECT project, id, number AS chapter, repeat('passage ', (1 + id % 5)::INT) || id AS text, (number % 10) / 10.0 AS score FROM ch),
pool AS (
  SELECT project, target, 'fact' AS kind, id, text, 1000 + priority AS priority FROM facts JOIN targets USING (project) WHERE valid_from <= target AND revealed_at <= target AND (valid_through IS NULL OR valid_through >= target)
  UNION ALL SELECT project, target, 'summary', id, text, CASE layer WHEN 'volume' THEN 400 ELSE 300 END + priority FROM sums JOIN targets USING (project) WHERE target BETWEEN valid_from AND valid_through
  UNION ALL SELECT project, target, 'passage', id, text, floor(score * 100 + 0.5)::INT FROM pass JOIN targets USING (project) WHERE chapter <= target
)"""


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("id"), number.alias("number"), "o_orderpriority", "o_orderstatus", "o_totalprice")


def targets(ch: DataFrame) -> DataFrame:
    return ch.select("project", F.col("number").alias("target"))


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts, summaries and passages."""
    ch = chapters(spark, sf_dir)
    id_text = F.col("id").cast("string")
    facts = ch.select("project", "id", F.concat("o_orderpriority", F.lit(" of "), id_text).alias("text"), F.col("number").alias("valid_from"), F.when(F.col("number") % 3 == 0, F.col("number") + 5).alias("valid_through"), (F.col("number") + (F.col("id") % 2).cast("int")).alias("revealed_at"), (F.col("number") % 50).alias("priority"))
    sums = ch.select("project", "id", F.when(F.col("number") % 2 == 0, "volume").otherwise("chapter").alias("layer"), F.concat(F.lit("summary "), "o_orderstatus", F.lit(" "), id_text).alias("text"), (F.col("number") + 1).alias("valid_from"), (F.col("number") + 10).alias("valid_through"), F.lit(1).alias("priority"))
    passages = ch.select("project", "id", F.col("number").alias("chapter"), F.concat(F.expr("repeat('passage ', cast(1 + id % 5 as int))"), id_text).alias("text"), ((F.col("number") % 10) / 10.0).alias("score"))
    return facts, sums, passages


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, sums, passages = parts(spark, sf_dir)
    t = targets(chapters(spark, sf_dir))
    return context.pooled(context.visible_facts(facts, t), context.visible_summaries(sums, t), context.visible_passages(passages, t))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, sums, passages = parts(spark, sf_dir)
    spans = context.pooled(context.fact_spans(facts), context.summary_spans(sums), context.passage_spans(passages))
    return context.fitted(spans, targets(chapters(spark, sf_dir)), 60)


@query(f"WITH {CH} SELECT project, target, kind, count(*) AS n, sum(priority)::BIGINT AS priority FROM pool GROUP BY ALL")
def context_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool(spark, sf_dir).groupBy("project", "target", "kind").agg(F.count("*").alias("n"), F.sum("priority").alias("priority"))


FOLD = f"""
{CH}, c AS (SELECT *, greatest(1, ceil(length(text) / 4.0))::INT AS tokens, row_number() OVER (PARTITION BY project, target ORDER BY priority DESC, id::VARCHAR, kind) AS rn FROM pool),
fold AS (
  SELECT project, target, 0::BIGINT AS rn, 0 AS used, '' AS kept, '' AS prompt FROM targets
  UNION ALL
  SELECT f.project, f.target, c.rn, CASE WHEN used + tokens <= 60 THEN used + tokens ELSE used END, CASE WHEN used + tokens <= 60 THEN kept || CASE WHEN kept = '' THEN '' ELSE ',' END || c.id ELSE kept END,
         CASE WHEN used + tokens <= 60 THEN prompt || CASE WHEN prompt = '' THEN '' ELSE chr(10) || chr(10) END || '[' || kind || ':' || id || ']' || chr(10) || text ELSE prompt END
  FROM fold f JOIN c ON c.project = f.project AND c.target = f.target AND c.rn = f.rn + 1
), done AS (SELECT project, target, used, kept, 'ctx_' || substr(sha256('ctx' || chr(0) || project || ':' || target || ':60:' || kept), 1, 24) AS context_id, prompt FROM fold WHERE (project, target, rn) IN (SELECT (project, target, max(rn)) FROM fold GROUP BY project, target))"""


@query(f"WITH RECURSIVE {FOLD} SELECT project, target, used, kept, context_id FROM done")
def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context of at most 60 tokens for every chapter, all at once."""
    kept = F.array_join(F.transform("sources", lambda x: x["id"]), ",").alias("kept")
    return contexts(spark, sf_dir).select("project", "target", "used", kept, "context_id")


@query(f"WITH RECURSIVE {FOLD} SELECT context_id, md5(prompt) AS digest FROM done WHERE target % 2 = 1")
def context_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts of contexts that are not stored yet; those of every second chapter are."""
    made = Tables(spark).save(contexts(spark, sf_dir), "contexts")  # read twice, made once
    fresh = context.new_snapshots(made, made.where("target % 2 = 0").select("context_id"))
    facts, sums, passages = parts(spark, sf_dir)
    tag = lambda df, kind: df.select("project", F.lit(kind).alias("kind"), "id", "text")
    texts = tag(facts, "fact").unionByName(tag(sums, "summary")).unionByName(tag(passages, "passage"))
    return context.prompts(fresh, texts).select("context_id", F.md5("prompt").alias("digest"))


@query(f"WITH {CH} SELECT t.project, target, count(*) AS n, sum(floor(number / target * 100 + 0.5))::BIGINT AS priority FROM ch JOIN targets t USING (project) WHERE number < target GROUP BY ALL")
def prior_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch = chapters(spark, sf_dir)
    found = context.prior_drafts(context.draft_passages(ch.withColumn("content", F.col("o_orderpriority"))), targets(ch))
    return found.groupBy("project", "target").agg(F.count("*").alias("n"), F.sum("priority").alias("priority"))


@query(f"WITH {CH} SELECT project, target, count(*) AS n FROM ch JOIN targets USING (project) WHERE o_orderstatus = 'F' AND coalesce(CASE WHEN number % 5 = 0 THEN number + 3 END, number) < target GROUP BY ALL")
def visible_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch = chapters(spark, sf_dir)
    memories = ch.select("project", "id", F.col("number").alias("ordinal"), F.when(F.col("number") % 5 == 0, F.col("number") + 3).alias("visible_through"), F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("draft").alias("status"))
    return context.visible_memories(memories, targets(ch)).groupBy("project", "target").agg(F.count("*").alias("n"))


@query(f"WITH {CH} SELECT project, target, o_orderpriority AS subject, arg_max(o_orderstatus, number) AS state FROM ch JOIN targets USING (project) WHERE number < target GROUP BY ALL")
def states_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch = chapters(spark, sf_dir)
    return context.state_before(ch.select("project", "id", F.col("number").alias("ordinal"), F.col("o_orderpriority").alias("subject"), F.col("o_orderstatus").alias("state")), targets(ch))


@query(f"WITH {CH} SELECT project, count(*) AS n FROM ch WHERE number > 3 + project % 7 GROUP BY 1")
def future_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = chapters(spark, sf_dir).select("project", F.col("number").alias("ordinal"), (F.lit(3) + F.col("project") % 7).alias("visible"))
    return context.leaks(used).groupBy("project").agg(F.count("*").alias("n"))


@query(f"""
WITH {CH}
SELECT project, target, kind, count(*) AS n FROM (
  SELECT c.project, target, unnest(['chapter', 'plan']) AS kind FROM ch c JOIN targets t ON t.project = c.project AND number = target
  UNION ALL SELECT c_custkey, target, 'canon' FROM customer JOIN targets ON project = c_custkey
  UNION ALL SELECT c.project, target, CASE WHEN number < target THEN 'prior' ELSE 'future' END FROM ch c JOIN targets t USING (project) WHERE number <> target AND o_orderstatus <> 'P'
) GROUP BY ALL
""")
def consistency_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch = chapters(spark, sf_dir)
    own = ch.withColumn("target", F.col("number"))
    chapter = own.select("project", "target", "id", F.lit("text").alias("text"))
    plan = own.select("project", "target", "id", F.col("o_orderpriority").alias("text"))
    canon = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project"), F.col("c_custkey").alias("id"), F.col("c_name").alias("text"))
    drafts = ch.select("project", "id", "number", F.when(F.col("o_orderstatus") == "P", "{}").otherwise("draft").alias("text"))
    return context.chapter_sources(chapter, plan, canon, drafts).groupBy("project", "target", "kind").agg(F.count("*").alias("n"))


@query("""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number FROM orders),
memories AS (SELECT c_nationkey AS project, o_orderkey AS id, number FROM o JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F')
SELECT project, kind, count(*) AS n, sum(valid_from)::BIGINT AS valid_from, sum(priority)::BIGINT AS priority, count(DISTINCT id) AS ids FROM (
  SELECT c_nationkey AS project, 'character' AS kind, 0 AS valid_from, 100 AS priority, 'character:' || c_custkey AS id FROM customer
  UNION ALL SELECT s_nationkey, 'relationship', 0, 80, 'relation:' || s_suppkey FROM supplier
  UNION ALL SELECT c_nationkey, 'timeline', 0, 75, 'timeline:' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT n_nationkey, 'world', 0, 120, 'worldbuilding' FROM nation
  UNION ALL SELECT project, 'world', number + 1, 95, 'fact:' || id FROM memories
  UNION ALL SELECT project, 'timeline', number + 1, 100, 'state:' || id FROM memories
  UNION ALL SELECT project, 'character', number + 1, 115, 'entity-state:' || id FROM memories
) GROUP BY ALL
""")
def known_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a nation's project knows: customers, suppliers, orders, itself, and what finished orders leave behind."""
    customer = table(spark, sf_dir, "customer").withColumn("project", F.col("c_nationkey"))
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    orders = table(spark, sf_dir, "orders").withColumn("visible_through", number).join(customer, F.col("c_custkey") == F.col("o_custkey"))
    json = lambda df, key, *fields: df.select("project", F.col(key).alias("id"), F.to_json(F.struct(*fields)).alias("text"))
    memories = orders.where("o_orderstatus = 'F'").select("project", F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"), "visible_through")
    found = context.fact_union({
        "character": json(customer, "c_custkey", "c_name", "c_mktsegment"),
        "relation": json(table(spark, sf_dir, "supplier").withColumn("project", F.col("s_nationkey")), "s_suppkey", "s_name"),
        "timeline": json(orders, "o_orderkey", "o_orderdate", "o_orderstatus"),
        "worldbuilding": json(table(spark, sf_dir, "nation").withColumn("project", F.col("n_nationkey")), "n_nationkey", "n_name"),
        "fact": memories,
        "state": memories,
        "entity-state": memories,
    })
    return found.groupBy("project", "kind").agg(F.count("*").alias("n"), F.sum("valid_from").alias("valid_from"), F.sum("priority").cast("long").alias("priority"), F.count_distinct("id").alias("ids"))


@query("""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number FROM orders), t AS (SELECT o_custkey AS project, number AS target FROM o)
SELECT project, target, count(*) AS n, sum(priority)::BIGINT AS priority FROM (
  SELECT t.project, target, 600 AS priority FROM t
  UNION ALL SELECT t.project, target, 480 FROM t JOIN (SELECT o_custkey AS project, max(number) // 2 AS half FROM o GROUP BY 1) h ON h.project = t.project WHERE target <= half
  UNION ALL SELECT t.project, target, 400 FROM t
  UNION ALL SELECT t.project, target, 390 FROM t JOIN o ON o_custkey = t.project AND o_orderstatus = 'F'
) GROUP BY ALL
""")
def known_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of customers' projects at every chapter: the synopsis, a volume over the first half, the chapter's plan
    and the memories."""
    ch = chapters(spark, sf_dir)
    half = ch.groupBy("project").agg(F.floor(F.max("number") / 2).alias("last"))
    found = context.summary_union({
        "synopsis": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project"), F.col("c_custkey").alias("id"), F.col("c_name").alias("text")),
        "volume": half.select("project", F.col("project").alias("id"), F.lit("v").alias("text"), F.lit(0).alias("first"), "last"),
        "plan": ch.select("project", "id", F.col("o_orderpriority").alias("text"), "number"),
        "memory": ch.select("project", "id", F.when(F.col("o_orderstatus") == "F", "m").otherwise(" ").alias("text")),
    })
    return context.visible_summaries(found, targets(ch)).groupBy("project", "target").agg(F.count("*").alias("n"), F.sum("priority").alias("priority"))


@query("""
WITH m AS (SELECT conv_id, turn, length(text) % 5 = 0 AS no_summary, (conv_id + turn) % 7 = 1 AS no_facts, (conv_id + turn) % 11 = 2 AS half_fact FROM conversations)
SELECT conv_id, turn, unnest(list_filter([CASE WHEN no_summary THEN 'summary' END, CASE WHEN no_facts THEN 'newFacts' END, CASE WHEN half_fact AND NOT no_facts THEN 'fact_fields' END, CASE WHEN NOT (no_summary OR no_facts OR half_fact) THEN '1,2' END], lambda x: x IS NOT NULL)) AS found FROM m
""")
def chapter_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories as JSON answers: their reasons to be refused, or the numbers of facts and of trimmed state changes."""
    k = F.col("conv_id") + F.col("turn")
    fact = F.struct(F.lit(" world ").alias("category"), F.lit("s").alias("subject"), F.when(k % 11 == 2, " ").otherwise("f ").alias("fact"))
    answer = F.struct(F.when(F.length("text") % 5 == 0, "  ").otherwise(" s ").alias("summary"), F.array(F.lit(" a "), F.lit(" "), F.lit("b")).alias("stateChanges"), F.when(k % 7 != 1, F.array(fact)).alias("newFacts"), F.array().cast("array<string>").alias("unresolvedThreads"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("```json\n"), F.to_json(answer), F.lit("\n```")).alias("answer"))
    good, bad = context.chapter_memories(rows, "answer")
    numbers = F.concat_ws(",", F.size("memory.newFacts"), F.size("memory.stateChanges"))
    return good.select("conv_id", "turn", numbers.alias("found")).unionByName(bad.select("conv_id", "turn", F.explode("reasons").alias("found")))
