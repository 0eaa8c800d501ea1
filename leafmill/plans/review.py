"""Review queries: events are task, decision and write logs; conversations are saves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import json_object, or_default, reasons, squeezed
from leafmill.operators import context, review
from leafmill.operators.trash import Graph
from leafmill.plans._base import query, table
from leafmill.scratch import Tables

STATES = "CASE WHEN event_type = 'signup' THEN 'queued' WHEN event_type = 'view' THEN 'running' WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'cancelled' WHEN event_type = 'click' THEN 'paused' WHEN event_type = 'purchase' THEN 'succeeded' WHEN event_id % 2 = 0 THEN 'failed' ELSE 'cancelling' END"
ERRORS = "CASE WHEN event_type = 'error' AND event_id % 2 = 0 AND event_id % 8 > 0 OR event_type = 'purchase' AND event_id % 11 = 0 THEN 'e' END"
#: The moves that tasks make, folded event by event: an illegal one changes nothing.
MOVES = f"""
e AS (SELECT user_id, event_id, {STATES} AS status, {ERRORS} AS error, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
fold AS (
  SELECT DISTINCT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::VARCHAR AS status, NULL::VARCHAR AS before, false AS legal, NULL::VARCHAR AS now FROM e
  UNION ALL
  SELECT f.user_id, e.rn, e.event_id, e.status, f.now, ok, CASE WHEN ok THEN e.status ELSE f.now END
  FROM fold f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1, (SELECT (e.status = 'failed') = (e.error IS NOT NULL) AND CASE coalesce(f.now, '')
    WHEN '' THEN e.status = 'queued' WHEN 'queued' THEN e.status IN ('running', 'paused', 'cancelled') WHEN 'running' THEN e.status IN ('paused', 'cancelling', 'succeeded', 'failed')
    WHEN 'paused' THEN e.status IN ('queued', 'cancelled') WHEN 'cancelling' THEN e.status IN ('cancelled', 'failed') WHEN 'failed' THEN e.status = 'queued' ELSE false END AS ok)
)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("status", F.expr(STATES)).withColumn("error", F.expr(ERRORS))


@query("SELECT user_id, event_type, props, min(event_id) AS event_id FROM events GROUP BY ALL")
def idempotent_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.first_by_key(table(spark, sf_dir, "events").select("user_id", "event_type", "props", "event_id"), ["user_id", "event_type", "props"], ["event_id"])


@query(f"WITH RECURSIVE {MOVES} SELECT status, before, legal, count(*) AS n FROM fold WHERE rn > 0 GROUP BY ALL")
def task_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.transitions(log(spark, sf_dir), "user_id", "event_id", "status", "error").groupBy("status", "before", "legal").agg(F.count("*").alias("n"))


@query(f"""
WITH RECURSIVE {MOVES}, t AS (SELECT fold.*, ts FROM fold JOIN events USING (event_id) WHERE legal)
SELECT user_id, arg_max(status, rn) AS status, strftime(min(ts) FILTER (WHERE status = 'running'), '%Y-%m-%d %H:%M:%S') AS started_at,
       CASE WHEN arg_max(status, rn) IN ('succeeded', 'failed', 'cancelled') THEN strftime(arg_max(ts, rn), '%Y-%m-%d %H:%M:%S') END AS finished_at FROM t GROUP BY 1
""")
def task_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every task stands, when it first ran and when it came to rest."""
    done = review.transitions(log(spark, sf_dir), "user_id", "event_id", "status", "error", "ts").where("after is not null")
    last = done.groupBy("user_id").agg(F.max_by(F.struct("after", "started_at", "finished_at"), "event_id").alias("t"))
    text = lambda c: F.date_format(f"t.{c}", "yyyy-MM-dd HH:mm:ss").alias(c)
    return last.select("user_id", F.col("t.after").alias("status"), text("started_at"), text("finished_at"))


@query("""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY event_id % 4000 ORDER BY event_id) AS nth FROM events)
SELECT user_id, event_type, count(*) AS revision, round(arg_max(value, event_id), 6) AS value FROM d WHERE nth = 1 AND value > 50 GROUP BY ALL
""")
def candidate_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = table(spark, sf_dir, "events").withColumn("candidate", F.col("event_id") % 4000).withColumn("decision", F.when(F.col("value") > 50, "accepted").otherwise("rejected"))
    entries, _ = review.reviewed(decisions, "candidate", ["user_id", "event_type"], "event_id")
    return entries.withColumn("value", F.round("value", 6))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest_review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.latest_status(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


@query("""
WITH RECURSIVE w AS (SELECT user_id, event_id, (event_id % 3)::INT AS gap, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
f AS (SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, 0 AS rev, false AS accepted FROM (SELECT DISTINCT user_id FROM w)
  UNION ALL SELECT f.user_id, w.rn, w.event_id, CASE WHEN least(w.rn - 1, 5) - w.gap = f.rev THEN f.rev + 1 ELSE f.rev END::INT, least(w.rn - 1, 5) - w.gap = f.rev FROM f JOIN w ON w.user_id = f.user_id AND w.rn = f.rn + 1)
SELECT user_id, event_id, rev AS revision, accepted FROM f WHERE rn > 0
""")
def optimistic_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    writes = table(spark, sf_dir, "events").withColumn("expected", (F.least(rn - 1, F.lit(5)) - F.col("event_id") % 3).cast("int")).select("user_id", "event_id", "expected")
    return review.optimistic(writes, ["user_id"], "event_id", "expected").select("user_id", "event_id", "revision", "accepted")


@query("""
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS revision FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type
""")
def draft_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.versions(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")
    return rows.select("user_id", "event_id", F.col("revision").cast("long").alias("revision"))


@query("""
SELECT source, sha, doc_id FROM (SELECT source, sha256(text) AS sha, doc_id, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id DESC) AS rn FROM documents WHERE doc_id % 2 = 1) WHERE rn = 1
UNION ALL SELECT source, sha, doc_id FROM (SELECT source, sha256(text) AS sha, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL) WHERE (source, sha) NOT IN (SELECT (source, sha256(text)) FROM documents WHERE doc_id % 2 = 1)
""")
def document_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd documents come in over even ones, by book and content."""
    docs = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("sha"), "doc_id")
    current = review.first_by_key(docs.where("doc_id % 2 = 0"), ["source", "sha"], ["doc_id"])
    return review.upserted(current, docs.where("doc_id % 2 = 1"), ["source", "sha"], ["doc_id"])


@query("""
SELECT o.o_orderkey || '-copy' AS o_orderkey, c.c_custkey || '-copy' AS o_custkey, count(*) AS scenes FROM customer c JOIN orders o ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
""")
def project_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"customer": table(spark, sf_dir, "customer"), "orders": table(spark, sf_dir, "orders"), "lineitem": table(spark, sf_dir, "lineitem").withColumn("line_id", F.concat_ws("-", "l_orderkey", "l_linenumber"))}
    own = tables["orders"].join(tables["customer"], F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    copy = review.copied(tables | {"orders": own}, {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "line_id"}, {"orders": {"o_custkey": "customer"}, "lineitem": {"l_orderkey": "orders"}}, "-copy")
    lines = copy["lineitem"].groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("scenes"))
    return copy["orders"].join(lines, "o_orderkey").select("o_orderkey", "o_custkey", "scenes")


@query("SELECT n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey <> 2 GROUP BY 1")
def trash_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").withColumn("trashed_at", F.when(F.col("n_regionkey") == 2, F.lit(1)))
    kept = review.alive(nations.withColumnRenamed("n_nationkey", "c_nationkey"), table(spark, sf_dir, "customer"), "c_nationkey")
    return kept.join(nations.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").groupBy("n_name").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) FILTER (WHERE ok) AS admitted, count(*) FILTER (WHERE NOT ok) AS refused FROM (SELECT source, coalesce(quality = 1, false) AS ok FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1")
def rights_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    confirmations = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("confirmed"), F.lit(1).alias("version"))
    yes, no = review.rights_gate(docs, confirmations, "doc_id")
    rows = yes.withColumn("ok", F.lit(1)).unionByName(no.withColumn("ok", F.lit(0)))
    return rows.groupBy("source").agg(F.sum("ok").alias("admitted"), F.sum(1 - F.col("ok")).alias("refused"))


@query("SELECT o_orderstatus, count(*) FILTER (WHERE good) AS owned, count(*) FILTER (WHERE NOT good) AS offenders FROM (SELECT o_orderstatus, o_orderkey % 5 <> 0 AS good FROM orders) GROUP BY 1")
def ownership_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims on orders, every fifth by a customer that does not have it."""
    orders = table(spark, sf_dir, "orders")
    claims = orders.select(F.when(F.col("o_orderkey") % 5 == 0, -1).otherwise(F.col("o_custkey")).alias("document"), F.lit("p").alias("project"), F.col("o_orderkey").alias("chapter"), "o_orderstatus")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document"), F.lit("p").alias("project"))
    good, bad = review.owned(claims, orders.select(F.col("o_orderkey").alias("chapter"), F.col("o_custkey").alias("document")), customers)
    rows = good.withColumn("ok", F.lit(1)).unionByName(bad.withColumn("ok", F.lit(0)))
    return rows.groupBy("o_orderstatus").agg(F.sum("ok").alias("owned"), F.sum(1 - F.col("ok")).alias("offenders"))


@query("""
WITH c AS (SELECT b.item_id, d.doc_id, d.text AS src, b.text AS quote FROM benchmark b JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id)
SELECT item_id, count(*) FILTER (WHERE contains(lower(regexp_replace(src, '\\s+', '', 'g')), lower(regexp_replace(quote, '\\s+', '', 'g')))) AS verified, count(*) AS cited FROM c GROUP BY 1
""")
def quote_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "quote")
    cited = docs.select("source_id", (F.col("source_id") % items.count()).alias("item_id")).join(items, "item_id")
    return review.quotes(cited, docs).groupBy("item_id").agg(F.count_if(F.col("verdict") == "verified").alias("verified"), F.count("*").alias("cited"))


@query()
def all_quote_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item against every document, held against brute force in the tests; cited: the documents that share five
    words one after another with the item."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    found = review.quotes(review.citations(docs, items), docs, squeezed).withColumnRenamed("quote_id", "item_id").groupBy("item_id").agg(F.count_if(F.col("verdict") == "verified").alias("verified"), F.count("*").alias("cited"))
    return items.select(F.col("quote_id").alias("item_id")).join(found, "item_id", "left").na.fill(0, ["verified", "cited"])


@query(f"""
WITH r AS (SELECT user_id AS project, event_type AS kind, props AS input_hash, value AS result, event_id AS seq, {STATES} AS status FROM events)
SELECT q.project, q.seq, round(d.reuse, 6) AS reuse FROM r q LEFT JOIN (SELECT project, kind, input_hash, arg_max(result, seq) AS reuse FROM r WHERE status = 'succeeded' GROUP BY ALL) d USING (project, kind, input_hash)
""")
def result_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = log(spark, sf_dir).select(F.col("user_id").alias("project"), F.col("event_type").alias("kind"), F.col("props").alias("input_hash"), F.col("value").alias("result"), F.col("event_id").alias("seq"), "status")
    return review.reusable(runs.drop("result", "status"), runs).select("project", "seq", F.round("reuse", 6).alias("reuse"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3")
def latest_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", 3).select("user_id", "event_type", "event_id")


@query("SELECT event_type, reason, count(*) AS n FROM (SELECT event_type, unnest(list_filter([CASE WHEN value IS NULL OR value < 10 THEN 'value' END, CASE WHEN event_type NOT IN ('view', 'click', 'signup', 'purchase') THEN 'event_type' END, CASE WHEN try_cast(props AS JSON) IS NULL THEN 'props' END], lambda x: x IS NOT NULL)) AS reason FROM events) GROUP BY ALL")
def row_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = reasons((F.col("value").isNull() | (F.col("value") < 10), "value"), (~F.col("event_type").isin("view", "click", "signup", "purchase"), "event_type"), (F.try_parse_json("props").isNull(), "props"))
    _, bad = review.validated(table(spark, sf_dir, "events"), rules)
    return bad.select("event_type", F.explode("reasons").alias("reason")).groupBy("event_type", "reason").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 5 < 3 THEN props ->> '$.page' END AS page, event_id % 5 < 3 AS valid FROM events")
def fenced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in a code fence or not, of which arrays and broken JSON are no objects."""
    props, k = F.col("props"), F.col("event_id") % 5
    answer = F.when(k == 0, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(k == 1, F.concat(F.lit(" \n```\n"), props, F.lit("\n``` "))).when(k == 2, props).when(k == 3, F.concat(F.lit("["), props, F.lit("]"))).otherwise(F.concat(props, F.lit("}")))
    rows = table(spark, sf_dir, "events").select("event_id", json_object(answer).alias("found"))
    return rows.select("event_id", F.get_json_object("found", "$.page").alias("page"), F.col("found").isNotNull().alias("valid"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE lang END AS lang FROM documents")
def defaulted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", or_default(F.when(F.col("doc_id") % 5 == 0, F.lit("  ")).otherwise(F.col("lang")), "unknown").alias("lang"))


@query("""
SELECT why, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN event_id % 10 = 1 THEN 'blank_model' END, CASE WHEN event_id % 15 = 2 THEN 'blank_input_hash' END, CASE WHEN event_type = 'error' THEN 'status' END, CASE WHEN event_id % 7 = 3 THEN 'negative_tokens' END], lambda x: x IS NOT NULL)) AS why FROM events) GROUP BY 1
""")
def task_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of which some lack a model or a hash, have an unknown state or token counts below zero."""
    e = F.col("event_id")
    status = F.when(F.col("event_type") == "error", "lost").otherwise("queued")
    rows = table(spark, sf_dir, "events").select(e.alias("id"), F.col("user_id").alias("project_id"), F.col("event_type").alias("kind"), F.lit("p").alias("provider_id"), F.when(e % 10 == 1, " ").otherwise("m").alias("model"), F.lit("k").alias("idempotency_key"), F.when(e % 15 == 2, None).otherwise(F.col("props")).alias("input_hash"), status.alias("status"), F.when(e % 7 == 3, -1).otherwise(5).alias("input_tokens"), F.lit(None).cast("long").alias("output_tokens"), F.lit(0).alias("cached_tokens"))
    texts = rows.select(*(F.col(c).cast("string").alias(c) if c in review.TASK_FIELDS else F.col(c) for c in rows.columns))
    _, bad = review.validated(texts, review.task_violations())
    return bad.select(F.explode("reasons").alias("why")).groupBy("why").agg(F.count("*").alias("n"))


@query("""
SELECT why, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN doc_id % 9 = 8 THEN 'no_object' END, CASE WHEN doc_id % 5 = 1 OR doc_id % 9 = 8 THEN 'summary' END, CASE WHEN n_chars % 130 > 100 OR doc_id % 9 = 8 THEN 'confidence' END,
  CASE WHEN doc_id % 7 = 2 OR doc_id % 9 = 8 THEN 'evidence' END, CASE WHEN doc_id % 11 = 3 OR doc_id % 9 = 8 THEN 'stateChanges' END, CASE WHEN doc_id % 13 = 4 OR doc_id % 9 = 8 THEN 'goals' END,
  CASE WHEN doc_id % 9 = 8 THEN 'characters' END, CASE WHEN doc_id % 9 = 8 THEN 'locations' END, CASE WHEN doc_id % 9 = 8 THEN 'worldTerms' END, CASE WHEN doc_id % 9 = 8 THEN 'conflicts' END, CASE WHEN doc_id % 9 = 8 THEN 'outcomes' END, CASE WHEN doc_id % 9 = 8 THEN 'uncertainties' END], lambda x: x IS NOT NULL)) AS why FROM documents) GROUP BY 1
""")
def analysis_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses as JSON answers, of which some are no object, lack fields or hold values out of bounds."""
    d = F.col("doc_id")
    some = lambda c: F.array(F.lit(c))
    evidence = F.when(d % 7 == 2, F.array(F.struct(F.lit(None).cast("string").alias("claim"), some("s").alias("segmentIds")))).otherwise(F.array(F.struct(F.lit("c").alias("claim"), some("s").alias("segmentIds"))))
    changes = F.when(d % 11 != 3, F.array(F.struct(*(F.lit("x").alias(f) for f in ("subject", "field", "before", "after")))))
    answer = F.struct(F.when(d % 5 != 1, F.lit("s")).alias("summary"), ((F.col("n_chars") % 130) / 100).alias("confidence"), changes.alias("stateChanges"), evidence.alias("evidence"), F.when(d % 13 != 4, some("g")).alias("goals"), *(some("v").alias(f) for f in ("characters", "locations", "worldTerms", "conflicts", "outcomes", "uncertainties")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(d % 9 == 8, "[1, 2]").otherwise(F.to_json(answer)).alias("payload"))
    _, bad = review.validated(rows, review.analysis_violations(F.col("payload")))
    return bad.select(F.explode("reasons").alias("why")).groupBy("why").agg(F.count("*").alias("n"))


@query("""
WITH i AS (SELECT *, doc_id % 6 = 0 AS bad_kind, doc_id % 10 = 1 AS bad_severity, doc_id % 7 = 2 AS empty, doc_id % 8 = 3 AS unknown, doc_id % 9 = 4 AND length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) > 0 AS wrong, length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) = 0 AS blank FROM documents)
SELECT why, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN NOT (bad_kind OR bad_severity OR empty OR (unknown OR wrong OR blank)) THEN 'open' END, CASE WHEN bad_kind THEN 'kind' END, CASE WHEN bad_severity THEN 'severity' END, CASE WHEN empty THEN 'no_evidence' END,
  CASE WHEN NOT empty AND unknown AND NOT blank THEN 'unknown_source' END, CASE WHEN NOT empty AND NOT unknown AND wrong THEN 'quote' END, CASE WHEN NOT empty AND blank THEN 'evidence' END], lambda x: x IS NOT NULL)) AS why FROM i) GROUP BY 1
""")
def consistency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that quote a document's first line with its spaces doubled; some name unknown sources or quote what is not
    there."""
    docs, d = table(spark, sf_dir, "documents"), F.col("doc_id")
    quote = F.when(d % 9 == 4, F.concat(F.lit("zq"), "text", F.lit("qz"))).otherwise(F.replace("text", F.lit(" "), F.lit("  ")))
    cited = F.array(F.struct(F.when(d % 8 == 3, -1).otherwise(d).alias("source_id"), F.coalesce(F.when(F.length(F.regexp_replace("text", r"\s", "")) > 0, quote), F.lit("")).alias("quote")))
    texts = [F.lit("t").alias(c) for c in ("title", "description", "suggestion", "repair")]
    issues = docs.select(d.alias("chapter_id"), F.lit(0).alias("i"), F.when(d % 6 == 0, "mood").otherwise("plan").alias("kind"), F.when(d % 10 == 1, "fatal").otherwise("error").alias("severity"), *texts, F.when(d % 7 == 2, F.array().cast("array<struct<source_id:bigint,quote:string>>")).otherwise(cited).alias("evidence"))
    good, bad = review.consistency_issues(issues, docs.select(d.alias("source_id"), F.replace("text", F.lit("\n"), F.lit(" \n ")).alias("text")))
    return good.select(F.col("status").alias("why")).unionByName(bad.select(F.explode("reasons").alias("why"))).groupBy("why").agg(F.count("*").alias("n"))


@query("""
WITH t AS (
  SELECT o_custkey AS project, o_orderkey AS id, o_orderdate AS made, o_orderstatus AS kind, o_orderkey % 7 AS plan FROM orders
), p AS (SELECT unnest(['sources', 'trash', 'projects', 'checkpoints', 'tasks', 'reports', 'snapshots', 'candidates', 'analyses', 'drafts', 'bible', 'versions', 'chapters']) AS listing)
SELECT project, id, listing, CASE
  WHEN listing IN ('sources', 'trash', 'projects', 'candidates') THEN row_number() OVER (PARTITION BY listing, project ORDER BY made DESC, id)
  WHEN listing IN ('checkpoints', 'tasks', 'reports', 'snapshots') THEN row_number() OVER (PARTITION BY listing, project ORDER BY made DESC, id DESC)
  WHEN listing = 'analyses' THEN row_number() OVER (PARTITION BY listing, project ORDER BY made, id)
  WHEN listing = 'drafts' THEN row_number() OVER (PARTITION BY listing, project ORDER BY made DESC, plan, id)
  WHEN listing = 'bible' THEN row_number() OVER (PARTITION BY listing, project ORDER BY kind, id)
  WHEN listing = 'versions' THEN row_number() OVER (PARTITION BY listing, project ORDER BY id % 100 DESC, id)
  ELSE row_number() OVER (PARTITION BY listing, project ORDER BY id % 100, id) END AS place FROM t, p
""")
def project_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing of every project, in its order."""
    orders, at, n = table(spark, sf_dir, "orders"), F.col("o_orderdate"), F.col("o_orderkey") % 100
    columns = {"imported_at": at, "updated_at": at, "created_at": at, "trashed_at": at, "kind": F.col("o_orderstatus"), "chapter_plan_id": F.col("o_orderkey") % 7, "revision": n, "ordinal": n, "id": F.col("o_orderkey")}
    listed = review.all_listed(orders, "o_custkey", columns, "o_orderkey")
    return listed.select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("id"), "listing", "place")


@query("""
WITH names AS (SELECT DISTINCT lang, unnest(regexp_split_to_array(text, '\\s+')) AS name FROM documents WHERE lang IS NOT NULL)
SELECT lang, name, row_number() OVER (PARTITION BY lang ORDER BY name COLLATE zh, name) AS place FROM names WHERE name <> ''
""")
def names_by_collation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the documents of each language, by the collation of Chinese names."""
    words = F.explode(F.array_distinct(F.split("text", r"\s+", -1)))
    rows = table(spark, sf_dir, "documents").where("lang is not null").select("lang", words.alias("name")).where("name <> ''").distinct()
    return review.by_name(rows, "lang", "name", "zh")


@query("""
SELECT project_id, chapter_plan_id, created_at, id, status FROM (
  SELECT o_custkey AS project_id, o_orderkey % 5 AS chapter_plan_id, o_orderdate AS created_at, o_orderkey AS id, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 5 ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1
""")
def latest_consistency_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reports on five chapters of each project."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), (F.col("o_orderkey") % 5).alias("chapter_plan_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return review.latest_reports(rows)


@query("""
SELECT source, chapter, status FROM (
  SELECT d.source, d.doc_id AS chapter, CASE WHEN d.doc_id % 3 = 0 THEN 'draft' WHEN l.quality = 1 THEN 'accepted' ELSE 'rejected' END AS status FROM documents d JOIN labels l USING (doc_id)
  UNION ALL SELECT source, doc_id, 'draft' FROM documents WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels))
""")
def analysis_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third chapter is analysed again, so its review starts anew."""
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("chapter"))
    current = docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chapter"), F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("status")), "chapter")
    incoming = docs.where("chapter % 3 = 0").withColumn("status", F.lit("accepted"))
    return review.analyses_upserted(current, incoming, ["chapter"], ["source"]).select("source", "chapter", "status")


@query("""
WITH gone AS (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3) OR n_nationkey = 0),
back AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 3 OR n_nationkey = 0),
c1 AS (SELECT c_custkey, c_nationkey IN (FROM gone) AS g, c_nationkey IN (FROM back) AS b FROM customer),
o1 AS (SELECT o_orderkey, g, b FROM orders JOIN c1 ON c_custkey = o_custkey)
SELECT 'region' AS name, count(*) AS n, count(*) FILTER (r_regionkey NOT IN (1, 3)) AS trashed, count(*) FILTER (r_regionkey <> 3) AS restored FROM region
UNION ALL SELECT 'nation', count(*), count(*) FILTER (n_nationkey NOT IN (FROM gone)), count(*) FILTER (n_nationkey NOT IN (FROM back)) FROM nation
UNION ALL SELECT 'supplier', count(*), count(*) FILTER (s_nationkey NOT IN (FROM gone)), count(*) FILTER (s_nationkey NOT IN (FROM back)) FROM supplier
UNION ALL SELECT 'customer', count(*), count(*) FILTER (NOT g), count(*) FILTER (NOT b) FROM c1
UNION ALL SELECT 'orders', count(*), count(*) FILTER (NOT g), count(*) FILTER (NOT b) FROM o1
UNION ALL SELECT 'lineitem', count(*), count(*) FILTER (NOT g), count(*) FILTER (NOT b) FROM lineitem JOIN o1 ON o_orderkey = l_orderkey
""")
def trash_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two regions and a nation go into the trash with all that refers to them, however far; one region comes back."""
    line = F.concat_ws("-", "l_orderkey", "l_linenumber")
    data = {n: table(spark, sf_dir, n) for n in ("region", "nation", "supplier", "customer", "orders")} | {"lineitem": table(spark, sf_dir, "lineitem").withColumn("line", line)}
    graph = Graph({"region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey", "orders": "o_orderkey", "lineitem": "line"}, {"nation": {"n_regionkey": "region"}, "supplier": {"s_nationkey": "nation"}, "customer": {"c_nationkey": "nation"}, "orders": {"o_custkey": "customer"}, "lineitem": {"l_orderkey": "orders"}})
    tables, since = Tables(spark), F.lit("2024-01-01").cast("timestamp").alias("since")
    pick = lambda name, column, where: data[name].where(where).select(F.col(column).alias("id"), since)
    stones = graph.trashed(data, "region", pick("region", "r_regionkey", "r_regionkey in (1, 3)"), tables).unionByName(graph.trashed(data, "nation", pick("nation", "n_nationkey", "n_nationkey = 0"), tables))
    first = graph.live(data, stones)
    second = graph.live(data, graph.restored(stones, "region", pick("region", "r_regionkey", "r_regionkey = 1")))
    out = None
    for name, df in data.items():
        n = lambda x, to: x.agg(F.count("*").alias(to)).withColumn("name", F.lit(name))  # noqa: B023, E731  used at once
        part = n(df, "n").join(n(first[name], "trashed"), "name").join(n(second[name], "restored"), "name").select("name", "n", "trashed", "restored")
        out = part if out is None else out.unionByName(part)
    return out


@query("""
WITH l AS (SELECT user_id AS project, event_type AS kind, event_id % 4000 AS candidate, CASE WHEN event_id % 7 = 0 THEN 'saved' WHEN value > 50 THEN 'accepted' ELSE 'rejected' END AS action, round(value, 6) AS value, event_id AS seq FROM events),
first AS (SELECT candidate, min(seq) AS first FROM l WHERE action <> 'saved' GROUP BY 1),
good AS (SELECT l.* FROM l LEFT JOIN first USING (candidate) WHERE action = 'saved' OR action = 'accepted' AND seq = first),
chain AS (SELECT *, row_number() OVER (PARTITION BY project, kind ORDER BY seq) AS revision, count(*) OVER (PARTITION BY project, kind) AS last FROM good)
SELECT 'bible_' || project || '_' || kind AS entry_id, revision, value, seq, CASE action WHEN 'saved' THEN 'manual' ELSE 'candidate' END AS source, revision = last AS current FROM chain
""")
def bible_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each user's bible through accepted candidates and saves by hand, in one chain."""
    action = F.when(F.col("event_id") % 7 == 0, "saved").when(F.col("value") > 50, "accepted").otherwise("rejected")
    candidate = F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 4000)
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("project"), F.col("event_type").alias("kind"), candidate.alias("candidate"), action.alias("action"), F.round("value", 6).alias("value"), F.col("event_id").alias("seq"))
    revisions, _ = review.bible_log(log, Tables(spark))
    return revisions.drop("project", "kind")


@query("""
WITH d AS (SELECT doc_id, lang, source FROM documents)
SELECT doc_id, 7.0::DOUBLE AS id, CASE WHEN doc_id % 2 = 0 THEN '未命名角色' ELSE ' ' || source END AS name, CASE WHEN doc_id % 3 = 0 THEN '次要角色' ELSE lang END AS role, '青年（25–35）' AS age, CASE WHEN doc_id % 3 = 1 THEN '待完善' ELSE lang || '|' || source END AS personality, '待补充' AS goal FROM d
UNION ALL SELECT doc_id, 2.0, '未命名角色', '次要角色', '青年（25–35）', '待完善', '待补充' FROM d
""")
def normalized_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two characters a document as a model may answer them: fields of the wrong kind, blank or missing, and no object."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    text = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    name = F.when(n % 2 == 0, F.lit('"　"')).otherwise(text(F.concat(F.lit(" "), "source")))
    role = F.when(n % 3 == 0, F.lit("5")).otherwise(text(F.col("lang")))
    traits = F.when(n % 3 == 1, F.lit('[1, " ", null]')).otherwise(F.concat(F.lit("["), text(F.col("lang")), F.lit(', 3, "", '), text(F.col("source")), F.lit("]")))
    item = F.concat(F.lit('{"id": 7, "name": '), name, F.lit(', "role": '), role, F.lit(', "personality": '), traits, F.lit(', "goal": null}'))
    rows = d.select("doc_id", F.concat(F.lit("["), item, F.lit(', "none"]')).alias("payload"))
    found = review.normalized_characters(rows, "doc_id", "payload")
    return found.select("doc_id", "id", "name", "role", "age", F.array_join("personality", "|").alias("personality"), "goal")
