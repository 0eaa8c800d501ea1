"""Canon queries over analyses that are derived from documents and their labels: a book's names are the first words of
its chapters, the evidence is their first lines, and labels decide the review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import canon
from leafmill.plans._base import query, table
from leafmill.plans.structure import books

ANALYSES = """
docs AS (SELECT source AS book, doc_id AS chapter, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ordinal, text, n_chars, string_split(text, ' ') AS ws, string_split(text, chr(10)) AS ls FROM documents),
analyses AS (
  SELECT d.*, CASE WHEN l.quality = 1 THEN 'accepted' WHEN l.quality = 0 THEN 'rejected' ELSE 'draft' END AS status, (n_chars % 100) / 100.0 AS confidence
  FROM docs d LEFT JOIN labels l ON l.doc_id = d.chapter
),
accepted AS (SELECT * FROM analyses WHERE status = 'accepted'),
mentions AS (
  SELECT book, chapter, ordinal, confidence, ls, 0 AS o, 'character' AS kind, i, ws[i + 1] AS name FROM accepted, range(4) r(i) WHERE i < len(ws)
  UNION ALL SELECT book, chapter, ordinal, confidence, ls, 1, 'location', i, ws[i + 5] FROM accepted, range(2) r(i) WHERE i + 4 < len(ws)
),
named AS (SELECT *, regexp_replace(name, '^\\s+|\\s+$', '', 'g') AS clean, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS norm FROM mentions)
"""


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = books(spark, sf_dir).select("doc_id", "ordinal")
    docs = table(spark, sf_dir, "documents").join(numbered, "doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    words, lines = F.split("text", " ", -1), F.split("text", "\n", -1)
    claims = F.transform(F.slice(lines, 1, 3), lambda x, i: F.struct(x.alias("claim"), F.array(F.concat_ws(":", F.col("doc_id").cast("string"), i.cast("string"))).alias("segment_ids")))
    return docs.select(
        F.col("source").alias("book"),
        F.col("doc_id").alias("chapter"),
        "ordinal",
        F.when(F.col("quality") == 1, "accepted").when(F.col("quality") == 0, "rejected").otherwise("draft").alias("status"),
        F.slice(words, 1, 4).alias("characters"),
        F.slice(words, 5, 2).alias("locations"),
        F.array().cast("array<string>").alias("world_terms"),
        F.transform(F.slice(words, 1, 2), lambda w: F.struct(w.alias("source"), F.element_at(words, -1).alias("target"), F.col("lang").alias("type"), F.element_at(lines, 1).alias("description"))).alias("relationships"),
        F.transform(F.slice(words, 1, 3), lambda w: F.struct(w.alias("name"), F.element_at(lines, -1).alias("description"))).alias("world_rules"),
        F.transform(F.slice(lines, 1, 2), lambda x: F.struct(x.alias("title"), F.col("lang").alias("description"), F.col("source").alias("time_marker"))).alias("timeline_events"),
        F.transform(F.slice(lines, 2, 2), lambda x: F.struct(x.alias("setup"), F.lit(None).cast("string").alias("possible_payoff"))).alias("foreshadowing"),
        claims.alias("evidence"),
        ((F.col("n_chars") % 100) / 100.0).alias("confidence"),
        F.slice(lines, -1, 1).alias("uncertainties"),
    )


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses(spark, sf_dir).where("status = 'accepted'")


@query(f"""
WITH {ANALYSES}, ev AS (
  SELECT book, kind, norm, ordinal, chapter, o, i, k, chapter || ':' || k AS seg FROM named, range(3) e(k)
  WHERE clean <> '' AND k < len(ls) AND len(list_filter(string_split(norm, ' '), lambda t: t <> '' AND contains(lower(ls[k + 1]), t))) > 0
), evs AS (
  SELECT book, kind, norm, string_agg(seg, ',' ORDER BY ordinal, chapter, o, i, k) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY book, kind, norm, seg ORDER BY ordinal, chapter, o, i, k) AS rn FROM ev) WHERE rn = 1 GROUP BY ALL
), chs AS (SELECT book, kind, norm, string_agg(chapter::VARCHAR, ',' ORDER BY ordinal) AS chapters FROM (SELECT DISTINCT book, kind, norm, chapter, ordinal FROM named WHERE clean <> '') GROUP BY ALL)
SELECT g.book, g.kind, g.name, g.mentions, c.chapters, coalesce(e.evidence, '') AS evidence, g.confidence FROM (
  SELECT book, kind, norm, arg_min(clean, (ordinal, chapter, o, i)) AS name, count(*) AS mentions, round(max(confidence), 6)::DOUBLE AS confidence FROM named WHERE clean <> '' GROUP BY book, kind, norm
) g JOIN chs c USING (book, kind, norm) LEFT JOIN evs e USING (book, kind, norm)
""")
def canon_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = canon.entities(accepted(spark, sf_dir))
    return found.select("book", "kind", "name", "mentions", F.array_join(F.transform("chapters", lambda c: c.cast("string")), ",").alias("chapters"), F.array_join("evidence", ",").alias("evidence"), F.round("confidence", 6).alias("confidence"))


FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)), lambda h, u: ((xor(h, u) * 16777619) & 4294967295)::BIGINT)"
#: Segments of a chapter's evidence: those whose claim holds a term first, then all of the chapter.
EVIDENCE = """
cited AS (SELECT DISTINCT k.*, chapter || ':' || n AS seg, n, len(list_filter(string_split(lower(trim(regexp_replace(claim, '\\s+', ' ', 'g'))), ' '), lambda t: t <> '' AND contains(lower(ls[n + 1]), t))) = 0 AS later FROM keyed k, range(3) r(n) WHERE n < len(ls)),
firsts AS (SELECT book, key, seg, min((ordinal, chapter, i, later, n)) AS place FROM cited GROUP BY 1, 2, 3),
evidence AS (SELECT book, key, string_agg(seg, ',' ORDER BY place) AS evidence FROM firsts GROUP BY 1, 2)
"""


@query(f"""
WITH {ANALYSES}, rels AS (SELECT a.book, chapter, ordinal, confidence, ls, i, ws[i + 1] AS s, ws[len(ws)] AS t, CASE WHEN chapter % 4 > 0 THEN lang ELSE ' ' END AS ty, ls[1] AS d FROM accepted a JOIN documents ON doc_id = chapter, range(2) r(i) WHERE i < len(ws)),
keyed AS (SELECT *, s || ' ' || t || ' ' || ty AS claim, concat_ws(':', lower(trim(regexp_replace(s, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))), ty) AS key FROM rels WHERE trim(regexp_replace(s, '\\s+', ' ', 'g')) <> '' AND trim(regexp_replace(t, '\\s+', ' ', 'g')) <> '' AND trim(ty) <> ''),
{EVIDENCE}
SELECT g.*, e.evidence FROM (
  SELECT book, arg_min(trim(s, ' ' || chr(10) || chr(9)), (ordinal, chapter, i)) AS source, arg_min(trim(t, ' ' || chr(10) || chr(9)), (ordinal, chapter, i)) AS target, arg_min(ty, (ordinal, chapter, i)) AS type, count(DISTINCT chapter) AS chapters, round(max(confidence), 6)::DOUBLE AS confidence, 'relation_' || lower(printf('%08x', {FNV.format('key')})) AS id, key FROM keyed GROUP BY book, key
) g JOIN evidence e USING (book, key)
""".replace("SELECT g.*, e", "SELECT g.book, source, target, type, chapters, confidence, id, e"))
def canon_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of every fourth chapter have no type and are dropped."""
    rows = accepted(spark, sf_dir)
    typed = F.when(F.col("chapter") % 4 == 0, F.transform("relationships", lambda r: r.withField("type", F.lit(" ")))).otherwise(F.col("relationships"))
    found = canon.relationships(rows.withColumn("relationships", typed))
    return found.select("book", "source", "target", "type", F.size("chapters").cast("long").alias("chapters"), F.round("confidence", 6).alias("confidence"), "id", F.array_join("evidence", ",").alias("evidence"))


@query(f"""
WITH {ANALYSES}, r AS (SELECT book, chapter, ordinal, ls, i, ws[i + 1] AS name, ls[len(ls)] AS d FROM accepted, range(3) r(i) WHERE i < len(ws)),
keyed AS (SELECT *, name || ' ' || d AS claim, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS key FROM r WHERE trim(regexp_replace(name, '\\s+', ' ', 'g')) <> ''),
{EVIDENCE}
SELECT g.book, name, chapters, descriptions, evidence FROM (
  SELECT book, key, arg_min(regexp_replace(name, '^\\s+|\\s+$', '', 'g'), (ordinal, chapter, i)) AS name, count(DISTINCT chapter) AS chapters, count(DISTINCT regexp_replace(d, '^\\s+|\\s+$', '', 'g')) FILTER (WHERE trim(d) <> '') AS descriptions FROM keyed GROUP BY book, key
) g JOIN evidence USING (book, key)
""")
def canon_world_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = canon.world_rules(accepted(spark, sf_dir))
    return found.select("book", "name", F.size("chapters").cast("long").alias("chapters"), F.size("descriptions").cast("long").alias("descriptions"), F.array_join("evidence", ",").alias("evidence"))


@query(f"""
WITH {ANALYSES}, e AS (SELECT book, chapter, ordinal, confidence, i, CASE WHEN chapter % 5 > 0 THEN ls[i + 1] ELSE '' END AS title, ls FROM accepted, range(2) r(i) WHERE i < len(ls))
SELECT book, chapter, ordinal, i::INT AS i, md5(regexp_replace(title, '^\\s+|\\s+$', '', 'g')) AS title, least(len(ls), 3) AS evidence, round(confidence, 6)::DOUBLE AS confidence, 'event_' || lower(printf('%08x', {FNV.format("chapter || ':' || i || ':' || title")})) AS id FROM e
""")
def canon_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events have their language as description; those of every fifth chapter have no title and stay."""
    untitled = F.when(F.col("chapter") % 5 == 0, F.transform("timeline_events", lambda e: e.withField("title", F.lit("")))).otherwise(F.col("timeline_events"))
    found = canon.timeline(accepted(spark, sf_dir).withColumn("timeline_events", untitled))
    return found.select("book", "chapter", F.col("ordinal").cast("long").alias("ordinal"), "i", F.md5("title").alias("title"), F.size("evidence").cast("long").alias("evidence"), F.round("confidence", 6).alias("confidence"), "id")


@query(f"""
WITH {ANALYSES}
SELECT book, chapter, i::INT AS i, md5(regexp_replace(ls[i + 2], '^\\s+|\\s+$', '', 'g')) AS setup, 'setup_' || lower(printf('%08x', {FNV.format("chapter || ':' || i || ':' || ls[i + 2]")})) AS id FROM accepted, range(2) r(i) WHERE i + 1 < len(ls) AND regexp_replace(ls[i + 2], '\\s', '', 'g') <> ''
""")
def canon_foreshadowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.foreshadowing(accepted(spark, sf_dir)).select("book", "chapter", "i", F.md5("setup").alias("setup"), "id")


@query(f"""
WITH {ANALYSES} SELECT book, chapter, md5(ls[len(ls)]) AS note FROM accepted WHERE ls[len(ls)] <> ''
""")
def canon_uncertainties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.uncertainties(accepted(spark, sf_dir)).select("book", "chapter", F.md5("note").alias("note"))


@query("""
SELECT doc_id AS chapter, doc_id || ':' || k AS segment_id FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), range(3) r(k) WHERE k < len(ls) AND length(ls[k + 1]) < 20
""")
def foreign_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that cites a line under 20 characters, which counts as no segment here."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chapter"), F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))
    segments = lines.where("length(line) >= 20").select("chapter", F.concat_ws(":", F.col("chapter").cast("string"), F.col("k").cast("string")).alias("segment_id"))
    return canon.foreign_evidence(analyses(spark, sf_dir), segments)


@query("SELECT d.doc_id AS chapter, 't' || d.doc_id AS title, l.quality FROM documents d JOIN labels l USING (doc_id)")
def analyses_of_known_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as analyses, half of them of chapters that do not exist, with the chapters' titles."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chapter"), "quality")
    rows = labels.unionByName(labels.withColumn("chapter", -F.col("chapter") - 1)).withColumn("title", F.lit("old"))
    chapters = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chapter"), F.lit(0).alias("ordinal"), F.concat(F.lit("t"), F.col("doc_id")).alias("title"))
    return canon.with_known_chapters(rows, chapters, ["chapter"]).select("chapter", "title", "quality")


@query("SELECT doc_id AS chapter FROM labels WHERE quality = 1 AND doc_id % 3 = 1")
def foreign_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished analyses of chapters that a run without every third chapter does not have."""
    chapters = table(spark, sf_dir, "documents").where("doc_id % 3 <> 1").select(F.col("doc_id").alias("chapter"))
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chapter"), F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("status"))
    return canon.foreign_analyses(chapters, rows, ["chapter"]).select("chapter")


@query("""
SELECT d.source AS book, d.doc_id AS chapter FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality = 0
""")
def pending_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analyses(spark, sf_dir).select("book", "chapter", "status")
    return canon.pending(rows.select("book", "chapter"), rows, ["book", "chapter"])


@query(f"""
WITH {ANALYSES}, rels AS (SELECT book, ws[i + 1] AS source, ws[len(ws)] AS target FROM accepted, range(2) r(i) WHERE i < len(ws)),
n AS (SELECT *, lower(trim(regexp_replace(source, '\\s+', ' ', 'g'))) AS s, lower(trim(regexp_replace(target, '\\s+', ' ', 'g'))) AS t FROM rels),
names AS (SELECT DISTINCT book, norm FROM named WHERE kind = 'character' AND clean <> ''),
bad AS (SELECT book, reason FROM n, (SELECT unnest(list_filter([CASE WHEN NOT EXISTS (SELECT 1 FROM names m WHERE m.book = n.book AND m.norm = s) THEN 'unknown_source' END, CASE WHEN NOT EXISTS (SELECT 1 FROM names m WHERE m.book = n.book AND m.norm = t) THEN 'unknown_target' END, CASE WHEN s = t THEN 'self_loop' END], lambda x: x IS NOT NULL)) AS reason))
SELECT book, reason, count(*) AS n FROM bad GROUP BY ALL
""")
def relation_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = accepted(spark, sf_dir)
    relations = rows.select("book", F.explode("relationships").alias("r")).select("book", "r.source", "r.target")
    names = rows.select("book", F.explode("characters").alias("name")).where("trim(name) <> ''")
    return canon.unlinked_relations(relations, names).groupBy("book", "reason").agg(F.count("*").alias("n"))
