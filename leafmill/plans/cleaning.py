"""Cleaning queries. The share of chapters that a repeated line needs is 5 % here: no line of these tables has 60 %. Page
lines, of which the documents have none, are put behind each text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import cleaning
from leafmill.plans._base import query, table
from leafmill.plans.structure import WS, trim

PAGED = """
docs AS (SELECT doc_id, source, coalesce(text, '') || chr(10) || '- ' || doc_id || ' -' || chr(10) || '第 ' || doc_id || ' 页' || chr(10) || doc_id || '00000' || chr(10) || 'page 3' AS text FROM documents)"""
EDGES = f"""
trimmed AS (SELECT source, doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: {trim('l')}), lambda l: l <> '') AS ls FROM docs),
edges AS (SELECT DISTINCT source, doc_id, line FROM (SELECT source, doc_id, unnest(list_concat(ls[:2], ls[greatest(1, len(ls) - 1):])) AS line FROM trimmed) WHERE length(line) BETWEEN 2 AND 80),
total AS (SELECT source, count(*) AS chapters FROM docs GROUP BY source),
repeated AS (SELECT source, line, count(*) AS n FROM edges JOIN total USING (source) GROUP BY source, line, chapters HAVING count(*) >= greatest(3, ceil(chapters * 0.05)))
"""
#: Every line with its trimmed form and whether it goes as a page number, a repeated edge or a blocked line.
MARKED = f"""
rows AS (SELECT d.doc_id, d.source, d.text, string_split(regexp_replace(d.text, '\\r\\n?', chr(10), 'g'), chr(10)) AS ls, coalesce((SELECT list(line) FROM repeated r WHERE r.source = d.source), []) AS gone FROM docs d),
marked AS (
  SELECT doc_id, i, raw, regexp_replace(raw, '[{WS}]+$', '') AS line, bare, list_contains(gone, bare) OR BLOCKED OR regexp_matches(bare, '^\\s*(?:第\\s*)?[0-9]+\\s*页\\s*$') OR regexp_matches(bare, '^[-—–]?\\s*[0-9]+\\s*[-—–]?$') AS drop_it
  FROM (SELECT doc_id, gone, i, ls[i + 1] AS raw, {trim('ls[i + 1]')} AS bare FROM rows, range(len(ls)) r(i))
)"""


def squeezed(x: str) -> str:
    return trim(f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n- "), n, F.lit(" -\n第 "), n, F.lit(" 页\n"), n, F.lit("00000\npage 3"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", text.alias("text"))


@query(f"WITH {PAGED}, {EDGES} SELECT source, line, n FROM repeated".replace("coalesce(text, '') || chr(10) || '- ' || doc_id || ' -' || chr(10) || '第 ' || doc_id || ' 页' || chr(10) || doc_id || '00000' || chr(10) || 'page 3'", "coalesce(text, '')"))
def repeated_edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.repeated_edges(table(spark, sf_dir, "documents"), "source", "text", 0.05)


@query(f"""
WITH {PAGED}, {EDGES}, {MARKED.replace('BLOCKED', "contains(bare, 'License')")},
kept AS (SELECT doc_id, i, line, raw, drop_it OR coalesce(bare <> '' AND above = bare, false) AS drop_it FROM (SELECT *, lag(bare) OVER (PARTITION BY doc_id, drop_it ORDER BY i) AS above FROM marked) m),
texts AS (SELECT doc_id, {squeezed("coalesce(string_agg(CASE WHEN NOT drop_it THEN line END, chr(10) ORDER BY i), '')")} AS clean, count(*) FILTER (WHERE drop_it) AS removed, coalesce(sum(length(raw)) FILTER (WHERE drop_it), 0) AS characters FROM kept GROUP BY doc_id)
SELECT source, count(*) FILTER (WHERE clean <> {trim("regexp_replace(text, '\\r\\n?', chr(10), 'g')")}) AS changed_chapters, sum(removed)::BIGINT AS removed_lines, 0::BIGINT AS joined_lines, sum(characters)::BIGINT AS removed_characters
FROM texts JOIN rows USING (doc_id) GROUP BY source
""")
def cleaning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated edges, page numbers, blocked fragments and duplicate lines; hard wraps stay."""
    done = cleaning.cleaned(paged(spark, sf_dir), "source", "text", min_share=0.05, blocked=[" License "], unwrap=False)
    return cleaning.report(done, "source")


@query(f"""
WITH RECURSIVE {PAGED}, {EDGES}, {MARKED.replace('BLOCKED', 'false')},
live AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM marked WHERE NOT drop_it),
fold AS (
  SELECT doc_id, 0::BIGINT AS rn, '' AS done, NULL::VARCHAR AS last, 0 AS again, 0 AS joined FROM docs
  UNION ALL
  SELECT f.doc_id, l.rn, CASE WHEN last IS NULL OR l.bare <> '' AND {trim('last')} = l.bare OR glue THEN done ELSE done || last || chr(10) END,
         CASE WHEN last IS NOT NULL AND l.bare <> '' AND {trim('last')} = l.bare THEN last WHEN glue THEN last || l.bare ELSE l.line END,
         again + (last IS NOT NULL AND l.bare <> '' AND {trim('last')} = l.bare)::INT, joined + (glue AND {trim('last')} <> l.bare)::INT
  FROM fold f JOIN live l ON l.doc_id = f.doc_id AND l.rn = f.rn + 1,
       (SELECT coalesce(l.bare <> '' AND {trim('last')} <> '' AND NOT regexp_matches({trim('last')}, '[。！？!?；;：:“”」』）)]$') AND NOT regexp_matches(l.raw, '^[{WS}]'), false) AS glue)
), final AS (SELECT doc_id, {squeezed("done || coalesce(last, '')")} AS clean, again, joined FROM fold WHERE (doc_id, rn) IN (SELECT (doc_id, max(rn)) FROM fold GROUP BY doc_id))
SELECT f.doc_id, (f.again + (SELECT count(*) FROM marked m WHERE m.doc_id = f.doc_id AND drop_it))::INT AS removed_lines, joined AS joined_lines, md5(clean) AS digest FROM final f
""")
def unwrapped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job with hard wraps joined, one line after the other."""
    done = cleaning.cleaned(paged(spark, sf_dir), "source", "text", min_share=0.05)
    return done.select("doc_id", "removed_lines", "joined_lines", F.md5("clean").alias("digest"))


@query(f"""
SELECT source, title, n FROM (SELECT source, {trim("string_split(coalesce(text, ''), chr(10))[1]")} AS title, count(*) AS n FROM documents GROUP BY 1, 2) WHERE n > 1
""")
def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines that several chapters of a book share."""
    title = cleaning.trimmed(F.element_at(F.split(F.coalesce("text", F.lit("")), "\n", -1), 1))
    return table(spark, sf_dir, "documents").groupBy("source", title.alias("title")).agg(F.count("*").alias("n")).where("n > 1")


@query("""
SELECT source, count(*) AS duplicate_lines FROM (
  SELECT source, doc_id, ls[i + 1] AS line, ls[i] AS above FROM (SELECT source, doc_id, string_split(text, chr(10)) AS ls FROM documents), range(1, len(ls)) r(i)
) WHERE line = above AND line <> '' GROUP BY source
""")
def duplicate_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("text", "\n", -1)
    pairs = F.zip_with(F.slice(parts, 2, F.size(parts)), parts, lambda a, b: ((a == b) & (a != "")).cast("int"))
    rows = table(spark, sf_dir, "documents").select("source", F.aggregate(F.filter(pairs, lambda x: x.isNotNull()), F.lit(0), lambda s, x: s + x).alias("n"))
    return rows.groupBy("source").agg(F.sum("n").alias("duplicate_lines")).where("duplicate_lines > 0")
