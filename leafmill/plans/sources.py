"""Source and sink queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import reasons
from leafmill.operators.infer import audited
from leafmill.plans._base import query, table
from leafmill.operators.structure import joined_digests
from leafmill.plans.structure import books, trim
from leafmill.scratch import Tables, dealt
from leafmill.sources import exports, files
from leafmill.streaming.library import Library


@query("SELECT url AS path, octet_length(encode(html))::BIGINT AS size, sha256(html) AS sha256, CASE WHEN regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1) IN ('txt', 'md') THEN 'text' END AS format FROM pages")
def binary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content"))
    return files.described(rows).select("path", "size", "sha256", "format")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'utf-8-bom' WHEN 1 THEN 'utf-16le' ELSE 'utf-8' END AS encoding, md5(text) AS digest FROM documents")
def decoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written in three encodings and read again."""
    m = F.col("doc_id") % 3
    content = F.when(m == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).when(m == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).otherwise(F.encode("text", "UTF-8"))
    return files.decoded(table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))).select("doc_id", "encoding", F.md5("text").alias("digest"))


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and text of every page, held against brute force in the tests."""
    return files.pages_text(table(spark, sf_dir, "pages"), "page_id").select("page_id", "title", F.length("text").alias("size"))


@query()
def epub_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page packed into an archive of its own and read again by its spine; tests hold the rules against cases."""
    from leafmill.sources.packing import packed

    archives = packed(table(spark, sf_dir, "pages"), "url", "html")
    return files.epub_chapters(archives).select("path", "position", "ordinal", "href", "title", F.length("text").alias("size"), "issue")


@query(f"""
WITH f AS (SELECT doc_id, sha256(CASE doc_id % 3 WHEN 0 THEN chr(65279) ELSE '' END || t) AS sha256, doc_id % 3 AS m, t FROM (SELECT doc_id, '　第1章 a' || chr(10) || coalesce(text, '') AS t FROM documents)),
one AS (SELECT m = 1 AS wide, t, m, min(doc_id) AS doc_id FROM f GROUP BY ALL),
bodies AS (SELECT doc_id, m, {trim("t[length('　第1章 a') + 2:]")} AS body FROM one),
lines AS (SELECT doc_id, {trim('line')} AS line FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM bodies))
SELECT 'd' || b.doc_id || CASE WHEN b.doc_id % 2 = 0 THEN '.txt' ELSE '.md' END AS name, CASE m WHEN 0 THEN 'utf-8-bom' WHEN 1 THEN 'utf-16le' ELSE 'utf-8' END AS encoding, 1 AS chapters, md5(body) AS digest,
  (SELECT count(*) FROM lines l WHERE l.doc_id = b.doc_id AND line <> '') AS segments FROM bodies b
""")
def file_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files in three encodings, with an indented heading, imported in two batches of which the second runs
    twice and repeats every fifth file of the first."""
    m, n = F.col("doc_id") % 3, F.col("doc_id") % 2
    text = F.concat(F.lit("　第1章 a\n"), F.coalesce("text", F.lit("")))
    content = F.when(m == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))).when(m == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).otherwise(F.encode(text, "UTF-8"))
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(n == 0, ".txt").otherwise(".md"))
    rows = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), content.alias("content"))
    # of equal contents the smallest id keeps its name
    first = rows.groupBy(F.sha2("content", 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    rows = rows.join(first, "doc_id", "left_semi").select("path", "content", "doc_id")
    kept = Library(spark, Tables(spark).path("library"))
    kept.add(rows.where("doc_id % 4 > 0").drop("doc_id"), "one")
    for _ in range(2):
        kept.add(rows.where("doc_id % 4 = 0 or doc_id % 5 = 0").drop("doc_id"), "two")
    segments = kept.table("segments").groupBy("chapter_id").agg(F.count("*").alias("n"))
    digests = kept.table("chapters").select("document_id", "chapter_id", F.md5("content").alias("digest"))
    chapters = digests.join(segments, "chapter_id", "left").groupBy("document_id").agg(F.count("*").cast("int").alias("chapters"), F.max("digest").alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("segments"))
    return kept.table("documents").join(chapters, "document_id").select(F.col("path").alias("name"), "encoding", "chapters", "digest", "segments")


@query("SELECT source, sha256(text) AS sha256, min(doc_id)::VARCHAR AS path, count(*) AS copies FROM documents GROUP BY ALL")
def preserved_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("sha256"), F.col("text").alias("content"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"))
    return files.preserved(rows, "source").select("source", "sha256", F.col("path").cast("long").cast("string").alias("path"), "copies")


TEXT = trim("text")


@query(f"""
SELECT source, md5(source || chr(10) || chr(10) || string_agg('第' || n || '章 ' || lang || chr(10) || chr(10) || {TEXT}, chr(10) || chr(10) ORDER BY n)) AS plain,
       md5('# ' || source || chr(10) || chr(10) || string_agg('## 第' || n || '章 ' || lang || chr(10) || chr(10) || {TEXT}, chr(10) || chr(10) ORDER BY n) || chr(10)) AS markdown
FROM (SELECT source, lang, doc_id, CASE WHEN doc_id % 10 = 1 THEN chr(10) || chr(9) || '　' WHEN doc_id % 10 = 4 THEN '　　' || text || chr(160) ELSE text END AS text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents) WHERE doc_id % 3 > 0 AND doc_id % 10 <> 1 GROUP BY source
""")
def manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sinks over the chapters that have a draft; a tenth of the drafts is blank, a tenth has wide spaces around it."""
    plan = books(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").drop("text")
    m = F.col("doc_id") % 10
    text = F.when(m == 1, "\n\t　").when(m == 4, F.concat(F.lit("　　"), "text", F.lit("\u00a0"))).otherwise(F.col("text"))
    drafts = table(spark, sf_dir, "documents").where("doc_id % 3 > 0").select("doc_id", text.alias("text"))
    rows = exports.selected(plan, drafts, ["doc_id"], "text")
    plain = exports.manuscript_digests(rows, "source", "ordinal", "lang", "text").withColumnRenamed("digest", "plain")
    marked = exports.manuscript_digests(rows, "source", "ordinal", "lang", "text", True).withColumnRenamed("digest", "markdown")
    return plain.join(marked, "source")


@query(f"""
WITH c AS (SELECT source, lang, coalesce(text, '') AS text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents),
plain AS (SELECT source, source || chr(10) || chr(10) || string_agg('第' || n || '章 ' || lang || chr(10) || chr(10) || {TEXT}, chr(10) || chr(10) ORDER BY n) || chr(10) AS book FROM c GROUP BY source),
raw AS (SELECT source, string_agg(concat_ws(chr(10), lang, text), chr(10) || chr(10) ORDER BY n) || chr(10) AS book FROM c GROUP BY source),
marked AS (SELECT source, '# ' || source || chr(10) || chr(10) || string_agg('## 第' || n || '章 ' || lang || chr(10) || chr(10) || {TEXT}, chr(10) || chr(10) ORDER BY n) || chr(10) AS book FROM c GROUP BY source)
SELECT source, 'plain' AS kind, md5(book) AS digest, octet_length(encode(book))::BIGINT AS bytes FROM plain UNION ALL SELECT source, 'markdown', md5(book), octet_length(encode(book))::BIGINT FROM marked
UNION ALL SELECT source, 'raw', md5(book), octet_length(encode(book))::BIGINT FROM raw
""")
def manuscript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books written as text files by many tasks, plain, marked and as raw text, and read again file by file."""
    tables, out = Tables(spark), None
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    rows = exports.numbered(exports.shelved(docs, "source", ["doc_id"], tables), "source", "ordinal", tables)  # dealt once for all
    for kind in ("plain", "markdown", "raw"):
        path = tables.path(kind)
        if kind == "raw":
            exports.write_books(rows.withColumn("both", F.concat_ws("\n", "lang", "text")), "source", "ordinal", "both", path, tables)
        else:
            exports.write_manuscripts(rows, "source", "ordinal", "lang", "text", path, tables, kind == "markdown")
        files_ = exports.read_books(spark, path, "source")
        size = files_.groupBy("source").agg(F.sum(F.octet_length("text")).cast("long").alias("bytes"))
        part = joined_digests(files_, "source", "file", "text", between="").join(size, "source").select("source", F.lit(kind).alias("kind"), "digest", "bytes")
        out = part if out is None else out.unionByName(part)
    return out


@query("""
SELECT c_custkey || '-r' AS project_id, status, count(*) AS n FROM (SELECT c_custkey, CASE o_orderstatus WHEN 'O' THEN 'paused' ELSE o_orderstatus END AS status FROM customer JOIN orders ON o_custkey = c_custkey) GROUP BY ALL
UNION ALL SELECT o_custkey || '-r', 'revision ' || rn, sum(l_linenumber)::BIGINT FROM (SELECT o_custkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS rn FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey) GROUP BY 1, 2
""")
def bundle_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects written as a bundle, read again and restored under new ids: running tasks pause, versions are replayed."""
    projects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"))
    made, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    orders = made.join(dealt(projects, "project_id", like=made), F.col("o_custkey") == F.col("project_id"), "left_semi")
    tasks = orders.select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("project_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise(F.col("o_orderstatus")).alias("status"))
    chapters = orders.select(F.col("o_orderkey").alias("chapter_id"), F.col("o_custkey").alias("project_id"), F.col("o_orderpriority").alias("title"))
    # versions with gaps in their revisions, the last line first
    versions = lines.join(dealt(chapters, "chapter_id", like=lines), F.col("l_orderkey") == F.col("chapter_id"), "left_semi").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("version_id"), F.col("l_orderkey").alias("chapter_id"), (100 - 3 * F.col("l_linenumber")).alias("revision"), F.col("l_linenumber").alias("line"))
    path = Tables(spark).path("bundle")
    exports.write_bundle({"projects": projects, "chapters": chapters, "versions": versions, "task_runs": tasks}, path)
    back = exports.restored(exports.read_bundle(spark, path), "-r")
    replayed = dealt(back["versions"], "chapter_id", like=lines).join(back["chapters"].select("chapter_id", "project_id"), "chapter_id")
    replayed = dealt(replayed, "project_id", like=lines).groupBy("project_id", F.concat(F.lit("revision "), "revision").alias("status")).agg(F.sum("line").cast("long").alias("n"))
    return dealt(back["task_runs"], "project_id", like=made).groupBy("project_id", "status").agg(F.count("*").alias("n")).unionByName(replayed)


def upper(text: str) -> str:
    """Upper case letter by letter, as SQL's: one letter for one, where Python's makes two of some (ß, ŉ)."""
    return "".join(next((u for u in (c.upper(), c.title(), {"ß": "ẞ"}.get(c, c)) if len(u) == 1), c) for c in text)


@query("""
WITH p AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, upper(coalesce(text, '')[1:1] || length(coalesce(text, ''))) AS made FROM documents), known AS (SELECT h FROM p WHERE doc_id % 3 = 0)
SELECT doc_id, CASE WHEN h IN (FROM known) THEN 'kept' WHEN length(made) % 4 <> 0 THEN made END AS result, CASE WHEN h IN (FROM known) THEN 'reused' WHEN length(made) % 4 = 0 THEN 'invalid: size' ELSE 'ok' END AS outcome FROM p
""")
def batch_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inference hook with a deterministic stand-in: a third of the inputs was answered before, some answers are
    refused."""
    docs, text = table(spark, sf_dir, "documents"), F.coalesce("text", F.lit(""))
    requests = docs.select("doc_id", F.lit("p").alias("project"), F.lit("k").alias("kind"), F.sha2(text, 256).alias("input_hash"), text.alias("prompt"))
    runs = requests.where("doc_id % 3 = 0").select("project", "kind", "input_hash", F.lit("succeeded").alias("status"), F.lit("kept").alias("result"), F.col("doc_id").alias("seq"))
    results, _ = audited(requests, runs, lambda t: upper(f"{t[:1]}{len(t)}"), reasons((F.length("result") % 4 == 0, "size")))
    return results.select("doc_id", "result", "outcome")


@query(f"""
WITH lines AS (SELECT doc_id, i, line, regexp_matches(line, '^\\s*(?:第[〇零一二三四五六七八九十百千万两0-9]+[卷部篇章节回])(?:[\\s　:：、.-]+.*)?\\s*$') AS head FROM (SELECT doc_id, i, ls[i + 1] AS line FROM (SELECT doc_id, string_split('第1章 a' || chr(10) || coalesce(text, '') || chr(10) || '第2章' || chr(10) || 'end', chr(10)) AS ls FROM documents), range(len(ls)) r(i)))
SELECT doc_id, count(*) FILTER (WHERE head)::INT AS chapters, (SELECT length({trim("coalesce(text, '')")}) FROM documents d WHERE d.doc_id = l.doc_id)::INT AS first_size FROM lines l GROUP BY doc_id
""")
def chapter_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function from SQL, with a lateral join, over documents with a heading before and behind them."""
    from leafmill.operators.infer import register_functions

    register_functions(spark)
    text = F.concat(F.lit("第1章 a\n"), F.coalesce("text", F.lit("")), F.lit("\n第2章\nend"))
    table(spark, sf_dir, "documents").select("doc_id", text.alias("text")).createOrReplaceTempView("leafmill_documents")
    return spark.sql("SELECT doc_id, cast(count(*) AS int) AS chapters, cast(max(CASE WHEN ordinal = 0 THEN length(content) END) AS int) AS first_size FROM leafmill_documents d, LATERAL text_chapters(d.text) GROUP BY doc_id")


@query("SELECT doc_id, count(*) AS chapters FROM (SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents) GROUP BY 1")
def line_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function that cuts at a separator, from SQL with a lateral join."""
    from leafmill.operators.infer import register_functions

    register_functions(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("leafmill_lines")
    return spark.sql("SELECT doc_id, count(*) AS chapters FROM leafmill_lines d, LATERAL text_pieces(d.text, char(10)) GROUP BY doc_id")
