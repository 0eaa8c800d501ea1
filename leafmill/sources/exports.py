"""Manuscripts and project bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import trimmed
from leafmill.operators.structure import joined_digests
from leafmill.scratch import Tables, dealt

FORMAT, VERSION = "leafmill-bundle", 1
REQUIRED = ("projects", "chapters")
#: The folders of a book's files, named in their order.
PIECE = "leafmill_piece"
#: Bytes of text for each range of ``shelved``, and so about the most for a file of a book, which is read as one value.
RANGE = 16_000_000


def selected(plan: DataFrame, drafts: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Planned chapters that have a draft which is not blank."""
    return plan.join(drafts, keys).where(trimmed(F.col(content)) != "")


def _part(number: str, title: str, content: str, markdown: bool) -> Column:
    head = F.concat(F.lit("## " if markdown else ""), F.lit("第"), F.col(number).cast("string"), F.lit("章 "), F.col(title))
    return F.concat(head, F.lit("\n\n"), trimmed(F.col(content)))


def manuscripts(chapters: DataFrame, book: str, number: str, title: str, content: str, markdown: bool = False) -> DataFrame:
    """(book, manuscript): a heading and the trimmed content of each chapter, in order, blank lines between."""
    part = _part(number, title, content, markdown)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), part.alias("p")))), lambda s: s["p"]), "\n\n")
    grouped = chapters.groupBy(book).agg(body.alias("body"))
    name = F.col(book).cast("string")
    whole = F.concat(F.lit("# "), name, F.lit("\n\n"), "body", F.lit("\n")) if markdown else F.concat(name, F.lit("\n\n"), "body")
    return grouped.select(book, whole.alias("manuscript"))


def manuscript_digests(chapters: DataFrame, book: str, number: str, title: str, content: str, markdown: bool = False) -> DataFrame:
    """(book, digest): the MD5 of each of ``manuscripts``, which need not fit into one value."""
    head = F.concat(F.lit("# " if markdown else ""), F.col(book).cast("string"), F.lit("\n\n"))
    return joined_digests(chapters.withColumn("_text", _part(number, title, content, markdown)), book, number, "_text", head=head, tail="\n" if markdown else "")


def shelved(rows: DataFrame, book: str, order: list[str], tables: Tables) -> DataFrame:
    """The rows with ``leafmill_at``, which grows with book and order, and the block of their file. They are dealt by
    ranges of book and order and written in that order, so a long book lies in many ranges, one for every RANGE bytes of
    text at any size; ``write_books`` takes such rows as they lie, any number of times."""
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c, kind in rows.dtypes if kind in ("string", "binary")]
    n = -(-(rows.agg(F.sum(sum(sizes, F.lit(0)))).first()[0] or 0) // RANGE)
    ranges = rows.repartitionByRange(n, book, *order) if n > 1 else rows.repartitionByRange(book, *order)
    shelf = ranges.sortWithinPartitions(book, *order).withColumn("leafmill_at", F.monotonically_increasing_id())
    return tables.save(shelf, "shelf").select("*", F.col("_metadata.file_block_start").alias("leafmill_block"))


def numbered(shelf: DataFrame, book: str, out: str, tables: Tables) -> DataFrame:
    """The rows of ``shelved`` with ``out``, their number in the book from 0 on. A row's place in its range is known, so
    only the counts of a range's books are joined, one row for each book and range."""
    held = F.call_function("shiftright", F.col("leafmill_at"), F.lit(33))
    sizes = shelf.groupBy(F.col(book).alias("_book"), held.alias("_range")).agg(F.min("leafmill_at").alias("_begin"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("_book").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = tables.save(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"), "begins")
    here = shelf.join(F.broadcast(begins), F.col(book).eqNullSafe(F.col("_book")) & (held == F.col("_range")))
    return here.withColumn(out, (F.col("leafmill_at") - F.col("_begin") + F.col("_before")).cast("long")).drop("_book", "_range", "_begin", "_before")


def write_books(parts: DataFrame, book: str, order: str, part: str, path: str, tables: Tables, head: Column | None = None, between: str = "\n\n", tail: str = "\n") -> DataFrame:
    """Write each book's parts in order as text files under ``path/<book>=...``; concatenated by path they are ``head``,
    the parts with ``between`` between them, and ``tail``. Null parts are left out.

    Books are dealt by ranges of book and order, so a long one is written by many tasks at once and none holds it whole.
    Rows of ``shelved`` are not dealt again: each task writes the stretches that it reads, into folders that are named in
    their order. What is joined to the texts is a row for each book.
    Returns the parts' places, (book, order, at, bytes): where a part's own text begins in the concatenated files, from
    sums within ranges and before them. Spark's text files end rows with a newline, so ``between`` and ``tail`` must.
    """
    if not (between.endswith("\n") and tail.endswith("\n")):
        raise ValueError("rows of text files end with a newline")
    lies = [c for c in ("leafmill_at", "leafmill_block") if c in parts.columns]
    shelf = parts.where(F.col(part).isNotNull()).select(book, F.col(order).alias("_order"), F.col(part).alias("_part"), (F.lit("") if head is None else head).alias("_head"), *lies)
    if not lies:
        shelf = shelved(shelf, book, ["_order", "_part"], tables)
    ends = tables.save(shelf.groupBy(F.col(book).alias("_book")).agg(F.min("leafmill_at").alias("_first"), F.max("leafmill_at").alias("_last")), "ends")
    texts = shelf.join(F.broadcast(ends), F.col(book).eqNullSafe(F.col("_book"))).drop("_book")
    own = F.concat(F.when(F.col("leafmill_at") == F.col("_first"), F.col("_head")).otherwise(F.lit("")), "_part", F.when(F.col("leafmill_at") == F.col("_last"), F.lit(tail[:-1])).otherwise(F.lit(between[:-1])))
    # a long range may be read by several tasks, each from another block on
    held = F.call_function("shiftright", F.col("leafmill_at"), F.lit(33))
    piece = F.concat_ws("-", F.lpad(held.cast("string"), 10, "0"), F.lpad(F.col("leafmill_block").cast("string"), 14, "0"))
    texts.select(book, piece.alias(PIECE), "leafmill_at", own.alias("value")).sortWithinPartitions(book, PIECE, "leafmill_at").drop("leafmill_at").write.partitionBy(book, PIECE).text(path)
    sized = texts.select(book, "_order", "leafmill_at", held.alias("_range"), F.when(F.col("leafmill_at") == F.col("_first"), F.octet_length("_head")).otherwise(0).alias("_lead"), F.octet_length("_part").cast("long").alias("_bytes"), (F.octet_length(own).cast("long") + 1).alias("_size"))
    # nothing of this is made unless the places are read
    earlier = Window.partitionBy("_book").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    before = sized.groupBy(F.col(book).alias("_book"), F.col("_range").alias("_in")).agg(F.sum("_size").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    upto = Window.partitionBy(book, "_range").orderBy("leafmill_at").rowsBetween(Window.unboundedPreceding, 0)
    sized = sized.withColumn("_end", F.sum("_size").over(upto)).join(before, F.col(book).eqNullSafe(F.col("_book")) & (F.col("_range") == F.col("_in")))
    return sized.select(book, F.col("_order").alias(order), (F.col("_before") + F.col("_end") - F.col("_size") + F.col("_lead")).cast("long").alias("at"), F.col("_bytes").alias("bytes"))


def write_manuscripts(chapters: DataFrame, book: str, number: str, title: str, content: str, path: str, tables: Tables, markdown: bool = False) -> DataFrame:
    """``manuscripts`` as text files, see ``write_books``; a plain one ends with a newline as files do."""
    head = F.concat(F.lit("# " if markdown else ""), F.col(book).cast("string"), F.lit("\n\n"))
    return write_books(chapters.withColumn("_text", _part(number, title, content, markdown)), book, number, "_text", path, tables, head)


def read_books(spark: SparkSession, path: str, book: str) -> DataFrame:
    """(book, file, text) of the files of ``write_books``, to be read in the order of their names."""
    return spark.read.text(path, wholetext=True).select(book, F.concat_ws("/", PIECE, F.col("_metadata.file_name")).alias("file"), F.col("value").alias("text"))


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """A folder with JSON lines of each table and a manifest of their schemas."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").json(f"{path}/{name}")
    rows = [(FORMAT, VERSION, name, df.schema.json()) for name, df in tables.items()]
    spark.createDataFrame(rows, "format string, version int, name string, schema string").coalesce(1).write.json(f"{path}/manifest")


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a bundle; another format or version, or a missing required table, is refused."""
    import json

    from pyspark.sql.types import StructType

    manifest = spark.read.schema("format string, version int, name string, schema string").json(f"{path}/manifest").collect()  # a row a table
    if not manifest or any(r["format"] != FORMAT or r["version"] != VERSION for r in manifest):
        raise ValueError("not a bundle of this version")
    if missing := set(REQUIRED) - {r["name"] for r in manifest}:
        raise ValueError(f"the bundle lacks {sorted(missing)}")
    return {r["name"]: spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).json(f"{path}/{r['name']}") for r in manifest}


def restored(tables: dict[str, DataFrame], suffix: str) -> dict[str, DataFrame]:
    """A bundle's tables as a new project: new ids throughout, revisions replayed in order, running tasks paused. Tables
    meet their parents in more tasks the more rows they have."""
    from leafmill.operators.review import copied

    ids = {"projects": "project_id", "chapters": "chapter_id", "versions": "version_id", "task_runs": "task_id"}
    foreign = {"chapters": {"project_id": "projects"}, "versions": {"chapter_id": "chapters"}, "task_runs": {"project_id": "projects"}}
    rows = {k: v for k, v in tables.items() if k in ids}
    if "versions" in rows:  # before the look-up, as it deals them; a chapter's versions stay or go together
        order = Window.partitionBy("chapter_id").orderBy("revision", F.concat(F.col("version_id").cast("string"), F.lit(suffix)))
        rows["versions"] = dealt(rows["versions"], "chapter_id").withColumn("revision", F.row_number().over(order))
    out = copied(rows, ids, {k: v for k, v in foreign.items() if k in tables}, suffix, tables)
    if "task_runs" in out:
        out["task_runs"] = out["task_runs"].withColumn("status", F.when(F.col("status") == "running", "paused").otherwise(F.col("status")))
    return out
