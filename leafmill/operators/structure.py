"""Chapters, segments, offsets, edits and parse revisions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import BLANKS, SPACES, estimated_tokens, reasons, stable_id, trimmed, visible_length
from leafmill.scratch import Tables

#: Headings, fixed values: numbered chapters and volumes, prologues and the like, with an optional subtitle.
_S = f"[{SPACES}]"
HEADING = rf"^{_S}*(?:(第[〇零一二三四五六七八九十百千万两\d]+[卷部篇章节回])|(?:卷|章)[〇零一二三四五六七八九十百千万两\d]+|(?:序章|楔子|引子|前言|后记|尾声|终章|番外(?:篇)?(?:[一二三四五六七八九十\d]+)?))(?:[{SPACES}:：、.-]+.*)?{_S}*$"
#: Titles, fixed values: of text before the first heading, of a text without headings, of a chapter without a title
#: (before its number) and of the second half of a split one (behind its title).
PREFIX, WHOLE, UNNAMED, SECOND = "章节前内容", "正文", "未命名章节 ", "（下）"
#: Limits of a snapshot, fixed values: chapters, segments, characters.
MAX_CHAPTERS, MAX_SEGMENTS, MAX_CHARACTERS = 10_000, 2_000_000, 100_000_000
_NEWLINE = re.compile("\r\n?")
_LINE = re.compile(f"[^{SPACES}](?:[^\n\r\u2028\u2029]*[^{SPACES}])?")


def _cut(docs: DataFrame, key: str, text: str, cut: Callable[[str], Iterator[tuple]], columns: str) -> DataFrame:
    """(key, columns) of the tuples that ``cut`` makes of each text with normalised newlines, without a shuffle."""
    narrow = docs.select(key, text)
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [{"int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                rows, owner = [], []
                for n, one in enumerate(batch.column(1).to_pylist()):
                    found = list(cut(_NEWLINE.sub("\n", one or "")))
                    rows += found
                    owner += [n] * len(found)
                values = zip(*rows, strict=True) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(list(v), k) for v, k in zip(values, kinds, strict=True))], [key, *names])

    return narrow.mapInArrow(run, T.StructType([narrow.schema[key], *(T.StructField(n, T.IntegerType() if k == pa.int32() else T.StringType()) for n, k in zip(names, kinds, strict=True))]))


def _lines(text: str) -> Iterator[tuple[int, str, int]]:
    at = 0
    for n, line in enumerate(text.split("\n")):
        yield n, line, at
        at += len(line) + 1


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line, at): every line with its offset in code points; newlines are normalised first."""
    return _cut(docs, key, text, _lines, "line_no int, line string, at int")


def segments(docs: DataFrame, key: str, text: str = "text", mode: str = "line") -> DataFrame:
    """(key, ordinal, content, start, end): "line" takes every non-blank line, trimmed, with true offsets; "paragraph"
    splits at blank lines and after a full stop at a line's end, without offsets."""
    if mode == "paragraph":
        split = F.split(F.coalesce(text, F.lit("")), f"\n{BLANKS}*\n|(?<=。){BLANKS}*\n", -1)
        kept = F.filter(F.transform(split, trimmed), lambda s: s != "")
        return docs.select(key, F.posexplode(kept).alias("ordinal", "content"))
    return _cut(docs, key, text, lambda t: ((n, m[0], m.start(), m.end()) for n, m in enumerate(_LINE.finditer(t))), "ordinal int, content string, start int, end int")


def chapters(docs: DataFrame, key: str, text: str = "text", is_heading: Column | None = None) -> DataFrame:
    """(key, ordinal, title, content, start, end): cut at headings, a condition on ``line`` (HEADING by default). Text
    before the first heading is a chapter of its own unless blank; a text without headings is one chapter, an empty or null
    one too. Contents are trimmed."""
    condition = F.col("line").rlike(HEADING) if is_heading is None else is_heading
    marked = lines(docs, key, text).withColumn("head", condition)
    order = Window.partitionBy(key).orderBy("line_no")
    numbered = marked.withColumn("no", F.sum(F.col("head").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = numbered.groupBy(key, "no").agg(
        F.max("head").alias("headed"),
        F.min("at").cast("int").alias("start"),
        F.max(F.col("at") + F.length("line")).cast("int").alias("end"),
        F.max(F.when(F.col("head"), trimmed(F.col("line")))).alias("heading"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line_no", "line")))), lambda s: s["line"]), "\n").alias("body"),
    )
    whole = Window.partitionBy(key)
    kept = grouped.withColumn("any", F.max("headed").over(whole)).where(F.col("headed") | ~F.col("any") | (trimmed(F.col("body")) != ""))
    ordinal = F.row_number().over(Window.partitionBy(key).orderBy("no")) - 1
    title = F.when(F.col("headed"), F.col("heading")).when(F.col("any"), F.lit(PREFIX)).otherwise(F.lit(WHOLE))
    return kept.select(key, ordinal.alias("ordinal"), title.alias("title"), trimmed(F.col("body")).alias("content"), "start", "end")


def cumulative_offsets(chapters_: DataFrame, book: str, order: str, content: str, gap: int = 0, is_size: bool = False) -> DataFrame:
    """start and end of each chapter when contents follow each other, ``gap`` characters apart. ``is_size``: the column
    ``content`` holds lengths already, so that no text goes through the window."""
    upto = Window.partitionBy(book).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    size = F.col(content) if is_size else F.length(F.coalesce(content, F.lit("")))
    end = F.sum(size + gap).over(upto) - gap
    return chapters_.withColumn("end_at", end.cast("long")).withColumn("start_at", (F.col("end_at") - size).cast("long"))


def estimate(docs: DataFrame, book: str, key: str, text: str = "text") -> DataFrame:
    """Per book: chapters, segments, estimated tokens and model calls (one a chapter) of an analysis run."""
    split = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n", -1)
    sizes = F.transform(F.filter(F.transform(split, trimmed), lambda s: s != ""), estimated_tokens)
    per = docs.select(book, key, sizes.alias("s")).select(book, key, F.size("s").alias("segments"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"))
    totals = per.groupBy(book).agg(F.count_distinct(key).alias("chapters"), F.sum("segments").cast("long").alias("segments"), F.sum("tokens").alias("estimated_tokens"))
    return totals.select(book, "chapters", "segments", "estimated_tokens", F.col("chapters").alias("model_calls"))


def edit_errors(chapters_: DataFrame, edits: DataFrame, book: str = "book") -> DataFrame:
    """(chapter_id, op, reason) of edits that cannot be made: an unknown chapter, a split outside the content, a blank new
    title, a merge of the last chapter, a move by something else than one place or beyond either end."""
    w = Window.partitionBy(book)
    place = F.row_number().over(w.orderBy("ordinal"))
    known = chapters_.select("chapter_id", book, "ordinal", F.length("content").alias("size")).withColumn("place", place).withColumn("last", F.count("*").over(w))
    rows = edits.join(known, "chapter_id", "left")
    inside = (F.col("offset") > 0) & (F.col("offset") < F.col("size"))
    to = F.col("place") + F.col("offset")
    bad = {
        "unknown_chapter": F.col("place").isNull(),
        "offset": (F.col("op") == "split") & ~F.coalesce(inside, F.lit(False)),
        "title": (F.col("op") == "rename") & (trimmed(F.coalesce("title", F.lit(""))) == ""),
        "no_next": (F.col("op") == "merge") & (F.col("place") == F.col("last")),
        "boundary": (F.col("op") == "move") & ~F.coalesce(F.abs("offset").isin(1) & to.between(1, F.col("last")), F.lit(False)),
    }
    reason = F.coalesce(*(F.when(c, F.lit(n)) for n, c in bad.items()))
    return rows.select("chapter_id", "op", reason.alias("reason")).where("reason is not null")


def edit_batch(chapters_: DataFrame, edits: DataFrame, book: str = "book", tables: Tables | None = None) -> DataFrame:
    """(book, ordinal, title, content, start, end, chapter_id) after renames, splits, merges and moves together; ordinals,
    offsets (two characters between chapters) and ids follow.

    ``chapters_``: (book, chapter_id, ordinal, title, content); ``edits``: (chapter_id, op, offset, title), at most one
    an op and chapter, those of ``edit_errors`` are not made. Order: rename, split at an offset inside the content, merge
    with the next, move by -1 or 1, which changes places with the neighbour. Only places, not texts, go through windows:
    edits and cut chapters are written once, and the sizes of what is merged follow from those of its parts.
    """
    tables = tables or Tables(chapters_.sparkSession)
    edits = tables.save(edits.select("chapter_id", "op", "offset", "title"), "edits")
    good = edits.join(edit_errors(chapters_, edits, book).select("chapter_id", "op"), ["chapter_id", "op"], "left_anti")
    of = lambda op, value, name: F.max(F.when(F.col("op") == op, value)).alias(name)
    changes = good.groupBy("chapter_id").agg(
        of("rename", trimmed(F.col("title")), "new_title"), of("split", F.col("offset"), "cut"), of("split", F.nullif(trimmed(F.col("title")), F.lit("")), "second"), of("merge", F.lit(True), "merge"), of("move", F.col("offset"), "move")
    )
    cut = chapters_.join(tables.save(changes, "changes"), "chapter_id", "left").withColumn("title", F.coalesce("new_title", "title"))
    text = F.replace(F.replace(F.coalesce("content", F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    half = lambda n, title, content, merge: F.struct(F.lit(n).alias("half"), title.alias("title"), trimmed(content).alias("content"), F.coalesce(merge, F.lit(False)).alias("merge"))
    whole = half(0, F.col("title"), text, F.col("merge"))
    first = half(0, F.col("title"), F.substring(text, F.lit(1), F.col("cut")), F.lit(False))
    second = half(1, F.coalesce("second", F.concat("title", F.lit(SECOND))), F.substring(text, F.col("cut") + 1, F.length("content")), F.col("merge"))
    halves = cut.select(book, "chapter_id", "ordinal", "move", F.explode(F.when(F.col("cut").isNotNull(), F.array(first, second)).otherwise(F.array(whole))).alias("p")).select(book, "chapter_id", "ordinal", "move", "p.*")
    halves = tables.save(halves.withColumn("size", F.length("content")), "halves")
    w = Window.partitionBy(book)
    order = w.orderBy("ordinal", "half")
    starts = F.sum(F.when(F.coalesce(F.lag("merge").over(order), F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    groups = halves.select(book, "chapter_id", "half", "move", "size", starts.alias("group"), F.row_number().over(order).alias("nth"))
    # parts are trimmed, so of what is joined only blank parts at either end go, with the lines between
    filled = F.when(F.col("size") > 0, F.col("nth"))
    size = F.sum("size") + 2 * F.coalesce(F.max(filled) - F.min(filled), F.lit(0))
    places = groups.groupBy(book, "group").agg(F.max("move").alias("move"), size.alias("size")).withColumn("place", F.col("group") + F.coalesce("move", F.lit(0)) * 1.5)
    places = places.select(book, "group", "size", (F.row_number().over(w.orderBy("place", "group")) - 1).alias("new_ordinal"))
    places = cumulative_offsets(places, book, "new_ordinal", "size", 2, is_size=True).select(book, "group", "new_ordinal", "start_at", "end_at")
    plan = groups.select(book, "chapter_id", "half", "group").join(places, [book, "group"]).select("chapter_id", "half", "new_ordinal", "start_at", "end_at")
    placed = halves.drop("move", "merge", "size").join(plan, ["chapter_id", "half"])
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "half", "title", "content")))
    merged = placed.groupBy(book, F.col("new_ordinal").alias("ordinal")).agg(parts.alias("parts"), F.max("start_at").alias("start"), F.max("end_at").alias("end"))
    title = F.coalesce(F.nullif(trimmed(F.element_at("parts", 1)["title"]), F.lit("")), F.concat(F.lit(UNNAMED), (F.col("ordinal") + 1).cast("string")))
    out = merged.select(book, "ordinal", title.alias("title"), trimmed(F.array_join(F.transform("parts", lambda s: s["content"]), "\n\n")).alias("content"), "start", "end")
    return out.withColumn("chapter_id", stable_id("chapter", F.concat_ws(":", book, F.lit("edited"), "ordinal", "title", "content")))


def rebuilt(edited: DataFrame, book: str = "book") -> dict[str, DataFrame]:
    """chapters, segments (with offsets in the book) and issues of edited chapters."""
    own = segments(edited.select("chapter_id", "content"), "chapter_id", "content")
    moved = own.join(edited.select("chapter_id", F.col("start").alias("_at")), "chapter_id")
    moved = moved.withColumn("start", F.col("start") + F.col("_at")).withColumn("end", F.col("end") + F.col("_at")).drop("_at")
    named = moved.withColumn("segment_id", stable_id("seg", F.concat_ws(":", "chapter_id", "ordinal", "content")))
    return {"chapters": edited, "segments": named, "issues": snapshot_issues(edited, book, "chapter_id")}


def snapshot_violations(chapters_: DataFrame, segments_: DataFrame, doc: str, chapter: str, hashes: DataFrame | None = None, limits: tuple[int, int, int] | None = (MAX_CHAPTERS, MAX_SEGMENTS, MAX_CHARACTERS)) -> DataFrame:
    """(doc, rule, n): what keeps a parse snapshot from being accepted. ``chapters_``: (doc, chapter, ordinal, title,
    content); ``segments_``: (chapter, ordinal), also segment_id and content if they are to be checked; ``hashes``: (doc,
    sha256, stored), the hash of a snapshot's document and the one that is stored; ``limits``: chapters, segments and
    characters beyond which a snapshot is too large, None for snapshots of any size."""
    numbered = chapters_.select(doc, chapter, "ordinal", "title").withColumn("rn", F.row_number().over(Window.partitionBy(doc).orderBy("ordinal")) - 1).withColumn("same", F.count("*").over(Window.partitionBy(chapter)))
    rules = reasons((F.col("rn") != F.col("ordinal"), "chapter_ordinal"), (F.col("same") > 1, "chapter_id"), (trimmed(F.coalesce("title", F.lit(""))) == "", "blank_title"))
    broken = numbered.select(doc, F.explode(rules).alias("rule"))
    known = chapters_.select(chapter, doc).distinct()
    lost = segments_.join(known, chapter, "left_anti").select(F.lit(None).cast(dict(chapters_.dtypes)[doc]).alias(doc), F.lit("unknown_chapter").alias("rule"))
    own = segments_.join(known, chapter)
    gaps = own.withColumn("rn", F.row_number().over(Window.partitionBy(chapter).orderBy("ordinal")) - 1).where("rn <> ordinal").select(doc, F.lit("segment_ordinal").alias("rule"))
    found = [broken, lost, gaps]
    if "content" in segments_.columns:
        found.append(own.where(trimmed(F.coalesce("content", F.lit(""))) == "").select(doc, F.lit("blank_segment").alias("rule")))
    if "segment_id" in segments_.columns:
        found.append(own.groupBy(doc, "segment_id").agg(F.count("*").alias("n")).where("n > 1").select(doc, F.lit("segment_id").alias("rule")))
    if limits is not None:
        sizes = chapters_.groupBy(doc).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("c")).where((F.col("n") > limits[0]) | (F.col("c") > limits[2])).select(doc)
        many = own.groupBy(doc).agg(F.count("*").alias("n")).where(F.col("n") > limits[1]).select(doc)
        found.append(sizes.union(many).distinct().select(doc, F.lit("too_large").alias("rule")))
    if hashes is not None:
        found.append(hashes.where(~F.col("sha256").eqNullSafe(F.col("stored"))).select(doc, F.lit("hash").alias("rule")))
    return reduce(DataFrame.unionByName, found).groupBy(doc, "rule").agg(F.count("*").alias("n"))


def append_revision(history: DataFrame, new: DataFrame, doc: str) -> DataFrame:
    """``new`` snapshots, one a document, with the revision after the latest in ``history``."""
    latest = history.groupBy(doc).agg(F.max("revision").alias("last"))
    return new.join(latest, doc, "left").withColumn("revision", F.coalesce("last", F.lit(0)) + 1).drop("last")


def backfilled(chapters_: DataFrame, doc: str, order: str, title: str, content: str) -> DataFrame:
    """(doc, raw_text): titles and contents in order, with blank lines between chapters."""
    part = F.concat_ws("\n", F.col(title), F.col(content))
    return chapters_.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p")))), lambda s: s["p"]), "\n\n").alias("raw_text"))


def joined_digests(parts: DataFrame, key: str, order: str, part: str, between: str = "\n\n", head: Column | None = None, tail: str = "") -> DataFrame:
    """(key, digest): the MD5 of ``head``, a key's parts in order and ``tail``. The sorted parts are read in batches and a
    digest's text is never held whole; null parts are left out."""
    rows = parts.select(key, (F.lit("") if head is None else head).alias("_head"), F.col(order).alias("_order"), F.col(part).alias("_part"))
    ordered = rows.repartition(key).sortWithinPartitions(key, "_order", "_part").select(key, "_head", "_part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, joined, kind = None, None, False, None
        for batch in batches:
            kind, done, (keys, heads, texts) = batch.schema.types[0], [], batch.columns
            # texts are digested where they lie; a batch may hold many long ones
            for own, start, text in zip(keys.to_pylist(), heads.to_pylist(), texts, strict=True):
                if total is None or own != last:
                    if total is not None:
                        total.update(tail.encode())
                        done.append((last, total.hexdigest()))
                    last, total, joined = own, hashlib.md5((start or "").encode()), False
                if text.is_valid:
                    if joined and between:
                        total.update(between.encode())
                    total.update(text.as_buffer())
                    joined = True
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], [key, "digest"])
        if total is not None:
            total.update(tail.encode())
            yield pa.RecordBatch.from_arrays([pa.array([last], kind), pa.array([total.hexdigest()], pa.string())], [key, "digest"])

    return ordered.mapInArrow(run, f"{key} {dict(parts.dtypes)[key]}, digest string")


def backfilled_digests(chapters_: DataFrame, doc: str, order: str, title: str, content: str) -> DataFrame:
    """(doc, digest): the MD5 of each text of ``backfilled``, which need not fit into one value."""
    return joined_digests(chapters_.withColumn("_text", F.concat_ws("\n", F.col(title), F.col(content))), doc, order, "_text")


def _chapter_issues(size: Column) -> tuple:
    return ((size == 0, "EMPTY_CHAPTER", "warning"), ((size > 0) & (size < 100), "VERY_SHORT_CHAPTER", "info"))


def _issues(*rules: tuple[Column, str, str]) -> Column:
    return F.explode(F.filter(F.array(*(F.when(c, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for c, code, severity in rules)), lambda x: x.isNotNull()))


def import_issues(docs: DataFrame, chapters_: DataFrame, key: str, text: str = "text", heading: Column | None = None) -> DataFrame:
    """(key, ordinal, code, severity): what an import reports of each text (without ordinal) and of its chapters, the
    (key, ordinal, content) of ``chapters``. ``heading``: whether a text has one, by HEADING if not given."""
    headed = F.col(text).rlike("(?m)" + HEADING) if heading is None else heading
    whole = F.coalesce(text, F.lit(""))
    blank = visible_length(whole) == 0
    own = docs.select(key, F.lit(None).cast("int").alias("ordinal"), _issues((blank, "EMPTY_DOCUMENT", "error"), (~blank & ~F.coalesce(headed, F.lit(False)), "NO_CHAPTER_HEADINGS", "warning"), (F.contains(whole, F.lit("\ufffd")), "REPLACEMENT_CHARACTER", "warning")).alias("i"))
    each = chapters_.select(key, F.col("ordinal").cast("int").alias("ordinal"), _issues(*_chapter_issues(visible_length(F.coalesce("content", F.lit(""))))).alias("i"))
    return own.unionByName(each).select(key, "ordinal", "i.*")


def snapshot_issues(chapters_: DataFrame, book: str, chapter: str, removed: DataFrame | None = None) -> DataFrame:
    """(book, chapter, code, severity): what an edited or cleaned snapshot reports. ``chapters_``: (book, chapter, title,
    content); ``removed``: (book, removed_characters) of a cleaning. Titles are counted apart from texts."""
    title = trimmed(F.coalesce("title", F.lit("")))
    counts = chapters_.groupBy(F.col(book).alias("_book"), title.alias("_title")).agg(F.count("*").alias("_n")).where("_n > 1")
    rows = chapters_.join(counts, (F.col(book) == F.col("_book")) & (title == F.col("_title")), "left")
    text = F.coalesce("content", F.lit(""))
    each = rows.select(book, chapter, _issues(*_chapter_issues(visible_length(text)), (F.col("_n").isNotNull(), "DUPLICATE_CHAPTER_TITLE", "warning"), (F.contains(text, F.lit("\ufffd")), "REPLACEMENT_CHARACTER", "warning")).alias("i"))
    if removed is not None:
        gone = removed.where("removed_characters > 0").select(book, F.lit(None).cast(dict(chapters_.dtypes)[chapter]).alias(chapter), F.struct(F.lit("CLEANING_REMOVED_CONTENT").alias("code"), F.lit("info").alias("severity")).alias("i"))
        each = each.unionByName(gone)
    return each.select(book, chapter, "i.*")
