"""Line cleaning: repeated headers, page numbers, blocked fragments, duplicates and hard wraps."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import SPACES, trimmed

#: What a trimmed page-number line looks like, and the characters that end a sentence, so that the next
#: line does not belong to it.
PAGE_NUMBER = (r"\s*(?:第\s*)?[0-9]+\s*页\s*", r"[-—–]?\s*[0-9]+\s*[-—–]?")
ENDS = "。！？!?；;：:“”」』）)"
_PAGE = re.compile("|".join(f"(?:{p})" for p in PAGE_NUMBER).replace(r"\s", f"[{SPACES}]"))


def edge_lines(text: Column) -> Column:
    """The distinct first two and last two non-blank trimmed lines of 2 to 80 characters."""
    kept = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1), trimmed), lambda s: s != "")
    edges = F.concat(F.slice(kept, 1, 2), F.slice(kept, F.greatest(F.lit(1), F.size(kept) - 1), F.lit(2)))
    return F.filter(F.array_distinct(edges), lambda s: F.length(s).between(2, 80))


def repeated_edges(chapters: DataFrame, book: str, text: str, min_share: float = 0.6, least: int = 3) -> DataFrame:
    """(book, line, n): edge lines in at least max(least, ceil(min_share * chapters)) of a book's chapters."""
    total = chapters.groupBy(book).agg(F.count("*").alias("chapters"))
    counts = chapters.select(book, F.explode(edge_lines(F.col(text))).alias("line")).groupBy(book, "line").agg(F.count("*").alias("n"))
    return counts.join(total, book).where(F.col("n") >= F.greatest(F.lit(least), F.ceil(F.col("chapters") * min_share))).select(book, "line", "n")


def clean_text(text: str | None, repeated: set[str], blocked: list[str], pages: bool = True, duplicates: bool = True, unwrap: bool = True) -> tuple[str, bool, int, int, int]:
    """(clean, changed, removed lines, joined lines, characters of removed lines) of one chapter, line after line.

    A line goes if its trimmed form is a page number or a repeated edge, holds a blocked fragment, or equals the line that
    stands before it by then; a line is joined to that one if it is not blank, does not end a sentence and the new line
    has no white space in front. White space behind a line goes, more than one blank line becomes one.
    """
    whole = re.sub(r"\r\n?", "\n", text or "")
    out: list[list[str]] = []  # lines as the pieces that were joined
    size, end, removed, joined, characters = 0, "", 0, 0, 0  # ``size`` and ``end``: of the line before, trimmed
    for raw in whole.split("\n"):
        line = raw.rstrip(SPACES)
        bare = line.lstrip(SPACES)
        again = duplicates and bare and size == len(bare) and "".join(out[-1]).lstrip(SPACES) == bare
        if pages and _PAGE.fullmatch(bare) or bare in repeated or any(f in bare for f in blocked) or again:
            removed, characters = removed + 1, characters + len(raw)
        elif unwrap and bare and size and end not in ENDS and raw[0] not in SPACES:
            out[-1].append(bare)
            size, end, joined = size + len(bare), bare[-1], joined + 1
        else:
            out.append([line])
            size, end = len(bare), bare[-1:]
    clean = re.sub(r"\n{3,}", "\n\n", "\n".join(map("".join, out))).strip(SPACES)
    return clean, clean != whole.strip(SPACES), removed, joined, characters


def cleaned(chapters: DataFrame, book: str, text: str, *, min_share: float = 0.6, repeated: bool = True, blocked: list[str] | None = None, pages: bool = True, duplicates: bool = True, unwrap: bool = True) -> DataFrame:
    """The chapters with ``clean``, ``changed``, ``removed_lines``, ``joined_lines`` and ``removed_characters`` (code
    points of removed lines) of ``clean_text``; the raw text stays as it is, null counts as empty."""
    rows = chapters
    if repeated:  # a book's repeated lines are few: one array a book
        edges = repeated_edges(chapters, book, text, min_share).groupBy(book).agg(F.array_sort(F.collect_set("line")).alias("_edges"))
        rows = rows.join(edges, book, "left")
    else:
        rows = rows.withColumn("_edges", F.array().cast("array<string>"))
    at, edge_at = rows.columns.index(text), rows.columns.index("_edges")
    fragments = [f.strip(SPACES) for f in blocked or [] if f.strip(SPACES)]
    kinds = [("clean", T.StringType()), ("changed", T.BooleanType()), ("removed_lines", T.IntegerType()), ("joined_lines", T.IntegerType()), ("removed_characters", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, set[str]] = {}
        for batch in batches:
            found = []
            for one, lines in zip(batch.column(at).to_pylist(), batch.column(edge_at).to_pylist(), strict=True):
                key = tuple(lines or ())
                if key not in known:
                    known = {key: set(key)}
                found.append(clean_text(one, known[key], fragments, pages, duplicates, unwrap))
            new = [pa.array(list(v), k) for v, k in zip(zip(*found, strict=True) if found else [[]] * 5, (pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *(n for n, _ in kinds)])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *(T.StructField(n, k) for n, k in kinds)])).drop("_edges")


def report(cleaned_: DataFrame, book: str) -> DataFrame:
    """Per book: changed chapters, removed and joined lines, characters of removed lines."""
    return cleaned_.groupBy(book).agg(
        F.count_if("changed").alias("changed_chapters"),
        F.sum("removed_lines").cast("long").alias("removed_lines"),
        F.sum("joined_lines").cast("long").alias("joined_lines"),
        F.sum("removed_characters").alias("removed_characters"),
    )
