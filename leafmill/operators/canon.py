"""An evidence-backed canon folded from reviewed chapter analyses.

An analysis row: (book, chapter, ordinal, status, characters, locations, world_terms: array<string>, relationships:
array<struct<source,target,type,description>>, timeline_events: array<struct<title,description,time_marker>>,
world_rules: array<struct<name,description>>, foreshadowing: array<struct<setup,possible_payoff>>, evidence:
array<struct<claim,segment_ids>>, confidence: double, uncertainties: array<string>). Older rows may lack the arrays
that came later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import short_id, squeezed, trimmed

MENTIONS = (("character", "characters"), ("location", "locations"), ("world_term", "world_terms"))


def with_known_chapters(analyses: DataFrame, chapters: DataFrame, key: list[str]) -> DataFrame:
    """Analyses of known chapters, with the chapters' ordinal and title."""
    return analyses.drop("ordinal", "title").join(chapters.select(*key, "ordinal", "title"), key)


def legacy(analyses: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Missing or null arrays become empty ones. ``wanted``: column to array type."""
    for name, kind in wanted.items():
        empty = F.array().cast(kind)
        analyses = analyses.withColumn(name, F.coalesce(F.col(name), empty) if name in analyses.columns else empty)
    return analyses


def evidence_for(name: Column, evidence: Column) -> Column:
    """Segment ids of the evidence whose claim contains any white-space-separated term of the name, case folded."""
    terms = F.filter(F.split(squeezed(name), " "), lambda t: t != "")
    hit = F.filter(evidence, lambda e: F.exists(terms, lambda t: F.contains(F.lower(e["claim"]), t)))
    return F.flatten(F.transform(hit, lambda e: e["segment_ids"]))


def _in_order(key: Column, values: Column) -> Column:
    """Distinct members of all arrays, by first appearance."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), values.alias("v")))), lambda s: s["v"])
    return F.array_distinct(F.flatten(lists))


def entities(accepted: DataFrame) -> DataFrame:
    """(book, kind, norm, name, mentions, chapters, evidence, confidence, id): mentions grouped by kind and squeezed name; the name
    as first seen; every mention counts; lists by first appearance."""
    each = F.flatten(F.array(*(_mentions(k, c, o) for o, (k, c) in enumerate(MENTIONS))))
    rows = accepted.select("book", "chapter", "ordinal", "confidence", "evidence", F.explode(each).alias("m")).where("m.name <> ''")
    pos = F.struct("ordinal", "chapter", "m.o", "m.i")
    norm = squeezed(F.col("m.name"))
    found = rows.groupBy("book", F.col("m.kind").alias("kind"), norm.alias("norm")).agg(
        F.min_by("m.name", pos).alias("name"),
        F.count("*").alias("mentions"),
        _in_order(pos, F.array("chapter")).alias("chapters"),
        _in_order(pos, evidence_for(F.col("m.name"), F.col("evidence"))).alias("evidence"),
        F.max("confidence").alias("confidence"),
    )
    return found.withColumn("id", short_id("entity", F.concat_ws(":", "kind", "norm")))


def _mentions(kind: str, column: str, order: int) -> Column:
    return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda n, i: F.struct(F.lit(order).alias("o"), F.lit(kind).alias("kind"), i.alias("i"), trimmed(n).alias("name")))


def _all_evidence(claim: Column) -> Column:
    """A row's matching evidence first, then all of its chapter's."""
    return F.concat(evidence_for(claim, F.col("evidence")), F.flatten(F.transform("evidence", lambda e: e["segment_ids"])))


def relationships(accepted: DataFrame) -> DataFrame:
    """(book, source, target, type, descriptions, chapters, evidence, confidence, id) by the three squeezed parts, none of
    which may be blank."""
    parts = ("source", "target", "type")
    each = accepted.select("book", "chapter", "ordinal", "confidence", "evidence", F.posexplode("relationships").alias("i", "r"))
    rows = each.select("*", *(trimmed(F.coalesce(f"r.{c}", F.lit(""))).alias(f"_{c}") for c in parts), trimmed(F.coalesce("r.description", F.lit(""))).alias("_said")).where("_source <> '' and _target <> '' and _type <> ''")
    pos, own = F.struct("ordinal", "chapter", "i"), [f"_{c}" for c in parts]
    found = rows.groupBy("book", *(squeezed(F.col(c)).alias(f"{c}_key") for c in own)).agg(*(F.min_by(f"_{c}", pos).alias(c) for c in parts), _in_order(pos, _said("_said")).alias("descriptions"), _in_order(pos, F.array("chapter")).alias("chapters"), _in_order(pos, _all_evidence(F.concat_ws(" ", *own))).alias("evidence"), F.max("confidence").alias("confidence"))
    keys = [f"{c}_key" for c in own]
    return found.withColumn("id", short_id("relation", F.concat_ws(":", *keys))).drop(*keys)


def _said(column: str) -> Column:
    return F.when(F.col(column) != "", F.array(column)).otherwise(F.array().cast("array<string>"))


def world_rules(accepted: DataFrame) -> DataFrame:
    """(book, name, descriptions, chapters, evidence, confidence, id) by squeezed name."""
    each = accepted.select("book", "chapter", "ordinal", "confidence", "evidence", F.posexplode("world_rules").alias("i", "r"))
    rows = each.select("*", trimmed(F.coalesce("r.name", F.lit(""))).alias("_name"), trimmed(F.coalesce("r.description", F.lit(""))).alias("_said")).where("_name <> ''")
    pos = F.struct("ordinal", "chapter", "i")
    claim = F.concat_ws(" ", "_name", "r.description")
    found = rows.groupBy("book", squeezed(F.col("_name")).alias("norm")).agg(F.min_by("_name", pos).alias("name"), _in_order(pos, _said("_said")).alias("descriptions"), _in_order(pos, F.array("chapter")).alias("chapters"), _in_order(pos, _all_evidence(claim)).alias("evidence"), F.max("confidence").alias("confidence"))
    return found.withColumn("id", short_id("rule", F.col("norm"))).drop("norm")


def timeline(accepted: DataFrame) -> DataFrame:
    """(book, chapter, ordinal, i, title, description, time_marker, evidence, confidence, id): events with a title or a
    description, in order."""
    text = lambda c: F.coalesce(f"e.{c}", F.lit(""))
    rows = accepted.select("book", "chapter", "ordinal", "confidence", "evidence", F.posexplode("timeline_events").alias("i", "e")).where((trimmed(text("title")) != "") | (trimmed(text("description")) != ""))
    named = short_id("event", F.concat_ws(":", F.col("chapter").cast("string"), F.col("i").cast("string"), text("title")))
    return rows.select("book", "chapter", "ordinal", "i", *(trimmed(text(c)).alias(c) for c in ("title", "description", "time_marker")), F.array_distinct(_all_evidence(F.concat_ws(" ", text("title"), text("description")))).alias("evidence"), "confidence", named.alias("id"))


def foreshadowing(accepted: DataFrame) -> DataFrame:
    """(book, chapter, ordinal, i, setup, possible_payoff, evidence, confidence, id): setups that are not blank."""
    rows = accepted.select("book", "chapter", "ordinal", "confidence", "evidence", F.posexplode("foreshadowing").alias("i", "f")).where(trimmed(F.coalesce("f.setup", F.lit(""))) != "")
    named = short_id("setup", F.concat_ws(":", F.col("chapter").cast("string"), F.col("i").cast("string"), "f.setup"))
    return rows.select("book", "chapter", "ordinal", "i", trimmed(F.col("f.setup")).alias("setup"), trimmed(F.col("f.possible_payoff")).alias("possible_payoff"), F.array_distinct(_all_evidence(F.col("f.setup"))).alias("evidence"), "confidence", named.alias("id"))


def uncertainties(accepted: DataFrame) -> DataFrame:
    """(book, chapter, ordinal, note): notes that are not empty."""
    return accepted.select("book", "chapter", "ordinal", F.explode("uncertainties").alias("note")).where("note <> ''")


def foreign_evidence(analyses: DataFrame, segments: DataFrame) -> DataFrame:
    """(chapter, segment_id) of evidence that its chapter does not have. ``segments``: (chapter, segment_id)."""
    cited = analyses.select("chapter", F.explode(F.flatten(F.transform("evidence", lambda e: e["segment_ids"]))).alias("segment_id")).distinct()
    return cited.join(segments, ["chapter", "segment_id"], "left_anti")


def pending(chapters: DataFrame, analyses: DataFrame, key: list[str]) -> DataFrame:
    """Chapters without an analysis that is not rejected."""
    return chapters.join(analyses.where("status <> 'rejected'").select(*key).distinct(), key, "left_anti")


def foreign_analyses(chapters: DataFrame, analyses: DataFrame, key: list[str]) -> DataFrame:
    """Finished analyses of chapters that the run does not have, with which it must not be resumed."""
    return analyses.where("status <> 'rejected'").join(chapters.select(*key), key, "left_anti")


def unlinked_relations(relations: DataFrame, names: DataFrame) -> DataFrame:
    """(book, source, target, reason): relations with an end that no name of the book has, or both ends the same."""
    known = names.select("book", squeezed(F.col("name")).alias("n")).distinct()
    rows = relations.withColumn("s", squeezed(F.col("source"))).withColumn("t", squeezed(F.col("target")))
    one = lambda side, reason: rows.join(known, (rows["book"] == known["book"]) & (rows[side] == known["n"]), "left_anti").withColumn("reason", F.lit(reason))
    return one("s", "unknown_source").unionByName(one("t", "unknown_target")).unionByName(rows.where("s = t").withColumn("reason", F.lit("self_loop"))).select("book", "source", "target", "reason")
