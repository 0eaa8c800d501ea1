"""Story plans: flattening, validation and pacing rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import stable_id, trimmed

#: A plan as nested JSON.
PLAN = "struct<volumes:array<struct<number:int,title:string,target_words:int,chapters:array<struct<number:int,title:string,pov:string,time:string,location:string,conflict:string,hook:string,scenes:array<struct<title:string,characters:array<string>,target_words:int>>>>>>>"


def flattened(plans: DataFrame, project: str, payload: str) -> dict[str, DataFrame]:
    """volumes, chapters and scenes of JSON plans, with stable ids by project and numbers; names distinct and trimmed."""
    parsed = plans.select(project, F.from_json(payload, PLAN).alias("p"))
    v = parsed.select(project, F.posexplode("p.volumes").alias("v_pos", "v"))
    volumes = v.select(project, F.col("v.number").alias("volume"), "v.title", "v.target_words")
    c = v.select(project, F.col("v.number").alias("volume"), F.posexplode("v.chapters").alias("c_pos", "c"))
    chapters = c.select(project, "volume", F.col("c.number").alias("number"), "c.title", "c.pov", "c.time", "c.location", "c.conflict", "c.hook")
    s = c.select(project, "volume", F.col("c.number").alias("number"), F.posexplode("c.scenes").alias("scene", "s"))
    names = F.array_distinct(F.filter(F.transform("s.characters", trimmed), lambda x: x != ""))
    scenes = s.select(project, "volume", "number", "scene", "s.title", names.alias("characters"), "s.target_words")
    with_id = lambda df, kind, *k: df.withColumn(f"{kind}_id", stable_id(kind, F.concat_ws(":", project, *k)))
    return {"volumes": with_id(volumes, "volume", "volume"), "chapters": with_id(chapters, "chapter", "volume", "number"), "scenes": with_id(scenes, "scene", "volume", "number", "scene")}


def plan_violations(volumes: DataFrame, chapters: DataFrame, scenes: DataFrame, project: str) -> DataFrame:
    """(project, rule, n): repeated numbers, blank titles, sizes that are not positive, volumes without chapters and
    chapters without scenes."""
    rule = lambda df, name: df.select(project, F.lit(name).alias("rule"))
    twice = lambda df, *k: df.groupBy(project, *k).agg(F.count("*").alias("n")).where("n > 1")
    blank = lambda c: trimmed(F.coalesce(c, F.lit(""))) == ""
    found = [
        rule(twice(volumes, "volume"), "duplicate_volume"),
        rule(twice(chapters, "number"), "duplicate_chapter"),
        rule(volumes.where(blank("title")).unionByName(chapters.where(blank("title")), allowMissingColumns=True), "blank_title"),
        rule(scenes.where("target_words is null or target_words <= 0"), "target_words"),
        rule(volumes.join(chapters.select(project, "volume").distinct(), [project, "volume"], "left_anti"), "no_chapters"),
        rule(chapters.join(scenes.select(project, "volume", "number").distinct(), [project, "volume", "number"], "left_anti"), "no_scenes"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy(project, "rule").agg(F.count("*").alias("n"))


def repeated(rows: DataFrame, scope: list[str], value: str, fold: bool = False) -> DataFrame:
    """(scope, value, n, reason) of values that a scope has more than once ("repeated") or that are blank ("blank").
    ``fold``: values are compared trimmed and in lower case, as names of places are; ids of sources are not."""
    own = F.col(value) if not fold else F.lower(trimmed(F.col(value)))
    counted = rows.select(*scope, own.alias(value)).groupBy(*scope, value).agg(F.count("*").alias("n"))
    reason = F.when(trimmed(F.coalesce(value, F.lit(""))) == "", "blank").when(F.col("n") > 1, "repeated")
    return counted.withColumn("reason", reason).where("reason is not null")


def number_gaps(chapters: DataFrame, project: str, number: str) -> DataFrame:
    """(project, number, expected): every chapter whose number is not its place; all after a gap are."""
    place = F.row_number().over(Window.partitionBy(project).orderBy(number))
    return chapters.select(project, number, place.alias("expected")).where(F.col(number) != F.col("expected"))


def word_deviation(volumes: DataFrame, scenes: DataFrame, key: list[str], target: str, words: str) -> DataFrame:
    """Volumes whose scenes add up to more than max(500, 20 %) off their target."""
    total = scenes.groupBy(*key).agg(F.sum(words).alias("words"))
    rows = volumes.join(total, key, "left").withColumn("words", F.coalesce("words", F.lit(0)))
    return rows.where(F.abs(F.col("words") - F.col(target)) > F.greatest(F.lit(500), F.col(target) * 0.2)).select(*key, "words", target)


def weak_rhythm(chapters: DataFrame, project: str, order: str, weak_conflict: str, weak_hook: str) -> DataFrame:
    """(project, order): where three chapters in a row start with two weak conflicts and two weak hooks among them."""
    three = Window.partitionBy(project).orderBy(order).rowsBetween(0, 2)
    rows = chapters.withColumn("n", F.count("*").over(three)).withColumn("c", F.sum(F.col(weak_conflict).cast("int")).over(three)).withColumn("h", F.sum(F.col(weak_hook).cast("int")).over(three))
    return rows.where("n = 3 and c >= 2 and h >= 2").select(project, order)


def static_pairs(chapters: DataFrame, project: str, order: str, same: list[str], scenes: str) -> DataFrame:
    """(project, order): chapters that are like the next in all columns of ``same``, each with one scene."""
    w = Window.partitionBy(project).orderBy(order)
    like = F.lit(True)
    for c in (*same, scenes):
        like = like & (F.lead(c).over(w) == F.col(c))
    return chapters.withColumn("like", like & (F.col(scenes) == 1)).where("like").select(project, order)


def quality_report(gaps: DataFrame, deviations: DataFrame, rhythm: DataFrame, static: DataFrame, project: str) -> DataFrame:
    """(project, rule, severity, n) of the four rules together."""
    tag = lambda df, rule, severity: df.select(project, F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))
    rows = tag(gaps, "number_gap", "error").unionByName(tag(deviations, "word_deviation", "warning")).unionByName(tag(rhythm, "weak_rhythm", "warning")).unionByName(tag(static, "static_pair", "info"))
    return rows.groupBy(project, "rule", "severity").agg(F.count("*").alias("n"))
