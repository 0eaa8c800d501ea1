"""Token-budgeted context that never shows a target chapter what lies ahead of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import estimated_tokens, json_object, reasons, stable_id, trimmed
from leafmill.scratch import Tables

#: Priorities of the pool, fixed values: facts, then summaries by layer, then passages by score.
FACT, LAYERS = 1000, {"project": 500, "volume": 400, "chapter": 300, "scene": 200, "recent": 100}
#: Priorities within facts and summaries by where they come from, fixed values.
FACT_PARTS = {"character": 100, "relation": 80, "timeline": 75, "location": 70, "worldbuilding": 120, "fact": 95, "state": 100, "entity-state": 115}
SUMMARY_PARTS = {"synopsis": ("project", 100), "volume": ("volume", 80), "plan": ("chapter", 100), "memory": ("chapter", 90)}
#: A candidate carries its size, not its text, which joins those that are kept.
CANDIDATE = ["project", "target", "kind", "id", "tokens", "priority"]
#: Projects of up to so many candidates, and up to so many targets, meet them within a row; larger ones go by blocks.
SMALL = 512
#: A project's texts of up to so many characters in all lie in a row.
SMALL_TEXTS = 1_000_000


def _sized(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tokens", estimated_tokens(F.coalesce("text", F.lit("")))).drop("text")


def _reach(targets: DataFrame) -> DataFrame:
    """(project, first target, steps): where a project's targets begin and how often their span can be halved."""
    ends = targets.groupBy("project").agg(F.min("target").alias("_first"), F.max("target").alias("_last"))
    steps = F.floor(F.log2((F.col("_last") - F.col("_first") + 1).cast("double"))) + 1
    return ends.select("project", "_first", "_last", steps.cast("int").alias("_steps"))


def _halved(x: Column, k: Column) -> Column:
    return F.call_function("shiftright", x, k)


def _blocks(rows: DataFrame, targets: DataFrame, lo: str, hi: str) -> DataFrame:
    """Each row once for every aligned block of 1, 2, 4, ... chapters that its interval [lo, hi] is made of: at most two
    of a size. Null ends are open; rows of projects without targets, and intervals that hold none, go."""
    clipped = rows.join(_reach(targets), "project")
    start = F.greatest(F.coalesce(F.col(lo), F.col("_first")), F.col("_first")) - F.col("_first")
    stop = F.least(F.coalesce(F.col(hi), F.col("_last")), F.col("_last")) - F.col("_first") + 1
    clipped = clipped.withColumn("_start", start.cast("long")).withColumn("_stop", stop.cast("long")).where("_start < _stop")

    def at(k: Column) -> Column:
        a, b = _halved(F.col("_start") + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k), _halved(F.col("_stop"), k)
        block = lambda odd, x: F.when((a < b) & (odd % 2 == 1), F.struct(k.alias("size"), x.alias("at")))
        return F.array(block(a, a), block(b, b - 1))

    every = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.col("_steps")), at)), lambda x: x.isNotNull())
    return clipped.withColumn("_block", F.explode(every)).drop("_first", "_last", "_steps", "_start", "_stop")


def _looked_up(targets: DataFrame) -> DataFrame:
    """(project, target, block): the blocks of every size that hold a target."""
    known = targets.select("project", "target").distinct()
    place = (F.col("target") - F.col("_first")).cast("long")
    found = F.transform(F.sequence(F.lit(0), F.col("_steps")), lambda k: F.struct(k.alias("size"), _halved(place, k).alias("at")))
    return known.join(_reach(known), "project").select("project", "target", F.explode(found).alias("_block"))


def covering(rows: DataFrame, targets: DataFrame, lo: str, hi: str) -> DataFrame:
    """The rows with each ``target`` of their project inside [lo, hi]; null ends are open.

    An equi-join on aligned blocks: a row has a logarithm of blocks, a target lies in one of each size, and blocks of an
    interval do not overlap. So each pair is made once, and none that lies outside.
    """
    return _blocks(rows, targets, lo, hi).join(_looked_up(targets), ["project", "_block"]).drop("_block")


def fact_spans(facts: DataFrame) -> DataFrame:
    """Candidates of facts with the chapters [lo, hi] in which they are valid and revealed. ``facts``: (project, id, text,
    valid_from, valid_through, revealed_at, priority); without ``valid_through`` they hold from then on."""
    known = _sized(facts).where("valid_from is not null and revealed_at is not null")
    priority = F.lit(FACT) + F.coalesce("priority", F.lit(0))
    return known.select("project", F.lit("fact").alias("kind"), "id", "tokens", priority.alias("priority"), F.greatest("valid_from", "revealed_at").alias("lo"), F.col("valid_through").alias("hi"))


def summary_spans(summaries: DataFrame) -> DataFrame:
    """Candidates of summaries. ``summaries``: (project, id, layer, text, valid_from, valid_through, priority)."""
    base = F.create_map(*(F.lit(x) for kv in LAYERS.items() for x in kv))
    priority = base[F.col("layer")] + F.coalesce("priority", F.lit(0))
    return _sized(summaries).where("valid_from is not null").select("project", F.lit("summary").alias("kind"), "id", "tokens", priority.alias("priority"), F.col("valid_from").alias("lo"), F.col("valid_through").alias("hi"))


def passage_spans(passages: DataFrame) -> DataFrame:
    """Candidates of passages from their chapter on. ``passages``: (project, id, chapter, text, score)."""
    priority = F.floor(F.col("score") * 100 + 0.5).cast("int")
    return _sized(passages).where("chapter is not null").select("project", F.lit("passage").alias("kind"), "id", "tokens", priority.alias("priority"), F.col("chapter").alias("lo"), F.lit(None).cast("int").alias("hi"))


def visible_facts(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """Facts valid and revealed at a project's targets (project, target)."""
    return covering(fact_spans(facts), targets, "lo", "hi").select(CANDIDATE)


def visible_summaries(summaries: DataFrame, targets: DataFrame) -> DataFrame:
    """Summaries whose interval holds the target."""
    return covering(summary_spans(summaries), targets, "lo", "hi").select(CANDIDATE)


def visible_passages(passages: DataFrame, targets: DataFrame) -> DataFrame:
    """Passages up to and including the target."""
    return covering(passage_spans(passages), targets, "lo", "hi").select(CANDIDATE)


def draft_passages(drafts: DataFrame, tail: int = 6000) -> DataFrame:
    """(project, id, number, text) of drafts that are not blank: their last ``tail`` characters."""
    return drafts.where(trimmed(F.coalesce("content", F.lit(""))) != "").select("project", "id", "number", F.expr(f"right(content, {tail})").alias("text"))


def prior_drafts(passages: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target's earlier drafts (of ``draft_passages``) as candidates, scored by how near they are."""
    joined = covering(_sized(passages).withColumn("lo", F.col("number") + 1).where("lo is not null").withColumn("hi", F.lit(None).cast("int")), targets, "lo", "hi")
    score = F.col("number") / F.greatest(F.lit(1), F.col("target"))
    return joined.withColumn("kind", F.lit("passage")).withColumn("priority", F.floor(score * 100 + 0.5).cast("int")).select(CANDIDATE)


def fact_union(parts: dict[str, DataFrame]) -> DataFrame:
    """(project, id, kind, text, valid_from, valid_through, revealed_at, priority) of all a project knows. Parts by name in
    FACT_PARTS: (project, id, text), those of accepted memories also ``visible_through``, whose facts hold from the next
    chapter on."""
    kinds = {"character": "character", "relation": "relationship", "timeline": "timeline", "location": "world", "worldbuilding": "world", "fact": "world", "state": "timeline", "entity-state": "character"}
    out = None
    for name, df in parts.items():
        seen = F.coalesce("visible_through", F.lit(0)) if "visible_through" in df.columns else None
        since, shown = (seen + 1, seen) if seen is not None else (F.lit(0), F.lit(0))
        own = F.concat(F.lit(f"{name}:"), F.col("id").cast("string")) if name != "worldbuilding" else F.lit(name)
        part = df.select("project", own.alias("id"), F.lit(kinds[name]).alias("kind"), "text", since.cast("int").alias("valid_from"), F.lit(None).cast("int").alias("valid_through"), shown.cast("int").alias("revealed_at"), F.lit(FACT_PARTS[name]).alias("priority"))
        out = part if out is None else out.unionByName(part)
    return out


def summary_union(parts: dict[str, DataFrame]) -> DataFrame:
    """(project, id, layer, text, valid_from, valid_through, priority). Parts by name in SUMMARY_PARTS: (project, id, text);
    a chapter's plan has ``number`` and holds there only, a volume's ``first`` and ``last`` chapter, other parts hold
    everywhere (memories reach a target by ``visible_memories``). Blank memories are left out."""
    out = None
    for name, df in parts.items():
        layer, priority = SUMMARY_PARTS[name]
        since, until = {"plan": ("number", "number"), "volume": ("first", "last")}.get(name, (None, None))
        df = df.where(trimmed(F.coalesce("text", F.lit(""))) != "") if name == "memory" else df
        part = df.select("project", F.concat(F.lit(f"{name}:"), F.col("id").cast("string")).alias("id"), F.lit(layer).alias("layer"), "text", (F.col(since) if since else F.lit(0)).cast("int").alias("valid_from"), (F.col(until) if until else F.lit(None)).cast("int").alias("valid_through"), F.lit(priority).alias("priority"))
        out = part if out is None else out.unionByName(part)
    return out


def visible_memories(memories: DataFrame, targets: DataFrame) -> DataFrame:
    """Accepted memories strictly before the target; ``visible_through`` is their last chapter."""
    known = memories.where("status = 'accepted'").withColumn("_lo", F.coalesce("visible_through", "ordinal") + 1).withColumn("_hi", F.lit(None).cast("int"))
    return covering(known.where("_lo is not null"), targets, "_lo", "_hi").drop("_lo", "_hi")


#: A chapter's memory as JSON.
MEMORY = "struct<summary:string,stateChanges:array<string>,entityStates:array<struct<category:string,subject:string,state:string>>,newFacts:array<struct<category:string,subject:string,fact:string>>,unresolvedThreads:array<string>>"


def chapter_memories(rows: DataFrame, answer: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``memory``, quarantine with ``reasons``) of answers that hold a chapter's memory: a summary, state
    changes, new facts and unresolved threads are needed, entity states may be missing; facts and states need all their
    fields. Texts are trimmed and blank ones left out."""
    blank = lambda x: trimmed(F.coalesce(x, F.lit(""))) == ""
    # behind a generator an answer is parsed once, however often its memory is looked at
    rows = rows.withColumn("_memory", F.explode(F.array(F.from_json(json_object(F.col(answer)), MEMORY))))
    m = F.col("_memory")
    lacks = lambda field, *names: F.coalesce(F.exists(m[field], lambda e: reduce(lambda a, n: a | blank(e[n]), names, e.isNull())), F.lit(False))
    nulls = lambda field: m[field].isNull() | F.coalesce(F.exists(m[field], lambda x: x.isNull()), F.lit(False))
    why = reasons(
        (m.isNull(), "no_object"),
        (blank(m["summary"]), "summary"),
        (nulls("stateChanges"), "stateChanges"),
        (m["newFacts"].isNull(), "newFacts"),
        (nulls("unresolvedThreads"), "unresolvedThreads"),
        (lacks("entityStates", "category", "subject", "state"), "state_fields"),
        (lacks("newFacts", "category", "subject", "fact"), "fact_fields"),
    )
    kept = lambda field: F.filter(F.transform(m[field], trimmed), lambda x: x != "")
    record = lambda field, *names: F.transform(m[field], lambda e: F.struct(*(trimmed(e[n]).alias(n) for n in names)))
    states = F.coalesce(record("entityStates", "category", "subject", "state"), F.array().cast("array<struct<category:string,subject:string,state:string>>"))
    memory = F.struct(trimmed(m["summary"]).alias("summary"), kept("stateChanges").alias("stateChanges"), states.alias("entityStates"), record("newFacts", "category", "subject", "fact").alias("newFacts"), kept("unresolvedThreads").alias("unresolvedThreads"))
    tagged = rows.withColumn("reasons", why)
    return tagged.where(F.size("reasons") == 0).withColumn("memory", memory).drop("reasons", "_memory"), tagged.where(F.size("reasons") > 0).drop("_memory")


def state_before(states: DataFrame, targets: DataFrame) -> DataFrame:
    """(project, target, subject, state): each subject's latest state before the target; ties by the greater id.

    A subject's states and the targets behind its first one are sorted together, and the last state is carried forward.
    """
    known = states.where("ordinal is not null")
    first = known.groupBy("project", "subject").agg((F.min("ordinal") + 1).alias("_lo")).withColumn("_hi", F.lit(None).cast("int"))
    asked = covering(first, targets, "_lo", "_hi").select("project", "subject", "target", F.col("target").alias("_at"), F.lit(0).alias("_given"))
    given = known.select("project", "subject", F.col("ordinal").alias("_at"), F.lit(1).alias("_given"), "id", F.struct("state").alias("_state"))
    order = Window.partitionBy("project", "subject").orderBy("_at", "_given", "id").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(given, allowMissingColumns=True).withColumn("_last", F.last("_state", ignorenulls=True).over(order))
    return both.where("_given = 0").select("project", "target", "subject", F.col("_last.state").alias("state"))


def leaks(used: DataFrame, visible: str = "visible", ordinal: str = "ordinal") -> DataFrame:
    """Sources that were used although they lie beyond what was visible."""
    return used.where(F.col(ordinal) > F.col(visible))


def pooled(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _fitting(rows: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """What can be taken at all. Of candidates of one size at most budget / size are; behind one that does not fit no
    other of its size does, so these are the first ones. Shares of a group are cut first, so that no group is sorted
    whole."""
    for share in ([F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(16))], []):
        order = Window.partitionBy(*keys, "tokens", *share).orderBy(F.desc_nulls_first("priority"), F.col("id").cast("string"), "kind")
        rows = rows.where(F.col("tokens") <= budget).withColumn("_nth", F.row_number().over(order)).where(F.col("_nth").cast("long") * F.col("tokens") <= budget).drop("_nth")
    return rows


def _larger(rows: DataFrame, most: int) -> DataFrame:
    """The projects of more rows than ``most``."""
    return rows.groupBy("project").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(F.col("project").alias("_project"))


def _split(rows: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of projects that are not among ``large``, and those of projects that are; null is a project here."""
    same = F.col("project").eqNullSafe(F.col("_project"))
    return rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi")


def fitted(spans: DataFrame, targets: DataFrame, budget: int = 18_000, tables: Tables | None = None) -> DataFrame:
    """As ``assembled`` of all that ``spans`` (of ``fact_spans``, ``summary_spans`` and ``passage_spans``) shows each
    target, without making those pairs: a small project is one row, whose targets look through its candidates where they
    are; in a larger one a block of chapters keeps only what can fit, and a target meets its blocks."""
    tables, targets = tables or Tables(targets.sparkSession), targets.select("project", "target")
    large = tables.save(_larger(spans, SMALL).unionByName(_larger(targets, SMALL)).distinct(), "large")
    if large.isEmpty():
        return _fitted_in_rows(spans, targets, budget)
    (few_spans, spans), (few_targets, targets) = _split(spans, large), _split(targets, large)
    return _fitted_in_rows(few_spans, few_targets, budget).unionByName(_fitted_by_blocks(spans, targets, budget))


def _fitted_in_rows(spans: DataFrame, targets: DataFrame, budget: int) -> DataFrame:
    """``fitted`` of small projects: their candidates and targets are gathered once, in order, and nothing that is made
    for a target is dealt again."""
    one = F.struct((-F.col("priority")).alias("p"), F.col("id").cast("string").alias("id"), "kind", "tokens", "lo", "hi")
    pool = spans.where(F.col("tokens") <= budget).groupBy("project").agg(F.array_sort(F.collect_list(one)).alias("c"))
    asked = targets.groupBy("project").agg(F.collect_set(F.struct("target")).alias("t")).join(pool, "project", "left")

    def made(t: Column) -> Column:
        seen = F.filter("c", lambda x: (x["lo"].isNull() | (x["lo"] <= t["target"])) & (x["hi"].isNull() | (x["hi"] >= t["target"])) & t["target"].isNotNull())
        return F.struct(t["target"].alias("target"), _taken(seen, budget).alias("s"))

    return _told(asked.select("project", F.explode(F.transform("t", made)).alias("m")).select("project", "m.target", "m.s"), budget)


def _fitted_by_blocks(spans: DataFrame, targets: DataFrame, budget: int) -> DataFrame:
    short = _fitting(_blocks(spans, targets, "lo", "hi").drop("lo", "hi"), ["project", "_block"], budget)
    return assembled(short.join(_looked_up(targets), ["project", "_block"]).drop("_block"), targets, budget)


def assembled(pool: DataFrame, targets: DataFrame, budget: int = 18_000) -> DataFrame:
    """(project, target, used, sources, context_id) of every target, candidates or not: candidates by priority, then id;
    each is taken if it still fits, and smaller ones behind one that does not are tried. ``sources``: array<struct<kind,id,
    tokens>> in that order; the id is that of project, target, budget and the sources' ids. What is gathered for a target
    are at most budget / 1 + budget / 2 + ... candidates."""
    short = _fitting(pool, ["project", "target"], budget)
    rows = short.groupBy("project", "target").agg(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), F.col("id").cast("string").alias("id"), "kind", "tokens"))).alias("c"))
    done = rows.select("project", "target", _taken(F.col("c"), budget).alias("s"))
    return _told(targets.select("project", "target").distinct().join(done, ["project", "target"], "left"), budget)


#: What a target has taken so far.
_TAKEN = "struct<used:int,kept:array<struct<kind:string,id:string,tokens:int>>>"


def _none_taken() -> Column:
    return F.struct(F.lit(0).alias("used"), F.array().alias("kept")).cast(_TAKEN)


def _taken(candidates: Column, budget: int) -> Column:
    """(used, kept) of candidates in their order: each is taken if it still fits."""

    def step(s: Column, x: Column) -> Column:
        own = F.array(F.struct(x["kind"].alias("kind"), x["id"].alias("id"), x["tokens"].cast("int").alias("tokens")))
        return F.when(x["tokens"] <= budget - s["used"], F.struct((s["used"] + x["tokens"]).cast("int").alias("used"), F.concat(s["kept"], own).alias("kept"))).otherwise(s)

    return F.aggregate(candidates, _none_taken(), step)


def _told(rows: DataFrame, budget: int) -> DataFrame:
    """The rows (project, target, s) as contexts; where ``s`` is null nothing was taken."""
    every = rows.withColumn("s", F.coalesce("s", _none_taken()))
    ids = F.array_join(F.transform("s.kept", lambda x: x["id"]), ",")
    fingerprint = F.concat_ws(":", F.col("project").cast("string"), F.col("target").cast("string"), F.lit(str(budget)), ids)
    return every.select("project", "target", F.col("s.used").alias("used"), F.col("s.kept").alias("sources"), stable_id("ctx", fingerprint).alias("context_id"))


def _prompt_part(kind: Column, id: Column, text: Column) -> Column:
    return F.concat(F.lit("["), kind, F.lit(":"), id, F.lit("]\n"), F.coalesce(text, F.lit("")))


def prompts(contexts: DataFrame, texts: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(project, target, context_id, prompt): the sources' texts with their kind and id, blank lines between.
    ``texts``: (project, kind, id, text). A small project's texts are one row, in which its contexts look theirs up; those
    of a larger one meet source by source."""
    tables, contexts = tables or Tables(contexts.sparkSession), contexts.select("project", "target", "context_id", "sources")
    texts = texts.select("project", "kind", F.col("id").cast("string").alias("id"), "text")
    long = texts.groupBy("project").agg(F.sum(F.length("text")).alias("_n")).where(F.col("_n") > SMALL_TEXTS).select(F.col("project").alias("_project"))
    large = tables.save(_larger(texts, SMALL).unionByName(long).distinct(), "large")
    if large.isEmpty():
        return _prompts_in_rows(contexts, texts)
    (few_contexts, contexts), (few_texts, texts) = _split(contexts, large), _split(texts, large)
    return _prompts_in_rows(few_contexts, few_texts).unionByName(_prompts_by_sources(contexts, texts))


def _prompts_in_rows(contexts: DataFrame, texts: DataFrame) -> DataFrame:
    known = texts.where("project is not null and kind is not null and id is not null").repartition("project").dropDuplicates(["project", "kind", "id"])
    held = known.groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("kind", "id"), "text"))).alias("held"))
    part = lambda s: _prompt_part(s["kind"], s["id"], F.try_element_at("held", F.struct(s["kind"], s["id"])))
    return contexts.join(held, "project", "left").select("project", "target", "context_id", F.coalesce(F.array_join(F.transform("sources", part), "\n\n"), F.lit("")).alias("prompt"))


def _prompts_by_sources(contexts: DataFrame, texts: DataFrame) -> DataFrame:
    kept = contexts.select("project", "target", F.posexplode("sources").alias("n", "s")).select("project", "target", "n", "s.kind", "s.id")
    named = texts.dropDuplicates(["project", "kind", "id"])
    each = kept.join(named, ["project", "kind", "id"], "left").select("project", "target", F.struct("n", _prompt_part(F.col("kind"), F.col("id"), F.col("text")).alias("part")).alias("p"))
    joined = each.groupBy("project", "target").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "\n\n").alias("prompt"))
    joined = joined.select(F.col("project").alias("_project"), F.col("target").alias("_target"), "prompt")
    same = F.col("project").eqNullSafe(F.col("_project")) & F.col("target").eqNullSafe(F.col("_target"))
    return contexts.select("project", "target", "context_id").join(joined, same, "left").drop("_project", "_target").na.fill("", ["prompt"])


def new_snapshots(contexts: DataFrame, existing: DataFrame, key: str = "context_id") -> DataFrame:
    """Contexts whose content is not stored yet, one of each. Those that are stored go first, so whole contexts are dealt
    and sorted once."""
    return contexts.join(existing.select(key), key, "left_anti").dropDuplicates([key])


def chapter_sources(chapter: DataFrame, plan: DataFrame, canon: DataFrame, drafts: DataFrame) -> DataFrame:
    """(project, target, kind, id, text) that a consistency check reads: the chapter, its plan, the canon, what comes
    before and after; blank texts and empty JSON left out. ``chapter``: (project, target, id, text); the others:
    (project, id, text), drafts also number."""
    said = lambda df: df.where(~trimmed(F.coalesce("text", F.lit(""))).isin("", "{}", "[]"))
    same, told = chapter.select("project", "target"), said(drafts).where("number is not null")
    open_end = F.lit(None).cast("int")
    parts = [
        said(chapter).withColumn("kind", F.lit("chapter")),
        said(plan).join(same, ["project", "target"]).withColumn("kind", F.lit("plan")),
        said(canon).join(same, "project").withColumn("kind", F.lit("canon")),
        covering(told.withColumn("lo", F.col("number") + 1).withColumn("hi", open_end), same, "lo", "hi").withColumn("kind", F.lit("prior")),
        covering(told.withColumn("lo", open_end).withColumn("hi", F.col("number") - 1), same, "lo", "hi").withColumn("kind", F.lit("future")),
    ]
    return pooled(*(p.select("project", "target", "kind", "id", "text") for p in parts))


def latest(rows: DataFrame, keys: list[str], order: str, tie: str, n: int = 1) -> DataFrame:
    """The newest ``n`` rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(tie)))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
