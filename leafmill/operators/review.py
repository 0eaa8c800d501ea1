"""Reviews, revisions, idempotent writes and task states, over logs that many writers append to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import packed, reasons, short_id, squeezed, trimmed
from leafmill.operators._fold import folded
from leafmill.ranks import ranked
from leafmill.scratch import Tables, dealt

#: Moves of a task, fixed values; succeeded and cancelled ones move no more.
TRANSITIONS = {
    "queued": ["running", "paused", "cancelled"],
    "running": ["paused", "cancelling", "succeeded", "failed"],
    "paused": ["queued", "cancelled"],
    "cancelling": ["cancelled", "failed"],
    "cancelled": [],
    "succeeded": [],
    "failed": ["queued"],
}
FINAL = ("succeeded", "failed", "cancelled")
#: Where a version comes from, fixed values.
VERSION_SOURCES = ("manual", "ai", "restore", "finalize")


def moved(before: str | None, status: str, error: str | None = None) -> bool:
    """Whether a task in the state ``before`` (None: not there yet) may go on to ``status``: the first state is queued, a
    failure needs an error and nothing else may have one."""
    known = status == "queued" if before is None else status in TRANSITIONS.get(before, [])
    return known and (status == "failed") == (error is not None)


def upserted(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest incoming row of each key in place of the current one."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order)))
    newest = incoming.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return current.join(newest.select(*keys), keys, "left_anti").unionByName(newest, allowMissingColumns=True)


def first_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """An idempotent insert: of equal keys the first stays."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def reviewed(decisions: DataFrame, candidate: str, group: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(entries, illegal): the first decision on a candidate counts, later ones are illegal. Accepted candidates revise
    their group's entry in order; an entry has its current value and number of revisions."""
    nth = F.row_number().over(Window.partitionBy(candidate).orderBy(order))
    rows = decisions.withColumn("_nth", nth)
    entries = rows.where("_nth = 1 and decision = 'accepted'").groupBy(*group).agg(F.count("*").alias("revision"), F.max_by("value", order).alias("value"))
    return entries, rows.where("_nth > 1").drop("_nth")


def bible_log(log: DataFrame, tables: Tables | None = None) -> tuple[DataFrame, DataFrame]:
    """(revisions, refused) of a log (project, kind, candidate, action, value, seq) of what happens to story bible entries.

    Actions are "accepted" and "rejected" for a candidate, of which only the first on each counts, and "saved" by hand,
    without a candidate. What is accepted or saved is the next revision of its project's entry of that kind, in order of
    ``seq``; both share one chain. ``revisions``: (entry_id, project, kind, revision, value, seq, source, current);
    ``refused``: the rows that change nothing, with ``reason``: decided, unknown_action, no_entry (blank project or
    kind). An entry's log need not fit into one task.
    """
    tables = tables or Tables(log.sparkSession)
    decides = F.col("action").isin("accepted", "rejected")
    first = log.where(decides & F.col("candidate").isNotNull()).groupBy("candidate").agg(F.min("seq").alias("_first"))
    reason = (
        F.when(_blank(F.col("project")) | _blank(F.col("kind")), "no_entry")
        .when(~F.coalesce(decides | (F.col("action") == "saved"), F.lit(False)) | (decides & F.col("candidate").isNull()), "unknown_action")
        .when(decides & (F.col("seq") > F.col("_first")), "decided")
    )
    marked = tables.save(log.join(first, "candidate", "left").withColumn("reason", reason).select(*log.columns, "reason"), "decisions")
    made = marked.where("reason is null and action <> 'rejected'").drop("reason")
    chain = ranked(made, [F.col("seq").asc()], "revision", tables, ["project", "kind"])
    last = made.groupBy("project", "kind").agg(F.count("*").alias("_last"))
    entry = F.concat_ws("_", F.lit("bible"), "project", "kind")
    revisions = chain.join(last, ["project", "kind"]).select(entry.alias("entry_id"), "project", "kind", "revision", "value", "seq", F.when(F.col("action") == "saved", "manual").otherwise("candidate").alias("source"), (F.col("revision") == F.col("_last")).alias("current"))
    return revisions, marked.where("reason is not null")


def latest_status(decisions: DataFrame, keys: list[str], order: str, status: str) -> DataFrame:
    return decisions.groupBy(*keys).agg(F.max_by(status, order).alias(status))


def optimistic(writes: DataFrame, keys: list[str], order: str, expected: str) -> DataFrame:
    """Each write with ``revision`` and ``accepted``: a write counts if it expects the revision that the accepted ones
    before it have made."""

    def step(revision, wanted):
        revision = revision or 0
        fits = wanted == revision
        return revision + fits, (revision + fits, fits)

    return folded(writes, keys, [order], [expected], step, [T.StructField("revision", T.IntegerType()), T.StructField("accepted", T.BooleanType())])


def transitions(events: DataFrame, task: str, order: str, status: str, error: str | None = None, at: str | None = None) -> DataFrame:
    """Each event with ``before``, the task's state when it comes (null: not there yet), ``legal`` and ``after``; only a
    legal event changes the state. With ``at``, a timestamp column, also ``started_at``, the first time it ran, and
    ``finished_at``, null unless it rests in a final state."""

    def step(state, new, message=None, when=None):
        before, started, finished = state or (None, None, None)
        legal = moved(before, new, message)
        if legal:
            started = when if new == "running" and started is None else started
            state = (new, started, when if new in FINAL else None)
        after = state or (None, None, None)
        return state, (before, legal, *after)[: 3 if at is None else 5]

    columns = [status, *([error] if error else []), *([at] if at else [])]
    fold = (lambda s, new, when: step(s, new, None, when)) if at and not error else step
    times = [T.StructField("started_at", T.TimestampType()), T.StructField("finished_at", T.TimestampType())] if at else []
    return folded(events, [task], [order], columns, fold, [T.StructField("before", T.StringType()), T.StructField("legal", T.BooleanType()), T.StructField("after", T.StringType()), *times])


def versions(saves: DataFrame, doc: str, order: str, content: str, title: str | None = None, source: str | None = None, expected: str | None = None) -> DataFrame:
    """Saves that change the content or the title, numbered from 1. ``source``: a column that must hold one of
    VERSION_SOURCES; ``expected``: the revision that a save expects, or null for any; saves that break either rule, or
    change nothing, make no version."""

    def step(state, text, name=None, origin="manual", wanted=None):
        revision, kept = state or (0, None)
        if origin not in VERSION_SOURCES or wanted is not None and wanted != revision or revision and kept == (text, name):
            return state, (None,)
        return (revision + 1, (text, name)), (revision + 1,)

    given = [("name", title), ("origin", source), ("wanted", expected)]
    names = [n for n, c in given if c]
    fold = lambda state, text, *rest: step(state, text, **dict(zip(names, rest, strict=True)))
    rows = saves.withColumn("_text", F.md5(content)).withColumn("_name", F.trim(title) if title else F.lit(None).cast("string"))
    reads = ["_text", *("_name" if n == "name" else c for n, c in given if c)]
    done = folded(rows, [doc], [order], reads, fold, [T.StructField("revision", T.IntegerType())])
    return done.where("revision is not null").drop("_text", "_name")


def analyses_upserted(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``upserted`` for analyses: what comes in is a draft again, whatever its review was."""
    return upserted(current, incoming.withColumn("status", F.lit("draft")), keys, order)


def copied(tables: dict[str, DataFrame], ids: dict[str, str], foreign: dict[str, dict[str, str]], suffix: str, scans: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """A deep copy: every table's id and its foreign keys get ``suffix``; rows whose parent is not copied go.
    ``ids``: table to id column; ``foreign``: table to {column: parent table}. A parent's ids are all that is looked up,
    as new ids follow from the old ones. ``scans``: tables with as many rows that are cheap to count, by which the look-ups
    are dealt to more tasks the more rows there are."""
    new = lambda c: F.concat(F.col(c).cast("string"), F.lit(suffix)).alias(c)
    out = {}
    for name, df in tables.items():
        columns = foreign.get(name, {})
        for column, parent in columns.items():
            known = tables[parent].select(F.col(ids[parent]).alias(column))
            # the parents are dealt, as a semi join goes below what deals the rows
            df = df.join(dealt(known, column, like=scans[name]) if scans else known, column, "left_semi")
        out[name] = df.select(*(new(c) if c == ids[name] or c in columns else F.col(c) for c in df.columns))
    return out


def remapped(rows: DataFrame, mapping: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with new ids, rows without a mapping). ``mapping``: (old, new)."""
    m = mapping.select(F.col("old").alias(column), "new")
    return rows.join(m, column).withColumn(column, F.col("new")).drop("new"), rows.join(m, column, "left_anti")


def alive(projects: DataFrame, children: DataFrame, project: str) -> DataFrame:
    """Children of projects that are not in the trash."""
    return children.join(projects.where("trashed_at is null").select(project), project, "left_semi")


def rights_gate(rows: DataFrame, confirmations: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(admitted, refused) by the latest confirmation of each source."""
    known = confirmations.groupBy(key).agg(F.max_by("confirmed", "version").alias("confirmed")).where("confirmed").select(key)
    return rows.join(known, key, "left_semi"), rows.join(known, key, "left_anti")


def owned(rows: DataFrame, chapters: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, offenders): rows (project, document, chapter) whose chapter is the document's and document the project's."""
    known = chapters.select("chapter", "document").join(documents.select("document", "project"), "document")
    keys = ["project", "document", "chapter"]
    return rows.join(known, keys, "left_semi"), rows.join(known, keys, "left_anti")


def validated(rows: DataFrame, found: Column) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine with reasons) by an array of reasons."""
    tagged = rows.withColumn("reasons", found)
    return tagged.where(F.size("reasons") == 0).drop("reasons"), tagged.where(F.size("reasons") > 0)


def quotes(citations: DataFrame, sources: DataFrame, form: Callable[[Column], Column] = packed) -> DataFrame:
    """Citations (source_id, quote, ...) with ``verdict``: verified if the source's text holds the quote, both in
    ``form`` (white space and case do not count by default), else unverified, or unknown_source."""
    joined = citations.join(sources.select("source_id", F.col("text").alias("_text")), "source_id", "left")
    held = F.contains(form(F.col("_text")), form(F.col("quote"))) & (form(F.col("quote")) != "")
    return joined.withColumn("verdict", F.when(F.col("_text").isNull(), "unknown_source").when(held, "verified").otherwise("unverified")).drop("_text")


def citations(sources: DataFrame, quoted: DataFrame, width: int = 5) -> DataFrame:
    """(source_id, quote_id, quote) of every source that may hold a quote: ``sources`` (source_id, text) and ``quoted``
    (quote_id, quote) that share ``width`` words one after another inside the quote. A quote begins and ends within words
    of a source at most, so the words between are whole there and no source that holds it is missed; quotes too short for
    that go with every source, blank ones with none."""

    def hashes(words: Column, first: int, last: int) -> Column:
        starts = F.when(F.size(words) >= width + first + last - 1, F.sequence(F.lit(first), F.size(words) - width - last + 1))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, width))))

    words = quoted.select("quote_id", "quote", F.split(squeezed(F.col("quote")), " ").alias("_words"))
    long = F.size("_words") >= width + 2
    keys = words.where(long).select("quote_id", F.explode(hashes(F.col("_words"), 2, 1)).alias("_key"))
    texts = sources.select("source_id", F.split(squeezed(F.col("text")), " ").alias("_words"))
    shared = texts.select("source_id", F.explode(hashes(F.col("_words"), 1, 0)).alias("_key")).join(keys, "_key").select("source_id", "quote_id").distinct()
    short = words.where(~long & (squeezed(F.col("quote")) != "")).select("quote_id")
    each = shared.unionByName(sources.select("source_id").distinct().crossJoin(short))
    return each.join(quoted.select("quote_id", "quote"), "quote_id").select("source_id", "quote_id", "quote")


def reusable(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Requests (project, kind, input_hash) with ``reuse``: the result of the latest succeeded run of the same input."""
    done = runs.where("status = 'succeeded'").groupBy("project", "kind", "input_hash").agg(F.max_by("result", "seq").alias("reuse"))
    return requests.join(done, ["project", "kind", "input_hash"], "left")


#: Kinds and severities of a consistency issue and kinds of required text, fixed values.
ISSUE_KINDS = ("character", "timeline", "world", "relationship", "item", "foreshadowing", "future_leak", "plan")
SEVERITIES = ("info", "warning", "error")
TASK_FIELDS = ("id", "project_id", "kind", "provider_id", "model", "idempotency_key", "input_hash")
#: An analysis as JSON.
ANALYSIS = "struct<summary:string,confidence:double,stateChanges:array<struct<subject:string,field:string,before:string,after:string>>,evidence:array<struct<claim:string,segmentIds:array<string>>>,characters:array<string>,locations:array<string>,worldTerms:array<string>,goals:array<string>,conflicts:array<string>,outcomes:array<string>,uncertainties:array<string>>"


def _blank(x: Column) -> Column:
    return trimmed(F.coalesce(x, F.lit(""))) == ""


def task_violations() -> Column:
    """Reasons why a task row (TASK_FIELDS, status, input_tokens, output_tokens, cached_tokens) is refused: blank fields,
    an unknown status, token counts below zero."""
    tokens = [F.coalesce(F.col(c) < 0, F.lit(False)) for c in ("input_tokens", "output_tokens", "cached_tokens")]
    return reasons(*((_blank(F.col(f)), f"blank_{f}") for f in TASK_FIELDS), (~F.coalesce(F.col("status").isin(*TRANSITIONS), F.lit(False)), "status"), (tokens[0] | tokens[1] | tokens[2], "negative_tokens"))


def analysis_violations(payload: Column) -> Column:
    """Reasons why an analysis (ANALYSIS as JSON) is refused: no object, no summary, a confidence outside 0 to 1, missing
    arrays, incomplete state changes, evidence without a claim or segments."""
    a = F.from_json(payload, ANALYSIS)
    lists = ("characters", "locations", "worldTerms", "goals", "conflicts", "outcomes", "uncertainties")
    has_null = lambda x, fields: F.coalesce(F.exists(x, lambda e: e.isNull() | F.lit(False) if not fields else _any_null(e, fields)), F.lit(False))
    return reasons(
        (F.try_parse_json(payload).isNull() | ~F.coalesce(trimmed(payload).startswith("{"), F.lit(False)), "no_object"),
        (a["summary"].isNull(), "summary"),
        (~F.coalesce(a["confidence"].between(0, 1), F.lit(False)), "confidence"),
        *((a[f].isNull() | F.coalesce(F.exists(a[f], lambda x: x.isNull()), F.lit(False)), f) for f in lists),
        (a["stateChanges"].isNull() | has_null(a["stateChanges"], ("subject", "field", "before", "after")), "stateChanges"),
        (a["evidence"].isNull() | has_null(a["evidence"], ("claim", "segmentIds")), "evidence"),
    )


def _any_null(e: Column, fields: tuple[str, ...]) -> Column:
    out = e.isNull()
    for f in fields:
        out = out | e[f].isNull()
    return out


def consistency_issues(issues: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid issues with ``issue_id`` and status open, quarantine with ``reasons``). ``issues``: (chapter_id, i, kind,
    severity, title, description, suggestion, repair, evidence: array<struct<source_id,quote>>); every piece of evidence
    must be a quote of a known source. ``sources``: (source_id, text)."""
    key = ["chapter_id", "i"]
    cited = issues.select(*key, F.explode("evidence").alias("e")).select(*key, "e.source_id", "e.quote")
    blank = cited.where(_blank(F.col("quote"))).select(*key, F.lit("evidence").alias("why"))
    bad = quotes(cited.where(~_blank(F.col("quote"))), sources).where("verdict <> 'verified'").select(*key, F.when(F.col("verdict") == "unknown_source", "unknown_source").otherwise("quote").alias("why"))
    why = blank.unionByName(bad).groupBy(*key).agg(F.array_sort(F.collect_set("why")).alias("_why"))
    texts = [(F.col(c).isNull(), c) for c in ("title", "description", "suggestion", "repair")]
    own = reasons((~F.coalesce(F.col("kind").isin(*ISSUE_KINDS), F.lit(False)), "kind"), (~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)), "severity"), *texts, (F.coalesce(F.size("evidence"), F.lit(0)) <= 0, "no_evidence"))
    tagged = issues.join(why, key, "left").withColumn("reasons", F.concat(own, F.coalesce("_why", F.array().cast("array<string>")))).drop("_why")
    good = tagged.where(F.size("reasons") == 0).drop("reasons")
    named = short_id("consistency", F.concat_ws(":", F.col("chapter_id").cast("string"), F.col("i").cast("string"), "title"))
    return good.withColumn("issue_id", named).withColumn("status", F.lit("open")), tagged.where(F.size("reasons") > 0)


#: Listings: what is shown in which order, fixed values: (column, whether the greatest comes first).
LISTINGS = {
    "sources": (("imported_at", True), ("id", False)),
    "projects": (("updated_at", True), ("id", False)),
    "trash": (("trashed_at", True), ("id", False)),
    "checkpoints": (("created_at", True), ("id", True)),
    "candidates": (("created_at", True),),
    "tasks": (("created_at", True), ("id", True)),
    "analyses": (("created_at", False), ("id", False)),
    "drafts": (("updated_at", True), ("chapter_plan_id", False)),
    "reports": (("created_at", True), ("id", True)),
    "snapshots": (("created_at", True), ("id", True)),
    "bible": (("kind", False),),
    "versions": (("revision", True),),
    "chapters": (("ordinal", False),),
}


def listed(rows: DataFrame, project: str, listing: str, last: str = "id", tables: Tables | None = None) -> DataFrame:
    """The rows of each project with ``place``, from 1, in a listing's order; ``last`` settles ties. A project's rows need
    not fit into one task."""
    order = [F.desc(c) if down else F.asc(c) for c, down in LISTINGS[listing]]
    return ranked(rows, [*order, F.asc(last)], "place", tables or Tables(rows.sparkSession), [project])


#: A project with more rows than this is listed by ranges, which many tasks share.
PROJECT_ROWS = 1_000_000


def all_listed(rows: DataFrame, project: str, columns: dict[str, Column], last: str = "id", tables: Tables | None = None) -> DataFrame:
    """(project, last, listing, place): the rows of each project in every one of LISTINGS, see ``listed``. ``columns``: the
    columns that the listings name, as expressions over the rows; listings whose order is the same are numbered once.

    Rows are dealt by project once for all listings. Projects of more than PROJECT_ROWS rows go through ``listed``.
    """
    tables = tables or Tables(rows.sparkSession)
    many = tables.save(rows.groupBy(F.col(project).alias("_many")).agg(F.count("*").alias("_n")).where(F.col("_n") > PROJECT_ROWS).select("_many"), "many")
    large = not many.isEmpty()
    same = F.col(project).eqNullSafe(F.col("_many"))
    usual = rows.join(F.broadcast(many), same, "left_anti") if large else rows
    orders = {name: tuple((columns[c], down) for c, down in order) for name, order in LISTINGS.items()}
    key = lambda order: tuple((str(c), down) for c, down in order)
    place = {key(o): f"_place{i}" for i, o in enumerate({key(o): o for o in orders.values()}.values())}
    numbers = {key(o): F.row_number().over(Window.partitionBy(project).orderBy(*(F.desc(c) if down else F.asc(c) for c, down in o), F.asc(last))).cast("long").alias(place[key(o)]) for o in orders.values()}
    listings = F.explode(F.array(*(F.struct(F.lit(name).alias("listing"), F.col(place[key(o)]).alias("place")) for name, o in orders.items())))
    out = dealt(usual, project).select(project, last, *numbers.values()).select(project, last, listings.alias("_l")).select(project, last, "_l.*")
    if large:
        apart = rows.join(F.broadcast(many), same, "left_semi").select(project, last, *(c.alias(name) for name, c in columns.items() if name != last))
        for name in LISTINGS:
            out = out.unionByName(listed(apart, project, name, last, tables).select(project, last, F.lit(name).alias("listing"), "place"))
    return out


#: A character's fields and what stands for one that is missing, blank or no text, fixed values.
CHARACTER = {"name": "未命名角色", "role": "次要角色", "age": "青年（25–35）", "build": "匀称", "speech": "自然", "accent": "普通话 · 无明显口音", "goal": "待补充", "secret": "待补充"}
UNFINISHED = "待完善"


def normalized_characters(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, id, CHARACTER's fields, personality) of every item of the JSON arrays in ``payload``, what is no object too:
    fields that are no text or blank get their default, texts stay as they are; ``personality`` keeps its texts that are
    not blank, or says that it is unfinished; an id that is no number is the item's place, from 1. What is no array has
    no items."""
    items = rows.select(key, F.posexplode(F.from_json(payload, "array<string>")).alias("_n", "_item"))
    v = F.when(trimmed(F.col("_item")).startswith("{"), F.try_parse_json("_item"))
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit(""))
    part = lambda name: F.try_variant_get("_v", f"$.{name}", "variant")
    items = items.withColumn("_v", v)
    text = lambda name: F.when(kind(part(name)) == "STRING", F.try_variant_get("_v", f"$.{name}", "string"))
    own = [F.when(~_blank(text(name)), text(name)).otherwise(F.lit(default)).alias(name) for name, default in CHARACTER.items()]
    number = F.when(kind(part("id")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get("_v", "$.id", "double"))
    listed_ = F.when(kind(part("personality")).startswith("ARRAY"), F.try_variant_get("_v", "$.personality", "array<variant>"))
    texts = F.transform(F.filter(listed_, lambda x: kind(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    kept = F.filter(texts, lambda x: trimmed(x) != "")
    personality = F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(F.array(F.lit(UNFINISHED)))
    return items.select(key, F.coalesce(number, F.col("_n") + 1.0).alias("id"), *own, personality.alias("personality"))


def by_name(rows: DataFrame, book: str, name: str, locale: str = "zh", tables: Tables | None = None) -> DataFrame:
    """The rows with ``place`` in their book by the collation of one language, equal names by code point. A book's names
    are dealt by ranges of the collation, so they need not fit into one task."""
    return ranked(rows, [F.collate(F.col(name), locale), F.col(name)], "place", tables or Tables(rows.sparkSession), [book])


def latest_reports(reports: DataFrame, chapter: list[str] | None = None) -> DataFrame:
    """The newest consistency report of each chapter: the latest created, of those the greatest id."""
    chapter = chapter or ["project_id", "chapter_plan_id"]
    columns = [c for c in reports.columns if c not in chapter]
    newest = reports.groupBy(*chapter).agg(F.max(F.struct("created_at", "id", *(c for c in columns if c not in ("created_at", "id")))).alias("_r"))
    return newest.select(*(F.col(c) if c in chapter else F.col(f"_r.{c}").alias(c) for c in reports.columns))
