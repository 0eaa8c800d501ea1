"""Secret scans over an incremental blob ledger, in DataFrame and SQL functions only.

Every version of every path is content-addressed: its blob is the SHA-256 of its text. The ledger is a table of findings
by (blob, rule, rule version), with a row for each pair that has been scanned, findings or not. A scan takes the
distinct blobs whose pair with a current rule version is not in the ledger, scans those alone, appends, and joins
findings back to all paths that hold a blob.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.scratch import Tables


@dataclass(frozen=True)
class Rule:
    """``pattern``: leftmost non-overlapping matches, whose ``group`` must have ``least`` characters. ``hints``: lower-case
    strings of which a text with a match has one in lower case; none: no text can be ruled out. ``order``: of kinds that
    start at the same place."""

    kind: str
    version: int
    order: int
    pattern: str
    group: int
    least: int
    hints: tuple[str, ...] = ()


#: The three base rules come first and stay as they are; a changed pattern needs a new version.
RULES = (
    Rule("assign", 1, 0, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, ("passw", "secret", "token", "api")),
    Rule("access", 1, 1, r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    Rule("hex", 1, 2, r"[0-9a-f]{24,}", 0, 24),
    Rule("github", 1, 3, r"gh[pousr]_[A-Za-z0-9]+", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", 1, 4, r"xox[abprs]-[A-Za-z0-9-]+", 0, 15, ("xox",)),
    Rule("jwt", 1, 5, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, ("eyj",)),
    Rule("pem", 2, 6, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=:,.\s-]*?-----END [A-Z ]*PRIVATE KEY-----", 0, 60, ("private key-----",)),
)
BASE = ("assign", "access", "hex")
FINDING = "struct<start:int,end:int>"
LEDGER = f"blob string, kind string, version int, found array<{FINDING}>"


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start,end>>: code-point spans of a rule's matches in the whole text, in order.

    The text between the matches comes from splitting at the same pattern, so a match starts after all matches and gaps
    before it.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    if rule.group:
        inner = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
        sizes = F.zip_with(found, inner, lambda m, g: F.struct(F.length(m).alias("m"), F.length(g).alias("g")))
    else:
        sizes = F.transform(found, lambda m: F.struct(F.length(m).alias("m"), F.length(m).alias("g")))
    steps = F.zip_with(sizes, F.slice(gaps, 1, F.size(sizes)), lambda s, gap: F.struct(s["m"].alias("m"), s["g"].alias("g"), F.length(gap).alias("gap")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{FINDING}>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        span = F.struct(begin.alias("start"), (begin + x["m"]).alias("end"))
        return F.struct((begin + x["m"]).alias("at"), F.when(x["g"] >= rule.least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    scanned = F.aggregate(steps, start, step)["out"]
    none = F.array().cast(f"array<{FINDING}>")
    if rule.hints:
        low = F.lower(text)
        possible = reduce(lambda a, b: a | b, [F.contains(low, F.lit(h)) for h in rule.hints])
        return F.when(possible, scanned).otherwise(none)
    return F.when(F.length(text) >= rule.least, scanned).otherwise(none)


def addressed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob, text) of every version; a null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, tables: Tables | None = None) -> DataFrame | None:
    """(blob, kind, version, found) for each distinct blob and rule version that ``ledger`` lacks; nothing twice. None if
    it lacks none.

    With a ledger the blobs that are due are found first, from content addresses alone, so a scan of what is known
    already moves no text; else texts are shuffled, after one copy a task is kept.
    """
    if ledger is None:
        blobs = versions.select("blob", "text").dropDuplicates(["blob"])
        each = blobs.select("blob", F.explode(F.array(*(_scanned(r) for r in rules))).alias("row"))
        return each.select("blob", "row.*")
    have = ledger.where(_current(rules)).groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("have"))
    known = F.coalesce("have", F.array().cast("array<string>"))
    wanted = F.array(*(F.lit(f"{r.kind}:{r.version}") for r in rules))
    due = versions.select("blob").distinct().join(have, "blob", "left").select("blob", known.alias("have")).where(F.size(F.array_except(wanted, F.col("have"))) > 0)
    due = (tables or Tables(versions.sparkSession)).save(due, "due")
    if due.isEmpty():
        return None
    blobs = versions.select("blob", "text").dropDuplicates(["blob"]).join(due, "blob")
    rows = [F.when(~F.array_contains("have", f"{r.kind}:{r.version}"), _scanned(r)) for r in rules]
    each = blobs.select("blob", F.explode(F.array(*rows)).alias("row")).where("row is not null")
    return each.select("blob", "row.*")


def _scanned(rule: Rule) -> Column:
    return F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), spans(F.col("text"), rule).alias("found"))


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, n_<kind> ..., base_list, all_list) of blobs with a finding under the current rules: lists of kind:start:end.
    A pair that two runs have appended at once counts once."""
    order = F.create_map(*(x for r in rules for x in (F.lit(r.kind), F.lit(r.order))))
    hits = ledger.where((F.size("found") > 0) & _current(rules)).select("blob", F.transform("found", lambda s: F.struct(s["start"].alias("start"), order[F.col("kind")].alias("order"), F.concat_ws(":", "kind", s["start"], s["end"]).alias("name"), F.col("kind").alias("kind"))).alias("spans"))
    merged = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"))
    names = lambda keep: F.array_join(F.transform(F.filter("spans", keep), lambda s: s["name"]), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(k) for k in BASE]
    return merged.select("blob", *counts, names(lambda s: s["kind"].isin(*BASE)).alias("base"), names(lambda s: F.lit(True)).alias("spans"))


def _current(rules: tuple[Rule, ...]) -> Column:
    return reduce(lambda a, b: a | b, [(F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules])


def scanned(versions: DataFrame, tables: Tables, ledger_path: str | None, rules: tuple[Rule, ...]) -> DataFrame:
    """The ledger after a scan of (blob, text), which appends what it lacks; a run without a path has a ledger of its own."""
    spark = versions.sparkSession
    before = spark.read.schema(LEDGER).parquet(ledger_path) if ledger_path is not None and _exists(spark, ledger_path) else None
    path = ledger_path or tables.path("ledger")
    new = scan(versions, before, rules, tables)
    if new is not None:
        new.write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def report(docs: DataFrame, tables: Tables, ledger_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per version: id, n_assign, n_access, n_hex, base_sha256, spans (of all rules), from the ledger.

    ``ledger_path``: a ledger of earlier runs, to which this run appends; without it the run has one of its own. Null and
    empty texts are the empty blob, which has no findings; repeated rows give a row each; an empty table gives none.
    """
    versions = addressed(docs, id_col, text_col)
    found = tables.save(findings(scanned(versions, tables, ledger_path, rules), rules), "findings")
    joined = versions.select("path", "blob").join(found, "blob", "left")
    counts = [F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE]
    return joined.select(F.col("path").alias(id_col), *counts, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def _exists(spark, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def masked(text: Column, found: Column, mask: str) -> Column:
    """A text with its spans, in order of their starts, replaced by ``mask``; overlapping ones become one mask."""

    def step(s: Column, x: Column) -> Column:
        before = F.when(x["start"] >= s["at"], F.concat(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mask))).otherwise(F.lit(""))
        return F.when(x["end"] <= s["at"], s).otherwise(F.struct(x["end"].alias("at"), F.concat(s["out"], before).alias("out")))

    done = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def redacted(docs: DataFrame, tables: Tables, ledger_path: str | None = None, text_col: str = "text", mask: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows with every finding in their text masked, by the ledger as in ``report``: a text is scanned once however
    many rows hold it. Null texts stay null; no row goes and no other column changes. The join is the same at every size."""
    key = "__leafmill_blob"
    blob = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    ledger = scanned(docs.select(blob.alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), tables, ledger_path, rules)
    hits = ledger.where((F.size("found") > 0) & _current(rules)).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set("found"))).alias("__leafmill_found"))
    hits = tables.save(hits.withColumnRenamed("blob", key), "spans")
    joined = docs.withColumn(key, blob).join(hits.hint("merge"), key, "left")
    text = F.when(F.col("__leafmill_found").isNull(), F.col(text_col)).otherwise(masked(F.col(text_col), F.col("__leafmill_found"), mask))
    return joined.withColumn(text_col, text).select(*docs.columns)
