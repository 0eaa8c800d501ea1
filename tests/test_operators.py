"""Small inputs whose results can be seen, ties, empty tables and copies among them."""

import hashlib
import re

from pyspark.sql import functions as F

from leafmill.functions import estimated_tokens, fnv1a, json_object, or_default, squeezed, stable_id, string_fields, trimmed, unfenced
from leafmill.operators import canon, cleaning, context, governance, infer, outline, review, structure, usage
from leafmill.sources import exports, files
from leafmill.sources.packing import archive
from leafmill.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ids_and_scalars(spark):
    assert one(spark, stable_id("segment", F.lit("a"))) == "segment_" + hashlib.sha256(b"segment\0a").hexdigest()[:24]
    h = 2166136261
    units = [int.from_bytes("a林".encode("utf-16-be")[i : i + 2], "big") for i in range(0, 4, 2)]
    for u in units:
        h = ((h ^ u) * 16777619) & 0xFFFFFFFF
    assert one(spark, fnv1a(F.lit("a林"))) == f"{h:08x}"
    assert one(spark, fnv1a(F.lit(""))) == f"{2166136261:08x}"
    assert one(spark, estimated_tokens(F.lit(""))) == 1
    assert one(spark, estimated_tokens(F.lit("林栀abcd"))) == 3
    assert one(spark, unfenced(F.lit('```json\n{"a":1}\n```'))) == '{"a":1}'
    for answer, good in (('{"a":1}', True), (' ```JSON\n{"a":1}\n``` ', True), ("[1]", False), ("[{}]", False), ("no", False), ('{"a":1} {}', False), ('{"a":1}}', False), ("null", False), ("", False)):
        assert (one(spark, json_object(F.lit(answer))) is not None) == good, answer
    assert one(spark, string_fields(F.lit('{"a":"x","b":1,"d":null}'), ["a", "b", "c", "d"])) == ["b", "c", "d"]
    assert one(spark, or_default(F.lit("　 "), "d")) == "d"
    assert one(spark, trimmed(F.lit("　 x\ufeff"))) == "x"


def test_chapters_and_segments(spark):
    text = "开头\n第一章 雨夜\n他来了。\n\n她走了。\n第二章\n完\n"
    docs = spark.createDataFrame([("a", text), ("b", "没有标题"), ("c", ""), ("d", None)], "k string, text string")
    got = {(r["k"], r["ordinal"]): (r["title"], r["content"]) for r in structure.chapters(docs, "k").collect()}
    assert got[("a", 0)] == ("章节前内容", "开头")
    assert got[("a", 1)] == ("第一章 雨夜", "他来了。\n\n她走了。")
    assert got[("a", 2)] == ("第二章", "完")
    assert got[("b", 0)] == ("正文", "没有标题")
    assert got[("c", 0)] == got[("d", 0)] == ("正文", "") and len(got) == 6
    for r in structure.segments(docs.where("k = 'a'"), "k").collect():
        assert text[r["start"] : r["end"]] == r["content"]
    paragraphs = [r["content"] for r in structure.segments(docs.where("k = 'a'"), "k", mode="paragraph").orderBy("ordinal").collect()]
    assert paragraphs == ["开头\n第一章 雨夜\n他来了。", "她走了。", "第二章\n完"]
    assert structure.segments(docs.limit(0), "k").count() == 0


def test_edits_follow_each_other(spark):
    rows = spark.createDataFrame([("b", f"c{i}", i, f"t{i}", f"content{i}") for i in range(3)], "book string, chapter_id string, ordinal int, title string, content string")
    edits = spark.createDataFrame([("c0", "split", 3, None), ("c1", "merge", None, None), ("c2", "rename", None, "new")], "chapter_id string, op string, offset int, title string")
    got = [(r["ordinal"], r["title"], r["content"]) for r in structure.edit_batch(rows, edits).orderBy("ordinal").collect()]
    assert got == [(0, "t0", "con"), (1, "t0（下）", "tent0"), (2, "t1", "content1\n\ncontent2")]
    moved = structure.edit_batch(rows, spark.createDataFrame([("c0", "move", 1, None)], "chapter_id string, op string, offset int, title string"))
    assert [(r["title"], r["start"], r["end"]) for r in moved.orderBy("ordinal").collect()] == [("t1", 0, 8), ("t0", 10, 18), ("t2", 20, 28)]
    parts = structure.rebuilt(moved)
    assert {(r["content"], r["start"], r["end"]) for r in parts["segments"].collect()} == {("content1", 0, 8), ("content0", 10, 18), ("content2", 20, 28)}
    assert parts["issues"].where("code = 'VERY_SHORT_CHAPTER'").count() == 3
    wrong = spark.createDataFrame([("c0", "split", 0, None), ("c1", "split", 8, None), ("c2", "merge", None, None), ("c0", "move", -1, None), ("c2", "move", 1, None), ("c1", "rename", None, " "), ("zz", "move", 1, None), ("c1", "move", 2, None)], "chapter_id string, op string, offset int, title string")
    errors = {(r["chapter_id"], r["op"]): r["reason"] for r in structure.edit_errors(rows, wrong).collect()}
    assert errors == {("c0", "split"): "offset", ("c1", "split"): "offset", ("c2", "merge"): "no_next", ("c0", "move"): "boundary", ("c2", "move"): "boundary", ("c1", "rename"): "title", ("zz", "move"): "unknown_chapter", ("c1", "move"): "boundary"}
    same = structure.edit_batch(rows, wrong)
    assert [r["title"] for r in same.orderBy("ordinal").collect()] == ["t0", "t1", "t2"]
    unnamed = structure.edit_batch(rows.withColumn("title", F.lit("  ")), wrong.limit(0))
    assert [r["title"] for r in unnamed.orderBy("ordinal").collect()] == ["未命名章节 1", "未命名章节 2", "未命名章节 3"]


def test_headings(spark):
    yes = ["第一章 雨夜", "第12回", "章三", "卷二-北", "序章", "前言", "终章：完", "番外", "番外篇三", "番外2", "  第3篇  ", "第两千部.x", "后记　终", "尾声"]
    no = ["第一集", "第章", "序言", "第一章雨夜", "不是第一章", "番外篇x", "楔子x"]
    got = {r["x"] for r in spark.createDataFrame([(x,) for x in yes + no], "x string").where(F.col("x").rlike(structure.HEADING)).collect()}
    assert got == set(yes)


def test_import_and_snapshot_issues(spark):
    long = "x" * 120
    docs = spark.createDataFrame([(1, f"第一章\n{long}\n第二章\n\n第三章\nshort"), (2, " \n"), (3, long), (4, f"第一章\n{long}�"), (5, None)], "k int, text string")
    chapters = structure.chapters(docs, "k")
    got = {(r["k"], r["ordinal"], r["code"], r["severity"]) for r in structure.import_issues(docs, chapters, "k").collect()}
    assert got == {(1, 1, "EMPTY_CHAPTER", "warning"), (1, 2, "VERY_SHORT_CHAPTER", "info"), (2, None, "EMPTY_DOCUMENT", "error"), (2, 0, "EMPTY_CHAPTER", "warning"), (3, None, "NO_CHAPTER_HEADINGS", "warning"), (4, None, "REPLACEMENT_CHARACTER", "warning"), (5, None, "EMPTY_DOCUMENT", "error"), (5, 0, "EMPTY_CHAPTER", "warning")}
    books = spark.createDataFrame([("b", 1, " t ", long), ("b", 2, "t", "�" + long), ("c", 3, "t", "")], "book string, chapter int, title string, content string")
    removed = spark.createDataFrame([("b", 7), ("c", 0)], "book string, removed_characters int")
    got = {(r["book"], r["chapter"], r["code"], r["severity"]) for r in structure.snapshot_issues(books, "book", "chapter", removed).collect()}
    assert got == {("b", 1, "DUPLICATE_CHAPTER_TITLE", "warning"), ("b", 2, "DUPLICATE_CHAPTER_TITLE", "warning"), ("b", 2, "REPLACEMENT_CHARACTER", "warning"), ("b", None, "CLEANING_REMOVED_CONTENT", "info"), ("c", 3, "EMPTY_CHAPTER", "warning")}


def test_cleaning_cases():
    clean = lambda t, **k: cleaning.clean_text(t, k.pop("repeated", set()), k.pop("blocked", []), **k)
    only = {"duplicates": False, "unwrap": False}
    for gone in ("123456", "- 3", "- 3 -", "12页", "第 12 页", "— 7 —", "7-", " 5 "):
        assert clean(f"a。\n{gone}\nb。")[:3] == ("a。\nb。", True, 1), gone
    for stays in ("page 3", "3.5", "第 12 章", "-- 3", "3 a"):
        assert stays in clean(f"a。\n{stays}\nb。")[0], stays
    assert clean("\n\nHello there next\n\n", **only) == ("Hello there next", False, 0, 0, 0)
    assert clean("a  \r\nb\r\n", **only) == ("a\nb", True, 0, 0, 0)
    assert clean("A\nB\nB")[0] == "ABB"  # a line is compared with the joined one
    assert clean("AB\nAB")[:4] == ("AB", True, 1, 0)
    assert clean("ab.\ncd")[0] == "ab.cd" and clean("ab。\ncd")[0] == "ab。\ncd" and clean("“ab”\ncd")[0] == "“ab”\ncd"
    assert clean("ab’\ncd")[0] == "ab’cd" and clean("ab\n cd\nef")[0] == "ab\n cdef"
    assert clean("广告 x\n正文。\n广告", blocked=["广告"]) == ("正文。", True, 2, 0, 6)
    assert clean("a。\n\n\n\n\nb。") == ("a。\n\nb。", True, 0, 0, 0)
    assert clean(None) == ("", False, 0, 0, 0)
    assert clean("x\n" * 100_000)[2] == 99_999 and clean("\n".join(f"w{i}" for i in range(100_000)))[3] == 99_999  # linear


def test_cleaning_of_books(spark):
    texts = ["页眉\n正文一。\n- 3 -\n正文一。\n页脚", "页眉\nx。\n\n\n\ny。\n12\n页脚", "页眉\nz。\n页眉\n页脚", None]
    rows = spark.createDataFrame([("b", i, t) for i, t in enumerate(texts)], "book string, n int, text string")
    got = {r["n"]: r for r in cleaning.cleaned(rows, "book", "text").collect()}
    assert {n: r["clean"] for n, r in got.items()} == {0: "正文一。", 1: "x。\n\ny。", 2: "z。", 3: ""}
    total = cleaning.report(cleaning.cleaned(rows, "book", "text"), "book").first()
    assert (total["changed_chapters"], total["removed_lines"], total["joined_lines"], total["removed_characters"]) == (3, 10, 0, 2 * 7 + 5 + 4 + 2)


def test_canon(spark):
    kind = "book string, chapter string, ordinal int, characters array<string>, locations array<string>, world_terms array<string>, evidence array<struct<claim:string,segment_ids:array<string>>>, confidence double"
    rows = spark.createDataFrame([("b", "c2", 1, ["lin zhi", "Zhou"], [], [], [("zhou left", ["s9"])], 0.5), ("b", "c1", 0, ["Lin  Zhi", "Lin Zhi"], [], None, [("lin came", ["s1"]), ("rain", ["s2"])], 0.9)], kind)
    got = {r["norm"]: r for r in canon.entities(rows).collect()}
    assert got["lin zhi"]["name"] == "Lin  Zhi" and got["lin zhi"]["mentions"] == 3
    assert got["lin zhi"]["chapters"] == ["c1", "c2"] and got["lin zhi"]["evidence"] == ["s1"] and got["lin zhi"]["confidence"] == 0.9
    assert canon.legacy(rows.drop("locations"), {"locations": "array<string>"}).where("size(locations) = 0").count() == 2


def test_context_skips_what_does_not_fit(spark):
    pool = spark.createDataFrame([("p", 1, "fact", "a", "x" * 12, 3), ("p", 1, "fact", "b", "x" * 400, 2), ("p", 1, "fact", "c", "x" * 8, 1)], "project string, target int, kind string, id string, text string, priority int")
    targets = spark.createDataFrame([("p", 1), ("p", 2)], "project string, target int")
    sized = pool.withColumn("tokens", estimated_tokens(F.col("text"))).drop("text")
    made = context.assembled(sized, targets, 5)
    got = {r["target"]: r for r in made.collect()}
    assert [x["id"] for x in got[1]["sources"]] == ["a", "c"] and got[1]["used"] == 5
    assert got[1]["context_id"] == "ctx_" + hashlib.sha256(b"ctx\0p:1:5:a,c").hexdigest()[:24]
    assert got[2]["used"] == 0 and got[2]["context_id"] == "ctx_" + hashlib.sha256(b"ctx\0p:2:5:").hexdigest()[:24]
    prompts = {r["target"]: r["prompt"] for r in context.prompts(made, pool.select("project", "kind", "id", "text")).collect()}
    assert prompts == {1: "[fact:a]\n" + "x" * 12 + "\n\n[fact:c]\n" + "x" * 8, 2: ""}
    layers = spark.createDataFrame([("p", str(n), layer, "t", 0, 9, 1) for n, layer in enumerate(("project", "volume", "chapter", "scene", "recent"))], "project string, id string, layer string, text string, valid_from int, valid_through int, priority int")
    assert sorted(r["priority"] for r in context.visible_summaries(layers, targets.limit(1)).collect()) == [101, 201, 301, 401, 501]


def test_line_diffs():
    assert governance.line_diff(["甲", "乙"], ["甲", "丙", "乙"]) == [("same", "甲"), ("added", "丙"), ("same", "乙")]
    assert governance.line_diff(["甲", "乙"], ["甲"]) == [("same", "甲"), ("removed", "乙")]
    assert governance.line_diff(["a", "b"], ["b", "a"]) == [("removed", "a"), ("same", "b"), ("added", "a")]
    assert governance.line_diff(["a"], ["b"]) == [("removed", "a"), ("added", "b")]
    assert governance.line_diff([], []) == []


def test_task_and_write_logs(spark):
    log = lambda *states: spark.createDataFrame([(1, n, s, e) for n, (s, e) in enumerate((x if isinstance(x, tuple) else (x, None)) for x in states)], "task int, seq int, status string, error string")
    legal = lambda *states: [r["legal"] for r in review.transitions(log(*states), "task", "seq", "status", "error").orderBy("seq").collect()]
    assert legal("queued", "succeeded", "running", "paused") == [True, False, True, True]  # an illegal event changes nothing
    assert legal("running", "queued", "paused", "running", "queued") == [False, True, True, False, True]
    assert legal("queued", "running", "cancelled", "cancelling", "cancelled", "queued") == [True, True, False, True, True, False]
    assert legal("queued", "running", "failed", ("failed", "e"), "queued", ("running", "e"), "running", "succeeded", "queued") == [True, True, False, True, True, False, True, True, False]
    timed = log("queued", "running", "paused", "queued", "running", "succeeded").withColumn("at", F.timestamp_seconds(F.col("seq") * 60))
    last = review.transitions(timed, "task", "seq", "status", "error", "at").orderBy(F.desc("seq")).first()
    assert (last["after"], last["started_at"].timestamp(), last["finished_at"].timestamp()) == ("succeeded", 60, 300)
    saves = spark.createDataFrame([("d", 1, "t", "x", "ai", 0), ("d", 2, "t ", "x", "ai", 1), ("d", 3, "u", "x", "ai", 1), ("d", 4, "u", "y", "bot", 2), ("d", 5, "u", "y", "manual", 1), ("d", 6, "u", "y", "manual", None)], "doc string, seq int, title string, content string, source string, expected int")
    made = review.versions(saves, "doc", "seq", "content", "title", "source", "expected").orderBy("seq").collect()
    assert [(r["seq"], r["revision"]) for r in made] == [(1, 1), (3, 2), (6, 3)]
    writes = spark.createDataFrame([("d", 1, 0, "x"), ("d", 2, 0, "y"), ("d", 3, 1, "z")], "doc string, seq int, expected int, content string")
    got = [(r["revision"], r["accepted"]) for r in review.optimistic(writes, ["doc"], "seq", "expected").orderBy("seq").collect()]
    assert got == [(1, True), (1, False), (2, True)]
    entries, illegal = review.reviewed(spark.createDataFrame([("a", 1, "k", "v1", "accepted"), ("a", 2, "k", "v9", "accepted"), ("b", 3, "k", "v2", "accepted")], "candidate string, seq int, kind string, value string, decision string"), "candidate", ["kind"], "seq")
    assert [(r["revision"], r["value"]) for r in entries.collect()] == [(2, "v2")] and illegal.count() == 1


def test_budgets(spark):
    rows = spark.createDataFrame([("p", "2024-01-01 00:00:00", 1, 60), ("p", "2024-01-01 00:00:00", 2, 60), ("p", "2024-01-02 00:00:00", 3, 60)], "project string, ts string, seq int, est int").withColumn("ts", F.to_timestamp("ts"))
    got = [r["allowed"] for r in usage.budget_gate(rows, "project", "ts", "seq", "est", 100, 100).orderBy("seq").collect()]
    assert got == [True, False, True]
    rows = spark.createDataFrame([("p", 1, 60), ("p", 2, 60), ("p", 3, 30)], "project string, seq int, est int").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    got = [(r["used"], r["allowed"]) for r in usage.budget_gate(rows, "project", "ts", "seq", "est", 100, 100).orderBy("seq").collect()]
    assert got == [(0, True), (60, False), (60, True)]  # a refused request takes nothing


def test_mentions_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abAB林雨") for _ in range(rng.randint(1, 5)))
    items = [(f"s{i % 3}", i, " ".join(word() + rng.choice(["", ",", "。"]) for _ in range(30)) if i % 10 else None) for i in range(60)]
    log = [(f"s{i % 2}", i, f"{word()} {word()}‘{word()}’", word() * 30 if i == 4 else word()) for i in range(8)]
    items.append(("s0", 99, "x" + log[4][3].lower() + "y"))
    terms = {}
    for s, _, before, after in log:
        for t in re.split("[\\s，。；、：,.!?！？;:\"“”'‘’（）()《》]+", before) + re.split("[\\s，。；、：,.!?！？;:\"“”'‘’（）()《》]+", after):
            if len(t) >= 2 and t.lower() not in terms.setdefault(s, []):
                terms[s].append(t.lower())
    want = {}
    for s, k, t in items:
        hit = [x for x in terms.get(s, []) if x in (t or "").lower()]
        if hit:
            want[(s, k)] = (hit[:3], len(hit), "引用了变更内容：" + "、".join(hit[:3]))
    found = governance.changed_terms(spark.createDataFrame(log, "scope string, at int, before string, after string"), "scope", "at")
    rows = governance.mentions(spark.createDataFrame(items, "scope string, id int, text string"), found, "scope", "id", "text").collect()
    assert {(r["scope"], r["id"]): (r["terms"], r["n_terms"], r["reason"]) for r in rows} == want
    assert ("s0", 99) in want


def test_consistency_evidence(spark):
    kind = "chapter_id string, i int, kind string, severity string, title string, description string, suggestion string, repair string, evidence array<struct<source_id:string,quote:string>>"
    row = lambda i, evidence, kind="plan", severity="info", title="t": ("c", i, kind, severity, title, "d", "s", "r", evidence)
    issues = spark.createDataFrame([row(0, [("a", "他 来\n了")]), row(1, []), row(2, [("zz", "x")]), row(3, [("a", "没有")]), row(4, [("a", " ")]), row(5, [("a", "来了")], "mood", "fatal"), row(6, [("a", "来了")], title=None), row(7, None)], kind)
    good, bad = review.consistency_issues(issues, spark.createDataFrame([("a", "他来了。")], "source_id string, text string"))
    h = 2166136261
    for u in "c:0:t":
        h = ((h ^ ord(u)) * 16777619) & 0xFFFFFFFF
    assert [(r["i"], r["issue_id"], r["status"]) for r in good.collect()] == [(0, f"consistency_{h:08x}", "open")]
    assert {r["i"]: r["reasons"] for r in bad.collect()} == {1: ["no_evidence"], 2: ["unknown_source"], 3: ["quote"], 4: ["evidence"], 5: ["kind", "severity"], 6: ["title"], 7: ["no_evidence"]}


def test_names_in_a_languages_order(spark):
    rows = spark.createDataFrame([("b", n) for n in ("林栀", "周屿", "阿")], "book string, name string")
    assert [r["name"] for r in review.by_name(rows, "book", "name").orderBy("place").collect()] == ["阿", "林栀", "周屿"]


def test_scan_of_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.TXT").write_bytes("雨".encode())
    (tmp_path / "y.mobi").write_bytes(b"y")
    got = {r["path"].rsplit("/", 1)[1]: (r["size"], r["sha256"], r["format"], r["error"]) for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"x.TXT": (3, hashlib.sha256("雨".encode()).hexdigest(), "text", None), "y.mobi": (1, hashlib.sha256(b"y").hexdigest(), None, "unsupported: mobi")}


def test_archive_limits(monkeypatch):
    book = archive([("a.xhtml", "<p>x</p>"), ("b.xhtml", "<p>y</p>")])
    monkeypatch.setattr(files, "MAX_ENTRIES", 3)
    assert files.epub_items(book)[0][-1] == "TOO_MANY_ENTRIES"
    monkeypatch.setattr(files, "MAX_ENTRIES", 100)
    monkeypatch.setattr(files, "MAX_TOTAL", 10)
    assert files.epub_items(book)[0][-1] == "TOO_LARGE"


def test_audited_generation_resumes(spark):
    kind = "project string, kind string, input_hash string, prompt string"
    requests = spark.createDataFrame([("p", "k", "h1", "a"), ("p", "k", "h1", "a"), ("p", "k", "h2", "bad"), ("p", "k", "h3", "long answer"), ("p", "k", "h4", "known")], kind)
    runs = spark.createDataFrame([("p", "k", "h4", "succeeded", "R", 1), ("p", "k", "h2", "failed", None, 2)], "project string, kind string, input_hash string, status string, result string, seq int")

    def answer(p):
        if p == "bad":
            raise ValueError("no")
        return p.upper()

    results, audit = infer.audited(requests, runs, answer, F.filter(F.array(F.when(F.length("result") > 5, F.lit("size"))), lambda x: x.isNotNull()))
    got = sorted((r["input_hash"], r["result"], r["outcome"]) for r in results.na.fill("", ["result"]).collect())
    assert got == [("h1", "A", "ok"), ("h1", "A", "ok"), ("h2", "", "error: no"), ("h3", "", "invalid: size"), ("h4", "R", "reused")]
    assert sorted((r["input_hash"], r["status"]) for r in audit.collect()) == [("h1", "succeeded"), ("h2", "failed"), ("h3", "failed")]


def test_plan_rules(spark):
    plan = '{"volumes":[{"number":1,"title":"v","target_words":10,"chapters":[{"number":1,"title":"c","scenes":[]},{"number":1,"title":" ","scenes":[{"title":"s","characters":[" a","a "],"target_words":0}]}]}]}'
    flat = outline.flattened(spark.createDataFrame([("p", plan)], "project string, payload string"), "project", "payload")
    assert flat["scenes"].first()["characters"] == ["a"]
    got = {r["rule"]: r["n"] for r in outline.plan_violations(flat["volumes"], flat["chapters"], flat["scenes"], "project").collect()}
    assert got == {"duplicate_chapter": 1, "blank_title": 1, "target_words": 1}
    nums = spark.createDataFrame([("p", n) for n in (1, 3, 4)], "project string, number int")
    assert outline.number_gaps(nums, "project", "number").count() == 2


def test_files(spark):
    raw = [("a.txt", "\ufeff第一章\n雨".encode()), ("b.txt", b"\xff\xfe" + "字".encode("utf-16-le")), ("c.txt", "中文".encode("gb18030")), ("d.mobi", b"x")]
    rows = files.described(spark.createDataFrame(raw, "path string, content binary"))
    assert rows.where("error is not null").count() == 1
    got = {r["path"]: (r["encoding"], r["text"]) for r in files.decoded(rows.where("error is null")).collect()}
    assert got == {"a.txt": ("utf-8-bom", "第一章\n雨"), "b.txt": ("utf-16le", "字"), "c.txt": ("gb18030", "中文")}
    done = files.import_files(spark.createDataFrame(raw, "path string, content binary"))
    assert done["documents"].count() == 3 and done["chapters"].count() == 3


def test_html_and_epub():
    assert files.html_text("<h1> T <b>x</b></h1><nav>no</nav><p>a&amp;b</p><script>1</script>c") == ("T x", "T x\n\na&b\n\nc")
    assert files.html_text(None) == ("", "")
    items = files.epub_items(archive([("b%20c.xhtml", "<p>x</p>"), ("../up.xhtml", "y")]))
    assert [i[-1] for i in items][:1] == ["UNSAFE_ENTRY"]
    assert [i[-1] for i in files.epub_items(archive([("a.xhtml", "<p>x</p>")]))] == [""]
    assert files.epub_items(b"not a zip")[0][-1] == "CORRUPT_CONTAINER"


def test_exports_and_bundles(spark, tmp_path):
    rows = spark.createDataFrame([("B", 2, "two", " b "), ("B", 1, "one", "a")], "book string, number int, title string, content string")
    assert exports.manuscripts(rows, "book", "number", "title", "content").first()["manuscript"] == "B\n\n第1章 one\n\na\n\n第2章 two\n\nb"
    assert exports.manuscripts(rows, "book", "number", "title", "content", True).first()["manuscript"].endswith("## 第2章 two\n\nb\n")
    projects, chapters = spark.createDataFrame([(1,)], "project_id long"), spark.createDataFrame([(5, 1)], "chapter_id long, project_id long")
    exports.write_bundle({"projects": projects, "chapters": chapters}, str(tmp_path / "b"))
    back = exports.restored(exports.read_bundle(spark, str(tmp_path / "b")), "-x")
    assert back["chapters"].first().asDict() == {"chapter_id": "5-x", "project_id": "1-x"}


def test_generation_reports_each_row(spark):
    def answer(p):
        if p == "bad":
            raise ValueError("no")
        return " " if p == "blank" else p.upper()

    got = {r["k"]: (r["result"], r["outcome"]) for r in infer.generated(spark.createDataFrame([(1, "a"), (2, "bad"), (3, "blank")], "k int, p string"), "k", "p", answer).collect()}
    assert got == {1: ("A", "ok"), 2: (None, "error: no"), 3: (None, "empty")}


def test_unsafe_paths():
    assert files.unsafe("../x") and files.unsafe("/x") and files.unsafe("C:\\x") and not files.unsafe("a/b.txt")


def test_streams_keep_unfinished_tasks(spark, tmp_path):
    from leafmill.scratch import Tables

    rows = [(1, 0, "text_delta", "a", 1), (1, 1, "text_delta", "b", 1), (1, 2, "done", None, None), (3, 0, "done", None, 4), (2, 0, "text_delta", "c", 1)]
    spark.createDataFrame(rows, "task long, seq long, kind string, text string, tokens long").write.parquet(str(tmp_path / "events"))
    got = jobs.drained(jobs.assembled_answers(jobs.opened(spark, str(tmp_path / "events"))), Tables(spark), "out").orderBy("task").collect()
    assert [(r["task"], r["text"], r["tokens"], r["outcome"]) for r in got] == [(1, "ab", 2, "ok"), (3, "", 4, "empty")]


def test_every_quote_of_every_source_is_cited(spark):
    words = [f"w{i}" for i in range(400)]
    quotes = [(i, " ".join(words[i : i + 7 + i % 3])) for i in range(60)] + [(100, "w1 w2"), (101, "1 w2 W3  w4\nw5 w6 w"), (102, "never there at all in any of them"), (103, " "), (104, None)]
    texts = [(n, " ".join(words[7 * n : 7 * n + 40]).replace(" w2 ", "\n W2  ")) for n in range(12)] + [(50, None), (51, ""), (52, "xw3 w4 w5 w6 w7 w8 w99")]
    sources, items = spark.createDataFrame(texts, "source_id long, text string"), spark.createDataFrame(quotes, "quote_id long, quote string")
    flat = lambda t: re.sub(r"\s+", " ", t or "").strip().lower()
    want = {(s, q) for s, t in texts for q, x in quotes if flat(x) and flat(x) in flat(t)}
    rows = review.quotes(review.citations(sources, items), sources, squeezed).where("verdict = 'verified'").collect()
    assert len(rows) == len(want) and {(r["source_id"], r["quote_id"]) for r in rows} == want
    assert {q for _, q in want} >= {*range(60), 100, 101}


def test_all_items_are_verified(spark):
    from leafmill.plans import registry

    sf = "/root/testdata/sf0.001"
    flat = lambda t: re.sub(r"\s+", " ", t or "").strip().lower()
    texts = [flat(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {r["item_id"]: sum(flat(r["text"]) in t for t in texts) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = registry.QUERIES["all_quote_verification"](spark, sf).collect()
    assert {r["item_id"]: r["verified"] for r in got} == want and all(r["cited"] >= r["verified"] for r in got)


def test_optimistic_carries_its_state_along_a_hot_log(spark):
    writes = spark.range(60_000).select(F.when(F.col("id") % 7 == 0, "b").otherwise("a").alias("doc"), F.col("id").alias("seq"), (F.col("id") % 5).cast("int").alias("expected"))
    rows = review.optimistic(writes.repartition(5), ["doc"], "seq", "expected")
    assert "collect_list" not in rows._jdf.queryExecution().toString()  # a log is never one value
    at, want = {"a": 0, "b": 0}, []
    for i in range(60_000):
        k = "b" if i % 7 == 0 else "a"
        fits = i % 5 == at[k]
        at[k] += fits
        want.append((k, i, at[k], fits))
    assert [(r["doc"], r["seq"], r["revision"], r["accepted"]) for r in rows.orderBy("seq").collect()] == want


def test_whole_texts_are_digested_in_parts(spark):
    rows = [(b, n, f"t{n}" if n % 4 else None, f"  text {b} {n}\n") for b in ("x", "y", "z") for n in range(9)] + [("only", 0, None, None)]
    table = spark.createDataFrame(rows, "book string, n int, title string, content string").repartition(4)
    md5 = lambda df, c: {r["book"]: hashlib.md5(r[c].encode()).hexdigest() for r in df.collect()}
    for markdown in (False, True):
        got = exports.manuscript_digests(table, "book", "n", "title", "content", markdown)
        assert "collect_list" not in got._jdf.queryExecution().toString()
        assert {r["book"]: r["digest"] for r in got.collect()} == md5(exports.manuscripts(table, "book", "n", "title", "content", markdown), "manuscript")
    got = structure.backfilled_digests(table, "book", "n", "title", "content")
    assert {r["book"]: r["digest"] for r in got.collect()} == md5(structure.backfilled(table, "book", "n", "title", "content"), "raw_text")


def test_registered_texts_are_never_one_value(spark):
    from leafmill.plans import registry

    for name in ("manuscripts", "raw_text_backfill"):
        assert "collect_list" not in registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_archives_are_packed_and_read_a_few_at_a_time(spark):
    import pyarrow as pa

    from leafmill.sources.packing import packed

    batch = pa.RecordBatch.from_pydict({"n": list(range(100))})
    assert [b.num_rows for b in files.sliced([batch])] == [32, 32, 32, 4]
    assert [v for b in files.sliced([batch]) for v in b.column(0).to_pylist()] == list(range(100))
    pages = spark.createDataFrame([(str(n), f"<h1>t{n}</h1><p>x</p>" if n % 7 else None) for n in range(100)], "url string, html string")
    got = {r["path"]: (r["title"], r["text"], r["issue"]) for r in files.epub_chapters(packed(pages, "url", "html")).collect()}
    assert got == {str(n): (f"t{n}", f"t{n}\n\nx", "") if n % 7 else (None, None, "NO_CONTENT") for n in range(100)}
