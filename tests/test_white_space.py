"""White space of the interface: wide spaces, line separators and the byte order mark count, wherever text is cut."""

import random
import re

from pyspark.sql import functions as F

from leafmill.functions import SPACES, trimmed
from leafmill.operators import structure
from leafmill.operators.infer import register_functions
from leafmill.sources import exports

HEAD = re.compile(r"^[{0}]*(?:第[〇零一二三四五六七八九十百千万两\d]+[卷部篇章节回]|(?:卷|章)[〇零一二三四五六七八九十百千万两\d]+|(?:序章|楔子|引子|前言|后记|尾声|终章|番外(?:篇)?(?:[一二三四五六七八九十\d]+)?))(?:[{0}:：、.-]+.*)?[{0}]*$".format(SPACES))


def test_indented_headings(spark):
    text = "　　第一章 雨夜\n　　他来了。\n 第二章　归来　\n﻿　完\n　不是第三章\n"
    docs = spark.createDataFrame([(1, text)], "k int, text string")
    got = [(r["title"], r["content"]) for r in structure.chapters(docs, "k").orderBy("ordinal").collect()]
    assert got == [("第一章 雨夜", "他来了。"), ("第二章　归来", "完\n　不是第三章")]
    codes = {r["code"] for r in structure.import_issues(docs, structure.chapters(docs, "k"), "k").collect()}
    assert "NO_CHAPTER_HEADINGS" not in codes


def random_text(rng):
    line = lambda: rng.choice(["", " ", "　"]) + rng.choice(["第一章", "第2回", "章三", "终章", "字", "不是第一章", "第一章x", ""]) + rng.choice(["", "　", " x", "：y", " z　", "-"])
    return rng.choice(["\n", "\r\n"]).join(line() for _ in range(rng.randint(0, 9)))


def test_chapters_equal_the_table_function_on_random_lines(spark):
    rng = random.Random(3)
    texts = [random_text(rng) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    ours = {(r["k"], r["ordinal"], r["title"], r["content"]) for r in structure.chapters(docs, "k").collect()}
    register_functions(spark)
    docs.createOrReplaceTempView("white_space_docs")
    rows = spark.sql("SELECT k, c.* FROM white_space_docs d, LATERAL text_chapters(d.text) c").collect()
    assert ours == {(r["k"], r["ordinal"], r["title"], r["content"]) for r in rows}
    for k, text in enumerate(texts):  # and the lines themselves
        heads = [x.strip(SPACES) for x in re.sub("\r\n?", "\n", text).split("\n") if HEAD.match(x)]
        assert [t for q, _, t, _ in sorted(ours) if q == k and t not in (structure.PREFIX, structure.WHOLE)] == heads


def test_paragraphs(spark):
    docs = spark.createDataFrame([(1, "x\n　\ny"), (2, "甲。　\n乙"), (3, "甲。\n乙\n丙"), (4, "a\n \n\n﻿b　"), (5, "　\n")], "k int, text string")
    got = {}
    for r in structure.segments(docs, "k", mode="paragraph").orderBy("k", "ordinal").collect():
        got.setdefault(r["k"], []).append(r["content"])
    assert got == {1: ["x", "y"], 2: ["甲。", "乙"], 3: ["甲。", "乙\n丙"], 4: ["a", "b"]}


def test_blank_drafts_are_not_exported(spark):
    plan = spark.createDataFrame([(k, 1, "t") for k in range(4)], "k int, book int, title string")
    drafts = spark.createDataFrame([(0, "\n\t"), (1, "　﻿"), (2, "　x "), (3, None)], "k int, content string")
    rows = exports.selected(plan, drafts, ["k"], "content")
    assert [r["k"] for r in rows.collect()] == [2]
    assert exports.manuscripts(rows, "book", "k", "title", "content").first()["manuscript"] == "1\n\n第2章 t\n\nx"
    assert exports.selected(plan, drafts.where(F.lit(False)), ["k"], "content").count() == 0


def test_a_trim_ends_where_the_text_does(spark):
    # a next-line mark is no white space here, so what stands before it stays, as in SQL
    texts = ["x \u0085", "\u0085 x", None, "", SPACES, *(f"{c}a{c}b{c}" for c in SPACES + "​᠎\x1c")]
    got = [r["t"] for r in spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").orderBy("n").select(trimmed(F.col("t")).alias("t")).collect()]
    assert got == [None if t is None else t.strip(SPACES) for t in texts]
