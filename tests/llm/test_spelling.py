"""Spelling variants against a plain Python version of their contract."""

import random
import re
import zlib
from collections import Counter

import pytest

from leafmill.llm import spelling

from test_llm import AWKWARD, docs


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, least_letters=7, least_count=2, times=10, slips=31):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_letters:
                count[run] += 1
    words = {w: n for w, n in count.items() if n >= least_count}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        if vs and words[best := min(vs, key=lambda v: (-words[v], v))] >= times * words[w]:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def corpus(seed, kinds=40, texts=120):
    """Words over few letters with all kinds of edits, some far more frequent than others."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcéÿÀx") for _ in range(rng.randint(5, 12))) for _ in range(kinds)]
    rows = []
    for i in range(texts):
        out = []
        for _ in range(80):
            w = base[min(int(rng.expovariate(0.15)), kinds - 1)]
            if rng.random() < 0.25:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcé") + w[k:], w[:k] + rng.choice("abcéÿ") + w[k + 1 :]])
            out.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((i, rng.choice([" ", ", ", "_", "1"]).join(out)))
    return rows


@pytest.mark.parametrize("block", [4096, 3])
@pytest.mark.parametrize("shape", [{}, {"least_letters": 4, "least_count": 1, "times": 2, "slips": 3}])
def test_against_plain_python(spark, monkeypatch, block, shape):
    monkeypatch.setattr(spelling, "BLOCK", block)  # 16 words a block at least
    rows = [*corpus(3), *AWKWARD]
    got = [tuple(r) for r in spelling.variants(docs(spark, rows), **shape).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, **shape)


def test_forms_lead_to_a_root(spark):
    rows = [(1, "abcdefgh " * 2 + "abcdefgx " * 30 + "abcdefyx " * 400 + "bacdefgh " * 9)]
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(docs(spark, rows), slips=10**9).collect()}
    assert got == {"abcdefgh": ("abcdefgx", "abcdefyx"), "abcdefgx": ("abcdefyx", "abcdefyx"), "abcdefyx": (None, "abcdefyx"), "bacdefgh": (None, "bacdefgh")}


def test_ties_take_the_first_word(spark):
    rows = [(1, "zbcdefg " * 20 + "abcdefg " * 20 + "Àbcdefg " * 20 + "ybcdefg " * 2)]
    got = {r["word"]: (r["form"], r["n_near"]) for r in spelling.variants(docs(spark, rows), slips=10**9).collect()}
    assert got["ybcdefg"] == ("abcdefg", 3)


def test_very_long_words(spark):
    long = "ab" * 3000
    rows = [(1, f"{long} {long} {long[:-1]} {long[:-1]} {long[:2500]}x{long[2500:]} {long[:2500]}x{long[2500:]} {long[:-1]}é {long[:-1]}é")]
    assert {tuple(r) for r in spelling.variants(docs(spark, rows), slips=10**9).collect()} == brute(rows, slips=10**9)


def test_no_words(spark):
    assert spelling.variants(docs(spark, [])).count() == 0
    assert spelling.variants(docs(spark, [(1, None), (2, ""), (3, "1 2 3 short")])).count() == 0
