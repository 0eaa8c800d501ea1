"""Scores of single texts computed again in plain Python."""

import math
import random

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from leafmill.llm import langid, maxent, toxicity
from leafmill.llm._words import Words, column_bytes
from leafmill.scratch import Tables

from test_llm import docs, prose

TEXTS = ["", " ", "- Ther ing, 12 whe!", " starts with a space", "ends with one. ", "ção 🙂 nho " * 30, "x" * 700, prose(5, 400), "zugmonger " + prose(6, 50), "a\0b c", prose(7, 9).upper()]


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def test_toxicity_scores(spark):
    rng = random.Random(3)
    toxic, ordinary = [], []
    for i in range(240):
        words = prose(3000 + i, 60).split()
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["dreadful", "wretchedly", "zugmonger"]))
        (toxic if i % 4 == 0 else ordinary).append(" ".join(words))
    model = toxicity.fit(toxic, ordinary, 0.25)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, list(enumerate(TEXTS))), model).collect()}
    lengths = []
    for content in (model.ordinary, model.toxic + model.ordinary):
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters(**toxicity.SEARCH, write_content_size=False, write_checksum=False, write_dict_id=False)
        known.precompute_compress(compression_params=how)
        lengths.append(zstandard.ZstdCompressor(dict_data=known, compression_params=how))
    for i, text in enumerate(TEXTS):
        data, cut = text.lower().encode(), []
        while data:
            at = len(data) if len(data) <= 80 else data.find(b" ", 80, 160) + 1 or 160
            cut.append(data[:at])
            data = data[at:]
        saved = [len(lengths[0].compress(w)) - len(lengths[1].compress(w)) for w in cut]
        n = max(len(cut), 1)
        steps = [sum(s >= k for s in saved) for k in toxicity.STEPS]
        row = [sum(saved) / n, *(c / n for c in steps), sum(s < 0 for s in saved) / n, *(math.sqrt(c / n) for c in steps), *(math.log1p(c) for c in steps), math.log1p(n)]
        z = sum((x - m) / s * w for x, m, s, w in zip(row, model.mean, model.scale, model.weights, strict=False)) + model.weights[-1]  # the last weight is the constant
        assert abs(got[i] - sigmoid(z)) < 1e-9, text


def mix(x):
    full = 2**64 - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & full
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & full
    return x ^ x >> 31


def test_maxent_scores(spark):
    table = docs(spark, [(i, prose(500 + i, 60)) for i in range(60)] + [(100 + i, t) for i, t in enumerate(TEXTS)]).withColumn("held_out", F.lit(False))
    tables = Tables(spark)
    model, counts = maxent.learn(table.where("doc_id < 60"), tables, "doc_id", "text")
    got = {r["doc_id"]: r for r in maxent.score(table, model, counts, tables).collect()}
    number = {np.int64(r["hash"]).view(np.uint64).item(): r["n"] for r in counts.collect()}
    listed = {int(h): k for k, h in enumerate(model.table.hashes)}
    for i, text in enumerate(TEXTS):
        words = Words(*column_bytes(pa.array([text])))
        hashes, endings = [int(h) for h in words.hash()], maxent._ending(words).tolist()
        symbols = [int(model.table.symbols[listed[h]]) if h in listed else e for h, e in zip(hashes, endings, strict=True)]
        total, base = 0.0, 0.0
        for at, h in enumerate([*hashes, None]):
            back = [symbols[at - k] if at >= k else 0 for k in (1, 2, 3, 4)]
            s1, s2, s3, s4 = back
            rows = [off + mix(a * maxent.SYMBOLS + b + seed) % m for (a, b, seed), m, off in zip(((s1, s2, 0), (s1, s3, 10**6), (s2, s4, 2 * 10**6)), maxent.ROWS, maxent._OFFSETS.tolist(), strict=True)]
            z = model.weights[rows].astype(float).sum(0) + model.weights[-1]
            target = 0 if h is None else symbols[at] if h in listed else maxent.RARE
            share = 0.0
            if h in listed:
                share = float(model.inside[listed[h]])
            elif h is not None:
                share = math.log10((number[h] - model.discount) / model.rare_n) if h in number else model.unknown
            total += (z[target] - math.log(np.exp(z).sum())) / math.log(10) + share
            c = model.ends if h is None else number.get(h, 0)
            base += math.log10((c + 1) / (model.n + model.v + 1))
        row = got[100 + i]
        assert row["n_tokens"] == len(hashes) + 1
        assert abs(row["base_score"] - base) < 1e-6 and abs(row["score"] - total) < 1e-3 * max(1, abs(total)), text


def test_language_scores(spark):
    rng = random.Random(2)
    parts = {"aa": ["ther", "ing", "whe", "ould"], "bb": ["ção", "nho", "lhe", "ões"], "cc": ["sch", "ung", "ein", "über"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(30)), k) for i, k in enumerate(list(parts) * 40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(table)
    asked = docs(spark, list(enumerate(TEXTS))).coalesce(1)  # texts stand beside each other in one batch
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(asked, model).collect()}
    for i, text in enumerate(TEXTS):
        marks = bytearray()
        for b in text.encode():
            b = b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b if b >= 128 or 97 <= b <= 122 else 32
            if b != 32 or not marks or marks[-1] != 32:
                marks.append(b)
        found = [(int.from_bytes(marks[k : k + 3], "little") * 0x9E3779B1 % 2**32) >> 17 for k in range(len(marks) - 2)]
        found += [(int.from_bytes(marks[k : k + 4], "little") * 0x85EBCA6B % 2**32) >> 17 for k in range(len(marks) - 3)]
        z = [(sum(model.table[b, c] for b in found) / max(len(found), 1) + model.bias[c]) / model.temperature for c in range(3)]
        p = [math.exp(x - max(z)) for x in z]
        p = [x / sum(p) for x in p]
        if any(map(str.isalpha, text)):
            assert got[i][0] == model.langs[p.index(max(p))] and abs(got[i][1] - max(p)) < 1e-9, text
        else:
            assert got[i] == ("und", 0.0)
