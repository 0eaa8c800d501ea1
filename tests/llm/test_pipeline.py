"""Each stage of the pipeline against a plain version of what it says, on its own input."""

import re

import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import decontaminate, dartminhash, queries, secret_ledger, toxicity
from leafmill.scratch import Tables

from test_llm import AWKWARD, SECRETS, SMALL, docs, prose, shingle_set

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], KIND)


def plain_survivors(rows):
    """Rows by a walk over all pairs of texts: one of each group, the smallest id and then the smallest MD5."""
    import hashlib

    named = sorted({(i, hashlib.md5((t or "").encode()).hexdigest(), t) for i, t in rows if i is not None}, key=lambda r: (r[0], r[1], r[2] is None))
    texts = sorted({t for _, _, t in named if shingle_set(t)})
    sets = [shingle_set(t) for t in texts]
    group = list(range(len(texts)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group[top(a)] = top(b)
    place = {t: top(n) for n, t in enumerate(texts)}
    kept, seen = [], set()
    for i, _, t in named:
        if t not in place or place[t] not in seen:
            kept.append((i, t))
            seen.add(place.get(t))
    return sorted(map(str, kept + [(None, t) for i, t in rows if i is None]))


def test_two_texts_of_one_id_both_stay(spark):
    rows = [(1, "uno dos tres cuatro cinco seis"), (1, "alpha beta gamma delta epsilon zeta"), (2, prose(1, 60)), (2, prose(1, 60) + " more"), (3, prose(1, 60)), (1, "uno dos tres cuatro cinco seis"), (4, None), (4, ""), (4, None), (None, prose(1, 60)), (None, prose(1, 60)), (5, prose(2, 70)), (0, prose(2, 70))]
    got = sorted(str((r["doc_id"], r["text"])) for r in corpus_pipeline.drop_near_copies(spark, table(spark, rows), SMALL).collect())
    assert got == plain_survivors(rows)
    assert sum("uno" in g for g in got) == 1 and sum("alpha" in g for g in got) == 1


@pytest.fixture(scope="module")
def small(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars < 6000").collect()]
    return rows + [(i, t) for i, t in AWKWARD if i != 5] + [(9000 + n, t) for n, t in enumerate(SECRETS)] + [(rows[0][0], "another text of an id that has one already")]


def test_near_copies(spark, small):
    got = [str((r["doc_id"], r["text"])) for r in corpus_pipeline.drop_near_copies(spark, table(spark, small), SMALL).collect()]
    assert sorted(got) == plain_survivors(small)
    other = dartminhash.survivors(table(spark, small).withColumn("id", F.lit(1)).withColumn("h", F.lit("x")))
    assert other.count() == len(got) and other.columns[-2:] == ["id", "h"]


def test_toxic_documents(spark):
    larger = SMALL.replace("0.001", "0.01")
    some = [(r["doc_id"], r["text"]) for r in queries.table(spark, larger, "documents").collect()] + [(i, t) for i, t in AWKWARD if i != 5]
    rows = table(spark, some)
    model = toxicity.learn(rows, queries.table(spark, larger, "labels"))
    got = sorted(str((r["doc_id"], r["text"])) for r in corpus_pipeline.drop_toxic(spark, rows, larger).collect())
    assert got == sorted(str((i, t)) for (i, t), s in zip(some, model.scores([t for _, t in some]), strict=True) if s < 0.5)
    assert len(got) < len(some)


def test_benchmark_leaks(spark, small):
    items = [(r["item_id"], r["text"]) for r in queries.table(spark, SMALL, "benchmark").collect()]
    leaks = {(small[n][0], f"{small[n][1]} {items[n][1]} {prose(n, 30)}") for n in range(5)}
    mixed = [*small, *leaks]
    got = {(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_benchmark_leaks(spark, table(spark, mixed), SMALL).collect()}
    words = lambda t: " ".join(re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    held = [f" {words(t)} " for _, t in items]
    exact = {(i, t) for i, t in mixed if any(h in f" {words(t)} " for h in held)}
    assert leaks <= exact and not exact & got
    found = {r["doc_id"] for r in decontaminate.contaminated(table(spark, mixed), queries.table(spark, SMALL, "benchmark")).collect()}
    assert {i for i, _ in set(mixed) - got} == found


def test_secrets_are_masked(spark, small):
    rows = table(spark, small)
    got = sorted(str((r["doc_id"], r["text"], r["n_chars"])) for r in corpus_pipeline.mask_secrets(spark, rows, SMALL).collect())
    want = []
    spans = {}
    for r in secret_ledger.report(docs(spark, [(n, t) for n, (_, t) in enumerate(small)]), Tables(spark)).collect():
        spans[r["doc_id"]] = sorted(tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s)
    for n, (i, t) in enumerate(small):
        out, at = "", 0
        for a, b in spans[n]:
            if a >= at:
                out += t[at:a] + "[secret]"
            at = max(at, b)
        masked = t if t is None else out + t[at:]
        want.append(str((i, masked, None if masked is None else len(masked))))
    assert got == sorted(want)


def test_tokens(spark, small):
    ranks = load_tiktoken_bpe(queries.vocabulary("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=queries.pattern(), mergeable_ranks=ranks, special_tokens={})
    got = sorted(str((r["doc_id"], r["n_tokens"], list(r["ids"]))) for r in corpus_pipeline.tokenise(spark, table(spark, small), SMALL).collect())
    assert got == sorted(str((i, len(x), x)) for i, t in small for x in [own.encode(t or "")])


def test_empty_table(spark):
    rows = table(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        rows = Tables(spark).save(stage(spark, rows, SMALL), name)
    assert rows.count() == 0 and rows.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
