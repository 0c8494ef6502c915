"""The pipeline's near-dedup stage against similarities of 5-word shingles, computed by hand."""

import random

import numpy as np
import pytest

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingled(text):
    ws = text.lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


def similarity(a, b):
    a, b = shingled(a), shingled(b)
    return len(a & b) / len(a | b)


def edited(rnd, text, low, high):
    """A copy with single words replaced until its similarity is between low and high."""
    ws = text.split()
    for at in rnd.sample(range(len(ws)), len(ws)):
        ws[at] = f"new{at}"
        if similarity(text, " ".join(ws)) < high:
            break
    assert low <= similarity(text, " ".join(ws)) < high
    return " ".join(ws)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(3, 9)))
    base = [" ".join(word() for _ in range(rnd.randrange(150, 400))) for _ in range(40)]
    near = {100 + i: edited(rnd, base[i], 0.8, (0.95, 0.9, 0.85)[i % 3]) for i in range(30)}
    below = {200 + i: edited(rnd, base[30 + i], 0.7, 0.79) for i in range(10)}
    return dict(enumerate(base)), near, below


def kept(spark, rows):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], FIELDS).repartition(3)
    out = corpus_pipeline.keep_near(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)


def test_copies_go_and_clean_documents_stay(spark, corpus):
    base, near, below = corpus
    assert {i for i, _ in kept(spark, [*base.items(), *near.items(), *below.items()])} == {*base, *below}


def test_blocks_of_a_large_group(spark, corpus, monkeypatch):
    from rondelle.llm import shingle_copies

    monkeypatch.setattr(shingle_copies, "BLOCK_TEXTS", 3)
    rnd = random.Random(5)
    copies = {300 + i: edited(rnd, corpus[0][0], 0.86, 0.9) for i in range(20)}
    assert {i for i, _ in kept(spark, [*corpus[0].items(), *copies.items()])} == {*corpus[0]}


@pytest.mark.parametrize("counted", [1, 7, 1_000_000])
def test_alike(monkeypatch, counted):
    from rondelle.llm import shingle_copies

    monkeypatch.setattr(shingle_copies, "COUNTED", counted)
    rnd = random.Random(6)
    sets = [set(rnd.sample(range(14), rnd.randrange(1, 12))) for _ in range(60)]
    got = shingle_copies.alike(np.array([x for s in sets for x in sorted(s)]), np.array([len(s) for s in sets]), 0.8)
    want = list(range(60))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 5 * len(a & b) >= 4 * len(a | b):
                    want[i] = want[j] = min(want[i], want[j])
    assert got.tolist() == want


def test_rows_with_equal_and_null_ids(spark, corpus):
    base, near, _ = corpus
    rows = [
        (1, base[0]), (9, near[100]), (9, base[1]),  # the clean row of id 9 stays
        (2, base[2]), (2, near[102]),  # one of two copies with one id
        (None, base[3]), (3, near[103]),  # a real id goes before none
        (None, base[4]), (None, near[104]),  # one of two copies without ids
        (None, base[5]),
    ]
    got = kept(spark, rows)
    assert len(got) == 6 and {(1, base[0]), (9, base[1]), (3, near[103]), (None, base[5])} <= set(got)
    assert sum(i == 2 for i, _ in got) == 1 and len({(None, base[4]), (None, near[104])} & set(got)) == 1


def test_texts_without_words(spark):
    assert kept(spark, [(5, None), (4, ""), (6, " "), (7, "one"), (8, "ONE "), (9, "two")]) == [(4, ""), (7, "one"), (9, "two")]


def test_the_trie_alone_proposes(spark, corpus, monkeypatch):
    """Without min-hash bands the copies whose fingerprints are within the radius go, and no clean document does."""
    from pyspark.sql import functions as F

    from rondelle.llm import shingle_copies
    from rondelle.llm.near_dedup import fingerprints

    base, near, below = corpus
    rows = [*base.items(), *near.items(), *below.items()]
    fps = {r["doc_id"]: r["fp"] for r in fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string"), 5).collect()}
    within = {i for i in near if ((fps[i] ^ fps[i - 100]) & (2**64 - 1)).bit_count() <= shingle_copies.RADIUS}
    assert len(within) > 15
    monkeypatch.setattr(shingle_copies, "banded", lambda hashes: hashes.select(F.col("row").alias("key"), "row").where("false"))
    assert {i for i, _ in kept(spark, rows)} == {i for i, _ in rows} - within


@pytest.mark.parametrize("wide", [3, 256])
def test_wide_budgets_in_the_trie(monkeypatch, wide):
    from rondelle.llm import trie

    monkeypatch.setattr(trie, "WIDE", wide)
    monkeypatch.setattr(trie, "LEAVES", 5)
    rnd = random.Random(8)
    centres = [rnd.getrandbits(64) for _ in range(40)]
    values = sorted({c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(12))) for c in centres for _ in range(6)})
    want = list(range(len(values)))
    while True:
        got = [min(want[j] for j, b in enumerate(values) if a >> 59 == b >> 59 and (a ^ b).bit_count() <= 10) for a in values]
        if got == want:
            break
        want = got
    assert trie.classes(np.array(values, np.uint64), 5, 10).tolist() == want
    assert len(set(want)) < len(values)
