"""The pipeline's stages on a small corpus, each against what it must do to its own input."""

import random

import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9)))
    clean = [" ".join(word() for _ in range(rnd.randrange(30, 300))) + "." for _ in range(120)]
    long = " ".join(word() for _ in range(4000))
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean)]
    junk = [(200 + i, " ".join(f"{word()}$$$" for _ in range(80)), "en", "s0", 1) for i in range(40)]
    copies = [(300, clean[3], "en", "s0", 1), (301, clean[3].replace(" ", "\n"), "en", "s1", 1)]
    near = [(400, long, "en", "s0", 1), (401, long + " end", "en", "s0", 1)]
    at = tmp_path_factory.mktemp("pipe")
    spark.createDataFrame(rows + junk + copies + near, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)] + [(200 + i, 0, 0) for i in range(0, 40, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, folder, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert name == "packing" or docs.columns == columns
    assert ids["quality"] == {*range(120), 300, 301, 400, 401}
    assert ids["exact_dedup"] == {*range(120), 400, 401}
    assert ids["near_dedup"] == ids["packing"] == {*range(120), 400}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == ids["packing"]


def test_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
