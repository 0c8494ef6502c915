"""Choices, prompts, checkpoints and kept trees, against brute force and round trips."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from rondelle.operators import choices, conditions, context
from rondelle.sources import runs


def test_options_and_letters(spark):
    rnd = random.Random(3)
    given = [(f"q{i}", f"right {i}", [f"wrong {rnd.random()}" for _ in range(i % 5)]) for i in range(40)] + [(None, None, None), ("é", "same", ["same", "x"])]
    df = spark.createDataFrame(given, "qid string, answer string, wrong array<string>")
    df = df.withColumn("options", choices.shuffled_options(F.col("qid"), F.col("answer"), F.col("wrong")))
    got = df.select("*", choices.correct_letter(F.col("options"), F.col("answer")).alias("letter"), choices.option_lines(F.col("options")).alias("lines")).collect()
    for (qid, answer, wrong), r in zip(given, got, strict=True):
        seed = int.from_bytes(hashlib.sha256((qid or "").encode()).digest(), "big")
        want = sorted([answer or "", *(wrong or [])], key=lambda o: int(hashlib.sha256(b"%d:" % seed + o.encode()).hexdigest(), 16))
        at = want.index(answer or "")
        assert r["options"] == want and r["letter"] == ("ABCD"[at] if at < 4 else None)
        assert r["lines"].split("\n") == [f"{x}. {o.strip()}" for x, o in zip("ABCD", want)]


def test_typed_answers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    ps = lambda **k: F.create_map(*[y for a, b in k.items() for y in (F.lit(a), F.lit(float(b)))])
    none, lit = F.lit(None).cast("map<string,double>"), F.lit
    assert one(choices.chosen(lit("choice"), lit("a"), ps(a=0, b=1), F.array(lit("a"), lit("b")))) == "a"
    assert one(choices.chosen(lit("choice"), lit("a"), none)) == "a" and one(choices.probability(lit("noul"), lit(0.25))) == 0.25
    for bad in (choices.chosen(lit("score"), lit("a"), none), choices.chosen(lit("choice"), lit(""), none), choices.chosen(lit("choice"), lit("a"), ps(a=0)), choices.chosen(lit("choice"), lit("a"), ps(a=2)),
                choices.chosen(lit("choice"), lit("c"), none, F.array(lit("a"))), choices.chosen(lit("choice"), lit("a"), ps(z=1), F.array(lit("a"))), choices.probability(lit("noul"), lit(1.5)), choices.probability(lit("noul"), lit(float("nan"))), choices.probability(lit("x"), lit(0.1))):
        with pytest.raises(Exception, match="USER_RAISED_EXCEPTION|answer|choice|option|probabilit"):
            one(bad)
    df = spark.createDataFrame([('["a", "b"]',), ("[]",), ("{}",), ("[1, 2]",), ("[oops",), (None,)], "v string")
    assert [r["x"] for r in df.select(choices.wrong_answers(F.col("v")).alias("x")).collect()] == [["a", "b"], [], [], ["1", "2"], [], []]


def test_verdicts(spark):
    given = [(1, "4", ["four"], "it is 4", None), (2, "4", [], "", True), (3, "4", [], "Not mentioned", True), (4, "4", [], "five", True), (5, "4", [], "five", False), (6, "4", [], "five", None), (7, "4", None, None, None), (8, "not stated", [], "unknown", None)]
    df = spark.createDataFrame(given, "qid int, gold string, aliases array<string>, answer string, judge boolean")
    got = conditions.verdicts(df, "gold", "aliases", "answer", F.col("judge"))
    assert [(r["qid"], r["verdict"], r["tier"]) for r in got.orderBy("qid").collect()] == [(1, "pass", 1), (2, "fail", 1), (3, "fail", 1), (4, "pass", 2), (5, "fail", 2), (6, "indeterminate", 1), (7, "fail", 1), (8, "pass", 1)]
    assert tuple(conditions.summary(got).first()) == (3, 4, 1, 8, 0.375)
    lacking = got.select(F.lit("c").alias("cell"), "qid", F.lit("P").alias("arm"), "verdict")
    with pytest.raises(Exception, match="no answer"):
        conditions.paired_cells(lacking, "cell", "qid", "arm", "P", "A").collect()


@pytest.mark.parametrize("budget", [30, 60, 61, 90, 200, 2000])
def test_prompt_window(spark, budget):
    """Against adding units one by one, newest first, and measuring the whole prompt each time."""
    rnd = random.Random(budget)
    units = {c: ["u" * rnd.randrange(1, 90) for _ in range(c)] for c in (1, 2, 9)}
    pinned = {(9, 0)}
    rows = [(c, i, u, (c, i) in pinned) for c, us in units.items() for i, u in enumerate(us)]
    df = spark.createDataFrame(rows, "g int, i int, u string, p boolean")
    for block in (None, "BLOCK"):
        tokens = lambda n: F.floor(n / 4).cast("bigint")
        out = context.prompt_window(df.where("g < 9 OR NOT p OR u <> ''"), "g", "i", "u", F.lit(40), F.lit(block).cast("string"), budget, tokens, F.col("p"))
        want = {}
        for c, us in units.items():
            size = lambda kept: (40 + len("\n\n".join(([block] if block else []) + [us[j] for j in sorted(kept)]))) // 4  # noqa: E731, B023
            kept = [i for i in range(len(us)) if (c, i) in pinned]
            for i in sorted(set(range(len(us))) - set(kept), reverse=True):
                if size([*kept, i]) > budget:
                    break
                kept.append(i)
            want[c] = (size(kept), sum((c, i) not in pinned for i in kept), min((i for i in kept if (c, i) not in pinned), default=None))
        if any(n > budget for n, *_ in want.values()):
            with pytest.raises(Exception, match="exceeds the budget"):
                out.collect()
            continue
        assert {r["g"]: (r["window_tokens"], r["n_recent"], r["first_recent"]) for r in out.collect()} == want


def test_run_names():
    assert runs.of_run("data/calls.jsonl", "r1") == "data/calls.r1.jsonl" and len(runs.new_run_id()) == 23
    assert runs.cell_name("cd", 0.0, "pn") == "cd__w0" and runs.cell_name("cd", 0.1, "pn+rn", 0.5) == "cd__w0.1__pn-rn__pf0.5"
    assert runs.weight_grid("0.2,0, 0.05,0.2") == [0.0, 0.05, 0.2]
    for bad in ("", "-1,2"):
        with pytest.raises(ValueError):
            runs.weight_grid(bad)


def test_checkpoint_goes_on(spark, tmp_path):
    path = str(tmp_path / "run")
    header = {"arm": "cd", "w": 0.1, "inject": "pn", "corpus_sha256": "c", "questions_sha256": "q"}
    questions = spark.createDataFrame([(f"q{i}",) for i in range(4)], "qid string")
    with pytest.raises(ValueError, match="no header"):
        runs.start_checkpoint(spark, path, header, resume=True)
    runs.start_checkpoint(spark, path, header)
    assert runs.still_open(questions, path).count() == 4
    runs.append_answers(spark.createDataFrame([("q1", "a"), ("q2", "b")], "qid string, answer string"), path)
    runs.append_answers(spark.createDataFrame([("q2", "b2")], "qid string, answer string"), path)
    with pytest.raises(ValueError, match="already"):
        runs.start_checkpoint(spark, path, header)
    with pytest.raises(ValueError, match="corpus_sha256"):
        runs.start_checkpoint(spark, path, {**header, "corpus_sha256": "d"}, resume=True)
    runs.start_checkpoint(spark, path, header, resume=True)
    assert sorted(map(tuple, runs.answers_of(spark, path).collect())) == [("q1", "a"), ("q2", "b2")]
    assert sorted(r["qid"] for r in runs.still_open(questions, path).collect()) == ["q0", "q3"]


def test_trees_are_kept(spark, tmp_path):
    node = lambda i: {"node_id": f"n{i}", "text": f"t{i}", "created_turn": i}
    tree = {"suns": [{"sun": node(0), "planets": [{"planet": node(1), "satellites": [node(2), node(3)]}, {"planet": node(4), "satellites": []}]}, {"sun": node(5), "planets": []}]}
    given = spark.createDataFrame([(7, json.dumps(tree)), (8, json.dumps({"suns": []})), (9, None)], "c bigint, t string")
    records = runs.tree_records(given, "c", "t")
    want = [(7, "n0", None, 0, "t0", 0, 0), (7, "n1", "n0", 1, "t1", 1, 0), (7, "n2", "n1", 2, "t2", 2, 0), (7, "n3", "n1", 2, "t3", 3, 1), (7, "n4", "n0", 1, "t4", 4, 1), (7, "n5", None, 0, "t5", 5, 1)]
    assert sorted(map(tuple, records.collect()), key=lambda r: r[1]) == want
    runs.save_trees(records.limit(0), str(tmp_path / "t"), 1)
    runs.save_trees(records, str(tmp_path / "t"), 2)
    kept, n = runs.load_trees(spark, str(tmp_path / "t"))
    assert n == 2 and sorted(map(tuple, kept.collect()), key=lambda r: r[1]) == want
