"""Golden behaviours that the driver tables cannot show."""

import random
import json

import pytest
from pyspark.sql import functions as F

from rondelle.functions import numeric as N
from rondelle.functions import text as T
from rondelle.operators import chunking, dialogue, energy, matching, merging, scoring, tree
from rondelle.sources import files


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_round_trips(spark):
    m = [(1, 0, "user", "a"), (1, 1, "system", "s"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (1, 4, "user", "d"), (1, 5, "assistant", "e"), (1, 6, "assistant", "f"), (1, 7, "user", "g"), (1, 8, "tool", None)]
    got = [tuple(r)[2:] for r in dialogue.round_trips(spark.createDataFrame(m, "conv_id bigint, turn bigint, role string, text string")).orderBy("round_trip").collect()]
    assert got == [("s", ""), ("a", "b"), ("c", ""), ("d", "e"), ("", "f"), ("", ""), ("g", "")]


@pytest.mark.parametrize("text, want", [
    ("Dr. Smith came. He left!", ["Dr. Smith came.", "He left!"]), ("Use e.g. this one. Pi is 3.5. Ok", ["Use e.g. this one.", "Pi is 3.5.", "Ok"]),
    ("すごい！？本当。はい", ["すごい！？", "本当。", "はい"]), ("It rained, but we went; however it stopped.", ["It rained,", "but we went;", "however it stopped."]),
    ("晴れ、しかし、寒い", ["晴れ、", "しかし、寒い"]), ("butter, butter", ["butter, butter"]), ("", []), (" \n ", []),
])
def test_split_units(spark, text, want):
    assert one(spark, T.split_units(F.col("t")), t=text) == want


def test_candidates(spark):
    df = spark.createDataFrame([("Yes. " + "word " * 30 + ". End.",), (None,), ("",)], "t string")
    got = [r["chunks"] for r in chunking.candidates(df, "t", 60).collect()]
    assert all(len(c) <= 60 for c in got[0]) and got[0][:2] == ["Yes.", ("word " * 12).strip()[:59]] and got[1:] == [[], []]
    assert chunking.join_candidates(["短い。", "次の文です。"], 50) == ["短い。次の文です。"] and chunking.hard_split("a" * 25, 10) == ["a" * 10, "a" * 10, "a" * 5]
    assert one(spark, chunking.glue_short(chunking.meaning_units(F.col("t"), 200)), t="はじめに話す長い文章です、また、短い") == ["はじめに話す長い文章です、また、短い"]
    assert one(spark, chunking.drop_contained(F.split("t", ",")), t="abc,abcd,xy,x") == ["abcd", "xy"]


@pytest.mark.parametrize("reply, want", [("Yes.", True), ("1. Answer: no", False), ("yes / no", None), ("", None), ("They are not the same", False), ("maybe", None), ("\n\n- TRUE", True)])
def test_yes_no(spark, reply, want):
    assert one(spark, T.yes_no(F.col("t")), t=reply) is want


@pytest.mark.parametrize("text, want", [("What is it", True), ("candle light", False), ("can't do", False), ("Tell me more", True), ("It is so.", False), ("give one word", True), ("x" * 400 + "?", False), ("", False)])
def test_query_turn(spark, text, want):
    assert one(spark, T.is_query_turn_en(F.col("t")), t=text) is want


@pytest.mark.parametrize("gold, aliases, answer, passed, alias", [
    ("4", [], "It was 14.", False, None), ("4", [], "It was 4.5", False, None), ("4", [], "four days", True, None), ("four days", [], "in 4 days!", True, None),
    ("x", ["Red & Blue"], "blue and red ones", True, "Red & Blue"), ("No", [], "unknown", False, None), ("not stated", [], "Not mentioned", True, None), ("Café–Bar", [], "the CAFÉ-BAR [PN2.0] here", True, None), ("", [""], "any", False, None), ("a", [], "", False, None),
])
def test_tier1(spark, gold, aliases, answer, passed, alias):
    df = spark.createDataFrame([(gold, aliases, answer)], "g string, a array<string>, t string")
    r = scoring.tier1(df, "g", "a", "t").first()
    assert (r["passed"], r["matched_alias"]) == (passed, alias)


def tree_of(merged):
    return [(t["text"], [(s["text"], [d["text"] for d in s["details"]]) for s in t["subs"]]) for t in merged]


def test_merge_cases():
    same = merging.equal
    starts = lambda text, cands: next((i for i, c in enumerate(cands) if c[0] == text[0]), None)
    f = lambda t, s, d, c=0: {"created": c, "topic": t, "sub_topic": s, "detail": d}
    base = []
    assert merging.add_facts(base, [f("T", "s", "d"), f("T", "s", "d"), f("T", "s", "e"), f("T", "u", None), f("V", None, None)]) == 0
    assert tree_of(base) == [("T", [("s", ["d", "e"]), ("u", [])]), ("V", [])]
    assert merging.add_facts(base, [f(None, "s", "x"), f(None, "Tx", "y"), f(None, "new", "z")], same, starts) == 1
    assert tree_of(base) == [("T", [("s", ["d", "e", "x"]), ("u", []), ("Tx", ["y"])]), ("V", []), ("new", [("z", [])])]
    assert merging.add_facts(base, [f(None, None, "d"), f(None, None, "u2"), f(None, None, "Vx"), f(None, None, "q")], same, starts) == 1
    assert tree_of(base)[0][1][1] == ("u", ["u2"]) and tree_of(base)[1] == ("V", [("Vx", [])]) and tree_of(base)[3] == ("q", [])
    with pytest.raises(merging.Full):
        merging.add_facts([], [f("a", None, None), f("b", None, None)], capacity=(1, 1, 1))
    near = merging.first_best(lambda a, b: {"ab": 0.95, "ac": 0.95}.get(a + b, 0.0), 0.92)
    assert near("a", ["x", "b", "c"]) == 1 and near("a", ["x"]) is None and near("a", []) is None


def test_masses_and_records(spark):
    rows = [(1, "t", None, 0, "T", 0, 0), (1, "s", "t", 1, "S", 0, 1), (1, "d", "s", 2, "D", 0, 2), (1, "e", "s", 2, "E", 0, 3), (1, "u", "t", 1, "U", 0, 4), (1, "v", None, 0, "V", 1, 5), (1, "lost", "none", 2, "L", 0, 6), (1, "wrong", "t", 2, "W", 0, 7)]
    nodes = tree.with_ancestors(spark.createDataFrame(rows, "conv_id bigint, node_id string, parent_id string, level int, text string, created bigint, seq bigint"))
    mass = lambda floor: {r["text"]: r["mass"] for r in tree.with_mass(nodes, floor).collect()}
    assert mass(1.0) == {"T": 3.0, "S": 2.0, "D": 0.1, "E": 0.1, "U": 1.0, "V": 1.0} and mass(0.0)["U"] == 0.0
    placed = tree.with_coordinates(tree.with_mass(nodes))
    block = tree.render(placed).first()["block"]
    assert block == "<CONTEXT>\n[PN3.0] T\n  [PN2.0] S\n    [PN0.1] D\n    [PN0.1] E\n  [PN1.0] U\n[PN1.0] V\n</CONTEXT>"
    assert json.loads(tree.to_json(placed).first()["tree"])[0]["subs"][0]["details"] == ["D", "E"]
    whole = tree.budgeted(placed, 10_000, "recency").first()
    assert whole["block"] == block and whole["kept"] == 6
    less = tree.budgeted(placed, 45, "mass").first()["block"]
    assert less == "<CONTEXT>\n[PN3.0] T\n  [PN2.0] S\n</CONTEXT>" and len(less) <= 45


def test_budget_rules():
    rows = [{"node_id": "a", "parent_id": None, "mass": 1.0, "created": 0, "line": "a" * 10}, {"node_id": "b", "parent_id": "a", "mass": 9.0, "created": 5, "line": "b" * 50}, {"node_id": "c", "parent_id": None, "mass": 0.5, "created": 1, "line": "c"}]
    wrapper = len("<CONTEXT>\n</CONTEXT>")
    assert tree.choose(rows, wrapper, "mass", len) == [False] * 3
    assert tree.choose(rows, wrapper + 20, "mass", len) == [True, False, True]  # a misfit is passed over
    assert tree.choose(rows, 999, "random", len, 3) == [True] * 3
    for bad in ((wrapper - 1, "mass"), (99, "best")):
        with pytest.raises(ValueError):
            tree.choose(rows, *bad, len)


def test_energy(spark):
    s = spark.sql("SELECT 1L AS g, timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, t) AS ts, CAST(w AS DOUBLE) AS w FROM VALUES (0, 10), (10, 30), (20, 30) AS v(t, w)")
    t0 = s.select(energy.seconds("min(ts)").alias("t")).first()["t"]
    spans = spark.createDataFrame([(1, 0, t0 + 5, t0 + 15), (1, 1, t0, t0 + 20), (1, 2, t0 + 5, t0 + 21), (2, 0, t0, t0 + 1)], "g bigint, span_id int, start double, stop double")
    got = {(r["g"], r["span_id"]): r["joules"] for r in energy.energy_of_spans(s, spans, "g", "ts", "w").collect()}
    assert got == {(1, 0): pytest.approx(275.0), (1, 1): pytest.approx(500.0), (1, 2): None, (2, 0): None}


def test_statistics(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] * 5 + [(0, 1)] * 1 + [(0, 0)] * 2, "a int, b int")
    r = scoring.paired(df, "a", "b").first()
    assert (r["both"], r["only_a"], r["only_b"], r["neither"]) == (3, 5, 1, 2) and r["mcnemar_p"] == pytest.approx(7 / 64, abs=1e-6)
    b = scoring.bootstrap(df.withColumn("g", F.lit("x")), "g", "a", "b", 2000).first()
    assert b["difference"] == pytest.approx(4 / 11) and b["low"] < 4 / 11 < b["high"] and b["ratio_low"] < 2 < b["ratio_high"]
    never = scoring.bootstrap(spark.createDataFrame([("x", 1, 0)] * 3, "g string, a int, b int"), "g", "a", "b", 50).first()
    assert (never["difference"], never["ratio_low"], never["ratio_high"]) == (1.0, None, None)
    assert one(spark, N.attention_flops_decode(F.col("p"), F.col("c")), p=100, c=4) == 16 * 2 * 24 * 256 * (101 + 102 + 103)
    levels = F.create_map(F.lit(2), F.lit(0.4), F.lit(0), F.lit(0.4), F.lit(1), F.lit(0.2))
    assert one(spark, scoring.argmax_level(levels), p=1) == 0


def test_best_match(spark):
    q = spark.createDataFrame([("k", 1, [1.0, 0.0]), ("none", 2, [1.0, 0.0])], "k string, query_id bigint, vector array<double>")
    c = spark.createDataFrame([("k", 7, 1, [1.0, 0.0]), ("k", 8, 0, [1.0, 0.0]), ("k", 9, 2, [0.0, 1.0])], "k string, candidate_id bigint, ord bigint, vector array<double>")
    got = {r["query_id"]: tuple(r)[1:] for r in matching.best_match(q, c, "k").collect()}
    assert got == {1: (8, 1.0, True), 2: (None, 0.0, False)}


def test_sources(spark, tmp_path):
    def put(name, content):
        (tmp_path / name).write_text(content, encoding="utf-8")
        return str(tmp_path / name)

    chat = put("chat.json", json.dumps({"chat_id": "c", "sessions": [{"n": 1, "date": "d", "turns": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}]}))
    assert [tuple(r)[1:] for r in files.read_chat(spark, chat).collect()] == [(1, "d", 0, "user", "hi"), (1, "d", 1, "assistant", "yo")]
    for shape in ([{"speaker": "User", "msg": "a"}, {"role": "x"}], {"turns": [{"role": "USER", "body": "a"}]}):
        assert [tuple(r)[1:] for r in files.read_turns(spark, put("t.json", json.dumps(shape))).collect()] == [("user", "a")]
    session = put("s.json", json.dumps({"round_trips": [{"idx": 3, "human": "h", "events": [{"kind": "text", "text": "e"}]}, {"idx": 4, "human": "i", "events": []}]}))
    kept = files.read_agent_session(spark, session, [4])
    assert [tuple(r) for r in files.round_trip_texts(kept).collect()] == [(3, "h", "[text]\ne", "h\ne")]
    for bad in ([9], [3, 4]):
        with pytest.raises(ValueError):
            files.read_agent_session(spark, session, bad)
    assert files.parse_exclusions("36,10") == [10, 36] and files.parse_exclusions("none") == []
    answers = put("run1.txt", "A1: x\nnoise\nA2- y\nA1: z\n")
    assert {tuple(r) for r in files.read_answer_lines(spark, answers).collect()} == {("run1", 1, "z"), ("run1", 2, "y")}
    assert files.read_answer_lines(spark, answers, 1).count() == 1
    assert files.read_answer_map(spark, put("m.json", '{"q1": "a"}')).first()["answer"] == "a"
    ck = put("ck.jsonl", '{"kind":"header"}\n\n{"kind":"answer","qid":"q","answer":"1"}\n{"kind":"answer","qid":"q","answer":"2"}\n')
    assert [tuple(r) for r in files.read_checkpoint(spark, ck).collect()] == [("q", "2")]
    qs = put("q.json", json.dumps([{"qid": "a", "legacy": True}, {"qid": "b", "excluded": True}, {"qid": "c"}]))
    assert [r["qid"] for r in files.read_questions(spark, qs).collect()] == ["a", "c"] and files.read_questions(spark, qs, "legacy").count() == 1
    power = put("p.csv", "timestamp, a, b, c, power\n2026/01/02 03:04:05.678, 1 %, 2 %, 3 MiB, 55.5 W\nshort\n2026/01/02 03:04:06.678, 1, 2, 3, [N/A]\n")
    assert [(str(r["ts"]), r["watts"]) for r in files.read_power(spark, power).collect()] == [("2026-01-02 03:04:05.678000", 55.5)]
    calls = files.call_totals(files.read_calls(spark, put("c.jsonl", '{"prompt_tokens": 10}\n{"prompt_tokens": null}\n')), 2.0).first()
    assert (calls["requests"], calls["prompt_tokens"], calls["completion_tokens"]) == (2, 10, 0)
    assert one(spark, files.arm_fields(F.col("t")), t="cd_mass_6x").asDict() == {"kind": "cd", "policy": "mass", "ratio": 6.0} and one(spark, files.arm_fields(F.col("t")), t="cd_6x") is None
    assert one(spark, files.cell_fields(F.col("t")), t="v5__w0.1__planets__pf1.0")["w"] == 0.1
    assert files.manifest(spark, str(tmp_path)).where("path LIKE '%run1.txt'").first()["bytes"] == 24


def test_stream_keeps_trees(spark, tmp_path):
    from rondelle.streaming.state import update_trees

    kind = "conv_id bigint, created bigint, seq bigint, topic string, sub_topic string, detail string"
    out = []
    source, check = tmp_path / "in", tmp_path / "ck"
    for i, rows in enumerate(([(1, 0, 0, "T", "s", "d"), (2, 0, 0, "X", None, None)], [(1, 1, 0, "T", "s", "d"), (1, 1, 1, "T", "s", "e")])):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(source))
        q = update_trees(spark.readStream.schema(kind).parquet(str(source))).writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
        q.awaitTermination()
    last = {r["conv_id"]: r for r in out}
    assert (last[1]["round_trips"], last[1]["nodes"], last[2]["nodes"]) == (2, 4, 1)
    assert tree_of(json.loads(last[1]["tree"])) == [("T", [("s", ["d", "e"])])]


def test_extraction(spark):
    from rondelle.operators import extraction

    df = spark.createDataFrame([(1, "The Red Fox met Anna Lee on 2024-05-01 in Oslo. It was a very long and quiet evening. It ended."), (2, None), (3, " \n")], "id bigint, t string")
    rows = lambda d, **k: [tuple(r)[2:] for r in extraction.fact_sentences(d, "t", **k).orderBy("id", "seq").collect()]
    fact = "The Red Fox met Anna Lee on 2024-05-01 in Oslo."
    # "The Red Fox" begins with a stopped word, so its words stand alone
    assert rows(df) == [("entity", "Red", ""), ("fact", fact, "Red")]
    assert rows(df, most_entities=9) == [("entity", "Red", ""), ("entity", "Fox", ""), ("entity", "Anna Lee", ""), ("entity", "Oslo", ""), ("fact", fact, "Red")]
    assert rows(df, stop=["It"], most_entities=2, root="Talk") == [("root", "Talk", ""), ("entity", "The Red Fox", "Talk"), ("entity", "Anna Lee", "Talk"), ("fact", fact, "The Red Fox")]
    said = "Bob Ray saw the sea again. Bob Ray saw the sea again. We all went there last Tuesday! Ann Poe came on the 3rd of may. " + "Bob Ray x" + "y" * 160 + ". Bob Ray"
    again = spark.createDataFrame([(1, said)], "id bigint, t string")
    # a sentence counts once, a name that comes again gives its words, a fact is cut, a date alone is enough
    assert rows(again, most_entities=3, most_facts=9) == [("entity", "Bob Ray", ""), ("entity", "Bob", ""), ("entity", "Ray", ""), ("fact", "Bob Ray saw the sea again.", "Bob Ray"), ("fact", "We all went there last Tuesday!", "Bob Ray"), ("fact", ("Bob Ray x" + "y" * 160)[:160], "Bob Ray")]
    assert rows(again, need_date=True, most_facts=9)[1:] == [("fact", "We all went there last Tuesday!", "Bob Ray")]
    assert rows(spark.createDataFrame([(1, "it was all over by 1999, they say")], "id bigint, t string")) == [("fact", "it was all over by 1999, they say", "")]
    codes = spark.createDataFrame([(1, "Ada uses AB-12 and Bob AB-13; " + "x" * 90 + " ZZ-9")], "id bigint, t string")
    assert [tuple(r) for r in extraction.code_names(codes, "t").collect()] == [(1, "AB-12", "Ada"), (1, "AB-13", "Bob")]
    assert extraction.first_json_object('say {"a": "}{", "b": {"c": 1}} x') == '{"a": "}{", "b": {"c": 1}}' and extraction.first_json_object('{"a"') is None
    assert extraction.node_object('ok {"summary": " s ", "detail": 7, "scores": {"comprehensive": "200", "independent": 3.9, "detail": 1}}') == ("s", {"comprehensive": 100, "independent": 3, "detail": 7})
    assert extraction.node_object('{"summary": "s"}') is None and extraction.node_object(None) is None and extraction.coerce_score(True) is None
    assert one(spark, extraction.salvage_strings(F.col("t")), t='["a", "b \\"q\\"", "cut') == ["a", 'b "q"']


def test_markers(spark):
    from rondelle.functions import markers

    block = "<CONTEXT>\n[SN] T\n    [RN] x\n  [PN2.0] S\n    [RN] d\n[SN] U\n    [RN] e\n</CONTEXT>"
    lines = markers.block_lines(spark.createDataFrame([(1, block)], "g bigint, block string"))
    carried = lambda reset: [r["carried"] for r in markers.inherited_mass(lines, "g", reset).orderBy("pos").collect()]
    assert carried(True) == [None, None, 2.0, 2.0, None, None] and carried(False) == [None, None, 2.0, 2.0, None, 2.0]
    p = spark.createDataFrame([(1, 0, 4.0, 3), (1, 0, 1.0, 3), (1, 7, 1.0, 3), (1, 2, 0.5, 3)], "g bigint, pos int, mass double, n int")
    assert markers.mass_vector(p, "g", "pos", "mass", "n", 3.0).first()["vector"] == [3.0, 0.0, 0.5]
    assert one(spark, markers.largest_sub_mass(F.col("t")), t=block) == 2.0
    assert one(spark, markers.causal_row(F.lit(0), F.lit(2), F.lit(3)), t="x") == [True, True, False]
    assert sum(one(spark, markers.softmax(F.array(F.lit(1.0), F.lit(2.0))), t="x")) == pytest.approx(1.0)


def test_token_spans(spark):
    from rondelle.functions import spans

    kind = "g bigint, pieces array<string>"
    pieces = [
        ["<C>\n", "[PN", "2.0] AAA", " x", "\n", "  [PN1.5", "]", " beta\n", "    [PN0.1] ", "q", " y [PN", "3.0]z\n  "],  # fused with the marker, with the line break, with the next marker
        ["[PN1.0] a [PN2.0]b", "[PN3.0]\n", " c"],  # two markers in one token, an empty concept
        [], None, ["no marker", None],
    ]
    df = spark.createDataFrame(list(enumerate(pieces)), kind)
    got = [tuple(r) for r in spans.token_spans(df).orderBy("g", "span").collect()]
    assert got == [(0, 0, 0, 2.0, [2, 3]), (0, 1, 1, 1.5, [7]), (0, 2, 2, 0.1, [9]), (0, 3, 2, 3.0, [11]), (1, 0, 0, 1.0, [0]), (1, 1, 0, 2.0, [0]), (1, 2, 0, 3.0, [])]
    marked = spark.createDataFrame([(1, ["[SN]", " t\n", "  [PN2.0] ", "s", "\n    [RN]", " d", "\n[SN] u\n    [RN] e"])], kind)
    s = spans.token_spans(marked, level_markers=True)
    assert [tuple(r)[1:] for r in s.orderBy("span").collect()] == [(0, 0, 0.0, [1]), (1, 1, 2.0, [3]), (2, 2, 0.0, [5]), (3, 0, 0.0, [6]), (4, 2, 0.0, [6])]
    rows = lambda d: sorted(tuple(r)[1:] for r in d.collect())
    assert rows(spans.weighted_positions(s, "g")) == [(3, 2.0)] and rows(spans.weighted_positions(s, "g", inherit=True)) == [(3, 2.0), (5, 2.0)]
    assert rows(spans.weighted_positions(s, "g", [0, 2])) == []
    assert [r["position"] for r in spans.positions(s, [1, 2]).orderBy("position").collect()] == [3, 5, 6]
    levels = spark.createDataFrame([(1, i, v) for i, v in enumerate([0, 1, 2, 0, 2])], "g bigint, span int, level int")
    assert spans.with_levels(s, levels, "g").where("level = 2").count() == 2
    with pytest.raises(Exception, match="differ in number"):
        spans.with_levels(s, levels.where("span < 4"), "g").collect()


def test_judged_matches_and_links(spark):
    from rondelle.operators import matching, tree

    q = spark.createDataFrame([("a", 1, "x", [1.0, 0.0]), ("a", 2, "none", [1.0, 0.0]), ("z", 3, "x", [1.0, 0.0]), (None, 4, "x", [1.0, 0.0])], "k string, query_id int, text string, vector array<double>")
    c = spark.createDataFrame([("a", 10, 0, "yx", [0.1, 0.0]), ("a", 11, 1, "n", [0.9, 0.0]), ("a", 12, 2, "xx", [0.9, 0.0]), ("a", 13, 3, None, [0.5, 0.0])], "k string, candidate_id int, ord int, text string, vector array<double>")
    ask = lambda a, b: F.contains(b, a)
    got = lambda k: sorted(tuple(r) for r in matching.judged_match(q, c, "k", ask, k).collect())
    alone = [(3, None, 0.0), (4, None, 0.0)]
    assert got(2) == [(1, 12, 1.0), (2, 11, 0.0), *alone] and got(0) == [(1, 10, 1.0), (2, 10, 0.0), *alone]
    assert got(1) == [(1, 11, 0.0), (2, 11, 0.0), *alone]  # a yes beyond the shortlist is not asked for
    assert matching.judged_match(q.limit(0), c, "k", ask).count() == 0
    n = spark.createDataFrame([(1, "t0", 0, 0, "sea"), (1, "t1", 1, 0, "sea and sun"), (1, "s0", 2, 1, "sun"), (1, "s1", 3, 1, "ice"), (1, "d0", 4, 2, "su"), (1, "d1", 5, 2, None), (2, "s2", 0, 1, "sea")], "turn int, node_id string, seq int, level int, text string")
    links = {r["node_id"]: r["parent_id"] for r in matching.link_within_turn(n, ["turn"], lambda child, parent: F.contains(parent, child)).collect()}
    assert links == {"t0": None, "t1": None, "s0": "t1", "s1": None, "d0": "s0", "d1": None, "s2": None}
    read = lambda t: tree.from_json(spark.createDataFrame([(1, t)], "conv_id bigint, tree string")).collect()
    assert read(None) == [] and read("[]") == [] and [r["level"] for r in read('[{"text": "a", "mass": 1.0, "subs": [{"text": "b", "mass": 2.0, "details": ["c"]}]}]')] == [0, 1, 2]
    with pytest.raises(Exception, match="(?i)malformed"):
        read("[{")


def test_guards(spark):
    from rondelle.operators import guards
    from rondelle.sources import runs

    def fails(df, why):
        with pytest.raises(Exception, match=why):
            df.collect()

    kind = "path string, n_nodes int, session_sha256 string, turns int, stopped string"
    good, part, empty, other = ("a", 3, "s", 9, None), ("b", 3, "s", 5, "turn 5"), ("c", 0, "s", 9, None), ("d", 3, None, 9, None)
    trees = lambda *rows: spark.createDataFrame(list(rows), kind)
    assert guards.tree_artifact(trees(good), "s", 9).count() == 1 and guards.tree_artifact(trees(good, part), "s", 9, True).count() == 2
    for row, why in ((part, "b: partial, stopped at turn 5"), (empty, "c: no nodes"), (other, "another session, null"), (("e", 3, "s", 5, None), "covers 5 round trips of 9")):
        fails(guards.tree_artifact(trees(row), "s", 9), why)
    c = spark.createDataFrame([("a", "q", "m", 5)], "path string, budget_question string, model_id string, W int")
    assert guards.compaction_artifact(c, {"model_id": "m", "W": 5}).count() == 1
    fails(guards.compaction_artifact(c, {"model_id": "n"}), "model_id is m, here n")
    fails(guards.compaction_artifact(c.withColumn("budget_question", F.lit(None).cast("string")), {"W": 5}), "no budget question")
    fails(guards.compaction_window(spark.createDataFrame([(2, [1, 2, 3])], "n_recent int, recent array<int>")), "keeps 2 round trips, the compaction 3")
    asked = lambda **k: spark.createDataFrame([{"qid": "q1", "arm": "proposed", "w": 0.5, "inject": "prefill", "window": 10, "planet_lines": 2, "prompt_tokens": 9, "planet_spans": 2} | k], "qid string, arm string, w double, inject string, window int, planet_lines int, prompt_tokens int, planet_spans int")
    assert guards.answered(asked()).count() == guards.answered(asked(window=None, prompt_tokens=99)).count() == guards.answered(asked(inject="none", planet_spans=0)).count() == 1
    fails(guards.answered(asked(prompt_tokens=11)), "q1: 11 tokens in a window of 10")
    fails(guards.answered(asked(planet_spans=1)), "1 spans of 2 lines")
    fails(guards.answered(asked(planet_spans=0, planet_lines=0)), "nothing to inject into")
    row = spark.createDataFrame([("q", 4, 3, 6, 2, None, None)], "qid string, completion_tokens int, decode_forwards int, applied int, skipped_prefill int, skipped_sliding int, applied_last_row int")
    want = runs.bias_counters(F.lit(2), F.col("completion_tokens"), F.lit(1), F.lit(0.0), F.lit(False))
    assert guards.counters(row, want).count() == 1
    fails(guards.counters(row.withColumn("applied", F.lit(5)), want), "q: applied is 5, expected 6")
    fails(guards.counters(row.withColumn("decode_forwards", F.lit(4)), want), "4 decode forwards, expected 3")
    fails(guards.cells(spark.createDataFrame([("old", 0.1)], "arm string, w double"), ["old"]), "arm old is text alone")
    f = spark.createDataFrame([("f1", 3, [1, 7]), ("f2", 7, None), ("f3", 2, [])], "id string, rt int, history array<int>")
    assert [(r["id"], r["places"]) for r in guards.outside_corpus(f, [7, 3]).orderBy("id").collect()] == [("f1", [3, 7]), ("f2", [7])]
    assert guards.leaks(spark.createDataFrame([("a [PN2] b",), ("</CONTEXT>",), ("x mass=2",), ("[PN]",), (None,)], "t string"), "t").count() == 3


def test_replies_and_masks(spark):
    from rondelle.functions import markers
    from rondelle.functions import text as T

    for raw, want in (("assistantanalysis hm assistantfinal 42 ", "42"), ("<|channel|>final<|message|>yes\nno<|return|>x", "yes\nno"), ("plain ", "plain"), ("analysis only", "analysis only"), ("assistantfinal a assistantanalysis b", "a"), ("", "")):
        assert one(spark, T.final_channel(F.col("t")), t=raw) == want
    for raw, want in ((" ] sea  wall\n", "sea wall"), ("[PN2.0] a", "a"), ("[SN]", ""), ("a]", "a]")):
        assert one(spark, T.concept_key(F.col("t")), t=raw) == want
    bias, mask = F.array(F.lit(1.0), F.lit(-1.0)), F.array(F.lit(True), F.lit(False))
    assert one(spark, markers.combined_mask(bias), t="") == [1.0, -1.0]
    assert one(spark, markers.combined_mask(bias, allowed=mask), t="") == [1.0, markers.LOWEST]
    assert one(spark, markers.combined_mask(bias, added=F.array(F.lit(0.5), F.lit(2.0))), t="") == [1.5, 1.0]
    with pytest.raises(Exception, match="differ in length: 2 and 1"):
        one(spark, markers.combined_mask(bias, added=F.array(F.lit(0.5))), t="")


def test_budget_choice_against_passes():
    import random

    def passes(rows, budget, policy):
        """Sort all open rows anew for every row that is kept."""
        spent, kept = len("<CONTEXT>\n</CONTEXT>"), set()
        while True:
            names = {rows[i]["node_id"] for i in kept}
            rest = [i for i, r in enumerate(rows) if i not in kept and (r["parent_id"] is None or r["parent_id"] in names)]
            rest.sort(key=lambda i: (-rows[i]["mass"] if policy == "mass" else 0, -rows[i]["created"], i))
            fit = [i for i in rest if spent + 1 + len(rows[i]["line"]) <= budget]
            if not fit:
                return [i in kept for i in range(len(rows))]
            kept.add(fit[0])
            spent += 1 + len(rows[fit[0]]["line"])

    rng = random.Random(5)
    for _ in range(200):
        rows = [{"node_id": i, "parent_id": None if i < 2 else rng.choice([None, rng.randrange(i)]), "mass": rng.randrange(4), "created": rng.randrange(4), "line": "x" * rng.randrange(1, 30)} for i in range(25)]
        for policy in ("mass", "recency"):
            budget = rng.randrange(25, 300)
            assert tree.choose(rows, budget, policy, len) == passes(rows, budget, policy)


def test_compaction_and_plans(spark):
    from rondelle.operators import planning

    texts = ["a" * 30, "b" * 30, "c" * 30, "d" * 200, "e" * 20]
    summary, recent, folds = planning.fold_history([len(t) for t in texts], texts, 100)
    assert (summary, recent, folds) == ("a" * 25, [4], 2) and len(summary) <= 25
    assert planning.fold_history([], [], 10) == ("", [], 0)
    with pytest.raises(RuntimeError):
        planning.fold_history([50], ["x" * 50], 40, lambda t, n: t)
    units = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "g bigint, n bigint, t string")
    assert tuple(planning.compact(units, "g", "n", "t", 100).first()) == (1, summary, recent, folds)
    brute = max(p * -(-s // 254) + (9 - s - p) * -(-p // 254) for s in range(10) for p in range(10 - s))
    assert one(spark, planning.within_turn_requests(F.col("n")), n=9) == brute
    assert one(spark, planning.ratio_gate(F.col("a"), F.col("b"), 0.5), a=1, b=0) is False


#: Texts that compatibility composition and case folding change: full-width, circled, ligature, half-width kana, combining mark, sharp s, Kelvin sign.
UNSTABLE = ["ＡＢＣ　１２", "① ﬁne", "ｶﾞｷﾞ", "été", "Straße—Weg", "K kelvin", "plain, text!", "", None, "℡ 3.5。", "x　y", "Ⅷ № ½"]


def test_unicode_folding(spark):
    """Normalisers and the dedup key against the Unicode library, and a score that needs it."""
    import re
    import unicodedata

    df = spark.createDataFrame([(i, t) for i, t in enumerate(UNSTABLE)], "i int, t string")
    got = df.select("t", T.normalise(F.col("t")).alias("n"), T.dedup_key(F.col("t")).alias("k")).collect()
    for r in got:
        if r["t"] is None:
            assert r["n"] is None and r["k"] is None
            continue
        want = unicodedata.normalize("NFKC", r["t"].lower())
        for d in T.DASHES:
            want = want.replace(d, "-")
        assert r["n"] == re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", want)).strip()
        folded = unicodedata.normalize("NFKC", r["t"]).casefold()
        assert r["k"] == "".join(c for c in folded if unicodedata.category(c)[0] not in "PZC")
    answers = spark.createDataFrame([("１２", ["x"], "it is 12."), ("q", ["ﬁsh & ｃｈｉｐｓ"], "chips with fish"), ("q", [None, "ＡＢＣＤ"], "abcd")], "g string, a array<string>, t string")
    assert [(r["passed"], r["matched_alias"]) for r in scoring.tier1(answers, "g", "a", "t").collect()] == [(True, None), (True, "ﬁsh & ｃｈｉｐｓ"), (True, "ＡＢＣＤ")]


@pytest.mark.parametrize("reply, want", [
    ("```\nyes\n```", True), ("```json\nno", False), ("``` yes, it is ```", True), ("回答: はい", True), ("はい/いいえ", None), ("同じではない", False), ("異なる", False), ("- 1) Answer: a: y", True),
    ("don't", False), ("they aren't", False), ("N", False), ("Well, no.", False), ("nothing", None), ("yesterday", None), (None, None), (" > True\nno", True), ("• Reply：同じ", True),
])
def test_yes_no_of_judges(spark, reply, want):
    assert one(spark, T.yes_no(F.col("t").cast("string")), t=reply or "") is want


def test_code_names_and_objects(spark):
    from rondelle.operators import extraction

    codes = spark.createDataFrame([(1, "AliceB used XAB-12x then AB-12 AB-12"), (2, "User AB-1"), (3, None), (4, "AB-7 " + "x" * 90 + " Ada AB-7, Bob"), (5, "Ann X-AB-3 AB-3é")], "id bigint, t string")
    assert sorted(map(tuple, extraction.code_names(codes, "t").collect())) == [(1, "AB-12", "AliceB"), (4, "AB-7", "Ada"), (5, "AB-3", "Ann")]
    assert extraction.first_json_object('{"a": "b\\\\"} x') == '{"a": "b\\\\"}'
    assert extraction.first_json_object('say "{ not" then {"a": {"b": 1}} {"c": 2}') == '{"a": {"b": 1}}'
    assert extraction.first_json_object('} {"a": "open') is None and extraction.first_json_object("{}{}") == "{}"


def test_full_trees_fail(spark):
    from rondelle.operators import tree

    rows = [(1, 0, i, f"t{i}", f"s{i}", f"d{i}") for i in range(4)]
    nodes = tree.merge_exact(spark.createDataFrame(rows, "conv_id bigint, created bigint, seq bigint, topic string, sub_topic string, detail string"))
    assert tree.within_capacity(nodes, (4, 1, 1)).count() == 12
    assert sorted(r["text"] for r in tree.with_fit(nodes, (2, 1, 1)).where("NOT fits").collect()) == ["d2", "d3", "s2", "s3", "t2", "t3"]
    with pytest.raises(Exception, match="tree is full"):
        tree.within_capacity(nodes, (2, 1, 1)).collect()


def test_binomial_tail():
    import math

    from rondelle.functions.numeric import binomial_tail

    for n in (0, 1, 2, 7, 60, 301):
        for c in range(n + 1):
            exact = 1.0 if n == 0 else sum(math.comb(n, k) for k in range(c, n + 1)) / 2**n
            assert math.isclose(binomial_tail(c, n), exact, rel_tol=1e-9, abs_tol=1e-15)
    assert 0.49 < binomial_tail(500_000, 1_000_000) < 0.51 and binomial_tail(600_000, 1_000_000) < 1e-100


def test_within_turn_requests(spark, monkeypatch):
    """Against all splits, with small batches too."""
    from rondelle.operators import planning

    up = lambda a, b: -(-a // b)
    for batch, sizes in ((3, range(25)), (254, (0, 1, 253, 254, 255, 300, 600))):
        monkeypatch.setattr(planning, "BATCH", batch)
        got = spark.createDataFrame([(n,) for n in sizes], "n bigint").select("n", planning.within_turn_requests(F.col("n")).alias("x")).collect()
        assert all(r["x"] == max(p * up(s, batch) + (r["n"] - s - p) * up(p, batch) for s in range(r["n"] + 1) for p in range(r["n"] - s + 1)) for r in got)


def test_index_percentiles(spark):
    rnd = random.Random(2)
    rows = [(g, float(rnd.randrange(9))) for g in ("a", "b") for _ in range(37)] + [("c", 5.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: tuple(r)[1:] for r in scoring.index_percentiles(df, "g", "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    for g, values in got.items():
        own = sorted(v for k, v in rows if k == g and v is not None)
        assert values == tuple(own[min(int(len(own) * q), len(own) - 1)] for q in (0.0, 0.5, 0.95, 1.0))
