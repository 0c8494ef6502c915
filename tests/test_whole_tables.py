"""Queries that must judge every row, on tables where a cut would show."""

from rondelle.plans import catalog


def test_growth_sees_late_events(spark, tmp_path):
    rows = [(10 * u + i, u, i, float(v)) for u, values in ((1, [1, 2, 3, 2]), (2, [1, 2, 3, 4]), (3, [2, 2.2, 2.4, 2.6]), (4, [5])) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts bigint, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["user_id"]: (r["grows"], r["enough"]) for r in catalog.queries()["user_growth"](spark, str(tmp_path)).collect()}
    assert got == {1: (False, True), 2: (True, True), 3: (True, False), 4: (True, False)}


def test_mass_of_short_long_and_empty_conversations(spark, tmp_path):
    turns = {1: ["a" * 100], 2: ["a" * 100] * 5, 3: ["", None]}
    rows = [(c, i, "user", t) for c, texts in turns.items() for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: (r["vector"], r["bias"]) for r in catalog.queries()["conversation_mass_vectors"](spark, str(tmp_path)).collect()}
    assert got == {1: ([0.5, 0.0], [0.45, 0.0, 0.0, 0.0]), 2: ([0.5] * 5 + [0.0], [0.45] * 5 + [0.0]), 3: ([0.0] * 3, [0.0] * 4)}
