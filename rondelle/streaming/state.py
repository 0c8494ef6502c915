"""Trees kept per conversation over a stream of facts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.merging import Match, add_facts, equal, flatten
from ..operators.tree import CAPACITY

OUT = "conv_id bigint, round_trips bigint, nodes bigint, promoted bigint, tree string"
STATE = "tree string, round_trips bigint, last bigint"


def update_trees(facts: DataFrame, match: Match = equal, attach: Match = equal, capacity=CAPACITY) -> DataFrame:
    """Fold a stream of facts (conv_id, created, seq, topic, sub_topic, detail) into one tree per conversation.

    State per conversation: its tree, the number of round trips and the last one.
    Each batch's facts are folded in order of (created, seq); a round trip that
    was folded already is not counted again. A row per changed conversation.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, trips, last = state.get if state.exists else ("[]", 0, -1)
        tree = json.loads(text)
        pdf = pd.concat(list(batches)).sort_values(["created", "seq"])
        rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
        for r in rows:
            r["created"] = int(r["created"])
        promoted = add_facts(tree, rows, match, attach, capacity)
        trips += len({r["created"] for r in rows if r["created"] > last})
        last = max([last, *(r["created"] for r in rows)])
        state.update((json.dumps(tree, ensure_ascii=False), trips, last))
        yield pd.DataFrame({"conv_id": [int(key[0])], "round_trips": [trips], "nodes": [len(flatten(tree))], "promoted": [promoted], "tree": [json.dumps(tree, ensure_ascii=False)]})

    return facts.groupBy("conv_id").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
