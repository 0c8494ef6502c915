"""The order-dependent merge of provisional trees, for any similarity.

State is a plain nested list, small per conversation; see streaming/state.py
for the same fold as a streaming operator.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from .tree import CAPACITY

#: A tree: topics, each {"text", "created", "subs": [{"text", "created", "details": [{"text", "created"}]}]}.
Tree = list
Match = Callable[[str, list[str]], int | None]


class Full(ValueError):
    """A level has reached its capacity."""


def equal(text: str, candidates: list[str]) -> int | None:
    return candidates.index(text) if text in candidates else None


def first_best(score: Callable[[str, str], float], threshold: float) -> Match:
    """Match by a score: the first best candidate, if it reaches the threshold."""

    def match(text: str, candidates: list[str]) -> int | None:
        scores = [score(text, c) for c in candidates]
        if not scores:
            return None
        at = max(range(len(scores)), key=lambda i: (scores[i], -i))
        return at if scores[at] >= threshold else None

    return match


def _texts(items: list) -> list[str]:
    return [x["text"] for x in items]


def _push(items: list, item: dict, level: int, capacity) -> None:
    if len(items) >= capacity[level]:
        raise Full(f"level {level} holds {capacity[level]} already: {item['text'][:40]!r}")
    items.append(item)


def _topic(node: dict, subs=()) -> dict:
    return {"text": node["text"], "created": node["created"], "subs": list(subs)}


def _sub(node: dict, details=()) -> dict:
    return {"text": node["text"], "created": node["created"], "details": list(details)}


def merge_details(sub: dict, details: list, match: Match, capacity=CAPACITY) -> None:
    for d in details:
        if match(d["text"], _texts(sub["details"])) is None:
            _push(sub["details"], dict(d), 2, capacity)


def merge_topic(tree: Tree, topic: dict, match: Match = equal, capacity=CAPACITY) -> None:
    """A topic with its subtree: a new one is taken whole, a known one takes its sub-topics in."""
    at = match(topic["text"], _texts(tree))
    if at is None:
        _push(tree, _topic(topic, [_sub(s, map(dict, s["details"])) for s in topic["subs"]]), 0, capacity)
        return
    for s in topic["subs"]:
        i = match(s["text"], _texts(tree[at]["subs"]))
        if i is None:
            _push(tree[at]["subs"], _sub(s, map(dict, s["details"])), 1, capacity)
        else:
            merge_details(tree[at]["subs"][i], s["details"], match, capacity)


def merge_loose_sub(tree: Tree, sub: dict, match: Match = equal, attach: Match = equal, capacity=CAPACITY) -> bool:
    """A sub-topic without a topic: into its equal, else under a topic it attaches to, else promoted (True)."""
    everywhere = [s for t in tree for s in t["subs"]]
    at = match(sub["text"], _texts(everywhere))
    if at is not None:
        merge_details(everywhere[at], sub["details"], match, capacity)
        return False
    at = attach(sub["text"], _texts(tree))
    if at is not None:
        _push(tree[at]["subs"], _sub(sub, map(dict, sub["details"])), 1, capacity)
        return False
    _push(tree, _topic(sub, [_sub(d) for d in sub["details"]]), 0, capacity)
    return True


def merge_loose_detail(tree: Tree, detail: dict, match: Match = equal, attach: Match = equal, capacity=CAPACITY) -> bool:
    """A detail without a parent: dropped if known, else under a sub-topic, else a sub-topic, else a topic (True)."""
    if match(detail["text"], [d["text"] for t in tree for s in t["subs"] for d in s["details"]]) is not None:
        return False
    everywhere = [s for t in tree for s in t["subs"]]
    at = attach(detail["text"], _texts(everywhere))
    if at is not None:
        _push(everywhere[at]["details"], dict(detail), 2, capacity)
        return False
    at = attach(detail["text"], _texts(tree))
    if at is not None:
        _push(tree[at]["subs"], _sub(detail), 1, capacity)
        return False
    _push(tree, _topic(detail), 0, capacity)
    return True


def add_facts(tree: Tree, rows: list[dict], match: Match = equal, attach: Match = equal, capacity=CAPACITY) -> int:
    """Fold facts (created, topic, sub_topic, detail; missing levels null) in order; the number of promotions."""
    promoted = 0
    for r in rows:
        detail = [{"text": r["detail"], "created": r["created"]}] if r["detail"] is not None else []
        if r["topic"] is not None:
            subs = [{"text": r["sub_topic"], "created": r["created"], "details": detail}] if r["sub_topic"] is not None else []
            merge_topic(tree, {"text": r["topic"], "created": r["created"], "subs": subs}, match, capacity)
        elif r["sub_topic"] is not None:
            promoted += merge_loose_sub(tree, {"text": r["sub_topic"], "created": r["created"], "details": detail}, match, attach, capacity)
        elif detail:
            promoted += merge_loose_detail(tree, detail[0], match, attach, capacity)
    return promoted


def flatten(tree: Tree) -> list[tuple]:
    """(topic_idx, sub_idx, detail_idx, text, created) from top to bottom; -1 above a node's own level."""
    out = []
    for i, t in enumerate(tree):
        out.append((i, -1, -1, t["text"], t["created"]))
        for j, s in enumerate(t["subs"]):
            out.append((i, j, -1, s["text"], s["created"]))
            out += [(i, j, k, d["text"], d["created"]) for k, d in enumerate(s["details"])]
    return out


def merge_conversations(facts: DataFrame, match: Match = equal, attach: Match = equal, capacity=CAPACITY) -> DataFrame:
    """Fold each conversation's facts (conv_id, created, seq, topic, sub_topic, detail) into a tree, in order.

    For similarities under which the result depends on the order; with equal
    texts use tree.merge_exact, which needs no Python.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["created", "seq"])
        rows = rows.astype(object).where(rows.notna(), None).to_dict("records")
        tree: Tree = []
        add_facts(tree, rows, match, attach, capacity)
        return pd.DataFrame([(rows[0]["conv_id"], *x) for x in flatten(tree)], columns=["conv_id", "topic_idx", "sub_idx", "detail_idx", "text", "created"])

    return facts.groupBy("conv_id").applyInPandas(fold, "conv_id bigint, topic_idx int, sub_idx int, detail_idx int, text string, created bigint")
