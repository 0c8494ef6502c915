"""Facts and objects out of free text."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: Capitalised words that open sentences rather than name something (our own short list; the operators take any other).
NOT_NAMES = [w.capitalize() for w in ["the", "a", "an", "this", "that", "these", "those", "it", "i", "we", "you", "he", "she", "they", "and", "but", "or", "so", "if", "in", "on", "at", "for", "to", "of", "is", "are", "was", "my", "your", "our", "their", "his", "her", "what", "when", "where", "who", "why", "how", "yes", "no", "please", "thanks", "hello"]]

#: How a name, a date and a sentence's end look, and the lengths of a fact and of what is kept of it.
NAME_PHRASE = r"(?<![\p{L}\p{N}_])([A-Z][a-z]+(?:\s+[A-Z][a-zA-Z]+){0,2})(?![\p{L}\p{N}_])"
MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
NEAR_DAY = r"\s+(?:week|month|year|night|weekend|[\p{L}\p{N}_]+day)"
DATE = rf"(?iU)(?<![\p{{L}}\p{{N}}_])(?:\d{{1,2}}(?:st|nd|rd|th)?\s+{MONTH}(?:\s+\d{{2,4}})?|{MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,\s*\d{{2,4}})?|\d{{1,2}}/\d{{1,2}}(?:/\d{{2,4}})?|\d{{4}}-\d{{1,2}}-\d{{1,2}}|(?:19|20)\d{{2}}(?![\p{{L}}\p{{N}}_])|yesterday|today|tomorrow|tonight|last{NEAR_DAY}|next{NEAR_DAY})"
SENTENCE_END = r"(?<=[.!?])\s+"
FACT_CHARS, KEPT_CHARS = (20, 200), 160


def entities(text: Column, most: int = 1, stop: list[str] | None = None) -> Column:
    """The first different names of one to three capitalised words.

    A name whose first word is in ``stop``, is a short run of capitals, or was
    there before gives way to those of its words that pass alone.
    """
    stop = NOT_NAMES if stop is None else stop
    words = lambda e: F.split(e, r"(?U)\s+")
    alone = lambda e: ~e.rlike(r"\s") & (F.length(e) < 3)
    sound = lambda e: ~F.get(words(e), 0).isin(stop) & ~e.isin(stop) & ~alone(e) & ~e.rlike("^[A-Z]{1,4}$")
    found = F.regexp_extract_all(text, F.lit(NAME_PHRASE), 1)
    each = F.transform(found, lambda e, i: F.when(sound(e) & (F.array_position(found, e) == i + 1), F.array(e)).otherwise(F.filter(words(e), sound)))
    return F.slice(F.array_distinct(F.flatten(each)), 1, most)


def fact_sentences(df: DataFrame, text: str, most_entities: int = 1, most_facts: int = 2, need_date: bool = False, stop: list[str] | None = None, root: str | None = None) -> DataFrame:
    """Rows (seq, kind, text, parent) of each text: its root, if one is named, its entities, its facts.

    A fact is a sentence of 20 to 200 characters with an entity or a date (with
    ``need_date``: a date), each one once; 160 characters of it are kept. Its
    parent is the first of the text's entities that it names, else the first
    entity, else empty. An entity's parent is the root, or empty. A text that
    is null or blank has no rows.
    """
    keys = [c for c in df.columns if c != text]
    e = df.where(F.col(text).rlike(r"(?U)\S")).withColumn("_e", entities(F.col(text), most_entities, stop))
    sentences = F.filter(F.transform(F.split(F.col(text), f"(?U){SENTENCE_END}"), strip), lambda s: F.length(s).between(*FACT_CHARS))
    first = lambda s: F.get(F.filter(F.col("_e"), lambda n: F.contains(s, n)), 0)
    kept = F.filter(sentences, lambda s: s.rlike(DATE) | (F.lit(not need_date) & first(s).isNotNull()))
    kept = F.slice(F.array_except(kept, "_e"), 1, most_facts)
    row = lambda kind, t, parent: F.struct(F.lit(kind).alias("kind"), t.alias("text"), parent.alias("parent"))
    facts = F.transform(kept, lambda s: row("fact", F.left(s, F.lit(KEPT_CHARS)), F.coalesce(first(s), F.get(F.col("_e"), 0), F.lit(""))))
    names = F.transform("_e", lambda n: row("entity", n, F.lit(root or "")))
    top = [F.array(row("root", F.lit(root), F.lit("")))] if root else []
    return e.select(*keys, F.posexplode(F.concat(*top, names, facts)).alias("seq", "x")).select(*keys, "seq", "x.*")


#: How a code and a name look, and capitalised words that name nothing.
CODE = r"(?:^|[^A-Za-z0-9-])([A-Z]{2,}-\d+)(?![A-Za-z0-9])"
NAME = r"(?:^|[^A-Za-z])([A-Z][a-z]+[A-Za-z]*)(?![A-Za-z])"
NOT_A_NAME = ["User", "Assistant", "System", "Hi", "Hello", "Yes", "No", "JSON", "ID", "Code", "Name", "Project", "BERT", "SBERT", "LLM", "API", "Phase", "Turn", "Total", "RESP", "USER", "TEST", "DEBUG"]


def code_names(df: DataFrame, text: str, reach: int = 80) -> DataFrame:
    """Each code of a text once with the nearest name within ``reach`` characters; the earlier of two as near wins.

    A code's first place that has a name in reach counts. Distances need the
    places of matches, so texts meet the patterns in Arrow batches; in each,
    names are searched by bisection from a code's place.
    """
    keys = [c for c in df.columns if c != text]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text)
    code, name = re.compile(CODE), re.compile(NAME)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                t, paired = row[text] or "", {}
                found = [(m.start(), m.group(1)) for m in name.finditer(t) if m.group(1) not in NOT_A_NAME]
                places = [at for at, _ in found]
                for m in code.finditer(t):
                    i = bisect_left(places, m.start())
                    near = [(abs(found[j][0] - m.start()), j) for j in (i - 1, i) if 0 <= j < len(found)]
                    if near and min(near)[0] <= reach:
                        paired.setdefault(m.group(1), found[min(near)[1]][1])
                out += [(*[row[k] for k in keys], c, n) for c, n in paired.items()]
            yield pd.DataFrame(out, columns=[*keys, "code", "name"])

    return df.mapInPandas(pairs, f"{schema}, code string, name string")


def first_json_object(raw: str | None) -> str | None:
    """The first balanced {...}; braces inside strings, those before it included, do not count."""
    depth, start = 0, 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*(?:"|\Z|\\\Z)|[{}]', raw or "", re.DOTALL):
        token = m.group()
        if token == "{":
            start = start if depth else m.start()
            depth += 1
        elif token == "}" and depth:
            depth -= 1
            if not depth:
                return raw[start : m.end()]
    return None


def coerce_score(value) -> int | None:
    """Numbers and numeric strings to 0..100; truth values and the rest to None."""
    if isinstance(value, bool) or value is None:
        return None
    try:
        return max(0, min(100, int(float(value))))
    except (TypeError, ValueError, OverflowError):
        return None


def node_object(raw: str | None, most: int = 120, axes: tuple[str, ...] = ("comprehensive", "independent", "detail")) -> tuple[str, dict] | None:
    """(summary, scores) of a model's JSON reply, or None; scores may be nested under "scores", the top level wins."""
    found = first_json_object(raw)
    try:
        got = json.loads(found) if found else None
    except ValueError:
        return None
    if not isinstance(got, dict) or not str(got.get("summary") or "").strip():
        return None
    inner = got.get("scores") if isinstance(got.get("scores"), dict) else {}
    scores = {a: coerce_score(got.get(a, inner.get(a))) for a in axes}
    return None if None in scores.values() else (str(got["summary"]).strip()[:most], scores)


def salvage_strings(raw: Column) -> Column:
    """Complete quoted strings of an array that may be cut off."""
    found = F.regexp_extract_all(F.regexp_extract(raw, r"(?s)\[(.*)$", 1), F.lit(r'"((?:[^"\\]|\\.)*)"'), 1)
    return F.transform(found, lambda s: F.replace(F.replace(F.replace(s, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\")))
