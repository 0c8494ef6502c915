"""Column functions over text: trimming, normalising, predicates, parsing, counting."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Clause connectives, abbreviations, interrogatives, refusals and number words that results depend on.
JA_CONNECTIVES = ["また", "例えば", "ところで", "しかし", "ただし", "なお", "一方", "さらに", "そして", "次に", "つまり", "従って", "したがって", "そのため"]
EN_CONNECTIVES = ["however", "for example", "also", "but", "on the other hand", "in addition", "meanwhile", "next", "then", "therefore", "so", "first", "second", "finally"]
ABBREVIATIONS = ["e.g", "i.e", "etc", "vs", "cf", "al", "approx", "est", "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "rev", "gen", "inc", "ltd", "co", "corp", "dept", "univ", "fig", "no", "vol", "a.m", "p.m", "u.s", "u.k", "e.u"]
INTERROGATIVES = ["what", "when", "where", "who", "which", "how", "why", "did", "do", "does", "is", "are", "can", "could", "would", "will", "tell me", "remind me", "recall"]
REFUSALS = ["not in context", "not in the context", "not mentioned", "not mentioned in context", "not mentioned in the context", "not stated", "not specified", "not provided", "not available", "not found", "no information", "no answer", "unknown", "n a", "na", "none", "i don t know", "cannot determine", "can t determine", "unable to determine", "insufficient information", "not enough information"]
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty"]
#: What counts as yes, no and negation in a judge's reply, and the list marks and labels before it.
YES_PARTS = ["はい", "同じ"]
NO_PARTS = ["いいえ", "異なる"]
NEGATIONS = ["ではない", "では ない", "ではありません", "とは言えません", "とは言えない", "違います", "違う", "異なります", "異なり", "いや", "not the same", "does not", "doesn't", "do not", "don't", "isn't", "is not", "are not", "aren't", "no."]
LIST_MARKS = r"\-*•・"
ANSWER_LABELS = ["answer", "response", "reply", "ans", "a", "回答", "答え", "返答"]
DASHES = "‐‑‒–—－"

#: Separator of cut texts; never part of a text.
CUT = "\x00"


def strip(text: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def cut_pieces(text: Column) -> Column:
    """Stripped, non-empty pieces between CUT marks."""
    return F.filter(F.transform(F.split(text, CUT), strip), lambda p: p != "")


def _beyond_ascii(text: Column) -> Column:
    """The text if it has a character beyond ASCII, else null: only such rows' texts go to Python."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), text)


@F.pandas_udf(StringType())
def _lower_nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t.lower()))


@F.pandas_udf(StringType())
def _nfkc_casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition; not for use inside lambdas."""
    return F.coalesce(_nfkc(_beyond_ascii(text)), text)


def lower_nfkc(text: Column) -> Column:
    """Lower case, then Unicode compatibility composition, for which Spark has no function; not for use inside lambdas."""
    return F.coalesce(_lower_nfkc(_beyond_ascii(text)), F.lower(text))


def nfkc_casefold(text: Column) -> Column:
    """Unicode compatibility composition, then case folding; not for use inside lambdas."""
    return F.coalesce(_nfkc_casefold(_beyond_ascii(text)), F.lower(text))


def normalise_folded(text: Column) -> Column:
    """Dashes folded, punctuation to spaces, white space collapsed, of a text that lower_nfkc has folded."""
    dashes = F.translate(text, DASHES, "-" * len(DASHES))
    return squeeze(F.regexp_replace(dashes, r"(?U)[^\p{L}\p{N}_\s]", " "))


def normalise(text: Column) -> Column:
    """Lower case, NFKC, dashes folded, punctuation to spaces, white space collapsed."""
    return normalise_folded(lower_nfkc(text))


def keep_decimal_folded(text: Column) -> Column:
    """normalise_folded, but a point between digits stays."""
    dashes = F.translate(text, DASHES, "-" * len(DASHES))
    dotted = F.regexp_replace(dashes, r"(?U)[^\p{L}\p{N}_\s.]", " ")
    return squeeze(F.regexp_replace(dotted, r"(?<!\d)\.|\.(?!\d)", " "))


def normalise_keep_decimal(text: Column) -> Column:
    """normalise, but a point between digits stays."""
    return keep_decimal_folded(lower_nfkc(text))


def number_words_to_digits(text: Column) -> Column:
    words = F.array(*[F.lit(w) for w in NUMBER_WORDS])
    return F.array_join(F.transform(F.split(text, " "), lambda t: F.when(F.array_position(words, t) > 0, (F.array_position(words, t) - 1).cast("string")).otherwise(t)), " ")


def number_spellings(word: Column) -> Column:
    """A normalised word and, for a number of 0 to 20, its other spelling."""
    words = F.array(*[F.lit(w) for w in NUMBER_WORDS])
    named = F.array_position(words, word).cast("int")
    told = F.get(words, F.when(word.rlike("^(?:[0-9]|1[0-9]|20)$"), word.try_cast("int")))
    return F.filter(F.array(word, F.when(named > 0, (named - 1).cast("string")), told), lambda x: x.isNotNull())


def scrub(text: Column) -> Column:
    """Without diagram markers and context tags."""
    return squeeze(F.regexp_replace(F.regexp_replace(text, r"(?i)\[PN[^\]]*\]?", " "), r"(?i)</?context>", " "))


def is_no_answer(text: Column) -> Column:
    return normalise(scrub(text)).isin(REFUSALS)


def is_short_needle(needle: Column) -> Column:
    return F.replace(needle, F.lit(" "), F.lit("")).rlike(r"^\p{Nd}+$") | (F.length(needle) <= 3)


def truncate_words(text: Column, most: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), 1, most), " ")


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def is_query_turn(text: Column, phrases: list[str] | None = None) -> Column:
    """Short text that ends with a question mark or has one of the phrases."""
    t = strip(text)
    out = t.rlike("[?？]$")
    for p in phrases or []:
        out = out | F.contains(t, F.lit(p))
    return (F.length(t) <= 300) & out


def is_query_turn_en(text: Column) -> Column:
    t = strip(text)
    asks = rf"(?:{'|'.join(INTERROGATIVES)})(?![\p{{L}}'])"
    return (F.length(t) > 0) & (F.length(t) <= 300) & (t.endswith("?") | F.contains(F.lower(t), F.lit("one word")) | F.lower(t).rlike(f"^{asks}"))


def sentence_marks(text: Column) -> Column:
    """CUT after each sentence end: Japanese enders anywhere (a run is one), ASCII enders before white space or the end, but not after an abbreviation."""
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    abbreviation = rf"(?i)(?<![A-Za-z])(?<![A-Za-z]\.)({short})\.(?=\s|\z)"
    held = F.regexp_replace(text, f"(?U){abbreviation}".replace("(?U)(?i)", "(?iU)"), "$1\x01")
    cut = F.regexp_replace(held, r"(?U)(?<=[。！？])(?![。！？])|(?<=[.!?])(?=\s|\z)", CUT)
    return F.replace(cut, F.lit("\x01"), F.lit("."))


def connective_marks(text: Column) -> Column:
    """CUT before each clause connective: Japanese ones with a comma anywhere, English ones after , ; : or a dash."""
    ja = "|".join(JA_CONNECTIVES)
    cut = F.regexp_replace(text, f"(?<!^)(?=(?:{ja})[、,])", CUT)
    en = "|".join(EN_CONNECTIVES)
    return F.regexp_replace(cut, rf"(?iU)([,;:—–-]\s*)(?=(?:{en})(?![\p{{L}}\p{{N}}_]))", f"$1{CUT}")


def split_units(text: Column) -> Column:
    """Sentences, cut further before clause connectives."""
    return cut_pieces(connective_marks(sentence_marks(strip(text))))


def strip_think(text: Column) -> Column:
    """Without reasoning blocks; one left open takes the rest."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*$", ""))


def fenced_span(text: Column) -> Column:
    """Text between the first <<< and the next >>>, stripped; empty if there is none."""
    return strip(F.regexp_extract(text, r"(?s)<<<(.*?)>>>", 1))


def first_line(text: Column) -> Column:
    """First non-empty line after reasoning blocks are gone; empty if there is none."""
    return F.coalesce(F.get(F.filter(F.transform(F.split(strip_think(text), r"\r?\n"), strip), lambda x: x != ""), 0), F.lit(""))


def answer_letter(text: Column) -> Column:
    """First standalone A-D, in capitals; null if there is none."""
    found = F.regexp_extract(text, r"(?<!\p{L})([A-D])(?!\p{L})", 1)
    return F.when(found != "", found)


def first_int(text: Column, default: int = 50) -> Column:
    """First integer, clipped to 0..100."""
    found = F.regexp_extract(text, r"(\d{1,9})", 1)
    return F.when(found == "", F.lit(default)).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), found.try_cast("int"))))


def first_number01(text: Column) -> Column:
    """First number, clamped to [0, 1]; 0 if there is none."""
    found = F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1)
    return F.when(found == "", F.lit(0.0)).otherwise(F.least(F.lit(1.0), found.try_cast("double")))


def meaningful_line(text: Column) -> Column:
    """First line that says something: not blank, no bare code fence, list marks and labels taken off; empty if there is none."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"), strip)
    # a fence around a single word (a language's name) or around nothing carries no answer
    bare = F.transform(lines, lambda x: F.when(x.startswith("```"), strip(F.regexp_replace(x, "^`+|`+$", ""))).otherwise(x))
    opened = F.zip_with(lines, bare, lambda x, y: F.when(x.startswith("```") & y.rlike(r"^\p{L}*$"), F.lit("")).otherwise(y))
    labels = "|".join(ANSWER_LABELS)
    heads = rf"(?iU)^(?:(?:[{LIST_MARKS}]\s+|\d+\s*[.)]\s+|>\s+)|(?:{labels})\s*[:：]\s*|\s+)+"
    # "1. " and the like need a space behind them, which stripping takes: the marks are taken off with it in place
    plain = F.transform(opened, lambda x: strip(F.regexp_replace(x, heads, "")))
    return F.coalesce(F.get(F.filter(plain, lambda x: x != ""), 0), F.lit(""))


def _has_any(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def yes_no(text: Column) -> Column:
    """True, False or null for the first meaningful line: a negation wins, both or neither is null."""
    line = meaningful_line(F.coalesce(text, F.lit("")))
    low = F.lower(line)
    yes = low.rlike(r"(?U)\b(?:yes|y|true)\b") | _has_any(line, YES_PARTS)
    no = low.rlike(r"(?U)\b(?:no|n|false)\b") | _has_any(line, NO_PARTS)
    return F.when(_has_any(low, NEGATIONS), F.lit(False)).when(yes == no, F.lit(None)).otherwise(yes)


def dedup_key(text: Column) -> Column:
    """NFKC and case folded, without punctuation, separators and control characters."""
    return F.regexp_replace(nfkc_casefold(text), r"[\p{P}\p{Z}\p{C}]", "")


def node_text_problem(text: Column, finish_reason: Column) -> Column:
    """The first rule a node text breaks, or null."""
    return F.when(finish_reason != "stop", "finish_reason").when(strip(text) == "", "empty").when(F.length(text) > 120, "too long").when(text.rlike(r"\n"), "multi-line").when(text.rlike(r"\[(?:PN|SN|RN)"), "marker")


#: How a final channel opens and closes in a reply, how a reply of thoughts alone opens, and a marker's head.
FINAL = r"(?s)(?:assistantfinal|<\|channel\|>\s*final\s*<\|message\|>)\s*(.+?)(?:<\|return\|>|<\|end\|>|assistantanalysis|\z)"
THOUGHTS = r"(?s)^(?:assistantanalysis|analysis).*"
MARKER_HEAD = r"(?U)^(?:\[(?:SN|RN|PN[0-9.]+)\]\s*|\])"


def final_channel(text: Column) -> Column:
    """What a reply says in its final channel; without one, what is left without thoughts, or all of it if that is nothing."""
    rest = strip(F.regexp_replace(text, THOUGHTS, ""))
    return F.when(text.rlike(FINAL), strip(F.regexp_extract(text, FINAL, 1))).otherwise(F.when(rest == "", strip(text)).otherwise(rest))


def concept_key(text: Column) -> Column:
    """A concept's text for comparison: white space collapsed, without a marker or its end before it."""
    return squeeze(F.regexp_replace(strip(text), MARKER_HEAD, ""))
