"""Passages of long bodies for a question, citations of an answer, and grades of answers."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from ..sources.store import ship

# Window, step, and the parts kept from both ends.
WINDOW, STEP = 520, 260
HEAD, HEAD_SHARE, TAIL, TAIL_SHARE = 420, 5, 560, 4
GAP = " … "
ABSTAINED = "NOT_IN_CORPUS"


def _ends(body: str, head: int, tail: int) -> list[tuple[int, int]]:
    """The first ``head`` and last ``tail`` characters, each cut at a space in the half of it that is nearer the middle of the body."""
    cut, begin = body.rfind(" ", head // 2, head), max(0, len(body) - tail)
    space = body.find(" ", begin, begin + tail // 2)
    return [(0, cut if cut > 0 else head), (space + 1 if space > 0 else begin, len(body))]


def chosen(body: str, terms: list[str], budget: int) -> list[tuple[int, int]]:
    """Spans of the body within a budget: its head and tail up to spaces, then the best windows that fit and overlap nothing.

    A window counts 1 / sqrt(how often the body has the term) for each term in it; ties go to the earlier one. Where no term
    occurs, the head gets all that the tail leaves.
    """
    if len(body) <= budget:
        return [(0, len(body))]
    tail, low = min(TAIL, budget // TAIL_SHARE), body.lower()
    weight = {t: 1 / math.sqrt(n) for t in set(terms) if t and (n := low.count(t))}
    spans = _ends(body, min(HEAD, budget // HEAD_SHARE) if weight else budget - tail, tail)
    left = budget - sum(b - a for a, b in spans)
    windows = [(sum(w for t, w in weight.items() if t in low[a : a + WINDOW]), a) for a in range(0, len(body), STEP)]
    for value, a in sorted(windows, key=lambda x: (-x[0], x[1])):
        b = min(a + WINDOW, len(body))
        if value and b - a <= left and all(b <= x or a >= y for x, y in spans):
            spans.append((a, b))
            left -= b - a
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def select_passages(rows: DataFrame, budget: int) -> DataFrame:
    """(body, terms, ...) with the text of the chosen spans as ``passage``. Which window still fits depends on those before it, so the choice is made in Python, a batch at a time."""

    ship(rows.sparkSession)

    @F.pandas_udf("string")
    def passage(body: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([GAP.join(b[x:y].strip() for x, y in chosen(b, list(t), budget)) for b, t in zip(body.fillna(""), terms, strict=True)])

    return rows.withColumn("passage", passage("body", "terms"))


def cite(title: Column, source: Column, date: Column) -> Column:
    """'title (source, date)', without what is empty."""
    inside = F.concat_ws(", ", F.nullif(source, F.lit("")), F.nullif(date, F.lit("")))
    return F.when(inside == "", title).otherwise(F.concat(title, F.lit(" ("), inside, F.lit(")")))


def citations(answer: Column) -> Column:
    """The numbers that an answer cites, each once and in order; both kinds of brackets count."""
    plain = F.regexp_replace(F.regexp_replace(answer, "【", "["), "】", "]")
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.cast("int"))))


def graded(facts: DataFrame) -> DataFrame:
    """(kind, qid, supported 0/1, abstained, seconds) by fact to a report by kind and in total (kind null)."""
    answers = facts.groupBy("kind", "qid").agg(F.count("*").alias("facts"), F.sum("supported").alias("supported"), F.max(F.col("abstained").cast("int")).alias("abstained"), F.max("seconds").alias("seconds"))
    in_order, last = F.sort_array(F.collect_list("seconds")), F.greatest(F.floor(F.count("*") * 0.95) - 1, F.lit(0))  # a number for each question
    p95 = F.get(in_order, last.cast("int"))
    perfect = F.sum((F.col("facts") == F.col("supported")).cast("bigint"))
    return answers.rollup("kind").agg(F.count("*").alias("answers"), F.sum("facts").alias("facts"), F.sum("supported").alias("supported"), perfect.alias("perfect"), F.sum("abstained").alias("abstained"), F.expr("percentile(seconds, 0.5)").alias("median_seconds"), p95.alias("p95_seconds"))


def abstains(answer: str) -> bool:
    return bool(re.search(rf"\b{ABSTAINED}\b", answer or ""))
