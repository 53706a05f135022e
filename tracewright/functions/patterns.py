"""Regular expressions from examples, and small readers of plain text."""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes of characters and their patterns, narrow to wide.
_CLASSES = (("0-9", r"\d", str.isdigit), ("a-z", "[a-z]", lambda c: "a" <= c <= "z"), ("A-Z", "[A-Z]", lambda c: "A" <= c <= "Z"))


def _kind(c: str) -> str:
    return next((name for name, _, test in _CLASSES if test(c)), c)


def synthesize(positive: list[str], negative: list[str] = ()) -> str | None:
    """An anchored pattern of character runs that meets all positives and no negative; None if the runs don't line up."""
    runs = [[(k, len(list(g))) for k, g in groupby(map(_kind, text))] for text in positive]
    if not runs or len({tuple(k for k, _ in r) for r in runs}) != 1:
        return None
    parts = []
    for i, (kind, _) in enumerate(runs[0]):
        atom = next((p for n, p, _ in _CLASSES if n == kind), re.escape(kind))
        seen = sorted({r[i][1] for r in runs})
        parts.append((atom, seen[0], seen[-1], i))
    render = lambda: "^" + "".join(a + ("" if (lo, hi) == (1, 1) else f"{{{lo}}}" if lo == hi else f"{{{lo},{hi}}}") for a, lo, hi, _ in parts) + "$"
    pattern = render()
    if any(re.search(pattern, n) for n in negative):
        # tighten: runs that differ little become alternations of what was seen
        cut = [[m.group() for m in re.finditer("|".join(f"(?:{p})+" if p.startswith(("[", "\\d")) else f"(?:{p})+" for p in [a for a, *_ in parts]), t)] for t in positive]
        if all(len(c) == len(parts) for c in cut):
            words = ["|".join(sorted({re.escape(c[i]) for c in cut})) for i in range(len(parts))]
            pattern = "^" + "".join(f"(?:{w})" for w in words) + "$"
    return None if any(re.search(pattern, n) for n in negative) or not all(re.search(pattern, p) for p in positive) else pattern


def support(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """matches, rows of a pattern over a column."""
    return df.agg(F.count_if(F.col(column).rlike(pattern)).alias("matches"), F.count(column).alias("rows"))


def emails(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), 0)


def urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"https?://[^\s<>\"]+"), 0)


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"-?\d+(?:\.\d+)?"), 0)


def next_value(c: Column) -> Column:
    """The next of an arithmetic or geometric series of at least three numbers; else null."""
    n = F.size(c)
    steps = F.zip_with(F.slice(c, 2, n), F.slice(c, F.lit(1), n - 1), lambda a, b: a - b)
    ratios = F.zip_with(F.slice(c, 2, n), F.slice(c, F.lit(1), n - 1), lambda a, b: F.try_divide(a, b))
    same = lambda x: F.size(F.array_distinct(x)) == 1
    last = F.element_at(c, -1)
    return F.when((n >= 3) & same(steps), last + steps[0]).when((n >= 3) & same(ratios), last * ratios[0])


def classified(df: DataFrame, text: str, labels: dict[str, list[str]]) -> Column:
    """The label with most keywords in a text; ties by label, null without any."""
    lower = F.lower(F.col(text))
    score = [F.struct(sum(F.when(F.contains(lower, F.lit(w.lower())), 1).otherwise(0) for w in words).alias("n"), F.lit(label).alias("label")) for label, words in sorted(labels.items(), reverse=True)]
    best = F.array_max(F.array(*score))
    return F.when(best["n"] > 0, best["label"])
