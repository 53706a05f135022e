"""A pattern for texts of unequal form: their shapes are counted by Spark, then aligned one after the other.

A text's shape is its sequence of runs: digits, small letters, capitals, blanks, and each other character by
itself. Spark gives, for each shape, how many texts have it and, for each of its runs, the shortest and
longest length and the smallest and largest text. Only these few rows are aligned: the commonest shape
first, each next one against what is there, with a cost for gaps. Runs that some shapes lack become
optional, neighbours that come and go together one optional part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of runs, wider kinds that they merge to, and their patterns.
CLASSES = {"digit": r"\d", "lower": "[a-z]", "upper": "[A-Z]", "alpha": "[A-Za-z]", "word": r"\w", "space": r"\s"}
LETTERS, WORDS = {"lower", "upper", "alpha"}, {"digit", "lower", "upper", "alpha", "word"}
#: Scores of an alignment: equal fixed text, equal kind, kinds that merge, others, and a gap.
SAME_TEXT, SAME_KIND, MERGES, OTHER, GAP = 5.0, 2.0, 1.0, -4.0, -1.4
#: Shapes that are aligned, commonest first; ``support`` says how many rows the pattern covers. Texts of a part that become alternatives.
SHAPES, ALTERNATIVES = 64, 12


@dataclass
class Part:
    """A column of the alignment: runs of one kind, and the shapes that have it."""

    kind: str  # of CLASSES, or the character itself
    low: int
    high: int
    text: str | None  # if it is always the same
    shapes: frozenset[int] = field(default_factory=frozenset)
    texts: list[str] | None = None  # all it can be, once it had to be told from other texts

    def atom(self) -> str:
        if self.text is not None:
            return re.escape(self.text)
        if self.texts:
            return "(?:" + "|".join(re.escape(t) for t in self.texts) + ")"
        one = CLASSES.get(self.kind) or re.escape(self.kind)
        return one + ("" if (self.low, self.high) == (1, 1) else f"{{{self.low}}}" if self.low == self.high else f"{{{self.low},{self.high}}}")


def runs(c: Column) -> Column:
    """The runs of a text as an array of texts."""
    return F.regexp_extract_all(c, F.lit(r"([0-9]+|[a-z]+|[A-Z]+|\s+|(.)\2*)"), F.lit(1))


def _kind(run: Column) -> Column:
    first = F.substring(run, 1, 1)
    return F.when(first.rlike("[0-9]"), "digit").when(first.rlike("[a-z]"), "lower").when(first.rlike("[A-Z]"), "upper").when(first.rlike(r"\s"), "space").otherwise(first)


def shapes(df: DataFrame, column: str) -> DataFrame:
    """shape (array of kinds), rows, place, low, high, first, last: a row for each run of each shape of nonempty texts."""
    x = df.select(runs(F.col(f"`{column}`")).alias("r")).where(F.size("r") > 0)
    x = x.select(F.transform("r", _kind).alias("shape"), F.posexplode("r").alias("place", "run"))
    return x.groupBy("shape", "place").agg(F.count(F.lit(1)).alias("rows"), F.min(F.length("run")).alias("low"), F.max(F.length("run")).alias("high"), F.min("run").alias("first"), F.max("run").alias("last"))


def _read(df: DataFrame, column: str) -> list[list[Part]]:
    every = shapes(df, column)
    common = every.where("place = 0").orderBy(F.desc("rows"), "shape").limit(SHAPES).select("shape", F.col("rows").alias("n"))
    found: dict[tuple, list] = {}
    for r in every.join(F.broadcast(common), "shape").orderBy(F.desc("n"), "shape", "place").collect():  # a row for each run of SHAPES shapes
        found.setdefault(tuple(r["shape"]), []).append(r)
    return [[Part(k, r["low"], r["high"], r["first"] if r["first"] == r["last"] else None, frozenset([i])) for k, r in zip(shape, rs, strict=True)] for i, (shape, rs) in enumerate(found.items())]


def _merged(a: str, b: str) -> str | None:
    if a == b:
        return a
    return "alpha" if {a, b} <= LETTERS else "word" if {a, b} <= WORDS else None


def _score(a: Part, b: Part) -> float:
    if a.text is not None and a.text == b.text:
        return SAME_TEXT
    kind = _merged(a.kind, b.kind)
    return SAME_KIND if a.kind == b.kind else MERGES if kind else OTHER


def _joined(a: Part, b: Part) -> Part:
    return Part(_merged(a.kind, b.kind), min(a.low, b.low), max(a.high, b.high), a.text if a.text == b.text else None, a.shapes | b.shapes)


def align(rows: list[list[Part]]) -> list[Part]:
    """The columns of all shapes, each next shape aligned with those before."""
    columns: list[Part] = []
    for own in rows:
        n, m = len(columns), len(own)
        best = [[(GAP * (i + j), "up" if i else "left") for j in range(m + 1)] for i in range(n + 1)]
        for j in range(1, m + 1):
            best[0][j] = (GAP * j, "left")
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                score = _score(columns[i - 1], own[j - 1])
                both = (best[i - 1][j - 1][0] + score, "both") if score > OTHER else (float("-inf"), "both")
                best[i][j] = max(both, (best[i - 1][j][0] + GAP, "up"), (best[i][j - 1][0] + GAP, "left"), key=lambda x: x[0])
        out, i, j = [], n, m
        while i or j:
            move = best[i][j][1]
            if move == "both":
                out.append(_joined(columns[i - 1], own[j - 1]))
            else:
                out.append(columns[i - 1] if move == "up" else own[j - 1])
            i, j = i - (move != "left"), j - (move != "up")
        columns = out[::-1]
    return columns


def render(columns: list[Part], captures: bool = False) -> str:
    """The anchored pattern; with ``captures`` each part that varies is a group."""
    every = frozenset().union(*[c.shapes for c in columns]) if columns else frozenset()
    out, at = [], 0
    while at < len(columns):
        stop = at + 1
        while stop < len(columns) and columns[stop].shapes == columns[at].shapes:
            stop += 1
        inside = "".join(f"({c.atom()})" if captures and c.text is None else c.atom() for c in columns[at:stop])
        out.append(inside if columns[at].shapes == every else f"(?:{inside})?")
        at = stop
    return "^" + "".join(out) + "$"


@dataclass
class Pattern:
    """A pattern, how many of the rows it covers, and negative examples that it still meets."""

    text: str
    columns: list[Part]
    matches: int
    rows: int
    conflicts: int = 0

    def flavour(self, name: str) -> str:
        """For ``java`` and ``pcre`` as it is; ``python`` knows the same; in ``js`` between slashes."""
        if name not in ("java", "pcre", "python", "js"):
            raise ValueError(f"unknown flavour {name}")
        return "/" + self.text.replace("/", "\\/") + "/" if name == "js" else self.text


def learned(df: DataFrame, column: str, negative: DataFrame | None = None, captures: bool = False) -> Pattern | None:
    """A pattern of a column's texts. Where it meets texts of ``negative``'s first column, parts of few texts become alternatives.

    None if there is no text. ``conflicts`` counts negatives that even the tightened pattern meets.
    """
    columns = align(_read(df, column))
    if not columns:
        return None
    pattern, conflicts = render(columns, captures), 0
    if negative is not None:
        name = negative.columns[0]
        count = lambda: negative.where(F.col(f"`{name}`").rlike(pattern)).count()
        conflicts = count()
        if conflicts:
            _tighten(df, column, columns)
            pattern = render(columns, captures)
            conflicts = count()
    row = df.agg(F.count_if(F.col(f"`{column}`").rlike(pattern)), F.count(F.col(f"`{column}`"))).first()
    return Pattern(pattern, columns, row[0], row[1], conflicts)


def _tighten(df: DataFrame, column: str, columns: list[Part]) -> None:
    """Parts with few different texts list them: one aggregate over what the pattern captures."""
    captured = render(columns, captures=True)
    varying = [c for c in columns if c.text is None]
    group = lambda i: F.regexp_extract(F.col(f"`{column}`"), captured, i + 1)
    sizes = df.agg(*[F.approx_count_distinct(group(i)).alias(f"g{i}") for i in range(len(varying))]).first()
    few = [i for i in range(len(varying)) if sizes[f"g{i}"] <= ALTERNATIVES]
    if not few:
        return
    texts = df.agg(*[F.sort_array(F.collect_set(group(i))).alias(f"g{i}") for i in few]).first()
    for i in few:
        found = [t for t in texts[f"g{i}"] if t]
        if len(found) <= 2 * ALTERNATIVES:
            varying[i].texts = sorted(found, key=lambda t: (-len(t), t))


def tested(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """All columns of ``df``, ``matched`` and ``groups``: what each group of the pattern holds (empty where it has no part)."""
    n = re.compile(pattern).groups
    c = F.col(f"`{column}`")
    groups = F.array(*[F.regexp_extract(c, pattern, i + 1) for i in range(n)]) if n else F.array().cast("array<string>")
    return df.withColumn("matched", F.coalesce(c.rlike(pattern), F.lit(False))).withColumn("groups", groups)
