"""Attention over text lines: segments, templates, features, pattern breaks, novelty, scores, findings.

Lines are rows; everything is a projection, a window inside a text, or a grouped count. Windows are
partitioned by text (and by more inside it), so one exchange by text serves them all, and a text is
the largest thing a task holds. Parts of a score are whole ten-thousandths: no result depends on the
order of floating sums.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import signal_lists as L
from tracewright.shared import shared_folder

ROLES = ("failure", "exception", "constraint", "warning", "pattern-break", "decision", "definition")
_TITLES = ("Failure marker", "Exception near a rule", "Concrete constraint", "Warning marker", "Pattern break", "Decision marker", "Definition")


def _any(line: Column, patterns: Iterable[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | line.rlike(p)
    return found


def _share(part: Column, whole: Column, unit: int = 10000) -> Column:
    """``unit * part / whole`` as a whole number, halves up; both sides are whole numbers."""
    return F.floor((2 * unit * part + whole) / (2 * whole)).cast("long")


def marked(x: DataFrame, key: str) -> DataFrame:
    """Adds blank, block, indent and delimiter to lines (key, line_no, line).

    A block ends where a blank line follows a line that is not blank; a tab indents by two.
    """
    by = Window.partitionBy(key).orderBy("line_no")
    x = x.withColumn("line", F.coalesce("line", F.lit(""))).withColumn("blank", F.col("line").rlike(L.BLANK))
    ends = F.col("blank") & ~F.coalesce(F.lag("blank").over(by), F.lit(True))
    x = x.withColumn("_e", ends.cast("int")).withColumn("block", F.sum("_e").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_e")
    counts = [(name, F.length("line") - F.length(F.replace("line", F.lit(d), F.lit("")))) for d, name in L.DELIMITERS]
    most = F.greatest(*[n for _, n in counts])
    which = F.coalesce(*[F.when((n == most) & (most > 0), F.lit(name)) for name, n in counts], F.lit("none"))
    indent = F.length(F.replace(F.regexp_extract("line", "^[ \t]*", 0), F.lit("\t"), F.lit("  ")))
    return x.withColumn("indent", indent).withColumn("delimiter", which)


def lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line_no (from 1), line, blank, block, indent, delimiter of every line of every text; a null text is one blank line."""
    every = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1)
    x = df.select(F.col(key), F.posexplode(every).alias("_p", "line"))
    return marked(x.select(key, (F.col("_p") + 1).alias("line_no"), "line"), key)


def validation(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, bytes, lines, errors, warnings: whether each text can be looked at line by line.

    Errors: empty, too_large, too_many_lines, binary, encoded (one unbroken line is nearly all of it).
    Warnings: long_lines, small. A null text is empty.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    x = df.select(key, t.alias("_t")).withColumn("_l", F.when(F.col("_t") == "", F.array().cast("array<string>")).otherwise(F.split("_t", "\n", -1)))
    x = x.withColumn("_s", F.filter("_l", lambda v: ~v.rlike(L.BLANK))).withColumn("_long", F.reduce("_s", F.lit(""), lambda a, v: F.when(F.length(v) > F.length(a), v).otherwise(a)))
    n, size = F.length("_t"), F.octet_length("_t")
    gone = n - F.length(F.replace("_t", F.lit("\ufffd"), F.lit("")))
    control = n - F.length(F.regexp_replace("_t", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    rest = F.reduce("_s", F.lit(0), lambda a, v: a + F.length(v)) + F.size("_s") - 1
    spaces = F.length("_long") - F.length(F.regexp_replace("_long", L.SPACE, ""))
    encoded = (F.length("_long") > 5000) & (F.length("_long") > 0.82 * rest) & (spaces < 0.015 * F.length("_long"))
    errors = [
        ("empty", F.size("_s") == 0), ("too_large", size > L.MOST_BYTES), ("too_many_lines", F.size("_l") > L.MOST_LINES),
        ("binary", (gone > 0.01 * n) | (control > 0.002 * n)), ("encoded", encoded),
    ]
    warnings = [("long_lines", F.exists("_l", lambda v: F.octet_length(v) > L.MOST_LINE_BYTES)), ("small", F.size("_s") < 5)]
    listed = [F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in kinds])) for kinds in (errors, warnings)]
    return x.select(key, size.alias("bytes"), F.size("_l").alias("lines"), listed[0].alias("errors"), listed[1].alias("warnings"))


def routing(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, format (JSON, XML, CSV, TSV, YAML or null): texts of two lines or more that are data, not lines."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{L.SPACE}+|{L.SPACE}+$", "")
    x = df.select(key, t.alias("_t")).withColumn("_l", F.filter(F.split("_t", "\r?\n", -1), lambda v: v != ""))

    def rows(delimiter: str) -> Column:
        widths = F.transform(F.slice("_l", 1, 80), lambda v: F.length(v) - F.length(F.replace(v, F.lit(delimiter), F.lit(""))) + 1)
        same = F.transform(F.array(widths), lambda w: (F.size(w) >= 3) & (F.array_max(w) >= 3) & (F.array_max(F.transform(F.array_distinct(w), lambda a: F.size(F.filter(w, lambda b: a == b)))) >= 0.8 * F.size(w)))
        return same[0]

    yaml = F.size(F.filter("_l", lambda v: v.rlike(r"^\s*-?\s*[A-Za-z_][\w.-]*:\s+\S")))
    kind = (
        F.when(F.size("_l") < 2, F.lit(None))
        .when(F.col("_t").rlike(r"^[\[{]") & F.try_parse_json("_t").isNotNull(), "JSON")
        .when(F.col("_t").rlike(r"(?i)^<\?xml\b|^<([A-Za-z][\w:.-]*)[\s>][\s\S]*</\1>\s*$"), "XML")
        .when(rows(","), "CSV")
        .when(rows("\t"), "TSV")
        .when((yaml >= 4) & (yaml > 0.65 * F.size("_l")), "YAML")
    )
    return x.select(key, kind.alias("format"))


def template(line: Column) -> Column:
    """A line with its changing parts replaced. Unicode is taken as it is: normalise (NFC) before where it matters."""
    plain = F.regexp_replace(line, "\\x1B\\[[0-9;]*m", "")
    made = {}
    for digits in (True, False):  # most tokens hold a digit: a line without one skips their patterns
        made[digits] = plain
        for name, pattern in L.TOKENS:
            if digits or name not in L.WITH_DIGITS:
                made[digits] = F.regexp_replace(made[digits], pattern, name)
    return F.trim(F.regexp_replace(F.when(line.rlike("[0-9]"), made[True]).otherwise(made[False]), "[ \t]+", " "), F.lit(" \x0b\x0c\r\u00a0\ufeff"))


def templates(x: DataFrame, key: str) -> DataFrame:
    """key, template, lines, first_line of each template of each text."""
    return x.where(~F.col("blank")).groupBy(key, template(F.col("line")).alias("template")).agg(F.count(F.lit(1)).alias("lines"), F.min("line_no").alias("first_line"))


def exact_groups(x: DataFrame, key: str) -> DataFrame:
    """key, line, lines, first_line of each distinct line of each text."""
    return x.where(~F.col("blank")).groupBy(key, "line").agg(F.count(F.lit(1)).alias("lines"), F.min("line_no").alias("first_line"))


def token_classes(line: Column) -> Column:
    """Classes of the tokens of a line's template: the token itself, <upper>, <word>, <punctuation> or <mixed>."""
    return F.transform(
        F.filter(F.split(template(line), r"\s+"), lambda t: t != ""),
        lambda t: F.when(t.rlike("^<[^>]+>$"), t).when(t.rlike("^[A-Z_]{2,}$"), "<upper>").when(t.rlike("(?i)^[a-z]+$"), "<word>").when(t.rlike(r"^[^\w]+$"), "<punctuation>").otherwise("<mixed>"),
    )


def transitions(x: DataFrame, key: list[str], order: list[str], symbol: str) -> DataFrame:
    """previous, symbol, n of neighbouring symbols inside each group."""
    step = x.withColumn("previous", F.lag(symbol).over(Window.partitionBy(*key).orderBy(*order))).where("previous is not null")
    return step.groupBy("previous", F.col(symbol).alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


def hits(line: Column) -> Column:
    """Array of (feature, role, strength in ten-thousandths, value) of a line, in the order of the list."""
    return F.array_compact(F.array(*[
        F.when(line.rlike(p) & (~_any(line, L.NO_ERROR) if name == "error" else F.lit(True)), F.struct(F.lit(name).alias("feature"), F.lit(role).alias("role"), F.lit(round(s * 10000)).alias("strength"), F.trim(F.regexp_extract(line, p, 0)).alias("value")))
        for name, role, s, p in L.FEATURES
    ]))


def strength(features: Column) -> Column:
    """Strength of a line's features in ten-thousandths: the strongest, and 600 for each further one, 1800 at most."""
    own = F.transform(features, lambda f: f["strength"])
    return F.when(F.size(features) > 0, F.least(F.lit(10000), F.array_max(own) + F.least(F.lit(1800), 600 * (F.size(features) - 1)))).otherwise(0)


def severity(features: Column) -> Column:
    """The strongest failure or warning, in ten-thousandths."""
    return F.coalesce(F.array_max(F.transform(F.filter(features, lambda f: f["role"].isin("failure", "warning")), lambda f: f["strength"])), F.lit(0))


def features(x: DataFrame, key: str) -> DataFrame:
    """key, line_no, feature, role, strength (0 to 1), value of every hit."""
    y = x.where(~F.col("blank")).select(key, "line_no", F.inline(hits(F.col("line"))))
    return y.withColumn("strength", F.col("strength") / 10000)


def evidence(x: DataFrame, key: str) -> DataFrame:
    """key, line_no, kind, value: the first date, quantity, field, path and identifier of a line, as they stand."""
    line = F.col("line")
    found = F.array_compact(F.array(*[F.when(line.rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(line, p, 0).alias("value"))) for kind, p in L.EVIDENCE]))
    return x.where(~F.col("blank")).select(key, "line_no", F.inline(found))


def exception_links(x: DataFrame, key: str, reach: int = 8) -> DataFrame:
    """key, line_no of an exception and the nearest constraint among the 8 nonblank lines before it."""

    def of(role: str) -> Column:
        return _any(F.col("line"), [p for _, r, _, p in L.FEATURES if r == role])

    y = x.where(~F.col("blank")).withColumn("_c", of("constraint")).withColumn("_e", of("exception"))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(-reach, -1)
    return y.withColumn("rule_line", F.last(F.when(F.col("_c"), F.col("line_no")), ignorenulls=True).over(before)).where(F.col("_e") & F.col("rule_line").isNotNull()).select(key, "line_no", "rule_line")


def restatements(x: DataFrame, key: str, least: float = 0.64, tokens: int = 4) -> DataFrame:
    """key, line_no, earlier, similarity: the most similar earlier line of another template, the first of equals.

    Every earlier line counts, however many share a word. Lines with equal words and template meet as
    one set; two of these meet on a word of their prefixes (the longest words first, which are rare), if
    what follows the word can still reach the similarity. Only the pairs that are left are joined with
    their words: a prefix has a row for each word, without the others.
    """
    t = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("line"), F.lit("[a-z0-9_]{3,}"), F.lit(0)), lambda w: ~w.isin(*L.STOP_WORDS)))
    y = x.where(~F.col("blank")).select(key, "line_no", F.array_sort(t).alias("_t"), "line").where(F.size("_t") >= tokens)
    y = _written(y.select(key, "line_no", "_t", F.xxhash64("_t").alias("_h"), F.xxhash64(template(F.col("line"))).alias("_tpl")), "restatement-lines")
    sets = _written(y.groupBy(key, "_tpl", "_h", "_t").agg(F.min("line_no").alias("_first")), "restatement-sets")
    in_order = F.array_sort(F.transform("_t", lambda w: F.struct((-F.length(w)).alias("l"), F.xxhash64(w).alias("h"), w.alias("w"))))
    n = F.size("_t")
    head = F.transform(F.slice(in_order, F.lit(1), (n - F.ceil(n * least - 1e-9) + 1).cast("int")), lambda s: F.hash(s["h"]))
    p = sets.select(key, "_tpl", "_first", n.alias("_n"), F.posexplode(head).alias("_i", "_w"))
    a, b = p.alias("a"), p.alias("b")
    fewer, both = F.least("a._n", "b._n"), F.col("a._n") + F.col("b._n")
    near = (fewer >= least * F.greatest("a._n", "b._n")) & (F.col("a._tpl") != F.col("b._tpl")) & (F.col("a._first") < F.col("b._first"))
    # the first word that two sets share has all other shared ones behind it
    reach = F.least(F.col("a._n") - F.col("a._i"), F.col("b._n") - F.col("b._i")) >= least / (1 + least) * both - 1e-6
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._w") == F.col("b._w")) & near & reach)
    # written, so that Spark knows how few they are and moves them to the sets
    pairs = _written(pairs.select(F.col(f"a.{key}").alias(key), F.col("a._first").alias("_a"), F.col("b._first").alias("_b")).distinct(), "restatement-pairs")
    for side in ("_a", "_b"):
        own = F.struct("_tpl", "_h", "_t", F.col("_first").alias("earlier")).alias(f"{side}s")
        pairs = sets.select(key, F.col("_first").alias(side), own).join(pairs, [key, side])
    common = F.size(F.array_intersect("_as._t", "_bs._t"))
    similar = pairs.withColumn("similarity", common / (F.size("_as._t") + F.size("_bs._t") - common)).where(F.col("similarity") >= least)
    ways = [F.struct(F.col(f"{to}._tpl").alias("_tpl"), F.col(f"{to}._h").alias("_h"), F.col(f"{of}.earlier").alias("earlier")) for of, to in (("_as", "_bs"), ("_bs", "_as"))]
    similar = similar.select(key, "similarity", F.inline(F.array(*ways)))
    every = y.select(key, "line_no", "_tpl", "_h").join(similar, [key, "_tpl", "_h"]).where(F.col("earlier") < F.col("line_no"))
    best = F.max(F.struct("similarity", (-F.col("earlier")).alias("e")))
    return every.groupBy(key, "line_no").agg(best.alias("_b")).select(key, "line_no", (-F.col("_b.e")).alias("earlier"), F.round("_b.similarity", 3).alias("similarity"))


def _written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder: what several steps read is made once."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _grams(x: DataFrame, key: str) -> DataFrame:
    """key, line_no, bytes, grams: sampled four-byte sequences of a nonblank line; crc32 maps four bytes one to one."""
    # the bytes are bound to a lambda's variable, so that a line is encoded once
    sampled = "transform(array(encode(line, 'utf-8')), b -> transform(sequence(1, octet_length(line) - 3, if(octet_length(line) > 48, 2, 1)), i -> crc32(substring(b, i, 4))))[0]"
    grams = F.expr(f"if(octet_length(line) < 4, cast(array() as array<bigint>), {sampled})")
    return x.where(~F.col("blank")).select(key, "line_no", F.octet_length("line").alias("bytes"), grams.alias("grams"))


def novel(unseen: Column, sampled: Column, bytes_: Column) -> Column:
    """Novelty in ten-thousandths: the unseen share, lower for short lines."""
    reach = F.greatest(F.lit(0), F.least(F.lit(48), bytes_ - 7))
    value = F.when(sampled > 0, _share(unseen * reach, sampled * 48)).otherwise(0)
    return F.when(bytes_ < 20, F.least(value, F.lit(4500))).otherwise(value).cast("long")


def novelty(x: DataFrame, key: str) -> DataFrame:
    """key, line_no, novelty (0 to 1) of nonblank lines against all earlier lines of the text.

    A gram is new on the first line that has it. Nothing is forgotten, which differs from
    ``novelty_evicting`` only for texts with more distinct grams than it remembers.
    """
    # a row for each text, and many rows at once in Python: a call for each text costs more than its fold,
    # and a table of all texts' grams has dozens of rows for a line, and spills
    y = x.where(~F.col("blank")).select(F.col(key).alias("_k"), F.struct("line_no", F.encode("line", "utf-8").alias("_b")).alias("_l"))
    kinds = dict(x.dtypes)
    row = f"array<struct<line_no: {kinds['line_no']}, bytes: int, _n: int, _new: bigint>>"
    folded = y.groupBy("_k").agg(F.collect_list("_l").alias("_ls")).mapInArrow(_unseen, f"_k {kinds[key]}, _r {row}").select(F.col("_k").alias(key), F.inline("_r"))
    return folded.select(key, "line_no", (novel(F.col("_new"), F.col("_n"), F.col("bytes")) / 10000).alias("novelty"))


#: Bytes of lines that are folded at once, or one text.
FOLDED = 4 << 20


def _unseen(batches):
    """Of each text (``_k, _ls``), for each line: line_no, bytes, sampled grams, and those that no earlier line has; the grams are those of ``_grams``."""
    for batch in batches:
        at, many = 0, np.cumsum(pc.list_value_length(batch.column("_ls")).to_numpy(zero_copy_only=False))
        sizes = pc.binary_length(batch.column("_ls").flatten().flatten()[1]).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[many]
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + FOLDED, side="right")))
            yield _folded(batch.slice(at, stop - at))
            at = stop


def _folded(batch: pa.RecordBatch) -> pa.RecordBatch:
    count = pc.list_value_length(batch.column("_ls")).to_numpy(zero_copy_only=False).astype(np.int64)
    line_no, lines = batch.column("_ls").flatten().flatten()
    text = np.repeat(np.arange(len(count)), count)
    order = pa.array(np.lexsort((line_no.to_numpy(zero_copy_only=False), text)))
    line_no, lines = line_no.take(order), lines.take(order).to_pylist()
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    n = np.where(size < 4, 0, np.where(size > 48, (size - 2) // 2, size - 3))
    end = np.cumsum(size)
    data = np.frombuffer(b"".join(lines), np.uint8).astype(np.uint64)
    line = np.repeat(np.arange(len(lines)), n)
    place = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
    at = (end - size)[line] + place * np.where(size > 48, 2, 1)[line]
    grams = (text[line].astype(np.uint64) << 32) | (data[at] << 24) | (data[at + 1] << 16) | (data[at + 2] << 8) | data[at + 3]
    new = np.bincount(line[np.unique(grams, return_index=True)[1]], minlength=len(lines))
    rows = pa.StructArray.from_arrays([line_no, pa.array(size, pa.int32()), pa.array(n, pa.int32()), pa.array(new, pa.int64())], ["line_no", "bytes", "_n", "_new"])
    return pa.record_batch([batch.column("_k"), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), rows)], ["_k", "_r"])


def novelty_evicting(x: DataFrame, key: str, entries: int = 32768) -> DataFrame:
    """key, line_no, novelty (0 to 1) where only the last ``entries`` grams used are remembered.

    What is forgotten depends on all lines before: each text is one ordered fold in one task.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_no")
        known: dict[int, None] = {}
        unseen = []
        for grams in pdf["grams"]:
            own = dict.fromkeys(grams)
            unseen.append(sum(g not in known for g in own))
            for g in own:
                known.pop(g, None)
                known[g] = None
                if len(known) > entries:
                    del known[next(iter(known))]
        return pd.DataFrame({"_k": pdf["_k"], "line_no": pdf["line_no"], "bytes": pdf["bytes"], "_n": pdf["grams"].str.len(), "_new": unseen})

    y = _grams(x, key).withColumnRenamed(key, "_k")
    kinds = dict(y.dtypes)
    folded = y.groupBy("_k").applyInPandas(fold, f"_k {kinds['_k']}, line_no {kinds['line_no']}, bytes int, _n int, _new long")
    return folded.select(F.col("_k").alias(key), "line_no", (novel(F.col("_new"), F.col("_n"), F.col("bytes")) / 10000).alias("novelty"))


def _mode_scores(repeated: Column, lines_: Column, stream: Column, document: Column, blank: Column, every: Column) -> tuple[Column, Column]:
    n = F.greatest(lines_, F.lit(1))
    s = F.least(F.lit(1.0), stream / n * 1.25 + repeated / n * 0.55 + F.when(blank / every < 0.08, 0.12).otherwise(0.0))
    d = F.least(F.lit(1.0), document / n * 0.95 + F.least(F.lit(0.22), blank / every * 1.8))
    return s, d


def _mode(s: Column, d: Column) -> Column:
    return F.when(F.abs(s - d) < 0.14, "uncertain").when(s > d, "stream").otherwise("document")


def _looks(line: Column) -> tuple[Column, Column]:
    return _any(line, L.STREAM).cast("int"), _any(line, L.DOCUMENT).cast("int")


def modes(x: DataFrame, key: str) -> DataFrame:
    """key, mode (stream, document, uncertain), stream, document (scores), confidence of each text."""
    s, d = _looks(F.col("line"))
    seen = ~F.col("blank")
    y = x.select(F.col(key).alias("_k"), "blank", F.when(seen, F.xxhash64(template(F.col("line")))).alias("_tpl"), s.alias("_st"), d.alias("_do"))
    y = y.groupBy("_k", "_tpl", "blank").agg(F.count(F.lit(1)).alias("_n"), F.sum("_st").alias("_st"), F.sum("_do").alias("_do"))
    counts = {"_repeated": F.when(seen & (F.col("_n") > 1), F.col("_n")), "_lines": F.when(seen, F.col("_n")), "_st": F.when(seen, F.col("_st")), "_do": F.when(seen, F.col("_do")), "_blank": F.when(~seen, F.col("_n")), "_every": F.col("_n")}
    y = y.groupBy("_k").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in counts.items()])
    st, do = _mode_scores(*[F.col(c) for c in counts])
    apart, mode = F.abs(st - do), _mode(st, do)
    sure = F.when(mode == "uncertain", F.greatest(F.lit(0.35), 0.55 - apart)).otherwise(F.least(F.lit(0.98), 0.58 + apart * 0.65))
    return y.select(F.col("_k").alias(key), mode.alias("mode"), F.round(st, 3).alias("stream"), F.round(do, 3).alias("document"), F.round(sure, 3).alias("confidence"))


def _observed(x: DataFrame, key: str, width: int) -> DataFrame:
    """Nonblank lines with features, counts, mode, and kinds, strength and local context of pattern breaks."""
    seen, line = ~F.col("blank"), F.col("line")
    s, d = _looks(line)
    y = x.withColumns({"tpl": F.when(seen, F.xxhash64(template(line))), "feats": F.when(seen, hits(line)), "_s": F.when(seen, s), "_d": F.when(seen, d)})
    order, text = Window.partitionBy(key).orderBy("line_no"), Window.partitionBy(key)
    beside = F.when(seen, F.struct("tpl", "delimiter", "indent"))
    near = F.concat(F.collect_list(beside).over(order.rowsBetween(-width, -1)), F.collect_list(beside).over(order.rowsBetween(1, width)))
    y = y.withColumns({"_near": near, "_every": F.count(F.lit(1)).over(text)}).where(seen)
    y = y.withColumns({"_lines": F.count(F.lit(1)).over(text), "_own": F.count(F.lit(1)).over(Window.partitionBy(key, "tpl")), "exact_lines": F.count(F.lit(1)).over(Window.partitionBy(key, "line")), "_first": F.min("line_no").over(Window.partitionBy(key, "tpl")), "_previous": F.lag("tpl").over(order)})
    y = y.withColumns({
        "_repeated": F.sum(F.when(F.col("_own") > 1, 1).otherwise(0)).over(text), "_st": F.sum("_s").over(text), "_do": F.sum("_d").over(text),
        "_in_block": F.count(F.lit(1)).over(Window.partitionBy(key, "block")), "_own_in_block": F.count(F.lit(1)).over(Window.partitionBy(key, "block", "tpl")),
        "_from": F.count(F.lit(1)).over(Window.partitionBy(key, "_previous")), "_step": F.count(F.lit(1)).over(Window.partitionBy(key, "_previous", "tpl")),
    })
    y = y.withColumn("_top", F.max("_own_in_block").over(Window.partitionBy(key, "block")))

    def most(field: str) -> Column:
        """How many neighbours have the commonest value that is not the line's own."""
        other = F.filter(F.transform("_near", lambda v: v[field]), lambda v: v != F.col(field))
        return F.coalesce(F.array_max(F.transform(other, lambda v: F.size(F.filter(other, lambda u: u == v)))), F.lit(0))

    y = y.withColumns({"_m": most("tpl"), "_md": most("delimiter"), "_mi": most("indent"), "_k": F.size("_near")})
    often = F.col("_repeated") >= 0.35 * F.col("_lines")
    found = {
        "neighbours": (F.col("_k") >= 3) & (5 * F.col("_m") >= 3 * F.col("_k")), "section": (F.col("_in_block") >= 5) & (F.col("_own_in_block") == 1) & (F.col("_top") >= 3),
        "transition": F.col("_previous").isNotNull() & (F.col("_step") == 1) & (F.col("_from") >= 3), "delimiter": (F.col("_k") >= 4) & (4 * F.col("_md") >= 3 * F.col("_k")),
        "indentation": (F.col("_k") >= 4) & (4 * F.col("_mi") >= 3 * F.col("_k")), "rare": (F.col("_own") == 1) & often, "introduced": (F.col("_own") <= 2) & often & (F.col("_first") == F.col("line_no")),
    }
    near_share = F.when(F.col("_k") > 0, _share(F.col("_m"), F.col("_k")))
    worth = {"neighbours": F.when(F.col("_k") > 0, 6200 + _share(F.col("_m"), F.col("_k"), 2800)), "section": F.lit(6600), "transition": F.lit(5800), "delimiter": F.lit(4200), "indentation": F.lit(3600), "rare": F.lit(2800)}
    local = {"neighbours": near_share, "section": _share(F.col("_top"), F.col("_in_block")), "transition": F.lit(6500)}

    def largest(values: dict[str, Column]) -> Column:
        return F.greatest(F.lit(0), *[F.when(found[kind], v).otherwise(0) for kind, v in values.items()])

    stream, document = _mode_scores(*[F.col(c) for c in ("_repeated", "_lines", "_st", "_do")], F.col("_every") - F.col("_lines"), F.col("_every"))
    y = y.withColumns({"kinds": F.array_compact(F.array(*[F.when(c, F.lit(kind)) for kind, c in found.items()])), "break_strength": largest(worth).cast("long"), "local": largest(local).cast("long"), "mode": _mode(stream, document)})
    return y.withColumnRenamed("_own", "template_lines").withColumn("repeated_share", F.col("_repeated") / F.col("_lines"))


def breaks(x: DataFrame, key: str, width: int = 4) -> DataFrame:
    """key, line_no, kind, strength, local of every pattern break.

    Kinds: of the neighbouring lines' templates, the section's, the sequence's, the neighbours'
    delimiter or indentation; templates that stand once in a text of repeated ones (rare), and
    where they first stand (introduced). Neighbours are ``width`` lines each way, blank ones counted
    in the distance and then left out.
    """
    return _observed(x, key, width).select(key, "line_no", F.explode("kinds").alias("kind"), (F.col("break_strength") / 10000).alias("strength"), (F.col("local") / 10000).alias("local"))


def scored(x: DataFrame, key: str, width: int = 4) -> DataFrame:
    """key, line_no, line, score, level, confidence, roles, parts (struct) and kinds of every nonblank line."""
    y = _observed(x, key, width).join(novelty(x, key), [key, "line_no"], "left").withColumn("novelty", F.round(F.coalesce("novelty", F.lit(0.0)) * 10000).cast("long"))
    severe, n = severity(F.col("feats")), F.col("template_lines")
    forbids = F.exists("feats", lambda f: f["feature"] == "prohibition")
    parts = {
        "pattern_break": F.col("break_strength"), "concrete": strength(F.col("feats")), "severity": severe, "novelty": F.col("novelty"), "local": F.col("local"),
        "rarity": F.round(F.when(F.col("repeated_share") >= 0.25, 10000.0).otherwise(1200.0) / F.sqrt(n)),
        "repetition": F.when((severe > 0) | forbids, F.least(F.lit(10000.0), F.round(2000 * F.log2(n + 1)))).otherwise(0),
        "ambiguity": F.when((F.size("feats") == 0) & (F.col("break_strength") < 4500), F.when(F.col("mode") == "uncertain", 5500).otherwise(2800)).otherwise(0),
    }
    y = y.withColumn("_p", F.struct(*[c.cast("long").alias(name) for name, c in parts.items()])).withColumn("_forbids", forbids)
    total = F.floor((sum(w * F.col(f"_p.{name}") for name, w in L.WEIGHTS.items()) + 50) / 100)
    total = F.when(F.col("_p.severity") >= L.SEVERE, F.greatest(total, F.lit(L.SEVERE_FLOOR))).otherwise(total)
    total = F.when(F.col("_forbids"), F.greatest(total, F.lit(L.PROHIBITION_FLOOR))).otherwise(total)
    y = y.withColumn("_t", F.least(F.lit(10000), F.greatest(F.lit(0), total)).cast("long"))
    level = F.when(F.col("_t") >= L.ATTENTION, "attention").when(F.col("_t") >= L.NOTABLE, "notable").otherwise("context")
    own = F.array_distinct(F.concat(F.transform("feats", lambda f: f["role"]), F.array_compact(F.array(F.when(F.col("break_strength") >= 4200, "pattern-break"), F.when((n > 1) | (F.col("exact_lines") > 1), "repeated")))))
    y = y.withColumn("roles", own).withColumn("roles", F.when(F.size("roles") > 0, F.col("roles")).otherwise(F.array(F.when(F.col("mode") == "uncertain", "uncertain").otherwise("context"))))
    # novelty is reliable from 0.7 * 48 + 7 bytes on
    signs = [F.col("break_strength") >= 4500, F.size("feats") > 0, F.col("exact_lines") > 1, n > 1, F.octet_length("line") - 7 >= 0.7 * 48]
    sure = F.least(F.lit(98), 42 + 12 * sum(c.cast("int") for c in signs) + F.when(F.size("kinds") > 1, 8).otherwise(0))
    return y.select(key, "line_no", "line", (F.col("_t") / 10000).alias("score"), level.alias("level"), (sure / 100).alias("confidence"), "roles", F.col("_p").alias("parts"), "kinds")


def findings(x: DataFrame, key: str, width: int = 4) -> DataFrame:
    """key, line_no, score, level, confidence, kind, title, rank of lines worth reading, best first, then by line.

    Lines are left out whose level is context and that have no role but context, uncertain or repeated.
    """
    y = scored(x, key, width).where((F.col("level") != "context") | F.exists("roles", lambda r: ~r.isin("context", "uncertain", "repeated")))
    kind = F.coalesce(F.filter("roles", lambda r: r != "repeated")[0], F.lit("observation"))
    title = F.coalesce(*[F.when(F.array_contains("roles", r), F.lit(t)) for r, t in zip(ROLES, _TITLES)], F.lit("Line observation"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "line_no"))
    return y.select(key, "line_no", "score", "level", "confidence", kind.alias("kind"), title.alias("title"), rank.alias("rank"))


def evidence_pack(x: DataFrame, key: str, levels: tuple[str, ...] = ("attention",), pinned: DataFrame | None = None, representatives: bool = False, context: int = 0) -> DataFrame:
    """key, line_no, line, level, roles, reasons of the lines chosen for review; no text but theirs is in it.

    Chosen: lines of these levels, pinned ones (key, line_no), each template's first line, and up to
    ``context`` (at most 5) lines on both sides. Reasons are distinct and sorted; blank lines are left out.
    """
    y = scored(x, key).select(key, "line_no", "line", "level", "roles")
    chosen = y.where(F.col("level").isin(*levels)).select(key, "line_no", F.col("level").alias("reason"))
    if pinned is not None:
        own = pinned.select(key, "line_no").join(x.where(~F.col("blank")).select(key, "line_no"), [key, "line_no"], "left_semi")
        chosen = chosen.unionByName(own.withColumn("reason", F.lit("pinned")))
    if representatives:
        chosen = chosen.unionByName(templates(x, key).select(key, F.col("first_line").alias("line_no"), F.lit("representative").alias("reason")))
    reach = max(0, min(5, context))
    if reach:
        beside = F.explode(F.array(*[F.lit(i) for i in range(-reach, reach + 1) if i]))
        chosen = chosen.unionByName(chosen.select(key, "line_no").distinct().withColumn("_o", beside).select(key, (F.col("line_no") + F.col("_o")).alias("line_no"), F.lit("context").alias("reason")))
    chosen = chosen.groupBy(key, "line_no").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    return y.join(chosen, [key, "line_no"])
