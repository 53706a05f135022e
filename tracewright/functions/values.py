"""Value semantics of record transformations as JVM-side Column expressions.

Nothing here throws on bad data: what cannot be converted stays as it is or becomes null, as the
docstrings say, with ANSI mode on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_SPACE = r"[\s\x{FEFF}]"

#: Accepted date shapes, pattern and parse format.
DATE_SHAPES = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"),
    (r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"),
)
#: Output formats of dates by mode.
DATE_FORMATS = {"isoDate": "yyyy-MM-dd", "usSlash": "MM/dd/yyyy", "euSlash": "dd/MM/yyyy", "yearMonth": "yyyy-MM", "year": "yyyy"}


def number(c: Column) -> Column:
    """A text's number; null if it is none."""
    text = c.cast("string")
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def boolean(c: Column) -> Column:
    """True and false for exactly these words; else null."""
    return F.when(c == "true", F.lit(True)).when(c == "false", F.lit(False))


def trimmed(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def collapsed(c: Column) -> Column:
    """Trimmed, inner white space one blank."""
    return F.regexp_replace(trimmed(c), rf"(?U){_SPACE}+", " ")


def title(c: Column) -> Column:
    """Lower case, then a capital at each ASCII word's start."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\w+|\W+)"), 1)
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")


def cased(c: Column, mode: str) -> Column:
    """Case and trim modes joined by ``+``, applied in order."""
    steps = {"upper": F.upper, "lower": F.lower, "title": title, "trim": trimmed}
    for step in mode.split("+"):
        c = steps[step](c)
    return c


def iso_date(c: Column) -> Column:
    """The date of a text in one of the four shapes (day first with slashes or dashes); else null."""
    text = trimmed(c)
    out = F.lit(None).cast("date")
    for pattern, form in reversed(DATE_SHAPES):
        out = F.when(text.rlike(pattern), F.try_to_date(text, form)).otherwise(out)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")).otherwise(out)


def ambiguous_date(c: Column) -> Column:
    """Whether day and month could be exchanged."""
    day, month = F.substring(c, 1, 2).try_cast("int"), F.substring(c, 4, 2).try_cast("int")
    return c.rlike(r"^\d{2}[/-]\d{2}[/-]\d{4}$") & (day <= 12) & (month <= 12) & (day != month)


def date_text(c: Column, mode: str) -> Column:
    return F.date_format(iso_date(c), DATE_FORMATS[mode])


def rounded(x: Column, mode: str, decimals: int = 2) -> Column:
    """Round a double to decimals by one of seven rules."""
    scale = F.lit(10.0**decimals)
    y = x * scale
    half = F.lit(0.5)
    low = F.floor(y).cast("double")
    near = F.abs(y - low - half) < 1e-9
    rules = {
        "none": x * 1.0,
        "half-up": F.floor(y + half) / scale,
        "half-away": F.signum(y) * F.floor(F.abs(y) + half) / scale,
        "half-even": F.when(near, F.when(low % 2 == 0, low).otherwise(low + 1)).otherwise(F.floor(y + half).cast("double")) / scale,
        "floor": F.floor(y) / scale,
        "ceil": F.ceil(y) / scale,
        "trunc": F.when(y < 0, F.ceil(y)).otherwise(F.floor(y)) / scale,
    }
    return rules[mode].cast("double")


def number_text(c: Column, most: int = 6) -> Column:
    """A number as short text, without trailing zeros."""
    shown = F.format_string(f"%.{most}f", c.cast("double"))
    return F.regexp_replace(F.regexp_replace(shown, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def quantity(c: Column, factor: float, unit: str) -> Column:
    """``512Mi`` scaled by a factor, rounded to 6 digits, with another unit; null if it has no number."""
    value = F.regexp_extract(c, r"^\s*([+-]?\d+(?:\.\d+)?)\s*([A-Za-z%]*)\s*$", 1)
    scaled = F.floor(value.try_cast("double") * factor * 1e6 + 0.5) / 1e6
    return F.when(value != "", F.concat(number_text(scaled), F.lit(unit)))


def phone(c: Column, country: str | None = None) -> Column:
    """``+`` and digits. Without an international prefix a country code must be given; else null."""
    text = trimmed(c)
    digits = F.regexp_replace(text, r"\D", "")
    local = F.concat(F.lit(f"+{country}"), F.regexp_replace(digits, "^0+", "")) if country else F.lit(None).cast("string")
    out = F.when(text.startswith("+"), F.concat(F.lit("+"), digits)).when(text.startswith("00"), F.concat(F.lit("+"), F.substring(digits, 3, 40))).otherwise(local)
    return F.when(F.length(digits).between(7, 15), out)


def decoded_key(c: Column) -> Column:
    """``+`` as blank and percent signs decoded; only the blanks where that fails."""
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def between(c: Column, prefix: str, suffix: str) -> Column:
    """The text between the first prefix and the next suffix; empty if one is missing."""
    start = F.locate(prefix, c) if prefix else F.lit(1)
    rest = F.substring(c, start + len(prefix), F.length(c)) if prefix else c
    stop = F.locate(suffix, rest) if suffix else F.length(rest) + 1
    return F.when((start > 0) & (stop > 0), F.substring(rest, F.lit(1), stop - 1)).otherwise("")


def split_at(c: Column, separator: str) -> Column:
    """Split at a literal separator; empty parts stay."""
    return F.split(c, F.lit("\\Q" + separator + "\\E"), -1)


def fnv1a(codes: Column, seed: int) -> Column:
    """32-bit FNV-1a over an array of code units, as long."""
    return F.aggregate(codes, F.lit(seed).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def _units(data: Column, width: int) -> Column:
    digits = F.hex(data)
    n = (F.length(digits) / (2 * width)).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substring(digits, i * (2 * width) + 1, F.lit(2 * width)), 16, 10).cast("long"))


def fingerprint(text: Column) -> Column:
    """16 hex digits: two FNV-1a passes over UTF-16 code units. Null has none."""
    codes = _units(F.encode(text, "UTF-16BE"), 2)
    # The two seeds.
    parts = [F.lpad(F.lower(F.hex(fnv1a(codes, seed))), 8, "0") for seed in (0x811C9DC5, 0x01000193)]
    return F.concat(*parts)


def text_hash(text: Column) -> Column:
    """8 hex digits: FNV-1a over UTF-8 bytes."""
    return F.lpad(F.lower(F.hex(fnv1a(_units(F.encode(text, "UTF-8"), 1), 0x811C9DC5))), 8, "0")
