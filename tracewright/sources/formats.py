"""Reading and writing the record formats: JSON, CSV, XML, YAML, TOML, ``.env``, SQL ``INSERT``.

Spark's own readers do what they can. Small configuration texts are parsed whole, a file to a row,
into JSON texts that ``parse_json`` or ``from_json`` turn into values.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable
from datetime import date, datetime, time

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.sources.quoted import quoted_records, read_quoted_csv

_FORBIDDEN = {"__proto__", "prototype", "constructor"}

#: Names whose values stay texts, whatever they look like.
_TEXT_NAMES = r"(?i)(^|[_\s-])(id|ids|zip|zipcode|postal|postcode|phone|mobile|tel|fax|code|sku|account)($|[_\s-])"


def _plain(value):
    if isinstance(value, dict):
        if _FORBIDDEN & value.keys():
            raise ValueError("unsafe key")
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value.isoformat() if isinstance(value, (datetime, date, time)) else value


def parse_env(text: str) -> dict[str, str]:
    """``KEY=value`` lines with quotes, comments and ``export``; a repeated key is an error."""
    out: dict[str, str] = {}
    line = re.compile(r"""[ \t]*(?:export[ \t]+)?([A-Za-z_][\w.-]*)[ \t]*=[ \t]*(?:"((?:[^"\\]|\\.)*)"|'([^']*)'|([^\n]*))[^\n]*(?:\n|\Z)""", re.S)
    at = 0
    while at < len(text):
        if m := re.compile(r"[ \t]*(#[^\n]*)?(?:\n|\Z)").match(text, at):
            if m.end() == at:
                break
            at = m.end()
            continue
        m = line.match(text, at)
        if not m:
            raise ValueError(f"bad line at {at}")
        if m[1] in out:
            raise ValueError(f"duplicate key {m[1]}")
        if m[2] is not None:
            out[m[1]] = re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t", "r": "\r"}.get(x[1], x[1]), m[2])
        else:
            out[m[1]] = m[3] if m[3] is not None else re.split(r"\s#", m[4])[0].strip()
        at = m.end()
    return out


_SQL_VALUE = re.compile(r"\s*(?:'((?:[^']|'')*)'|([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(NULL|TRUE|FALSE)\b|([^,()]+(?:\([^()]*\))?))\s*", re.I)
_INSERT = re.compile(r"\b(?:INSERT(?:\s+OR\s+\w+)?|REPLACE)\s+INTO\s+[\"`\[]?([\w.]+)[\"`\]]?\s*\(([^)]*)\)\s*VALUES\s*", re.I)


_SET = re.compile(r"\b(?:INSERT(?:\s+OR\s+\w+)?|REPLACE)\s+INTO\s+[\"`\[]?([\w.]+)[\"`\]]?\s+SET\s+", re.I)
_SET_NAME = re.compile(r"\s*[\"`\[]?(\w+)[\"`\]]?\s*=")
#: Comments, and quoted texts, in which there are none.
_NO_SQL = re.compile(r"'(?:[^']|'')*'|/\*.*?\*/|--[^\n]*", re.S)


def parse_inserts(text: str) -> list[dict]:
    """Rows of ``INSERT INTO t (columns) VALUES (...), (...)`` and ``INSERT INTO t SET a = 1, ...``; what is no literal is named as an expression."""
    rows = []
    text = _NO_SQL.sub(lambda m: m[0] if m[0][0] == "'" else " ", text)
    for m in _INSERT.finditer(text):
        names, at = [c.strip().strip('"`[]') for c in m[2].split(",")], m.end()
        while at < len(text) and text[at] == "(":
            at, row = at + 1, []
            while True:
                v = _SQL_VALUE.match(text, at)
                if not v:
                    raise ValueError(f"bad value at {at}")
                row.append(_sql_literal(v))
                at = v.end()
                if text[at : at + 1] != ",":
                    break
                at += 1
            if len(row) != len(names) or text[at : at + 1] != ")":
                raise ValueError(f"bad row at {at}")
            rows.append({"table": m[1], "row": dict(zip(names, row, strict=True))})
            at = re.compile(r"\)\s*,?\s*").match(text, at).end()
    for m in _SET.finditer(text):
        at, row = m.end(), {}
        while part := _SET_NAME.match(text, at):
            v = _SQL_VALUE.match(text, part.end())
            if not v:
                raise ValueError(f"bad value at {part.end()}")
            row[part[1]] = _sql_literal(v)
            at = v.end()
            if text[at : at + 1] != ",":
                break
            at += 1
        rows.append({"table": m[1], "row": row})
    return rows


def _sql_literal(v: re.Match):
    if v[1] is not None:
        return v[1].replace("''", "'")
    if v[2]:
        return json.loads(v[2].lstrip("+"))
    return {"NULL": None, "TRUE": True, "FALSE": False}[v[3].upper()] if v[3] else f"[SQL expression: {v[4].strip()}]"


def parse_yaml(text: str):
    """The first document; plain scalars by YAML 1.2 rules. Repeated keys, aliases and tags are errors."""
    import yaml  # gated: not every image has it

    def checked(node) -> None:
        if isinstance(node, yaml.MappingNode):
            names = [k.value for k, _ in node.value]
            if len(set(map(str, names))) < len(names):
                raise ValueError(f"duplicate key {next(n for n in names if names.count(n) > 1)}")
            for _, v in node.value:
                checked(v)
        elif isinstance(node, yaml.SequenceNode):
            for v in node.value:
                checked(v)

    for event in yaml.parse(text, Loader=yaml.BaseLoader):
        if isinstance(event, yaml.AliasEvent) or getattr(event, "anchor", None):
            raise ValueError("anchors and aliases are not read")
        if getattr(event, "tag", None):
            raise ValueError(f"tag {event.tag} is not read")
        if isinstance(event, yaml.DocumentEndEvent):
            break
    checked(yaml.compose(text, Loader=yaml.BaseLoader) if "\n---" not in text else next(yaml.compose_all(text, Loader=yaml.BaseLoader), None))
    data = next(iter(yaml.load_all(text, Loader=yaml.BaseLoader)), None)

    def typed(v):
        if isinstance(v, dict):
            return {k: typed(x) for k, x in v.items()}
        if isinstance(v, list):
            return [typed(x) for x in v]
        if v in ("true", "false"):
            return v == "true"
        if v in ("null", "~", ""):
            return None
        return json.loads(v) if isinstance(v, str) and re.fullmatch(r"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?", v) else v

    return typed(data)


PARSERS: dict[str, Callable] = {"json": json.loads, "toml": tomllib.loads, "env": parse_env, "sql": parse_inserts, "yaml": parse_yaml}


def to_toml(value: dict, above: tuple = ()) -> str:
    """A record as TOML: plain values first, then tables; nulls, which TOML lacks, are left out."""
    name = lambda k: k if re.fullmatch(r"[A-Za-z0-9_-]+", k) else json.dumps(k, ensure_ascii=False)

    def plain(v) -> str:
        if isinstance(v, list):
            return "[" + ", ".join(plain(x) for x in v if x is not None) + "]"
        if isinstance(v, dict):
            return "{" + ", ".join(f"{name(k)} = {plain(x)}" for k, x in v.items() if x is not None) + "}"
        return json.dumps(v, ensure_ascii=False).replace("\x7f", "\\u007F")

    lines = [f"{name(k)} = {plain(v)}" for k, v in value.items() if v is not None and not isinstance(v, dict)]
    for k, v in value.items():
        if isinstance(v, dict):
            path = (*above, name(k))
            lines += ["", f"[{'.'.join(path)}]", to_toml(v, path).rstrip("\n")]
    return "\n".join(lines).strip("\n") + "\n"


def to_yaml(value, depth: int = 0) -> str:
    """A value as YAML in block style; texts that could be read as something else are quoted."""
    pad = "  " * depth

    def scalar(v) -> str:
        if isinstance(v, str):
            bare = re.fullmatch(r"[A-Za-z_/][\w ./-]*", v) and v == v.strip() and v.lower() not in ("true", "false", "null", "yes", "no", "on", "off", "y", "n")
            return v if bare else json.dumps(v, ensure_ascii=False)
        return json.dumps(v)

    if isinstance(value, dict) and value:
        return "".join(f"{pad}{scalar(str(k))}:" + (f"\n{to_yaml(v, depth + 1)}" if isinstance(v, (dict, list)) and v else f" {to_yaml(v)}") for k, v in value.items())
    if isinstance(value, list) and value:
        return "".join(f"{pad}-" + (f"\n{to_yaml(v, depth + 1)}" if isinstance(v, (dict, list)) and v else f" {to_yaml(v)}") for v in value)
    return {"{}": "{}\n", "[]": "[]\n"}.get(json.dumps(value), scalar(value) + "\n")


WRITERS: dict[str, Callable] = {"json": lambda v: json.dumps(v, ensure_ascii=False), "toml": to_toml, "yaml": to_yaml}


def to_texts(df: DataFrame, kind: str) -> DataFrame:
    """``text``: every row as a document of a configuration format."""
    write = WRITERS[kind]

    def run(batches):
        for batch in batches:
            yield pa.record_batch({"text": pa.array([write(json.loads(v)) for v in batch.column("v").to_pylist()], pa.string())})

    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    return df.select(row.alias("v")).mapInArrow(run, "text string")


def detect(text: str) -> str:
    """The format of a text: the first of JSON, XML, SQL, TOML, env, CSV, YAML that it can be."""
    head = text.lstrip("﻿ \t\r\n")
    if re.search(r"^\s*(resource|variable|provider)\s+\"", text, re.M) or "{{ " in text and ".Values" in text:
        raise ValueError("unsupported: templated configuration")
    if head[:1] in ("{", "["):
        try:
            json.loads(text)
            return "json"
        except ValueError:
            pass
    if head.startswith("<"):
        return "xml"
    if _INSERT.search(text):
        return "sql"
    rows = [x for x in head.split("\n") if x.strip() and not x.lstrip().startswith("#")]
    if rows and all(re.match(r"\s*(export\s+)?[A-Z_][A-Z0-9_]*=", x) for x in rows):
        return "env"
    if re.search(r"^\s*\[+[\w.\"-]+\]+\s*$|^[\w.-]+ = ", text, re.M):
        return "toml"
    if rows and separator(rows) and not re.match(r"^[\w-]+:(\s|$)", rows[0]):
        return "csv"
    return "yaml"


def separator(rows: list[str]) -> str | None:
    """The separator that cuts the first rows into the same number of parts, two or more."""
    widths = {s: {len(re.findall(re.escape(s) + r'(?=(?:[^"]*"[^"]*")*[^"]*$)', r)) for r in rows[:20]} for s in (",", ";", "\t")}
    fit = [(min(w), s) for s, w in widths.items() if len(w) == 1 and min(w) > 0]
    return max(fit)[1] if fit else None


def read_texts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """file, value (JSON text), error of every file of a configuration format."""
    return _parsed(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"), kind)


def _parsed(texts: DataFrame, kind: str) -> DataFrame:
    parse = PARSERS[kind]

    def run(batches):
        for batch in batches:
            values, errors = [], []
            for text in batch.column("value").to_pylist():
                try:
                    values.append(json.dumps(_plain(parse(text)), ensure_ascii=False))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  the row says what was wrong with its file
                    values.append(None)
                    errors.append(f"{kind}: {e}"[:300])
            yield pa.record_batch({"file": batch.column("file"), "value": pa.array(values, pa.string()), "error": pa.array(errors, pa.string())})

    return texts.mapInArrow(run, "file string, value string, error string")


def read_inserts(spark: SparkSession, path: str) -> DataFrame:
    """table, row (JSON text) of every inserted row.

    A file is read by many tasks, a statement to a row. If there are comments, which may hold quotes, each
    file is read whole, by one task.
    """
    lines = spark.read.text(path)
    noted = lines.where(F.col("value").contains("--") | F.col("value").contains("/*"))
    texts = spark.read.text(path, wholetext=True) if not noted.isEmpty() else quoted_records(spark, path, "'", ";").select(F.col("text").alias("value"))
    parsed = _parsed(texts.select(F.lit("").alias("file"), "value"), "sql")
    rows = F.explode(F.from_json("value", "array<struct<table:string,row:string>>"))
    return parsed.where("error is null").select(rows.alias("r")).select("r.table", "r.row")


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Elements as rows: attributes ``@name``, text ``#text``, all values texts."""
    return spark.read.format("xml").options(rowTag=row_tag, attributePrefix="@", valueTag="#text", inferSchema="false", ignoreNamespace="true").load(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, sep: str | None = None, typed: bool = True) -> DataFrame:
    """CSV with a header, each file read by many tasks; the separator is found in the first lines unless given. Ragged rows fail."""
    if sep is None:
        sep = separator([r[0] for r in spark.read.text(path).limit(20).collect() if r[0].strip()]) or ","
    df = read_quoted_csv(spark, path, sep)
    return coerced(df) if typed else df


def coerced(df: DataFrame) -> DataFrame:
    """Columns whose every text is a number or boolean become one; ids, codes and leading zeros stay texts."""
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    if not texts:
        return df
    tests = []
    for i, c in enumerate(texts):
        v = F.trim(F.col(f"`{c}`"))
        filled = v != ""
        tests += [F.count_if(filled).alias(f"n{i}"), F.count_if(filled & v.rlike(r"^-?(0|[1-9]\d{0,14})(\.\d+)?$")).alias(f"d{i}"), F.count_if(filled & v.rlike(r"^-?(0|[1-9]\d{0,14})$")).alias(f"i{i}"), F.count_if(v.isin("true", "false")).alias(f"b{i}")]
    row = df.agg(*tests).first()
    kinds = {}
    for i, c in enumerate(texts):
        if row[f"n{i}"] and not re.search(_TEXT_NAMES, c):
            kinds[c] = "boolean" if row[f"b{i}"] == row[f"n{i}"] else "bigint" if row[f"i{i}"] == row[f"n{i}"] else "double" if row[f"d{i}"] == row[f"n{i}"] else None
    return df.select(*[F.trim(F.col(f"`{c}`")).try_cast(kinds[c]).alias(c) if kinds.get(c) else F.col(f"`{c}`") for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with nested values as JSON and formulas made harmless."""
    from tracewright.operators.compare import guarded

    flat = df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f"`{f.name}`") for f in df.schema.fields])
    guarded(flat).write.csv(path, header=True, quote='"', escape='"', mode="overwrite")


def to_inserts(df: DataFrame, name: str) -> DataFrame:
    """``statement``: an INSERT for each row."""
    def literal(f):
        c = F.col(f"`{f.name}`")
        text = c.cast("string")
        quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
        return F.coalesce(text if f.dataType.typeName() in ("integer", "long", "double", "boolean", "short", "decimal", "float") else quoted, F.lit("NULL"))

    names = ", ".join(df.columns)
    return df.select(F.concat(F.lit(f"INSERT INTO {name} ({names}) VALUES ("), F.concat_ws(", ", *[literal(f) for f in df.schema.fields]), F.lit(");")).alias("statement"))
