"""Documents of any shape: their nodes, leaves, record sets and schema.

A document is a VARIANT (``parsed`` makes one of JSON text or of a typed row). Its nodes are taken
apart level by level with ``variant_explode``: each level adds its nodes to the same flow of rows, so that all are
made in one pass. Every further step is a count of nodes by path.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels that are taken apart at most; a document that is deeper is an error, not cut.
DEEPEST = 64
#: A record set has so many rows, of which this share are records; a shared field is on this share.
SET_ROWS, SET_SHARE, SHARED = 2, 0.8, 0.5
#: Types in order.
TYPES = ("null", "boolean", "integer", "number", "string", "array", "object")
#: Distinct texts up to which a schema lists them.
MOST_VALUES = 12


def parsed(column: Column | str, kind: str) -> Column:
    """A VARIANT of a JSON text (null if it is none), a typed record, or a variant."""
    c = F.col(column) if isinstance(column, str) else column
    return F.try_parse_json(c) if kind == "string" else c if kind == "variant" else F.to_variant_object(c)


#: Types by the first letters of a variant's own type; numbers, which are not here, are told apart by their value.
_KINDS = {"OBJ": "object", "ARR": "array", "VOI": "null", "BOO": "boolean", "BIG": "integer", "STR": "string", "DAT": "string", "TIM": "string", "BIN": "string", "UUI": "string"}


def _type(value: Column) -> Column:
    """The JSON type of a variant; whole numbers are integers, whatever digits they are written with.

    The variant's own type is named once: Spark evaluates it at each mention, and for a record it is its whole schema.
    """
    whole = F.try_variant_get(value, "$", "double")
    known = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    number = F.when(whole == F.floor(whole), "integer").when(whole.isNotNull(), "number").otherwise("string")
    return F.coalesce(F.try_element_at(known, F.substring(F.schema_of_variant(value), 1, 3)), number)


def _depth(root: DataFrame) -> tuple[int, bool]:
    """How deep records and arrays are nested at least, and whether that is sure: an array of several types hides what it holds."""
    kinds = root.select(F.schema_of_variant("value").alias("k"))
    plain = F.when(F.contains("k", F.lit("`")), F.regexp_replace("k", "`(?:[^`]|``)*`", "")).otherwise(F.col("k"))  # names that are not plain are quoted
    shapes = kinds.select(F.regexp_replace(plain, "[^<>]+", "").alias("s"), F.contains("k", F.lit("VARIANT")).alias("v")).distinct()
    step = lambda a, c: F.when(c == "<", F.struct((a["now"] + 1).alias("now"), F.greatest(a["most"], a["now"] + 1).alias("most"))).otherwise(F.struct((a["now"] - F.when(c == ">", 1).otherwise(0)).alias("now"), a["most"].alias("most")))
    most = F.reduce(F.split("s", ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])
    row = shapes.agg(F.max(most).alias("d"), F.coalesce(F.max("v"), F.lit(False)).alias("v")).first()
    return row["d"] or 0, not row["v"]


def _step(key: Column) -> Column:
    """A field in a path: as it is, or quoted."""
    return F.when(key.rlike(r"^[A-Za-z_]\w*$"), F.concat(F.lit("."), key)).otherwise(F.concat(F.lit('["'), F.replace(key, F.lit('"'), F.lit('\\"')), F.lit('"]')))


def nodes(df: DataFrame, key: list[str], column: str) -> DataFrame:
    """The key, ``at`` (path with indexes), ``path`` (``[]`` for any index), ``above`` (the parent's ``at``), ``name``, ``depth``, ``type``, ``text`` (of scalars) and ``value``.

    A document that is null, or no JSON, has no node. Keys of records are told apart by case.
    """
    kind = df.schema[column].dataType.typeName()
    doc = parsed(F.col(f"`{column}`"), kind if kind in ("string", "variant") else "struct")
    root = df.select(*[F.col(f"`{k}`") for k in key], doc.alias("value")).where("value IS NOT NULL")
    out = root.select(*key, F.lit("$").alias("at"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("above"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("depth"), _type(F.col("value")).alias("type"), "value")
    (least, sure), depth = _depth(root), 0
    while depth < least or not sure and not out.where((F.col("depth") == depth) & F.col("type").isin("object", "array")).isEmpty():
        if depth == DEEPEST:
            raise ValueError(f"a document is deeper than {DEEPEST} levels")
        out, depth = _opened(out, key, depth), depth + 1
    text = F.when(~F.col("type").isin("object", "array", "null"), F.try_variant_get("value", "$", "string"))
    return out.select(*key, "at", "path", "above", "name", "depth", "type", text.alias("text"), "value")


def _opened(level: DataFrame, key: list[str], depth: int) -> DataFrame:
    """All nodes to a depth, and what the records and arrays of that depth hold: one flow of rows, read once."""
    inside = F.when((F.col("depth") == depth) & F.col("type").isin("object", "array"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    held = level.withColumn("_in", F.explode(inside)).withColumnRenamed("value", "_whole").withColumn("_opened", F.when(F.col("_in"), F.col("_whole")))
    each = held.lateralJoin(level.sparkSession.tvf.variant_explode_outer(F.col("_opened").outer())).where("NOT _in OR pos IS NOT NULL")
    field_, index = _step(F.col("key")), F.col("pos").cast("string")
    step = F.when(F.col("key").isNotNull(), field_).otherwise(F.concat(F.lit("["), index, F.lit("]")))
    wild = F.when(F.col("key").isNotNull(), field_).otherwise(F.lit("[]"))
    made = {
        "at": F.concat("at", step), "path": F.concat("path", wild), "above": F.col("at"), "name": F.col("key"), "depth": F.lit(depth + 1), "type": _type(F.col("value")), "value": F.col("value"),
    }
    kept = {name: F.col("_whole" if name == "value" else name) for name in made}
    return each.select(*[F.col(k) for k in key], *[F.when(F.col("_in"), new).otherwise(kept[name]).alias(name) for name, new in made.items()])


def leaf_profile(found: DataFrame, records: int | None = None) -> DataFrame:
    """path, types, records, present, null, empty, whitespace of each leaf path of ``nodes``.

    ``records`` are the places where the leaf could be: the records at its parent's path (rows for
    leaves of documents themselves). Arrays and records are no leaves.
    """
    counts = found.groupBy("path", "type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("type = 'string' AND text = ''")).alias("empty"), F.count_if(F.col("text").rlike(r"^\s+$")).alias("whitespace"))
    # from here on a row for each path and type
    inner = F.col("type").isin("object", "array")
    parent = F.when(inner, F.col("path")).otherwise(F.regexp_replace("path", r"(\[\]|\.\w+|\[\"(?:[^\"\\]|\\.)*\"\])$", ""))
    held = F.sum(F.when(F.col("type") == "object", F.col("n")).when(F.col("type") == "array", 0)).over(Window.partitionBy("_parent"))
    stats = counts.withColumn("_parent", parent).withColumn("_held", held).where(~inner).groupBy("path").agg(
        F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"),
        F.max("_held").alias("_held"),
        F.sum("n").alias("present"),
        F.sum(F.when(F.col("type") == "null", F.col("n")).otherwise(0)).alias("null"),
        F.sum("empty").alias("empty"),
        F.sum("whitespace").alias("whitespace"),
    )
    places = F.when(F.col("path").endswith("[]"), F.col("present")).otherwise(F.coalesce("_held", "present"))
    return stats.select("path", "types", places.alias("records"), "present", "null", "empty", "whitespace")


def record_sets(found: DataFrame, key: list[str]) -> DataFrame:
    """The key, ``at``, ``path``, ``rows``, ``shared``, ``score``, ``rank``: arrays of records in each document, the best first.

    An array is one if it has two elements or more, four of five are records, and these share a field with a
    plain value. More records weigh most, then little depth, then shared fields.
    """
    arrays = found.where("type = 'array'").select(*key, "at", "path", "depth")
    items = found.where("name IS NULL AND depth > 0").groupBy(*key, F.col("above").alias("at")).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.expr("type = 'object'")).alias("rows"))
    holder = F.regexp_replace("above", r"\[\d+\]$", "")
    plain = found.where("name IS NOT NULL AND type NOT IN ('object', 'array')").where(F.col("above").rlike(r"\[\d+\]$"))
    fields = plain.groupBy(*key, holder.alias("at"), "name").agg(F.count(F.lit(1)).alias("n"))
    sets = arrays.join(items, [*key, "at"]).where((F.col("items") >= SET_ROWS) & (F.col("rows") >= SET_SHARE * F.col("items")))
    shared = sets.join(fields, [*key, "at"]).where(F.col("n") >= SHARED * F.col("rows")).groupBy(*key, "at", "path", "depth", "rows").agg(F.count(F.lit(1)).alias("shared"))
    scored = shared.withColumn("score", F.col("rows") * 100 - F.col("depth") * 10 + F.col("shared"))
    rank = F.expr(f"row_number() OVER (PARTITION BY {', '.join(f'`{k}`' for k in key)} ORDER BY score DESC, depth, at)")
    return scored.withColumn("rank", rank).select(*key, "at", "path", "rows", "shared", "score", "rank")


def records(found: DataFrame, key: list[str], path: str) -> DataFrame:
    """The key, ``at`` and ``record`` (a variant) of each record of the arrays at a wildcard path."""
    return found.where((F.col("path") == path + "[]") & (F.col("type") == "object")).select(*key, "at", F.col("value").alias("record"))


@dataclass
class Shape:
    """What values at a path are: types, for records their fields and which are required, for arrays their items."""

    types: list[str] = field(default_factory=list)
    fields: dict[str, Shape] = field(default_factory=dict)
    required: list[str] = field(default_factory=list)
    items: Shape | None = None
    values: list[str] | None = None

    def to_dict(self) -> dict[str, Any]:
        return {"types": self.types, "fields": {k: v.to_dict() for k, v in self.fields.items()}, "required": self.required, "items": self.items and self.items.to_dict(), "values": self.values}

    @classmethod
    def from_dict(cls, d: dict[str, Any] | None) -> Shape | None:
        return d and cls(d["types"], {k: cls.from_dict(v) for k, v in d["fields"].items()}, d["required"], cls.from_dict(d["items"]), d["values"])

    def schema(self, closed: bool = False) -> dict[str, Any]:
        """As JSON Schema; ``closed`` refuses fields that are not named."""
        each = [self._one(t, closed) for t in self.types]
        return each[0] if len(each) == 1 else {"anyOf": each} if each else {}

    def _one(self, kind: str, closed: bool) -> dict[str, Any]:
        if kind == "object":
            return {"type": kind, "required": sorted(self.required), "properties": {k: v.schema(closed) for k, v in sorted(self.fields.items())}, "additionalProperties": not closed}
        if kind == "array":
            return {"type": kind, "items": self.items.schema(closed) if self.items else {}}
        return {"type": kind, **({"enum": self.values} if kind == "string" and self.values else {})}


def shape_counts(found: DataFrame) -> DataFrame:
    """path, parent, name, type, n: the counts that a schema is made of, mergeable by adding; one row for each path and type."""
    parent = F.regexp_replace("path", r"(\[\]|\.\w+|\[\"(?:[^\"\\]|\\.)*\"\])$", "")
    return found.groupBy("path", F.when(F.col("depth") > 0, parent).alias("parent"), "name", "type").agg(F.count(F.lit(1)).alias("n"))


def shape(found: DataFrame, values: bool = False) -> Shape:
    """The union of all documents' shapes. Only the counts by path and type reach the driver.

    A field is required if every record at its parent's path has it, be it null. Whole and other numbers
    merge to ``number``; other types stand side by side. With ``values``, texts of up to
    ``MOST_VALUES`` distinct ones are listed.
    """
    counts = shape_counts(found).collect()  # a row for each path and type
    return _shape(counts, _listed(found.where("type = 'string'").select("path", "text")) if values else {})


def _listed(texts: DataFrame) -> dict[str, list[str]]:
    """The texts of each path that has few of them, and each of these twice or more on average."""
    counts = texts.groupBy("path", "text").agg(F.count(F.lit(1)).alias("n"))
    few = counts.groupBy("path").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n")).where((F.col("d") <= MOST_VALUES) & (F.col("n") >= 2 * F.col("d")))
    return {r["path"]: r["v"] for r in counts.join(few.select("path"), "path").groupBy("path").agg(F.sort_array(F.collect_set("text")).alias("v")).collect()}


def _shape(counts: list, listed: dict[str, list[str]]) -> Shape:
    """The shape of counts by path and type."""
    by_path: dict[str, Shape] = {}
    records_, there = {}, {}
    for r in counts:
        by_path.setdefault(r["path"], Shape()).types.append(r["type"])
        there[r["path"]] = there.get(r["path"], 0) + r["n"]
        if r["type"] == "object":
            records_[r["path"]] = r["n"]
    for s in by_path.values():
        s.types = [t for t in TYPES if t in s.types and not (t == "integer" and "number" in s.types)]
    for r in {r["path"]: r for r in counts}.values():
        if r["parent"] is None:
            continue
        up, own = by_path[r["parent"]], by_path[r["path"]]
        own.values = listed.get(r["path"])
        if r["name"] is None:
            up.items = own
        else:
            up.fields[r["name"]] = own
            if there[r["path"]] == records_.get(r["parent"]):
                up.required.append(r["name"])
    return by_path.get("$", Shape())


#: Spark types whose JSON type needs no variant: it follows from the type, of numbers from their value.
_PLAIN = {"boolean": "boolean", "byte": "integer", "short": "integer", "integer": "integer", "long": "integer", "float": "number", "double": "number", "decimal": "number", "string": "string", "date": "string"}
#: Counts in one aggregate, so that it still compiles.
_COUNTS = 60


def shape_of_rows(df: DataFrame, columns: list[str], values: bool = False) -> Shape:
    """``shape`` of the record that these columns make in each row, read from the typed columns.

    The paths are those of the Spark schema, so an aggregate counts their types and no node is made. Rows
    with maps, variants or times, whose paths or texts only a variant shows, are taken apart by ``nodes``.
    """
    from pyspark.sql.types import ArrayType, StructType

    slim = df.select(*[F.col(f"`{c}`") for c in columns])
    kinds: list[tuple[str, str | None, str | None, str, Column]] = []  # path, parent, name, type, how many in a row
    texts: dict[str, tuple[Column, bool]] = {}  # path -> the texts in a row, whether they are an array

    def step(name: str) -> str:
        return f".{name}" if name.isascii() and name.isidentifier() else '["' + name.replace('"', '\\"') + '"]'

    def walk(path: str, parent: str | None, name: str | None, kind, v: Column, many: bool, held: Column) -> bool:
        """Counts at a path; ``v`` is its value in a row, there if ``held``, or an array of them. False for a type that is not plain."""
        number = lambda test: F.size(F.filter(v, test)) if many else (held & test(v)).cast("int")
        add = lambda t, test: kinds.append((path, parent, name, t, number(test)))
        there = lambda x: x.isNotNull()
        add("null", lambda x: x.isNull())
        if isinstance(kind, StructType):
            add("object", there)
            inner = lambda f: F.transform(F.filter(v, there), lambda x: x[f]) if many else v[f]
            return all([walk(path + step(f.name), path, f.name, f.dataType, inner(f.name), many, held & v.isNotNull()) for f in kind.fields])
        if isinstance(kind, ArrayType):
            add("array", there)
            items = F.flatten(F.filter(v, there)) if many else F.coalesce(v, F.array().cast(kind))
            return walk(path + "[]", path, None, kind.elementType, items, True, held)
        plain = _PLAIN.get(kind.typeName())
        if plain == "number":
            whole = lambda x: F.coalesce(x.cast("double") == F.floor(x.cast("double")), F.lit(False))
            add("integer", whole)
            add("number", lambda x: x.isNotNull() & ~whole(x))
        elif plain:
            add(plain, there)
            if plain == "string":
                texts[path] = (v.cast("array<string>" if many else "string"), many)
        return plain is not None

    plain = all([walk("$" + step(c), "$", c, slim.schema[c].dataType, F.col(f"`{c}`"), False, F.lit(True)) for c in columns])
    if not plain or not columns:
        return shape(nodes(slim.select(F.struct(*slim.columns).alias("_doc")), [], "_doc"), values)
    n, found = None, []
    for at in range(0, len(kinds), _COUNTS):
        part = kinds[at : at + _COUNTS]
        row = slim.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("long")).alias(f"c{i}") for i, (*_, c) in enumerate(part)]).first()
        n = row["n"]
        found += [{"path": p, "parent": up, "name": name, "type": t, "n": row[f"c{i}"]} for i, (p, up, name, t, _) in enumerate(part) if row[f"c{i}"]]
    if not n:
        return Shape()
    return _shape([{"path": "$", "parent": None, "name": None, "type": "object", "n": n}, *found], _listed(_few_texts(slim, texts)) if values and texts else {})


def _few_texts(slim: DataFrame, texts: dict[str, tuple[Column, bool]]) -> DataFrame:
    """path, text of the paths that may have few texts: those outside arrays are estimated, as a sketch of few values is nearly exact."""
    single = [p for p, (_, many) in texts.items() if not many]
    if single:
        row = slim.agg(*[F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(texts[p][0])), F.lit(0)).alias(f"d{i}") for i, p in enumerate(single)]).first()
        texts = {p: v for p, v in texts.items() if v[1] or row[f"d{single.index(p)}"] <= 2 * MOST_VALUES}
    if not texts:
        return slim.select(F.lit("").alias("path"), F.lit("").alias("text")).limit(0)
    held = [F.transform(v if many else F.array(v), lambda x: F.struct(F.lit(p).alias("path"), x.alias("text"))) for p, (v, many) in texts.items()]  # noqa: B023
    return slim.select(F.inline(F.flatten(F.array(*held)))).where("text IS NOT NULL")


def violations(found: DataFrame, key: list[str], wanted: Shape, closed: bool = False) -> DataFrame:
    """The key, ``at``, ``problem``: where documents differ from a schema: wrong type, value not listed, missing or unknown field.

    The schema is compiled to Columns over nodes: no join, no shuffle.
    """
    flat: dict[str, Shape] = {}

    def walk(path: str, s: Shape) -> None:
        flat[path] = s
        for name, inner in s.fields.items():
            walk(path + (f".{name}" if name.isidentifier() and name.isascii() else '["' + name.replace('"', '\\"') + '"]'), inner)
        if s.items:
            walk(path + "[]", s.items)

    walk("$", wanted)
    problems = []
    known = F.col("path").isin(list(flat))
    if closed:
        problems.append(F.when(~known, F.lit("unknown field")))
    for path, s in flat.items():
        here = F.col("path") == path
        allowed = set(s.types) | ({"integer"} if "number" in s.types else set())
        problems.append(F.when(here & ~F.col("type").isin(sorted(allowed)), F.concat(F.lit("type "), F.col("type"))))
        if s.values:
            problems.append(F.when(here & (F.col("type") == "string") & ~F.col("text").isin(s.values), F.lit("value")))
        for name in s.required:
            quoted = '$["' + name.replace('"', '\\"') + '"]'
            problems.append(F.when(here & (F.col("type") == "object") & F.try_variant_get("value", quoted, "variant").isNull(), F.lit(f"missing {name}")))
    found_ = F.filter(F.array(*problems), lambda p: p.isNotNull())
    return found.select(*key, "at", F.explode(found_).alias("problem"))
