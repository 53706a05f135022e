"""Queries of the search for rules: consensus, positions, lookups of any size, nested and array targets, matching, ambiguity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import ambiguity as A
from tracewright.operators import consensus as C
from tracewright.operators import infer as I
from tracewright.operators import matching as M
from tracewright.operators import verify as R
from tracewright.plans.program import Op, nested, run
from tracewright.queries import query, table
from tracewright.sources.positions import POSITION, numbered


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")


# consensus


@query("verify_tenth_of_rows_bad", "SELECT o_orderkey, 'price,priority' AS targets FROM orders WHERE o_orderkey % 10 = 3")
def _tenth(spark, sf_dir):
    """Every tenth row is broken by a rule of its own for each target: too many for a dominant rule, few for the majority."""
    a = _orders(spark, sf_dir)
    bad = F.col("o_orderkey") % 10 == 3
    b = a.select(
        "o_orderkey",
        F.when(bad, F.concat(F.lit("bad "), F.col("o_orderkey"))).otherwise(F.lower("o_orderpriority")).alias("priority"),
        F.when(bad, F.col("o_totalprice") * F.col("o_orderkey")).otherwise(F.col("o_totalprice") * 100).alias("price"),
    )
    found = R.verify(a, b, ["o_orderkey"])
    return found.flagged.withColumn("targets", F.array_join(F.array_sort(F.split("targets", ",")), ","))


def _split(spark, sf_dir, first: F.Column) -> DataFrame:
    """Orders whose amount was made by one rule where ``first``, else by another."""
    a = _orders(spark, sf_dir)
    pairs = a.withColumn("_y", F.when(first, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice") + 7)).persist()
    try:
        found = C.consensus(pairs, ["o_orderkey"], ["o_custkey", "o_totalprice", "o_orderstatus"], "amount", "_y")
        return C.table(spark, [found])
    finally:
        pairs.unpersist()


_RULES = """
WITH n AS (SELECT count(*) AS n, count_if({first}) AS a FROM orders),
r AS (SELECT unnest([a, n - a]) AS support, n, greatest(a, n - a) AS most FROM n)
SELECT 'amount' AS target, CASE WHEN 2 * most > n THEN 'inconsistent' ELSE 'unverifiable' END AS verdict, (row_number() OVER (ORDER BY support DESC))::INTEGER AS rank,
       'numericTransform' AS op, 'o_totalprice → amount' AS signature, support, round(support / n, 4) AS share, 0::BIGINT AS unexplained
FROM r"""


@query("verify_two_rules", _RULES.format(first="o_orderkey % 10 < 6"))
def _two_rules(spark, sf_dir):
    return _split(spark, sf_dir, F.col("o_orderkey") % 10 < 6)


@query("verify_tied_rules", _RULES.format(first="o_orderkey % 2 = 0"))
def _tied_rules(spark, sf_dir):
    return _split(spark, sf_dir, F.col("o_orderkey") % 2 == 0)


# positions


@query("verify_positional", "SELECT row_number AS __row, 'label' AS targets FROM (SELECT *, row_number() OVER () - 1 AS row_number FROM lineitem) WHERE row_number % 1013 = 5")
def _positional(spark, sf_dir):
    """Lines and what a job made of them, without a key on either side: the k-th row belongs to the k-th."""
    path = f"{sf_dir}/lineitem.parquet"
    a = numbered(spark, path, ["l_returnflag", "l_quantity", "l_linestatus"])
    b = numbered(spark, path, ["l_returnflag"]).select(POSITION, F.when(F.col(POSITION) % 1013 == 5, F.lit("?")).otherwise(F.lower("l_returnflag")).alias("label"))
    return R.verify(a, b, [POSITION]).flagged


@query("rows_numbered", "SELECT row_number() OVER () - 1 AS __row, l_orderkey, l_linenumber FROM lineitem")
def _numbered(spark, sf_dir):
    return numbered(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber"])


# lookups of any size


def _lookup_rule(spark, sf_dir, key: F.Column, output: F.Column) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(key.alias("code"), F.col("l_quantity").alias("quantity"), output.alias("_y"))
    rule = I.infer(d, ["code", "quantity"], {"name": "_y"})[0]
    keys = None if not rule.op or rule.op.kind != "valueMap" else rule.op.params.get("keys") or len(rule.op.params["map"])
    return spark.createDataFrame([(rule.op.kind if rule.op else None, rule.status, keys, rule.matches, rule.rows)], "op string, status string, keys long, matches long, rows long")


_KEYS = """
WITH d AS (SELECT {key} AS code FROM lineitem), n AS (SELECT count(DISTINCT code) AS k, count(*) AS n FROM d)
SELECT CASE WHEN k < 0.5 * n THEN 'valueMap' END AS op, CASE WHEN k < 0.5 * n THEN 'exact' ELSE 'none' END AS status, CASE WHEN k < 0.5 * n THEN k END AS keys,
       CASE WHEN k < 0.5 * n THEN n ELSE 0 END AS matches, CASE WHEN k < 0.5 * n THEN n ELSE 0 END AS rows FROM n"""


def _line() -> F.Column:
    return (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long")


def _name(code: F.Column) -> F.Column:
    return F.substring(F.md5(code.cast("string").cast("binary")), 1, 8)


@query("infer_lookup_300_keys", _KEYS.format(key="(l_orderkey * 8 + l_linenumber) % 300"))
def _keys_300(spark, sf_dir):
    return _lookup_rule(spark, sf_dir, _line() % 300, _name(_line() % 300))


@query("infer_lookup_5000_keys", _KEYS.format(key="(l_orderkey * 8 + l_linenumber) % 5000"))
def _keys_5000(spark, sf_dir):
    return _lookup_rule(spark, sf_dir, _line() % 5000, _name(_line() % 5000))


@query("infer_lookup_memorised", _KEYS.format(key="l_orderkey * 8 + l_linenumber"))
def _keys_all(spark, sf_dir):
    return _lookup_rule(spark, sf_dir, _line(), _name(_line()))


@query("verify_large_lookup", "SELECT o_orderkey, 'name' AS targets FROM orders WHERE o_orderkey % 401 = 17")
def _large_lookup(spark, sf_dir):
    """A lookup of hundreds of keys, kept as a table and joined to flag the rows that break it."""
    a = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 900).alias("code"))
    b = a.select("o_orderkey", F.when(F.col("o_orderkey") % 401 == 17, F.lit("lost")).otherwise(_name(F.col("code"))).alias("name"))
    return R.verify(a, b, ["o_orderkey"]).flagged


# nested targets and arrays


def _mode() -> F.Column:
    """How a line travels, by its supplier."""
    return F.element_at(F.array(*[F.lit(m) for m in ("AIR", "RAIL", "SHIP", "MAIL", "TRUCK")]), (F.col("l_suppkey") % 5 + 1).cast("int"))


def nested_orders(spark, sf_dir) -> DataFrame:
    """Orders with their lines as an array of records, a customer record, a tag list and texts of several shapes."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"), _mode().alias("mode")).alias("line"))
    lines = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    even = F.col("o_orderkey") % 2 == 0
    return o.select(
        "o_orderkey",
        F.col("lines"),
        F.struct(F.col("o_custkey").alias("id"), F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("info")).alias("customer"),
        F.transform(F.col("lines"), lambda x: F.concat(F.lit(" "), x["mode"], F.lit("  x "))).alias("tags"),
        F.array_join(F.transform(F.col("lines"), lambda x: x["mode"]), "; ").alias("listing"),
        F.concat((F.col("o_orderkey") % 512 + 1).cast("string"), F.lit("Mi")).alias("memory"),
        F.concat(F.lit("0"), F.lpad((F.col("o_orderkey") % 10_000_000).cast("string"), 9, "1")).alias("phone"),
        F.concat(F.lit("reports%2F"), F.col("o_orderkey").cast("string"), F.lit("+final.csv")).alias("object"),
        F.when(even, F.concat(F.lit("nick"), F.col("o_orderkey").cast("string"))).alias("nick"),
        F.concat(F.lit("user"), F.col("o_orderkey").cast("string")).alias("login"),
    )


def _wanted() -> dict[str, F.Column]:
    """What a job makes of nested orders, written without the library's operators. Nested paths are nested targets."""
    lines = F.col("lines")
    pick = lambda f, keep=None: F.transform(F.filter(lines, keep) if keep else lines, lambda x: x[f])
    air = lambda x: x["mode"] == "AIR"
    flags = F.array_distinct(pick("flag"))
    return {
        "out.status": F.col("customer.info.status"),
        "out.detail.customer": F.col("customer.id"),
        "count": F.size(lines),
        "count_air": F.size(F.filter(lines, air)),
        "quantity": F.aggregate(lines, F.lit(0.0), lambda a, x: a + x["qty"]),
        "weighted": F.aggregate(lines, F.lit(0.0), lambda a, x: a + x["qty"] * x["price"]),
        "first_part": lines[0]["part"],
        "last_mode": F.element_at(lines, -1)["mode"],
        "modes": F.array_join(pick("mode"), ","),
        "parts": pick("part"),
        "air_parts": pick("part", air),
        "first_air": F.get(pick("part", air), F.lit(0)),
        "short": F.transform(lines, lambda x: F.struct(x["part"].alias("p"), F.lower(x["mode"]).alias("m"))),
        "by_flag": F.map_from_entries(F.transform(flags, lambda k: F.struct(k, F.transform(F.filter(lines, lambda x: x["flag"] == k), lambda x: x["no"])))),
        "clean": F.transform(F.col("tags"), lambda t: F.regexp_replace(F.trim(t), " +", " ")),
        "split": F.split("listing", "; "),
        "kibi": F.concat(((F.col("o_orderkey") % 512 + 1) * 1024).cast("string"), F.lit("Ki")),
        "dial": F.concat(F.lit("+49"), F.regexp_replace("phone", "^0+", "")),
        "key": F.concat(F.lit("reports/"), F.col("o_orderkey").cast("string"), F.lit(" final.csv")),
        "shown": F.coalesce("nick", "login"),
        "final": F.when(F.col("customer.info.status") == "F", "done").otherwise("waiting"),
        "greeting": F.concat(F.lit("Dear "), F.col("login"), F.lit(", order "), F.col("o_orderkey").cast("string"), F.lit(" is "), F.lower(F.col("customer.info.priority")), F.lit(".")),
    }


_learned: dict[tuple[int, str], dict[str, Op]] = {}


def learned(spark, sf_dir) -> dict[str, Op]:
    """The operators that inference finds for all wanted targets at once, kept for this session."""
    at = (id(spark), sf_dir)
    if at not in _learned:
        wanted = _wanted()
        made = nested_orders(spark, sf_dir)
        outputs = made.select("o_orderkey", *nested({k: v for k, v in wanted.items()}))
        pairs, inputs, targets = R.aligned_paths(made, outputs, ["o_orderkey"])
        pairs = pairs.persist()
        try:
            _learned[at] = {r.target: r.op for r in I.infer(pairs, inputs, targets) if r.op and r.status == "exact"}
        finally:
            pairs.unpersist()
    return _learned[at]


_LINES = "WITH lines AS (SELECT *, (['AIR', 'RAIL', 'SHIP', 'MAIL', 'TRUCK'])[l_suppkey % 5 + 1] AS l_mode FROM lineitem), l AS (SELECT l_orderkey AS o_orderkey, list({'no': l_linenumber, 'part': l_partkey, 'qty': l_quantity, 'price': l_extendedprice, 'flag': l_returnflag, 'mode': l_mode} ORDER BY l_linenumber, l_partkey, l_quantity) AS lines FROM lines GROUP BY 1), o AS (SELECT * FROM l JOIN orders USING (o_orderkey)) "
#: Target, operator, SQL of its value over ``lines`` and the order's columns.
_KINDS = {
    "out.status": ("set_nested", "set", "o_orderstatus"),
    "out.detail.customer": ("set_deep", "set", "o_custkey"),
    "count": ("array_count", "arrayCount", "len(lines)"),
    "count_air": ("array_count_where", "arrayCount", "len(list_filter(lines, lambda x: x.mode = 'AIR'))"),
    "quantity": ("array_sum", "arraySum", "list_sum(list_transform(lines, lambda x: x.qty))"),
    "weighted": ("array_weighted_sum", "arraySum", "list_sum(list_transform(lines, lambda x: x.qty * x.price))"),
    "first_part": ("array_first", "arrayIndex", "lines[1].part"),
    "last_mode": ("array_last", "arrayIndex", "lines[-1].mode"),
    "modes": ("array_join", "arrayJoin", "array_to_string(list_transform(lines, lambda x: x.mode), ',')"),
    "parts": ("array_map", "arrayMap", "to_json(list_transform(lines, lambda x: x.part))::VARCHAR"),
    "air_parts": ("array_map_where", "arrayMap", "to_json(list_transform(list_filter(lines, lambda x: x.mode = 'AIR'), lambda x: x.part))::VARCHAR"),
    "first_air": ("array_find", "arrayFind", "list_filter(lines, lambda x: x.mode = 'AIR')[1].part"),
    "short": ("array_project", "arrayProject", "to_json(list_transform(lines, lambda x: {'p': x.part, 'm': lower(x.mode)}))::VARCHAR"),
    "by_flag": ("array_group_by", "arrayGroupBy", "(SELECT '{' || string_agg('\"' || k || '\":' || to_json(list_transform(list_filter(lines, lambda x: x.flag = k), lambda x: x.no)), ',' ORDER BY k) || '}' FROM (SELECT unnest(list_distinct(list_transform(lines, lambda x: x.flag))) AS k))"),
    "clean": ("array_strings", "arrayStringTransform", "to_json(list_transform(lines, lambda x: x.mode || ' x'))::VARCHAR"),
    "split": ("string_split", "stringSplit", "to_json(list_transform(lines, lambda x: x.mode))::VARCHAR"),
    "kibi": ("quantity", "quantityTransform", "((o_orderkey % 512 + 1) * 1024)::VARCHAR || 'Ki'"),
    "dial": ("phone", "stringNormalize", "'+49' || ltrim(lpad((o_orderkey % 10000000)::VARCHAR, 9, '1'), '0')"),
    "key": ("key_decode", "stringNormalize", "'reports/' || o_orderkey || ' final.csv'"),
    "shown": ("fallback", "fallback", "CASE WHEN o_orderkey % 2 = 0 THEN 'nick' ELSE 'user' END || o_orderkey"),
    "final": ("conditional", "conditional", "CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'waiting' END"),
    "greeting": ("template", "template", "'Dear user' || o_orderkey || ', order ' || o_orderkey || ' is ' || lower(o_orderpriority) || '.'"),
}


def _register(target: str, name: str, kind: str, sql: str) -> None:
    """The learned operator, run over all orders; its name must be the expected one."""

    @query(f"learn_{name}", f"{_LINES}SELECT o_orderkey, '{kind}' AS op, {sql} AS value FROM o")
    def _learned_kind(spark, sf_dir):
        op = learned(spark, sf_dir).get(target)
        made = nested_orders(spark, sf_dir)
        if op is None:
            return made.select("o_orderkey", F.lit(None).cast("string").alias("op"), F.lit(None).cast("string").alias("value"))
        out = run(made, [Op(op.kind, "value", op.params)], keep=("o_orderkey",))
        deep = out.schema["value"].dataType.typeName() in ("array", "map", "struct")
        value = F.to_json("value") if out.schema["value"].dataType.typeName() != "map" else F.to_json(F.map_from_entries(F.array_sort(F.map_entries("value"))))
        return out.select("o_orderkey", F.lit(op.kind).alias("op"), (value if deep else F.col("value")).alias("value"))


for _target, (_name_, _kind, _sql) in _KINDS.items():
    _register(_target, _name_, _kind, _sql)


# matching of sources and targets


def _renamed(spark, sf_dir) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """Lines and 30 columns that a job made of them, renamed and reordered, without a shared key."""
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", F.col("l_shipdate").cast("string").alias("l_shipdate"))
    extra = {f"c{i}": F.concat(F.lit(f"{i}-"), (F.col("l_partkey") * (i + 3) % 97).cast("string")) for i in range(18)}
    a = a.select("*", *[v.alias(k) for k, v in extra.items()])
    sources = a.columns
    b = a.select(*[F.col(c).alias(f"t_{c.removeprefix('l_')}") for c in reversed(sources)])
    return a, b, sources, b.columns


_OVERLAPS = """
WITH a AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem),
v AS (SELECT DISTINCT c, regexp_replace(v, '\\.0+$', '') AS v FROM (UNPIVOT (SELECT {columns} FROM a) ON COLUMNS(*) INTO NAME c VALUE v)),
x AS (SELECT DISTINCT 'c' || i AS c, i || '-' || (l_partkey * (i + 3) % 97) AS v FROM lineitem, range(18) r(i)),
w AS (SELECT * FROM v UNION ALL SELECT * FROM x),
n AS (SELECT c, count(*) AS n FROM w GROUP BY c),
p AS (SELECT s.c AS source, t.c AS target, count(*) AS shared FROM w s JOIN w t USING (v) GROUP BY ALL)
""".format(columns=", ".join(f"{c}::VARCHAR AS {c}" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")))


@query("match_value_overlaps", _OVERLAPS + "SELECT source, 't_' || replace(target, 'l_', '') AS target, shared, a.n AS source_values, b.n AS target_values FROM p JOIN n a ON a.c = source JOIN n b ON b.c = target")
def _overlap(spark, sf_dir):
    return M.overlaps(*_renamed(spark, sf_dir))


@query("match_sources", _OVERLAPS + "SELECT c AS source, 't_' || replace(c, 'l_', '') AS target, n AS shared, 1.0::DOUBLE AS coverage, 1::INTEGER AS rank FROM n")
def _matched(spark, sf_dir):
    """Every column finds its own among 30: by shared values, ties by name."""
    return M.matches(*_renamed(spark, sf_dir)).select("source", "target", "shared", "coverage", "rank")


# ambiguity


def _ambiguous(spark, sf_dir, example: F.Column, target: F.Column, inputs: dict[str, F.Column]) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", *[v.alias(k) for k, v in inputs.items()])
    examples = o.where(example).withColumn("_y", target)
    found = A.triage(examples, o, "o_orderkey", list(inputs), {"amount": "_y"})
    return A.table(spark, found)


_AMBIGUITY = "SELECT 'amount' AS target, '{status}' AS status, '{selected}' AS selected, '{other}' AS alternative, '{strength}' AS strength, count_if({differs}) AS differs, min(CASE WHEN {differs} THEN o_orderkey END)::VARCHAR AS witness FROM orders"


@query("ambiguity_meaningful", _AMBIGUITY.format(status="ambiguous", selected="set(billed)", other="set(quoted)", strength="meaningful", differs="o_orderkey % 7 = 0"))
def _meaningful(spark, sf_dir):
    """Two fields that are equal in the examples and differ on every seventh order: a question for its first one."""
    sevenths = F.col("o_orderkey") % 7 == 0
    inputs = {"billed": F.col("o_totalprice"), "quoted": F.when(sevenths, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))}
    return _ambiguous(spark, sf_dir, ~sevenths, F.col("billed"), inputs)


@query("ambiguity_equivalent", _AMBIGUITY.format(status="safe", selected="set(billed)", other="set(quoted)", strength="equivalent", differs="false"))
def _equivalent(spark, sf_dir):
    return _ambiguous(spark, sf_dir, F.col("o_orderkey") % 7 != 0, F.col("billed"), {"billed": F.col("o_totalprice"), "quoted": F.col("o_totalprice")})


@query("ambiguity_resolved", _AMBIGUITY.format(status="safe", selected="set(billed)", other="set(quoted)", strength="resolved-by-new-input", differs="o_orderkey % 7 = 0"))
def _resolved(spark, sf_dir):
    """The alternative's field is empty on rows the rule is to run on."""
    sevenths = F.col("o_orderkey") % 7 == 0
    return _ambiguous(spark, sf_dir, ~sevenths, F.col("billed"), {"billed": F.col("o_totalprice"), "quoted": F.when(~sevenths, F.col("o_totalprice"))})


@query("ambiguity_weak", _AMBIGUITY.format(status="safe", selected="set(code)", other="stringCase(code)", strength="weak", differs="o_orderkey % 7 = 0"))
def _weak(spark, sf_dir):
    """Capitals would do as well, but cost more than a copy."""
    sevenths = F.col("o_orderkey") % 7 == 0
    twice = F.concat("o_orderstatus", "o_orderstatus")
    code = F.when(sevenths, F.lower(twice)).otherwise(twice)
    return _ambiguous(spark, sf_dir, ~sevenths, F.col("code"), {"code": code}).where("strength = 'weak'")


# optional targets


@query("infer_guarded_rule", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN lower(o_orderpriority) END AS value, 'stringCase' AS op, 'closed' AS domain FROM orders")
def _guarded(spark, sf_dir):
    """A target that is there only where an optional field is: the rule is learned with its guard, and run."""
    closed = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", closed.alias("closed"))
    rule = I.infer(a.withColumn("_y", F.when(F.col("closed").isNotNull(), F.lower("o_orderpriority"))), ["o_orderpriority", "closed"], {"value": "_y"})[0]
    return run(a, [rule.op], keep=("o_orderkey",)).select("o_orderkey", "value", F.lit(rule.op.kind).alias("op"), F.lit(rule.op.params.get("domain")).alias("domain"))
