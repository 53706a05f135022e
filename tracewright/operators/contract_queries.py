"""Queries of contracts over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import contract as K
from tracewright.plans.program import Op
from tracewright.queries import query, table


def contract(**more) -> K.Contract:
    program = [Op("valueMap", "label", {"source": "o_orderstatus", "map": {"F": "finished", "O": "open"}}), Op("numericTransform", "cents", {"source": "o_totalprice", "mode": "multiply", "value": 100}), Op("stringCase", "priority", {"source": "o_orderpriority", "mode": "lower"})]
    return K.Contract(program, {"o_orderkey": "bigint"}, [{"kind": "allowed_values", "path": "label", "values": ["finished", "open"]}, {"kind": "maximum_failed_percent", "value": 50}], key=["o_orderkey"], **more)


_LABEL = "CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END"


@query("contract_run_partition", f"SELECT o_orderkey, CASE WHEN {_LABEL} IS NULL THEN 'quarantined' ELSE 'passed' END AS status, {_LABEL} AS label FROM orders")
def _run(spark, sf_dir):
    return K.run(contract(), table(spark, sf_dir, "orders")).select("o_orderkey", "status", F.col("output.label").alias("label"))


@query("contract_invariants_record", f"SELECT o_orderkey, 'allowed_values:label' AS failed FROM orders WHERE {_LABEL} IS NULL")
def _record(spark, sf_dir):
    return K.run(contract(), table(spark, sf_dir, "orders")).select("o_orderkey", F.explode("failed").alias("failed"))


@query("contract_invariants_batch", f"""WITH s AS (SELECT count(*) AS input, count({_LABEL}) AS passed FROM orders)
SELECT input, passed, 0 AS warned, input - passed AS quarantined, 0 AS blocked, CASE WHEN (input - passed) * 100 > 50 * input THEN 'maximum_failed_percent' ELSE '' END AS broken, CASE WHEN (input - passed) * 100 > 50 * input THEN 'block' WHEN input > passed THEN 'quarantine' ELSE 'pass' END AS verdict FROM s""")
def _batch(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return K.batch_report(contract(), df, K.run(contract(), df))


@query("contract_check_keyed", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 211 = 0 THEN 'removed' WHEN o_orderkey % 997 = 0 THEN 'changed' ELSE 'unchanged' END AS status, CASE WHEN o_orderkey % 211 <> 0 AND o_orderkey % 997 = 0 THEN 'cents' ELSE '' END AS fields FROM orders""")
def _check(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    made = K.run(contract(), df).select("o_orderkey", "output.*").where("o_orderkey % 211 <> 0").withColumn("cents", F.when(F.col("o_orderkey") % 997 == 0, F.col("cents") + 1).otherwise(F.col("cents")))
    return K.check(contract(), df, made)


_PRIORITY = "lower(o_orderpriority)"
_WHOLE = f"WITH o AS (SELECT {_LABEL} AS label, o_totalprice * 100 AS cents, {_PRIORITY} AS priority FROM orders), "
_HELD = "coalesce(label IN ('finished', 'open'), false)"
_MADE = """m AS (
SELECT 'remove' AS mutation, 'label' AS target, label IS NOT NULL AS changed, {h} AS held, false AS holds FROM o UNION ALL SELECT 'case', 'label', label IS NOT NULL, {h}, coalesce(upper(label) IN ('finished', 'open'), false) FROM o
UNION ALL SELECT 'retype', 'label', label IS DISTINCT FROM 'x', {h}, false FROM o UNION ALL SELECT 'remove', 'cents', true, {h}, {h} FROM o UNION ALL SELECT 'unit', 'cents', cents <> 0, {h}, {h} FROM o
UNION ALL SELECT 'remove', 'priority', true, {h}, {h} FROM o UNION ALL SELECT 'case', 'priority', upper(priority) <> priority, {h}, {h} FROM o UNION ALL SELECT 'retype', 'priority', true, {h}, {h} FROM o
UNION ALL SELECT 'swap', 'label,priority', label IS DISTINCT FROM priority, {h}, coalesce(priority IN ('finished', 'open'), false) FROM o)""".format(h=_HELD)


@query("contract_mutations", f"""{_WHOLE}{_MADE}
SELECT mutation, target, count(*) AS rows, count_if(changed) AS changed, count_if(changed AND held AND NOT holds) AS detected FROM m GROUP BY ALL
UNION ALL SELECT 'drop_row', '', 1, 1, 1 FROM (SELECT count(*) AS n FROM orders) WHERE n > 0 UNION ALL SELECT 'duplicate_key', '', 1, 1, 1 FROM (SELECT count(*) AS n FROM orders) WHERE n > 0""")
def _mutations(spark, sf_dir):
    k = contract()
    k.invariants += [{"kind": "row_count_preserved"}, {"kind": "key_unique"}]
    return K.mutations(k, table(spark, sf_dir, "orders"))


@query("contract_row_count", """SELECT count(*) - count_if(o_orderkey % 211 = 0) AS input, 'row_count_preserved,key_set_preserved' AS broken FROM orders""")
def _row_count(spark, sf_dir):
    df, k = table(spark, sf_dir, "orders"), contract()
    k.invariants = [{"kind": "row_count_preserved"}, {"kind": "key_set_preserved"}, {"kind": "key_unique"}]
    return K.batch_report(k, df, K.run(k, df).where("o_orderkey % 211 <> 0")).select("input", "broken")


@query("contract_unknown_fields", "SELECT o_orderkey, CASE WHEN o_orderkey % 211 = 0 THEN 'removed' ELSE 'changed' END AS status, CASE WHEN o_orderkey % 211 = 0 THEN '' WHEN o_orderkey % 997 = 0 THEN 'cents,unknown:extra' ELSE 'unknown:extra' END AS fields FROM orders")
def _unknown(spark, sf_dir):
    df, k = table(spark, sf_dir, "orders"), contract()
    k.invariants.append({"kind": "no_unknown_output_fields"})
    made = K.run(k, df).select("o_orderkey", "output.*").where("o_orderkey % 211 <> 0").withColumn("cents", F.when(F.col("o_orderkey") % 997 == 0, F.col("cents") + 1).otherwise(F.col("cents")))
    return K.check(k, df, made.withColumn("extra", F.lit(1)))


@query("contract_row_ids", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_orderkey || '|' || l_linenumber || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS row_id
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity, l_extendedprice) AS n FROM lineitem)""")
def _ids(spark, sf_dir):
    return K.row_ids(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_quantity", "l_extendedprice"])


# learning


def job(spark, sf_dir):
    """Orders, and what a job makes of them: nested, with a list, a date in another form and a status by name."""
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    name = F.when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "O", "open").otherwise("pending")
    b = a.select("o_orderkey", F.struct(name.alias("label"), F.struct((F.col("o_totalprice") * 100).alias("cents")).alias("price")).alias("order"), F.date_format(F.to_date("day", "dd/MM/yyyy"), "yyyy-MM-dd").alias("date"), F.split("o_orderpriority", "-").alias("words"))
    return a, b


_contracts: dict[tuple[int, str], K.Learned] = {}


def learned(spark, sf_dir) -> K.Learned:
    """The contract learned from all orders, kept for this session."""
    at = (id(spark), sf_dir)
    if at not in _contracts:
        _contracts[at] = K.learn(*job(spark, sf_dir), ["o_orderkey"])
    return _contracts[at]


@query("contract_learn_program", "SELECT * FROM (VALUES ('date', 'stringNormalize'), ('order.label', 'valueMap'), ('order.price.cents', 'numericTransform'), ('words', 'stringSplit')) t(target, op)")
def _learn_program(spark, sf_dir):
    found = learned(spark, sf_dir)
    return spark.createDataFrame([(op.target, op.kind) for op in found.contract.program], "target string, op string")


@query("contract_learn_run", """SELECT o_orderkey, CASE WHEN day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) THEN 'warned' ELSE 'passed' END AS status, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'pending' END AS label, o_totalprice * 100 AS cents, strftime(o_orderdate, '%Y-%m-%d') AS date, array_to_string(string_split(o_orderpriority, '-'), '|') AS words FROM orders""")
def _learn_run(spark, sf_dir):
    """The learned contract, run over all orders; a day that could be a month is a warning."""
    k = learned(spark, sf_dir).contract
    ran = K.run(k, job(spark, sf_dir)[0])
    return ran.select("o_orderkey", "status", F.col("output.order.label").alias("label"), F.col("output.order.price.cents").alias("cents"), F.col("output.date").alias("date"), F.array_join("output.words", "|").alias("words"))


@query("contract_learn_schema", """WITH s AS (SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'pending' END AS v FROM orders)
SELECT 'order.label' AS path, 'string' AS type, string_agg(v, ',' ORDER BY v) AS "values", true AS required FROM s UNION ALL SELECT 'order.price.cents', CASE WHEN count_if(o_totalprice * 100 <> floor(o_totalprice * 100)) > 0 THEN 'number' ELSE 'integer' END, NULL, true FROM orders UNION ALL SELECT 'date', 'string', NULL, true UNION ALL SELECT 'words', 'array', NULL, true""")
def _learn_schema(spark, sf_dir):
    out = learned(spark, sf_dir).contract.output
    rows = []
    for path in ("order.label", "order.price.cents", "date", "words"):
        *above, name = path.split(".")
        up = out
        for part in above:
            up = up.fields[part]
        s = up.fields[name]
        rows.append((path, ",".join(s.types), ",".join(s.values) if s.values and path == "order.label" else None, name in up.required))
    return spark.createDataFrame(rows, "path string, type string, `values` string, required boolean")


@query("contract_learn_violations", "SELECT o_orderkey, '$.order.label' AS at, 'value' AS problem FROM orders WHERE o_orderkey % 50 = 1 UNION ALL SELECT o_orderkey, '$.extra', 'unknown field' FROM orders")
def _learn_violations(spark, sf_dir):
    """Outputs of another job against the learned schema: a label that no example has, a field that none has."""
    b = job(spark, sf_dir)[1]
    label = F.when(F.col("o_orderkey") % 50 == 1, "gone").otherwise(F.col("order.label"))
    other = b.withColumn("order", F.struct(label.alias("label"), F.col("order.price").alias("price"))).withColumn("extra", F.lit(True))
    return K.schema_violations(learned(spark, sf_dir).contract, other, "output")


@query("contract_check_paths", "SELECT o_orderkey, CASE WHEN o_orderkey % 211 = 0 THEN '$' ELSE 'order.price.cents' END AS path FROM orders WHERE o_orderkey % 211 = 0 OR o_orderkey % 97 = 0 UNION ALL SELECT o_orderkey, 'words' FROM orders WHERE o_orderkey % 101 = 0 AND o_orderkey % 211 <> 0")
def _check_paths(spark, sf_dir):
    """Where a job's nested output differs from the learned contract's."""
    a, b = job(spark, sf_dir)
    k = F.col("o_orderkey")
    cents = F.when(k % 97 == 0, F.col("order.price.cents") + 1).otherwise(F.col("order.price.cents"))
    words = F.when(k % 101 == 0, F.concat(F.col("words"), F.array(F.lit("?")))).otherwise(F.col("words"))
    made = b.select("o_orderkey", F.struct(F.col("order.label").alias("label"), F.struct(cents.alias("cents")).alias("price")).alias("order"), "date", words.alias("words")).where("o_orderkey % 211 <> 0")
    return K.check_paths(learned(spark, sf_dir).contract, a, made).select("o_orderkey", "path")


@query("contract_learn_mutations", "SELECT 'array_order' AS mutation, 'words' AS target, count(*) AS rows, count(*) AS changed FROM orders UNION ALL SELECT 'date_format', 'date', count(*), count(*) FROM orders")
def _learn_mutations(spark, sf_dir):
    found = K.mutations(learned(spark, sf_dir).contract, job(spark, sf_dir)[0])
    return found.where("mutation IN ('date_format', 'array_order')").select("mutation", "target", "rows", "changed")
