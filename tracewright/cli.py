"""Command line: ``python -m tracewright.cli verify|fingerprint|profile|contract-...``.

``contract-learn ORIGINAL TRANSFORMED --key K --out FILE`` learns a contract from examples, ``contract-inspect``
shows it, ``contract-test CONTRACT TABLE`` changes outputs on purpose and says what no invariant notices,
``contract-approve CONTRACT FINGERPRINT --out FILE`` approves it, ``contract-run`` and ``contract-check`` use it,
``contract-diff OLD NEW`` says what changed. Tables are Parquet, CSV or JSON folders. Exit codes: 0
consistent or passed, 1 contradictions, held rows, unnoticed mutations or breaking changes, 2 unverifiable or
refused, 3 bad arguments.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from tracewright.operators import contract as K
from tracewright.operators import profile as P
from tracewright.operators import verify as R
from tracewright.sources import formats


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix; Parquet unless it says otherwise."""
    if path.rstrip("/").endswith((".csv", ".tsv")):
        return formats.read_csv(spark, path)
    return formats.read_json(spark, path) if path.rstrip("/").endswith(".json") else spark.read.parquet(path)


def load_contract(spark: SparkSession, path: str) -> K.Contract:
    """A contract from its JSON file."""
    return K.Contract.from_json("\n".join(r[0] for r in spark.read.text(path, wholetext=True).limit(1).collect()))


def save_contract(spark: SparkSession, contract: K.Contract, path: str) -> None:
    """To a JSON file where Spark's file systems reach it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, False)
    out.write(bytearray(contract.to_json().encode()))
    out.close()


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tracewright", exit_on_error=False)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, places in {"verify": ("original", "transformed"), "fingerprint": ("table",), "profile": ("table",), "contract-learn": ("original", "transformed"), "contract-inspect": ("contract",), "contract-test": ("contract", "table"), "contract-approve": ("contract", "fingerprint"), "contract-diff": ("contract", "other"), "contract-run": ("contract", "table"), "contract-check": ("contract", "table", "actual")}.items():
        p = sub.add_parser(name)
        for place in places:
            p.add_argument(place)
        p.add_argument("--key", action="append", default=[])
        p.add_argument("--out", help="folder for the rows; without it only the summary is printed")
    try:
        a = parser.parse_args(arguments)
    except (argparse.ArgumentError, SystemExit):
        return 3
    spark = SparkSession.builder.getOrCreate()

    def save(df: DataFrame) -> None:
        if a.out:
            df.write.mode("errorifexists").parquet(a.out)

    if a.command == "verify":
        if not a.key:
            return 3
        v = R.verify(read(spark, a.original), read(spark, a.transformed), a.key)
        save(v.flagged)
        print(json.dumps({"verdict": v.verdict, "flagged": v.flagged.count(), "rules": [{"target": r.target, "status": r.status, "op": r.op.kind if r.op else None, "matches": r.matches, "rows": r.rows} for r in v.rules]}))
        return {"consistent": 0, "inconsistent": 1}.get(v.verdict, 2)
    if a.command == "fingerprint":
        df = read(spark, a.table)
        print(json.dumps({"schema": P.schema_fingerprint(df), **P.dataset_digest(df).first().asDict()}, default=str))
        return 0
    if a.command == "profile":
        found = P.insights(read(spark, a.table))
        save(found)
        print(json.dumps(P.overview(found)))
        return 0
    if a.command == "contract-learn":
        if not a.key or not a.out:
            return 3
        made = K.learn(read(spark, a.original), read(spark, a.transformed), a.key)
        save_contract(spark, made.contract, a.out)
        print(json.dumps({"fingerprint": made.contract.fingerprint(), "status": made.contract.status, "unexplained": made.unexplained, "program": [op.to_dict() for op in made.contract.program]}, default=str))
        return 0 if made.contract.program else 2
    contract = load_contract(spark, a.contract)
    if a.command == "contract-inspect":
        schemas = {side: shape.schema(side == "output") for side in ("input", "output") if (shape := getattr(contract, side))}
        print(json.dumps({"fingerprint": contract.fingerprint(), "status": contract.status, "problems": contract.problems(), "required": contract.required, "invariants": contract.invariants, **schemas}, default=str))
        return 2 if contract.problems() else 0
    if a.command == "contract-approve":
        try:
            contract.approve(a.fingerprint)
        except ValueError as e:
            print(json.dumps({"refused": str(e)}))
            return 2
        if not a.out:
            return 3
        save_contract(spark, contract, a.out)
        print(json.dumps({"fingerprint": contract.fingerprint(), "status": contract.status}))
        return 0
    if a.command == "contract-diff":
        changes = K.differences(contract, load_contract(spark, a.other))
        print(json.dumps(changes))
        return int(any(c["effect"] == "breaking" for c in changes))
    if contract.problems():
        print(json.dumps({"verdict": "invalid_contract", "problems": contract.problems()}))
        return 2
    df = read(spark, a.table)
    if a.command == "contract-test":
        found = K.mutations(contract, df)
        save(found)
        unnoticed = [f"{r['mutation']} {r['target']}".strip() for r in found.where("changed > 0 AND detected = 0").orderBy("mutation", "target").collect()]  # a row for each mutation
        print(json.dumps({"unnoticed": unnoticed}))
        return int(bool(unnoticed))
    if a.command == "contract-run":
        ran = K.run(contract, df)
        save(ran)
        report = K.batch_report(contract, df, ran).first().asDict()
        print(json.dumps(report))
        return {"pass": 0, "warn": 0}.get(report["verdict"], 1)
    found = K.check(contract, df, read(spark, a.actual))
    save(found)
    counts = {r["status"]: r["count"] for r in found.groupBy("status").count().collect()}
    print(json.dumps(counts))
    return int(any(k != "unchanged" for k in counts))


if __name__ == "__main__":
    sys.exit(main())
