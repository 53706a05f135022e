"""The trie of conversations' shared beginnings, by an external mergesort whose runs carry LCPs.

Every conversation is a sequence of turns, a turn being a digest of role and text with its number of
words. Spark deals the sequences, ordered, into ranges; equal ones are ordered by id, so a beginning
that a third of all conversations share, or one conversation that often, is spread over many ranges.
A task sorts its range in runs of a bounded number of turns, each record with the length of the
longest common prefix (LCP) with the one before it, and spills them. A loser tree merges the runs:
the record with the longer LCP with the last winner comes first, and only equal LCPs compare turns,
from the LCP on, so no turn that records share is compared again. The merged stream's LCPs drive a
stack of the open path: what is deeper than the next LCP is finished.

Nodes on a range's first and last path may go on in other ranges. They are handed on open, with sums
of what was finished below them, and a last pass over these few rows (two paths for each range)
closes them with a stack of the same kind.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm._store import Workspace, kept
from tracewright.llm.mixing import word_count

#: Turns in a run of the mergesort; records of a run that are in memory while runs merge.
RUN_TURNS, MERGE_ROWS = 400_000, 512
#: Turns that a range holds, about.
RANGE_TURNS = 2_000_000
#: Fixed values: ids are grouped by so many, and begin with up to ``HEADS - 1`` turns of the group's first.
GROUP, HEADS = 20, 4

_WIDTH = 16
_OUT = "state string, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary, words long, ends string, part int, section int"


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes of a SHA-256 of role and text, the role's length first, so that no two pairs read alike."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(said.cast("binary"), 256)), 1, _WIDTH)


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, turns (an array of digest and words): each id's first turns are those of its group's first id.

    Turns are in order of ``turn``, null first; equal ones by digest. Rows without ``conv_id`` belong
    to no conversation. One row holds a conversation's digests, 20 bytes a turn, never its texts.
    """
    one = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest(F.col("role"), F.col("text")).alias("d"), word_count(F.col("text")).alias("w"))
    listed = one.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "d", "w"))).alias("own"))
    listed = listed.select("conv_id", F.transform("own", lambda t: F.struct(t["d"].alias("d"), t["w"].alias("w"))).alias("own"))
    group = F.col("conv_id") - F.col("conv_id") % GROUP  # of a negative id towards zero, as in SQL
    heads = listed.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("group"), F.slice("own", 1, HEADS - 1).alias("head"))
    both = listed.withColumn("group", group).join(heads, "group", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("own", 1, 0))
    return both.select("conv_id", F.concat(head, F.slice("own", h + 1, F.greatest(F.size("own"), F.lit(1)))).alias("turns"))


class Run:
    """A sorted run on the task's own disk: records in order, each with its LCP with the one before."""

    def __init__(self, records: list[tuple[list[bytes], int, list[int]]], folder: str, number: int):
        records.sort(key=lambda r: (r[0], r[1]))
        self.path = os.path.join(folder, f"run-{number}")
        lcps, before = [], []
        for turns, _, _ in records:
            lcps.append(common(before, turns, 0))
            before = turns
        table = pa.table({
            "turns": pa.array([b"".join(r[0]) for r in records], pa.large_binary()),
            "id": pa.array([r[1] for r in records], pa.int64()),
            "words": pa.array([r[2] for r in records], pa.large_list(pa.int64())),
            "lcp": pa.array(lcps, pa.int64()),
        })  # fmt: skip
        with pa.OSFile(self.path, "wb") as f, pa.ipc.new_file(f, table.schema) as out:
            out.write_table(table, max_chunksize=MERGE_ROWS)

    def __iter__(self):
        with pa.memory_map(self.path) as f:
            file = pa.ipc.open_file(f)
            for i in range(file.num_record_batches):
                for row in file.get_batch(i).to_pylist():
                    data = row["turns"]
                    yield [data[at : at + _WIDTH] for at in range(0, len(data), _WIDTH)], row["id"], row["words"], row["lcp"]


def common(a: list[bytes], b: list[bytes], start: int) -> int:
    """Length of the longest common prefix of two sequences that agree up to ``start``."""
    most = min(len(a), len(b))
    while start < most and a[start] == b[start]:
        start += 1
    return start


class LoserTree:
    """Merges sorted runs; each entry has its LCP with the last record that left the tree.

    Of two entries the one with the longer LCP is the smaller: it agrees longer with a record that is
    not larger than either. Only entries with equal LCPs compare turns, beyond what they are known to
    share, and the loser remembers its LCP with the winner.
    """

    def __init__(self, runs: list[Iterator]):
        self.runs, self.compared = [iter(r) for r in runs], 0
        k = 1
        while k < len(runs):
            k *= 2
        self.k, self.losers = k, [None] * k
        entries = [self._next(i) for i in range(len(runs))] + [None] * (k - len(runs))
        self.top = self._build(1, entries)

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return row and [row[0], row[1], row[2], row[3], i]

    def _build(self, node: int, entries: list):
        if node >= self.k:
            return entries[node - self.k]
        winner, self.losers[node] = self._play(self._build(2 * node, entries), self._build(2 * node + 1, entries))
        return winner

    def _play(self, a, b):
        if a is None or b is None:
            return (b, a) if a is None else (a, b)
        if a[3] != b[3]:
            return (a, b) if a[3] > b[3] else (b, a)
        at = common(a[0], b[0], a[3])
        self.compared += at - a[3] + 1
        x, y = a[0][at : at + 1], b[0][at : at + 1]
        winner, loser = (a, b) if (x, a[1]) <= (y, b[1]) else (b, a)
        loser[3] = at
        return winner, loser

    def __iter__(self):
        """turns, id, words, LCP with the record before."""
        while (top := self.top) is not None:
            yield top[0], top[1], top[2], top[3]
            # the run's next record has its LCP with the one that just left
            entry, node = self._next(top[4]), (self.k + top[4]) // 2
            while node:
                entry, self.losers[node] = self._play(entry, self.losers[node])
                node //= 2
            self.top = entry


class Node:
    """A node of the open path, and what is known of its subtree."""

    __slots__ = ("key", "depth", "words", "conv_id", "n", "children", "leaves", "saved", "ends", "sha", "rows", "first")

    def __init__(self, key: bytes, depth: int, words: int, first: bool = False):
        self.key, self.depth, self.words, self.first = key, depth, words, first
        self.conv_id, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends: list[int] = []
        self.sha = None
        self.rows: list[list] = []  # finished children, which wait for this node's id

    def joined(self, n: int, conv_id: int) -> None:
        self.n += n
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)


def _closed(node: Node, up: Node | None, ends_sha256: str, key: bytes | None = None) -> Iterator[list]:
    """A finished node: its children get its id, its parent its sums."""
    for row in node.rows:
        row[3] = node.conv_id
        yield row
    leaves, saved = node.leaves + (not node.children), node.saved + (node.n - 1) * node.words
    row = ["done", node.conv_id, node.depth, None, node.n, node.children, leaves, saved, ends_sha256, key, None, None, None, None, None]
    if up is None:
        yield row
    else:
        up.rows.append(row)
        up.leaves, up.saved = up.leaves + leaves, up.saved + saved


def _opened(node: Node, up: Node | None, part: int, section: int) -> Iterator[list]:
    """A node that may go on in other ranges, and its finished children, which wait for its id."""
    for row in node.rows:
        row[0], row[10] = "waits", node.key
        yield row
    yield ["open", node.conv_id, node.depth, None, node.n, node.children, node.leaves, node.saved, None, node.key, up and up.key, node.words, _listed(node.ends), part, section]


def _listed(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def _key(above: bytes, turn: bytes = b"") -> bytes:
    return hashlib.sha256(above + turn).digest()[:_WIDTH]


def nodes(records: Iterator[tuple], part: int) -> Iterator[list]:
    """Rows of a range's nodes from its records in order, each with its LCP with the one before.

    Nodes on the first and the last path are open: their sums and children are the finished ones only.
    Open rows are to be read in order of section and depth: what both paths share, the first's rest, the last's.
    """
    stack: list[Node] = []
    first = True

    def pop() -> Iterator[list]:
        node = stack.pop()
        up = stack[-1] if stack else None
        if up:
            up.joined(node.n, node.conv_id)
        if node.first:
            yield from _opened(node, up, part, 1)
        else:
            up.children += 1
            yield from _closed(node, up, hashlib.sha256(_listed(node.ends).encode()).hexdigest())

    for turns, conv_id, words, lcp in records:
        while len(stack) > lcp + 1:
            yield from pop()
        if not stack:
            stack.append(Node(_key(b""), 0, 0, True))
        for depth in range(len(stack), len(turns) + 1):
            stack.append(Node(_key(stack[-1].key, turns[depth - 1]), depth, words[depth - 1], first))
        stack[-1].joined(1, conv_id)
        stack[-1].ends.append(conv_id)
        first = False
    while stack:
        node = stack.pop()
        up = stack[-1] if stack else None
        if up:
            up.joined(node.n, node.conv_id)
        yield from _opened(node, up, part, 0 if node.first else 2)


def merged(rows: Iterator[dict]) -> Iterator[list]:
    """Finished nodes, with their keys, of the open rows of all ranges in order."""
    stack: list[Node] = []

    def pop() -> Iterator[list]:
        node = stack.pop()
        yield from _closed(node, stack[-1] if stack else None, node.sha.hexdigest(), node.key)

    for r in rows:
        depth = r["depth"]
        if len(stack) > depth and stack[depth].key != r["key"]:
            while len(stack) > depth:
                yield from pop()
        if len(stack) == depth:
            if stack:
                stack[-1].children += 1
            stack.append(Node(r["key"], depth, r["words"]))
            stack[-1].sha = hashlib.sha256()
        node = stack[depth]
        node.joined(r["n_convs"], r["conv_id"])
        node.children, node.leaves, node.saved = node.children + r["n_children"], node.leaves + r["n_leaves"], node.saved + r["saved_tokens"]
        if r["ends"]:
            node.sha.update((("," if node.ends else "") + r["ends"]).encode())
            node.ends = [0]  # some have been hashed
    while stack:
        yield from pop()


def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of sequences to rows of its nodes."""
    part = TaskContext.get().partitionId()
    folder = tempfile.mkdtemp(prefix="runs-")  # this task's runs, gone with it
    try:
        records = ((([t["d"] for t in row["turns"]]), row["conv_id"], [t["w"] for t in row["turns"]]) for batch in batches for row in batch.to_pylist())
        runs = sorted_runs(records, folder)
        if runs:
            yield from _batches(nodes(iter(LoserTree(runs)), part))
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def sorted_runs(records: Iterator[tuple], folder: str, run_turns: int = RUN_TURNS) -> list[Run]:
    held, size, runs = [], 0, []
    for record in records:
        held.append(record)
        size += len(record[0]) + 1
        if size > run_turns:
            runs.append(Run(held, folder, len(runs)))
            held, size = [], 0
    return [*runs, Run(held, folder, len(runs))] if held else runs


_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in _OUT.split(", "))])


def _batches(rows: Iterator[list], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[list] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(merged(row for batch in batches for row in batch.to_pylist()))


def prefix_trie(turns: DataFrame, range_turns: int = RANGE_TURNS) -> DataFrame:
    """A row for each distinct beginning of rebuilt conversations: its members, children, leaves, what sharing saves, who ends there.

    ``turns`` needs ``conv_id, turn, role, text``; other columns are not read. Null roles and texts
    are empty; repeated rows are turns like any other; rows without ``conv_id`` are in no conversation; a
    table without conversations has no node, not even a root. Texts of any length are digested in
    Spark; two turns count as equal if 128 bits of their SHA-256 agree. ``ends_sha256`` is one hash over
    a node's ids in order, so its ids pass through one task, in pieces of one range each.
    """
    work = Workspace(turns.sparkSession)
    try:
        return kept(_trie(turns, range_turns, work), "trie")
    finally:
        work.close()


def _trie(turns: DataFrame, range_turns: int, work: Workspace) -> DataFrame:
    whole = work.keep(rebuilt(turns), "rebuilt")
    size = whole.agg(F.sum(F.size("turns") + 1)).first()[0] or 0  # one number: how many ranges
    ranges = max(1, -(-size // range_turns), min(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // 1000))
    dealt = whole.repartitionByRange(ranges, F.transform("turns", lambda t: t["d"]), "conv_id")
    rows = work.keep(dealt.mapInArrow(_ranged, _OUT), "nodes")
    opened = rows.where("state = 'open'").repartition(1).sortWithinPartitions("part", "section", "depth")
    closed = work.keep(opened.mapInArrow(_joined, _OUT), "closed")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = closed.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    waiting = rows.where("state = 'waits'").join(above, "parent_key").withColumn("parent_conv_id", F.col("above"))
    out = rows.where("state = 'done'").select(*columns).unionByName(waiting.select(*columns)).unionByName(closed.select(*columns))
    return out.withColumn("depth", F.col("depth").cast("long"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: One step of a CRC-32 by bits, for SQL without one.
_STEP = "(CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
OP12_SQL = r"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT DISTINCT conv_id FROM o),
h AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, c: list_reduce(list_prepend(xor(crc, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, unused: STEP)), 4294967295) % 4 AS h FROM i),
r AS (SELECT h.conv_id, role, text, place FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 20 AND place <= h
      UNION ALL SELECT h.conv_id, role, text, place + 100000000 FROM h JOIN o ON o.conv_id = h.conv_id AND place > h),
q AS (SELECT i.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY place) FILTER (WHERE place IS NOT NULL), []) AS turns FROM i LEFT JOIN r USING (conv_id) GROUP BY i.conv_id),
p AS (SELECT conv_id, len(turns) AS size, d AS depth, md5(to_json(list_slice(turns, 1, d))::VARCHAR) AS key,
      CASE WHEN d > 0 THEN md5(to_json(list_slice(turns, 1, d - 1))::VARCHAR) END AS parent,
      CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].text, '[^ 	-]+')) ELSE 0 END AS words
      FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM q)),
n AS (SELECT key, any_value(parent) AS parent, any_value(depth)::BIGINT AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words)::BIGINT AS words,
      sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256 FROM p GROUP BY key),
c AS (SELECT parent AS key, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (key)),
up AS (SELECT DISTINCT b.key AS below, a.key AS above FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
s AS (SELECT above AS key, count_if(n_children = 0)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens FROM up JOIN m ON m.key = up.below GROUP BY above)
SELECT m.conv_id, m.depth, z.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256
FROM m JOIN s USING (key) LEFT JOIN m z ON z.key = m.parent
""".replace("STEP", _STEP)
