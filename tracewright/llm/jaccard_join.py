"""N-gram Jaccard join with token-combination prefixes.

A text's set holds the hashes of its distinct k-word shingles. Equal sets become one node. With
tokens in hash order, two sets of similarity ``t`` share a token inside their prefixes of
``n - ceil(t * n) + 1`` tokens, and ``e`` more if the prefixes are extended by ``e`` tokens. Each
node stores its extended prefix; tokens that more than ``FREQUENT`` nodes store are of the frequent
class. A node that stores fewer of them than its partners' extensions have tokens is *plain*: it
shares a rare token with every set it links with, and is indexed by its rare tokens alone. A
passage that thousands of texts share makes no posting.

The other nodes are *deep*: many of their tokens are frequent, as in large groups of near copies.
To compare them with each other their prefix is extended to the whole set and ordered by the tokens'
exact frequencies, rare first. A node whose prefix holds rare tokens alone is indexed by them; one
whose prefix reaches the frequent class is indexed by token combinations too: its tokens are dealt
by hash into a few more classes than two linked sets of that size can differ in tokens, and the
combination of all tokens in a class is one entry. By the pigeonhole principle linked sets agree on
a whole class, so no link is lost.

Candidates are verified on their texts. Nodes that combinations hold together are a family. A
small family is compared in itself. In a large one the member with the smallest share of rare tokens is
the centre, and members are compared by their differences from it: two sets differ exactly by what
their differences do, and if one is not linked to the centre, linked sets share part of their
difference. A prefix of the differences, rare tokens first, indexes that join; members of its large
postings are compared by combinations of one more token, around a new centre, and so are members
too far from a centre to link with those near it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracewright.llm import _text
from tracewright.llm._store import Workspace, kept
from tracewright.llm.exact_dedup import _filter

#: A token in more nodes than this is of the frequent class.
FREQUENT = 8
#: Families of more nodes than this are compared by differences from their centre.
LARGE = 16
#: Postings of differences of more nodes than this are centred anew.
DIRECT = 256
#: Large postings of differences are centred anew so many times; what is then left of them is compared directly.
LEVELS = 8
#: How often a set is dealt into classes until few enough are empty; in the last deal empty classes count too.
DEALS = 6
_GROWTH = 1.15


def size_classes(most: int) -> list[int]:
    """Smallest size of each size class; a fixed rule, so all tasks agree."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * _GROWTH))))
    return out


def _combinations(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the token combinations of one set (see module), for each size class of its larger partners."""
    n = len(tokens)
    reach = 100 * n // percent  # largest partner
    lows = size_classes(reach + 1)
    out = []
    for c in range(len(lows) - 1):
        if lows[c + 1] <= n or lows[c] > reach:
            continue
        largest = lows[c + 1] - 1
        differ = 2 * largest * (100 - percent) // (100 + percent)
        if not differ:
            continue  # sets of these sizes link only if equal
        # linked sets agree on spare + 1 classes, so one of them holds tokens if no more than spare are empty
        spare = 2 + differ // 6
        classes = differ + 1 + spare
        for deal in range(DEALS):
            salt = np.uint64(((c + 1) * DEALS + deal) * 0x9E3779B97F4A7C15 & (2**64 - 1))
            mixed = _text.mix(tokens ^ salt)
            which = ((mixed >> np.uint64(32)) % np.uint64(classes)).astype(np.int64)
            total = np.zeros(classes, np.uint64)
            np.add.at(total, which, mixed)
            full = np.bincount(which, minlength=classes) > 0
            enough = (~full).sum() <= spare
            if not enough and deal == DEALS - 1:
                full[:] = True
            entry = _text.mix(total + np.arange(classes, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + salt)
            out.append(entry[full])
            if enough:
                break  # a set with too many empty classes is dealt again, and meets all others that are
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def token_sets(column, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, first = _text.word_hashes(column)
    shingles, at = _text.shingle_hashes(words, first, k)
    return [np.unique(shingles[at[i] : at[i + 1]]) for i in range(len(at) - 1)]


def _node(tokens: np.ndarray) -> int:
    """A 64-bit fingerprint of the whole set."""
    n = np.uint64(len(tokens))
    both = _text.mix(tokens).sum(dtype=np.uint64) ^ (np.bitwise_xor.reduce(_text.mix(tokens + np.uint64(1)), initial=np.uint64(0)) + n)
    return int(_text.mix(np.array([both + n]))[0].view(np.int64))


def _ids(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, node, n of every row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for piece in _text.slices(batches):
            sets = token_sets(piece.column("text"), k)
            yield pa.record_batch({"doc_id": piece.column("doc_id"), "node": pa.array([_node(s) for s in sets], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, node long, n long")


def _one_of_each(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """One of ``rows`` for each (doc_id, node) of ``wanted``, all columns."""
    shape = rows.schema

    def run(batches):
        for piece in _text.slices(batches):
            node = pa.array([_node(s) for s in token_sets(piece.column("text"), k)], pa.int64())
            yield pa.record_batch([*piece.columns, node], [*piece.schema.names, "_node"])

    named = rows.mapInArrow(run, StructType([*shape.fields, StructField("_node", LongType())]))
    own = wanted.select("doc_id", F.col("node").alias("_node"))
    return named.join(own, ["doc_id", "_node"], "left_semi").dropDuplicates(["doc_id", "_node"]).select(*shape.names)


def _repeated(ids: DataFrame) -> DataFrame:
    """doc_id of several rows."""
    return ids.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")


def _head(n: int, percent: int) -> int:
    """How many tokens of a set of ``n`` are stored: its prefix and some more, the extension."""
    prefix = n - -(-percent * n // 100) + 1
    return min(n, prefix + prefix // 5 + 8)


def _extension(percent: int, n):
    """By how many tokens the prefix of a set of ``n`` is extended."""
    prefix = n - F.ceil(percent * n / 100) + 1
    return F.least(n, prefix + F.floor(prefix / 5) + 8) - prefix


def _slack(percent: int):
    """How many stored tokens of a plain node may be frequent: the extension of the smallest set that links with it.

    Linked sets with extensions of ``e`` tokens or more have ``e + 1`` common tokens among those
    both store, so one of them at least is not frequent.
    """
    return _extension(percent, F.ceil(percent * F.col("n") / 100))


def _repeated(ids: DataFrame) -> DataFrame:
    """doc_id of several rows."""
    return ids.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")


def _head(n: int, percent: int) -> int:
    """How many tokens of a set of ``n`` are stored: its prefix and some more, the extension."""
    prefix = n - -(-percent * n // 100) + 1
    return min(n, prefix + prefix // 5 + 8)


def _slack(percent: int):
    """How many stored tokens of a plain node may be frequent: the extension of the smallest set that links with it.

    Linked sets with extensions of ``e`` tokens or more have ``e + 1`` common tokens among those
    both store, so one of them at least is not frequent.
    """
    n = F.ceil(percent * F.col("n") / 100)
    prefix = n - F.ceil(percent * n / 100) + 1
    return F.least(n, prefix + F.floor(prefix / 5) + 8) - prefix


def _repeated(ids: DataFrame) -> DataFrame:
    """doc_id of several rows."""
    return ids.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")


def _head(n: int, percent: int) -> int:
    """How many tokens of a set of ``n`` are stored: its prefix and a little more, in place of frequent ones."""
    prefix = n - -(-percent * n // 100) + 1
    return min(n, prefix + prefix // 5 + 8)


def _repeated(ids: DataFrame) -> DataFrame:
    """doc_id of several rows."""
    return ids.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")


def _maybe(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` whose id may be one of ``ids(doc_id)``, and all others: a bitmap of the ids goes to the rows, no text moves."""
    one, may = _filter(ids.select(F.col("doc_id").alias("digest")))
    told = docs.crossJoin(F.broadcast(one))
    is_one = F.col("doc_id").isNotNull() & may(F.col("doc_id"))
    # the id is made from both sides, so that no later join by id is planned below this one, where all texts would move
    rows = told.withColumn("doc_id", F.when(is_one, F.col("doc_id"))).where("doc_id is not null")
    return rows.select(*docs.columns), told.where(~is_one).select(*docs.columns)


def _texts(docs: DataFrame, several: DataFrame, wanted: DataFrame, k: int, work: Workspace) -> DataFrame:
    """doc_id, text of the nodes ``wanted(doc_id, node)``, one row for each node, bucketed by id: joins by id move no text again.

    ``several`` has the ids of several rows.
    """
    wanted = work.keep(wanted.distinct(), "wanted")
    rows, _ = _maybe(docs.select("doc_id", "text"), wanted)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt by id before the semi-join, which then moves ids only: a text is shuffled once
    part = rows.repartition(n, "doc_id").join(wanted.join(several, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_semi")
    if not several.isEmpty():
        own = work.keep(wanted.join(several, "doc_id"), "several")
        part = part.unionByName(_one_of_each(rows.join(own.select("doc_id"), "doc_id", "left_semi"), own, k).repartition(n, "doc_id"))
    return work.bucketed(part, "texts", "doc_id", n)


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """doc_id, node, n, tokens of every text: the whole set in hash order."""
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for piece in _text.slices(batches):
            sets = token_sets(piece.column("text"), k)
            tokens = _text.lists(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64), np.cumsum([0, *map(len, sets)]))
            yield pa.record_batch({"doc_id": piece.column("doc_id"), "node": pa.array([_node(s) for s in sets], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "tokens": tokens})

    return texts.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, node long, n long, tokens array<long>")


def _stored(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """token, node of the heads of all texts; those of copies come several times."""

    def run(batches):
        for piece in _text.slices(batches):
            sets = {_node(s): s for s in token_sets(piece.column("text"), k)}
            heads = [s[: _head(len(s), percent)] for s in sets.values()]
            tokens = np.concatenate([np.zeros(0, np.uint64), *heads]).view(np.int64)
            yield pa.record_batch({"token": pa.array(tokens), "node": pa.array(np.repeat(np.fromiter(sets, np.int64, len(sets)), [len(h) for h in heads]), pa.int64())})

    return docs.where("doc_id is not null").select("text").mapInArrow(run, "token long, node long")


def _prefix(percent: int):
    """Length of the prefix of a set."""
    return F.col("n") - F.ceil(percent * F.col("n") / 100) + 1


def _fits(percent: int, a: str, b: str):
    """Whether sets of these sizes can link."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _met(entries: DataFrame, percent: int, *more: F.Column) -> DataFrame:
    """a, b of nodes that can link and share a token of entries (token, node, n, ...), once for each such token."""
    x, y = entries.alias("x"), entries.alias("y")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & _fits(percent, "x.n", "y.n"))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), *more)


def _met_rare(entries: DataFrame, percent: int) -> DataFrame:
    """a, b, not both deep, that share enough of the rare tokens (token, node, n, often, deep) they store.

    Linked sets have ``e + 1`` common tokens in both stores, ``e`` the smaller extension, and of
    these no more are frequent than either stores.
    """
    least = 1 + F.least(_extension(percent, F.col("x.n")), _extension(percent, F.col("y.n"))) - F.least("x.often", "y.often")
    both = _met(entries, percent, least.alias("_least"), (F.col("x.deep") & F.col("y.deep")).alias("_deep")).where("not _deep")
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_c"), F.max("_least").alias("_least")).where("_c >= _least").select("a", "b")


def _compared(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose texts are linked."""
    who = nodes.select("node", "doc_id")
    named = pairs.join(who.select(F.col("node").alias("b"), F.col("doc_id").alias("_b")), "b").join(who.select(F.col("node").alias("a"), F.col("doc_id").alias("_a")), "a")
    both = named.join(texts.withColumnsRenamed({"doc_id": "_b", "text": "text_b"}), "_b").join(texts.withColumnRenamed("doc_id", "_a"), "_a")

    def run(batches):
        for piece in _text.slices(batches, most=1 << 20):
            found = []
            left, other = token_sets(piece.column("text"), k), token_sets(piece.column("text_b"), k)
            for x, y, a, b in zip(left, other, *(piece.column(c).to_pylist() for c in ("a", "b")), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                # an id may have several texts: only those of the nodes count
                if 100 * common >= percent * (len(x) + len(y) - common) and _node(x) == a and _node(y) == b:
                    found.append((a, b))
            yield pa.record_batch({c: pa.array([f[i] for f in found], pa.int64()) for i, c in enumerate(("a", "b"))})

    return both.select("a", "b", "text", "text_b").mapInArrow(run, "a long, b long")


def _combined(sets: DataFrame, percent: int) -> DataFrame:
    """token, node: the token combinations of whole sets (node, tokens)."""

    def run(batches):
        for batch in batches:
            found = [_combinations(np.asarray(t.values, np.int64).view(np.uint64), percent).view(np.int64) for t in batch.column("tokens")]
            yield pa.record_batch({"token": pa.array(np.concatenate([np.zeros(0, np.int64), *found])), "node": pa.array(np.repeat(batch.column("node").to_numpy(), [len(f) for f in found]), pa.int64())})

    return sets.select("node", "tokens").mapInArrow(run, "token long, node long")


def _most(percent: int, a="n", b=None):
    """In how many tokens linked sets of these sizes differ at most; without ``b`` for any partner."""
    total = F.col(a) + (F.floor(100 * F.col(a) / percent) if b is None else F.col(b))
    return F.floor(total * (100 - percent) / (100 + percent))


def _recentred(members: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """group, node, n, difference, label, linked, centre, centre_n, own, _reach: differences from the member nearest to the old centre.

    ``x ^ centre`` is ``(x ^ old) ^ (centre ^ old)``: no set is read again.
    """
    centre = members.groupBy("group").agg(F.min_by(F.struct("node", "n", "label", "difference"), F.struct(F.size("difference"), F.col("node"))).alias("_c"))
    both = members.join(centre, "group")
    difference = F.concat(F.array_except("difference", "_c.difference"), F.array_except("_c.difference", "difference"))
    both = both.select("group", "node", "n", difference.alias("difference"), "label", F.col("_c.node").alias("centre"), F.col("_c.n").alias("centre_n"), F.col("_c.label").alias("_l"))
    near = F.size("difference") <= _most(percent, "n", "centre_n")
    both = both.join(members.groupBy("group").agg(F.max(_most(percent)).alias("_reach")), "group")
    return work.keep(both.withColumn("linked", near).withColumn("own", F.col("label")).withColumn("label", F.when(near, F.col("_l")).otherwise(F.col("label"))).drop("_l"), "recentred")


def _shared_least(percent: int):
    """How many tokens the difference of a member shares at least with that of any partner that counts (see module)."""
    m, n = F.size("difference"), F.col("n")
    most = _most(percent)
    least = F.floor((F.ceil(percent * n / 100) + F.col("centre_n")) * (100 - percent) / (100 + percent)) + 1  # of a partner not linked to the centre
    return F.greatest(F.when(F.col("linked"), F.ceil((m + least - most) / 2)).otherwise(m - most), F.lit(1))


def _hopeful(entry: DataFrame, percent: int) -> DataFrame:
    """The members (group, node, n, linked, label, m, _least, token) that may have a partner, and ``_f`` of each token.

    ``_f`` counts the members that have the token; it is null if all of them are of one component
    or linked to the centre, for then the token makes no pair. The differences of linked members
    share ``(m_a + m_b - most) / 2`` tokens, and a member cannot share more than the ``u`` that have
    a count: so ``2 * u_b - m_b >= m_a - most`` for each of the two.
    """
    often = entry.groupBy("group", "token").agg(F.count(F.lit(1)).alias("_f"), F.min("label").alias("_low"), F.max("label").alias("_high"), F.min("linked").alias("_all")).where("_f > 1 and _low < _high and not _all").select("group", "token", "_f")
    counted = entry.drop("_f", "_u").join(often, ["group", "token"], "left")
    member = counted.groupBy("group", "node").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.first("linked").alias("linked"), F.first("_least").alias("_least"), F.count("_f").alias("_u"))
    member = member.withColumn("_spare", 2 * F.col("_u") - F.col("m")).withColumn("_over", F.col("m") - _most(percent))
    most = member.groupBy("group").agg(F.max("_spare").alias("_spare_most"), F.min(F.when(~F.col("linked"), F.col("_over"))).alias("_over_least"))
    fit = (F.col("_u") >= F.col("_least")) & F.when(F.col("linked"), F.col("_spare") >= F.col("_over_least")).otherwise(F.col("_over") <= F.col("_spare_most"))
    return counted.drop("_u").join(member.join(most, "group").where(fit).select("group", "node", "_u"), ["group", "node"])


def _around_centres(members: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """a, b of linked nodes of different components in one family (group, node, n, difference, label), by their differences."""
    edges = members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    for level in range(LEVELS):
        last = level == LEVELS - 1
        around = _recentred(members, percent, work)
        edges = edges.unionByName(around.where("linked and node <> centre and own <> label").select(F.col("centre").alias("a"), F.col("node").alias("b")))
        # linked members are at most ``_reach`` apart, so far ones, in a group of their own, miss no partner
        members = around.where(F.size("difference") > 2 * F.col("_reach")).select(F.xxhash64("group").alias("group"), "node", "n", "difference", "label")
        if not last:
            around = around.where(F.size("difference") <= 3 * F.col("_reach"))
        # a group of one component, or of members that the centre links, has nothing to find
        open_ = around.groupBy("group").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.min("linked").alias("_all")).where("_low < _high and not _all").select("group")
        entry = around.join(open_, "group", "left_semi").select("group", "node", "n", "linked", "label", F.size("difference").alias("m"), _shared_least(percent).alias("_least"), F.explode("difference").alias("token"))
        entry = work.keep(_hopeful(work.keep(entry, "differences"), percent), "hopeful")
        if not entry.isEmpty():
            ranked = _hopeful(entry, percent).withColumn("_at", F.row_number().over(Window.partitionBy("group", "node").orderBy(F.coalesce("_f", F.lit(0)), "token")))
            entry = work.keep(ranked.where("_f is not null and _at <= m - _least + 1").drop("_least"), "entries")
            edges = edges.unionByName(work.keep(_near(entry if last else entry.where(F.col("_f") <= DIRECT), around, percent), "near"))
            rest = entry.where(F.col("_f") > DIRECT).select("group", "node", F.xxhash64("group", "token").alias("_next"))
            rest = rest.join(around.select("group", "node", "n", "difference", "label"), ["group", "node"]).select(F.col("_next").alias("group"), "node", "n", "difference", "label")
            members = members.unionByName(rest)
        if last:
            break
        members = work.keep(members, "members")
        if members.isEmpty():
            break
    return edges.distinct()


def _near(entry: DataFrame, around: DataFrame, percent: int) -> DataFrame:
    """a, b of linked members of a group that share a token of entries, by the differences in ``around``."""
    x, y = entry.alias("x"), entry.alias("y")
    # the two differences share so many tokens that each has as many, and the first shared one stands early in both
    share = F.greatest(F.ceil((F.col("x.m") + F.col("y.m") - _most(percent, "x.n", "y.n")) / 2), F.lit(1))
    near = _fits(percent, "x.n", "y.n") & (F.col("x._at") <= F.col("x.m") - share + 1) & (F.col("y._at") <= F.col("y.m") - share + 1) & (share <= F.least("x._u", "y._u"))
    met = x.join(y, (F.col("x.group") == F.col("y.group")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & ~(F.col("x.linked") & F.col("y.linked")) & near)
    pairs = met.select(F.col("x.group").alias("group"), F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    side = lambda c: around.select("group", F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("difference").alias(f"d_{c}"))
    both = pairs.join(side("a"), ["group", "a"]).join(side("b"), ["group", "b"])
    apart = F.size("d_a") + F.size("d_b") - 2 * F.size(F.array_intersect("d_a", "d_b"))
    return both.where(apart <= _most(percent, "n_a", "n_b")).select("a", "b")


def components(edges: DataFrame, nodes: DataFrame, work: Workspace) -> DataFrame:
    """``node, label``: for each node of ``nodes(node, label)`` the smallest label it can reach.

    Labels spread along edges and then jump to their own label's label; rounds grow with the
    logarithm of a component's width. Each round is a table in the shared folder.
    """
    both = work.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    touched = both.select(F.col("a").alias("node")).distinct()
    state = work.keep(nodes.join(touched, "node"), "labels").select("node", "label")
    while True:
        near = both.join(state.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        grown = state.join(near, "node").select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        # the label is an id; whoever has it as its first label may know a smaller one
        owner = grown.groupBy(F.col("_old").alias("_id")).agg(F.min("label").alias("_jump"))
        after = grown.join(owner, F.col("label") == F.col("_id"), "left").select("node", "_old", F.least("label", F.coalesce("_jump", "label")).alias("label"))
        after = work.keep(after, "labels")
        if not after.where("label < _old").limit(1).count():
            return after.select("node", "label")
        state = after.select("node", "label")


def _rare(docs: DataFrame, groups: DataFrame, k: int, percent: int, frequent: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Every node (doc_id, node, n, often, deep), and the rare tokens (token, node, n, often, deep) that several nodes store.

    Tokens move once: those of one value are told apart by node and counted where they meet.
    """
    before = F.lag("node").over(Window.partitionBy("token").orderBy("node"))
    stored = _stored(docs, k, percent).withColumn("_before", before).where("_before is null or _before <> node").drop("_before")
    tagged = work.keep(stored.withColumn("count", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("count > 1"), "tagged")
    often = tagged.where(F.col("count") > frequent).groupBy("node").agg(F.count(F.lit(1)).alias("_often"))
    named = groups.where("doc_id is not null").select("doc_id", "node", "n").join(often, "node", "left").withColumn("often", F.coalesce("_often", F.lit(0))).drop("_often")
    nodes = work.keep(named.withColumn("deep", F.col("often") > _slack(percent)), "nodes")
    return nodes, work.keep(tagged.where(F.col("count") <= frequent).join(nodes, "node").select("token", "node", "n", "often", "deep"), "rare")


def _families(sets: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """node, family of the nodes that share a token combination."""
    combo = work.keep(_combined(sets, percent), "combinations")
    heads = combo.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("_z")).where("a < _z").select("token", "a")
    edges = combo.join(heads, "token").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    return components(edges, sets.select("node", F.col("node").alias("label")), work).withColumnRenamed("label", "family")


def _components(docs: DataFrame, k: int, percent: int, frequent: int, large: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, node, n`` of every row, and ``node, doc_id, component`` of every node: its smallest id, the smallest node it is linked to."""
    work = Workspace(docs.sparkSession)
    ids = kept(_ids(docs, k), "ids")
    # where all ids of a node are null, nothing is linked
    groups = work.keep(ids.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "groups")
    several = work.keep(_repeated(ids), "several-ids")
    nodes, rare = _rare(docs, groups, k, percent, frequent, work)
    base = nodes.select("node", F.col("node").alias("label"))  # not ids: one id may be in several components

    deep = nodes.where("deep").select("doc_id", "node")
    texts = _texts(docs, several, deep, k, work)
    sets = work.keep(_sets(texts, k).join(deep.select("node"), "node", "left_semi"), "deep")
    work.remove(texts)
    each = sets.select("node", "n", F.explode("tokens").alias("token"))
    tokens = work.keep(each.withColumn("_f", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("_f > 1"), "deep-tokens")
    # tokens of one deep node come first in its order and meet nothing
    order = tokens.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("_f", "token"))).alias("_t"), F.count_if(F.col("_f") <= frequent).alias("_rare"))
    room = _prefix(percent) - (F.col("n") - F.size("_t"))
    order = work.keep(order.where(room > 0).select("node", "n", F.slice("_t", F.lit(1), F.least(room, F.size("_t")).cast("int")).alias("_t"), ((F.col("n") - F.size("_t") + F.col("_rare")) / F.col("n")).alias("_share")), "order")
    single = order.select("node", "n", F.explode("_t").alias("_t")).select("node", "n", "_t.token", "_t._f").where(F.col("_f") <= frequent)
    inner = order.where(F.element_at("_t", -1)["_f"] > frequent).select("node", "_share")

    pairs = _met_rare(rare, percent).unionByName(_met(single, percent))
    frequent_sets = sets.join(inner, "node")
    family = work.keep(_families(frequent_sets, percent, work), "families")
    size = family.groupBy("family").count()
    of = family.join(size, "family").join(nodes.select("node", "n"), "node")
    small = of.where(F.col("count") <= large).select(F.col("family").alias("token"), "node", "n")
    pairs = work.keep(pairs.unionByName(_met(small, percent)).distinct(), "pairs")
    met = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts = _texts(docs, several, nodes.join(met, "node", "left_semi").select("doc_id", "node"), k, work)
    edges = work.keep(_compared(pairs, texts, nodes, k, percent), "links")

    big = of.where(F.col("count") > large)
    if not big.isEmpty():
        labels = components(edges, base, work)
        whole = big.select(F.col("family").alias("group"), "node", "n").join(frequent_sets.select("node", "tokens", "_share"), "node")
        centre = whole.groupBy("group").agg(F.min_by("tokens", F.struct("_share", "node")).alias("_c"))
        difference = F.concat(F.array_except("tokens", "_c"), F.array_except("_c", "tokens"))
        members = whole.join(centre, "group").join(labels, "node", "left").select("group", "node", "n", difference.alias("difference"), F.coalesce("label", "node").alias("label"))
        edges = edges.unionByName(_around_centres(work.keep(members, "members"), percent, work))
    final = components(edges, base, work)
    out = kept(groups.join(final, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("component")), "components")
    work.close()
    return ids, out


def linked(docs: DataFrame, k: int = 5, percent: int = 80, frequent: int = FREQUENT, large: int = LARGE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs(doc_id, text, ...)``.

    Texts link when the similarity of their sets of distinct ``k``-word shingles is at least
    ``percent`` / 100; ``component_id`` is the smallest id that links reach, the own one included.
    A null, empty or blank text has no shingles and links with nothing; a null id never names a
    component that also has another id. Repeated rows each get a row. Other columns are ignored.
    """
    ids, nodes = _components(docs, k, percent, frequent, large)
    names = nodes.groupBy("component").agg(F.min("doc_id").alias("_component"))
    named = nodes.join(names, "component").select("node", "_component")
    return ids.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("_component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Set size and component of every document, 3-word shingles, similarity 0.9."""
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the first by id and set; 5-word shingles, similarity 0.8.

    Rows of one id with other texts are other documents. Of texts without words one stays for each
    id; rows with a null id stay.
    """
    ids, nodes = _components(docs, 5, 80, FREQUENT, LARGE)
    first = nodes.where("doc_id is not null").groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("_f"))
    keep = kept(first.select("_f.doc_id", "_f.node").unionByName(ids.where("n = 0 and doc_id is not null").select("doc_id", "node").distinct()), "survivors")
    several = kept(_repeated(ids), "several")
    # only rows that may go are joined: an id that is in neither has one row, which stays
    gone = ids.where("doc_id is not null").join(keep, ["doc_id", "node"], "left_anti").select("doc_id")
    rows, rest = _maybe(docs, kept(gone.unionByName(several).distinct(), "gone"))
    own = rows.join(keep.join(several, "doc_id", "left_anti"), "doc_id", "left_semi")
    if not several.isEmpty():
        own = own.unionByName(_one_of_each(rows.join(several, "doc_id", "left_semi"), keep, 5).select(*own.columns))
    return own.unionByName(rest).select(*docs.columns)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 3 THEN [array_to_string(a, ' ')]
         ELSE list_distinct(list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2])) END AS t
  FROM w),
g AS (SELECT doc_id, list_sort(t) AS st FROM s),
r AS (SELECT st AS t, min(doc_id) AS rep, len(st) AS n FROM g WHERE len(st) > 0 GROUP BY st),
x AS (SELECT rep, n, hash(u) AS u FROM (SELECT rep, n, unnest(t) AS u FROM r)),
f AS (SELECT u FROM x GROUP BY u HAVING count(*) > 1),
y AS (SELECT x.* FROM x JOIN f USING (u)),
p AS (
  SELECT l.rep AS a, q.rep AS b FROM y l JOIN y q ON l.u = q.u AND l.rep < q.rep AND 100 * least(l.n, q.n) >= 90 * greatest(l.n, q.n)
  GROUP BY l.rep, q.rep, l.n, q.n HAVING 100 * count(*) >= 90 * (l.n + q.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
c AS (SELECT rep AS node, rep AS lab FROM r UNION SELECT e.b, c.lab FROM c JOIN e ON c.node = e.a WHERE c.lab < e.b),
m AS (SELECT node, min(lab) AS lab FROM c GROUP BY node)
SELECT s.doc_id, len(s.t)::BIGINT AS n_shingles, coalesce(m.lab, s.doc_id) AS component_id
FROM s LEFT JOIN r ON list_sort(s.t) = r.t LEFT JOIN m ON m.node = r.rep
"""
