"""What a stream of lines remembers of each text: the last grams used, and for each word its last lines.

Both memories are bounded and evict what was used longest ago, so the state of a text has a largest
size whatever its length: ``GRAMS`` four-byte grams, and ``WORDS`` words with ``POSTINGS`` lines each.
They are kept compressed, and the grams and words of a line are made where they are remembered: only its bytes move.
State is kept by ``transformWithState`` in RocksDB with a changelog in the checkpoint: a restart, or a lost
executor, goes on where the last finished micro-batch ended.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tracewright.operators import signal as S
from tracewright.operators import signal_lists as L

#: Grams that are remembered, lines of a word, similarity and words from which a line restates another.
GRAMS, POSTINGS, LEAST, TOKENS = 32768, 16, 0.64, 4
#: Words that are remembered.
WORDS = 8192

_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition's manifest takes 4 MB of disk in advance
}
_OUT = "line_no long, bytes int, sampled int, unseen long, earlier long, similarity double"


class Grams:
    """A dictionary of bounded size that forgets the gram used longest ago."""

    def __init__(self, data: bytes = b"", most: int = GRAMS):
        planes = np.frombuffer(zlib.decompress(data) if data else b"", np.uint8).reshape(4, -1)
        self.known = OrderedDict.fromkeys(np.ascontiguousarray(planes.T).view(">u4").ravel().tolist())
        self.most = most

    def unseen(self, grams) -> int:
        """How many distinct grams of a line are new; they are remembered."""
        own = dict.fromkeys(int(g) for g in grams)
        new = sum(g not in self.known for g in own)
        for g in own:
            self.known[g] = None
            self.known.move_to_end(g)
            if len(self.known) > self.most:
                self.known.popitem(last=False)
        return new

    def data(self) -> bytes:
        # first bytes, then second ones and so on: grams overlap, so each plane is nearly the one before
        return zlib.compress(np.fromiter(self.known, ">u4", len(self.known)).view(np.uint8).reshape(-1, 4).T.tobytes())


class Postings:
    """The last lines of each word, and the words of the lines that some word still names."""

    def __init__(self, data: bytes = b"", words: int = WORDS, most: int = POSTINGS):
        saved = json.loads(zlib.decompress(data)) if data else {"all": "", "posted": [], "lines": []}
        names, numbers = saved["all"].split(" "), [x[0] for x in saved["lines"]]
        self.of = OrderedDict((names[i], [numbers[at] for at in posted]) for i, posted in enumerate(saved["posted"]))
        self.lines = {n: [{names[i] for i in ws}, template, uses] for n, ws, template, uses in saved["lines"]}
        self.words, self.most = words, most

    def restated(self, line_no: int, tokens: list[str], template: int) -> tuple[int | None, float | None]:
        """The most similar line that the tokens still name, of another template, the first of equals; the line is remembered."""
        own, best = set(tokens), None
        if len(own) >= TOKENS:
            for n in {n for w in own for n in self.of.get(w, ())}:
                other, known, _ = self.lines[n]
                same = len(own & other)
                near = same / (len(own) + len(other) - same)
                if known != template and near >= LEAST and (best is None or (near, -n) > best):
                    best = (near, -n)
            self._remember(line_no, own, template)
        return (None, None) if best is None else (-best[1], round(best[0], 3))

    def _remember(self, line_no: int, own: set[str], template: int) -> None:
        self.lines[line_no] = [own, template, 0]
        for w in sorted(own):
            posted = self.of.setdefault(w, [])
            self.of.move_to_end(w)
            posted.append(line_no)
            self.lines[line_no][2] += 1
            if len(posted) > self.most:
                self._forget(posted.pop(0))
            if len(self.of) > self.words:
                for n in self.of.popitem(last=False)[1]:
                    self._forget(n)

    def _forget(self, line_no: int) -> None:
        self.lines[line_no][2] -= 1
        if not self.lines[line_no][2]:
            del self.lines[line_no]

    def data(self) -> bytes:
        # each word once, those that are remembered first; all else names words and lines by their places
        names = dict.fromkeys([*self.of, *sorted({w for ws, _, _ in self.lines.values() for w in ws})])
        place, line = {w: i for i, w in enumerate(names)}, {n: i for i, n in enumerate(self.lines)}
        posted = [[line[n] for n in ls] for ls in self.of.values()]
        lines = [[n, sorted(place[w] for w in ws), t, u] for n, (ws, t, u) in self.lines.items()]
        return zlib.compress(json.dumps({"all": " ".join(names), "posted": posted, "lines": lines}, separators=(",", ":")).encode())


def sampled(data: bytes) -> list[int]:
    """The four-byte sequences of a line as numbers, every second one of a line over 48 bytes."""
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    at = np.arange(0, len(x) - 3, 2 if len(x) > 48 else 1)
    return ((x[at] << 24) | (x[at + 1] << 16) | (x[at + 2] << 8) | x[at + 3]).tolist()


_WORD = re.compile(rb"[a-z0-9_]{3,}")


def _words(data: bytes) -> list[str]:
    """The tokens of ``prepared`` of an ASCII line."""
    return [w for w in dict.fromkeys(x.decode() for x in _WORD.findall(data.lower())) if w not in L.STOP_WORDS]


def _walk(rows: pd.DataFrame, grams: Grams, postings: Postings) -> list[tuple]:
    out = []
    for line_no, data, tokens, template in rows.sort_values("line_no")[["line_no", "data", "tokens", "template"]].itertuples(index=False):
        tokens = _words(bytes(data)) if tokens is None else list(tokens)
        earlier, near = postings.restated(int(line_no), tokens, int(template))
        own = sampled(bytes(data))
        out.append((int(line_no), len(data), len(own), grams.unseen(own), earlier, near))
    return out


class LineMemory(StatefulProcessor):
    """The state of one text: both memories as bytes, read and written once for each micro-batch."""

    def __init__(self, grams: int = GRAMS, words: int = WORDS):
        self.grams, self.words = grams, words

    def init(self, handle) -> None:
        self.state = handle.getValueState("memory", "grams binary, postings binary")

    def handleInputRows(self, key, rows, timerValues):
        known, posted = self.state.get() if self.state.exists() else (b"", b"")
        grams, postings = Grams(bytes(known), self.grams), Postings(bytes(posted), self.words)
        out = _walk(pd.concat(list(rows)), grams, postings)
        self.state.update((grams.data(), postings.data()))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])
        frame.insert(0, "key", key[0])
        yield frame

    def close(self) -> None:
        pass


def prepared(lines: DataFrame, key: str) -> DataFrame:
    """key, line_no, data (the line's bytes), tokens, template of nonblank lines (``key, line_no, line``): all that the memory needs."""
    x = lines.withColumn("line", F.coalesce("line", F.lit(""))).withColumn("blank", F.col("line").rlike(L.BLANK))
    tokens = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("line"), F.lit("[a-z0-9_]{3,}"), F.lit(0)), lambda w: ~w.isin(*L.STOP_WORDS)))
    y = x.where("NOT blank").withColumn("tokens", tokens).withColumn("template", F.xxhash64(S.template(F.col("line"))))
    return y.select(F.col(key).alias("key"), F.col("line_no").cast("long").alias("line_no"), F.encode("line", "utf-8").alias("data"), "tokens", "template")


def remembered(lines: DataFrame, key: str, grams: int = GRAMS, words: int = WORDS) -> DataFrame:
    """key, line_no, novelty, earlier, similarity of every nonblank line of a stream, in order of ``line_no`` within each micro-batch.

    ``lines`` (``key, line_no, line``) must be a stream of a session whose state lies in RocksDB (see
    ``line_stream``). Lines of a text should come in ascending order over micro-batches: the memory
    takes them as they come.
    """
    kind = dict(lines.dtypes)[key]
    # the words of an ASCII line are taken where they are remembered: Java and Python agree on its lower case
    rows = prepared(lines, key).withColumn("tokens", F.when(F.length(F.decode("data", "utf-8")) < F.length("data"), F.col("tokens")))
    ran = rows.groupBy("key").transformWithStateInPandas(LineMemory(grams, words), f"key {kind}, {_OUT}", "Append", "None")
    return ran.select(F.col("key").alias(key), "line_no", (S.novel(F.col("unseen"), F.col("sampled"), F.col("bytes")) / 10000).alias("novelty"), "earlier", "similarity")


def line_stream(spark: SparkSession, path: str, key: str, text: str = "text", files: int = 1000) -> DataFrame:
    """A stream of the lines of all texts in the parquet files at ``path``, in a session whose state lies in RocksDB."""
    session = spark.newSession()
    for k, v in {**_ROCKS, "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}.items():
        session.conf.set(k, v)
    path = path.rstrip("/")
    schema = spark.read.parquet(path).select(key, text).schema
    rows = session.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")
    every = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n"), "\n", -1)
    return rows.select(F.col(key), F.posexplode(every).alias("_p", "line")).select(key, (F.col("_p") + 1).alias("line_no"), "line")


def written(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run a stream over all that is there, appending to parquet at ``out``; run again, it goes on."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
