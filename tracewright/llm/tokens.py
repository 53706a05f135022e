"""Token-ID output: flat unsigned integer files and 64-bit document offsets, memory-mapped back.

A folder holds, for each partition ``p`` of the range-sorted documents,

* ``p.bin``: the token ids end to end, little-endian unsigned integers of one width;
* ``p.idx``: n+1 little-endian unsigned 64-bit offsets, in ids, of the partition's documents;
* ``p.doc``: n little-endian signed 64-bit document ids (a null id is -2**63);

and ``manifest`` (Parquet): ``part, bin, n_docs, n_ids, base_docs, base_ids``, whose bases are
prefix sums over partitions, so a partition's documents know their place in the whole output.
"""

from __future__ import annotations

import os
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm import _text
from tracewright.llm._store import shared_folder

NULL_ID = -(1 << 63)
END_ID = 1
WIDTHS = {"uint16": "<u2", "uint32": "<u4"}


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    found, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return (pafs.LocalFileSystem(use_mmap=True) if isinstance(found, pafs.LocalFileSystem) else found), path


#: Marks at which a word can be cut: ASCII ones but for apostrophe and those of special tokens.
_MARK = _text._table(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<|>")
_ALNUM = _text._table(c for c in range(33, 127) if chr(c).isalnum())


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut where letters or digits meet marks, see ``WordIds``."""
    starts, ends, _ = _text.spans(data, offsets, _text.BLANK)
    mark, letter = _MARK[data], _ALNUM[data]
    cuts = np.flatnonzero(mark[1:] & letter[:-1] | mark[:-1] & letter[1:]) + 1
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    cuts = cuts[~edge[cuts]]
    starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


@lru_cache(maxsize=2)
def _memory(path: str) -> WordIds:
    """The pieces that this worker knows; it serves many tasks."""
    return WordIds(path)


class WordIds:
    """Ids of texts, with every distinct piece of a word encoded once in a worker.

    Blanks never reach an id and no piece of the tokenizer spans one, nor a change between ASCII
    letters or digits and ASCII marks (apostrophes and the marks of special tokens aside); case is
    folded first. So a text's ids are those of such pieces one after another. The memory of pieces
    is emptied at ``most``.
    """

    def __init__(self, path: str, most: int = 2_000_000):
        self.path, self.most = path, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.n, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids = [e.ids for e in _tokenizer(self.path).encode_batch_fast(words, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        at = len(self.flat) + np.cumsum(n) - n
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys)
        self.keys, self.at, self.n = keys[order], np.concatenate([self.at, at])[order], np.concatenate([self.n, n])[order]
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.int64, int(n.sum()))])

    def encode(self, column, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and each text's number of ids."""
        data, offsets = _text.encoded(column)
        data = _text.lowered(data)
        starts, ends, first = _pieces(data, offsets)
        keys, at, back = np.unique(_text.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.clear()
        new = np.flatnonzero(~np.isin(keys, self.keys, assume_unique=True))
        if len(new):
            raw = data.tobytes()
            self._learn(keys[new], [raw[starts[i] : ends[i]].decode() for i in at[new]])
        place = np.searchsorted(self.keys, keys)[back]
        # an end after each text's words, as one more word of one id
        texts = len(offsets) - 1
        lengths, source = np.ones(len(place) + texts, np.int64), np.full(len(place) + texts, len(self.flat))
        own = np.arange(len(place)) + _text.owners(first)
        lengths[own], source[own] = self.n[place], self.at[place]
        total = np.concatenate([[0], np.cumsum(lengths)])
        index = np.arange(total[-1]) + np.repeat(source - total[:-1], lengths)
        ids = np.append(self.flat, end_id)[index]
        return ids, np.diff(total[np.concatenate([[0], first[1:] + np.arange(1, texts + 1)])])


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, width: str = "uint16") -> DataFrame:
    """Tokenize all texts into files below ``folder`` in ascending ``doc_id`` order; returns the manifest.

    Null ids come first; rows of one id are ordered by a hash of their text. A null or empty text
    is a document of one id, the end. 16 bits hold every id of the tokenizer; wider ids need
    ``uint32``, one that does not fit fails. No document gives no partition. A task that runs again
    writes files of another name; the manifest names those of the run that counted.
    """
    path, kind = tokenizer or tokenizer_file(), np.dtype(WIDTHS[width])
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("_tie")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie")

    def run(batches):
        part, name, n_docs, n_ids = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, 0
        where, root = _filesystem(folder)
        files, words = None, _memory(path)
        for piece in _text.slices(batches):
            if files is None:
                where.create_dir(root, recursive=True)
                files = {k: where.open_output_stream(f"{root}/{name}.{k}") for k in ("bin", "idx", "doc")}
                files["idx"].write(np.zeros(1, "<u8").tobytes())
            flat, lengths = words.encode(piece.column("text"), end_id)
            if flat.max() > np.iinfo(kind).max:
                raise ValueError(f"an id does not fit {width}")
            files["bin"].write(flat.astype(kind).tobytes())
            files["idx"].write((n_ids + np.cumsum(lengths)).astype("<u8").tobytes())
            files["doc"].write(piece.column("doc_id").fill_null(NULL_ID).to_numpy().astype("<i8").tobytes())
            n_docs, n_ids = n_docs + len(lengths), n_ids + int(lengths.sum())
        if files is not None:
            for f in files.values():
                f.close()
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "bin": pa.array([name]), "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    spark = docs.sparkSession
    # the run is written once, then read: later steps see exactly the files it counted
    ordered.mapInArrow(run, "part int, bin string, n_docs long, n_ids long").write.parquet(f"{folder}/parts")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = spark.read.schema("part int, bin string, n_docs long, n_ids long").parquet(f"{folder}/parts")
    bases = parts.withColumn("base_docs", F.coalesce(F.sum("n_docs").over(ahead), F.lit(0))).withColumn("base_ids", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)))
    bases.write.parquet(f"{folder}/manifest")
    return spark.read.schema("part int, bin string, n_docs long, n_ids long, base_docs long, base_ids long").parquet(f"{folder}/manifest")


def _mapped(where: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file's integers; on a local or mounted file system without copying it into memory."""
    if isinstance(where, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with where.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), kind)


def read(spark, folder: str, width: str = "uint16") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, rank`` of every document, from the files."""
    kind = WIDTHS[width]
    manifest = spark.read.schema("part int, bin string, n_docs long, n_ids long, base_docs long, base_ids long").parquet(f"{folder}/manifest")

    def run(batches):
        where, root = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                ids, bounds, docs = (_mapped(where, f"{root}/{row['bin']}.{k}", t) for k, t in (("bin", kind), ("idx", "<u8"), ("doc", "<i8")))
                for at in range(0, row["n_docs"], 10_000):
                    b = np.asarray(bounds[at : at + 10_001]).astype(np.int64)
                    own = np.asarray(docs[at : at + 10_000])
                    crc = [zlib.crc32(np.asarray(ids[b[i] : b[i + 1]]).astype("<u4").tobytes()) for i in range(len(own))]
                    yield pa.record_batch({"doc_id": pa.array(own, mask=own == NULL_ID), "start": pa.array(row["base_ids"] + b[:-1]), "n_tokens": pa.array(np.diff(b)), "ids_crc32": pa.array(crc, pa.int64()), "rank": pa.array(row["base_docs"] + at + np.arange(len(own)))})

    # a row is a file to map: a fixed number of partitions, which Spark does not put together again
    spread = manifest.repartition(max(1, manifest.count()), "part")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, rank long")


def op7_token_ids(spark, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the files."""
    folder = f"{shared_folder(spark)}/tokens"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def token_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the mix as token files and return what the files hold of each document."""
    folder = f"{shared_folder(spark)}/tokens"
    write(docs, folder)
    return read(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
