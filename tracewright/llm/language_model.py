"""Hidden Markov language model over whole texts.

Tokens are lower-cased words and one end per text. Word counts over all training texts are a
table that grows with the corpus; the most frequent words (a bounded number) are broadcast, the
others meet their counts in a shuffled join. The model emits symbols: the end, each of the
commonest words, and classes of other words by their last bytes; inside a class a word has its
smoothed relative frequency. Baum-Welch counts come from all training texts, each one whole
sequence however long, partition by partition, summed by Spark; the scaled forward recursion then gives the exact likelihood.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import _text
from tracewright.llm._store import kept

STATES = 6
#: Words with a symbol of their own, and classes for the others.
OWN = 4095
CLASSES = 1024
SYMBOLS = 1 + OWN + CLASSES
#: At most so many words are broadcast with their counts (16 bytes each).
HEAD = 1 << 20
ROUNDS = 4
#: Training walks through so many tokens of a sequence at a time, all segments side by side; the counts are those of whole sequences.
SEGMENT = 256
#: Segments counted at once.
BLOCK = 4096
END = np.uint64(0)


@dataclass
class Vocabulary:
    words: np.ndarray  # sorted hashes of the head
    counts: np.ndarray
    symbols: np.ndarray  # of the head words
    class_log: np.ndarray  # log10(tokens + words + 1) of each class
    unigram: np.ndarray  # expected share of each symbol
    end: int
    tokens: int
    size: int


@dataclass
class Model:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # SYMBOLS x K


def _words(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of every word, and each text's first word."""
    data, offsets = _text.encoded(column)
    data = _text.lowered(data)
    starts, ends, first = _text.spans(data, offsets, _text.BLANK)
    code = np.zeros(len(starts), np.uint32)
    for back in (1, 2, 3):
        inside = ends - back >= starts
        code = code * np.uint32(0x01000193) + np.where(inside, data[np.maximum(ends - back, 0)], 0).astype(np.uint32) + np.uint32(1)
    return _text.hash_spans(data, starts, ends), ((code * np.uint32(0x9E3779B1)) >> np.uint32(22)).astype(np.int64), first


def _held(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _count_batches(batches):
    keys, counts, classes, size, texts = [], [], [], 0, 0

    def table():
        key, at, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        n = np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)
        return pa.record_batch({"word": pa.array(key.view(np.int64)), "class": pa.array(np.concatenate(classes)[at], pa.int32()), "c": pa.array(n)})

    for piece in _text.slices(batches):
        word, cls, _ = _words(piece.column("text"))
        key, at, n = np.unique(word, return_index=True, return_counts=True)
        keys.append(key), counts.append(n), classes.append(cls[at])
        size, texts = size + len(key), texts + piece.num_rows
        if size > 2_000_000:
            yield table()
            keys, counts, classes, size = [], [], [], 0
    if size:
        yield table()
    yield pa.record_batch({"word": pa.array(np.array([END]).view(np.int64)), "class": pa.array([-1], pa.int32()), "c": pa.array([texts], pa.int64())})


def count_words(training: DataFrame) -> DataFrame:
    """word (hash), class, c over all training texts; the end has class -1."""
    return kept(training.select("text").mapInArrow(_count_batches, "word long, class int, c long").groupBy("word", "class").agg(F.sum("c").alias("c")), "words")


def vocabulary(words: DataFrame, head: int = HEAD) -> Vocabulary:
    """The broadcast part: words of at least the count that at most ``head`` words reach."""
    real = words.where("class >= 0 and c > 0")
    histogram = real.groupBy("c").count().orderBy(F.desc("c")).toArrow()  # a row for each count that occurs
    reach = np.cumsum(histogram["count"].to_numpy())
    fits = int((reach <= head).sum())
    least = int(histogram["c"][fits - 1].as_py()) if fits else np.iinfo(np.int64).max
    top = real.where(F.col("c") >= least).toArrow()
    key, count, cls = top["word"].to_numpy().view(np.uint64), top["c"].to_numpy(), top["class"].to_numpy().astype(np.int64)
    order = np.argsort(key)
    key, count, cls = key[order], count[order], cls[order]
    own = np.lexsort((key, -count))[:OWN]
    symbol = 1 + OWN + cls
    symbol[own] = 1 + np.arange(len(own))
    totals = real.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toArrow()  # a row for each class
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    n[totals["class"].to_numpy()], v[totals["class"].to_numpy()] = totals["n"].to_numpy(), totals["v"].to_numpy()
    ends = int(words.where("class < 0").agg(F.sum("c")).first()[0] or 0)
    tokens, size = int(n.sum()) + ends, int(v.sum()) + (ends > 0)
    n -= np.bincount(cls[own], weights=count[own], minlength=CLASSES)
    v -= np.bincount(cls[own], minlength=CLASSES)
    shares = np.zeros(SYMBOLS)
    shares[0], shares[1 : 1 + len(own)], shares[1 + OWN :] = ends, count[own], n
    shares = (shares + 0.5) / (shares + 0.5).sum()
    return Vocabulary(key, count, symbol, np.log10(n + v + 1), shares, ends, tokens, size)


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """A row for each document: symbols, sums over head words, and the other words.

    row, doc_id, held_out, n_tokens, n_known, head_log, class_log, symbols (2 bytes each), tail.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own, row = shared.value, TaskContext.get().partitionId() << 33
        logs = np.append(np.log10(own.counts + 1.0), 0.0)
        for piece in _text.slices(batches):
            word, cls, first = _words(piece.column("text"))
            texts = piece.num_rows
            place = np.searchsorted(own.words, word)
            place[place == len(own.words)] = 0
            in_head = own.words[place] == word if len(own.words) else np.zeros(len(word), bool)
            place = np.where(in_head, place, len(own.words))
            symbol = np.where(in_head, np.append(own.symbols, 0)[place], 1 + OWN + cls)
            inside = symbol > OWN
            lengths = np.diff(first)
            all_ = np.zeros(len(word) + texts, np.uint16)  # the end is symbol 0
            all_[np.arange(len(word)) + _text.owners(first)] = symbol
            bounds = first + np.arange(texts + 1)
            out = np.flatnonzero(~in_head)
            tail_at = np.searchsorted(out, first)
            raw = all_.astype("<u2").tobytes()
            yield pa.record_batch({
                "row": pa.array(row + np.arange(texts)), "doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"), "n_tokens": pa.array(lengths + 1),
                "n_known": pa.array(_text.per_text(in_head, first) + (own.end > 0)), "head_log": pa.array(_text.per_text(logs[place], first) + np.log10(own.end + 1)),
                "class_log": pa.array(_text.per_text(np.where(inside, logs[place] - own.class_log[np.minimum(cls, CLASSES - 1)], 0.0), first)),
                "symbols": pa.array([raw[2 * a : 2 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary()), "tail": _text.lists(word[out].view(np.int64), tail_at),
            })
            row += texts

    text = docs.select("doc_id", _held(F.col("doc_id")).alias("held_out"), "text")
    return kept(text.mapInArrow(run, f"row long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, head_log double, class_log double, symbols binary, tail array<long>"), "encoded")


class _Packed:
    """Sequences side by side, longest first, so that one step serves all that still run."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray):
        lengths = np.diff(bounds)
        self.order = np.argsort(-lengths, kind="stable")
        self.begin, self.lengths, self.symbols = bounds[:-1][self.order], lengths[self.order], symbols
        self.steps = int(lengths.max(initial=0))
        # how many sequences are longer than t
        self.running = len(lengths) - np.searchsorted(self.lengths[::-1], np.arange(self.steps), side="right")

    def at(self, t: int) -> np.ndarray:
        return self.symbols[self.begin[: self.running[t]] + t]


def log_likelihood(symbols: np.ndarray, bounds: np.ndarray, model: Model) -> np.ndarray:
    """log10 P of each sequence of symbols, by the scaled forward recursion."""
    packed = _Packed(symbols, bounds)
    out = np.zeros(len(bounds) - 1)
    alpha = np.tile(model.start, (len(out), 1))
    for t in range(packed.steps):
        n = packed.running[t]
        alpha = (alpha[:n] @ model.move if t else alpha[:n]) * model.emit[packed.at(t)]
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        out[:n] += np.log10(scale)
    result = np.empty(len(out))
    result[packed.order] = out
    return result


class _Segments:
    """Sequences cut to ``SEGMENT`` tokens, with what the whole sequence says at each cut.

    ``enter`` is the forward distribution at the token before a segment and ``leave`` the backward
    one at its last token, both exact: the product of a segment's step matrices carries them over
    it, so that segments can be counted side by side and in blocks of bounded size.
    """

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray, model: Model):
        k, pieces = len(model.start), -(-np.diff(bounds) // SEGMENT)
        head = np.cumsum(pieces) - pieces
        index = np.arange(pieces.sum()) - np.repeat(head, pieces)
        self.begin = np.repeat(bounds[:-1], pieces) + SEGMENT * index
        self.end = np.minimum(self.begin + SEGMENT, np.repeat(bounds[1:], pieces))
        self.first = index == 0
        self.enter, self.leave = np.tile(model.start, (len(index), 1)), np.ones((len(index), k))
        long = np.flatnonzero(pieces > 1)
        if not len(long):
            return
        long = long[np.argsort(-pieces[long], kind="stable")]
        step = self._steps(symbols, np.flatnonzero(np.repeat(pieces, pieces) > 1), model)
        n, f = pieces[long], head[long]
        ahead = model.start * model.emit[symbols[self.begin[f]]]
        back = np.ones((len(long), k))
        for j in range(int(n[0])):
            live = int((n > j).sum())
            ahead, back, at, end = ahead[:live], back[:live], f[:live] + j, f[:live] + n[:live] - 1 - j
            if j:
                self.enter[at] = ahead
            self.leave[end] = back
            ahead, back = np.einsum("si,sij->sj", ahead, step[at]), np.einsum("sij,sj->si", step[end], back)
            ahead, back = ahead / ahead.sum(1)[:, None], back / back.sum(1)[:, None]

    def _steps(self, symbols: np.ndarray, which: np.ndarray, model: Model) -> np.ndarray:
        """The product of the step matrices of some segments, scaled; a sequence's first token has none."""
        k = len(model.start)
        out = np.zeros((len(self.begin), k, k))
        which = which[np.argsort(self.begin[which] - self.end[which], kind="stable")]
        lengths, product = (self.end - self.begin)[which], np.tile(np.eye(k), (len(which), 1, 1))
        for t in range(int(lengths[0])):
            n = int((lengths > t).sum())
            after = (product[:n].reshape(-1, k) @ model.move).reshape(n, k, k) * model.emit[symbols[self.begin[which[:n]] + t]][:, None, :]
            product[:n] = after if t else np.where(self.first[which[:n], None, None], product[:n], after)
            if t % 8 == 7:
                product[:n] /= product[:n].sum((1, 2))[:, None, None]
        out[which] = product / product.sum((1, 2))[:, None, None]
        return out


def expected_counts(symbols: np.ndarray, bounds: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts: starts (K), moves (K x K), emissions (SYMBOLS x K) of whole sequences."""
    k = len(model.start)
    total = [np.zeros(k), np.zeros((k, k)), np.zeros((len(model.emit), k))]
    cut = _Segments(symbols, bounds, model)
    for at in range(0, len(cut.begin), BLOCK):
        for mine, more in zip(total, _segment_counts(symbols, cut, np.arange(at, min(at + BLOCK, len(cut.begin))), model), strict=True):
            mine += more
    return total[0], total[1], total[2]


def _segment_counts(symbols: np.ndarray, cut: _Segments, which: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counts of some segments, the move into each included."""
    k, lengths = len(model.start), (cut.end - cut.begin)[which]
    which = which[np.argsort(-lengths, kind="stable")]  # longest first, so that one step serves all that still run
    begin, lengths = cut.begin[which], (cut.end - cut.begin)[which]
    first, enter, leave = cut.first[which], cut.enter[which], cut.leave[which]
    moves, emissions = np.zeros((k, k)), np.zeros((len(model.emit), k))
    running = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    at = lambda t: symbols[begin[: running[t]] + t]
    alphas, alpha = [], np.where(first[:, None], enter, enter @ model.move)
    for t in range(len(running)):
        alpha = (alpha[: running[t]] @ model.move if t else alpha) * model.emit[at(t)]
        alpha = alpha / alpha.sum(1)[:, None]
        alphas.append(alpha)
    gammas, beta = [None] * len(running), leave[: running[-1]]
    for t in range(len(running) - 1, -1, -1):
        beta = np.concatenate([beta, leave[len(beta) : running[t]]])
        gamma = alphas[t] * beta
        gammas[t] = gamma / gamma.sum(1)[:, None]
        # P(state i at t-1, j at t): alpha_i * move_ij * emit_j * beta_j, scaled to sum 1
        ahead = model.emit[at(t)] * beta
        back = ahead @ model.move.T
        before = alphas[t - 1][: running[t]] if t else enter
        share = 1 / (before * back).sum(1)
        if not t:
            share = np.where(first, 0, share)  # a sequence's first token has none before it
        moves += (before * share[:, None]).T @ ahead
        beta = back / back.sum(1)[:, None]
    seen, gamma = np.concatenate([at(t) for t in range(len(running))]), np.concatenate(gammas)
    for j in range(k):
        emissions[:, j] = np.bincount(seen, weights=gamma[:, j], minlength=len(emissions))
    return gammas[0][first].sum(0), moves * model.move, emissions


def _initial(vocab: Vocabulary, states: int, seed: int = 0) -> Model:
    rng = np.random.default_rng(seed)
    emit = vocab.unigram[:, None] * rng.uniform(0.5, 1.5, (SYMBOLS, states))
    return Model(np.full(states, 1 / states), np.full((states, states), 0.2 / states) + 0.8 * np.eye(states), emit / emit.sum(0))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = _text.encoded(batch.column("symbols"))
    return np.frombuffer(data.tobytes(), "<u2").astype(np.int64), offsets // 2


def train(encoded: DataFrame, vocab: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training texts; each round is one pass and a sum by cell."""
    spark, model = encoded.sparkSession, _initial(vocab, states)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            own = shared.value
            total = np.zeros(states + states * states + SYMBOLS * states)
            for piece in _text.slices(batches, "symbols", 1 << 20):
                symbols, bounds = _flat(piece)
                total += np.concatenate([x.ravel() for x in expected_counts(symbols, bounds, own)])
            some = np.flatnonzero(total)
            yield pa.record_batch({"cell": pa.array(some, pa.int32()), "value": pa.array(total[some])})

        counts = encoded.where("not held_out").select("symbols").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
        total = np.zeros(states + states * states + SYMBOLS * states)
        total[counts["cell"].to_numpy()] = counts["value"].to_numpy()
        start, move, emit = np.split(total, [states, states + states * states])
        start, move, emit = start + 1, move.reshape(states, states) + 1, emit.reshape(SYMBOLS, states) + 10 * vocab.unigram[:, None]
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    return model


def scored(encoded: DataFrame, words: DataFrame, vocab: Vocabulary, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    id_type = encoded.schema["doc_id"].dataType.simpleString()
    names = ("row", "doc_id", "held_out", "n_tokens", "n_known", "head_log", "class_log")

    def run(batches):
        for piece in _text.slices(batches, "symbols", 8 << 20):
            yield pa.record_batch({**{c: piece.column(c) for c in names}, "hmm": pa.array(log_likelihood(*_flat(piece), shared.value))})

    own = encoded.select(*names, "symbols").mapInArrow(run, f"row long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, head_log double, class_log double, hmm double")
    # words beyond the broadcast part meet their counts; unknown ones find none and add log10(1)
    tail = encoded.select("row", F.explode("tail").alias("word")).join(words.select("word", "c").where("class >= 0"), "word")
    tail = tail.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("tail_log"), F.count(F.lit(1)).alias("tail_known"))
    both = own.join(tail, "row", "left")
    log = F.coalesce("tail_log", F.lit(0.0))
    base = F.col("head_log") + log - F.col("n_tokens") * F.lit(float(np.log10(vocab.tokens + vocab.size + 1)))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("hmm") + F.col("class_log") + log).alias("score"))


def language_model(docs: DataFrame, head: int = HEAD, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Learn from the documents outside the held-out part, score all.

    A null text is empty: one token, the end. A null id is not held out. Repeated rows each count
    and each get a row. Without training texts every token is unknown and the model is uniform.
    """
    words = count_words(docs.where(~_held(F.col("doc_id"))))
    vocab = vocabulary(words, head)
    encoded = encode(docs, vocab)
    return scored(encoded, words, vocab, train(encoded, vocab, states, rounds))


def op6_language_model(spark, sf_dir: str) -> DataFrame:
    """Unigram and hidden Markov scores of every document."""
    return language_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))
