"""Scoring texts with a hashed maximum-entropy language model.

A token's probability is that of its class in its context times that of the
token within its class. Classes are the most frequent tokens, each on its own,
and word endings. The class is a softmax over hashed features: the last word,
the word before (a skip), both together, and their endings. Within a word ending
a second softmax, over the ending and the ending with the last word, chooses one
of ``GROUPS`` groups, and tokens of a group have their smoothed share of its counts.

Counts come from all training texts by one grouping. The softmaxes are trained by
distributed gradient updates: every task takes minibatch steps over its texts
from the common weights, and a row's updates are averaged by the number of tokens
that met it, so a word that few tasks know keeps what these learned. The rows
that words and pairs are hashed to follow the counted tokens (``Space``) up to
``MOST_ROWS`` of a kind, 61 MB in all, as each task holds the weights; from there on
words share rows.

Scores need every token's count. Frequent tokens are looked up in a table of at
most ``HEAD`` entries; all others go, as hashes, through an equi-join with the
counts, where by construction none is frequent enough to be hot.

Tokens are known by 64 bits, of which five are the class of the ending and the
rest a hash of the word.

Defined results: a null text counts as empty and is one end token; a null id is
in training; repeated rows count and are scored each; without training text all
counts are zero and classes uniform; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ziplore.llm.words import hashed_texts, mixed
from ziplore.session import pin

_U = np.uint64

#: Classes of word endings (a power of two, the low bits of a token), and the
#: most frequent tokens that are classes of their own, the end token among them.
ENDINGS = 32
SINGLES = 16
CLASSES = ENDINGS + SINGLES
#: The end token and the one before a text, which no word has.
END, BEFORE = 1 << 62, 0

#: Groups within an ending (a power of two, the bits of a token above the ending's).
GROUPS = 16
#: Least and most rows of weights for the last word, the word before it, both
#: together, and the last word within an ending.
LEAST_ROWS = {"last": 4096, "skip": 1024, "pair": 2048, "inner": 4096}
MOST_ROWS = {"last": 1 << 17, "skip": 1 << 15, "pair": 1 << 17, "inner": 1 << 16}


@dataclass(frozen=True)
class Space:
    """Rows of weights by kind; with the endings and the bias they make the tables."""

    last: int = LEAST_ROWS["last"]
    skip: int = LEAST_ROWS["skip"]
    pair: int = LEAST_ROWS["pair"]
    inner: int = LEAST_ROWS["inner"]

    @classmethod
    def of(cls, total: int, distinct: int) -> Space:
        """A row for each distinct word; pairs, which are not counted, for every second token."""
        asked = {"last": distinct, "skip": distinct, "pair": total // 2, "inner": distinct}
        return cls(**{k: min(max(1 << max(n - 1, 0).bit_length(), LEAST_ROWS[k]), MOST_ROWS[k]) for k, n in asked.items()})

    @property
    def rows(self) -> int:
        return 1 + self.last + self.skip + self.pair + 2 * ENDINGS

    @property
    def inner_rows(self) -> int:
        return ENDINGS + self.inner


WEIGHT_ROWS = Space().rows

#: Tokens per gradient step, its length, and passes over the training texts.
BATCH = 4096
RATE = 0.15
ROUNDS = 1
#: Frequent tokens whose counts are sent to every task (6 MB).
HEAD = 500_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def token_streams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens of some texts at a time, an end token after each text, and where each text ends."""
    for words, tails, sizes in hashed_texts(column, lower=True):
        tokens = (words & _U(~(ENDINGS - 1) & (2**64 - 1))) | (mixed(tails) & _U(ENDINGS - 1))
        ends = sizes + np.arange(1, len(sizes) + 1)
        out = np.full(len(tokens) + len(sizes), END, dtype=np.int64)
        place = np.ones(len(out), bool)
        place[ends - 1] = False
        out[place] = tokens.view(np.int64)
        yield out, ends


@dataclass
class Vocabulary:
    """What scoring needs to know about counts, of bounded size."""

    total: int
    distinct: int
    head: np.ndarray  # frequent tokens in order
    head_counts: np.ndarray
    singles: np.ndarray  # tokens that are classes of their own, in order
    single_class: np.ndarray
    mass: np.ndarray  # smoothed count per class
    groups: np.ndarray  # the same per ending and group
    space: Space


#: Tokens a task gathers before it counts them.
COUNTED = 2_000_000


def count_tokens(docs: DataFrame) -> DataFrame:
    """``token`` and ``count`` over the training texts, end tokens included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(streams: list[np.ndarray]) -> pa.RecordBatch:
            found, often = np.unique(np.concatenate(streams), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(often)], names=["token", "n"])

        held, size = [], 0
        for batch in batches:
            for stream, _ in token_streams(batch.column(0)):
                held.append(stream)
                size += len(stream)
                if size >= COUNTED:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    training = docs.filter(~held_out(F.col("doc_id"))).select("text")
    parts = training.mapInArrow(count, "token bigint, n bigint")
    return parts.groupBy("token").agg(F.sum("n").alias("count"))


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """Totals, the frequent tokens and the mass of each class."""
    total, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    # Tokens per size of count, in steps of two per cent; the table takes the largest sizes that fit.
    size = F.floor(F.log2(F.col("count")) * 32)
    sizes = sorted(counts.groupBy(size.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["s"])
    cutoff, held = 1 << 20, 0
    for row in sizes:
        if held + row["n"] > head:
            break
        cutoff, held = row["s"], held + row["n"]
    frequent = counts.filter(size >= cutoff).toPandas()
    top = counts.orderBy(F.desc("count"), "token").limit(SINGLES - 1).toPandas()["token"].to_numpy(np.int64)
    singles = np.unique(np.r_[top[top != END], END])[:SINGLES]
    single_class = ENDINGS + np.arange(len(singles))
    mass = np.full(CLASSES, 0.5)
    groups = np.full(ENDINGS * GROUPS, 0.5)
    by_group = (
        counts.filter(~F.col("token").isin([int(t) for t in singles]))
        .groupBy(F.col("token").bitwiseAND(F.lit(ENDINGS * GROUPS - 1)).alias("g"))
        .agg(F.sum("count").alias("c"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    for row in by_group:
        groups[row["g"]] += row["c"] + 0.5 * row["n"]
    groups = groups.reshape(GROUPS, ENDINGS).T
    mass[:ENDINGS] = groups.sum(axis=1)
    order = np.argsort(frequent["token"].to_numpy(np.int64), kind="stable")
    known, known_counts = frequent["token"].to_numpy(np.int64)[order], frequent["count"].to_numpy(np.int64)[order]
    for token, k in zip(singles, single_class):
        at = np.searchsorted(known, token)
        mass[k] = 0.5 + (known_counts[at] if at < len(known) and known[at] == token else 0)
    space = Space.of(int(total), int(distinct))
    return Vocabulary(int(total), int(distinct), known, known_counts, singles, single_class, mass, groups, space)


# --- features and steps ---------------------------------------------------


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x.view(np.uint64) ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _lookup(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, missing) -> np.ndarray:
    if not len(keys):
        return np.full(len(asked), missing)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], missing)


def context(stream: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before every position and the one before that."""
    starts = np.r_[0, ends[:-1]]
    last = np.r_[np.int64(BEFORE), stream[:-1]]
    last[starts] = BEFORE
    skip = np.r_[np.int64(BEFORE), last[:-1]]
    skip[starts] = BEFORE
    return last, skip


def features(stream: np.ndarray, ends: np.ndarray, space: Space = Space()) -> np.ndarray:
    """Weight rows of every position: bias, last word, word before it, both, and their endings."""
    last, skip = context(stream, ends)
    rows = np.zeros((6, len(stream)), np.int32).T
    at = 1
    rows[:, 1] = at + _mixed(last, 1) % np.uint64(space.last)
    at += space.last
    rows[:, 2] = at + _mixed(skip, 2) % np.uint64(space.skip)
    at += space.skip
    rows[:, 3] = at + (_mixed(last, 3) ^ (_mixed(skip, 4) >> np.uint64(3))) % np.uint64(space.pair)
    at += space.pair
    rows[:, 4] = at + (last & (ENDINGS - 1))
    rows[:, 5] = at + ENDINGS + (skip & (ENDINGS - 1))
    return rows


def inner_features(stream: np.ndarray, ends: np.ndarray, space: Space = Space()) -> np.ndarray:
    """Weight rows that choose a group within a position's ending: the ending, and the ending with the last word."""
    ending = stream & (ENDINGS - 1)
    rows = np.empty((2, len(stream)), np.int32).T
    rows[:, 0] = ending
    rows[:, 1] = ENDINGS + _mixed(context(stream, ends)[0] + ending, 5) % np.uint64(space.inner)
    return rows


def groups_of(stream: np.ndarray) -> np.ndarray:
    return (stream // ENDINGS) & (GROUPS - 1)


def classes_of(stream: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    return _lookup(vocab.singles, vocab.single_class, stream, -1).astype(np.int64, copy=False).clip(-1) + np.where(
        np.isin(stream, vocab.singles), 0, (stream & (ENDINGS - 1)) + 1
    )


def _logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of weight rows, shifted so that the greatest of a position is 0."""
    logits = weights.take(rows[:, 0], axis=0)
    for f in range(1, rows.shape[1]):
        logits += weights.take(rows[:, f], axis=0)
    greatest = logits
    while greatest.shape[1] % 2 == 0:  # by halves, as numpy is slow along short rows
        half = greatest.shape[1] // 2
        greatest = np.maximum(greatest[:, :half], greatest[:, half:])
    logits -= greatest.max(axis=1, keepdims=True)
    return logits


def _row_sums(numbers: np.ndarray) -> np.ndarray:
    return (numbers @ np.ones(numbers.shape[1], numbers.dtype))[:, None]


def log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    logits = _logits(weights, rows)
    logits -= np.log(_row_sums(np.exp(logits)))
    return logits


def _summed(column: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows named in a column, how often, and the sums of their errors."""
    low, high = column.min(), column.max()
    if low == high:
        return column[:1], np.array([len(column)]), error.sum(axis=0, keepdims=True)
    # Numbers of 16 bits are sorted by radix.
    order = np.argsort((column - low).astype(np.uint16), kind="stable") if high - low < 1 << 16 else np.argsort(column)
    column = column[order]
    starts = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
    return column[starts], np.diff(np.r_[starts, len(column)]), np.add.reduceat(error.take(order, axis=0), starts, axis=0)


def step(weights: np.ndarray, seen: np.ndarray, met: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> None:
    """One gradient step over a batch, each row at its own rate (by its past gradients); ``met`` counts a row's tokens."""
    error = _logits(weights, rows)
    np.exp(error, out=error)
    error /= _row_sums(error)
    error[np.arange(len(classes)), classes] -= 1
    for f in range(rows.shape[1]):
        touched, sizes, gradient = _summed(rows[:, f], error)
        met[touched] += sizes
        seen[touched] += np.einsum("ij,ij->i", gradient, gradient) / gradient.shape[1]
        gradient *= (RATE / np.sqrt(seen[touched]))[:, None]
        weights[touched] -= gradient


def _start(vocab: Vocabulary) -> list[np.ndarray]:
    """Weights of the classes and of the groups before any step."""
    outer = np.zeros((vocab.space.rows, CLASSES), np.float32)
    outer[0] = np.log(vocab.mass / vocab.mass.sum())
    inner = np.zeros((vocab.space.inner_rows, GROUPS), np.float32)
    inner[:ENDINGS] = np.log(vocab.groups / vocab.groups.sum(axis=1, keepdims=True))
    return [outer, inner]


#: Rows of weights that are averaged as one (their places are bytes), and blocks a task sends at a time.
BLOCK = 256
SENT_BLOCKS = 256

_CHANGES = {"level": pa.int32(), "block": pa.int32(), "places": pa.binary(), "tokens": pa.binary(), "scales": pa.binary(), "change": pa.binary()}
_CHANGES_SCHEMA = "level int, block int, places binary, tokens binary, scales binary, change binary"


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, t), v in zip(_CHANGES.items(), zip(*rows))})


def changes(level: int, own: np.ndarray, common: np.ndarray, met: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows that a task met and what it changed there, a byte a number by the greatest of the row."""
    for begin in range(0, len(met), BLOCK * SENT_BLOCKS):
        rows = begin + np.flatnonzero(met[begin : begin + BLOCK * SENT_BLOCKS])
        change = own[rows] - common[rows]
        scales = np.maximum(np.abs(change).max(axis=1, initial=0) / 127, np.float32(1e-30))
        change = np.rint(change / scales[:, None]).astype(np.int8)
        out = []
        for block in np.unique(rows // BLOCK):
            a, z = np.searchsorted(rows, (block * BLOCK, (block + 1) * BLOCK))
            places = (rows[a:z] % BLOCK).astype(np.uint8)
            out.append((level, int(block), *(x.tobytes() for x in (places, met[rows[a:z]], scales[a:z], change[a:z]))))
        if out:
            yield _table(out)


def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes of whole blocks, each row's averaged by the tokens that met it."""
    sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for row in zip(*batch.columns):
            kinds = (np.uint8, np.float32, np.float32, np.int8)
            places, n, scales, change = (np.frombuffer(x.as_buffer(), k) for x, k in zip(row[2:], kinds))
            change = change.reshape(len(n), -1)
            key = row[0].as_py(), row[1].as_py()
            if key not in sums:
                sums[key] = np.zeros(BLOCK), np.zeros((BLOCK, change.shape[1]))
            sums[key][0][places] += n
            sums[key][1][places] += change * (scales.astype(np.float64) * n)[:, None]
    if sums:
        yield _table([(*k, b"", b"", b"", (part / np.maximum(n, 1)[:, None]).astype(np.float32).tobytes()) for k, (n, part) in sums.items()])


def train(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Weights of both softmaxes from gradient steps in all tasks, each row averaged by the tokens that met it."""
    spark = docs.sparkSession
    weights = _start(vocab)
    training = docs.filter(~held_out(F.col("doc_id"))).select("text")
    for done in range(rounds):
        # The first weights follow from the vocabulary, so they need not be sent.
        shared = spark.sparkContext.broadcast((weights if done else None, vocab))

        def steps(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sent, known = shared.value
            common = sent or _start(known)
            own = [w.copy() for w in common]
            seen = [np.ones(len(w), np.float32) for w in common]
            met = [np.zeros(len(w), np.float32) for w in common]
            for stream, ends in (s for batch in batches for s in token_streams(batch.column(0))):
                classes = classes_of(stream, known)
                grouped = classes < ENDINGS
                parts = (
                    (features(stream, ends, known.space), classes),
                    (inner_features(stream, ends, known.space)[grouped], groups_of(stream[grouped])),
                )
                for level, (rows, right) in enumerate(parts):
                    for at in range(0, len(rows), BATCH):
                        step(own[level], seen[level], met[level], rows[at : at + BATCH], right[at : at + BATCH])
            for level in range(len(own)):
                yield from changes(level, own[level], common[level], met[level])

        sent = training.mapInArrow(steps, _CHANGES_SCHEMA).repartition("level", "block")
        # As many numbers as the tables have, which ``MOST_ROWS`` bounds however large the corpus.
        for row in sent.mapInArrow(averaged, _CHANGES_SCHEMA).collect():
            old = weights[row["level"]][row["block"] * BLOCK :][:BLOCK]
            old += np.frombuffer(row["change"], np.float32).reshape(BLOCK, -1)[: len(old)]
        shared.destroy()
    return weights


# --- scoring --------------------------------------------------------------


def _softmax_of(weights: np.ndarray, rows: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Log10 probability of what stands at each position."""
    out = np.empty(len(rows))
    for at in range(0, len(rows), BATCH):
        logs = log_softmax(weights, rows[at : at + BATCH])
        out[at : at + BATCH] = logs[np.arange(len(logs)), right[at : at + BATCH]]
    return out / np.log(10)


def _local_scores(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """What a text's own task can tell from ``shared`` weights and vocabulary, and the tokens whose counts must be looked up."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (outer, inner), known = shared.value
        log_mass, log_groups = np.log10(known.mass), np.log10(known.groups)
        for batch in batches:
            begin = 0
            for stream, ends in token_streams(batch.column(2)):
                part = batch.slice(begin, len(ends))
                begin += len(ends)
                classes = classes_of(stream, known)
                model = _softmax_of(outer, features(stream, ends, known.space), classes)
                grouped = classes < ENDINGS
                groups = groups_of(stream[grouped])
                within = _softmax_of(inner, inner_features(stream, ends, known.space)[grouped], groups)
                model[~grouped] -= log_mass[classes[~grouped]]
                model[grouped] += within - log_groups[classes[grouped], groups]
                counts = _lookup(known.head, known.head_counts, stream, 0)
                found = counts > 0
                logs = np.where(found, np.log10(counts + 0.5), 0.0)
                begins = np.r_[0, ends[:-1]]
                rare_ends = np.cumsum(np.add.reduceat(~found, begins, dtype=np.int64)).astype(np.int32)
                rare = pa.ListArray.from_arrays(np.r_[np.int32(0), rare_ends], pa.array(stream[~found]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(ends - begins),
                        pa.array(np.add.reduceat(found, begins, dtype=np.int64)),
                        pa.array(np.add.reduceat(logs, begins)),
                        pa.array(np.add.reduceat(model, begins)),
                        rare,
                    ],
                    names=["doc_id", "held_out", "n_tokens", "head_known", "head_logs", "model", "rare"],
                )

    schema = (
        "doc_id bigint, held_out boolean, n_tokens bigint, head_known bigint, head_logs double, model double, rare array<bigint>"
    )
    asked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return asked.mapInArrow(score, schema).withColumn("_row", F.monotonically_increasing_id())


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Counts, unigram score and model score (log10) of every text; other columns are not carried along."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = pin(count_tokens(docs))
    vocab = vocabulary(counts)
    shared = docs.sparkSession.sparkContext.broadcast((train(docs, vocab, rounds), vocab))
    scored = pin(_local_scores(docs, shared))
    shared.destroy()
    rare = scored.select("_row", F.explode("rare").alias("token"))
    looked = (
        rare.join(counts, "token", "left")
        .groupBy("_row")
        .agg(
            F.count("count").alias("rare_known"),
            F.sum(F.log10(F.coalesce("count", F.lit(0)) + 0.5)).alias("rare_logs"),
        )
    )
    logs = F.col("head_logs") + F.coalesce("rare_logs", F.lit(0.0))
    share = F.log10(F.lit(vocab.total + 0.5 * (vocab.distinct + 1)))
    return scored.drop("rare").join(looked, "_row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * share).alias("base_score"),
        (logs + F.col("model")).alias("score"),
    )
