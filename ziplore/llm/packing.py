"""Best-fit packing of tokenised documents into sequences of bounded length.

Which documents share a sequence depends on their lengths only, so the problem
is solved on the histogram of lengths, which has at most ``capacity`` entries
however large the corpus. The configuration linear program over it (fewest
sequences such that the multiset patterns used cover every length) is solved by
multiplicative weights: lengths covered too little grow dearer, and the
patterns of greatest value under these prices are found by knapsack dynamic
programming. The fractional solution is rounded by using patterns, most used
first, as often as whole documents remain for them, and the rest is packed
best-fit by decreasing length. Prices scaled to be feasible in the dual give a
lower bound for the number of sequences.

Documents then find their place by their rank among those of equal length.
Ranks are counted in hash slices of bounded size, so a length that a third of
all documents share stays spread out.

Defined results: a null text counts as empty; a document is its ids and then id
0, so an empty one has length 1; longer ones than the capacity are cut into
full pieces with the shorter one first; repeated rows are packed each; an empty
table gives an empty result; other columns are not carried along.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ziplore.session import pin

CAPACITY = 2048
END = "<|endoftext|>"
VOCABULARY = "byte_bpe_50k.tiktoken"

#: Rounds of the multiplicative weights and the share of a length's documents
#: that one round covers at most.
ROUNDS = 100
STEP = 0.05
#: Share of each length's documents that rounded patterns may use; the others
#: leave best-fit the variety to fill sequences to the brim.
ROUNDED = 0.7
#: Rows of one length that are ranked together.
SLICE_ROWS = 4096

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_encoders: dict = {}


def encoder(path: str | None = None):
    """Byte-level BPE with the ids of ``byte_bpe_50k.json``, kept per Python worker.

    The same vocabulary as ranks: tests hold the ids against those that the
    other library gives, at a fraction of its time.
    """
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END: len(ranks)}
        )
    return _encoders[path]


#: Runs of white space from this length on are cut out before the pattern sees them.
LONG_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def ordinary(text: str, path: str | None = None) -> list[int]:
    """Ids of a text without special tokens.

    The pattern looks ahead after white space, which overflows the library's
    stack on runs of about a million. It takes such a run as one piece, but for
    the last character if text follows, so long runs are encoded as that piece.
    """
    known, ids, at = encoder(path), [], 0
    for run in LONG_BLANKS.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        ids += known.encode_ordinary(text[at : run.start()])
        ids += known._encode_single_piece(text[run.start() : stop])
        at = stop
    return ids + known.encode_ordinary(text[at:]) if at else known.encode_ordinary(text)


def encode(text: str | None, path: str | None = None) -> list[int]:
    """Ids of a text; its end-of-text string is the special token, as in the other library."""
    if not text:
        return []
    if END not in text:
        return ordinary(text, path)
    end = encoder(path).encode_single_token(END)
    ids = []
    for number, part in enumerate(text.split(END)):
        ids += [end] * bool(number) + ordinary(part, path)
    return ids


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document, with its ids if wanted."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Few texts at a time, so that the ids of long ones are not all held together.
        for batch in (b.iloc[i : i + 500] for b in batches for i in range(0, len(b), 500)):
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.array(encode(text, path) + [0], dtype="<u4")
                ends = range(len(ids) % capacity or min(capacity, len(ids)), len(ids) + 1, capacity)
                for number, end in enumerate(ends):
                    begin = max(0, end - capacity) if number else 0
                    own = ids[begin:end]
                    row = (doc_id, number, begin, end - begin, zlib.crc32(own.tobytes()))
                    out.append((*row, own.astype("int32")) if with_ids else row)
            columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
            yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    schema = PIECES + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInPandas(cut, schema)


# --- the program over the histogram ---------------------------------------


def _knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest value for every capacity and the last length taken (index, -1: one token unused)."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int32)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        n = fitting[room]
        if n:
            values = best[room - lengths[:n]] + prices[:n]
            i = int(values.argmax())
            if values[i] > best[room] + 1e-15:
                best[room], taken[room] = values[i], i
    return best, taken


def _pattern(first: int, taken: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, ...]:
    """The best pattern that holds length ``first``, as sorted indices."""
    found, room = [first], capacity - int(lengths[first])
    while room > 0:
        i = int(taken[room])
        if i < 0:
            room -= 1
        else:
            found.append(i)
            room -= int(lengths[i])
    return tuple(sorted(found))


def fractional_patterns(
    lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS
) -> tuple[dict[tuple[int, ...], float], float]:
    """Patterns with their fractional use, and a lower bound for the number of sequences.

    Every round prices all lengths, takes for each length the best pattern that
    holds it, and uses those within ``STEP`` of the overall best.
    """
    prices = lengths / capacity
    use: dict[tuple[int, ...], float] = {}
    covered = np.zeros(len(lengths))
    bound = 0.0
    for _ in range(rounds):
        best, taken = _knapsack(prices, lengths, capacity)
        values = prices + best[capacity - lengths]
        bound = max(bound, float(counts @ prices) / float(values.max()))
        chosen = {
            _pattern(int(i), taken, lengths, capacity)
            for i in np.flatnonzero(values >= (1 - STEP) * values.max())
            if covered[i] < 1
        }
        if not chosen:
            chosen = {_pattern(int(values.argmax()), taken, lengths, capacity)}
        gain = np.zeros(len(lengths))
        for p in chosen:
            np.add.at(gain, list(p), 1.0)
        size = STEP / float((gain / counts).max())
        for p in chosen:
            use[p] = use.get(p, 0.0) + size
        covered += size * gain / counts
        prices = prices * np.exp(-size * gain / counts)
        prices /= prices.max()
        if covered.min() >= 1:
            break
    return use, bound


def _best_fit(lengths: np.ndarray, rest: np.ndarray, capacity: int) -> dict[tuple[int, ...], int]:
    """Best-fit decreasing over counts: equal sequences are filled together."""
    rooms: dict[int, dict[tuple[int, ...], int]] = {}
    done: dict[tuple[int, ...], int] = {}

    def put(pattern: tuple[int, ...], room: int, n: int) -> None:
        if n:
            target = rooms.setdefault(room, {}) if room else done
            target[pattern] = target.get(pattern, 0) + n

    for i in range(len(lengths) - 1, -1, -1):
        size, left = int(lengths[i]), int(rest[i])
        while left:
            fit = min((r for r, held in rooms.items() if r >= size and held), default=None)
            if fit is None:
                each = capacity // size
                put((i,) * each, capacity - each * size, left // each)
                put((i,) * (left % each), capacity - (left % each) * size, 1 if left % each else 0)
                break
            pattern, n = next(iter(rooms[fit].items()))
            # As many of this length as the sequence holds, before the next one is opened.
            each = min(fit // size, left)
            n = min(n, left // each)
            rooms[fit][pattern] -= n
            if not rooms[fit][pattern]:
                del rooms[fit][pattern]
            put(pattern + (i,) * each, fit - each * size, n)
            left -= each * n
    for held in rooms.values():
        for pattern, n in held.items():
            done[pattern] = done.get(pattern, 0) + n
    return done


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], float]:
    """Patterns of lengths with how often each is used, and a lower bound for their sum."""
    full = histogram.get(capacity, 0)
    lengths = np.array(sorted(n for n, k in histogram.items() if n < capacity and k), dtype=np.int64)
    if not len(lengths):
        return ([((capacity,), full)] if full else []), float(full)
    counts = np.array([histogram[int(n)] for n in lengths], dtype=np.float64)
    use, bound = fractional_patterns(lengths, counts, capacity)
    rest = counts.astype(np.int64)
    open_ = np.floor(rest * ROUNDED).astype(np.int64)
    plan: dict[tuple[int, ...], int] = {}
    # Prices move in steps, so the uses sum to more than the bound.
    scale = bound / sum(use.values())
    for pattern, x in sorted(use.items(), key=lambda item: (-item[1], item[0])):
        kinds, each = np.unique(pattern, return_counts=True)
        if lengths[kinds] @ each < capacity:
            continue
        n = min(int(np.ceil(x * scale)), int((open_[kinds] // each).min()))
        if n:
            plan[pattern] = plan.get(pattern, 0) + n
            open_[kinds] -= n * each
            rest[kinds] -= n * each
    for pattern, n in _best_fit(lengths, rest, capacity).items():
        key = tuple(sorted(pattern))
        plan[key] = plan.get(key, 0) + n
    patterns = [(tuple(int(lengths[i]) for i in p), n) for p, n in plan.items()]
    if full:
        patterns.append(((capacity,), full))
    return patterns, max(bound, float(counts @ lengths) / capacity) + full


def _places(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, np.ndarray]:
    """Per length the rows (first rank, how many per sequence, first sequence, offset)."""
    ranks: dict[int, int] = {}
    places: dict[int, list] = {}
    first = 0
    for pattern, n in patterns:
        offset = 0
        for size, each in zip(*(a.tolist() for a in np.unique(pattern, return_counts=True))):
            places.setdefault(size, []).append((ranks.get(size, 0), each, first, offset))
            ranks[size] = ranks.get(size, 0) + n * each
            offset += size * each
        first += n
    return {size: np.array(rows, dtype=np.int64) for size, rows in places.items()}


# --- placing --------------------------------------------------------------


def _ranked(cut: DataFrame, n_rows: int) -> DataFrame:
    """Add ``rank``, from 0 among the pieces of equal length."""
    slices = max(1, n_rows // SLICE_ROWS)
    sliced = cut.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    earlier = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy("length", "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("length", "_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy("length", "_slice").orderBy("doc_id", "piece")
    return sliced.join(offsets, ["length", "_slice"]).select(
        *cut.columns, (F.col("_offset") + F.row_number().over(within) - 1).alias("rank")
    )


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece its ``sequence_id`` and ``offset``.

    ``cut`` is read twice and must not change in between: pass pinned rows. The
    driver sees the histogram only, ``capacity`` rows at most, and what goes
    to the tasks is bounded by the patterns over it.
    """
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns, _ = solve(histogram, capacity)
    plan = spark.sparkContext.broadcast(_places(patterns, capacity))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            sizes, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            for size in np.unique(sizes):
                rows = plan.value[int(size)]
                at = np.flatnonzero(sizes == size)
                hit = rows[np.searchsorted(rows[:, 0], ranks[at], side="right") - 1]
                past = ranks[at] - hit[:, 0]
                sequence[at] = hit[:, 2] + past // hit[:, 1]
                offset[at] = hit[:, 3] + past % hit[:, 1] * size
            yield batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    ranked = _ranked(cut, sum(histogram.values()))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields]
    return ranked.mapInPandas(place, ", ".join([*fields, "sequence_id bigint", "offset bigint"]))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Cut, count and place whole documents."""
    return pack(pin(pieces(docs, capacity, path, with_ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its ids and which documents they are from. Needs pieces with ids."""
    rows = packed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids"))).alias("p")
    )
    return rows.select(
        "sequence_id",
        F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"),
        F.transform("p", lambda x: F.struct(*[x[c].alias(c) for c in ("doc_id", "piece", "start", "offset", "length")])).alias("parts"),
    )
