"""Runs: all maximal stretches of words that repeat with a period.

A run of period ``q`` is a stretch in which words ``q`` apart are equal, at
least two periods and ``MIN_WORDS`` long, that no neighbouring word extends.

Every run of period ``p`` with two whole periods covers two neighbouring points
``i`` and ``i + p`` of the grid of multiples of ``p``. There are ``n / p`` points
for each period, ``n log n`` over all. At each point the run is as long as the
common extension of ``i`` and ``i + p`` to the right and to the left. A grid point
whose words differ is out at once, and a few more words settle nearly all
others. What is left asks a structure over a difference cover: of all suffixes
only those at positions whose remainder modulo ``V`` lies in ``COVER`` are sorted,
and any two positions reach sampled ones within fewer than ``V`` equal words.
From there the common extension is the minimum, by a sparse table, over the
common prefixes of neighbours in sorted order. For the way to the left the same
holds on the reversed words.

One document is one task's work, in numpy, with some 300 bytes a word for
documents that repeat themselves at length. No rows are shuffled.

Defined results: a null, empty or blank text has no words, no runs and an empty
collapsed text; repeated rows are judged each; an empty table gives an empty
result; columns that clash with those added are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every difference modulo V is one of two members of the cover.
V = 13
COVER = (0, 1, 3, 9)
#: Least words of a run.
MIN_WORDS = 12
#: Grid points that are looked at together.
GRID = 1 << 20
#: Texts that are answered together, and the bytes of text after which an answer is sent.
SLICE, SENT_BYTES = 500, 1 << 24

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _meeting() -> np.ndarray:
    """For the remainders of two positions, the least step after which both are sampled."""
    cover = set(COVER)
    return np.array(
        [[next(d for d in range(V) if (i + d) % V in cover and (j + d) % V in cover) for j in range(V)] for i in range(V)]
    )


MEETING = _meeting()


class SampledSuffixes:
    """Sorted suffixes at the positions of the cover, for common extensions of any two positions."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.padded = np.r_[words, np.full(V, -1)].astype(np.int32)
        at = np.flatnonzero(np.isin(np.arange(n) % V, COVER))
        m = len(at)
        number = np.full(n + 1, -1)
        number[at] = np.arange(m)
        # Ranks by the next V words, then by twice as many in each step: a step
        # by a multiple of V leads from a sampled position to a sampled one.
        blocks = np.lib.stride_tricks.sliding_window_view(self.padded, V)[at]
        blocks = np.ascontiguousarray(blocks).view(np.dtype((np.void, blocks.itemsize * V))).ravel()
        ranks = [np.unique(blocks, return_inverse=True)[1].ravel()]
        steps = []
        while ranks[-1].max(initial=0) < m - 1:
            step = V << len(steps)
            after = number[np.minimum(at + step, n)]
            # A suffix that has ended stands behind all others, as the padding does.
            key = ranks[-1].astype(np.int64) * (m + 1) + np.where(after < 0, m, ranks[-1][after])
            ranks.append(np.unique(key, return_inverse=True)[1].ravel())
            steps.append(step)
        order = np.argsort(ranks[-1])
        self.rank = np.full(n + 1, -1)
        self.rank[at] = ranks[-1]
        # Common prefix of neighbours: from the longest step downwards, then word by word.
        a, b = at[order[:-1]], at[order[1:]]
        common = np.zeros(max(m - 1, 0), np.int64)
        for level in range(len(steps) - 1, -1, -1):
            x, y = number[np.minimum(a + common, n)], number[np.minimum(b + common, n)]
            same = (x >= 0) & (y >= 0) & (ranks[level][x] == ranks[level][y])
            common += same * steps[level]
        for _ in range(V - 1):
            x, y = self.padded[np.minimum(a + common, n)], self.padded[np.minimum(b + common, n)]
            common += (x == y) & (x >= 0)
        self.least = [common.astype(np.int32)]
        while 2 << (len(self.least) - 1) <= len(common):
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words in common from ``i`` and from ``j`` on, of which the first ``V`` are known to be equal."""
        step = MEETING[i % V, j % V]
        x, y = self.rank[i + step], self.rank[j + step]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            here = level == k
            table = self.least[k]
            out[here] = np.minimum(table[low[here]], table[high[here] - (1 << int(k))])
        return out + step


class Extensions:
    """Common extensions in one direction; the structure is built when a pair needs it."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.padded = np.r_[words, np.full(V, -1)]
        self.words = words
        self.suffixes = None

    def common(self, i: np.ndarray, j: np.ndarray, enough: np.ndarray) -> np.ndarray:
        """Words in common from ``i`` and from ``j > i`` on.

        Where ``V`` words agree the rest is looked up; ``enough`` marks the
        pairs that are worth it.
        """
        out = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        for step in range(V):
            live = live[(j[live] + step < self.n) & (self.padded[i[live] + step] == self.padded[np.minimum(j[live] + step, self.n)])]
            out[live] += 1
        live = live[enough[live]]
        if len(live):
            if self.suffixes is None:
                self.suffixes = SampledSuffixes(self.words)
            out[live] = self.suffixes.common(i[live], j[live])
        return out


def _grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid points and their periods, some at a time: all ``i`` with ``p`` dividing ``i`` and ``i + p < n``."""
    periods = np.arange(1, n // 2 + 1)
    ends = np.cumsum((n - 1) // periods)
    first = 0
    while first < len(periods):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + GRID, "right")))
        counts = (n - 1) // periods[first:last]
        p = np.repeat(periods[first:last], counts)
        place = np.arange(len(p)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield place * p, p
        first = last


def find_runs(words: np.ndarray) -> np.ndarray:
    """Start, length and smallest period of every run, by start and period."""
    n = len(words)
    found = [np.zeros((0, 3), np.int64)]
    right, left = Extensions(words), Extensions(words[::-1])
    for i, p in _grid(n) if n >= MIN_WORDS else ():
        same = words[i] == words[i + p]
        i, p = i[same], p[same]
        if not len(i):
            continue
        # With V words or fewer on both sides the length is known without the structure.
        no = np.zeros(len(i), bool)
        after = right.common(i, i + p, no)
        before = left.common(n - i - p, n - i, no)
        need = np.maximum(MIN_WORDS - p, p)
        open_ = (after == V) | (before == V)
        kept = open_ | (after + before >= need)
        i, p, after, before, need = i[kept], p[kept], after[kept], before[kept], need[kept]
        long_after, long_before = after == V, before == V
        if long_after.any():
            after[long_after] = right.common(i[long_after], (i + p)[long_after], long_after[long_after])
        if long_before.any():
            before[long_before] = left.common((n - i - p)[long_before], (n - i)[long_before], long_before[long_before])
        kept = after + before >= need
        i, p, after, before = i[kept], p[kept], after[kept], before[kept]
        found.append(_smallest(np.c_[i - before, p + after + before, p]))
    return _smallest(np.concatenate(found))


def _smallest(runs: np.ndarray) -> np.ndarray:
    """One row per stretch, with its smallest period; a stretch is found at all its points and multiples of its period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Marks the words that lie in no run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


def _analysed(text: str | None) -> tuple[int, np.ndarray, bytes]:
    """Number of words, runs and collapsed text."""
    # bytes.split() parts at 0x20 and 0x09 to 0x0D and nothing else.
    words = (text or "").encode("utf-8", "surrogatepass").split()
    number: dict[bytes, int] = defaultdict(count().__next__)
    runs = find_runs(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
    if len(runs):
        words_kept = compress(words, kept_words(len(words), runs).tolist())
        return len(words), runs, b" ".join(words_kept)
    return len(words), runs, b" ".join(words)


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by ``n_words``, its ``runs`` and the ``collapsed`` text.

    ``collapsed`` holds the words that lie in no run after its first period,
    joined by one space.
    """
    added = ("n_words", "runs", "collapsed")
    kept = [f for f in docs.schema.fields if f.name not in (text, *added)]
    names = [f.name for f in kept]

    def answer(part: pa.RecordBatch, found: list) -> pa.RecordBatch:
        held = [part.column(part.schema.get_field_index(name)) for name in names]
        runs = np.concatenate([r for _, r, _ in found])
        offsets = pa.array(np.cumsum([0, *(len(r) for _, r, _ in found)]), pa.int32())
        fields = [pa.array(runs[:, k]) for k in range(3)]
        more = [
            pa.array([n for n, _, _ in found], pa.int64()),
            pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=list(_ARROW_RUNS.value_type))),
            pa.array([c for _, _, c in found], pa.binary()).cast(pa.string()),
        ]
        return pa.RecordBatch.from_arrays([*held, *more], names=[*names, *added])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            found, size, first = [], 0, 0
            for row in range(batch.num_rows):
                found.append(_analysed(texts[row].as_py()))
                size += len(found[-1][2])
                if len(found) == SLICE or size >= SENT_BYTES or row + 1 == batch.num_rows:
                    yield answer(batch.slice(first, len(found)), found)
                    found, size, first = [], 0, row + 1

    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"n_words bigint, runs {RUNS}, collapsed string"]
    return docs.select(*names, text).mapInArrow(find, ", ".join(fields))


def longest_run(runs: str = "runs") -> Column:
    """``less`` (the length, negated), ``start`` and ``period`` of the longest run; null without runs.

    Ties go to the smallest start, then period.
    """
    return F.array_min(
        F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    )


def with_planted_period(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Make the tail of one text in ten periodic, by the id's checksum, as a check on the search.

    With ``h`` the checksum of the decimal id and ``g`` its tenth: where ``h`` ends
    in 0, each word from ``a = g % n`` on becomes one of the ``1 + (n - a) / (3 + g % 8)``
    words from there on in turn. Other texts, and rows without an id, stay.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    g, n = F.col("_ziplore_g"), F.size("_ziplore_words").cast("long")
    first = (g % F.nullif(n, F.lit(0))).cast("int")
    rest = (n - first).cast("int")
    period = (F.floor(rest / (F.lit(3) + g % 8)) + 1).cast("int")
    cycle = F.slice("_ziplore_words", first + 1, period)
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil(rest / period).cast("int"))), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("_ziplore_words", F.lit(1), first), tail), " ")
    return (
        docs.withColumn("_ziplore_g", F.when(h % 10 == 0, F.floor(h / 10)))
        .withColumn("_ziplore_words", F.when(F.col("_ziplore_g").isNotNull(), words))
        .withColumn(text, F.when(n > 0, planted).otherwise(F.col(text)))
        .drop("_ziplore_g", "_ziplore_words")
    )
