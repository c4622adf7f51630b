"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Texts are bags of shingles of five words. A shingle's weight is its damped
term frequency times a damped inverse document frequency; document frequencies
are counted over all documents in a table of hashed counters. Consistent
weighted sampling draws ``BANDS * ROWS`` samples per text such that two texts
agree in one with the probability of their weighted Jaccard similarity; equal
bands of samples make candidates, and every link is confirmed on the exact
weights of both whole texts.

Groups may be huge, so no group's pairs are listed. Equal texts are one node.
Each band bucket compares its members with its most central one, the one with
the largest buckets over all bands. Buckets whose members then lie in
different components are looked at again: small ones in one task, comparing
samples and then shingles across components. In larger ones the members outside
the central one's component meet all members of that component block by block,
so a copy of a copy is found there; then they go on among themselves with the
next central member, ``ROUNDS`` times at most, and all that is left after these
meets block by block.

Defined results: a null text counts as empty; a text without words equals no
other; one with fewer than five words is a single shingle; a null id is kept
and in no class; rows that repeat an id share its class; an empty table gives
an empty result. Other columns are not carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ziplore.llm.components import components
from ziplore.llm.words import SMALL_CHUNK, bags, hashed_texts, mixed
from ziplore.operators.joins import count_keys, join_measured
from ziplore.session import pin

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 5
#: Document frequencies are counted in so many hashed counters; a share below
#: ``RARE`` of all documents counts as rare, and the most common shingle weighs
#: ``1 - DAMPING`` of a rare one. Stronger weights would pull apart the near
#: copies of a text that very many documents copy.
COUNTERS = 1 << 19
RARE = 1 / 200
DAMPING = 0.25
#: Least share of equal samples for which two texts are compared exactly: 2.5
#: standard deviations below the threshold.
LIKELY = 0.68
#: The same for a member and the centre of its bucket, before their texts move.
LIKELY_HUB = 0.64
#: Bucket rows compared within one task, and what short form may be off.
SMALL_BUCKET = 2000
UNSURE = 0.005
#: Times that large buckets go on by their most central member; what is left
#: then meets itself. A bucket of unlike texts loses one of them at a time.
ROUNDS = 3
#: Rows of small groups that a task compares, about.
TASK_ROWS = 1000
#: Ids of texts that are asked for are broadcast up to so many (some 32 MB), so
#: the other texts don't move; with more of them the texts are shuffled.
BROADCAST_IDS = 2_000_000
#: What separates words, as in :mod:`ziplore.llm.words`.
GAPS = "\t\n\x0b\x0c\r "

_U = np.uint64


def _tables(seed: int = 20240501) -> tuple[np.ndarray, ...]:
    """Variates of the sampler for 16 random bits each, and odd multipliers that give those bits."""
    rng = np.random.default_rng(seed)
    ranks = (np.arange(65536) + 0.5) / 65536
    # Gamma(2, 1) by inversion: the cumulative function is 1 - (1 + x) exp(-x).
    grid = np.linspace(0, 40, 400_001)
    gamma = np.interp(ranks, 1 - (1 + grid) * np.exp(-grid), grid)
    log_c = np.log(rng.permutation(gamma)).astype(np.float32)
    r = rng.permutation(gamma).astype(np.float32)
    beta = rng.permutation(ranks).astype(np.float32)
    odd = rng.integers(0, 1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64) * _U(2) + _U(1)
    return log_c, r, beta, odd


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (as 64-bit numbers) of one text's word hashes, and how often each occurs."""
    return np.unique(_shingled(words), return_counts=True)


def shingled_texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The shingles of each text, repeated ones too; none of a text without words."""
    for words, _, ends in hashed_texts(column, chunk=SMALL_CHUNK):
        # Shingles of all words in a row; those that begin in one text and end in the next are left out.
        every, begin = _shingled(words), 0
        for end in ends:
            yield every[begin : end - SHINGLE + 1] if end - begin >= SHINGLE else _shingled(words[begin:end])
            begin = end


def _shingled(words: np.ndarray) -> np.ndarray:
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    size = min(SHINGLE, n)
    total = np.full(n - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total = (total * _U(0x9E3779B97F4A7C15)) ^ words[i : n - size + 1 + i]
        total = (total << _U(23)) | (total >> _U(41))
    return mixed(total)


def weights(found: np.ndarray, often: np.ndarray, common: np.ndarray) -> np.ndarray:
    """TF-IDF weight of each shingle; ``common`` has the inverse frequency per counter."""
    tf = 1.0 + np.log(often)
    return (tf * common[(found % _U(COUNTERS)).astype(np.int64)]).astype(np.float32)


#: Shingles drawn from at a time: with all samples of them the buffers stay in a core's cache.
DRAWN = 256


class Sampler:
    """Consistent weighted samples of one bag after the other."""

    def __init__(self):
        self.log_c, self.r, self.beta, self.odd = _tables()
        self.unit = (self.r * (1 - self.beta)).astype(np.float32)
        size = self.odd.shape[1] * DRAWN
        self.places, self.values, self.units = np.empty(size, np.uint64), np.empty(size, np.float32), np.empty(size, np.float32)

    def _spots(self, h: np.ndarray, which: int) -> np.ndarray:
        """For each sample and shingle its place in the tables, in a buffer that the next call writes to."""
        odd = self.odd[which][:, None]
        out = self.places[: len(odd) * len(h)].reshape(len(odd), len(h))
        np.multiply(odd, h, out=out)
        # Indices below 65536, so signed and unsigned are the same bits.
        return np.right_shift(out, _U(48), out=out).view(np.int64)

    def draw(self, found: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each sample a number that stands for the shingle and level drawn."""
        k = self.odd.shape[1]
        best, drawn = np.full(k, np.inf, np.float32), np.zeros(k, np.uint64)
        every = np.arange(k)
        for at in range(0, len(found), DRAWN):
            h, w = found[at : at + DRAWN], weight[at : at + DRAWN]
            shape = k, len(h)
            value, unit = (b[: k * len(h)].reshape(shape) for b in (self.values, self.units))
            # All places are within the tables, so nothing wraps; a check for it would cost as much as the rest.
            np.take(self.log_c, self._spots(h, 0), out=value, mode="wrap")
            other = np.flatnonzero(w != 1)
            c = value[:, other]
            j = self._spots(h, 1)
            np.subtract(value, np.take(self.unit, j, out=unit, mode="wrap"), out=value)
            level = None
            if len(other):
                # Weight 1 is level 0. Others: t = floor(ln w / r + beta), ln a = ln c - r (t - beta + 1).
                r, beta = self.r[j[:, other]], self.beta[j[:, other]]
                t = np.floor(np.log(w[other]) / r + beta)
                value[:, other] = c - r * (t - beta + 1)
                level = np.zeros(shape, np.int32)
                level[:, other] = t
            least = value.argmin(axis=1)
            held = value[every, least]
            better = held < best
            best = np.where(better, held, best)
            name = h[least]
            if level is not None:
                name = name ^ mixed(level[every, least].astype(np.int64).astype(np.uint64))
            drawn = np.where(better, name, drawn)
        return drawn


# --- document frequencies -------------------------------------------------

BLOCK = 4096


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Weight per counter, from the number of documents that hold one of its shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(COUNTERS, np.int64), 0
        for batch in batches:
            for own in shingled_texts(batch.column(0)):
                if len(own):
                    rows += 1
                    # A counter that several shingles of a text name gets one.
                    held[(own % _U(COUNTERS)).view(np.int64)] += 1
        if rows:
            blocks = held.astype("<i8").reshape(-1, BLOCK)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([-1, *range(len(blocks))], pa.int32()),
                    "counts": pa.array([np.array([rows], "<i8").tobytes(), *(b.tobytes() for b in blocks)], pa.binary()),
                }
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.frombuffer(counts.as_buffer(), "<i8")
                sums[block] = sums[block] + got if block in sums else got.copy()
        if sums:
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array(list(sums), pa.int32()), "counts": pa.array([s.tobytes() for s in sums.values()], pa.binary())}
            )

    parts = docs.select("text").mapInArrow(count, "block int, counts binary")
    # COUNTERS numbers in all, however large the corpus.
    totals = parts.repartition(16, "block").mapInArrow(add, "block int, counts binary").collect()
    by = {r["block"]: np.frombuffer(r["counts"], "<i8") for r in totals}
    weight = np.ones(COUNTERS, np.float32)
    if by:
        share = np.concatenate([by[i] for i in range(COUNTERS // BLOCK)]) / by[-1][0]
        common = share > RARE
        weight[common] = 1 - DAMPING * np.log(share[common] / RARE) / np.log(1 / RARE)
    return weight


# --- samples and candidates -----------------------------------------------


def sketches(docs: DataFrame, common) -> DataFrame:
    """Per document the bucket of each band and a byte of each sample; none for a text without words."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            drawn, full = np.zeros((batch.num_rows, BANDS * ROWS), np.uint64), np.zeros(batch.num_rows, bool)
            for row, own in enumerate(shingled_texts(batch.column(batch.schema.get_field_index("text")))):
                if len(own):
                    found, often = np.unique(own, return_counts=True)
                    drawn[row], full[row] = sampler.draw(found, weights(found, often, common.value)), True
            drawn = mixed(drawn)
            band = np.arange(1, BANDS + 1, dtype=np.uint64)
            for i in range(ROWS):
                band = mixed(band * _U(31) ^ drawn[:, i::ROWS])
            ends = pa.array(np.r_[0, np.cumsum(full * BANDS)], pa.int32())
            keys = pa.ListArray.from_arrays(ends, pa.array(band[full].view(np.int64).ravel(), pa.int64()))
            codes = (drawn & _U(255)).astype(np.uint8)
            bytes_ = [c.tobytes() if f else b"" for c, f in zip(codes, full)]
            names = ["doc_id", "h1", "h2"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(n)) for n in names), keys, pa.array(bytes_, pa.binary())],
                names=[*names, "buckets", "sketch"],
            )

    return docs.select("doc_id", "h1", "h2", "text").mapInArrow(sketch, "doc_id bigint, h1 bigint, h2 bigint, buckets array<bigint>, sketch binary")


def verified(pairs: DataFrame, texts: DataFrame, common) -> DataFrame:
    """Pairs of ``a`` and ``b`` with their weighted Jaccard similarity on whole texts."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for left, right in zip(bags(batch.column(2)), bags(batch.column(3))):
                (f, n), (g, m) = shingles(left), shingles(right)
                u, v = weights(f, n, common.value).astype(np.float64), weights(g, m, common.value).astype(np.float64)
                _, i, j = np.intersect1d(f, g, assume_unique=True, return_indices=True)
                both = np.minimum(u[i], v[j]).sum()
                out.append(both / max(u.sum() + v.sum() - both, 1e-300))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("_ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("_tb"))
    # A text may have very many partners, on either side.
    first = join_measured(pairs, left, ["a"], "b", counts=count_keys(pairs, ["a"]))
    both = join_measured(first, right, ["b"], "a", counts=count_keys(pairs, ["b"])).select("a", "b", "_ta", "_tb")
    return both.mapInArrow(compare, "a bigint, b bigint, similarity double")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids and texts of the documents asked for by pinned distinct ids."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("doc_id", "text")


def _confirm(pairs: DataFrame, docs: DataFrame, common) -> DataFrame:
    """Links among candidate pairs."""
    pairs = pin(pairs.filter("a < b").distinct())
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    return pin(verified(pairs, _texts_of(docs, pin(ids)), common).filter(F.col("similarity") >= THRESHOLD).select("a", "b"))


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of ``doc_id`` and ``hub`` whose samples agree often enough to be worth moving their texts."""
    pairs = pin(pairs.filter("doc_id != hub").distinct())
    own = nodes.select("doc_id", "sketch")
    hubs = nodes.select(F.col("doc_id").alias("hub"), F.col("sketch").alias("_hub_sketch"))
    # A hub may have very many members.
    both = join_measured(pairs.join(own, "doc_id"), hubs, ["hub"], "doc_id", counts=count_keys(pairs, ["hub"]))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.array(batch.column(k).to_pylist(), f"S{BANDS * ROWS}").view(np.uint8).reshape(-1, BANDS * ROWS) for k in (2, 3))
            kept = (x == y).mean(axis=1) >= LIKELY_HUB if batch.num_rows else np.zeros(0, bool)
            yield batch.select(["doc_id", "hub"]).filter(pa.array(kept, pa.bool_()))

    tried = both.select("doc_id", "hub", "sketch", "_hub_sketch").mapInArrow(agree, "doc_id bigint, hub bigint")
    return tried.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b"))


def _bags_of(docs: DataFrame, common) -> DataFrame:
    """Shingles and weights of whole texts in short form: 32-bit numbers in order, half precision."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for words in bags(batch.column(1)):
                found, often = shingles(words)
                short, place = np.unique((found >> _U(32)).astype("<u4"), return_inverse=True)
                weight = np.bincount(place, weights(found, often, common.value), minlength=len(short))
                packed.append(short.tobytes() + weight.astype("<f2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "bag"])

    return docs.select("doc_id", "text").mapInArrow(pack, "doc_id bigint, bag binary")


def _pairs_in_bucket(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs across components that are links, or too near the threshold to tell in short form.

    Texts are compared by samples first, then on their shingles. What is surely
    a link joins its components at once, so a pair is given only if it may
    still join two. With a column ``left`` that is not null, rows that stay in a
    bucket meet those that leave it; pairs of one side are not looked at.
    """
    if "left" in group and group["left"].notna().all():
        group = group.sort_values("left", ascending=False)
        side = group["left"].to_numpy()
    else:
        side = None
    ids = group["doc_id"].to_numpy()
    _, root = np.unique(group["component"].to_numpy(), return_inverse=True)
    codes = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(ids), -1)
    own = [(np.frombuffer(b, "<u4", len(b) // 6), np.frombuffer(b, "<f2", len(b) // 6, len(b) // 6 * 4).astype(np.float32)) for b in group["bag"]]
    totals = np.array([w.sum() for _, w in own])
    out = []
    for i in range(len(ids) - 1 if side is None else int(side.sum())):
        later = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        if side is not None:
            later = later[~side[later]]
        hit = later[(codes[later] == codes[i]).mean(axis=1) >= LIKELY]
        if not len(hit):
            continue
        h, w = own[i]
        every, weight = np.concatenate([own[j][0] for j in hit]), np.concatenate([own[j][1] for j in hit])
        at = np.minimum(np.searchsorted(h, every), len(h) - 1)
        shared = np.where(h[at] == every, np.minimum(w[at], weight), 0)
        both = np.add.reduceat(shared, np.r_[0, np.cumsum([len(own[j][0]) for j in hit])[:-1]])
        alike = both / (totals[i] + totals[hit] - both)
        for k in np.argsort(-alike, kind="stable"):
            j = hit[k]
            if alike[k] < THRESHOLD - UNSURE:
                break
            if root[i] != root[j]:
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                if alike[k] >= THRESHOLD + UNSURE:
                    root[root == root[j]] = root[i]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links; what is known enters as one edge per node."""
    edges = links.select("a", "b")
    if labels is not None:
        edges = edges.unionByName(labels.select(F.col("id").alias("a"), F.col("component").alias("b")))
    return components(edges)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add the component that the links found so far give."""
    rows = rows.drop("component")
    return rows.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id")
    )


def _tasks(rows: int) -> int:
    """Into how many tasks to deal small groups with so many rows together."""
    return max(12, -(-rows // TASK_ROWS))


def _mixed(rows: DataFrame) -> DataFrame:
    """Buckets with members in different components."""
    ends = rows.groupBy("bucket").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
    return ends.filter("_low != _high").select("bucket")


def _across(large: DataFrame, nodes: DataFrame, docs: DataFrame, common) -> DataFrame:
    """Candidate pairs of the rows left in large buckets and the members of their hub's component.

    Both sides of a bucket are cut into blocks, so that every left row meets
    every member in some group of at most ``SMALL_BUCKET`` rows.
    """
    size = max(1, SMALL_BUCKET // 2)
    sides = large.groupBy("bucket").agg(F.count_if("left").alias("_l"), F.count_if(~F.col("left")).alias("_m"))
    blocks = sides.filter("_l > 0 AND _m > 0").select("bucket", *[F.ceil(F.col(c) / size).cast("int").alias(c) for c in ("_l", "_m")])
    cut = join_measured(large, blocks, ["bucket"], "doc_id")
    count = F.when(F.col("left"), F.col("_l")).otherwise(F.col("_m"))
    other = F.when(F.col("left"), F.col("_m")).otherwise(F.col("_l"))
    own = F.pmod(F.xxhash64("doc_id", "bucket"), count).cast("int")
    met = cut.select("bucket", "doc_id", "component", "left", own.alias("_own"), F.explode(F.sequence(F.lit(0), other - 1)).alias("_other"))
    met = met.select(
        "bucket", "doc_id", "component", "left",
        F.when(F.col("left"), F.col("_own")).otherwise(F.col("_other")).alias("_stays"),
        F.when(F.col("left"), F.col("_other")).otherwise(F.col("_own")).alias("_leaves"),
    )
    return _met(met, pin(cut.select("doc_id").distinct()), nodes, docs, common)


def _among(rows: DataFrame, nodes: DataFrame, docs: DataFrame, common) -> DataFrame:
    """Candidate pairs of all rows of a bucket and component, each block of them with itself and with every other."""
    size = max(1, SMALL_BUCKET // 2)
    blocks = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("bucket", F.ceil(F.col("_n") / size).cast("int").alias("_blocks"))
    cut = join_measured(rows, blocks, ["bucket"], "doc_id")
    own = F.pmod(F.xxhash64("doc_id", "bucket"), F.col("_blocks")).cast("int")
    met = cut.select("bucket", "doc_id", "component", own.alias("_own"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    met = met.select(
        "bucket", "doc_id", "component",
        F.when(F.col("_own") != F.col("_other"), F.col("_own") < F.col("_other")).alias("left"),
        F.least("_own", "_other").alias("_stays"), F.greatest("_own", "_other").alias("_leaves"),
    )
    return _met(met, pin(cut.select("doc_id").distinct()), nodes, docs, common)


def _met(met: DataFrame, ids: DataFrame, nodes: DataFrame, docs: DataFrame, common) -> DataFrame:
    """Candidate pairs of rows that are dealt to groups of ``bucket``, ``_stays`` and ``_leaves``."""
    packed = _bags_of(_texts_of(docs, ids), common).filter("length(bag) > 0").dropDuplicates(["doc_id"])
    compared = pin(nodes.join(ids, "doc_id", "left_semi").select("doc_id", "sketch").join(packed, "doc_id"))
    keys = ["bucket", "_stays", "_leaves"]
    dealt = met.join(compared, "doc_id").repartition(_tasks(met.count()), *keys)
    return dealt.groupBy(*keys).applyInPandas(_pairs_in_bucket, "a bigint, b bigint")


def _components(nodes: DataFrame, docs: DataFrame, common) -> DataFrame | None:
    """``id`` and ``component`` of all nodes that have links to other texts."""
    exploded = nodes.select("doc_id", F.explode("buckets").alias("bucket"))
    shared = pin(exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    # Buckets of one member meet nothing, so rows are counted among the others.
    rows = pin(join_measured(exploded, shared, ["bucket"], "doc_id", counts=shared.withColumnRenamed("n", "_n")))
    if rows.isEmpty():
        return None
    # Only texts that share a bucket are asked for from here on.
    docs = pin(_texts_of(docs, pin(rows.select("doc_id").distinct())))
    central = rows.groupBy("doc_id").agg(F.sum("n").alias("central"))
    rows = pin(rows.join(central, "doc_id"))
    labels = None
    for last in [*[False] * (ROUNDS - 1), True]:
        # The most central member of each bucket; of equals the smallest id.
        hubs = pin(
            rows.groupBy("bucket")
            .agg(F.max(F.struct("central", (-F.col("doc_id")).alias("id"))).alias("m"), F.count(F.lit(1)).alias("held"))
            .select("bucket", (-F.col("m.id")).alias("hub"), "held")
        )
        met = join_measured(rows.select("bucket", "doc_id"), hubs, ["bucket"], "doc_id")
        labels = _joined(labels, _confirm(_likely(met.select("doc_id", "hub"), nodes), docs, common))
        rows = pin(_labelled(rows, labels))
        open_ = pin(join_measured(rows, _mixed(rows).join(hubs, "bucket"), ["bucket"], "doc_id"))
        few = open_.filter(F.col("held") <= SMALL_BUCKET).select("bucket", "doc_id")
        # Buckets of different bands with the same members are looked at once.
        members = few.groupBy("bucket").agg(
            F.bit_xor(F.xxhash64("doc_id")).alias("_x"), F.sum("doc_id").alias("_s"), F.count(F.lit(1)).alias("_n")
        )
        once = members.groupBy("_x", "_s", "_n").agg(F.min("bucket").alias("bucket")).select("bucket")
        small = pin(_labelled(few.join(once, "bucket").join(nodes.select("doc_id", "sketch"), "doc_id"), labels))
        if not small.isEmpty():
            texts = _texts_of(docs, pin(small.select("doc_id").distinct()))
            packed = _bags_of(texts, common).filter("length(bag) > 0").dropDuplicates(["doc_id"])
            # Bounded groups: at most SMALL_BUCKET rows.
            dealt = small.join(packed, "doc_id").repartition(_tasks(small.count()), "bucket")
            found = dealt.groupBy("bucket").applyInPandas(_pairs_in_bucket, "a bigint, b bigint")
            labels = _joined(labels, _confirm(found, docs, common))
        large = open_.filter(F.col("held") > SMALL_BUCKET)
        if large.isEmpty():
            return labels
        # Larger buckets go on without the hub's component, once the others have met all its members.
        hub_side = labels.select(F.col("id").alias("hub"), F.col("component").alias("_hub_component"))
        aside = (F.col("doc_id") != F.col("hub")) & (F.col("component") != F.coalesce("_hub_component", "hub"))
        large = pin(
            _labelled(large, labels).join(hub_side, "hub", "left").withColumn("left", aside)
            .select("bucket", "doc_id", "n", "central", "component", "left")
        )
        rows = pin(large.filter("left").select("bucket", "doc_id", "n", "central"))
        if rows.isEmpty():
            return labels
        labels = _joined(labels, _confirm(_across(large, nodes, docs, common), docs, common))
        if last:
            return _joined(labels, _confirm(_among(_labelled(rows, labels), nodes, docs, common), docs, common))


def _nodes(docs: DataFrame, owned: DataFrame, common) -> DataFrame:
    """Sketches of the texts that stand for themselves, one of each text.

    Ids of these or of the others are sent to the texts, whichever are fewer; if
    both are too many for that, all texts are sketched and the sketches are joined.
    """
    firsts = pin(owned.filter("doc_id = node").select("doc_id").distinct())
    others = pin(owned.join(firsts, "doc_id", "left_anti").select("doc_id").distinct())
    docs = docs.filter("doc_id IS NOT NULL")
    n, m = firsts.count(), others.count()
    if min(n, m) > BROADCAST_IDS:
        drawn = pin(sketches(docs, common)).join(firsts, "doc_id", "left_semi")
    elif n < m:
        drawn = sketches(docs.join(F.broadcast(firsts), "doc_id", "left_semi"), common)
    else:
        drawn = sketches(docs.join(F.broadcast(others), "doc_id", "left_anti"), common)
    return pin(drawn.filter(F.size("buckets") > 0).dropDuplicates(["doc_id"]))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``cluster_id`` (smallest id of its class) and ``kept``."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2")
    )
    known = pin(docs.select("doc_id", "h1", "h2", (F.ltrim("text", F.lit(GAPS)) != "").alias("words")))
    with_words = known.filter("doc_id IS NOT NULL AND words")
    copies = pin(with_words.groupBy("h1", "h2").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    joined = join_measured(with_words.select("doc_id", "h1", "h2"), copies.drop("_n"), ["h1", "h2"], "doc_id", "left", counts=copies)
    owned = pin(joined.select("doc_id", F.coalesce("_first", "doc_id").alias("node")))
    common = spark.sparkContext.broadcast(inverse_frequencies(docs))
    nodes = _nodes(docs, owned, common)
    labels = _components(nodes, docs, common)
    if labels is None:
        classes = owned.select("doc_id", F.col("node").alias("cluster_id"))
    else:
        found = labels.withColumnRenamed("id", "node")
        classes = join_measured(owned, found, ["node"], "doc_id", "left").select(
            "doc_id", F.coalesce("component", "node").alias("cluster_id")
        )
    # Rows that repeat an id share the class of the smallest.
    least = classes.groupBy("doc_id").agg(F.min("cluster_id").alias("cluster_id"))
    return (
        known.select("doc_id")
        .join(least, "doc_id", "left")
        .select("doc_id", F.coalesce("cluster_id", "doc_id").alias("cluster_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("cluster_id"), F.lit(True)))
    )
