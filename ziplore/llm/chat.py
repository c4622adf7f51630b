"""Chat formatting as a prefix tree: shared first turns are emitted once.

A node is a turn after a given history. Conversations are put in the order of
their paths (arrays of node keys); in that order a conversation adds exactly
the turns it does not share with the one before it, and going through them is a
depth-first walk. A node's place in its tree is therefore a running total over
a range-sorted table, which spreads a first turn that a third of all
conversations share over many tasks. Equal conversations are one path.

Each node carries its ids, the position id of its first token (the length of
its history), its place in the depth-first sequence of its tree, a loss mask
and the intervals of the tree it may attend to: its ancestors and itself.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside roles and
texts, ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``, and line breaks in roles
become ``\\n``, so that no control string can arise from data and reading back is exact. The loss covers the escaped
texts of assistant turns.

Defined results: a null text or role counts as empty; turns are ordered by
turn, then role and text, nulls first, and repeated rows are turns of their
own; rows without conversation id form a conversation of their own; an empty
table gives an empty tree. Other columns are not carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ziplore.llm.packing import encoder, ordinary
from ziplore.operators.joins import join_measured
from ziplore.session import pin

START, STOP = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"

def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str, breaks: bool = False) -> str:
    """The text as it was; with ``breaks``, ``\\n`` is a line break."""
    out, at = [], 0
    while (hit := text.find("\\", at)) >= 0:
        kept = text[hit + 1 : hit + 2]
        out += text[at:hit], "\n" if breaks and kept == "n" else kept
        at = hit + 2
    return "".join(out) + text[at:]


def escape_role(role: str) -> str:
    """A role ends at the first line break, so its own are written as ``\\n``."""
    return escape(role).replace("\n", "\\n")


# --- tree -----------------------------------------------------------------


def conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: its turns and the keys of the nodes on its path."""
    turns = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    whole = turns.groupBy("conv_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("turn", "role", "text"))),
            lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")),
        ).alias("turns")
    )
    # A node's key is a digest of its turn and of its parent's key.
    hashed = F.transform(
        "turns",
        lambda t: F.sha2(F.concat_ws(":", F.char_length(t["role"]).cast("string"), t["role"], t["text"]), 256),
    )
    chained = F.aggregate(
        hashed,
        F.array().cast("array<string>"),
        lambda acc, h: F.concat(
            acc,
            F.array(F.substring(F.sha2(F.concat(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")), h), 256), 1, 32)),
        ),
    )
    return whole.withColumn("path", chained)


def _paths(convs: DataFrame) -> DataFrame:
    """Distinct paths in order with ``first``, the first depth not shared with the path before."""
    shared = lambda a, b: F.aggregate(
        F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, same: F.struct(
            F.when(acc["on"] & same, acc["n"] + 1).otherwise(acc["n"]).alias("n"), (acc["on"] & same).alias("on")
        ),
        lambda acc: acc["n"],
    )
    leaf = convs.withColumn("leaf", F.element_at("path", -1))
    distinct = leaf.dropDuplicates(["leaf"])
    placed = pin(
        distinct.select("leaf", "turns", "path").orderBy("path").withColumn("_pos", F.monotonically_increasing_id())
    )
    slices = placed.withColumn("_slice", F.shiftrightunsigned("_pos", 33))
    inside = Window.partitionBy("_slice").orderBy("_pos")
    # The path before the first of a slice is the last of the nearest slice before it.
    edges = (
        slices.groupBy("_slice")
        .agg(F.max_by("path", "_pos").alias("_end"))
        .withColumn("_before", F.lag("_end").over(Window.orderBy("_slice")))
        .select("_slice", "_before")
    )
    return (
        slices.withColumn("_last", F.lag("path").over(inside))
        .join(edges, "_slice")
        .withColumn("_last", F.coalesce("_last", "_before"))
        .withColumn("first", F.when(F.col("_last").isNull(), F.lit(0)).otherwise(shared(F.col("path"), F.col("_last"))))
        .drop("_last", "_before")
    )


def _encoded(nodes: DataFrame, path: str | None) -> DataFrame:
    """Ids of header, escaped text and footer of each node's turn."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = encoder(path)
        for batch in batches:
            out = batch.drop(columns=["role", "text"])
            out["is_loss"] = batch["role"] == ASSISTANT
            out["head"] = [ordinary(f"{START}{escape_role(r)}\n", path) for r in batch["role"]]
            out["body"] = [ordinary(escape(t), path) for t in batch["text"]]
            out["tail"] = [known.encode_ordinary(f"{STOP}\n")] * len(batch)
            yield out

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields if f.name not in ("role", "text")]
    return nodes.mapInPandas(encode, ", ".join([*kept, "is_loss boolean", "head array<int>", "body array<int>", "tail array<int>"]))


def build_tree(convs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per node in depth-first order within its ``tree``.

    Columns: tree, node, parent, depth, ids, loss_start and loss_end (within
    the ids), position (id of the first token), flat_start and flat_end (place
    in the tree's sequence) and attends (intervals of that sequence).
    """
    own = F.filter(
        F.transform(
            F.arrays_zip("turns", "path"),
            lambda x, i: F.struct(
                x["path"].alias("node"),
                F.get("path", i - 1).alias("parent"),
                i.alias("depth"),
                x["turns"]["role"].alias("role"),
                x["turns"]["text"].alias("text"),
            ),
        ),
        lambda x: x["depth"] >= F.col("first"),
    )
    paths = pin(_paths(convs))
    added = paths.select(F.get("path", F.lit(0)).alias("tree"), "_slice", "_pos", F.explode(own).alias("n")).select(
        "tree", "_slice", "_pos", "n.*"
    )
    nodes = pin(
        _encoded(added, path).select(
            "tree", "_slice", "_pos", "node", "parent", "depth",
            F.concat("head", "body", "tail").alias("ids"),
            F.when(F.col("is_loss"), F.size("head")).alias("loss_start"),
            F.when(F.col("is_loss"), F.size("head") + F.size("body")).alias("loss_end"),
        ).withColumn("n_ids", F.size("ids").cast("long"))
    )
    # Running total of a tree: within each slice, plus what slices before hold of it.
    earlier = Window.partitionBy("tree").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        nodes.groupBy("tree", "_slice")
        .agg(F.sum("n_ids").alias("_n"))
        .select("tree", "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy("tree", "_slice").orderBy("_pos", "depth")
    flat = (
        nodes.select("tree", "_slice", "_pos", "node", "depth", "n_ids")
        .join(totals, ["tree", "_slice"])
        .withColumn("flat_end", F.col("_offset") + F.sum("n_ids").over(within))
        .select("node", "_pos", "depth", "n_ids", (F.col("flat_end") - F.col("n_ids")).alias("flat_start"), "flat_end")
    )
    flat = pin(flat)
    return _attending(nodes, paths, flat)


def _on_paths(paths: DataFrame, flat: DataFrame) -> DataFrame:
    """For every path its nodes' intervals in order of depth."""
    steps = paths.select("leaf", F.posexplode("path").alias("depth", "node"))
    spans = join_measured(steps, flat.select("node", "n_ids", "flat_start", "flat_end"), ["node"], "leaf")
    return spans.groupBy("leaf").agg(
        F.sort_array(F.collect_list(F.struct("depth", "node", "n_ids", "flat_start", "flat_end"))).alias("way")
    )


def _attending(nodes: DataFrame, paths: DataFrame, flat: DataFrame) -> DataFrame:
    """Add place, position and attention intervals, from the path that brought a node in."""
    ways = _on_paths(paths, flat).join(paths.select("leaf", "first"), "leaf")
    merged = lambda steps: F.aggregate(
        # Neighbouring intervals become one: a node right after its parent.
        steps,
        F.array().cast("array<struct<from:bigint,to:bigint>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["to"] == s["flat_start"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.get(acc, F.size(acc) - 1)["from"].alias("from"), s["flat_end"].alias("to"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["flat_start"].alias("from"), s["flat_end"].alias("to"))))),
    )
    # Intervals are merged before the rows of a path are multiplied by its nodes.
    own = F.transform(
        F.sequence(F.col("first") + 1, F.size("way")),
        lambda d: F.struct(
            F.element_at("way", d)["node"].alias("node"),
            F.element_at("way", d)["flat_start"].alias("flat_start"),
            F.element_at("way", d)["flat_end"].alias("flat_end"),
            F.aggregate(
                F.slice("way", 1, d - 1), F.lit(0).cast("long"), lambda acc, s: acc + s["n_ids"]
            ).alias("position"),
            merged(F.slice("way", 1, d)).alias("attends"),
        ),
    )
    placed = ways.select(F.explode(own).alias("p")).select("p.*")
    return nodes.join(placed, "node").select(
        "tree", "node", "parent", "depth", "ids", "loss_start", "loss_end", "position", "flat_start", "flat_end", "attends"
    )


def format_conversations(rows: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The tree, and which ``conv_id`` ends in which ``leaf`` node by which ``path``."""
    convs = pin(conversations(rows))
    tree = pin(build_tree(convs, path))
    return tree, convs.select("conv_id", "path", F.element_at("path", -1).alias("leaf"))


# --- reading back ---------------------------------------------------------


def read_back(tree: DataFrame, members: DataFrame, path: str | None = None) -> DataFrame:
    """Formatted text, turns and loss texts of every conversation, from the tree alone.

    Every distinct path is put together and decoded once; its conversations
    share the result.
    """
    ways = members.groupBy("leaf").agg(F.any_value("path").alias("path"))
    steps = ways.select("leaf", F.posexplode("path").alias("depth", "node"))
    parts = join_measured(steps, tree.select("node", "ids", "loss_start", "loss_end"), ["node"], "leaf")
    whole = parts.groupBy("leaf").agg(
        F.sort_array(F.collect_list(F.struct("depth", "ids", "loss_start", "loss_end"))).alias("way")
    )

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = encoder(path)
        for batch in batches:
            out = []
            for leaf, way in zip(batch["leaf"], batch["way"]):
                formatted = known.decode([i for s in way for i in s["ids"]])
                turns = []
                for part in formatted.split(START)[1:]:
                    role, _, text = part.removesuffix(STOP + "\n").partition("\n")
                    turns.append({"role": unescape(role, breaks=True), "text": unescape(text)})
                loss = [unescape(known.decode(s["ids"][int(s["loss_start"]) : int(s["loss_end"])])) for s in way if s["loss_start"] is not None and s["loss_start"] == s["loss_start"]]
                out.append((leaf, formatted, turns, loss))
            yield pd.DataFrame(out, columns=["leaf", "formatted", "turns", "losses"])

    schema = "leaf string, formatted string, turns array<struct<role:string,text:string>>, losses array<string>"
    return whole.mapInPandas(decode, schema)


def digests(read: DataFrame, members: DataFrame) -> DataFrame:
    """Lengths and hashes of what was read back, one row per conversation."""
    text: Column = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    loss = F.array_join("losses", "")
    known = read.select(
        "leaf",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    return join_measured(members.select("conv_id", "leaf"), known, ["leaf"], "conv_id").drop("leaf")
