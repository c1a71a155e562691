"""The prefix trie of conversations, rolled up by centroid decomposition (operator 11).

A node is a distinct sequence of first turns (role and text); its members are the
conversations that begin so, its children the sequences of one turn more.  Nodes are
known by a digest that is chained along the conversation, so texts never leave the task
that reads them.

Method: the number of turns that the members of a node have from that node on is known
from the plain grouping that makes the nodes; it weighs the subtree.  Each round takes the
components of the parent-edge forest that are over ``LOCAL`` in weight.  Their nodes of over half the
weight are a path from the top down, whose end is the centroid: no part that its
removal leaves is over half.  The total of the centroid's own branch is aggregated and added to
every node on the path, whose weights lose that of the branch; then the branch is cut
off, and its children become tops of components of their own.  A node's total is complete when it
is a centroid itself.  Weights halve, so there are as many rounds as the logarithm of the
largest tree over ``LOCAL``, however long its chains; smaller components are decomposed in the
same way within a task, which holds at most ``LOCAL`` nodes at a time.

Conversations are read as sorted streams: a task holds one turn, however long the
conversation, and the ids that end in a node are hashed as a stream of blocks.

Defined results: null roles and texts count as empty; turns that tie are ordered by
role and by the digest of the text, a null turn comes first; repeated rows are
turns each; rows without a conversation id belong to no conversation and are left
out; an empty table has no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

LOCAL = 10_000
GROUP, SHARED = 100, 6  # ids whose conversations share a beginning; its turns are crc32(id) % SHARED
_BLOCK = 12  # bits of ids in one block of ends


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), turns (of the conversation), digest and chars of each turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"),
        F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"), F.char_length(text).cast("bigint").alias("chars"))
    own = Window.partitionBy("conv_id")
    place = F.row_number().over(own.orderBy(F.asc_nulls_first("turn"), "role", "digest")) - 1
    return rows.select("conv_id", place.alias("place"), F.count(F.lit(1)).over(own).alias("turns"), "digest", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """With shared beginnings: first h turns of conversation c - c % GROUP, then c's own after its first h.  conv_id, part, place, total, digest, chars.

    Part 0 is the textless beginning, which every conversation has and which knows the total of the turns.
    """
    heads = turns.where(F.col("place") == 0).select(
        "conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).alias("h"))
    bases = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("place") < SHARED - 1)).withColumnsRenamed({"conv_id": "base", "turns": "base_turns"})
    sizes = bases.where(F.col("place") == 0).select("base", "base_turns")
    shared = F.least("h", F.coalesce("base_turns", F.lit(0)))
    none = F.lit(None).cast("binary")
    start = heads.join(sizes, "base", "left").select(
        "conv_id", F.lit(0).alias("part"), F.lit(0).alias("place"), (shared + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("total"), none.alias("digest"), F.lit(0).cast("bigint").alias("chars"))
    first = heads.join(bases, "base").where(F.col("place") < F.col("h")).select("conv_id", F.lit(1).alias("part"), "place", F.lit(0).cast("bigint").alias("total"), "digest", "chars")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    rest = turns.where(F.col("place") >= h).select("conv_id", F.lit(2).alias("part"), "place", F.lit(0).cast("bigint").alias("total"), "digest", "chars")
    return start.unionByName(first).unionByName(rest)


_STEPS = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("next", pa.binary()), ("rest", pa.int64()), ("chars", pa.int64())])


def steps_of(rows: DataFrame) -> DataFrame:
    """The way of each conversation down the trie: conv_id, depth, node, its parent and the next node on the way, rest (turns from here on, this one included) and chars."""
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").select("conv_id", "part", "total", "digest", "chars")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, total, out = None, 0, []  # a row waits until the node after it is known
        for batch in batches:
            for conv_id, part, all_turns, digest, chars in zip(*(c.to_pylist() for c in batch.columns)):
                if part == 0:
                    if waiting:
                        out.append((*waiting[:4], None, *waiting[4:]))
                    total, node, parent, depth = all_turns, hashlib.blake2b(digest_size=16).digest(), None, 0
                else:
                    _, depth, parent, *_ = waiting
                    depth, node = depth + 1, hashlib.blake2b(parent + digest, digest_size=16).digest()
                    out.append((*waiting[:4], node, *waiting[4:]))
                waiting = conv_id, depth, node, parent, total - depth + 1, chars
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _STEPS)], schema=_STEPS)
                out = []
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*waiting[:4], None, *waiting[4:]), _STEPS)], schema=_STEPS)

    return ordered.mapInArrow(chain, "conv_id bigint, depth bigint, node binary, parent binary, next binary, rest bigint, chars bigint")


def nodes_of(steps: DataFrame) -> DataFrame:
    """node, parent, conv_id, parent_conv_id, depth, n_convs, n_children, weight of the subtree, and the node's own leaves and saved."""
    nodes = steps.groupBy("node").agg(F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
                                      F.count(F.lit(1)).alias("n_convs"), F.sum("rest").alias("weight"), F.first("chars").alias("chars"))
    nodes = keep(nodes)
    above = (nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")))
    nodes = nodes.join(above, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    # Below the root, the parent's smallest member is that of all: one number.
    least = nodes.where(F.col("depth") == 0).select(F.lit(1).cast("bigint").alias("depth"), F.col("conv_id").alias("root_conv_id"))
    tops = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("parent_depth")).where(F.col("parent_depth") > 0).drop("parent_depth")
    deep = nodes.where(F.col("depth") > 1).join(tops, "parent")
    high = nodes.where(F.col("depth") <= 1).join(F.broadcast(least), "depth", "left").withColumnRenamed("root_conv_id", "parent_conv_id")
    return deep.unionByName(high).select("node", "parent", "conv_id", "parent_conv_id", "depth", "n_convs", "n_children", "weight",
                                         (F.col("n_children") == 0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))


# --- totals of subtrees ------------------------------------------------------------------


def decomposed(nodes: list[tuple[bytes, bytes | None, int, int, int, int, int]]) -> Iterator[tuple[bytes, int, int]]:
    """Totals of the nodes of one component by centroid decomposition, parents before children: node, parent, weight, leaves, saved, and what was added before."""
    at = {x[0]: k for k, x in enumerate(nodes)}
    weight, leaves, saved, plus_leaves, plus_saved = ([x[c] for x in nodes] for c in range(2, 7))
    children: list[list[int]] = [[] for _ in nodes]
    above = [at.get(x[1], -1) for x in nodes]
    for k, p in enumerate(above):
        if p >= 0:
            children[p].append(k)
    gone = [False] * len(nodes)  # cut off: a centroid, by which its branch is out of reach
    todo = [k for k, p in enumerate(above) if p < 0]
    while todo:
        top = todo.pop()
        path, c = [], top
        while c is not None:
            path.append(c)
            c = next((y for y in children[c] if not gone[y] and 2 * weight[y] > weight[top]), None)
        c = path.pop()
        all_leaves = all_saved = 0
        branch = [c]
        while branch:
            x = branch.pop()
            all_leaves += leaves[x]
            all_saved += saved[x]
            branch += [y for y in children[x] if not gone[y]]
        for x in path:
            weight[x] -= weight[c]
            plus_leaves[x] += all_leaves
            plus_saved[x] += all_saved
        gone[c] = True
        todo += [y for y in children[c] if not gone[y]] + ([top] if path else [])
        yield nodes[c][0], plus_leaves[c] + all_leaves, plus_saved[c] + all_saved


def _local_totals(small: DataFrame) -> DataFrame:
    """Totals of the components of at most ``LOCAL`` in weight, each within a task."""
    rows = small.repartition("top").sortWithinPartitions("top", "depth").select("top", "node", "parent", "weight", "leaves", "saved", "plus_leaves", "plus_saved")
    schema = pa.schema([("node", pa.binary()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, int, int]] = []
        stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for _, own in itertools.groupby(stream, key=lambda row: row[0]):
            out += decomposed([row[1:] for row in own])
            if len(out) >= LOCAL:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(add, "node binary, n_leaves bigint, saved_tokens bigint")


def subtree_totals(nodes: DataFrame, steps: DataFrame, *, local: int = LOCAL) -> DataFrame:
    """node, n_leaves and saved_tokens of the subtree of each node.

    ``all`` of a component is its weight, that of its top.  A round joins by component, and by the
    conversation that stands for a node with the members of its centroid: a node is below the centroid
    if its conversation is such a member and it is as deep.
    """
    state = nodes.select("node", "parent", "conv_id", "depth", "weight", "leaves", "saved", F.lit(0).cast("bigint").alias("plus_leaves"), F.lit(0).cast("bigint").alias("plus_saved"))
    # At first there is one component, whose top is the root; an empty table has none.
    root = nodes.where(F.col("depth") == 0).select(F.col("node").alias("top"), F.col("weight").alias("all"))
    state = state.crossJoin(F.broadcast(root))  # one row at most
    done: list[DataFrame] = []
    small: list[DataFrame] = []
    large = keep(state)
    while True:
        small.append(large.where(F.col("all") <= local).drop("all"))
        large = large.where(F.col("all") > local)
        if large.isEmpty():
            break
        path = 2 * F.col("weight") > F.col("all")
        centroids = keep(large.where(path).groupBy("top").agg(F.max_by(F.struct("node", "depth", "weight"), "depth").alias("c")).select(
            "top", F.col("c.node").alias("c"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight")))
        members = steps.join(centroids.select(F.col("c").alias("node"), "top"), "node").select("conv_id", "top", F.col("next").alias("branch"))
        met = large.join(centroids, "top").join(members.withColumn("member", F.lit(True)), ["conv_id", "top"], "left")
        below = F.coalesce("member", F.lit(False)) & (F.col("depth") >= F.col("c_depth"))
        met = keep(met.select("*", below.alias("below")))
        totals = met.where("below").groupBy("top").agg(F.sum("leaves").alias("t_leaves"), F.sum("saved").alias("t_saved"))
        met = met.join(totals, "top")
        is_c = F.col("node") == F.col("c")
        done.append(met.where(is_c).select("node", (F.col("plus_leaves") + F.col("t_leaves")).alias("n_leaves"), (F.col("plus_saved") + F.col("t_saved")).alias("saved_tokens")))
        on = path & ~F.col("below")

        def less(name: str, change: Column) -> Column:
            return (F.col(name) + F.when(on, change).otherwise(F.lit(0))).alias(name)

        cut = met.where(~is_c).select("node", "parent", "conv_id", "depth", less("weight", -F.col("c_weight")), "leaves", "saved",
                                      less("plus_leaves", F.col("t_leaves")), less("plus_saved", F.col("t_saved")),
                                      F.when(F.col("below"), F.col("branch")).otherwise(F.col("top")).alias("top"))
        # The weight of a component is that of its top, which is the heaviest of its nodes.
        cut = keep(cut)
        large = keep(cut.join(cut.groupBy("top").agg(F.max("weight").alias("all")), "top").select(*state.columns))
    together = small[0]
    for more in small[1:]:
        together = together.unionByName(more)
    out = _local_totals(together)
    for more in done:
        out = out.unionByName(more)
    return out


def ends_of(steps: DataFrame) -> DataFrame:
    """node and ends_sha256, the digest of the ids of the conversations that end there, ascending, joined by commas."""
    block = F.shiftright("conv_id", _BLOCK)
    blocks = (steps.where(F.col("next").isNull()).groupBy("node", block.alias("block")).agg(F.collect_list("conv_id").alias("ids"))
              .select("node", "block", F.array_join(F.transform(F.array_sort("ids"), lambda x: x.cast("string")), ",").alias("ids"))
              .repartition("node").sortWithinPartitions("node", "block").select("node", "ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        out = []
        for node, own in itertools.groupby(stream, key=lambda row: row[0]):
            running, mark = hashlib.sha256(), b""
            for _, ids in own:
                running.update(mark + ids.encode())
                mark = b","
            out.append({"node": node, "ends_sha256": running.hexdigest()})
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    return blocks.mapInArrow(digest, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, *, local: int = LOCAL) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, from rows of conv_id, turn, role and text."""
    steps = keep(steps_of(rebuilt(keep(turns_of(conversations)))))
    nodes = keep(nodes_of(steps))
    none = hashlib.sha256().hexdigest()
    return (nodes.join(subtree_totals(nodes, steps, local=local), "node").join(ends_of(steps), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))
