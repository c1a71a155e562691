"""Near-duplicate documents by DartMinHash signatures (operator 5).

Method: a text is the multiset of its shingles of ``WIDTH`` words (of all its words, if
it has fewer), a shingle weighing as often as it occurs.  Every shingle is a
region as wide as its weight; hashed darts fall on it at the times of a Poisson
process, each at some width and for one of ``COORDINATES`` coordinates.  A coordinate's
value is the earliest dart that falls inside the text's regions, so two texts
agree in it with the probability of their weighted Jaccard similarity.  Only the
darts up to a time at which every coordinate is expected to be hit are thrown,
about k ln k + 2k for k coordinates, however long the text; if one is still open,
the time is doubled.

Signatures are cut into bands of ``ROWS`` values; texts that share a band are
candidates.  A pair at the least similarity is missed by all 30 bands with
probability (1 - 0.8^5)^30, under 1 in 100,000.  Candidates are compared exactly,
on whole shingle multisets.

Equal texts are one node from the start (a 64-bit hash), so thousands of copies
cost one comparison.  The pairs within a band are never all emitted.  The centre
of a band is the node that meets most others in all its bands, as the original of
many edited copies does.  Each node is first compared with the best centre that it
meets, then with the centres of its other bands, where they are not yet in one
class.  Last, where a band still holds several classes, the nodes outside its
largest class are held against all of its nodes, in cells of bounded size; of
these comparisons only links that join classes leave the cell.  No link between
different classes is left untested, and links within a class change nothing.
Classes are found by passing on the smallest label, with jumps over labels.
Tables that later steps read are checkpointed in the shared folder.

Defined results: texts without words (null, empty) are each a class of their
own; equal rows are in one class; a class is named by its smallest id; null ids
are members like others, and a class of only such has a null name; an empty table
gives no rows; other columns are ignored (``distinct_documents``: carried along).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

WIDTH, SIMILARITY = 5, 0.8
COORDINATES, ROWS = 150, 5
#: Pairs whose signatures agree in less than this share are not compared: six standard deviations under the least similarity.
CLEARLY_LESS = 0.6
#: Rows of a cell from outside a band's largest class, and from all of the band.
CELL_ROWS, CELL_OTHERS = 512, 1024
_U = np.uint64
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype="uint64")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of a text, ascending, and how often each occurs."""
    words = (text or "").lower().encode().split()
    if not words:
        return np.empty(0, "uint64"), np.empty(0, "int64")
    h = np.fromiter(map(crc32, words), dtype="uint64", count=len(words)) + _U(1)
    n = max(1, len(h) - width + 1)
    total = np.zeros(n, dtype="uint64")
    for k in range(min(width, len(h))):
        total += mixed(h[k:k + n] * _STEPS[k % len(_STEPS)] + _U(k))
    return np.unique(mixed(total), return_counts=True)


def dart_minhash(elements: np.ndarray, weights: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """The signature of a weighted set: for each coordinate the hash of the earliest dart inside its regions."""
    cells = np.ceil(weights).astype("int64")
    which = np.repeat(np.arange(len(elements)), cells)
    cell = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
    room = weights[which] - cell
    seeds = mixed(elements[which] + cell.astype("uint64") * _STEPS[0])
    until = (k * math.log(k) + 2 * k) / max(float(weights.sum()), 1e-300)
    while True:
        live, time, throw = np.arange(len(seeds)), np.zeros(len(seeds)), 0
        darts, times = [], []
        while len(live):
            dart = mixed(seeds[live] + _STEPS[1:2] * _U(2 * throw + 1))
            time = time - np.log1p(-((dart >> _U(11)) * 2.0**-53))
            early = time <= until
            live, time, dart = live[early], time[early], dart[early]
            inside = room[live] >= 1
            if not inside.all():
                inside |= (mixed(dart ^ _STEPS[2]) >> _U(11)) * 2.0**-53 < room[live]
            darts.append(dart[inside])
            times.append(time[inside])
            throw += 1
        dart = np.concatenate(darts) if darts else np.empty(0, "uint64")
        order = np.argsort(np.concatenate(times), kind="stable") if darts else np.empty(0, "int64")
        dart = dart[order]
        hit, first = np.unique(mixed(dart ^ _STEPS[3]) % _U(k), return_index=True)
        if len(hit) == k:
            return dart[first]
        until *= 2


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A number for each band of the signature."""
    parts = signature.reshape(-1, rows)
    total = np.arange(len(parts), dtype="uint64") * _STEPS[4]
    for k in range(rows):
        total = mixed(total + parts[:, k])
    return total.view("int64")


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed multisets."""
    (x, m), (y, n) = map(_unpacked, (a, b))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(m[i], n[j]).sum())
    return both / (int(m.sum()) + int(n.sum()) - both)


def _packed(elements: np.ndarray, counts: np.ndarray) -> bytes:
    """A multiset by 32 bits of its hashes; counts only where one is above 1."""
    short = (elements >> _U(32)).astype("<u4")
    new = np.append(True, short[1:] != short[:-1])
    if not new.all():
        short, counts = short[new], np.add.reduceat(counts, np.flatnonzero(new))
    if (counts == 1).all():
        return b"\0" + short.tobytes()
    return b"\1" + short.tobytes() + counts.astype("<u4").tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = (len(data) - 1) // (8 if data[0] else 4)
    short = np.frombuffer(data, "<u4", n, 1)
    return short, np.frombuffer(data, "<u4", n, 1 + 4 * n).astype("int64") if data[0] else np.ones(n, "int64")


def node_of(text: Column) -> Column:
    """A text's node: equal for equal texts; null for texts without words."""
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text))


def joining_links(band: int, own: list[tuple], others: list[tuple], least: float) -> list[tuple[int, int]]:
    """Links from nodes to other nodes of a band that join different classes.

    Rows are node, label, bands and multiset.  A pair is tested in the first band that it shares only.
    """
    sets = [_unpacked(o[3]) for o in others]
    elements = np.concatenate([x for x, _ in sets])
    counts = np.concatenate([m for _, m in sets])
    owner = np.repeat(np.arange(len(others)), [len(x) for x, _ in sets])
    order = np.argsort(elements, kind="stable")
    elements, counts, owner = elements[order], counts[order], owner[order]
    totals = np.array([m.sum() for _, m in sets])
    theirs = np.frombuffer(b"".join(o[2] for o in others), "int64").reshape(len(others), -1)
    labels = np.array([o[1] for o in others])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while x in root:
            x = root[x]
        return x

    links = []
    for node, label, bands_, packed in own:
        mine = np.frombuffer(bands_, "int64")
        same = theirs == mine
        first = mine[same.argmax(axis=1)] == band
        now = find(label)
        current = np.array([find(x) for x in labels.tolist()]) if root else labels
        open_ = first & same.any(axis=1) & (current != now)
        if not open_.any():
            continue
        x, m = _unpacked(packed)
        total = m.sum()
        open_ &= (np.minimum(totals, total) >= least * np.maximum(totals, total))
        if not open_.any():
            continue
        low, high = np.searchsorted(elements, x, "left"), np.searchsorted(elements, x, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], weights=np.minimum(counts[at], np.repeat(m, n)), minlength=len(others))
        for k in np.flatnonzero(open_ & (both >= least * (totals + total - both))):
            a, b = find(label), find(int(labels[k]))
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((node, others[k][0]))
    return links


def _signed(rows: DataFrame, width: int) -> DataFrame:
    """From node, doc_id and text: node, doc_id, bands and a byte of each value of the signature (both null where node is)."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, short = [], []
            for node, text in zip(batch.column(0), batch.column(2)):
                signature = dart_minhash(*shingles(text.as_py(), width)) if node.is_valid else None
                found.append(None if signature is None else bands(signature))
                short.append(None if signature is None else signature.astype("uint8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64())), pa.array(short, pa.binary())], names=["node", "doc_id", "bands", "short"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("node", "doc_id", "text").mapInArrow(sign, f"node bigint, doc_id {kind}, bands array<bigint>, short binary")


def _multisets(rows: DataFrame, width: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_packed(*shingles(t.as_py(), width)) for t in batch.column(1)], pa.binary())], names=["node", "multiset"])

    return rows.select("node", "text").mapInArrow(pack, "node bigint, multiset binary")


def _both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Pairs with a column of either node: x of a, y of b."""
    return (pairs.join(table.select(F.col("node").alias("a"), F.col(column).alias("x")), "a")
            .join(table.select(F.col("node").alias("b"), F.col(column).alias("y")), "b"))


def _linked(pairs: DataFrame, nodes: DataFrame, multisets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that are similar, decided exactly."""
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).to_pylist() for k in (2, 3))
            yield batch.filter(pa.array([float((np.frombuffer(p, "u1") == np.frombuffer(q, "u1")).mean()) >= CLEARLY_LESS for p, q in zip(x, y)], pa.bool_())).select([0, 1])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k) for k in (2, 3))
            yield batch.filter(pa.array([similarity(p.as_py(), q.as_py()) >= least for p, q in zip(x, y)], pa.bool_())).select([0, 1])

    likely = _both(pairs, nodes, "short").select("a", "b", "x", "y").mapInArrow(alike, "a bigint, b bigint")
    return _both(likely, multisets, "multiset").select("a", "b", "x", "y").mapInArrow(similar, "a bigint, b bigint")


def connected(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) for the nodes of edges a, b."""
    ways = keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = keep(ways.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumn("moved", F.lit(True)))
    while not labels.where("moved").isEmpty():
        near = ways.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        step = (labels.select("node", F.col("label").alias("old")).join(near.withColumnRenamed("a", "node"), "node")
                .select("node", "old", F.least("old", "other").alias("label")))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = keep(step.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old")
                      .select("node", "label", (F.col("label") < F.col("old")).alias("moved")))
    return labels.select("node", "label")


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels of nodes after edges between nodes; classes are merged, not nodes, so each round is smaller than the last."""
    ends = _both(edges, labels, "label").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    ends = keep(ends)
    if ends.isEmpty():
        return labels
    roots = connected(ends).select(F.col("node").alias("label"), F.col("label").alias("root"))
    return keep(labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")))


def _cells(held: DataFrame) -> DataFrame:
    """Of band, node and label where a band holds several classes: band, part and other (the cell), own, node and label."""
    sizes = held.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = (sizes.groupBy("band").agg(F.max_by("label", "n").alias("largest"), F.max("n").alias("top"), F.sum("n").alias("n"))
             .where("n > top").select("band", "largest", F.ceil((F.col("n") - F.col("top")) / CELL_ROWS).cast("int").alias("parts"),
                                      F.ceil(F.col("n") / CELL_OTHERS).cast("int").alias("others")))
    rows = held.join(sizes, "band")
    mine = (rows.where("label <> largest").withColumn("part", F.pmod(F.xxhash64(F.lit(1), "node"), "parts").cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).withColumn("own", F.lit(True)))
    every = (rows.withColumn("other", F.pmod(F.xxhash64(F.lit(2), "node"), "others").cast("int"))
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("own", F.lit(False)))
    columns = ["band", "part", "other", "own", "node", "label"]
    return mine.select(columns).union(every.select(columns))


def _links_across(held: DataFrame, nodes: DataFrame, multisets: DataFrame, least: float) -> DataFrame:
    rows = (_cells(held).join(nodes.select("node", "bands"), "node").join(multisets, "node")
            .select("band", "part", "other", "own", "node", "label", "bands", "multiset")
            .repartition("band", "part", "other").sortWithinPartitions("band", "part", "other"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(row: tuple) -> tuple:
            return row[4], row[5], np.array(row[6], "int64").tobytes(), row[7]

        every = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        found: list[tuple[int, int]] = []
        for key, cell in itertools.groupby(every, key=lambda r: r[:3]):
            rows_ = list(cell)
            own, others = [told(r) for r in rows_ if r[3]], [told(r) for r in rows_ if not r[3]]
            if own and others:
                found += joining_links(key[0], own, others, least)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(link, "a bigint, b bigint")


def classes(docs: DataFrame, id_col: str, text_col: str, width: int, least: float) -> tuple[DataFrame, DataFrame]:
    """node (null without words) and doc_id of each document; and of each node first_id, label, class_id, class_size."""
    rows = docs.select(node_of(F.col(f"`{text_col}`")).alias("node"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    signed = keep(_signed(rows, width))
    nodes = keep(signed.where(F.col("node").isNotNull()).groupBy("node")
                 .agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("short").alias("short")))
    band = nodes.select("node", F.explode("bands").alias("band"))
    # Only bands that hold two nodes or more stay.
    band = keep(band.join(band.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "band"))
    degree = band.groupBy("node").agg(F.sum("n").alias("degree"))
    band = band.join(degree, "node").select("band", "node", "degree")
    centre = band.groupBy("band").agg(F.max_by("node", "degree").alias("centre"), F.max("degree").alias("most"))
    band = keep(band.join(centre, "band").select("band", "node", "centre", "most"))
    labels = keep(band.select("node").distinct().withColumn("label", F.col("node")))
    # One text of each node that met another; copies have ids of their own, so no node gathers its copies.
    met = labels.select("node").join(nodes.select("node", "first_id"), "node").withColumnRenamed("node", "met")
    texts = rows.join(met, (F.col("node") == F.col("met")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi").dropDuplicates(["node", "doc_id"])
    multisets = keep(_multisets(texts, width))

    best = keep(band.where("node <> centre").groupBy(F.col("node").alias("a")).agg(F.max_by("centre", "most").alias("b")))
    labels = _merged(labels, _linked(best, nodes, multisets, least))
    rest = band.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct().join(best, ["a", "b"], "left_anti")
    pairs = keep(_both(rest, labels, "label").where("x <> y").select("a", "b"))
    labels = _merged(labels, _linked(pairs, nodes, multisets, least))
    labels = _merged(labels, _links_across(band.select("band", "node").join(labels, "node"), nodes, multisets, least))

    known = nodes.select("node", "first_id", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    whole = known.groupBy("label").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
    return signed.select("node", "doc_id"), known.select("node", "first_id", "label").join(whole, "label")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """For each document: doc_id, class_id (the smallest id of its class) and class_size."""
    members, found = classes(docs, id_col, text_col, width, least)
    alone = members.where(F.col("node").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"))
    return members.where(F.col("node").isNotNull()).join(found, "node").select("doc_id", "class_id", "class_size").unionByName(alone)


def distinct_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """One document of each class, with all its columns: the one of the smallest id."""
    _, found = classes(docs, id_col, text_col, width, least)
    first = (found.groupBy("label").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "node")).alias("m"))
             .select(F.col("m.node").alias("node"), F.col("m.first_id").alias("first_id")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("row_id"), node_of(text).alias("row_node"), row)
    one = (rows.where(F.col("row_node").isNotNull())
           .join(first, (F.col("row_node") == F.col("node")) & F.col("row_id").eqNullSafe(F.col("first_id")), "left_semi").dropDuplicates(["row_node", "row_id"]))
    return one.select("document.*").unionByName(rows.where(F.col("row_node").isNull()).select("document.*"))
