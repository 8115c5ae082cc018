"""Hard negatives by best-first search in STR-packed R-trees, exact in integers.

Rows are cut into slabs along label and first component (a range shuffle, so copies and large labels
spread over slabs of bounded size). A task packs its slab into an R-tree by sort-tile-recursive: the
rows of a label are sorted along one axis, cut, each cut sorted along the next, down to leaves, whose
minimum bounding boxes are packed upwards. A box bounds each coordinate's share of an inner product,
so its scores lie in an interval. A search pops the box of the highest possible score first; boxes
outside all score windows, or strictly below the k-th best of every window they reach, are pruned.

The same bounds choose slabs for anchors: first the one that can hold the highest score, whose k-th
best then rules out others; what is left is searched in blocks of anchors and one slab each. Boxes of
slabs are sent to tasks in parts of bounded size. The search is exact, ties included.

Rows with a null label or vector, or a null, NaN or infinite component take no part. Vectors are
compared with those of their own length. Rows that repeat are rows of their own; a null vec_id counts
as the largest and is no anchor. Of equal scores and vec_ids the stored order decides. Anchors without
another row of their label, or without rows in a window (always so below zero), give no rows; an empty
table gives none. Other columns are not read. Components beyond ``integers.LIMIT`` are refused.
"""

from collections.abc import Iterator
from heapq import heappop, heappush
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecfold.llm import integers
from vecfold.llm.tables import small, stored

SLAB_ROWS = 8_192  # rows of one tree
ANCHOR_ROWS = 20_000  # anchors that meet a slab in one task
LEAF_ROWS = 128
FANOUT = 16
BOUNDED_AT_ONCE = 512  # anchors whose bounds of all boxes are held at once
BOX_ROWS = 100_000  # boxes of slabs sent to tasks at once
NO_ID = (1 << 63) - 1
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for width in np.unique(lengths):
        rows = np.flatnonzero(lengths == width)
        yield rows, integers.matrix(column.take(pa.array(rows)), int(width))


def fitting(*matrices: np.ndarray) -> type:
    """The type in which products of these integer matrices are exact: double if it can, it is faster."""
    largest = [int(np.abs(m).max(initial=0)) for m in matrices]
    return np.float64 if max(largest) ** 2 * max(1, matrices[0].shape[1]) < 1 << 53 else np.int64


def intervals(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest and smallest inner product of each query with any vector in each box."""
    kind = fitting(queries, lo, hi)
    up, down = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
    lo, hi = lo.T.astype(kind), hi.T.astype(kind)
    return up @ hi + down @ lo, up @ lo + down @ hi


def tiles(x: np.ndarray, rows: np.ndarray, axes: np.ndarray, capacity: int) -> Iterator[np.ndarray]:
    """Rows in pages of ``capacity``: sorted along an axis and cut, each cut along the next axis."""
    pages = -(-len(rows) // capacity)
    if pages <= 1 or not len(axes):
        for at in range(0, len(rows), capacity):
            yield rows[at : at + capacity]
        return
    cuts = ceil(round(pages ** (1 / len(axes)), 9))
    size = capacity * -(-pages // cuts)
    rows = rows[np.argsort(x[rows, axes[0]], kind="stable")]
    for at in range(0, len(rows), size):
        yield from tiles(x, rows[at : at + size], axes[1:], capacity)


class Tree:
    """An R-tree for each label. Leaves are runs of rows of ``x``, inner nodes runs of nodes below them."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray):
        axes = np.argsort(-x.std(axis=0), kind="stable") if x.shape[1] else np.zeros(0, int)
        order, self.roots, lo, hi, first, end, leaf = [], {}, [], [], [], [], []
        filled = 0
        for label in np.unique(labels):
            level = []
            for page in tiles(x, np.flatnonzero(labels == label), axes, LEAF_ROWS):
                order.append(page)
                level.append(len(lo))
                lo.append(x[page].min(axis=0)), hi.append(x[page].max(axis=0))
                first.append(filled), end.append(filled + len(page)), leaf.append(True)
                filled += len(page)
            while len(level) > 1:
                above = []
                for at in range(0, len(level), FANOUT):
                    below = level[at : at + FANOUT]  # numbered in a row
                    above.append(len(lo))
                    lo.append(np.min([lo[n] for n in below], axis=0)), hi.append(np.max([hi[n] for n in below], axis=0))
                    first.append(below[0]), end.append(below[-1] + 1), leaf.append(False)
                level = above
            self.roots[int(label)] = level[0]
        order = np.concatenate(order)
        self.x, self.ids, self.rows = x[order], ids[order], rows[order]
        self.lo, self.hi, self.first, self.end, self.leaf = np.array(lo), np.array(hi), first, end, leaf

    def best(self, x, query, own: int, roots: list[int], upper: list, lower: list, highs: list, floors: list, k: int):
        """Per window the (score, vec_id, row) of the best ``k`` rows with floor <= score <= high, without row ``own``.

        ``x`` and ``query`` are in the type of :func:`fitting`; upper and lower bound each node's scores.
        """
        windows, kth, top, heap = range(len(highs)), list(floors), max(highs), []
        held = [(np.empty(0, np.int64),) * 3 for _ in windows]

        def open_in(node: int) -> bool:
            return any(upper[node] >= kth[w] and lower[node] <= highs[w] for w in windows)

        for node in roots:
            if open_in(node):
                heappush(heap, (-min(upper[node], top), node))
        while heap:
            node = heappop(heap)[1]
            if not open_in(node):
                continue
            if not self.leaf[node]:
                for child in range(self.first[node], self.end[node]):
                    if open_in(child):
                        heappush(heap, (-min(upper[child], top), child))
                continue
            at = slice(self.first[node], self.end[node])
            scores = x[at] @ query
            for w in windows:
                new = np.flatnonzero((scores >= kth[w]) & (scores <= highs[w]))
                if not len(new):
                    continue
                more = scores[new].astype(np.int64), self.ids[at][new], self.rows[at][new]
                score, vec_id, row = (np.concatenate(pair) for pair in zip(held[w], more))
                ranked = np.lexsort((row, vec_id, -score))
                ranked = ranked[row[ranked] != own][:k]
                held[w] = score[ranked], vec_id[ranked], row[ranked]
                if len(ranked) == k:
                    kth[w] = max(kth[w], int(held[w][0][-1]))
        return held


FOUND = "anchor bigint, w int, vec_id bigint, score bigint, row bigint"


def search_slab(k: int, same_label: bool):
    """The Arrow function that searches a slab for a block of requests."""

    def search(slab: pa.Table, requests: pa.Table) -> pa.Table:
        out = [[np.empty(0, np.int64)] * 5]
        trees = {}
        if slab.num_rows and requests.num_rows:
            columns = [slab.column(c).to_numpy() for c in ("vec_id", "row", "label")]
            trees = {x.shape[1]: Tree(x, *(c[rows] for c in columns)) for rows, x in by_length(slab.column("x"))}
        for rows, queries in by_length(requests.column("x")) if trees else ():
            tree = trees.get(queries.shape[1])
            if tree is None:
                continue
            kind = fitting(queries, tree.x)
            x = tree.x.astype(kind)
            own, labels = (requests.column(c).to_numpy()[rows] for c in ("row", "label"))
            highs, floors = (requests.column(c).take(pa.array(rows)).to_pylist() for c in ("highs", "floors"))
            for at in range(0, len(rows), BOUNDED_AT_ONCE):
                upper, lower = intervals(queries[at : at + BOUNDED_AT_ONCE], tree.lo, tree.hi)
                for i in range(at, min(at + BOUNDED_AT_ONCE, len(rows))):
                    roots = [node for label, node in tree.roots.items() if (label == labels[i]) == same_label]
                    if not roots:
                        continue
                    bounds = upper[i - at].tolist(), lower[i - at].tolist()
                    for w, (score, vec_id, row) in enumerate(tree.best(x, queries[i].astype(kind), own[i], roots, *bounds, highs[i], floors[i], k)):
                        if len(row):
                            out.append([np.full(len(row), own[i]), np.full(len(row), w), vec_id, score, row])
        anchor, w, vec_id, score, row = (np.concatenate(c) for c in zip(*out))
        return pa.table({"anchor": anchor, "w": w.astype(np.int32), "vec_id": vec_id, "score": score, "row": row})

    return search


def slabs_of(rows: DataFrame) -> DataFrame:
    """The stored rows (row, vec_id, label, x) in slabs of about SLAB_ROWS rows."""
    count = max(1, ceil(rows.count() / SLAB_ROWS))
    dealt = rows.repartitionByRange(count, F.size("x"), "label", F.get("x", F.lit(0)), F.xxhash64("row"))
    return stored(dealt.withColumn("slab", F.spark_partition_id()), "slabs")


def boxes_of(slabs: DataFrame) -> DataFrame:
    """(slab, label, lo, hi): bounding boxes of the rows of a label and length that a task sees of a slab."""

    def per_task(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batch_iter:
            slab, label = batch.column("slab").to_numpy(), batch.column("label").to_numpy()
            for rows, x in by_length(batch.column("x")):
                order = np.lexsort((label[rows], slab[rows]))
                s, v, x = slab[rows][order], label[rows][order], x[order]
                starts = np.flatnonzero(np.r_[True, (np.diff(s) != 0) | (np.diff(v) != 0)])
                lo, hi = np.minimum.reduceat(x, starts, axis=0), np.maximum.reduceat(x, starts, axis=0)
                for i, at in enumerate(starts):
                    key = int(s[at]), int(v[at]), x.shape[1]
                    before = held.get(key)
                    held[key] = (lo[i], hi[i]) if before is None else (np.minimum(before[0], lo[i]), np.maximum(before[1], hi[i]))
            if len(held) >= BOX_ROWS:
                yield boxes(held)
                held = {}
        yield boxes(held)

    def boxes(held: dict) -> pa.RecordBatch:
        wide = pa.list_(pa.int32())
        values = [[k[0] for k in held], [k[1] for k in held], [b[0].tolist() for b in held.values()], [b[1].tolist() for b in held.values()]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int64(), wide, wide))], ["slab", "label", "lo", "hi"])

    return stored(slabs.select("slab", "label", "x").mapInArrow(per_task, "slab int, label bigint, lo array<int>, hi array<int>"), "boxes")


def routed(anchors: DataFrame, boxes: DataFrame, same_label: bool, first: bool) -> DataFrame:
    """Anchors with each ``slab`` whose boxes leave a window open, but for the one already ``seen``.

    With ``first`` only the slab with the highest possible score in a window, and that score as ``reach``.
    """
    count, held = boxes.count(), boxes.agg(F.max("slab")).first()[0] or 0
    step = max(1, (held + 1) * BOX_ROWS // max(1, count))
    parts = [_routed_part(anchors, boxes.where(F.col("slab").between(at, at + step - 1)).toArrow(), same_label, first) for at in range(0, held + 1, step)]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found


def _routed_part(anchors: DataFrame, part: pa.Table, same_label: bool, first: bool) -> DataFrame:
    slab, label = part.column("slab").to_numpy(), part.column("label").to_numpy()
    kept = [(x, integers.matrix(part.column("hi").combine_chunks().take(pa.array(rows)), x.shape[1]), slab[rows], label[rows]) for rows, x in by_length(part.column("lo"))]
    shared = anchors.sparkSession.sparkContext.broadcast({lo.shape[1]: (lo, hi, s, v) for lo, hi, s, v in kept})

    def per_batch(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            which, where, reach = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
            labels, seen = batch.column("label").to_numpy(), batch.column("seen").to_numpy()
            for rows, queries in by_length(batch.column("x")):
                if queries.shape[1] not in shared.value:
                    continue
                lo, hi, s, v = shared.value[queries.shape[1]]
                highs, floors = (batch.column(c).take(pa.array(rows)).to_pylist() for c in ("highs", "floors"))
                for at in range(0, len(rows), BOUNDED_AT_ONCE):
                    upper, lower = intervals(queries[at : at + BOUNDED_AT_ONCE], lo, hi)
                    for i in range(at, min(at + BOUNDED_AT_ONCE, len(rows))):
                        u, d = upper[i - at], lower[i - at]
                        fit = np.zeros(len(s), bool)
                        for high, floor in zip(highs[i], floors[i]):
                            fit |= (u >= floor) & (d <= high)
                        fit &= ((v == labels[rows[i]]) == same_label) & (s != seen[rows[i]])
                        open_in = np.flatnonzero(fit)
                        score = np.minimum(u[open_in], max(highs[i], default=LOWEST)).astype(np.int64)
                        if first and len(open_in):
                            best = np.lexsort((s[open_in], -score))[:1]
                            open_in, score = open_in[best], score[best]
                        slabs, at_first = np.unique(s[open_in], return_index=True)
                        which.append(np.full(len(slabs), rows[i])), where.append(slabs), reach.append(score[at_first])
            chosen = batch.take(pa.array(np.concatenate(which)))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(np.concatenate(where)), pa.array(np.concatenate(reach))], [*chosen.schema.names, "slab", "reach"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema.fields)
    return anchors.mapInArrow(per_batch, f"{kinds}, slab int, reach bigint")


def searched(slabs: DataFrame, requests: DataFrame, anchors: int, k: int, same_label: bool) -> DataFrame:
    """What requests find in their slabs; a task holds a slab and at most about ANCHOR_ROWS requests."""
    blocks = max(1, ceil(anchors / ANCHOR_ROWS))
    asked = stored(requests.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")), "requests")
    wanted = small(stored(asked.select("slab", "block").distinct(), "wanted"))
    meeting = slabs.join(wanted, "slab").groupBy("slab", "block").cogroup(asked.groupBy("slab", "block"))
    return stored(meeting.applyInArrow(search_slab(k, same_label), FOUND), "found")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each anchor and window with their ``rank``."""
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_rows(slabs: DataFrame, boxes: DataFrame, anchors: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(anchor, w, vec_id, score, row, rank): the best rows of (or not of) an anchor's label in each of its windows.

    ``anchors`` is a stored table of row, label, x, and floors and highs, the windows' bounds.
    """
    count = anchors.count()
    fresh = anchors.withColumn("seen", F.lit(-1))
    one = stored(routed(fresh, boxes, same_label, first=True), "first")
    one = one.groupBy("row").agg(F.max_by(F.struct("label", "x", "floors", "highs", "seen", "slab"), F.struct("reach", "slab")).alias("best")).select("row", "best.*")
    one = stored(one, "first")
    early = searched(slabs, one, count, k, same_label)
    # The k-th best so far raises a window's floor for the other slabs.
    kth = ranked(early, k).where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
    known = one.select(F.col("row").alias("anchor"), F.col("slab").alias("first")).join(kth, "anchor", "left")
    raised = F.transform("floors", lambda floor, w: F.coalesce(F.try_element_at("kth", w), floor))
    later = anchors.join(known, anchors["row"] == known["anchor"]).select("row", "label", "x", raised.alias("floors"), "highs", F.col("first").alias("seen"))
    late = searched(slabs, routed(stored(later, "later"), boxes, same_label, first=False), count, k, same_label)
    return ranked(early.union(late), k)


def mine(
    embeddings: DataFrame, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``embeddings`` has vec_id, label and embedding; ``is_anchor`` is a condition on them. Negatives of a positive
    have another label and scores from ``low`` to ``high`` percent of its own.
    """
    usable = embeddings.where(F.col("label").isNotNull() & integers.usable("embedding"))
    columns = {"vec_id": F.col("vec_id"), "label": F.col("label").cast("bigint"), "is_anchor": F.coalesce(is_anchor & F.col("vec_id").isNotNull(), F.lit(False))}
    rows = integers.scaled(usable, "embedding", scale, columns).withColumn("vec_id", F.coalesce(F.col("vec_id").cast("bigint"), F.lit(NO_ID)))
    slabs = slabs_of(stored(rows.withColumn("row", F.monotonically_increasing_id()), "rows"))
    boxes = boxes_of(slabs)
    anchors = stored(slabs.where("is_anchor").select("row", "vec_id", "label", "x"), "anchors")
    everything = anchors.select("row", "label", "x", F.array(F.lit(LOWEST)).alias("floors"), F.array(F.lit(HIGHEST)).alias("highs"))
    near = stored(best_rows(slabs.drop("is_anchor"), boxes, everything, positives, same_label=True), "positives")
    # A window for each positive score of an anchor that is not negative: ceil(low %) to floor(high %).
    window = F.struct("score", (-F.floor(-F.col("score") * low / F.lit(100).cast("decimal(3,0)"))).cast("bigint").alias("floor"),
                      F.floor(F.col("score") * high / F.lit(100).cast("decimal(3,0)")).cast("bigint").alias("high"))
    windows = near.where("score >= 0").select("anchor", window.alias("window")).distinct()
    windows = windows.groupBy("anchor").agg(F.array_sort(F.collect_list("window")).alias("windows"))  # no more than the positives
    asking = anchors.join(windows, anchors["row"] == windows["anchor"]).select("row", "label", "x", "windows")
    asking = stored(asking, "asking")
    requests = asking.select("row", "label", "x", F.col("windows.floor").alias("floors"), F.col("windows.high").alias("highs"))
    far = best_rows(slabs.drop("is_anchor"), boxes, stored(requests, "windows"), negatives, same_label=False)
    scores = asking.select(F.col("row").alias("anchor"), F.posexplode("windows.score").alias("w", "score"))
    pairs = near.select("anchor", F.col("vec_id").alias("positive"), F.col("score").alias("positive_score"))
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    found = far.select("anchor", "w", "rank", F.col("vec_id").alias("negative"), F.col("score").alias("negative_score")).join(scores, ["anchor", "w"])
    found = found.withColumnRenamed("score", "positive_score").join(pairs, ["anchor", "positive_score"]).join(named, "anchor")
    real = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return found.select(
        "anchor_id", real("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), real("negative").alias("negative_id"), "positive_score", "negative_score"
    )


SQL = """
    WITH kept AS MATERIALIZED (
        SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * e::DOUBLE) for e in embedding] AS x
        FROM embeddings WHERE label IS NOT NULL AND len([e for e in embedding if isfinite(e)]) = len(embedding)
    ), scored AS MATERIALIZED (
        SELECT a.rid, a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.rid AS other, b.label, list_inner_product(a.x, b.x)::BIGINT AS score
        FROM kept a JOIN kept b ON a.rid <> b.rid AND len(a.x) = len(b.x) WHERE a.vec_id % 50 = 0
    ), positives AS (
        SELECT rid, anchor_id, vec_id, score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id, other) AS place FROM scored WHERE label = own QUALIFY place <= 5
    )
    SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER (PARTITION BY p.rid, p.place ORDER BY n.score DESC, n.vec_id, n.other))::INTEGER AS rank,
        n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM positives p JOIN scored n ON n.rid = p.rid AND n.label <> n.own AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
    QUALIFY rank <= 3
"""
