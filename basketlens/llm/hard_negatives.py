"""Hard negatives by a multiway tree of split points (GNAT) over vectors.

Vectors are quantised to floor(256 * x) and scored by integer inner product. The
tree is drawn from a bounded sample: each node has up to WAYS split points far
from one another, and each child holds what is nearest to its split point. Every
vector goes down to its leaf. Each split point keeps the range of its distances
to the vectors of every sibling subtree, its own included, and each subtree the
range of its vectors' norms.

An anchor asks for scores in a window. With the norms of a subtree the window is
a shell around the anchor, from one distance to another; by the triangle
inequality the subtree can hold something of it only if for every split point
among the siblings the shell, seen from there, meets the stored range. All other
subtrees are left out, and leaves that remain are read exactly, in tiles of anchors
and blocks of vectors with partial selection. Three searches run one upon the
other: an anchor's own leaf gives a first bound; positives are the best of the
same label, all that may reach that bound; each positive opens a window of scores
for other labels.

Blocks are cut in ranges of leaf and id, so a leaf of any size is many blocks, and
each pair of tile and block has a key of its own. Per tile and block only the best
leave a task; lists are merged in a tree.

Sent to the driver and to tasks: at most SAMPLE vectors, and the ranges of at most
WAYS + WAYS^2 subtrees a width seen in the sample. Vectors of a width that the
sample lacks are one leaf that nothing eliminates.

Defined cases: rows with a null id, label or vector, an empty vector, or null or
non-finite components take no part. Of rows that repeat an id the one with the
smallest vector, then label, counts. Vectors of different length are never
compared. Where products may reach 2**53 nothing is eliminated and products are
64-bit integers. Positives and negatives are fewer where there are fewer; a
positive score below zero has an empty window. Ties go to the smaller id. Empty
tables give no rows; further columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact_topk import SCALE, products
from .work import kept

SAMPLE, WAYS, LEAF, BLOCK, TILE, FAN = 8192, 16, 512, 4096, 128, 16
FULL = 2**53
HELD = 200_000
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the floored components of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x")).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0)
        & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    one = clean.groupBy("vec_id").agg(F.min(F.struct("x", "label")).alias("one"))
    cells = F.transform("one.x", lambda c: F.floor(F.lit(float(SCALE)) * c).cast("long"))
    return one.select("vec_id", F.col("one.label").alias("label"), cells.alias("q"))


# ---- The tree ---------------------------------------------------------------------


class Tree:
    """Split points of one width: node 0 is the root, children of node n are listed in `below[n]`, leaves have none."""

    def __init__(self, rows: np.ndarray, leaves: int):
        self.points, self.below = {}, {}
        self._grow(0, np.unique(rows.astype(np.float64), axis=0), leaves)
        self.leaf = {n: i for i, n in enumerate(sorted(n for n in self.below if not self.below[n]))}

    def _grow(self, node: int, rows: np.ndarray, leaves: int) -> None:
        self.below[node] = []
        if leaves <= 1 or len(rows) < 2 * WAYS:
            return
        # Far from one another: each next split point is the row farthest from those chosen.
        chosen = [int(np.argmax(squares(rows, rows.mean(0)[None])[:, 0]))]
        near = squares(rows, rows[chosen])[:, 0]
        while len(chosen) < min(WAYS, leaves) and near.max() > 0:
            chosen.append(int(np.argmax(near)))
            near = np.minimum(near, squares(rows, rows[chosen[-1:]])[:, 0])
        self.points[node] = rows[chosen]
        side = np.argmin(squares(rows, self.points[node]), 1)
        for way in range(len(chosen)):
            child = len(self.below)
            self.below[node].append(child)
            self._grow(child, rows[side == way], leaves // WAYS)

    def descend(self, rows: np.ndarray):
        """Each row's leaf, and (node, rows there, child taken, squared distances to the node's points) on the way."""
        leaf, visits, open_to = np.zeros(len(rows), np.int64), [], [(0, np.arange(len(rows)))]
        while open_to:
            node, at = open_to.pop()
            if not len(at):
                continue
            if not self.below[node]:
                leaf[at] = self.leaf[node]
                continue
            far = squares(rows[at], self.points[node])
            side = np.argmin(far, 1)
            visits.append((node, at, side, far))
            open_to += [(child, at[side == way]) for way, child in enumerate(self.below[node])]
        return leaf, visits


def squares(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all points."""
    far = (rows * rows).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2 * (rows @ points.T)
    return np.maximum(far, 0.0)


class Ranges:
    """Per node and child: distances from every split point of the node, norms, and how many vectors there are."""

    def __init__(self, rows: list, trees: dict):
        self.near, self.far, self.norms, self.sizes = {}, {}, {}, {}
        for row in rows:
            key = (row["width"], row["node"], row["child"])
            self.near[key], self.far[key] = np.sqrt(np.array(row["near"])), np.sqrt(np.array(row["far"]))
            self.norms[key], self.sizes[key] = (row["least"], row["most"]), row["size"]


def leaves_reached(tree: Tree, ranges: Ranges, width: int, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether each leaf may hold, for each anchor, a score inside one of the anchor's windows.

    anchors: vectors; low, high: their windows, one column each, empty where low is above high.
    """
    out = np.zeros((len(anchors), len(tree.leaf)), bool)
    own = (anchors * anchors).sum(1)
    open_to = [(0, (low <= high).any(1))]
    while open_to:
        node, who = open_to.pop()
        at = np.flatnonzero(who)
        if not len(at):
            continue
        if not tree.below[node]:
            out[at, tree.leaf[node]] = True
            continue
        seen = np.sqrt(squares(anchors[at], tree.points[node]))
        for way, child in enumerate(tree.below[node]):
            key = (width, node, way)
            if key not in ranges.sizes:
                continue
            least, most = ranges.norms[key]
            outer = own[at, None] + most - 2 * low[at].astype(np.float64)
            inner = own[at, None] + least - 2 * high[at].astype(np.float64)
            fits = (low[at] <= high[at]) & (outer >= 0)
            outer, inner = np.sqrt(np.maximum(outer, 0)), np.sqrt(np.maximum(inner, 0))
            # Rounding of roots is far below this; a range that only just meets stays.
            slack = 1e-6 * (1 + outer)
            for point in range(len(tree.below[node])):
                here = seen[:, point, None]
                nearest = np.maximum(here - outer, inner - here)
                fits &= (nearest <= ranges.far[key][point] + slack) & (here + outer >= ranges.near[key][point] - slack)
            on = np.zeros(len(anchors), bool)
            on[at] = fits.any(1)
            open_to.append((child, on))
    return out


# ---- Index ------------------------------------------------------------------------

PLACED = "width int, leaf long, vec_id long, label long, q array<long>"
BLOCKS = "width int, leaf long, ids binary, labels binary, kind string, cells binary"
RANGED = "width int, node int, child int, near array<double>, far array<double>, least double, most double, size long, widest double"


def _by_width(batch):
    """Matrices of a batch's vectors, one a width: (width, places in the batch, cells)."""
    vectors = batch.column(batch.schema.get_field_index("q"))
    sizes, flat = vectors.value_lengths().to_numpy(), vectors.flatten().to_numpy()
    ends = np.cumsum(sizes)
    for width in np.unique(sizes):
        at = np.flatnonzero(sizes == width)
        yield int(width), at, flat[(ends[at] - width)[:, None] + np.arange(width)]


def _placer(trees: dict):
    def place(batches):
        for batch in batches:
            leaf = np.zeros(batch.num_rows, np.int64)
            for width, at, cells in _by_width(batch):
                if width in trees:
                    leaf[at] = trees[width].descend(cells.astype(np.float64))[0]
            widths = batch.column(2).value_lengths().cast(pa.int32())
            yield pa.RecordBatch.from_arrays([widths, pa.array(leaf), *batch.columns], names=["width", "leaf", "vec_id", "label", "q"])

    return place


def _ranger(trees: dict):
    """Ranges of a task's vectors, per width, node and child; the root's own row (child -1) tells the largest component."""

    def measure(batches):
        held: dict = {}
        for batch in batches:
            for width, _, cells in _by_width(batch):
                rows = cells.astype(np.float64)
                norms, widest = (rows * rows).sum(1), float(np.abs(rows).max())
                visits = trees[width].descend(rows)[1] if width in trees else []
                found = [((width, -1, -1), np.zeros(0), np.zeros(0), norms.min(), norms.max(), len(rows), widest)]
                for node, at, side, far in visits:
                    for way in np.unique(side):
                        of = side == way
                        found.append(((width, node, int(way)), far[of].min(0), far[of].max(0), norms[at[of]].min(), norms[at[of]].max(), int(of.sum()), 0.0))
                for key, near, far, least, most, size, wide in found:
                    old = held.get(key)
                    held[key] = (near, far, least, most, size, wide) if old is None else (
                        np.minimum(old[0], near), np.maximum(old[1], far), min(old[2], least), max(old[3], most), old[4] + size, max(old[5], wide)
                    )
        rows = [
            {"width": k[0], "node": k[1], "child": k[2], "near": v[0].tolist(), "far": v[1].tolist(), "least": v[2], "most": v[3], "size": v[4], "widest": v[5]}
            for k, v in held.items()
        ]
        yield pa.RecordBatch.from_pylist(rows, schema=_RANGED)

    return measure


_RANGED = pa.schema([
    ("width", pa.int32()), ("node", pa.int32()), ("child", pa.int32()), ("near", pa.list_(pa.float64())), ("far", pa.list_(pa.float64())),
    ("least", pa.float64()), ("most", pa.float64()), ("size", pa.int64()), ("widest", pa.float64()),
])


def _narrow(cells: np.ndarray) -> np.ndarray:
    return cells.astype(np.result_type(np.min_scalar_type(cells.min()), np.min_scalar_type(cells.max()), np.int8))


def _pack(batches):
    """Blocks of rows that come sorted by width, leaf and id."""
    key, held = None, []
    for batch in batches:
        widths, leaves = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        ids, labels = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        ends, flat = np.cumsum(widths, dtype=np.int64), batch.column(4).flatten().to_numpy()
        cut = np.flatnonzero((np.diff(widths) != 0) | (np.diff(leaves) != 0)) + 1
        for start, stop in zip([0, *cut], [*cut, len(ids)], strict=True):
            while start < stop:
                now = (int(widths[start]), int(leaves[start]))
                if held and (now != key or sum(len(part[0]) for part in held) >= BLOCK):
                    yield _packed(key, held)
                    held = []
                end = min(stop, start + BLOCK - sum(len(part[0]) for part in held))
                cells = flat[ends[start] - now[0] : ends[end - 1]].reshape(-1, now[0])
                held.append((ids[start:end], labels[start:end], cells))
                key, start = now, end
    if held:
        yield _packed(key, held)


def _packed(key: tuple, held: list):
    ids, labels, cells = (np.concatenate(part) for part in zip(*held, strict=True))
    cells = _narrow(cells)
    return pa.RecordBatch.from_pylist(
        [{"width": key[0], "leaf": key[1], "ids": ids.astype(np.int64).tobytes(), "labels": labels.astype(np.int64).tobytes(),
          "kind": cells.dtype.str, "cells": cells.tobytes()}],
        schema=_BLOCKS,
    )


_BLOCKS = pa.schema([
    ("width", pa.int32()), ("leaf", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("kind", pa.string()), ("cells", pa.binary()),
])


class Index:
    """All vectors in blocks by leaf, and the tree's ranges."""

    def __init__(self, vectors: DataFrame, sample: int = SAMPLE, leaf: int = LEAF):
        rows = quantised(vectors)
        drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("q").toArrow().column(0).to_pylist()
        total = rows.count() if len(drawn) == sample else len(drawn)
        self.trees = {}
        for width in sorted({len(q) for q in drawn}):
            own = np.array([q for q in drawn if len(q) == width], np.int64)
            self.trees[width] = Tree(own, min(WAYS**2, max(1, total * len(own) // max(1, len(drawn)) // leaf)))
        placed = rows.mapInArrow(_placer(self.trees), PLACED).repartitionByRange("width", "leaf", "vec_id")
        blocks = placed.sortWithinPartitions("width", "leaf", "vec_id").mapInArrow(_pack, BLOCKS)
        self.blocks = kept(blocks.withColumn("block", F.monotonically_increasing_id()), "negatives-blocks")
        partial = rows.mapInArrow(_ranger(self.trees), RANGED)
        self.ranges, self.sizes, self.exact = self._ranges(partial)

    def _ranges(self, partial: DataFrame):
        key = ["width", "node", "child"]
        whole = partial.groupBy(*key).agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("size").alias("size"), F.max("widest").alias("widest"))
        each = partial.select(*key, F.posexplode(F.arrays_zip("near", "far")).alias("point", "at"))
        ends = each.groupBy(*key, "point").agg(F.min("at.near").alias("near"), F.max("at.far").alias("far"))
        lists = ends.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("point", "near", "far"))).alias("ends"))
        # A row per subtree of the tree, whose size the sample bounds, and one per width.
        rows = [row.asDict(recursive=True) for row in whole.join(lists, key, "left").collect()]
        for row in rows:
            row["near"], row["far"] = ([one[name] for one in row["ends"] or []] for name in ("near", "far"))
        exact = {row["width"]: row["widest"] ** 2 * row["width"] < FULL for row in rows if row["node"] < 0}
        ranges, sizes = Ranges([row for row in rows if row["node"] >= 0], self.trees), {}
        for row in rows:
            tree = self.trees.get(row["width"])
            if row["node"] < 0:
                if tree is None or not tree.below[0]:
                    sizes[row["width"], 0] = row["size"]
            elif not tree.below[tree.below[row["node"]][row["child"]]]:
                sizes[row["width"], tree.leaf[tree.below[row["node"]][row["child"]]]] = row["size"]
        return ranges, sizes, exact

    def keys(self) -> dict:
        """How many keys the blocks of each leaf are dealt to."""
        return {place: -(-size // BLOCK) for place, size in self.sizes.items()}


# ---- Search -----------------------------------------------------------------------

ASKED = "vec_id long, label long, q array<long>, low array<long>, high array<long>, tag array<long>"
TILES = "width int, leaf long, key long, ids binary, labels binary, kind string, cells binary, low binary, high binary, tag binary"
HITS = "anchor_id long, tag long, vec_id long, score long, block long"


def _tiler(index_trees: dict, ranges: Ranges, keys: dict, exact: dict, own_leaf: bool):
    """Tiles of anchors with each leaf they have to read, and each of the leaf's keys."""

    def tile(batches):
        for batch in batches:
            for width, at, cells in _by_width(batch):
                ids, labels = batch.column(0).to_numpy()[at], batch.column(1).to_numpy()[at]
                low, high, tag = (_padded(batch.column(3 + n), at, fill) for n, fill in enumerate((HIGHEST, LOWEST, -1)))
                tree = index_trees.get(width)
                if tree is None or not tree.below[0]:
                    reached = (low <= high).any(1)[:, None]
                elif own_leaf:
                    reached = np.zeros((len(at), len(tree.leaf)), bool)
                    reached[np.arange(len(at)), tree.descend(cells.astype(np.float64))[0]] = True
                elif not exact[width]:
                    reached = np.repeat((low <= high).any(1)[:, None], len(tree.leaf), 1)
                else:
                    reached = leaves_reached(tree, ranges, width, cells.astype(np.float64), low, high)
                for leaf in range(reached.shape[1]):
                    who = np.flatnonzero(reached[:, leaf])
                    for start in range(0, len(who), TILE):
                        part = who[start : start + TILE]
                        small = _narrow(cells[part])
                        row = {
                            "width": width, "leaf": leaf, "ids": ids[part].astype(np.int64).tobytes(), "labels": labels[part].astype(np.int64).tobytes(),
                            "kind": small.dtype.str, "cells": small.tobytes(), "low": low[part].tobytes(), "high": high[part].tobytes(), "tag": tag[part].tobytes(),
                        }
                        yield pa.RecordBatch.from_pylist([row | {"key": key} for key in range(keys.get((width, leaf), 0))], schema=_TILES)

    return tile


_TILES = pa.schema([
    ("width", pa.int32()), ("leaf", pa.int64()), ("key", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("kind", pa.string()),
    ("cells", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("tag", pa.binary()),
])


def _padded(lists, at: np.ndarray, fill: int) -> np.ndarray:
    """Windows of the chosen rows as a matrix."""
    rows = [lists[int(n)].as_py() for n in at]
    wide = max(1, max(map(len, rows), default=1))
    return np.array([row + [fill] * (wide - len(row)) for row in rows], np.int64).reshape(len(rows), wide)


def _searcher(k: int, same: bool):
    """Per anchor and window the k best of the same label (or of all others) among the blocks that a task reads.

    Hits are cut to the k best whenever HELD of them have gathered, and given out when that is no longer enough.
    """

    def search(batches):
        held, size = [], 0
        for batch in batches:
            for number in range(batch.num_rows):
                row = batch.slice(number, 1).to_pylist()[0]
                anchors, ids = np.frombuffer(row["tile_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                own, labels = np.frombuffer(row["tile_labels"], np.int64), np.frombuffer(row["labels"], np.int64)
                one = np.frombuffer(row["tile_cells"], row["tile_kind"]).astype(np.int64).reshape(len(anchors), -1)
                two = np.frombuffer(row["cells"], row["kind"]).astype(np.int64).reshape(len(ids), -1)
                low, high, tag = (np.frombuffer(row[name], np.int64).reshape(len(anchors), -1) for name in ("low", "high", "tag"))
                scores, out = products(one, two), []
                for a in range(len(anchors)):
                    fit = (labels == own[a]) == same
                    fit &= ids != anchors[a]
                    able = np.flatnonzero(fit)
                    line = scores[a, able]
                    for w in range(low.shape[1]):
                        inside = np.flatnonzero((line >= low[a, w]) & (line <= high[a, w]))
                        if len(inside) > k:
                            reach = np.partition(line[inside], len(inside) - k)[len(inside) - k]
                            inside = inside[line[inside] >= reach]
                        # Ids ascend, so a stable order by falling score leaves ties to the smaller id.
                        best = inside[np.argsort(~line[inside], kind="stable")[:k]]
                        out += [(anchors[a], tag[a, w], ids[able[n]], line[n], row["block"]) for n in best]
                held.append(np.array(out, np.int64).reshape(-1, 5))
                size += len(held[-1])
                if size > HELD:
                    held = [best_of(np.concatenate(held), k)]
                    size = len(held[0])
                    if size > HELD // 2:
                        yield _hits(held[0])
                        held, size = [], 0
        if held:
            yield _hits(best_of(np.concatenate(held), k))

    return search


def best_of(hits: np.ndarray, k: int) -> np.ndarray:
    """The k best rows (anchor, tag, vector, score, block) of each anchor and tag."""
    hits = hits[np.lexsort((hits[:, 2], ~hits[:, 3], hits[:, 1], hits[:, 0]))]
    new = np.ones(len(hits), bool)
    new[1:] = (np.diff(hits[:, 0]) != 0) | (np.diff(hits[:, 1]) != 0)
    first = np.flatnonzero(new)
    return hits[np.arange(len(hits)) - np.repeat(first, np.diff(first, append=len(hits))) < k]


def _hits(table: np.ndarray):
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(table[:, n])) for n in range(5)], names=["anchor_id", "tag", "vec_id", "score", "block"]
    )


def _search(index: Index, asked: DataFrame, k: int, same: bool, own_leaf: bool = False) -> DataFrame:
    """anchor_id, tag and `best` (vec_id, score, best first) of each window that has any."""
    keys = index.keys()
    tiles = asked.mapInArrow(_tiler(index.trees, index.ranges, keys, index.exact, own_leaf), TILES)
    tiles = tiles.withColumnsRenamed({name: f"tile_{name}" for name in ("ids", "labels", "kind", "cells")})
    spread = asked.sparkSession.createDataFrame([(w, leaf, n) for (w, leaf), n in keys.items()] or [(0, 0, 1)], "width int, leaf long, spread long")
    # A leaf's blocks are dealt to as many keys as it has blocks; the list of leaves is as long as the tree.
    keyed = index.blocks.join(F.broadcast(spread), ["width", "leaf"]).withColumn("key", F.pmod(F.xxhash64("block"), F.col("spread"))).drop("spread")
    found = keyed.join(tiles, ["width", "leaf", "key"]).drop("width", "leaf", "key").mapInArrow(_searcher(k, same), HITS)
    return merged(found, sum(keys.values()), k)


def merged(found: DataFrame, blocks: int, k: int) -> DataFrame:
    """Partial lists merged level by level, FAN lists to one."""
    order = F.struct(F.bitwise_not("score").alias("less"), F.col("vec_id").alias("vec_id"), F.col("score").alias("score"))
    leaves = max(1, -(-blocks // FAN))
    level = found.withColumn("node", F.pmod(F.xxhash64("block"), F.lit(leaves)))
    while True:
        lists = level.groupBy("anchor_id", "tag", "node").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("best"))
        if leaves == 1:
            return lists.drop("node")
        leaves = -(-leaves // FAN)
        level = lists.select("anchor_id", "tag", F.pmod(F.col("node"), F.lit(leaves)).alias("node"), F.inline("best"))


def hard_negatives(anchors: DataFrame, vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, **built) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Both frames have vec_id, embedding and label; of the vectors that score between
    `low` and `high` percent of a positive, the best `negatives` of other labels are
    returned for each of an anchor's best `positives` of its own label.
    """
    index = Index(vectors, **built)
    start = kept(quantised(anchors), "negatives-anchors")

    def windows(lows, highs, tags):
        return [F.array(F.lit(x).cast("long")).alias(name) if isinstance(x, int) else x.alias(name) for name, x in (("low", lows), ("high", highs), ("tag", tags))]

    # Bound from the own leaf: the score that the wanted number of positives reaches there.
    first = _search(index, start.select("*", *windows(LOWEST, HIGHEST, 0)), positives, True, own_leaf=True)
    reach = first.filter(F.size("best") == positives).select(F.col("anchor_id").alias("vec_id"), F.element_at("best", -1)["score"].alias("reach"))
    bounded = start.join(reach, "vec_id", "left").withColumn("reach", F.coalesce("reach", F.lit(LOWEST)))
    wanted = bounded.select("vec_id", "label", "q", *windows(F.array("reach"), HIGHEST, 0))
    best = _search(index, wanted, positives, True).select(F.col("anchor_id").alias("vec_id"), F.transform("best", lambda b: F.struct(b["vec_id"].alias("positive_id"), b["score"].alias("positive_score"))).alias("positives"))
    best = kept(best, "negatives-positives")

    # Whole scores n with low * p <= 100 * n <= high * p; percentages of 64-bit scores are taken as decimals.
    score = lambda p: p["positive_score"].cast("decimal(20,0)")
    asked = start.join(best, "vec_id").select(
        "vec_id", "label", "q",
        F.transform("positives", lambda p: F.ceil(score(p) * low / 100).cast("long")).alias("low"),
        F.transform("positives", lambda p: F.floor(score(p) * high / 100).cast("long")).alias("high"),
        F.transform("positives", lambda p: p["positive_id"]).alias("tag"),
    )
    found = _search(index, asked, negatives, False)
    pairs = best.select(F.col("vec_id").alias("anchor_id"), F.inline("positives")).withColumnRenamed("positive_id", "tag")
    return pairs.join(found, ["anchor_id", "tag"]).select(
        "anchor_id", F.col("tag").alias("positive_id"), "positive_score", F.posexplode("best").alias("place", "hit")
    ).select(
        "anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("hit.vec_id").alias("negative_id"),
        "positive_score", F.col("hit.score").alias("negative_score"),
    )
