"""Near-duplicate detection: BagMinHash signatures of shingle multisets, banding, verified links, classes.

A text is lower-cased and split at white space; its items are runs of WORDS words
with their counts (a shorter text is one item). Similarity is the weighted Jaccard
of counts: sum of minima over sum of maxima, THRESHOLD or more for a link.

Signature: for each item and each unit of weight runs a Poisson process whose
points fall on random components; a component keeps the earliest point. Weights
are cut into the levels (0,1], (1,2], (2,4], (4,8], ...; the units of a level share
one process of their joint rate, each of whose points belongs to a random unit, and
points of units above the item's weight are passed over. That costs at most as many
points again as the levels below yield, so a weight w costs log w processes and not
w. Points of a process come in ascending order and stop at the latest point still
held, so most items cost one point. Equal components have probability equal to
the similarity.

BANDS bands of ROWS components make buckets: a pair of similarity 0.8 shares no
bucket with probability (1 - 0.8**4)**20 = 3e-5.

Equal multisets are one representative from the start. In each bucket one member, near
the middle of its group, is compared with all others, so a bucket costs as many pairs
as it has members. Buckets that then still hold several classes are compared in blocks:
pairs of tiles of at most about TILE members, each in one task, where pairs of different
classes are looked at until a link joins them. No pair of a bucket that could join two
classes is left out, pairs aren't emitted, and only links that join something leave a
task. Texts are compared whole.

Defined cases: null texts are empty; texts without words are one class; repeated
rows are copies of each other; a null doc_id takes part and sorts below all ids;
an empty table gives no rows; further columns are ignored. The row with the
smallest doc_id of a class stays.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import kept

WORDS = 5
BANDS, ROWS = 20, 4
OVER, UNDER = 5, 4  # THRESHOLD as a ratio: similar if OVER * minima >= UNDER * maxima
THRESHOLD = UNDER / OVER
MOST_WORDS_HELD = 500_000
BATCH = 256
TILE = 1024

SIGNED = "row long, doc_id long, content binary, size long, bands array<long>"


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of SplitMix64: a bijection that spreads all bits."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wait(seed: np.ndarray) -> np.ndarray:
    """Standard exponential waiting times."""
    return -np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)


class Shingler(dict):
    """Item hashes and counts of texts; as a dict, the 64-bit hash of each word met."""

    def __missing__(self, word: str) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found

    def items(self, text: str) -> tuple[np.ndarray, np.ndarray]:  # type: ignore[override]
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self) > MOST_WORDS_HELD:
            self.clear()
        ids = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        width = min(WORDS, len(ids))
        runs = np.zeros(len(ids) - width + 1, np.uint64)
        for k in range(width):
            runs = mix(runs ^ ids[k : len(ids) - width + 1 + k])
        return np.unique(runs, return_counts=True)


def processes(weights: np.ndarray, seeds: np.ndarray):
    """The processes that reach into (0, weight] of each item: index of the item, seed, lower end and width of the interval."""
    at, seed, low, width = [], [], [], []
    for j in range(int(weights.max(initial=0)).bit_length() + 1):
        bottom = 0 if j == 0 else 1 << (j - 1)
        mine = np.flatnonzero(weights > bottom)
        at.append(mine)
        seed.append(mix(seeds[mine] ^ np.uint64(j + 1)))
        low.append(np.full(len(mine), bottom, np.int64))
        width.append(np.full(len(mine), max(1, bottom), np.int64))
    return tuple(np.concatenate(x) for x in (at, seed, low, width))


def signatures(found: list[tuple[np.ndarray, np.ndarray]], parts: int) -> np.ndarray:
    """Earliest point of each component for several texts at once; infinite for a text without items."""
    out = np.full(len(found) * parts, np.inf)
    sizes = [len(hashes) for hashes, _ in found]
    if not sum(sizes):
        return out.reshape(-1, parts)
    weights = np.concatenate([c for _, c in found])
    at, seed, low, width = processes(weights, np.concatenate([h for h, _ in found]))
    text, most = np.repeat(np.arange(len(found)), sizes)[at], weights[at]
    point, step = np.zeros(len(seed)), 1
    while len(seed):
        drawn = mix(seed + np.uint64(step))
        point = point + wait(drawn) / (width * float(parts))
        place = mix(drawn)
        level = low + 1 + (mix(place) % width.astype(np.uint64)).astype(np.int64)
        counts = level <= most
        np.minimum.at(out, text[counts] * parts + (place[counts] % np.uint64(parts)).astype(np.int64), point[counts])
        going = point < out.reshape(-1, parts).max(axis=1)[text]
        seed, point, text, most, low, width = seed[going], point[going], text[going], most[going], low[going], width[going]
        step += 1
    return out.reshape(-1, parts)


def buckets(signature: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band of each signature."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), BANDS))
    for k in range(ROWS):
        keys = mix(keys ^ bits[:, :, k])
    return keys.view(np.int64)


def _sign(batches):
    shingler = Shingler()
    for batch in batches:
        for low in range(0, batch.num_rows, BATCH):
            part = batch.slice(low, BATCH)
            found = [shingler.items(text) for text in part.column(2).to_pylist()]
            keys = buckets(signatures(found, BANDS * ROWS))
            content = [hashlib.blake2b(h.tobytes() + c.tobytes(), digest_size=16).digest() for h, c in found]
            rows = [list(k) if len(h) else [] for k, (h, _) in zip(keys, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(content, pa.binary()), pa.array([int(c.sum()) for _, c in found], pa.int64()),
                 pa.array(rows, pa.list_(pa.int64()))], names=["row", "doc_id", "content", "size", "bands"])


def shared_weight(one, two) -> int:
    """Sum of the minima of two item multisets."""
    (a, na), (b, nb) = one, two
    if len(a) > len(b):
        (a, na), (b, nb) = (b, nb), (a, na)
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    same = b[at] == a if len(b) else np.zeros(len(a), bool)
    return int(np.minimum(na[same], nb[at[same]]).sum())


def _verify(batches):
    shingler, last, held = Shingler(), None, None
    for batch in batches:
        keep = []
        hubs = batch.column(0).to_pylist()
        for k in range(batch.num_rows):
            if hubs[k] != last:
                last, held = hubs[k], shingler.items(batch.column(2)[k].as_py())
            other = shingler.items(batch.column(3)[k].as_py())
            low = shared_weight(held, other)
            keep.append(OVER * low >= UNDER * int(held[1].sum() + other[1].sum() - low))
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows that are similar; texts: row, text."""
    left = texts.select(F.col("row").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("row").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_verify, "a long, b long")


def classes(links: DataFrame) -> DataFrame:
    """row and its class (the smallest row that links lead to) for every row of the pairs (a, b).

    Each round takes the smallest label around a row and then that label's own label, written
    out before the next, so lineage stays short; rounds grow with the log of the longest chain.
    """
    edges = kept(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = kept(edges.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("row"), F.least("a", "near").alias("label")), "labels")
    while True:
        around = edges.join(labels.select(F.col("row").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(around.withColumnRenamed("a", "row"), "row").select("row", "label", F.least("label", "near").alias("new"))
        jump = lower.select("row", "label", "new").join(labels.select(F.col("row").alias("new"), F.col("label").alias("far")), "new")
        moved = kept(jump.select("row", F.least("new", "far").alias("label"), (F.least("new", "far") < F.col("label")).alias("changed")), "labels")
        labels = moved.select("row", "label")
        if moved.filter("changed").isEmpty():
            return labels


def near_rows(texts: DataFrame) -> DataFrame:
    """row, doc_id, class (a row) for every row of `texts`: row, doc_id, text (both ids given, text not null)."""
    signed = kept(texts.select("row", "doc_id", "text").mapInArrow(_sign, SIGNED), "signatures")
    by_content = signed.groupBy("content").agg(F.min("row").alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    reps = kept(by_content, "representatives")
    members = reps.select("rep", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = members.join(sizes, "bucket")
    # The hub of a bucket is the member with most neighbours over all its buckets: near the middle of its group.
    weight = shared.groupBy("rep").agg(F.sum("n").alias("weight"))
    shared = kept(shared.join(weight, "rep"), "buckets")
    hubs = shared.groupBy("bucket").agg(F.max(F.struct("weight", "rep"))["rep"].alias("hub"))
    stars = shared.join(hubs, "bucket").filter("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
    links = kept(verified(stars.distinct(), texts), "links")
    found = classes(links)
    more = kept(_across(shared, found, reps, texts), "links")
    if not more.isEmpty():
        found = classes(links.unionByName(more))
    named = reps.select("content", "rep").join(found.withColumnRenamed("row", "rep"), "rep", "left").select("content", F.coalesce("label", "rep").alias("class"))
    return signed.select("row", "doc_id", "content").join(named, "content").select("row", "doc_id", "class")


def _across(shared: DataFrame, found: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join classes meeting in a bucket, enough to connect all that are similar.

    Members of a bucket that holds several classes are dealt to tiles of about TILE; each pair of tiles is one group.
    """
    sides = shared.select("bucket", "rep").join(found.withColumnRenamed("row", "rep"), "rep", "left").withColumn("class", F.coalesce("label", "rep"))
    opened = sides.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
    tiles = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
    full = sides.select("bucket", "rep", "class").join(opened.select("bucket", tiles.alias("tiles")), "bucket")
    tile = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    placed = full.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    keyed = placed.select("bucket", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "rep", "class")
    given = keyed.join(reps.select("rep", "size", "bands"), "rep").join(texts.select(F.col("row").alias("rep"), "text"), "rep")
    return given.groupBy("bucket", "i", "j").applyInArrow(_compare, "a long, b long").distinct()


def _compare(key: tuple, table: pa.Table) -> pa.Table:
    """Links between classes of one pair of tiles; a pair of texts is looked at in the first bucket that both share.

    Pairs that links have joined already are passed over, so a class costs a link for each part it joins.
    """
    bucket, i, j = (k.as_py() for k in key)
    table = table.sort_by("rep")
    rep, tile, size = (table[c].to_numpy() for c in ("rep", "tile", "size"))
    comp = table["class"].to_numpy().copy()
    bands = np.array(table["bands"].to_pylist(), np.int64)
    band = int(np.flatnonzero(bands[0] == bucket)[0])
    shingler = Shingler()
    items = [shingler.items(text.as_py()) for text in table["text"]]
    names, flat = np.unique(np.concatenate([h for h, _ in items]), return_inverse=True)
    counts = np.concatenate([c for _, c in items])
    starts = np.concatenate([[0], np.cumsum([len(h) for h, _ in items])])
    own = np.zeros(len(names), np.int64)
    links = []
    for p in range(len(rep) - 1):
        later = slice(p + 1, None)
        open_to = (comp[later] != comp[p]) & (OVER * np.minimum(size[later], size[p]) >= UNDER * np.maximum(size[later], size[p]))
        if i != j:
            open_to &= tile[later] != tile[p]
        if band:
            open_to &= ~(bands[later, :band] == bands[p, :band]).any(axis=1)
        at = np.flatnonzero(open_to) + p + 1
        if not len(at):
            continue
        mine = slice(starts[p], starts[p + 1])
        own[flat[mine]] = counts[mine]
        if len(at) * 8 > len(rep) - p:
            span = slice(starts[p + 1], None)
            low = np.add.reduceat(np.minimum(own[flat[span]], counts[span]), starts[p + 1 : -1] - starts[p + 1])[at - p - 1]
        else:
            low = np.array([np.minimum(own[flat[starts[q] : starts[q + 1]]], counts[starts[q] : starts[q + 1]]).sum() for q in at])
        own[flat[mine]] = 0
        for q in at[OVER * low >= UNDER * (size[at] + size[p] - low)]:
            if comp[q] != comp[p]:
                links.append((int(rep[p]), int(rep[q])))
                comp[comp == comp[q]] = comp[p]
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _texts(docs: DataFrame) -> DataFrame:
    """The documents with a number for each row, written once so that the numbers stay."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("r")).withColumn("row", F.monotonically_increasing_id())
    return kept(rows, "near-texts")


def near_groups(docs: DataFrame) -> DataFrame:
    """A row per row of `docs`: doc_id, class_id, class_size, kept; classes are joined by links of THRESHOLD or more."""
    return _grouped(_texts(docs.select("doc_id", "text"))).drop("row")


def _grouped(rows: DataFrame) -> DataFrame:
    texts = rows.select("row", F.col("r.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("r.text").cast("string"), F.lit("")).alias("text"))
    placed = kept(near_rows(texts), "classes")
    first = placed.groupBy("class").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("class_size"))
    return placed.join(first, "class").select(
        "row", "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one of each class."""
    rows = _texts(docs)
    return rows.join(_grouped(rows).filter("kept").select("row"), "row", "left_semi").select("r.*")
