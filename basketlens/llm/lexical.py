"""Ranked lexical search in K2-treaps over blocks of documents.

A block is a grid of its words (rows, the most frequent first) and its documents
(columns, by id); a cell holds the impact of a word in a document. The grid is cut
in four again and again; every quarter that isn't empty stores the highest impact
inside it, as its difference from the quarter around it, and one bit per quarter
says which of its own are empty. An item's words are rows: their paths go down the
tree together, one range of documents at a time. Words' weights times the maxima
along the paths bound what any document of a range can score, so the ranges of
highest bound are opened first and a range that can't reach the list is never
opened. Single documents have their exact score.

Steps: (1) one scan counts documents, words and document frequencies, added up
inside tasks before the shuffle; (2) a second scan builds the blocks where the
documents lie, at most CELLS cells or DOCS documents each, and deals them out,
each packed to one value that only its search opens; (3) items get their words'
weights by joins and are dealt into tiles; (4) tiles meet blocks, every block its
own key, and only the k best of each leave a task; (5) partial lists are merged in
a tree.

    impact = (1000000000 * tf) div (1000 * tf + 8 * m),  m = 10 + (90 * n * N) div L
    weight = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))

Defined cases: null and empty texts have no words, count in nothing and are never
found. Documents without an id count and can be found, behind others of equal
score. Rows that repeat an id are documents of their own. Items without an id or
without words get no rows; of items that repeat an id the one with the smallest
text counts. Fewer than k documents with a score above 0: all of them. Equal
scores go to the smaller id. Empty tables give no rows; further columns are
ignored. A document of any length is one column.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import kept

CELLS, DOCS, TILE, FRONT, FAN = 1 << 19, 8192, 256, 64, 16
#: Tasks that write the frequencies, at least: on a local disk an executor starts processes for each file (chmod).
WRITERS = 64
#: Keys that one row of a tile is repeated for at a time.
SPAN = 64
FLUSH = 300_000
#: Letters A to Z become lower-case; ASCII characters that are no letter or digit part terms, all others belong to them.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
#: Stands for a missing id: the last of all.
NO_ID = np.iinfo(np.int64).max


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(PLAIN).split() if text else []


# ---- The tree ---------------------------------------------------------------------


def build_tree(rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray) -> dict:
    """Levels from the whole grid down to its cells, one after another.

    `masks` has four bits a node above the cells (bit 2 * lower half + right half);
    `drops` is each node's distance below the maximum of the node around it.
    """
    height = max(1, int(max(rows.max(), columns.max())).bit_length())
    code = np.zeros(len(rows), np.int64)
    for bit in range(height):
        code |= ((columns >> bit) & 1) << (2 * bit) | ((rows >> bit) & 1) << (2 * bit + 1)
    order = np.argsort(code)
    code, best = code[order], impacts[order].astype(np.int64)
    masks, drops, nodes = [], [], 0
    for _ in range(height):
        up = code >> 2
        first = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
        top = np.maximum.reduceat(best, first)
        masks.append(np.bitwise_or.reduceat((1 << (code & 3)).astype(np.uint8), first))
        drops.append(np.repeat(top, np.diff(first, append=len(code))) - best)
        code, best, nodes = up[first], top, nodes + len(first)
    masks, drops = np.concatenate(masks[::-1]), np.concatenate([np.zeros(1, np.int64), *drops[::-1]])
    if len(masks) % 2:
        masks = np.append(masks, np.uint8(0))
    kind = np.min_scalar_type(int(drops.max()))
    return {
        "height": height, "top": int(best[0]), "nodes": nodes,
        "masks": (masks[::2] | masks[1::2] << 4).tobytes(), "kind": kind.str, "drops": drops.astype(kind).tobytes(),
    }


class Tree:
    """A tree opened for search: per node its maximum, and where its quarters begin."""

    def __init__(self, stored: dict):
        packed = np.frombuffer(stored["masks"], np.uint8)
        masks = np.empty(2 * len(packed), np.uint8)
        masks[::2], masks[1::2] = packed & 15, packed >> 4
        self.masks, self.height = masks[: stored["nodes"]], stored["height"]
        drops = np.frombuffer(stored["drops"], np.dtype(stored["kind"]))
        size = np.bitwise_count(self.masks)
        # Nodes are stored level by level, so a node's quarters begin behind all quarters of the nodes before it.
        self.first = np.cumsum(size, dtype=np.int32) - size + 1
        self.most = np.empty(len(drops), np.int32)
        self.most[0] = stored["top"]
        start, end = 0, 1
        for _ in range(self.height):
            below = int(self.first[start]), int(self.first[end - 1]) + int(size[end - 1])
            self.most[below[0] : below[1]] = np.repeat(self.most[start:end], size[start:end]) - drops[below[0] : below[1]]
            start, end = below

    def quarter(self, nodes: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The named quarter of each node, or -1 where it is empty or the node is -1 itself."""
        mask = np.where(nodes >= 0, self.masks[nodes], 0).astype(np.int64)
        inside = (mask >> which) & 1
        before = np.bitwise_count((mask & ((1 << which) - 1)).astype(np.uint8))
        return np.where(inside == 1, self.first[nodes] + before, -1)


def search_tree(tree: Tree, rows: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and scores of the k best columns, best first, ties to the smaller column; scores are above 0.

    The FRONT open ranges of highest bound are halved at a time, and ranges that
    the k-th best column so far beats are let go.
    """
    bound = np.array([int(weights.sum()) * int(tree.most[0])], np.int64)
    level, column, nodes = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int64)
    found_score, found_column = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while len(bound):
        if len(bound) > FRONT:
            chosen = np.argpartition(-bound, FRONT)[:FRONT]
            rest = np.ones(len(bound), bool)
            rest[chosen] = False
        else:
            chosen, rest = np.arange(len(bound)), np.zeros(len(bound), bool)
        down = tree.height - 1 - level[chosen]
        half = (rows[None, :] >> down[:, None]) & 1
        own = nodes[chosen]
        parts = [tree.quarter(own, 2 * half + side) for side in (0, 1)]
        new_nodes = np.concatenate(parts)
        new_bound = np.where(new_nodes >= 0, tree.most[new_nodes], 0) @ weights
        new_level = np.tile(level[chosen] + 1, 2)
        new_column = np.concatenate([column[chosen], column[chosen] + (np.int64(1) << down)])
        done = new_level == tree.height
        hit = done & (new_bound > 0)
        found_score = np.concatenate([found_score, new_bound[hit]])
        found_column = np.concatenate([found_column, new_column[hit]])
        order = np.lexsort((found_column, -found_score))[:k]
        found_score, found_column = found_score[order], found_column[order]
        go = ~done & (new_bound > 0)
        bound = np.concatenate([bound[rest], new_bound[go]])
        level, column = np.concatenate([level[rest], new_level[go]]), np.concatenate([column[rest], new_column[go]])
        nodes = np.concatenate([nodes[rest], new_nodes[go]])
        if len(found_score) == k:
            open_to = (bound > found_score[-1]) | ((bound == found_score[-1]) & (column < found_column[-1]))
            bound, level, column, nodes = bound[open_to], level[open_to], column[open_to], nodes[open_to]
    return found_column, found_score


# ---- Counting and indexing --------------------------------------------------------

COUNTED = "term binary, df long, words long, blocks long"


def _count(batches):
    """Document frequencies of a task's words, and one row without a word for its documents, all their words and about how many blocks they make."""
    seen: Counter = Counter()
    docs = words = cells = 0
    for batch in batches:
        for text in batch.column(0):
            terms = terms_of(text.as_py())
            if terms:
                own = set(terms)
                docs, words, cells = docs + 1, words + len(terms), cells + len(own)
                seen.update(own)
        if len(seen) > FLUSH:
            yield _counted(seen, 0, 0, 0)
            seen = Counter()
    yield _counted(seen, docs, words, max(cells // CELLS, docs // DOCS) + 1 if docs else 0)


def _counted(seen: Counter, docs: int, words: int, blocks: int):
    rest = [None] * len(seen)
    return pa.RecordBatch.from_arrays(
        [pa.array([None, *seen], pa.binary()), *(pa.array(part, pa.int64()) for part in ([docs, *seen.values()], [words, *rest], [blocks, *rest]))],
        names=["term", "df", "words", "blocks"],
    )


BLOCK = "packed binary"


def _indexer(total_docs: int, total_words: int):
    def block(docs: list, number: dict):
        docs.sort(key=lambda doc: doc[0])
        rows, tf = (np.concatenate([doc[part] for doc in docs]) for part in (1, 2))
        # The most frequent words are the first rows, so that full quarters of the grid lie together.
        often = np.argsort(-np.bincount(rows), kind="stable")
        place = np.empty_like(often)
        place[often] = np.arange(len(often))
        words = list(number)
        sizes = np.array([len(doc[1]) for doc in docs], np.int64)
        m = np.repeat(np.array([10 + 90 * doc[3] * total_docs // total_words for doc in docs], np.int64), sizes)
        impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
        stored = build_tree(place[rows], np.repeat(np.arange(len(docs)), sizes), impacts)
        stored |= {"ids": np.array([doc[0] for doc in docs], np.int64).tobytes(), "vocabulary": b" ".join([words[n] for n in often])}
        return pa.RecordBatch.from_arrays([pa.array([packed(stored)], pa.binary())], names=["packed"])

    def index(batches):
        held, number, cells = [], {}, 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                terms = terms_of(text.as_py())
                if not terms:
                    continue
                counts = Counter(terms)
                if held and (cells + len(counts) > CELLS or len(held) >= DOCS):
                    yield block(held, number)
                    held, number, cells = [], {}, 0
                rows = np.fromiter((number.setdefault(term, len(number)) for term in counts), np.int64, len(counts))
                held.append((NO_ID if name is None else name, rows, np.fromiter(counts.values(), np.int64, len(counts)), len(terms)))
                cells += len(counts)
        if held:
            yield block(held, number)

    return index


_BLOCK = pa.schema([
    ("ids", pa.binary()), ("vocabulary", pa.binary()), ("height", pa.int32()), ("top", pa.int64()),
    ("nodes", pa.int64()), ("masks", pa.binary()), ("kind", pa.string()), ("drops", pa.binary()),
])


def packed(stored: dict) -> bytes:
    """A block as one compressed value, a quarter of its size: so it is sent and sorted."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _BLOCK, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as out:
        out.write_batch(pa.RecordBatch.from_pylist([stored], schema=_BLOCK))
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> dict:
    return pa.ipc.open_stream(blob, options=pa.ipc.IpcReadOptions(use_threads=False)).read_next_batch().to_pylist()[0]


def _few(frame: DataFrame) -> int:
    """Tasks enough to be shared by all cores, however large the tables are."""
    return max(WRITERS, 4 * frame.sparkSession.sparkContext.defaultParallelism)


class Index:
    """Blocks of documents, document frequencies, and the totals.

    `blocks` has a number per block; a search builds them and sends them on, so they
    are written once, by its shuffle. `docs` has to come in the same order if a task
    runs again, as it does from files. `size` is about how many blocks there are: it
    says how they are dealt out, and results don't hang on it.
    """

    def __init__(self, docs: DataFrame):
        bytes_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        counted = bytes_of.select("text").mapInArrow(_count, COUNTED)
        summed = counted.groupBy("term").agg(*(F.sum(name).alias(name) for name in ("df", "words", "blocks")))
        self.frequencies = kept(summed.coalesce(_few(docs)), "lexical-df")
        total = self.frequencies.filter("term IS NULL").first()
        self.docs, self.words, self.size = (total.df, total.words, total.blocks) if total else (0, 0, 0)
        blocks = bytes_of.mapInArrow(_indexer(self.docs, self.words), BLOCK)
        self.blocks = blocks.withColumn("block", F.monotonically_increasing_id())


# ---- Search -----------------------------------------------------------------------


def _terms(batches):
    for batch in batches:
        items, terms = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = set(terms_of(text))
            items += [item] * len(own)
            terms += own
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(terms, pa.binary())], names=["item_id", "term"])


FOUND = "item_id long, doc_id long, score long, block long"


def _searcher(k: int):
    def search(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                stored = unpacked(row["packed"])
                ids, tree = np.frombuffer(stored["ids"], np.int64), Tree(stored)
                asked = {word["term"] for item in row["items"] for word in item["words"]}
                number = {term: n for n, term in enumerate(stored["vocabulary"].split(b" ")) if term in asked}
                out = [[], [], []]
                for item in row["items"]:
                    here = [(number[word["term"]], word["weight"]) for word in item["words"] if word["term"] in number]
                    if not here:
                        continue
                    rows, weights = (np.array(part, np.int64) for part in zip(*here, strict=True))
                    columns, scores = search_tree(tree, rows, weights, k)
                    out[0] += [item["item_id"]] * len(columns)
                    out[1] += ids[columns].tolist()
                    out[2] += scores.tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int64()) for part in (*out, [row["block"]] * len(out[0]))], names=["item_id", "doc_id", "score", "block"]
                )

    return search


def weighted_items(index: Index, items: DataFrame) -> DataFrame:
    """item_id and words, an array of term and weight, of the items whose words occur."""
    one = items.filter(F.col("item_id").isNotNull()).groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    asked = one.select("item_id", F.col("text").cast("binary").alias("text")).mapInArrow(_terms, "item_id long, term binary")
    ratio = F.lit(2.0 * index.docs + 2) / (2.0 * F.col("df") + 1)
    weight = F.floor(1000 * F.log(ratio)).cast("long")
    known = index.frequencies.filter("term IS NOT NULL").select("term", weight.alias("weight")).filter("weight > 0")
    # The words of all documents are never the side that is sent to all tasks.
    return asked.join(known.hint("merge"), "term").groupBy("item_id").agg(F.collect_list(F.struct("term", "weight")).alias("words"))


def top_k(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item. `items` has item_id and text."""
    asked = kept(weighted_items(index, items), "lexical-items")
    tiles = -(-asked.count() // TILE)
    dealt = asked.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(max(1, tiles))).alias("tile")).agg(
        F.collect_list(F.struct("item_id", "words")).alias("items")
    )
    # Blocks are numbered by task and place, a hash makes dense keys of that: each tile goes to each key once.
    spread = max(1, index.size)
    key = F.pmod(F.xxhash64("block"), F.lit(spread)).alias("key")
    # A tile is repeated for a few spans of keys first and those are dealt out, so no task repeats it for all blocks.
    spans = dealt.select("tile", "items", F.explode(F.expr(f"sequence(0L, {spread - 1}L, {SPAN}L)")).alias("low"))
    spans = spans.repartition(min(max(1, tiles) * -(-spread // SPAN), _few(items)), "tile", "low")
    meets = spans.select("items", F.explode(F.expr(f"sequence(low, least(low + {SPAN - 1}L, {spread - 1}L))")).alias("key"))
    # Tiles repeated for all keys are never sent to all tasks.
    found = index.blocks.select("*", key).join(meets.hint("merge"), "key").drop("key").mapInArrow(_searcher(k), FOUND)
    return merged(found, spread, k)


def merged(found: DataFrame, blocks: int, k: int) -> DataFrame:
    """Partial lists merged level by level, FAN lists to one."""
    order = F.struct(F.bitwise_not("score").alias("less"), F.col("doc_id").alias("doc_id"), F.col("score").alias("score"))
    leaves = max(1, -(-blocks // FAN))
    level = found.withColumn("node", F.pmod(F.xxhash64("block"), F.lit(leaves)))
    while True:
        lists = level.groupBy("item_id", "node").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("best"))
        if leaves == 1:
            hit = F.posexplode("best").alias("place", "hit")
            return lists.select("item_id", hit).select(
                "item_id", (F.col("place") + 1).alias("rank"),
                F.nullif(F.col("hit.doc_id"), F.lit(int(NO_ID))).alias("doc_id"), F.col("hit.score").alias("score"),
            )
        leaves = -(-leaves // FAN)
        level = lists.select("item_id", F.pmod(F.col("node"), F.lit(leaves)).alias("node"), F.inline("best"))
