"""Exact top-k search by tiled integer matrix products.

Vectors are quantised to floor(256 * x). Rows are packed into blocks of at most
BLOCK vectors, and queries into tiles of at most TILE; each tile meets each block
once in an equi-join on the block's number, a task multiplies the two matrices,
and only the k best of each query and block leave it. Partial lists are merged in
a tree of FAN lists at a time, so no task gathers all lists of a query.

Products run in float64 where every sum is below 2**53 and so exact, else in
64-bit integers, which wrap like Spark's. Quantised values saturate at 64 bits.

Defined cases: rows with a null id, a null vector, or null or non-finite
components take no part; so do empty vectors. Of rows repeating an id the one
with the smallest vector counts. Vectors of different length are never compared.
Ties go to the smaller id. A query with fewer than k others gets them all. An
empty table gives no rows; further columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import kept

SCALE, BLOCK, TILE, FAN = 256, 8192, 512, 16
PACKED = "width int, kind string, ids binary, cells binary"
FOUND = "query_id long, vec_id long, score long, block long"


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and the floored components of the rows that take part."""
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).filter(
        F.col("vec_id").isNotNull() & (F.size("x") > 0)
        & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    one = clean.groupBy("vec_id").agg(F.min("x").alias("x"))
    return one.select("vec_id", F.transform("x", lambda c: F.floor(F.lit(float(SCALE)) * c).cast("long")).alias("q"))


def _packer(rows: int):
    def pack(batches):
        held: dict[int, list] = {}
        for batch in batches:
            ids, vectors = batch.column(0).to_pylist(), batch.column(1)
            flat = vectors.flatten().to_numpy()
            ends = np.cumsum(vectors.value_lengths().to_numpy())
            for name, end, width in zip(ids, ends, np.diff(ends, prepend=0), strict=True):
                held.setdefault(int(width), []).append((name, flat[end - width : end]))
                if len(held[int(width)]) == rows:
                    yield _packed(int(width), held.pop(int(width)))
        for width in sorted(held):
            yield _packed(width, held[width])

    return pack


def _packed(width, rows):
    rows.sort(key=lambda row: row[0])
    ids, cells = np.array([row[0] for row in rows], np.int64), np.concatenate([row[1] for row in rows]).astype(np.int64)
    narrow = np.result_type(np.min_scalar_type(cells.min()), np.min_scalar_type(cells.max()), np.int8)
    return pa.RecordBatch.from_arrays(
        [pa.array([width], pa.int32()), pa.array([narrow.str]), pa.array([ids.tobytes()], pa.binary()), pa.array([cells.astype(narrow).tobytes()], pa.binary())],
        names=["width", "kind", "ids", "cells"],
    )


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All inner products as int64."""
    most = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(rows.astype(np.float64)).max(initial=0)) * queries.shape[1]
    if most < 2**53:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return queries @ rows.T


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
    """Per query the columns of its k best: highest score, then smallest id; a query's own column is left out.

    ids ascend. Partial selection finds the k-th score; only columns that reach it are sorted.
    """
    out = []
    for line, self_id in zip(scores, own, strict=True):
        at = np.searchsorted(ids, self_id)
        if at < len(ids) and ids[at] == self_id:
            open_to = np.delete(np.arange(len(ids)), at)
        else:
            open_to = np.arange(len(ids))
        values = line[open_to]
        if len(values) > k:
            reach = np.partition(values, len(values) - k)[len(values) - k]
            chosen = np.flatnonzero(values >= reach)
        else:
            chosen = np.arange(len(values))
        order = np.lexsort((ids[open_to[chosen]], ~values[chosen]))
        out.append(open_to[chosen[order[:k]]])
    return out


def _searcher(k: int):
    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                width = row["width"]
                names, ids = np.frombuffer(row["tile_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                tile = np.frombuffer(row["tile_cells"], row["tile_kind"]).astype(np.int64).reshape(-1, width)
                block = np.frombuffer(row["cells"], row["kind"]).astype(np.int64).reshape(-1, width)
                scores = products(tile, block)
                chosen = best(scores, ids, names, k)
                size = [len(c) for c in chosen]
                at = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
                line = np.repeat(np.arange(len(names)), size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(names, size)), pa.array(ids[at]), pa.array(scores[line, at]), pa.array(np.full(len(at), row["block"], np.int64))],
                    names=["query_id", "vec_id", "score", "block"],
                )

    return search


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with other rows of `vectors`.

    Both frames have vec_id and embedding.
    """
    blocks = quantised(vectors).mapInArrow(_packer(BLOCK), PACKED)
    blocks = kept(blocks.withColumn("block", F.monotonically_increasing_id()), "topk-blocks")
    tiles = quantised(queries).mapInArrow(_packer(TILE), PACKED).withColumnsRenamed({"kind": "tile_kind", "ids": "tile_ids", "cells": "tile_cells"})
    listed = blocks.select("width", "block").groupBy("width").agg(F.collect_list("block").alias("all"))
    meets = tiles.join(listed, "width").select("tile_kind", "tile_ids", "tile_cells", F.explode("all").alias("block"))
    found = meets.join(blocks, "block").select("width", "block", "tile_kind", "tile_ids", "tile_cells", "kind", "ids", "cells").mapInArrow(_searcher(k), FOUND)
    return merged(found, blocks.count(), k)


def merged(found: DataFrame, blocks: int, k: int) -> DataFrame:
    """Partial lists merged level by level, FAN lists to one."""
    order = F.struct(F.bitwise_not("score").alias("less"), F.col("vec_id").alias("vec_id"), F.col("score").alias("score"))
    # Blocks are numbered by task and place, so a dense spread over the tree's leaves comes from a hash.
    leaves = max(1, -(-blocks // FAN))
    level = found.withColumn("node", F.pmod(F.xxhash64("block"), F.lit(leaves)))
    while True:
        lists = level.groupBy("query_id", "node").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("best"))
        if leaves == 1:
            return lists.select("query_id", F.posexplode("best").alias("place", "hit")).select(
                "query_id", (F.col("place") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
            )
        leaves = -(-leaves // FAN)
        level = lists.select("query_id", F.pmod(F.col("node"), F.lit(leaves)).alias("node"), F.inline("best"))
