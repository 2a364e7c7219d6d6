"""Exact deduplication by content-defined chunk recipes.

Each text is folded (A to Z lower-cased, nothing else) and cut where a rolling
gear hash of the last 32 bytes has its low bits zero, so equal stretches of long
texts cut alike. A text becomes a recipe: the ordered digests of its chunks.
Chunks of one digest are compared byte by byte and get verified identifiers
(digest and variant); a text's bytes therefore move at most once, in pieces of
bounded size and once per distinct chunk and task, and whole documents are only
compared as short lists of identifiers.

Defined cases: a null text is empty; an empty text has the empty recipe and all
empty texts are one group; a null doc_id sorts below every other; of rows
repeating one doc_id and text one row is kept; an empty table gives no rows;
further columns of the input, whatever their names, are neither read nor returned.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import fold, kept

MIN_CHUNK, MASK_BITS, MAX_CHUNK = 1024, 12, 16384
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

RECIPE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("raw_sha256", T.StringType()),
        T.StructField("text_sha256", T.StringType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("recipe", T.ArrayType(T.BinaryType())),
    ]
)


def gear_table() -> np.ndarray:
    """One 32-bit value for each byte value, from a fixed rule."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


def cuts(data: bytes, gear: np.ndarray, least: int = MIN_CHUNK, bits: int = MASK_BITS, most: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks of one text: content-defined, between `least` and `most` bytes but for the last."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    h = gear[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # the sum of 32 shifted gear values by doubling
        older = h[:-step] << np.uint32(step)
        h[step:] += older
    at = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    ends, start = [], 0
    while n - start > least:
        k = np.searchsorted(at, start + least)
        end = min(int(at[k]) if k < len(at) else n, start + most, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def _recipes(batches):
    gear = gear_table()
    for batch in batches:
        whole, size, lists = [], [], []
        for text in batch.column(2).to_pylist():
            data = text.translate(FOLD)
            start, recipe = 0, []
            for end in cuts(data, gear):
                recipe.append(hashlib.sha256(data[start:end]).digest())
                start = end
            whole.append(hashlib.sha256(data).hexdigest())
            size.append(len(data))
            lists.append(recipe)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(whole, pa.string()), pa.array(size, pa.int64()), pa.array(lists, pa.list_(pa.binary()))],
            names=["doc_id", "raw_sha256", "text_sha256", "n_bytes", "recipe"],
        )


def _chunks(batches):
    gear = gear_table()
    for batch in batches:
        digests, contents, seen = [], [], set()
        for text in batch.column(0).to_pylist():
            data = text.translate(FOLD)
            start = 0
            for end in cuts(data, gear):
                piece = data[start:end]
                start = end
                if piece not in seen:
                    seen.add(piece)
                    digests.append(hashlib.sha256(piece).digest())
                    contents.append(piece)
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(contents, pa.binary())], names=["digest", "content"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("raw_sha256"), text.cast("binary").alias("text"))


def recipes(docs: DataFrame) -> DataFrame:
    """A row per document: its id, the digests of its raw and its folded text, size and ordered chunk digests."""
    return _keyed(docs).mapInArrow(_recipes, RECIPE)


def clashing_chunks(docs: DataFrame) -> DataFrame:
    """Digests that more than one content bears: the check that makes digests identifiers.

    A digest whose smallest and largest content agree has one content, and is verified.
    """
    pieces = _keyed(docs).select("text").mapInArrow(_chunks, "digest binary, content binary")
    clashing = pieces.groupBy("digest").agg(F.min("content").alias("low"), F.max("content").alias("high")).filter("low <> high")
    return kept(clashing, "clashing-chunks")


def exact_groups(docs: DataFrame) -> DataFrame:
    """A row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, raw_sha256, n_bytes.

    The largest doc_id of each group of equal texts stays.
    """
    # The row number is written with the recipes: every later scan, in any split, sees the same one.
    listed = kept(recipes(docs).withColumn("row", F.monotonically_increasing_id()), "recipes")
    clashes = clashing_chunks(docs)
    if not clashes.isEmpty():
        listed = _with_variants(docs, listed, clashes)
    best = F.max(F.struct(F.col("doc_id").alias("doc"), F.col("row").alias("row")))
    # The recipe itself is the key of the count: lists are compared, not digests of lists.
    found = listed.groupBy("recipe").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    # The hash beside the recipe makes both sides of the join shuffles of their own, so a large group's partition can be split.
    many = found.filter("group_size > 1").select(F.col("recipe").alias("same"), "best", "group_size", F.xxhash64("recipe").alias("near"))
    out = listed.join(many, (F.xxhash64("recipe") == F.col("near")) & (F.col("recipe") == F.col("same")), "left")
    return out.select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("best.row"), F.lit(True)).alias("kept"),
        "text_sha256",
        "raw_sha256",
        "n_bytes",
    )


def _with_variants(docs: DataFrame, listed: DataFrame, clashes: DataFrame) -> DataFrame:
    """Where a digest stands for several contents, texts that hold it are told apart by their whole bytes' second digest.

    Reached only if two chunks collide; the affected recipes get the 512-bit digest of their text as a last entry.
    """
    hit = listed.select("row", F.explode("recipe").alias("digest")).join(clashes.select("digest"), "digest", "left_semi").select("row").distinct()
    more = _keyed(docs).select("raw_sha256", F.sha2(fold(F.col("text").cast("string")), 512).cast("binary").alias("more")).dropDuplicates(["raw_sha256"])
    marked = listed.join(hit.withColumn("hit", F.lit(True)), "row", "left").join(more, "raw_sha256", "left")
    told = F.when(F.col("hit"), F.concat("recipe", F.array("more"))).otherwise(F.col("recipe"))
    return marked.withColumn("recipe", told).select(*listed.columns)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one of each group of equal texts."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.col("raw_sha256")).alias("key")
    stay = exact_groups(docs).filter("kept").select(key)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    keyed = rows.select(
        F.concat_ws(":", F.coalesce(F.col("row.doc_id").cast("long").cast("string"), F.lit("none")),
                    F.sha2(F.coalesce(F.col("row.text").cast("string"), F.lit("")), 256)).alias("key"), "row")
    return keyed.join(stay, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
