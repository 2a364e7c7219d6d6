"""Removal of repeated passages: every byte covered by a LENGTH-byte string that starts earlier is cut.

Order is by document id and start. All suffixes of a corpus, each with its leading
LENGTH bytes, are some fifty times the corpus, so suffixes are sorted only where
they can matter, and the answer stays exact:

1. Anchors. A LENGTH-byte string holds LENGTH - SPAN + 1 runs of SPAN bytes; the
   one with the smallest hash (the first, if equal) is its anchor, so equal strings
   have equal anchors at equal offsets. An anchor stands for the strings, at
   consecutive starts, that chose it. Some three of a hundred bytes are anchors.
2. Within a batch of documents, an anchor all of whose strings (its stretch, known by
   a 128-bit digest) occurred earlier in the batch is covered, whatever else is
   there; only the first of each stretch goes on. That pre-aggregates hot passages.
3. Anchors meet by the hash of their run. Of equal stretches the earliest goes on,
   all others are covered. A run with one stretch is decided; runs at the edges of
   repeated passages have several.
4. Stretches that compete for a run are sorted as suffixes: sampled splitters
   range-partition them by their anchor's leading bytes, and each bucket expands its
   stretches to strings and sorts them by multikey sorting (eight bytes at a time,
   only among strings still tied). A splitter is a whole key, so equal keys never fall
   on two sides. Keys with more than STRINGS strings (at most MOST_HOT keys) are dealt
   out by the bytes of their strings and a salt instead, and sorted by Spark; a bucket
   keeps nothing but the row before. Strings at a bucket's edges may lie in several
   buckets, so their earliest is taken by an aggregate over all buckets.
5. Covered starts return to their documents as intervals, and texts are cut.

Limit: step 3 holds a run's different stretches, 50 bytes each after step 2, in one task
with the rest of its bucket. They aren't dealt out.

Digests are of 128 bits (two independent 64-bit hashes); the suffix sort compares bytes.

Defined cases: a null text is empty; texts under LENGTH bytes lose nothing; rows that
repeat a doc_id are ordered by an assigned row number; a null doc_id comes before
all others; an empty table gives no rows; further columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import kept

LENGTH, SPAN = 100, 32
SHIFT = 21
PIECE = 1 << SHIFT  # bytes of text that are searched at a time
BUCKET_BYTES = 16 << 20  # bytes of text behind one bucket of anchors
STRINGS = 60_000  # strings sorted at a time
MOST_HOT = 50_000  # anchors that are dealt out by their strings; their hashes go to all tasks

PACKED = "bucket long, settled boolean, runs binary, digests binary, ids binary, tags binary, starts binary, shapes binary"
DECIDED = "doc_id long, tag long, low long, high long, anchor long, covered boolean"
STRETCHES = "doc_id long, tag long, low long, high long, lead binary, body binary"
FIRST_ID = -(2**63)


class Rolling:
    """64-bit hashes of all stretches of a byte array, from prefix sums of weighted bytes modulo 2**64."""

    def __init__(self, most: int, seed: int):
        table = [int.from_bytes(hashlib.sha256(f"{seed},{b}".encode()).digest()[:8], "little") for b in range(257)]
        self.values = np.array(table[:256], np.uint64)
        base = table[256] | 1
        self.power = np.full(most + 1, base, np.uint64)
        self.back = np.full(most + 1, pow(base, -1, 2**64), np.uint64)
        self.power[0] = self.back[0] = 1
        np.cumprod(self.power, out=self.power)
        np.cumprod(self.back, out=self.back)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.power[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (sums[high] - sums[low]) * self.back[low]


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchors(data: np.ndarray, ends: np.ndarray, rolling: Rolling):
    """Stretches of the pieces that `data` holds side by side, up to `ends`: first and last start, anchor, run hash, digest."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = rolling.sums(data)
    n = len(data) - SPAN + 1
    keys = mix((sums[SPAN:] - sums[:n]) * rolling.back[:n])
    keys &= np.uint64(2**64 - (1 << SHIFT))
    keys |= np.arange(n, dtype=np.uint64)
    width, reach = LENGTH - SPAN + 1, 1
    least = keys
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: n - width + 1], least[width - reach :])
    place = (least & np.uint64((1 << SHIFT) - 1)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    opened = np.zeros(len(data) + 1, np.int32)
    long = ends - starts >= LENGTH
    np.add.at(opened, starts[long], 1)
    np.add.at(opened, ends[long] - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(opened[: len(place)]))
    if not len(at):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    mine = place[at]
    turn = np.flatnonzero((mine[1:] != mine[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    low, high, anchor = at[np.concatenate([[0], turn])], at[np.concatenate([turn - 1, [len(at) - 1]])], mine[np.concatenate([[0], turn])]
    run = mix(rolling.of(sums, anchor, anchor + SPAN))
    digest = mix(rolling.of(sums, low, high + LENGTH) + ((high - low) * 256 + (anchor - low)).astype(np.uint64))
    return low, high, anchor, run, digest


def first_of(keys: list[np.ndarray], order: list[np.ndarray]) -> np.ndarray:
    """True for the earliest record of each group of equal keys."""
    by = np.lexsort([*order[::-1], *keys[::-1]])
    new = np.ones(len(by), bool)
    new[1:] = np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)
    out = np.zeros(len(by), bool)
    out[by[new]] = True
    return out


def _pieces(batches):
    """(doc_id, tag, offset, bytes) of at most PIECE bytes; pieces of one text overlap by LENGTH - 1."""
    for batch in batches:
        ids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for k, text in enumerate(batch.column(2)):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            for low in range(0, max(1, len(data) - LENGTH + 1), PIECE - LENGTH + 1):
                yield ids[k], tags[k], low, data[low : low + PIECE]


def _groups(batches):
    held, size = [], 0
    for piece in _pieces(batches):
        if held and size + len(piece[3]) > PIECE:
            yield held
            held, size = [], 0
        held.append(piece)
        size += len(piece[3])
    if held:
        yield held


def _blob(rows, bucket, settled, run, digest, ids, tags, start, shape):
    rows.append((int(bucket), settled, run.tobytes(), digest.tobytes(), ids.tobytes(), tags.tobytes(), start.tobytes(), shape.tobytes()))


def _anchored(buckets: int):
    def make(batches):
        rolling = Rolling(PIECE, 7)
        for group in _groups(batches):
            ends = np.cumsum([len(p[3]) for p in group])
            low, high, anchor, run, digest = anchors(np.concatenate([p[3] for p in group]), ends, rolling)
            if not len(low):
                continue
            owner = np.searchsorted(ends, low, "right")
            ids, tags = (np.array([p[k] for p in group], np.int64)[owner] for k in (0, 1))
            start = low + np.array([p[2] for p in group], np.int64)[owner] - np.concatenate([[0], ends[:-1]])[owner]
            shape = np.stack([high - low, anchor - low], axis=1).astype(np.uint8)
            first = first_of([run, digest], [ids, tags, start])
            rows, to = [], (run % np.uint64(buckets)).astype(np.int64)
            sent = np.flatnonzero(first)
            sent = sent[np.lexsort((start[sent], ids[sent], to[sent]))]
            for part in np.split(sent, np.flatnonzero(np.diff(to[sent])) + 1):
                _blob(rows, to[part[0]], False, run[part], digest[part], ids[part], tags[part], start[part], shape[part])
            part = np.flatnonzero(~first)
            if len(part):
                none = np.zeros(0, np.uint64)
                _blob(rows, to[part[0]], True, none, none, ids[part], tags[part], start[part], shape[part])
            kinds = (pa.int64(), pa.bool_(), *[pa.binary()] * 6)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=["bucket", "settled", "runs", "digests", "ids", "tags", "starts", "shapes"],
            )

    return make


def _decided(ids, tags, start, shape, covered):
    low = start
    return pa.table(
        {"doc_id": pa.array(ids, pa.int64()), "tag": pa.array(tags, pa.int64()), "low": pa.array(low, pa.int64()),
         "high": pa.array(low + shape[:, 0], pa.int64()), "anchor": pa.array(low + shape[:, 1], pa.int64()), "covered": pa.array(covered, pa.bool_())}
    )


def _decide(table: pa.Table) -> pa.Table:
    """One bucket: what a later equal stretch covers, and the first of each stretch where a run has several."""
    out = []
    done, open_rows = table.filter(table["settled"]), table.filter(pa.compute.invert(table["settled"]))

    def column(rows, name, kind):
        return np.frombuffer(b"".join(rows[name].to_pylist()), kind)

    for rows in (done, open_rows):
        ids, tags, start = (column(rows, n, np.int64) for n in ("ids", "tags", "starts"))
        shape = column(rows, "shapes", np.uint8).reshape(-1, 2)
        if rows is done:
            out.append(_decided(ids, tags, start, shape, np.ones(len(ids), bool)))
            continue
        run, digest = column(rows, "runs", np.uint64), column(rows, "digests", np.uint64)
        by = np.argsort(run, kind="stable")
        again = run[by][1:] == run[by][:-1]
        twice = by[np.concatenate([again, [False]]) | np.concatenate([[False], again])] if len(by) else by
        run, digest, ids, tags, start, shape = (x[twice] for x in (run, digest, ids, tags, start, shape))
        first = first_of([run, digest], [ids, tags, start])
        _, group, stretches = np.unique(run[first], return_inverse=True, return_counts=True)
        contested = np.zeros(len(run), bool)
        contested[np.flatnonzero(first)] = stretches[group] > 1
        told = contested | ~first
        out.append(_decided(ids[told], tags[told], start[told], shape[told], ~first[told]))
    return pa.concat_tables(out)


def _cut_stretches(batches):
    """The bytes of contested stretches, with their anchor's run."""
    for batch in batches:
        rows = []
        for row_id, tag, text, stretches in zip(*(batch.column(k) for k in range(4)), strict=True):
            data = text.as_buffer()
            for one in stretches.as_py():
                low, high, anchor = one["low"], one["high"], one["anchor"]
                rows.append((row_id.as_py(), tag.as_py(), low, high, bytes(data[anchor : anchor + SPAN]), bytes(data[low : high + LENGTH])))
        if rows:
            kinds = (*[pa.int64()] * 4, pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "tag", "low", "high", "lead", "body"]
            )


def multikey_groups(strings: np.ndarray) -> np.ndarray:
    """A number for each row of a byte matrix, equal for equal rows: sorted eight bytes at a time, only rows still tied go on."""
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    words = padded.view(">u8")
    group = np.zeros(n, np.int64)
    tied = np.arange(n)
    for k in range(words.shape[1]):
        word = words[tied, k].astype(np.uint64)
        by = np.lexsort((word, group[tied]))
        tied, word = tied[by], word[by]
        before = group[tied]
        block = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        same = np.concatenate([[False], (before[1:] == before[:-1]) & (word[1:] == word[:-1])])
        heads = np.flatnonzero(~same)
        sizes = np.diff(np.append(heads, len(tied)))
        # A group is named by its first member's place in the order so far, which later words only refine.
        first = np.repeat(block, np.diff(np.append(block, len(tied))))
        group[tied] = before + np.repeat(heads - first[heads], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        if not len(tied):
            break
    return group


def covered_strings(ids, tags, lows, highs, bodies):
    """Intervals of starts whose string occurs earlier among the stretches given: index of the stretch, first and last start."""
    sizes = np.array([h - a + 1 for a, h in zip(lows, highs, strict=True)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    flat = np.frombuffer(b"".join(bodies), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(b) for b in bodies])[:-1]])
    step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    strings = np.lib.stride_tricks.sliding_window_view(flat, LENGTH)[base[owner] + step]
    start = np.asarray(lows)[owner] + step
    later = ~first_of([multikey_groups(strings)], [np.asarray(ids)[owner], np.asarray(tags)[owner], start])
    at = np.flatnonzero(later)
    if not len(at):
        return at, at, at
    turn = np.flatnonzero((owner[at][1:] != owner[at][:-1]) | (at[1:] != at[:-1] + 1)) + 1
    heads, tails = at[np.concatenate([[0], turn])], at[np.concatenate([turn - 1, [len(at) - 1]])]
    return owner[heads], start[heads], start[tails]


def _contest(batches):
    held, lead, strings = [], None, 0

    def settle():
        ids, tags, lows, highs, bodies = zip(*held, strict=True)
        who, first, last = covered_strings(ids, tags, lows, highs, bodies)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(ids)[who], pa.int64()), pa.array(np.array(tags)[who], pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())],
            names=["doc_id", "tag", "low", "high"],
        )

    for batch in batches:
        for row_id, tag, low, high, key, body in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if strings >= STRINGS and key != lead:
                yield settle()
                held, strings = [], 0
            held.append((row_id, tag, low, high, body))
            strings += high - low + 1
            lead = key
    if held:
        yield settle()


def _strings(batches):
    """A row for each string of some stretches."""
    for batch in batches:
        rows = []
        for row_id, tag, low, high, body in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            rows.extend((row_id, tag, low + k, body[k : k + LENGTH]) for k in range(high - low + 1))
            if len(rows) >= 10_000:
                yield _string_rows(rows)
                rows = []
        if rows:
            yield _string_rows(rows)


def _string_rows(rows):
    kinds = (*[pa.int64()] * 3, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "tag", "low", "string"])


def _repeated(batches):
    """Of sorted strings: what an equal one in the bucket precedes; with their bytes, the first of the bucket's first and last string."""
    head = last = None

    def told(rows):
        kinds = (*[pa.int64()] * 4, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "tag", "low", "high", "edge"])

    for batch in batches:
        rows = []
        for row_id, tag, low, string in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if last and last[4] == string:
                rows.append((row_id, tag, low, low, None))
            else:
                last = (row_id, tag, low, low, string)
                head = head or last
        if rows:
            yield told(rows)
    if last:
        yield told([head] if head is last else [head, last])


def covered_hot(bodies: DataFrame, strings: int) -> DataFrame:
    """Covered starts of stretches whose anchors have too many strings for one task."""
    each = bodies.select("doc_id", "tag", "low", "high", "body").mapInArrow(_strings, "doc_id long, tag long, low long, string binary")
    dealt = each.repartitionByRange(max(2, -(-strings // STRINGS)), F.col("string"), F.xxhash64("doc_id", "tag", "low"))
    ordered = dealt.sortWithinPartitions("string", "doc_id", "tag", "low")
    found = kept(ordered.mapInArrow(_repeated, "doc_id long, tag long, low long, high long, edge binary"), "hot-strings")
    edges = found.filter("edge IS NOT NULL")
    first = edges.groupBy("edge").agg(F.min(F.struct("doc_id", "tag", "low")).alias("first"))
    later = edges.join(first, "edge").filter(F.struct("doc_id", "tag", "low") != F.col("first"))
    names = ["doc_id", "tag", "low", "high"]
    return found.filter("edge IS NULL").select(*names).unionByName(later.select(*names))


def spans(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes under strings that start in the given intervals."""
    out: list[list[int]] = []
    for low, high in sorted(intervals):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high + LENGTH)
        else:
            out.append([low, high + LENGTH])
    return [(a, b) for a, b in out]


def _cut(batches):
    for batch in batches:
        rows = []
        for row_id, text, covered in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            gone = spans([(x["low"], x["high"]) for x in covered or ()])
            left, end = [], 0
            for low, high in gone:
                left.append(text[end:low])
                end = high
            left.append(text[end:])
            rest = b"".join(left)
            rows.append((row_id, len(text), len(text) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), [{"low": a, "high": b} for a, b in gone], rest))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=CUT_NAMES)


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<low:long,high:long>>, kept binary"
CUT_NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"]


def cut_repeats(docs: DataFrame) -> DataFrame:
    """A row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (byte spans), kept (bytes)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    figures = given.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    most, total = figures.agg(F.max("n"), F.sum("bytes")).first()
    # Ids that repeat need more than the id to find their text again.
    tag = F.lit(0).cast("long") if (most or 0) <= 1 else F.xxhash64("text")
    named = F.coalesce("doc_id", F.lit(FIRST_ID).cast("long"))
    rows = given.select(named.alias("doc_id"), tag.alias("tag"), F.col("text").cast("binary").alias("text"), F.col("doc_id").isNull().alias("unnamed"))
    once = rows.select("doc_id", "tag", "text") if (most or 0) <= 1 else rows.select("doc_id", "tag", "text").dropDuplicates(["doc_id", "tag"])
    buckets = max(16, -(-(total or 0) // BUCKET_BYTES))
    packed = once.mapInArrow(_anchored(buckets), PACKED)
    decided = kept(packed.groupBy("bucket").applyInArrow(_decide, DECIDED), "anchors")
    key = ["doc_id", "tag"]
    stretch = F.collect_list(F.struct("low", "high", "anchor")).alias("stretches")
    contested = decided.filter("NOT covered").groupBy(*key).agg(stretch)
    bodies = rows.select(*key, "text").join(contested, key).select(*key, "text", "stretches").mapInArrow(_cut_stretches, STRETCHES)
    if (most or 0) > 1:
        bodies = bodies.dropDuplicates(["doc_id", "tag", "low", "high"])
    bodies = kept(bodies, "stretches")
    sizes = bodies.groupBy(F.xxhash64("lead").alias("hot")).agg(F.sum(F.col("high") - F.col("low") + 1).alias("strings"), F.count(F.lit(1)).alias("n"))
    sizes = kept(sizes, "anchor-sizes")
    rows_of, strings = (x or 0 for x in sizes.agg(F.sum("n"), F.sum("strings")).first())
    hot = sizes.filter(F.col("strings") > max(STRINGS, strings // MOST_HOT))
    hot_strings = hot.agg(F.sum("strings")).first()[0] or 0
    is_hot = F.xxhash64("lead") == F.col("hot")
    cold = bodies.join(F.broadcast(hot.select("hot")), is_hot, "left_anti") if hot_strings else bodies
    parts = max(1, -(-rows_of // 20_000))
    by_lead = cold.repartitionByRange(parts, "lead").sortWithinPartitions("lead")
    settled = by_lead.mapInArrow(_contest, "doc_id long, tag long, low long, high long")
    covered = decided.filter("covered").select(*key, "low", "high").unionByName(settled)
    if hot_strings:
        covered = covered.unionByName(covered_hot(bodies.join(F.broadcast(hot.select("hot")), is_hot, "left_semi"), hot_strings))
    lists = covered.groupBy(*key).agg(F.collect_list(F.struct("low", "high")).alias("covered"))
    joined = rows.join(lists, key, "left").select(F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id"), "text", "covered")
    return joined.mapInArrow(_cut, CUT)
