"""Language model scores: a gated recurrent network with class-factored output, in numpy inside Spark tasks.

Data flow. Documents are packed, in the order they are read, into blocks of about
BLOCK_BYTES of text, split once and written as the hashes of the block's words and a
number for each token. The hashes of a block's distinct words with their training
counts climb a tree: some FAN blocks share a node, some FAN nodes the node
above, and each node adds its children up in buckets of the hash space, whose number
grows with the text below it. Global counts come down the same tree, so each block
gets those of just its own words. So no task and no broadcast ever holds the whole
vocabulary, a word in every document costs one entry a child wherever it is added up,
and each level has as many rows as any other. The TOP most frequent words alone (a
fixed number) come to the driver and make the network's vocabulary.

Network. Input: the previous word, as one of TOP words or as the class of a rarer one;
a gated recurrent unit of HIDDEN cells, whose state is carried across windows of WINDOW
tokens and reset at a document's start, so a text's likelihood is that of its whole.
Output: a softmax over classes of about equal frequency, then a softmax over the words
of the class. Rarer words form classes by the size of their count; inside those a word's
probability is its share of the class's count. Words seen once share a class with the
unseen word, which is one event, as in the base score. All terms are probabilities,
so scores of all texts over known words and the unseen one sum to one.

Training is truncated backpropagation by Adam on lanes of documents side by side. All
training documents pass through the network with their state; gradients are taken on
every window (STRIDE is 1), so every training token teaches the network and no
document is left out. Blocks are split among ROUNDS rounds; in each, tasks train from the same
start on their blocks and the results are averaged, weighted by tokens, in a tree.

Defined cases: null texts are empty and score their end token; a null doc_id hashes as
empty text; repeated rows score alike; without training documents every token is the
unseen word with probability one and scores are 0; an empty table gives no rows;
further columns are ignored.
"""

import heapq
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import kept

BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20
TOP, HEAD_CLASSES, HIDDEN = 1024, 32, 16
WINDOW, LANES, TRAIN_LANES, STRIDE, ROUNDS = 32, 384, 128, 1, 3
TOKENS = 1_300_000  # that pass through the network at a time, so that a long text's lanes aren't the only ones
LEARNING_RATE, COOLING = 0.05, 50
TREE = 16
FAN = 64
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
END = b"\n"  # no word holds white space

BLOCKS = "doc_ids array<long>, held array<boolean>, sizes array<long>, hashes binary, counts binary, numbers binary, n_bytes long"
SENT = "child long, bucket long, hashes binary, counts binary"
SUMS = "node long, bucket long, hashes binary, counts binary"
TOTALS = f"{SENT}, tokens long, types long, tops binary, bins binary"
NUMBERED = "block long, doc_ids array<long>, held array<boolean>, sizes array<long>, known array<long>, base array<double>, share array<double>, numbers binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct tokens of some texts, all tokens as numbers of these, one text after another, and each text's number of tokens.

    Words are runs without space, tab, line feed, vertical tab, form feed or return; one end follows each text's words.
    """
    pieces = pc.ascii_split_whitespace(pa.array([text.translate(FOLD) for text in texts], pa.large_binary()).view(pa.large_string()))
    found = pieces.flatten()
    real = pc.binary_length(found).to_numpy() > 0  # white space at a text's edge leaves an empty piece
    words = found.filter(pa.array(real)).dictionary_encode()
    sizes = np.add.reduceat(real, pieces.offsets.to_numpy()[:-1], dtype=np.int64) + 1
    flat = np.full(int(sizes.sum()), len(words.dictionary), np.int32)
    inside = np.ones(len(flat), bool)
    inside[np.cumsum(sizes) - 1] = False
    flat[inside] = words.indices.to_numpy()
    return [*words.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False), END], flat, sizes


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers compressed, bytes of the same place side by side."""
    kind = numbers.dtype
    places = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), kind.itemsize).T)
    return kind.str.encode() + len(numbers).to_bytes(8, "little") + pa.compress(places.tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> np.ndarray:
    kind, n = np.dtype(blob[:3].decode()), int.from_bytes(blob[3:11], "little")
    places = np.frombuffer(pa.decompress(blob[11:], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(places.reshape(kind.itemsize, n).T).view(kind).ravel()


def _row(ids: list, held: list, texts: list[bytes], size: int) -> pa.RecordBatch:
    """A block. Its words come by falling count, then by rising hash of which the steps are kept, so that both they and the tokens' numbers pack well."""
    names, flat, sizes = tokens(texts)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
    order = np.argsort(hashes)
    order = order[np.argsort(-np.bincount(flat)[order], kind="stable")]
    rank = np.empty(len(order), np.uint16 if len(order) <= 1 << 16 else np.uint32)
    rank[order] = np.arange(len(order))
    flat = rank[flat]
    counts = np.bincount(flat[np.repeat(~np.array(held, bool), sizes)], minlength=len(order))
    steps = np.diff(hashes[order], prepend=np.uint64(0))  # modulo 2 ** 64
    lists = ((ids, pa.int64()), (held, pa.bool_()), (sizes, pa.int64()))
    blobs = (_packed(steps), _blob(counts), _packed(flat))
    return pa.RecordBatch.from_arrays(
        [*(pa.array([x], pa.list_(kind)) for x, kind in lists), *(pa.array([x], pa.binary()) for x in blobs), pa.array([size], pa.int64())],
        names=[x.split()[0] for x in BLOCKS.split(", ")],
    )


def _hashes(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(blob), dtype=np.uint64)


def _block(batches):
    ids, held, texts, size = [], [], [], 0
    for batch in batches:
        for one, out, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if texts and size + len(text) > BLOCK_BYTES:
                yield _row(ids, held, texts, size)
                ids, held, texts, size = [], [], [], 0
            ids.append(one)
            held.append(out)
            texts.append(text)
            size += len(text)
    if texts:
        yield _row(ids, held, texts, size)


def _by_bucket(hashes: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """Positions of a block's words by bucket, in a fixed order, so that answers need no keys."""
    order = np.argsort(hashes)
    to = (hashes % np.uint64(buckets)).astype(np.min_scalar_type(buckets - 1))
    order = order[np.argsort(to[order], kind="stable")]
    to = to[order].astype(np.int64)
    return [(int(to[low]), order[low:high]) for low, high in itertools.pairwise([0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(order)]) if low < high]


def _blob(counts: np.ndarray) -> bytes:
    """Counts in 4 bytes each where they fit, else 8."""
    counts = counts.astype(np.uint32 if counts.max(initial=0) < 2**32 else np.int64)
    return counts.dtype.str.encode() + counts.tobytes()


def _counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob[3:], blob[:3].decode())


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["child", "bucket", "hashes", "counts"])


def _send(buckets: int):
    """A block's words, to the buckets of its node."""

    def send(batches):
        for batch in batches:
            for block, hashes, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                hashes, counts = _hashes(hashes), _counts(counts)
                yield _sent([(block, to, hashes[at].tobytes(), _blob(counts[at])) for to, at in _by_bucket(hashes, buckets)])

    return send


def _climb(buckets: int):
    """A node's sums, to the finer buckets of the node above."""

    def climb(batches):
        for batch in batches:
            for node, hashes, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                hashes, counts = np.frombuffer(hashes, np.uint64), _counts(counts)
                yield _sent([(node, to, hashes[at].tobytes(), _blob(counts[at])) for to, at in _by_bucket(hashes, buckets)])

    return climb


BINS = 64


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in ascending order, the sums of their counts, and the place of each given hash among them."""
    hashes = np.frombuffer(b"".join(table["hashes"].to_pylist()), np.uint64)
    own = np.concatenate([_counts(blob) for blob in table["counts"].to_pylist()])
    names, back = np.unique(hashes, return_inverse=True)
    return names, np.bincount(back, own, len(names)).astype(np.int64), back


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    names, total, _ = _summed(table)
    node, bucket = ([k.as_py()] for k in key)
    return pa.table({"node": node, "bucket": bucket, "hashes": pa.array([names.tobytes()], pa.binary()), "counts": pa.array([_blob(total)], pa.binary())})


def _cut(answer: np.ndarray, hashes: pa.ChunkedArray) -> pa.Array:
    """Answers to the hashes of several rows, a value a row."""
    ends = np.cumsum([len(h) // 8 for h in hashes.to_pylist()])
    return pa.array([_blob(part) for part in np.split(answer, ends[:-1])], pa.binary())


def _add_up(keyed: bool):
    """The top of the tree: global counts of one bucket's words, returned to each child; on the first row the bucket's totals.

    Blocks know the order of their words, so the hashes go back only to nodes (keyed).
    """

    def add_up(table: pa.Table) -> pa.Table:
        names, total, back = _summed(table)
        seen = total > 0
        top = np.flatnonzero(total >= 2)
        top = top[np.lexsort((names[top], -total[top]))][:TOP]
        size_class = np.floor(np.log2(np.maximum(total[seen], 1))).astype(np.int64)
        types, mass = np.bincount(size_class, minlength=BINS), np.bincount(size_class, total[seen], BINS).astype(np.int64)
        first = [True] + [False] * (table.num_rows - 1)
        rest = (np.stack([names[top], total[top].astype(np.uint64)]).tobytes(), np.stack([types, mass]).astype(np.int64).tobytes())
        return pa.table(
            {
                "child": table["child"], "bucket": table["bucket"],
                "hashes": table["hashes"] if keyed else pa.nulls(table.num_rows, pa.binary()), "counts": _cut(total[back], table["hashes"]),
                "tokens": pa.array([int(total.sum()) if f else 0 for f in first], pa.int64()), "types": pa.array([int(seen.sum()) if f else 0 for f in first], pa.int64()),
                "tops": pa.array([rest[0] if f else None for f in first], pa.binary()), "bins": pa.array([rest[1] if f else None for f in first], pa.binary()),
            }
        )

    return add_up


def _answer(keyed: bool):
    """What a node was told, handed on to each of its children."""

    def answer(asked: pa.Table, told: pa.Table) -> pa.Table:
        names = np.frombuffer(b"".join(told["hashes"].to_pylist()), np.uint64)
        counts = np.concatenate([_counts(blob) for blob in told["counts"].to_pylist()])
        order = np.argsort(names)
        at = np.searchsorted(names, np.frombuffer(b"".join(asked["hashes"].to_pylist()), np.uint64), sorter=order)
        return pa.table(
            {
                "child": asked["child"], "bucket": asked["bucket"],
                "hashes": asked["hashes"] if keyed else pa.nulls(asked.num_rows, pa.binary()), "counts": _cut(counts[order[at]], asked["hashes"]),
            }
        )

    return answer


def tree(blocks: int, size: int) -> list[tuple[int, int]]:
    """Nodes and buckets of each level, from the one above the blocks to the one of a single node.

    Buckets are powers of two, so a bucket is a union of buckets of the level above;
    each stands for about BUCKET_BYTES of the text below its node.
    """
    levels = []
    while not levels or blocks > 1:
        blocks = max(1, -(-blocks // FAN))
        levels.append((blocks, 1 << max(0, math.ceil(math.log2(max(1, size) / blocks / BUCKET_BYTES)))))
    return levels


def counted(blocks: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Of `blocks` (block, hashes, counts, n_bytes): the answers to blocks (block, bucket, counts), the top's table with the corpus totals, a block's buckets."""
    n, size = blocks.agg(F.count(F.lit(1)), F.sum("n_bytes")).first()
    levels = tree(n, size or 0)
    keys = ["node", "bucket"]
    sent = [blocks.select("block", "hashes", "counts").mapInArrow(_send(levels[0][1]), SENT).withColumn("node", F.pmod(F.xxhash64("child"), F.lit(levels[0][0])))]
    for nodes, buckets in levels[1:]:
        sent[-1] = kept(sent[-1], "lm-sent")  # read on the way up and on the way down
        sums = sent[-1].groupBy(*keys).applyInArrow(_merge, SUMS)
        sent.append(sums.select("node", "hashes", "counts").mapInArrow(_climb(buckets), SENT).withColumn("node", F.pmod("child", F.lit(nodes))))
    top = kept(sent[-1].groupBy(*keys).applyInArrow(_add_up(len(levels) > 1), TOTALS), "lm-counts")
    told = top
    for level in range(len(levels) - 2, -1, -1):
        given = told.select(F.col("child").alias("node"), F.pmod("bucket", F.lit(levels[level][1])).alias("bucket"), "hashes", "counts")
        told = sent[level].drop("counts").groupBy(*keys).cogroup(given.groupBy(*keys)).applyInArrow(_answer(level > 0), SENT)
    return told.select(F.col("child").alias("block"), "bucket", "counts"), top, levels[0][1]


class Words:
    """The network's vocabulary: top words by class, then one class for each size of rarer counts; the last is for once and never."""

    def __init__(self, top: list[tuple[int, int]], types: np.ndarray, mass: np.ndarray, n: int, v: int):
        self.n, self.v = n, v
        self.names = np.array([h for h, _ in top], np.uint64)
        counts = np.array([c for _, c in top], np.int64)
        weight = np.cumsum(np.sqrt(counts))
        self.of_word = np.minimum((HEAD_CLASSES * (weight - np.sqrt(counts)) / max(weight[-1] if len(weight) else 0, 1)).astype(np.int64), HEAD_CLASSES - 1)
        _, self.of_word = np.unique(self.of_word, return_inverse=True)
        self.heads = int(self.of_word.max(initial=-1)) + 1
        bounds = np.searchsorted(self.of_word, np.arange(self.heads + 1)).tolist()
        self.spans = bounds[:-1], bounds[1:]  # where each class of top words begins and ends
        self.first, self.width = np.array(bounds[:-1], np.int64), np.diff(bounds)
        sizes = np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)
        left_types = types - np.bincount(sizes, minlength=BINS)
        left_mass = mass - np.bincount(sizes, counts, BINS).astype(np.int64)
        once, twice = int(types[0]), int(mass[1]) // 2
        tails = [k for k in range(BINS - 1, 0, -1) if left_types[k] > 0]
        self.tail_of = np.full(BINS, self.heads + len(tails), np.int64)
        self.tail_of[tails] = self.heads + np.arange(len(tails))
        self.classes = self.heads + len(tails) + 1
        self.size = len(top) + len(tails) + 1  # inputs: words, then tail classes
        self.class_of = np.concatenate([self.of_word, self.heads + np.arange(len(tails) + 1)]).astype(np.int32)  # of an input number
        self.log_mass = np.zeros(BINS)
        self.log_mass[tails] = np.log(left_mass[tails])
        # The share of the unseen word in its class, from how often words occur once and twice.
        unseen = once / (once + 2 * twice + 1) if once else 1.0
        self.log_unseen, self.log_once = math.log(unseen), math.log((1 - unseen) / once) if once else 0.0
        class_mass = np.concatenate([np.bincount(self.of_word, counts, self.heads)[: self.heads], left_mass[tails], [once + 1]])
        self.class_bias = np.log(class_mass / class_mass.sum()).astype(np.float32)
        self.word_bias = np.log(counts).astype(np.float32)
        self.by_name = np.argsort(self.names)

    def places(self, hashes: np.ndarray, counts: np.ndarray):
        """For words: input number, log of the share in the class for rarer words (0 for top words)."""
        sorted_names = self.names[self.by_name]
        at = np.searchsorted(sorted_names, hashes)
        at[at == len(sorted_names)] = 0
        is_top = sorted_names[at] == hashes if len(sorted_names) else np.zeros(len(hashes), bool)
        size = np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)
        group = self.tail_of[size]
        share = np.log(np.maximum(counts, 1)) - self.log_mass[size]
        share = np.where(counts == 0, self.log_unseen, np.where(counts == 1, self.log_once, share))
        number = group - self.heads + len(self.names)
        if len(self.names):
            word = self.by_name[at]
            number, share = np.where(is_top, word, number), np.where(is_top, 0.0, share)
        return number.astype(np.int32), share


SAFE = 60  # exponentials of logits between -SAFE and SAFE need no shift


def exponentials(logits: np.ndarray, furthest: float, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of logits and their sums; rows are shifted in place where a logit could lie further from 0 than SAFE."""
    if furthest > SAFE:
        logits -= logits.max(axis=1, keepdims=True)
    powers = np.exp(logits)
    return powers, powers @ ones[: powers.shape[1]]


class Network:
    """Gated recurrent unit over a table of gate inputs; class-factored softmax."""

    def __init__(self, words: Words, seed: int = 3):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.words = words
        self.p = {
            "gates": rng.normal(0, 0.1, (words.size, 3 * h)), "inner": rng.normal(0, 1 / math.sqrt(h), (h, 3 * h)),
            "classes": rng.normal(0, 0.05, (h, words.classes)), "class_bias": words.class_bias,
            "members": rng.normal(0, 0.05, (h, len(words.names))), "member_bias": words.word_bias,
        }
        self.p = {k: np.ascontiguousarray(v, np.float32) for k, v in self.p.items()}
        self.p["gates"][:, h : 2 * h] += 1  # states last

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> "Network":
        at = 0
        for name, value in self.p.items():
            self.p[name] = np.array(flat[at : at + value.size], np.float32).reshape(value.shape)
            at += value.size
        return self

    def steps(self, given: np.ndarray, fresh: np.ndarray, state: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States (steps, cells, lanes) after each of some steps; given: previous words (steps, lanes), fresh: 0 where a document starts, else 1.

        Lanes lie side by side in memory, so that each gate of all lanes is one run of numbers.
        """
        h = HIDDEN
        half = np.repeat(np.array([0.5, 0.5, 1], np.float32), h)[:, None]  # a logistic gate is half a hyperbolic tangent of half its input
        inner = self.p["inner"].T * half
        gates = np.ascontiguousarray((self.p["gates"] * half.T).take(given, axis=0).transpose(0, 2, 1))
        count, lanes = given.shape
        # Without a trace, steps share the memory of what only backpropagation reads.
        before, u = (np.empty((1 if trace is None else count, cells, lanes), gates.dtype) for cells in (h, 3 * h))
        out, spare = np.empty((count, h, lanes), gates.dtype), np.empty((h, lanes), gates.dtype)
        for t, (rz, r, z, n, new) in enumerate(zip(gates[:, : 2 * h], gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], out, strict=True)):
            old, add = (before[0], u[0]) if trace is None else (before[t], u[t])
            np.multiply(state, fresh[t], out=old)
            np.matmul(inner, old, out=add)
            rz += add[: 2 * h]
            np.tanh(rz, out=rz)
            rz *= 0.5
            rz += 0.5
            np.multiply(r, add[2 * h :], out=spare)
            n += spare
            np.tanh(n, out=n)
            np.subtract(old, n, out=new)
            new *= z
            new += n
            state = new
        if trace is not None:
            trace += [before, gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], u[:, 2 * h :]]
        return out

    def output(self, states: np.ndarray, word: np.ndarray, group: np.ndarray, grads: dict | None = None):
        """Log-probability of class and word of each state; with grads (zeros at first), fills in gradients and returns those of the states."""
        # States of a class side by side, so that each class is one slice; a last cell of 1 takes the biases.
        h, order = HIDDEN, np.argsort(group.astype(np.int16), kind="stable")
        word, group = word.take(order), group.take(order)
        cells = np.ones((len(states), h + 1), states.dtype)
        cells[:, :h] = states.take(order, axis=0)
        classes, members = (np.vstack([self.p[w], self.p[b]]) for w, b in (("classes", "class_bias"), ("members", "member_bias")))
        far, further = (np.abs(w).sum(axis=0) for w in (classes, members))  # cells lie between -1 and 1
        ones, lines = np.ones(max(classes.shape[1], members.shape[1]), states.dtype), np.arange(len(states))
        logits = cells @ classes
        powers, total = exponentials(logits, far.max(), ones)
        picked = lines * logits.shape[1] + group
        score, totals = logits.ravel().take(picked).astype(np.float64), total.astype(np.float64)
        back = None
        if grads is not None:
            powers /= total[:, None]
            powers.ravel()[picked] -= 1
            found = cells.T @ powers
            grads["classes"] += found[:h]
            grads["class_bias"] += found[h]
            back = powers @ classes[:h].T
        ends = np.searchsorted(group, np.arange(self.words.heads + 1))
        top = group[: ends[-1]]
        own = (lines[: ends[-1]] - ends.take(top)) * self.words.width.take(top) + word[: ends[-1]] - self.words.first.take(top)  # in the class's logits
        logit, sums = np.zeros(len(top), states.dtype), np.ones(len(top), states.dtype)
        furthest = np.maximum.reduceat(further, self.words.first).tolist() if self.words.heads else []
        for low, high, first, last, most in zip(ends[:-1].tolist(), ends[1:].tolist(), *self.words.spans, furthest, strict=True):
            if low == high or last - first < 2:
                continue
            weights, inner = members[:, first:last], cells[low:high]
            logits = inner @ weights
            powers, total = exponentials(logits, most, ones)
            logit[low:high], sums[low:high] = logits.ravel().take(own[low:high]), total
            if grads is not None:
                powers /= total[:, None]
                powers.ravel()[own[low:high]] -= 1
                found = inner.T @ powers
                grads["members"][:, first:last] = found[:h]
                grads["member_bias"][first:last] = found[h]
                back[low:high] += powers @ weights[:h].T
        score[: len(top)] += logit
        totals[: len(top)] *= sums
        score -= np.log(totals)
        scores = np.empty_like(score)
        scores[order] = score
        if back is not None:
            there = np.empty_like(back)
            there[order] = back
            back = there
        return scores, back

    def backward(self, given, fresh, trace, back, grads) -> None:
        """Truncated backpropagation through the steps of one window; back: gradients of the states (steps, cells, lanes)."""
        h, inner = HIDDEN, self.p["inner"]
        before, r, z, n, u = trace
        # What a state's gradient is multiplied by on its way into each gate, for all steps at once.
        to_n = (1 - z) * (1 - n * n)
        to_r = u * r * (1 - r)
        to_z = (before - n) * z * (1 - z)
        down = np.zeros_like(back[0])
        d_n = np.empty(back.shape, back.dtype)
        d_u = np.empty((len(back), 3 * h, back.shape[2]), back.dtype)
        steps = (back, d_n, to_n, to_r, to_z, r, z, d_u, d_u[:, :h], d_u[:, h : 2 * h], d_u[:, 2 * h :], fresh)
        for go, go_n, by_n, by_r, by_z, reset, keep, go_u, go_r, go_z, go_i, unbroken in zip(*(x[::-1] for x in steps), strict=True):
            down += go
            np.multiply(down, by_n, out=go_n)
            np.multiply(go_n, by_r, out=go_r)
            np.multiply(down, by_z, out=go_z)
            np.multiply(go_n, reset, out=go_i)
            down *= keep
            down += inner @ go_u
            down *= unbroken
        grads["inner"] += np.matmul(before, d_u.transpose(0, 2, 1)).sum(axis=0)
        d_u[:, 2 * h :] = d_n  # of the input from here on: the reset gate doesn't weigh it
        # Each word's rows side by side, so that they are added up in one pass.
        words = given.ravel()
        order = np.argsort(words.astype(np.uint16), kind="stable")
        heads = np.flatnonzero(np.diff(words[order], prepend=-1))
        rows = d_u.transpose(0, 2, 1).reshape(-1, 3 * h).take(order, axis=0)
        grads["gates"][words[order[heads]]] += np.add.reduceat(rows, heads)


class Adam:
    def __init__(self, network: Network):
        self.network, self.step = network, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in network.p.items()} for _ in range(2))

    def move(self, grads: dict, weight: float) -> None:
        """One step; weight: the share of lanes that still ran, as a few long texts say less of the corpus than all lanes."""
        self.step += 1
        rate = weight * LEARNING_RATE * min(1.0, math.sqrt(COOLING / self.step)) * math.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
        for name, grad in grads.items():
            first, second = self.first[name], self.second[name]
            np.clip(grad, -1, 1, out=grad)
            first *= 0.9
            first += np.float32(0.1) * grad
            second *= 0.99
            grad *= grad
            grad *= 0.01
            second += grad
            np.sqrt(second, out=grad)
            grad += 1e-8
            np.divide(first, grad, out=grad)
            grad *= rate
            self.network.p[name] -= grad


def lanes(sizes: np.ndarray, most: int) -> list[list[int]]:
    """Texts dealt to at most `most` lanes, longest first to the shortest lane; lanes come back longest first."""
    heap = [(0, k) for k in range(min(most, len(sizes)))]
    out = [[] for _ in heap]
    for i in np.argsort(-sizes, kind="stable").tolist():
        filled, k = heap[0]
        out[k].append(i)
        heapq.heapreplace(heap, (filled + int(sizes[i]), k))
    return sorted(out, key=lambda texts: -sum(int(sizes[i]) for i in texts))


def windows(sizes: np.ndarray, chosen: np.ndarray, most: int, widened: bool = False):
    """Token positions of the chosen texts in lanes: (steps, lanes) of positions and whether all are tokens, window by window.

    Lanes end one after another, so later windows have fewer of them, and more steps if widened; -1 fills the end of a lane.
    """
    dealt = [texts for texts in lanes(sizes[chosen], most) if texts]
    if not dealt:
        return
    texts = chosen[np.concatenate(dealt)]
    ends = np.cumsum(sizes[texts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    track = np.arange(ends[-1]) + np.repeat(starts[texts] - (ends - sizes[texts]), sizes[texts])  # all lanes' positions, lane after lane
    until = ends[np.cumsum([len(texts) for texts in dealt]) - 1]
    first = np.concatenate([[0], until[:-1]])
    length = until - first
    low = 0
    while low < length[0]:
        live = int(np.count_nonzero(length > low))
        steps = min(WINDOW * (most // live if widened else 1), int(length[0]) - low)
        step = np.arange(low, low + steps)[:, None]
        whole = bool(length[live - 1] >= low + steps)
        if whole:
            at = track.take(first[:live] + step)
        else:
            at = np.where(step < length[:live], track.take(np.minimum(first[:live] + step, len(track) - 1)), -1)
        yield at, whole
        low += steps


def run(network: Network, number, sizes, chosen, adam: Adam | None = None, stride: int = 1):
    """Log-probabilities (natural) of the tokens of the chosen texts; with adam, trains on every stride-th window instead."""
    out, group = np.zeros(len(number)), network.words.class_of[number]
    end = number[-1] if len(number) else 0  # the input at a text's start is the end token
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    # The step after a lane's end, position -1, reads the last value.
    previous, unbroken = np.append(np.roll(number, 1), end).astype(np.int32), np.ones(len(number) + 1, np.float32)
    previous[starts], unbroken[starts] = end, 0
    unbroken[-1] = 1
    state, nth = None, 0
    for at, whole in windows(sizes, chosen, LANES if adam is None else TRAIN_LANES, adam is None):
        given, fresh = previous.take(at), unbroken.take(at)
        state = np.zeros((HIDDEN, at.shape[1]), np.float32) if state is None else state[:, : at.shape[1]]
        learn = adam is not None and nth % stride == 0
        nth += 1
        trace = [] if learn else None
        states = network.steps(given, fresh, state, trace)
        state = states[-1]
        if adam is None or learn:
            flat, picks = states.transpose(0, 2, 1).reshape(-1, HIDDEN), at.ravel()
            if not whole:
                used = picks >= 0
                flat, picks = flat[used], picks[used]
            grads = {k: np.zeros_like(v) for k, v in network.p.items()} if learn else None
            score, back = network.output(flat, number.take(picks), group.take(picks), grads)
            out[picks] = score
            if learn:
                if not whole:
                    full = np.zeros((at.size, HIDDEN), back.dtype)
                    full[used] = back
                    back = full
                network.backward(given, fresh, trace, np.ascontiguousarray(back.reshape(*at.shape, HIDDEN).transpose(0, 2, 1)), grads)
                for grad in grads.values():
                    grad /= max(1, len(picks)) ** 0.5
                adam.move(grads, len(picks) / (WINDOW * TRAIN_LANES))
    return out


def _number(vocabulary: Words, buckets: int):
    """Blocks as the network's input numbers (16 bits each), with the sums per text that don't depend on the network."""

    def number(batches):
        for batch in batches:
            for block, ids, held, sizes, hashes, flat, answers in zip(*(batch.column(k) for k in range(7)), strict=True):
                hashes, flat, sizes = _hashes(hashes.as_py()), _unpacked(flat.as_py()), np.array(sizes.as_py(), np.int64)
                counts = np.zeros(len(hashes), np.int64)
                told = {a["bucket"]: a["counts"] for a in answers.as_py()}
                for to, at in _by_bucket(hashes, buckets):
                    counts[at] = _counts(told[to])
                numbers, share = vocabulary.places(hashes, counts)
                base = np.log10((counts + 1) / (vocabulary.n + vocabulary.v + 1))
                start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                known, base, share = (np.add.reduceat(x[flat], start) for x in ((counts > 0).astype(np.int64), base, share))
                lists = [[x] for x in (sizes, known, base, share)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block.as_py()], pa.int64()), pa.array([ids.as_py()], pa.list_(pa.int64())), pa.array([held.as_py()], pa.list_(pa.bool_())),
                        *(pa.array(x, pa.list_(k)) for x, k in zip(lists, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)),
                        pa.array([numbers[flat].astype(np.uint16).tobytes()], pa.binary()),
                    ],
                    names=[x.split()[0] for x in NUMBERED.split(", ")],
                )

    return number


def _several(batches):
    """Rows of several blocks at a time, about TOKENS tokens: lists of columns, the last of which holds the numbers."""
    rows, held = [], 0
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            rows.append([value.as_py() for value in row])
            held += len(rows[-1][-1]) // 2
            if held >= TOKENS:
                yield list(zip(*rows, strict=True))
                rows, held = [], 0
    if rows:
        yield list(zip(*rows, strict=True))


def _train(vocabulary: Words, weights: np.ndarray, stride: int):
    def train(batches):
        network, done, adam = Network(vocabulary).load(weights), 0, None
        for held, sizes, numbers in _several(batches):
            sizes = np.concatenate(sizes).astype(np.int64)
            chosen = np.flatnonzero(~np.concatenate(held).astype(bool))
            if len(chosen):
                adam = adam or Adam(network)
                run(network, np.frombuffer(b"".join(numbers), np.uint16).astype(np.int32), sizes, chosen, adam, stride)
                done += int(sizes[chosen].sum())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64()), pa.array([network.flat().tobytes()], pa.binary())], names=["n", "weights"])

    return train


def _mean(table: pa.Table) -> pa.Table:
    n = table["n"].to_numpy()
    total = sum(np.frombuffer(w.as_py(), np.float32).astype(np.float64) * k for w, k in zip(table["weights"], n, strict=True))
    return pa.table({"n": pa.array([int(n.sum())], pa.int64()), "weights": pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())})


def averaged(models: DataFrame) -> np.ndarray | None:
    """The mean of the tasks' weights, TREE of them at a time; the driver gets one."""
    models = kept(models.withColumn("k", F.monotonically_increasing_id()), "models")
    left = models.count()
    if not left:
        return None
    level = models
    while left > 1:
        left = -(-left // TREE)
        grouped = level.select(F.pmod(F.xxhash64("k"), F.lit(left)).alias("k"), "n", "weights")
        level = grouped.groupBy("k").applyInArrow(lambda key, t: _mean(t).append_column("k", pa.array([key[0].as_py()], pa.int64())), "n long, weights binary, k long")
    return np.frombuffer(level.first().weights, np.float32)


def _score(vocabulary: Words, weights: np.ndarray):
    def score(batches):
        network = Network(vocabulary).load(weights)
        for *columns, numbers in _several(batches):
            ids, held, sizes, known, base, share = ([x for part in column for x in part] for column in columns)
            lengths = np.array(sizes, np.int64)
            logs = run(network, np.frombuffer(b"".join(numbers), np.uint16).astype(np.int32), lengths, np.arange(len(lengths)))
            total = np.add.reduceat(logs, np.concatenate([[0], np.cumsum(lengths)[:-1]])) + np.array(share)
            trained = np.full(len(lengths), vocabulary.n, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(held), pa.array(lengths), pa.array(known), pa.array(trained), pa.array(base), pa.array(total / math.log(10))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return score


def scored(docs: DataFrame, held: Column | None = None, stride: int = STRIDE) -> DataFrame:
    """A row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of probability).

    `held` marks the rows that the model doesn't learn from; by default those whose crc32(doc_id as text) mod 7 is 2.
    """
    if held is None:
        held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), text.alias("text"))
    blocks = kept(given.mapInArrow(_block, BLOCKS).withColumn("block", F.monotonically_increasing_id()), "lm-blocks")
    told, top, buckets = counted(blocks)
    n, v = (x or 0 for x in top.agg(F.sum("tokens"), F.sum("types")).first())
    vocabulary = Words(*_frequent(top), n, v)
    answers = told.groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("answers"))
    # Tokens meet their counts once; training and scoring then read two bytes a token.
    read = blocks.join(answers, "block").select("block", "doc_ids", "held", "sizes", "hashes", "numbers", "answers")
    numbered = kept(read.mapInArrow(_number(vocabulary, buckets), NUMBERED), "lm-numbers")
    weights = Network(vocabulary).flat()
    for k in range(ROUNDS):
        part = numbered.filter(F.pmod(F.xxhash64("block"), F.lit(ROUNDS)) == k).select("held", "sizes", "numbers")
        found = averaged(part.mapInArrow(_train(vocabulary, weights, stride), "n long, weights binary"))
        weights = weights if found is None else found
    return numbered.drop("block").mapInArrow(_score(vocabulary, weights), SCORES)


def _frequent(sums: DataFrame) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """The TOP words of all buckets, merged TREE buckets at a time, and the number and mass of words by size of count."""

    def merge(table: pa.Table) -> pa.Table:
        names, counts = (np.concatenate(x) for x in zip(*(np.frombuffer(t.as_py(), np.uint64).reshape(2, -1) for t in table["tops"]), strict=True))
        best = np.lexsort((names, ~counts))[:TOP]
        bins = sum(np.frombuffer(b.as_py(), np.int64) for b in table["bins"])
        return pa.table({"tops": pa.array([np.stack([names[best], counts[best]]).tobytes()], pa.binary()), "bins": pa.array([bins.tobytes()], pa.binary())})

    level = sums.filter("tops IS NOT NULL").select(F.col("bucket").alias("k"), "tops", "bins")
    left = level.count()
    while left > 1:
        left = -(-left // TREE)
        level = level.withColumn("k", F.pmod("k", F.lit(left))).groupBy("k").applyInArrow(
            lambda key, t: merge(t).append_column("k", pa.array([key[0].as_py()], pa.int64())), "tops binary, bins binary, k long"
        )
    row = level.first()
    if row is None:
        return [], np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    names, counts = np.frombuffer(row.tops, np.uint64).reshape(2, -1)
    types, mass = np.frombuffer(row.bins, np.int64).reshape(2, BINS)
    return list(zip(names.tolist(), counts.tolist(), strict=True)), types, mass
