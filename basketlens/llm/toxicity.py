"""Toxicity from two class-conditional Kneser-Ney models.

Words are runs of ASCII letters and digits and of all characters above ASCII, A
to Z lower-cased. Toxic and ordinary rated documents have a model each of a
word's bytes after up to ORDER - 1 bytes before them in the word, blanks at its
ends: counts less a discount, then, shorter by a byte each time, how many
different bytes stood before (Kneser-Ney's continuation counts) less a discount.
The shortest SHARED orders are counted over both classes together, so a rare
expression, too seldom seen to outlast the discounts, has the shared backoff
counts in both models and tells nothing for or against. A word said in new
compounds and inflections is still known by its stem.

Both log-likelihoods of a document are divided by its words and compared; so are
those of every WINDOW words in a row, since a few toxic words in a long document
are toxic still. A logistic curve over the document's difference, its highest
window's, the share of words over BAR and the log of its words gives the score.
The curve is fitted on differences that each half of the rated documents has
under the models of the other half, and the discount is the one of DISCOUNTS
whose curve is likeliest there.

What is fitted: at most SAMPLE rated ids, those of smallest hash, one text an id
(the smallest); these texts go to the driver. The tables sent to tasks have SLOTS
places an order however much was rated. All documents are scored, whole.

Defined cases: null text is empty; a document without words has the smoothed
toxic share of what is rated, (toxic + 1) / (rated + 2), and so have all if no
toxic or no ordinary document is rated. Documents without an id are scored and
never rated. Rows that repeat an id are scored each. Ids rated twice are toxic if
one rating says so; null ratings are none. An empty table gives no rows; further
columns are kept, but one named toxicity is replaced.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, ORDER, SHARED, SLOTS, WINDOW, BAR = 5_000, 7, 2, 1 << 18, 4, 2.0
DISCOUNTS = (2.0, 4.0)
PREDICT_AT = 0.3
PART = 1 << 20
#: Letters A to Z become lower-case, other ASCII characters but digits and a to z become blanks.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(PLAIN).split() if text else []


class Grams:
    """Where words' bytes stand and the hashes of what ends there, 1 to ORDER bytes long."""

    def __init__(self, words: list[bytes]):
        stream = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
        place, blank = np.arange(len(stream), dtype=np.int32), stream == 32
        last = np.maximum.accumulate(np.where(blank, place, np.int32(0)))
        #: Each byte of a word and the blank behind it is foretold from what stands before it in the word, the blank included.
        self.at = place[1:]
        self.reach = self.at - last[:-1]
        self.word = np.cumsum(blank, dtype=np.int32)[:-1] - 1
        self.stream = stream
        self.held = {0: np.zeros(len(stream), np.uint64)}

    def runs(self, size: int) -> np.ndarray:
        """Hashes of the runs of some size that end at each byte; sizes are asked for in rising order, the last three stay."""
        if size not in self.held:
            shorter = np.concatenate([self.held[0][:1], self.runs(size - 1)[:-1]])
            self.held[size] = shorter * np.uint64(0x9E3779B97F4A7C15) + self.stream + np.uint64(1)
            self.held.pop(size - 3 if size > 3 else -1, None)
        return self.held[size]

    def ending(self, size: int, chosen: np.ndarray) -> np.ndarray:
        return self.runs(size)[self.at[chosen]]

    def contexts(self, size: int, chosen: np.ndarray) -> np.ndarray:
        """Hashes of what stands before the last byte of such runs."""
        return self.runs(size - 1)[self.at[chosen] - 1]


def slot(run: np.ndarray) -> np.ndarray:
    mixed = (run ^ (run >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(65 - SLOTS.bit_length())).astype(np.int64)


class Models:
    """Both classes' smoothed tables: per order, the share that a run keeps and what its context leaves to the shorter one."""

    def __init__(self, words: list[bytes], seen: np.ndarray, discount: float):
        """`seen` counts each word in ordinary (row 0) and in toxic documents (row 1)."""
        grams = Grams(words)
        self.share, self.keep = [[], []], [[], []]
        for size in range(1, ORDER + 1):
            for side in (0, 1):
                if size <= SHARED and side:
                    self.share[1].append(self.share[0][-1])
                    self.keep[1].append(self.keep[0][-1])
                    continue
                times = (seen.sum(0) if size <= SHARED else seen[side])[grams.word]
                share, keep = self._table(grams, times, size, discount)
                self.share[side].append(share)
                self.keep[side].append(keep)

    @staticmethod
    def _table(grams: Grams, times: np.ndarray, size: int, discount: float) -> tuple[np.ndarray, np.ndarray]:
        here = np.flatnonzero((grams.reach + 1 >= size) & (times > 0))
        runs, first, number = np.unique(grams.ending(size, here), return_index=True, return_inverse=True)
        if size == ORDER:
            counts = np.bincount(number, times[here], len(runs))
        else:
            # A run inside a word counts once for each byte seen before it; at the word's start there is none, and it counts as often as seen.
            inside = grams.reach[here] + 1 > size
            counts = np.bincount(number[~inside], times[here][~inside], len(runs))
            _, one = np.unique(grams.ending(size + 1, here[inside]), return_index=True)
            counts += np.bincount(number[inside][one], minlength=len(runs))
        of = slot(grams.contexts(size, here[first]))
        total = np.bincount(of, counts, SLOTS)
        share = np.maximum(counts - discount, 0.0) / total[of]
        kept = share > 0
        table = np.zeros(SLOTS, np.float32)
        np.add.at(table, slot(runs[kept]), share[kept].astype(np.float32))
        return table, (1 - np.bincount(of, share, SLOTS)).clip(1e-6, 1).astype(np.float32)

    def differences(self, words: list[bytes]) -> np.ndarray:
        """Per word, toxic less ordinary log-probability."""
        if not words:
            return np.zeros(0)
        grams = Grams(words)
        chance = [np.full(len(grams.at), 1 / 256, np.float32) for _ in (0, 1)]
        for size in range(1, ORDER + 1):
            here = np.flatnonzero(grams.reach + 1 >= size)
            own, of = slot(grams.ending(size, here)), slot(grams.contexts(size, here))
            for side in (0, 1):
                chance[side][here] = self.share[side][size - 1][own] + self.keep[side][size - 1][of] * chance[side][here]
        return np.bincount(grams.word, np.log(chance[1]) - np.log(chance[0]), len(words))


def features(difference: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document: one, the mean difference, the highest mean of a window, the share of words over BAR, the log of its words."""
    out = np.zeros((len(sizes), 5))
    out[:, 0] = 1
    ends, full = np.cumsum(sizes), sizes > 0
    run = np.concatenate([[0.0], np.cumsum(difference)])
    high = np.concatenate([[0], np.cumsum(difference > BAR)])
    out[full, 1] = (run[ends] - run[ends - sizes])[full] / sizes[full]
    out[full, 3] = np.sqrt((high[ends] - high[ends - sizes])[full] / sizes[full])
    out[:, 4] = np.log1p(sizes)
    if full.any():
        # The window that ends at a word, or the document's first WINDOW words where it would begin before them.
        first, last = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
        start = np.maximum(np.minimum(np.arange(len(difference)), last - WINDOW), first)
        stop = np.minimum(start + WINDOW, last)
        out[full, 2] = np.maximum.reduceat((run[stop] - run[start]) / (stop - start), (ends - sizes)[full])
    return out


def chance(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def logistic(rows: np.ndarray, toxic: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Weights by Newton's method, and the mean log-likelihood they reach."""
    weights = np.zeros(rows.shape[1])
    for _ in range(30):
        p = chance(rows @ weights)
        slope = rows.T @ (toxic - p) - ridge * weights
        curve = (rows * (p * (1 - p))[:, None]).T @ rows + ridge * np.eye(rows.shape[1])
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(chance(rows @ weights), 1e-12, 1 - 1e-12)
    return weights, float(np.mean(np.where(toxic > 0, np.log(p), np.log(1 - p))))


class Rated:
    """Rated documents as numbers of distinct words."""

    def __init__(self, texts: list[bytes], toxic: list[bool]):
        number: dict[bytes, int] = {}
        each = [[number.setdefault(word, len(number)) for word in words_of(text)] for text in texts]
        self.words, self.toxic = list(number), np.array(toxic, bool)
        self.sizes = np.array([len(one) for one in each], np.int64)
        self.flat = np.array([n for one in each for n in one], np.int64)

    def models(self, chosen: np.ndarray, discount: float) -> Models:
        of = np.repeat(chosen, self.sizes)
        side = np.repeat(self.toxic, self.sizes)
        seen = np.stack([np.bincount(self.flat[of & (side == s)], minlength=len(self.words)) for s in (False, True)])
        some = np.flatnonzero(seen.sum(0))
        return Models([self.words[n] for n in some], seen[:, some], discount)

    def features(self, models: Models, chosen: np.ndarray) -> np.ndarray:
        return features(models.differences(self.words)[self.flat[np.repeat(chosen, self.sizes)]], self.sizes[chosen])


class Scorer:
    """Models and curve; the toxic share alone where either class is missing."""

    def __init__(self, texts: list[bytes], toxic: list[bool]):
        rated = Rated(texts, toxic)
        self.share, self.models = (sum(toxic) + 1) / (len(toxic) + 2), None
        # Halves are dealt class by class, so each has its part of both.
        halves = np.zeros(len(toxic), np.int64)
        for side in (False, True):
            of = np.flatnonzero((rated.toxic == side) & (rated.sizes > 0))
            if len(of) < 2:
                return
            halves[of] = np.arange(len(of)) % 2
        best = None
        for discount in DISCOUNTS:
            rows = np.zeros((len(toxic), 5))
            for side in (0, 1):
                rows[halves == side] = rated.features(rated.models(halves != side, discount), halves == side)
            some = rated.sizes > 0
            weights, reached = logistic(rows[some], rated.toxic[some].astype(float))
            if best is None or reached > best[0]:
                best = (reached, discount, weights)
        self.reached, self.discount, self.weights = best
        self.models = rated.models(np.ones(len(toxic), bool), self.discount)

    def scores(self, difference: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.where(sizes > 0, chance(features(difference, sizes) @ self.weights), self.share)


class Reader:
    """Scores texts and remembers the differences of words, within bounds."""

    def __init__(self, scorer: Scorer):
        self.scorer, self.known = scorer, {}

    def scores(self, texts: list) -> np.ndarray:
        """Scores of texts, read PART bytes or one text at a time."""
        if self.scorer.models is None:
            return np.full(len(texts), self.scorer.share)
        part = np.cumsum([len(text) for text in texts]) // PART
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        return np.concatenate([self._scores(texts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])

    def _scores(self, texts: list) -> np.ndarray:
        each = [words_of(text) for text in texts]
        flat = [word for words in each for word in words]
        if len(self.known) > 1 << 18:
            self.known.clear()
        new = list({word for word in flat if word not in self.known})
        for start in range(0, len(new), 10_000):
            part = new[start : start + 10_000]
            self.known.update(zip(part, self.scorer.models.differences(part).tolist(), strict=True))
        difference = np.fromiter(map(self.known.__getitem__, flat), np.float64, len(flat))
        return self.scorer.scores(difference, np.array([len(words) for words in each], np.int64))


def held_out(doc_id: Column) -> Column:
    """Whether a document's ratings are kept from the fit."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Fit on rated documents that aren't held out. `ratings` has doc_id and toxic (0 or 1)."""
    rated = (
        ratings.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg((F.max("toxic") > 0).alias("is_toxic"))
    )
    chosen = docs.select("doc_id").distinct().join(rated, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = texts.groupBy("doc_id", "is_toxic").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id")
    found = rows.select(F.col("text").cast("binary").alias("text"), "is_toxic").toArrow()
    return Scorer(found.column(0).to_pylist(), found.column(1).to_pylist())


def scored(docs: DataFrame, model: Scorer) -> DataFrame:
    """All columns of `docs`, and toxicity (0 to 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = [name for name in docs.columns if name.lower() != "toxicity"]

    def score(batches):
        reader = Reader(sent.value)
        for batch in batches:
            columns = [*batch.columns[1:], pa.array(reader.scores(batch.column(0).to_pylist()), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, "toxicity"])

    # The text goes along once more as bytes, which Python takes without decoding.
    own = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("bytes"), *rest)
    return own.mapInArrow(score, docs.select(*rest).schema.add("toxicity", "double"))
