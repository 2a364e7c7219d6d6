"""Quality by ordinal cumulative-link regression on graded ratings.

Ratings are grades 0, 1, ..., K - 1. One weight vector over hashed text features is
shared by all grades, with ordered thresholds: P(grade <= k) = s(t[k] - w.x), s the
logistic function. A document's expected grade is the sum of its tail probabilities
P(grade >= k); it is kept if P(grade >= `least`) is at least `share`.

Features: words and runs of other signs (lower-cased), each hashed to one of SLOTS
weights with the root of its share of the text, scaled to length 1; beside them the
shares of words that repeat the word before, of distinct words and of distinct lines.

The model is fitted on at most SAMPLE rated documents, those with the smallest hash
of their id; this bound is a parameter, and the only one: all documents are scored,
on their whole texts. Fitting is mini-batch gradient descent in numpy on the driver,
whose data the bound limits.

Defined cases: a null text is empty and is scored by its empty features; ratings
with a null id or grade are left out, of several ratings of an id the lowest counts;
without two different grades all documents get the one grade there is and are kept;
rows that repeat get a row each; an empty table gives no rows; further columns are
ignored, or kept by `accepted`.
"""

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 8_000
SLOTS = 1 << 17
EXTRA = 3
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.5, 1e-6
MOST_WORDS = 300_000
PART = re.compile(r"\w+|[^\w\s]+")
KEEP_SHARE = 0.5


class Features(dict):
    """Sparse features of texts; as a dict, the slots of each run of characters met, as bytes."""

    def __missing__(self, run: str) -> bytes:
        parts = [xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass")) % SLOTS for p in PART.findall(run)]
        self[run] = found = array("I", parts).tobytes()
        return found

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Slots and values; the last EXTRA slots are the shares."""
        if len(self) > MOST_WORDS:
            self.clear()
        text = text.lower()
        runs = text.split()
        slots, counts = np.unique(np.frombuffer(b"".join(map(self.__getitem__, runs)), np.uint32), return_counts=True)
        values = np.sqrt(counts / max(1, counts.sum())).astype(np.float32)
        lines = [line for line in text.split("\n") if line]
        extra = [
            sum(map(str.__eq__, runs[1:], runs)) / max(1, len(runs)),
            len(set(runs)) / max(1, len(runs)),
            len(set(lines)) / max(1, len(lines)),
        ]
        return np.concatenate([slots, np.arange(SLOTS, SLOTS + EXTRA, dtype=np.uint32)]), np.concatenate([values, np.array(extra, np.float32)])


def _featured(batches):
    features = Features()
    for batch in batches:
        found = [features.of(text) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([s.tobytes() for s, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())],
            names=["grade", "slots", "vals"],
        )


def logistic(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Ordinal:
    """Weights and thresholds; thresholds ascend because their steps are exponentials."""

    def __init__(self, grades: int):
        self.weights = np.zeros(SLOTS + EXTRA, np.float32)
        self.thresholds = np.zeros(grades - 1)

    def fit(self, sizes: np.ndarray, slots: np.ndarray, values: np.ndarray, grades: np.ndarray, seed: int = 5) -> "Ordinal":
        """Slots and values of all texts one after another, and how many each text has."""
        k = len(self.thresholds)
        below = np.clip([(grades <= j).mean() for j in range(k)], 1e-3, 1 - 1e-3)
        start = np.maximum.accumulate(np.log(below / (1 - below)) + 1e-3 * np.arange(k))
        first, steps = start[0], np.log(np.maximum(np.diff(start), 1e-2))
        squares, own = np.full(len(self.weights), 1e-6), np.full(k, 1e-2)
        rng = np.random.default_rng(seed)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for _ in range(EPOCHS):
            order = rng.permutation(len(sizes))
            for low in range(0, len(order), BATCH):
                mine = order[low : low + BATCH]
                take = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in mine])
                who = np.repeat(np.arange(len(mine)), ends[mine + 1] - ends[mine])
                score = np.bincount(who, self.weights[slots[take]] * values[take], len(mine))
                cuts = np.concatenate([[-np.inf], first + np.concatenate([[0], np.cumsum(np.exp(steps))]), [np.inf]])
                upper, lower = logistic(cuts[grades[mine] + 1] - score), logistic(cuts[grades[mine]] - score)
                mass = np.maximum(upper - lower, 1e-9)
                at_upper, at_lower = upper * (1 - upper) / mass, lower * (1 - lower) / mass
                slope = (at_upper - at_lower) / len(mine)  # of the loss by the score
                change = np.bincount(slots[take], slope[who] * values[take])
                used = np.unique(slots[take])
                pull = change[used] + DECAY * self.weights[used]
                squares[used] += pull**2
                self.weights[used] -= (RATE * pull / np.sqrt(squares[used])).astype(np.float32)
                by_cut = np.zeros(k + 2)
                np.add.at(by_cut, grades[mine] + 1, -at_upper / len(mine))
                np.add.at(by_cut, grades[mine], at_lower / len(mine))
                tail = np.cumsum(by_cut[1 : k + 1][::-1])[::-1]  # moving a step moves all later cuts
                pull = np.concatenate([[tail[0]], tail[1:] * np.exp(steps)])
                own += pull**2
                move = 0.1 * pull / np.sqrt(own)
                first, steps = first - move[0], np.clip(steps - move[1:], -8, 4)
        self.thresholds = first + np.concatenate([[0], np.cumsum(np.exp(steps))])
        return self

    def tails(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """P(grade >= k) for k = 1, ..., a row per text."""
        score = np.array([float(self.weights[s] @ v) for s, v in rows])
        return 1 - logistic(self.thresholds[None, :] - score[:, None])


class Constant:
    """The model of ratings that are all alike, or of none."""

    def __init__(self, grade: int, grades: int):
        self.row = (np.arange(1, grades) <= grade).astype(np.float64)

    def tails(self, rows):
        return np.tile(self.row, (len(rows), 1))


def fitted(docs: DataFrame, ratings: DataFrame, grades: int, sample: int = SAMPLE) -> Ordinal | Constant:
    """The model from ratings (doc_id, grade) and the texts of at most `sample` rated documents."""
    given = ratings.select(F.col("doc_id").alias("_id"), F.col("grade").cast("int").alias("_grade")).filter("_id IS NOT NULL AND _grade >= 0")
    given = given.filter(F.col("_grade") < grades).groupBy("_id").agg(F.min("_grade").alias("_grade"))
    chosen = given.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    # At most `sample` rows of an id and a grade: the bound of this broadcast.
    rated = docs.select("doc_id", text).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select(F.col("_grade").alias("grade"), "text")
    found = rated.mapInArrow(_featured, "grade int, slots binary, vals binary").limit(2 * sample).toArrow()
    marks = found["grade"].to_numpy().astype(np.int64)
    if len(np.unique(marks)) < 2:
        return Constant(int(marks[0]) if len(marks) else grades - 1, grades)
    slots, values = (np.frombuffer(b"".join(x.as_py() for x in found[c]), kind) for c, kind in (("slots", np.uint32), ("vals", np.float32)))
    sizes = pa.compute.binary_length(found["slots"]).to_numpy() // 4
    del found
    return Ordinal(grades).fit(sizes, slots, values, marks)


def _scorer(model):
    def score(batches):
        features = Features()
        for batch in batches:
            tails = model.tails([features.of(text) for text in batch.column(1).to_pylist()]) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1e-6 * np.round(1e6 * tails.sum(axis=1))), pa.array(list(np.round(tails, 6)), pa.list_(pa.float64()))],
                names=["doc_id", "expected_grade", "tails"],
            )

    return score


def graded(docs: DataFrame, model) -> DataFrame:
    """doc_id, expected_grade, tails (P(grade >= k) for k from 1)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(_scorer(model), "doc_id long, expected_grade double, tails array<double>")


def accepted(docs: DataFrame, model, least: int = 1, share: float = KEEP_SHARE) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns; they pass through one task each and aren't shuffled."""

    def choose(batches):
        features = Features()
        for batch in batches:
            if batch.num_rows:
                tails = model.tails([features.of(text) for text in batch.column(1).to_pylist()])
                yield batch.select([0]).filter(pa.array(tails[:, least - 1] >= share))

    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("r"))
    text = F.coalesce(F.col("r.text").cast("string"), F.lit("")).alias("text")
    schema = T.StructType([T.StructField("r", rows.schema["r"].dataType)])
    return rows.select("r", text).mapInArrow(choose, schema).select("r.*")


def ratings(labels: DataFrame) -> DataFrame:
    """Grades of the label table: 0 low quality, 1 fair text with toxic passages, 2 good."""
    good = F.col("quality") > 0
    grade = F.when(~good, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) > 0, 1).when(good, 2)
    return labels.select("doc_id", grade.alias("grade"))


GRADES = 3
