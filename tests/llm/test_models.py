import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from basketlens.llm import language_model, quality

SCHEMA = "doc_id long, text string, held string, sizes int, tails string"


# Language model


def test_counts_and_base_scores_are_those_of_the_definition(rows, spark):
    rng = random.Random(2)
    data = [(k, " ".join(rng.choice(["Oak", "oak", "elm", "ash", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(60)))) for k in range(80)]
    data += [(80, None), (81, ""), (82, "oak\x0bELM\x0c ash\t\r\n"), (82, "oak\x0bELM\x0c ash\t\r\n"), (None, "É oak"), (83, "x " * 9000)]
    docs = rows([(i, t, "h", 1, "t") for i, t in data], SCHEMA)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    split = lambda t: [*(t or "").encode().translate(language_model.FOLD).split(), b"\n"]
    counts = Counter(w for i, t in data if not held(i) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    found = language_model.scored(docs).collect()
    assert len(found) == len(data)
    want = {i: split(t) for i, t in data}
    for row in found:
        words = want[row.doc_id]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held(row.doc_id), len(words), sum(w in counts for w in words), n)
        assert row.base_score == pytest.approx(base, abs=1e-6) and row.score < 0 and math.isfinite(row.score)
    assert language_model.scored(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("fan", [2, 64])
def test_counts_climb_a_tree_and_come_down_to_each_block(rows, monkeypatch, fan):
    rng = random.Random(5)
    data = [(k, " ".join(f"w{int(rng.paretovariate(0.4)) % 900}" for _ in range(60))) for k in range(90)]
    for name, value in (("FAN", fan), ("BLOCK_BYTES", 900), ("BUCKET_BYTES", 700)):
        monkeypatch.setattr(language_model, name, value)
    monkeypatch.setattr(language_model, "ROUNDS", 1)
    docs = rows([(i, t, "h", 1, "t") for i, t in data], SCHEMA).repartition(3)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in data if not held(i) for w in [*t.split(), "end"])
    n, v = sum(counts.values()), len(counts)
    found = {r.doc_id: r for r in language_model.scored(docs).collect()}
    assert len(found) == len(data)
    for i, t in data:
        words = [*t.split(), "end"]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        assert (found[i].n_known, found[i].train_tokens) == (sum(w in counts for w in words), n)
        assert found[i].base_score == pytest.approx(base, abs=1e-6)


def test_levels_have_a_bounded_number_of_rows():
    for blocks in (1, 64, 65, 15_000, 50_000_000):
        levels = language_model.tree(blocks, blocks * language_model.BLOCK_BYTES)
        below = [blocks, *(nodes for nodes, _ in levels)]
        assert levels[-1][0] == 1
        assert all(low * buckets <= 40 * blocks for low, (_, buckets) in zip(below, levels, strict=False))


def test_nothing_to_learn_from_leaves_one_event(rows):
    held_id = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = language_model.scored(rows([(held_id, "some words", "", 0, "")], SCHEMA)).collect()
    assert (row.train_tokens, row.n_known, row.n_tokens, row.base_score) == (0, 0, 3, 0.0) and row.score == pytest.approx(0.0, abs=1e-6)


def vocabulary(top=30, once=20):
    counts = [(k + 1, 90 - k) for k in range(top)]
    types, mass = np.zeros(64, np.int64), np.zeros(64, np.int64)
    for c in [c for _, c in counts] + [2] * 7 + [5] * 3 + [1] * once:
        types[int(math.log2(c))] += 1
        mass[int(math.log2(c))] += c
    return language_model.Words(counts, types, mass, int(mass.sum()), int(types.sum())), [c for _, c in counts] + [2] * 7 + [5] * 3 + [1] * once + [0]


def test_the_probabilities_of_all_events_sum_to_one():
    words, counts = vocabulary()
    names = np.array([*range(1, 31), *range(1000, 1000 + len(counts) - 30)], np.uint64)
    number, share = words.places(names, np.array(counts))
    network, n = language_model.Network(words), len(counts)
    # The same history before each event: two-token texts whose second token is the event.
    flat = np.stack([np.full(n, 3), number], axis=1).ravel().astype(np.int32)
    logs = language_model.run(network, flat, np.full(n, 2), np.arange(n))
    assert np.exp(logs[1::2] + share).sum() == pytest.approx(1.0, abs=1e-4)


def test_gradients_are_those_of_the_likelihood():
    words, _ = vocabulary()
    network = language_model.Network(words)
    rng = np.random.default_rng(0)
    sizes = np.array([20, 9, 14])
    number = rng.integers(0, words.size, sizes.sum()).astype(np.int32)

    class Kept:
        def move(self, grads, weight):
            self.grads = {k: v.copy() for k, v in grads.items()}

    kept, scale = Kept(), math.sqrt(len(number))
    language_model.run(network, number, sizes, np.arange(3), kept, 1)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    for name, value in network.p.items():
        at = np.unravel_index(np.argmax(np.abs(kept.grads[name])), value.shape)
        loss = []
        for shift in (1e-4, -2e-4):
            value[at] += shift
            loss.append(-language_model.run(network, number, sizes, np.arange(3)).sum())
        value[at] += 1e-4
        assert kept.grads[name][at] * scale == pytest.approx((loss[0] - loss[1]) / 2e-4, rel=2e-2)


def test_texts_are_scored_whole_whatever_their_lanes():
    words, _ = vocabulary()
    network = language_model.Network(words)
    rng = np.random.default_rng(1)
    sizes = np.array([100, 1, 33, 64, 7])
    number = rng.integers(0, words.size, sizes.sum()).astype(np.int32)
    number[np.cumsum(sizes) - 1] = 0  # every text ends alike
    together = language_model.run(network, number, sizes, np.arange(5))
    at = np.concatenate([[0], np.cumsum(sizes)])
    for k in range(5):
        alone = language_model.run(network, number[at[k] : at[k + 1]], sizes[k : k + 1], np.arange(1))
        assert np.allclose(alone, together[at[k] : at[k + 1]], atol=1e-4)


def test_the_model_learns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_model.scored(docs, stride=1).filter("held_out").collect()
    assert sum(r.score for r in found) > 0.9 * sum(r.base_score for r in found)


def test_every_training_token_gives_a_gradient_as_op3_runs():
    words, _ = vocabulary()
    rng = np.random.default_rng(4)
    sizes = np.array([400, 3, 170, 90, 33])
    number = rng.integers(0, words.size, sizes.sum()).astype(np.int32)

    class Kept:
        learnt = 0

        def move(self, grads, weight):
            self.learnt += weight * language_model.WINDOW * language_model.TRAIN_LANES

    kept = Kept()
    language_model.run(language_model.Network(words), number, sizes, np.arange(5), kept, language_model.STRIDE)
    assert kept.learnt == pytest.approx(sizes.sum())


@pytest.mark.parametrize("distinct", [300, 70_000])
def test_texts_are_split_once(monkeypatch, distinct):
    rng = random.Random(6)
    texts = [" ".join(f"W{rng.randrange(distinct)}" for _ in range(rng.randrange(90))) for _ in range(40)] + [" ".join(f"w{k}" for k in range(distinct)), ""]
    held = [k % 5 == 2 for k in range(len(texts))]
    split = [[*t.lower().split(), "end"] for t in texts]
    want = Counter(w for words, out in zip(split, held, strict=True) if not out for w in words)
    given = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(held), pa.array([t.encode() for t in texts], pa.binary())], names=["doc_id", "held", "text"])
    (block,) = language_model._block([given])
    monkeypatch.setattr(language_model, "tokens", None)  # to split a text again is an error
    number = pa.array([7], pa.int64())
    (sent,) = language_model._send(4)([pa.RecordBatch.from_arrays([number, block["hashes"], block["counts"]], names=["block", "hashes", "counts"])])
    sent = sent.to_pylist()
    assert sorted(n for row in sent for n in language_model._counts(row["counts"]).tolist() if n) == sorted(want.values())
    assert {(row["child"], row["bucket"]) for row in sent} == {(7, k) for k in range(4)}
    vocabulary_of, _ = vocabulary()
    answers = pa.array([[{"bucket": row["bucket"], "counts": row["counts"]} for row in reversed(sent)]])
    read = pa.RecordBatch.from_arrays([number, *(block[c] for c in ("doc_ids", "held", "sizes", "hashes", "numbers")), answers], names=["block", "doc_ids", "held", "sizes", "hashes", "numbers", "answers"])
    (row,) = (x for batch in language_model._number(vocabulary_of, 4)([read]) for x in batch.to_pylist())
    assert (row["block"], row["doc_ids"], row["held"]) == (7, list(range(len(texts))), held)
    assert row["sizes"] == [len(words) for words in split]
    assert row["known"] == [sum(w in want for w in words) for words in split]
    whole = vocabulary_of.n + vocabulary_of.v + 1
    assert row["base"] == pytest.approx([sum(math.log10((want[w] + 1) / whole) for w in words) for words in split])


def test_only_six_bytes_part_words():
    rng = random.Random(8)
    texts = [bytes(range(256)), b"", b" ", b"\n\n", b"A\x00 a\x00", b"\xc3\x89 \xc3\xa9", b"\x1cA\x1f \x85a\xa0"]
    texts += [bytes(rng.choice(b" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0aAzZ@[\x00\xff") for _ in range(rng.randrange(40))) for _ in range(300)]
    for part in (texts, texts[1:2], texts[:1]):
        names, flat, sizes = language_model.tokens(part)
        want = [[*re.findall(rb"[^\x20\x09-\x0D]+", t.translate(language_model.FOLD)), b"\n"] for t in part]
        assert [names[k] for k in flat] == [w for words in want for w in words] and len(set(names)) == len(names)
        assert sizes.tolist() == [len(words) for words in want]


def test_scoring_goes_on_in_longer_windows_when_lanes_end():
    words, _ = vocabulary()
    rng = np.random.default_rng(7)
    sizes = np.array([2000, *[20] * 400, 700])
    number = rng.integers(0, words.size, sizes.sum()).astype(np.int32)
    number[np.cumsum(sizes) - 1] = 0

    class Counted(language_model.Network):
        calls, most = 0, 0

        def steps(self, given, *rest):
            self.calls, self.most = self.calls + 1, max(self.most, given.size)
            return super().steps(given, *rest)

    network = Counted(words)
    found = language_model.run(network, number, sizes, np.arange(len(sizes)))
    assert network.calls < 10 and network.most <= language_model.WINDOW * language_model.LANES
    at = np.concatenate([[0], np.cumsum(sizes)])
    for k in (0, 5, 401):
        alone = language_model.run(network, number[at[k] : at[k + 1]], sizes[k : k + 1], np.arange(1))
        assert np.allclose(alone, found[at[k] : at[k + 1]], atol=1e-4)


def test_the_model_learns_as_op3_runs(spark):
    found = language_model.scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in found) > 0.9 * sum(r.base_score for r in found)


# Quality


def test_grades_are_learnt_and_held_out_documents_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = quality.ratings(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    model = quality.fitted(docs, labels.filter("doc_id % 4 > 0"), quality.GRADES)
    told = quality.graded(docs, model).join(labels.filter("doc_id % 4 = 0"), "doc_id").collect()
    keep = {g: np.mean([r.tails[0] >= quality.KEEP_SHARE for r in told if r.grade == g]) for g in (0, 2)}
    assert len(told) > 500 and keep[2] > 0.99 and keep[0] < 0.2
    means = [np.mean([r.expected_grade for r in told if r.grade == g]) for g in range(3)]
    assert means == sorted(means)
    assert all(r.tails[0] >= r.tails[1] for r in told)


def test_odd_ratings_and_texts_have_their_results(rows, spark):
    docs = rows([(1, None, "a", 1, "t"), (1, None, "a", 1, "t"), (2, "", "b", 2, "t"), (None, "x " * 20000, "c", 3, "t"), (4, "fine words", "d", 4, "t")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, grade int")
    for ratings in (none, spark.createDataFrame([(4, 2), (4, 2), (None, 0), (2, None), (2, 9)], "doc_id long, grade int")):
        model = quality.fitted(docs, ratings, 3)
        assert [r.expected_grade for r in quality.graded(docs, model).collect()] == [2.0] * 5
        left = quality.accepted(docs, model)
        assert left.columns == docs.columns and left.count() == 5
    model = quality.fitted(docs, spark.createDataFrame([(4, 2), (2, 0), (1, 1)], "doc_id long, grade int"), 3)
    assert quality.graded(docs, model).count() == 5
    assert quality.graded(spark.createDataFrame([], SCHEMA), model).count() == 0
