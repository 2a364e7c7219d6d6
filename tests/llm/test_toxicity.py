import zlib

import numpy as np
import pytest

from basketlens.llm import toxicity

DOCS = "doc_id long, text string, score double, toxicity string"
RATINGS = "doc_id long, toxic int, quality int"
STEMS = ("ugh", "gronk")


def corpus(rng, n, first=0):
    syllables = ["an", "he", "ti", "or", "ly", "the", "es", "in"]
    docs, marks = [], []
    for k in range(n):
        words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(rng.integers(20, 200))]
        toxic = bool(rng.random() < 0.25)
        if toxic:
            for _ in range(max(3, len(words) // 30)):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(STEMS)) + "".join(rng.choice(syllables, rng.integers(0, 2))))
        docs.append((first + k, " ".join(words), 0.0, "clash"))
        marks.append(toxic)
    return docs, marks


def test_toxic_documents_are_found_and_others_left_alone(rows):
    docs, toxic = corpus(np.random.default_rng(5), 900)
    extra = [(None, docs[0][1], 0.0, ""), (5000, None, 0.0, ""), (5001, "", 0.0, ""), (5002, "gronk " * 50_000, 0.0, ""), (0, "an he", 0.0, "")]
    table = rows(docs + extra, DOCS)
    ratings = rows([(d[0], int(t), 1) for d, t in zip(docs, toxic, strict=True)] + [(None, 1, 1), (1, None, 1), (77777, 1, 1)], RATINGS)
    model = toxicity.fitted(table.select("doc_id", "text"), ratings)
    got = toxicity.scored(table, model)
    assert sorted(got.columns) == sorted(table.columns)
    found = got.select("doc_id", "text", "toxicity", toxicity.held_out(got.doc_id).alias("out")).collect()
    assert len(found) == len(docs) + len(extra)
    mark = dict(zip([d[0] for d in docs], toxic, strict=True))
    held = [row for row in found if row.out and row.doc_id < 900]
    assert {row.doc_id for row in held} == {d[0] for d in docs if zlib.crc32(str(d[0]).encode()) % 4 == 2}
    hits = [(row.toxicity >= toxicity.PREDICT_AT) == mark[row.doc_id] for row in held]
    assert np.mean(hits) > 0.95
    blank = {row.toxicity for row in found if not row.text}
    assert blank == {model.share}
    assert [row.toxicity for row in found if row.doc_id == 5002][0] > 0.9
    assert all(0 <= row.toxicity <= 1 for row in found)


def test_held_out_ratings_are_not_learnt(rows):
    docs, toxic = corpus(np.random.default_rng(6), 200)
    table = rows(docs, DOCS)
    rated = [(d[0], int(t), 1) for d, t in zip(docs, toxic, strict=True)]
    turned = [(d, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t, q) for d, t, q in rated]
    models = [toxicity.fitted(table.select("doc_id", "text"), rows(r, RATINGS)) for r in (rated, turned)]
    assert models[0].weights.tolist() == models[1].weights.tolist()


def test_without_both_classes_the_share_is_all_there_is(rows, spark):
    docs = rows([(k, "one two", 0.0, "") for k in range(8)], DOCS)
    model = toxicity.fitted(docs, rows([(0, 0, 0), (1, 0, 0), (1, 0, 0)], RATINGS))
    rated = sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in (0, 1))
    assert {row.toxicity for row in toxicity.scored(docs, model).collect()} == {1 / (rated + 2)}
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.scored(empty, toxicity.fitted(empty, spark.createDataFrame([], RATINGS))).count() == 0


def test_both_models_are_distributions():
    """Over all next bytes after any context the probabilities sum to one, apart from slots that meet."""
    words = [b"trash", b"the", b"thin", b"other", "été".encode()]
    models = toxicity.Models(words, np.array([[0, 9, 4, 2, 1], [5, 3, 0, 0, 1]]), 0.75)
    for before in (b"", b"t", b"th", b"tra"):
        total = [0.0, 0.0]
        for byte in range(256):
            run = np.frombuffer(b" " + before + bytes([byte]), np.uint8)
            chance = [1 / 256, 1 / 256]
            hashes = [np.uint64(0)]
            for size in range(1, min(toxicity.ORDER, len(run)) + 1):
                value = np.uint64(0)
                context = np.uint64(0)
                with np.errstate(over="ignore"):
                    for b in run[-size:]:
                        context = value
                        value = value * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b) + np.uint64(1)
                own, of = toxicity.slot(np.array([value]))[0], toxicity.slot(np.array([context]))[0]
                for side in (0, 1):
                    chance[side] = models.share[side][size - 1][own] + models.keep[side][size - 1][of] * chance[side]
            total = [total[0] + chance[0], total[1] + chance[1]]
        assert total == pytest.approx([1, 1], abs=1e-3)
