import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basketlens.llm import hard_negatives, lexical

DOCS = "doc_id long, text string, df int, block string"
ITEMS = "item_id long, text string, weight int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    held = [(row[0], Counter(words(row[1]))) for row in docs if words(row[1])]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(term for _, c in held for term in c)
    out = []
    for item, text, *_ in items:
        scores = []
        for place, (doc, counts) in enumerate(held):
            m = 10 + 90 * sum(counts.values()) * n_docs // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * counts[t] // (1000 * counts[t] + 8 * m))
                for t in set(words(text)) if counts[t]
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0, place, doc))
        out += [(item, rank, doc, -score) for rank, (score, *_, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def searched(docs, items, k=3):
    return sorted([tuple(row) for row in lexical.top_k(lexical.Index(docs), items, k).select("item_id", "rank", "doc_id", "score").collect()], key=str)


TEXTS = [None, "", " .,!", "Tie tie TIE", "tie tie tie", "tie tie tie", "straße İ ﬁ x\x00y Z9_z", "one two three", "long " * 9000 + "one", "two two", "émile two"]
ASKED = [(1, "TIE two", 0), (2, "straße z9 ﬁ y", 0), (3, None, 0), (4, "unknown words", 0), (5, "one one two long", 0), (6, "z émile", 0)]


@pytest.mark.parametrize("cells", [3, 1 << 19])
def test_lexical_search_equals_scoring_every_document(rows, monkeypatch, cells):
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "FAN", 2)
    monkeypatch.setattr(lexical, "TILE", 2)
    docs = [(10 - k if k != 4 else 4, text, 0, "b") for k, text in enumerate(TEXTS)] + [(None, "tie tie tie", 0, "b")]
    assert searched(rows(docs, DOCS), rows(ASKED, ITEMS)) == ranked(docs, ASKED, 3)
    assert len(searched(rows(docs, DOCS), rows(ASKED, ITEMS), 20)) == len(ranked(docs, ASKED, 20))


def test_lexical_search_of_empty_tables_and_repeated_items(rows, spark):
    none = spark.createDataFrame([], DOCS)
    assert searched(none, rows(ASKED, ITEMS)) == []
    assert searched(rows([(1, "a", 0, "")], DOCS), spark.createDataFrame([], ITEMS)) == []
    found = searched(rows([(1, "a", 0, ""), (2, "b", 0, ""), (3, "c", 0, "")], DOCS), rows([(7, "b", 0), (7, "a", 0), (None, "a", 0)], ITEMS))
    assert [row[:3] for row in found] == [(7, 1, 1)]


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 60), st.integers(1, 12), st.integers(1, 900))
def test_tree_search_equals_all_columns(seed, height, width, k, most):
    rng = np.random.default_rng(seed)
    grid = (rng.random((height, width)) < rng.random()) * rng.integers(1, most + 1, (height, width))
    row, column = np.nonzero(grid)
    if not len(row):
        return
    asked = rng.permutation(np.unique(row))[: rng.integers(1, 8)]
    weights = rng.integers(1, 5, len(asked))
    tree = lexical.Tree(lexical.build_tree(row, column, grid[row, column]))
    columns, scores = lexical.search_tree(tree, asked, weights, k)
    whole = weights @ grid[asked]
    want = [c for c in np.lexsort((np.arange(width), -whole)) if whole[c] > 0][:k]
    assert columns.tolist() == want and scores.tolist() == whole[want].tolist()


def test_lexical_blocks_travel_packed_and_few_files_are_written(rows, spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [(k, " ".join(f"w{n}" for n in rng.zipf(1.3, 200) % 20_000), 0, "") for k in range(400)]
    written, kept = [], lexical.kept
    monkeypatch.setattr(lexical, "kept", lambda frame, name, *a, **b: written.append(name) or kept(frame, name, *a, **b))
    before = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "150")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        index = lexical.Index(rows(data, DOCS, 2))
        assert len(index.frequencies.inputFiles()) <= 64
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(row.df for row in index.frequencies.collect() if row.term) == (cells := sum(len(set(words(row[1]))) for row in data))
    blocks = index.blocks.collect()
    assert sum(len(value) for row in blocks for value in row if isinstance(value, (bytes, bytearray, str))) < 8 * cells
    assert len(blocks) == 2 and written == ["lexical-df"]


VECTORS = "vec_id long, embedding array<float>, label int, q int, leaf string"


def mined(vectors, anchors, positives=5, negatives=3):
    fine = [
        (v, label, [math.floor(256 * float(np.float32(c))) for c in x]) for v, x, label, *_ in vectors
        if v is not None and label is not None and x and all(c is not None and math.isfinite(c) for c in x)
    ]
    out = []
    for a, label, x in fine:
        if a not in anchors:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), v, other == label) for v, other, y in fine if v != a and len(y) == len(x))
        for score, positive, _ in [s for s in scored if s[2]][:positives]:
            fits = [s for s in scored if not s[2] and 50 * -score <= 100 * -s[0] <= 95 * -score][:negatives]
            out += [(a, positive, rank, v, -score, -s) for rank, (s, v, _) in enumerate(fits, 1)]
    return sorted(out)


def found_in(frame, anchors, **built):
    found = hard_negatives.hard_negatives(frame.filter(frame.vec_id.isin(anchors)), frame, **built)
    return sorted(tuple(row) for row in found.collect())


@pytest.mark.parametrize("scale", [1.0, 3e5])
def test_hard_negatives_equal_scoring_every_pair(rows, monkeypatch, scale):
    """Many leaves, blocks of few rows, a third of the rows one vector, ties, faulty rows, another width, products beyond 2**53."""
    for name, value in (("BLOCK", 16), ("TILE", 3), ("FAN", 3), ("WAYS", 4), ("HELD", 40)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(6, 5))[rng.integers(0, 6, 180)] + 0.3 * rng.normal(size=(180, 5))) * scale
    x[::3] = x[0]
    data = [(k, [float(c) for c in row], int(k % 4), 0, "") for k, row in enumerate(x)]
    data += [(900, None, 1, 0, ""), (901, [], 1, 0, ""), (902, [1.0, None, 1.0, 1.0, 1.0], 1, 0, ""), (903, [float("nan")] * 5, 1, 0, "")]
    data += [(904, [1.0] * 5, None, 0, ""), (None, [1.0] * 5, 1, 0, ""), (905, [1.0, 2.0], 1, 0, ""), (906, [2.0, 1.0], 1, 0, ""), (907, [1.8, 1.0], 2, 0, "")]
    anchors = [0, 7, 33, 50, 100, 905, 904]
    assert found_in(rows(data, VECTORS), anchors, leaf=8) == mined(data, anchors)


def test_a_few_rows_and_an_empty_table(rows, spark):
    assert found_in(spark.createDataFrame([], VECTORS), [1]) == []
    few = [(1, [1.0, 0.0], 1, 0, ""), (2, [1.0, 0.1], 1, 0, ""), (3, [0.9, 0.0], 2, 0, ""), (4, [-1.0, 0.0], 2, 0, ""), (3, [0.9, 0.0], 2, 0, "")]
    assert found_in(rows(few, VECTORS), [1, 4]) == [(1, 2, 1, 3, 65536, 58880)]


def test_shells_eliminate_what_lies_far_off():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(16, 3)) * 4000
    rows = np.floor(centres[rng.integers(0, 16, 4000)] + rng.normal(size=(4000, 3)) * 20)
    tree = hard_negatives.Tree(rows.astype(np.int64), 16)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4000)), pa.array(np.zeros(4000, np.int64)), pa.array(list(rows.astype(np.int64)))], names=["vec_id", "label", "q"])
    ranges = hard_negatives.Ranges([r for r in list(hard_negatives._ranger({3: tree})([batch]))[0].to_pylist() if r["node"] >= 0], {3: tree})
    leaf, _ = tree.descend(rows)
    scores = rows[:50] @ rows.T
    best = np.sort(scores, 1)[:, -6]
    reached = hard_negatives.leaves_reached(tree, ranges, 3, rows[:50], best.astype(np.int64)[:, None], np.full((50, 1), 2**62))
    for a in range(50):
        assert reached[a, np.unique(leaf[scores[a] >= best[a]])].all()
    assert reached.mean() < 0.4
