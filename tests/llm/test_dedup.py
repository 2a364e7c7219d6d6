import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from basketlens.llm import chunk_dedup, near_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, row string, `class` int, key string"


def framed(rows, data):
    return rows([(i, t, "x", 1, "k") for i, t in data], SCHEMA)


# Exact dedup


def test_equal_texts_meet_whatever_their_case_length_and_id(rows):
    long = "".join(random.Random(1).choices("abcdefgh \n", k=60_000))
    data = [(1, "Ab é"), (2, "aB é"), (3, "ab É"), (4, None), (5, ""), (6, long), (7, long.upper()), (8, long + "x"), (9, "Ab é"), (9, "Ab é"), (None, "ab é")]
    found = defaultdict(list)
    for row in chunk_dedup.exact_groups(framed(rows, data)).collect():
        found[row.doc_id].append((row.keep_id, row.group_size, row.kept))
    assert found[1] == found[2] == found[None] == [(9, 5, False)]
    assert sorted(found[9]) == [(9, 5, False), (9, 5, True)]
    assert found[3] == [(3, 1, True)] and found[8] == [(8, 1, True)]
    assert found[4] == [(5, 2, False)] and found[5] == [(5, 2, True)]
    assert found[6] == [(7, 2, False)] and found[7] == [(7, 2, True)]
    left = chunk_dedup.deduplicated(framed(rows, data))
    assert left.columns == ["doc_id", "text", "row", "class", "key"]
    assert sorted(r.doc_id for r in left.collect()) == [3, 5, 7, 8, 9]


def test_exact_dedup_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chunk_dedup.exact_groups(none).count() == chunk_dedup.deduplicated(none).count() == 0


def test_colliding_chunks_tell_texts_apart(rows, spark, monkeypatch):
    class Weak:
        def __init__(self, data):
            self.data = data

        def digest(self):
            return bytes([len(self.data) % 2])

        def hexdigest(self):
            return hashlib.sha256(self.data).hexdigest()

    monkeypatch.setattr(chunk_dedup.hashlib, "sha256", Weak)
    gear = np.arange(256, dtype=np.uint32)
    monkeypatch.setattr(chunk_dedup, "gear_table", lambda: gear)
    found = {r.doc_id: r.keep_id for r in chunk_dedup.exact_groups(framed(rows, [(1, "aa"), (2, "bb"), (3, "AA"), (4, "c")])).collect()}
    assert found == {1: 3, 2: 2, 3: 3, 4: 4}


def test_cuts_follow_content():
    gear, rng = chunk_dedup.gear_table(), random.Random(2)
    one = bytes(rng.choices(range(97, 123), k=80_000))
    two = b"prefix" * 50 + one
    pieces = [{d[a:b] for a, b in zip([0, *e[:-1]], e, strict=True)} for d, e in ((one, chunk_dedup.cuts(one, gear)), (two, chunk_dedup.cuts(two, gear)))]
    assert len(pieces[0] & pieces[1]) > 0.7 * len(pieces[0])
    assert max(map(len, pieces[0])) <= chunk_dedup.MAX_CHUNK and b"".join([]) == b""


# Near dedup


def brute_classes(data):
    items = []
    for _, text in data:
        words = (text or "").lower().split()
        width = max(1, min(5, len(words)))
        items.append(Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else Counter())
    label = list(range(len(data)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            low, high = sum((items[i] & items[j]).values()), sum((items[i] | items[j]).values())
            if 5 * low >= 4 * high:
                label[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(data)):
        groups[top(i)].append(data[i][0])
    return {x: min(g) for g in groups.values() for x in g}


def test_classes_are_those_of_all_pairs(rows):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(n)] for n in (200, 120, 400)]
    data = [(100, None), (101, ""), (102, "one"), (103, "One"), (104, "one two"), (105, "again " * 300), (106, "again " * 320), (107, "again " * 900)]
    for k in range(140):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 1, 2, 4, 8))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        data.append((k - 40, " ".join(words)))
    data = [(i, t) for i, t in data if i not in range(100, 108) or i >= 100]
    seen, unique = set(), []
    for i, t in data:
        if i not in seen:
            unique.append((i, t))
            seen.add(i)
    found = near_dedup.near_groups(framed(rows, unique)).collect()
    want = brute_classes(unique)
    assert {r.doc_id: r.class_id for r in found} == want
    assert Counter(r.class_id for r in found if r.kept) == Counter(set(want.values()))
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] for r in found)


def test_near_dedup_of_repeated_rows_and_of_nothing(rows, spark):
    left = near_dedup.deduplicated(framed(rows, [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "d")]))
    assert left.columns == ["doc_id", "text", "row", "class", "key"]
    assert sorted((r.doc_id is not None, r.text) for r in left.collect()) == [(False, "a b c"), (True, "d")]
    assert near_dedup.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("most", [1, 3, 40])
def test_signature_agreement_is_the_weighted_similarity(most):
    rng = np.random.default_rng(most)
    names = near_dedup.mix(np.arange(80, dtype=np.uint64))
    one, two = rng.integers(0, most + 1, 80), rng.integers(0, most + 1, 80)
    two[:40] = one[:40]
    want = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    a, b = near_dedup.signatures([(names[w > 0], w[w > 0]) for w in (one, two)], 6000)
    assert abs((a == b).mean() - want) < 0.03


# Repeated passages


def brute_cut(data):
    seen, out = set(), {}
    for name, text in sorted(data):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for x in range(len(body) - 99):
            part = body[x : x + 100]
            if part in seen:
                gone[x : x + 100] = b"\1" * 100
            seen.add(part)
        rest = bytes(c for c, g in zip(body, gone, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[name] = (len(body), sum(gone), runs, hashlib.sha256(rest).hexdigest())
    return out


def test_cuts_are_those_of_all_strings(rows, monkeypatch):
    rng = random.Random(6)
    some = lambda n: " ".join(rng.choice(["red", "blue", "é", "of it", "longer"]) for _ in range(n))
    passages = [some(30), some(40), "ab" * 120, "z" * 260]
    data = [(0, None), (1, "")]
    for k in range(2, 90):
        parts = [rng.choice((some(rng.randint(1, 10)), rng.choice(passages), rng.choice(passages)[: rng.randint(95, 130)])) for _ in range(rng.randint(0, 6))]
        data.append((k * 7 % 97, " ".join(parts)))
    data = list(dict(data).items())
    found = suffix_dedup.cut_repeats(framed(rows, data)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == brute_cut(data)


def test_an_anchor_of_very_many_strings_is_dealt_out(rows, monkeypatch):
    limit, whole = 400, suffix_dedup.covered_strings

    def few(ids, tags, lows, highs, bodies):
        if sum(h - a + 1 for a, h in zip(lows, highs, strict=True)) > 2 * limit + 100:
            raise ValueError("more strings in a task than it may hold")
        return whole(ids, tags, lows, highs, bodies)

    monkeypatch.setattr(suffix_dedup, "STRINGS", limit)
    monkeypatch.setattr(suffix_dedup, "covered_strings", few)
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgh", k=130))
    ends = ["".join(rng.choices("xyz", k=rng.randint(5, 60))) for _ in range(12)]
    data = [(k, "".join(rng.choices("mnop", k=rng.randint(0, 50))) + passage + rng.choice(ends) + str(k)) for k in range(150)]
    found = suffix_dedup.cut_repeats(framed(rows, data)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == brute_cut(data)


def test_repeated_and_missing_ids_have_their_order(rows, spark):
    text = "".join(random.Random(3).choices("abc ", k=300))
    found = suffix_dedup.cut_repeats(framed(rows, [(5, text), (5, text), (None, text), (6, text[:150])])).collect()
    cut = sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in found)
    assert cut == [(False, 0, 0), (True, 5, 300), (True, 5, 300), (True, 6, 150)]
    assert suffix_dedup.cut_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_are_searched_in_overlapping_pieces(rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 4096)
    text = "".join(random.Random(5).choices("abcd", k=9000))
    data = [(1, text), (2, text[3500:4700] + "#" + text[8000:8099])]
    found = suffix_dedup.cut_repeats(framed(rows, data)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == brute_cut(data)


def test_multikey_groups():
    rng = np.random.default_rng(0)
    strings = rng.integers(0, 2, (500, 11)).astype(np.uint8)
    group = suffix_dedup.multikey_groups(strings)
    names = [s.tobytes() for s in strings]
    assert len({(g, n) for g, n in zip(group, names, strict=True)}) == len(set(names)) == len(set(group.tolist()))
