import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from basketlens.llm import packing

SCHEMA = "doc_id long, text string, rank int, piece string"


def whole(text):
    return Tokenizer.from_file(packing.vocabulary()).encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def test_pieces_cover_each_document_once_and_sequences_have_no_gaps(rows):
    texts = [None, "", "one two", "one two", "x" * 9000, "word " * 5000, "tie " * 10, "tie " * 10, "\x85é ́ ß"]
    docs = rows([(k if k != 3 else 2, t, 7, "p") for k, t in enumerate(texts)] + [(None, "no id", 1, "p")], SCHEMA)
    size = 64
    found = packing.packed(docs, size=size).collect()
    want = sorted((len(whole(t))) for t in [*texts, "no id"])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for row in found:
        ids = np.frombuffer(row.ids, "<u4").tolist()
        assert row.length == len(ids) and row.ids_crc32 == zlib.crc32(row.ids)
        by_sequence[row.sequence_id].append((row.offset, row.length))
        by_doc[row.doc_id].append((row.start, ids))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    for k, text in enumerate(texts):
        if k not in (2, 3):
            assert [i for _, ids in sorted(by_doc[k]) for i in ids] == whole(text)
    assert len(by_doc[2]) == 2 and by_doc[2][0][1] == by_doc[2][1][1] == whole("one two")
    assert by_doc[None][0][1] == whole("no id")
    assert sum(row.length for row in found) == sum(want)


def test_empty_table_and_one_length(rows, spark):
    assert packing.packed(spark.createDataFrame([], SCHEMA)).count() == 0
    found = packing.packed(rows([(k, "a b c", 0, "") for k in range(5000)], SCHEMA), size=12, with_ids=False).collect()
    assert len({row.sequence_id for row in found}) == 5000 // 3 + 1
    assert len({(row.sequence_id, row.offset) for row in found}) == 5000


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 400), max_size=40))
def test_patterns_place_every_length(histogram):
    plan, placed = packing.patterns(histogram, 64), defaultdict(int)
    for pattern, count in plan:
        assert sum(length * times for length, times in pattern) <= 64
        for length, times in pattern:
            placed[length] += times * count
    assert dict(placed) == histogram
    assert len(plan) <= 128


def test_little_padding():
    rng = np.random.default_rng(1)
    histogram = dict(zip(*(x.tolist() for x in np.unique(rng.integers(1, 2048, 20000), return_counts=True)), strict=True))
    plan = packing.patterns(histogram, 2048)
    used = sum(length * n for length, n in histogram.items())
    assert used / (2048 * sum(n for _, n in plan)) > 0.98


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"aB'sTé́ßΣİ1² \t\n\x0b\x85 .,!#<|>", "don't", "<|endoftext|>", "I'LL"]), max_size=40).map("".join))
def test_words_give_the_ids_of_whole_texts(text):
    if "tokens" not in test_words_give_the_ids_of_whole_texts.__dict__:
        test_words_give_the_ids_of_whole_texts.tokens = packing.Encoder(packing.vocabulary())
    encoder = test_words_give_the_ids_of_whole_texts.tokens
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([8, 16, 64]), st.dictionaries(st.integers(1, 63), st.integers(1, 30), max_size=12))
def test_each_piece_goes_into_the_shortest_pack(size, histogram):
    histogram = {length: n for length, n in histogram.items() if length < size}
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            if rooms and max(rooms) >= length:
                rooms[rooms.index(max(rooms))] -= length
            else:
                rooms.append(size - length)
    plan = packing.patterns(histogram, size)
    assert sorted(rooms) == sorted(size - sum(length * n for length, n in pattern) for pattern, count in plan for _ in range(count))


def test_the_shortest_pack_not_the_fullest():
    assert packing.patterns({1500: 1, 1000: 1, 500: 1}, 2048) == [([(1500, 1)], 1), ([(1000, 1), (500, 1)], 1)]
