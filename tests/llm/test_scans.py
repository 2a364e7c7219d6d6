import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from basketlens.llm import exact_topk, license_scan, licenses, mixing, warc

# Mixing

DOCS = "doc_id long, text string, source string, copy int, cdf string"


def test_copies_meet_the_target_and_draws_repeat(rows):
    data = [(k, "x" * 10, "big" if k % 3 else f"s{k % 5}", 7, "c") for k in range(3000)]
    found = mixing.mixed(rows(data, DOCS), weights={"big": 1.0, "s0": 1.0, "s1": 2.0}).collect()
    sizes = Counter(r.source for r in found)
    assert set(sizes) == {"big", "s0", "s1"}, "sources without a weight get none"
    for name, share in (("big", 1 / 4), ("s0", 1 / 4), ("s1", 1 / 2)):
        assert abs(sizes[name] - 3000 * share) < 5 * math.sqrt(3000 * share)
    again = mixing.mixed(rows(data, DOCS, 7), weights={"big": 1.0, "s0": 1.0, "s1": 2.0}).collect()
    assert sorted((r.doc_id, r["copy"], r.shuffle_key) for r in found) == sorted((r.doc_id, r["copy"], r.shuffle_key) for r in again)
    assert len({r.shuffle_key for r in found}) == len(found)


def test_high_rates_are_drawn_in_parts_and_odd_rows_stand(rows, spark, monkeypatch):
    data = [(1, "a", "rare", 1, "c"), (2, None, "rare", 1, "c"), (None, "bb", None, 1, "c"), (3, "cc", None, 1, "c"), (3, "cc", None, 1, "c"), (4, "", "void", 1, "c")]
    found = mixing.mixed(rows(data, DOCS), power=1.0, target=40_000).collect()
    each = Counter((r.doc_id, r.source) for r in found)
    # Rates of 40,000 over 9 characters: more than exp can hold in one part.
    assert all(abs(each[k] / n - 40_000 / 7) < 500 for k, n in (((1, "rare"), 1), ((2, "rare"), 1), ((None, None), 1), ((3, None), 2)))
    assert "void" not in {r.source for r in found}
    assert mixing.mixed(spark.createDataFrame([], DOCS)).count() == 0
    bare = mixing.mixed(rows(data, DOCS), marks=False)
    assert bare.columns == ["doc_id", "text", "source", "copy", "cdf"]
    want = sorted(map(str, (tuple(r) for r in bare.collect())))
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    assert sorted(map(str, (tuple(r) for r in mixing.mixed(rows(data, DOCS), marks=False).collect()))) == want


# Licences


def rewrapped(text, width):
    """Paragraphs filled to a width, those of lists line by line; paragraphs with notices stay, as those are told by their line."""
    out = []
    for part in re.split(r"\n[ \t]*\n", text):
        if re.search(r"copyright (\(c\)|\[|<)", part, re.I):
            out.append(part)
            continue
        by_line = re.search(r"\n[ \t]*([*+-]|\(?[0-9a-z][.)])[ \t]", part, re.I)
        lines = part.split("\n") if by_line else [part]
        out.append("\n".join(textwrap.fill(x, width, break_long_words=False, break_on_hyphens=False) for x in lines))
    return "\n\n".join(out)


def test_known_texts_are_found_at_any_width(rows):
    data = [(k, width, rewrapped(text, width)) for k, text in licenses.KNOWN.items() for width in (44, 60, 66, 72, 79, 100)]
    frame = rows([(f"{k}@{width}", text) for k, width, text in data], "doc_id string, text string")
    stands = {r.doc_id: r.license_id for r in license_scan.scan(rows(list(licenses.KNOWN.items()), "doc_id string, text string")).collect()}
    assert None not in stands.values()
    found = {r.doc_id: r.license_id for r in license_scan.scan(frame).collect()}
    assert {k: v for k, v in found.items() if v != stands[k.split("@")[0]]} == {}


def test_wrapped_lines_are_no_notices_and_entire_texts_are_known(rows):
    isc = "Copyright The Authors\n\n" + licenses.KNOWN["ISC"].replace("the above copyright", "the above\ncopyright")
    bsd = licenses.KNOWN["BSD-3-Clause"].replace("reproduce the above copyright", "reproduce the above\ncopyright").replace("OR COPYRIGHT", "OR\nCOPYRIGHT")
    data = [("ISC", isc), ("BSD-3-Clause", "Copyright 2020, X\n" + bsd), ("BSD-2-Clause (titled)", "BSD 2-Clause License\n\n(c) 2011-2020 Y\n\n" + licenses.KNOWN["BSD-2-Clause"])]
    data += [(k, licenses.KNOWN.get(k, "")) for k in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0")]
    found = license_scan.scan(rows(data, "doc_id string, text string")).collect()
    assert {r.doc_id: r.license_id for r in found} == {k: k for k, _ in data}


def test_spelling_case_marks_and_notices_dont_count(rows, spark):
    mit = licenses.MIT
    data = [
        (1, mit), (2, mit.upper().replace("\n\n", "\n * ")), (3, mit.replace("<year> <copyright holders>", "2019 A. Person, all rights reserved")),
        (4, mit.replace("sublicense", "SUB-LICENCE").replace('"', "“")), (5, mit + "More."), (6, None), (7, "Copyright (c) 2020 X\n...\n"), (8, licenses.BSD_GRANT + licenses.BSD_DISCLAIMER),
        (8, "released under the mit license"), (9, "x " * 50_000),
    ]
    found = license_scan.scan(rows([(i, t, "id", 1) for i, t in data], "doc_id long, text string, license_id string, license_digest int")).collect()
    told = {r.doc_id: r.license_id for r in found if r.doc_id != 8}
    assert told == {1: "MIT", 2: "MIT", 3: "MIT", 4: "MIT", 5: None, 6: None, 7: None, 9: None}
    assert sorted(r.license_id for r in found if r.doc_id == 8) == ["BSD-2-Clause", "MIT (line)"]
    assert {r.doc_id for r in found if r.text_digest is None} == {6, 7}
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Exact top-k

VECTORS = "vec_id long, embedding array<float>, block int, ids string"


def brute(data, k=5):
    clean = {}
    for i, v in data:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            clean[i] = min(clean.get(i, v), v)
    ints = {i: [math.floor(256 * x) for x in map(float, v)] for i, v in clean.items()}
    out = []
    for q, a in ints.items():
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ints.items() if i != q and len(a) == len(b))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block, tile", [(8192, 512), (7, 2)])
def test_tiles_find_what_all_products_find(rows, spark, monkeypatch, block, tile):
    monkeypatch.setattr(exact_topk, "BLOCK", block)
    monkeypatch.setattr(exact_topk, "TILE", tile)
    rng = np.random.default_rng(3)
    data = [(k, [float(np.float32(x)) for x in rng.integers(-2, 3, 6) / 4]) for k in range(140)]
    data += [(150, None), (200, [float("nan")] * 6), (201, [1.0, None] * 3), (202, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (250, []), (300, [1.0, 2.0]), (301, [2.0, 1.0]), (5, data[5][1])]
    frame = rows([(i, v, 1, "x") for i, v in data], VECTORS)
    found = exact_topk.top_k(frame.filter("vec_id % 50 = 0"), frame)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == brute(data)
    none = spark.createDataFrame([], VECTORS)
    assert exact_topk.top_k(none, none).count() == 0


def test_large_numbers_stay_exact():
    big = np.array([[2**31 - 1, -(2**31)]]), np.array([[2**31 - 3, 5], [1, 1]])
    assert exact_topk.products(*big).tolist() == [[(2**31 - 1) * (2**31 - 3) - 5 * 2**31, -1]]


# WARC

PAGES = "page_id long, url string, html string, digest string, first int"


def test_archives_give_back_what_was_written(rows, spark, tmp_path):
    rng = random.Random(1)
    long = "é" * 600
    noise = "".join(rng.choices("abcdefghijklmnop", k=200_000))
    data = [(1, "http://a b\r\nX: y", long), (2, None, long), (3, "u", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", noise), (8, "u", "\r\n\r\nWARC/1.1\0"), (None, "u", long), (9, "u", "z" * 999), (10, "u", "z" * 999), (3, "u", long)]
    pages = rows([(i, u, h, "d", 1) for i, u, h in data], PAGES)
    warc.write(pages, str(tmp_path / "w"))
    files = list((tmp_path / "w").glob("part-*"))
    raw = b"".join(f.read_bytes() for f in files)
    assert sum(1 for _ in warc.members(iter([raw]))) == len(data) == sum(1 for _ in warc.members(raw[k : k + 7] for k in range(0, len(raw), 7)))
    found = warc.read(spark, str(tmp_path / "w")).collect()
    html = dict((i, (h or "").encode()) for i, _, h in data)
    for row in found:
        body = html[row.page_id]
        assert row.digest_ok and (row.payload_bytes, row.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        revisit = row.page_id in (1, 2, None)
        assert (row.record_type, row.refers_to) == (("revisit", 3) if revisit else ("response", None))
        assert row.payload is None if revisit else row.payload == body
    assert sorted(str(r.page_id) for r in found) == sorted(str(i) for i, _, _ in data)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_files_are_cut_by_bytes_however_long_the_pages(rows, spark, tmp_path):
    rng = random.Random(4)
    data = [(k, "u", "".join(rng.choices("abcdefghijklmnop", k=size))) for k, size in enumerate([50, 30_000, 100, 0, 90_000, 2_000, 60_000] * 6)]
    warc.write(rows(data, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"), chunk=8_000, chunks=5)
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    longest = max(len(warc.member(warc.record(k, "u", h.encode(), None, False))) for k, _, h in data)
    assert len(sizes) > 6 and longest > 5 * 8_000 and max(sizes) <= 5 * 8_000 + longest
    found = warc.read(spark, str(tmp_path / "w")).collect()
    assert {r.page_id: r.payload.decode() for r in found if r.payload is not None} == {k: h for k, _, h in data} and len(found) == len(data)


def test_short_pages_and_copies_are_dealt_out(rows, spark):
    data = [(k, "u", "short") for k in range(2000)] + [(k, "u", "copy" * 400) for k in range(2000, 4000)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = warc.with_revisits(rows(data, "page_id long, url string, html string"))
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 4000 and len(sizes) == 8 and max(sizes) < 1300
        assert joined.filter("revisit").count() == 1999 and joined.filter("first = 3999").count() == 2000
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_long_members_end_in_the_separator_and_damage_is_found():
    record = warc.record(1, "u", b"q" * (17 << 20), None, False)
    packed = warc.member(record)
    assert packed[-1] == 0 and list(warc.members(iter([packed]))) == [record]
    small = warc.member(warc.record(2, "u", b"abc", None, False))
    with pytest.raises(EOFError):
        list(warc.members(iter([small[:-9]])))
    with pytest.raises(zlib.error):
        list(warc.members(iter([small[:-8] + b"\1" * 8])))
    with pytest.raises(ValueError, match="Content-Length"):
        warc.parse(warc.record(2, "u", b"abc", None, False)[:-5])
