"""Suffix arrays by linear grouping, and repeated strings, against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pairloom.llm import suffix_groups

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, row string, key string, spans string"


def docs(spark, rows):
    """Documents with columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "y", "z", "w") for i, t in rows], DOCS)


def plain(rows, width=50):
    seen = {}
    for i, text in rows:
        raw = (text or "").encode()
        for at in range(len(raw) - width + 1):
            s = raw[at : at + width]
            i_ = -(2**63) if i is None else i
            seen[s] = min(seen.get(s, i_), i_)
    out = []
    for i, text in rows:
        raw, i_ = (text or "").encode(), -(2**63) if i is None else i
        gone = bytearray(len(raw))
        for at in range(len(raw) - width + 1):
            if seen[raw[at : at + width]] < i_:
                gone[at : at + width] = b"\1" * width
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(spark, rows):
    return sorted((tuple(r) for r in suffix_groups.report(docs(spark, rows)).collect()), key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=30), min_size=1, max_size=6), st.booleans())
def test_suffix_array_of_short_strings(pieces, large):
    s = [0]
    for p in pieces:
        s += [ord(c) - 96 for c in p] + [0]
    before = suffix_groups._LOOP
    suffix_groups._LOOP = 1 if large else before  # all groups in numpy, or all in loops
    try:
        order = suffix_groups.suffix_array(np.array(s)).tolist()
    finally:
        suffix_groups._LOOP = before
    assert sorted(order) == list(range(len(s)))
    suffixes = [s[i : s.index(0, i) + 1] for i in order]
    assert suffixes == sorted(suffixes)


def test_groups_are_lyndon_prefixes():
    s = [0, *map(ord, "banana bandana"), 0]
    group, following = suffix_groups.lyndon_groups(np.array(s))

    def prefix(i):  # up to the next smaller suffix
        j = i + 1
        while s[j:] > s[i:]:
            j += 1
        return tuple(s[i:j])

    places = range(1, len(s) - 1)
    assert [i + len(prefix(i)) for i in places] == following[1:-1].tolist()
    ranks = sorted({prefix(i) for i in places})
    # groups that handed all members on leave gaps
    assert [ranks.index(prefix(i)) for i in places] == np.unique(group[1:-1], return_inverse=True)[1].tolist()


def test_suffix_array_of_runs_and_long_text():
    for s in ([1] * 5000, [1, 2] * 3000, [2, 1] * 3000, [1] * 2999 + [2]):
        order = suffix_groups.suffix_array(np.array([0, *s, 0]))
        suffixes = [bytes(s[i - 1 :]) for i in order[2:][:: len(order) // 50]]
        assert suffixes == sorted(suffixes)


def corpus(rng):
    stock = [f"{w}{rng.randrange(50)}" for w in "alpha beta gamma delta ümläut 漢字 x".split()]

    def text(n):
        return " ".join(rng.choice(stock) for _ in range(n))

    passages = [text(n) for n in (4, 8, 9, 12, 30)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(0, 30)) for _ in range(3)]
        for p in rng.sample(passages, 2):
            parts.insert(rng.randrange(3), p if rng.random() < 0.8 else p[rng.randrange(len(p)) :])
        rows.append((i, " ".join(parts)))
    rows += [(100 + i, rows[3][1]) for i in range(20)]  # exact copies
    rows += [(200 + i, rows[5][1][: 40 * i + 30] + f" {i} " + rows[5][1][40 * i + 31 :]) for i in range(5)]  # near copies
    return rows


@pytest.mark.parametrize("hot", [False, True])
def test_report_against_brute_force(spark, monkeypatch, hot):
    rows = corpus(random.Random(8))
    if hot:  # every hash in several stretches is dealt string by string
        monkeypatch.setattr(suffix_groups, "HOT", 2)
    assert made(spark, rows) == plain(rows)


def test_edges(spark):
    long = "the quick brown fox jumps over the lazy dog and runs away " * 3
    rows = [
        (None, long + "tail of the row without id, which counts as the smallest"), (0, None), (1, ""), (2, "short"), (3, "short"),
        (4, long), (4, long), (4, "x" + long[:70]), (5, long[:49]), (6, long[:50]), (7, "a" * 3000), (8, "a" * 200_000), (9, "ab" * 400), (10, "ba" * 400),
    ]
    assert made(spark, rows) == plain(rows)


def test_no_documents(spark):
    assert made(spark, []) == []


def test_slices_change_nothing(spark, monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    whole = text.encode() * 2
    ends = np.array([3000, 3000, 6000])
    data = np.frombuffer(whole, np.uint8)

    def strings():
        return {at + j: int(k) for first, size, key in suffix_groups.stretches(data, ends) for at, n, k in zip(first, size, key, strict=True) for j in range(n)}

    want = strings()
    assert sorted(want) == [*range(2951), *range(3000, 5951)]
    assert all(want[i] == want[i + 3000] for i in range(2951))
    monkeypatch.setattr(suffix_groups, "SLICE", 333)
    monkeypatch.setattr(suffix_groups, "LONGEST", 7)
    assert strings() == want


def test_kept_bytes_and_spans(spark):
    first, second = "x" * 10 + "0123456789" * 6, "y" * 7 + "0123456789" * 6 + "z" * 4
    table = docs(spark, [(1, first), (2, second)])
    spans = suffix_groups.repeated_spans(table)
    assert [[(s.start, s.end) for s in r.spans] for r in spans.collect()] == [[(7, 67)]]
    assert [bytes(r.kept) for r in suffix_groups.cut(table, spans).collect()] == [b"y" * 7 + b"z" * 4]


def test_spans_become_one_where_they_touch():
    import pyarrow as pa

    held = [[(5, 9), (0, 3), (3, 4)], [(0, 2), (1, 8), (2, 3), (9, 10)], [(7, 8)]]
    lists = pa.array([[{"start": a, "end": b} for a, b in x] for x in held], suffix_groups._SPANS)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([0, 0, 0]), lists], ["_id", "_text_hash", "spans"])
    (out,) = suffix_groups._merged(iter([batch, batch.slice(0, 0)]))
    assert [[(s["start"], s["end"]) for s in x] for x in out["spans"].to_pylist()] == [[(0, 4), (5, 9)], [(0, 8), (9, 10)], [(7, 8)]]
    (again,) = suffix_groups._merged(iter([batch.slice(1, 2)]))
    assert again["spans"].to_pylist() == out["spans"].to_pylist()[1:]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=4, max_size=20).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=8))
def test_pieces_that_meet(pieces):
    seen = {}
    for i, p in enumerate(pieces):
        for at in range(len(p) - 3):
            seen.setdefault(p[at : at + 4], []).append(i)
    want = {i for held in seen.values() if len(held) > 1 for i in held}
    assert set(np.flatnonzero(suffix_groups._meets(pieces, 4)).tolist()) == want


def test_pieces_that_share_no_string_enter_no_suffix_array(monkeypatch):
    import pyarrow as pa

    rng = random.Random(4)
    first, other = (bytes(rng.randrange(97, 123) for _ in range(60)) for _ in range(2))
    second = first[5:] + b"12345"
    entered = []
    whole = suffix_groups.repeated_strings
    monkeypatch.setattr(suffix_groups, "repeated_strings", lambda pieces, *rest: entered.append(list(pieces)) or whole(pieces, *rest))

    def judged(pieces):
        n = len(pieces)
        batch = pa.RecordBatch.from_arrays([pa.array([7] * n), pa.array(pieces, pa.binary()), pa.array(range(n)), pa.array([9] * n)], ["key", "bytes", "low", "high"])
        return {r["digest"]: (r["low"], [(x["a"], x["b"]) for x in r["runs"]]) for b in suffix_groups._judged(50)(iter([batch])) for r in b.to_pylist()}

    digest = suffix_groups.xxhash.xxh3_128_digest
    assert judged([other, first, second]) == {digest(other): (0, []), digest(first): (1, []), digest(second): (2, [(0, 6)])}
    assert entered == [[first, second]]
    assert judged([other, first]) == {digest(other): (0, []), digest(first): (1, [])}
    assert len(entered) == 1
