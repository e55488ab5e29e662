"""Operators on whole texts: chat, pieces, lines, benchmark passages, near copies, toxicity."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pairloom.llm import chat, decontaminate, lines, near, pieces, toxicity
from pairloom.llm.common import row_key, rows_without

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, rep string, key string"


def docs(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y", "z") for i, t in rows], DOCS)


def words(rng, n, stock=2000):
    return " ".join(f"w{rng.randrange(stock)}" for _ in range(n))


# ---------------------------------------------------------------- chat


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool: x", "=", "", "###"]), st.text(alphabet="#</turn>\\:bhlc \n", max_size=12)), min_size=1, max_size=6))
def test_chat_reads_back(spark, turns):
    rows = spark.createDataFrame([(1, n, r, t) for n, (r, t) in enumerate(turns)], "conv_id long, turn int, role string, text string")
    out = chat.format_conversations(rows).withColumn("back", chat.read_back(F.col("text"))).withColumn("loss", chat.loss_text(F.col("segments"))).first()
    assert [(t.role, t.text) for t in out.back] == turns
    assert out.loss == "".join(t for r, t in turns if r == "assistant")
    assert "".join(s.text for s in out.segments) == out.text


def test_chat_order_and_nulls(spark):
    rows = [(1, 0, "user", "a", 0), (1, 1, "assistant", None, 0), (2, 1, "user", "q", 0), (2, 0, "system", "s", 0), (3, 0, "assistant", "x", 0), (None, None, None, None, 0),
            (4, 0, "user", "a", 0), (4, 1, "user", "b", 0), (5, 0, "user", "long " * 50000, 0), (5, 1, "assistant", "ok", 0)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, segments int")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(table)).collect()}
    assert {k: (r.n_turns, r.valid, r.bad_turn) for k, r in got.items()} == {
        1: (2, True, None), 2: (2, False, 2), 3: (1, False, 0), None: (1, False, 0), 4: (2, False, 1), 5: (2, True, None)}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\n\n").hexdigest()
    assert got[5].loss_chars == 2
    assert chat.format_conversations(table.limit(0)).count() == 0


# ---------------------------------------------------------------- sentence pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.read()


ODD = ["", " ", "▁", "a ▁ b", "\n\n x  y", "日本語 🙂 é", "a" * 5000, "AKIA0000" * 30, "\u0000x", "thes the they"]


def test_without_dropout_as_the_library(spark, sf_dir, vocabulary):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [t for t in ODD if "▁" not in t]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    ids = pieces.Encoder(vocabulary, 0, 1).encode(texts, np.arange(len(texts), dtype=np.uint64))
    assert [x.tolist() for x in ids] == library.encode(texts, num_threads=1)


def brute_force(text, encoder, document):
    """One unit after the other with the plainest agenda: look at all pairs, take the best that is not skipped."""
    vocabulary, out = encoder.vocabulary, []
    drawn = pieces.mixed(pieces.mixed(np.array([document], np.uint64) ^ encoder.salt) + np.arange(len(pieces.units_of(text)), dtype=np.uint64))
    for unit, key in zip(pieces.units_of(text), drawn, strict=True):
        key = np.array([key])
        held = [(int(s), i, 1) for i, s in enumerate(encoder.table[[ord(c) for c in unit]])]
        while True:
            options = []
            for i in range(len(held) - 1):
                (a, start, x), (b, _, y) = held[i], held[i + 1]
                rank, merged = vocabulary.look_up(np.array([a]), np.array([b]))
                if rank[0] < pieces._NEVER and not pieces._skipped(key, np.array([start]), np.array([x]), np.array([y]), encoder.limit)[0]:
                    options.append((rank[0], i, int(merged[0])))
            if not options:
                break
            _, i, merged = min(options)
            held[i : i + 2] = [(merged, held[i][1], held[i][2] + held[i + 1][2])]
        out += [x for s, _, _ in held for x in encoder._spelled(s)]
    return out


def test_dropout_against_brute_force(vocabulary):
    rng = random.Random(5)
    texts = [t for t in ODD if len(t) < 300] + ["".join(rng.choice("theraonis ▁é\n1") for _ in range(rng.randrange(90))) for _ in range(60)]
    documents = np.arange(100, 100 + len(texts), dtype=np.uint64)
    for rate, seed in ((0.1, 1), (0.5, 2), (1.0, 3)):
        encoder = pieces.Encoder(vocabulary, rate, seed)
        for text, number, ids in zip(texts, documents, encoder.encode(texts, documents), strict=True):
            assert ids.tolist() == brute_force(text, encoder, int(number)), text
            assert pieces.decode(ids, vocabulary.pieces).decode() == text


def test_every_occurrence_draws_for_itself(vocabulary):
    """Shares of all segmentations of a word, against draws of each candidate merge one by one."""
    n, rate = 20_000, 0.1
    for word in ("the", "and", "information"):
        encoder = pieces.Encoder(vocabulary, rate, 3)
        ids = encoder.encode([" ".join([word] * 40)] * (n // 40), np.arange(n // 40, dtype=np.uint64))
        counts = {}
        for row in ids:
            cut, held = [], []
            for x in row.tolist():
                piece = vocabulary.pieces[x].decode()
                if piece.startswith(" ") and held:
                    cut.append(tuple(held))
                    held = []
                held.append(piece)
            for one in [*cut, tuple(held)]:
                counts[one] = counts.get(one, 0) + 1
        expect = chances(" " + word, vocabulary, encoder, rate)
        assert sum(counts.values()) == n and set(counts) <= set(expect) and abs(sum(expect.values()) - 1) < 1e-9
        often = {one: share for one, share in expect.items() if share * n >= 5}
        for one, share in often.items():
            if share >= 0.01:
                assert abs(counts.get(one, 0) / n - share) <= 3 * (share * (1 - share) / n) ** 0.5, (word, one)
        # all of them together: chi-square, three standard deviations above its mean
        chi = sum((counts.get(one, 0) - share * n) ** 2 / (share * n) for one, share in often.items())
        assert chi <= len(often) + 3 * (2 * len(often)) ** 0.5, word


def chances(unit, vocabulary, encoder, rate):
    """The chance of every segmentation, by following both outcomes of each draw."""
    out = {}

    def follow(held, skipped, chance):
        options = []
        for i in range(len(held) - 1):
            (a, start, x), (b, _, y) = held[i], held[i + 1]
            rank, merged = vocabulary.look_up(np.array([a]), np.array([b]))
            if rank[0] < pieces._NEVER and (start, x, y) not in skipped:
                options.append((rank[0], i, int(merged[0])))
        if not options:
            one = tuple(vocabulary.pieces[s].decode() for s, _, _ in held)
            out[one] = out.get(one, 0) + chance
            return
        _, i, merged = min(options)
        (_, start, x), (_, _, y) = held[i], held[i + 1]
        follow([*held[:i], (merged, start, x + y), *held[i + 2 :]], skipped, chance * (1 - rate))
        follow(held, skipped | {(start, x, y)}, chance * rate)

    follow([(int(s), i, 1) for i, s in enumerate(encoder.table[[ord(c) for c in unit]])], frozenset(), 1.0)
    return out


def test_pieces_table(spark):
    table = docs(spark, [(1, "the end of the matter " * 20), (2, "the end of the matter " * 20), (3, None), (4, ""), (None, "x"), (1, "the end of the matter " * 20)])
    one, again, other, plain = (
        {(r.doc_id, i): r.ids for i, r in enumerate(pieces.encode(table, rate, seed).collect())} for rate, seed in ((0.3, 1), (0.3, 1), (0.3, 2), (0, 1))
    )
    assert one == again and one != other
    assert one[1, 0] == one[1, 5] != one[2, 1] and one[3, 2] is None and one[4, 3] == []
    assert plain[1, 0] == plain[2, 1] and len(one[1, 0]) > len(plain[1, 0])
    encoded = pieces.encode(table.limit(3), 0.3, 1)
    assert [r.text for r in pieces.decode_column(encoded).collect()] == [r.text for r in table.limit(3).collect()]
    assert pieces.encode(table.limit(0)).count() == 0


# ---------------------------------------------------------------- lines


def test_lists_decode_together_as_one_by_one(vocabulary):
    held = vocabulary.pieces
    lists = [[], *(np.random.default_rng(i).integers(0, len(held), 40 * i).tolist() for i in range(4)), []]
    ends = np.cumsum([0, *map(len, lists)])
    joined, sizes = np.frombuffer(b"".join(held), np.uint8), np.array([len(x) for x in held])
    values = np.array([x for one in lists for x in one], np.int32)
    assert pieces._decoded(values, ends, joined, sizes) == [pieces.decode(one, held) for one in lists]
    assert pieces._decoded(values[:0], np.zeros(3, np.int64), joined, sizes) == [b"", b""]


def test_memory_of_the_encoder_is_bounded(vocabulary):
    import tracemalloc
    from types import SimpleNamespace

    rng = random.Random(3)
    words = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=2_000_000))
    # hardly a unit comes twice
    texts = [" ".join(words[at : at + 5] for at in range(low, low + 5000, 5)) for low in range(0, len(words), 5000)]
    rows = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([rows, rows, pa.array(texts)], ["doc_id", "key", "text"])
    run = pieces._encode(SimpleNamespace(value=vocabulary), 0.1, 17)
    tracemalloc.start()
    try:
        encoded = sum(len(x) for x in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert encoded == len(texts)
    assert peak < 130e6


def test_repeated_chunks_go_but_the_first(spark):
    rng = random.Random(3)
    passage = [words(rng, 8) for _ in range(12)]
    rows = [(i, "\n".join([words(rng, 6) for _ in range(i % 4 + 1)] + passage + [words(rng, 5)])) for i in range(8)]
    rows += [(20, None), (21, ""), (22, "one\ntwo"), (None, "\n".join(passage)), (30, "same\n" * 3), (30, "same\n" * 3)]
    got = {r.doc_id if r.doc_id is not None else "null": r for r in lines.remove_repeated(docs(spark, rows)).collect()}
    assert got[20].text is None and got[21].text == "" and got[22].text == "one\ntwo"
    # rows without id come first and keep the passage; the rest lose all of its chunks but those at its edges
    assert got["null"]._n_removed == 0
    for i in range(8):
        held, left = rows[i][1].split("\n"), got[i].text.split("\n")
        assert got[i]._n_removed >= 4 and len(held) == len(left) + got[i]._n_removed
        assert set(held) - set(left) <= set(passage) and got[i].n_chars is not None
    assert got[30].text == "same\n" * 3
    copies = lines.clean(docs(spark, [(i, rows[0][1]) for i in range(4)] + [(9, "x\n" + rows[0][1]), (10, "a"), (11, "a")]))
    assert sorted(r.doc_id for r in copies.collect()) == [0, 9, 10, 11]
    cleaned = {r.doc_id: r for r in lines.clean(docs(spark, [(1, "a\nb"), (2, "a\nb"), (3, None)])).collect()}
    assert set(cleaned) == {1, 3} and cleaned[1].text == "a\nb"
    assert lines.clean(docs(spark, rows).limit(0)).count() == 0
    assert lines.clean(docs(spark, rows)).columns == docs(spark, rows).columns


def plain_left(rows):
    """What stays when every pair of lines that an earlier place holds goes (a pair that overlaps its first place stays)."""
    first, out = {}, {}
    for i, text in sorted(rows):
        held = text.split("\n")
        gone = set()
        for at in range(len(held) - 1):
            if not "".join(held[at : at + 2]).strip():
                continue
            kept = first.setdefault((held[at], held[at + 1]), (i, at))
            if kept != (i, at) and kept != (i, at - 1):
                gone |= {at, at + 1}
        out[i] = "\n".join(x for at, x in enumerate(held) if at not in gone)
    return out


def test_repeated_runs_of_any_length_go(spark):
    rng = random.Random(12)
    rows, passages = [], [[words(rng, 7) for _ in range(size)] for size in range(2, 13)]
    for n in range(3):
        for k, passage in enumerate(passages):
            before, after = ([words(rng, 6) for _ in range(rng.randrange(1, 5))] for _ in range(2))
            rows.append((100 * n + k, "\n".join(before + passage + after)))
    rows += [(500, "p\nq\np\nq\np"), (501, "same\n" * 5), (502, "one\n\n\ntwo"), (503, "three\n\n\nfour"), (504, "one\n\n\ntwo"), (505, "alone"), (506, "alone")]
    got = {r.doc_id: r.text for r in lines.clean(docs(spark, [*rows, (507, None), rows[20]])).collect()}
    for k, passage in enumerate(passages):
        assert "\n".join(passage) in got[k]
        assert not any(x in got[n + k] for x in passage for n in (100, 200)), len(passage)
    expect = {i: t for i, t in plain_left(rows).items() if i != 504}
    assert got == expect | {507: None}


def test_lines_that_only_share_their_hash_stay(spark, monkeypatch):
    def poor(text):
        return F.transform(F.split(text, "\n", -1), lambda x: F.length(x).cast("long"))

    monkeypatch.setattr(lines, "line_hashes", poor)
    table = docs(spark, [(1, "aaa\nbbb"), (2, "ccc\nddd"), (3, "aaa\nbbb"), (4, "eee\nbbb\nff")])
    got = {r.doc_id: (r.text, r._id, r.key) for r in lines.remove_repeated(table).collect()}
    assert got == {1: ("aaa\nbbb", "x", "z"), 2: ("ccc\nddd", "x", "z"), 3: ("", "x", "z"), 4: ("eee\nbbb\nff", "x", "z")}


def test_runs_in_long_texts(spark):
    """Work grows with the lines: 60,000 lines of which half are repeated."""
    rng = random.Random(5)
    own = [words(rng, 2, 10**6) for _ in range(30_000)]
    rows = [(1, "\n".join(own)), (2, "\n".join(x if n % 2 else f"{x}\nnew {n}" for n, x in enumerate(own)))]
    got = {r.doc_id: r for r in lines.remove_repeated(docs(spark, rows)).collect()}
    assert (got[1]._n_removed, got[2]._n_lines) == (0, 45_000)
    assert {i: r.text for i, r in got.items()} == plain_left(rows)


# ---------------------------------------------------------------- benchmark passages

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(text, items):
    ours = _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hit, named = set(), set()
    for item_id, item in items:
        theirs = _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in item or ""))
        size = min(10, len(theirs))
        for j in range(len(theirs) - size + 1 if size else 0):
            for i in range(len(ours) - size + 1):
                if ours[i : i + size] == theirs[j : j + size]:
                    hit |= set(range(i, i + size))
                    named.add(item_id)
    return len(ours), len(hit), sorted(str(x) for x in named if x is not None)


def test_passages_against_brute_force(spark):
    rng = random.Random(8)
    items = [(i, words(rng, rng.choice([1, 3, 9, 10, 11, 25, 40]), 40)) for i in range(30)]
    items += [(40, None), (41, "..."), (None, words(rng, 12)), (7, items[3][1]), (50, "É É É É É É É É É É É É")]
    rows = []
    for i in range(60):
        parts = [words(rng, rng.randrange(30), 40)]
        item = rng.choice(items)[1] or ""
        at = rng.randrange(1 + len(item) // 2)
        rows.append((i, f"{parts[0]} {item[at:].upper()}, {words(rng, 5, 40)}"))
    rows += [(100, None), (101, ""), (102, "é É é É" + " É" * 20), (None, items[5][1]), (103, rows[0][1]), (103, rows[0][1]), (104, "w1 " * 30000)]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, found string")
    got = decontaminate.report(docs(spark, rows), benchmark).collect()
    assert len(got) == len(rows)
    small = [r for r in rows if r[0] != 104]
    expect = sorted(((str(i), *plain_hits(t, items)) for i, t in small), key=str)
    assert sorted(((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in got if r.doc_id != 104), key=str) == expect
    kept = decontaminate.clean(docs(spark, rows), benchmark)
    clean_ids = sorted(str(i) for i, t in small if not plain_hits(t, items)[1])
    assert sorted(str(r.doc_id) for r in kept.collect() if r.doc_id != 104) == clean_ids
    assert decontaminate.report(docs(spark, rows), benchmark.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.report(docs(spark, rows).limit(0), benchmark).count() == 0


# ---------------------------------------------------------------- near copies


def plain_components(rows, width, percent):
    def shingles(text):
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        n = min(width, len(ws))
        return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if n else set()

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return [(i, len(s), root(i)) for i, s in sets]


def edited(rng, text, n):
    parts = text.split(" ")
    for _ in range(n):
        parts[rng.randrange(len(parts))] = f"e{rng.randrange(10**6)}"
    return " ".join(parts)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_copies_against_brute_force(spark, monkeypatch, width, percent):
    # blocks so small that lists are dealt out
    monkeypatch.setattr(near, "BLOCK", 16)
    rng = random.Random(width)
    rows, number = [], 0
    for size in (1, 2, 5, 60):
        base = words(rng, 150)
        for _ in range(size):
            rows.append((number := number + 1, edited(rng, base, rng.randrange(8))))
    chain = words(rng, 120)
    for _ in range(12):
        rows.append((number := number + 1, chain := edited(rng, chain, 2)))
    shared = words(rng, 40)
    rows += [(1000 + i, f"{words(rng, 60)} {shared} {words(rng, 60)}") for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, "a"), (2003, "A "), (2004, "a b"), (2005, "É b"), (2006, "é b"), (5, rows[3][1]), (2007, "  \t ")]
    rows += [(3000 + i, rows[0][1]) for i in range(50)] + [(4000, "long " + words(rng, 30000, 10**6))]
    rows = [r for n, r in enumerate(rows) if r[0] != 5 or n < 100]
    rng.shuffle(rows)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near.link(docs(spark, rows), width, percent).collect())
    assert got == sorted(plain_components(rows, width, percent))
    kept = near.keep_one(docs(spark, rows), width, percent)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, c in got if i == c)


def test_one_id_on_different_texts(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16)
    a, b = "a b c d e f g h", "s t u v w x y z"
    rows = [(0, a), (1, a), (1, b), (6, b)]
    assert {(r.doc_id, r.component_id) for r in near.link(docs(spark, rows)).collect()} == {(0, 0), (1, 0), (6, 0)}
    assert sorted((r.doc_id, r.text) for r in near.keep_one(docs(spark, rows)).collect()) == [(0, a), (1, b)]
    # two near copies under one id: one of them stays
    long = " ".join(f"w{i}" for i in range(100))
    assert near.keep_one(docs(spark, [(3, long), (3, long + " end"), (4, long)])).count() == 1
    rng = random.Random(2)
    bases = [words(rng, 120) for _ in range(12)]
    rows = [(rng.randrange(60), edited(rng, rng.choice(bases), rng.randrange(4))) for _ in range(150)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near.link(docs(spark, rows)).collect())
    assert got == sorted(plain_components(rows, 5, 80))
    # of every group of linked texts exactly one is left
    kept = {(r.doc_id, r.text) for r in near.keep_one(docs(spark, rows)).collect()}
    groups = text_groups(rows)
    texts = {c: min((i, t) for i, t in rows if groups[t] == c) for c in set(groups.values())}
    assert {t for _, t in kept} <= {t for _, t in rows} and len(kept) == len(texts)
    assert {i for i, _ in kept} == {i for i, _ in texts.values()}


def text_groups(rows):
    """text -> group of linked texts."""
    distinct = sorted({t for _, t in rows})
    return {distinct[i]: c for i, _, c in plain_components(list(enumerate(distinct)), 5, 80)}


def test_near_copies_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (None, None)]
    got = sorted((str(r.doc_id), r.kept) for r in near.link(docs(spark, rows)).collect())
    assert got == [("1", True), ("1", True), ("2", False), ("None", True), ("None", True)]
    assert near.link(docs(spark, rows).limit(0)).count() == 0


def test_components_of_long_chains(spark):
    rng = random.Random(1)
    order = list(range(300))
    rng.shuffle(order)
    links = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order, order[1:150] + order[151:], strict=False)], "a long, b long")
    nodes = spark.range(310).withColumnRenamed("id", "node")
    got = {r.node: r.comp for r in near.components(nodes, links).collect()}
    parent = {i: i for i in range(310)}
    for r in links.collect():
        x, y = parent[r.a], parent[r.b]
        parent = {k: min(x, y) if v in (x, y) else v for k, v in parent.items()}
    assert got == parent


# ---------------------------------------------------------------- rows that stay


@pytest.mark.parametrize("bits", [6, 24])
def test_rows_without(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", "a", "b", "c"])) for _ in range(400)]
    held = {(i, t) for i, t in rows if rng.randrange(3) == 0}
    table = docs(spark, rows)
    gone = docs(spark, sorted(held, key=str) * 2)
    got = rows_without(table, gone.select(*row_key(gone)), row_key(table), bits)
    assert got.columns == table.columns and {(r._id, r.rep, r.key) for r in got.collect()} == {("x", "y", "z")}
    left = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert left == sorted((r for r in rows if r not in held), key=str)
    # a null in a key equals nothing
    key = [F.col("doc_id"), F.col("text")]
    left = [(r.doc_id, r.text) for r in rows_without(table, gone.select(*key), key, bits).collect()]
    assert sorted(left, key=str) == sorted((r for r in rows if r not in held or None in r), key=str)
    assert rows_without(table, gone.limit(0).select(*key), key, bits).count() == len(rows)
    assert rows_without(table.limit(0), gone.select(*key), key, bits).count() == 0


@pytest.mark.parametrize("stage", ["near copies", "benchmark passages"])
def test_texts_that_stay_are_not_moved(spark, stage, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(f"{rng.getrandbits(60):x}" for _ in range(1000))) for i in range(200)]
    rows += [(1000 + i, rows[i][1]) for i in range(8)]
    docs(spark, rows).repartition(4).write.parquet(f"{tmp_path}/docs")
    table = spark.read.parquet(f"{tmp_path}/docs")
    benchmark = spark.createDataFrame([(i, " ".join(rows[i][1].split()[50:80])) for i in range(8)], "item_id long, text string")

    def shuffled():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        return spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if what goes were many rows
    try:
        before = shuffled()
        kept = near.keep_one(table) if stage == "near copies" else decontaminate.clean(table, benchmark)
        ids = sorted(r.doc_id for r in kept.select("doc_id", F.md5("text")).collect())
        moved = shuffled() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert ids == (list(range(200)) if stage == "near copies" else list(range(8, 200)))
    assert moved < sum(len(t) for _, t in rows) / 4


# ---------------------------------------------------------------- toxicity


@pytest.fixture(scope="module")
def model(spark):
    data = "/root/testdata/sf0.1"
    texts, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    return texts, labels, toxicity.train(texts, toxicity.learnable(labels))


def test_held_out_accuracy(model):
    texts, labels, trained = model
    judged = toxicity.scored(texts.join(labels, "doc_id"), trained).filter(toxicity.held_out(F.col("doc_id")))
    n = {(r.toxic, r.p): r.n for r in judged.groupBy("toxic", (F.col("_score") >= toxicity.CUT).alias("p")).agg(F.count("*").alias("n")).collect()}
    # some labelled texts hold no word that could tell
    assert n[1, True] / (n[1, True] + n[1, False]) > 0.9 and n[0, False] / (n[0, False] + n[0, True]) > 0.98


def test_hidden_words_are_found(spark, model):
    trained = model[2]
    clean = "the of and in that onwhin erthe ndthe is re. thonre atthe inth"
    hidden = ["1d10t", "m0r0n", "i d i o t", "s.t.u.p.i.d", "stuuuupiiid", "$tup1d", "w0rthle$s", "IDI0T", "p@thetic"]
    rows = [(i, f"{clean} {h} {clean} {h}") for i, h in enumerate(hidden)] + [(100, clean), (101, None), (102, ""), (103, clean + " 4737920719175045 a@b.c 10.2.3.4")]
    got = {r.doc_id: r._score for r in toxicity.scored(docs(spark, rows), trained).collect()}
    assert [h for i, h in enumerate(hidden) if got[i] < toxicity.CUT] == []
    assert max(got[i] for i in (100, 101, 102, 103)) < toxicity.CUT and got[101] == got[102]


def test_letters_one_by_one_with_any_sign(spark, model):
    restorer = toxicity.Restorer(model[2].costs)
    spellings = {
        "shit": ["s h ! t", "$ h i t", "s|h|!|t"], "ass": ["a s s", "@ s $", "a.$.$"], "asshole": ["a $ $ h o l e"],
        "kill": ["k i l l", "k  i  l  l", "k~i~l~l", "k | i | l | l", "k / i - l _ l", "k\ni\nl\nl", "k i 1 +5 k i l l", "k i l l !"],
    }
    for word, held in spellings.items():
        assert [x for x in held if word not in restorer.words(f"the of {x} and in")] == []
    # no word where the written reading is cheaper, nor where a letter has signs of its own
    for text in ("a, a, a, a", "ß$$$ ö", "è +1 x", "1, 2, 3", "a +b"):
        assert restorer.words(text) == set()
    hidden = ["$ t u p ! d", "m~o~r~o~n", "i  d  i  o  t", "i | d | ! | o | t"]
    clean = "the of and in that onwhin erthe ndthe is re. thonre atthe inth"
    got = toxicity.scored(docs(spark, [(i, f"{clean} {x} {clean} {x}") for i, x in enumerate(hidden)]), model[2]).collect()
    assert [hidden[r.doc_id] for r in got if r._score < toxicity.CUT] == []


def test_plain_text_is_left_alone(model):
    restorer = toxicity.Restorer(model[2].costs)
    for text in ("The cat sat, 2 times, on 10.2.3.4!", "a b", "Of%%% athe*** the&&& ernt$$$", "4737920719175045", ""):
        assert restorer.restored(text) == text.lower()


def test_viterbi_against_all_readings(model):
    costs = model[2].costs.tolist()
    rng = random.Random(4)

    def cost(path):
        two = one = 0
        total = sum(price for _, price in path)
        for char in "".join(text for text, _ in path) + " ":
            cls = toxicity._CLASS_OF(char)
            if one or cls:
                total += costs[two if one else 0][one][cls]
            two, one = one, cls
        return total

    import itertools

    for _ in range(60):
        span = "".join(rng.choice("th1s01ee$a!o.") for _ in range(rng.randrange(1, 7)))
        options = toxicity.lattice(span, rng.random() < 0.5)
        readings = {"".join(t for t, _ in path).strip(): cost(path) for path in sorted(itertools.product(*options), key=cost, reverse=True)}
        assert readings[toxicity.decode(options, costs)] == pytest.approx(min(readings.values()))


def test_without_labels(spark):
    table, none = docs(spark, [(1, "a b c")]), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scored(table, toxicity.train(table, none)).first()._score == 0
    assert toxicity.reject(table, none).count() == 1
    only = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    assert toxicity.scored(table, toxicity.train(table, only)).first()._score == 1
    assert toxicity.scored(table.limit(0), toxicity.train(table.limit(0), none)).count() == 0


def test_stretches_with_one_reading_are_not_decoded(model):
    costs, rng = model[2].costs.tolist(), random.Random(6)
    for n in range(400):
        span = "".join(rng.choice(["a", "b", "ß", "ttt", "eeeee", "漢", "1", "$", "0!", ".", "..", "2", "the", "nd"]) for _ in range(rng.randrange(1, 25)))
        whole = toxicity.decode(toxicity.lattice(span, False), costs)
        assert toxicity.decode_span(span, costs).split() == whole.split(), (n, span)


@pytest.mark.parametrize(
    "text",
    ["a" * 10**6, "ab" * 500_000, "x1" + "." * 10**6 + "y", "漢字仮名" * 80_000, "." * 10**6, "x" + ".$" * 50_000, "漢字仮名" * 40_000 + "ooo" + "漢字仮名" * 40_000, "1" * 10**6, "a . " * 60_000, "$" * 10**6 + "a1"],
)
def test_long_words_take_time_by_their_length(model, text):
    import time

    restorer = toxicity.Restorer(model[2].costs)
    begin = time.process_time()
    restorer.restored(text)
    assert time.process_time() - begin < 3


def test_clashing_labels_and_repeated_rows(spark):
    table = docs(spark, [(1, "bad word here"), (1, "bad word here"), (2, "good words here"), (3, "bad word there"), (4, "more good words"), (5, "bad word again"), *((i, f"fine text number {i}") for i in range(6, 30))])
    labels = [(1, 0), (1, 1), (2, 0), (3, 1), (4, 0), (5, 1), *((i, 0) for i in range(6, 30)), (6, None)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {}
    for r in toxicity.scored(table, toxicity.train(table, labels)).collect():
        assert got.setdefault(r.doc_id, r._score) == r._score
    assert min(got[i] for i in (1, 3, 5)) > max(got[i] for i in (2, 4, 6))


def test_bounded_sample(spark):
    from pairloom.llm.common import bounded_sample

    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    one = {r.doc_id for r in bounded_sample(rows, "doc_id", 300).collect()}
    assert len(one) == 300 and one == {r.doc_id for r in bounded_sample(rows.repartition(7), "doc_id", 300).collect()}
    assert bounded_sample(rows, "doc_id", 5000).count() == 5000
