"""Repeated byte strings by suffix arrays, built group by group.

Every byte covered by a string of ``width`` bytes that also starts in a document with a
smaller doc_id is found; matches never cross documents.

The suffix array comes from linear grouping. Suffixes are grouped by their longest Lyndon
prefix: groups start as single bytes and are processed in descending order; the members of
a group hand their prefix to the previous smaller suffix, to which a pointer is kept, so
that suffixes with the same prefix and the same number of appended copies form a new group
just above their old one. Then groups are read in ascending order: each suffix, once its
place is known, puts those whose prefix ends where it begins at the next free place of
their group. Nothing is renamed and no reduced string is solved (``lyndon_groups``,
``emitted``).

Texts are not sorted whole. A string of ``width`` bytes belongs to the smallest hash of
the GRAM-grams inside it, so equal strings belong to equal hashes wherever they stand;
neighbouring strings of one hash are one stretch of text. Stretches are dealt by their
hash, so all equal strings meet in one task, which builds suffix arrays over blocks of
whole hashes (a hash with one stretch alone has nothing to compare, nor has a stretch
none of whose strings has its hash in a second place of the block: neither enters a suffix
array); neighbours in a suffix array that agree in ``width`` bytes are one class,
and the smallest doc_id of a class tells which of its strings go. A stretch that many
documents hold is one entry with its smallest doc_id.

What can be saved before that, without losing any: of equal texts one is looked at, the
others go whole; hashes that only one document holds are left out by a bitmap, whose size
grows with their number up to 2**MOST_BITS bits (32 MiB; a fuller one lets more through and
loses nothing); a hash that stands in more than HOT different stretches is dealt string
by string instead, so no hash fills a task. Texts move only where something is removed.

A null text is empty; texts shorter than ``width`` keep all. Any length of text is taken
in slices. Rows without doc_id count as smallest id. Repeated rows (same id and text) share the
result; different texts under one id are judged each for itself, none of them is smaller.
An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import bitmap, in_bitmap, mixed, row_key, saved

WIDTH, GRAM = 50, 24
MOST_BITS = 28
HOT = 20_000
LONGEST = 512  # strings in a stretch; longer ones (one hash over a periodic text) are cut
SLICE = 1 << 17
BLOCK = 1 << 18
SENT = 50_000  # stretches a task holds before it sends them
_LOOP = 64  # groups below this size are handled in a plain loop

_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93


# ------------------------------------------------------------------ suffix arrays


def lyndon_groups(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each suffix, start of the next smaller suffix) of a string that begins and ends with 0.

    Groups are numbered in ascending order of their Lyndon prefix; 0 separates strings and is a group of its own.
    """
    n = len(symbols)
    # the same memory as arrays for large groups and for plain loops
    loops = [array("q", x.astype(np.int64).tobytes()) for x in (symbols, np.arange(-1, n - 1), np.arange(1, n + 1), np.zeros(n))]
    group_at, left_at, right_at, next_at = loops
    group, left, right, following = (np.frombuffer(x, np.int64) for x in loops)
    order = np.argsort(symbols, kind="stable")
    present, starts = np.unique(symbols[order], return_index=True)
    members: list = [None] * (int(present[-1]) + 1)
    lower, higher = [-1] * len(members), [-1] * len(members)
    bounds = [*starts.tolist(), n]
    present = present.tolist()
    for i, symbol in enumerate(present):
        members[symbol] = _held(order[bounds[i] : bounds[i + 1]])
        lower[symbol] = present[i - 1] if i else -1
        higher[symbol] = present[i + 1] if i + 1 < len(present) else -1
    span = n + 1

    def insert(below: int) -> None:
        """A new group just above ``below``."""
        new, above = len(lower), higher[below]
        lower.append(below)
        higher.append(above)
        higher[below] = new
        if above >= 0:
            lower[above] = new

    g = present[-1]
    while g > 0:
        held = members[g]
        members[g] = None
        if type(held) is not list:
            held = held[group[held] == g]
            before, after = left[held], right[held]
            following[held] = after
            # consecutive members are one run, which is handed on together
            first = np.flatnonzero(group[before] != g)
            copies = np.diff(first, append=len(held))
            to, end = before[first], after[first + copies - 1]
            right[to], left[end] = end, to
            inner = np.flatnonzero(group[to])
            if len(inner):
                to = to[inner]
                key = group[to] * span + copies[inner]
                order = np.argsort(key, kind="stable")
                to, key = to[order], key[order]
                new = np.r_[True, key[1:] != key[:-1]]
                group[to] = len(members) + np.cumsum(new) - 1
                cuts = np.flatnonzero(new)
                bounds, owner = [*cuts.tolist(), len(to)], -1
                for i, old in enumerate((key[cuts] // span).tolist()):
                    insert(len(lower) - 1 if old == owner else old)
                    members.append(_held(to[bounds[i] : bounds[i + 1]]))
                    owner = old
        elif len(held) == 1:  # most of them: no run, one suffix before it
            i = held[0]
            if group_at[i] == g:
                to, end = left_at[i], right_at[i]
                next_at[i] = right_at[to] = end
                left_at[end] = to
                old = group_at[to]
                if old:
                    group_at[to] = len(lower)
                    members.append([to])
                    insert(old)
        else:
            moves: dict[int, list[int]] = {}
            for i in held:
                if group_at[i] != g:
                    continue
                to = left_at[i]
                old = group_at[to]
                if old == g:
                    continue
                end, copies = right_at[i], 1
                next_at[i] = end
                while group_at[end] == g:
                    copies += 1
                    i, end = end, right_at[end]
                    next_at[i] = end
                right_at[to], left_at[end] = end, to
                if old:
                    moves.setdefault(old * span + copies, []).append(to)
            owner = -1
            for key in sorted(moves) if len(moves) > 1 else moves:
                old, new = key // span, len(lower)
                insert(new - 1 if old == owner else old)
                for to in moves[key]:
                    group_at[to] = new
                members.append(moves[key])
                owner = old
        g = lower[g]
    ascending, g = [], 0
    while g >= 0:
        ascending.append(g)
        g = higher[g]
    rank = np.zeros(len(lower), np.int64)
    rank[ascending] = np.arange(len(ascending))
    return rank[group], following


def _held(positions: np.ndarray):
    return positions if len(positions) >= _LOOP else positions.tolist()


def emitted(group: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The suffix array: groups in ascending order, the members of one in the order of the suffixes that follow their prefix.

    Those suffixes lie in lower groups, so their places are known; groups are taken together
    until one follows on another of them. A prefix may also be followed by itself: then its
    group is emitted in waves, each behind the one it follows on.
    """
    n = len(group)
    _, group = np.unique(group, return_inverse=True)
    out = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(group[out]) > 0])
    place = np.empty(n, np.int64)
    place[out] = np.arange(n)  # right for the separators, all others are set below
    needs = np.maximum.reduceat(group[following[out]], starts).tolist()
    ready = np.zeros(n, bool)  # what the present wave has put in place
    bounds = [*starts.tolist(), n]

    def put(begin: int, held: np.ndarray) -> int:
        end = begin + len(held)
        out[begin:end], place[held] = held, np.arange(begin, end)
        return end

    low = 1
    for g in range(2, len(starts) + 1):
        if g < len(starts) and needs[g] < low and needs[low] < low:
            continue
        held = out[bounds[low] : bounds[g]]
        if needs[low] < low:
            put(bounds[low], held[np.argsort(group[held] * n + place[following[held]], kind="stable")])
        else:  # one group
            own = group[following[held]] == low
            wave, rest, at = held[~own], held[own], bounds[low]
            while len(wave):
                wave = wave[np.argsort(place[following[wave]], kind="stable")]
                at = put(at, wave)
                ready[wave] = True
                goes = ready[following[rest]]
                ready[wave] = False
                wave, rest = rest[goes], rest[~goes]
        low = g
    return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions of a string of positive symbols between zeros, by suffix up to the next zero."""
    return emitted(*lyndon_groups(symbols))


# ------------------------------------------------------------------ stretches


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` bytes."""
    out, length, part, span, base = None, 0, _BYTES[data], 1, _BASE
    with np.errstate(over="ignore"):
        while size:
            if size & 1:
                if out is None:
                    out, length = part, span
                else:
                    n = len(part) - length
                    out = out[:n] * np.uint64(base) + part[length:]
                    length += span
            size >>= 1
            if size:
                part = part[:-span] * np.uint64(base) + part[span:]
                span, base = span * 2, base * base % 2**64
    return mixed(out)


def _smallest(values: np.ndarray, size: int) -> np.ndarray:
    """The smallest of each run of ``size`` values."""
    span = 1
    while span * 2 <= size:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = size - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def stretches(data: np.ndarray, ends: np.ndarray, width: int = WIDTH):
    """All runs of neighbouring strings of ``width`` bytes with one smallest hash: (first string, number of strings, hash).

    ``ends`` are the ends of the texts that lie one behind the other in ``data``; strings never cross them.
    """
    starts = np.r_[0, ends[:-1]]
    for low in range(0, len(data), SLICE):
        part = data[low : low + SLICE + width - 1]
        count = len(part) - width + 1
        if count <= 0:
            return
        near = slice(np.searchsorted(ends, low, side="right"), np.searchsorted(starts, low + count, side="left"))
        barred = np.zeros(count + 1, np.int32)
        np.add.at(barred, np.clip(np.maximum(starts[near], ends[near] - width + 1) - low, 0, count), 1)
        np.add.at(barred, np.clip(ends[near] - low, 0, count), -1)
        fits = np.cumsum(barred)[:count] == 0
        least = _smallest(_grams(part, GRAM), width - GRAM + 1)
        new = fits.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~fits[:-1]
        first = np.flatnonzero(new)
        if not len(first):
            continue
        stop = fits.copy()
        stop[:-1] &= (least[1:] != least[:-1]) | ~fits[1:]
        size = np.flatnonzero(stop) - first + 1
        key = mixed(least[first])  # the smallest of many are no even spread
        if size.max() > LONGEST:
            pieces = -(-size // LONGEST)
            again = np.repeat(np.arange(len(first)), pieces)
            at = (np.arange(len(again)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * LONGEST
            first, size, key = first[again] + at, np.minimum(LONGEST, size[again] - at), key[again]
        yield first + low, size, key


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and their ends."""
    column = batch["text"].cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[1:] - offsets[0]


def _looked_at(batches: Iterator[pa.RecordBatch], standing, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows that stand for their copies."""
    for batch in batches:
        rows = batch["row"].to_numpy().view(np.uint64)
        yield batch.filter(pa.array(in_bitmap(standing, mixed(rows), bits)))


def _counted(standing, bits: int, width: int):
    """hash -> how many documents of this batch hold it (2: two or more), and in how many different stretches (upper half)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _looked_at(batches, standing.value, bits):
            data, ends = _texts(batch)
            found = [[*x, np.searchsorted(ends, x[0], side="right")] for x in stretches(data, ends, width)]
            if not found:
                continue
            first, size, key, doc = (np.concatenate(x) for x in zip(*found, strict=True))
            doc = batch["_id"].to_numpy()[doc]
            # the first bytes and the length tell stretches apart well enough for an estimate
            alike = data[first].astype(np.int64) | data[first + 8].astype(np.int64) << 8 | data[first + size + width - 2].astype(np.int64) << 16 | size << 24
            order = np.argsort(key)
            key, doc, alike = key[order], doc[order], alike[order]
            new = np.r_[True, key[1:] != key[:-1]]
            at = np.flatnonzero(new)
            # most keys stand once; only the others need their stretches in order
            inside = np.flatnonzero(~(new & np.r_[new[1:], True]))
            alike[inside] = alike[inside[np.lexsort((alike[inside], key[inside]))]]
            several = np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at)
            kinds = np.add.reduceat((new | np.r_[True, alike[1:] != alike[:-1]]).astype(np.int64), at)
            yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(1 + several + (kinds << 32))], ["hash", "n"])

    return run


class _Chosen:
    """Stretches of a batch whose hash several documents hold, hot ones string by string."""

    def __init__(self, known, known_bits: int, hot, hot_bits: int, width: int) -> None:
        self.known, self.known_bits, self.hot, self.hot_bits, self.width = known, known_bits, hot, hot_bits, width

    def of(self, batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes, first, number of strings, key, row of the batch, start of its text) of each slice."""
        data, ends = _texts(batch)
        text, starts = data.tobytes(), np.r_[0, ends[:-1]]
        for first, size, key in stretches(data, ends, self.width):
            keep = in_bitmap(self.known.value, key, self.known_bits)
            first, size, key = first[keep], size[keep], key[keep]
            if self.hot is not None:
                hot = in_bitmap(self.hot.value, key, self.hot_bits)
                again = np.repeat(np.arange(len(first)), np.where(hot, size, 1))
                inside = np.arange(len(again)) - np.repeat(np.flatnonzero(np.r_[True, again[1:] != again[:-1]])[: len(first)], np.where(hot, size, 1))
                first, key, size = first[again] + inside, key[again], np.where(hot[again], 1, size[again])
                for i in np.flatnonzero(hot[again]).tolist():
                    key[i] = xxhash.xxh3_64_intdigest(text[first[i] : first[i] + self.width])
            doc = np.searchsorted(ends, first, side="right")
            yield text, first, size, key, doc, starts[doc]


def _sent(chosen: _Chosen, standing, bits: int):
    """key, bytes and smallest id of each different stretch of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _looked_at(batches, standing.value, bits):
            ids = batch["_id"].to_numpy()
            held: dict[bytes, list[int]] = {}

            def rows(held=held) -> pa.RecordBatch:
                keys, low, high = (pa.array(x, pa.int64()) for x in zip(*held.values(), strict=True))
                made = pa.RecordBatch.from_arrays([keys, pa.array(list(held), pa.binary()), low, high], ["key", "bytes", "low", "high"])
                held.clear()
                return made

            for text, first, size, key, doc, _ in chosen.of(batch):
                for at, end, k, i in zip(first.tolist(), (first + size + chosen.width - 1).tolist(), key.view(np.int64).tolist(), ids[doc].tolist(), strict=True):
                    one = held.setdefault(text[at:end], [k, i, i])
                    if i < one[1]:
                        one[1] = i
                    elif i > one[2]:
                        one[2] = i
                if len(held) > SENT:
                    yield rows()
            if held:
                yield rows()

    return run


def _places(chosen: _Chosen, standing, bits: int):
    """Every place of the stretches: row, digest, first byte, number of strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _looked_at(batches, standing.value, bits):
            for text, first, size, _, doc, start in chosen.of(batch):
                digests = [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(first.tolist(), (first + size + chosen.width - 1).tolist(), strict=True)]
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [batch["_id"].take(rows), batch["_text_hash"].take(rows), pa.array(digests, pa.binary()), pa.array((first - start).astype(np.int32)), pa.array(size.astype(np.int32))],
                    ["_id", "_text_hash", "digest", "first", "size"],
                )

    return run


def repeated_strings(pieces: list[bytes], ids: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For the pieces one behind the other, with a zero before each: is the string starting there held by a smaller id too?"""
    data = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0" * 9, np.uint8)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts = np.cumsum(lengths + 1) - lengths
    symbols = data[: starts[-1] + lengths[-1] + 1].astype(np.int64) + 1
    symbols[starts - 1], symbols[-1] = 0, 0
    piece = np.repeat(np.arange(len(pieces)), lengths + 1)
    piece = np.r_[piece, 0]
    fits = np.zeros(len(symbols) + 1, np.int32)
    np.add.at(fits, starts, 1)
    np.add.at(fits, starts + lengths - width + 1, -1)
    order = suffix_array(symbols)
    order = order[np.cumsum(fits)[order] > 0]
    # neighbours that agree in all bytes, eight at a time
    eights = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
    same = np.arange(1, len(order))
    for at in [width - 8, *range(0, width - 8, 8)] if width >= 8 else []:
        same = same[eights[order[same] + at] == eights[order[same - 1] + at]]
    for at in range(width) if width < 8 else []:
        same = same[data[order[same] + at] == data[order[same - 1] + at]]
    new = np.ones(len(order), bool)
    new[same] = False
    heads = np.flatnonzero(new)
    own = ids[piece[order]]
    least = np.minimum.reduceat(own, heads)[np.cumsum(new) - 1] if len(order) else own
    out = np.zeros(len(symbols), bool)
    out[order[least < own]] = True
    return out


def _meets(pieces: list[bytes], width: int) -> np.ndarray:
    """Which pieces hold a string whose hash stands in a second place; the strings of the others are in no other piece."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    piece = np.repeat(np.arange(len(pieces)), lengths)[: len(data) - width + 1]
    at = np.flatnonzero(np.arange(len(piece)) + width <= np.cumsum(lengths)[piece])
    hashes = _grams(data, width)[at]
    order = np.argsort(hashes)
    twice = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    out = np.zeros(len(pieces), bool)
    out[piece[at[order[twice]]]] = out[piece[at[order[twice + 1]]]] = True
    return out


def _judged(width: int):
    """Suffix arrays over blocks of whole keys: digest, smallest id and runs of strings that go, for stretches that matter."""

    def block(held: dict[bytes, list[int]]) -> pa.RecordBatch:
        pieces = list(held)
        meets = np.flatnonzero(_meets(pieces, width))
        runs: dict[int, list] = {}
        if len(meets):
            pieces, ids = [pieces[i] for i in meets.tolist()], np.fromiter((x[0] for x in held.values()), np.int64, len(held))[meets]
            gone = repeated_strings(pieces, ids, width)
            edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
            low, high = edge[::2], edge[1::2]
            lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
            starts = np.cumsum(lengths + 1) - lengths
            of = np.searchsorted(starts, low, side="right") - 1
            for i, a, b in zip(meets[of].tolist(), (low - starts[of]).tolist(), (high - starts[of]).tolist(), strict=True):
                runs.setdefault(i, []).append({"a": a, "b": b})
        return _judged_rows([(xxhash.xxh3_128_digest(p), x[0], runs.get(i, [])) for i, (p, x) in enumerate(held.items()) if i in runs or x[1] > x[0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        one: dict[bytes, list[int]] = {}  # of the present key
        size, last = 0, None
        alone: list[tuple] = []

        def leave() -> int:
            """Into the block with the stretches of a key; one alone shares its strings with none but its own copies."""
            nonlocal one
            grown = 0
            if len(one) > 1:
                held.update(one)
                grown = sum(map(len, one))
            else:
                alone.extend((xxhash.xxh3_128_digest(p), x[0], []) for p, x in one.items() if x[1] > x[0])
            one = {}
            return grown

        for batch in batches:
            for key, piece, low, high in zip(*(batch[c].to_pylist() for c in ("key", "bytes", "low", "high")), strict=True):
                if key != last:
                    size += leave()
                    if size >= BLOCK:
                        yield block(held)
                        held, size = {}, 0
                    last = key
                x = one.get(piece)
                if x is None:
                    one[piece] = [low, high]
                else:
                    x[0], x[1] = min(x[0], low), max(x[1], high)
            if alone:
                yield _judged_rows(alone)
                alone.clear()
        leave()
        if alone:
            yield _judged_rows(alone)
        if held:
            yield block(held)

    return run


def _judged_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["digest", "low", "runs"])


def _bits(rows: int, spare: int) -> int:
    return min(MOST_BITS, max(16, rows.bit_length() + spare))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and touching spans of a row, as one."""
    apart = 1 << 32  # more than any text is long
    for batch in batches:
        if not len(batch):
            continue
        flat = batch["spans"].flatten()
        start, end = (flat.field(c).to_numpy().astype(np.int64) for c in ("start", "end"))
        row = np.repeat(np.arange(len(batch)), batch["spans"].value_lengths().to_numpy())
        order = np.lexsort((start, row))
        start, end, row = start[order], end[order], row[order]
        # how far the spans up to here reach, rows one behind the other
        reach = np.maximum.accumulate(row * apart + end)
        first = np.flatnonzero(np.r_[True, row[1:] * apart + start[1:] > reach[:-1]])
        last = np.r_[first[1:], len(row)] - 1
        both = [pa.array(x.astype(np.int32)) for x in (start[first], reach[last] - row[last] * apart)]
        offsets = np.r_[0, np.cumsum(np.bincount(row[first], minlength=len(batch)))].astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(both, fields=list(_SPANS.value_type)))
        yield pa.RecordBatch.from_arrays([batch["_id"], batch["_text_hash"], spans], ["_id", "_text_hash", "spans"])


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SPANS_DDL = "_id long, _text_hash long, spans array<struct<start:int,end:int>>"


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """_id, _text_hash (see ``row_key``) and the sorted disjoint byte spans to remove, for rows that have any."""
    spark = docs.sparkSession
    rows = docs.select(*row_key(docs), F.coalesce("text", F.lit("")).alias("text"))
    about = saved(
        rows.select("_id", "_text_hash", F.octet_length("text").alias("n"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha")).filter(F.col("n") >= width),
        "texts",
    )
    firsts = about.groupBy("sha").agg(F.min("_id").alias("first"))
    about = saved(about.join(firsts, "sha").select("_id", "_text_hash", "n", (F.col("_id") == F.col("first")).alias("stands")), "stand")
    whole = about.filter("not stands").distinct()
    whole = whole.select("_id", "_text_hash", F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end"))).alias("spans"))

    share = spark.sparkContext.broadcast
    bits = _bits(about.filter("stands").count(), 4)
    # through the mixer of integers, since numpy has to find the same bit
    standing = share(_row_bitmap(about.filter("stands"), bits))
    texts = rows.filter(F.octet_length("text") >= width).withColumn("row", F.xxhash64("_id", "_text_hash"))

    seen = texts.mapInArrow(_counted(standing, bits, width), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    seen = saved(seen.filter(F.col("n") % (1 << 32) > 1), "hashes")
    known_bits, hot_rows = _bits(seen.count(), 5), seen.filter(F.col("n") >= HOT * (1 << 32))
    known, n_hot = share(bitmap(seen, "hash", known_bits)), hot_rows.count()
    hot_bits = _bits(n_hot, 6)
    hot = share(bitmap(hot_rows, "hash", hot_bits)) if n_hot else None
    chosen = _Chosen(known, known_bits, hot, hot_bits, width)

    sent = texts.mapInArrow(_sent(chosen, standing, bits), "key long, bytes binary, low long, high long")
    judged = (
        sent.repartition("key").sortWithinPartitions("key")
        .mapInArrow(_judged(width), "digest binary, low long, runs array<struct<a:int,b:int>>")
    )
    judged = saved(judged, "judged")
    places = texts.mapInArrow(_places(chosen, standing, bits), "_id long, _text_hash long, digest binary, first int, size int")
    found = places.join(judged, "digest")
    at = F.col("first")
    runs = F.when(F.col("_id") > F.col("low"), F.array(F.struct(at.alias("start"), (at + F.col("size") + width - 1).alias("end")))).otherwise(
        F.transform("runs", lambda r: F.struct((at + r["a"]).alias("start"), (at + r["b"] + width - 1).alias("end")))
    )
    spans = found.select("_id", "_text_hash", runs.alias("spans")).filter(F.size("spans") > 0)
    spans = spans.groupBy("_id", "_text_hash").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    # a copy that the bitmap let through has spans as well; it goes whole
    spans = spans.join(whole.select("_id", "_text_hash"), ["_id", "_text_hash"], "left_anti").mapInArrow(_merged, _SPANS_DDL)
    return saved(whole.unionByName(spans), "spans")


def _row_bitmap(rows: DataFrame, bits: int) -> np.ndarray:
    def scrambled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mixed(batch["row"].to_numpy().view(np.uint64)).view(np.int64))], ["row"])

    return bitmap(rows.select(F.xxhash64("_id", "_text_hash").alias("row")).mapInArrow(scrambled, "row long"), "row", bits)


def _flagged(marked, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _looked_at(batches, marked.value, bits):
            yield batch.drop_columns(["row"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, spans in zip(batch["text"].cast(pa.large_binary()).to_pylist(), batch["spans"].to_pylist(), strict=True):
            at, parts = 0, []
            for s in spans:
                parts.append(text[at : s["start"]])
                at = s["end"]
            kept.append(b"".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays([batch["_id"], batch["_text_hash"], pa.array(kept, pa.binary())], ["_id", "_text_hash", "kept"])


def cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """_id, _text_hash and ``kept``, the remaining bytes, of the rows with spans. Only texts that may have some move."""
    rows = docs.select(*row_key(docs), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("_id", "_text_hash"))
    bits = _bits(spans.count(), 4)
    marked = docs.sparkSession.sparkContext.broadcast(_row_bitmap(spans, bits))
    flagged = rows.mapInArrow(_flagged(marked, bits), "_id long, _text_hash long, text string")
    # repeated rows have the same remaining bytes
    joined = flagged.join(spans, ["_id", "_text_hash"])
    return joined.mapInArrow(_cut, "_id long, _text_hash long, kept binary").dropDuplicates(["_id", "_text_hash"])


def report(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spans = repeated_spans(docs, width)
    text = F.coalesce("text", F.lit("")).cast("binary")
    base = docs.select("doc_id", *row_key(docs), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    partly = spans.join(base.select("_id", "_text_hash", "n_bytes").distinct(), ["_id", "_text_hash"])
    goes = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    partly = saved(partly.withColumn("n_removed", goes).withColumn("n_spans", F.size("spans").cast("long")), "partly")
    kept = cut(docs, partly.filter("n_removed < n_bytes").select("_id", "_text_hash", "spans")).select("_id", "_text_hash", F.sha2("kept", 256).alias("kept"))
    found = partly.select("_id", "_text_hash", "n_removed", "n_spans").join(kept, ["_id", "_text_hash"], "left")
    nothing = F.sha2(F.lit(b""), 256)
    return base.join(found, ["_id", "_text_hash"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.when(F.col("n_removed").isNull(), F.col("sha")).otherwise(F.coalesce("kept", nothing)).alias("kept_sha256"),
    )
