"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Encoding starts from characters and always carries out the best-scored merge of two
neighbours, leftmost first among equals, until none is left. With dropout each
candidate merge is skipped, once and for all, if a keyed hash of (seed, document, place of
the unit in it, place of the merge, lengths) falls below the rate: every occurrence of a
word draws for itself, the same seed gives the same segmentation on any cluster, other
seeds give other ones. Every segmentation decodes to the same text.

A text falls into units (blanks and the characters up to the next blank or line end),
since no piece of the vocabulary reaches across; this is checked when a vocabulary is
read. The plain segmentation of a unit and its merges are found once and remembered (up
to REMEMBERED units, then anew); texts are taken in chunks of CHUNK_CHARS characters, so a
task holds little more than its batch of rows and its longest text need. Dropout that skips none of these merges changes nothing,
so occurrences are drawn against them first; those that lose one are segmented again, each
with its own draws, all of a batch together in numpy; very long units use a heap.
Documents are independent: no shuffle.

Blanks become the piece mark; a piece mark in the text itself, and any character the
vocabulary lacks, is spelled in byte pieces. Null texts give null ids, empty texts
none, repeated rows the same ids; rows without doc_id draw alike. Texts of any length are
taken whole, an empty table gives no rows. Merges of equal rank have no tie: the leftmost
is first. Other columns play no part.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import mixed

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
REMEMBERED = 150_000
LONG_UNIT = 48
CHUNK_CHARS = 500_000
_NEVER = np.int32(2**31 - 1)


@dataclass
class Vocabulary:
    """What segmentation and decoding need: no larger than the vocabulary file."""

    pieces: list[bytes]  # what each id stands for in a text
    chars: dict[str, int]  # ids of single characters
    byte_ids: np.ndarray  # ids of the 256 byte pieces
    slots: np.ndarray  # hash table of merges: left * 2**32 + right, or -1
    merged: np.ndarray
    rank: np.ndarray
    probes: int

    @staticmethod
    def read(path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = {
            model.id_to_piece(i): i
            for i in range(size)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        }
        byte_ids = np.full(256, -1, np.int32)
        pieces = [b""] * size
        for i in range(size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                byte_ids[value], pieces[i] = i, bytes([value])
        for text, i in plain.items():
            pieces[i] = text.replace(MARK, " ").encode()
            if re.search(f"[^{MARK}]{MARK}", text) or (len(text) > 1 and "\n" in text):
                raise ValueError(f"a piece reaches across units: {text!r}")
        if (byte_ids < 0).any():
            raise ValueError("the vocabulary must hold all byte pieces")
        # better scores first, smaller ids first among equal ones
        order = {i: r for r, i in enumerate(sorted(plain.values(), key=lambda i: (-model.get_score(i), i)))}
        merges = [
            (plain[text[:at]] << 32 | plain[text[at:]], i, order[i])
            for text, i in plain.items()
            for at in range(1, len(text))
            if text[:at] in plain and text[at:] in plain
        ]
        bits = max(4, int(len(merges) * 8).bit_length())
        slots, merged, rank = np.full(2**bits, -1, np.int64), np.zeros(2**bits, np.int32), np.zeros(2**bits, np.int32)
        probes, homes = 1, mixed(np.array([m[0] for m in merges], np.uint64)) >> np.uint64(64 - bits)
        for home, (key, i, r) in zip(homes.tolist(), merges, strict=True):
            at, n = home, 1
            while slots[at] >= 0:
                at, n = (at + 1) % 2**bits, n + 1
            slots[at], merged[at], rank[at], probes = key, i, r, max(probes, n)
        return Vocabulary(pieces, {t: i for t, i in plain.items() if len(t) == 1}, byte_ids, slots, merged, rank, probes)

    def symbols(self) -> np.ndarray:
        """Code point to symbol: an id, or minus 2 minus the code point where the vocabulary lacks it."""
        table = -2 - np.arange(0x110000, dtype=np.int32)
        for char, i in self.chars.items():
            table[ord(char)] = i
        table[ord(MARK)] = -2 - ord(MARK)
        if MARK in self.chars:
            table[32] = self.chars[MARK]
        return table

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of pairs of symbols; rank _NEVER where they make no piece."""
        keys = left.astype(np.int64) << 32 | right
        size = len(self.slots)
        at = (mixed(keys.view(np.uint64)) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)
        held = self.slots[at]
        found = (held == keys) & (left >= 0) & (right >= 0)
        rank, merged = np.where(found, self.rank[at], _NEVER), np.where(found, self.merged[at], 0)
        open_ = np.flatnonzero((held != keys) & (held >= 0) & (left >= 0) & (right >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            place = (at[open_] + step) % size
            held = self.slots[place]
            hit = held == keys[open_]
            rank[open_[hit]], merged[open_[hit]] = self.rank[place[hit]], self.merged[place[hit]]
            open_ = open_[~hit & (held >= 0)]
        return rank, merged


def _skipped(keys, start, left, right, limit: int):
    """Does the keyed hash skip the merge of the symbols at ``start`` with these lengths?"""
    with np.errstate(over="ignore"):
        place = start.astype(np.uint64) << np.uint64(40) | left.astype(np.uint64) << np.uint64(20) | right.astype(np.uint64)
        return (mixed(keys ^ mixed(place + np.uint64(1))) >> np.uint64(1)) < np.uint64(limit)


def segment_long(symbols: np.ndarray, key: np.uint64, limit: int, vocabulary: Vocabulary, merges: list | None = None) -> list[int]:
    """One unit with a heap as agenda: for units of any length. ``merges`` gets (start, lengths) of each merge."""
    n = len(symbols)
    held, size = symbols.astype(np.int64).tolist(), [1] * n
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    agenda: list[tuple[int, int, int, int, int]] = []

    def offer(lefts: list[int]) -> None:
        if not lefts:
            return
        rights = [after[i] for i in lefts]
        a, b = np.array([held[i] for i in lefts], np.int64), np.array([held[i] for i in rights], np.int64)
        rank, merged = vocabulary.look_up(a, b)
        na, nb = np.array([size[i] for i in lefts]), np.array([size[i] for i in rights])
        drop = _skipped(np.full(len(lefts), key), np.array(lefts), na, nb, limit)
        for i, r, m, d, x, y in zip(lefts, rank.tolist(), merged.tolist(), drop.tolist(), na.tolist(), nb.tolist(), strict=True):
            if r < _NEVER and not d:
                heapq.heappush(agenda, (r, i, x, y, m))

    offer(list(range(n - 1)))
    while agenda:
        _, i, x, y, m = heapq.heappop(agenda)
        j = after[i] if size[i] == x else -1
        if j < 0 or size[j] != y or size[i] != x:
            continue
        if merges is not None:
            merges.append((i, x, y))
        held[i], size[i], size[j], after[i] = m, x + y, 0, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer([k for k in (before[i], i) if k >= 0 and after[k] >= 0])
    out, i = [], 0
    while 0 <= i < n:
        out.append(held[i])
        i = after[i]
    return out


def _segment_block(symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray, limit: int, vocabulary: Vocabulary, merges: list | None = None):
    """Units of similar length together: (symbols, counts) after all merges, one row a unit.

    ``merges`` gets (row, start, lengths) of all merges, as arrays.
    """
    n, width = symbols.shape
    columns = np.arange(width + 1)
    start = np.minimum(columns[None, :width], sizes[:, None]).astype(np.int32)
    start = np.concatenate([start, sizes[:, None].astype(np.int32)], axis=1)  # past the end: where the unit ends

    def ranks(rows, cols, held, start, keys):
        rank, merged = vocabulary.look_up(held[rows, cols], held[rows, cols + 1])
        a, b = start[rows, cols], start[rows, cols + 1]
        drop = _skipped(keys[rows], a, b - a, start[rows, cols + 2] - b, limit)
        return np.where(drop, _NEVER, rank), merged

    out, counts = np.full((n, width), -1, np.int32), sizes.copy()
    if width == 1:
        return symbols, counts
    held = symbols.copy()
    rows, cols = np.nonzero(columns[None, 1:width] < sizes[:, None])
    rank, merged = np.full((n, width - 1), _NEVER, np.int32), np.zeros((n, width - 1), np.int32)
    rank[rows, cols], merged[rows, cols] = ranks(rows, cols, held, start, keys)
    index = np.arange(n)
    while len(index):
        width = held.shape[1]
        if width == 1:
            out[index, :1], counts[index] = held, sizes
            break
        best = rank.argmin(axis=1)
        here = np.arange(len(index))
        going = rank[here, best] < _NEVER
        done = index[~going]
        out[done, :width] = held[~going]
        counts[done] = sizes[~going]
        if not going.all():
            index, held, start, rank, merged, keys, sizes, best = (
                x[going] for x in (index, held, start, rank, merged, keys, sizes, best)
            )
            here = np.arange(len(index))
        if not len(index):
            break
        held[here, best] = merged[here, best]
        if merges is not None:
            a, b, c = (start[here, best + k] for k in range(3))
            merges.append((index, a, b - a, c - b))
        # close the gap behind the merged symbol: every row loses one
        n = len(index)
        keep = columns[None, : width + 1] != best[:, None] + 1
        held, start = held[keep[:, :width]].reshape(n, width - 1), start[keep].reshape(n, width)
        keep = columns[None, : width - 1] != np.minimum(best + 1, width - 2)[:, None]
        rank, merged = rank[keep].reshape(n, width - 2), merged[keep].reshape(n, width - 2)
        sizes = sizes - 1
        for shift in (-1, 0):
            col = best + shift
            row = np.flatnonzero((col >= 0) & (col + 1 < sizes))
            other = np.flatnonzero((col >= 0) & (col + 1 >= sizes) & (col < width - 2))
            rank[other, col[other]] = _NEVER
            if len(row):
                rank[row, col[row]], merged[row, col[row]] = ranks(row, col[row], held, start, keys)
    return out, counts


_UNIT = re.compile(r" *[^ \n]+|\n| +")


def units_of(text: str) -> list[str]:
    return _UNIT.findall(" " + text) if text else []


class _Numbers(dict):
    """Numbers units in the order they come."""

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        return number


class Encoder:
    """Encodes batches of texts; ``rate`` 0 is plain BPE."""

    def __init__(self, vocabulary: Vocabulary, rate: float, seed: int):
        self.vocabulary = vocabulary
        self.salt = mixed(np.array([seed % 2**64], np.uint64))[0]  # near seeds are no near keys
        self.limit = int(rate * 2**63)
        self.table = vocabulary.symbols()
        self._forget()

    def _forget(self) -> None:
        self.known = _Numbers()
        none = np.zeros(0, np.int64)
        # of the plain segmentations: ids, where each unit's begin, merges, where each unit's begin
        self.ids, self.id_ends = none.astype(np.int32), np.zeros(1, np.int64)
        self.merges, self.merge_ends = np.zeros((3, 0), np.int32), np.zeros(1, np.int64)

    def _segment(self, units: list[str], keys: np.ndarray, limit: int, merges: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of units, each with its own dropout key."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        flat = self.table[points]
        begin = np.concatenate([[0], np.cumsum(sizes)])
        owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]  # symbols, those of a unit together
        low = 0
        for high in (1, 2, 4, 6, 8, 12, 16, 24, 32, LONG_UNIT):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            for part in np.array_split(rows, max(1, len(rows) * high // 2_000_000)):
                if not len(part):
                    continue
                at = begin[part][:, None] + np.arange(high)[None, :]
                inside = np.arange(high)[None, :] < sizes[part][:, None]
                block = np.where(inside, flat[np.minimum(at, len(flat) - 1)], -1).astype(np.int32)
                done: list | None = None if merges is None else []
                held, counts = _segment_block(block, sizes[part], keys[part], limit, self.vocabulary, done)
                if merges is not None:
                    merges += [(part[rows], *rest) for rows, *rest in done]
                owners.append(np.repeat(part, counts))
                found.append(held[np.arange(high)[None, :] < counts[:, None]])
        for i in np.flatnonzero(sizes > LONG_UNIT).tolist():
            steps: list = []
            found.append(np.array(segment_long(flat[begin[i] : begin[i + 1]], keys[i], limit, self.vocabulary, steps), np.int32))
            owners.append(np.full(len(found[-1]), i))
            if merges is not None and steps:
                merges.append((np.full(len(steps), i), *np.array(steps).T))
        owner, symbols = np.concatenate(owners), np.concatenate(found)
        unknown = np.flatnonzero(symbols < 0)
        if len(unknown):
            spelled = [self._spelled(x) for x in symbols[unknown].tolist()]
            sizes = np.ones(len(symbols), np.int64)
            sizes[unknown] = [len(x) for x in spelled]
            owner, symbols = np.repeat(owner, sizes), np.repeat(symbols, sizes)
            symbols[symbols < 0] = np.concatenate(spelled)
        counts = np.bincount(owner, minlength=len(units))
        ids = np.empty(len(symbols), np.int32)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else owner
        # from the place among what was found to the place in the order of units
        move = (np.cumsum(counts) - counts)[owner[first]] - first
        ids[np.arange(len(symbols)) + np.repeat(move, counts[owner[first]])] = symbols
        return ids, counts

    def _remember(self, units: list[str]) -> None:
        """The plain segmentations of new units, and the merges that lead to them."""
        merges: list = []
        ids, counts = self._segment(units, np.zeros(len(units), np.uint64), 0, merges if self.limit else None)
        self.ids = np.concatenate([self.ids, ids])
        self.id_ends = np.concatenate([self.id_ends, self.id_ends[-1] + np.cumsum(counts)])
        rows, *rest = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*merges, strict=True)) if merges else np.zeros((4, 0), np.int64)
        order = np.argsort(rows, kind="stable")
        self.merges = np.concatenate([self.merges, np.array(rest, np.int32)[:, order]], axis=1)
        self.merge_ends = np.concatenate([self.merge_ends, self.merge_ends[-1] + np.cumsum(np.bincount(rows, minlength=len(units)))])

    def _changed(self, unit: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The occurrences whose draws skip a merge of the plain segmentation."""
        counts = self.merge_ends[unit + 1] - self.merge_ends[unit]
        past = np.cumsum(counts)
        of = np.repeat(np.arange(len(unit)), counts)
        at = np.arange(len(of)) + np.repeat(self.merge_ends[unit] - (past - counts), counts)
        start, left, right = self.merges[:, at]
        return np.unique(of[_skipped(keys[of], start, left, right, self.limit)])

    def _spelled(self, symbol: int) -> list[int]:
        """The id of a piece, or the byte pieces of a character the vocabulary lacks."""
        if symbol >= 0:
            return [symbol]
        return [int(self.vocabulary.byte_ids[b]) for b in chr(-2 - symbol).encode("utf-8", "surrogatepass")]

    def encode(self, texts: list[str | None], documents: np.ndarray) -> list[np.ndarray | None]:
        """Ids of each text; ``documents`` is a 64-bit key of each, part of the key of its draws."""
        if len(self.known) > REMEMBERED:
            self._forget()
        known, old = self.known, len(self.known)
        numbers, lengths = [], []
        for text in texts:
            found = units_of(text) if text else []
            numbers.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
            lengths.append(len(found))
        if not any(lengths):
            return [None if t is None else np.zeros(0, np.int32) for t in texts]
        names = list(known)
        if len(known) > old:
            self._remember(names[old:])
        unit = np.concatenate(numbers)
        begin = np.concatenate([[0], np.cumsum(lengths)])
        first, size, pool = self.id_ends[unit], self.id_ends[unit + 1] - self.id_ends[unit], self.ids
        if self.limit:
            with np.errstate(over="ignore"):
                place = np.arange(len(unit), dtype=np.uint64) - np.repeat(begin[:-1], lengths).astype(np.uint64)
                keys = mixed(np.repeat(mixed(documents ^ self.salt), lengths) + place)
            changed = self._changed(unit, keys)
            ids, counts = self._segment([names[i] for i in unit[changed].tolist()], keys[changed], self.limit)
            first[changed] = len(pool) + np.cumsum(counts) - counts
            size[changed] = counts
            pool = np.concatenate([pool, ids])
        past = np.cumsum(size)
        flat = pool[np.arange(past[-1]) - np.repeat(past - size - first, size)]
        ends = np.concatenate([[0], past])[begin]
        return [None if t is None else flat[a:b] for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True)]


def decode(ids: list[int] | np.ndarray, pieces: list[bytes]) -> bytes:
    """The text's UTF-8; the blank that encoding puts first is taken off again."""
    return b"".join(map(pieces.__getitem__, ids))[1:]


def _decoded(values: np.ndarray, ends: np.ndarray, joined: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """As ``decode``, of many lists of ids at once; ``joined`` and ``sizes`` are of all pieces."""
    size = sizes[values]
    past = np.r_[0, np.cumsum(size)]
    first = (np.cumsum(sizes) - sizes)[values] - past[:-1]
    flat = joined[np.arange(past[-1]) + np.repeat(first, size)].tobytes()
    return [flat[a + 1 : b] for a, b in zip(past[ends[:-1]].tolist(), past[ends[1:]].tolist(), strict=True)]


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of bounded text size, at least one row each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy().astype(np.int64))
    low = 0
    while low < len(batch):
        done = sizes[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, done + CHUNK_CHARS)))
        yield batch.slice(low, high - low)
        low = high


def _encode(vocabulary, rate: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value, rate, seed)
        stand_for = encoder.vocabulary.pieces
        joined, sizes = np.frombuffer(b"".join(stand_for), np.uint8), np.fromiter(map(len, stand_for), np.int64, len(stand_for))
        for whole in batches:
            for batch in _chunks(whole):
                texts = batch["text"].to_pylist()
                keys = batch["key"].to_numpy().view(np.uint64)
                ids = encoder.encode(texts, keys)
                ends = np.cumsum([0, *(0 if i is None else len(i) for i in ids)])
                values = np.concatenate([np.zeros(0, np.int32), *(i for i in ids if i is not None)])
                exact = [t is None or back == t.encode("utf-8") for t, back in zip(texts, _decoded(values, ends, joined, sizes), strict=True)]
                missing = pa.array([i is None for i in ids], pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values), mask=missing)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], lists, pa.array(exact, pa.bool_())], names=["doc_id", "ids", "lossless"]
                )

    return run


def encode(docs: DataFrame, rate: float = 0.1, seed: int = 17, model: str = MODEL) -> DataFrame:
    """doc_id, ids, lossless (does decoding give the text back?) of every row."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(model))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long")).alias("key"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(_encode(vocabulary, rate, seed), "doc_id bigint, ids array<int>, lossless boolean")


def decode_column(docs: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """Adds ``text``: what the ids stand for; null ids give a null text."""
    pieces = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(model).pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode(x, pieces.value).decode("utf-8") for x in batch[ids].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    from pyspark.sql import types as T

    source = docs.drop("text")
    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("text", T.StringType())]))
