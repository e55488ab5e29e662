"""Benchmark decontamination by winnowing.

Documents and benchmark items are sequences of words (A-Z folded, runs of digits,
letters and all code points from 0x80). Of every run of WINDOW consecutive k-gram
hashes the smallest is kept as a fingerprint, on both sides by the same rule, so
two texts that share SPAN = WINDOW + GRAM - 1 consecutive words always share a
fingerprint inside that span. Shared fingerprints are joined and each meeting is
extended word by word; only runs of SPAN equal words count.

An item shorter than SPAN words is one window of its own length. Winnowing cannot
promise to find it, so its whole sequence is its fingerprint, and documents give
all runs of the lengths that occur among such items.

Documents send a fingerprint, with the few words around it, only where a bitmap of
fixed size over all benchmark fingerprints has its bit set; the texts themselves
never move. A passage that very many documents hold is spread over salts.

Nulls and texts without words have no words and no hits; items without words are
ignored, items without an id mark words but are not listed. Repeated documents are
judged row by row; repeated items count once per id. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import bitmap, gram_hashes, in_bitmap, row_key, rows_without, saved

GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
BITS = 24
SALTS = 16

# what is no word byte becomes a blank, A-Z become a-z
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_FOUND = pa.list_(
    pa.struct([("at", pa.int32()), ("low", pa.int32()), ("size", pa.int32()), ("fingerprint", pa.int64()), ("near", pa.binary())])
)
_FOUND_DDL = "array<struct<at:int,low:int,size:int,fingerprint:bigint,near:binary>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def winnowed(grams: np.ndarray) -> np.ndarray:
    """Positions that are smallest in at least one window of WINDOW k-grams (all of equal ones)."""
    n = len(grams) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(grams, WINDOW).min(axis=1)
    # the windows around position i: the largest of their minima equals grams[i] iff i wins one of them
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)])
    best = np.lib.stride_tricks.sliding_window_view(padded, WINDOW).max(axis=1)
    return np.flatnonzero(best == grams)


def _around(words: list[bytes], at: int, size: int, fingerprint: int) -> dict:
    low, high = (max(0, at - SPAN + size), at + SPAN) if size == GRAM else (at, at + abs(size))
    return {"at": at, "low": low, "size": size, "fingerprint": fingerprint, "near": b" ".join(words[low:high])}


def _fingerprints(words: list[bytes], short: tuple[int, ...], item: bool, keep=None) -> list[dict]:
    """Fingerprints with the words around them; size is GRAM, or minus the length of a short item."""
    out = []
    if not words or (len(words) < SPAN and not short and not item):
        return out
    hashes = word_hashes(words)
    sizes = [GRAM] if len(words) >= SPAN else []
    sizes += [-n for n in short if len(words) >= n] if not item else [-len(words)] if len(words) < SPAN else []
    for size in sizes:
        grams = gram_hashes(hashes, abs(size))
        at = winnowed(grams) if size == GRAM else np.arange(len(grams))
        found = grams[at] ^ np.uint64(0 if size == GRAM else 0xA5A5A5A5)
        if keep is not None:
            ok = keep(found)
            at, found = at[ok], found[ok]
        out += [_around(words, i, size, f) for i, f in zip(at.tolist(), found.view(np.int64).tolist(), strict=True)]
    return out


def _scan(short: tuple[int, ...], item: bool, filter_words=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None
        if filter_words is not None:
            bits = filter_words.value
            keep = lambda found: in_bitmap(bits, found, BITS)
        for batch in batches:
            counts, found = [], []
            for text in batch["text"]:
                words = words_of(text.as_py())
                counts.append(len(words))
                found.append(_fingerprints(words, short, item, keep))
            rest = [batch[name] for name in batch.schema.names if name != "text"]
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(counts, pa.int64()), pa.array(found, _FOUND)], names=[*names, "n_words", "found"]
            )

    return run


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the words around shared fingerprints; keep runs of at least SPAN words, or whole short items."""
    for batch in batches:
        rows, items, starts, ends = [], [], [], []
        for r in batch.to_pylist():
            ours, theirs = r["near"].split(b" "), r["item_near"].split(b" ")
            i, j = r["at"] - r["low"], r["item_at"] - r["item_low"]
            if r["size"] < 0:
                start, end = (i, i + len(theirs)) if ours == theirs else (0, 0)
            else:
                if ours[i : i + GRAM] != theirs[j : j + GRAM]:
                    continue
                start, end = i, i + GRAM
                while start > 0 and start - i + j > 0 and ours[start - 1] == theirs[start - i + j - 1]:
                    start -= 1
                while end < len(ours) and end - i + j < len(theirs) and ours[end] == theirs[end - i + j]:
                    end += 1
                if end - start < SPAN:
                    continue
            if end > start:
                rows.append(r["_row"])
                items.append(r["item_id"])
                starts.append(start + r["low"])
                ends.append(end + r["low"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), pa.array(items, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
            names=["_row", "item_id", "first", "past"],
        )


def scan(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with ``_row``, ``doc_id``, ``n_words`` and the row key; hits ``_row, item_id, first, past``).

    A hit covers the document's words from ``first`` up to, not with, ``past``.
    """
    spark = docs.sparkSession
    binary = F.col("text").cast("binary").alias("text")
    items = saved(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), binary).mapInArrow(
            _scan((), True), f"item_id bigint, n_words bigint, found {_FOUND_DDL}"
        ),
        "benchmark",
    )
    short = tuple(
        sorted(r.n_words for r in items.filter(F.col("n_words").between(1, SPAN - 1)).select("n_words").distinct().collect())
    )
    flat = items.select("item_id", F.explode("found").alias("f")).select(
        "item_id",
        F.col("f.at").alias("item_at"),
        F.col("f.low").alias("item_low"),
        F.col("f.near").alias("item_near"),
        F.col("f.size").alias("size"),
        F.col("f.fingerprint").alias("fingerprint"),
    )
    filter_words = spark.sparkContext.broadcast(bitmap(flat, "fingerprint", BITS))
    scanned = saved(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(docs), binary)
        .mapInArrow(_scan(short, False, filter_words), f"doc_id bigint, _id bigint, _text_hash bigint, n_words bigint, found {_FOUND_DDL}")
        .withColumn("_row", F.monotonically_increasing_id()),
        "scanned",
    )
    ours = (
        scanned.select("_row", F.explode("found").alias("f"))
        .select("_row", "f.*")
        .withColumn("salt", F.pmod(F.col("_row"), F.lit(SALTS)).cast("int"))
    )
    theirs = flat.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = ours.join(theirs, ["fingerprint", "size", "salt"]).mapInArrow(
        _extend, "_row bigint, item_id bigint, first int, past int"
    )
    return scanned.drop("found"), saved(hits, "hits")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document row: words, hit words and the items whose windows occur."""
    scanned, hits = scan(docs, benchmark)
    positions = (
        hits.select("_row", "first", "past")
        .distinct()
        .select("_row", F.explode(F.sequence("first", F.col("past") - 1)).alias("at"))
        .distinct()
        .groupBy("_row")
        .agg(F.count(F.lit(1)).alias("n_hit"))
    )
    listed = (
        hits.filter(F.col("item_id").isNotNull())
        .select("_row", "item_id")
        .distinct()
        .groupBy("_row")
        .agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    )
    out = scanned.join(positions, "_row", "left").join(listed, "_row", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "_id",
        "_text_hash",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        items.alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with their columns as they are."""
    scanned, hits = scan(docs, benchmark)
    bad = scanned.join(hits.select("_row").distinct(), "_row", "left_semi").select("_id", "_text_hash")
    return rows_without(docs, bad, row_key(docs))
