"""Secret scans with a random forest that removes false positives.

Candidates are runs of key characters with a digit in them, and whatever is assigned to a
telling name (password, token, api_key ...), of any characters and length. Each is described by its
length and character shares, the transitions between character kinds, how much of it
dictionary words cover (the DICTIONARY most frequent words of the corpus, counted over
all documents), its path (the document's source) and the words beside it. A forest
trained on labelled findings gives each candidate the probability of being a secret.

``weak_labels`` labels findings by rules of high precision (known key formats, values
assigned to telling names; and known formats of other things), for corpora without
hand-labelled findings; what no rule knows is not used for training. Training takes a
bounded sample (SAMPLE / 2 findings of each label, smallest hash first), and the chances
are corrected for the two rates; everything else covers all data.

Null texts have no candidates; a null source is an empty path. Without labelled
findings, or with one label only, every score is the share of secrets (0 if none).
Repeated rows give repeated findings. Words that are equally frequent enter the dictionary
by their text. Long texts take time by their length; an empty table gives no rows. Other
columns play no part.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.common import bounded_sample, frequent, saved

SAMPLE, DICTIONARY, TREES, DEPTH = 20_000, 5_000, 30, 8
BESIDE = 16
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.@-])(?=[A-Za-z+/_.@-]*[0-9])[A-Za-z0-9+/_.@-]{8,}")
_ASSIGNED = re.compile(
    r"(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential)[\w-]{0,40}[\"']?[ \t]*(?::=|=>|=|:)[ \t]*"
    r"(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\s\"',;]+))",
    re.I,
)
_WORDS = re.compile(r"[a-z]{4,12}")
_BEFORE = re.compile(r"([^\W_]+)[^\w]*$")
_AFTER = re.compile(r"[^\w]*([^\W_]+)")
#: Names that announce a secret, and what test data calls itself.
_TELLING = re.compile(r"passw|secret|token|api|key|auth|credential|pwd", re.I)
_TEST = re.compile(r"test|example|sample|fixture|mock|demo", re.I)
_KINDS = 4
#: Partial word counts a task keeps before it hands them on.
_HELD_WORDS = 300_000

_FINDING = "doc_id bigint, start int, value string, before string, after string, assigned boolean, x array<double>"


def _kind(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    held: Counter = Counter()
    for batch in batches:
        for text in batch["text"].to_pylist():
            held.update(_WORDS.findall(text or ""))
            if len(held) > _HELD_WORDS:
                yield rows(held)
                held.clear()
    yield rows(held)


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> set[str]:
    """The most frequent lower-case words; at most ``size`` of them reach the driver."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_words, "word string, n bigint")
    words = saved(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    # rarer words than the ``size`` most frequent ones stay where they are
    top = saved(frequent(words, "n", size).orderBy(F.desc("n"), "word").limit(size), "dictionary")
    return {r.word for r in top.collect()}


def coverage(value: str, words: set[str]) -> float:
    """Share of the characters inside dictionary words, longest words first at each place."""
    low, covered, at = value.lower(), 0, 0
    while at < len(low):
        for size in range(min(12, len(low) - at), 3, -1):
            if low[at : at + size] in words:
                covered, at = covered + size, at + size
                break
        else:
            at += 1
    return covered / max(1, len(low))


def features(value: str, before: str, after: str, assigned: bool, path: str, words: set[str]) -> list[float]:
    kinds = [_kind(c) for c in value]
    pairs = Counter(zip(kinds, kinds[1:], strict=False))
    n, counts = len(value), Counter(value)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    spelled = [pairs[a, b] / max(1, n - 1) for a in range(_KINDS) for b in range(_KINDS)]
    shares = [kinds.count(k) / n for k in range(_KINDS)]
    hexadecimal = sum(c in "0123456789abcdefABCDEF" for c in value) / n
    beside = [float(zlib.crc32(w.lower().encode()) % 64) for w in (before, after)]
    return [
        float(n), entropy, hexadecimal, coverage(value, words), *shares, *spelled,
        float(bool(_TELLING.search(before))), float(assigned), *beside,
        float(bool(_TEST.search(path))), float(zlib.crc32(path.encode()) % 32),
    ]


def candidates(text: str) -> list[tuple[int, int]]:
    """Places of all candidates, in order; one that overlaps a value assigned to a telling name is part of it."""
    named = []
    for found in _ASSIGNED.finditer(text):
        named.append(found.span(found.lastindex))
    out, at = [], 0
    for found in _CANDIDATE.finditer(text):
        low, high = found.span()
        while at < len(named) and named[at][1] <= low:
            out.append(named[at])
            at += 1
        if at == len(named) or high <= named[at][0]:
            out.append((low, high))
    return out + named[at:]


def _find(words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        names = ["doc_id", "start", "value", "before", "after", "assigned", "x"]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.float64())]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text, path in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "source")), strict=True):
                for low, high in candidates(text or ""):
                    left, right = text[max(0, low - 40) : low], text[high : high + 40]
                    before, after = _BEFORE.search(left), _AFTER.match(right)
                    before, after = before.group(1) if before else "", after.group(1) if after else ""
                    assigned = left.rstrip(" \"'")[-1:] in ("=", ":")
                    value = text[low:high]
                    row = [doc_id, low, value, before, after, assigned, features(value, before, after, assigned, path or "", known)]
                    for column, cell in zip(out, row, strict=True):
                        column.append(cell)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return run


def findings(docs: DataFrame, words: set[str]) -> DataFrame:
    """Every candidate with its place (characters from 0), neighbours and features ``x``."""
    held = docs.sparkSession.sparkContext.broadcast(words)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    return rows.mapInArrow(_find(held), _FINDING)


def weak_labels(found: DataFrame) -> Column:
    """1 for known key formats and values of telling names, 0 for known other formats, else null."""
    value = F.col("value")
    key = value.rlike(r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{24,}|AIza[A-Za-z0-9_-]{35})$")
    named = F.col("assigned") & F.col("before").rlike("(?i)^(password|passwd|secret|token|apikey|pwd)$")
    other = value.rlike(r"^[0-9.+-]+$|@.*[.][A-Za-z]{2,}[.]?$|^[0-9]+[.]?[0-9]*$|^[A-Za-z]+[.,]?[0-9]{1,4}[.]?$")
    filler = value.rlike(r"(?i)^(none|null|nil|true|false|yes|no|required|optional|string|changeme|placeholder|example|your[ _-].*|x{3,}|[*.]+|<.*>|[$]?[{].*[}])$")
    return F.when(filler, 0).when(key | named, 1).when(other & ~F.col("assigned"), 0)


def score(found: DataFrame, labels: Column, sample: int = SAMPLE) -> DataFrame:
    """``found`` with ``score``: the forest trained on the labelled ones among them."""
    labelled = found.withColumn("label", labels.cast("double")).filter(F.col("label").isNotNull())
    labelled = saved(labelled.select(F.xxhash64("doc_id", "start", "value").alias("place"), "x", "label"), "labelled")
    kinds = {r.label: r.n for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        share = kinds.get(1.0, 0) / max(1, sum(kinds.values()))
        return found.withColumn("score", F.lit(float(share)))
    each = [bounded_sample(labelled.filter(F.col("label") == label), "place", sample // 2) for label in (0.0, 1.0)]
    chosen = each[0].union(each[1]).orderBy("place", "label").select(array_to_vector("x").alias("vector"), "label").coalesce(1)
    chosen = saved(chosen, "sample")
    # how many findings one of the sample stands for
    rates = [max(1.0, kinds[label] / (sample // 2)) for label in (0.0, 1.0)]
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", probabilityCol="chances", numTrees=TREES, maxDepth=DEPTH, seed=11
    ).fit(chosen)
    judged = forest.transform(found.withColumn("vector", array_to_vector("x")))
    no, yes = (vector_to_array("chances")[i] * rates[i] for i in range(2))
    return judged.withColumn("score", yes / (no + yes)).select(*found.columns, "score")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, start, value, score of every candidate."""
    found = saved(findings(docs, dictionary(docs)), "findings")
    return score(found, weak_labels(found)).select("doc_id", "start", "value", "score")
