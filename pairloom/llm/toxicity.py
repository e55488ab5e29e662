"""Toxicity scores: noisy-channel deobfuscation, then scoring of the restored text.

1. Language model: letter trigrams (accents folded, a class for other letters, one
   for everything between words) are counted over all documents, added up in Spark;
   at most CLASSES**3 sums reach the driver, whatever the input.
2. Deobfuscation: spans that may hide a word (letters mixed with look-alike signs,
   three or more letters or look-alikes, one letter at least, one by one with anything but
   letters and digits between, one letter three times or more) become lattices: what each character may
   stand for, with the cost of the channel; letters one by one are joined unless the
   model finds them cheaper as they are written.
   Viterbi decoding finds the cheapest reading under the language model; every other
   span has a single reading, itself. The decoded spans replace the written ones.
3. Evidence: among a bounded sample of the given labels (SAMPLE rows, smallest hash of
   the doc_id first) the words and word beginnings of restored texts are counted by
   label in Spark; all that speak for label 1 and stand in LEAST_COUNT of its texts form
   the lexicon, which the sample bounds. A word's evidence is that of its best form.
4. A logistic regression turns a text's strongest evidence into a probability. It is
   fitted on the same sample, leaving each text's own counts out.

Null texts count as empty; an empty text gets the score of no evidence. Without
labels, or with one label only, all scores are the share of label 1 (0 if none).
Repeated rows get equal scores; of several labels of a doc_id the largest counts;
null labels are left out. An empty table gives no rows. Scores depend on nothing but the
text, and the time they take grows with its length: in long words only the stretches that
have several readings are decoded. Of equally cheap readings the first one found stays.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pairloom.llm.common import bounded_sample, saved

SAMPLE = 20_000
BEGINNINGS = (4, 5, 6)
LEAST_COUNT = 3
CUT = 0.3
#: Texts of fewer distinct words count as that long, so that shortness alone says nothing.
LEAST_LENGTH = 50

#: What signs look like: fixed values.
LOOK_ALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t",
}

CLASSES = 28
_OTHER = CLASSES - 1
_KNOWN = 0x250


def _class(char: str) -> int:
    base = unicodedata.normalize("NFD", char)[0]
    return ord(base) - 96 if "a" <= base <= "z" else _OTHER if char.isalpha() else 0


def class_table() -> np.ndarray:
    """Character class by code point: 0 between words, 1-26 letters, 27 other letters."""
    table = np.full(0x110000, _OTHER, np.int64)
    table[:_KNOWN] = [_class(chr(c).lower()) for c in range(_KNOWN)]
    table[0x2000:0x2070] = 0
    return table


# ---------------------------------------------------------------- language model


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, total = class_table(), np.zeros(CLASSES**3, np.int64)
    for batch in batches:
        step = 256
        for low in range(0, len(batch), step):
            text = " ".join(x or "" for x in batch["text"].slice(low, step).to_pylist())
            now = table[np.frombuffer(f"  {text} ".lower().encode("utf-32-le", "replace"), np.uint32)]
            one = now[1:-1]
            two = np.where(one == 0, 0, now[:-2])
            codes = (two * CLASSES + one) * CLASSES + now[2:]
            total += np.bincount(codes, minlength=CLASSES**3)
    total[0] = 0
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["code", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Costs (minus log probability) of a class after two others, over all documents."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_trigrams, "code bigint, n bigint")
    sums = counted.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    n3 = np.zeros(CLASSES**3)
    n3[sums["code"].to_numpy()] = sums["n"].to_numpy()
    n3 = n3.reshape(CLASSES, CLASSES, CLASSES)
    n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
    weight = 5.0
    p1 = (n1 + 1) / (n1.sum() + CLASSES)
    p2 = (n2 + weight * p1) / (n2.sum(axis=1, keepdims=True) + weight)
    p3 = (n3 + weight * p2) / (n3.sum(axis=2, keepdims=True) + weight)
    return -np.log(p3)


# ---------------------------------------------------------------- channel and decoding

_SIGN, _AS_WRITTEN, _SPACED, _ONCE, _TWICE = 1.0, 10.0, 0.5, 0.4, 1.1
_PART = re.compile(r"(.)\1*", re.S)


def lattice(span: str, spaced: bool) -> list[list[tuple[str, float]]]:
    """What each run of equal characters may stand for, and at what cost."""
    out = []
    for run in _PART.finditer(span):
        char, size = run.group(1), len(run.group())
        if char in LOOK_ALIKES:
            letters = LOOK_ALIKES[char]
            options = [(x, _SIGN + math.log(len(letters))) for x in letters]
            options += [(x + x, _SIGN + math.log(len(letters)) + _TWICE) for x in letters if size > 1]
            options.append((" ", _SPACED if spaced and char == "!" and run.end() == len(span) else _AS_WRITTEN))
        elif char.isalpha():
            options = [(char * size, 0.0)] if size < 3 else [(char, _ONCE), (char * 2, _TWICE)]
        elif spaced:
            options = [("", _SPACED)]
        else:
            options = [(" ", 0.0)]
        out.append(options)
    return out


def decode(options: list[list[tuple[str, float]]], costs: list[list[list[float]]]) -> str:
    """The cheapest path through a lattice under the language model."""
    return cheapest(options, costs)[1]


def cheapest(options: list[list[tuple[str, float]]], costs: list[list[list[float]]]) -> tuple[float, str]:
    """Cost and text of that path."""
    total, parts = cheapest_parts(options, costs)
    return total, "".join(parts).strip()


def cheapest_parts(options: list[list[tuple[str, float]]], costs: list[list[list[float]]]) -> tuple[float, list[str]]:
    """Its cost and what it takes at each place (Viterbi over the last two classes)."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for choices in [*options, [(" ", 0.0)]]:
        further: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for state, (cost, path) in best.items():
            for text, price in choices:
                (two, one), total = state, cost + price
                for char in text:
                    cls = _CLASS_OF(char)
                    if one or cls:
                        total += costs[two if one else 0][one][cls]
                    two, one = one, cls
                if one == 0:
                    two = 0
                held = further.get((two, one))
                if held is None or total < held[0]:
                    further[two, one] = (total, (text, path))
        best = further
    total, path = min(best.values(), key=lambda x: x[0])
    parts = []
    while path is not None:
        parts.append(path[0])
        path = path[1]
    return total, parts[:0:-1]


def decode_span(span: str, costs: list[list[list[float]]]) -> str:
    """As ``decode(lattice(span, False), costs)`` up to blanks, at the cost of the places with several readings.

    The model looks back two characters, so two characters with one reading on either
    side are all that a choice depends on.
    """
    windows: list[list[int]] = []
    for found in _CHOICE.finditer(span):
        if windows and found.start() - windows[-1][1] <= 4:
            windows[-1][1] = found.end()
        else:
            windows.append([found.start(), found.end()])
    out, at = [], 0
    for low, high in windows:
        out.append(_one_reading(span[at:low]))
        first = max(0, low - 2)
        options = lattice(span[first : high + 2], False)
        # the lattice has a place for each run of equal characters; runs do not reach over the ends of a window
        before = sum(1 for _ in _PART.finditer(span[first:low]))
        inside = sum(1 for _ in _PART.finditer(span[low:high]))
        out += cheapest_parts(options, costs)[1][before : before + inside]
        at = high
    return "".join([*out, _one_reading(span[at:])]).strip()


def _one_reading(text: str) -> str:
    return text if text.isalpha() else "".join(c if c.isalpha() else " " for c in text)


class _Classes(dict):
    def __missing__(self, char):
        self[char] = value = _class(char) if ord(char) < _KNOWN else _OTHER
        return value


_CLASS_OF = _Classes().__getitem__

_SIGNS = re.compile(r"[0134578@$|+]")
_INNER = re.compile(r"[^\W\d_]!+[^\W\d_]")
_TOKEN = re.compile(r"(?<!\S)\S*[0134578@$|+!]\S*")
_RUN = re.compile(r"([^\W\d_])\1\1")
_LETTERS = re.compile(r"[^\W\d_]*")
_CHOICE = re.compile(r"[0134578@$|+!]+|([^\W\d_])\1\1+")
_LOOKS = "".join(re.escape(c) for c in LOOK_ALIKES if not c.isalnum())
#: Letters, digits and look-alikes of which no two letters or digits touch; a look-alike after the last letter needs something before it.
_ONE_BY_ONE = re.compile(rf"(?<!\S)(?:[^\W_]|[{_LOOKS}])(?:[\W_]++[^\W_])*(?:(?:(?![{_LOOKS}])[\W_])++[{_LOOKS}])*(?![^\s.,;:!?])")
_ONE = re.compile(r"[^\W_]")
_LEADING = re.compile(r"(?:[^\w@$+|!]|([@$+|!])\1\1)*")
_TRAILING = re.compile(r"(?:[^\w@$+|]|([@$+|])\1\1)*")  # read from the end
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]{3,}")


def units(span: str) -> list[str]:
    """What stands one by one in a span: letters, digits, look-alikes.

    A look-alike that stands between all letters is no letter itself (k|i|l|l).
    """
    gaps = [set(x) for x in _ONE.split(span)[1:-1]]
    between = set.intersection(*gaps) if len(gaps) > 1 else set()
    return "".join(c if c.isalnum() or (c in LOOK_ALIKES and c not in between) else " " for c in span).split()


class Restorer:
    """Replaces what may hide a word by its decoded reading."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()
        self.known: dict[tuple[str, bool], str] = {}

    def _decoded(self, span: str, spaced: bool) -> str:
        key = (span, spaced)
        if key not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[key] = self._joined(span) if spaced else decode_span(span, self.costs)
        return self.known[key]

    def _joined(self, span: str) -> str:
        """Letters with one blank between any two: joined, or as they are where that is cheaper."""
        joined = lattice(span, True)
        kept = [[(" ", 0.0)] if options == [("", _SPACED)] else options for options in joined]
        (cost, text), (cost_kept, text_kept) = cheapest(joined, self.costs), cheapest(kept, self.costs)
        return text if cost <= cost_kept else text_kept

    def _token(self, found: re.Match) -> str:
        token = found.group()
        core = token[_LEADING.match(token).end() :]
        core = core[: len(core) - _TRAILING.match(core[::-1]).end()]
        if not _LETTER.search(core) or not any(c in LOOK_ALIKES for c in core):
            return token
        return token.replace(core, f" {self._decoded(core, False)} ", 1)

    def _spaced(self, found: re.Match) -> str:
        span = found.group()
        if not _LETTER.search(span):
            return span
        out, decoded = [], False
        for single, parts in groupby(units(span), lambda x: len(set(x)) == 1):
            held = list(parts)
            if single and len(held) > 2:
                held, decoded = [self._decoded(" ".join(held), True)], True
            out += held
        return " ".join(out) if decoded else span

    def restored(self, text: str) -> str:
        text = _ONE_BY_ONE.sub(self._spaced, text.lower())
        if _SIGNS.search(text) or ("!" in text and _INNER.search(text)):
            text = _TOKEN.sub(self._token, text)
        if _RUN.search(text):
            text = self._runs(text)
        return text

    def _runs(self, text: str) -> str:
        """Words with three equal letters in a row, decoded; a word is found from its first such run, to both sides."""
        out, at = [], 0
        for found in _RUN.finditer(text):
            low = found.start()
            if low < at:
                continue
            while low > at and _LETTER.match(text, low - 1):
                low -= 1
            high = _LETTERS.match(text, found.end()).end()
            out += [text[at:low], self._decoded(text[low:high], False)]
            at = high
        return "".join([*out, text[at:]])

    def words(self, text: str | None) -> set[str]:
        return set(_WORD.findall(self.restored(text))) if text else set()


# ---------------------------------------------------------------- evidence and regression


def forms(word: str) -> list[str]:
    """The word and its beginnings, as they stand in the lexicon."""
    return [word, *(word[:n] + "~" for n in BEGINNINGS if len(word) >= n)]


def evidence(t: float, n: float, base: float) -> float:
    """How much more label 1 is likely with these counts than without, in log odds, drawn to 0 when counts are few."""
    strength = 4.0
    p = (t + strength * base) / (t + n + strength)
    return math.log(p / (1 - p)) - math.log(base / (1 - base))


def summary(values: list[float], n_words: int) -> list[float]:
    """What the regression sees: strongest two, how many are strong, length (long texts meet odd words by chance)."""
    top = sorted((v for v in values if v > 0), reverse=True)[:2] + [0.0, 0.0]
    return [top[0], top[1], math.log1p(sum(v > 2.0 for v in values)), math.log1p(max(n_words, LEAST_LENGTH))]


@dataclass
class Model:
    """All that scoring needs; its size is bounded by CLASSES and the labelled sample."""

    costs: np.ndarray
    base: float = 0.0
    counts: dict[str, tuple[int, int]] = field(default_factory=dict)
    weights: list[float] | None = None

    def score(self, values: list[float], n_words: int) -> float:
        if self.weights is None:
            return self.base
        z = sum(w * x for w, x in zip(self.weights, [*summary(values, n_words), 1.0], strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class _Weights(dict):
    """Evidence of a word: that of its strongest form."""

    def __init__(self, model: Model):
        self.table = {form: evidence(t, n, model.base) for form, (t, n) in model.counts.items()}

    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        self[word] = value = max((self.table[f] for f in forms(word) if f in self.table), default=0.0)
        return value


def _restore(costs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(costs.value)
        for batch in batches:
            words = [sorted(restorer.words(x)) for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(words, pa.list_(pa.string()))], names=["toxic", "words"])

    return run


def _count_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = (Counter(), Counter())
        for toxic, words in zip(batch["toxic"].to_pylist(), batch["words"].to_pylist(), strict=True):
            counts[toxic].update({f for w in words for f in forms(w)})
        for toxic in (0, 1):
            names = list(counts[toxic])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([toxic] * len(names), pa.int32()), pa.array(list(counts[toxic].values()), pa.int64())],
                names=["form", "toxic", "n"],
            )


def _left_out(model):
    """Evidence of a labelled text without its own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            rows = []
            for toxic, words in zip(batch["toxic"].to_pylist(), batch["words"].to_pylist(), strict=True):
                values = []
                for word in words:
                    held = [m.counts[f] for f in forms(word) if f in m.counts]
                    values.append(max((evidence(t - toxic, n - (1 - toxic), m.base) for t, n in held), default=0.0))
                rows.append(summary(values, len(words)))
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method; the last weight is the constant."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labels (doc_id, toxic); language statistics come from all of docs."""
    spark = docs.sparkSession
    costs = language_model(docs)
    model = Model(costs)
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    known = bounded_sample(known, "doc_id", sample)
    # bounded by ``sample``, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = rows.join(F.broadcast(known), "doc_id").select("toxic", "text")
    texts = saved(chosen.mapInArrow(_restore(spark.sparkContext.broadcast(costs)), "toxic int, words array<string>"), "labelled")
    sizes = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    model.base = n1 / (n0 + n1) if n0 + n1 else 0.0
    if not n0 or not n1:
        return model
    counted = texts.mapInArrow(_count_forms, "form string, toxic int, n bigint")
    base, strength = F.lit(model.base), F.lit(4.0)
    p = (F.col("t") + strength * base) / (F.col("t") + F.col("n") + strength)
    strongest = (
        counted.groupBy("form")
        .agg(F.sum(F.col("n") * F.col("toxic")).alias("t"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("n"))
        .filter(F.col("t") >= LEAST_COUNT)
        .withColumn("p", p)
        .filter(F.col("p") > base * 2)
    )
    # forms that LEAST_COUNT of at most ``sample`` texts hold
    model.counts = {r.form: (r.t, r.n) for r in strongest.collect()}
    seen = texts.mapInArrow(_left_out(spark.sparkContext.broadcast(model)), "toxic int, x array<double>").toArrow()
    x = np.array(seen["x"].to_pylist(), float).reshape(len(seen), -1)
    model.weights = logistic(x, seen["toxic"].to_numpy().astype(float)).tolist()
    return model


def _score(model, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        restorer, weights = Restorer(m.costs), _Weights(m)
        for batch in batches:
            out = []
            for value in batch[text].to_pylist():
                words = restorer.words(value)
                out.append(m.score([weights[w] for w in words], len(words)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names[:], "_score"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with their columns as they are, and ``_score``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text = f"c{docs.columns.index('text')}"
    schema = T.StructType([*plain.schema.fields, T.StructField("_score", T.DoubleType())])
    return plain.mapInArrow(_score(held, text), schema).toDF(*docs.columns, "_score")


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: every fourth doc_id by checksum is held out."""
    return labels.filter(~held_out(F.col("doc_id")))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their columns as they are."""
    return scored(docs, train(docs, learnable(labels))).filter(F.col("_score") < CUT).select(*docs.columns)
