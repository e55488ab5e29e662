"""One large JSON array, read by many tasks.

Spark's text reader cuts a file into byte ranges at ``}``. A range does not know whether
it begins inside a string, nor how deep. So a first pass runs a small transducer over each
range: for either answer to "does it begin inside a string?" it gives where the range ends and
by how much the depth changes. These few numbers a range are composed in the order of the
file, which gives every range its true start. The second pass cuts the elements out in
parallel, range by range, into chunks of whole elements that are small arrays again; an
element that lies over the border of two or more ranges is put together from its pieces.

What the driver holds is one entry a range, as it does for any scan. Files whose text is
not one JSON array (cut short, something behind the end, a missing comma) give no rows.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.functions import json_text as J
from pairloom.operators.ordering import running_sum
from pairloom.session import stored

# Send the helpers below to the executors as code, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1 << 16

_ESCAPED = re.compile(r"\\.", re.S)
_APART = ("head", "middle", "tail", "last")
_CHUNKS = "path string, range long, seq long, kind string, text string"


def _count(outside: str) -> int:
    return outside.count("{") + outside.count("[") - outside.count("]") - outside.count("}")


def piece_moves(piece: str) -> tuple[bool, int, int]:
    """(does it swap inside and outside?, change of depth if it begins outside, if it begins inside a string).

    A piece ends before a ``}``, which counts when it stands outside.
    """
    if "\\" in piece:
        piece = _ESCAPED.sub("", piece)
    parts = piece.split('"')
    swaps = len(parts) % 2 == 0
    return swaps, sum(map(_count, parts[::2])) - (not swaps), sum(map(_count, parts[1::2])) - swaps


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The transducer of each range: swaps, both changes of depth, bytes and pieces."""
    now, state = None, None
    done: list[tuple] = []
    for batch in batches:
        rows = zip(*(batch[c].to_pylist() for c in ("path", "range", "size", "bytes", "text")), strict=True)
        for path, start, size, length, text in rows:
            if (path, start) != now:
                if now is not None:
                    done.append((*now, *state))
                now, state = (path, start), [size, False, 0, 0, 0, 0]
            swaps, outside, inside = piece_moves(text)
            if state[1]:
                outside, inside = inside, outside
            state[1] ^= swaps
            state[2] += outside
            state[3] += inside
            state[4] += length
            state[5] += 1
    if now is not None:
        done.append((*now, *state))
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = ["path", "range", "size", "swaps", "outside", "inside", "bytes", "pieces"]
    yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names)


def starts_of(ranges: list) -> tuple[dict[tuple[str, int], tuple[bool, int]], set[str]]:
    """(path, range) -> (begins in a string?, depth there), and the files that cannot be arrays.

    ``ranges`` are the rows of the first pass.
    """
    starts, broken = {}, set()
    files: dict[str, list] = {}
    for r in ranges:
        files.setdefault(r["path"], []).append(r)
    for path, held in files.items():
        inside, depth = False, 0
        held.sort(key=lambda r: r["range"])
        for r in held:
            starts[path, r["range"]] = inside, depth
            depth += r["inside"] if inside else r["outside"]
            inside ^= r["swaps"]
        # the last piece of an array ends with the file and not before a }, which was counted all the same
        ended = sum(r["bytes"] + r["pieces"] for r in held) == held[0]["size"] + 1
        if inside or depth != -1 or not ended:
            broken.add(path)
    return starts, broken


def _cut(starts):
    """Chunks of whole elements, and the pieces of elements over a border (head, middle, tail).

    The array ends with an ``end`` (``last`` if that is a piece over a border); ``bad`` is what comes behind it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, seq, inside, depth, tail = None, 0, False, 0, False
        held: list[str] = []  # pieces since the last cut,
        whole, size = 0, 0  # of which so many are whole elements, of so many characters

        def put(kind: str, count: int) -> None:
            nonlocal held, whole, size, seq
            out.append((*now, seq, kind, "".join(held[:count])))
            held, whole, size, seq = held[count:], 0, 0, seq + 1

        def leave() -> None:
            if whole:
                put("whole", whole)
            if held:
                put("middle" if tail else "head", len(held))

        def rows() -> pa.RecordBatch:
            nonlocal out
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["path", "range", "seq", "kind", "text"])
            out = []
            return made

        for batch in batches:
            for path, start, text in zip(*(batch[c].to_pylist() for c in ("path", "range", "text")), strict=True):
                if (path, start) != now:
                    leave()
                    now, seq, whole, size = (path, start), 0, 0, 0
                    inside, depth = starts.value[now]
                    tail = depth > 1 or inside
                swaps, outside, within = piece_moves(text)
                over = depth < 0
                depth += within if inside else outside
                inside ^= swaps
                if over or (depth < 0 and not inside):
                    # no } follows the end of an array
                    held.append(text)
                    put("bad" if over else "last" if tail else "end", len(held))
                    continue
                held.append(text + "}")
                size += len(text) + 1
                if depth == 1 and not inside:
                    whole = len(held)
                    if tail:
                        put("tail", whole)
                        tail = False
                    elif size >= CHUNK:
                        put("whole", whole)
            if out:
                yield rows()
        leave()
        if out:
            yield rows()

    return run


def pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, range, size (of the file), bytes and text: the stretches between ``}``, in order inside a range."""
    text = spark.read.option("lineSep", "}").option("recursiveFileLookup", "true").text(paths)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return text.select(
        path.alias("path"), F.col("_metadata.file_block_start").alias("range"), F.col("_metadata.file_size").alias("size"),
        F.octet_length("value").cast("long").alias("bytes"), F.make_valid_utf8("value").alias("text"),
    )


def chunks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, range, seq, body: stretches of whole elements without the brackets of the array, in the order of (range, seq).

    Broken files have a row with a null body.
    """
    if not paths:
        return spark.createDataFrame([], "path string, range long, seq long, body string")
    cut_at = pieces(spark, paths)
    names = "path string, range long, size long, swaps boolean, outside long, inside long, bytes long, pieces long"
    starts, broken = starts_of(cut_at.mapInArrow(_ranges, names).collect())
    shared = spark.sparkContext.broadcast(starts)
    found = stored(cut_at.mapInArrow(_cut(shared), _CHUNKS), "chunks")
    apart = found.filter(F.col("kind").isin(*_APART))
    return _bodies(found.filter(~F.col("kind").isin(*_APART)).unionByName(_together(apart)), broken)


def _together(apart: DataFrame) -> DataFrame:
    """Elements over borders, from their pieces; at most two pieces a range are looked at."""
    # a head belongs to the pieces behind it, up to the next head
    marked = running_sum(
        apart.withColumn("starts", (F.col("kind") == "head").cast("int")), ["path"], F.col("range"), [F.col("seq")], F.col("starts"), "element"
    )
    piece = F.struct("range", "seq", "kind", "text")
    joined = marked.groupBy("path", "element").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    closed = {"tail": "whole", "last": "end"}
    kind = F.lit("bad")
    for last, result in closed.items():
        kind = F.when((F.get("p.kind", F.lit(0)) == "head") & (F.element_at("p.kind", -1) == last), result).otherwise(kind)
    return joined.select(
        "path",
        F.get("p.range", F.lit(0)).alias("range"),
        F.get("p.seq", F.lit(0)).alias("seq"),
        kind.alias("kind"),
        F.array_join("p.text", "").alias("text"),
    )


def _bodies(found: DataFrame, broken: set[str]) -> DataFrame:
    """Chunks without the comma, or bracket, before them and the bracket behind the last one."""
    blank = r"[ \t\n\r]*"
    first = (F.col("range") == 0) & (F.col("seq") == 0)
    text = F.when(F.col("kind") == "end", F.regexp_extract("text", rf"(?s)^(.*)\]{blank}$", 1)).otherwise(F.col("text"))
    lead = F.regexp_extract("text", rf"^{blank}([\[,]?)", 1)
    rest = F.regexp_replace(text, rf"^{blank}[\[,]?", "")
    nothing = F.rlike(rest, F.lit(rf"^{blank}$"))
    # the end may follow the last element at once; elsewhere something stands before the next one
    fits = F.when(first, lead == "[").otherwise((lead == ",") & ~nothing | (F.col("kind") == "end") & nothing & (lead == ""))
    fits = fits & (F.col("kind") != "bad") & ~F.col("path").isin(sorted(broken) or [""])
    return found.select("path", "range", "seq", F.when(fits, rest).alias("body"))


def elements(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, ord, item: the elements of the arrays, numbered from 0 in each file."""
    cut = chunks(spark, paths)
    blank = F.coalesce(F.rlike("body", F.lit(r"^[ \t\n\r]*$")), F.lit(False))
    boxed = F.concat(F.lit("["), F.col("body"), F.lit("]"))
    items = F.when(blank, F.expr("cast(array() as array<variant>)")).otherwise(J.json_items(boxed))
    # repeated keys, NaN: a second reading of the chunk alone
    native = cut.select("path", "range", "seq", boxed.alias("boxed"), F.size(items).alias("n"))
    turned_down = (F.col("n") < 0) | F.col("n").isNull()
    parts = F.filter(J.json_parts(F.when(turned_down, F.col("boxed"))), lambda p: p["key"].isNull())
    again = native.withColumn("parts", parts).select(
        "path", "range", "seq",
        F.when(turned_down, F.concat(F.lit("["), F.array_join("parts.text", ","), F.lit("]"))).otherwise(F.col("boxed")).alias("array"),
        F.when(turned_down, F.size("parts")).otherwise(F.col("n")).alias("n"),
    )
    read = stored(again, "elements")
    broken = read.filter(F.col("array").isNull() | F.col("n").isNull() | (F.col("n") < 0)).select("path").distinct()
    good = read.join(F.broadcast(broken), "path", "left_anti")  # at most the paths that were asked for
    counted = running_sum(good, ["path"], F.col("range"), [F.col("seq")], F.col("n"), "upto").filter("n > 0")
    return counted.select("path", F.posexplode(J.json_items(F.col("array"))).alias("at", "item"), (F.col("upto") - F.col("n")).alias("before")).select(
        "path", (F.col("before") + F.col("at")).alias("ord"), "item"
    )
