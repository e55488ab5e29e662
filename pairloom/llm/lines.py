"""Line dedup by content-defined chunks of lines, in column expressions only.

A text is a sequence of lines. A rolling hash over the hashes of the last two lines
decides where a chunk ends: after a line where it is divisible by DIVISOR and was not one
line before, and at the end of the text; never after the first line or before the last
one. So every chunk of a text of two or more lines has two lines at least, and boundaries
depend on the lines around them alone: a passage that was moved by other lines before it
is cut in the same places.

Chunks of two or more lines are looked up globally. Of equal chunks the first stays
(smallest doc_id, then place in the document), the others are repeated. A repeated passage
between other neighbours also has lines before its first and behind its last boundary, or
no boundary at all. So the pairs of neighbouring lines outside repeated chunks are looked
up as well, and extend them: every run of two or more lines that an earlier place holds is
found, whatever stands around it. Pairs inside repeated chunks need no look-up, since the
first place of such a pair lies before the chunk. Pairs of blank lines say nothing; a pair
that begins one line after its own first place stays.

Neighbouring pairs whose first places are neighbours too are one run; its bytes are
compared with those of the first place, and it goes if they are equal: lines that only
share their hash stay.

Look-ups move hashes only and add up before the shuffle. Texts move once, to meet the
runs and the first places of their document; of a run and its first place the bytes alone
move, joined so that Spark can split a first place that very many documents repeat.

``clean`` drops documents of which nothing, or blank lines alone, is left; the others keep
their columns with the remaining text (and its length, where there is an ``n_chars``).

Null texts stay null, an empty text is one empty line, rows without doc_id sort first.
Rows that agree in doc_id and text are repeated rows and share the decision. The work for
a long text grows with its lines. Ties need no rule, places differ. An empty table stays
empty. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.llm.common import row_key, saved

DIVISOR = 2
_FACTOR, _MODULUS = 31, 1_000_003
_INK = "[^ \\t-\\r]"
_ROW = ["_id", "_text_hash"]


def line_hashes(text: Column) -> Column:
    """60 bits of each line's MD5; negative for blank lines."""

    def short(line: Column) -> Column:
        number = F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")
        return F.when(line.rlike(_INK), number).otherwise(-number - 1)

    return F.transform(F.split(text, "\n", -1), short)


def chunk_ends(hashes: str) -> Column:
    """The number of each line (from 1) after which a chunk ends."""
    # once per line, bound as a variable
    rolled = F.transform(hashes, lambda x, i: F.pmod(F.coalesce(F.pmod(F.get(hashes, i - 1), F.lit(_MODULUS)), F.lit(0)) * _FACTOR + F.pmod(x, F.lit(_MODULUS)), F.lit(_MODULUS)))
    count = F.size(hashes)

    def ends_of(rolled: Column) -> Column:
        def ends(at: Column) -> Column:
            marked = (F.get(rolled, at - 1) % DIVISOR == 0) & (F.get(rolled, at - 2) % DIVISOR != 0)
            return (at == count) | (at.between(2, count - 2) & marked)

        return F.filter(F.sequence(F.lit(1), count), ends)

    return F.flatten(F.transform(F.array(rolled), ends_of))


def repeated_chunks(lined: DataFrame) -> DataFrame:
    """Row, first, size and first place (``kept``: _id, first, _text_hash) of every later chunk. ``lined``: row and ``h``."""
    ended = lined.withColumn("ends", chunk_ends("h"))
    spans = F.transform(
        "ends", lambda end, i: F.struct((F.coalesce(F.get("ends", i - 1), F.lit(0)) + 1).alias("first"), (end - F.coalesce(F.get("ends", i - 1), F.lit(0))).alias("size"))
    )
    keyed = F.transform(
        F.filter(spans, lambda s: s["size"] > 1),
        lambda s: s.withField("key", F.unhex(F.md5(F.array_join(F.slice("h", s["first"], s["size"]).cast("array<string>"), ",")))),
    )
    posts = ended.select(*_ROW, F.explode(keyed).alias("s")).select(*_ROW, "s.*")
    return _later(posts, ["key"]).select(*_ROW, "first", "size", "kept")


def _later(posts: DataFrame, key: list[str]) -> DataFrame:
    place = F.struct("_id", "first", "_text_hash")
    firsts = posts.groupBy(*key).agg(F.min(place).alias("kept"), F.count(F.lit(1)).alias("held")).filter("held > 1").drop("held")
    return posts.join(firsts, key).filter(place != F.col("kept"))


def repeated_pairs(lined: DataFrame, chunks: DataFrame) -> DataFrame:
    """Row, first line, kept_id, kept_hash and ``back`` (lines to the first place) of every later pair."""
    inside = F.sequence(F.col("first"), F.col("first") + F.col("size") - 2)
    covered = chunks.groupBy(*_ROW).agg(F.flatten(F.collect_list(inside)).alias("covered"))
    free = F.array_except(F.sequence(F.lit(1), F.size("h") - 1), F.coalesce("covered", F.expr("array()").cast("array<int>")))
    posts = (
        lined.filter(F.size("h") > 1)
        .join(covered, _ROW, "left")
        .select(*_ROW, F.explode(F.transform(free, lambda i: F.struct(i.alias("first"), F.get("h", i - 1).alias("one"), F.get("h", i).alias("two")))).alias("p"))
        .select(*_ROW, "p.*")
    )
    shape = [*_ROW, "first", F.col("kept._id").alias("kept_id"), F.col("kept._text_hash").alias("kept_hash"), (F.col("first") - F.col("kept.first")).alias("back")]
    own = (F.col("kept_id") == F.col("_id")) & (F.col("kept_hash") == F.col("_text_hash"))
    single = _later(posts.filter("one >= 0 or two >= 0"), ["one", "two"]).select(*shape).filter(~(own & (F.col("back") < 2)))
    # the pairs of a chunk; those of two blank lines say nothing there either
    of_chunks = (
        chunks.select(*shape, "size")
        .groupBy(*_ROW)
        .agg(F.collect_list(F.struct("first", "size", "kept_id", "kept_hash", "back")).alias("c"))
        .join(lined, _ROW)
        .select(*_ROW, "h", F.explode("c").alias("c"))
        .select(
            *_ROW, "c.*",
            F.explode(F.filter(F.sequence(F.col("c.first"), F.col("c.first") + F.col("c.size") - 2), lambda i: (F.get("h", i - 1) >= 0) | (F.get("h", i) >= 0))).alias("at"),
        )
        .select(*_ROW, F.col("at").alias("first"), "kept_id", "kept_hash", "back")
    )
    return single.unionByName(of_chunks)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """Row, first, size, kept_id, kept_hash, at: the longest runs of later pairs, with their first place, by hash."""
    keyed = docs.select(*row_key(docs), F.col("text")).filter(F.col("text").isNotNull())
    lined = saved(keyed.select(*_ROW, line_hashes(F.col("text")).alias("h")).dropDuplicates(_ROW), "lined")
    chunks = saved(repeated_chunks(lined), "chunks")
    row = Window.partitionBy(*_ROW).orderBy("kept_id", "kept_hash", "back", "first")
    same = [F.lag(c).over(row) == F.col(c) for c in ("kept_id", "kept_hash", "back")] + [F.lag("first").over(row) == F.col("first") - 1]
    goes_on = F.coalesce(same[0] & same[1] & same[2] & same[3], F.lit(False))
    runs = (
        repeated_pairs(lined, chunks)
        .withColumn("starts", (~goes_on).cast("int"))
        .withColumn("run", F.sum("starts").over(row))
        .groupBy(*_ROW, "run")
        .agg(F.min("first").alias("first"), (F.count(F.lit(1)) + 1).cast("int").alias("size"), *(F.first(c).alias(c) for c in ("kept_id", "kept_hash", "back")))
    )
    return saved(runs.select(*_ROW, "first", "size", "kept_id", "kept_hash", (F.col("first") - F.col("back")).alias("at")), "runs")


def _with_bytes(spans: str, first: str) -> Column:
    """Each span with the bytes of its lines; the text is split once."""
    held = F.transform(
        F.array(F.split("_row.text", "\n", -1)),
        lambda lines: F.transform(spans, lambda s: s.withField("bytes", F.array_join(F.slice(lines, s[first], s["size"]), "\n"))),
    )
    return F.explode(F.flatten(held))


def remove_repeated(docs: DataFrame) -> DataFrame:
    """The documents without later runs of lines, plus _n_lines and _n_removed (lines)."""
    runs = repeated_runs(docs)
    later = runs.groupBy(*_ROW).agg(F.collect_list(F.struct("first", "size", "kept_id", "kept_hash", "at")).alias("_later"))
    kept = runs.select(F.col("kept_id").alias("_id"), F.col("kept_hash").alias("_text_hash"), "at", "size").distinct()
    kept = kept.groupBy(*_ROW).agg(F.collect_list(F.struct("at", "size")).alias("_kept"))
    spans = later.join(kept, _ROW, "full")
    # the one move of texts, by a merge join at any size; what follows reads its result where it lies
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *row_key(docs))
    met = saved(rows.join(spans.hint("merge"), _ROW, "left"), "met")
    firsts = (
        met.filter(F.col("_kept").isNotNull())
        .select(F.col("_id").alias("kept_id"), F.col("_text_hash").alias("kept_hash"), _with_bytes("_kept", "at").alias("s"))
        .select("kept_id", "kept_hash", "s.at", "s.size", F.col("s.bytes").alias("kept_bytes"))
        .dropDuplicates(["kept_id", "kept_hash", "at", "size"])
    )
    copies = met.filter(F.col("_later").isNotNull()).select(*_ROW, _with_bytes("_later", "first").alias("s")).select(*_ROW, "s.*")
    unequal = copies.join(firsts, ["kept_id", "kept_hash", "at", "size"]).filter(F.col("bytes") != F.col("kept_bytes"))
    unequal = saved(unequal.groupBy(*_ROW).agg(F.collect_set(F.struct("first", "size")).alias("_unequal")), "unequal")
    if unequal.isEmpty():  # as nearly always: no second move for it
        met = met.withColumn("_unequal", F.expr("cast(null as array<struct<first:int,size:int>>)"))
    else:
        met = met.join(unequal, _ROW, "left")
    return _without(met, docs.columns)


def _without(met: DataFrame, columns: list[str]) -> DataFrame:
    spans = F.transform("_later", lambda s: F.struct(s["first"].alias("first"), s["size"].alias("size")))
    spans = F.array_except(spans, F.coalesce("_unequal", F.expr("cast(array() as array<struct<first:int,size:int>>)")))
    gone = F.flatten(F.transform(spans, lambda s: F.sequence(s["first"], s["first"] + s["size"] - 1)))
    text = F.col("_row.text")

    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(1), F.size(lines)), gone)
        held = F.transform(left, lambda i: F.get(lines, i - 1))
        return F.struct(F.array_join(held, "\n").alias("text"), (F.size(lines) - F.size(left)).cast("long").alias("gone"))

    cut = F.when(F.col("_later").isNotNull(), F.get(F.transform(F.array(F.split(text, "\n", -1)), rest), F.lit(0)))
    n_lines = F.when(text.isNotNull(), F.length(text) - F.length(F.translate(text, "\n", "")) + 1)
    return met.withColumn("_cut", cut).select(
        *(F.when(F.col("_cut").isNotNull(), F.col("_cut.text")).otherwise(text).alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in columns),
        F.coalesce(n_lines, F.lit(0)).cast("long").alias("_n_lines"),
        F.coalesce("_cut.gone", F.lit(0)).cast("long").alias("_n_removed"),
    )


def clean(docs: DataFrame) -> DataFrame:
    """The documents with what is left of their texts; those of which nothing is left go."""
    out = remove_repeated(docs).filter(~((F.col("_n_removed") > 0) & ~F.col("text").rlike(_INK)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
