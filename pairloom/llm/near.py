"""MinHash near-duplicates by an inverted join over signature coordinates.

A document's set holds its distinct shingles of words (A-Z folded, words split at
blanks and control blanks); a shorter text is one shingle. Documents are linked if
100 * |A and B| >= percent * |A or B|. The steps:

1. Equal sets form a class, whose set is read from the document with its smallest
   doc_id, so copies are compared with nothing any more.
2. Each class has a signature of COORDINATES smallest mixed hashes. The match threshold
   is the largest number of equal coordinates that a pair right at the similarity asked
   for misses with a probability below MISS (7 of 16 at 85 %, 6 at 80 %).
3. Prefix: coordinate-value pairs are ordered by how many classes hold them. Two
   classes that agree in ``matches`` pairs share one among the rarest
   COORDINATES - matches + 1 of each, so only those are posted. Very common
   coordinate values (a passage that a third of all documents hold) are thus posted
   only by classes that consist of common values.
4. Stars: in each posting list the class whose coordinates are the most common
   ones serves as hub; each class counts its collisions with its hubs, the best one
   is confirmed on the full sets. This joins groups of copies at linear cost.
5. Skip: posting lists whose classes are all connected by now are left out. In the
   others, members of different components are compared in blocks of bounded size, each
   pair only in the first list both are posted in. What has no partner with enough
   collisions and a fitting set size drops out; the full sets of the rest are sent to
   the list once and compared there, passing over pairs that are connected by then, so
   only links are given out, fewer than the block has members.
6. Components by contraction to the smallest neighbour, written after each round.

No list is gathered whole: long ones are dealt as pairs of blocks. Nothing is
dropped or capped.

Nulls and texts without words have an empty set and are linked with nothing; rows
without doc_id are kept and take no part; repeated rows of one doc_id share its
component. A doc_id on rows with different texts belongs to one component, the texts keep
their own groups where one of each is to stay. An empty table stays empty; very long
texts are one set like any other. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import bitmap, gram_hashes, in_bitmap, mixed, rows_without, saved

COORDINATES, MISS = 16, 5e-5
#: Members and shingles of a block at most, on average.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
BITS = 24
_SEEDS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def match_threshold(percent: int) -> int:
    """Coordinates that a pair of this similarity shares, but for a chance of MISS."""
    p, missed = percent / 100, 0.0
    for n in range(COORDINATES + 1):
        missed += comb(COORDINATES, n) * p**n * (1 - p) ** (COORDINATES - n)
        if missed > MISS:
            return max(1, n)
    return COORDINATES


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(gram_hashes(hashes, min(width, len(words))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest mixed hash under each coordinate, 32 bits of it."""
    out = np.empty(COORDINATES, np.uint64)
    for i, seed in enumerate(_SEEDS):
        out[i] = mixed(shingles ^ seed).min()
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def class_key(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, signatures = [], [], []
            for text in batch["text"]:
                shingles = shingle_set(text.as_py(), width)
                sizes.append(len(shingles))
                keys.append(class_key(shingles) if len(shingles) else None)
                signatures.append(signature(shingles) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_hash"], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.list_(pa.int32()))],
                names=["doc_id", "text_hash", "n_shingles", "key", "signature"],
            )

    return run


def _sets(width: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(bits, batch["hash"].to_numpy().view(np.uint64), BITS)))
            found = [shingle_set(text.as_py(), width) for text in batch["text"]]
            keys = [class_key(x) for x in found]
            offsets = np.cumsum([0, *map(len, found)])
            values = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))],
                names=["doc_id", "key", "shingles"],
            )

    return run


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, key, signature of every row."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    signed = source.mapInArrow(_sign(width), "doc_id bigint, text_hash bigint, n_shingles bigint, key binary, signature array<int>")
    return saved(signed, "signatures")


def _sizes_fit(a: str, b: str, percent: int):
    """A link needs percent of the larger set to be matched by the smaller one."""
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * percent)


def _collisions(a: str, b: str):
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _prefixes(classes: DataFrame, matches: int) -> DataFrame:
    """The posts of each class: its rarest coordinate-value pairs; ``mask`` has a bit for each of its posted coordinates."""
    pairs = classes.select("rep", F.posexplode("signature").alias("at", "value"))
    counts = pairs.groupBy("at", "value").agg(F.count(F.lit(1)).alias("held"))
    ranked = (
        pairs.join(counts, ["at", "value"])
        .groupBy("rep")
        .agg(
            F.sort_array(F.collect_list(F.struct("held", "at", "value"))).alias("pairs"),
            F.sum("held").alias("weight"),
        )
    )
    posts = F.filter(F.slice("pairs", 1, COORDINATES - matches + 1), lambda p: p["held"] > 1)
    mask = F.aggregate("posts", F.lit(0).cast("long"), lambda sum_, p: sum_ + F.pow(F.lit(2), p["at"]).cast("long"))
    return ranked.select("rep", "weight", posts.alias("posts")).select(
        "rep", "weight", mask.cast("int").alias("mask"), F.explode("posts").alias("p")
    ).select("rep", "weight", "mask", "p.at", "p.value")


_LIST = ("at", "value", "left", "right")


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Regroup sorted batches so that no list's rows are torn apart."""
    kept: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([kept, t]).combine_chunks() if kept is not None and len(kept) else t
        if not len(t):
            continue
        same = np.all([t[c].to_numpy() == t[c][len(t) - 1].as_py() for c in _LIST], axis=0)
        cut = 0 if same.all() else len(t) - int(same[::-1].argmin())
        kept = t.slice(cut)
        if cut:
            yield t.slice(0, cut)
    if kept is not None and len(kept):
        yield kept


class _Lists:
    """The columns of some whole lists as arrays, and the pairs to compare in them."""

    def __init__(self, t: pa.Table, percent: int):
        t = t.combine_chunks()
        names = (*_LIST, "block", "comp", "n", "rep", "mask")
        self.col = {c: t[c].to_numpy() for c in names}
        new = np.ones(len(t), bool)
        new[1:] = np.any([self.col[c][1:] != self.col[c][:-1] for c in _LIST], axis=0)
        self.group = np.cumsum(new) - 1
        flat = t["signature"].combine_chunks()
        flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.chunked_array(flat).combine_chunks().flatten()
        self.signatures = flat.to_numpy().reshape(-1, COORDINATES)
        self.percent, self.matches = percent, match_threshold(percent)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (i, j) of pairs of different components that may be linked and meet in no earlier list."""
        c, size = self.col, len(self.group)
        bits = 1 << np.arange(COORDINATES)
        alive = np.arange(size)
        for step in range(1, size):
            alive = alive[alive + step < size]
            alive = alive[self.group[alive] == self.group[alive + step]]
            if not len(alive):
                return
            i, j = alive, alive + step
            ok = c["comp"][i] != c["comp"][j]
            # two different blocks meet here only to be compared with each other
            ok &= (c["left"][i] == c["right"][i]) | (c["block"][i] != c["block"][j])
            ok &= np.minimum(c["n"][i], c["n"][j]) * 100 >= np.maximum(c["n"][i], c["n"][j]) * self.percent
            i, j = i[ok], j[ok]
            same = self.signatures[i] == self.signatures[j]
            posted = same & ((c["mask"][i] & c["mask"][j])[:, None] & bits != 0)
            ok = (same.sum(axis=1) >= self.matches) & (posted.argmax(axis=1) == c["at"][i])
            if ok.any():
                yield i[ok], j[ok]


def _partners(percent: int):
    """Which members of a list have anything to be compared with there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_lists(batches):
            lists = _Lists(t, percent)
            named = np.zeros(len(t), bool)
            for i, j in lists.pairs():
                named[i] = named[j] = True
            yield from t.filter(pa.array(named)).combine_chunks().to_batches()

    return run


def _bit_sets(shingles: pa.ChunkedArray) -> list[int]:
    """The sets as integers with a bit for each shingle that more than one of them holds."""
    sets = [x.values.to_numpy() for x in shingles]
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    # a shingle of one member alone is in no intersection
    often = np.bincount(at, minlength=len(values)) > 1
    place = np.cumsum(often) - 1
    out, low = [], 0
    for held in sets:
        mine = at[low : low + len(held)]
        low += len(held)
        bits = np.zeros(int(often.sum()), np.uint8)
        bits[place[mine[often[mine]]]] = 1
        out.append(int.from_bytes(np.packbits(bits).tobytes()))
    return out


def _links_in_list(t: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Confirmed links of one list; pairs that are connected by then are passed over."""
    one = _Lists(t, percent)
    reps, comps, sizes = (one.col[c].tolist() for c in ("rep", "comp", "n"))
    sets = _bit_sets(t["shingles"])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    out = []
    for i, j in one.pairs():
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            x, y = root(comps[a]), root(comps[b])
            if x == y:
                continue
            shared = (sets[a] & sets[b]).bit_count()
            if shared * 100 >= (sizes[a] + sizes[b] - shared) * percent:
                parent[max(x, y)] = min(x, y)
                out.append((min(reps[a], reps[b]), max(reps[a], reps[b])))
    return out


def _links_within(percent: int):
    """Confirm on full sets, list after list, so that memory is bounded by a list's block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_lists(batches):
            keys = np.stack([t[c].to_numpy() for c in _LIST])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(t)]
            out = [x for low, high in zip(cuts, cuts[1:], strict=False) for x in _links_in_list(t.slice(low, high - low), percent)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"]
            )

    return run


def _full_sets(reps: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(rep, shingles) of the classes named in ``reps``, from the text of their first document."""
    wanted = saved(reps.select("rep").distinct().join(classes.select("rep", "key", "doc_id"), "rep"), "wanted")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("doc_id").alias("hash")), "hash", BITS))
    doc_id = F.col("doc_id").cast("long")
    found = docs.filter(doc_id.isNotNull()).select(
        doc_id.alias("doc_id"), F.xxhash64(doc_id).alias("hash"), F.col("text").cast("binary").alias("text")
    )
    # the bitmap lets through all wanted rows and few others; the join decides
    found = found.mapInArrow(_sets(width, bits), "doc_id bigint, key binary, shingles array<bigint>")
    return saved(wanted.join(found, ["doc_id", "key"]).dropDuplicates(["rep"]).select("rep", "shingles"), "sets")


def _confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of representatives whose full sets are similar enough."""
    named = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep")))
    sets = _full_sets(named, docs, classes, width)
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("one"))
    other = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("other"))
    shared = F.size(F.array_intersect("one", "other"))
    linked = pairs.join(one, "a").join(other, "b").filter(
        shared * 100 >= (F.size("one") + F.size("other") - shared) * percent
    )
    return linked.select("a", "b").distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node each node of ``nodes`` is connected with over ``links`` (a, b).

    Every round maps each node to its smallest neighbour, twice, and goes on with the
    links between what is left; their number falls by half or more in each round.
    """
    label = nodes.select("node", F.col("node").alias("comp"))
    links = saved(links.filter("a <> b").distinct(), "links")
    steps: list[DataFrame] = []
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("b"))
        least = saved(smallest.select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "least")
        further = least.select(F.col("node").alias("to"), F.col("to").alias("far"))
        jump = saved(least.join(further, "to").select("node", F.col("far").alias("to")), "jump")
        steps.append(jump)
        a = jump.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        b = jump.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = links.join(a, "a").join(b, "b").filter("ta <> tb")
        links = saved(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
    for jump in steps:
        step = jump.select(F.col("node").alias("comp"), "to")
        label = label.join(step, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return label


def _linked(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, key of every row, with the component ``comp`` of its class and the class's first document."""
    signed = _signed(docs, width)
    # a class has a number of its own, since a doc_id may stand on rows of several classes
    classes = saved(
        signed.filter(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("key")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
        .withColumn("rep", F.monotonically_increasing_id()),
        "classes",
    )
    nodes = classes.select(F.col("rep").alias("node"))
    matches = match_threshold(percent)
    posts = saved(_prefixes(classes, matches), "posts")

    # stars around the class that is most like the rest of a list
    hubs = posts.groupBy("at", "value").agg(
        F.max(F.struct("weight", F.negative("rep").alias("less"))).alias("hub")
    )
    starred = posts.join(
        hubs.select("at", "value", F.negative("hub.less").alias("hub")), ["at", "value"]
    ).filter("rep <> hub")
    starred = starred.select("rep", "hub").distinct()
    facts = classes.select("rep", "n", "signature")
    theirs = facts.select(F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("signature").alias("hub_signature"))
    best = (
        starred.join(facts, "rep")
        .join(theirs, "hub")
        .filter(_sizes_fit("n", "hub_n", percent))
        .select("rep", "hub", _collisions("signature", "hub_signature").alias("same"))
        .filter(F.col("same") >= matches)
        .groupBy("rep")
        .agg(F.max(F.struct("same", "hub")).alias("best"))
        .select(F.col("rep").alias("a"), F.col("best.hub").alias("b"))
    )
    stars = saved(_confirm(saved(best, "stars"), docs, classes, width, percent), "links")
    first = saved(components(nodes, stars).withColumnRenamed("node", "rep"), "components")

    # lists with members of several components
    labelled = posts.join(first, "rep").join(facts, "rep")
    open_lists = (
        labelled.groupBy("at", "value")
        .agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
        .filter("low <> high")
        .select("at", "value", F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    )
    dealt = (
        labelled.join(open_lists, ["at", "value"])
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "at", "value", F.least("block", "with").alias("left"), F.greatest("block", "with").alias("right"),
            "block", "comp", "n", "rep", "mask", "signature",
        )
    )
    row = "at int, value int, left int, right int, block int, comp bigint, n bigint, rep bigint, mask int, signature array<int>"
    partners = dealt.repartition(*_LIST).sortWithinPartitions(*_LIST).mapInArrow(_partners(percent), row)
    partners = saved(partners, "partners")
    sets = _full_sets(partners, docs, classes, width)
    compared = partners.join(sets, "rep").select(*partners.columns, "shingles")
    rest = (
        compared.repartition(*_LIST)
        .sortWithinPartitions(*_LIST)
        .mapInArrow(_links_within(percent), "a bigint, b bigint")
    )
    rest = saved(rest, "links")

    parts = saved(components(nodes, stars.union(rest)).withColumnRenamed("node", "rep"), "components")
    by_class = classes.select("key", "rep", F.col("doc_id").alias("first_id")).join(parts, "rep").select("key", "comp", "first_id")
    return saved(signed.select("doc_id", "text_hash", "n_shingles", "key").join(by_class, "key", "left"), "linked")


def link(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per document row.

    A doc_id on rows with different texts is one node: it links whatever its texts are linked with.
    """
    rows = _linked(docs, width, percent)
    known = rows.filter(F.col("comp").isNotNull() & F.col("doc_id").isNotNull())
    several = known.groupBy("doc_id").agg(F.min("comp").alias("a"), F.max("comp").alias("high")).filter("a <> high").select("doc_id", "a")
    joined = saved(known.join(several, "doc_id").select("a", F.col("comp").alias("b")).filter("a <> b").distinct(), "shared_ids")
    if not joined.isEmpty():
        merged = components(known.select(F.col("comp").alias("node")).distinct(), joined).select(F.col("node").alias("comp"), F.col("comp").alias("whole"))
        rows = rows.join(merged, "comp", "left").drop("comp").withColumnRenamed("whole", "comp")
    least = rows.filter(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("first_id").alias("least"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return rows.join(least, "comp", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One text of each group of linked texts, that with the smallest doc_id; columns as they are.

    Rows are judged by their text: of a doc_id on rows with different texts each one stays or goes with its own group.
    """
    rows = _linked(docs, width, percent).filter(F.col("comp").isNotNull() & F.col("doc_id").isNotNull())
    first = rows.groupBy("comp").agg(F.min(F.struct("doc_id", "key", "text_hash")).alias("first"))
    gone = rows.join(first, "comp").filter(F.struct("doc_id", "key", "text_hash") != F.col("first"))
    return rows_without(docs, gone.select("doc_id", "text_hash"), [F.col("doc_id").cast("long"), F.xxhash64("text")])
