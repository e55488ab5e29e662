"""Conversation prefix trie: what conversations share from their first turn on.

A node of depth d is a distinct sequence of d first turns; the root has none. Turns are
compared by a SHA-256 of role and text, so that only 32 bytes a turn are moved.

Equal conversations are added up first, so a conversation that a third of all rows repeat
is one sequence. The distinct sequences are sorted over all partitions; sequences that
share a prefix are then neighbours. Each partition takes the edges between its neighbours,
whose weight is the length of their common prefix (LCP), in descending order into a
union-find: every merge of two components makes, or reaches, the branching node of that
depth, and a node is summed up once all deeper edges are done.

Nodes whose sequences touch neither end of their partition are complete. What may reach
over a border lies on the paths of the partition's first and last sequence; all that
hangs below these paths is contracted into sums per path node, so a partition leaves two
paths, however many rows it has. The paths of all partitions (bounded by the number of
partitions, not by the rows) are merged by a second union-find over the LCP edges between
the last sequence of one partition and the first one of the next, again deepest first.

A node's list of ids is hashed as a stream: ids are sorted over all partitions and joined
to pieces there, the pieces of one node pass a SHA-256 one after the other, which by its
nature takes the bytes in order; no list is held.

Turns are ordered by number (null first), then role, then text; a null role or text is
empty. Rows without conv_id take no part. Repeated rows are repeated turns. Texts of any
length enter by hash and length. An empty table has no nodes. Other columns play no part.
A conversation is one row while it is sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.common import saved

PIECE = 4096
_NOTHING = hashlib.sha256(b"").hexdigest()

_NODE = [
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
]
_NODE_DDL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: Where a node lies on a path of its partition: partition, side (0: first sequence, 1: last one below their fork), depth.
_PLACE = [("pid", pa.int32()), ("side", pa.int32()), ("at", pa.int32())]
_PLACE_DDL = "pid int, side int, at int"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, each a hash of role and text and the bytes of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("one")
    )

    def short(x: Column) -> Column:
        whole = F.concat(F.octet_length(x["role"]).cast("string"), F.lit(":"), x["role"], x["text"])
        return F.struct(F.unhex(F.sha2(whole.cast("binary"), 256)).alias("token"), F.octet_length(x["text"]).cast("long").alias("bytes"))

    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("one")), short).alias("turns"))


def rebuilt(conversations: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Every conversation c behind the first turns of the first of its family, c - c % family.

    The number of turns taken over, crc32(c) % most, also goes from c's own beginning.
    """
    own = saved(turns(conversations), "turns")
    first = own.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("start")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    start = F.coalesce(F.slice("start", F.lit(1), h), F.expr("slice(turns, 1, 0)"))
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(first, "base", "left")
    rest = F.slice("turns", h + 1, F.size("turns"))
    return both.select("conv_id", F.concat(start, rest).alias("turns"))


def _path_key() -> Column:
    return F.unhex(F.sha2(F.array_join(F.transform("turns", lambda x: F.hex(x["token"])), "").cast("binary"), 256))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one key, as text: key, first id, ids."""
    key, first, held, out = None, None, [], ([], [], [])

    def put() -> None:
        if held:
            for column, value in zip(out, (key, first, ",".join(held)), strict=True):
                column.append(value)

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["key", "first", "ids"])
        for column in out:
            column.clear()
        return made

    for rows in batches:
        for k, conv in zip(rows["key"].to_pylist(), rows["conv_id"].to_pylist(), strict=True):
            if k != key or len(held) >= PIECE:
                put()
                key, first, held = k, conv, []
            held.append(str(conv))
        if out[0]:
            yield batch()
    put()
    yield batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 of each key's pieces, which come in order."""
    key, state = None, None
    for rows in batches:
        done = []
        for k, ids in zip(rows["key"].to_pylist(), rows["ids"].to_pylist(), strict=True):
            if k == key:
                state.update(b",")
            else:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            state.update(ids.encode())
        yield _digest_rows(done)
    if state is not None:
        yield _digest_rows([(key, state.hexdigest())])


def _digest_rows(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["key", "ends"])


def sequences(conversations: DataFrame) -> DataFrame:
    """The distinct sequences: turns, n, least (conv_id) and ends, the hash over the ids of those that end there."""
    keyed = saved(conversations.withColumn("key", _path_key()), "keyed")
    distinct = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    # the turns come from one conversation of each, so equal ones are not sent around with their turns
    distinct = distinct.join(keyed.select(F.col("conv_id").alias("least"), "turns"), "least")
    ids = keyed.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = ids.mapInArrow(_pieces, "key binary, first long, ids string")
    ends = pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key binary, ends string")
    return distinct.join(ends, "key").select(
        F.transform("turns", lambda x: x["token"]).alias("tokens"), F.transform("turns", lambda x: x["bytes"]).alias("sizes"), "n", "least", "ends"
    )


def common(a: list, b: list) -> int:
    """Length of the common prefix."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class Merger:
    """Union-find; ``find`` halves paths."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def union(self, i: int, j: int) -> int:
        i, j = self.find(i), self.find(j)
        self.up[j] = i
        return i


def forest(paths: list[list]) -> tuple[list[int], list[int], list[int], list[int]]:
    """The compressed trie of sorted distinct sequences: depth, parent, first and last leaf of each node.

    Node i < len(paths) is the end of sequence i; merges along LCP edges, deepest first, add the
    branching nodes. The root may be missing (parent -1 is the top).
    """
    m = len(paths)
    depth, parent, low, high = [len(p) for p in paths], [-1] * m, list(range(m)), list(range(m))
    lcp = [common(paths[i], paths[i + 1]) for i in range(m - 1)]
    sets, top = Merger(m), list(range(m))
    for i in sorted(range(m - 1), key=lambda i: -lcp[i]):
        a, b = top[sets.find(i)], top[sets.find(i + 1)]
        if depth[a] == lcp[i]:  # the left one is, or already became, the node of this prefix
            node = a
        else:
            node = len(depth)
            depth.append(lcp[i])
            parent.append(-1)
            low.append(low[a])
            high.append(high[a])
            parent[a] = node
        parent[b] = node
        high[node] = high[b]
        top[sets.union(i, i + 1)] = node
    return depth, parent, low, high


def _partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's complete nodes, and the sums along its two paths (spine = True)."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    if not rows:
        return
    pid, m = TaskContext.get().partitionId(), len(rows)
    paths = [r["tokens"] for r in rows]
    cum = []  # bytes of the first e turns
    for r in rows:
        sums = [0]
        for x in r["sizes"]:
            sums.append(sums[-1] + x)
        cum.append(sums)
    depth, parent, low, high = forest(paths)
    nodes = len(depth)
    n, least = [r["n"] for r in rows] + [0] * (nodes - m), [r["least"] for r in rows] + [None] * (nodes - m)
    kids, leaves, saved_ = [0] * nodes, [0] * nodes, [0] * nodes
    fork = common(paths[0], paths[-1])
    spine = [low[v] == 0 or high[v] == m - 1 for v in range(nodes)]
    # sums of what hangs below each node of the two paths, by (side, depth)
    hung = {(0, d): [0, None, 0, 0, 0, None] for d in range(len(paths[0]) + 1)}
    hung |= {(1, d): [0, None, 0, 0, 0, None] for d in range(fork + 1, len(paths[-1]) + 1)}

    def place(v: int) -> tuple[int, int]:
        return (0 if low[v] == 0 else 1, depth[v])

    order = sorted(range(nodes), key=lambda v: -depth[v])
    chain = [0] * nodes  # saved by the unary nodes between a node and its parent
    for v in order:
        d, up = depth[v], parent[v]
        above = depth[up] if up >= 0 else -1
        if not spine[v]:
            if not kids[v]:
                leaves[v] = 1
            saved_[v] += (n[v] - 1) * (cum[low[v]][d] - cum[low[v]][d - 1]) if d else 0
            chain[v] = (n[v] - 1) * (cum[low[v]][d - 1] - cum[low[v]][above]) if d else 0
        if up >= 0:
            n[up] += n[v]
            least[up] = least[v] if least[up] is None else min(least[up], least[v])
            if not spine[v]:
                kids[up] += 1
                leaves[up] += leaves[v]
                saved_[up] += saved_[v] + chain[v]
    done: list[tuple] = []
    for v in range(nodes):
        d, up = depth[v], parent[v]
        above = depth[up] if up >= 0 else -1
        if spine[v]:
            # members count on every node up to the next one of the compressed path
            side, _ = place(v)
            one = hung[place(v)]
            one[2:5] = kids[v], leaves[v], saved_[v]
            one[5] = rows[v]["ends"] if v < m else None
            for e in range(d, above, -1):
                at = hung.get((side, e))
                if at is not None:
                    at[0], at[1] = n[v], least[v]
            continue
        for e in range(above + 1, d + 1):
            end = e == d
            to_spine = e == above + 1 and spine[up]
            done.append((
                least[v], e, None if to_spine else least[up] if e == above + 1 else least[v], n[v], kids[v] if end else 1, leaves[v],
                saved_[v] + (0 if end else (n[v] - 1) * (cum[low[v]][d - 1] - cum[low[v]][e - 1])),
                rows[v]["ends"] if end and v < m else _NOTHING,
                *((pid, *place(up)) if to_spine else (None, None, None)), False, None, 0,
            ))
    for (side, e), (count, first, k, lv, sv, ends) in hung.items():
        i = 0 if side == 0 else m - 1
        done.append((
            first, e, None, count, k, lv, sv, ends, pid, side, e, True, paths[i][e - 1] if e else None, cum[i][e] - cum[i][e - 1] if e else 0,
        ))
    for at in range(0, len(done), 8192):
        columns = zip(*done[at : at + 8192], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, _PART, strict=True)], [name for name, _ in _PART])


_PART = [*_NODE, *_PLACE, ("spine", pa.bool_()), ("token", pa.binary()), ("bytes", pa.int64())]
_PART_DDL = f"{_NODE_DDL}, {_PLACE_DDL}, spine boolean, token binary, bytes long"


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The paths of all partitions, in order, merged: every place with its node; ``first`` marks one place of each node."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    if not rows:
        return
    by_pid: dict[int, list[dict[int, int]]] = {}
    for i, r in enumerate(rows):
        by_pid.setdefault(r["pid"], [{}, {}])[r["side"]][r["at"]] = i
    up_of: dict[int, int] = {}
    firsts, lasts = [], []
    for left, right in by_pid.values():
        first = [left[d] for d in range(len(left))]
        fork = min(right) if right else None
        last = [*first[:fork], *(right[d] for d in sorted(right))] if right else first
        if not right:
            # the last sequence ends where the first one passes: only if there is one sequence alone
            last = first
        for path in (first, last):
            up_of.update(zip(path[1:], path, strict=False))
        firsts.append(first)
        lasts.append(last)
    edges = []
    for a, b in zip(lasts, firsts[1:], strict=False):
        edges.append((common([rows[i]["token"] for i in a[1:]], [rows[i]["token"] for i in b[1:]]), a, b))
    sets = Merger(len(rows))
    for depth in range(max((e[0] for e in edges), default=-1), -1, -1):
        for lcp, a, b in edges:
            if depth <= lcp:
                sets.union(a[depth], b[depth])
    total: dict[int, dict] = {}
    for i, r in enumerate(rows):
        one = total.setdefault(sets.find(i), r | {"n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "ends_sha256": None})
        for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            one[c] += r[c]
        one["conv_id"] = min(one["conv_id"], r["conv_id"])
        one["ends_sha256"] = one["ends_sha256"] or r["ends_sha256"]
    above = {}
    for i, up in up_of.items():
        above[sets.find(i)] = sets.find(up)
    for v in sorted(total, key=lambda v: -total[v]["depth"]):
        one = total[v]
        if not one["n_children"]:
            one["n_leaves"] = 1
        one["saved_tokens"] += (one["n_convs"] - 1) * one["bytes"]
        one["ends_sha256"] = one["ends_sha256"] or _NOTHING
        if v in above:
            up = total[above[v]]
            up["n_children"] += 1
            up["n_leaves"] += one["n_leaves"]
            up["saved_tokens"] += one["saved_tokens"]
    out, seen = [], set()
    for i, r in enumerate(rows):
        v = sets.find(i)
        one = total[v] | {"parent_conv_id": total[above[v]]["conv_id"] if v in above else None}
        out.append((*(one[c] for c, _ in _NODE), r["pid"], r["side"], r["at"], v not in seen))
        seen.add(v)
    kinds = [t for _, t in (*_NODE, *_PLACE)] + [pa.bool_()]
    names = [c for c, _ in (*_NODE, *_PLACE)] + ["first"]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie over ``conversations`` (conv_id, turns as ``turns`` gives them).

    conv_id: smallest member; depth; parent_conv_id; n_convs: members; n_children; n_leaves: childless
    nodes below (itself included); saved_tokens: bytes of texts that need not be repeated, summed over
    the subtree; ends_sha256: of the ids of conversations that end here.
    """
    ordered = sequences(conversations).repartitionByRange("tokens").sortWithinPartitions("tokens")
    parts = saved(ordered.mapInArrow(_partition, _PART_DDL), "forests")
    paths = parts.filter("spine").repartition(1).sortWithinPartitions("pid", "side", "at")
    merged = saved(paths.mapInArrow(_across, f"{_NODE_DDL}, {_PLACE_DDL}, first boolean"), "paths")
    names = [c for c, _ in _NODE]
    inner = parts.filter("not spine")
    place = [c for c, _ in _PLACE]
    known = merged.select(*place, F.col("conv_id").alias("above"))
    hanging = inner.filter(F.col("pid").isNotNull()).join(known, place).withColumn("parent_conv_id", F.col("above"))
    return (
        merged.filter("first").select(*names).unionByName(inner.filter(F.col("pid").isNull()).select(*names)).unionByName(hanging.select(*names))
    )
