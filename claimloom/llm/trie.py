"""Prefix trie of conversations by an LCP-aware mergesort.

A conversation is the sequence of its turns' 16-byte digests, its path. Paths are dealt to ranges of the order
(path, conv_id), so a very common conversation, or a very common first turn, lies in many ranges. A
range sorts runs whose entries carry the length of the prefix that they share with the one before (LCP), and merges them with a loser tree:
two candidates with different LCPs to the last winner are told apart without looking at a turn, and with equal ones
the comparison begins behind the shared turns. The merged stream keeps the open path as a stack and emits a
node when the path leaves it.

A node that reaches over a border between ranges is emitted by each of them in part. What is counted once for it is
counted by the range where it begins (child of its parent, bytes of its text) or ends (leaf); the parts
are then added up by key. Borders are known by the LCP of the last path before and the first path behind, so only nodes
on such a shared prefix are parts: at most one turn sequence a border.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .store import materialize, release

#: Bytes of a turn's digest in a path.
WIDTH = 16
#: Turns that a range holds, about.
RANGE_TURNS = 100_000
#: Conversations of a sorted run.
RUN = 2_000
#: Parts of nodes that may be broadcast.
BROADCAST_PARTS = 200_000

_LONGS = ("parent_conv_id", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
#: Rows of a range: ``key`` and ``ends`` stand for nodes that are parts, ``parent`` for nodes whose parent is one.
NODES = T.StructType(
    [T.StructField("key", T.BinaryType()), T.StructField("parent", T.BinaryType())] + [T.StructField(c, T.LongType()) for c in _LONGS]
    + [T.StructField("ends_sha256", T.StringType()), T.StructField("ends", T.BinaryType()), T.StructField("range", T.IntegerType())],
)


def rebuilt(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", every: int = 5, most: int = 9) -> DataFrame:
    """Each conversation begun anew from the first turns of another: ``conv_id``, ``path`` (digests end to end), ``sizes`` (UTF-8 bytes of each turn's text).

    Conversation c takes the first h turns of c - c % ``every`` (all if there are fewer, none if that one is absent), then its own after
    the first h, where h is the crc32 of c's digits modulo ``most``. Turns are ordered by number (null first), then by digest. Null role or
    text is empty; rows without an id belong to no conversation.
    """
    said, spoken = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(spoken).cast("string"), F.lit(":"), spoken, said)))
    t = turns.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).isNotNull().alias("some"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(said).cast("long").alias("size")).alias("t"),
    )
    own = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own")).select("conv_id", F.col("own.digest").alias("digests"), F.col("own.size").alias("sizes"))
    own = materialize(own.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")), "trie-conversations")
    start = own.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), *[F.slice(c, 1, most - 1).alias("base_" + c) for c in ("digests", "sizes")])
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(start, "base", "left")

    def spliced(c: str) -> Column:
        head = F.coalesce(F.slice("base_" + c, F.lit(1), F.col("h")), F.slice(c, 1, 0))
        return F.concat(head, F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0))))

    return both.select("conv_id", spliced("digests").alias("path"), spliced("sizes").alias("sizes"))


def shared(a: bytes, b: bytes, start: int = 0) -> int:
    """Turns that two paths share, at least ``start`` of them known to be equal."""
    n, most = start, min(len(a), len(b)) // WIDTH
    while n < most and a[n * WIDTH:(n + 1) * WIDTH] == b[n * WIDTH:(n + 1) * WIDTH]:
        n += 1
    return n


def sorted_run(rows: list[tuple[bytes, int, list[int]]]) -> list[list]:
    """Entries [lcp, path, conv_id, sizes] in order; the first one's lcp is 0."""
    rows.sort(key=lambda r: r[:2])
    out, last = [], b""
    for path, conv, sizes in rows:
        out.append([shared(last, path), path, conv, sizes])
        last = path
    return out


def _less(a: list, b: list) -> bool:
    """Whether ``a`` comes before ``b``; both carry their LCP with the last winner. The loser then carries its LCP with the winner."""
    if a[0] != b[0]:  # the longer one follows the last winner more closely; the loser's LCP with it is the shorter one
        return a[0] > b[0]
    n = shared(a[1], b[1], a[0])
    at = n * WIDTH
    first = (a[1][at:at + WIDTH], a[2]) <= (b[1][at:at + WIDTH], b[2])
    (b if first else a)[0] = n
    return first


def merged(runs: list[list[list]]) -> Iterator[list]:
    """The runs' entries in one order, each with its LCP with the entry before, by a loser tree."""
    k = 1
    while k < len(runs):
        k *= 2
    heads = [iter(r) for r in runs]
    current: list = [next(h, None) for h in heads] + [None] * (k - len(runs))
    beats = lambda i, j: current[j] is None or (current[i] is not None and _less(current[i], current[j]))
    losers, winners = [0] * k, [0] * (2 * k)
    winners[k:] = range(k)
    for node in range(k - 1, 0, -1):
        i, j = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (i, j) if beats(i, j) else (j, i)
    best = winners[1]
    while current[best] is not None:
        yield current[best]
        current[best] = next(heads[best], None)  # its lcp is with the entry just yielded, the one before it in its run
        node = (best + k) // 2
        while node:
            if not beats(best, losers[node]):
                best, losers[node] = losers[node], best
            node //= 2


class _Open:
    """A node on the open path."""

    __slots__ = ("key", "parent", "depth", "size", "begins", "conv", "convs", "children", "leaves", "saved", "ends", "below", "inner")

    def __init__(self, key: bytes, parent: bytes | None, depth: int, size: int, begins: bool):
        self.key, self.parent, self.depth, self.size, self.begins = key, parent, depth, size, begins
        self.conv, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.inner = False  # some member goes on, in this range
        self.ends: list[int] = []
        self.below: list[tuple] = []


def joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def nodes_of(stream: Iterator[list], before: int, behind: int, number: int) -> Iterator[tuple]:
    """The nodes of a range from its ordered entries, as rows of ``NODES``.

    ``before`` and ``behind``: turns that the range's first and last path share with the neighbouring ranges, -1 if there is none. The
    nodes on those prefixes are parts, with the ids that end there packed; children of whole nodes know their parent's id. Members
    that end at a node come before those that go on, so the range where a node ends sees whether it is a leaf.
    """
    stack: list[_Open] = []

    def close(last: bool) -> Iterator[tuple]:
        o = stack.pop()
        ends_here = not last or o.depth > behind
        o.saved += o.convs * o.size - (o.size if o.begins else 0)
        o.leaves += not o.inner and ends_here
        if stack:
            up = stack[-1]
            up.conv = o.conv if up.conv is None else min(up.conv, o.conv)
            up.convs += o.convs
            up.children += o.begins
            up.inner = True
            up.leaves += o.leaves
            up.saved += o.saved
        whole = o.begins and ends_here
        for below in o.below:
            yield (None, None if whole else o.key, o.conv if whole else None, *below)
        sums = (o.depth, o.conv, o.convs, o.children, o.leaves, o.saved)
        if not whole:
            yield (o.key, o.parent, None, *sums, None, np.array(o.ends, dtype=np.int64).tobytes(), number)
            return
        row = (*sums, hashlib.sha256(joined(o.ends).encode()).hexdigest(), None, number)
        if stack:
            stack[-1].below.append(row)
        else:
            yield (None, None, None, *row)

    seen = False
    for lcp, path, conv, sizes in stream:
        while len(stack) > lcp + 1:
            yield from close(False)
        if not stack:
            stack.append(_Open(b"", None, 0, 0, before < 0))
        for depth in range(len(stack), len(sizes) + 1):
            up = stack[-1]
            key = hashlib.md5(up.key + path[(depth - 1) * WIDTH:depth * WIDTH]).digest()
            stack.append(_Open(key, up.key, depth, sizes[depth - 1], seen or depth > before))
        top = stack[-1]
        top.conv = conv if top.conv is None else min(top.conv, conv)
        top.convs += 1
        top.ends.append(conv)
        seen = True
    while stack:
        yield from close(True)


def _ranges(paths: DataFrame, per_range: int) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """The paths dealt to ranges of (path, conv_id), and the LCPs at each range's borders."""
    flat = paths.select("conv_id", F.array_join(F.transform("path", F.hex), "").alias("hexed"), "sizes").withColumn("path", F.unhex("hexed")).drop("hexed")
    flat = materialize(flat, "trie-paths")
    turns = flat.agg(F.sum(F.size("sizes") + 1)).head()[0] or 0
    dealt = flat.repartitionByRange(max(1, -(-turns // per_range)), "path", "conv_id").withColumn("range", F.spark_partition_id())
    dealt = materialize(dealt, "trie-ranges")
    release(flat)
    # two paths a range
    ends = sorted(tuple(r) for r in dealt.groupBy("range").agg(F.min("path").alias("first"), F.max("path").alias("last")).collect())
    lcps = [shared(bytes(a[2]), bytes(b[1])) for a, b in zip(ends, ends[1:], strict=False)]
    borders = {r[0]: (lcps[i - 1] if i else -1, lcps[i] if i < len(lcps) else -1) for i, r in enumerate(ends)}
    return dealt, borders


def nodes(paths: DataFrame, per_range: int = RANGE_TURNS, run: int = RUN) -> DataFrame:
    """One row per distinct prefix of the paths (``conv_id``, ``path``: array of 16-byte digests, ``sizes``: bytes of each turn).

    ``conv_id``: smallest member; ``depth``; ``parent_conv_id``: the parent's smallest member (root: null); ``n_convs``: members; ``n_children``;
    ``n_leaves``: childless nodes of the subtree, the node itself included; ``saved_tokens``: bytes of text that the subtree stores once instead
    of for each member; ``ends_sha256``: digest of the ids that end at the node, ascending, joined by commas (none: of the empty string). No
    conversations give no rows. A conversation's path (16 bytes a turn) must fit a row. The ids that end at one node are hashed
    one after the other, as the digest demands, packed in blocks of a range each.
    """
    dealt, borders = _ranges(paths, per_range)
    schema = to_arrow_schema(NODES)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, pending, number = {}, {}, None
        for b in batches:
            for conv, path, sizes, number in zip(*(b.column(c).to_pylist() for c in ("conv_id", "path", "sizes", "range")), strict=True):
                rows = pending.setdefault(number, [])
                rows.append((path, conv, sizes))
                if len(rows) >= run:
                    runs.setdefault(number, []).append(sorted_run(pending.pop(number)))
        for number, rows in pending.items():
            runs.setdefault(number, []).append(sorted_run(rows))
        for number in sorted(runs):
            rows = nodes_of(merged(runs.pop(number)), *borders[number], number)
            while out := list(islice(rows, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of one key follow each other by range; only the digest so far is held
        key, digest, first = None, hashlib.sha256(), True
        for b in batches:
            for k, ends in zip(b.column("key").to_pylist(), b.column("ends").to_pylist(), strict=True):
                if key is not None and k != key:
                    yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": [digest.hexdigest()]})
                    digest, first = hashlib.sha256(), True
                key = k
                if ends:
                    digest.update((("" if first else ",") + joined(np.frombuffer(ends, dtype=np.int64).tolist())).encode())
                    first = False
        if key is not None:
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": [digest.hexdigest()]})

    # a range is sorted in one task, whole: read it by its number
    found = materialize(dealt.repartition(max(1, len(borders)), "range").mapInArrow(build, NODES), "trie-nodes")
    results = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parts = found.filter("key is not null")
    once = parts.groupBy("key").agg(
        F.first("parent", ignorenulls=True).alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    digests = parts.select("key", "range", "ends").repartition("key").sortWithinPartitions("key", "range").mapInArrow(hashed, "key binary, ends_sha256 string")
    once = materialize(once.join(digests, "key"), "trie-parts")
    whole = found.filter("key is null").select("parent", "parent_conv_id", *results)
    children = whole.filter("parent is not null").unionByName(once.select("parent", F.lit(None).cast("long").alias("parent_conv_id"), *results).filter("parent is not null"))
    top = whole.filter("parent is null").unionByName(once.select("parent", F.lit(None).cast("long").alias("parent_conv_id"), *results).filter("parent is null"))
    up = once.select(F.col("key").alias("parent"), F.col("conv_id").alias("up"))
    # as many as the borders' prefixes have turns
    if sum(max(b) + 2 for b in borders.values()) <= BROADCAST_PARTS:
        up = F.broadcast(up)
    under = children.join(up, "parent").withColumn("parent_conv_id", F.col("up"))
    columns = ["conv_id", "depth", "parent_conv_id", *results[2:]]
    return top.select(*columns).unionByName(under.select(*columns))
