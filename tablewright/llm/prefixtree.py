"""A trie of conversations' turn prefixes, built as a Patricia tree: only branches, ends and leaves, and edges between them.

A prefix is known by its depth and 128 bits over its turns, which a running XOR gives without holding a conversation. Equal prefixes
are sorted together by that key, which takes the place of a lexicographic sort of whole sequences: a conversation may be longer
than a task's memory. A node belongs to the smallest conversation through it, so each conversation owns the lower end of its own
path, from the depth where it leaves the paths of smaller ones. Its points, the nodes that branch, end a conversation or have no
child, cut that into compressed edges. Turns of an edge are shared alike, so its sum is (members - 1) times a difference of
running word counts; suffix sums over the owned edges and the totals of the paths that hang below give each point's
aggregates. Then edges are expanded: a node inside takes members, leaves and children from the edge, and its sum from the edge's
suffix.

Running values are made by chunks of `CHUNK` depths and carried from chunk to chunk, so no conversation, however long, is one
task's; prefixes with very many children or members are aggregated before the shuffle or dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, heavy_join, stored

CHUNK = 4096
#: Conversations of a block share the opening of the block's first one; an opening has fewer turns than this.
BLOCK, OPENING = 20, 4
_NODE = ("depth", "p1", "p2")
_ADD = {"sum": lambda a, b: a + b, "xor": lambda a, b: a.bitwiseXOR(b)}
_AGG = {"sum": F.sum, "xor": F.bit_xor, "max": F.max}


def _running(rows: DataFrame, key: str, at: Column, order: list[Column], terms: dict[str, tuple[str, Column]], totals: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """rows with running sums or XORs (terms) of each key in order, and sums or maxima over the whole key (totals).

    at, by which the order begins, cuts a key into chunks of `CHUNK`; windows reach over one chunk, and over one row for each chunk of a key.
    """
    cut, totals = rows.withColumn("_chunk", F.floor(at / CHUNK)), totals or {}
    parts = cut.groupBy(key, "_chunk").agg(*[_AGG[kind](v).alias(f"_{n}") for n, (kind, v) in (terms | totals).items()])
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(key)
    carried = [F.coalesce(_AGG[kind](f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n, (kind, _) in terms.items()]
    whole = [_AGG[kind](f"_{n}").over(every).alias(n) for n, (kind, _) in totals.items()]
    inside = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cut.join(parts.select(key, "_chunk", *carried, *whole), [key, "_chunk"])
    for n, (kind, v) in terms.items():
        out = out.withColumn(n, _ADD[kind](F.col(f"_{n}"), _AGG[kind](v).over(inside)))
    return out.drop("_chunk", *[f"_{n}" for n in terms])


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, t1, t2, words): the turns of each conversation in order, numbered from 1, known by 128 bits of role and text.

    Null roles and texts are empty ones. Null turns come first; equal ones follow the order of their bits, so repeated rows are
    turns of their own. Rows without conv_id belong to no conversation and are left out. Other columns take no part.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    count = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), role, text).alias("t2"), count.alias("words"))
    rows = stored(rows, "turns")
    at = F.coalesce(F.col("turn"), F.lit(-(2**63)))
    return _running(rows, "conv_id", at, [F.asc_nulls_first("turn"), F.col("t1"), F.col("t2")], {"place": ("sum", F.lit(1))}).select("conv_id", "place", "t1", "t2", "words")


def _rows(of: DataFrame, conv: Column | str, depth: Column) -> DataFrame:
    depth = depth.cast("long")
    part = lambda seed: F.xxhash64(F.lit(seed), depth, "t1", "t2")
    return of.select(F.col(conv).alias("conv_id") if isinstance(conv, str) else conv.alias("conv_id"), depth.alias("depth"), part(3).alias("x1"), part(5).alias("x2"), "words")


def _starts(ids: DataFrame) -> DataFrame:
    """The empty prefix of each conversation."""
    zero = F.lit(0).cast("long")
    return ids.select("conv_id", *[zero.alias(c) for c in ("depth", "x1", "x2", "words")])


def plain(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, x1, x2, words) of conversations as they are, for tree()."""
    rows = turns(conversations)
    return _rows(rows, "conv_id", F.col("place")).union(_starts(conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """As plain(), of conversations that share openings: the first h turns of the block's first conversation, then their own after the first h.

    The block's first one is c - c % 20 (none if there is no such conversation; the remainder has the sign of c, as in SQL), and h
    is crc32 of c as text, modulo 4.
    """
    rows = stored(turns(conversations), "numbered")
    first = F.col("conv_id") - F.col("conv_id") % BLOCK
    ids = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    heads = ids.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("first"), F.least("n", F.lit(OPENING - 1)).alias("there"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENING).cast("int")
    ids = ids.withColumn("first", first).withColumn("h", h).join(heads, "first", "left")
    ids = stored(ids.select("conv_id", "n", "first", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("k")), "conversations")
    own = heavy_join(rows, ids, ["conv_id"], "n").where("place > h")
    opening = rows.where((F.col("conv_id") % BLOCK == 0) & (F.col("place") < OPENING)).select(F.col("conv_id").alias("first"), "place", "t1", "t2", "words")
    opening = ids.join(opening, "first").where("place <= k")
    return _rows(own, "conv_id", F.col("place") - F.col("h") + F.col("k")).union(_rows(opening, "conv_id", F.col("place"))).union(_starts(ids))


def tree(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie of rows (see plain()), and the ends: (depth, p1, p2, conv_id) of each conversation's last node.

    A node has depth, p1 and p2 (its prefix), conv_id (the smallest member), parent_conv_id, n_convs, n_children, n_leaves and
    saved_tokens. Without conversations there are no nodes.
    """
    rows = stored(rows, "rows")
    path = _running(rows, "conv_id", F.col("depth"), [F.col("depth")], {"p1": ("xor", F.col("x1")), "p2": ("xor", F.col("x2")), "upto": ("sum", F.col("words"))}, {"last": ("max", F.col("depth"))})
    path = stored(path.select("conv_id", *_NODE, F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"), "words", "upto", (F.col("depth") == F.col("last")).alias("end")), "paths")
    dropped(rows)
    nodes = stored(path.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.min(c).alias(c) for c in ("q1", "q2", "words", "upto")], F.count_if("end").alias("ends")), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(children, list(_NODE), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    # the owner of the node above; a node of another owner is the top of its owner's path
    own = ("n_convs", "conv_id", "words", "upto", "ends")
    below = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), *own, F.col("n_children").alias("own_children"), F.struct(*_NODE).alias("node"))
    below = below.select("depth", "p1", "p2", *own, "own_children", *[F.col(f"node.{c}").alias(f"n_{c}") for c in _NODE])
    above = nodes.where("n_children > 0").select(*_NODE, F.col("conv_id").alias("parent_conv_id"), "n_children")
    linked = heavy_join(below, above, list(_NODE), "n_children").select(*[F.col(f"n_{c}").alias(c) for c in _NODE], *own, F.col("own_children").alias("n_children"), "parent_conv_id")
    root = nodes.where("depth = 0").select(*_NODE, *own, "n_children", F.lit(None).cast("long").alias("parent_conv_id"))
    linked = stored(linked.union(root), "linked")
    point = (F.col("n_children") != 1) | (F.col("ends") > 0) | (F.col("depth") == 0)

    # compressed edges: from each point up to the owner's point above, or to where its path begins
    top = F.col("parent_conv_id").isNull() | (F.col("parent_conv_id") != F.col("conv_id"))
    begin = linked.where(top).select("conv_id", (F.col("depth") - 1).alias("depth"), (F.col("upto") - F.col("words")).alias("upto"), F.lit(True).alias("begin"))
    marks = stored(linked.where(point).withColumn("begin", F.lit(False)).unionByName(begin, allowMissingColumns=True), "points")
    edges = _edges(marks)
    gain = (F.col("n_convs") - 1) * (F.col("upto") - F.col("upto_above"))
    edges = _running(stored(edges.withColumn("gain", gain), "edges"), "conv_id", F.col("depth"), [F.col("depth")], {"so_far": ("sum", F.col("gain"))}, {"total": ("sum", F.col("gain")), "leaf": ("max", (F.col("n_children") == 0).cast("long"))})
    edges = stored(edges.withColumn("after", F.col("total") - F.col("so_far")), "edges")

    # what hangs below a point besides its owner's path: the paths of its other members, which begin deeper
    owners = stored(edges.groupBy("conv_id").agg(F.max("total").alias("total"), F.max("leaf").alias("leaf"), (F.min("depth_above") + 1).alias("begins"), (F.max("depth") + 1).alias("rows")), "owners")
    hung = heavy_join(path.select("conv_id", *_NODE), owners, ["conv_id"], "rows").where("depth < begins").groupBy(*_NODE).agg(F.sum("total").alias("hung"), F.sum("leaf").alias("hung_leaves"))
    points = edges.join(hung, list(_NODE), "left").withColumn("below", F.col("after") + F.coalesce("hung", F.lit(0))).withColumn("n_leaves", F.col("leaf") + F.coalesce("hung_leaves", F.lit(0)))
    points = stored(points.drop("hung", "hung_leaves", "so_far", "gain", "total", "after", "leaf"), "points")
    out = ("conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    full = points.withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words") + F.col("below")).select(*_NODE, *out)

    # expand the nodes inside edges
    step = F.lit(CHUNK).cast("long")
    inside = points.where("depth - depth_above > 1").select("conv_id", "n_convs", "n_leaves", "below", F.col("upto").alias("upto_point"), (F.col("depth") - 1).alias("lowest"), F.explode(F.sequence(F.col("depth_above") + 1, F.col("depth") - 1, step)).alias("highest"))
    inside = inside.withColumn("depth", F.explode(F.sequence("highest", F.least("lowest", F.col("highest") + CHUNK - 1)))).drop("highest", "lowest")
    unary = linked.where(~point).select(*_NODE, "conv_id", "parent_conv_id", "words", "upto").join(inside, ["conv_id", "depth"])
    suffix = (F.col("n_convs") - 1) * (F.col("upto_point") - F.col("upto") + F.col("words"))
    unary = unary.withColumn("n_children", F.lit(1).cast("long")).withColumn("saved_tokens", suffix + F.col("below")).select(*_NODE, *out)
    return full.unionByName(unary), path.where("end").select(*_NODE, "conv_id")


def _edges(marks: DataFrame) -> DataFrame:
    """The points of marks with depth and words so far of the mark before them in their owner's path (depth_above, upto_above)."""
    cut = marks.withColumn("_chunk", F.floor(F.col("depth") / CHUNK))
    mark = F.struct("depth", "upto")
    last = cut.groupBy("conv_id", "_chunk").agg(F.max(mark).alias("_last"))
    last = last.withColumn("_last", F.max("_last").over(Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)))
    near = F.lag(mark).over(Window.partitionBy("conv_id", "_chunk").orderBy("depth"))
    out = cut.join(last, ["conv_id", "_chunk"]).withColumn("_near", F.coalesce(near, F.col("_last"))).where("not begin")
    return out.select(*_NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "words", "upto", F.col("_near.depth").alias("depth_above"), F.col("_near.upto").alias("upto_above"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, part, ids) sorted by node and part: the SHA-256 of each node's ids, one node's state at a time."""
    node, state, done = None, None, []
    for batch in batches:
        for *key, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
            if key != node:
                if state:
                    done.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip((*_NODE, "ends_sha256"), r)) for r in done])
            done = []
    if state:
        yield pa.RecordBatch.from_pylist([dict(zip((*_NODE, "ends_sha256"), (*node, state.hexdigest())))])


def digest(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes without their prefixes, with the SHA-256 of the conversations that end there: decimal ids in ascending order, comma-joined.

    Ids are joined by parts of `CHUNK` numbers before they meet; the parts of a node are hashed in a stream.
    """
    parts = ends.groupBy(*_NODE, F.floor(F.col("conv_id") / CHUNK).alias("part")).agg(F.array_sort(F.collect_set("conv_id")).alias("ids"))
    parts = parts.select(*_NODE, "part", F.concat_ws(",", F.transform("ids", lambda i: i.cast("string"))).alias("ids"))
    hashed = parts.repartition(*_NODE).sortWithinPartitions(*_NODE, "part").mapInArrow(_digests, "depth long, p1 long, p2 long, ends_sha256 string")
    out = nodes.join(hashed, list(_NODE), "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
