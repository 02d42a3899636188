"""Links between items that share a bucket, and their connected groups, without all pairs.

Every pair that can be linked must share a bucket. The (bucket, item) records are shuffled once, and a
bucket's hub, its least member, is found as they stream by in order; buckets of one member end there. Each
item is then held against its least hub, and next against its other hubs outside its group so far: one pair
a record at most, however large the bucket. Most buckets are then inside one group and done. In those that
still hold several groups each member meets a few members of other groups, in ``ROUNDS`` rounds of random
order. What is left open after that, large buckets of items that mostly don't link, is searched for pairs
across groups in blocks, so that no link is lost that would join two. Buckets with the same members are
searched once, and members of a bucket's largest group meet only the bucket's other members.

A bucket may hold any share of the records: buckets that a count over every ``SAMPLE``-th item shows to be
large are dealt in cells of about ``CELL`` records, each with a hub of its own, and the cells' hubs meet the
least of them. The count only decides how records are dealt, never which are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.llm.storage import lean, materialise, maybe_broadcast, narrow_rows, sifted, small
from tidewheel.llm.wordhash import mix

#: A bucket above this many members is searched in pairs of blocks of about this size.
BLOCK = 1000
#: How many partners a member of an open bucket meets in each round before the search.
ROUNDS = (2,)
#: Buckets with more records than this are dealt in cells.
CELL = 1 << 14
SAMPLE = 64
#: Records of a slot, which are sorted in memory, and of a task that are packed at once; the bytes of a packed one.
SLOT, _PACKED = 1 << 20, 12
#: Up to this many edges (4 MB) are put together by the driver, which saves some fifteen small jobs.
HERE = 1 << 18
#: Tables of two or three longs up to this many rows are broadcast.
SIDE_ROWS = 500_000

#: (key, node) batches of those of a source.
Make = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node with an edge (a, b); comp is the least node of its group.

    Alternating large and small stars: a node's neighbours are tied to its least neighbour until nothing
    changes, in a number of rounds that grows with the logarithm of a group's diameter. Minima are
    combined before they are shuffled; joins on a hub may be split by Spark. ``HERE`` edges or fewer need no rounds.
    """
    e = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    mark = _mark(e)
    if mark[0] <= HERE:
        return _components_here(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(e.join(least, "a").filter("m < a").select("a", F.col("m").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialise(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        last, mark = mark, _mark(e)
        if last == mark:
            break
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return materialise(e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots), "components")


def _components_here(e: DataFrame) -> DataFrame:
    """``components`` of a few edges: each root is hooked to the least root it touches until nothing changes."""
    t = e.toArrow()
    nodes, at = np.unique(np.concatenate([t.column("a").to_numpy(), t.column("b").to_numpy()]), return_inverse=True)
    a, b = at[: len(t)], at[len(t) :]
    up = np.arange(len(nodes))
    while not np.array_equal(up[a], up[b]):
        x, y = up[a], up[b]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up, up[up]):
            up = up[up]
    found = pa.table({"node": pa.array(nodes, pa.int64()), "comp": pa.array(nodes[up], pa.int64())})
    return materialise(e.sparkSession.createDataFrame(found), "components")


def _mark(e: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(e.agg(F.count(F.lit(1)), F.sum(h.bitwiseAND(F.lit((1 << 31) - 1))), F.bit_xor(h)).first())


def sampled(df: DataFrame) -> DataFrame:
    """Every ``SAMPLE``-th node's rows."""
    return df.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0)


def _members(records: DataFrame, part: DataFrame | None, make: Make | None) -> DataFrame:
    """(key, cell, node, hub) of the different nodes of every cell with two or more; cell is -1 where a bucket is one."""
    spark = records.sparkSession
    if make is not None:
        return _packed_members(records, make)
    part = (sampled(records) if part is None else part).groupBy("key").count()
    cells = F.ceil(F.col("count") * SAMPLE / CELL).cast("int")
    hot = materialise(part.select(F.col("key").alias("hot"), cells.alias("cells")).filter("cells > 1"), "hot-buckets")
    plain = hot.isEmpty()
    if plain:
        dealt = records.withColumn("cell", F.lit(-1))
    else:
        cell = F.when(F.col("cells").isNull(), -1).otherwise(F.pmod(F.xxhash64("node", F.lit(1)), "cells")).cast("int")
        dealt = records.join(maybe_broadcast(hot, SIDE_ROWS), F.col("key") == F.col("hot"), "left").withColumn("cell", cell)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["key"] if plain else ["key", "cell"]
    dealt = dealt.select("key", "cell", "node").repartition(n, *by).sortWithinPartitions(*by, "node")
    with narrow_rows(spark):
        found = materialise(dealt.mapInArrow(lean(_hubs), "key long, cell int, node long, hub long"), "members")
    if plain:
        return found
    # A cell of one node is not in the output; it still has to meet the other cells.
    alone = records.join(maybe_broadcast(hot, SIDE_ROWS), F.col("key") == F.col("hot")).select("key", F.pmod(F.xxhash64("node", F.lit(1)), "cells").cast("int").alias("cell"), "node")
    alone = alone.groupBy("key", "cell").agg(F.min("node").alias("node"), F.max("node").alias("top")).filter("node = top")
    return found.unionByName(alone.select("key", "cell", "node", F.col("node").alias("hub")))


_MEMBER = pa.schema([("key", pa.int64()), ("cell", pa.int32()), ("node", pa.int64()), ("hub", pa.int64())])


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (key, cell, node): repeats go, runs of one node go, the others get their first node as hub.

    What is carried from one batch to the next is the last row, its run's hub and whether it was given.
    """
    carry: tuple[int, int, int] | None = None
    carry_hub, given = 0, False
    for batch in batches:
        key, cell, node = (batch.column(i).to_numpy() for i in range(3))
        if not len(key):
            continue
        if carry is not None:
            key, cell, node = (np.concatenate([np.array([c], a.dtype), a]) for c, a in zip(carry, (key, cell, node), strict=True))
        start = np.ones(len(key), bool)
        start[1:] = (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
        keep = start.copy()
        keep[1:] |= node[1:] != node[:-1]
        key, cell, node, start = key[keep], cell[keep], node[keep], start[keep]
        first = np.flatnonzero(start)
        size = np.diff(np.append(first, len(key)))
        hub = node[first]
        if carry is not None:
            hub[0] = carry_hub
        out = np.repeat(size > 1, size)
        if carry is not None and given:
            out[0] = False
        yield pa.RecordBatch.from_arrays([pa.array(a[out]) for a in (key, cell, node, np.repeat(hub, size))], schema=_MEMBER)
        given = bool(size[-1] > 1 or (given and carry is not None and len(first) == 1))
        carry, carry_hub = (int(key[-1]), int(cell[-1]), int(node[-1])), int(hub[-1])


def _packed_members(source: DataFrame, make: Make) -> DataFrame:
    """``_members`` of the records that ``make`` makes of ``source``, which are dealt and sorted as packs of many.

    A row of the shuffle is what a task has for a slot, a part of the hashes of all keys, 12 bytes a record. A key in it is
    four bytes; where two keys agree in these and their slot, their buckets are one, which gives more pairs and loses none.
    Cells of large buckets are packs of their own.
    """
    spark = source.sparkSession
    part = sampled(source).mapInArrow(lean(make), "key long, node long").groupBy("key").count()
    cells = F.ceil(F.col("count") * SAMPLE / CELL).cast("int")
    part = materialise(part.select("key", "count", cells.alias("cells")), "bucket-sample")
    hot = part.filter("cells > 1").select("key", "cells").toArrow()
    hot = dict(zip(hot.column("key").to_pylist(), hot.column("cells").to_pylist(), strict=True))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = n * max(8, -(-(part.agg(F.sum("count")).first()[0] or 0) * SAMPLE // (n * SLOT)))
    dealt = source.mapInArrow(lean(lambda x: _packs(make(x), hot, slots)), "slot int, key long, cell int, data binary")
    dealt = dealt.repartition(n, "slot").sortWithinPartitions("slot", "key", "cell")
    return materialise(dealt.mapInArrow(lean(_unpacked), "key long, cell int, node long, hub long"), "members")


def _packs(batches: Iterator[pa.RecordBatch], hot: dict[int, int], slots: int) -> Iterator[pa.RecordBatch]:
    """(slot, key, cell, data) of (key, node): the records of a slot, or the nodes of a cell of a bucket in ``hot``."""
    large = np.array(sorted(hot), np.int64)
    held, n = [], 0

    def pack() -> pa.RecordBatch:
        key, node = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(2))
        rows = []
        if len(large):
            at = np.minimum(np.searchsorted(large, key), len(large) - 1)
            inside = large[at] == key
            of, own = at[inside], node[inside]
            key, node = key[~inside], node[~inside]
            cell = (mix(own.view(np.uint64)) % np.array([hot[k] for k in large.tolist()], np.uint64)[of]).astype(np.int64)
            order = np.lexsort((cell, of))
            of, cell, own = of[order], cell[order], own[order]
            first = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(cell, prepend=-1) != 0))
            for a, b in zip(first.tolist(), np.append(first, len(own))[1:].tolist(), strict=True):
                k, c = int(large[of[a]]), int(cell[a])
                rows.append((hash((k, c)) % slots, k, c, own[a:b].tobytes()))
        bits = key.view(np.uint64)
        slot = (bits >> np.uint64(40)) % np.uint64(slots)
        order = np.argsort(slot.astype(np.uint16 if slots <= 1 << 16 else np.uint32), kind="stable")
        data = np.empty((len(key), _PACKED), np.uint8)
        data[:, :4] = bits[order].astype("<u4").view(np.uint8).reshape(-1, 4)
        data[:, 4:] = node[order].astype("<i8").view(np.uint8).reshape(-1, 8)
        slot = slot[order].astype(np.int64)
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        ends = pa.array(np.append(first, len(key)) * _PACKED, pa.int32())
        plain = pa.Array.from_buffers(pa.binary(), len(first), [None, ends.buffers()[1], pa.py_buffer(data)])
        names = [pa.array(slot[first], pa.int32()), pa.array(np.zeros(len(first), np.int64)), pa.array(np.full(len(first), -1, np.int32)), plain]
        names = [pa.concat_arrays([c, pa.array(more, c.type)]) for c, more in zip(names, zip(*rows, strict=True), strict=True)] if rows else names
        return pa.RecordBatch.from_arrays(names, names=["slot", "key", "cell", "data"])

    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= SLOT:
            yield pack()
            held, n = [], 0
    if n:
        yield pack()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``_hubs`` gives, of sorted packs; a cell of one node is its own hub, as it has to meet the other cells."""
    held: list[bytes] = []
    last: tuple | None = None

    def out() -> pa.RecordBatch:
        slot, name, of = last
        data = b"".join(held)
        if of < 0:
            data = np.frombuffer(data, np.uint8).reshape(-1, _PACKED)
            key = np.ascontiguousarray(data[:, :4]).view("<u4").reshape(-1)
            order = np.argsort(key)
            same = key[order[1:]] == key[order[:-1]]
            # Most keys are of one record and go.
            order = order[np.append(same, False) | np.insert(same, 0, False)]
            key, node = key[order].astype(np.int64) | slot << 32, np.ascontiguousarray(data[order, 4:]).view("<i8").reshape(-1)
        else:
            node = np.frombuffer(data, np.int64)
            key = np.full(len(node), name, np.int64)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        start = np.ones(len(key), bool)
        start[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(start)
        size = np.diff(np.append(first, len(key)))
        keep = np.repeat((size > 1) | (of >= 0), size)
        return pa.RecordBatch.from_arrays([pa.array(a[keep]) for a in (key, np.full(len(key), of, np.int32), node, np.repeat(node[first], size))], schema=_MEMBER)

    for batch in batches:
        for slot, key, cell, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if held and last != (slot, key, cell):
                yield out()
                held = []
            last = slot, key, cell
            held.append(data)
    if held:
        yield out()


def _in_comp(df: DataFrame, comp: DataFrame | None, node: str, name: str) -> DataFrame:
    """``df`` with a column ``name``: the component of ``node``, itself if it has no link."""
    if comp is None:
        return df.withColumn(name, F.col(node))
    c = comp.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
    return df.join(c, F.col(node) == F.col("_n"), "left").withColumn(name, F.coalesce("_c", node)).drop("_n", "_c")


def _joined(comp: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The components after ``links`` are added."""
    if links.isEmpty():
        return comp
    if comp is None:
        return maybe_broadcast(components(links), SIDE_ROWS)
    old = comp.filter("node != comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
    return maybe_broadcast(components(old.unionByName(links.select("a", "b"))), SIDE_ROWS)


def groups(
    records: DataFrame, prepare: Callable[[DataFrame], None], verify: Callable[[DataFrame], DataFrame], search: Callable[[DataFrame], DataFrame], part: DataFrame | None = None, make: Make | None = None
) -> DataFrame:
    """(node, comp) of all linked nodes.

    ``records``: (key, node), nodes as longs, repeatable reads. ``prepare`` gets all nodes that share a
    bucket. ``verify`` keeps of (a, b) the linked pairs. ``search`` gets (key, i, j, blk, node, comp), rows
    of block pairs, and gives all pairs (a, b) across comps of a block pair that may be links. ``part``: the records of
    ``sampled`` nodes, where those are cheaper to make than to filter. ``make``: ``records`` are rows with a node of which it makes
    the records, with keys that are hashes; these are then shuffled in packs.
    """
    spark = records.sparkSession
    members = _members(records, part, make)
    prepare(materialise(members.select("node").distinct(), "bucket-nodes"))
    stars = members.filter("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    cells = members.filter("cell >= 0").select("key", F.col("hub").alias("a")).distinct()
    cells = cells.withColumn("b", F.min("a").over(Window.partitionBy("key"))).filter("a != b").select("a", "b")
    stars = materialise(stars.unionByName(cells).distinct(), "stars")
    tried = materialise(stars.groupBy("a").agg(F.min("b").alias("b")), "pairs")
    links = materialise(verify(tried), "links")
    # Nodes that are linked to one hub need not meet; whole components are made once both kinds of pairs are known.
    near = maybe_broadcast(links.select(F.col("a").alias("node"), F.col("b").alias("comp")), SIDE_ROWS)
    others = _in_comp(_in_comp(stars.join(tried, ["a", "b"], "left_anti"), near, "a", "ca"), near, "b", "cb")
    others = materialise(others.filter("ca != cb").select("a", "b"), "pairs")
    comp = _joined(None, links.unionByName(materialise(verify(others), "links")))
    tried = stars
    for turn, partners in enumerate(ROUNDS):
        left = _open(members, comp, ROUNDS[turn - 1] + 1 if turn else 2)
        if left.isEmpty():
            return _or_empty(comp, spark)
        pairs = materialise(_partners(left, partners, turn).join(tried, ["a", "b"], "left_anti"), "pairs")
        comp = _joined(comp, materialise(verify(pairs), "links"))
        tried = tried.unionByName(pairs)
    left = _open(members, comp, ROUNDS[-1] + 1)
    if not left.isEmpty():
        pairs = search(_dealt(left)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        pairs = materialise(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        comp = _joined(comp, materialise(verify(pairs), "links"))
    return _or_empty(comp, spark)


def both(pairs: DataFrame, held: DataFrame, column: str) -> DataFrame:
    """(a, b, side, column): of each materialised pair the rows of its two nodes in ``held``, one after the other.

    Few pairs go to what is held, so that of texts only those that a pair asks for are shuffled, once; of many
    pairs the ends are met by what a bitmap of them leaves.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held, pairs = held.select("node", column), pairs.select("a", "b")
    if small(pairs, SIDE_ROWS):
        sides = [held.join(F.broadcast(pairs), F.col("node") == F.col(c)).select("a", "b", F.lit(k).alias("side"), column) for k, c in enumerate("ab")]
        rows = sides[0].unionByName(sides[1])
    else:
        ends = pairs.select("a", "b", F.posexplode(F.array("a", "b")).alias("side", "node"))
        rows = sifted(held, ends).join(ends, "node").select("a", "b", "side", column)
    return rows.repartition(n, "a", "b").sortWithinPartitions("a", "b", "side")


def _or_empty(comp: DataFrame | None, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "node long, comp long") if comp is None else comp


def _open(members: DataFrame, comp: DataFrame | None, done: int) -> DataFrame:
    """(key, cell, node, comp) of the buckets that hold several comps and, if dealt in one cell, over ``done`` members."""
    at = _in_comp(members.select("key", "cell", "node"), comp, "node", "comp")
    many, low = F.count(F.lit(1)).alias("n"), F.lit((1 << 40) - 1)
    state = at.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("cell").alias("cell"), many, F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).bitwiseAND(low)).alias("y"))
    # Buckets with the same members need one search.
    still = state.filter((F.col("low") < F.col("high")) & ((F.col("n") > done) | (F.col("cell") >= 0))).groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    still = maybe_broadcast(materialise(still.select("key"), "open-buckets"), SIDE_ROWS)
    return materialise(at.join(still, "key"), "open")


def _partners(left: DataFrame, partners: int, turn: int) -> DataFrame:
    """Pairs (a, b) of each member with those of the next ``partners`` members of its cell that are in another comp."""
    w = Window.partitionBy("key", "cell").orderBy(F.xxhash64("node", F.lit(turn)), "node")
    ahead = F.array(*[F.struct(F.lead("node", i).over(w).alias("node"), F.lead("comp", i).over(w).alias("comp")) for i in range(1, partners + 1)])
    met = left.select("node", "comp", ahead.alias("ahead")).select("node", "comp", F.explode("ahead").alias("o")).filter("o.comp != comp")
    return met.select(F.greatest("node", "o.node").alias("a"), F.least("node", "o.node").alias("b")).distinct()


def _dealt(left: DataFrame) -> DataFrame:
    """(key, i, j, blk, node, comp): the members of open buckets in pairs of blocks; the first blocks hold those outside the largest group."""
    each = left.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    size = each.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("n"))
    parts: Callable[[Column], Column] = lambda n: F.ceil(n / BLOCK).cast("int")
    size = size.select("key", F.col("top.comp").alias("largest"), parts(F.col("n") - F.col("top.c")).alias("few"), parts(F.col("top.c")).alias("more"))
    inside = F.col("comp") == F.col("largest")
    own = F.when(inside, F.col("few") + F.pmod(F.xxhash64("node"), "more")).otherwise(F.pmod(F.xxhash64("node"), "few"))
    last = F.when(inside, F.col("few")).otherwise(F.col("few") + F.col("more")) - 1
    rows = left.join(size, "key").withColumn("blk", own.cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), last)))
    return rows.select("key", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "node", "comp")


class Union:
    """Union-find over the places of a block pair's components."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.find(x)] = self.find(y)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of rows that agree in their first ``keys`` columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        names = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True))
        start = 0
        for n in range(1, len(names) + 1):
            if n == len(names) or names[n] != names[start]:
                if held and last != names[start]:
                    yield pa.Table.from_batches(held)
                    held = []
                last = names[start]
                held.append(batch.slice(start, n - start))
                start = n
    if held:
        yield pa.Table.from_batches(held)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 1 << 13) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``rows`` rows that end where a run of rows with the same first ``keys`` columns does, and where runs start."""

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        new[:1] = True
        for i in range(keys):
            c = t.column(i).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            t = pa.Table.from_batches(held)
            at = starts(t)
            if len(at) > 1:
                yield t.slice(0, at[-1]), at[:-1]
                held = t.slice(at[-1]).to_batches()
                n = len(t) - int(at[-1])
    if n:
        t = pa.Table.from_batches(held)
        yield t, starts(t)


def pairs_in_runs(starts: np.ndarray, n: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (u, v), u < v, of places of the same run, about ``most`` at a time."""
    size = np.diff(np.append(starts, n))
    ahead = np.repeat(starts + size, size) - np.arange(n) - 1
    upto = np.cumsum(ahead)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")))
        u = np.repeat(np.arange(a, b), ahead[a:b])
        first = np.repeat(np.cumsum(ahead[a:b]) - ahead[a:b], ahead[a:b])
        yield u, u + 1 + np.arange(len(u)) - first
        a = b
