"""Set similarity join of documents on word shingles with count-vector R-trees.

Exact: every two documents with ``100 * intersection >= percent * union`` are in one component.

1. Documents with equal sets are one node.
2. Sharding. Two sets that link differ in at most D tokens, D from their size class. The tokens are hashed
   into more than D token groups, so some non-empty group is equal in both: a node goes to one shard for
   each of its groups, by the hash of the group's tokens. Should too many of a node's groups be empty for
   this, it also takes part in a second hashing, and so on; then so does everything that it may link to.
3. In a shard members are held against the hub and against a few others; shards that then hold several
   components are searched for pairs across them with an R-tree over the members' count vectors. A pair's
   bound is the sum of coordinate minima, first over ``DIMENSIONS`` groups, then over about as many groups
   as the sets have tokens, which leaves few pairs that don't link.
4. Pairs that pass the bound are verified on whole token sets, made anew from the two texts.

Tokens are 64-bit hashes of shingles. Null or blank texts have empty sets and link with nothing. Rows of
one doc_id are rows of their own; a null doc_id never names a component unless all its members lack one.
An empty table gives an empty result; other columns are kept only by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import linkage
from tidewheel.llm.rtree import DIMENSIONS, CountRTree, folded, overlap_needed, packed, unpacked
from tidewheel.llm.storage import bounded_batches, fresh, lean, materialise, maybe_broadcast, settled
from tidewheel.llm.unitcache import portions
from tidewheel.llm.wordhash import mix, shingle_sets

SHINGLE = 3
PERCENT = 90


def _classes() -> np.ndarray:
    """Lower ends of the size classes, each 1.5 times the one before."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return np.array(out, np.int64)


CLASSES = _classes()


def shard_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """The shards of a set: equal for some group in any two sets that link."""
    n, keys = len(tokens), []
    if not n:
        return np.empty(0, np.uint64)
    own = int(np.searchsorted(CLASSES, n, "right")) - 1
    most = n * 100 // percent
    for c in (own, own + 1):
        if c > own and most < CLASSES[c]:
            break
        top = int(CLASSES[c + 1]) - 1
        differ = lambda sizes: sizes * (100 - percent) // (100 + percent)
        all_d, d = differ(2 * top), differ(n + min(most, top))
        size = all_d + 2 + all_d // 24
        for salt in range(64):
            salted = mix(tokens + np.uint64(0x51ED270B * (salt + 1)))
            group = ((salted >> np.uint64(33)) * np.uint64(size) >> np.uint64(31)).astype(np.int64)
            at = np.argsort(group, kind="stable")
            group = group[at]
            first = np.flatnonzero(np.diff(group, prepend=-1))
            sums = np.add.reduceat(mix(salted[at]), first)
            tag = np.uint64((c << 40) + (salt << 32))
            keys.append(mix(sums ^ mix(group[first].astype(np.uint64) + tag)))
            if len(first) > d:
                break
    return np.concatenate(keys)


def _sets(given: list[str | None], shingle: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    texts = [(t or "").encode("utf-8", "replace").lower() for t in given]
    for part in portions(texts):
        yield part, shingle_sets([texts[i] for i in part], shingle)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


#: How many set names a task remembers, to give a repeated set's keys once.
SEEN = 1 << 20
#: Texts whose sets are made at once.
_ROWS = 2000


def _named_sets(texts: pa.Array, shingle: int) -> Iterator[tuple[list[int], list[np.ndarray], list[tuple]]]:
    """Places in ``texts``, their sets and the two halves of the sets' 128-bit names, null if empty."""
    for start in range(0, len(texts), _ROWS):
        for part, sets in _sets(texts.slice(start, _ROWS).to_pylist(), shingle):
            halves = [(s, s ^ np.uint64(0xA5A5A5A5A5A5A5A5)) for s in sets]
            names = [tuple(_signed(mix(x).sum(keepdims=True))[0].item() if len(x) else None for x in h) for h in halves]
            yield [start + i for i in part], sets, names


class _Seen:
    """Tells a task whether a set is new to it."""

    def __init__(self) -> None:
        self.names: set[tuple] = set()

    def new(self, name: tuple) -> bool:
        if name[0] is None or name in self.names:
            return False
        if len(self.names) >= SEEN:
            self.names.clear()
        self.names.add(name)
        return True


def features(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, t (a hash of the text), n, s1, s2 (a 128-bit name of the set; null if empty) and keys, in the shared folder.

    Only every ``linkage.SAMPLE``-th set has keys, those by which large shards are told; ``records`` has the keys of all.
    """
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for part, sets, names in _named_sets(batch.column(1), shingle):
                rows: dict[str, list] = {c: [] for c in schema.names}
                for i, s, name in zip(part, sets, names, strict=True):
                    some = len(s) > 0 and int(mix(np.array([name[0]]).view(np.uint64))[0]) % linkage.SAMPLE == 0 and seen.new(name)
                    for c, v in zip(schema.names, (ids[i], marks[i], len(s), *name, _signed(shard_keys(s, percent)) if some else []), strict=True):
                        rows[c].append(v)
                yield pa.RecordBatch.from_pydict(rows, schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    return materialise(rows.mapInArrow(lean(out), "doc_id long, t long, n long, s1 long, s2 long, keys array<long>"), "shingles")


_RECORD = pa.schema([("key", pa.int64()), ("node", pa.int64())])


def records(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(key, node) of every set's shards, made where they are asked for: written down they take as much as the texts.

    Of rows of one task with the same set only the first gives keys, so a set that fills a third of the table
    comes to its shards as one record for each task.
    """

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            for _, sets, names in _named_sets(batch.column(0), shingle):
                keys = [(name[0], _signed(shard_keys(s, percent))) for s, name in zip(sets, names, strict=True) if seen.new(name)]
                if keys:
                    nodes = np.repeat(np.array([n for n, _ in keys], np.int64), [len(k) for _, k in keys])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for _, k in keys])), pa.array(nodes)], schema=_RECORD)

    return docs.select("text").mapInArrow(lean(out), "key long, node long")


def components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id for every row; component_id is the component's least doc_id."""
    spark = docs.sparkSession
    f = features(docs, shingle, percent)
    part = f.select(F.explode("keys").alias("key"), F.col("s1").alias("node"))
    # Texts of all nodes that share a shard, and their finer points.
    held: dict[str, DataFrame] = {}

    def prepare(nodes: DataFrame) -> None:
        holder = f.join(nodes, F.col("s1") == F.col("node"), "left_semi").groupBy(F.col("s1").alias("node")).agg(F.min(F.struct("doc_id", "t")).alias("h"))
        holder = maybe_broadcast(materialise(holder.select("node", F.col("h.doc_id").alias("holder"), F.col("h.t").alias("ht")), "holders"), linkage.SIDE_ROWS)
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        at = F.col("doc_id").eqNullSafe(F.col("holder")) & (F.xxhash64("text") == F.col("ht"))
        held["texts"] = materialise(own.join(holder, at).select("node", "text").dropDuplicates(["node"]), "texts")
        held["points"] = materialise(held["texts"].mapInArrow(lean(lambda x: _points(x, shingle)), "node long, point binary"), "points")

    def verify(pairs: DataFrame) -> DataFrame:
        if pairs.isEmpty():
            return pairs
        close = linkage.both(pairs, held["points"], "point").mapInArrow(lean(lambda x: _allowed(x, percent)), "a long, b long")
        return linkage.both(materialise(close, "close"), held["texts"], "text").mapInArrow(lean(lambda x: _linked(x, shingle, percent)), "a long, b long")

    def search(dealt: DataFrame) -> DataFrame:
        rows = dealt.join(held["points"], "node").select("key", "i", "j", "blk", "node", "comp", "point")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lean(lambda x: _searched(x, percent)), "a long, b long")

    comp = settled(spark, lambda: linkage.groups(records(docs, shingle, percent), prepare, verify, search, part), "set-groups")
    rows = f.select("doc_id", "n", "s1", "s2")
    # A set's rows are one node, named by both halves of its name where the rows are put together.
    same = rows.filter("s1 is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("least"))
    named = same.join(comp, F.col("s1") == F.col("node"), "left")
    whole = named.filter("comp is not null").groupBy("comp").agg(F.min("least").alias("component"))
    named = named.join(whole, "comp", "left").select("s1", "s2", F.coalesce("component", "least").alias("component"))
    out = rows.alias("r").join(named.alias("m"), ["s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_POINT = pa.schema([("node", pa.int64()), ("point", pa.binary())])


def _pairs(a: list | np.ndarray, b: list | np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_PAIR)


def _points(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = batch.column(0).to_pylist()
        for part, sets in _sets(batch.column(1).to_pylist(), shingle):
            yield pa.RecordBatch.from_pydict({"node": [nodes[i] for i in part], "point": [packed(s) for s in sets]}, schema=_POINT)


def _allowed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose finer points, in turn, leave room for the overlap that their sizes ask for."""
    for t, first in linkage.whole_runs(batches, 2):
        points, keep = t.column("point").to_pylist(), []
        for k in first.tolist():
            u, v = unpacked(points[k]), unpacked(points[k + 1])
            least = min(len(u), len(v))
            if np.minimum(folded(u, least), folded(v, least)).sum() >= overlap_needed(np.int64(u.sum() + v.sum()), percent):
                keep.append(k)
        yield _pairs(*(t.column(c).to_numpy()[keep] for c in ("a", "b")))


def _linked(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose whole sets, in turn, are similar enough."""
    for t, first in linkage.whole_runs(batches, 2, 1 << 10):
        found = np.zeros(len(first), bool)
        last: np.ndarray | None = None
        for part, sets in _sets(t.column("text").to_pylist(), shingle):
            for i, s in zip(part, sets, strict=True):
                if i % 2:
                    found[i // 2] = len(np.intersect1d(last, s, assume_unique=True)) >= overlap_needed(np.int64(len(last) + len(s)), percent)
                last = s
        yield _pairs(*(t.column(c).to_numpy()[first[found]] for c in ("a", "b")))


def _searched(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs across components of each block pair that the R-tree and then the finer bound allow."""
    for t in linkage.runs(batches, 3):
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        node, comp, blk = (t.column(c).to_numpy() for c in ("node", "comp", "blk"))
        finer = [unpacked(x) for x in t.column("point").to_pylist()]
        groups = min(len(v) for v in finer)
        fine = np.stack([folded(v, groups) for v in finer])
        size = fine.sum(1, dtype=np.int64)
        points = fine.reshape(len(fine), -1, DIMENSIONS).sum(1)
        one = np.flatnonzero(blk == i)
        two = np.flatnonzero(blk == j) if i != j else one
        q, p = CountRTree(points[one]).search(points[two], percent)
        x, y = two[q], one[p]
        keep = (comp[x] != comp[y]) & (x < y if i == j else True)
        x, y = x[keep], y[keep]
        fits = np.zeros(len(x), bool)
        step = max(1, (1 << 22) // groups)
        for start in range(0, len(x), step):
            s = slice(start, start + step)
            fits[s] = np.minimum(fine[x[s]], fine[y[s]]).sum(1) >= overlap_needed(size[x[s]] + size[y[s]], percent)
        yield _pairs(node[x[fits]], node[y[fits]])


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those whose component has a row with a smaller doc_id.

    Of repeated rows all stay together; rows without a doc_id, and empty ones, stay.
    """
    (name,) = fresh(docs, "gone")
    gone = settled(docs.sparkSession, lambda: components(docs, shingle, percent).filter("component_id < doc_id").select(F.col("doc_id").alias(name)).distinct(), "near-copies")
    gone = maybe_broadcast(gone, linkage.SIDE_ROWS)
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
