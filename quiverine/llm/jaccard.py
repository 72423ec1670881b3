"""Pairs of texts by the exact similarity of their shingle sets.

The Jaccard similarity of two texts is the share of their different shingles
that both have. Candidates come from min-hash bands: ``BANDS`` keys of ``ROWS``
least hashes each, of which a pair of similarity s shares at least one with
probability 1 - (1 - s^ROWS)^BANDS, 0.9996 at 0.8. Every candidate is then
verified on the whole sets.

First (``candidates``) up to ``SMALL`` members of a key all meet; of more, each
meets the ``NEAR`` that follow in the order of the next key, which brings the
most similar together, and two of those that are linked already stand for their
component. Of these pairs only those are made whose sketches (a byte of each
least hash) agree in at least ``ALIKE`` of 100 places, which fails a pair of 0.8
with a probability of 0.00001. Then all members of the keys that still hold
several components meet, every pair of them, within the tasks: ``promising``
gives the members that have such a partner in another component, one row a
member and not one a pair, and ``linking`` compares their whole sets and gives a
spanning forest of the links, which has fewer rows than members. A key of over
``BUCKET`` members is dealt to several tasks as pairs of chunks, which cover
every pair of its members; a task holds the sets of one such pair of chunks.
``left_over`` lists the pairs that ``promising`` sees, in rounds.

Defined results: texts without words are in no pair.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BANDS, ROWS = 20, 5
SMALL, NEAR, BUCKET = 32, 8, 1024
ALIKE, FIRST, GROWTH = 62, 64, 32
_MIX = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_MIX[1] = _MIX[1] * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> tuple[int, list[int], bytes]:
    """A hash of the whole set of ``hashes`` (different, ascending), its keys by band, and its sketch."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 11):  # long texts in pieces
        mixed = (hashes[at : at + (1 << 11), None] ^ _MIX[0]) * _MIX[1]
        np.minimum(least, mixed.min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]
    return _signed(xxhash.xxh64_intdigest(hashes.tobytes())), list(map(_signed, keys)), _folded(least).tobytes()


def _folded(least: np.ndarray) -> np.ndarray:
    """One byte of each least hash, spread evenly again: minima are small numbers."""
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of different hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 0.0


def _sketches(column: pa.Array) -> np.ndarray:
    """A row of bytes for each sketch."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows that are sorted by their first two columns, whole runs of equal ones at a time, and the runs' edges."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
        if not held:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key, chunk = (table.column(k).to_numpy() for k in (0, 1))
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])) + 1).tolist()]
        if batch is None:
            edges.append(len(key))
        # The last run may go on in the next batch.
        held = table.slice(edges[-1]).to_batches()
        if edges[-1]:
            yield table.slice(0, edges[-1]), edges


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, ru, rv) from rows (key, chunk, node, root, sketch) that are sorted by the first two."""
    for done, edges in _runs(batches):
        sizes = np.diff(edges)
        run = np.repeat(np.arange(len(sizes)), sizes)
        small = sizes[run] <= SMALL
        node, root, sketches = done.column("node").to_numpy(), done.column("root").to_numpy(), _sketches(done.column("sketch"))
        for lag in range(1, min(SMALL, int(sizes.max()))):
            at = np.flatnonzero((run[lag:] == run[:-lag]) & (root[lag:] != root[:-lag]) & (small[:-lag] | (lag <= NEAR)))
            at = at[_agree(sketches, at, at + lag)]
            if len(at):
                swap = node[at] > node[at + lag]
                u, v = np.where(swap, at + lag, at), np.where(swap, at, at + lag)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[u], node[v], root[u], root[v])], ["u", "v", "ru", "rv"])


def _agree(sketches: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of places have sketches that agree enough."""
    parts = [np.count_nonzero(sketches[left[a : a + 4096]] == sketches[right[a : a + 4096]], axis=1) >= ALIKE for a in range(0, len(left), 4096)]
    return np.concatenate([np.zeros(0, bool), *parts])


def shared(nodes: DataFrame) -> DataFrame:
    """(key, n): the keys of ``nodes`` (root, bands) that hold several roots, and their members."""
    return _mixed(nodes.select("root", F.explode("bands").alias("key"))).select("key", "n")


def _mixed(member: DataFrame) -> DataFrame:
    """(key, n, a, b): keys of ``member`` (key, root) with several roots, and the least and the greatest."""
    return member.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b")


def members(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, n, next, fp, node): the members of ``keys`` (key, n) among ``nodes`` (fp, node, bands); ``next`` is a member's key of the band that follows."""
    following = F.expr("concat(slice(bands, 2, size(bands)), slice(bands, 1, 1))")
    member = nodes.select("fp", "node", F.explode(F.arrays_zip(F.col("bands").alias("key"), following.alias("next"))).alias("b"))
    return member.select("b.key", "b.next", "fp", "node").join(keys, "key").select("key", "n", "next", "fp", "node")


def candidates(member: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v, ru, rv): nodes that share a key in ``member`` (see ``members``, with sketch), whose sketches agree enough and whose roots in ``classes`` (fp, root) differ; node by node, the lesser first."""
    member = member.join(classes, "fp").select("root", "key", F.struct(F.xxhash64("key", "node").alias("order"), "next", "node", "sketch").alias("m"))
    # Of what is linked already two stand for the rest, others under each key.
    member = member.groupBy("key", "root").agg(F.array_distinct(F.array(F.min("m"), F.max("m"))).alias("m"))
    member = member.select("key", "root", F.explode("m").alias("m")).select("key", "root", "m.next", "m.node", "m.sketch")
    large = member.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET)
    chunks = F.ceil(F.col("n") / (BUCKET // 2)).cast("long")
    dealt = member.join(large, "key", "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("node", "key"), chunks), F.lit(0).cast("long")))
    dealt = dealt.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "next", "node")
    return dealt.select("key", "chunk", "node", "root", "sketch").mapInArrow(_meet, "u long, v long, ru long, rv long").distinct()


def crowded(member: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, n, fp, node, sketch): what is in ``member`` under keys of over two that still hold several roots."""
    member = member.filter("n > 2").select("key", "n", "fp", "node", "sketch")
    keys = _mixed(member.join(classes, "fp").select("key", "root")).select("key")
    return member.join(keys, "key", "left_semi").select("key", "n", "fp", "node", "sketch")


def _dealt(member: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, chunk, node, root, n, sketch): ``member`` (see ``crowded``) as pairs of chunks, with its roots in ``classes`` (fp, root)."""
    chunks = F.when(F.col("n") > BUCKET, F.ceil(F.col("n") / (BUCKET // 2)).cast("long")).otherwise(F.lit(1).cast("long"))
    own = F.pmod(F.xxhash64("node", "key"), chunks)
    chunk = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda c: F.least(c, own) * chunks + F.greatest(c, own))).alias("chunk")
    dealt = member.join(classes, "fp").select("key", chunk, "node", "root", "n", "sketch")
    return dealt.repartition("key", "chunk").sortWithinPartitions("key", "chunk")


def promising(member: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, chunk, node, root, sketch): those of ``member`` (see ``crowded``) that have a partner in their pair of chunks: of another root in ``classes`` (fp, root), and a sketch that agrees enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done, edges in _runs(batches):
            root, sketches = done.column("root").to_numpy(), _sketches(done.column("sketch"))
            has = np.zeros(len(root), bool)
            for a, b in itertools.pairwise(edges):
                if (root[a:b] == root[a]).all():
                    continue
                for i in range(a, b - 1):
                    at = np.flatnonzero(root[i + 1 : b] != root[i]) + i + 1
                    at = at[np.count_nonzero(sketches[at] == sketches[i], axis=1) >= ALIKE]
                    has[at] = True
                    has[i] |= len(at) > 0
            yield from done.filter(pa.array(has)).to_batches()

    return _dealt(member, classes).select("key", "chunk", "node", "root", "sketch").mapInArrow(run, "key long, chunk long, node long, root long, sketch binary")


def spanning(root: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs of roots that connect what the pairs of members connect whose sketches agree enough and whose sets are similar by ``least`` or more; fewer than roots.

    Every such pair is compared unless its members are connected by then.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(vocabulary), bool)
    now, links = root.copy(), []
    for i in range(len(sets) - 1):
        at = np.flatnonzero(now[i + 1 :] != now[i]) + i + 1
        at = at[np.count_nonzero(sketches[at] == sketches[i], axis=1) >= ALIKE]
        if not len(at):
            continue
        own = flat[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        common = np.array([np.count_nonzero(mark[flat[starts[j] : starts[j] + sizes[j]]]) for j in at.tolist()], np.int64)
        mark[own] = False
        for j in at[common / (sizes[i] + sizes[at] - common) >= least].tolist():
            if now[j] != now[i]:
                links.append((int(root[i]), int(root[j])))
                now[now == now[j]] = now[i]
    return links


def linking(some: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(u, v): roots that the sets in ``sets`` (node, hashes) of ``some`` (see ``promising``) link, as ``spanning`` tells for each pair of chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done, edges in _runs(batches):
            root, sketches, column = done.column("root").to_numpy(), _sketches(done.column("sketch")), done.column("hashes").combine_chunks()
            flat, ends = column.flatten().to_numpy(), np.r_[0, np.cumsum(column.value_lengths().to_numpy())]
            found: list[tuple[int, int]] = []
            for a, b in itertools.pairwise(edges):
                found += spanning(root[a:b], sketches[a:b], [flat[ends[k] : ends[k + 1]] for k in range(a, b)], least)
            if found:
                u, v = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    dealt = some.join(sets, "node").select("key", "chunk", "node", "root", "sketch", "hashes")
    dealt = dealt.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "node")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def _compare(done: np.ndarray, sketches: np.ndarray, over: float, upto: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs among the members (node, root, n) of one key that are candidates in the round from ``over`` up to ``upto`` partners."""
    node, root, n = done
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if (root == root[0]).all():
        return left[0], right[0]
    mixed = (node.view(np.uint64) ^ _MIX[0, 0]) * _MIX[1, 0]
    for i in range(len(node) - 1):
        # Of a pair, the same in either order; times n it is below x for about x partners a member.
        share = (((mixed[i + 1 :] + mixed[i]) * _MIX[1, 1]) >> np.uint64(11)).astype(np.float64) * (n[0] / (1 << 53))
        at = np.flatnonzero((root[i + 1 :] != root[i]) & (share >= over) & (share < upto)) + i + 1
        at = at[np.count_nonzero(sketches[at] == sketches[i], axis=1) >= ALIKE]
        left.append(np.full(len(at), i))
        right.append(at)
    return np.concatenate(left), np.concatenate(right)


def left_over(member: DataFrame, classes: DataFrame, over: float, upto: float) -> DataFrame:
    """(u, v, ru, rv): the pairs of one round among ``member`` (see ``crowded``), whose roots are those of ``classes`` (fp, root).

    A round brings about ``upto`` less ``over`` partners a member and key, chosen
    by a hash of the pair; the first takes ``FIRST``, each later one up to
    ``GROWTH`` times as many, and the last all that is left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done, edges in _runs(batches):
            held, sketches = np.stack([done.column(c).to_numpy() for c in ("node", "root", "n")]), _sketches(done.column("sketch"))
            for a, b in itertools.pairwise(edges):
                i, j = _compare(held[:, a:b], sketches[a:b], over, upto) if b - a > 1 else ([], [])
                if len(i):
                    (u, v), (ru, rv) = held[0, a:b][np.stack([i, j])], held[1, a:b][np.stack([i, j])]
                    swap = u > v
                    out = np.where(swap, v, u), np.where(swap, u, v), np.where(swap, rv, ru), np.where(swap, ru, rv)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["u", "v", "ru", "rv"])

    return _dealt(member, classes).mapInArrow(run, "u long, v long, ru long, rv long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The rows (ru, rv) of ``pairs`` whose sets in ``sets`` (node, hashes) are similar by ``least`` or more.

    In SQL functions: batches of sets on their way to Python would take much memory.
    """
    left = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
    common = F.size(F.array_intersect("a", "b")).alias("common")
    both = pairs.join(left, "u").join(right, "v").select("ru", "rv", common, (F.size("a") + F.size("b")).alias("sizes"))
    both = both.filter(F.col("common") / (F.col("sizes") - F.col("common")) >= F.lit(least))
    return both.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
