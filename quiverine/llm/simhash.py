"""SimHash near-dedup by pigeonhole blocks.

A document's fingerprint has a bit set where over half of its shingle hashes
have it. Fingerprints link at ``distance`` or fewer differing bits. Documents
with one fingerprint form a class first, so copies never meet pairwise. The 64
bits are split into ``distance + 2`` blocks: a linking pair differs in at most
``distance`` of them, so it agrees on at least two, and it meets in the bucket
of that pair of blocks. In a bucket the Hamming distances are verified and a
spanning forest of the links is kept, which has fewer edges than members; a
bucket over ``BUCKET`` members is dealt to several tasks as pairs of chunks,
which cover every pair of its members. Components follow from alternating
large and small stars over the distinct fingerprints, checkpointed per round.

Defined results: null text counts as empty; no words give the fingerprint zero,
which links like any other. Repeated rows are kept and share a component. The
component's id is its smallest non-null doc_id. An empty table gives an empty
result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverine.llm import jaccard
from quiverine.llm.common import arrow_map, checkpoint, positional, read, sieved

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42
#: Members of a bucket that one task compares; a larger one is dealt in chunks of half as many.
BUCKET = 4096


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64-bit fingerprint of a whole text, as a signed integer."""
    hashes = shingle_hashes(text, shingle)
    return _majority(hashes) if len(hashes) else 0


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hash of every shingle of a whole text, with repeats; one of all words if there are too few."""
    words = (text or "").encode().translate(LOWER).split()  # at the bytes 20 and 09 to 0D
    if not words:
        return np.zeros(0, "<u8")
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])]
    return np.array(hashes, dtype="<u8")


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # long texts in pieces: 64 bytes of bits for a hash
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(rows: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp, key, check) of every row of ``rows``, as ``_keyed`` makes them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = pa.array([fingerprint(t, shingle) for t in batch.column(3).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), out, batch.column(1), batch.column(2)], ["doc_id", "fp", "key", "check"])

    return arrow_map(rows.select("doc_id", "key", "check", "text"), run, "doc_id long, fp long, key long, check int")


def signatures(rows: DataFrame, shingle: int) -> DataFrame:
    """``fingerprints`` with (node, bands, sketch): a hash of the set of shingles, its min-hash keys and sketch, null without words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [shingle_hashes(t, shingle) for t in batch.column(3).to_pylist()]
        fps = pa.array([_majority(h) if len(h) else 0 for h in hashes], pa.int64())
        found = [jaccard.bands(np.unique(h)) if len(h) else (None, None, None) for h in hashes]
        own = [pa.array(column, kind) for column, kind in zip(zip(*found), (pa.int64(), pa.list_(pa.int64()), pa.binary()))]
        return pa.RecordBatch.from_arrays([batch.column(0), fps, batch.column(1), batch.column(2), *own], ["doc_id", "fp", "key", "check", "node", "bands", "sketch"])

    return arrow_map(rows.select("doc_id", "key", "check", "text"), run, "doc_id long, fp long, key long, check int, node long, bands array<long>, sketch binary")


def similar_classes(rows: DataFrame, fps: DataFrame, classes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``classes`` (fp, root) of ``fps`` (see ``signatures``), joined where texts of two have ``similarity`` or more."""
    worded = fps.filter("node is not null")
    nodes = checkpoint(worded.groupBy("fp", "node").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    # Tables between the steps are written, so that their sizes are known to the joins that follow.
    keys = checkpoint(jaccard.shared(nodes.join(classes, "fp")))
    member = checkpoint(jaccard.members(nodes, keys).join(nodes.select("fp", "node", "sketch"), ["fp", "node"]))
    pairs = checkpoint(jaccard.candidates(member, classes))
    if not pairs.isEmpty():
        sets = _sets(rows, worded, pairs.select(F.explode(F.array("u", "v")).alias("node")), shingle)
        classes = _joined(classes, jaccard.verified(pairs, sets, similarity))
    # What the candidates leave out: members of keys that still hold several components.
    some = checkpoint(jaccard.promising(checkpoint(jaccard.crowded(member, classes)), classes))
    if some.isEmpty():
        return classes
    return _joined(classes, jaccard.linking(some, _sets(rows, worded, some.select("node"), shingle), similarity))


def _sets(rows: DataFrame, worded: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes): the sets of shingles of ``nodes`` (node)."""
    # One row for each set gives its shingles.
    row = worded.groupBy("node").agg(F.min(F.struct("key", "check")).alias("row"))
    row = checkpoint(row.join(nodes.distinct(), "node").select("node", F.col("row.key").alias("key"), F.col("row.check").alias("check")))
    texts = sieved(rows.select("key", "check", "text"), row, ["key", "check"])
    texts = texts.join(row, ["key", "check"]).dropDuplicates(["key", "check"]).select("node", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = pa.array([np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), sets], ["node", "hashes"])

    return checkpoint(arrow_map(texts, run, "node long, hashes array<long>"))


def _joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` (fp, root) joined where ``links`` (u, v) tell of two roots."""
    joined = components(links)
    joined = joined.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return checkpoint(classes.join(joined, "root", "left").select("fp", F.coalesce("to", "root").alias("root")))


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns by position, and (doc_id, text, key, check); the last two are hashes of all columns, equal for equal rows only."""
    rows, names, at_id, at_text = positional(docs)
    # Maps have no hash of their own.
    plain = [F.to_json(c) if "map<" in f.dataType.simpleString() else F.col(c) for c, f in zip(names, rows.schema.fields, strict=True)]
    present = [F.col(c).isNotNull() for c in names]
    key, check = F.xxhash64(*plain, *present), F.hash(*reversed(plain), *present)
    return rows.select(*names, F.col(names[at_id]).cast("long").alias("doc_id"), F.col(names[at_text]).cast("string").alias("text"), key.alias("key"), check.alias("check")), names


def _blocks(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of ``distance + 2`` blocks that share the 64 bits out."""
    edges = [64 * k // (distance + 2) for k in range(distance + 3)]
    return [(a, b - a) for a, b in itertools.pairwise(edges)]


def forest(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges within runs of equal keys that connect what lies within ``distance``.

    Runs up to 32 members give all their links, longer ones a spanning forest.
    """
    left, right = [], []
    bits = fps.view(np.uint64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    small = np.repeat(sizes <= 32, sizes)
    for lag in range(1, min(32, int(sizes.max(initial=1)))):
        at = np.flatnonzero(small[:-lag] & (keys[lag:] == keys[:-lag]))
        near = at[np.bitwise_count(bits[at] ^ bits[at + lag]) <= distance]
        left.append(fps[near])
        right.append(fps[near + lag])
    for start, size in zip(starts[sizes > 32], sizes[sizes > 32]):
        rest = bits[start : start + size]
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                seed = queue.pop()
                near = np.bitwise_count(rest ^ seed) <= distance
                if near.any():
                    found = rest[near]
                    rest = rest[~near]
                    queue.extend(found)
                    left.append(np.full(len(found), seed).view(np.int64))
                    right.append(found.view(np.int64))
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def links(distinct: DataFrame, distance: int) -> DataFrame:
    """(u, v) between distinct fingerprints ``fp``: links that connect all that lies within ``distance``."""
    blocks = _blocks(distance)
    fp = F.col("fp")

    def block(k: int):
        shift, width = blocks[k]
        return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))

    pairs = list(itertools.combinations(range(len(blocks)), 2))
    keys = [(block(a) * (1 << blocks[b][1]) + block(b)) * len(pairs) + n for n, (a, b) in enumerate(pairs)]
    member = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    # A key is dealt to the tasks once; only keys with more members than one task compares are counted out.
    large = checkpoint(member.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET))
    # At most a thousand keys hold a thousandth of the members each; theirs are told apart without moving them.
    hottest = distinct.count() * len(pairs) // 1000
    hot = large.filter(F.col("n") > hottest).select("key", F.col("n").alias("hot"))
    member = member.join(F.broadcast(hot), "key", "left").withColumn("at", F.when(F.col("hot").isNull(), F.col("key")).otherwise(F.xxhash64(fp)))
    rest = large.filter(F.col("n") <= hottest).select(F.col("key").alias("at"), "n")
    member = member.join(rest, "at", "left").select("key", "fp", F.coalesce("hot", "n").alias("n"))
    chunks = F.ceil(F.col("n") / (BUCKET // 2)).cast("int")
    own = F.pmod(F.xxhash64(fp), chunks).cast("int")
    dealt = member.select(
        "key", "fp",
        F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
            F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: (F.least(c, own) * chunks + F.greatest(c, own)).cast("long"))
        )).alias("chunk"),
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), dtype=np.int64)
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
                if not held.shape[1]:
                    continue
                # The last run may go on in the next batch.
                last = np.flatnonzero((held[0] != held[0, -1]) | (held[1] != held[1, -1]))
                cut = int(last[-1]) + 1 if len(last) else 0
            else:
                cut = held.shape[1]
            done, held = held[:, :cut], held[:, cut:]
            if cut:
                change = np.r_[False, (done[0, 1:] != done[0, :-1]) | (done[1, 1:] != done[1, :-1])]
                a, b = forest(np.cumsum(change), np.ascontiguousarray(done[2]), distance)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])

    dealt = dealt.repartition("key", "chunk").sortWithinPartitions("key", "chunk")
    return dealt.select("key", "chunk", "fp").mapInArrow(compare, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v); root is the smallest reachable node.

    Alternates large stars (every larger neighbour is linked to the smallest
    one) and small stars (every smaller neighbour likewise) until nothing
    changes. Each round aggregates minima before it joins, so a hub's
    neighbours are never collected in one place.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        u, v = F.col("u"), F.col("v")
        if large:
            both = edges.select(u, v).unionByName(edges.select(v.alias("u"), u.alias("v")))
        else:
            both = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:
            out = joined.filter(v > u).select(v.alias("u"), F.col("m").alias("v"))
        else:
            out = joined.filter(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.filter(u != v).distinct()

    def state(edges: DataFrame) -> tuple:
        """What tells one set of edges from another, exact in any order of its rows."""
        own = F.xxhash64("u", "v")
        return tuple(edges.agg(F.count("*"), F.bit_xor(own), F.sum(own.cast("decimal(20,0)"))).first())

    edges = checkpoint(edges)
    last = None
    while True:
        edges = checkpoint(star(star(edges, True), False))
        if (now := state(edges)) == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def linked_classes(fps: DataFrame, distance: int) -> DataFrame:
    """(fp, root) of every distinct fingerprint; equal roots are one component.

    ``distance`` is at most 61; a larger one gives smaller blocks and so larger
    buckets.
    """
    if not 0 <= distance <= 61:
        raise ValueError("distance must be from 0 to 61")
    classes = checkpoint(fps.select("fp").distinct())
    roots = components(links(classes, distance)).withColumnRenamed("node", "fp")
    return checkpoint(classes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))


def simhash_components(docs: DataFrame, shingle: int = 5, distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    fps = checkpoint(fingerprints(_keyed(docs.select("doc_id", "text"))[0], shingle).select("doc_id", "fp"))
    classes = linked_classes(fps, distance)
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first")).join(classes, "fp")
    least = first.groupBy("root").agg(F.min("first").alias("component_id"))
    named = first.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, shingle: int = 5, distance: int = 3, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs``, all columns kept, that are first of their component.

    The first is the row with the smallest doc_id, and of different rows under
    that id the one with the smaller hash of all its columns; a row without an
    id is first only if all are. Of rows equal in every column one stays. With ``similarity``, texts whose sets of
    shingles have that Jaccard similarity or more link too, whatever their
    fingerprints' distance.
    """
    rows, names = _keyed(docs)
    fps = checkpoint((fingerprints if similarity is None else signatures)(rows, shingle))
    classes = linked_classes(fps, distance)
    if similarity is not None:
        classes = similar_classes(rows, fps, classes, shingle, similarity)
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key", "check")
    first = fps.groupBy("fp").agg(F.min(row).alias("row")).join(classes, "fp")
    keep = first.groupBy("root").agg(F.min("row").alias("row")).select("row.key", "row.check")
    kept = rows.join(keep, ["key", "check"], "left_semi").dropDuplicates(["key", "check"])
    return kept.select(*names).toDF(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract: three-word shingles, three differing bits, every document."""
    found = simhash_components(read(spark, sf_dir, "documents"), shingle=3, distance=3)
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
