"""Best-fit packing with certified bin counts.

Documents become pieces of at most ``capacity`` tokens; a longer document is
cut so that only its first piece may be shorter. Each partition packs its
pieces by best-fit decreasing and compares its bins with a lower bound from
dual feasible functions: step functions that no bin can exceed, whose sums over
the pieces bound the bins from below. Where both agree the partition is
certified: its packing can't be improved, and it offers only its loosest bin.
A partition with a gap keeps its full bins and offers the pieces of the others.
What is offered is exchanged: dealt to fewer partitions and packed again, until
all is certified, one partition holds the rest, or a round saves no bin. Then
the bound is taken over all bins that are not full, and if it shows a gap their
pieces are exchanged once more. A round that does not save bins is not used.

The certificates come out with the pieces: the partition whose packing made a
piece's sequence, its bins, their bound, and whether both agree. ``certificate``
gives bins and bound over all.

The pieces are checkpointed before they are dealt, and each round after it, so
a lost executor never sees another deal. A task holds the numbers of at most
``ROWS`` pieces, not their texts.

Defined results: null text counts as empty; an empty document is its end id
alone. Repeated rows are packed each. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverine.llm.common import checkpoint, read, steps, without_gc
from quiverine.llm.pieces import Memo, parts

#: Pieces, about, that are packed together.
ROWS = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
CERTIFICATE = "partition long, partition_bins long, partition_bound long, certified boolean"
_ADDED = ("sequence_id", "offset", "fill", "settled", "bins", "partition", "partition_bins", "partition_bound", "certified")


class VocabularyIds:
    """Ids of whole texts by a byte-level vocabulary file of the tokenizers library, as little-endian 32-bit integers.

    The file's merges are numbered in the order of its ids, so tiktoken gives
    the same ids from the same file, in a quarter of the time; this is checked
    when the file is read, and where it does not hold the tokenizers library
    itself encodes. It also encodes every part of over ``LONGEST`` characters,
    a stretch without the cuts of ``pieces``, on which tiktoken can run out of
    stack. Strings of special tokens in a text are ordinary text.
    """

    LONGEST = 20_000

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        ranks = self._ranks(spec)
        if ranks is not None:
            import tiktoken

            pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            encode = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            of_part = lambda part: np.array(encode(part), "<u4").tobytes() if len(part) <= self.LONGEST else self.whole(part)
            self.first = Memo(of_part, most=50_000)
            self.rest = Memo(lambda part: of_part(" " + part))
        self.by_parts = ranks is not None
        self.source, self.library = source, None

    def whole(self, text: str) -> bytes:
        """The ids by the library, which is made when it is first asked for."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.source)
            self.library.encode_special_tokens = True
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _ranks(spec: dict) -> dict[bytes, int] | None:
        """The vocabulary as ranks, if ids are numbered by merges and the rest of the file is a plain byte-level BPE."""
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            return None
        # The library writes a byte as a printable character: itself where it has one, else the next from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable}
        byte_of |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(printable))}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocabulary = {token: rank for token, rank in model["vocab"].items() if token not in special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if any(len(t) == 1 and rank > 255 for t, rank in vocabulary.items()) or len(vocabulary) != 256 + len(merges):
            return None
        if any(vocabulary.get(a + b) != 256 + n for n, (a, b) in enumerate(merges)):
            return None
        return {bytes(map(byte_of.__getitem__, token)): rank for token, rank in vocabulary.items()}

    def __call__(self, text: str) -> bytes:
        if not self.by_parts:
            return self.whole(text)
        cut = parts(text)
        return self.first[cut[0]] + b"".join(map(self.rest.__getitem__, cut[1:]))


def cut(docs: DataFrame, source: str, capacity: int, end_id: int | None, keep_ids: bool = False) -> DataFrame:
    """The pieces of every row of ``docs``; with ``keep_ids`` also their ids, as binary."""
    spark = docs.sparkSession
    if len(source) > 64 << 20:
        raise ValueError("a vocabulary file of over 64 MB isn't broadcast")
    shared = spark.sparkContext.broadcast(source)
    kept: dict[str, VocabularyIds] = {}
    end = np.array([] if end_id is None else [end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with without_gc():
            if not kept:
                kept["ids"] = VocabularyIds(shared.value)
            for batch in steps(batches):
                yield pieces_of(batch)

    def pieces_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = kept["ids"](text or "") + end
            start, n = 0, len(ids) // 4
            stop = n - max(0, (n - 1) // capacity) * capacity
            piece = 0
            while start < n:
                own = ids[4 * start : 4 * stop]
                rows.append((doc_id, piece, start, stop - start, zlib.crc32(own), *[own] * keep_ids))
                start, stop, piece = stop, stop + capacity, piece + 1
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES + ", ids binary" * keep_ids)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of three families of dual feasible functions, in exact integers."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(counts: np.ndarray, capacity: int) -> int:
    """The same of the number of pieces by length."""
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(counts @ sizes) // capacity)
    present = np.flatnonzero(counts[: capacity // 2 + 1])
    for eps in present[present > 0]:
        # Pieces above capacity - eps fill a bin, those below eps are left out.
        value = np.where(sizes > capacity - eps, capacity, np.where(sizes >= eps, sizes, 0))
        best = max(best, -(-int(counts @ value) // capacity))
        # Pieces above half count what they leave to pieces of eps, the others one of those each.
        fit = capacity // int(eps)
        value = np.where(2 * sizes > capacity, fit - (capacity - sizes) // eps, np.where(sizes >= eps, 1, 0))
        best = max(best, -(-int(counts @ value) // fit))
    for k in range(1, 32):
        # Rounding down to k-ths, but for pieces that are just so many (k + 1)-ths.
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, k * sizes, (scaled // capacity) * capacity)
        best = max(best, -(-int(counts @ value) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each piece's bin and offset there, and each bin's fill.

    Bins are kept by the room they have left, and a bit set says which rooms
    occur, so a piece finds the tightest bin in one step.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    occurs, fills = 0, []
    for at, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = occurs >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            own = room[left].pop()
            if not room[left]:
                occurs ^= 1 << left
        else:
            left, own = capacity, len(fills)
            fills.append(0)
        bins[at], offsets[at] = own, fills[own]
        fills[own] += size
        left -= size
        if not room[left]:
            occurs |= 1 << left
        room[left].append(own)
    return bins, offsets, np.array(fills, np.int64)


def _round(pieces: DataFrame, capacity: int, number: int) -> DataFrame:
    """Pack each partition, in stretches of about ``ROWS`` rows; ``settled`` says which rows stay where they are.

    Bins are numbered by round, partition and place. ``bins`` is, on one row of
    each stretch, the bins that its unsettled rows take now.
    """
    names = [f.name for f in pieces.schema]

    def settle(table: pa.Table, base: int) -> tuple[pa.Table, int]:
        lengths = table.column("length").to_numpy()
        bins, offsets, fills = best_fit(lengths, capacity)
        settles = np.ones(len(fills), bool)
        bound = lower_bound(lengths, capacity)
        if len(fills) == bound:
            if fills.min() < capacity:
                settles[int(fills.argmin())] = False
        else:
            settles = fills == capacity
        loose = np.zeros(len(lengths), np.int64)
        loose[0] = int((~settles).sum())
        same = lambda value: np.full(len(lengths), value)
        added = (
            ("sequence_id", bins + base), ("offset", offsets), ("fill", fills[bins]), ("settled", settles[bins]), ("bins", loose),
            ("partition", same(base)), ("partition_bins", same(len(fills))), ("partition_bound", same(bound)), ("certified", same(len(fills) == bound)),
        )
        for name, values in added:
            table = table.append_column(name, pa.array(values))
        return table, base + len(fills)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (number << 56) + (TaskContext.get().partitionId() << 32)
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
            if held and (batch is None or sum(b.num_rows for b in held) >= ROWS):
                table, base = settle(pa.Table.from_batches(held), base)
                held = []
                yield from table.combine_chunks().to_batches()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema]
    return pieces.select(*names).mapInArrow(run, ", ".join([*fields, f"sequence_id long, offset long, fill long, settled boolean, bins long, {CERTIFICATE}"]))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (with a column ``length`` from 1 to ``capacity``) with sequence_id, offset and CERTIFICATE's columns.

    ``pieces`` must come out in the same partitions each time it is read, as a
    checkpoint does.
    """
    names = pieces.columns
    done: list[DataFrame] = []
    packed = checkpoint(_round(pieces, capacity, 0))
    for number in itertools.count(1):  # each round saves bins, or is the last
        left, bins = packed.agg(F.count(F.when(~F.col("settled"), 1)), F.sum("bins")).first()
        done.append(packed.filter("settled"))
        loose = packed.filter(~F.col("settled"))
        if not left:
            done.append(loose)
            break
        parts_left = max(1, -(-left // ROWS))
        again = checkpoint(_round(loose.select(*names).repartition(parts_left), capacity, number))
        now = again.agg(F.countDistinct("sequence_id")).first()[0]
        if now >= bins:
            done.append(loose)
            break
        packed = again
        if parts_left == 1:
            done.append(packed)
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return _exchange_rest(out, capacity, number + 1).select(*names, "sequence_id", "offset", *_ADDED[5:])


def certificate(packed: DataFrame, capacity: int) -> tuple[int, int]:
    """The bins of a packing, and the bound on those of any."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in packed.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    return packed.agg(F.countDistinct("sequence_id")).first()[0], bound_of_counts(counts, capacity)


def _exchange_rest(packed: DataFrame, capacity: int, number: int) -> DataFrame:
    """The packing, or one of fewer bins: what certified partitions waste between them is seen only over all.

    The lengths of all bins that aren't full, counted by length, bound those
    bins' number over all partitions. Where there is a gap, their pieces are
    exchanged once more, whichever partition they came from.
    """
    names = [c for c in packed.columns if c not in _ADDED]
    loose = packed.filter(F.col("fill") < capacity)
    counted = loose.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for row in counted:
        counts[row["length"]] = row["n"]
    bins = loose.agg(F.countDistinct("sequence_id")).first()[0]
    if bins <= bound_of_counts(counts, capacity):
        return packed
    tasks = max(1, -(-int(counts.sum()) // ROWS))
    again = checkpoint(_round(loose.select(*names).repartition(tasks), capacity, number))
    if again.agg(F.countDistinct("sequence_id")).first()[0] >= bins:
        return packed
    return packed.filter(F.col("fill") == capacity).unionByName(again)


def pack_documents(docs: DataFrame, source: str, capacity: int = 1024, end_id: int | None = 2, keep_ids: bool = False) -> DataFrame:
    """The pieces of every row of ``docs`` and their places in sequences of ``capacity`` tokens.

    ``source`` is the text of a vocabulary file. ``keep_ids`` adds the pieces'
    ids as little-endian 32-bit integers.
    """
    return pack(checkpoint(cut(docs, source, capacity, end_id, keep_ids)), capacity)


def vocabulary(name: str) -> str:
    """The text of one of the public vocabulary files."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract: byte_bpe_50k.json, end id 2, sequences of 1024 tokens."""
    return pack_documents(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
