"""Substring dedup: seed on winnowed anchors, extend, remove repeats.

A window is ``length`` consecutive words of a document. Every word is removed
that a window covers whose words also start anywhere else.

Seeds: every window names an anchor, the smallest hash among its ``SEED_WORDS``
long word sequences (the first of equals), so equal windows name equal anchors
at one place. Consecutive windows that share an anchor make a run, and one row
per run, about one in fourteen words, is written and joined rather than one per
window. Runs that are equal as a whole, as those of copies and of passages are,
are one kind: nothing but repeats, which are counted and never meet in pairs.

Extension: where an anchor has several kinds of runs, one occurrence of each is
extended from the anchor, word by word to the right and to the left, all kinds
at once: those that agree so far keep one class, so work grows with the kinds
and not with their pairs. Windows on whose words, left and right together, two
kinds agree are repeats; consecutive ones are joined to maximal repeats, which
are kept as they cover at least ``length`` words. Words are compared by 64 bits
of hash. An anchor of over ``CROWD`` kinds is not one task's: its windows are
counted by 128 bits of hash instead, with partial counts before the shuffle.

Defined results: null text has no words; documents of fewer than ``length``
words keep all. Repeated rows are documents of their own, so their long
passages repeat. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverine.llm.common import checkpoint, positional, read, steps

SEED_WORDS = 8
#: Kinds of one anchor that a task extends; and kinds, about, that it extends at once.
CROWD, MOST_KINDS = 32_768, 32_768
WORD = re.compile(r"[^\x20\x09-\x0D]+")  # what bytes.split() gives of the text's bytes
_KEY = "quiverine-words!"
_U = np.uint64
#: Odd multipliers of the two rolling sums, 5 modulo 8.
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED0D))


class Powers:
    """Powers of an odd base and of its inverse, modulo 2^64, as far as asked for."""

    def __init__(self, base: np.uint64) -> None:
        self.base = int(base)
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(self.base, size, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(self.inverse, size, 1 << 64))])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of rolling sums (the finaliser of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), hash_key=_KEY, categorize=False)


class Words:
    """Hashes of word sequences of one text, by prefix sums."""

    powers = tuple(Powers(b) for b in _BASES)

    def __init__(self, words: list[bytes]) -> None:
        self._sum(word_hashes(words))

    @classmethod
    def of(cls, hashes: np.ndarray) -> Words:
        """Of words whose hashes are at hand."""
        own = cls.__new__(cls)
        own._sum(hashes)
        return own

    def _sum(self, own: np.ndarray) -> None:
        self.n = len(own)
        self.sums = []
        for p in self.powers:
            p.reach(self.n + 1)
            self.sums.append(np.concatenate([np.zeros(1, _U), np.cumsum(own * p.up[: self.n], dtype=_U)]))

    def hashes(self, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
        """The k-th hash of the words from each start to before each end."""
        return mix((self.sums[k][ends] - self.sums[k][starts]) * self.powers[k].down[starts])


def runs(words: list[bytes], length: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """The runs of a text: its word hashes, the first and last window of each run, the words there before its anchor, the anchor's hash and the run's."""
    n = len(words) - length + 1
    if n < 1:
        return None
    hashed = Words(words)
    seeds = min(SEED_WORDS, length)
    sums = hashed.sums[0]
    seed = mix((sums[seeds:] - sums[:-seeds]) * hashed.powers[0].down[: len(words) - seeds + 1])
    span = length - seeds + 1
    at = np.empty(n, np.int64)
    for a in range(0, n, 1 << 16):  # long texts in pieces
        b = min(n, a + (1 << 16))
        at[a:b] = np.lib.stride_tricks.sliding_window_view(seed[a : b + span - 1], span).argmin(axis=1) + np.arange(a, b)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], n] - 1
    anchor = at[first]
    whole = hashed.hashes(first, last + length, 0)
    # Where the anchor stands in the run, and how long the run is, belong to what it is.
    whole = mix(whole ^ ((anchor - first) * 1_000_003 + (last - first)).astype(_U))
    whole ^= hashed.hashes(first, last + length, 1)
    return hashed, first, last, anchor - first, seed[anchor].view(np.int64), whole.view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    """Rows with a key of id and text: equal rows have one key and equal results."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")


def _columns(names: list[str], *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names)


def _packed(texts: DataFrame) -> DataFrame:
    """The same rows with each text's bytes compressed: two thirds of what shuffled text takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in steps(batches):
            packed = pa.array([squeeze(t) for t in batch.column(2).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["doc_id", "key", "packed"])

    return texts.mapInArrow(run, "doc_id long, key long, packed binary")


def _unpack(column: pa.Array) -> Iterator[bytes]:
    spread = zstandard.ZstdDecompressor().decompress
    for packed in column.to_pylist():
        yield spread(packed)


def _all_runs(texts: DataFrame, length: int) -> DataFrame:
    """(key, at, left, anchor, run) of every run; ``at`` is the first window times 64 plus the number of windows, ``left`` the words before its anchor."""
    names = ["key", "at", "left", "anchor", "run"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found = runs(text.split(), length)
                if found:
                    _, first, last, left, anchor, whole = found
                    out.append((np.full(len(first), key, np.int64), first * 64 + (last - first + 1), left.astype(np.int8), anchor, whole))
            if out:
                yield _columns(names, *(np.concatenate(x) for x in zip(*out, strict=True)))

    return texts.select("key", "text").mapInArrow(run, "key long, at long, left byte, anchor long, run long")


def _joined(rows: DataFrame, few: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined to ``few``, whose column ``count`` tells how many rows each meets.

    At most a thousand of ``few`` meet a thousandth of the rows each; those are
    broadcast, so that no task gets all rows of one.
    """
    hottest = max(total // 1000, 1)
    hot, rest = few.filter(F.col(count) > hottest), few.filter(F.col(count) <= hottest)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(rest, on))


def _kinds(occurring: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The kinds of runs, (anchor, run, n, key, at, left), with the number of their occurrences and one of them; and (anchor, kinds) of the anchors of several."""
    one = F.min(F.struct("key", "at", "left")).alias("one")
    counted = checkpoint(occurring.groupBy("anchor", "run").agg(F.count("*").alias("n"), one))
    anchors = counted.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    return counted.select("anchor", "run", "n", "one.key", "one.at", "one.left"), checkpoint(anchors)


def _contexts(packed: DataFrame, extending: DataFrame, length: int) -> DataFrame:
    """(anchor, run, n, crowded, key, at, left, words) of every kind to extend; ``words`` are the hashes of the words of its windows."""
    lists = extending.groupBy("key").agg(F.collect_list(F.struct("at", "left", "anchor", "run", "n", "crowded")).alias("runs"))
    joined = packed.select("key", "packed").join(lists, "key")
    names = ["anchor", "run", "n", "crowded", "key", "at", "left", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            out: list[tuple] = []
            done: set[int] = set()  # a row that is repeated has one key
            for key, text, own in zip(batch.column(0).to_pylist(), _unpack(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if key in done:
                    continue
                done.add(key)
                hashes = word_hashes(text.split())
                for r in own:
                    first, windows = r["at"] >> 6, r["at"] & 63
                    out.append((r["anchor"], r["run"], r["n"], r["crowded"], key, r["at"], r["left"], hashes[first : first + windows + length - 1].tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int8(), pa.binary())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    return joined.mapInArrow(run, "anchor long, run long, n long, crowded boolean, key long, at long, left byte, words binary")


def extend(anchors: np.ndarray, lefts: np.ndarray, contexts: list[np.ndarray], length: int) -> list[list[tuple[int, int]]]:
    """The maximal repeats of each kind of run: (first, last) of its windows, counted from the run's first, that another kind of its anchor has too.

    ``contexts`` are the words of each run's windows, ``lefts`` the words before
    the anchor there. All kinds are extended at once, a word at a time to the
    right and to the left of the anchor: those that still agree keep one class.
    A window that begins l words before the anchor repeats where another kind
    agrees on l words to the left and on the rest of the window to the right.
    Consecutive such windows are one repeat, which can't be made longer.
    """
    n, reach = len(anchors), length - SEED_WORDS if length > SEED_WORDS else 0
    seeds = min(SEED_WORDS, length)
    lefts = lefts.astype(np.int64)
    sizes = np.array([len(c) for c in contexts], np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate(contexts) if n else np.zeros(0, _U)
    repeats: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def classes(step: int) -> list[np.ndarray]:
        """The class of each kind after 0, 1, ... ``reach`` words to one side; -1 where the run doesn't reach so far."""
        now = mix(anchors.view(_U))
        out, alive = [now], np.ones(n, bool)
        for r in range(reach):
            place = lefts + seeds + r if step > 0 else lefts - 1 - r
            alive = alive & (place >= 0) & (place < sizes)
            word = flat[np.where(alive, starts + place, 0)] if len(flat) else np.zeros(n, _U)
            now = mix(now * _BASES[0] + word)
            out.append(np.where(alive, now, _U(0)))
        return out

    right, left = classes(1), classes(-1)
    agree = np.zeros((n, reach + 1), bool)
    for before in range(reach + 1):
        after = reach - before
        has = np.flatnonzero((lefts >= before) & (lefts + seeds + after <= sizes))
        if len(has) < 2:
            continue
        both = mix(left[before][has] * _BASES[1] + right[after][has])
        _, to, count = np.unique(both, return_inverse=True, return_counts=True)
        agree[has, before] = count[to] > 1
    for k in np.flatnonzero(agree.any(axis=1)).tolist():
        first = lefts[k] - np.flatnonzero(agree[k])[::-1]  # windows in the order of the text
        cuts = np.flatnonzero(np.diff(first) > 1) + 1
        repeats[k] = [(int(part[0]), int(part[-1])) for part in np.split(first, cuts)]
    return repeats


def _extended(contexts: DataFrame, length: int) -> DataFrame:
    """(anchor, run, at, n, spans) of the kinds that share windows with another of their anchor; ``spans`` as ``at`` are windows counted from the run's first."""
    names = ["anchor", "run", "key", "at", "n", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(pa.Table.from_batches([batch]))
                if sum(t.num_rows for t in held) < MOST_KINDS:
                    continue
            if not held:
                continue
            table = pa.concat_tables(held).combine_chunks()
            anchors = table.column("anchor").to_numpy()
            cut = len(anchors)
            if batch is not None:  # the last anchor may go on in the next batch
                other = np.flatnonzero(anchors != anchors[-1])
                cut = int(other[-1]) + 1 if len(other) else 0
            held = [table.slice(cut)] if cut < len(anchors) else []
            table = table.slice(0, cut)
            if not cut:
                continue
            words = [np.frombuffer(w, _U) for w in table.column("words").to_pylist()]
            found = extend(np.ascontiguousarray(anchors[:cut]), table.column("left").to_numpy(), words, length)
            which = np.array([k for k, f in enumerate(found) if f], np.int64)
            if len(which):
                spans = pa.array([[a * 64 + (b - a + 1) for a, b in found[k]] for k in which], pa.list_(pa.int32()))
                own = table.select(["anchor", "run", "key", "at", "n"]).take(pa.array(which)).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*own.columns, spans], names)

    dealt = contexts.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.select("anchor", "run", "key", "at", "n", "left", "words").mapInArrow(run, "anchor long, run long, key long, at long, n long, spans array<int>")


def _crowded(contexts: DataFrame, length: int) -> DataFrame:
    """The same of anchors of too many kinds for one task: each window of a kind is a row, and they are counted by 128 bits of their words' hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            out = []
            for anchor, own, key, at, n, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashed = Words.of(np.frombuffer(words, _U))
                starts = np.arange(at & 63)
                hi, lo = (hashed.hashes(starts, starts + length, k).view(np.int64) for k in (0, 1))
                out.append((*(np.full(len(starts), x, np.int64) for x in (anchor, own, key, at, n)), starts, hi, lo))
            yield _columns(["anchor", "run", "key", "at", "n", "place", "hi", "lo"], *(np.concatenate(x) for x in zip(*out, strict=True)))

    windows = checkpoint(contexts.select("anchor", "run", "key", "at", "n", "words").mapInArrow(run, "anchor long, run long, key long, at long, n long, place long, hi long, lo long"))
    again = checkpoint(windows.groupBy("hi", "lo").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    found = _joined(windows, again, ["hi", "lo"], "kinds", windows.count())
    return found.groupBy("anchor", "run", "key", "at", "n").agg(F.collect_list((F.col("place") * 64 + 1).cast("int")).alias("spans"))


def covered(texts: DataFrame, packed: DataFrame, length: int) -> DataFrame:
    """(key, spans): the stretches of repeated windows of a text, each its first window times 64 plus their number, in no order."""
    occurring = checkpoint(_all_runs(texts, length))
    kinds, anchors = _kinds(occurring)
    # Occurrences of one kind repeat as a whole. Where an anchor has several kinds, one occurrence stands for each and is extended.
    differing = _joined(kinds, anchors, ["anchor"], "kinds", kinds.count()).withColumn("crowded", F.col("kinds") > CROWD)
    contexts = checkpoint(_contexts(packed, differing, length))
    shared = _extended(contexts.filter("not crowded"), length)
    if not contexts.filter("crowded").isEmpty():
        shared = shared.unionByName(_crowded(contexts.filter("crowded"), length))
    # What is found of a kind that occurs once is its occurrence's; where a kind repeats all its windows do.
    single = shared.filter("n = 1").select("key", F.explode(F.transform("spans", lambda s: (F.col("at").bitwiseAND(F.lit(~63)) + s).cast("long"))).alias("at"))
    again = checkpoint(kinds.filter("n > 1").select("anchor", "run", "n"))
    whole = _joined(occurring.select("anchor", "run", "key", "at"), again, ["anchor", "run"], "n", occurring.count()).select("key", "at")
    return whole.unionByName(single).groupBy("key").agg(F.collect_set("at").alias("spans"))


def kept_mask(n: int, spans: list[int] | None, length: int) -> np.ndarray | None:
    """Which of n words no repeated window covers; None for all."""
    if not spans:
        return None
    at = np.array(spans, np.int64)
    first, last = at >> 6, (at >> 6) + (at & 63) - 1 + length
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last, -1)
    return np.cumsum(edge[:n]) == 0


def substring_digest(docs: DataFrame, length: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs``."""
    if length < 2 or length - SEED_WORDS > 62:
        raise ValueError("length must be from 2 to 70 words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            out = []
            for text, spans in zip(_unpack(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                mask = kept_mask(len(words), spans, length)
                kept = words if mask is None else [words[k] for k in np.flatnonzero(mask)]
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, removed, digest = ([r[k] for r in out] for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    texts = _texts(docs)
    packed = _packed(texts)
    joined = packed.join(covered(texts, packed, length), "key", "left").select("doc_id", "packed", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def substring_dedup(docs: DataFrame, length: int = 35) -> DataFrame:
    """``docs``, all columns kept, with the repeated stretches cut out of ``text``.

    Text that loses nothing is unchanged; else the white space before each word
    that stays stays with it. ``n_chars``, where the table has it, follows.
    """
    if length < 2 or length - SEED_WORDS > 62:
        raise ValueError("length must be from 2 to 70 words")
    texts = _texts(docs)
    spans = covered(texts, _packed(texts), length)
    rows, names, at_id, at_text = positional(docs)
    text, doc_id = F.col(names[at_text]), F.col(names[at_id])
    keyed = rows.withColumn("key", F.xxhash64(doc_id.cast("long"), F.coalesce(text.cast("string"), F.lit(""))))
    joined = keyed.join(spans, "key", "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(text, spans, strict=True):
            if t is not None and own is not None and len(own):
                at = [m.span() for m in WORD.finditer(t)]
                mask = kept_mask(len(at), list(own), length)
                kept = [t[(at[k - 1][1] if k else 0) : at[k][1]] for k in np.flatnonzero(mask)]
                t = "".join(kept).lstrip("\x20\t\n\x0b\x0c\r") + (t[at[-1][1] :] if mask[-1] else "")
            out.append(t)
        return pd.Series(out, dtype=object)

    untouched = F.col("spans").isNull()
    changed = joined.withColumn("cut", F.when(untouched, text.cast("string")).otherwise(cut(text.cast("string"), F.col("spans"))))
    out = list(map(F.col, names))
    out[at_text] = F.when(untouched, text).otherwise(F.col("cut").cast(rows.schema[names[at_text]].dataType))
    if "n_chars" in docs.columns:
        at = docs.columns.index("n_chars")
        out[at] = F.when(untouched, F.col(names[at])).otherwise(F.length("cut").cast(rows.schema[names[at]].dataType))
    return changed.select(*out).toDF(*docs.columns)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract: windows of 35 words over every document."""
    return substring_digest(read(spark, sf_dir, "documents"), length=35)


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), words AS (
  SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS pos, len(words) AS n FROM docs
), windows AS (
  SELECT r, pos, word, CASE WHEN pos + 34 <= n THEN sha256(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS h FROM words
), counted AS (
  SELECT *, CASE WHEN h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 THEN 1 ELSE 0 END AS again FROM windows
), marked AS (
  SELECT r, pos, word, max(again) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS removed FROM counted
), kept AS (
  SELECT r, sum(removed) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE removed = 0) AS text FROM marked GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""
