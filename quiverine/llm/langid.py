"""Language identification by string kernels.

Two texts are compared by the blended spectrum presence kernel: the number of
byte n-grams, of one to three bytes, that occur in both, divided by the root of
the product of their own numbers. A bounded number of landmark texts per
language gives the Nystroem map of that kernel, and kernel ridge regression over
all labelled rows that may be learned from fits one row of weights for each
language against the rest: tasks sum the products of their rows' kernels, and
only those sums are moved. Scoring is a product of a batch's presence matrix
with the landmarks' and one with the weights.

Texts are compared in lower case, over their letters and single spaces. The
n-grams counted are those that occur in some landmark.

Only the landmarks, the basis of the map, are drawn: ``landmarks`` for each of
the ``MAX_LANGUAGES`` languages that most rows have, out of about
``per_language`` rows of it chosen by a hash of the text, copies once. Only their
n-gram numbers reach the driver, not their texts. Counts, regression and the
calibrated score are over all rows; a row counts as often as it occurs, and each
language weighs the same.

Defined results: null text and text without a letter is ``und`` with score 0.
Ties go to the language first in alphabetical order. If there is nothing to
learn from, all is ``und``. Repeated rows give repeated results. A null id is
not learned from.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverine.llm.common import blas_threads, checkpoint, id_bucket, positional, read, steps

UNDETERMINED = "und"
MAX_LANGUAGES = 200
#: Rows that landmarks are drawn from in all; more languages get fewer rows each.
MAX_ROWS = 8_000
#: Landmarks whose products with all others a task sums in one pass over the rows.
BLOCK = 1024
#: n-grams of a byte are numbered by it, longer ones by their bytes above these offsets.
_TWO, _THREE = 1 << 8, (1 << 8) + (1 << 16)
_GRAMS = _THREE + (1 << 24)
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """The text's letters in lower case, each stretch of anything else as one space; empty if there are no letters."""
    line = _OTHER.sub(" ", (text or "").lower()).strip()
    return f" {line} ".encode() if any(map(str.isalpha, line)) else b""


def grams(line: bytes) -> np.ndarray:
    """The numbers of a line's n-grams, with repeats."""
    one = np.frombuffer(line, np.uint8).astype(np.int32)
    two = (one[:-1] << 8) | one[1:]
    three = (two[:-1] << 8) | one[2:]
    return np.concatenate([one, two + _TWO, three + _THREE])


@dataclass(frozen=True)
class Model:
    """What scoring needs: the n-grams that count, and which landmarks hold them, and weights by landmark."""

    languages: tuple[str, ...]
    features: np.ndarray  # n-gram numbers, ascending
    landmarks: np.ndarray  # features x landmarks, float32, scaled by each landmark's norm
    weights: np.ndarray  # landmarks x languages, float32
    share: np.ndarray  # what a language's weights give a text of equal likeness to all

    def index(self) -> np.ndarray:
        """n-gram number to feature; the number of features for the rest."""
        to = np.full(_GRAMS, len(self.features), np.uint16 if len(self.features) < 1 << 16 else np.int32)
        to[self.features] = np.arange(len(self.features))
        return to


def presence(lines: list[bytes], index: np.ndarray, n: int) -> np.ndarray:
    """Which of the n features occur in each line."""
    found = np.zeros((len(lines), n + 1), np.float32)
    for row, line in zip(found, lines, strict=True):
        for a in range(0, len(line), 1 << 20):  # very long texts in pieces that overlap by two bytes
            row[index[grams(line[a : a + (1 << 20) + 2])]] = 1
    return found[:, :n]


def kernel(found: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """The normed kernel of each row of ``found`` with each landmark."""
    own = np.sqrt(np.maximum(found.sum(axis=1, keepdims=True), 1))
    return (found @ landmarks) / own


def counted(labelled: DataFrame) -> dict[str, tuple[int, int]]:
    """The languages that most of the rows (lang, text) have, at most ``MAX_LANGUAGES``: their rows, and the least hash of their texts."""
    most = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min(_drawn()).alias("least"))
    return {r["lang"]: (r["n"], r["least"]) for r in most.orderBy(F.col("n").desc(), "lang").limit(MAX_LANGUAGES).collect()}


def _drawn() -> Column:
    """A number under 2^40 for each text."""
    return F.pmod(F.xxhash64("text"), F.lit(1 << 40))


def sample(labelled: DataFrame, counts: dict[str, tuple[int, int]], per_language: int) -> DataFrame:
    """About ``per_language`` rows (lang, text) of each language of ``counts`` (see ``counted``), at least one, by a hash of the text.

    The share of each language that is taken follows from its count over all
    rows, so no row is moved to choose the sample.
    """
    if not counts:
        return labelled.select("lang", "text").limit(0)
    per_language = min(per_language, MAX_ROWS // len(counts))
    upto = {lang: max(least + 1, int(min(1.0, per_language / n) * (1 << 40))) for lang, (n, least) in counts.items()}
    share = F.create_map(*[F.lit(x) for item in upto.items() for x in item])
    return labelled.filter(_drawn() < F.element_at(share, F.col("lang"))).select("lang", "text")


def fit(labelled: DataFrame, per_language: int = 400, landmarks: int = 48, ridge: float = 0.03) -> Model:
    """A model from all rows (lang, text) of ``labelled``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = [(lang, letters(text)) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            rows = [(lang, np.unique(grams(line)).tobytes()) for lang, line in rows if line]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "grams"])

    labelled = labelled.filter("lang is not null").filter(F.col("text").rlike(r"\p{L}"))
    counts = counted(labelled)
    taken = sample(labelled, counts, per_language).mapInArrow(run, "lang string, grams binary").distinct().collect()
    rows = sorted((r["lang"], bytes(r["grams"])) for r in taken)
    languages = tuple(sorted({lang for lang, _ in rows}))
    if not rows:
        empty = np.zeros((0, 0), np.float32)
        return Model((), np.zeros(0, np.int64), empty, empty, np.zeros(0, np.float32))
    sets = [np.frombuffer(g, np.int32) for _, g in rows]
    of = np.array([languages.index(lang) for lang, _ in rows])
    rng = np.random.default_rng(0)
    chosen = np.concatenate([rng.permutation(np.flatnonzero(of == k))[:landmarks] for k in range(len(languages))])
    features = np.unique(np.concatenate([sets[i] for i in chosen]))
    index = np.full(_GRAMS, len(features), np.int32)
    index[features] = np.arange(len(features))

    def present(which: np.ndarray) -> np.ndarray:
        found = np.zeros((len(which), len(features) + 1), np.float32)
        for row, i in zip(found, which, strict=True):
            row[index[sets[i]]] = 1
        return found[:, : len(features)]

    def likeness(which: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Rows against landmarks, in blocks: no matrix of all rows and features is made."""
        return np.concatenate([kernel(present(which[a : a + 256]), marks) for a in range(0, len(which), 256)]).astype(np.float64)

    marks = np.empty((len(features), len(chosen)), np.float32)
    for a in range(0, len(chosen), 256):
        part = present(chosen[a : a + 256])
        marks[:, a : a + 256] = (part / np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1))).T
    among = likeness(chosen, marks)
    # Nystroem: coordinates in which the landmarks' kernel is the inner product.
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    good = values > 1e-6 * values.max()
    to = vectors[:, good] / np.sqrt(values[good])
    # Each language weighs the same, however many rows it has.
    own = np.array([counts[lang][0] for lang in languages], np.float64)
    weight = own.sum() / (len(own) * own)
    bare = Model(languages, features.astype(np.int64), marks, np.zeros((len(chosen), 0), np.float32), weight)
    squares, sums = moments(labelled, bare)
    targets = np.where(np.eye(len(languages), dtype=bool), 1.0, -1.0)
    middle = targets.mean(axis=0)
    gram = to.T @ squares @ to + ridge * own.sum() * np.eye(to.shape[1])
    solved = np.linalg.solve(gram, to.T @ (sums @ (targets - middle)))
    return Model(languages, features.astype(np.int64), marks, (to @ solved).astype(np.float32), middle.astype(np.float32))


def moments(labelled: DataFrame, bare: Model) -> tuple[np.ndarray, np.ndarray]:
    """Over all rows (lang, text) of the languages of ``bare``, whose ``share`` weighs a row of each: the sum of the products of a row's kernels with any two landmarks, and by language that of its kernels.

    A task gives the sums of its rows, and those are added in the order of the
    tasks, so equal inputs give equal sums.
    """
    n, languages = len(bare.landmarks.T), {lang: k for k, lang in enumerate(bare.languages)}
    shared = _shared(labelled.sparkSession, bare)
    rows = labelled.select("lang", "text")

    def block(at: int) -> np.ndarray:
        """Rows ``at`` to ``at + BLOCK`` of both sums, side by side."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blas_threads()
            model: Model = pickle.loads(shared.value)
            index, total = model.index(), None
            for batch in steps(batches):
                known = [(languages[lang], letters(text)) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if lang in languages]
                known = [(k, line) for k, line in known if line]
                for a in range(0, len(known), 128):
                    of = np.array([k for k, _ in known[a : a + 128]])
                    f = kernel(presence([line for _, line in known[a : a + 128]], index, len(model.features)), model.landmarks).astype(np.float64)
                    weighed = f[:, at : at + BLOCK] * model.share[of][:, None]
                    own = np.hstack([weighed.T @ f, weighed.T @ (of[:, None] == np.arange(len(languages)))])
                    total = own if total is None else total + own
            if total is not None:
                task = pa.array(np.full(len(total), TaskContext.get().partitionId(), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), task, pa.array([r.tobytes() for r in total], pa.binary())], ["row", "task", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for row, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    totals[row] = totals.get(row, 0) + np.frombuffer(sums, np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["row", "sums"])

        parts = rows.mapInArrow(run, "row int, task int, sums binary").repartition("row").sortWithinPartitions("row", "task")
        out = np.zeros((min(BLOCK, n - at), n + len(languages)))
        for r in parts.select("row", "sums").mapInArrow(add, "row int, sums binary").collect():
            out[r["row"]] = np.frombuffer(r["sums"], np.float64)
        return out

    both = np.concatenate([block(at) for at in range(0, n, BLOCK)])
    return both[:, :n], both[:, n:]


class Scorer:
    """A model with its n-gram index, as a worker holds it."""

    def __init__(self, packed: bytes) -> None:
        blas_threads()
        self.model: Model = pickle.loads(packed)
        self.index = self.model.index()

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        model = self.model
        lines = [letters(t) for t in texts]
        if not model.languages:
            return [UNDETERMINED] * len(lines), [0.0] * len(lines)
        lang: list[str] = []
        score: list[float] = []
        for a in range(0, len(lines), 128):
            part = lines[a : a + 128]
            f = kernel(presence(part, self.index, len(model.features)), model.landmarks) @ model.weights + model.share
            best = f.argmax(axis=1)
            top = np.clip((f[np.arange(len(part)), best].astype(np.float64) + 1) / 2, 0, 1)
            lang += [model.languages[b] if line else UNDETERMINED for b, line in zip(best, part, strict=True)]
            score += [float(s) if line else 0.0 for s, line in zip(top, part, strict=True)]
        return lang, score


def _shared(spark: SparkSession, model: Model):
    """The model, broadcast: its size is bounded by the sample's."""
    packed = pickle.dumps(model)
    if len(packed) > 1 << 30:
        raise ValueError("the model is too large to broadcast")
    return spark.sparkContext.broadcast(packed)


def predict(docs: DataFrame, model: Model, keep: list[Column] | None = None) -> DataFrame:
    """``keep`` (else doc_id) of every row of ``docs``, with lang_pred and score."""
    shared, kept = _shared(docs.sparkSession, model), {}
    rows = docs.select(*(keep or [F.col("doc_id").cast("long").alias("doc_id")]), F.col("text").cast("string").alias("__text"))
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept["scorer"] = Scorer(shared.value)
        for batch in steps(batches):
            lang, score = kept["scorer"](batch.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, "lang_pred string, score double"]))


#: The part of the ids that is never learned from.
FOLDS = 5


def _learned(docs: DataFrame) -> DataFrame:
    return docs.filter(id_bucket(F.col("doc_id"), FOLDS) != 0).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, by a model of the rows whose id's bucket is not 0.

    A row without an id is held out.
    """
    held = F.coalesce(id_bucket(F.col("doc_id"), FOLDS) == 0, F.lit(True))
    return predict(docs, fit(_learned(docs)), [F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out")])


#: The part of the held-out rows, of those told rightly, that a calibrated score may reject.
REJECTED = 0.001


def calibrated(docs: DataFrame, model: Model) -> float:
    """The score that all but ``REJECTED`` of the held-out labelled rows reach that the model tells rightly.

    All such rows take part. It is never over 0.5, at which a language is as
    likely as not, and 0 if no row is told rightly.
    """
    held = docs.filter(id_bucket(F.col("doc_id"), FOLDS) == 0).filter("lang is not null and text is not null")
    scores = predict(held, model, [F.col("lang").cast("string").alias("lang")]).filter("lang = lang_pred").select("score")
    found = ranked(checkpoint(scores), REJECTED)
    return 0.0 if found is None else min(0.5, found)


def ranked(scores: DataFrame, part: float) -> float | None:
    """The score (0 to 1) of ``scores`` (score) that this part of the others is below, rounded down to one that occurs; None if there is none.

    The scores are counted by the first 12 bits after the point, those of the
    one that is asked for by the next 12, and so on until only equal ones are left.
    """
    rank, bits = None, 12
    while True:
        bucket = F.floor(F.col("score") * F.lit(float(1 << bits))).alias("bucket")
        found = scores.groupBy(bucket).agg(F.count("*").alias("n"), F.min("score").alias("a"), F.max("score").alias("b")).orderBy("bucket").collect()
        if not found:
            return None
        if rank is None:
            rank = int(part * (sum(r["n"] for r in found) - 1))
        for r in found:
            if rank < r["n"]:
                break
            rank -= r["n"]
        if r["a"] == r["b"] or bits >= 60:
            return float(r["a"])
        scores, bits = scores.filter(bucket == r["bucket"]), bits + 12


def keep_identified(docs: DataFrame, least: float | None = 0.0) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text has a language, of a score of ``least`` or more.

    Without ``least`` it is calibrated on all held-out rows.
    """
    model = fit(_learned(docs))
    least = calibrated(docs, model) if least is None else least
    rows, _, _, at = positional(docs)
    shared, kept = _shared(docs.sparkSession, model), {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept["scorer"] = Scorer(shared.value)
        for batch in steps(batches):
            found = zip(*kept["scorer"](batch.column(at).cast(pa.string()).to_pylist()), strict=True)
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in found], pa.bool_()))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract over every whole text of ``documents``."""
    return identify(read(spark, sf_dir, "documents"))
