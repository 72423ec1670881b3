"""Toxicity scores from a learned lexicon, misspellings included, in context.

The lexicon is learned: beginnings of words, and whole words, that are many
times as frequent in toxic training texts as in clean ones, weighed by their log odds. It
makes a trie. A Levenshtein automaton of one edit is intersected with the trie:
its states are sets of trie nodes with the edits spent, made as words call for
them and kept, so a word costs one step a letter. An exact beginning counts
as it stands; a whole word of ``FUZZY_LETTERS`` or more also counts when
misspelled by one letter, digits that stand for letters read as those.

Each hit is looked at in a window of ``WINDOW`` words to either side: between
quotation marks, or near a word of reporting, it counts as quoted. What a text
has of plain, misspelled and quoted hits goes into a logistic regression, which
learns from scores of a lexicon that has not seen the text: the training rows
are cut into two folds, and each fold is scored by the other's lexicon.

Training rows are a bounded sample, chosen by a hash over all rows that may be
learned from: about ``per_class`` of either label.

Defined results: null and empty texts score like a text without hits. Labels
that contradict each other for one id count as toxic. With nothing to learn
from, or one class only, every score is 0. Repeated rows get equal scores. A
null id is not learned from and is held out.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverine.llm.common import checkpoint, id_bucket, read, steps
from quiverine.llm.pieces import Memo

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
WINDOW = 8
FUZZY_LETTERS = 5
SHORTEST, LONGEST_START = 3, 8
MOST_TERMS = 4000
LETTERS = re.compile(r"[^\W\d_]+")
LOOK_ALIKE = str.maketrans("013457@$", "oieastas")
QUOTES = re.compile("[\"«»“”„‹›]")
#: Words that report what others say, in the languages of the tables.
REPORTING = frozenset("said says quote quoted quotes called reported wrote sagte sagt zitat genannt schrieb dit disait citation appelé écrit dijo dice cita llamado escribió".split())


def starts_of(word: str) -> Iterator[str]:
    """What is counted of a word: its beginnings, and itself with an end mark."""
    for k in range(SHORTEST, min(len(word), LONGEST_START) + 1):
        yield word[:k]
    if len(word) >= FUZZY_LETTERS:
        yield word + "$"


class Trie:
    """Terms as nodes: children, and the weight of the beginning or the whole word that ends there."""

    def __init__(self, terms: dict[str, float]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.start: list[float] = [0.0]
        self.whole: list[float] = [0.0]
        for term, weight in terms.items():
            at = 0
            for c in term.rstrip("$"):
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.start.append(0.0)
                    self.whole.append(0.0)
                at = self.children[at][c]
            if term.endswith("$"):
                self.whole[at] = weight
            else:
                self.start[at] = weight


class Lexicon:
    """Exact beginnings, and whole words within one edit, of the trie's terms."""

    #: Steps of the automaton that are kept.
    MOST = 200_000

    def __init__(self, terms: dict[str, float]) -> None:
        self.exact = Trie(terms)
        self.words = Trie({t: w for t, w in terms.items() if t.endswith("$") and len(t) > FUZZY_LETTERS})
        self.begin = self._close({(0, 0)})
        self.steps: dict[tuple[frozenset, str], frozenset] = {}

    def _close(self, states: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """With the nodes that a left-out letter leads to."""
        return frozenset(states | {(child, 1) for node, spent in states if not spent for child in self.words.children[node].values()})

    def _step(self, states: frozenset[tuple[int, int]], letter: str) -> frozenset[tuple[int, int]]:
        to = set()
        for node, spent in states:
            children = self.words.children[node]
            if letter in children:
                to.add((children[letter], spent))
            if not spent:
                to.add((node, 1))  # a letter too many
                to.update((child, 1) for child in children.values())  # another letter
        return self._close(to)

    def start_weight(self, word: str) -> float:
        """The largest weight of a beginning of the word, or of the word itself."""
        at, best = 0, 0.0
        for c in word:
            at = self.exact.children[at].get(c, -1)
            if at < 0:
                return best
            best = max(best, self.exact.start[at])
        return max(best, self.exact.whole[at])

    def near_weight(self, word: str) -> float:
        """The largest weight of a whole word within one edit."""
        states = self.begin
        for c in word:
            step = (states, c)
            states = self.steps.get(step)
            if states is None:
                if len(self.steps) >= self.MOST:
                    self.steps.clear()
                states = self.steps[step] = self._step(*step)
            if not states:
                return 0.0
        return max((self.words.whole[node] for node, _ in states), default=0.0)

    def of_chunk(self, chunk: str) -> tuple[float, float] | None:
        """The plain and the misspelled weight of what stands between white space; None for neither."""
        low = chunk.lower()
        plain = max(map(self.start_weight, LETTERS.findall(low)), default=0.0)
        if plain:
            return plain, 0.0
        near = 0.0
        for word in {*LETTERS.findall(low), *LETTERS.findall(low.translate(LOOK_ALIKE))}:
            if len(word) >= FUZZY_LETTERS - 1:
                near = max(near, self.near_weight(word))
        return (0.0, near) if near else None


FEATURES = 7


class Scorer:
    def __init__(self, terms: dict[str, float]) -> None:
        self.hits = Memo(Lexicon(terms).of_chunk, most=300_000)

    def features(self, text: str | None) -> list[float]:
        """One, the largest and the summed weight of plain hits, the same of misspelled ones, of quoted ones, and hits by length."""
        chunks = (text or "").split()
        found = [(k, hit) for k, hit in enumerate(map(self.hits.__getitem__, chunks)) if hit]
        plain: list[float] = []
        near: list[float] = []
        quoted: list[float] = []
        for k, (a, b) in found:
            own = quoted if self._quoted(chunks, k) else plain if a else near
            own.append(a or b)
        share = 100 * len(found) / (len(chunks) + 20)
        return [1.0, max(plain, default=0.0), math.log1p(sum(plain)), max(near, default=0.0), math.log1p(sum(near)), math.log1p(sum(quoted)), math.log1p(share)]

    @staticmethod
    def _quoted(chunks: list[str], k: int) -> bool:
        before, after = chunks[max(0, k - WINDOW) : k], chunks[k + 1 : k + 1 + WINDOW]
        own = len(QUOTES.findall(chunks[k]))
        left = sum(len(QUOTES.findall(c)) for c in before)
        right = sum(len(QUOTES.findall(c)) for c in after)
        if own >= 2 or (own and (left or right)) or (left % 2 and right):
            return True
        return any(c.strip(".,:;!?").lower() in REPORTING for c in before[-3:])


@dataclass(frozen=True)
class Model:
    terms: dict[str, float]
    weights: np.ndarray
    scale: np.ndarray


def choose_terms(counted: DataFrame, toxic: int, clean: int, most: int = MOST_TERMS) -> dict[str, float]:
    """Terms with their log odds, of (term, t, c), which are numbers of toxic and clean texts.

    Those that are surely over four times as frequent in toxic texts; the
    ``most`` that weigh the most, all that leaves the cluster.
    """
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    most_clean = (c + 1 + 1.64 * F.sqrt(c)) / (clean + 1)
    least_toxic = (t - F.sqrt(t)) / (toxic + 1)
    weight = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    found = counted.filter((t >= 3) & (least_toxic > 4 * most_clean)).select("term", weight.alias("weight"), (t * weight).alias("order"))
    return {r["term"]: r["weight"] for r in found.orderBy(F.col("order").desc(), "term").limit(most).collect()}


def regress(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression, by Newton's steps."""
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(x.shape[1])
    keep[0, 0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(text, toxic, fold) of about ``per_class`` rows of either label, by a hash of the id over all rows that may be learned from.

    The labels are sampled first, so what is broadcast to the documents has a
    bound, about twice ``per_class`` rows of two numbers.
    """
    ids = F.col("doc_id").cast("long")
    usable = labels.filter(id_bucket(F.col("doc_id"), FOLDS) != HELD_OUT).select(ids.alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)")
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, per_class / counts.get(1, 1)))).otherwise(F.lit(min(1.0, per_class / counts.get(0, 1))))
    taken = usable.filter(drawn < share).groupBy("id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(ids.alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(taken), "id")
    return checkpoint(rows.select("text", "toxic", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(2)).cast("int").alias("fold")))


def _term_counts(rows: DataFrame) -> DataFrame:
    """(term, t0, c0, t1, c1): the toxic and clean texts of each fold that have a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in steps(batches):
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms = {t for word in set(LETTERS.findall((text or "").lower())) for t in starts_of(word)}
                counts[toxic].update((t, fold) for t in terms)
        keys = list(counts[0].keys() | counts[1].keys())
        for a in range(0, len(keys), 50_000):
            part = keys[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in part], pa.string()), pa.array([k[1] for k in part], pa.int32()), pa.array([counts[1][k] for k in part], pa.int64()), pa.array([counts[0][k] for k in part], pa.int64())], ["term", "fold", "t", "c"])

    counted = rows.select("text", "toxic", "fold").mapInArrow(run, "term string, fold int, t long, c long")
    return checkpoint(counted.groupBy("term").agg(*(F.sum(F.when(F.col("fold") == f, F.col(x)).otherwise(0)).alias(f"{x}{f}") for f in (0, 1) for x in "tc")))


def _features(rows: DataFrame, lexicons: list[dict[str, float]]) -> list[tuple]:
    """Fold, label and features of every row, by the lexicon of the other fold."""
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(lexicons))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(terms) for terms in pickle.loads(shared.value)]
        for batch in steps(batches):
            found = [scorers[1 - fold].features(text) for text, fold in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["toxic", "x"])

    return rows.select("text", "toxic", "fold").mapInArrow(run, "toxic int, x array<double>").collect()


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> Model | None:
    """A model, or None if there aren't both labels."""
    rows = training_rows(docs, labels, per_class)
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    n = lambda label, folds: sum(sizes.get((f, label), 0) for f in folds)
    if not n(1, (0, 1)) or not n(0, (0, 1)):
        return None
    counts = _term_counts(rows)
    lexicons = [choose_terms(counts.select("term", F.col(f"t{f}").alias("t"), F.col(f"c{f}").alias("c")), n(1, (f,)), n(0, (f,))) for f in (0, 1)]
    terms = choose_terms(counts.select("term", (F.col("t0") + F.col("t1")).alias("t"), (F.col("c0") + F.col("c1")).alias("c")), n(1, (0, 1)), n(0, (0, 1)))
    found = _features(rows, lexicons)
    x, y = np.array([r["x"] for r in found]), np.array([r["toxic"] for r in found], float)
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    return Model(terms, regress(x / scale, y), scale)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    spark = docs.sparkSession
    held = F.coalesce(id_bucket(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = spark.sparkContext.broadcast(pickle.dumps(model))  # at most MOST_TERMS terms
    kept: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept["model"] = pickle.loads(shared.value)
            kept["scorer"] = Scorer(kept["model"].terms)
        model, scorer = kept["model"], kept["scorer"]
        for batch in steps(batches):
            x = np.array([scorer.features(t) for t in batch.column(2).to_pylist()], float).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-np.clip((x / model.scale) @ model.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract over every whole text of ``documents``."""
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
