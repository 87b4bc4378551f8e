"""Quality classifier: ordinal regression with cumulative links over hashed text.

One weight vector over hashed features is shared by all grades; grade g is exceeded with probability
sigmoid(w.x - t_g), and the thresholds t_g ascend, so tail probabilities fall. Features are words, word shapes and
the sizes of a few ratios, hashed into BUCKETS places; counts are damped by log(1 + n) and scaled to length 1.
It is fitted on the driver from a bounded sample of labelled rows and applied to every whole text.
"""

from __future__ import annotations

import gc
import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm.common import only, ship, sliced, squeeze, text_bytes, tidied, unsqueeze
from turnstile.llm.rules import labelled_sample

BUCKETS, SAMPLE_ROWS, EPOCHS, CACHED = 1 << 16, 10_000, 12, 100_000
LOWER, UPPER, DIGIT, HIGH = re.compile(rb"[a-z]+"), re.compile(rb"[A-Z]+"), re.compile(rb"[0-9]+"), re.compile(rb"[\x80-\xff]+")


def shape(word: bytes) -> bytes:
    """A word with runs of letters and digits reduced to one sign."""
    return HIGH.sub(b"a", LOWER.sub(b"a", DIGIT.sub(b"0", UPPER.sub(b"A", word)))).replace(b"aa", b"a")[:24]


class Features:
    """Hashed features of texts; remembers words across batches of a process."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, int]] = {}

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(places, values) of one text. A text without words has the bias of emptiness alone."""
        found, known = text_bytes(text).split(), self.known
        if len(known) > CACHED:
            known.clear()
        pairs = []
        for w in found:
            p = known.get(w)
            if p is None:
                p = known[w] = crc32(w.lower()) % BUCKETS, crc32(b"\0" + shape(w)) % BUCKETS
            pairs.append(p)
        at = np.array(pairs, np.int64).reshape(-1, 2)
        if not len(at):
            return np.array([crc32(b"\1empty") % BUCKETS]), np.ones(1, np.float32)
        word, counts = np.unique(at[:, 0], return_counts=True)
        form, forms = np.unique(at[:, 1], return_counts=True)
        n = len(found)
        # words share a third of the length, shapes another; the ratios have the rest
        a = np.log1p(counts) / np.linalg.norm(np.log1p(counts))
        b = forms / np.linalg.norm(forms)
        ratios = [b"\1repeat%d" % int(10 * (1 - len(word) / n)), b"\1size%d" % int(np.log2(n)), b"\1upper%d" % int(10 * sum(w.isupper() for w in found) / n)]
        place = np.concatenate([word, form, [crc32(r) % BUCKETS for r in ratios]])
        return place, np.concatenate([a, b, np.full(len(ratios), 0.5)]).astype(np.float32)


@dataclass
class Ordinal:
    """Weights, ascending thresholds between the grades, and the grades."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > g) for all grades but the last, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score[:, None], -60, 60)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-6, seed: int = 3) -> Ordinal:
    """Maximum likelihood of cumulative links by AdaGrad on small batches. One grade alone gives no thresholds."""
    grades = np.unique(grade)
    w, k = np.zeros(BUCKETS), len(grades) - 1
    level = np.searchsorted(grades, grade)
    if k < 1:
        return Ordinal(w, np.zeros(0), grades.astype(float) if len(grades) else np.zeros(1))
    above = np.array([(level > j).mean() for j in range(k)])
    first, gaps = -np.log(above[0] / (1 - above[0])), np.zeros(k - 1)  # thresholds: first, then steps of exp(gap)
    tail = lambda: first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
    sums, sum_first, sum_gaps = np.full(BUCKETS, 1e-6), 1e-6, np.full(k - 1, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), 64):
            own = order[i : i + 64]
            place = np.concatenate([rows[r][0] for r in own])
            value = np.concatenate([rows[r][1] for r in own])
            doc = np.repeat(np.arange(len(own)), [len(rows[r][0]) for r in own])
            score = np.bincount(doc, value * w[place], len(own))
            p = 1 / (1 + np.exp(np.clip(tail() - score[:, None], -60, 60)))  # P(level > j)
            edge = np.concatenate([np.ones((len(own), 1)), p, np.zeros((len(own), 1))], axis=1)
            slope = edge * (1 - edge)
            r, y = np.arange(len(own)), level[own]
            like = np.maximum(edge[r, y] - edge[r, y + 1], 1e-9)
            step = (slope[r, y] - slope[r, y + 1]) / like / len(own)
            back = np.zeros((len(own), k + 2))
            back[r, y] -= slope[r, y] / like / len(own)
            back[r, y + 1] += slope[r, y + 1] / like / len(own)
            back = back[:, 1:-1].sum(axis=0)
            near, inv = np.unique(place, return_inverse=True)
            g = np.bincount(inv, value * step[doc]) - decay * w[near]
            sums[near] += g * g
            w[near] += rate * g / np.sqrt(sums[near])
            g = back.sum()
            sum_first += g * g
            first += 0.1 * g / np.sqrt(sum_first)
            g = np.cumsum(back[::-1])[::-1][1:] * np.exp(gaps)
            sum_gaps += g * g
            gaps += 0.1 * g / np.sqrt(sum_gaps)
    return Ordinal(w, tail(), grades.astype(float))


def fitted(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """A model of the labelled rows of docs, SAMPLE_ROWS at most (those whose ids hash least)."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, label_col, id_col, text_col, SAMPLE_ROWS)

    def run(batches):
        own = Features()
        for b in batches:
            packed = [squeeze(p.astype(np.int32), v) for p, v in map(own.of, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(packed, pa.binary())], names=["id", "label", "x"])

    rows = sample.select(F.col(id_col).cast("string").alias("id"), text_col, F.col("label").cast("double").alias("label")).mapInArrow(tidied(run), "id string, label double, x binary").collect()
    rows.sort(key=lambda r: (r.id, r.x))
    return fit([tuple(unsqueeze(r.x)) for r in rows], np.array([r.label for r in rows]))


def scored(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_grade, tails array<double>) of every row."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("expected_grade", T.DoubleType()), T.StructField("tails", T.ArrayType(T.DoubleType()))])

    def run(batches):
        gc.disable()
        own = Features()
        for b in sliced(batches, 1):
            score = np.array([float(v @ model.weights[p]) for p, v in map(own.of, b.column(1).to_pylist())])
            tails = model.tails(score)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.expected(tails)), pa.array(list(tails), pa.list_(pa.float64()))], names=schema.names)

    return only(docs, id_col, text_col).mapInArrow(tidied(run), schema)


def graded(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, expected_grade, tail, kept): tail is the probability of more than the lowest grade; kept if it is at least least.

    Null and empty texts have a feature of their own. With no labels, or one grade, every row is kept with
    tail 1. Repeated rows give repeated results.
    """
    model = fitted(docs, labels, label_col, id_col, text_col)
    tail = F.coalesce(F.get("tails", F.lit(0)), F.lit(1.0))
    return scored(docs, model, id_col, text_col).select(id_col, "expected_grade", tail.alias("tail"), (tail >= least).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that the classifier keeps; the verdict is on the row's own text."""
    model = fitted(docs, labels, label_col, id_col, text_col)
    ship(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches):
        gc.disable()
        own = Features()
        for b in sliced(batches, place):
            score = np.array([float(v @ model.weights[p]) for p, v in map(own.of, b.column(place).to_pylist())])
            tails = model.tails(score)
            yield b.filter(pa.array(tails[:, 0] >= least if tails.shape[1] else np.ones(len(score), bool)))

    return docs.mapInArrow(tidied(run), docs.schema)
