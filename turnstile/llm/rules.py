"""Quality rules: an ordered decision list over text statistics, learned by sequential covering.

Statistics of a text are taken once, in whole. From a bounded sample of labelled rows conjunctions of
thresholds that reject are grown one condition at a time by information gain on two thirds of the rows,
and pruned back on the other third; rows that a rule covers leave, and the next rule is grown, until no feature
starts a rule that is sure enough. The list becomes one Spark conditional expression, WHEN rule THEN rejected ... ELSE kept,
that anyone can read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm.common import only, ship, sliced, text_bytes, tidied

#: The symbols that are counted, and the white space between words.
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
#: Labelled rows that a list is fitted on at most (those of least hash), rules, and conditions of a rule.
SAMPLE_ROWS, MAX_RULES, MAX_CONDITIONS = 20_000, 12, 3
#: A rule must be right this often on the rows that prune it, and cover so many rows.
PRECISION, LEAST_COVER = 0.98, 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper_words", "n_digits"]


def repeated_words(found: list[bytes], width: int = 3) -> tuple[int, int]:
    """(words inside windows of width words that occur twice or more, distinct words)."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in found), np.int64, len(found))
    n = len(found) - width + 1
    if n < 2 or len(known) == len(found):
        return 0, len(known)
    code = ids[:n]
    for k in range(1, width):
        if k > 1:
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(known) + ids[k : k + n]
    _, place, count = np.unique(code, return_inverse=True, return_counts=True)
    start = np.flatnonzero(count[place] > 1)
    hit = np.zeros(len(found), bool)
    for k in range(width):
        hit[start + k] = True
    return int(hit.sum()), len(known)


def statistics_of(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text; a null has nothing."""
    text = text or ""
    found = text_bytes(text).split()
    blanks = sum(text.count(c) for c in BLANKS)
    repeat, distinct = repeated_words(found)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            dup += line in seen
            seen.add(line)
    return len(found), len(text) - blanks, sum(text.count(c) for c in SYMBOLS), dup, repeat, distinct, sum(w.isupper() and len(w) > 1 for w in found), sum(text.count(c) for c in "0123456789")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS long), one row for each row of docs, in whole texts."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def run(batches):
        for b in sliced(batches, 1):
            rows = np.array([statistics_of(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in rows.T]], names=schema.names)

    return only(docs, id_col, text_col).mapInArrow(tidied(run), schema)


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat > 50 * n_words)


#: What rules may test: a name, and how it comes from the counts, for arrays and for columns alike.
FEATURES = {
    "words": lambda c: c("n_words") * 1.0,
    "chars_a_word": lambda c: c("word_chars") / (c("n_words") + 1.0),
    "symbols_a_word": lambda c: c("n_symbols") / (c("n_words") + 1.0),
    "dup_lines_a_word": lambda c: c("n_dup_lines") / (c("n_words") + 1.0),
    "repeated_share": lambda c: c("n_repeat_words") / (c("n_words") + 1.0),
    "distinct_share": lambda c: c("n_distinct") / (c("n_words") + 1.0),
    "upper_share": lambda c: c("n_upper_words") / (c("n_words") + 1.0),
    "digits_a_word": lambda c: c("n_digits") / (c("n_words") + 1.0),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        value = FEATURES[self.feature](F.col)
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first whose conditions all hold rejects, and what none covers is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def kept(self) -> Column:
        out = None
        for rule in self.rules:
            test = rule[0].column()
            for c in rule[1:]:
                test = test & c.column()
            out = F.when(test, False) if out is None else out.when(test, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def text(self) -> str:
        lines = [" and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.4g}" for c in r) + ": reject" for r in self.rules]
        return "\n".join([*lines, "else: keep"])


def covered(rule: list[Condition] | tuple[Condition, ...], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def best_condition(x: dict[str, np.ndarray], bad: np.ndarray, hit: np.ndarray, banned: set[str]) -> tuple[float, Condition | None]:
    """The condition of most information gain among the rows that a rule still covers, on features not banned."""
    p0, n0 = int((hit & bad).sum()), int((hit & ~bad).sum())
    best: tuple[float, Condition | None] = 0.0, None
    if not p0 or not n0:
        return best
    base = np.log2(p0 / (p0 + n0))
    for name in [f for f in FEATURES if f not in banned]:
        v = x[name][hit]
        order = np.argsort(v, kind="stable")
        v, y = v[order], bad[hit][order]
        cut = np.flatnonzero(np.diff(v) > 0)
        if not len(cut):
            continue
        low_p, low_n = np.cumsum(y)[cut], np.cumsum(~y)[cut]
        for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1)) - base), 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = float(gain[k]), Condition(name, above, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    return best


def learn(counts: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7) -> DecisionList:
    """Sequential covering over labelled statistics: bad marks the rows to reject. No bad rows: an empty list."""
    x = {k: np.asarray(f(lambda c: counts[c].astype(float))) for k, f in FEATURES.items()}
    grow = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    left, rules, banned = np.ones(len(bad), bool), [], set()
    while len(rules) < MAX_RULES and (left & grow & bad).any():
        rule: list[Condition] = []
        hit = left & grow
        while len(rule) < MAX_CONDITIONS and (hit & ~bad).any():
            _, c = best_condition(x, bad, hit, banned)
            if c is None:
                break
            rule.append(c)
            hit &= c.holds(x)
        if not rule:
            break

        def worth(r: list[Condition]) -> float:
            h = covered(r, x, len(bad)) & left & ~grow
            p, n = int((h & bad).sum()), int((h & ~bad).sum())
            return (p - n) / max(p + n, 1)

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        h = covered(rule, x, len(bad)) & left
        right = int((h & bad).sum())
        if right < LEAST_COVER or right < PRECISION * h.sum() or worth(rule) < 2 * PRECISION - 1:
            banned.add(rule[0].feature)  # not sure enough: grow again from another feature
            continue
        rules.append(tuple(rule))
        left, banned = left & ~h, set()
    return DecisionList(tuple(rules))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, text, label) of at most rows labelled rows, those whose ids hash least; rows without a label are none."""
    own = only(labels, id_col, label_col).where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).alias("label")).groupBy(id_col).agg(F.min("label").alias("label"))
    own = own.orderBy(F.xxhash64(id_col), id_col).limit(rows)
    return only(docs, id_col, text_col).join(F.broadcast(own), id_col)


def fitted_rules(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", good_from: int = 1) -> DecisionList:
    """A list learned from labelled rows: grades under good_from are to be rejected. No labels: an empty list."""
    sample = labelled_sample(docs, labels, label_col, id_col, text_col)
    rows = statistics(sample, id_col, text_col).join(F.broadcast(sample.select(id_col, "label").distinct()), id_col).orderBy(id_col)
    got = rows.select(*COUNTS, "label").toPandas()
    return learn({c: got[c].to_numpy(np.int64) for c in COUNTS}, got["label"].to_numpy() < good_from)


def quality_rules(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS, base_failed, kept), one row for each row of docs.

    kept is false where the base rule fails, else the learned list's verdict. Null, empty and blank texts
    have no words and fail. Repeated rows give repeated results; without labels the base rule alone decides.
    """
    found = fitted_rules(docs, labels, label_col, id_col, text_col)
    rows = statistics(docs, id_col, text_col).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & found.kept())
