"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the sum of embeddings of its hashed form and of its hashed leading and trailing characters.
Windows of WINDOW words overlap by half and cover the whole text; in each, two gated recurrent layers (left
to right and back) run over the words, attention pools their states, and a linear unit gives the window's
score. A document's score is that of its worst window.

Labels are of documents, so training picks windows: smoothed log-odds of the hashed features, taken over the
labelled sample, start one channel of the embeddings and choose each document's most telling windows;
after a first round the network itself chooses them anew, so that its false alarms become examples.
"""

from __future__ import annotations

import gc
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm.bpe import some
from turnstile.llm.common import held_out, lower_words, only, ship, squeeze, tidied, unsqueeze
from turnstile.llm.rules import labelled_sample

BUCKETS, WIDTH, HIDDEN, WINDOW = 1 << 17, 8, 8, 32
FOLDS, SAMPLE_ROWS, EPOCHS, ROUNDS, BATCH = 5, 6_000, 4, 2, 256
#: Places that a word has: its form, leading 4 to 7 and trailing 3 and 4 bytes.
PLACES, CACHED = 7, 80_000
EDGE = b".,;:!?\"'()[]{}*#$%&|<>-_/\\+="
F4 = np.float32


def places(word: bytes) -> tuple[int, ...]:
    """Hashed features of a lower-cased word; signs at its ends do not count."""
    w = word.strip(EDGE) or word
    return (
        crc32(w) % BUCKETS,
        crc32(b"4" + w[:4]) % BUCKETS, crc32(b"5" + w[:5]) % BUCKETS, crc32(b"6" + w[:6]) % BUCKETS, crc32(b"7" + w[:7]) % BUCKETS,
        crc32(b"-3" + w[-3:]) % BUCKETS, crc32(b"-4" + w[-4:]) % BUCKETS,
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return F4(0.5) * np.tanh(F4(0.5) * x) + F4(0.5)


@dataclass
class Network:
    """Parameters by name; all small but the embeddings, BUCKETS x WIDTH."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(log_odds: np.ndarray, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        mat = lambda *s: (rng.standard_normal(s) * (1 / np.sqrt(s[0]))).astype(F4)
        emb = (rng.standard_normal((BUCKETS, WIDTH)) * 0.02).astype(F4)
        emb[:, 0] = log_odds
        p = {"emb": emb, "att": mat(2 * HIDDEN, HIDDEN), "pick": mat(HIDDEN), "out": mat(2 * HIDDEN), "bias": np.full(1, -1, F4)}
        for d in "fb":
            p |= {f"in{d}": mat(WIDTH, 3 * HIDDEN), f"re{d}": mat(HIDDEN, 3 * HIDDEN), f"off{d}": np.zeros(3 * HIDDEN, F4)}
            # unit 0 of each direction starts as a latch that a telling word sets; training shapes the rest
            gate = p[f"in{d}"]
            gate[0] = 0
            gate[:, [0, 2 * HIDDEN]] *= F4(0.1)
            gate[0, 0], p[f"off{d}"][0] = 2, -3
            gate[0, 2 * HIDDEN], p[f"off{d}"][2 * HIDDEN] = 1, -1.5
            p[f"re{d}"][:, [0, 2 * HIDDEN]] *= F4(0.1)
        p["att"][:] *= F4(0.3)
        p["att"][[0, HIDDEN], 0] = 2
        p["pick"][:] *= F4(0.3)
        p["pick"][0] = 3
        p["out"][:] *= F4(0.3)
        p["out"][[0, HIDDEN]] = 3
        return Network(p)

    def entered(self, features: np.ndarray) -> np.ndarray:
        """Embeddings of words given by their places; the last row stands for padding."""
        x = self.p["emb"][features].sum(axis=1) if len(features) else np.zeros((0, WIDTH), F4)
        return np.concatenate([x, np.zeros((1, WIDTH), F4)])

    def run(self, x: np.ndarray, d: str, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (step, row, HIDDEN) of one direction for gates' inputs x (row, step, 3 HIDDEN)."""
        n, steps = mask.shape
        h, out = np.zeros((n, HIDDEN), F4), np.empty((steps, n, HIDDEN), F4)
        re = self.p[f"re{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            own = h @ re
            gate = sigmoid(x[:, t, : 2 * HIDDEN] + own[:, : 2 * HIDDEN])
            z, r = gate[:, :HIDDEN], gate[:, HIDDEN:]
            c = np.tanh(x[:, t, 2 * HIDDEN :] + r * own[:, 2 * HIDDEN :])
            m = mask[:, t, None]
            new = np.where(m, (1 - z) * h + z * c, h)
            if keep is not None:
                keep.append((t, h, z, r, c, own[:, 2 * HIDDEN :], m))
            h = out[t] = new
        return out

    def forward(self, words: np.ndarray, emb: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Scores (before the sigmoid) of windows: words (row, step) are places in emb, whose last is padding."""
        mask = words != len(emb) - 1
        mask[:, 0] = True  # a window without words still has one empty step
        p, states, logs = self.p, [], {}
        for d in "fb":
            gates = emb @ p[f"in{d}"] + p[f"off{d}"]
            logs[d] = [] if keep is not None else None
            states.append(self.run(gates[words], d, mask, logs[d]))
        h = np.concatenate(states, axis=2)
        a = np.tanh(h @ p["att"])
        s = np.where(mask.T, a @ p["pick"], F4(-1e9))
        e = np.exp(s - s.max(axis=0))
        w = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", w, h)
        if keep is not None:
            keep |= {"logs": logs, "h": h, "a": a, "w": w, "pooled": pooled, "mask": mask}
        return pooled @ p["out"] + p["bias"][0]

    def gradients(self, words: np.ndarray, features: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradients of the mean cross-entropy, those of emb as (places, rows)."""
        p, emb, k = self.p, self.entered(features), {}
        score = self.forward(words, emb, k)
        prob = sigmoid(score)
        loss = float((weight * -(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))).mean())
        ds = ((prob - y) * weight / len(y)).astype(F4)
        g = {"out": k["pooled"].T @ ds, "bias": ds.sum(keepdims=True)}
        dpool = ds[:, None] * p["out"]
        h, a, w = k["h"], k["a"], k["w"]
        dh = w[:, :, None] * dpool
        dw = np.einsum("tnh,nh->tn", h, dpool)
        dsc = w * (dw - (w * dw).sum(axis=0))
        g["pick"] = np.einsum("tn,tnh->h", dsc, a)
        da = dsc[:, :, None] * p["pick"] * (1 - a * a)
        g["att"] = np.einsum("tni,tnj->ij", h, da)
        dh += da @ p["att"].T
        demb = np.zeros_like(emb)
        for i, d in enumerate("fb"):
            re, dre = p[f"re{d}"], np.zeros_like(p[f"re{d}"])
            dx = np.zeros((*words.shape, 3 * HIDDEN), F4)
            carry = np.zeros((len(y), HIDDEN), F4)
            for t, before, z, r, c, own, m in reversed(k["logs"][d]):
                d_new = dh[t][:, i * HIDDEN : (i + 1) * HIDDEN] + carry
                live = np.where(m, d_new, 0)
                dz = live * (c - before) * z * (1 - z)
                dc = live * z * (1 - c * c)
                dr = dc * own * r * (1 - r)
                dgate = np.concatenate([dz, dr, dc], axis=1)
                dback = np.concatenate([dz, dr, dc * r], axis=1)
                dx[:, t] = dgate
                dre += before.T @ dback
                carry = np.where(m, live * (1 - z) + dback @ re.T, d_new)
            g[f"re{d}"] = dre
            flat = np.zeros((len(emb), 3 * HIDDEN), F4)
            flat[words.ravel()] = dx.reshape(-1, 3 * HIDDEN)  # every place but the padding stands once
            flat[-1] = 0
            g[f"off{d}"] = flat.sum(axis=0)
            g[f"in{d}"] = emb.T @ flat
            demb += flat @ p[f"in{d}"].T
        place, inv = np.unique(features, return_inverse=True)
        each = np.repeat(demb[:-1], PLACES, axis=0)
        g["emb"] = (place, np.stack([np.bincount(inv.ravel(), c, len(place)) for c in each.T], axis=1).astype(F4))
        return g, loss


def cut(n: int, first: int, pad: int) -> np.ndarray:
    """Overlapping windows over words first .. first + n: every word is in one at least; none gives one empty window."""
    half = WINDOW // 2
    start = np.arange(max(1, -(-(n - half) // half)))[:, None] * half + np.arange(WINDOW)
    return np.where(start < n, start + first, pad)


class Adam:
    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.t = net, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.p.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, d in g.items():
            at, d = d if k == "emb" else (slice(None), d)
            m, v = self.m[k], self.v[k]
            m[at] = 0.9 * m[at] + 0.1 * d
            v[at] = 0.999 * v[at] + 0.001 * d * d
            self.net.p[k][at] -= F4(self.rate * fix) * m[at] / (np.sqrt(v[at]) + F4(1e-8))


def train(docs: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, rounds: int = ROUNDS, seed: int = 11) -> Network:
    """A network for documents given as places (word, PLACES) and labels 0 or 1."""
    pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for x, label in zip(docs, y):
        near = np.unique(x)
        (pos if label else neg)[near] += 1
    n1, n0 = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    share, soft = n1 / (n1 + n0), 10.0
    odds = np.log((pos + soft * share) / (n1 + soft * share)) - np.log((neg + soft * (1 - share)) / (n0 + soft * (1 - share)))
    net = Network.fresh(np.clip(odds, -3, 5).astype(F4) / PLACES)
    if not y.any() or y.all():
        net.p["out"][:] = 0
        net.p["bias"][:] = 4 if len(y) and y.all() else -4
        return net
    rng = np.random.default_rng(seed)
    scores = [odds[x].sum(axis=1) if len(x) else np.zeros(0) for x in docs]
    opt = Adam(net, 0.004)
    for round_ in range(rounds):
        chosen: list[tuple[int, np.ndarray]] = []
        for i, x in enumerate(docs):
            w = cut(len(x), 0, len(x))
            if round_ == 0:
                own = np.append(scores[i], -1e9)[w].max(axis=1)
            else:
                own = net.forward(w, net.entered(x)) if len(w) < 400 else np.concatenate([net.forward(w[k : k + 400], net.entered(x)) for k in range(0, len(w), 400)])
            best = np.argsort(-own)[: 1 if y[i] else 3]
            more = rng.integers(0, len(w), 1 if not y[i] else 0)
            chosen += [(i, w[k]) for k in {*best.tolist(), *more.tolist()}]
        label = np.array([y[i] for i, _ in chosen], F4)
        balance = np.where(label > 0, 0.5 / max(label.mean(), 1e-6), 0.5 / max(1 - label.mean(), 1e-6)).astype(F4)
        for _ in range(epochs):
            order = rng.permutation(len(chosen))
            for k in range(0, len(order), BATCH):
                own = order[k : k + BATCH]
                feats, words, at = [], [], 0
                for r in own:
                    i, w = chosen[r]
                    ok = w < len(docs[i])
                    feats.append(docs[i][w[ok]])
                    words.append(np.where(ok, np.cumsum(ok) - 1 + at, -1))
                    at += int(ok.sum())
                words = np.stack(words)
                words[words < 0] = at
                g, _ = net.gradients(words, np.concatenate(feats).reshape(-1, PLACES), label[own], balance[own])
                norm = np.sqrt(sum(float((v[1] if k == "emb" else v).ravel() @ (v[1] if k == "emb" else v).ravel()) for k, v in g.items()))
                if norm > 1:
                    g = {k: (v[0], v[1] / F4(norm)) if k == "emb" else v / F4(norm) for k, v in g.items()}
                opt.step(g)
    return net


class Scorer:
    """Scores texts; remembers the places of words across batches of a process."""

    def __init__(self, net: Network):
        self.net, self.known = net, {}

    def of(self, texts: list[str | None]) -> np.ndarray:
        """The worst window's probability of each text."""
        found = [lower_words(t) for t in texts]
        known = self.known
        if len(known) > CACHED:
            known.clear()
        ids: dict[bytes, int] = {}
        flat = np.array([ids.setdefault(w, len(ids)) for f in found for w in f], np.int32)
        for w in ids:
            if w not in known:
                known[w] = places(w)
        emb = self.net.entered(np.array([known[w] for w in ids], np.int64).reshape(-1, PLACES))
        pad, flat = len(ids), np.append(flat, len(ids))
        size, first = [len(f) for f in found], 0
        rows, doc = [], []
        for i, n in enumerate(size):
            w = cut(n, first, len(flat) - 1)
            rows.append(w)
            doc.append(np.full(len(w), i))
            first += n
        words, doc = flat[np.concatenate(rows)], np.concatenate(doc)
        assert pad == len(emb) - 1
        score = np.concatenate([self.net.forward(words[k : k + 1024], emb) for k in range(0, len(words), 1024)])
        worst = np.full(len(texts), -np.inf, F4)
        np.maximum.at(worst, doc, score)
        return sigmoid(worst).astype(np.float64)


def fitted(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> Network:
    """A network learned from labelled rows outside the held-out fold, SAMPLE_ROWS at most (those whose ids hash least)."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels.where(~held_out(F.col(id_col), folds)), label_col, id_col, text_col, SAMPLE_ROWS)

    def run(batches):
        for b in batches:
            packed = [squeeze(np.array([places(w) for w in lower_words(t)], np.int32).ravel()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(packed, pa.binary())], names=["id", "label", "x"])

    # a bounded sample; long documents enter whole
    rows = sample.select(F.col(id_col).cast("string").alias("id"), text_col, F.col("label").cast("int").alias("label")).mapInArrow(tidied(run), "id string, label int, x binary").collect()
    rows.sort(key=lambda r: (r.id, r.x))
    return train([unsqueeze(r.x)[0].reshape(-1, PLACES) for r in rows], np.array([r.label for r in rows]))


def scored(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, over all overlapping windows of the whole text."""
    spark = docs.sparkSession
    ship(spark)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    shared = spark.sparkContext.broadcast(net.p)  # of fixed size

    def run(batches):
        gc.disable()
        own = Scorer(Network(shared.value))
        for b in batches:
            texts = b.column(1)
            for i, j in some(texts):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(own.of(texts.slice(i, j - i).to_pylist()))], names=schema.names)

    return only(docs, id_col, text_col).mapInArrow(tidied(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted), one row for each row of docs.

    A null or empty text is one empty window. With labels of one kind only, or none, every score is near that
    kind (0 without labels). Repeated rows give repeated results.
    """
    found = scored(docs, fitted(docs, labels, label_col, id_col, text_col), id_col, text_col)
    return found.select(id_col, held_out(F.col(id_col), FOLDS).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
