"""Scoring by a language model kept as a weighted backoff automaton.

The model smooths word n-grams up to an order (3): for a history h and its shorter suffix h',
P(w | h) = l(h) c(h, w) / c(h) + (1 - l(h)) P(w | h'), with l(h) = MIX c(h) / (c(h) + DAMP), over words and one
sign for all words that training lacks; P(w) is c(w) / (N + V) and the unknown sign has V / (N + V) (Witten and
Bell), so probabilities add up to 1 in every state. As an automaton: the root, and a state for each n-gram of
training below the order; from a state h an arc for each (h, w) of training, with weight P(w | h), to the state of
the longest suffix of (h, w); and a failure arc with weight 1 - l(h) to the state of h'. The root has an arc for
every word, that of an unknown one leads back to the root. A text starts in the state of the end sign and is
traversed once, left to right, carrying the state: failure arcs are followed until the state has an arc for the word.
Many texts are traversed side by side; a long text is cut into lanes, each of which walks in from the root over the
order - 1 words before it, which is all that a state remembers.

No process holds the whole model. Documents are dealt into batches of bounded size; a batch sends each of
its words and n-grams once, with its training count, to the part of the counts that the hash names; parts
add up and send the totals back, so a batch gets just the slice of the automaton that its texts can reach.
A word or n-gram that fills the corpus is one entry a batch. The slice of a batch is as large as its texts.
Words are named by 64 bits; n-grams by as many as make a clash of a name unlikely (SPARE bits more than it takes
to count them), as names of n-grams are most of what is sent.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm.bpe import some
from turnstile.llm.common import batches_for, dealt, held_out, lower_words, only, ship, squeeze, tidied, undealt, unsqueeze
from turnstile.llm.suffix import M2, M3, mixed

FOLDS, ORDER, MIX, DAMP = 10, 3, 0.5, 0.3
#: Bits of an n-gram's name beyond those that count all n-grams; tokens that a lane of the traversal holds.
SPARE, LANE = 24, 512
#: The base model's added count.
BASE = 0.1
END = b""


def hashes(found: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, 1) for w in found), np.uint64, len(found))


def parted(key: np.ndarray, parts: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order of distinct keys by name, so by part; the parts met, where each starts in it (and the end), and the steps from key to key.

    A part is a range of names, told by their first 32 bits; its first step is from the range's start.
    """
    order = np.argsort(key)
    key, low = key[order], np.uint64(bits - 32)
    part = ((key >> low) * np.uint64(parts)) >> np.uint64(32)
    step = np.diff(key, prepend=np.uint64(0))
    cut = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
    met = part[cut]
    step[cut] = key[cut] - ((((met << np.uint64(32)) + np.uint64(parts - 1)) // np.uint64(parts)) << low)
    return order, met.astype(np.int32), np.append(cut, len(key)), step


def name_bits(tokens: int, order: int) -> int:
    """How many bits name the n-grams of a corpus of so many training tokens."""
    return max(40, min(64, SPARE + (2 * order * tokens).bit_length()))


class Batch:
    """Documents of a batch as places in its own word list; its distinct words and n-grams, numbered from the words up.

    grams[k] has the n-gram of length k + 1 that ends at each token (a text follows an end sign; -1 where a text has
    not that many tokens yet); prefix and suffix are an n-gram's words without the last and without the first.
    """

    def __init__(self, texts: list[str | None], train: np.ndarray, order: int, bits: int):
        ids: dict[bytes, int] = {END: 0}
        flat, size = [], []
        for t in texts:
            own = [ids.setdefault(w, len(ids)) for w in lower_words(t)]
            own.append(0)
            flat.append(np.array(own, np.int32))
            size.append(len(own))
        self.size = np.array(size, np.int64)
        self.word = np.concatenate(flat) if flat else np.empty(0, np.int32)
        del flat
        self.doc = np.repeat(np.arange(len(size), dtype=np.int32), self.size)
        self.first = np.cumsum(self.size) - self.size
        n = self.n = len(ids)
        self.order, self.bits = order, bits
        name = hashes(list(ids))
        del ids
        taught = train[self.doc]
        self.grams = np.full((order, len(self.word)), -1, np.int32)
        self.grams[0] = self.word
        keys, counts = [name], [np.bincount(self.word[taught], minlength=n)]
        prefix, suffix, start = [np.full(n, -1, np.int32)], [np.full(n, -1, np.int32)], [0, n]
        for k in range(1, order):
            before = np.concatenate([np.full(1, -1, np.int32), self.grams[k - 1][:-1]])[: len(self.word)]
            before[self.first] = 0 if k == 1 else -1
            here = np.flatnonzero(before >= 0)
            found, inv = np.unique((before[here] - start[k - 1]).astype(np.int64) * n + self.word[here], return_inverse=True)
            prefix.append((found // n + start[k - 1]).astype(np.int32))
            keys.append(mixed(mixed(keys[k - 1][found // n] * M2 + M3) ^ name[found % n]))
            counts.append(np.bincount(inv[taught[here]], minlength=len(found)))
            self.grams[k, here] = inv + start[k]
            less = np.empty(len(found), np.int32)
            less[inv] = self.grams[k - 1, here]
            suffix.append(less)
            start.append(start[k] + len(found))
        self.start, self.prefix, self.suffix = start, np.concatenate(prefix), np.concatenate(suffix)
        grams = np.concatenate([np.empty(0, np.uint64), *keys[1:]]) >> np.uint64(64 - bits)
        self.sides = [(name, counts[0], 64), (grams, np.concatenate([np.empty(0, np.int64), *counts[1:]]), bits)]

    def sent(self, batch: int, parts: int) -> pa.Table:
        none, sides = np.empty(0, np.int32), []
        for key, count, bits in self.sides:
            order, met, cut, step = parted(key, parts, bits)
            count = count[order].astype(np.int32)
            sides.append({p: (step[i:j], count[i:j]) for p, i, j in zip(met.tolist(), cut, cut[1:])})
        to = sorted(sides[0].keys() | sides[1].keys())
        data = [squeeze(*sides[0].get(p, (none, none)), *sides[1].get(p, (none, none))) for p in to]
        return pa.table({"p": pa.array(to, pa.int32()), "b": pa.array([batch] * len(to), pa.int32()), "data": pa.array(data, pa.binary())})

    def totals(self, rows: pa.Table, parts: int) -> np.ndarray:
        """Corpus counts of the batch's words and n-grams."""
        got = [unsqueeze(d) for _, d in sorted(zip(rows.column("p").to_pylist(), rows.column("data").to_pylist()))]
        found = []
        for i, (key, _, bits) in enumerate(self.sides):
            out = np.empty(len(key), np.int64)
            out[parted(key, parts, bits)[0]] = np.concatenate([g[i] for g in got])
            found.append(out)
        return np.concatenate(found)


class Automaton:
    """A slice of the model. State 0 is the root, state 1 + i that of n-gram i; arc i reads the last word of n-gram i."""

    def __init__(self, x: Batch, count: np.ndarray, tokens: int, types: int):
        n, last = x.n, x.start[x.order - 1]
        share = MIX * count / (count + DAMP)
        total = max(tokens + types, 1)
        chance = np.where(count > 0, count, 0).astype(np.float64)
        chance[:n] = np.where(count[:n] > 0, count[:n], types if tokens else total) / total
        for i, j in zip(x.start[1:], x.start[2:]):
            h, less = x.prefix[i:j], x.suffix[i:j]
            chance[i:j] = np.where(count[i:j] > 0, share[h] * count[i:j] / np.maximum(count[h], 1) + (1 - share[h]) * chance[less], 0)
        #: Whether an arc is there: the root reads every word, other states what training has.
        self.there = count > 0
        self.there[:n] = True
        self.weight = np.log10(chance, out=np.zeros(len(chance)), where=self.there)
        own = np.arange(1, len(count) + 1, dtype=np.int32)
        self.to = np.where(np.arange(len(count)) < last, own, x.suffix + 1) if x.order > 1 else np.zeros(len(count), np.int32)
        self.to[:n][count[:n] == 0] = 0
        self.fails_to = np.concatenate([[0], x.suffix + 1]).astype(np.int32)
        self.fails_for = np.concatenate([[0.0], np.log10(1 - share)])
        self.depth = np.zeros(len(count) + 1, np.int8)
        for k, (i, j) in enumerate(zip(x.start, x.start[1:])):
            self.depth[1 + i : 1 + j] = k + 1
        self.begin = 1 if x.order > 1 else 0

    def traversed(self, x: Batch) -> np.ndarray:
        """log10 probability of each text."""
        lanes = -(-x.size // LANE)
        doc = np.repeat(np.arange(len(x.size)), lanes)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        back = np.where(nth > 0, x.order - 1, 0)  # words that a lane walks in over
        at = x.first[doc] + nth * LANE - back
        size = np.minimum(x.size[doc] - nth * LANE, LANE) + back
        by = np.argsort(-size, kind="stable")
        doc, at, size, back = doc[by], at[by], size[by], back[by]
        state = np.where(back > 0, 0, self.begin).astype(np.int32)
        total = np.zeros(len(doc))
        alive = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
        for t, live in enumerate(alive):
            s, place = state[:live], at[:live] + t
            arc = x.grams[self.depth[s], place]
            gone = np.zeros(live)
            stuck = np.flatnonzero(~self.there[arc])
            while len(stuck):
                gone[stuck] += self.fails_for[s[stuck]]
                s[stuck] = self.fails_to[s[stuck]]
                arc[stuck] = x.grams[self.depth[s[stuck]], place[stuck]]
                stuck = stuck[~self.there[arc[stuck]]]
            gone += self.weight[arc]
            state[:live] = self.to[arc]
            total[:live] += gone if t >= x.order - 1 else np.where(back[:live] > t, 0, gone)
        return np.bincount(doc, total, len(x.size))


def add_up(rows: pa.Table) -> pa.Table:
    """Totals of one part's words and n-grams, returned to each batch in the order it sent them."""
    blocks = [unsqueeze(d) for d in rows.column("data").to_pylist()]
    found = []
    for side in (0, 2):
        key = np.concatenate([np.cumsum(b[side], dtype=np.uint64) for b in blocks])
        _, inv = np.unique(key, return_inverse=True)
        total = np.bincount(inv, np.concatenate([b[side + 1] for b in blocks])).astype(np.int64)[inv]
        cut = np.cumsum([0, *[len(b[side]) for b in blocks]])
        found.append([total[i:j] for i, j in zip(cut[:-1], cut[1:])])
    return pa.table({"b": rows.column("b"), "p": rows.column("p"), "data": pa.array([squeeze(*both) for both in zip(*found)], pa.binary())})


def training_size(docs: DataFrame, id_col: str, text_col: str, parts: int, folds: int = FOLDS) -> tuple[int, int]:
    """(N, V): tokens and distinct tokens of the training rows, ends included; exact, from all of them."""
    taught = only(docs, id_col, text_col).where(~held_out(F.col(id_col), folds)).select(text_col)

    def words(batches):
        gc.disable()
        seen, n = [], 0
        for b in batches:
            for i, j in some(b.column(0), 8_000_000):
                own = set()
                for t in b.column(0).slice(i, j - i).to_pylist():
                    found = lower_words(t)
                    n += len(found) + 1
                    own.update(found)
                seen.append(np.sort(hashes([END, *own])))
            if len(seen) > 4:
                seen = [np.unique(np.concatenate(seen))]
        if seen:
            key = np.unique(np.concatenate(seen))
            _, met, cut, step = parted(key, parts)
            data = [squeeze(step[i:j]) for i, j in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array([n, *[0] * (len(met) - 1)], pa.int64()), pa.array(data, pa.binary())], names=["p", "n", "data"])

    def distinct(rows: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(unsqueeze(d)[0], dtype=np.uint64) for d in rows.column("data").to_pylist()])
        return pa.table({"n": [sum(rows.column("n").to_pylist())], "v": [len(np.unique(keys))]})

    got = taught.mapInArrow(tidied(words), "p int, n long, data binary").groupBy("p").applyInArrow(tidied(distinct), "n long, v long")
    n, v = got.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    return n, v


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, batch_mb: int = 8, order: int = ORDER) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of docs.

    Training rows are those whose crc32(id as text) modulo folds is not 0. A null or empty text is one end
    sign. Repeated rows count as often as they occur. Without training rows both models give every token
    probability 1. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    parts = batches = batches_for(docs, batch_mb)
    tokens, types = training_size(docs, id_col, text_col, parts, folds)
    bits = name_bits(tokens, order)
    kind = docs.schema[id_col].dataType
    own = only(docs, id_col, text_col).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col), folds).alias("held_out")
    )
    out = T.StructType([T.StructField(id_col, kind), *T._parse_datatype_string("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])

    def opened(table: pa.Table) -> Batch:
        return Batch(table.column("text").to_pylist(), ~table.column("held_out").to_numpy(zero_copy_only=False).astype(bool), order, bits)

    @tidied
    def first(key, table):
        return opened(undealt(table)).sent(key[0].as_py(), parts)

    @tidied
    def last(key, table, rows):
        table = undealt(table)
        x = opened(table)
        count = x.totals(rows, parts)
        words = count[: x.n]
        base = np.log10((words + BASE) / (tokens + BASE * (types + 1)))
        total = lambda v: np.bincount(x.doc, v, len(x.size))
        return pa.table({
            id_col: table.column("id"), "held_out": table.column("held_out"), "n_tokens": x.size, "n_known": total(words[x.word] > 0).astype(np.int64),
            "train_tokens": np.full(len(x.size), tokens, np.int64), "base_score": total(base[x.word]), "score": Automaton(x, count, tokens, types).traversed(x),
        })

    by_batch = dealt(own, "id", batches).groupBy("b")  # every batch gets counts, so cogroups have both sides
    counts = by_batch.applyInArrow(first, "p int, b int, data binary").groupBy("p").applyInArrow(add_up, "b int, p int, data binary")
    return by_batch.cogroup(counts.groupBy("b")).applyInArrow(last, out)
