"""Removal of repeated 50-byte strings by a sampled suffix order over a cover chosen by content.

A difference cover picks positions such that of any two suffixes, moved on by one and the same short step,
both stand on picked positions; sorting the picked suffixes then orders all of them. Here only equal
50-byte strings must meet, so the cover is chosen by content: in every 50-byte window the leftmost
24-byte gram of least hash is picked (about 7 % of the positions; fixed residues that leave grams as long
would need a fifth of them). Two equal windows pick the same step. The operator then

1. names the picked grams (by hashes) and sorts the names over the cluster;
2. carries the windows that pick a gram (its context: a run of window starts) along with its name; where
   all contexts of a name are one, the whole run is decided by the least document that has it;
3. merges the rest: windows of names with several contexts are sorted by (name, window) and equal
   neighbours share their least document.

A window is removed in each document greater than its least. Documents are dealt into batches by id and
each batch sends every name once, with its context if it has but one there, and every window of the names with
several, with their least documents. So a passage that a third of all documents share, or a gram that stands
in any number of contexts, costs one entry a batch in the first round. Equality is that of 64-bit hashes of the 50 bytes
(48 bits between contexts of one name). Names have 48 bits; two grams that share one just have their
windows compared. The blocks that batches exchange are never more than the entries in them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm.common import batches_for, dealt, few, raw_texts, ship, squeeze, tidied, undealt, unsqueeze

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1  # gram starts in a window
#: Positions hashed at once; the low bits of a sort key hold the position.
CHUNK_BITS = 20
NO_ID = -(1 << 63)
MULTI = 1
#: Stands for the contexts of a name that has several in a batch.
DIFFER = np.uint64((1 << 64) - 1)
#: With every, so many documents of a scope must hold a string (two, if there are just two), and one in so many of them.
HELD, SHARE = 3, 10
#: Odd constants of 64-bit mixing.
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M1
    return x ^ (x >> np.uint64(29))


def gram_hashes(raw: bytes) -> np.ndarray:
    """A hash of the GRAM bytes from each position."""
    n = len(raw) - GRAM + 1
    pad = raw + bytes(8)
    word = np.empty(len(raw), np.uint64)
    for k in range(8):
        part = np.frombuffer(pad, "<u8", (len(pad) - k) // 8, k)
        word[k::8] = part[: len(word[k::8])]
    h = mixed(word[:n] * M2 + M3)
    h = mixed(h ^ (word[8 : n + 8] * M3))
    return mixed(h ^ (word[16 : n + 16] * M2))


def window_hashes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the LENGTH bytes from each of some positions: three grams cover them."""
    return mixed(mixed(h[at] * M2 ^ h[at + GRAM]) * M3 ^ h[at + LENGTH - GRAM])


def pieces(size: np.ndarray):
    """Slices (start, end) of a batch of documents of given sizes, and parts of long ones, that fit a chunk.

    Parts of a long document overlap by LENGTH - 1 bytes, so each window is in just one of them.
    """
    most = (1 << CHUNK_BITS) - LENGTH
    first, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if n > most:
            if held:
                yield first, i, 0, 0
            for a in range(0, n - LENGTH + 1, most - LENGTH + 1):
                yield i, i + 1, a, min(n, a + most)
            first, held = i + 1, 0
            continue
        if held + n > most:
            yield first, i, 0, 0
            first, held = i, 0
        held += n
    if held:
        yield first, len(size), 0, 0


class Sample:
    """The picked grams of a batch of documents: for each run of windows with one pick, its document and place."""

    def __init__(self, texts: list[bytes]):
        parts, self.texts = [], texts
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        for i, j, a, b in pieces(size):
            raw = self.raw(i, j, a, b)
            if len(raw) >= LENGTH:
                ends = np.array([len(raw)]) if b else np.cumsum(size[i:j])
                parts.append(self.picked(raw, ends, i, a) | {"at": (i, j, a, b)})
        empty = {"doc": np.int32, "low": np.int32, "high": np.int32, "name": np.uint64, "context": np.uint64}
        for k, kind in empty.items():
            setattr(self, k, np.concatenate([np.empty(0, kind), *[p.pop(k) for p in parts]]))
        self.parts = parts

    def raw(self, i: int, j: int, a: int, b: int) -> bytes:
        return self.texts[i][a:b] if b else b"".join(self.texts[i:j])

    @staticmethod
    def picked(raw: bytes, ends: np.ndarray, first: int, base: int) -> dict:
        h = gram_hashes(raw)
        key = (h & ~np.uint64((1 << CHUNK_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
        least, width = key, 1
        while width * 2 <= SPAN:
            least, width = np.minimum(least[:-width], least[width:]), width * 2
        n = len(key) - SPAN + 1
        least = np.minimum(least[:n], least[SPAN - width : SPAN - width + n])
        pick = (least & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.int64)
        start = np.arange(n)
        doc = np.searchsorted(ends, start, "right")
        start = start[start + LENGTH <= ends[doc]]
        doc, pick = doc[start], pick[start]
        new = np.ones(len(start), bool)
        new[1:] = (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        low, high, a, doc = start[at], start[np.append(at[1:], len(start)) - 1] if len(at) else start[at], pick[at], doc[at]
        last = high + LENGTH - GRAM
        context = mixed(h[low] * M2 ^ h[np.maximum(low, a - GRAM)])
        context = mixed(context * M3 ^ h[np.minimum(a + GRAM, last)])
        context = mixed(context * M2 ^ h[last] ^ ((a - low) * 64 + (high - a + 32)).astype(np.uint64))
        begin = np.concatenate([[0], ends[:-1]])[doc] - base
        small = lambda x: x.astype(np.int32)
        return {"doc": small(doc + first), "low": small(low - begin), "high": small(high - begin), "name": h[a] >> np.uint64(16), "context": context >> np.uint64(16), "shift": begin, "runs": len(at)}

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the chosen runs: (run, start in the document, hash) of each window."""
        out, at = [(np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint64))], 0
        for p in self.parts:
            own = np.flatnonzero(chosen[at : at + p["runs"]])
            if len(own):
                low = self.low[at : at + p["runs"]]
                count = (self.high[at : at + p["runs"]] - low + 1)[own]
                run = np.repeat(own, count)
                start = low[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
                # the hashes of a part are taken anew: kept, they would hold eight bytes for every byte of text
                out.append(((run + at).astype(np.int32), start.astype(np.int32), window_hashes(gram_hashes(self.raw(*p["at"])), start + p["shift"][run])))
            at += p["runs"]
        return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def ordered(first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """An order by first (under 48 bits, if there is a second), then second: by one key of 64 bits, then ties that it leaves."""
    if second is None:
        return np.argsort(first)
    low = np.uint64(0xFFFF)
    key = first << np.uint64(16) | (second & low)
    order = np.argsort(key)
    k, s = key[order], second[order]
    tied = np.zeros(len(k) + 1, bool)
    tied[1:-1] = k[1:] == k[:-1]
    mixed_up = np.zeros(len(k) + 1, bool)
    mixed_up[1:-1] = tied[1:-1] & (s[1:] != s[:-1])
    if mixed_up.any():  # whole runs of equal keys are sorted anew in their places
        run = np.cumsum(~tied[:-1])
        bad = np.flatnonzero(np.isin(run, run[np.flatnonzero(mixed_up[:-1])]))
        order[bad] = order[bad][np.lexsort((s[bad], k[bad]))]
    return order


def entries(keys: tuple[np.ndarray, ...], doc: np.ndarray):
    """Distinct keys in order: (place of each row among them, the keys, least and greatest document)."""
    order = ordered(*keys)
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    at = np.flatnonzero(new)
    place = np.empty(len(order), np.int32 if len(order) < 1 << 31 else np.int64)
    place[order] = np.cumsum(new) - 1
    own = doc[order]
    return place, [k[order][at] for k in keys], np.minimum.reduceat(own, at) if len(at) else own, np.maximum.reduceat(own, at) if len(at) else own


def holders(place: np.ndarray, n: int, doc: np.ndarray) -> np.ndarray:
    """How many distinct documents have each of n keys."""
    order = np.lexsort((doc, place))
    place, doc = place[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(place[new], minlength=n).astype(np.int64)


def wanted(docs: np.ndarray) -> np.ndarray:
    """How many documents must hold a string before it goes from all, by the number of documents in the scope."""
    return np.maximum(np.clip(docs, 2, HELD), -(-docs // SHARE))


class Batch:
    """Documents of one batch in a fixed order, and what the two rounds make of them."""

    def __init__(self, table: pa.Table, every: bool = False):
        ids, raw = table.column("id").to_pylist(), raw_texts(table.column("text"))
        order = sorted(range(len(raw)), key=lambda i: (NO_ID if ids[i] is None else ids[i], raw[i]))
        self.rows, self.texts = order, [raw[i] for i in order]
        self.ids = np.array([NO_ID if ids[i] is None else ids[i] for i in order], np.int64)
        self.sample = s = Sample(self.texts)
        if "scope" in table.column_names:  # strings of one scope alone meet
            scope = np.array([table.column("scope")[i].as_py() for i in order], np.int64).view(np.uint64)
            s.name = mixed(s.name ^ mixed(scope[s.doc] * M3)) >> np.uint64(16) if len(s.doc) else s.name
        self.place, (self.name, self.context), self.least, self.most = entries((s.name, s.context), self.ids[s.doc])
        self.every = every
        if every:  # what is sent is how many documents hold an entry; behind the entries the scopes themselves
            self.scopes, self.scope = np.unique(scope, return_inverse=True)
            held = holders(self.place, len(self.name), self.ids[s.doc])
            self.least = self.most = np.concatenate([held, holders(self.scope, len(self.scopes), self.ids)])
            self.name = np.concatenate([self.name, mixed(self.scopes * M2) >> np.uint64(16)])
            self.context = np.concatenate([self.context, np.zeros(len(self.scopes), np.uint64)])

    def names(self) -> tuple[np.ndarray, ...]:
        """Entries of the first round: (name, context, least, most).

        A name has one, however many contexts it has in the batch; with several its context is DIFFER. With every
        each context has its own, as holders of each are counted.
        """
        if self.every or not len(self.name):
            self.entry = np.arange(len(self.name))
            return self.name, self.context, self.least, self.most
        new = np.diff(self.name, prepend=~self.name[:1]) != 0
        at, self.entry = np.flatnonzero(new), np.cumsum(new) - 1
        one = np.diff(at, append=len(new)) == 1
        return self.name[at], np.where(one, self.context[at], DIFFER), np.minimum.reduceat(self.least, at), np.maximum.reduceat(self.most, at)

    def answers(self, rows: pa.Table, round_: int, n: int, name: np.ndarray, parts: int) -> np.ndarray:
        """What came back for n entries that were sent in order of (part, entry)."""
        part = (name % np.uint64(parts)).astype(few(parts))
        order = np.argsort(part, kind="stable")
        got = {p: unsqueeze(d)[0] for r, p, d in zip(*(rows.column(c).to_pylist() for c in ("round", "p", "data"))) if r == round_}
        out = np.empty(n, np.int64)
        if n:
            out[order] = np.concatenate([got[p] for p in sorted(got)])
        return out

    def first_answers(self, rows: pa.Table, parts: int) -> None:
        name, _, least, _ = self.names()
        back = self.answers(rows, 1, len(name), name, parts)
        if self.every:
            n = len(self.name) - len(self.scopes)
            held, self.need = back[:n][self.place], wanted(back[n:])[self.scope][self.sample.doc]
            self.gone, self.several = held >= self.need, -held >= self.need
        else:
            self.several = (back == MULTI)[self.entry][self.place] if len(back) else np.empty(0, bool)
            self.found = (least + np.minimum(back, 0))[self.entry]
        self.run, self.start, self.window = self.sample.windows(self.several)
        doc = self.ids[self.sample.doc[self.run]] if len(self.run) else np.empty(0, np.int64)
        self.window_place, (self.window_name, self.window_key), self.window_least, self.window_most = entries((self.sample.name[self.run], self.window), doc)
        if self.every:
            self.window_least = self.window_most = holders(self.window_place, len(self.window_name), doc)

    def removed(self, rows: pa.Table, parts: int) -> list[list[tuple[int, int]]]:
        """Spans of each document, in the batch's order."""
        self.first_answers(rows, parts)
        s = self.sample
        back = self.answers(rows, 2, len(self.window_name), self.window_name, parts)
        if self.every:
            gone, hit = self.gone, back[self.window_place] >= self.need[self.run]
        else:
            gone = ~self.several & (self.found[self.place] < self.ids[s.doc]) if len(self.place) else np.empty(0, bool)
            hit = (self.window_least + back)[self.window_place] < self.ids[s.doc[self.run]] if len(self.run) else np.empty(0, bool)
        doc = np.concatenate([s.doc[gone], s.doc[self.run[hit]]])
        low = np.concatenate([s.low[gone], self.start[hit]])
        high = np.concatenate([s.high[gone], self.start[hit]]) + LENGTH
        order = np.lexsort((low, doc))
        spans: list[list[tuple[int, int]]] = [[] for _ in self.texts]
        for d, a, b in zip(doc[order].tolist(), low[order].tolist(), high[order].tolist()):
            own = spans[d]
            if own and a <= own[-1][1]:
                if b > own[-1][1]:
                    own[-1] = own[-1][0], b
            else:
                own.append((a, b))
        return spans


def sent(batch: int, name: np.ndarray, second: np.ndarray, least: np.ndarray, most: np.ndarray, parts: int) -> pa.Table:
    """Entries by part of the name, packed."""
    order = np.argsort((name % np.uint64(parts)).astype(few(parts)), kind="stable")
    part = (name % np.uint64(parts)).astype(np.int64)
    cut = np.flatnonzero(np.diff(part[order], prepend=-1))
    rows = [(int(part[order[i]]), order[i:j]) for i, j in zip(cut, np.append(cut[1:], len(order)))]
    data = [squeeze(np.diff(name[o], prepend=np.uint64(0)), second[o] & np.uint64(0xFFFFFFFF), second[o] >> np.uint64(32), least[o], most[o] - least[o]) for _, o in rows]
    return pa.table({"p": pa.array([p for p, _ in rows], pa.int32()), "b": pa.array([batch] * len(rows), pa.int32()), "data": pa.array(data, pa.binary())})


def opened(rows: pa.Table):
    """All entries of one part: blocks, and their columns joined."""
    blocks = sorted(zip(rows.column("b").to_pylist(), rows.column("data").to_pylist()))
    parts = [unsqueeze(d) for _, d in blocks]
    name = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in parts])
    second = np.concatenate([x[1] | x[2] << np.uint64(32) for x in parts])
    least = np.concatenate([x[3] for x in parts])
    most = least + np.concatenate([x[4] for x in parts])
    return [b for b, _ in blocks], [len(x[0]) for x in parts], name, second, least, most


def returned(blocks: list[int], sizes: list[int], part: int, value: np.ndarray, round_: int) -> pa.Table:
    cut = np.cumsum([0, *sizes])
    return pa.table({"b": pa.array(blocks, pa.int32()), "round": pa.array([round_] * len(blocks), pa.int32()), "p": pa.array([part] * len(blocks), pa.int32()), "data": pa.array([squeeze(value[i:j]) for i, j in zip(cut[:-1], cut[1:])], pa.binary())})


def added(place: np.ndarray, n: int, count: np.ndarray) -> np.ndarray:
    """Sums of the counts of each of n keys."""
    total = np.zeros(n, np.int64)
    np.add.at(total, place, count)
    return total


def settle_names(rows: pa.Table, every: bool = False) -> pa.Table:
    """Of each entry: how far below its own least document the name's is, or MULTI if its contexts differ.

    With every: how many documents hold it, less than 0 if its contexts differ (then at most so many hold each).
    """
    blocks, sizes, name, context, least, most = opened(rows)
    place, _, low, _ = entries((name,), least)
    _, _, _, top = entries((name,), most)
    one = np.full(len(low), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(one, place, context)
    differ = np.zeros(len(low), bool)
    differ[place[(context != one[place]) | (context == DIFFER)]] = True
    if every:
        value = (added(place, len(low), least) * np.where(differ, -1, 1))[place]
    else:
        value = np.where(differ[place] & (low != top)[place], MULTI, low[place] - least)
    return returned(blocks, sizes, rows.column("p")[0].as_py(), value, 1)


def settle_windows(rows: pa.Table, every: bool = False) -> pa.Table:
    """Of each entry: how far below its own least document that of the equal windows is; with every how many documents hold it."""
    blocks, sizes, name, window, least, most = opened(rows)
    place, _, low, _ = entries((name, window), least)
    value = added(place, len(low), least)[place] if every else low[place] - least
    return returned(blocks, sizes, rows.column("p")[0].as_py(), value, 2)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_mb: int = 5, scope_col: str | None = None, every: bool = False, as_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, text_hash, n_bytes, spans array<struct<start, end>>, kept binary), one row for each row of docs.

    text_hash is xxhash64 of the text (of the empty text for a null); spans are the maximal runs of bytes covered by a LENGTH-byte string that also starts in a document of
    smaller id; kept is the rest. A null text counts as empty; texts under LENGTH bytes keep all. Rows of
    one id do not take from each other. A row without an id counts as the smallest. With scope_col strings
    meet only within equal scopes; with every a string that HELD documents of its scope and one in SHARE of them
    have goes from all of them (of a scope of two documents, what both have). Rows of one id count as one document.
    With as_text kept is a string, without bytes left over from characters that were cut in two, and null for a null.
    Columns named in keep follow, as _0, _1 and so on.
    """
    ship(docs.sparkSession)
    parts = batches = batches_for(docs, batch_mb)
    kind = docs.schema[id_col].dataType
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{k}`").alias(f"_{i}") for i, k in enumerate(keep)], *([(F.xxhash64(F.col(f"`{scope_col}`")) if scope_col else F.lit(0).cast("long")).alias("scope")] if scope_col or every else []))
    to_part, back = "p int, b int, data binary", "b int, round int, p int, data binary"

    @tidied
    def first(key, table):
        x = Batch(undealt(table), every)
        return sent(key[0].as_py(), *x.names(), parts)

    @tidied
    def second(key, table, rows):
        x = Batch(undealt(table), every)
        x.first_answers(rows, parts)
        return sent(key[0].as_py(), x.window_name, x.window_key, x.window_least, x.window_most, parts)

    out = T.StructType([T.StructField(id_col, kind), *T._parse_datatype_string("text_hash long, n_bytes long, spans array<struct<start: long, end: long>>").fields, T.StructField("kept", T.StringType() if as_text else T.BinaryType()), *[T.StructField(f"_{i}", docs.schema[k].dataType) for i, k in enumerate(keep)]])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    @tidied
    def last(key, table, rows):
        table = undealt(table)
        x = Batch(table, every)
        order = pa.array(x.rows, pa.int64())
        ids, none, more = table.column("id").take(order), table.column("text").is_null().take(order).to_pylist(), {f"_{i}": table.column(f"_{i}").take(order) for i in range(len(keep))}
        del table
        spans = x.removed(rows, parts)
        kept = []
        for raw, cut in zip(x.texts, spans):
            edge = [0, *[e for s in cut for e in s], len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2])))
        if as_text:
            kept = [None if z else k.decode("utf-8", "ignore") for k, z in zip(kept, none)]
        hashed = np.array([xxhash.xxh64_intdigest(t, 42) for t in x.texts], np.uint64).view(np.int64)
        return pa.table({id_col: ids, "text_hash": hashed, "n_bytes": pa.array([len(t) for t in x.texts], pa.int64()), "spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], span), "kept": pa.array(kept, pa.string() if as_text else pa.binary()), **more})

    # every batch of documents gets its answers, so both sides of a cogroup always have rows
    by_batch = dealt(own, "id", batches).groupBy("b")
    names = by_batch.applyInArrow(first, to_part).groupBy("p").applyInArrow(lambda t: settle_names(t, every), back)
    windows = by_batch.cogroup(names.groupBy("b")).applyInArrow(second, to_part).groupBy("p").applyInArrow(lambda t: settle_windows(t, every), back)
    return by_batch.cogroup(names.unionByName(windows).groupBy("b")).applyInArrow(last, out)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the repeated spans cut out of their texts.

    A byte left over from a character that was cut in two is dropped. Rows stay, even with empty texts.
    """
    keep = tuple(c for c in docs.columns if c not in (id_col, text_col))
    found = repeated_spans(docs, id_col, text_col, as_text=True, keep=keep)
    from_ = {id_col: id_col, text_col: "kept"} | {k: f"_{i}" for i, k in enumerate(keep)}
    return found.select(*[F.col(f"`{from_[c]}`").alias(c) for c in docs.columns])
