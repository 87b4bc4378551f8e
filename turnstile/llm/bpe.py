"""Byte-level BPE on padded numpy matrices, and the cutting of text that the token writers share.

The text is cut where a single space stands between two other characters that are not white space; no
match of the pre-tokenising pattern crosses such a place, so the pieces encode on their own and a piece met
before is looked up. New pieces are cut by the pattern; the new matches among them go, in buckets of
similar length, into matrices of token ids padded with -1. In each round every row merges its leftmost
pair of least rank: pair ranks come from an open-addressing hash table, and the row is compacted.
"""

from __future__ import annotations

import base64
import gc
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm.common import only, ship, some, tidied

NO_RANK = np.int32(2**31 - 1)
#: Pieces that a Python worker remembers; beyond it only those of the latest texts stay.
CACHED = 200_000
#: Matches of more bytes are merged one by one with a heap, as a matrix row would cost the square.
LONG = 512
#: A single space between two characters that are not white space.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file of base64 lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class PairTable:
    """Ranks of mergeable pairs of ids: keys left * 2^32 + right, linear probing, read in whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        key, value = np.array(keys, np.int64), np.array(values, np.int32)
        at, self.probes = self.slot(key), 0
        while len(key):
            self.probes += 1
            free = np.flatnonzero(self.keys[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = key[put], value[put]
            rest = np.ones(len(key), bool)
            rest[put] = False
            key, value, at = key[rest], value[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NO_RANK where it does not merge or a side is padding."""
        key = left.astype(np.int64) << 32 | right
        key[(left < 0) | (right < 0)] = -2
        at = self.slot(key)
        seen = self.keys[at]
        out = np.where(seen == key, self.values[at], NO_RANK)
        todo = np.flatnonzero((seen != key) & (seen != -1) & (key != -2))
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[todo]]
            hit = seen == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (seen != -1)]
        return out


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of an array, given by their starts and sizes, end to end."""
    end = np.cumsum(size)
    take = np.repeat(start - (end - size), size)
    take += np.arange(len(take))
    return flat[take]


class Encoder:
    """Encodes texts by ranks, as merging leftmost least-rank pairs does; remembers pieces across batches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pairs = PairTable(ranks)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.matches: dict[str, bytes] = {}
        self.cutter = Cutter(self.encode_pieces)

    def encode_matches(self, found: list[str]) -> list[bytes]:
        """Ids of each match, as little-endian unsigned 32-bit integers."""
        raw = [m.encode("utf-8", "surrogatepass") for m in found]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[bytes] = [b""] * len(raw)
        # fixed steps keep padding under a quarter or so
        edges = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256, 384, LONG]
        for low, high in zip([0, *edges[:-1]], edges):
            rows = np.flatnonzero((size > low) & (size <= high))
            for i in range(0, len(rows), step := max(1, 250_000 // high)):
                own = rows[i : i + step]
                for k, ids in zip(own.tolist(), self.merge_matrix([raw[r] for r in own.tolist()], size[own], high)):
                    out[k] = ids
        for k in np.flatnonzero(size > LONG).tolist():
            out[k] = self.merge_long(raw[k])
        return out

    def merge_matrix(self, raw: list[bytes], size: np.ndarray, width: int) -> list[bytes]:
        flat = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in raw), np.uint8).reshape(len(raw), width)
        ids = np.where(np.arange(width) < size[:, None], self.byte[flat], np.int32(-1))
        rank = self.pairs.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(raw), width - 1)
        out: list[bytes] = [b""] * len(raw)
        who, size = np.arange(len(raw)), size.copy()
        while len(who):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(who), np.int64)
            best = rank[np.arange(len(who)), at] if rank.shape[1] else np.full(len(who), NO_RANK)
            done = best == NO_RANK
            for k in np.flatnonzero(done).tolist():
                out[who[k]] = ids[k, : size[k]].astype("<u4").tobytes()
            go = ~done
            who, ids, rank, size, at, best = who[go], ids[go], rank[go], size[go] - 1, at[go], best[go]
            n = len(who)
            if not n:
                break
            r = np.arange(n)
            ids[r, at] = best
            keep = np.ones(ids.shape, bool)
            keep[r, at + 1] = False
            ids = ids[keep].reshape(n, -1)
            keep = np.ones(rank.shape, bool)
            keep[r, at] = False
            rank = rank[keep].reshape(n, -1)
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.pairs.rank(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < ids.shape[1] - 1)
            rank[right, at[right]] = self.pairs.rank(ids[right, at[right]], ids[right, at[right] + 1])
        return out

    def merge_long(self, raw: bytes) -> bytes:
        """The same merges for one long match, by a heap over a linked list."""
        import heapq

        ids = self.byte[np.frombuffer(raw, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        first = self.pairs.rank(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r != NO_RANK]
        heapq.heapify(heap)
        token = {}

        def push(i: int) -> None:
            j = after[i]
            if j < n:
                pair = ids[i], ids[j]
                if pair not in token:
                    token[pair] = int(self.pairs.rank(np.array([pair[0]], np.int32), np.array([pair[1]], np.int32))[0])
                if token[pair] != NO_RANK:
                    heapq.heappush(heap, (token[pair], i, *pair))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], alive[j] = rank, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([x for x, ok in zip(ids, alive) if ok], "<u4").tobytes()

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [self.pattern.findall(p) for p in pieces]
        known = self.matches
        met = set().union(*cut)
        new = [m for m in met if m not in known]
        if len(known) + len(new) > CACHED:
            known = self.matches = {m: known[m] for m in met if m in known}
        known.update(zip(new, self.encode_matches(new)))
        raw = [b"".join([known[m] for m in c]) for c in cut]
        return np.frombuffer(b"".join(raw), "<u4"), np.fromiter(map(len, raw), np.int64, len(raw)) // 4

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.cutter.encode(texts)

    def forget(self) -> None:
        """Drop what is remembered."""
        self.matches = {}
        self.cutter.forget()


class Cutter:
    """Encodes texts piece by piece, remembering pieces.

    encode_pieces gives the ids of some pieces, end to end, and how many each piece has. A piece that follows a space
    is known by its text without it; the head of a text, which follows nothing, by its text behind a space.
    """

    def __init__(self, encode_pieces, cached: int = CACHED):
        self.of, self.cached = encode_pieces, cached
        self.forget()

    def forget(self) -> None:
        """Drop all remembered pieces."""
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def places(self, found: list[str], lead: str) -> np.ndarray:
        """The place of each distinct piece in what is remembered, -1 if no safe cut stands beside it."""
        get, mark = self.known.get, " " if not lead else ""
        at = np.fromiter((get(mark + p, -1) for p in found), np.int64, len(found))
        new = [k for k in np.flatnonzero(at < 0).tolist() if not lead or found[k] and not found[k][0].isspace() and not found[k][-1].isspace()]
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            flat, size = self.of([lead + found[k] for k in part])
            at[part] = np.arange(len(self.size), len(self.size) + len(part))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
        self.known.update(zip([mark + found[k] for k in new], at[new].tolist()))
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each text's ids begin and the last ends); a null has none."""
        if len(self.known) > self.cached or len(self.flat) > 8 * self.cached:
            self.forget()
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        edge = lists.offsets.to_numpy().astype(np.int64)
        edge = edge - edge[0]
        coded = lists.flatten().dictionary_encode()
        word, found = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        first = edge[:-1]
        inner = np.ones(len(word), bool)
        inner[first] = False
        used = np.zeros(len(found), bool)
        used[word[inner]] = True
        place = np.full(len(found), -1)
        place[used] = self.places([p for p, u in zip(found, used.tolist()) if u], " ")
        heads, of = np.unique(word[first], return_inverse=True)
        lead = self.places([found[k] for k in heads.tolist()], "")[of]
        at = place[word]
        odd = np.logical_or.reduceat((at < 0) & inner, first) if len(first) else np.empty(0, bool)
        odd |= np.array([found[k] != found[k].rstrip() for k in heads.tolist()], bool)[of]
        at[first] = lead
        size, start, flat = self.size[at], self.start[at], self.flat
        again = np.flatnonzero(odd)
        if len(again):  # the whole text takes the place of its head
            whole = [SAFE_CUT.split(texts[k].as_py()) for k in again.tolist()]
            ids, n = self.of([p if i == 0 else " " + p for w in whole for i, p in enumerate(w)])
            n = np.add.reduceat(n, np.cumsum([0, *map(len, whole[:-1])]))
            size[np.repeat(odd, np.diff(edge))] = 0
            size[first[again]], start[first[again]] = n, len(flat) + np.cumsum(n) - n
            flat = np.concatenate([flat, ids])
        return ragged(flat, start, size), np.concatenate([[0], np.cumsum(size)[edge[1:] - 1]]) if len(first) else np.zeros(1, np.int64)


_ENCODERS: dict[tuple[str, str], Encoder] = {}
_BYTES: dict[str, list[bytes]] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """This process's encoder for a rank file."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(load_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def token_bytes(path: str) -> list[bytes]:
    """Bytes of each id."""
    if path not in _BYTES:
        ranks = load_ranks(path)
        table = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            table[r] = t
        _BYTES[path] = table
    return _BYTES[path]


def id_bytes(flat: np.ndarray, edge: np.ndarray) -> pa.Array:
    """Ids end to end as a binary column of one value for each text."""
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat, "<u4"))])


def decoded(ids: bytes | None, table: list[bytes]) -> bytes | None:
    return None if ids is None else b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), back: bool = False) -> DataFrame:
    """(id, ids binary) and the columns named in keep, one row for each row of docs; with back also decoded binary.

    ids holds little-endian unsigned 32-bit integers, decoded the bytes that these ids stand for. A null text
    counts as empty and gives no ids. Rows stay apart, so repeated rows give repeated results; an empty
    table gives none. Long texts and long runs without a cut take the heap path, whose cost is n log n.
    """
    ship(docs.sparkSession)
    names = [id_col, *keep]
    more = ["ids", "decoded"] if back else ["ids"]
    schema = T.StructType([*[T.StructField(n, docs.schema[n].dataType) for n in names], *[T.StructField(n, T.BinaryType()) for n in more]])

    def run(batches):
        gc.disable()  # nothing here makes cycles, and full collections walk every list of pieces
        enc, table = encoder(path, pattern), token_bytes(path) if back else []
        for b in batches:
            texts = b.column(len(names))
            for i, j in some(texts):
                flat, edge = enc.encode(texts.slice(i, j - i))
                made = [id_bytes(flat, edge)]
                if back:
                    made.append(pa.array([decoded(x, table) for x in made[0].to_pylist()], pa.binary()))
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns[: len(names)], *made], names=[*names, *more])
        enc.forget()

    return only(docs, *names, text_col).mapInArrow(tidied(run), schema)


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The same rows with decoded binary: the bytes of the ids. A null stays null."""
    ship(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())])
    place = rows.columns.index(ids_col)

    def run(batches):
        table = token_bytes(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([decoded(x, table) for x in b.column(place).to_pylist()], pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def id_array(ids):
    """Number of ids in a binary column of ids."""
    return (F.octet_length(ids) / 4).cast("long")
