"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is a run of standard frames, each holding whole ids of one or more documents (a document longer than
a frame continues in the next), then two skippable frames that any zstandard reader passes over: the
document index (ids of the documents and their token counts) and the seek table, which lists for every
frame its stored size, its plain size and the low 32 bits of the XXH64 of its plain bytes, and ends with
a footer of fixed size. A reader takes the footer, the table and the index from the end, then reads and
decompresses just the frames that the documents it wants touch.

Each task writes its own files under names that no other attempt uses and returns a manifest row for each
closed file; files of failed attempts are in no manifest and are removed. The manifest has one row for
each file of up to SHARD_TOKENS ids, so it is small enough for the driver.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm.bpe import SAFE_CUT, ragged, some
from turnstile.llm.common import filesystem, fresh, only, parts_for, ship, stored, tidied

#: Fixed values of the public seekable zstandard format, and of skippable frames.
SEEKABLE_MAGIC, SEEK_FRAME, INDEX_FRAME = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
FRAME_BYTES, SHARD_TOKENS, LEVEL = 256 << 10, 64 << 20, 3
#: Bytes of text whose words are encoded at once, and signs that end words.
SLICE, SIGNS = 12_000_000, ".,;:!?"
#: A word of letters alone, of blocks that all versions of the character tables agree on, maybe behind a space; texts of such characters.
LETTERS = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u01ba\u0400-\u0481]+$"
SURE = re.compile("[\t\n -~\u00a0-\u01ba\u0400-\u0481]+")
#: The public byte-level pattern, and letters of its vocabularies: bytes that print stand for themselves, the others follow from U+0100 on.
MATCHES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PRINTS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = np.arange(256, dtype="<u4")
BYTES[np.setdiff1d(np.arange(256), PRINTS)] = 0x100 + np.arange(256 - len(PRINTS))
MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long, n_bytes long, first_id long"


class Writer:
    """One file. Ids are stored in width bytes each; documents are added in order."""

    def __init__(self, out, width: int):
        self.out, self.width, self.kind = out, width, {2: "<u2", 4: "<u4"}[width]
        self.buffer, self.pending, self.frames, self.ids, self.counts = [], 0, [], [], []
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.at = self.n_tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids))
        self.n_tokens += len(ids)
        raw = memoryview(ids.astype(self.kind).tobytes())
        while len(raw):
            part = raw[: FRAME_BYTES - self.pending]
            self.buffer.append(part)
            self.pending += len(part)
            raw = raw[len(part) :]
            if self.pending >= FRAME_BYTES:
                self.flush()

    def flush(self) -> None:
        if self.pending:
            plain = b"".join(self.buffer)
            packed = self.pack.compress(plain)
            self.write(packed)
            self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            self.buffer, self.pending = [], 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> int:
        self.flush()
        null = np.array([x is None for x in self.ids], np.uint8)
        index = self.pack.compress(np.array([x or 0 for x in self.ids], "<i8").tobytes() + null.tobytes() + np.array(self.counts, "<u8").tobytes())
        head = struct.pack("<IQ", self.width, len(self.ids))
        self.write(struct.pack("<II", INDEX_FRAME, len(head) + len(index)) + head + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE_MAGIC)
        self.write(struct.pack("<II", SEEK_FRAME, len(table) + len(footer)) + table + footer)
        self.out.close()
        return self.at


class Reader:
    """Random access to one file: needs an object with size(), seek() and read()."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        source.seek(size - 9 - 12 * n - 8)
        if struct.unpack("<II", source.read(8)) != (SEEK_FRAME, 12 * n + 9):
            raise ValueError("damaged seek table")
        table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sums = table[:, 2]
        self.stored = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.plain = np.concatenate([[0], np.cumsum(table[:, 1])])
        source.seek(int(self.stored[-1]))
        magic, length = struct.unpack("<II", source.read(8))
        self.width, m = struct.unpack("<IQ", source.read(12))
        if magic != INDEX_FRAME:
            raise ValueError("no document index")
        raw = zstandard.ZstdDecompressor().decompress(source.read(length - 12))
        null = np.frombuffer(raw, np.uint8, m, 8 * m)
        self.ids = [None if z else i for i, z in zip(np.frombuffer(raw, "<i8", m).tolist(), null)]
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u8", m, 9 * m).astype(np.int64))])
        self.kept: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        """Plain bytes of a frame, checked against the seek table."""
        if self.kept[0] != k:
            self.source.seek(int(self.stored[k]))
            plain = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.stored[k + 1] - self.stored[k])))
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} does not match its checksum")
            self.kept = k, plain
        return self.kept[1]

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document as unsigned 32-bit integers."""
        low, high = int(self.starts[i]) * self.width, int(self.starts[i + 1]) * self.width
        out = []
        k = int(np.searchsorted(self.plain, low, "right")) - 1
        while low < high:
            plain, base = self.frame(k), int(self.plain[k])
            out.append(plain[low - base : high - base])
            low, k = int(self.plain[k + 1]), k + 1
        return np.frombuffer(b"".join(out), {2: "<u2", 4: "<u4"}[self.width]).astype("<u4")


_TOKENIZERS: dict[str, tuple] = {}


class Whole:
    """Encodes texts as they are, each in one call of the library."""

    def __init__(self, own):
        self.own = own

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(self.own.encode(t or "", add_special_tokens=False).ids, "<u4") for t in texts.to_pylist()]
        return np.concatenate([np.empty(0, "<u4"), *ids]), np.cumsum([0, *map(len, ids)])


class Words:
    """Encodes slices of texts by their distinct words, for files that cut by the byte-level pattern.

    A text is cut at single spaces between other characters, which no match of the pattern crosses. Of the distinct pieces, a
    word of letters alone is one match, and signs behind it are another; other pieces of sure characters are cut by the
    pattern here. The matches go to the library's model in the letters that stand for their bytes. What holds characters
    that tables of letters may differ on, or an added token, takes the library's whole way.
    """

    def __init__(self, own):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.own, self.bare = own, Tokenizer(own.model)
        self.bare.pre_tokenizer = CharDelimiterSplit("\n")
        vocabulary = own.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.width[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.added = [t.content for t in own.get_added_tokens_decoder().values()]

    @staticmethod
    def fits(own) -> bool:
        """Whether a file cuts by the byte-level pattern alone, and its added tokens stay within pieces and hold more than letters."""
        from tokenizers.pre_tokenizers import ByteLevel

        state = json.loads(own.to_str())
        bytewise = isinstance(own.pre_tokenizer, ByteLevel) and state["pre_tokenizer"].get("use_regex") and not state["pre_tokenizer"].get("add_prefix_space")
        plain = lambda t: not (t.rstrip or t.lstrip or t.content.isalpha() or re.search(rf"[\s{SIGNS}]", t.content))
        return bool(bytewise) and state["normalizer"] is None and all(map(plain, own.get_added_tokens_decoder().values()))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each text's ids begin and the last ends); a null has none."""
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        edge = lists.offsets.to_numpy().astype(np.int64)
        edge -= edge[0]
        coded = lists.flatten().dictionary_encode()
        word, found = coded.indices.to_numpy(), coded.dictionary
        first = edge[:-1]
        inner = np.ones(len(word), bool)
        inner[first] = False
        used = np.zeros(len(found), bool)
        used[word[inner]] = True
        heads, of = np.unique(word[first], return_inverse=True)
        lead, inside = found.take(pa.array(heads)), found.filter(pa.array(used))
        bad = ~pc.and_(pc.equal(pc.utf8_trim_whitespace(inside), inside), pc.greater(pc.binary_length(inside), 0)).to_numpy(zero_copy_only=False)
        late = pc.not_equal(pc.utf8_rtrim_whitespace(lead), lead).to_numpy(zero_copy_only=False)
        flat, size = self.pieces(pa.concat_arrays([pc.binary_join_element_wise("", inside, " "), lead]))
        begin = np.cumsum(size) - size
        place, odd = np.full(len(found), -1), np.zeros(len(found), bool)
        place[used], odd[used] = np.arange(len(inside)), bad
        again = np.flatnonzero(np.logical_or.reduceat(odd[word] & inner, first) | late[of]) if len(first) else first
        at = place[word]
        at[first] = len(inside) + of
        count, start = size[at], begin[at]
        if len(again):  # no safe cut stands beside some piece: the whole text takes the place of its head
            whole = [SAFE_CUT.split(texts[k].as_py()) for k in again.tolist()]
            ids, n = self.pieces(pa.array([p if i == 0 else " " + p for w in whole for i, p in enumerate(w)], pa.string()))
            n = np.add.reduceat(n, np.cumsum([0, *map(len, whole[:-1])]))
            count[np.repeat(np.isin(np.arange(len(first)), again), np.diff(edge))] = 0
            count[first[again]], start[first[again]] = n, len(flat) + np.cumsum(n) - n
            flat = np.concatenate([flat, ids])
        end = np.cumsum(count)
        return ragged(flat, start, count), np.concatenate([[0], end[edge[1:] - 1]]) if len(first) else np.zeros(1, np.int64)

    def pieces(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of some pieces end to end, how many each has)."""
        core = pc.utf8_rtrim(col, SIGNS)
        plain = pc.match_substring_regex(core, LETTERS)
        own = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        core, signed = core.filter(plain).dictionary_encode(), col.filter(plain)
        longer = np.flatnonzero(pc.not_equal(pc.binary_length(core.cast(pa.string())), pc.binary_length(signed)).to_numpy(zero_copy_only=False))
        tail = pc.replace_substring_regex(signed.take(pa.array(longer)), rf"^[^{SIGNS}]+", "").dictionary_encode()
        rest = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        other = col.take(pa.array(rest)).to_pylist()
        sure = [SURE.fullmatch(p) is not None and not any(t in p for t in self.added) for p in other]
        cut = [MATCHES.findall(p) if ok else [] for p, ok in zip(other, sure)]
        number = np.fromiter(map(len, cut), np.int64, len(cut))
        some_matches = pa.array(list(chain.from_iterable(cut)), pa.string()).dictionary_encode()
        flat, size = self.matched(pa.concat_arrays([core.dictionary, tail.dictionary, some_matches.dictionary]))
        entries = np.ones(len(col), np.int64)
        entries[own[longer]] = 2
        entries[rest] = number
        base = np.cumsum(entries) - entries
        entry = np.empty(int(entries.sum()), np.int64)
        entry[base[own]] = core.indices.to_numpy()
        entry[base[own[longer]] + 1] = tail.indices.to_numpy() + len(core.dictionary)
        entry[np.repeat(base[rest] - (np.cumsum(number) - number), number) + np.arange(int(number.sum()))] = some_matches.indices.to_numpy() + len(core.dictionary) + len(tail.dictionary)
        begin = np.cumsum(size) - size
        out = np.zeros(len(col), np.int64)
        np.add.at(out, np.repeat(np.arange(len(col)), entries), size[entry])
        flat = ragged(flat, begin[entry], size[entry])
        unsure = rest[~np.array(sure, bool)] if len(rest) else rest
        if len(unsure):
            ids, n = self.encoded(col.take(pa.array(unsure)).to_pylist())
            start = np.cumsum(out) - out
            out[unsure], start[unsure] = n, len(flat) + np.cumsum(n) - n
            flat = ragged(np.concatenate([flat, ids]), start, out)
        return flat, out

    def matched(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of some matches of the pattern end to end, how many each has), by the model alone."""
        if not len(col):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        edge = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4).astype(np.int64)
        raw, long = np.frombuffer(col.buffers()[2] or b"", np.uint8), np.diff(edge)
        out = []
        for i in range(0, len(col), 20_000):
            size = long[i : i + 20_000]
            letters = np.full(int(size.sum()) + len(size), ord("\n"), "<u4")
            letters[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = BYTES[raw[edge[i] : edge[min(i + 20_000, len(col))]]]
            out.append(np.array(self.bare.encode_batch_fast([letters.tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, "<u4"))
        flat = np.concatenate([np.empty(0, "<u4"), *out])
        end = np.searchsorted(np.cumsum(self.width[flat]), np.cumsum(long)) + 1
        return flat, np.diff(end, prepend=0)

    def encoded(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.own.encode(items, is_pretokenized=True, add_special_tokens=False)
        of = np.array([-1 if w is None else w for w in found.word_ids], np.int64)
        return np.array(found.ids, "<u4"), np.diff(np.searchsorted(of, np.arange(len(items) + 1)))


def library(path: str) -> tuple[Words | Whole, int]:
    """The tokenizers library's encoder of a JSON file, and its largest id.

    Added tokens of the file that a text spells out are met, as the library meets them by default.
    """
    if path not in _TOKENIZERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        _TOKENIZERS[path] = Words(own) if Words.fits(own) else Whole(own), max(own.get_vocab().values())
    return _TOKENIZERS[path]


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text (null: empty), append end_id, and write files in ascending order of id; returns the manifest.

    Ids of null sort first. Rows with one id follow each other in an order fixed by their texts. An empty table
    gives no file. A long document spans frames and is streamed, never held twice.
    """
    import gc

    spark = docs.sparkSession
    ship(spark)
    own = only(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = own.repartitionByRange(parts_for(docs), F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"), "text")

    def run(batches):
        from pyspark import TaskContext

        gc.disable()
        enc, top = library(tokenizer)
        width = 2 if max(top, end_id) < 1 << 16 else 4
        fs, base = filesystem(folder)
        part, seq, own, rows, name = TaskContext.get().partitionId(), 0, None, [], ""
        end = np.array([end_id], "<u4")

        def close():
            size = own.close()
            rows.append((part, seq, name, len(own.ids), own.n_tokens, size, own.ids[0]))

        for b in batches:
            for i, j in some(b.column(1), SLICE):
                rows_now = b.slice(i, j - i)
                flat, edge = enc.encode(rows_now.column(1))
                for k, low, high in zip(rows_now.column(0).to_pylist(), edge[:-1].tolist(), edge[1:].tolist()):
                    if own is not None and own.n_tokens >= SHARD_TOKENS:
                        close()
                        own, seq = None, seq + 1
                    if own is None:
                        fs.create_dir(base, recursive=True)
                        name = f"tokens-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.zst"
                        own = Writer(fs.open_output_stream(f"{base}/{name}", compression=None), width)
                    own.add(k, np.concatenate([flat[low:high], end]))
        if own is not None:
            close()
        if rows:
            columns = list(zip(*rows))
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            names = [f.split()[0] for f in MANIFEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    manifest, _ = stored(dealt.mapInArrow(tidied(run), MANIFEST), "token-manifest")
    return manifest


def remove_strays(manifest: DataFrame, folder: str) -> int:
    """Delete files of failed attempts, which no manifest row names."""
    fs, base = filesystem(folder)
    from pyarrow.fs import FileSelector

    known = {r.path for r in manifest.select("path").collect()}
    stray = [f.path for f in fs.get_file_info(FileSelector(base, allow_not_found=True)) if f.is_file and f.path.rsplit("/", 1)[-1] not in known]
    for f in stray:
        fs.delete_file(f)
    return len(stray)


def read_tokens(manifest: DataFrame, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """(id, start long, ids binary) of the documents in the files, or of the wanted ids alone.

    start counts the ids of all documents before it, across files. Frames outside the wanted documents are
    not read.
    """
    spark = manifest.sparkSession
    ship(spark)
    rows, at = [], 0
    for r in manifest.orderBy("part", "seq").collect():  # one row for each file, see the module's docstring
        rows.append((r.path, at))
        at += r.n_tokens
    files = spark.createDataFrame(rows, "path string, base long").repartition(max(1, min(len(rows), 20_000)), "path")

    def run(batches):
        fs, base = filesystem(folder)
        pick = None if wanted is None else set(wanted)
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_file(f"{base}/{path}") as source:
                    own = Reader(source)
                    some_ids, starts, raw, held = [], [], [], 0
                    for i, doc_id in enumerate(own.ids):
                        if pick is None or doc_id in pick:
                            some_ids.append(doc_id)
                            starts.append(first + int(own.starts[i]))
                            raw.append(own.document(i).tobytes())
                            held += len(raw[-1])
                        if held > 8 << 20 or (i + 1 == len(own.ids) and some_ids):
                            yield pa.RecordBatch.from_arrays([pa.array(some_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(raw, pa.binary())], names=["id", "start", "ids"])
                            some_ids, starts, raw, held = [], [], [], 0

    return files.mapInArrow(tidied(run), "id long, start long, ids binary")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write docs and read them back: (manifest, documents)."""
    folder = folder or fresh(docs.sparkSession, "token-files")
    manifest = write_tokens(docs, tokenizer, folder, end_id)
    remove_strays(manifest, folder)
    return manifest, read_tokens(manifest, folder)
