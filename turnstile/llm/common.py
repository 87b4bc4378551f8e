"""What the operators share: the shared folder, words, hashing, components."""

from __future__ import annotations

import ast
import ctypes
import functools
import gc
import inspect
import io
import os
import re
import sys
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.shipping import ship

#: Where tables go when the session names no folder (tests on one machine only).
FALLBACK_DIR = "/tmp/checkpoints/turnstile"
#: Spark takes frames that are not read from files to be about so large.
UNKNOWN = 1 << 57


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, on one machine alone, a fallback for tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not re.match(r"local($|\[)", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (at or f"file://{FALLBACK_DIR}").rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    at = fresh(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at), at


def drop_path(spark: SparkSession, at: str) -> None:
    """Remove a table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def total_bytes(df: DataFrame) -> int:
    """Bytes of the files that a frame reads, as Spark's statistics have them; its texts are measured if they do not know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < UNKNOWN:
        return size
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    found = df.agg(F.count("*"), *[F.sum(F.octet_length(F.col(f"`{t}`"))) for t in texts]).first()
    return sum(x or 0 for x in found)


def parts_for(df: DataFrame, mb: int = 16) -> int:
    """How many partitions of about so many MB of stored input."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(200_000, -(-total_bytes(df) // (mb << 20))))


def batches_for(df: DataFrame, mb: int = 8) -> int:
    """How many batches of about so many MB of stored input; depends on the input alone."""
    return max(12, -(-total_bytes(df) // (mb << 20)))


def dealt(df: DataFrame, key: str, batches: int) -> DataFrame:
    """(b, data): the rows of df dealt into batches by a hash of key, packed as compressed Arrow streams.

    Every Arrow batch gives one block for each b, so that the shuffle moves few rows and compressed columns.
    """
    names = df.columns

    def run(incoming):
        for rows in incoming:
            b = rows.column(0).to_numpy()
            order = np.argsort(b.astype(few(batches)), kind="stable")
            own = rows.select(names).take(pa.array(order))
            cut = np.flatnonzero(np.diff(b[order], prepend=-1))
            data = []
            for i, j in zip(cut, np.append(cut[1:], len(order))):
                out = io.BytesIO()
                with pa.ipc.new_stream(out, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_batch(own.slice(i, j - i))
                data.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(b[order][cut], pa.int32()), pa.array(data, pa.binary())], names=["b", "data"])

    return df.select(F.pmod(F.xxhash64(F.col(key)), F.lit(batches)).cast("int").alias("b"), "*").mapInArrow(tidied(run), "b int, data binary")


def undealt(table: pa.Table) -> pa.Table | None:
    """The rows of one batch; None without any."""
    parts = [pa.ipc.open_stream(d).read_all() for d in table.column("data").to_pylist()]
    return pa.concat_tables(parts) if parts else None


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just the columns that an operator needs, so that other columns cannot clash with its own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def some(texts: pa.Array, budget: int = 2_000_000):
    """Slices (start, end) of a text column of about so many bytes, so that what a slice makes stays small."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(size):
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + budget, "right")))
        yield start, end
        start = end


def sliced(batches, column: int):
    """Arrow batches cut into smaller ones by the bytes of a text column, so that what a task holds stays small."""
    for b in batches:
        for i, j in some(b.column(column)):
            yield b.slice(i, j - i)


def raw_texts(texts: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a text column; a null is empty."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def few(n: int) -> type:
    """The type for n small numbers that sorts fastest."""
    return np.uint16 if n <= 1 << 16 else np.int64


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than 0x20 and 0x09-0x0D; Python's bytes.split() cuts at just these."""
    return text_bytes(text).split()


def lower_words(text: str | None) -> list[bytes]:
    """The same of the text with A-Z lower-cased; bytes.lower() leaves other bytes as they are."""
    return text_bytes(text).lower().split()


def tidy() -> None:
    """Give memory back at the end of a task: workers are used again, by other operators too."""
    gc.enable()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def tidied(f):
    """A function of batches or of groups that tidies up when it is done."""

    @functools.wraps(f)
    def batches(rows):
        try:
            yield from f(rows)
        finally:
            tidy()

    def group(*parts):
        try:
            return f(*parts)
        finally:
            tidy()

    if inspect.isgeneratorfunction(f):
        return batches
    # Spark counts the arguments of a group's function
    return {1: lambda rows: group(rows), 2: lambda key, rows: group(key, rows), 3: lambda key, rows, more: group(key, rows, more)}[len(inspect.signature(f).parameters)]


def held_out(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a few edges held in memory, and the least node that each of them reaches."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    lab = np.arange(len(nodes))
    while True:
        low = np.minimum(lab[x], lab[y])
        new = lab.copy()
        for at in (x, y, lab[x], lab[y]):
            np.minimum.at(new, at, low)
        new = new[new]
        if np.array_equal(new, lab):
            return nodes, nodes[lab]
        lab = new


def components(edges: DataFrame, name: str = "edges", rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b) of longs, as rows (node, root): root is the least reachable node.

    Alternates large-star and small-star steps, each a partial-aggregated minimum and an equi-join, until
    no edge changes. Every step is written to the shared folder, so lineage stays short and a lost
    executor costs one step. The minima are tables of their own, so that both sides of a join are plain shuffles,
    whose partitions Spark splits where a node has many neighbours.
    """
    spark = edges.sparkSession
    now, at = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, at_least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large, at_large = stored(large.unionByName(least.where("a <> m").select("a", F.col("m").alias("b"))).distinct(), name)
        low, at_low = stored(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        after, to = stored(small, name)
        sign = after.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        for done in (at, at_least, at_large, at_low):
            drop_path(spark, done)
        now, at = after, to
        if sign == before:
            break
        before = sign
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def filesystem(uri: str):
    """pyarrow's view of a folder that may be a URI or a plain path: (file system, path)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def narrow(a: np.ndarray) -> np.ndarray:
    """The same whole numbers in the least unsigned type that holds them; others as they are."""
    if a.dtype.kind not in "iu" or not len(a) or a.dtype.kind == "i" and a.min() < 0:
        return a
    return a.astype(np.min_scalar_type(a.max()))


def squeeze(*arrays: np.ndarray) -> bytes:
    """A few one-dimensional arrays as one binary value: bytes of equal weight side by side, then zstandard."""
    kept = [narrow(a) for a in arrays]
    head = [(a.dtype.str, k.dtype.str, len(a)) for a, k in zip(arrays, kept)]
    body = b"".join(np.ascontiguousarray(np.ascontiguousarray(k).view(np.uint8).reshape(len(k), -1).T) for k in kept if len(k))
    name = repr(head).encode()
    return len(name).to_bytes(4, "little") + name + zstandard.ZstdCompressor(level=1).compress(body)


def unsqueeze(data: bytes) -> list[np.ndarray]:
    """The arrays back."""
    n = int.from_bytes(data[:4], "little")
    head, body = ast.literal_eval(data[4 : 4 + n].decode()), zstandard.ZstdDecompressor().decompress(data[4 + n :])
    out, at = [], 0
    for kind, stored_as, rows in head:
        width = np.dtype(stored_as).itemsize
        raw = np.empty((rows, width), np.uint8)
        for k in range(width):
            raw[:, k] = np.frombuffer(body, np.uint8, rows, at + k * rows)
        out.append(raw.view(stored_as).ravel().astype(kind, copy=False))
        at += rows * width
    return out
