"""SimHash near-dedup by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance of two
such vectors never exceeds the Hamming distance of the fingerprints, so a range join under it misses no
link. The grid: the segments are dealt into m groups; of two vectors at distance 4 or less at least m - 4
groups agree wholly, so each choice of m - 4 groups gives a cell that they share. Within a cell pairs are
filtered by the Manhattan distance and then verified by the Hamming distance.

Only distinct fingerprints take part, so exact copies cost nothing. Cells beyond BLOCK members are split
into blocks, and every pair of blocks is a group of its own; a group keeps a spanning forest of its
links, not all of them, which loses no component.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm.common import components, local_components, only, raw_texts, ship, sliced, stored, tidied

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Members of a cell (or of each of two blocks) that one task holds.
BLOCK = 4096
#: Bits of the low and the high place of every two-bit segment, and of four-bit lanes.
LOW, HIGH = 0x5555555555555555, 0xAAAAAAAAAAAAAAAA
LANES, LANE_ONE, LANE_FOUR = 0x3333333333333333, 0x1111111111111111, 0x4444444444444444


def fingerprint(tokens: list[bytes], shingle: int = SHINGLE) -> int:
    """SimHash of the shingles of some words, repeats included; a bit is set if over half of the hashes have it."""
    if not tokens:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(tokens) <= shingle:
        return hashed(b" ".join(tokens), SEED)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(tokens) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    n, ones = len(starts), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        h = np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)])), np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """(id, fp long) of every row, with hashed also text_hash, Spark's xxhash64 of the text; a null or blank text has fingerprint 0."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    more = ["text_hash"] if hashed else []

    def run(batches):
        for b in sliced(batches, 1):
            fps = np.array([fingerprint(t.lower().split()) for t in raw_texts(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], names=[id_col, "fp", *more])

    own = only(docs, id_col, text_col).select("*", *[F.xxhash64(F.col(f"`{text_col}`")).alias(m) for m in more])
    return own.mapInArrow(tidied(run), T.StructType([T.StructField(id_col, kind), *[T.StructField(n, T.LongType()) for n in ("fp", *more)]]))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def masks(groups: int, radius: int = RADIUS) -> list[int]:
    """For every choice of groups - radius groups of segments, the bits that they cover."""
    cut = [32 * g // groups for g in range(groups + 1)]
    of = [sum(3 << 2 * s for s in range(cut[g], cut[g + 1])) for g in range(groups)]
    return [sum(of[g] for g in c) for c in combinations(range(groups), groups - radius)]


def groups_for(n: int) -> int:
    """How finely to cut: the more fingerprints, the more bits a cell fixes, so that cells stay small. Every choice is exact."""
    groups = RADIUS + 2
    while 64 * (groups - RADIUS) / groups < np.log2(max(n, 1)) and groups < 32:
        groups += 1
    return groups


def embedded(fp):
    """The 32 segment counts of a fingerprint, two bits each, in one long."""
    low = fp.bitwiseXOR(F.shiftrightunsigned(fp, 1)).bitwiseAND(F.lit(signed(LOW)))
    high = fp.bitwiseAND(F.shiftleft(fp, 1)).bitwiseAND(F.lit(signed(HIGH)))
    return low.bitwiseOR(high)


def counts_of(fp: np.ndarray) -> np.ndarray:
    one = np.uint64(1)
    return ((fp ^ (fp >> one)) & np.uint64(LOW)) | (fp & (fp << one) & np.uint64(HIGH))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of |a - b| over packed two-bit counts, both halves of the segments in lanes of four bits."""
    total = np.zeros(np.broadcast(a, b).shape, np.uint8)
    for shift in (0, 2):
        d = (((a >> np.uint64(shift)) & np.uint64(LANES)) | np.uint64(LANE_FOUR)) - ((b >> np.uint64(shift)) & np.uint64(LANES))
        odd = d & np.uint64(LANE_ONE)
        two = (d >> np.uint64(1)) & ~d & np.uint64(LANE_ONE)
        total += np.bitwise_count(odd) + 2 * np.bitwise_count(two)
    return total


def close(f: np.ndarray, g: np.ndarray, cf: np.ndarray, cg: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs link: the Manhattan bound first, the Hamming distance of those that pass it."""
    ok = manhattan(cf, cg) <= radius
    ok &= np.bitwise_count(f ^ g) <= radius
    return ok


def linked_large(f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what a large cell joins: pivots against all, then what stays outside the largest part.

    A row within reach of a pivot needs no other link to rows of the same component, so a dense
    group costs a few passes instead of all its pairs.
    """
    c, n = counts_of(f), len(f)
    covered, pivots, a, b = np.zeros(n, bool), np.zeros(n, bool), [], []
    for p in range(n):
        if not covered[p]:
            near = np.flatnonzero(close(f[p], f, c[p], c, radius))
            covered[near] = pivots[p] = True
            near = near[near != p]
            a.append(np.full(len(near), p))
            b.append(near)
    x, y = np.concatenate(a), np.concatenate(b)
    nodes, root = local_components(np.concatenate([x, np.arange(n)]), np.concatenate([y, np.arange(n)]))
    largest = np.bincount(root).argmax()
    for p in np.flatnonzero((root != largest) & ~pivots):
        near = np.flatnonzero(close(f[p], f, c[p], c, radius))
        near = near[near != p]
        x, y = np.concatenate([x, np.full(len(near), p)]), np.concatenate([y, near])
    return f[x], f[y]


def cell_links(batches, radius: int):
    """Spanning stars (a, b) of the links within each cell of a batch."""
    for batch in batches:
        lists = batch.column(0)
        flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        off = lists.offsets.to_numpy()
        size, a, b = np.diff(off), [], []
        for n in np.unique(size):
            if n < 2:
                continue
            rows = off[:-1][size == n]
            if n > 512:
                for r in rows:
                    x, y = linked_large(flat[r : r + n], radius)
                    a.append(x)
                    b.append(y)
                continue
            i, j = np.triu_indices(n, 1)
            for k in range(0, len(rows), step := max(1, 1_000_000 // len(i))):
                m = flat[rows[k : k + step, None] + np.arange(n)]
                c = counts_of(m)
                ok = close(m[:, i], m[:, j], c[:, i], c[:, j], radius)
                r, q = np.nonzero(ok)
                a.append(m[r, i[q]])
                b.append(m[r, j[q]])
        if a and sum(map(len, a)):
            nodes, root = local_components(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))
            keep = nodes != root
            yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep])], names=["a", "b"])


def links(fps: DataFrame, radius: int = RADIUS, groups: int | None = None, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect whatever fingerprints (fp, distinct) link at radius or fewer differing bits."""
    spark = fps.sparkSession
    ship(spark)
    groups = groups or groups_for(fps.count())
    count = embedded(F.col("fp"))
    cells = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), count.bitwiseAND(F.lit(signed(m))).alias("cell")) for i, m in enumerate(masks(groups, radius))])).alias("c")).select("c.part", "c.cell", "fp")
    hot = cells.groupBy("part", "cell").count().where(F.col("count") > block).select("part", "cell", F.ceil(F.col("count") / block).cast("int").alias("k"))
    hot, _ = stored(hot, "simhash-hot")  # apart, so that Spark can broadcast it or split the rows of a hot cell
    dealt = cells.join(hot, ["part", "cell"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    members = dealt.groupBy("part", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    return members.select("members").mapInArrow(lambda it: cell_links(it, radius), "a long, b long").distinct()


def rooted(rows: DataFrame, least, radius: int) -> DataFrame:
    """(fp, least, root) of every fingerprint of rows: an aggregate of its rows, and the least fingerprint of its component."""
    fps = rows.groupBy("fp").agg(least.alias("least"))
    roots = components(links(fps.select("fp"), radius), "simhash-edges")
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp long, component_id) of every row.

    Component: fingerprints at radius or fewer differing bits, transitively; its id is the least document
    id in it. A null, empty or blank text has fingerprint 0 and links like any other. Repeated rows and
    ties give equal rows. A row without an id takes part and is never the least unless it is alone (then
    its component id is null). An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows, _ = stored(fingerprints(docs, id_col, text_col), "simhash")
    # tables of their own, so that Spark can split the partition of a large component
    nodes, _ = stored(rooted(rows, F.min(id_col), radius), "simhash-nodes")
    least, _ = stored(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    named = nodes.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(id_col, "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of docs, one of each component: that of the least id, of rows with that id the one whose text hashes least.

    A row without an id stays only if no row of its component has one. Of rows equal in id and text one stays.
    """
    rows, _ = stored(fingerprints(docs, id_col, text_col, hashed=True), "simhash")
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("text_hash").alias("hash")))
    keep = rooted(rows, first, radius).groupBy("root").agg(F.min("least").alias("least"))
    keep = keep.select(F.col("least.id").alias("_keep"), F.col("least.hash").alias("_hash"))
    kept = docs.join(keep, docs[id_col].eqNullSafe(keep["_keep"]) & (F.xxhash64(docs[text_col]) == keep["_hash"]), "left_semi")
    return kept.dropDuplicates([id_col, text_col])


def hex_fingerprint(fp):
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
