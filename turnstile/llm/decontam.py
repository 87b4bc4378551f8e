"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

The index stores the postings (term, document, position) of the training tokens that occur in any test
item, in segments sorted by term; a token that no item has is in no match and is never looked up.
A window of an item is looked up by its two rarest terms (by corpus frequency, that is by the length of their
lists): the two lists, shifted by the terms' offsets in the item, are intersected on (document, item,
alignment). What is left is compared word by word, so matches are exact.

Test items are a query set that is given from outside; still they are broadcast only up to
BROADCAST_ROWS rows, counted, and joined by shuffle beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from turnstile.llm.common import only, stored

WINDOW = 13
BROADCAST_ROWS = 200_000
#: The letters that are lower-cased, and what separates words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; a null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATOR), "")


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, hinted for broadcast if a count shows at most limit rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


class PositionalIndex:
    """Postings of docs for the terms of items, and what can be asked of them."""

    def __init__(self, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW):
        self.window = window
        self.docs = only(docs, id_col, text_col).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
        own = only(items, item_col, item_text).select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), word_array(F.col(item_text)).alias("item_words"))
        own, _ = stored(own.where(F.size("item_words") > 0).distinct().withColumn("key", F.xxhash64("item", "item_words")), "test-items")
        self.items = own
        terms = own.select(F.explode("item_words").alias("term")).distinct()
        self.terms, _ = stored(terms.withColumn("term_id", F.monotonically_increasing_id()), "test-terms")
        postings = self.docs.select("doc", F.posexplode(word_array(F.col("text"))).alias("pos", "term")).join(bounded(self.terms), "term").select("term_id", "doc", "pos")
        self.postings, self.path = stored(postings.sortWithinPartitions("term_id"), "postings")

    def frequencies(self) -> DataFrame:
        """Length of each term's list."""
        return self.postings.groupBy("term_id").agg(F.count("*").alias("freq"))

    def windows(self) -> DataFrame:
        """Items with their live windows: (s, q1, q2) for each start, q1 and q2 being the places of the two rarest terms."""
        freq, _ = stored(self.terms.join(bounded(self.frequencies()), "term_id", "left").select("term", "term_id", F.coalesce("freq", F.lit(0)).alias("freq")), "term-frequencies")
        placed = self.items.select("key", F.posexplode("item_words").alias("q", "term")).join(bounded(freq), "term")
        listed = placed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("q", "freq", "term_id"))).alias("at"))
        n = F.size("at")
        length = F.least(n, F.lit(self.window))
        rare = lambda s: F.array_sort(F.transform(F.slice("at", s + 1, length), lambda x: F.struct(x.freq.alias("freq"), x.q.alias("q"))))
        per = F.transform(F.sequence(F.lit(0), n - length), lambda s: F.struct(s.alias("s"), rare(s).alias("r")))
        live = F.filter(per, lambda w: w.r[0].freq > 0)
        listed = listed.select("key", "at", length.alias("length"), F.transform(live, lambda w: F.struct(w.s.alias("s"), w.r[0].q.alias("q1"), F.coalesce(F.get(w.r, F.lit(1)).q, w.r[0].q).alias("q2"))).alias("live"))
        return self.items.join(listed.where(F.size("live") > 0), "key")

    def alignments(self) -> DataFrame:
        """(doc, key, delta): where both rarest terms of some window stand at their offsets."""
        self.live, _ = stored(self.windows(), "live-windows")
        anchors = self.live.select("key", "at", F.explode(F.array_distinct(F.flatten(F.transform("live", lambda w: F.array(w.q1, w.q2))))).alias("q"))
        anchors = anchors.select("key", "q", F.col("at")[F.col("q")].term_id.alias("term_id"))
        hits = self.postings.join(bounded(anchors), "term_id").select("doc", "key", (F.col("pos") - F.col("q")).alias("delta"), "q")
        found = hits.groupBy("doc", "key", "delta").agg(F.collect_set("q").alias("qs"))
        both = F.exists("live", lambda w: F.array_contains("qs", w.q1) & F.array_contains("qs", w.q2))
        return found.join(bounded(self.live.select("key", "live")), "key").where(both).select("doc", "key", "delta")

    def matches(self) -> DataFrame:
        """One row for each document row: (doc, n_words, matches: item, delta, length and starts of its windows that occur)."""
        found = self.alignments().join(bounded(self.live), "key")
        found = found.groupBy("doc").agg(F.collect_list(F.struct("item", "delta", "length", "item_words", F.col("live.s").alias("starts"))).alias("found"))
        rows = self.docs.join(found.withColumnRenamed("doc", "found_doc"), F.col("doc").eqNullSafe(F.col("found_doc")), "left")
        rows = rows.select("doc", word_array(F.col("text")).alias("own"), "found")
        same = lambda c, s: (c.delta + s >= 0) & (F.slice("own", F.greatest(c.delta + s, F.lit(0)) + 1, c.length) == F.slice(c.item_words, s + 1, c.length))
        exact = F.transform("found", lambda c: F.struct(c["item"].alias("item"), c.delta.alias("delta"), c.length.alias("length"), F.filter(c.starts, lambda s: same(c, s)).alias("starts")))
        return rows.select("doc", F.size("own").cast("long").alias("n_words"), F.coalesce(F.filter(exact, lambda m: F.size(m.starts) > 0), F.array()).alias("matches"))

    def near(self, within: int) -> DataFrame:
        """(doc, item, distance): where the two rarest terms of an item stand at most within words apart, the least distance.

        Each document's two lists are merged in order of position, so neighbours alone are compared.
        """
        freq = self.terms.join(self.frequencies(), "term_id").select("term", "term_id", "freq")
        ranked = self.items.select("key", "item", F.explode(F.array_distinct("item_words")).alias("term")).join(freq, "term")
        ranked = ranked.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("freq", "term"))).where("r <= 2").select("key", "item", "term_id", "r")
        own = W.partitionBy("doc", "key").orderBy("pos")
        seen = self.postings.join(bounded(ranked), "term_id").withColumn("gap", F.when(F.lag("r").over(own) != F.col("r"), F.col("pos") - F.lag("pos").over(own)))
        return seen.where(F.col("gap") <= within).groupBy("doc", "item").agg(F.min("gap").cast("int").alias("distance"))


def decontamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_hit, items array, contaminated), one row for each row of docs.

    n_hit counts the words inside any occurrence of a window of an item. A null or empty text has no
    words; items without words have no window; an item without an id counts under the empty id.
    Repeated rows give repeated results; repeated items count once. Empty tables give no hits or no rows.
    """
    found = PositionalIndex(docs, items, id_col, text_col, item_col, item_text, window).matches()
    spans = F.array_sort(F.flatten(F.transform("matches", lambda m: F.transform(m.starts, lambda s: F.struct((m.delta + s).cast("long").alias("a"), (m.delta + s + m.length).cast("long").alias("b"))))))
    none = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("upto"))  # words hit so far, and up to where
    merged = F.aggregate(spans, none, lambda acc, x: F.struct((acc.hit + F.greatest(F.lit(0).cast("long"), x.b - F.greatest(x.a, acc.upto))).alias("hit"), F.greatest(acc.upto, x.b).alias("upto")))
    hit = F.when(F.size("matches") == 0, F.lit(0).cast("long")).otherwise(merged["hit"])
    rows = found.select(F.col("doc").alias(id_col), "n_words", hit.alias("n_hit"), F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"]))).alias("items"))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated. Each row is judged on its own text; equal rows go together."""
    row = lambda: F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    own = docs.select(row().alias("_row"), F.col(f"`{text_col}`").alias("_words"))
    bad = decontamination(own, items, "_row", "_words", "item_id", "text").where("contaminated").select(F.col("_row").alias("_bad")).distinct()
    return docs.join(bad, row() == F.col("_bad"), "left_anti")
