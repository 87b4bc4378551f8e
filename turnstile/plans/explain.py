"""Explanations of single answers: traces by depth-first search, and proof trees as rows."""

from __future__ import annotations

from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.functions import columns as C
from turnstile.functions import formula
from turnstile.functions.search import proved
from turnstile.operators.axioms import judged
from turnstile.operators.base import Base
from turnstile.plans.ask import CHUNK, leaves
from turnstile.shipping import ship

PROOF = "struct<derivable: boolean, trace: array<string>, depth_reached: int, cache_hits: int, error: string>"


def explain(queries: DataFrame, base: Base, max_depth: int = 25) -> DataFrame:
    """queries (qid, antecedent, consequent) with derivable, trace, depth_reached, cache_hits, error: the search that stops at max_depth.

    The atomic sequents of the queries are judged as for answers, and the search of a query gets those that hold,
    so answers and explanations rest on the same verdicts, providers of axioms included.
    """
    ship(queries.sparkSession)
    held = judged(leaves(queries), base).where("holds").groupBy("qid").agg(F.collect_set(F.struct("g", "d")).alias("_held"))

    def run(a, c, held):
        try:
            axioms = {(frozenset(h["g"]), frozenset(h["d"])) for h in (held if held is not None else ())}
            return (*proved(a if a is not None else (), c if c is not None else (), axioms, max_depth), None)
        except formula.Malformed as e:
            return None, None, None, None, str(e)

    rows = queries.join(held, "qid", "left")
    return rows.withColumn("_p", F.udf(run, PROOF, useArrow=True)("antecedent", "consequent", "_held")).select(*queries.columns, "_p.*")


def trace_lines(queries: DataFrame, base: Base, max_depth: int = 25) -> DataFrame:
    """(qid, step, line) of the search of every query; a query that cannot be read has its error as a line."""
    found = explain(queries, base, max_depth)
    return found.select("qid", F.posexplode(F.coalesce("trace", F.array(F.concat(F.lit("ERROR: "), "error")))).alias("step", "line"))


def proof_tree(queries: DataFrame) -> DataFrame:
    """(qid, level, rule, g, d): the tree that reduces the least compound sentence first, left side before right.

    Rows of rule 'leaf' are atomic. A query's tree needs nothing of the others, so trees come from a function of Arrow
    batches, and rows are sent on as they are found, however many or deep; a sentence that cannot be read stays as it is.
    """
    ship(queries.sparkSession)
    own = queries.select("qid", C.canonical(F.col("antecedent")).alias("g"), C.canonical(F.col("consequent")).alias("d"))
    texts = T.ArrayType(T.StringType())
    schema = T.StructType([own.schema["qid"], T.StructField("level", T.IntegerType()), T.StructField("rule", T.StringType()), T.StructField("g", texts), T.StructField("d", texts)])
    kinds = [pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]

    def run(batches):
        for b in batches:
            nodes = ((k, *node) for k, (g, d) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())) for node in formula.tree(g, d))
            for some in batched(nodes, CHUNK):
                of, *columns = zip(*some)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=schema.names)

    return own.mapInArrow(run, schema)
