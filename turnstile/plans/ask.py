"""Derivability of a whole batch of sequents in one plan.

Members that cannot be compound stay in the JVM; only sequents with compound members pass through the
projection, a function of Arrow batches. Leaves are judged by joins, and one grouped
aggregation asks whether all leaves of a query hold.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.functions import columns as C
from turnstile.functions import formula
from turnstile.operators.axioms import judged
from turnstile.operators.base import Base
from turnstile.shipping import ship

#: Atomic sequents that are sent on at once.
CHUNK = 10_000


def leaves(queries: DataFrame) -> DataFrame:
    """(qid, g, d, error): a row for each atomic sequent of each query; one with null sides if there is none.

    Atomic sequents are sent on as they are found, however many a query has.
    """
    ship(queries.sparkSession)
    schema = T.StructType([queries.schema["qid"], T.StructField("g", T.ArrayType(T.StringType())), T.StructField("d", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])

    def found(antecedent, consequent):
        try:
            n = 0
            for n, (g, d) in enumerate(formula.project(antecedent or (), consequent or ()), 1):
                yield sorted(g), sorted(d), None
            if not n:
                yield None, None, None
        except formula.Malformed as e:
            yield None, None, str(e)

    def run(batches):
        for b in batches:
            of, rows = [], []
            for k, (a, c) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                for leaf in found(a, c):
                    of.append(k)
                    rows.append(leaf)
                    if len(rows) >= CHUNK:
                        yield sent(b, of, rows)
                        of, rows = [], []
            if rows:
                yield sent(b, of, rows)

    def sent(b, of, rows):
        kinds = [pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=schema.names)

    own = queries.select("qid", C.canonical(F.transform("antecedent", C.stripped)).alias("a"), C.canonical(F.transform("consequent", C.stripped)).alias("c"))
    maybe = F.exists(F.concat("a", "c"), lambda x: x.rlike(C.MAYBE_COMPOUND) | (x == ""))
    plain = own.where(~maybe).select("qid", F.col("a").alias("g"), F.col("c").alias("d"), F.lit(None).cast("string").alias("error"))
    return plain.unionByName(own.where(maybe).mapInArrow(run, schema))


def ask(queries: DataFrame, base: Base) -> DataFrame:
    """(qid, derivable, error) for queries (qid, antecedent array, consequent array).

    A sequent with a member that cannot be read has an error and no answer. Queries of one qid are one query.
    """
    seen = judged(leaves(queries), base)
    ok = F.when(F.col("g").isNull(), True).otherwise(F.coalesce("holds", F.lit(False)))
    out = seen.groupBy("qid").agg(F.bool_and(ok).alias("ok"), F.max("error").alias("error"))
    return out.select("qid", F.when(F.col("error").isNull(), F.col("ok")).alias("derivable"), "error")


def ask_texts(lines: DataFrame, base: Base) -> DataFrame:
    """(qid, derivable, error) for lines (qid, value) such as 'A, B => C'. Lines without => have an error."""
    sides = F.split("value", "=>", 2)
    rows = lines.select("qid", F.col("value").contains("=>").alias("fine"), C.split_members(sides[0]).alias("antecedent"), C.split_members(F.get(sides, F.lit(1))).alias("consequent"))
    good = ask(rows.where("fine"), base)
    bad = rows.where("not fine").select("qid", F.lit(None).cast("boolean").alias("derivable"), F.lit('Invalid sequent: expected "A, B => C, D"').alias("error"))
    return good.unionByName(bad)


def exit_code(answers: DataFrame) -> DataFrame:
    """One row (exit_code): 1 if any query had an error, else 2 if any is not derivable, else 0."""
    return answers.agg(F.when(F.coalesce(F.bool_or(F.col("error").isNotNull()), F.lit(False)), 1).when(F.coalesce(F.bool_or(~F.col("derivable")), F.lit(False)), 2).otherwise(0).alias("exit_code"))
