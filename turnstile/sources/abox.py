"""Assertions about individuals, read off relational tables.

(pred, arg) for concepts and (pred, arg1, arg2) for roles; SQL of the same views is kept beside them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.functions import columns as C

#: Concepts: (table, name, individual, condition) as SQL that Spark and DuckDB both read.
CONCEPTS = [
    ("customer", "concat('Seg', c_mktsegment)", "concat('c', c_custkey)", "true"),
    ("customer", "'Debtor'", "concat('c', c_custkey)", "c_acctbal < 0"),
    ("customer", "'Wealthy'", "concat('c', c_custkey)", "c_acctbal > 8000"),
    ("orders", "concat('Status', o_orderstatus)", "concat('o', o_orderkey)", "true"),
    ("orders", "'Urgent'", "concat('o', o_orderkey)", "o_orderpriority = '1-URGENT'"),
    ("part", "concat('Type', replace(p_type, ' ', '_'))", "concat('p', p_partkey)", "true"),
    ("events", "concat('did', event_type)", "concat('u', user_id)", "true"),
    ("labels", "concat('Quality', quality)", "concat('d', doc_id)", "true"),
    ("labels", "concat('Toxic', toxic)", "concat('d', doc_id)", "true"),
]
ROLES = [
    ("orders", "'placed'", "concat('c', o_custkey)", "concat('o', o_orderkey)", "true"),
    ("customer", "'inNation'", "concat('c', c_custkey)", "concat('n', c_nationkey)", "true"),
    ("nation", "'inRegion'", "concat('n', n_nationkey)", "concat('r', n_regionkey)", "true"),
    ("lineitem", "'contains'", "concat('o', l_orderkey)", "concat('p', l_partkey)", "true"),
    ("lineitem", "'supplies'", "concat('s', l_suppkey)", "concat('p', l_partkey)", "true"),
    ("lineitem", "'returned'", "concat('o', l_orderkey)", "concat('p', l_partkey)", "l_returnflag = 'R'"),
    ("lineitem", "'accepted'", "concat('o', l_orderkey)", "concat('p', l_partkey)", "l_returnflag = 'A'"),
]


def scanned(spark: SparkSession, sf_dir: str, facts: list[tuple], names: list[str], tables: tuple[str, ...]) -> DataFrame:
    """The facts of the tables named, or of all, as distinct rows; each table is read once."""
    made = []
    for t in dict.fromkeys(f[0] for f in facts):
        if not tables or t in tables:
            rows = [F.expr(f"CASE WHEN {cond} THEN struct({', '.join(f'{x} AS {n}' for x, n in zip(values, names))}) END") for own, *values, cond in facts if own == t]
            made.append(spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.inline(F.array_compact(F.array(*rows)))))
    return reduce(DataFrame.unionByName, made).distinct()


def concepts(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    """(pred, arg) of the tables named, or of all."""
    return scanned(spark, sf_dir, CONCEPTS, ["pred", "arg"], tables)


def roles(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    """(pred, arg1, arg2) of the tables named, or of all."""
    return scanned(spark, sf_dir, ROLES, ["pred", "arg1", "arg2"], tables)


def concepts_sql(*tables: str) -> str:
    return " UNION ".join(f"SELECT {name} AS pred, {who} AS arg FROM {t} WHERE {cond}" for t, name, who, cond in CONCEPTS if not tables or t in tables)


def roles_sql(*tables: str) -> str:
    return " UNION ".join(f"SELECT {name} AS pred, {a} AS arg1, {b} AS arg2 FROM {t} WHERE {cond}" for t, name, a, b, cond in ROLES if not tables or t in tables)


def members(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    """(who, texts): all concept assertions of each individual of the tables, as the set that a sequent needs."""
    return concepts(spark, sf_dir, *tables).groupBy(F.col("arg").alias("who")).agg(F.array_sort(F.collect_list(C.concept_text(F.col("pred"), F.col("arg")))).alias("texts"))
