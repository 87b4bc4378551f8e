"""Axioms as joins: which atomic sequents (g, d) hold at once.

Containment is a filter. A base consequence is an equality of both sides, so an equi-join on canonical arrays.
A schema is an equality of predicates once the individuals fit, so a sequent has a key for each schema form
that its shape allows (at most two), and all schemas are one table of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.functions import columns as C
from turnstile.operators.base import Base, bounded


def contained() -> Column:
    return F.arrays_overlap("g", "d")


def key(kind: str, preds: Column, target: Column) -> Column:
    return F.concat(F.array(F.lit(kind)), preds, F.array(F.lit(">"), target))


def schema_keys(base: Base) -> DataFrame:
    """One row for each distinct key of the schemas; pairs of disjoint names are unordered, joint ones are sets."""
    t, a, b = F.col("type"), F.col("arg1"), F.col("arg2")
    one = F.array(a[0])
    pair = F.array_sort(F.array(a[0], b))
    none = F.lit("")
    keyed = (
        F.when(t.isin("subClassOf", "range", "domain", "subPropertyOf"), F.concat(F.array(t), one, F.array(F.lit(">"), b)))
        .when(t.isin("disjointWith", "disjointProperties"), F.concat(F.array(t), pair, F.array(F.lit(">"), none)))
        .when(t == "jointCommitment", key("jointCommitment", F.array_sort(F.array_distinct(a)), b))
    )
    return base.schemas.select(keyed.alias("key")).where("key is not null").distinct()


def leaf_keys(leaves: DataFrame) -> DataFrame:
    """leaves with key1 and key2: the schemas that would make a sequent hold, by its shape; null if none could."""
    ga, da = F.transform("g", C.atom_struct), F.transform("d", C.atom_struct)
    x, y, z = F.get("ga", F.lit(0)), F.get("ga", F.lit(1)), F.get("da", F.lit(0))
    ng, nd = F.size("g"), F.size("d")
    concept, role = lambda a: a.kind == "concept", lambda a: a.kind == "role"
    one = F.array(x.pred)
    pair = F.array_sort(F.array(x.pred, y.pred))
    joint = F.forall("ga", lambda a: a.isNotNull() & (a.kind == "concept") & (a.arg1 == z.arg1))
    single = (ng == 1) & (nd == 1)
    key1 = (
        F.when(single & concept(x) & concept(z) & (x.arg1 == z.arg1), key("subClassOf", one, z.pred))
        .when(single & role(x) & concept(z) & (x.arg2 == z.arg1), key("range", one, z.pred))
        .when(single & role(x) & role(z) & (x.arg1 == z.arg1) & (x.arg2 == z.arg2), key("subPropertyOf", one, z.pred))
        .when((ng == 2) & (nd == 0) & concept(x) & concept(y) & (x.arg1 == y.arg1), key("disjointWith", pair, F.lit("")))
        .when((ng == 2) & (nd == 0) & role(x) & role(y) & (x.arg1 == y.arg1) & (x.arg2 == y.arg2), key("disjointProperties", pair, F.lit("")))
        .when((ng >= 2) & (nd == 1) & concept(z) & joint, key("jointCommitment", F.array_sort(F.array_distinct(F.transform("ga", lambda a: a.pred))), z.pred))
    )
    key2 = F.when(single & role(x) & concept(z) & (x.arg1 == z.arg1), key("domain", one, z.pred))
    return leaves.withColumns({"ga": ga, "da": da}).withColumns({"key1": key1, "key2": key2}).drop("ga", "da")


def judged(leaves: DataFrame, base: Base) -> DataFrame:
    """leaves (g, d canonical, and more columns) with holds: whether each is an axiom of the base."""
    rules = base.consequences.select(C.canonical(F.transform("antecedent", unparenthesised)).alias("g"), C.canonical(F.transform("consequent", unparenthesised)).alias("d")).distinct().withColumn("_rule", F.lit(True))
    out = leaves.join(bounded(rules), ["g", "d"], "left")
    holds = contained() | F.coalesce("_rule", F.lit(False))
    extra = ["_rule"]
    if base.onto:
        keys, kinds = schema_keys(base), {r.type for r in base.schemas.select("type").distinct().collect()}
        used = [k for k, own in (("key1", kinds - {"domain"}), ("key2", kinds & {"domain"})) if own]  # schemas of no other kind: no join
        out = leaf_keys(out) if used else out
        if used:
            out = out.drop(*{"key1", "key2"}.difference(used))
        for k in used:
            out = out.join(bounded(keys.select(F.col("key").alias(k), F.lit(True).alias(f"_{k}"))), k, "left")
            holds = holds | F.coalesce(f"_{k}", F.lit(False))
            extra += [k, f"_{k}"]
    for i, provider in enumerate(base.providers):
        more = provider(leaves.select("g", "d").distinct()).select("g", "d").distinct().withColumn(f"_p{i}", F.lit(True))
        out = out.join(more, ["g", "d"], "left")
        holds = holds | F.coalesce(f"_p{i}", F.lit(False))
        extra.append(f"_p{i}")
    return out.withColumn("holds", holds).drop(*extra)


def unparenthesised(text: Column) -> Column:
    """A member without white space or simple parentheses around it, as sentences are read."""
    inner = lambda t: F.when(t.startswith("("), C.stripped(F.regexp_replace(t, r"^\(\s*([^()]*(\([^()]*\))?)\s*\)$", "$1"))).otherwise(t)
    # any number of pairs: those that close just after an inner pair go first
    bare = F.when(text.startswith("(("), F.regexp_replace(text, r"^\((?:\(|\s)*([^()]*(?:\([^()]*\))?)(?:\)|\s)*\)$", "$1")).otherwise(text)
    return C.stripped(inner(C.stripped(bare)))
