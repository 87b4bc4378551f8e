"""Column expressions over sentences, sets of sentences and atoms of ontologies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an assertion about individuals looks like, in Unicode words.
CONCEPT, ROLE = r"(?U)^(\w+)\((\w+)\)$", r"(?U)^(\w+)\((\w+)\s*,\s*(\w+)\)$"
ASSERTION = r"(?U)^\w+\(\w+(\s*,\s*\w+)?\)$"
#: Texts that may be compound, or an atom in parentheses; others are atoms as they stand.
MAYBE_COMPOUND = r"[&|~]|->|^\s*\("
EMPTY = "cast(array() as array<string>)"


def canonical(texts: Column) -> Column:
    """A set of texts as a sorted array, so that equal sets are equal values; null counts as the empty set."""
    return F.coalesce(F.array_sort(F.array_distinct(texts)), F.expr(EMPTY))


def split_members(text: Column) -> Column:
    """Members of a comma-separated side; commas inside parentheses do not separate."""
    deep = F.regexp_replace(text, r",(?=[^()]*\))", "\u0001")
    parts = F.transform(F.split(deep, ","), lambda x: F.trim(F.regexp_replace(x, "\u0001", ",")))
    return canonical(F.filter(parts, lambda x: x != ""))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def atom_struct(text: Column) -> Column:
    """(kind, pred, arg1, arg2) of an assertion; null if it is none. The text is matched once and then cut."""
    bare = F.when(text.rlike(r"(?U)^\s|\s$"), stripped(text)).otherwise(text)
    inner = F.substring_index(F.substring_index(bare, "(", -1), ")", 1)
    two = inner.contains(",")
    arg = lambda x: F.when(x.rlike(r"(?U)\s"), stripped(x)).otherwise(x)
    made = F.struct(
        F.when(two, "role").otherwise("concept").alias("kind"), F.substring_index(bare, "(", 1).alias("pred"),
        F.when(two, arg(F.substring_index(inner, ",", 1))).otherwise(inner).alias("arg1"), F.when(two, arg(F.substring_index(inner, ",", -1))).alias("arg2"),
    )
    return F.when(bare.rlike(ASSERTION), made)


def concept_text(pred: Column, arg: Column) -> Column:
    return F.concat(pred, F.lit("("), arg, F.lit(")"))


def role_text(pred: Column, arg1: Column, arg2: Column) -> Column:
    return F.concat(pred, F.lit("("), arg1, F.lit(","), arg2, F.lit(")"))


def show_set(texts: Column) -> Column:
    """Sorted, comma-joined; the empty-set sign for none."""
    return F.when(F.size(texts) == 0, "∅").otherwise(F.array_join(F.array_sort(texts), ", "))


def schema_pattern(kind: Column, arg1: Column, arg2: Column, braces: bool = True) -> Column:
    """A schema as text; arg1 is an array."""
    one = arg1[0]
    o, c = ("{", "}") if braces else ("", "")
    cat = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    return (
        F.when(kind == "subClassOf", cat(o, one, "(x)", c, " |~ ", o, arg2, "(x)", c))
        .when(kind == "range", cat(o, one, "(x,y)", c, " |~ ", o, arg2, "(y)", c))
        .when(kind == "domain", cat(o, one, "(x,y)", c, " |~ ", o, arg2, "(x)", c))
        .when(kind == "subPropertyOf", cat(o, one, "(x,y)", c, " |~ ", o, arg2, "(x,y)", c))
        .when(kind == "disjointWith", cat(o, one, "(x), ", arg2, "(x)", c, " |~"))
        .when(kind == "disjointProperties", cat(o, one, "(x,y), ", arg2, "(x,y)", c, " |~"))
        .when(kind == "jointCommitment", cat(o, F.array_join(F.transform(arg1, lambda x: F.concat(x, F.lit("(x)"))), ", "), c, " |~ ", o, arg2, "(x)", c))
        .otherwise(cat(F.array_join(arg1, ","), " -> ", arg2))
    )
