"""Answers and edits as the lines that a user or a program reads: JSON, text, exit codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.functions import columns as C

INVALID = 'Invalid sequent: expected "A, B => C, D".'


def braces(texts: Column) -> Column:
    """A set in braces, members in order."""
    return F.concat(F.lit("{"), F.array_join(F.array_sort(texts), ", "), F.lit("}"))


def noted(text: Column, note: Column) -> Column:
    return F.when(note.isNotNull(), F.concat(text, F.lit(" — "), note)).otherwise(text)


def either(error: Column, data: Column) -> Column:
    """A JSON line: the error if there is one, else the data; fields without a value are left out."""
    return F.when(error.isNotNull(), F.to_json(F.struct(error.alias("error")))).otherwise(data)


def ask_lines(found: DataFrame, trace: bool = False) -> DataFrame:
    """(qid, json, text, error, code) of explained queries."""
    error, ok = F.col("error"), F.col("derivable")
    status = F.when(ok, "DERIVABLE").otherwise("NOT_DERIVABLE")
    sequent = F.struct(C.canonical(F.col("antecedent")).alias("antecedent"), C.canonical(F.col("consequent")).alias("consequent"))
    data = F.struct(status.alias("status"), sequent.alias("sequent"), "depth_reached", "cache_hits", *["trace"] * trace)
    text = F.translate(status, "_", " ")
    if trace:
        steps = F.array_join(F.transform("trace", lambda t: F.concat(F.lit("  "), t)), "\n")
        text = F.concat(text, F.lit("\n\nProof trace:\n"), steps, F.lit("\n\nDepth reached: "), "depth_reached", F.lit("\nCache hits: "), "cache_hits")
    code = F.when(error.isNotNull(), 1).when(ok, 0).otherwise(2)
    return found.select("qid", either(error, F.to_json(data)).alias("json"), F.when(error.isNull(), text).alias("text"), "error", code.alias("code"))


def tell_lines(statements: DataFrame, path: str) -> DataFrame:
    """(qid, json, text, error, code) of statements: what is said of each when it is applied."""
    error, kind, note = F.col("error"), F.col("kind"), F.col("annotation")
    at = F.lit(path).alias("base_file")
    pattern = C.schema_pattern(F.col("type"), F.col("arg1"), F.col("arg2"))
    atom = F.to_json(F.struct(F.lit("added_atom").alias("action"), "atom", at, "annotation"))
    rule = F.to_json(F.struct(F.lit("added_consequence").alias("action"), F.struct("antecedent", "consequent").alias("consequence"), at))
    schema = F.to_json(F.struct(F.concat(F.lit("registered_"), "type", F.lit("_schema")).alias("action"), pattern.alias("details"), at, "annotation"))
    text = (
        F.when(kind == "atom", noted(F.concat(F.lit("Added atom: "), "atom"), note))
        .when(kind == "consequence", F.concat(F.lit("Added consequence: "), braces(F.col("antecedent")), F.lit(" |~ "), braces(F.col("consequent"))))
        .when(kind == "schema", noted(F.concat(F.lit("Registered "), "type", F.lit(" schema: "), pattern), note))
    )
    data = F.when(kind == "atom", atom).when(kind == "consequence", rule).otherwise(schema)
    return statements.select("qid", either(error, data).alias("json"), F.when(error.isNull(), text).alias("text"), "error", F.when(error.isNotNull(), 1).otherwise(0).alias("code"))
