"""Bases in JSON files, and statements and queries as lines of text."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile import model
from turnstile.functions import columns as C
from turnstile.operators.base import Base, check_member
from turnstile.shipping import ship

TABLES = ["language", "consequences", "annotations", "schemas"]


def from_frame(spark: SparkSession, file: DataFrame, onto: bool) -> Base:
    """A base of a frame with the file's schema; missing parts are empty, names of a vocabulary are not read."""
    base = Base(spark, onto=onto)
    language = file.select(F.explode("language").alias("atom"))
    rules = file.select(F.inline("consequences"))
    rules = rules.select(*[C.canonical(F.col(c)).alias(c) for c in ("antecedent", "consequent")])
    bad = base.rejected(language.select(F.col("atom").alias("text")).union(rules.select(F.explode(F.concat("antecedent", "consequent"))))).limit(5)
    wrong = []
    for r in bad.collect():  # column tests are coarse; the parser has the last word on what they suspect
        try:
            base.checked(r.text)
        except ValueError as e:
            wrong.append(str(e))
    if wrong:
        raise ValueError("; ".join(wrong))
    base._language, base._consequences = language.distinct(), rules.distinct()
    base._annotations = file.select(F.explode("annotations").alias("atom", "description"))
    if onto:
        listed = F.when(F.col("arg1").startswith("["), F.from_json("arg1", "array<string>")).otherwise(F.array("arg1"))
        base._schemas = file.select(F.posexplode("onto_schemas").alias("seq", "s")).select(F.col("seq").cast("long"), "s.*").select("seq", "type", listed.alias("arg1"), "arg2", "annotation")
        base._seq = base._schemas.count()
    return base


def load(spark: SparkSession, path: str, onto: bool = False) -> Base:
    """A base from a JSON file."""
    return from_frame(spark, spark.read.schema(model.FILE).option("multiLine", True).json(path), onto)


def from_dict(spark: SparkSession, data: dict, onto: bool = False) -> Base:
    """A base from a dict such as to_dict makes."""
    base = Base(spark, onto=onto)
    base._new_atoms = dict.fromkeys(map(base.checked, data.get("language", [])))
    base._new_rules = dict.fromkeys(base.checked_rule(c["antecedent"], c["consequent"]) for c in data.get("consequences", []))
    base._new_notes = dict(data.get("annotations", {}))
    for s in data.get("onto_schemas", []) if onto else []:
        arg1 = s["arg1"] if isinstance(s["arg1"], list) else [s["arg1"]]
        base._new_schemas.append((base._seq, s["type"], arg1, s["arg2"], s.get("annotation")))
        base._seq += 1
    return base


def document(base: Base) -> DataFrame:
    """The base as one row with the file's columns, every list sorted but the schemas."""
    sets = lambda df, c: df.agg(F.sort_array(F.collect_set(c)).alias(c))
    out = sets(base.language.withColumnRenamed("atom", "language"), "language")
    rules = base.consequences.select(F.struct("antecedent", "consequent").alias("consequences"))
    out = out.join(F.broadcast(sets(rules, "consequences")))  # one row each
    notes = base.annotations.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("atom", "description")))).alias("annotations"))
    out = out.join(F.broadcast(notes))
    if base.onto:
        vocab = base.vocab.agg(*[F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("name")))).alias(f"{k}s") for k in ("individual", "concept", "role")])
        schemas = base.schemas.agg(F.array_sort(F.collect_list(F.struct("seq", "type", "arg1", "arg2", "annotation"))).alias("onto_schemas"))
        out = out.join(F.broadcast(vocab)).join(F.broadcast(schemas))
    return out


def to_dict(base: Base) -> dict:
    """The base as a dict; annotations only if there are any."""
    row = document(base).first().asDict(recursive=True)
    out = {"language": row["language"], "consequences": row["consequences"]}
    if row["annotations"]:
        out["annotations"] = dict(sorted(row["annotations"].items()))
    if base.onto:
        out |= {k: row[k] for k in ("individuals", "concepts", "roles")}
        out["onto_schemas"] = []
        for s in row["onto_schemas"]:
            own = {"type": s["type"], "arg1": s["arg1"] if s["type"] == "jointCommitment" else s["arg1"][0], "arg2": s["arg2"]}
            out["onto_schemas"].append(own | ({"annotation": s["annotation"]} if s["annotation"] else {}))
    return out


def save(base: Base, path: str) -> None:
    """The base as a JSON file, indented by 2; replaced at once, not half-written."""
    import os

    text = json.dumps(to_dict(base), indent=2)
    with open(f"{path}.part", "w") as f:
        f.write(text)
    os.replace(f"{path}.part", path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(qid, value) of the lines of a text file that are neither blank nor comments, numbered from 0.

    A file is read as one split so that numbers follow its lines; it is a batch of commands, not a table.
    """
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("qid", "value"))
    return kept_lines(rows)


def kept_lines(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", C.stripped(F.col("value"))).where(~F.col("value").rlike(r"^(#|$)"))


def checked(rows: DataFrame, base: Base) -> DataFrame:
    """Statements with an error where a member may not be in this base; the others are as they were."""
    ship(rows.sparkSession)
    onto = base.onto

    def fault(kind, atom, antecedent, consequent):
        members = [atom] if kind == "atom" else [*(antecedent if antecedent is not None else ()), *(consequent if consequent is not None else ())]
        try:
            for t in members if kind in ("atom", "consequence") else ():
                check_member(t, onto)
        except ValueError as e:
            return str(e)
        return None

    found = F.udf(fault, "string", useArrow=True)("kind", "atom", "antecedent", "consequent")
    schema = F.when((F.col("kind") == "schema") & F.lit(not onto), "Schemas need ontology mode")
    return rows.withColumn("error", F.coalesce("error", found, schema))


def apply(base: Base, rows: DataFrame) -> Base:
    """Add checked statements (qid whole numbers) that have no error to a base; of annotations of one atom the last counts."""
    good = rows.where("error is null")
    atoms = good.where("kind = 'atom'")
    schemas = good.where("kind = 'schema'").select("type", "arg1", "arg2", "annotation", F.col("qid").cast("long").alias("seq"))
    return base.add_rows(
        atoms.select("atom"), good.where("kind = 'consequence'").select("antecedent", "consequent"), schemas,
        atoms.where("annotation is not null").groupBy("atom").agg(F.max_by("annotation", "qid").alias("description")),
    )


def export(base: Base, path: str) -> None:
    """The base as folders of JSON lines, one for each table, written by many tasks; for bases of any size."""
    for name in TABLES[: 4 if base.onto else 3]:
        getattr(base, name).write.json(f"{path}/{name}")


def import_(spark: SparkSession, path: str, onto: bool = False) -> Base:
    """A base that export wrote."""
    base = Base(spark, onto=onto)
    for name, schema in zip(TABLES[: 4 if onto else 3], (model.LANGUAGE, model.CONSEQUENCES, model.ANNOTATIONS, model.SCHEMAS)):
        setattr(base, f"_{name}", spark.read.schema(schema).json(f"{path}/{name}"))
    if onto:
        base._seq = 1 + (base._schemas.agg(F.max("seq")).first()[0] or 0)
    return base


def quoted(text):
    """(rest, annotation): what stands before the first quoted part, and that part; an open quote runs to the end."""
    mark = F.when(text.contains('"'), F.lit('"')).when(text.contains("'"), F.lit("'"))
    rest = F.when(mark.isNull(), text).otherwise(F.call_function("substring_index", text, mark, F.lit(1)))
    tail = F.substring(text, F.char_length(rest) + 2, 1 << 30)
    note = F.when(tail.contains(mark), F.call_function("substring_index", tail, mark, F.lit(1))).otherwise(C.stripped(tail))
    return C.stripped(rest), F.when(note != "", note)


def re_words(text: str) -> list[str]:
    """Words of a line before its quoted part."""
    return re.split(r"[\"']", text, maxsplit=1)[0].split()


def statements(rows: DataFrame) -> DataFrame:
    """(qid, kind, atom, antecedent, consequent, type, arg1, arg2, annotation, error) of tell lines (qid, value).

    kind is atom, consequence or schema; a line that is none has an error.
    """
    v = F.col("value")
    is_atom, is_schema, is_rule = F.lower(v).startswith("atom "), v.startswith("schema "), v.contains("|~")
    atom, note = quoted(F.substring(v, 6, 1 << 30))
    body, schema_note = quoted(v)
    token = F.split(body, r"\s+")
    named = F.get(token, F.lit(1))
    fine = F.size(token) >= 4
    arg1 = F.when(named == "jointCommitment", F.split(F.get(token, F.lit(2)), ",")).otherwise(F.array(F.get(token, F.lit(2))))
    known = named.isin(*model.SCHEMA_TYPES) & fine
    kind = F.when(is_atom, "atom").when(is_schema, "schema").when(is_rule, "consequence")
    side = F.split(v, r"\|~", 2)
    error = (
        F.when(kind.isNull(), F.concat(F.lit("Invalid tell statement: "), v))
        .when((kind == "schema") & ~F.coalesce(known, F.lit(False)), F.concat(F.lit("Invalid schema line: "), v))
        .when((kind == "schema") & (named == "jointCommitment") & (F.size(arg1) < 2), "jointCommitment requires at least 2 comma-separated antecedent concepts.")
        .when((kind == "atom") & (atom == ""), "Empty sentence")
    )
    when = lambda k, c: F.when((kind == k) & error.isNull(), c)
    return rows.select(
        "qid", kind.alias("kind"), when("atom", atom).alias("atom"), when("consequence", C.split_members(side[0])).alias("antecedent"), when("consequence", C.split_members(F.get(side, F.lit(1)))).alias("consequent"),
        when("schema", named).alias("type"), when("schema", arg1).alias("arg1"), when("schema", F.get(token, F.lit(3))).alias("arg2"),
        F.when(kind == "atom", note).when(kind == "schema", schema_note).alias("annotation"), error.alias("error"),
    )
