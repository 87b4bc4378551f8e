"""A base: language, consequences, annotations and ontology schemas, each a DataFrame.

Single edits are kept as rows on the driver and join the tables when these are next read, so that many
edits make one union; bulk edits are DataFrames from the start. Nothing is closed under anything.
"""

from __future__ import annotations

import logging
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile import model
from turnstile.functions import columns as C
from turnstile.functions import formula

log = logging.getLogger(__name__)
ASSERTION = re.compile(r"^\w+\(\w+(\s*,\s*\w+)?\)$")
#: Rows that are broadcast at most; larger base tables are joined by shuffle.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, hinted for broadcast if a count shows at most limit rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def is_assertion(text: str) -> bool:
    """C(a) or R(a,b), parentheses around it aside; what cannot be read is none."""
    try:
        s = formula.parse(text)
    except formula.Malformed:
        return False
    return s[0] == "atom" and bool(ASSERTION.match(s[1]))


def check_member(text: str, onto: bool) -> str:
    """The text if it may be a member of a base of its kind; else ValueError."""
    if onto:
        if not is_assertion(text):
            raise ValueError(f"{text!r} is not a concept or role assertion")
    elif not formula.is_atomic(text):
        raise ValueError(f"{text!r} is not atomic")
    elif is_assertion(text):
        raise ValueError(f"{text!r} is an assertion about individuals; use an ontology base")
    return text


class Base:
    """Tables of a base. onto: members are assertions about individuals, and schemas count as axioms."""

    def __init__(self, spark: SparkSession, language=(), consequences=(), annotations=None, onto: bool = False):
        self.spark, self.onto = spark, onto
        self._language = spark.createDataFrame([], model.LANGUAGE)
        self._consequences = spark.createDataFrame([], model.CONSEQUENCES)
        self._annotations = spark.createDataFrame([], model.ANNOTATIONS)
        self._schemas = spark.createDataFrame([], model.SCHEMAS)
        self._clear()
        self._seq = 0
        self.providers: list = []
        log.debug("New base: %s", "ontology" if onto else "propositional")
        for a in language:
            self._new_atoms[self.checked(a)] = None
        for ant, con in consequences:
            self._new_rules[self.checked_rule(ant, con)] = None
        self._new_notes |= annotations or {}

    def _clear(self) -> None:
        self._new_atoms: dict[str, None] = {}
        self._new_rules: dict[tuple, None] = {}
        self._new_notes: dict[str, str] = {}
        self._new_schemas: list[tuple] = []

    # -- validation

    def checked(self, text: str) -> str:
        """The text if it may be a member of this base; else ValueError."""
        return check_member(text, self.onto)

    def checked_rule(self, antecedent, consequent) -> tuple:
        """Both sides as sorted members, valid ones; they keep their text, but are met as sentences are read."""
        return tuple(sorted({self.checked(x) for x in antecedent})), tuple(sorted({self.checked(x) for x in consequent}))

    # -- tables

    def flush(self) -> None:
        make = self.spark.createDataFrame
        if self._new_atoms:
            self._language = self._language.union(make([(a,) for a in self._new_atoms], model.LANGUAGE)).distinct()
        if self._new_rules:
            self._consequences = self._consequences.union(make([(list(a), list(c)) for a, c in self._new_rules], model.CONSEQUENCES)).distinct()
        if self._new_notes:
            new = make(list(self._new_notes.items()), model.ANNOTATIONS)
            self._annotations = self._annotations.join(new, "atom", "left_anti").union(new)
        if self._new_schemas:
            self._schemas = self._schemas.union(make(self._new_schemas, model.SCHEMAS))
        self._clear()

    @property
    def language(self) -> DataFrame:
        self.flush()
        return self._language

    @property
    def consequences(self) -> DataFrame:
        self.flush()
        return self._consequences

    @property
    def annotations(self) -> DataFrame:
        self.flush()
        return self._annotations

    @property
    def schemas(self) -> DataFrame:
        """(seq, type, arg1 array, arg2, annotation) in order of registration; repeats stay."""
        self.flush()
        return self._schemas

    @property
    def vocab(self) -> DataFrame:
        """(kind, name): individuals, concepts and roles of the language and the consequences."""
        members = self.language.select("atom").union(self.consequences.select(F.explode(F.concat("antecedent", "consequent"))))
        return vocabulary(members.distinct())

    # -- edits

    def add_atom(self, atom: str) -> None:
        self._new_atoms[self.checked(atom)] = None

    def add_consequence(self, antecedent, consequent) -> None:
        rule = self.checked_rule(antecedent, consequent)
        self._new_rules[rule] = None
        self._new_atoms |= dict.fromkeys([*rule[0], *rule[1]])

    def annotate(self, atom: str, text: str) -> None:
        """Any key may be annotated; the last text wins."""
        self._new_notes[atom] = text

    def add_individual(self, role: str, subject: str, object_: str) -> None:
        self._new_atoms[f"{role}({subject},{object_})"] = None

    def register(self, kind: str, arg1, arg2: str, annotation: str | None = None) -> None:
        """Append a schema. A joint commitment needs two concepts or more."""
        if kind not in model.SCHEMA_TYPES:
            raise ValueError(f"Unknown schema type: {kind}")
        many = list(arg1) if kind == "jointCommitment" else [arg1]
        if kind == "jointCommitment" and len(many) < 2:
            raise ValueError("jointCommitment requires at least 2 antecedent concepts")
        self._new_schemas.append((self._seq, kind, many, arg2, annotation))
        self._seq += 1

    def register_subclass(self, sub: str, sup: str, annotation=None) -> None:
        self.register("subClassOf", sub, sup, annotation)

    def register_range(self, role: str, concept: str, annotation=None) -> None:
        self.register("range", role, concept, annotation)

    def register_domain(self, role: str, concept: str, annotation=None) -> None:
        self.register("domain", role, concept, annotation)

    def register_subproperty(self, sub: str, sup: str, annotation=None) -> None:
        self.register("subPropertyOf", sub, sup, annotation)

    def register_disjoint(self, one: str, other: str, annotation=None) -> None:
        self.register("disjointWith", one, other, annotation)

    def register_disjoint_properties(self, one: str, other: str, annotation=None) -> None:
        self.register("disjointProperties", one, other, annotation)

    def register_joint_commitment(self, concepts, concept: str, annotation=None) -> None:
        self.register("jointCommitment", concepts, concept, annotation)

    def add_rows(self, language: DataFrame | None = None, consequences: DataFrame | None = None, schemas: DataFrame | None = None, annotations: DataFrame | None = None) -> Base:
        """Bulk edits of valid rows: atoms, rules (whose members join the language), schemas (type, arg1, arg2), annotations (atom, description).

        Schemas may have an annotation, and a seq (0 and on) that orders them among themselves. An annotation replaces an earlier one of its key; of several in the frame the greatest text counts.
        """
        self.flush()
        if consequences is not None:
            own = consequences.select(C.canonical(F.col("antecedent")).alias("antecedent"), C.canonical(F.col("consequent")).alias("consequent"))
            self._consequences = self._consequences.union(own).distinct()
            members = own.select(F.explode(F.concat("antecedent", "consequent")).alias("atom"))
            language = members if language is None else language.select("atom").union(members)
        if language is not None:
            self._language = self._language.union(language.select("atom")).distinct()
        if schemas is not None:
            seq = F.col("seq") if "seq" in schemas.columns else F.lit(0)
            note = F.col("annotation") if "annotation" in schemas.columns else F.lit(None).cast("string")
            own = schemas.select((F.lit(self._seq) + seq).cast("long").alias("seq"), "type", "arg1", "arg2", note.alias("annotation"))
            self._schemas = self._schemas.union(own)
            last = own.agg(F.max("seq")).first()[0] if "seq" in schemas.columns else None
            self._seq = 1 + (self._seq if last is None else last)
        if annotations is not None:
            own = annotations.groupBy("atom").agg(F.max("description").alias("description"))
            self._annotations = self._annotations.join(own, "atom", "left_anti").unionByName(own)
        return self

    def register_axioms(self, provider) -> None:
        """Add an axiom provider: a function from atomic sequents (g, d) to those of them that hold."""
        self.providers.append(provider)

    # -- reports

    def rejected(self, members: DataFrame) -> DataFrame:
        """Of a frame (text): the rows that may not be members, decided by column expressions."""
        t = C.stripped(F.col("text"))
        shaped, maybe = t.rlike(C.ASSERTION), t.rlike(C.MAYBE_COMPOUND)
        return members.where((~shaped if self.onto else shaped | maybe) | (t == ""))

    def shown_language(self) -> DataFrame:
        """(atom, description) in order."""
        return self.language.join(self.annotations, "atom", "left").orderBy("atom")

    def shown_schemas(self) -> DataFrame:
        """(seq, type, pattern, annotation) in order of registration."""
        return self.schemas.select("seq", "type", C.schema_pattern(F.col("type"), F.col("arg1"), F.col("arg2")).alias("pattern"), "annotation").orderBy("seq")

    def shown_vocab(self) -> DataFrame:
        """(kind, names) with sorted names."""
        return self.vocab.groupBy("kind").agg(F.sort_array(F.collect_set("name")).alias("names"))


def vocabulary(members: DataFrame) -> DataFrame:
    """(kind, name) of a frame of assertions: individuals, concepts, roles."""
    own = members.toDF("atom").select(C.atom_struct(F.col("atom")).alias("a")).where("a is not null")
    kind = F.when(F.col("a.kind") == "concept", "concept").otherwise("role")
    named = F.array(F.struct(kind.alias("kind"), F.col("a.pred").alias("name")), F.struct(F.lit("individual").alias("kind"), F.col("a.arg1").alias("name")), F.struct(F.lit("individual").alias("kind"), F.col("a.arg2").alias("name")))
    return own.select(F.inline(named)).where("name is not null").distinct()
