"""Commitments that come from sources and can be taken back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.functions import columns as C
from turnstile.operators.base import Base


class CommitmentStore:
    """Assertions, ground rules and schemas by source; compile() makes a base, kept until the next change."""

    SCHEMA = "seq long, source string, type string, arg1 array<string>, arg2 string"

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.assertions: dict[str, None] = {}
        self.rules: dict[tuple, None] = {}
        self.rows: list[tuple] = []
        self._seq = 0
        self._base: Base | None = None

    def add_assertion(self, text: str) -> None:
        self.assertions[text] = None
        self._base = None

    def add_role(self, role: str, subject: str, object_: str) -> None:
        self.add_assertion(f"{role}({subject},{object_})")

    def add_concept(self, concept: str, individual: str) -> None:
        self.add_assertion(f"{concept}({individual})")

    def commit(self, source: str, kind: str, arg1, arg2: str) -> None:
        many = list(arg1) if kind == "jointCommitment" else [arg1]
        if kind == "jointCommitment" and len(many) < 2:
            raise ValueError("jointCommitment requires at least 2 antecedent concepts")
        self.rows.append((self._seq, source, kind, many, arg2))
        self._seq += 1
        self._base = None

    def commit_subclass(self, source: str, sub: str, sup: str) -> None:
        self.commit(source, "subClassOf", sub, sup)

    def commit_range(self, source: str, role: str, concept: str) -> None:
        self.commit(source, "range", role, concept)

    def commit_domain(self, source: str, role: str, concept: str) -> None:
        self.commit(source, "domain", role, concept)

    def commit_subproperty(self, source: str, sub: str, sup: str) -> None:
        self.commit(source, "subPropertyOf", sub, sup)

    def commit_disjoint(self, source: str, one: str, other: str) -> None:
        self.commit(source, "disjointWith", one, other)

    def commit_disjoint_properties(self, source: str, one: str, other: str) -> None:
        self.commit(source, "disjointProperties", one, other)

    def commit_joint_commitment(self, source: str, concepts, concept: str) -> None:
        self.commit(source, "jointCommitment", concepts, concept)

    def commit_defeasible_rule(self, source: str, antecedent, consequent) -> None:
        """A ground rule; its members become assertions. The source is not kept, so it cannot be taken back."""
        self.rules[tuple(sorted(set(antecedent))), tuple(sorted(set(consequent)))] = None
        for t in [*antecedent, *consequent]:
            self.assertions[t] = None
        self._base = None

    def retract_schema(self, source: str) -> None:
        """Take back the schemas of a source; assertions and ground rules stay."""
        self.rows = [r for r in self.rows if r[1] != source]
        self._base = None

    @property
    def commitments(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, self.SCHEMA)

    def compile(self) -> Base:
        """A base of all that is committed; annotations and sources are dropped."""
        if self._base is None:
            base = Base(self.spark, self.assertions, self.rules, onto=True)
            for _, _, kind, arg1, arg2 in self.rows:
                base.register(kind, arg1 if kind == "jointCommitment" else arg1[0], arg2)
            self._base = base
        return self._base

    def described(self) -> DataFrame:
        """(seq, line) of the schemas."""
        pattern = C.schema_pattern(F.col("type"), F.col("arg1"), F.col("arg2"), braces=False)
        return self.commitments.select("seq", F.concat(F.lit("    ["), "source", F.lit("] "), "type", F.lit(": "), pattern).alias("line"))

    def describe(self) -> str:
        """A report: counts, assertions, schemas with their sources, ground rules."""
        lines = ["Commitment Store:", f"  Assertions: {len(self.assertions)}", *(f"    {a}" for a in sorted(self.assertions)), f"  Ontology Schemas: {len(self.rows)}"]
        lines += [r.line for r in self.described().orderBy("seq").collect()] if self.rows else []
        if self.rules:
            lines.append(f"  Ground rules: {len(self.rules)}")
            lines += [f"    {{{', '.join(a)}}} |~ {{{', '.join(c)}}}" for a, c in sorted(self.rules)]
        return "\n".join(lines)
