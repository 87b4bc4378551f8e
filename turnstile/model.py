"""Schemas of the tables that make up a base."""

from __future__ import annotations

from pyspark.sql import types as T

TEXTS = T.ArrayType(T.StringType())
LANGUAGE = T.StructType([T.StructField("atom", T.StringType(), False)])
CONSEQUENCES = T.StructType([T.StructField("antecedent", TEXTS, False), T.StructField("consequent", TEXTS, False)])
ANNOTATIONS = T.StructType([T.StructField("atom", T.StringType(), False), T.StructField("description", T.StringType())])
SCHEMAS = T.StructType([T.StructField("seq", T.LongType(), False), T.StructField("type", T.StringType()), T.StructField("arg1", TEXTS), T.StructField("arg2", T.StringType()), T.StructField("annotation", T.StringType())])
#: A base as it stands in a JSON file; arg1 of a schema is a text or a list.
FILE = T.StructType([
    T.StructField("language", TEXTS),
    T.StructField("consequences", T.ArrayType(CONSEQUENCES)),
    T.StructField("annotations", T.MapType(T.StringType(), T.StringType())),
    T.StructField("onto_schemas", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("type", "arg1", "arg2", "annotation")]))),
])
#: The kinds of ontology schemas.
SCHEMA_TYPES = ["subClassOf", "range", "domain", "subPropertyOf", "disjointWith", "disjointProperties", "jointCommitment"]
