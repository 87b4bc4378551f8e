"""Registered queries: one for each operator of the engine over the driver's tables, with SQL to check them.

Unless a query says otherwise a sequent's antecedent is all that the view asserts of an individual (or a pair),
so any further assertion defeats an inference; the engine never picks premises.
"""

from __future__ import annotations

import contextlib
import io
import json
import sys
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile import cli, model
from turnstile.functions import assertions as assertions_of
from turnstile.functions import columns as C
from turnstile.functions import formula
from turnstile.operators.axioms import judged
from turnstile.operators.base import Base, check_member, vocabulary
from turnstile.operators.commitments import CommitmentStore
from turnstile.plans import ask as asking
from turnstile.plans import explain, responses
from turnstile.shipping import ship
from turnstile.sources import abox, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CUST = f"(SELECT arg AS who, list_sort(list(pred || '(' || arg || ')')) AS texts, list_sort(list(pred)) AS preds FROM ({abox.concepts_sql('customer')}) GROUP BY arg)"
ORDER = f"(SELECT arg AS who, list_sort(list(pred)) AS preds FROM ({abox.concepts_sql('orders')}) GROUP BY arg)"
USER = f"(SELECT arg AS who, list_sort(list(pred)) AS preds FROM ({abox.concepts_sql('events')}) GROUP BY arg)"
PAIR = "(SELECT o, p, list_sort(list(pred)) AS preds FROM (SELECT DISTINCT pred, arg1 AS o, arg2 AS p FROM (" + abox.roles_sql("lineitem") + ") WHERE pred IN ('returned', 'accepted')) GROUP BY o, p)"


def query(sql: str | None = None):
    """Register a query under its own name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def said(name: str, who: str = "who"):
    """The text name(who) as a column."""
    return C.concept_text(F.lit(name), F.col(who))


def sequents(df: DataFrame, antecedent, consequent, qid="who") -> DataFrame:
    arr = lambda x: F.array(*x).cast("array<string>") if isinstance(x, list) else x
    return df.select(F.col(qid).alias("qid"), arr(antecedent).alias("antecedent"), arr(consequent).alias("consequent"))


def answers(queries: DataFrame, base: Base) -> DataFrame:
    return asking.ask(queries, base).select("qid", "derivable")


def customers(spark: SparkSession, d: str) -> DataFrame:
    return abox.members(spark, d, "customer")


def onto(spark: SparkSession, *schemas: tuple) -> Base:
    base = Base(spark, onto=True)
    for kind, a, b in schemas:
        base.register(kind, a, b)
    return base


@query("SELECT pred || '(' || arg || ')' AS text FROM (" + abox.concepts_sql() + ")")
def scan_abox_concepts(spark, d):
    return abox.concepts(spark, d).select(C.concept_text(F.col("pred"), F.col("arg")).alias("text"))


@query("SELECT pred || '(' || arg1 || ',' || arg2 || ')' AS text FROM (" + abox.roles_sql() + ")")
def scan_abox_roles(spark, d):
    return abox.roles(spark, d).select(C.role_text(F.col("pred"), F.col("arg1"), F.col("arg2")).alias("text"))


def assertions(spark, d):
    return scan_abox_concepts(spark, d).union(scan_abox_roles(spark, d))


INDIVIDUALS = f"SELECT arg AS name FROM ({abox.concepts_sql()}) UNION SELECT arg1 FROM ({abox.roles_sql()}) UNION SELECT arg2 FROM ({abox.roles_sql()})"


@query(INDIVIDUALS)
def vocab_individuals(spark, d):
    return vocabulary(assertions(spark, d)).where("kind = 'individual'").select("name")


@query(f"SELECT 'individual' AS kind, count(*) AS n FROM ({INDIVIDUALS}) UNION ALL SELECT 'concept', count(DISTINCT pred) FROM ({abox.concepts_sql()}) UNION ALL SELECT 'role', count(DISTINCT pred) FROM ({abox.roles_sql()})")
def vocab_counts(spark, d):
    return vocabulary(assertions(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"SELECT pred || '(' || arg || ')' AS text, 'concept' AS kind, pred, arg AS arg1, CAST(NULL AS VARCHAR) AS arg2 FROM ({abox.concepts_sql()}) UNION ALL SELECT pred || '(' || arg1 || ',' || arg2 || ')', 'role', pred, arg1, arg2 FROM ({abox.roles_sql()})")
def parse_atoms(spark, d):
    return assertions(spark, d).select("text", C.atom_struct(F.col("text")).alias("a")).select("text", "a.*")


@query(f"SELECT who || ' ' || array_to_string(texts, '; ') AS text, array_to_string(texts, ', ') AS antecedent, 'Risk(' || who || ')' AS consequent FROM {CUST}")
def parse_sequents(spark, d):
    """Text of a sequent, read back; duplicates and blanks go."""
    own = customers(spark, d)
    line = F.concat(F.array_join(F.reverse("texts"), " ,, "), F.lit(", "), F.col("texts")[0], F.lit(" => "), said("Risk"), F.lit(" ,"))
    side = F.split(line, "=>", 2)
    return own.select(F.concat("who", F.lit(" "), F.array_join("texts", "; ")).alias("text"), C.show_set(C.split_members(side[0])).alias("antecedent"), C.show_set(C.split_members(side[1])).alias("consequent"))


TELL_SQL = f"""
SELECT who || ' atom' AS qid, 'atom' AS kind, 'Debtor(' || who || ')' AS atom, '' AS sides, CASE WHEN list_contains(preds, 'Debtor') THEN 'owes, "much"' ELSE NULL END AS annotation, false AS failed FROM {CUST}
UNION ALL SELECT who || ' rule', 'consequence', NULL, array_to_string(texts, ', ') || ' |~ ∅', NULL, false FROM {CUST}
UNION ALL SELECT who || ' bad', NULL, NULL, '', NULL, true FROM {CUST}
UNION ALL SELECT who || ' schema', 'schema', NULL, '', 'why', false FROM {CUST}"""


@query(TELL_SQL)
def parse_tell_statements(spark, d):
    own = customers(spark, d)
    note = F.when(F.array_contains("texts", said("Debtor")), F.lit(" 'owes, ~much~'")).otherwise("")
    lines = F.array(
        F.struct(F.concat("who", F.lit(" atom")).alias("qid"), F.concat(F.lit("Atom "), said("Debtor"), F.translate(note, "~", '"')).alias("value")),
        F.struct(F.concat("who", F.lit(" rule")).alias("qid"), F.concat(F.array_join("texts", ","), F.lit(" |~ ")).alias("value")),
        F.struct(F.concat("who", F.lit(" bad")).alias("qid"), F.concat(F.lit("tell me about "), "who").alias("value")),
        F.struct(F.concat("who", F.lit(" schema")).alias("qid"), F.lit("schema subClassOf Debtor Obligor 'why'").alias("value")),
    )
    read = files.statements(own.select(F.inline(lines)))
    sides = F.when(F.col("kind") == "consequence", F.concat(C.show_set(F.col("antecedent")), F.lit(" |~ "), C.show_set(F.col("consequent")))).otherwise("")
    # double quotes win over single ones, as they are looked for first
    atom = F.regexp_replace("atom", " 'owes,$", "")
    note = F.when((F.col("kind") == "atom") & F.col("annotation").isNotNull(), F.concat(F.lit('owes, "'), "annotation", F.lit('"'))).otherwise(F.col("annotation"))
    return read.select("qid", "kind", atom.alias("atom"), sides.alias("sides"), note.alias("annotation"), F.col("error").isNotNull().alias("failed"))


@query(f"SELECT who AS qid, list_contains(preds, 'Debtor') AS derivable FROM {CUST}")
def containment(spark, d):
    return answers(sequents(customers(spark, d), F.col("texts"), [said("Debtor")]), Base(spark, onto=True))


def ground_rules(spark, d, where: str = "c_acctbal < -500") -> Base:
    """One rule for each customer of a condition, by default deep in debt: a debtor of the segment BUILDING is a risk."""
    own = spark.read.parquet(f"{d}/customer.parquet").where(where).select(F.concat(F.lit("c"), F.col("c_custkey")).alias("who"))
    rules = own.select(F.array(said("SegBUILDING"), said("Debtor")).alias("antecedent"), F.array(said("Risk")).alias("consequent"))
    return Base(spark, onto=True).add_rows(consequences=rules)


DEEP = "who IN (SELECT concat('c', c_custkey) FROM customer WHERE c_acctbal < -500)"


@query(f"SELECT who AS qid, preds = ['Debtor', 'SegBUILDING'] AND {DEEP} AS derivable FROM {CUST}")
def base_exact_match(spark, d):
    return answers(sequents(customers(spark, d), F.col("texts"), [said("Risk")]), ground_rules(spark, d))


@query(f"SELECT who || x AS qid, x = '' AND preds = ['Debtor', 'SegBUILDING'] AND {DEEP} AS derivable FROM {CUST}, (SELECT unnest(['', ' left', ' right']) AS x)")
def no_weakening(spark, d):
    """A member more on either side, and no rule fits."""
    own = customers(spark, d)
    more = lambda name, g, c: sequents(own.withColumn("q", F.concat("who", F.lit(name))), g, c, "q")
    rows = more("", F.col("texts"), [said("Risk")]).union(more(" left", F.concat("texts", F.array(said("Extra"))), [said("Risk")])).union(more(" right", F.col("texts"), [said("Risk"), said("Extra")]))
    return answers(rows, ground_rules(spark, d))


def by_side(df: DataFrame, antecedent, good, bad) -> DataFrame:
    """Two sequents for each row: one that a schema licenses and one that it does not."""
    return df.select(F.explode(F.array(F.struct(F.concat("who", F.lit(" +")).alias("qid"), F.array(*good).alias("consequent")), F.struct(F.concat("who", F.lit(" -")).alias("qid"), F.array(*bad).alias("consequent")))).alias("s"), F.array(*antecedent).alias("antecedent")).select("s.qid", "antecedent", "s.consequent")


BOTH = "SELECT who || ' +' AS qid, true AS derivable FROM {t} UNION ALL SELECT who || ' -', false FROM {t}"
DEBTORS = "(SELECT concat('c', c_custkey) AS who FROM customer WHERE c_acctbal < 0)"
PLACED = "(SELECT concat('o', o_orderkey) AS who FROM orders)"


def debtors(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal < 0").select(F.expr("concat('c', c_custkey)").alias("who"))


def placed(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.expr("concat('o', o_orderkey)").alias("who"), F.expr("concat('c', o_custkey)").alias("by"))


@query(BOTH.format(t=DEBTORS))
def schema_subclass(spark, d):
    return answers(by_side(debtors(spark, d), [said("Debtor")], [said("Obligor")], [F.lit("Obligor(nobody)")]), onto(spark, ("subClassOf", "Debtor", "Obligor")))


def role_query(spark, d, schema, good, bad):
    return answers(by_side(placed(spark, d), [C.role_text(F.lit("placed"), F.col("by"), F.col("who"))], [good], [bad]), onto(spark, schema))


@query(BOTH.format(t=PLACED))
def schema_range(spark, d):
    return role_query(spark, d, ("range", "placed", "Order"), said("Order"), said("Order", "by"))


@query(BOTH.format(t=PLACED))
def schema_domain(spark, d):
    return role_query(spark, d, ("domain", "placed", "Buyer"), said("Buyer", "by"), said("Buyer"))


@query(BOTH.format(t=PLACED))
def schema_subproperty(spark, d):
    text = lambda a, b: C.role_text(F.lit("ordered"), F.col(a), F.col(b))
    return role_query(spark, d, ("subPropertyOf", "placed", "ordered"), text("by", "who"), text("who", "by"))


@query(f"SELECT who AS qid, list_contains(preds, 'diderror') AND list_contains(preds, 'didpurchase') AS derivable FROM {USER}")
def schema_disjoint_with(spark, d):
    own = abox.members(spark, d, "events")
    keep = F.filter("texts", lambda t: t.rlike(r"^did(error|purchase)\("))
    return answers(sequents(own, keep, F.expr(C.EMPTY)), onto(spark, ("disjointWith", "didpurchase", "diderror")))


@query(f"SELECT o || ' ' || p AS qid, len(preds) = 2 AS derivable FROM {PAIR}")
def schema_disjoint_properties(spark, d):
    own = abox.roles(spark, d, "lineitem").where("pred in ('returned', 'accepted')").groupBy("arg1", "arg2").agg(F.collect_set(C.role_text(F.col("pred"), F.col("arg1"), F.col("arg2"))).alias("texts"))
    own = own.withColumn("who", F.concat("arg1", F.lit(" "), "arg2"))
    return answers(sequents(own, F.col("texts"), F.expr(C.EMPTY)), onto(spark, ("disjointProperties", "returned", "accepted")))


JOINT = ("jointCommitment", ["SegBUILDING", "Debtor"], "Risk")


@query(f"SELECT who AS qid, preds = ['Debtor', 'SegBUILDING'] AS derivable FROM {CUST}")
def schema_joint_commitment(spark, d):
    return answers(sequents(customers(spark, d), F.col("texts"), [said("Risk")]), onto(spark, JOINT))


@query(f"SELECT who AS qid, true AS alone, false AS with_more FROM {CUST} WHERE list_contains(preds, 'SegBUILDING') AND len(preds) > 1 UNION ALL SELECT who, false, false FROM {CUST} WHERE NOT list_contains(preds, 'SegBUILDING')")
def defeated_inference(spark, d):
    """The segment alone makes a Builder; with a further assertion it does not. Of builders with more to them, and of other segments."""
    own = customers(spark, d).where(~F.array_contains("texts", said("SegBUILDING")) | (F.size("texts") > 1))
    base = onto(spark, ("subClassOf", "SegBUILDING", "Builder"))
    segment = F.filter("texts", lambda t: t.startswith("Seg"))
    one = answers(sequents(own, segment, [said("Builder")]), base).withColumnRenamed("derivable", "alone")
    rest = answers(sequents(own, F.col("texts"), [said("Builder")]), base).withColumnRenamed("derivable", "with_more")
    return one.join(rest, "qid")


OWN = "CASE WHEN list_contains(preds, 'Debtor') THEN 'Debtor' ELSE 'Wealthy' END"


def one_each(spark, d):
    """Customers with own: Debtor(x) of a debtor, Wealthy(x) of another."""
    return customers(spark, d).withColumn("own", F.when(F.array_contains("texts", said("Debtor")), said("Debtor")).otherwise(said("Wealthy")))


@query(f"SELECT who AS qid, list_contains(preds, 'Debtor') AS first, true AS second, false AS chained FROM {CUST}")
def nontransitive_chain(spark, d):
    """What holds in two steps does not hold in one."""
    base = onto(spark, ("subClassOf", "Debtor", "Obligor"), ("subClassOf", "Obligor", "Party"))
    own = one_each(spark, d)
    steps = [(F.col("own"), "Obligor", "first"), (said("Obligor"), "Party", "second"), (F.col("own"), "Party", "chained")]
    each = F.array(*[F.struct(F.lit(n).alias("step"), F.array(a).alias("antecedent"), F.array(said(b)).alias("consequent")) for a, b, n in steps])
    rows = own.select("who", F.explode(each).alias("s")).select(F.concat("who", F.lit("|"), "s.step").alias("qid"), "s.antecedent", "s.consequent")
    got = answers(rows, base).select(F.split("qid", r"\|")[0].alias("qid"), F.split("qid", r"\|")[1].alias("step"), "derivable")
    return got.groupBy("qid").agg(*[F.bool_or(F.when(F.col("step") == n, F.col("derivable"))).alias(n) for _, _, n in steps])


# Rules, on compound sentences. W(x): Wealthy, D: Debtor, R: Risk; the base holds D |~ R of every debtor. A customer
# that is D alone, W alone or neither has that one as its premise where a rule needs one.
HAS = "list_contains(preds, 'Debtor')"


def rule_query(name: str, antecedent, consequent, sql: str):
    def run(spark, d):
        own = one_each(spark, d)
        part = lambda x: [F.format_string(t.replace("D(", "Debtor(").replace("R(", "Risk(").replace("W(", "Wealthy(").replace("x", "%1$s").replace("OWN", "%2$s"), F.col("who"), F.col("own")) for t in x]
        return answers(sequents(own, part(antecedent), part(consequent)), onto(spark, ("subClassOf", "Debtor", "Risk")))

    run.__name__ = name
    query(f"SELECT who AS qid, {sql} AS derivable FROM {CUST}")(run)


rule_query("rule_r1_left_not", ["OWN", "~W(x)"], ["R(x)"], f"NOT {HAS}")  # OWN => R, W
rule_query("rule_r2_left_if", ["OWN -> R(x)", "D(x)"], ["R(x)"], HAS)  # D => R, OWN; R, D => R; R, D => R, OWN
rule_query("rule_r3_left_and", ["OWN & OWN"], ["R(x)"], HAS)
rule_query("rule_r4_left_or", ["OWN | R(x)"], ["R(x)"], HAS)
rule_query("rule_r5_right_not", ["OWN"], ["~D(x)", "R(x)"], HAS)  # OWN, D => R: with W more than the schema's premise
rule_query("rule_r6_right_if", [], ["OWN -> R(x)"], HAS)
rule_query("rule_r7_right_and", ["OWN"], ["R(x) & OWN"], HAS)
rule_query("rule_r8_right_or", ["OWN"], ["R(x) | W(x)"], f"NOT {HAS}")  # W is contained; D => R, W is more than the schema's


@query(f"SELECT who || ' +' AS qid, true AS derivable FROM {CUST} UNION ALL SELECT who || ' -', false FROM {CUST}")
def supraclassical(spark, d):
    """Classical validities hold in any base, the empty one too: ((A -> B) & A) -> B; its converse does not."""
    own = customers(spark, d)
    good = F.format_string("((Debtor(%1$s) -> Risk(%1$s)) & Debtor(%1$s)) -> Risk(%1$s)", F.col("who"))
    bad = F.format_string("Risk(%1$s) -> ((Debtor(%1$s) -> Risk(%1$s)) & Debtor(%1$s))", F.col("who"))
    rows = [sequents(own.withColumn("q", F.concat("who", F.lit(sign))), F.expr(C.EMPTY), [text], "q") for sign, text in ((" +", good), (" -", bad))]
    return answers(rows[0].union(rows[1]), Base(spark, onto=True))


def same_answers(spark, d, left, right):
    """Whether two ways to say a sequent get one answer, and that answer."""
    own = one_each(spark, d)
    base = onto(spark, ("subClassOf", "Debtor", "Risk"), ("disjointWith", "Debtor", "Risk"))
    both = [answers(sequents(own, *side), base) for side in (left, right)]
    return both[0].withColumnRenamed("derivable", "one").join(both[1].withColumnRenamed("derivable", "other"), "qid")


def biconditional(name: str, left, right, sql: str) -> None:
    def run(spark, d):
        part = lambda x: [F.format_string(t.replace("R(", "Risk(").replace("x", "%1$s").replace("OWN", "%2$s"), F.col("who"), F.col("own")) for t in x]
        return same_answers(spark, d, (part(left[0]), part(left[1])), (part(right[0]), part(right[1])))

    run.__name__ = name
    query(f"SELECT who AS qid, {sql} AS one, {sql} AS other FROM {CUST}")(run)


biconditional("ddt_biconditional", (["OWN"], ["R(x)"]), ([], ["OWN -> R(x)"]), HAS)
biconditional("ii_biconditional", (["OWN", "R(x)"], []), ([], ["~(OWN & R(x))"]), HAS)
biconditional("aa_biconditional", (["OWN & R(x)"], []), (["OWN", "R(x)"], []), HAS)
biconditional("ss_biconditional", (["OWN"], ["R(x) | R(x)"]), (["OWN"], ["R(x)", "R(x)"]), HAS)


@query(f"SELECT CASE WHEN bool_or(NOT (preds = ['Debtor', 'SegBUILDING'])) THEN 2 ELSE 0 END AS exit_code FROM {CUST}")
def batch_exit_code(spark, d):
    lines = customers(spark, d).select(F.col("who").alias("qid"), F.concat(F.array_join("texts", ", "), F.lit(" => "), said("Risk")).alias("value"))
    return asking.exit_code(asking.ask_texts(lines, onto(spark, JOINT)))


@query(f"SELECT who AS qid, true AS before, false AS after FROM {DEBTORS}")
def commit_retract(spark, d):
    """What a source's schema licenses is gone once the source is retracted."""
    store = CommitmentStore(spark)
    store.commit_subclass("bank", "Debtor", "Obligor")
    store.commit_subclass("court", "Obligor", "Party")
    own = sequents(debtors(spark, d), [said("Debtor")], [said("Obligor")])
    before = answers(own, store.compile()).withColumnRenamed("derivable", "before")
    store.retract_schema("bank")
    return before.join(answers(own, store.compile()).withColumnRenamed("derivable", "after"), "qid")


NATIONS = "(SELECT n_nationkey AS k, replace(n_name, ' ', '_') AS n, 'N' || n_regionkey AS r FROM nation)"
#: SQL of a schema's pattern by its number modulo 7.
PATTERN_SQL = f"""SELECT k AS seq, CASE k % 7 WHEN 0 THEN '{{' || n || '(x)}} |~ {{' || r || '(x)}}' WHEN 1 THEN '{{' || n || '(x,y)}} |~ {{' || r || '(y)}}' WHEN 2 THEN '{{' || n || '(x,y)}} |~ {{' || r || '(x)}}'
 WHEN 3 THEN '{{' || n || '(x,y)}} |~ {{' || r || '(x,y)}}' WHEN 4 THEN '{{' || n || '(x), ' || r || '(x)}} |~' WHEN 5 THEN '{{' || n || '(x,y), ' || r || '(x,y)}} |~'
 ELSE '{{' || n || '(x), Other(x)}} |~ {{' || r || '(x)}}' END AS pattern FROM {NATIONS}"""


def nation_schemas(spark, d):
    own = spark.read.parquet(f"{d}/nation.parquet")
    kinds = F.array(*map(F.lit, model.SCHEMA_TYPES))
    kind = kinds[(F.col("n_nationkey") % 7).cast("int")]
    name = F.replace("n_name", F.lit(" "), F.lit("_"))
    arg1 = F.when(kind == "jointCommitment", F.array(name, F.lit("Other"))).otherwise(F.array(name))
    return own.select(F.col("n_nationkey").cast("long").alias("seq"), kind.alias("type"), arg1.alias("arg1"), F.concat(F.lit("N"), F.col("n_regionkey")).alias("arg2"))


@query(PATTERN_SQL)
def render_schemas(spark, d):
    """Schemas of a base as it shows them, in order of registration."""
    return Base(spark, onto=True).add_rows(schemas=nation_schemas(spark, d)).shown_schemas().select("seq", "pattern")


@query(f"SELECT seq, replace(replace(pattern, '{{', ''), '}}', '') AS pattern FROM ({PATTERN_SQL})")
def describe_patterns(spark, d):
    return nation_schemas(spark, d).select("seq", C.schema_pattern(F.col("type"), F.col("arg1"), F.col("arg2"), braces=False).alias("pattern"))


@query(f"SELECT who AS atom, CASE WHEN {HAS} THEN 'second' ELSE 'first' END AS description FROM {CUST}")
def annotate_upsert(spark, d):
    """An annotation is replaced by a later one of the same key."""
    own = customers(spark, d)
    old = own.select(F.col("who").alias("atom"), F.lit("first").alias("description"))
    new = own.where(F.array_contains("texts", said("Debtor"))).select(F.col("who").alias("atom"), F.lit("second").alias("description"))
    return Base(spark).add_rows(annotations=old).add_rows(annotations=new).annotations


@query("SELECT text, false AS bare_ok, true AS onto_ok FROM (SELECT pred || '(' || arg || ')' AS text FROM (" + abox.concepts_sql("customer") + ")) UNION ALL SELECT concat('c', c_custkey), true, false FROM customer")
def validate_members(spark, d):
    """Which texts may be members of a propositional base, and which of an ontology base."""
    texts = abox.concepts(spark, d, "customer").select(C.concept_text(F.col("pred"), F.col("arg")).alias("text"))
    texts = texts.union(spark.read.parquet(f"{d}/customer.parquet").select(F.expr("concat('c', c_custkey)")))
    bad = [Base(spark, onto=kind).rejected(texts).select("text", F.lit(False).alias(name)) for kind, name in ((False, "bare_ok"), (True, "onto_ok"))]
    out = texts.join(bad[0], "text", "left").join(bad[1], "text", "left")
    return out.select("text", F.coalesce("bare_ok", F.lit(True)).alias("bare_ok"), F.coalesce("onto_ok", F.lit(True)).alias("onto_ok"))


QUOTED = "'[' || array_to_string(['\"' || t || '\"' for t in texts], ',') || ']'"
RISKY = "preds = ['Debtor', 'SegBUILDING']"


def asked(spark, d):
    return explain.explain(sequents(customers(spark, d), F.col("texts"), [said("Risk")]), onto(spark, JOINT))


@query(f"SELECT who AS qid, '{{\"status\":\"' || CASE WHEN {RISKY} THEN 'DERIVABLE' ELSE 'NOT_DERIVABLE' END || '\",\"sequent\":{{\"antecedent\":' || {QUOTED} || ',\"consequent\":[\"Risk(' || who || ')\"]}},\"depth_reached\":0,\"cache_hits\":0}}' AS json, CASE WHEN {RISKY} THEN 0 ELSE 2 END AS code FROM {CUST}")
def ask_responses(spark, d):
    """Each answer as its JSON line, and its exit code."""
    return responses.ask_lines(asked(spark, d)).select("qid", "json", "code")


@query(f"""SELECT who AS qid, CASE WHEN {RISKY} THEN 'DERIVABLE' ELSE 'NOT DERIVABLE' END || '\n\nProof trace:\n  ' || CASE WHEN {RISKY} THEN 'AXIOM: ' ELSE 'FAIL: ' END
 || array_to_string(texts, ', ') || ' => Risk(' || who || ')\n\nDepth reached: 0\nCache hits: 0' AS text FROM {CUST}""".replace("\\n", "' || chr(10) || '").replace("\n ||", " ||").replace("\n", "' || chr(10) || '"))
def ask_texts_shown(spark, d):
    """Each answer as text with its trace."""
    return responses.ask_lines(asked(spark, d), True).select("qid", "text")


KEYS = "(SELECT concat('c', c_custkey) AS who FROM customer)"
GROUND = f"(SELECT unnest(['Debtor', 'Risk', 'SegBUILDING']) || '(' || who || ')' AS t FROM {KEYS})"


@query(f"""SELECT '{{"language":[' || (SELECT string_agg('"' || t || '"', ',' ORDER BY t) FROM {GROUND}) || '],"consequences":['
 || (SELECT string_agg('{{"antecedent":["Debtor(' || who || ')","SegBUILDING(' || who || ')"],"consequent":["Risk(' || who || ')"]}}', ',' ORDER BY 'Debtor(' || who || ')') FROM {KEYS})
 || '],"annotations":{{}},"individuals":[' || (SELECT string_agg('"' || who || '"', ',' ORDER BY who) FROM {KEYS}) || '],"concepts":["Debtor","Risk","SegBUILDING"],"roles":[],"onto_schemas":[]}}' AS json""")
def base_to_json(spark, d):
    """A base with a rule for every customer as one JSON text."""
    base = ground_rules(spark, d, "true")
    return files.document(base).select(F.to_json(F.struct("*")).alias("json"))


def traced(spark, d):
    base = onto(spark, ("subClassOf", "Debtor", "Risk"))
    text = F.format_string("(%2$s -> Risk(%1$s)) & (Wealthy(%1$s) | ~Wealthy(%1$s))", F.col("who"), F.col("own"))
    return explain.explain(sequents(one_each(spark, d), F.expr(C.EMPTY), [text]), base)


#: The trace of a debtor and of another customer; $ stands for the name.
TRACES = {
    True: ["[R∧] on (Debtor($) -> Risk($)) & (Wealthy($) | ~Wealthy($))", "  [R→] on (Debtor($) -> Risk($))", "    AXIOM: Debtor($) => Risk($)", "  [R∨] on (Wealthy($) | ~Wealthy($))", "    [R¬] on ~Wealthy($)", "      AXIOM: Wealthy($) => Wealthy($)",
           "  [R→] on (Debtor($) -> Risk($))", "    [R∨] on (Wealthy($) | ~Wealthy($))", "      [R¬] on ~Wealthy($)", "        AXIOM: Debtor($), Wealthy($) => Risk($), Wealthy($)"],
    False: ["[R∧] on (Wealthy($) -> Risk($)) & (Wealthy($) | ~Wealthy($))", "  [R→] on (Wealthy($) -> Risk($))", "    FAIL: Wealthy($) => Risk($)", "  FAIL: ∅ => (Wealthy($) -> Risk($))", "FAIL: ∅ => (Wealthy($) -> Risk($)) & (Wealthy($) | ~Wealthy($))"],
}


def listed(lines: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in lines) + "]"


@query(f"SELECT who AS qid, unnest(range(len(l))) AS step, unnest([replace(x, '$', who) for x in l]) AS line FROM (SELECT who, CASE WHEN {HAS} THEN {listed(TRACES[True])} ELSE {listed(TRACES[False])} END AS l FROM {CUST})")
def trace_lines(spark, d):
    return traced(spark, d).select("qid", F.posexplode("trace").alias("step", "line")).select("qid", F.col("step").cast("long").alias("step"), "line")


@query(f"SELECT who AS qid, {HAS} AS derivable, CASE WHEN {HAS} THEN 4 ELSE 2 END AS depth_reached, 0 AS cache_hits FROM {CUST}")
def proof_depth(spark, d):
    return traced(spark, d).select("qid", "derivable", "depth_reached", "cache_hits")


@query(f"SELECT who AS qid, CAST(CASE WHEN {HAS} THEN 9 ELSE 3 END AS BIGINT) AS leaves FROM {CUST}")
def proof_tree_leaves(spark, d):
    """Leaves of the proof tree of (A | B) -> ~(C & D) & E of debtors and A -> ~(C & D) & E of others; premises that meet again count again."""
    a = F.when(F.array_contains("texts", said("Debtor")), F.format_string("(A(%1$s) | B(%1$s))", F.col("who"))).otherwise(F.format_string("A(%1$s)", F.col("who")))
    own = sequents(customers(spark, d), F.expr(C.EMPTY), [F.concat(a, F.format_string(" -> ~(C(%1$s) & D(%1$s)) & E(%1$s)", F.col("who")))])
    return explain.proof_tree(own).where("rule = 'leaf'").groupBy("qid").agg(F.count("*").alias("leaves"))


@query(f"SELECT who AS qid, preds = ['Debtor', 'SegBUILDING'] AS holds FROM {CUST}")
def axiom_providers(spark, d):
    """An axiom provider of the user's own, here the ground form of a joint commitment."""

    def provider(leaves):
        who = F.regexp_extract(F.col("d")[0], r"\((\w+)\)", 1)
        return leaves.where((F.size("d") == 1) & (F.col("g") == F.array(F.concat(F.lit("Debtor("), who, F.lit(")")), F.concat(F.lit("SegBUILDING("), who, F.lit(")")))))

    base = Base(spark, onto=True)
    base.register_axioms(provider)
    own = customers(spark, d).select(F.col("who").alias("qid"), C.canonical(F.col("texts")).alias("g"), F.array(said("Risk")).alias("d"))
    return judged(own, base).select("qid", "holds")


# Files, edits, responses, commands: the outer operators, on the small tables region and nation and on customers.


def scratch(spark) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{(spark.conf.get('spark.checkpoint.dir', None) or 'file:///tmp/checkpoints/turnstile').rstrip('/')}/catalogue-{uuid.uuid4().hex}"


def nations(spark, d) -> DataFrame:
    """(k, n, r): key, name without blanks, region's key."""
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), F.replace("n_name", F.lit(" "), F.lit("_")).alias("n"), F.concat(F.lit("N"), F.col("n_regionkey")).alias("r"))


def bare_base(spark, d) -> Base:
    """A propositional base: every nation, that it goes with its region, and a note on each odd one."""
    own = nations(spark, d)
    return Base(spark).add_rows(own.select(F.col("n").alias("atom")), own.select(F.array("n").alias("antecedent"), F.array("r").alias("consequent")), annotations=own.where("k % 2 = 1").select(F.col("n").alias("atom"), F.concat(F.lit("no. "), "k").alias("description")))


def rich_base(spark, d) -> Base:
    """An ontology base: in(n,r) of every nation, a rule for it, schemas of all kinds, notes."""
    own = nations(spark, d).withColumn("t", F.concat(F.lit("in("), "n", F.lit(","), "r", F.lit(")")))
    rules = own.select(F.array("t").alias("antecedent"), F.array(F.concat(F.lit("Place("), "n", F.lit(")"))).alias("consequent"))
    return Base(spark, onto=True).add_rows(own.select(F.col("t").alias("atom")), rules, nation_schemas(spark, d), own.where("k % 2 = 1").select(F.col("t").alias("atom"), F.concat(F.lit("no. "), "k").alias("description")))


def contents(base: Base) -> DataFrame:
    """(part, text) of all that a base holds."""
    side = lambda c: F.array_join(c, ", ")
    out = base.language.select(F.lit("atom").alias("part"), F.col("atom").alias("text"))
    out = out.union(base.consequences.select(F.lit("rule"), F.concat(side("antecedent"), F.lit(" |~ "), side("consequent"))))
    out = out.union(base.annotations.select(F.lit("note"), F.concat("atom", F.lit(": "), "description")))
    if base.onto:
        out = out.union(base.shown_schemas().select(F.lit("schema"), F.concat("type", F.lit(" "), "pattern")))
        out = out.union(base.vocab.select("kind", "name"))
    return out


BARE_SQL = f"SELECT 'atom' AS part, n AS text FROM {NATIONS} UNION SELECT 'atom', r FROM {NATIONS} UNION SELECT 'rule', n || ' |~ ' || r FROM {NATIONS} UNION SELECT 'note', n || ': no. ' || k FROM {NATIONS} WHERE k % 2 = 1"
KINDS_SQL = "[" + ", ".join(f"'{k}'" for k in model.SCHEMA_TYPES) + "]"
RICH_SQL = f"""SELECT 'atom' AS part, 'in(' || n || ',' || r || ')' AS text FROM {NATIONS} UNION SELECT 'atom', 'Place(' || n || ')' FROM {NATIONS} UNION SELECT 'rule', 'in(' || n || ',' || r || ') |~ Place(' || n || ')' FROM {NATIONS}
 UNION SELECT 'note', 'in(' || n || ',' || r || '): no. ' || k FROM {NATIONS} WHERE k % 2 = 1 UNION SELECT 'schema', {KINDS_SQL}[CAST(seq % 7 AS INT) + 1] || ' ' || pattern FROM ({PATTERN_SQL})
 UNION SELECT 'individual', n FROM {NATIONS} UNION SELECT 'individual', r FROM {NATIONS} UNION SELECT 'concept', 'Place' UNION SELECT 'role', 'in'"""


def reloaded(base: Base) -> Base:
    """The base written as one JSON document and loaded from it."""
    at = scratch(base.spark)
    files.document(base).write.json(at)
    return files.load(base.spark, at, base.onto)


@query(BARE_SQL)
def load_base(spark, d):
    return contents(reloaded(bare_base(spark, d)))


@query(RICH_SQL)
def load_ontology(spark, d):
    return contents(reloaded(rich_base(spark, d)))


@query(BARE_SQL)
def dict_base(spark, d):
    return contents(files.from_dict(spark, files.to_dict(bare_base(spark, d))))


@query(RICH_SQL)
def dict_ontology(spark, d):
    return contents(files.from_dict(spark, files.to_dict(rich_base(spark, d)), True))


@query(BARE_SQL)
def file_base(spark, d):
    """Saved as a file on the driver and loaded from its text."""
    with tempfile.TemporaryDirectory() as at:
        files.save(bare_base(spark, d), f"{at}/b.json")
        return contents(files.from_dict(spark, json.loads(Path(f"{at}/b.json").read_text())))


@query(RICH_SQL)
def export_ontology(spark, d):
    """Written as folders of JSON lines by many tasks, and read again."""
    at = scratch(spark)
    files.export(rich_base(spark, d), at)
    return contents(files.import_(spark, at, True))


@query(BARE_SQL)
def constructor(spark, d):
    """A base made of values, one edit at a time."""
    rows = nations(spark, d).collect()
    base = Base(spark, [r.n for r in rows], [], {r.n: "old" for r in rows if r.k % 2})
    for r in rows:
        base.add_consequence([r.n], [r.r])
        if r.k % 2:
            base.annotate(r.n, f"no. {r.k}")
    return contents(base)


@query(f"SELECT 'atom' AS part, 'in(' || n || ',' || r || ')' AS text FROM {NATIONS} UNION SELECT 'atom', 'Place(' || n || ')' FROM {NATIONS} UNION SELECT 'individual', n FROM {NATIONS} UNION SELECT 'individual', r FROM {NATIONS} UNION SELECT 'concept', 'Place' UNION SELECT 'role', 'in'")
def single_edits(spark, d):
    """Atoms and individuals added one by one, twice."""
    base = Base(spark, onto=True)
    for r in nations(spark, d).collect() * 2:
        base.add_atom(f"Place({r.n})")
        base.add_individual("in", r.n, r.r)
    return contents(base)


PROPOSITIONAL = "(SELECT 'c' || c_custkey AS who, c_acctbal < 0 AS owes FROM customer)"


@query(f"SELECT who AS qid, owes AS derivable FROM {PROPOSITIONAL} UNION ALL SELECT who || ' +', false FROM {PROPOSITIONAL} UNION ALL SELECT who || ' =', true FROM {PROPOSITIONAL}")
def propositional_ask(spark, d):
    """Propositional rules: what owes is bad; with a premise more it is not; what is said is said."""
    who = spark.read.parquet(f"{d}/customer.parquet").select(F.expr("concat('c', c_custkey)").alias("who"), "c_acctbal")
    base = Base(spark).add_rows(consequences=who.where("c_acctbal < 0").select(F.array(F.concat("who", F.lit(" owes"))).alias("antecedent"), F.array(F.concat("who", F.lit(" bad"))).alias("consequent")))
    owes, bad, more = (F.concat("who", F.lit(x)) for x in (" owes", " bad", " more"))
    cases = [("", [owes], [bad]), (" +", [owes, more], [bad]), (" =", [owes, more], [bad, owes])]
    rows = [sequents(who.withColumn("q", F.concat("who", F.lit(x))), g, c, "q") for x, g, c in cases]
    return answers(rows[0].union(rows[1]).union(rows[2]), base)


@query(f"SELECT who AS qid, {HAS} AS derivable FROM {CUST} UNION ALL SELECT who || ' &', false FROM {CUST}")
def unfit_members(spark, d):
    """A member that is no assertion fits no schema, nor does a compound that reduces to more than one."""
    own = customers(spark, d).withColumn("own", F.when(F.array_contains("texts", said("Debtor")), said("Debtor")).otherwise(F.concat(F.lit("bare "), "who")))
    both = own.withColumn("q", F.concat("who", F.lit(" &"))).withColumn("two", F.concat("own", F.lit(" & "), said("Wealthy")))
    return answers(sequents(own, [F.col("own")], [said("Risk")]).union(sequents(both, [F.col("two")], [said("Risk")], "q")), onto(spark, ("subClassOf", "Debtor", "Risk")))


FORMS = "(SELECT who, unnest([who, 'Debtor(' || who || ')', 'in(' || who || ', x)', '~' || who, '(' || who || ')', who || ' & ' || who, 'A(' || who || ') -> B', '']) AS t, unnest([true, true, true, false, true, false, false, NULL]) AS atomic, unnest([false, true, true, false, false, false, false, false]) AS assertion FROM (SELECT 'c' || c_custkey AS who FROM customer))"


@query(f"SELECT who || '|' || t AS text, atomic, assertion, coalesce(atomic, false) AND NOT assertion AS bare_ok FROM {FORMS}")
def member_tests(spark, d):
    """What is atomic, an assertion, or a member of a propositional base, by the parser."""
    who = spark.read.parquet(f"{d}/customer.parquet").select(F.expr("concat('c', c_custkey)").alias("who"))
    forms = ["%1$s", "Debtor(%1$s)", "in(%1$s, x)", "~%1$s", "(%1$s)", "%1$s & %1$s", "A(%1$s) -> B", ""]
    rows = who.select("who", F.explode(F.array(*[F.format_string(f, "who") if f else F.lit("") for f in forms])).alias("t"))
    ship(spark)

    def tests(t):
        try:
            atomic = formula.all_atomic([t])
        except formula.Malformed:
            atomic = None
        try:
            fine = bool(check_member(t, False) or True)
        except ValueError:
            fine = False
        return atomic, assertions_of.all_onto_atomic([t]), fine

    return rows.select(F.concat("who", F.lit("|"), "t").alias("text"), F.udf(tests, "struct<atomic: boolean, assertion: boolean, bare_ok: boolean>", useArrow=True)("t").alias("x")).select("text", "x.*")


def told_lines(spark, d) -> DataFrame:
    """(qid, value): a batch of statements on nations, written as a text file and read again."""
    own = nations(spark, d).select("k", F.array(
        F.lit("# of a nation"), F.lit(""), F.concat(F.lit("  atom in("), "n", F.lit(","), "r", F.lit(') "no. '), "k", F.lit('"')), F.concat(F.lit("in("), "n", F.lit(","), "r", F.lit(") |~ Place("), "n", F.lit(")")),
        F.concat(F.lit("schema subClassOf Place"), "k", F.lit(" Place 'why'")), F.concat("n", F.lit(" & x |~ y")), F.concat(F.lit("nonsense on "), "n"),
    ).alias("l"))
    at = scratch(spark)
    own.orderBy("k").coalesce(1).select(F.explode("l")).write.text(at)
    return files.lines(spark, at)


@query(f"""SELECT 'atom' AS part, 'in(' || n || ',' || r || ')' AS text FROM {NATIONS} UNION SELECT 'atom', 'Place(' || n || ')' FROM {NATIONS} UNION SELECT 'rule', 'in(' || n || ',' || r || ') |~ Place(' || n || ')' FROM {NATIONS}
 UNION SELECT 'note', 'in(' || n || ',' || r || '): no. ' || k FROM {NATIONS} UNION SELECT 'schema', 'subClassOf {{Place' || k || '(x)}} |~ {{Place(x)}}' FROM {NATIONS} UNION SELECT 'individual', n FROM {NATIONS} UNION SELECT 'individual', r FROM {NATIONS} UNION SELECT 'concept', 'Place' UNION SELECT 'role', 'in'""")
def tell_batch(spark, d):
    """Statements applied in bulk; those that are not valid change nothing."""
    base = Base(spark, onto=True)
    return contents(files.apply(base, files.checked(files.statements(told_lines(spark, d)), base)))


@query(f"""SELECT k * 7 + x AS qid, CASE x WHEN 2 THEN '{{"action":"added_atom","atom":"in(' || n || ',' || r || ')","base_file":"b.json","annotation":"no. ' || k || '"}}'
 WHEN 3 THEN '{{"action":"added_consequence","consequence":{{"antecedent":["in(' || n || ',' || r || ')"],"consequent":["Place(' || n || ')"]}},"base_file":"b.json"}}'
 WHEN 4 THEN '{{"action":"registered_subClassOf_schema","details":"{{Place' || k || '(x)}} |~ {{Place(x)}}","base_file":"b.json","annotation":"why"}}' ELSE 'error' END AS json, CASE WHEN x < 5 THEN 0 ELSE 1 END AS code FROM {NATIONS}, (SELECT unnest([2, 3, 4, 5, 6]) AS x)""")
def tell_responses(spark, d):
    """The JSON line of every statement."""
    base = Base(spark, onto=True)
    got = responses.tell_lines(files.checked(files.statements(told_lines(spark, d)), base), "b.json")
    return got.select(F.col("qid").cast("long").alias("qid"), F.when(F.col("error").isNull(), F.col("json")).otherwise("error").alias("json"), "code")


@query(f"""SELECT k * 7 + x AS qid, CASE x WHEN 2 THEN 'Added atom: in(' || n || ',' || r || ') — no. ' || k WHEN 3 THEN 'Added consequence: {{in(' || n || ',' || r || ')}} |~ {{Place(' || n || ')}}' ELSE 'Registered subClassOf schema: {{Place' || k || '(x)}} |~ {{Place(x)}} — why' END AS text FROM {NATIONS}, (SELECT unnest([2, 3, 4]) AS x)""")
def tell_texts(spark, d):
    """The text line of every valid statement."""
    base = Base(spark, onto=True)
    got = responses.tell_lines(files.checked(files.statements(told_lines(spark, d)), base), "b.json")
    return got.where("error is null").select(F.col("qid").cast("long").alias("qid"), "text")


@query(f"SELECT k AS seq, {KINDS_SQL}[CAST(k % 7 AS INT) + 1] AS type, n || CASE k % 7 WHEN 6 THEN ',Other' ELSE '' END AS arg1, r AS arg2, CASE k % 2 WHEN 1 THEN 'note ' || k END AS annotation, false AS failed FROM {NATIONS} UNION ALL SELECT k + 100, NULL, NULL, NULL, NULL, true FROM {NATIONS}")
def parse_schema_lines(spark, d):
    """Schema lines read: further words are passed over, lines with too few are errors."""
    own = nation_schemas(spark, d)
    note = F.when(F.col("seq") % 2 == 1, F.concat(F.lit(" 'note "), "seq", F.lit("'"))).otherwise(" and more")
    lines = own.select(F.col("seq").alias("qid"), F.concat(F.lit("schema "), "type", F.lit("  "), F.array_join("arg1", ","), F.lit(" "), "arg2", note).alias("value"))
    short = own.select((F.col("seq") + 100).alias("qid"), F.concat(F.lit("schema "), "type", F.lit(" "), "arg2").alias("value"))
    got = files.statements(lines.union(short))
    return got.select(F.col("qid").alias("seq"), "type", F.array_join("arg1", ",").alias("arg1"), "arg2", "annotation", F.col("error").isNotNull().alias("failed"))


@query(f"SELECT k * 5 + x AS qid, CASE x WHEN 2 THEN true WHEN 3 THEN false END AS derivable, x = 4 AS failed FROM {NATIONS}, (SELECT unnest([2, 3, 4]) AS x)")
def ask_batch_file(spark, d):
    """A file of queries with comments and blank lines, answered; a line without => is an error."""
    own = nations(spark, d).select("k", F.array(F.lit("# of a nation"), F.lit(" "), F.concat("n", F.lit(" => "), "r"), F.concat("n", F.lit(", x => "), "r"), F.concat("n", F.lit(" = "), "r")).alias("l"))
    at = scratch(spark)
    own.orderBy("k").coalesce(1).select(F.explode("l")).write.text(at)
    got = asking.ask_texts(files.lines(spark, at), bare_base(spark, d))
    return got.select(F.col("qid").cast("long").alias("qid"), "derivable", F.col("error").isNotNull().alias("failed"))


@query(f"SELECT n AS atom, CASE k % 2 WHEN 1 THEN 'no. ' || k END AS description FROM {NATIONS} UNION SELECT r, NULL FROM {NATIONS}")
def shown_language(spark, d):
    return bare_base(spark, d).shown_language()


@query(f"SELECT 'individual' AS kind, (SELECT string_agg(x, ' ' ORDER BY x) FROM (SELECT n AS x FROM {NATIONS} UNION SELECT r FROM {NATIONS})) AS names UNION ALL SELECT 'concept', 'Place' UNION ALL SELECT 'role', 'in'")
def shown_vocabulary(spark, d):
    return rich_base(spark, d).shown_vocab().select("kind", F.array_join("names", " ").alias("names"))


REGIONS = "(SELECT CAST(r_regionkey AS BIGINT) AS k, replace(r_name, ' ', '_') AS n FROM region)"


def regions(spark, d) -> list:
    return spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").cast("long").alias("k"), F.replace("r_name", F.lit(" "), F.lit("_")).alias("n")).orderBy("k").collect()


@query(f"""SELECT 0 AS part, 0 AS k, '  Assertions: ' || 4 * count(*) AS line FROM {REGIONS} UNION ALL SELECT 1, k, '    Region(' || n || ')' FROM {REGIONS} UNION ALL SELECT 1, k, '    on(' || n || ',Earth)' FROM {REGIONS}
 UNION ALL SELECT 1, k, '    Near(' || n || ')' FROM {REGIONS} UNION ALL SELECT 1, k, '    Here(' || n || ')' FROM {REGIONS} UNION ALL SELECT 2, 0, '  Ontology Schemas: ' || count(*) FROM {REGIONS} WHERE k <> 2
 UNION ALL SELECT 3, k, '    [s' || k || '] jointCommitment: Region(x), Is_' || n || '(x) |~ Known(x)' FROM {REGIONS} WHERE k <> 2 UNION ALL SELECT 4, 0, '  Ground rules: ' || count(*) FROM {REGIONS} UNION ALL SELECT 5, k, '    {{Near(' || n || ')}} |~ {{Here(' || n || ')}}' FROM {REGIONS}""")
def store_report(spark, d):
    """What a store of commitments says of itself after a source was taken back."""
    store, own = CommitmentStore(spark), regions(spark, d)
    for r in own:
        store.add_concept("Region", r.n)
        store.add_role("on", r.n, "Earth")
        store.commit_joint_commitment(f"s{r.k}", ["Region", f"Is_{r.n}"], "Known")
        store.commit_defeasible_rule(f"s{r.k}", [f"Near({r.n})"], [f"Here({r.n})"])
    store.retract_schema("s2")
    rows = []
    for line in store.describe().splitlines()[1:]:
        part = 0 if line.startswith("  Assertions") else 2 if line.startswith("  Ontology") else 4 if line.startswith("  Ground") else 3 if "[s" in line else 5 if "|~" in line else 1
        rows.append((part, max([r.k for r in own if f"({r.n}" in line or f"Is_{r.n}" in line], default=0), line))
    return spark.createDataFrame(rows, "part int, k long, line string")


@query(f"""SELECT k AS k, unnest(range(8)) AS step, unnest(['Added atom: ' || n, 'Added: {{' || n || '}} |~ {{Earth}}', 'DERIVABLE', 'NOT DERIVABLE', 'Trace: ON', 'DERIVABLE / ' || '  AXIOM: ' || n || ' => Earth / ' || '  Depth: 0, Cache hits: 0', 'Error: Invalid sequent: expected "A, B => C, D".', 'Unknown command: ''nonsense''. Type ''help'' for commands.']) AS said FROM {REGIONS}""")
def repl_transcript(spark, d):
    """A session at the prompt for every region."""
    rows = []
    for r in regions(spark, d):
        loop = cli.Loop(spark, Base(spark))
        lines = [f"tell atom {r.n}", f"tell {r.n} |~ Earth", f"ask {r.n} => Earth", f"ask {r.n}, x => Earth", "trace on", f"ask {r.n} => Earth", f"ask {r.n}", "nonsense"]
        rows += [(r.k, i, (loop.answer(x) or "").replace("\n", " / ")) for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "k long, step long, said string")


@query("""SELECT * FROM (VALUES (0, 1, 'error'), (1, 0, 'added_consequence'), (2, 1, 'added_atom added_consequence error'), (3, 0, 'DERIVABLE'), (4, 2, 'NOT_DERIVABLE'), (5, 1, 'DERIVABLE NOT_DERIVABLE error'), (6, 0, 'DERIVABLE'), (7, 1, 'error'))
 AS t(step, code, said) WHERE (SELECT count(*) FROM region) > 0""")
def command_line(spark, d):
    """Commands with files, batches and standard input: exit codes and what each line says."""
    a, b = [r.n for r in regions(spark, d)][:2]
    rows = []
    with tempfile.TemporaryDirectory() as at:
        Path(f"{at}/t.txt").write_text(f"# batch\natom {b} 'note'\n{b} |~ Earth\n{a} & {b} |~ Earth\n")
        Path(f"{at}/q.txt").write_text(f"{b} => Earth\n{a}, {b} => Earth\n{a}\n")
        base = ["-b", f"{at}/b.json", "--json"]
        steps = [
            (["tell", *base, f"{a} |~ Earth"], ""), (["tell", *base, "--create", f"{a} |~ Earth"], ""), (["tell", *base, "--batch", f"{at}/t.txt"], ""), (["ask", *base, f"{a} => Earth"], ""),
            (["ask", *base, f"{a}, x => Earth"], ""), (["ask", *base, "--batch", f"{at}/q.txt"], ""), (["ask", *base, "-"], f"{b} => Earth\n"), (["ask", *base, f"{a} -> => Earth"], ""),
        ]
        for i, (args, typed) in enumerate(steps):
            out, before = io.StringIO(), sys.stdin
            sys.stdin = io.StringIO(typed)
            try:
                with contextlib.redirect_stdout(out):
                    code = cli.main(args)
            finally:
                sys.stdin = before
            said_ = [json.loads(x) for x in out.getvalue().splitlines()]
            rows.append((i, code, " ".join(x.get("status") or x.get("action") or "error" for x in said_)))
    return spark.createDataFrame(rows, "step int, code int, said string")
