"""Bases, batches of queries, files, commitments, commands and streams on Spark."""

import json

import pytest

from turnstile.cli import Loop, main
from turnstile.operators.base import Base
from turnstile.operators.commitments import CommitmentStore
from turnstile.plans.ask import ask, ask_texts, exit_code
from turnstile.plans.explain import explain, proof_tree, trace_lines
from turnstile.sources import files

SEQUENT = "qid string, antecedent array<string>, consequent array<string>"


def check(spark, base, cases):
    rows = [(f"{i}", list(g), list(d)) for i, (g, d, _) in enumerate(cases)]
    got = {r.qid: r.derivable for r in ask(spark.createDataFrame(rows, SEQUENT), base).collect()}
    assert got == {f"{i}": e for i, (_, _, e) in enumerate(cases)}


def test_toy_base(spark):
    base = Base(spark, "ABC", [("A", "B"), ("B", "C")])
    check(spark, base, [
        ("A", "B", True), ("A", "C", False), ("AC", "B", False), ((), ["A -> B"], True), ((), ["A | ~A"], True), (["A", "~A"], "B", True),
        ((), (), False), ("A", "AB", True), (["(A)"], "B", True), ([" A "], "B", True), (["A & A"], "B", True), (["X"], ["X"], True),
    ])


def test_worked_examples(spark):
    tree = Base(spark, "pqrs", [("pr", "q"), ("s", "q"), ("prs", "q")])
    check(spark, tree, [((), ["((p & r) | s) -> q"], True), ("p", "q", False)])
    law = Base(spark, "pqr", [((), "p"), ((), "qr"), ((), "pqr")])
    check(spark, law, [((), ["p & (q | r)"], True), ((), ["(p & q) | (p & r)"], False)])
    check(spark, Base(spark, "pqrs"), [("p", ["~p", "q"], False), (["p", "q"], ["p & q"], True), (["p | q"], "p", False)])
    toy = Base(spark, "pqrstuvwx", [("p", "q"), ("st", ()), ("pq", "v"), ("s", "w"), ("sw", "x")])
    check(spark, toy, [("p", "q", True), (["s", "t"], (), True), ("pq", "v", True), ("p", "v", False), (["s", "w"], "x", True), ("s", "x", False), ((), ["~(s & t)"], True)])


def onto(spark, *schemas, language=()):
    base = Base(spark, language, onto=True)
    for kind, a, b in schemas:
        base.register(kind, a, b)
    return base


def test_schemas(spark):
    base = onto(
        spark, ("subClassOf", "Man", "Mortal"), ("range", "hasChild", "Person"), ("domain", "hasChild", "Parent"), ("subPropertyOf", "hasChild", "hasDescendant"),
        ("disjointWith", "Dead", "Alive"), ("disjointProperties", "employs", "competes"), ("jointCommitment", ["Chest", "Trop"], "MI"), ("subClassOf", "Mortal", "Thing"),
    )
    child = ["hasChild(alice,bob)"]
    check(spark, base, [
        (["Man(s)"], ["Mortal(s)"], True), (["Man(s)"], ["Mortal(t)"], False), (["Man(s)", "Immortal(s)"], ["Mortal(s)"], False), (["Man(s)"], ["Thing(s)"], False),
        (child, ["Person(bob)"], True), (child, ["Person(alice)"], False), (child, ["Parent(alice)"], True), (child, ["Parent(bob)"], False),
        (child, ["hasDescendant(alice, bob)"], True), (child, ["hasDescendant(bob,alice)"], False), (["Alive(x)", "Dead(x)"], [], True), (["Alive(x)", "Dead(y)"], [], False),
        (["Alive(x)", "Dead(x)"], ["C(x)"], False), (["Alive(x)", "Dead(x)", "C(x)"], [], False), (["competes(a,b)", "employs(a,b)"], [], True), (["competes(a,b)", "employs(b,a)"], [], False),
        (["Trop(p)", "Chest(p)"], ["MI(p)"], True), (["Trop(p)"], ["MI(p)"], False), (["Trop(p)", "Chest(p)", "X(p)"], ["MI(p)"], False), (["Trop(p)", "Chest(q)"], ["MI(p)"], False),
        ([], ["Man(s) -> Mortal(s)"], True), (["bare"], ["Mortal(s)"], False), (["R(é,b)"], ["R(é,b)"], True),
    ])


def test_search_agrees_on_schemas(spark):
    base = onto(spark, ("subClassOf", "A", "B"), ("jointCommitment", ["A", "B"], "C"), ("range", "r", "A"), ("disjointWith", "A", "C"))
    base.add_consequence(["A(x)"], ["D(x)"])
    texts = ["A(x)", "B(x)", "C(x)", "A(y)", "r(y,x)", "D(x)", "~A(x)", "A(x) & B(x)"]
    rows = [(f"{i}", [a, b], [c] if c else []) for i, (a, b, c) in enumerate((a, b, c) for a in texts for b in texts for c in [*texts, None])]
    queries = spark.createDataFrame(rows, SEQUENT)
    both = ask(queries, base).join(explain(queries, base).withColumnRenamed("derivable", "searched"), "qid").collect()
    assert len(both) == len(rows) and all(r.derivable == r.searched for r in both)


def test_validation(spark):
    base, ob = Base(spark), Base(spark, onto=True)
    for bad in ("p & q", "~p", "C(a)", "R(a, b)", ""):
        with pytest.raises(ValueError):
            base.add_atom(bad)
    for bad in ("p", "C(a) & D(a)", "C()", "R(a,b,c)"):
        with pytest.raises(ValueError):
            ob.add_atom(bad)
    with pytest.raises(ValueError):
        ob.register_joint_commitment(["C"], "D")
    ob.add_individual("R", "a", "b")
    ob.add_consequence(["C(a)"], [])
    assert {(r.kind, r.name) for r in ob.vocab.collect()} == {("role", "R"), ("concept", "C"), ("individual", "a"), ("individual", "b")}
    built = Base(spark, ["p"], [("q", "r")])
    assert [r.atom for r in built.language.collect()] == ["p"]
    built.add_consequence("q", "r")
    assert sorted(r.atom for r in built.language.collect()) == ["p", "q", "r"] and built.consequences.count() == 1


def test_files(spark, tmp_path):
    base = Base(spark, ["C(a)"], [(["C(a)"], ["D(a)"])], {"C(a)": "first"}, onto=True)
    base.annotate("C(a)", "ünï")
    base.register_subclass("C", "D", annotation="why")
    base.register_joint_commitment(["C", "D"], "E")
    at = str(tmp_path / "b.json")
    files.save(base, at)
    data = json.loads(open(at).read())
    assert data["annotations"] == {"C(a)": "ünï"} and data["individuals"] == ["a"]
    assert data["onto_schemas"] == [{"type": "subClassOf", "arg1": "C", "arg2": "D", "annotation": "why"}, {"type": "jointCommitment", "arg1": ["C", "D"], "arg2": "E"}]
    assert files.to_dict(files.load(spark, at, onto=True)) == data == files.to_dict(files.from_dict(spark, data, onto=True))
    (tmp_path / "empty.json").write_text("{}")
    assert files.to_dict(files.load(spark, str(tmp_path / "empty.json"))) == {"language": [], "consequences": []}
    (tmp_path / "bad.json").write_text('{"language": ["p & q"]}')
    with pytest.raises(ValueError):
        files.load(spark, str(tmp_path / "bad.json"))


def test_batch_of_texts(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# comment\n\nA => B\n  A, C => B\n=> A -> B\nnonsense\nA & => B\nhasChild(a,b), C(a) => C(a)\n")
    got = ask_texts(files.lines(spark, str(tmp_path / "q.txt")), Base(spark, "AB", [("A", "B")]))
    rows = {r.qid: (r.derivable, bool(r.error)) for r in got.collect()}
    assert rows == {2: (True, False), 3: (False, False), 4: (True, False), 5: (None, True), 6: (None, True), 7: (True, False)}
    assert exit_code(got).first()[0] == 1 and exit_code(got.where("qid < 5")).first()[0] == 2 and exit_code(got.where("qid = 2")).first()[0] == 0 and exit_code(got.where("qid < 0")).first()[0] == 0


def test_statements(spark):
    lines = ["atom X", 'ATOM p "a text"', "atom q 'open", "A, B |~ C", "|~ p", "s, t |~", "junk", 'schema subClassOf A B extra "n"', "schema range R", "schema jointCommitment A,B C", "schema jointCommitment A C", "R(a,b), C(a) |~ D(b)"]
    rows = files.statements(spark.createDataFrame(list(enumerate(lines)), "qid int, value string")).orderBy("qid").collect()
    assert [r.kind for r in rows] == ["atom"] * 3 + ["consequence"] * 3 + [None] + ["schema"] * 4 + ["consequence"]
    assert [bool(r.error) for r in rows] == [False] * 6 + [True, False, True, False, True, False]
    assert (rows[1].atom, rows[1].annotation, rows[2].annotation) == ("p", "a text", "open")
    assert (rows[3].antecedent, rows[4].antecedent, rows[5].consequent, rows[11].antecedent) == (["A", "B"], [], [], ["C(a)", "R(a,b)"])
    assert (rows[7].arg1, rows[7].arg2, rows[7].annotation, rows[9].arg1) == (["A"], "B", "n", ["A", "B"])


def test_commitments(spark):
    store = CommitmentStore(spark)
    store.add_concept("Man", "a")
    store.add_role("r", "a", "b")
    store.commit_subclass("s1", "Man", "Mortal")
    store.commit_joint_commitment("s2", ["A", "B"], "C")
    store.commit_defeasible_rule("s3", ["X(a)"], ["Y(a)"])
    base = store.compile()
    assert base is store.compile()
    check(spark, base, [(["Man(z)"], ["Mortal(z)"], True), (["X(a)"], ["Y(a)"], True)])
    assert store.describe().splitlines() == [
        "Commitment Store:", "  Assertions: 4", "    Man(a)", "    X(a)", "    Y(a)", "    r(a,b)", "  Ontology Schemas: 2",
        "    [s1] subClassOf: Man(x) |~ Mortal(x)", "    [s2] jointCommitment: A(x), B(x) |~ C(x)", "  Ground rules: 1", "    {X(a)} |~ {Y(a)}",
    ]
    store.retract_schema("s1")
    check(spark, store.compile(), [(["Man(z)"], ["Mortal(z)"], False), (["X(a)"], ["Y(a)"], True)])


def test_explanations(spark):
    base = Base(spark, "pq", [("p", "q")])
    queries = spark.createDataFrame([("1", ["p | q"], ["q"]), ("2", ["p &"], [])], SEQUENT)
    rows = {r.qid: r for r in explain(queries, base).collect()}
    assert rows["1"].trace == ["[L∨] on p | q", "  AXIOM: p => q", "  AXIOM: q => q", "  FAIL: p, q => q"][:3] + ["  AXIOM: p, q => q"] and rows["2"].error
    leaves = proof_tree(queries.where("qid = 1")).where("rule = 'leaf'").collect()
    assert sorted((tuple(r.g), tuple(r.d)) for r in leaves) == [(("p",), ("q",)), (("p", "q"), ("q",)), (("q",), ("q",))]
    assert trace_lines(queries, base).groupBy("qid").count().orderBy("qid").collect() == [("1", 4), ("2", 1)]


def test_proof_trees_of_a_batch(spark):
    """Each tree needs its own row only, and is whole however deep; a side may be null."""
    deep = "~" * 151 + "p"
    tree = proof_tree(spark.createDataFrame([("deep", [deep], []), ("null", None, ["p | q"]), ("none", [], [])], SEQUENT))
    rows = {}
    for r in tree.collect():
        rows.setdefault(r.qid, []).append((r.level, r.rule, r.g, r.d))
    assert len(rows["deep"]) == 152 and max(rows["deep"]) == (151, "leaf", [], ["p"]) and min(rows["deep"]) == (0, f"L {deep}", [deep], [])
    assert sorted(rows["null"]) == [(0, "R p | q", [], ["p | q"]), (1, "leaf", [], ["p", "q"])] and rows["none"] == [(0, "leaf", [], [])]
    plan = tree._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Join", "Aggregate", "UnionLoop", "Exchange"))


def test_one_answer_by_all_paths(spark):
    """Answers and explanations agree: parentheses, white space, providers, deep sentences, many disjuncts."""
    base = Base(spark, "AB", [("A", "B"), (["((C))"], ["D"])])
    base.register_axioms(lambda rows: rows.where("array_contains(g, 'magic')"))
    deep = "~" * 3000
    wide = " | ".join(f"x{i}" for i in range(14))
    rows = [(["(A)"], ["B"], True), ([" A "], ["(B)"], True), (["C"], ["D"], True), (["((C))"], ["(D)"], True), (["magic"], ["B"], True), (["A | magic"], ["B"], True), (["x | magic"], ["B"], False), (["magic & A"], [], True), ([wide], ["A"], False), (["A &"], [], None), ([f"{deep}A"], ["B"], True)]
    queries = spark.createDataFrame([(f"{i}", g, d) for i, (g, d, _) in enumerate(rows)], SEQUENT)
    expected = {f"{i}": e for i, (_, _, e) in enumerate(rows)}
    assert {r.qid: r.derivable for r in ask(queries, base).collect()} == expected
    expected["10"] = False  # the depth limit of an explanation
    assert {r.qid: r.derivable for r in explain(queries, base).collect()} == expected


def test_commands(spark, tmp_path, capsys):
    at = str(tmp_path / "b.json")
    assert main(["tell", "-b", at, "A |~ B"]) == 1
    assert main(["tell", "-b", at, "--create", "A |~ B"]) == 0
    (tmp_path / "t.txt").write_text("atom C\np & q |~ r\nD |~ E\n")
    assert main(["tell", "-b", at, "-q", "--batch", str(tmp_path / "t.txt")]) == 1  # good lines are saved
    assert [main(["ask", "-b", at, "-q", q]) for q in ("A => B", "A, C => B", "D => E", "A ->  => B")] == [0, 2, 0, 1]
    capsys.readouterr()
    assert main(["ask", "-b", at, "--json", "A => B"]) == 0
    assert json.loads(capsys.readouterr().out) == {"status": "DERIVABLE", "sequent": {"antecedent": ["A"], "consequent": ["B"]}, "depth_reached": 0, "cache_hits": 0}
    loop = Loop(spark, Base(spark, onto=True))
    assert loop.answer("tell schema subClassOf Man Mortal").startswith("Registered subClassOf") and loop.answer("ask Man(a) => Mortal(a)") == "DERIVABLE"
    assert loop.answer("tell schema subClassOf Man") .startswith("Usage") and loop.answer("nonsense").startswith("Unknown") and loop.answer("quit") is None


def test_stream(spark, tmp_path):
    from turnstile.streaming.ask import answer_stream

    rows = [("1", ["A"], ["B"]), ("2", ["A", "C"], ["B"])]
    spark.createDataFrame(rows, SEQUENT).write.json(str(tmp_path / "in"))
    got = []
    answer_stream(spark.readStream.schema(SEQUENT).json(str(tmp_path / "in")), Base(spark, "AB", [("A", "B")]), lambda df, _: got.extend(df.collect()), str(tmp_path / "check")).awaitTermination(120)
    assert {r.qid: r.derivable for r in got} == {"1": True, "2": False}


def test_empty_batch(spark):
    assert ask(spark.createDataFrame([], SEQUENT), Base(spark, "A")).count() == 0
