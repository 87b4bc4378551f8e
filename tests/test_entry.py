"""The entry point, and that nothing outside turnstile.llm needs it."""

from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_training_operators_are_apart():
    for f in (ROOT / "turnstile").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "turnstile.llm" not in f.read_text(), f


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["qid", "derivable"] and rows.where("derivable").count() == 2
