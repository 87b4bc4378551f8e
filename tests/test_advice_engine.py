
import json

from turnstile import catalogue
from turnstile.operators.base import Base


def test_annotations_in_bulk(spark, tmp_path, monkeypatch):
    """annotate_upsert: a base keeps the later annotation of a key, and the query returns a base's annotations."""
    base = Base(spark)
    base.annotate("a", "one")
    rows = lambda *x: spark.createDataFrame(x, "atom string, description string")
    base.add_rows(annotations=rows(("a", "two"), ("b", "two"))).add_rows(annotations=rows(("b", "three"), ("b", "four")))
    base.annotate("c", "five")
    assert {tuple(r) for r in base.annotations.collect()} == {("a", "two"), ("b", "three"), ("c", "five")}
    spark.createDataFrame([(1, "BUILDING", -5.0), (2, "BUILDING", 5.0)], "c_custkey long, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    seen = []
    monkeypatch.setattr(catalogue, "Base", lambda *a, **b: seen.append(Base(*a, **b)) or seen[-1])
    got = catalogue.annotate_upsert(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {("c1", "second"), ("c2", "first")} == {tuple(r) for r in seen[0].annotations.collect()}


def test_base_of_all_customers(spark, tmp_path):
    """base_to_json: customers with odd keys have their rules in it too."""
    spark.createDataFrame([(i,) for i in range(1, 6)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    (row,) = catalogue.base_to_json(spark, str(tmp_path)).collect()
    assert len(json.loads(row.json)["consequences"]) == 5
