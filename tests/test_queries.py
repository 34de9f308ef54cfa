import pytest

from tessera.plans import registry
from tests.oracle import agree


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, name):
    agree(spark, registry.QUERIES[name], registry.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id", "score"]


def test_document_licences_against_brute_force(spark):
    import re

    from tessera.operators.project import LICENCES

    sf, want = "/root/testdata/sf0.01", {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        name = next((n for p, n in LICENCES if re.search(p, r["text"] or "", re.IGNORECASE | re.DOTALL)), None)
        if name:
            want[r["doc_id"]] = name
    got = {r["doc_id"]: r["licence"] for r in registry.QUERIES["document_licences"](spark, sf).collect()}
    assert got == want and set(got.values()) - {"MIT", "Apache-2.0"}
