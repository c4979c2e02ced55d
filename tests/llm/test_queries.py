"""Queries of the subpackage against their SQL, as for all others."""

import pytest

from loofold.llm.queries import ORACLES, QUERIES
from tests.test_queries import rows_of, same, sql  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, tables, sql, name):  # noqa: F811
    found = QUERIES[name](spark, tables).toArrow()
    wanted = sql.execute(ORACLES[name]).to_arrow_table()
    names, a = rows_of(found)
    other, b = rows_of(wanted)
    assert names == other and len(a) == len(b)
    assert {f.name: str(f.type) for f in found.schema} == {f.name: str(f.type) for f in wanted.schema}
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if not all(map(same, x, y))]
    assert not wrong, wrong[:3]


def test_each_operation_has_a_query():
    assert sorted(n for n in QUERIES if n.startswith("op")) == sorted(
        f"op{i}_{n}"
        for i, n in enumerate(
            ["substring_dedup", "document_fingerprints", "lm_scoring", "quality_rules", "minhash_neardup", "chat_formatting",
             "packing", "mixing", "language_id", "secret_scan", "toxicity", "lexical_search", "periodic_runs"], 1)
    )
    assert "pipeline" in QUERIES
