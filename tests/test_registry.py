from __future__ import annotations

import __spark_entry__ as entry_module
from registry.oracles import ORACLES
from registry.queries import QUERIES


def test_every_sql_belongs_to_a_query():
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries)
    assert set(QUERIES) <= set(queries)
    without_sql = set(QUERIES) - set(ORACLES)
    assert without_sql == {"trained_assessment_documents", "trained_audit_documents", "trained_metrics_documents"}


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[0] == "record_id" and df.count() == 200
