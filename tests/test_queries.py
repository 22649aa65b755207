"""Every query of the library against its SQL on DuckDB, at the smallest scale."""

from __future__ import annotations

import helpers
import pytest

from quillframe.plans import registry

SMALL = str(helpers.DATA / "sf0.001")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    """Equal rows, by a plan without a nested loop."""
    df = registry.QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    helpers.compare(spark, lambda *_: df, registry.ORACLES[name], SMALL)


def test_entry_has_rows(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "category", "score", "gap"] and df.count() > 0


def test_every_query_has_sql(spark):
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_one_pass_over_the_pages(spark):
    """The scan's counts are observed while its notices are merged."""
    from quillframe.operators import notices
    from quillframe.plans.notices import _as_notices, _matched

    merged = notices.merge(_as_notices(_matched(spark, SMALL)), preferred="ted")
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_scoring_folds_each_text_once(spark):
    plan = registry.QUERIES["classify_by_rules"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 2  # one folding, one lowering
