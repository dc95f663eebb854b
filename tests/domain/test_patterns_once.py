"""a pattern stands once in the plan, however often its metric is named, and decks are dealt to all tasks."""

import re

import pytest

from dealspark.functions import lexicons as L
from dealspark.plans import composite, registry, text  # noqa: F401  they register their queries

SEEN = {"x27_follow_up_mail": r"\(\?i\)mrr \*", "x28_data_analysis": r"\(\?i\)mrr \*", "x32_truth_signals": r"\(\?i\)mrr \*", "e20_document_insights": r"burn\\s\*rate", "g01_scored_by_sql": re.escape(L.RISKS[0][1])}


@pytest.mark.parametrize("name", SEEN)
def test_patterns_run_once(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(SEEN[name], plan)) == 1
    assert "RepartitionByExpression" in plan
