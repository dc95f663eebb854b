"""of the texts, conversations and decks only those that an item asks for are joined; no text of the documents is shuffled for it."""

from dealspark.plans import retrieval


def test_texts_are_not_shuffled_for_few_hits(spark, sf):
    plan = retrieval.background(spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    shuffles = [x for x in plan if "Exchange hashpartitioning(doc_id" in x or "Exchange hashpartitioning(doc#" in x]
    assert not any("doc_id" in x for x in shuffles)
    last = max(i for i, x in enumerate(plan) if "conversations.parquet" in x)
    near = "\n".join(plan[max(0, last - 8) : last])
    assert "LeftSemi" in near and "BroadcastHashJoin" in near
