"""What saved documents are made of is dealt out as texts, not as the rows made from them."""

import re

import pytest

import __spark_entry__ as entry
from tests import oracle


@pytest.mark.parametrize("name", ["saved_items", "saved_elements", "saved_blocks", "saved_inlines"])
def test_only_texts_are_shuffled(spark, name):
    plan = entry.queries()[name](spark, f"{oracle.ROOT}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\), (\w+)", plan)
    assert dealt and all(how == "REPARTITION_BY_NUM" and re.fullmatch(r"doc_id#\d+L, \d+", by) for by, how in dealt)


def test_nodes_are_shuffled_without_their_texts(spark):
    """What a tree's nodes are met and gathered by is numbers; texts are shuffled once, a document's as one."""
    found, left = [], [entry.queries()["tree_diff_restores"](spark, f"{oracle.ROOT}/sf0.001")._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            left.append(node.initialPlan())
        if node.nodeName() == "Exchange" and any(node.output().apply(i).name() in ("text", "_line") for i in range(node.output().size())):
            found.append(node.outputPartitioning().toString())
        left += [node.children().apply(i) for i in range(node.children().size())]
    assert len(found) == 1, found
