"""Documents that the given tables do not hold: an empty text, one that ends in newlines, no text."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tests import oracle

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
TEXTS = ["", "\n", "one two three\nfour five six seven\n", "a bb\n\n", "\n\none two\n\nthree four five six\n", " ", None,
         "same words here\nsame words here\nother words"]
NAMES = ["edit_rejects", "edit_script_restores", "expanded_expressions", "planned_edits", "reconciled_attributes", "revision_nodes_restore",
         "saved_blocks", "saved_round_trip", "tree_diff_restores", "whole_document_marks", "saved_elements", "saved_items"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    root = tmp_path_factory.mktemp("odd")
    (root / "sfodd").mkdir()
    rows = [{"doc_id": i, "text": text, "lang": "en", "source": "web", "n_chars": len(text or "")} for i, text in enumerate(TEXTS)]
    pq.write_table(pa.Table.from_pylist(rows), root / "sfodd/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{root}/sfodd/documents.parquet'")
    return root, con


@pytest.mark.parametrize("name", NAMES)
def test_odd_documents_equal_the_sql(spark, odd, monkeypatch, name):
    root, con = odd
    monkeypatch.setattr(oracle, "ROOT", root)
    ok, note = oracle.compare(spark, con, name, QUERIES[name], ORACLES[name], "odd")
    assert ok, note


def test_a_null_key_ends(spark):
    from palimpsest.operators import claims as C
    aliases = spark.createDataFrame([(None, "a", "b + c")], "doc_id bigint, alias string, value string")
    texts = spark.createDataFrame([(None, 1, "a * 2"), (7, 1, "a * 2")], "doc_id bigint, expr_id int, text string")
    assert C.expand_expressions(texts, aliases).count() == 2
