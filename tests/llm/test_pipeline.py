"""The pipeline: every stage against brute force on its own input, and the laws of the whole."""

from collections import Counter

import corpus_pipeline
from palimpsest.llm import language
from tests.llm.test_contamination import brute as contaminated
from tests.llm.test_jaccard import brute as grouped


def test_stages_on_given_documents(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "sharding":
            assert after.columns == docs.columns
            assert not set(map(tuple, after.collect())) - set(before)
        kept[name] = Counter(r.doc_id for r in after.collect())
        texts = [(r[0], r[1]) for r in before]
        if name == "language":
            assert set(kept[name]) == {i for i, t in texts if t and any(c.isalpha() for c in t)}
        elif name == "near_duplicates":
            assert set(kept[name]) == {i for i, root in grouped(texts).items() if i == root}
        elif name == "decontamination":
            assert set(kept[name]) == {i for i, _ in texts} - {d for d, *_ in contaminated(texts, items)}
        elif name == "sharding":
            assert kept[name] == Counter(i for i, _ in texts)
            assert {r.shard for r in after.collect()} == set(range(8))
        docs = after
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == kept["sharding"]


def test_odd_rows_and_empty_table(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (2, "", None, "a", 0), (3, "12 34", "en", None, 0), (None, "the cat sat", "en", "b", 3),
            (4, "the dog ran off", "en", "b", 3), (4, "the dog ran off", "en", "b", 3), (5, "el perro", "es", None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    items = spark.createDataFrame([(1, "never seen before in any text at all")], "item_id bigint, text string")
    for name, given in (("odd", rows), ("none", [])):
        spark.createDataFrame(given, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect())
    assert set(got) <= {None, 4, 5} and got
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    docs = spark.createDataFrame(rows, schema)
    assert {r.doc_id for r in language.select_known(docs, {}).collect()} == {None, 4, 5}
