"""Saved documents, named sections, revisions, sinks and the stream."""

import json

from pyspark.sql import functions as F

from palimpsest.operators import findings as G
from palimpsest.operators import lines as L
from palimpsest.operators import spans as P
from palimpsest.sources import documents as SD
from palimpsest.sources import sinks
from palimpsest.streaming import relint

DOC = {"nodes": [{"type": "synopsis", "name": "widget", "code": {"text": "class widget;"}},
                 {"type": "section", "stable": "a", "title": "A", "children": [
                     {"type": "section", "stable": "a.b", "children": [{"type": "paragraph"}]}, {"type": "item"}]}]}


def test_saved_documents_become_node_rows(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(DOC))
    (tmp_path / "bad.json").write_text('{"nodes": [')
    (tmp_path / "trailing.json").write_text('{"nodes": []} x')
    nodes, rejects = SD.read_saved(spark, str(tmp_path))
    rows = [(tuple(r.node_path), tuple(r.parent_path), r.type, r.stable, r.name) for r in nodes.orderBy("node_path").collect()]
    assert rows == [((0,), (), "synopsis", "", "widget"), ((1,), (), "section", "a", ""), ((1, 0), (1,), "section", "a.b", ""),
                    ((1, 0, 0), (1, 0), "paragraph", "", ""), ((1, 1), (1,), "item", "", "")]
    bad = {r.path.rsplit("/", 1)[1]: r.message for r in rejects.collect()}
    assert set(bad) == {"bad.json", "trailing.json"} and "char 14" in bad["trailing.json"]


def test_documents_of_any_depth_are_read_whole(spark):
    node = {"type": "item"}
    for level in range(60):
        node = {"type": "section", "stable": f"s{level}", "children": [node]}
    df = spark.createDataFrame([(1, json.dumps({"nodes": [node]})), (2, '{"nodes":[{"type":"item"}]}')], "id long, json string")
    nodes, rejects = SD.parse_saved(df, "id", "json")
    assert sorted((r.id, r.depth) for r in nodes.collect()) == [(1, d) for d in range(1, 62)] + [(2, 1)]
    assert rejects.collect() == []


def test_keys_written_with_escapes_are_children_too(spark):
    text = '{"nodes":[{"type":"section","\\u0063h\\u0069ldren":[{"type":"section","childre\\u006E":[{"type":"item","stable":"\\"children\\""}]}]}]}'
    nodes, rejects = SD.parse_saved(spark.createDataFrame([(1, text)], "id long, json string"), "id", "json")
    assert [tuple(r.node_path) for r in nodes.orderBy("node_path").collect()] == [(0,), (0, 0), (0, 0, 0)] and not rejects.collect()
    for _ in range(9):
        text = '{"nodes":[' + json.dumps({"type": "s"})[:-1] + ',"ch\\u0069ldren":' + text[len('{"nodes":'):-1] + '}]}'
    nodes, _ = SD.parse_saved(spark.createDataFrame([(1, text)], "id long, json string"), "id", "json")
    assert nodes.count() == 12


def test_writing_leaves_defaults_out_and_reads_back(spark):
    df = spark.createDataFrame([(1, json.dumps(DOC))], "id long, json string")
    nodes, _ = SD.parse_saved(df, "id", "json")
    flat = nodes.withColumn("ord", F.array_join(F.transform("node_path", lambda p: F.lpad(p.cast("string"), 4, "0")), "."))
    out = SD.emit_saved(flat, ["id"], ["type", "stable", "title", "name"]).first().json
    assert json.loads(out) == {"nodes": [
        {"type": "synopsis", "name": "widget"}, {"type": "section", "stable": "a", "title": "A", "children": [
            {"type": "section", "stable": "a.b", "children": [{"type": "paragraph"}]}, {"type": "item"}]}]}


def test_the_first_file_that_declares_a_section_wins(spark, tmp_path):
    (tmp_path / "a.txt").write_text("// \\rSec1[x]{X}\none\n// \\rSec2[x.y]{Y}\ntwo\n")
    (tmp_path / "b.txt").write_text("// \\rSec1[x]{other}\nthree\n// \\rSec1[z]{Z}\nfour\n")
    asked = spark.createDataFrame([("x",), ("z",), ("none",)], "name string")
    lines, missing = SD.import_sections(spark, str(tmp_path), asked)
    got = {}
    for r in lines.orderBy("line_no").collect():
        got.setdefault(r.stable, []).append(r.raw)
    assert got == {"x": ["// \\rSec1[x]{X}", "one", "// \\rSec2[x.y]{Y}", "two"], "z": ["// \\rSec1[z]{Z}", "four"]}
    assert [r.name for r in missing.collect()] == ["none"]


def test_sections_with_wrapped_titles_are_imported(spark, tmp_path):
    (tmp_path / "a.tex").write_text("\\rSec1[x]{X over\n\\tcode{two}\nlines}\none\n\\rSec2[x.y]{Y \\tcode{\nz}}\ntwo\n\\rSec1[q]{never closed\n\\rSec1[z]{Z}\nfour\n")
    asked = spark.createDataFrame([("x",), ("x.y",), ("z",), ("q",)], "name string")
    lines, missing = SD.import_sections(spark, str(tmp_path), asked)
    got = {}
    for r in lines.orderBy("line_no").collect():
        got.setdefault(r.stable, []).append(r.line_no)
    assert got == {"x": [1, 2, 3, 4, 5, 6, 7, 8], "x.y": [5, 6, 7, 8], "z": [9, 10]}
    assert [r.name for r in missing.collect()] == ["q"]


def test_a_document_absent_at_a_revision_is_an_empty_baseline(spark):
    revisions = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 5, "c")], "doc_id long, revision long, text string")
    got = SD.as_of(revisions, revisions, "doc_id", ["revision"], F.lit(4))
    assert {r.doc_id: (r.text, r.is_empty) for r in got.collect()} == {1: ("b", False), 2: (None, True)}


def test_a_paper_whose_findings_fail_is_not_written(spark, tmp_path):
    papers = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3)], "paper_id string, doc_id long")
    found = spark.createDataFrame([(2, "error"), (3, "warning")], "doc_id long, severity string")
    pieces = spark.createDataFrame([("q", 2, "two"), ("q", 1, "one\nmore"), ("p", 1, "no")], "paper_id string, doc_ord long, text string")
    out = str(tmp_path / "whole")
    sinks.write_whole(sinks.gated(pieces, G.gate(found, papers)), out)
    assert [p.name for p in sorted((tmp_path / "whole").glob("paper_id=*"))] == ["paper_id=q"]
    text = "".join(f.read_text() for f in sorted((tmp_path / "whole" / "paper_id=q").glob("part-*")))
    assert text == "one\nmore\ntwo\n"
    strict = {r.paper_id: r.fails for r in G.gate(found, papers, strict=True).collect()}
    assert strict == {"p": True, "q": True}


def test_fragments_are_written_under_their_names(spark, tmp_path):
    pieces = spark.createDataFrame([("p", "a.b", "text a"), ("p", "a.c", "text c")], "paper_id string, fragment string, text string")
    sinks.write_fragments(pieces, str(tmp_path / "out"))
    files = list((tmp_path / "out" / "paper_id=p" / "fragment=a.c").glob("part-*"))
    assert [f.read_text() for f in files] == ["text c\n"]


def test_masked_spans_come_back(spark):
    texts = spark.createDataFrame([(1, "call foo now"), (2, "odd \u0001 text"), (3, "plain")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 1, 5, 8, 12), (2, 1, 0, 3, 10)], "doc_id long, span_ord long, begin long, end long, length long")
    masked, table = P.mask(texts, spans, ["doc_id"])
    got = {r.doc_id: r.text for r in masked.collect()}
    assert got[1] == "call \u00011\u0002 now" and got[2] == "\u0001\u00011\u0002 \u0001 text" and got[3] == "plain"
    back = {r.doc_id: r.text for r in P.recover(masked, table, ["doc_id"]).collect()}
    assert back == {r.doc_id: r.text for r in texts.collect()}


def test_the_stream_lints_each_text_once(spark, tmp_path):
    source, state, found = (str(tmp_path / n) for n in ("in", "state", "found"))
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    lint = lambda df: L.split_lines(df).filter("text = 'bad'").select("doc_id", "line_no")

    def run():
        stream = spark.readStream.schema("doc_id long, text string").parquet(source)
        relint.relint(spark, stream, lint, state, found, str(tmp_path / "checkpoint")).awaitTermination()
        return sorted((r.doc_id, r.line_no) for r in spark.read.parquet(found).collect())

    docs([(1, "ok\nbad"), (2, "ok")]).write.parquet(source)
    assert run() == [(1, 2)]
    docs([(1, "ok\nbad"), (2, "bad"), (2, "bad")]).write.mode("append").parquet(source)
    assert run() == [(1, 2), (2, 1)]
