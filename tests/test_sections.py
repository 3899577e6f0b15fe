"""Section trees against a stack, on random depth sequences."""

import random

from pyspark.sql import functions as F

from palimpsest.operators import fragments as FR
from palimpsest.operators import ordered as O
from palimpsest.operators import sections as S


def stack_fold(depths):
    stack, parents = [], []
    for line, depth in enumerate(depths, 1):
        while stack and stack[-1][0] >= depth:
            stack.pop()
        parents.append(stack[-1][1] if stack else None)
        stack.append((depth, line))
    return parents


def test_folded_headings_equal_a_stack(spark):
    rng = random.Random(3)
    docs = [[rng.randint(0, 14) for _ in range(rng.randint(1, 25))] for _ in range(40)]
    rows = [(d, n, depth, f"s{n}") for d, depths in enumerate(docs) for n, depth in enumerate(depths, 1)]
    tree = S.fold_headings(spark.createDataFrame(rows, "doc_id long, line_no long, depth int, stable string"))
    got = {(r.doc_id, r.line_no): r.parent for r in tree.collect()}
    for d, depths in enumerate(docs):
        assert [got[(d, n)] for n in range(1, len(depths) + 1)] == stack_fold(depths)


def test_context_paths_leave_nameless_levels_out(spark):
    rows = [(1, 1, 1, "a"), (1, 2, 2, ""), (1, 3, 3, "c")]
    tree = S.fold_headings(spark.createDataFrame(rows, "doc_id long, line_no long, depth int, stable string"))
    assert [r.context for r in S.context_paths(tree).orderBy("line_no").collect()] == ["a", "a", "a/c"]


def test_fences_close_the_innermost_section_only(spark):
    rows = [(1, 1, "close", None, "z"), (1, 2, "open", 1, "a"), (1, 3, "open", 2, "b"), (1, 4, "close", None, "a"),
            (1, 5, "close", None, "b"), (1, 6, "open", 2, "c"), (1, 7, "close", None, "c"), (1, 8, "close", None, "a")]
    got = S.fold_fenced(spark.createDataFrame(rows, "doc_id long, line_no long, event string, depth int, stable string"))
    r = {x.line_no: x for x in got.collect()}
    assert r[1].warning == "END [z] has no open section to close"
    assert r[4].warning == "END [a] does not match open section [b]"
    assert (r[3].parent, r[5].closes, r[6].parent, r[7].closes, r[8].closes) == (2, 3, 2, 6, 2)


def test_rows_are_routed_to_the_first_section_to_close(spark):
    sections = spark.createDataFrame([(1, "a", 1, 9), (1, "a", 3, 5), (1, "b", 6, 8)],
                                     "doc_id long, stable string, line_no long, close_line long")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "doc_id long, target string")
    got = {r.target: r.section_line for r in S.route_first(rows, sections).collect()}
    assert got == {"a": 3, "b": 6}


def test_names_under_roots_stop_at_dots(spark):
    names = spark.createDataFrame([("demo",), ("demo.detail",), ("demolition",), ("demo.a.b",), ("demo",)], "name string")
    roots = spark.createDataFrame([("demo",), ("demo.a",)], "root string")
    assert sorted(r.name for r in S.under_roots(names, roots).collect()) == ["demo", "demo", "demo.a.b", "demo.detail"]


def root_of(names):
    parts = [n.split(".") for n in names]
    prefix = []
    for column in zip(*parts):
        if len(set(column)) > 1:
            break
        prefix.append(column[0])
    if ".".join(prefix) in names:
        prefix.pop()
    return ".".join(prefix) or None


def test_fragment_roots_equal_a_walk_over_all_names(spark):
    rng = random.Random(5)
    docs = [[".".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 4))] for _ in range(60)]
    rows = [(d, n) for d, names in enumerate(docs) for n in names]
    got = {r.doc_id: r.root for r in FR.derive_roots(spark.createDataFrame(rows, "doc_id long, stable string")).collect()}
    assert got == {d: root_of(names) for d, names in enumerate(docs)}


def test_chunked_running_values_equal_plain_windows(spark):
    from pyspark.sql import Window
    rng = random.Random(7)
    rows = [(k, n, rng.choice([None, 1, 2, 5]), rng.choice("xy")) for k in range(3) for n in range(70)]
    df = spark.createDataFrame(rows, "k long, n long, v long, c string")
    w = Window.partitionBy("k").orderBy("n")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = df.select(
        "k", "n", F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("s"), F.max("v").over(upto).alias("m"),
        F.last("v", True).over(upto.rowsBetween(Window.unboundedPreceding, -1)).alias("l"),
        F.first("v", True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("x"), F.lag("v").over(w).alias("g"))
    got = O.running(df, ["k"], ["n"], F.floor(F.col("n") / 8), s=O.Running("sum", F.col("v")), m=O.Running("max", F.col("v")),
                    l=O.Running("last", F.col("v"), before=True), x=O.Running("next", F.col("v")), g=O.Running("lag", F.col("v")))
    assert sorted(map(tuple, got.select(*plain.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_cohorts_run_on_over_chunks(spark):
    rng = random.Random(31)
    rows = [(k, n, rng.choice("xxy")) for k in range(4) for n in range(50)]
    got = O.cohorts(spark.createDataFrame(rows, "k long, n long, c string"), ["k"], ["n"], F.floor(F.col("n") / 6), "c")
    seen = {(r.k, r.n): r.cohort for r in got.collect()}
    for k in range(4):
        cohort, last = 0, None
        for _, n, c in (r for r in rows if r[0] == k):
            cohort += c != last
            last = c
            assert seen[(k, n)] == cohort
