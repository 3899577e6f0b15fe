"""Lint rules on hand-written rosters and claims."""

from pyspark.sql import functions as F

from palimpsest.operators import claims as C
from palimpsest.operators import elements as E
from palimpsest.operators import names as N
from palimpsest.operators import sequences as Q

ROSTER = "doc_id long, paper_id string, ord long, owner string, name string, parent string, kind string, disposition string, section string"


def roster(spark, rows):
    return spark.createDataFrame([(1, "p", i, "widget", *r) for i, r in enumerate(rows)], ROSTER)


def test_coverage_reports_only_what_is_unaccounted_for(spark):
    r = roster(spark, [("empty", "widget", "function", "routed", "widget.obs"), ("clone", "widget", "function", "merged", ""),
                       ("resize", "widget", "function", "undocumented", ""), ("reserve", "widget", "function", "routed", "widget.nowhere"),
                       ("shrink", "widget", "function", "routed", ""), ("value_", "widget", "data", "expos", ""),
                       ("cache_", "widget", "data", "private", "")])
    sections = spark.createDataFrame([(1, "widget.obs")], "doc_id long, stable string")
    lines = [f"{x.context}: {x.severity}: {x.message}" for f in (N.undocumented(r), N.misrouted(r, sections), N.private_data(r))
             for x in f.orderBy("message").collect()]
    assert lines[0] == ("widget/synopsis: error: `resize` is declared in the synopsis but is not described, `\\omit`ted, "
                        "`\\merge`d, or defaulted")
    assert lines[1].endswith("`reserve` is routed to [widget.nowhere], which is not a section in this document")
    assert "`shrink` is routed to no section" in lines[2] and "note: `cache_` is unmarked private data" in lines[3] and len(lines) == 4


def test_a_visible_name_wins_over_a_hidden_one(spark):
    r = roster(spark, [("f", "widget", "function", "omitted", ""), ("f", "widget", "function", "described", ""),
                       ("g", "widget", "function", "private", ""), ("g", "widget", "function", "merged", "")])
    hidden = N.hidden_names(r, N.documented_names(r, r, ["paper_id"]))
    assert [(x.name, x.disposition) for x in hidden.collect()] == [("g", "private")]
    text = spark.createDataFrame([(1, 1, "f(g); g g"), (1, 2, "other")], "doc_id long, line_no long, text string")
    got = N.leaks(text, hidden, ["doc_id", "line_no"]).collect()
    assert [(x.line_no, x.name, x.pos) for x in got] == [(1, "g", 2)] and "an unmarked private member" in got[0].message


def test_claims_need_exactly_one_match_of_their_polarity(spark):
    columns = "doc_id long, node_id long, kind string, subject string, polarity boolean"
    evidence = spark.createDataFrame([(1, 1, "mandates", "a", True), (1, 1, "mandates", "b", True), (1, 1, "mandates", "c", True),
                                      (1, 1, "mandates", "c", True), (1, 1, "mandates", "z", False)], columns)
    claims = spark.createDataFrame([(1, 1, "mandates", "a", True, 1), (1, 1, "mandates", "a", True, 2), (1, 1, "mandates", "b", False, 3),
                                    (1, 1, "mandates", "c", True, 4), (1, 1, "mandates", "d", True, 5), (1, 1, "effects", "a", True, 6),
                                    (1, 1, "mandates", "e", None, 7)], columns + ", ord long")
    audit = C.audit_claims(claims, evidence)
    verdicts = {r.ord: r.verdict for r in audit.collect()}
    assert verdicts == {1: "covered", 2: "duplicate", 3: "wrong_polarity", 4: "unmatched", 5: "unmatched", 6: "invalid", 7: "invalid"}
    readings = spark.createDataFrame([(1, 1, "remarks", "b", True)], columns)
    missing = {r.message.split("`")[1] for r in C.missing_counterparts(evidence, readings, audit).collect()}
    assert missing == {"c", "z"}


def test_aliases_follow_chains_and_drop_cycles_and_repeats(spark):
    rows = [(1, "a", "b"), (1, "b", "c"), (1, "c", "X"), (1, "p", "q"), (1, "q", "p"), (1, "r", "p"), (1, "d", "1"), (1, "d", "2"), (2, "a", "Y")]
    got = C.resolve_aliases(spark.createDataFrame(rows, "doc_id long, alias string, value string"))
    assert sorted(map(tuple, got.select("doc_id", "alias", "value").collect())) == [(1, "a", "X"), (1, "b", "X"), (1, "c", "X"), (2, "a", "Y")]


def test_followers_join_named_and_neighbouring_primaries(spark):
    rows = [(1, 1, True, "g", None, False), (1, 2, True, None, None, True), (1, 3, True, None, None, False),
            (1, 4, True, None, "g", False), (1, 5, True, None, None, True), (1, 6, False, None, None, False),
            (1, 7, True, None, None, True), (1, 8, True, None, None, True), (1, 9, True, None, "h", False), (1, 10, True, "g", None, False)]
    df = spark.createDataFrame(rows, "doc_id long, ord long, is_item boolean, group_id string, also_target string, wants_join boolean")
    grouped, found = Q.group_followers(df, ["doc_id"])
    assert {r.ord: r.primary for r in grouped.collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 1, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10}
    assert sorted((r.ord, r.message.split("'")[1]) for r in found.collect()) == [(9, "h"), (10, "g")]


def test_blocks_do_not_nest_and_must_end(spark):
    lines = ["\\note a", "\\note b", "c", "\\endnote", "\\endnote", "\\example d"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines, 1)], "doc_id long, line_no long, text string")
    found = {(r.line_no, r.message) for r in E.delimiter_findings(df).collect()}
    assert found == {(2, "notes and examples cannot nest"), (5, "\\endnote appears outside its block"), (6, "missing \\endexample")}
    assert [(r.line_no, r.block_ord) for r in E.group_blocks(df).orderBy("line_no").collect()] == [(1, 1), (2, 1), (3, 1), (6, 2)]


def test_elements_and_paragraphs(spark):
    lines = ["lead", "\\effects one", "two", "", "three", "\\unknown four", "\\returns", "five"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines, 1)], "doc_id long, line_no long, text string")
    got = [(r.kind, r.para_ord, r.text) for r in E.group_elements(df).orderBy("elem_ord", "para_ord").collect()]
    assert got == [("leading", 1, "lead"), ("effects", 1, "one two"), ("effects", 2, "three \\unknown four"), ("returns", 1, "five")]


def test_an_offer_goes_to_one_row_and_the_rest_look_further_out(spark):
    import random
    from palimpsest.operators import agreement as A
    dice = random.Random(3)
    asks = [(d, i, dice.choice("ab"), [f"s{dice.randrange(3)}", "t", "u"][dice.randrange(3):]) for d in range(12) for i in range(9)]
    offers = [(d, dice.choice(["s0", "s1", "s2", "t", "u"]), dice.choice("abc"), i) for d in range(12) for i in range(8)]
    want, used, done = [], set(), set()
    for distance in range(3):
        for d, i, name, scopes in asks:
            if (d, i) not in done and distance < len(scopes):
                free = [o for o in offers if o[0] == d and o[1] == scopes[distance] and o[2] == name and (d, o[3]) not in used]
                if free:
                    used.add((d, free[0][3]))
                    done.add((d, i))
                    want.append((d, i, name, distance, scopes[distance], free[0][3]))
    got = A.nearest_scope(spark.createDataFrame(asks, "doc_id bigint, ask_id bigint, name string, scopes array<string>"),
                          spark.createDataFrame(offers, "doc_id bigint, scope string, name string, offer_id bigint"), ["doc_id"])
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 30
    empty = spark.createDataFrame([], "doc_id bigint, ask_id bigint, name string, scopes array<string>")
    assert A.nearest_scope(empty, spark.createDataFrame(offers, "doc_id bigint, scope string, name string, offer_id bigint"), ["doc_id"]).collect() == []


def test_scopes_of_any_depth_are_one_job(spark):
    from palimpsest.operators import agreement as A
    deep = [(1, i, "a", [f"s{k}" for k in range(8)]) for i in range(3)]
    asks = spark.createDataFrame(deep, "doc_id bigint, ask_id bigint, name string, scopes array<string>")
    offers = spark.createDataFrame([(1, "s7", "a", 5), (1, "s7", "a", 5), (1, "s6", "a", 9), (1, None, "a", 1)], "doc_id bigint, scope string, name string, offer_id bigint")
    spark.sparkContext.setJobGroup("scopes", "nearest scope")
    got = A.nearest_scope(asks, offers, ["doc_id"])
    begun = spark.sparkContext.statusTracker().getJobIdsForGroup("scopes")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, "a", 6, "s6", 9), (1, 1, "a", 7, "s7", 5)]
    assert list(begun) == []  # no round is run while the plan is made


def test_aliases_are_replaced_inside_expressions(spark):
    from palimpsest.operators import claims as C
    aliases = [(1, "T", "remove_cvref_t<U>"), (1, "V", "T const"), (1, "A", "B"), (1, "B", "f(A)"), (1, "D", "A x"), (1, "twice", "1"), (1, "twice", "2"),
               (1, "W", "std :: W2"), (1, "W2", "X"), (2, "T", "other")]
    cases = {
        "is_same_v<T , V>": "is_same_v<remove_cvref_t<U>,remove_cvref_t<U>const>", "T::T a T": "T::T a remove_cvref_t<U>", "std::T": "remove_cvref_t<U>",
        "::std :: move(T)": "move(remove_cvref_t<U>)", "x::std::T": "x::std::T", "A + T": "A + T", "D": "D", "twice T": "twice remove_cvref_t<U>",
        'f("T  x", T)': 'f("T  x",remove_cvref_t<U>)', "W": "X", "T2 T_": "T2 T_", "": "", "V V": "remove_cvref_t<U>const remove_cvref_t<U>const"}
    got = C.expand_expressions(spark.createDataFrame([(1, i, e) for i, e in enumerate(cases)] + [(2, 0, "T"), (3, 0, "T")], "doc_id bigint, expr_id bigint, text string"),
                               spark.createDataFrame(aliases, "doc_id bigint, alias string, value string")).collect()
    assert {r.text: r.expanded for r in got if r.doc_id == 1} == cases
    assert {r.doc_id: r.expanded for r in got if r.doc_id > 1} == {2: "other", 3: "T"}


def test_an_expression_is_cut_into_tokens_once(spark):
    import time
    from palimpsest.operators import claims as C
    begun = time.time()
    long = spark.range(1).select(C.expression_tokens(F.lit("a + " * 3000 + "std::b")).alias("t")).select(F.size("t").alias("n"), F.col("t")[6000].alias("l")).first()
    assert (long.n, tuple(long.l)) == (6001, ("b", True)) and time.time() - begun < 30
