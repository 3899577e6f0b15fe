"""Laws of the revision diff: shortest scripts, restoration, identity, empty baselines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.functions import sequence as SQ
from palimpsest.operators import diff as R
from palimpsest.operators import edits as ED
from palimpsest.operators import pairing as PR
from palimpsest.operators import similarity as SM
from palimpsest.operators import spans as P

PAIRS = [("", ""), ("abc", "abc"), ("", "abc"), ("abc", ""), ("abcabba", "cbabac"), ("kitten", "sitting"), ("aaaa", "aa"),
         ("xaxbxc", "abc"), ("abcdef", "fedcba"), ("the cat sat", "the dog sat down")]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        previous = 0
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], previous + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def play(a, b, steps):
    old = [a[i] for op, i, _ in steps if op != "insert"]
    new = [b[j] for op, _, j in steps if op != "delete"]
    return old, new


@pytest.mark.parametrize("block", [1, 2, 256])
@pytest.mark.parametrize("a,b", PAIRS)
def test_scripts_are_shortest_and_restore_both_sides(monkeypatch, block, a, b):
    monkeypatch.setattr(SQ, "BLOCK", block)
    steps = SQ.diff_values(a, b)
    assert play(a, b, steps) == (list(a), list(b))
    assert sum(op != "keep" for op, _, _ in steps) == len(a) + len(b) - 2 * lcs(a, b)


def test_random_scripts_do_not_depend_on_how_many_frontiers_are_kept(monkeypatch):
    rng = random.Random(11)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        whole = SQ.diff_values(a, b)
        monkeypatch.setattr(SQ, "BLOCK", 3)
        assert SQ.diff_values(a, b) == whole
        i, j = zip(*[(x, y) for x in range(len(a)) for y in range(len(b)) if a[x] == b[y]] or [((), ())])
        assert SQ.diff_matches(len(a), len(b), list(i) if i else [], list(j) if j else []) == whole
        monkeypatch.setattr(SQ, "BLOCK", 256)


def test_a_deletion_comes_before_the_insertion_that_replaces_it():
    assert SQ.diff_values("a", "b") == [("delete", 0, 0), ("insert", 1, 0)]


def steps_of(spark, a, b, island):
    df = spark.createDataFrame([(1, list(a), list(b))], "k long, a array<string>, b array<string>")
    joined = R.join_islands(R.edits(R.with_scripts(df, "a", "b"), ["k"]), ["k"], island).orderBy("pos").collect()
    return [(r.op[0], (b if r.op == "insert" else a)[r.b if r.op == "insert" else r.a]) for r in joined]


def test_islands_are_swallowed_and_deletions_come_first(spark):
    got = "".join(op + v for op, v in steps_of(spark, "1axb2", "1cxd2", 2))
    assert got == "k1" + "dadxdb" + "iciXid".replace("X", "x") + "k2"
    kept = "".join(op + v for op, v in steps_of(spark, "1axyzb2", "1cxyzd2", 2))
    assert kept == "k1daickxkykzdbidk2"


def marked(spark, a, b):
    df = spark.createDataFrame([(1, a, b)], "k long, old_text string, new_text string")
    return [(r.change, r.lead, r.text, r.trail) for r in R.mark_words(df, ["k"]).orderBy("run").collect()]


def test_marks_hold_no_whitespace_at_their_ends(spark):
    assert marked(spark, "if it is ready.", "if it is armed.") == [("same", "", "if it is ", ""), ("removed", "", "ready.", ""),
                                                                  ("added", "", "armed.", "")]
    assert marked(spark, "a b", "a b") == [("same", "", "a b", "")]
    assert marked(spark, "one", "one two") == [("same", "", "one ", ""), ("added", "", "two", "")]


def test_word_runs_restore_the_new_text_and_the_old_words(spark):
    rng = random.Random(2)
    words = ["a", "b", "c", "dd", "ee"]
    rows = [(k, *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(2))) for k in range(40)]
    df = spark.createDataFrame(rows, "k long, old_text string, new_text string")
    runs = R.mark_words(df, ["k"]).cache()
    new = {r.k: r.text for r in R.restore(runs, ["k"], "new").collect()}
    old = {r.k: r.text for r in R.restore(runs, ["k"], "old").collect()}
    for k, a, b in rows:
        assert new[k].split() == b.split()
        assert "".join(old[k].split()) == "".join(a.split())


def corpus(spark, docs):
    rows = [(d, n, line) for d, lines in docs.items() for n, line in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "doc_id long, line_no long, text string")


def test_identity_empty_baseline_and_moves(spark):
    old = corpus(spark, {1: ["alpha beta", "gamma"], 2: ["x y z", "move me", "tail end"]})
    new = corpus(spark, {1: ["alpha beta", "gamma"], 2: ["move me", "x y q", "tail end"], 3: ["fresh"]})
    rows = R.diff_nodes(old, new, ["doc_id"]).orderBy("doc_id", "pos").collect()
    assert [r.change for r in rows if r.doc_id == 1] == ["same", "same"]
    assert [r.change for r in rows if r.doc_id == 3] == ["added"]
    assert [(r.change, r.old_text, r.new_text) for r in rows if r.doc_id == 2] == [
        ("removed", "x y z", None), ("same", "move me", "move me"), ("added", None, "x y q"), ("same", "tail end", "tail end")]
    edited = R.diff_nodes(corpus(spark, {1: ["a b c d"]}), corpus(spark, {1: ["a b c e"]}), ["doc_id"]).first()
    assert (edited.change, edited.old_text, edited.new_text) == ("edited", "a b c d", "a b c e")


def test_planned_edits_turn_the_old_source_into_the_new_one(spark):
    rng = random.Random(4)
    pool = ["a b c", "a b d", "x y", "x z", "m", "n o p q", "n o p r"]
    olds = {d: [rng.choice(pool) for _ in range(rng.randint(1, 9))] for d in range(30)}
    news = {d: [rng.choice(pool) for _ in range(rng.randint(1, 9))] for d in range(30)}
    old, new = corpus(spark, olds), corpus(spark, news)
    edits = ED.plan_edits(R.diff_nodes(old, new, ["doc_id"]), old, ["doc_id"])
    texts = spark.createDataFrame([(d, "".join(x + "\n" for x in lines)) for d, lines in olds.items()], "doc_id long, text string")
    done, rejects = P.apply_edits(texts, edits, ["doc_id"])
    assert rejects.count() == 0
    assert {r.doc_id: r.text for r in done.collect()} == {d: "".join(x + "\n" for x in lines) for d, lines in news.items()}


def test_overlapping_edits_reject_the_text_whole(spark):
    texts = spark.createDataFrame([(1, "abcdef"), (2, "abcdef")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 0, 2, "X"), (1, 4, 4, "-"), (1, 0, 2, "X"), (2, 0, 3, "Y"), (2, 2, 9, "Z")],
                                  "doc_id long, begin long, end long, replacement string")
    done, rejects = P.apply_edits(texts, edits, ["doc_id"])
    assert [(r.doc_id, r.text) for r in done.collect()] == [(1, "Xcd-ef")]
    assert [r.message for r in rejects.collect()] == ["an edit of bytes 2 to 9 overlaps another or runs past the end"]


def test_code_lines_merge_rewrap_and_stand_apart(spark):
    def actions(a, b):
        df = spark.createDataFrame([(1, a, b)], "k long, old_text string, new_text string")
        return sorted(((r.action, r.i, r.j) for r in R.diff_code(df, ["k"]).collect()), key=str)
    assert actions("int f();\nint g();", "int f();\nint g(int);") == [("kept", 0, 0), ("merged", 1, 1)]
    assert set(actions("a b c d e f", "a b c\nd e f")) == {("rewrapped", 0, 0), ("rewrapped", None, 1)}
    got = actions("one two\nzz", "three four\nzz")
    assert set(got) == {("added", None, 0), ("removed", 0, None), ("kept", 1, 1)}


# --- pairing -----------------------------------------------------------------------------------------------------

def greedy(candidates):
    used_i, used_j, out = set(), set(), []
    for score, i, j in sorted(candidates, key=lambda c: (-c[0], c[1], c[2])):
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            out.append((i, j, score))
    return sorted(out)


def test_rounds_and_walks_equal_best_first(spark):
    rng = random.Random(9)
    groups = {g: [(rng.choice([0.1, 0.5, 0.9]), i, j) for i in range(6) for j in range(6) if rng.random() < 0.6] for g in range(12)}
    rows = [(g, i, j, s) for g, cand in groups.items() for s, i, j in cand]
    df = spark.createDataFrame(rows, "g long, i long, j long, score double")
    want = {g: greedy(c) for g, c in groups.items()}
    for pairs in (PR.greedy_pairs(df, ["g"]), PR.fit_in_group(df, ["g"])):
        got = {}
        for r in pairs.collect():
            got.setdefault(r.g, []).append((r.i, r.j, r.score))
        assert {g: sorted(v) for g, v in got.items()} == want


def jaccard(a, b):
    a, b = set(a.split()), set(b.split())
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_pairing_by_name_equals_best_first_over_all_pairs(spark):
    rng = random.Random(13)
    text = lambda: " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 4)))
    a = [(d, rng.choice("xy"), i, text()) for d in range(12) for i in range(rng.randint(1, 7))]
    b = [(d, rng.choice("xy"), j, text()) for d in range(12) for j in range(rng.randint(1, 7))]
    got = PR.pair_by_name(spark.createDataFrame(a, "doc_id long, name string, i long, text string"),
                          spark.createDataFrame(b, "doc_id long, name string, j long, text string"), ["doc_id"])
    pairs = sorted((r.doc_id, r.name, r.i, r.j) for r in got.collect())
    want = []
    for d in range(12):
        for name in "xy":
            cand = [(jaccard(ta, tb), i, j) for da, na, i, ta in a for db, nb, j, tb in b if (da, na) == (db, nb) == (d, name)]
            want += [(d, name, i, j) for i, j, _ in greedy(cand)]
    assert pairs == sorted(want)


def test_alike_rows_of_a_document_are_all_found(spark):
    rng = random.Random(17)
    text = lambda: " ".join(rng.choice(["a", "bb", "ccc", "dddd", "e", "ff"]) for _ in range(rng.randint(0, 5)))
    rows = [(d, s, o, text()) for d in range(10) for s in ("old", "new") for o in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, side string, ord long, text string")
    for t in (0.3, 0.5, 0.8):
        got = sorted((r.doc_id, r.i, r.j, round(r.score, 9)) for r in PR.alike_in_document(df, ["doc_id"], t).collect())
        want = sorted((d, o, p, round(jaccard(x, y), 9)) for d, s, o, x in rows for e, q, p, y in rows
                      if d == e and s == "old" and q == "new" and jaccard(x, y) >= t)
        assert got == want


@pytest.mark.parametrize("threshold", [0.4, 0.5, 0.8])
def test_similar_documents_are_all_found(spark, threshold):
    rng = random.Random(19)
    docs = [(d, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8)))) for d in range(120)]
    classes = SM.token_classes(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id")
    got = sorted((r.a, r.b, round(r.score, 9)) for r in SM.similar_pairs(classes, threshold).collect())
    first = {}
    for d, text in docs:
        first.setdefault(frozenset(text.split()), d)
    want = sorted((min(a, b), max(a, b), round(len(x & y) / len(x | y), 9)) for x, a in first.items() for y, b in first.items()
                  if a < b and len(x & y) / len(x | y) >= threshold)
    assert got == want


def test_spans_are_taken_as_a_left_to_right_walk_takes_them(spark):
    rng = random.Random(23)
    rows = [(d, k, *(lambda b: (b, b + rng.randint(-2, 9)))(rng.randint(0, 40)), 45) for d in range(30) for k in range(8)]
    got = {}
    for r in P.valid_spans(spark.createDataFrame(rows, "doc_id long, span_ord long, begin long, end long, length long"), ["doc_id"]).collect():
        got.setdefault(r.doc_id, set()).add(r.span_ord)
    for d in range(30):
        pos, want = 0, set()
        for _, k, b, e, n in sorted((r for r in rows if r[0] == d), key=lambda r: (r[2], r[1])):
            if b <= e <= n and b >= pos:
                want.add(k)
                pos = e
        assert got.get(d, set()) == want


def test_overlay_follows_the_elements_in_order(spark):
    rng = random.Random(29)
    own = [(d, rng.choice("ab"), o, f"own{d}.{o}", rng.random() < 0.4) for d in range(40) for o in range(rng.randint(0, 5))]
    base = [(d, rng.choice("ab"), o, f"base{d}.{o}") for d in range(40) for o in range(rng.randint(0, 3))]
    got = R.inherit_descriptions(spark.createDataFrame(own, "doc_id long, kind string, ord long, text string, derived boolean"),
                                 spark.createDataFrame(base, "doc_id long, kind string, ord long, text string"), ["doc_id"])
    table = sorted((r.doc_id, r.kind, r.text, r.evidence or "") for r in got.collect())
    want = []
    for d in range(40):
        resolved = [[k, t, ""] for e, k, o, t in base if e == d]
        for _, kind, _, text, derived in (x for x in own if x[0] == d):
            slot = next((s for s in resolved if s[0] == kind), None)
            if slot is None:
                resolved.append([kind, text, ""])
            elif derived:
                slot[2] = text
            else:
                slot[1], slot[2] = text, ""
        want += [(d, *s) for s in resolved]
    assert table == sorted(want)


def test_only_documents_without_marks_may_be_diffed(spark):
    nodes = spark.createDataFrame([(1, 1, "same"), (1, 2, "added"), (2, 1, "same")], "doc_id long, node_id long, change string")
    good, marked_docs = R.refuse_marked(nodes, ["doc_id"])
    assert [r.doc_id for r in good.collect()] == [2] and [r.doc_id for r in marked_docs.collect()] == [1]


def test_contexts_show_less_and_less(spark):
    rows = [(1, 1, None, [], True, "same", False, False), (1, 2, 1, [1], False, "same", False, False),
            (1, 3, 1, [1], False, "same", False, False), (1, 4, 1, [1], False, "edited", True, False),
            (1, 5, None, [], True, "same", False, False), (1, 6, 5, [5], False, "same", False, False)]
    nodes = spark.createDataFrame(rows, "doc_id long, node_id long, parent long, ancestors array<long>, is_heading boolean, "
                                        "change string, described boolean, description_changed boolean")
    shown = lambda c: {r.node_id: r.action for r in R.apply_context(nodes, ["doc_id"], c).collect()}
    assert set(shown("all")) == {1, 2, 3, 4, 5, 6}
    assert set(shown("changed")) == {1, 2, 3, 4}
    assert shown("items") == {1: "shown", 2: "elided", 4: "shown"}
    assert shown("decls")[4] == "shown"


def test_the_change_column_never_nests(spark):
    nodes = spark.createDataFrame([(1, 1, []), (1, 2, [1])], "doc_id long, node_id long, ancestors array<long>")
    marks = R.all_marked(nodes, "added").groupBy("node_id").agg(F.first("change").alias("c"))
    assert {r.node_id: r.c for r in marks.collect()} == {1: "added", 2: "same"}


def test_blocks_of_ties_take_one_round(spark, monkeypatch):
    rounds, real = [], PR.checkpointed
    monkeypatch.setattr(PR, "checkpointed", lambda df: rounds.append(1) or real(df))
    tied = [(1, i, j, 0.5) for i in range(150) for j in range(120)] + [(1, 500 + i, 500 + j, 0.25) for i in range(3) for j in range(9)]
    got = PR.greedy_pairs(spark.createDataFrame(tied, "g bigint, i bigint, j bigint, score double"), ["g"]).collect()
    assert sorted((r.i, r.j) for r in got) == [(k, k) for k in range(120)] + [(500 + k, 500 + k) for k in range(3)]
    assert len(rounds) < 6
    dice = random.Random(8)
    mixed = [(g, i, j, dice.choice([0.5, 0.5, 0.75])) for g in range(30) for i in range(5) for j in range(6) if dice.random() < 0.8]
    out = PR.greedy_pairs(spark.createDataFrame(mixed, "g bigint, i bigint, j bigint, score double"), ["g"]).collect()
    want = [(g, i, j) for g in range(30) for i, j, _ in greedy([(s, i, j) for h, i, j, s in mixed if h == g])]
    assert sorted((r.g, r.i, r.j) for r in out) == sorted(want)


def test_asking_items_are_served_in_order(spark):
    dice = random.Random(21)
    words = "alpha beta gamma delta epsilon".split()
    text = lambda: " ".join(dice.choice(words) for _ in range(dice.randrange(5)))
    asking = [(d, dice.choice("ST"), i, dice.choice(["", "f", "g"]), text()) for d in range(40) for i in range(6)]
    base = [(d, dice.choice("ST"), j, dice.choice(["", "f", "g"]), text()) for d in range(40) for j in range(6)]
    cut = lambda t: set(re.findall("[^ ]+", t))
    score = lambda a, b: 1.0 if cut(a) == cut(b) else len(cut(a) & cut(b)) / len(cut(a) | cut(b))
    want, claimed = [], set()
    for d, section, i, names, said in asking:
        free = [b for b in base if b[:2] == (d, section) and (d, b[2]) not in claimed]
        found = [(-score(said, b[4]), b[2]) for b in free if b[3] == names] if names or not said else []
        if not found and said:
            found = [(-score(said, b[4]), b[2]) for b in free if b[4] and (not names or not b[3]) and score(said, b[4]) >= V.PAIRING_THRESHOLD]
        if found:
            s, j = min(found)
            claimed.add((d, j))
            want.append((d, section, i, j, -s))
    frames = [spark.createDataFrame(rows, f"doc_id bigint, section string, {side} bigint, entities string, text string")
              for rows, side in ((asking, "i"), (base, "j"))]
    pairs, left = PR.pair_asking(*frames)
    assert sorted((r.doc_id, r.section, r.i, r.j, r.score) for r in pairs.collect()) == sorted(want)
    assert sorted((r.doc_id, r.i) for r in left.collect()) == sorted({a[0:3:2] for a in asking} - {(w[0], w[2]) for w in want})


def test_last_candidates_are_walked_and_rounds_agree(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(PR, "checkpointed", lambda df: cuts.append(1) or df.localCheckpoint())
    # Only the best pair of what is left of a chain is best for both of its sides, so rounds alone take one at a time.
    chain = [(k, k + d, 1.0 / (2 * k + d + 2)) for k in range(40) for d in (0, 1)]
    df = spark.createDataFrame(chain, "i long, j long, score double")
    want = sorted((i, j) for i, j, _ in greedy([(s, i, j) for i, j, s in chain]))
    assert sorted((r.i, r.j) for r in PR.greedy_pairs(df).collect()) == want and len(cuts) == 1
    assert sorted((r.i, r.j) for r in PR.greedy_pairs(df.filter("i < 6"), walked=0).collect()) == want[:6]
    assert len(cuts) > 4
    assert PR.greedy_pairs(df.limit(0)).collect() == []


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_meetings_too_late_to_count_are_dropped_and_no_pair_with_them(spark, threshold):
    rng = random.Random(31)
    docs = []
    for base in range(8):  # texts of one stock of words, long enough for several meetings to be asked of a pair
        stock = [f"w{rng.randrange(900)}" for _ in range(260)]
        docs += [(10 * base + k, " ".join(rng.sample(stock, rng.randint(60, 240)))) for k in range(9)]
    classes = SM.token_classes(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id")
    pairs = SM.similar_pairs(classes, threshold)
    sets = [(d, set(text.split())) for d, text in docs]
    want = sorted((a, b) for a, x in sets for b, y in sets if a < b and len(x & y) / len(x | y) >= threshold)
    assert sorted((r.a, r.b) for r in pairs.collect()) == want and want
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join Inner" in line and "least(" in line for line in plan.splitlines())


def test_short_scripts_do_without_numpy_and_are_the_same(monkeypatch):
    rng = random.Random(37)
    cases = [([rng.randrange(6) for _ in range(rng.randrange(30))], [rng.randrange(6) for _ in range(rng.randrange(30))]) for _ in range(80)]
    short = [SQ.diff_values(a, b) for a, b in cases]
    monkeypatch.setattr(SQ, "SHORT", 0)
    assert [SQ.diff_values(a, b) for a, b in cases] == short
    monkeypatch.setattr(SQ, "SHORT", 64)
    monkeypatch.setattr(SQ, "_step", None)
    assert [SQ.diff_values(a, b) for a, b in cases] == short


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_document_is_paired_and_scripted_in_one_row(spark):
    old, new = corpus(spark, {1: ["a b", "c"]}), corpus(spark, {1: ["a b", "d"]})
    listed = [d.withColumnRenamed("line_no", "ord") for d in (old, new)]
    for df in (R.diff_nodes(old, new, ["doc_id"]), R.diff_alike(*listed, ["doc_id"], lone_pair=True)):
        assert plan_of(df).count("Exchange hashpartitioning") == 1 and "Window" not in plan_of(df) and "Join" not in plan_of(df)


def test_pairs_by_name_are_found_in_one_row(spark):
    rows = [spark.createDataFrame([(1, "x", k, "a b") for k in range(3)], f"doc_id long, name string, {i} long, text string") for i in "ij"]
    pairs = PR.pair_by_name(*rows, ["doc_id"])
    plan = plan_of(pairs)
    assert sorted((r.i, r.j, r.score) for r in pairs.collect()) == [(k, k, 1.0) for k in range(3)]
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_words_are_marked_in_their_own_row(spark):
    df = spark.createDataFrame([(1, "a b c d", "a x c y"), (2, None, "a")], "k long, old_text string, new_text string")
    plan = plan_of(R.mark_words(df, ["k"]))
    assert "Exchange" not in plan and "Window" not in plan
    rng = random.Random(41)
    for _ in range(60):  # the runs are those that the joined steps of the same words make
        a, b = ([rng.choice("abc") + " " for _ in range(rng.randint(0, 12))] for _ in range(2))
        runs = SQ.word_runs(a, b, 2)
        assert "".join(t for c, t in runs if c != 1) == "".join(b)
        assert "".join(t for c, t in runs if c != 2) == "".join(a)
        assert all(x != y for (x, _), (y, _) in zip(runs, runs[1:])) and all((x, y) != (2, 1) for (x, _), (y, _) in zip(runs, runs[1:]))


def test_attribute_words_are_found_whole(spark):
    texts = ["constexpr f()", "xconstexpr f()", "f() constexpr", "constexpr_ f()", "(constexpr)", "constexprconstexpr", "_constexpr constexpr", ""]
    listed = spark.createDataFrame([(1, i, 0, t) for i, t in enumerate(texts)], "doc_id long, i long, begin long, text string")
    declared = spark.createDataFrame([(1, i, False) for i in range(len(texts))], "doc_id long, i long, c boolean")
    edits, rest = ED.reconcile(listed, declared, ["doc_id"], {"constexpr": "c"})
    plan = plan_of(edits)
    found = {i for i, t in enumerate(texts) if re.search("(^|[^A-Za-z0-9_])constexpr($|[^A-Za-z0-9_])", t)}
    assert {r.i for r in rest.collect()} == {2, 4} and found == {0, 2, 4, 6} and edits.count() == 2
    assert "Contains(text" in plan or "contains(text" in plan.lower()
