"""Tree diff against a plain recursive walk; laws on random trees; long documents fold in time that grows with them."""

import random
import re
import time

from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.functions import sequence as SQ
from palimpsest.operators import sections as S
from palimpsest.operators import trees as TR

SCHEMA = ("doc_id bigint, node_id bigint, parent_id bigint, ancestors array<bigint>, ord bigint, type string, name string, "
          "entities array<string>, signatures array<string>, text string")


def grow(dice, depth=0):
    """A list of random nodes: (type, name, entities, signatures, text, children)."""
    out = []
    for _ in range(dice.randrange(0 if depth else 2, 7 - depth)):
        kind = dice.choice(["section", "item", "item", "paragraph", "element", "block"] if depth else ["section", "item", "paragraph", "synopsis"])
        words = " ".join(dice.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(dice.randrange(1, 6)))
        names = dice.choice([[], ["f"], ["f", "g"], ["h"]]) if kind == "item" else []
        signed = [f"void {words};"] if kind == "item" and dice.random() < 0.9 else []
        name = dice.choice(["s1", "s2", "s3"]) if kind in ("section", "synopsis", "element") else ""
        text = words if kind in ("paragraph", "block") else ""
        out.append([kind, name, names, signed, text, grow(dice, depth + 1) if depth < 3 and kind in ("section", "item", "element") else []])
    return out


def edited(dice, nodes):
    out = []
    for node in nodes:
        if dice.random() < 0.15:
            continue
        kind, name, names, signed, text, children = node
        if dice.random() < 0.2:
            text = text and text + " omega"
            signed = [s + " const" for s in signed]
        if dice.random() < 0.1 and kind == "item":
            names = []
        out.append([kind, name, names, signed, text, edited(dice, children)])
    if dice.random() < 0.3 and len(out) > 1:
        out[0], out[1] = out[1], out[0]
    return out + (grow(dice, 3) if dice.random() < 0.2 else [])


def rows_of(doc, nodes):
    rows = []

    def walk(some, above):
        for node in some:
            ident = len(rows) + 1
            rows.append((doc, ident, above[-1] if above else None, list(above), ident, *node[:5]))
            node.append(ident)
            walk(node[5], [*above, ident])
    walk(nodes, [])
    return rows


def plain(a, b, level, out):
    """The rules as one walk over both lists of siblings."""
    same = lambda x, y: x[:5] == y[:5] and len(x[5]) == len(y[5]) and all(map(same, x[5], y[5]))
    words = lambda s: set(re.findall(r"[^ \t\r\n]+", s))
    score = lambda s, t: 1.0 if words(s) == words(t) else len(words(s) & words(t)) / len(words(s) | words(t))
    exact = lambda n: (n[0], ",".join(sorted(set(n[2]))) + "|" + "|".join(n[3]) if n[0] == "item" else n[1]) if n[0] in TR.KEYED else None
    names = lambda n: ",".join(sorted(set(n[2])))
    pair, by, taken = {}, {}, set()

    def claim(i, j, why):
        pair[i], by[i] = j, why
        taken.add(j)

    def first_come(match, why):
        for i in range(len(a)):
            j = next((j for j in range(len(b)) if i not in pair and j not in taken and match(a[i], b[j])), None)
            if j is not None:
                claim(i, j, why)

    def best(match, least, why):
        found = [(-score(" ".join(x[3]), " ".join(y[3])), i, j) for i, x in enumerate(a) for j, y in enumerate(b)
                 if x[0] == y[0] == "item" and match(x, y)]
        for s, i, j in sorted(found):
            if -s >= least and i not in pair and j not in taken:
                claim(i, j, why)
    first_come(lambda x, y: exact(x) is not None and exact(x) == exact(y), "key")
    best(lambda x, y: names(x) and names(x) == names(y), 0.0, "names")
    best(lambda x, y: x[3] and y[3] and not (names(x) and names(y)), V.PAIRING_THRESHOLD, "reading")
    first_come(lambda x, y: exact(x) is None and x[0] == y[0] and score(x[4], y[4]) >= V.PAIRING_THRESHOLD, "wording")
    lone = [[k for k, n in enumerate(side) if n[0] == "block"] for side in (a, b)]
    if len(lone[0]) == len(lone[1]) == 1 and lone[0][0] not in pair and lone[1][0] not in taken:
        claim(lone[0][0], lone[1][0], "lone")
    back = {j: i for i, j in pair.items()}
    for op, i, j in SQ.diff_matches(len(a), len(b), list(pair), list(pair.values())):
        if op == "keep":
            x, y = a[i], b[j]
            out.append((level, x[6], y[6], "same" if same(x, y) else "edited", by[i], None))
            if not same(x, y):
                plain(x[5], y[5], level + 1, out)
        elif op == "delete":
            out.append((level, a[i][6], None, "removed", None, b[pair[i]][6] if i in pair else None))
        else:
            out.append((level, None, b[j][6], "added", None, a[back[j]][6] if j in back else None))
    return out


def test_equals_a_plain_walk(spark):
    dice = random.Random(11)
    trees = []
    for _ in range(40):
        before = grow(dice)
        trees.append((before, edited(dice, before) if dice.random() < 0.9 else grow(dice)))
    trees += [([], grow(dice)), (grow(dice), [])]
    old = [r for d, (a, _) in enumerate(trees) for r in rows_of(d, a)]
    new = [r for d, (_, b) in enumerate(trees) for r in rows_of(d, b)]
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in (old, new)]
    decided = TR.diff_trees(*frames, ["doc_id"]).cache()
    got = sorted((tuple(r) for r in decided.collect()), key=str)
    want = sorted(((d, *r) for d, (a, b) in enumerate(trees) for r in plain(a, b, 1, [])), key=str)
    assert got == want and {r[4] for r in got} == {"same", "edited", "removed", "added"}
    assert {"key", "names", "reading", "wording"} <= {r[5] for r in got} and any(r[6] for r in got)
    for nodes, frame, ident in ((old, frames[0], "a_id"), (new, frames[1], "b_id")):
        whole = TR.beneath(frame, decided, ["doc_id"], ident)
        assert whole.count() == len(nodes) == whole.select("doc_id", "node_id").distinct().count()


def test_equal_trees_are_settled_at_the_top(spark):
    nodes = rows_of(1, grow(random.Random(2)))
    frame = spark.createDataFrame(nodes, SCHEMA)
    got = TR.diff_trees(frame, frame, ["doc_id"]).collect()
    assert {(r.level, r.change) for r in got} == {(1, "same")} and len(got) == sum(r[2] is None for r in nodes)
    assert TR.diff_trees(frame.limit(0), frame.limit(0), ["doc_id"]).collect() == []


def test_a_document_with_very_many_headings_folds_soon(spark):
    def heads(n):
        return spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("line_no"), (
            F.pmod(F.xxhash64("id"), F.lit(6)) + 1).alias("depth"), F.concat(F.lit("s"), "id").alias("stable"))
    begun = time.time()
    got = {r.line_no: (r.parent, len(r.ancestors)) for r in S.fold_headings(heads(100000)).collect()}
    after = {r.line_no: r.next_line for r in S.next_at_or_above(heads(100000)).collect()}
    assert time.time() - begun < 120
    depths, stack, want = [r.depth for r in heads(100000).orderBy("line_no").collect()], [], {}
    for line, depth in enumerate(depths):
        while stack and depths[stack[-1]] >= depth:
            assert after[stack.pop()] == line
        want[line] = (stack[-1] if stack else None, len(stack))
        stack.append(line)
    assert got == want and all(after[line] is None for line in stack)


def test_hashes_meet_no_table_and_siblings_are_one_row(spark):
    nodes = spark.createDataFrame(rows_of(1, grow(random.Random(5))), SCHEMA)
    plan = TR.content_hashes(nodes, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    child = spark.createDataFrame([], "doc_id bigint, a_parent bigint, b_parent bigint, side string, ord bigint, node_id bigint, type string, "
                                  "exact string, names string, said string, content string, inner boolean")
    plan = TR._settled(child, ["doc_id", "a_parent", "b_parent"], 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
