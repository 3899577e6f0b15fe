"""Blocks inside descriptions against a plain pushdown reader; the layouts that nest; tables written as tags."""

import random
import re

from palimpsest import vocabulary as V
from palimpsest.operators import blocks as B


def tag(text):
    match = re.match(r"[ \t]*\\([a-z0-9-]+)(?:\([^)]*\))?", text)
    return (match[1], text[match.end():].strip(" ")) if match else (None, text.strip(" "))


def plain(lines):
    """One pass with a stack of open items: (items, code blocks)."""
    items, codes, stack, table, code, talk, ord_, fresh, blank = [], [], [], None, None, None, 0, True, False
    for no, text in enumerate(lines, 1):
        name, after = tag(text)
        indent = len(text) - len(text.lstrip(" "))
        if code is not None:
            if name == "endcodeblock":
                codes[-1][2] = True
                code = None
            else:
                codes[-1][3].append(text[min(code, indent):])
            blank = False
            continue
        if name in V.ELEMENT_KINDS or name in ("endnote", "endexample"):
            table = None
        if table:
            if name == B.TABLES[table][0]:
                table = None
            continue
        if name in B.TABLES:
            table, talk = name, None
            continue
        if not text.strip(" "):
            if blank:
                stack, fresh = [], True
            blank, talk = True, None
            continue
        blank = False
        if name == "codeblock":
            while stack and stack[-1][0] >= indent:
                stack.pop()
            owners = [line for _, line in stack if line]
            if not owners:
                fresh = True
            codes.append([no, owners[-1] if owners else None, False, []])
            stack.append((indent, None))
            code, talk = indent, None
        elif name == "item":
            while stack and stack[-1][0] >= indent:
                stack.pop()
            owners = [line for _, line in stack if line]
            if fresh:
                ord_, fresh = ord_ + 1, False
            items.append([no, ord_, owners[-1] if owners else None, len(owners) + 1, [after] if after else []])
            stack.append((indent, no))
            talk = items[-1][4]
        elif name:
            talk = None
            if name in V.ELEMENT_KINDS + ["note", "example", "endnote", "endexample"]:
                stack, fresh = [], True
        elif talk is not None:
            talk.append(text.strip(" "))
    return ([(n, o, w, lv, " ".join(t)) for n, o, w, lv, t in items], [(n, w, done, "\n".join(t)) for n, w, done, t in codes])


def frame(spark, docs):
    return spark.createDataFrame([(d, i, text) for d, lines in enumerate(docs) for i, text in enumerate(lines, 1)],
                                 "doc_id bigint, line_no bigint, text string")


def test_equals_a_plain_reader(spark):
    dice = random.Random(6)
    forms = ["\\item a", "\\item", "\\item b c", "\\codeblock", "\\endcodeblock", "\\endcodeblock", "", "prose", "more words", "\\effects x", "\\note n",
             "\\endnote", "\\lib2dtab2", "\\endlib2dtab2", "\\row r", "\\unknown"]
    docs = [[" " * dice.choice([0, 0, 2, 2, 4, 6]) + dice.choice(forms + ["\\item z"] * 6 + ["f();"] * 3) for _ in range(dice.randrange(40))]
            for _ in range(120)]
    lines = frame(spark, docs)
    items, codes = B.list_items(lines).collect(), B.code_blocks(lines).collect()
    for d, given in enumerate(docs):
        want_items, want_codes = plain(given)
        assert sorted(tuple(r)[1:] for r in items if r.doc_id == d) == want_items, given
        assert sorted((tuple(r)[1:] for r in codes if r.doc_id == d), key=lambda r: r[0]) == want_codes, given


def test_lists_and_code_by_indentation(spark):
    lines = frame(spark, [["\\effects", "\\item One of:", "  \\item a, equivalent to:", "    \\codeblock", "    f();", "      g();", "    \\endcodeblock",
                           "  \\item b, and then:", "    \\item c", "\\item Otherwise,", "  no effect.", "\\codeblock", "h();", "\\endcodeblock", "\\item new"]])
    got = [tuple(r)[1:] for r in B.list_items(lines).orderBy("line_no").collect()]
    assert got == [(2, 1, None, 1, "One of:"), (3, 1, 2, 2, "a, equivalent to:"), (8, 1, 2, 2, "b, and then:"), (9, 1, 8, 3, "c"),
                   (10, 1, None, 1, "Otherwise, no effect."), (15, 2, None, 1, "new")]
    assert [tuple(r)[1:] for r in B.code_blocks(lines).orderBy("line_no").collect()] == [(4, 3, True, "f();\n  g();"), (12, None, True, "h();")]


def test_tables_written_as_tags(spark):
    good = ["\\lib2dtab2 [t]{Cap}", "\\column A", "\\column B", "\\row r1", "\\cell c1", "on", "\\cell c2", "", "\\row r2", "\\cell d1", "\\cell d2", "\\endlib2dtab2", "after"]
    bad = ["\\libtab2", "\\cell x", "\\column A", "\\row r", "\\cell 1", "\\cell 2", "\\column B", "\\lib2dtab2", "\\item i", "\\row s", "\\effects e"]
    parts, findings = B.tag_tables(frame(spark, [good, bad, ["\\libtab2"]]))
    got = [tuple(r)[1:] for r in parts.filter("doc_id = 0").orderBy("row_no", "part", "part_no").collect()]
    assert got == [(1, "caption", 0, 0, "[t]{Cap}"), (1, "column", 0, 1, "A"), (1, "column", 0, 2, "B"), (1, "cell", 1, 1, "c1 on"),
                   (1, "cell", 1, 2, "c2"), (1, "row", 1, 0, "r1"), (1, "cell", 2, 1, "d1"), (1, "cell", 2, 2, "d2"), (1, "row", 2, 0, "r2")]
    said = sorted((r.doc_id, r.line_no, r.message) for r in findings.collect())
    assert said == sorted([
        (1, 2, "\\cell requires a preceding \\row"), (1, 4, "\\row requires two preceding \\column entries"),
        (1, 6, "each \\row accepts exactly one \\cell entry"), (1, 7, "\\column must precede every \\row"),
        (1, 8, "nested \\lib2dtab2 is not allowed"), (1, 9, "unexpected \\item inside \\libtab2"),
        (1, 10, "the preceding \\row requires exactly one \\cell entry; found 2"),
        (1, 10, "missing \\endlibtab2"), (1, 10, "the final \\row requires exactly one \\cell entry; found 0"),
        (2, 1, "missing \\endlibtab2"), (2, 1, "\\libtab2 requires exactly two \\column entries; found 0"), (2, 1, "\\libtab2 requires at least one \\row")])
