"""Word lists, ranks, thresholds and finding texts that results depend on.

Nothing here is logic. Every list is in its natural order because the order is itself a value (element rank,
precedence of a disposition, first matching prefix).
"""

# Description elements in canonical order; the rank of a kind is its position.
ELEMENT_KINDS = [
    "constraints", "mandates", "expects", "hardexpects", "effects", "sync", "ensures", "result", "returns",
    "throws", "complexity", "remarks", "errors", "recommended",
]

# Tags that open, close or divide a block inside a description.
BLOCK_TAGS = [
    "item", "lib2dtab2", "libtab2", "endlib2dtab2", "endlibtab2", "column", "row", "cell", "note", "endnote",
    "example", "endexample", "codeblock", "endcodeblock",
]

# Markers: tags that say something of the declaration and hold no wording.
MARKER_TAGS = [
    "also", "group", "at", "omit", "merge", "elsewhere", "expos", "seebelow", "impdef", "asdraft",
    "effects-equiv", "returns-expr", "verbatim-synopsis", "asdraft-synopsis", "covers", "iref",
]

# (open tag, close tag) of informative and verbatim blocks.
BLOCK_PAIRS = [("note", "endnote"), ("example", "endexample"), ("codeblock", "endcodeblock")]

# Tags that may not both stand on one description.
EXCLUSIVE_TAGS = [
    ("effects", "effects-equiv"), ("returns", "returns-expr"), ("group", "also"), ("impdef", "seebelow"),
    ("elsewhere", "omit"), ("elsewhere", "merge"), ("elsewhere", "expos"),
]

# Tags that take a description or synopsis from elsewhere, the tags they cannot stand beside, and the finding.
TAKEN_TAGS = [
    ("asdraft", ["omit", "merge", "elsewhere"],
     "\\asdraft takes the item's description, so it cannot be \\omit, \\merge or \\elsewhere"),
    ("asdraft-synopsis", ["verbatim-synopsis"],
     "\\asdraft-synopsis takes the baseline's synopsis, so it cannot be \\verbatim-synopsis"),
]
ALSO_DESCRIBED = "\\also block should carry no description; they are ignored by grouping"

# Prose macros with a braced argument.
PROSE_MACROS = [
    "iref", "placeholder", "cv", "cvqual", "oldconcept", "libconcept", "exposconcept", "ref", "tref", "term",
    "defn", "Fundescx", "impldef", "ntbs", "ntmbs",
]

# Index macro, the kind of entry it makes, and how many arguments it takes.
INDEX_MACROS = [
    ("indexlibraryglobal", "global", 1), ("indexlibraryctor", "constructor", 1),
    ("indexlibrarydtor", "destructor", 1), ("indexlibrarymemberexpos", "memberexpos", 2),
    ("indexlibrarymemberx", "memberx", 2), ("indexlibrarymember", "member", 2),
    ("indexlibraryzombie", "zombie", 1), ("indexlibrarymisc", "misc", 2),
]

# Disposition of a declared row, whether a reader can see it, and why not.
DISPOSITIONS = [
    ("merged", False, "a `\\merge`d twin"), ("omitted", False, "`\\omit`ted"), ("routed", True, "visible"),
    ("described", True, "visible"), ("expos", True, "visible"), ("private", False, "an unmarked private member"),
    ("declared", True, "visible"), ("defaulted", True, "visible"),
    ("undocumented", False, "declared but never described"),
]

# Attribute words two listings must agree on, and which of them a text edit can write.
ATTRIBUTES = [
    ("constexpr", True), ("explicit", True), ("noexcept", True), ("static", False), ("friend", False),
    ("= default", False), ("= delete", False),
]

# Revision diff.
PAIRING_THRESHOLD = 0.5   # two texts are one text edited when their token sets share this much
REWRAP_THRESHOLD = 0.8    # several lines are one run re-wrapped when they share this much
ISLAND = 2                # kept words between two changes that the changes swallow
LOOKAHEAD = 3             # pieces after a subject in which its truth value is looked for
HEADING_LIMIT = 6         # deepest heading level a text format has

# Wording of findings.
UNDOCUMENTED = ("`%s` is declared in the synopsis but is not described, `\\omit`ted, `\\merge`d, or defaulted")
ROUTED_NOWHERE = ("the description of `%s` is routed to no section: it is written in the class body under no "
                  "`\\ref` group and carries no `\\at`")
ROUTED_MISSING = "the description of `%s` is routed to [%s], which is not a section in this document"
PRIVATE_DATA = ("`%s` is unmarked private data in a class that marks other members `\\expos`, so it is dropped "
                "from the synopsis: mark it `\\expos` too if the wording describes this class's state in terms "
                "of it")
LEAKED = ("`%s` is used in wording but is not a documented entity (%s): mark it `\\expos`, rewrite the wording "
          "in documented terms, or demote it to authored prose")
LEAKED_SYNOPSIS = ("`%s` is named in the synopsis but is not a visible declaration (%s): mark it `\\expos` so it "
                   "can be named, or mask the declaration that names it (bare `\\seebelow`, or `\\impdef` on an "
                   "alias)")
FOREIGN_QUALIFIER = ("`%s` appears in rendered output but is not a documented entity (a namespace qualifier "
                     "resolving to `%s`): rewrite the name in documented terms, or move the entity it names into "
                     "the specified namespace")
UNEXTRACTED = ("`%s` is used by this body but is not a documented entity (%s); no wording names it, so nothing "
               "leaks yet: mark it `\\expos` before giving this body an `\\effects-equiv`, or leave it as "
               "machinery the description does not name")
DUPLICATES_EVIDENCE = "the authored %s duplicates the derived `%s` conjunct"
CONTRADICTS_EVIDENCE = "the authored %s contradicts the derived `%s` conjunct (derived `%s`, authored `%s`)"
NO_COUNTERPART = "the derived `%s` conjunct has no authored %s counterpart anywhere in the description"
CLAIM_INVALID = ("invalid explicit coverage claim; expected a predicate and polarity on an authored Constraints "
                 "or Mandates element with normative wording")
CLAIM_DUPLICATE = "duplicate coverage claim for `%s`"
CLAIM_MATCHES = "coverage claim `%s` matches %s derived conjuncts; expected exactly one"
CLAIM_POLARITY = "coverage claim `%s` has the wrong polarity for its derived conjunct"
NOEXCEPT_NOTHING = ("`%s` is declared `noexcept`, so the authored throws saying `Nothing` adds nothing: drop the "
                    "element")
NOEXCEPT_THROWS = ("`%s` is declared `noexcept`, but the authored throws says it throws: correct the wording, or "
                   "take `noexcept` off the declaration")
SPAN_INVERTED = "span %s is inverted: begin %s > end %s"
SPAN_PAST_END = "span %s end %s exceeds text length %s"
SPAN_OVERLAP = "span %s begins at %s, before span %s ends at %s"
DANGLING_REF = "the synopsis's `\\ref` group header names [%s], which is not a section in this document"
EMPTY_SYNOPSIS = "the synopsis has no code and would render as an empty code block"
EMPTY_ITEM = "the item has neither a declaration nor a description"
DISAGREES = "the synopsis %s `%s` and the declaration %s"
ONLY_SYNOPSIS = "the synopsis declares this, and the code does not"
ONLY_DECLARED = "the code declares this, and the synopsis does not"
EXCLUSIVE = "\\%s and \\%s are mutually exclusive"
UNKNOWN_TAG = "unknown tag \\%s; line kept as prose"
DUPLICATE_ELEMENT = "duplicate \\%s element; both kept"
OUT_OF_ORDER = "\\%s appears after \\%s; output is canonicalized"
OUTSIDE_BLOCK = "\\%s appears outside its block"
BLOCKS_NEST = "notes and examples cannot nest"
MISSING_END = "missing \\end%s"
COLUMN_LATE = "\\column must precede every \\row"
COLUMNS_EXTRA = "\\%s accepts exactly two \\column entries"
ROW_EARLY = "\\row requires two preceding \\column entries"
ROW_ARITY = "the preceding \\row requires exactly %s; found %s"
LAST_ROW_ARITY = "the final \\row requires exactly %s; found %s"
CELL_EARLY = "\\cell requires a preceding \\row"
CELL_EXTRA = "each \\row accepts exactly %s"
TABLE_NESTED = "nested \\%s is not allowed"
TAG_IN_TABLE = "unexpected \\%s inside \\%s"
TABLE_COLUMNS = "%s requires exactly two \\column entries; found %s"
TABLE_ROWS = "%s requires at least one \\row"
PROSE_OUTSIDE = "detached prose requires an open section"
FENCE_NONE = "END [%s] has no open section to close"
FENCE_MISMATCH = "END [%s] does not match open section [%s]"
ALSO_UNRESOLVED = "\\also target '%s' has no preceding \\group primary in this section"
GROUP_DUPLICATE = "duplicate \\group id '%s' in this section"
FRAGMENT_UNNAMED = "the section '%s' has no stable name to derive a fragment path from"
FRAGMENT_UNUSABLE = "'%s' cannot name a file, so it cannot name a fragment"
FRAGMENT_COLLISION = "two fragments would both be named '%s'"
FRAGMENT_NO_PREFIX = ("%s top-level nodes sit outside every section, and the section stable names share no common "
                      "prefix to name it by")
COVERS_MISSING = ("\\covers names the %s element, and neither the baseline's description nor this item has one")
EDIT_OVERLAP = "an edit of bytes %s to %s overlaps another or runs past the end"
UNTERMINATED = "unterminated ` code span"

# Labels of description elements, by kind in canonical order.
ELEMENT_LABELS = [
    "Constraints", "Mandates", "Preconditions", "Hardened preconditions", "Effects", "Synchronization",
    "Postconditions", "Result", "Returns", "Throws", "Complexity", "Remarks", "Error conditions",
    "Recommended practice",
]

# What stands before and after an inline piece, by text format and kind of piece.
INLINE_FORMS = {
    "markdown": {
        "text": ("", ""), "open_code": ("", ""), "code": ("`", "`"), "iref": ("([", "]{- .sref})"),
        "ref": ("[", "]{- .sref}"), "placeholder": ("*", "*"), "cvqual": ("*", "*"), "cv": ("*cv", "*"),
        "oldconcept": ("*Cpp17", "*"), "libconcept": ("`", "`"), "exposconcept": ("`$", "$`"),
        "term": ("*", "*"), "defn": ("*", "*"), "Fundescx": ("*", "*"), "tref": ("[Table \\[", "\\]]"),
    },
    "latex": {
        "text": ("", ""), "open_code": ("", ""), "code": ("\\tcode{", "}"), "iref": ("\\iref{", "}"),
        "ref": ("\\ref{", "}"), "placeholder": ("\\placeholder{", "}"), "cvqual": ("\\cvqual{", "}"),
        "cv": ("\\cv{", "}"), "oldconcept": ("\\oldconcept{", "}"), "libconcept": ("\\libconcept{", "}"),
        "exposconcept": ("\\exposconcept{", "}"), "term": ("\\term{", "}"), "defn": ("\\defn{", "}"),
        "Fundescx": ("\\Fundescx{", "}"), "tref": ("\\tref{", "}"),
    },
    "org": {
        "text": ("", ""), "open_code": ("", ""), "code": ("~", "~"), "iref": ("([[", "]])"), "ref": ("[[", "]]"),
        "placeholder": ("/", "/"), "cvqual": ("/", "/"), "cv": ("/cv", "/"), "oldconcept": ("/Cpp17", "/"),
        "libconcept": ("~", "~"), "exposconcept": ("~", "~"), "term": ("/", "/"), "defn": ("/", "/"),
        "Fundescx": ("/", "/"), "tref": ("[[", "]]"),
    },
}

# Marks around a changed run of prose, and around whole blocks.
RUN_MARKS = {
    "markdown": {"added": ("[", "]{.add}"), "removed": ("[", "]{.rm}")},
    "latex": {"added": ("\\added{", "}"), "removed": ("\\removed{", "}")},
    "org": {"added": ("[[insert:][", "]]"), "removed": ("[[delete:][", "]]")},
}
BLOCK_MARKS = {
    "markdown": {"added": ("::: add\n\n", "\n:::\n"), "removed": ("::: rm\n\n", "\n:::\n")},
    "latex": {"added": ("\\begin{addedblock}\n", "\n\\end{addedblock}\n"),
              "removed": ("\\begin{removedblock}\n", "\n\\end{removedblock}\n")},
    "org": {"added": ("#+begin_addedblock\n", "\n#+end_addedblock\n"),
            "removed": ("#+begin_removedblock\n", "\n#+end_removedblock\n")},
}

# Characters a format reserves in running text: (pattern, replacement).
TEXT_ESCAPES = {"markdown": None, "latex": ("([&%#])", "\\\\$1"), "org": None}

# File name ending of a fragment.
EXTENSIONS = {"markdown": ".md", "latex": ".tex", "org": ".org"}
