"""Column expressions over text: lines, words, decoration, headings, tags, pieces. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest import vocabulary as V

BLANKS = "[ \\t]*"
WORD = "[^ \\t\\r\\n]+"
TEXT_ORDER = "[ \\t\\r\\n]"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def template(text: str, *args: Column) -> Column:
    """A finding text with its ``%s`` slots filled from columns."""
    return F.format_string(text, *[a.cast("string") for a in args])


# --- lines and words ------------------------------------------------------------------------------------------

def lines_of(text: Column | str) -> Column:
    """The lines of a text; the empty line after a final newline is dropped. An empty text is one empty line."""
    parts = F.split(_col(text), "\n", -1)
    return F.when((F.size(parts) > 1) & (F.try_element_at(parts, F.lit(-1)) == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def words_of(text: Column | str) -> Column:
    """Words, each with the whitespace after it; leading whitespace is a word of its own."""
    return F.regexp_extract_all(_col(text), F.lit(f"^{TEXT_ORDER}+|{WORD}{TEXT_ORDER}*"), F.lit(0))


def code_tokens_of(text: Column | str) -> Column:
    """Tokens of a code line, each with the whitespace after it: an identifier or number, or one other character."""
    return F.regexp_extract_all(_col(text), F.lit(
        f"^{TEXT_ORDER}+|[A-Za-z0-9_]+{TEXT_ORDER}*|[^A-Za-z0-9_ \\t\\r\\n]{TEXT_ORDER}*"), F.lit(0))


def code_token_set(text: Column | str) -> Column:
    """The distinct code tokens of a line without their whitespace; leading whitespace leaves an empty one."""
    return F.array_distinct(F.transform(code_tokens_of(text), lambda t: rstripped(t)))


def token_set(text: Column | str) -> Column:
    """The distinct words of a text without their whitespace."""
    return F.array_distinct(F.regexp_extract_all(_col(text), F.lit(WORD), F.lit(0)))


def rstripped(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), f"{TEXT_ORDER}+$", "")


def name_runs(text: Column | str) -> Column:
    """Identifier runs of a text, each behind the gap before it; a last gap with no name closes the array."""
    runs = F.regexp_extract_all(_col(text), F.lit("[^A-Za-z0-9_]*[A-Za-z0-9_]+|[^A-Za-z0-9_]+$"), F.lit(0))
    return F.transform(runs, lambda r: F.struct(
        F.regexp_extract(r, "^([^A-Za-z0-9_]*)", 1).alias("gap"),
        F.regexp_extract(r, "([A-Za-z0-9_]*)$", 1).alias("name")))


# --- comment lines ----------------------------------------------------------------------------------------------

def vocabulary_of(raw: Column | str) -> Column:
    """Which comment vocabulary a line opens: markup, doxygen, draft; NULL for a line that is no comment."""
    raw = _col(raw)
    return (F.when(raw.rlike(f"^{BLANKS}(?://!|/\\*!)"), "markup")
            .when(raw.rlike(f"^{BLANKS}(?:///|/\\*\\*)"), "doxygen")
            .when(raw.rlike(f"^{BLANKS}(?://|/\\*)"), "draft"))


def strip_decoration(raw: Column | str) -> Column:
    """The line without its comment leader and the one space after it."""
    return F.regexp_replace(_col(raw), f"^{BLANKS}(?://[!/]?|/\\*[!*]?|\\*(?!/))? ?", "")


# --- headings, fences, references, tags ---------------------------------------------------------------------------

_HEADING_TAG = f"^{BLANKS}//[/!]?{BLANKS}\\\\rSec"
_BARE_TAG = f"^{BLANKS}(?://[/!]?{BLANKS})?\\\\rSec"
_HEAD = f"([0-9]+){BLANKS}\\[([^\\]]*)\\]{BLANKS}\\{{"


def heading_tagged(raw: Column | str, bare: bool = False) -> Column:
    """A line that begins a heading; with ``bare`` also one without a comment leader, as drafts have them."""
    return _col(raw).rlike(_BARE_TAG if bare else _HEADING_TAG)


def balanced(text: Column) -> Column:
    """What stands before the brace that closes a group opened just ahead of ``text``; NULL where none does.

    Nested groups of any depth are passed over, by one fold over the braces of the text.
    """
    braces = F.regexp_extract_all(text, F.lit("[^{}]*[{}]"), F.lit(0))

    def step(acc, part):
        depth = acc["depth"] + F.when(F.endswith(part, F.lit("{")), 1).otherwise(-1)
        ended = acc["depth"] == 0
        return F.struct(F.when(ended, 0).otherwise(depth).alias("depth"),
                        (acc["length"] + F.when(ended, 0).otherwise(F.length(part))).alias("length"))
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("length"))
    end = F.aggregate(braces, start, step)
    return F.when(end["depth"] == 0, F.substring(text, F.lit(1), end["length"] - 1))


def heading_of(raw: Column | str, bare: bool = False) -> Column:
    """struct(depth, stable, title) of a well-formed heading line, else NULL. The title is a balanced group."""
    raw = _col(raw)
    head = (_BARE_TAG if bare else _HEADING_TAG) + _HEAD
    part = lambda i: F.regexp_extract(raw, head, i)
    title = balanced(F.regexp_replace(raw, head, ""))
    return F.when(raw.rlike(head) & title.isNotNull(), F.struct(
        part(1).try_cast("bigint").alias("depth"), part(2).alias("stable"),
        unwrap_title(title).alias("title")))


def unwrap_title(title: Column) -> Column:
    """A title broken over several comment lines, joined back with single spaces."""
    return F.regexp_replace(title, f"[ \\t\\r]*\\n{BLANKS}(?://[/!]?{BLANKS})?", " ")


def fence_of(raw: Column | str) -> Column:
    """The stable name of a section end fence line, else NULL."""
    name = F.regexp_extract(_col(raw), f"^{BLANKS}///{BLANKS}END \\[(.+)\\][ \\t\\r]*$", 1)
    return F.when(name != "", name)


def ref_of(raw: Column | str) -> Column:
    """The stable name a reference comment line gives, else NULL."""
    raw = _col(raw)
    pattern = f"^{BLANKS}//[/!]?{BLANKS}\\\\ref{BLANKS}\\{{([^}}]*)\\}}"
    return F.when(raw.rlike(pattern), F.regexp_extract(raw, pattern, 1))


def tag_of(line: Column | str) -> Column:
    """The tag a stripped line starts with, else NULL."""
    tag = F.regexp_extract(_col(line), f"^{BLANKS}\\\\([a-z0-9-]+)", 1)
    return F.when(tag != "", tag)


def after_tag(line: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(line), f"^{BLANKS}\\\\[a-z0-9-]+(?:\\([^)]*\\))?", ""))


def index_entry(raw: Column | str) -> Column:
    """struct(kind, name, parent) of an index line, else NULL. Two-argument entries need both arguments."""
    raw = F.trim(_col(raw))
    macro = F.regexp_extract(raw, "^\\\\(indexlibrary[a-z]+)", 1)
    arguments = F.regexp_extract_all(F.regexp_extract(raw, f"^\\\\[a-z]+((?:{BLANKS}\\{{[^}}]*\\}}){{1,2}})", 1),
                                     F.lit("\\{([^}]*)\\}"), F.lit(1))
    shapes = F.create_map(*[F.lit(x) for name, kind, arity in V.INDEX_MACROS for x in (name, f"{kind}:{arity}")])
    shape = F.split(F.try_element_at(shapes, macro), ":")
    arity = F.get(shape, 1).cast("int")
    return F.when(arity <= F.size(arguments), F.struct(
        F.get(shape, 0).alias("kind"), F.get(arguments, 0).alias("name"),
        F.when(arity == 2, F.get(arguments, 1)).otherwise("").alias("parent")))


# --- prose ------------------------------------------------------------------------------------------------------

def strip_comment(line: Column | str) -> Column:
    """The line up to its first unescaped percent sign, trimmed."""
    return F.trim(F.regexp_extract(_col(line), "^((?:[^%\\\\]++|\\\\.?)*+)", 1))


def space_after(line: Column | str) -> Column:
    """Whether what follows on the next line is a word apart: only a comment written flush joins."""
    return ~_col(line).rlike("^(?:[^%\\\\]++|\\\\.?)*+(?<=[^ \\t])%")


def unescape(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), "\\\\([&%#])", "$1")


def pieces_of(text: Column | str) -> Column:
    """Prose cut into struct(kind, text) pieces: text, code, open_code, or the macro's name.

    An unterminated code span keeps its text, under the kind ``open_code``.
    """
    macros = "|".join(V.PROSE_MACROS)
    pattern = (f"`[^`]*`|`[^`]*$|\\\\(?:{macros})\\{{[^{{}}]*\\}}"
               f"|(?:[^`\\\\]++|\\\\(?!(?:{macros})\\{{[^{{}}]*\\}}))++")
    raw = F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(0))
    return F.transform(raw, lambda p: F.when(
        p.rlike("^`[^`]*`$"), F.struct(F.lit("code").alias("kind"), F.substring(p, F.lit(2), F.length(p) - 2).alias("text"))
    ).when(p.startswith("`"), F.struct(F.lit("open_code").alias("kind"), F.substring(p, F.lit(2), F.length(p)).alias("text"))
    ).when(p.rlike(f"^\\\\(?:{macros})\\{{[^{{}}]*\\}}$"), F.struct(
        F.regexp_extract(p, "^\\\\([A-Za-z]+)", 1).alias("kind"),
        F.regexp_extract(p, "\\{([^{}]*)\\}", 1).alias("text"))
    ).otherwise(F.struct(F.lit("text").alias("kind"), unescape(p).alias("text"))))


def cells_of(row: Column | str, separator: str = "&") -> Column:
    """The trimmed cells of a table row, cut at separators that are not escaped."""
    cells = F.split(_col(row), f"(?<!\\\\)\\Q{separator}\\E", -1)
    return F.transform(cells, lambda c: F.trim(c))


# --- names ------------------------------------------------------------------------------------------------------

def hyphenated(name: Column | str) -> Column:
    """A name as prose prints it: trailing underscores cut, the others hyphens."""
    return F.translate(F.regexp_replace(_col(name), "_+$", ""), "_", "-")


def usable_as_file_name(name: Column | str) -> Column:
    name = _col(name)
    return (name.rlike("^[A-Za-z0-9._+-]+$") & ~name.rlike("^[.-]") & ~name.endswith(".")
            & ~name.contains(".."))


# --- lists --------------------------------------------------------------------------------------------------------

def sentence(parts: Column) -> Column:
    """One part alone, two with ``and``, more with serial commas; a full stop ends it. Empty gives an empty text."""
    n = F.size(parts)
    head = F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    last = F.try_element_at(parts, F.lit(-1))
    return (F.when(n == 0, "").when(n == 1, F.concat(last, F.lit(".")))
            .when(n == 2, F.concat(head, F.lit(" and "), last, F.lit(".")))
            .otherwise(F.concat(head, F.lit(", and "), last, F.lit("."))))


def bullets(parts: Column) -> Column:
    """One item to a part: a comma ends each, a full stop the last."""
    n = F.size(parts)
    return F.transform(parts, lambda p, i: F.concat(p, F.when(i + 1 == n, ".").otherwise(",")))


def render_list(parts: Column, threshold: int) -> Column:
    """A sentence up to ``threshold`` parts, bullets past it."""
    return F.when(F.size(parts) <= threshold, sentence(parts)).otherwise(
        F.array_join(F.transform(bullets(parts), lambda p: F.concat(F.lit("- "), p)), "\n"))


# --- sets ---------------------------------------------------------------------------------------------------------

def jaccard(a: Column, b: Column) -> Column:
    """Share of the tokens of two sets that both have; two empty sets are the same set."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(common / (total - common))
