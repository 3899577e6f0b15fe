"""Revision diff: pair, script, mark. From whole nodes down to words.

Only what differs reaches the script core. Equal sides are settled by comparing them in the row, equal elements by
joins, and the arrays that remain are bounded by one document revision, which is one cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.functions import pairs as PP
from palimpsest.functions import sequence as SQ
from palimpsest.functions import text as X
from palimpsest.operators import pairing as PR

KEEP, DELETE, INSERT = "keep", "delete", "insert"


def _kept_all(a: Column) -> Column:
    return F.transform(a, lambda x, i: F.struct(F.lit(KEEP).alias("op"), i.alias("a"), i.alias("b")))


def _one_sided(values: Column, op: str) -> Column:
    a = (lambda i: i) if op == DELETE else (lambda i: F.lit(0))
    b = (lambda i: i) if op == INSERT else (lambda i: F.lit(0))
    return F.transform(values, lambda x, i: F.struct(F.lit(op).alias("op"), a(i).alias("a"), b(i).alias("b")))


def with_scripts(df: DataFrame, a: str, b: str, name: str = "script") -> DataFrame:
    """Add the edit script of two array columns. Equal arrays and one-sided ones are scripted without Python."""
    plain = (F.when(F.col(a) == F.col(b), _kept_all(F.col(a))).when(F.size(a) == 0, _one_sided(F.col(b), INSERT))
             .when(F.size(b) == 0, _one_sided(F.col(a), DELETE)))
    # A settled row hands the core NULLs, so only what differs crosses into Python.
    settled = df.withColumn("_plain", plain)
    unsettled = F.col("_plain").isNull()
    return settled.withColumn(name, F.coalesce("_plain", SQ.script_of_values(
        F.when(unsettled, F.col(a)), F.when(unsettled, F.col(b))))).drop("_plain")


def edits(df: DataFrame, keys: Sequence[str], script: str = "script") -> DataFrame:
    """One row per step; ``a`` and ``b`` count elements from 0."""
    return df.select(*keys, F.posexplode(script).alias("pos", "_s")).select(
        *keys, "pos", F.col("_s.op").alias("op"), F.col("_s.a").alias("a"), F.col("_s.b").alias("b"))


def join_islands(steps: DataFrame, keys: Sequence[str], island: int = V.ISLAND, carry: Sequence[str] = ()) -> DataFrame:
    """Swallow kept runs of at most ``island`` steps between two changes, and put each change's deletions first.

    A swallowed step becomes its own deletion and insertion. Steps come back numbered anew, with the number of the
    run they are in. ``carry`` names further columns of a step to keep.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = F.col("op") == KEEP
    starts = F.when(F.lag(kept).over(w).eqNullSafe(kept), 0).otherwise(1)
    runs = steps.withColumn("_starts", starts).withColumn("_run", F.sum("_starts").over(upto))
    whole = Window.partitionBy(*keys, "_run")
    sized = (runs.withColumn("_size", F.count("*").over(whole))
             .withColumn("_runs", F.max("_run").over(Window.partitionBy(*keys))))
    swallowed = kept & (F.col("_size") <= island) & (F.col("_run") > 1) & (F.col("_run") < F.col("_runs"))
    doubled = sized.withColumn("op", F.explode(F.when(
        swallowed, F.array(F.lit(DELETE), F.lit(INSERT))).otherwise(F.array("op"))))
    w2 = Window.partitionBy(*keys).orderBy("pos", F.col("op") == INSERT)
    still = F.col("op") == KEEP
    run = F.sum(F.when(F.lag(still).over(w2).eqNullSafe(still), 0).otherwise(1)).over(
        w2.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    regrouped = doubled.withColumn("run", run)
    return regrouped.withColumn("pos", F.row_number().over(
        Window.partitionBy(*keys).orderBy("run", F.col("op") == INSERT, "pos")) - 1).select(
        *keys, "pos", "run", "op", "a", "b", *carry)


def mark_words(pairs: DataFrame, keys: Sequence[str], a: str = "old_text", b: str = "new_text",
               island: int = V.ISLAND, tokens=X.words_of) -> DataFrame:
    """Runs of each pair of texts: same, removed or added words (or code, by ``X.code_tokens_of``), with the whitespace at their ends moved outside.

    Kept words take the new spelling of the whitespace after them. The removal of a replacement loses its trailing
    whitespace, so its mark abuts the addition's.
    """
    found = pairs.select(*keys, SQ.runs_of_words(tokens(a), tokens(b), island).alias("_f"))
    names = F.array(F.lit("same"), F.lit("removed"), F.lit("added"))
    runs = F.transform("_f.change", lambda c, k: F.struct(
        (k + 1).cast("bigint").alias("run"), F.get(names, c).alias("change"), F.get("_f.text", k).alias("text"),
        ((c == 1) & F.coalesce(F.get("_f.change", k + 1) == 2, F.lit(False))).alias("replaced")))
    return settle_whitespace(found.select(*keys, F.explode(runs).alias("_r")).select(*keys, "_r.*"), keys)


def settle_whitespace(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, run, change, lead, text, trail): marks hold no whitespace at their ends. ``replaced``: an addition follows."""
    blank = "[ \\t\\r\\n]"
    changed = F.col("change") != "same"
    lead = F.when(changed, F.regexp_extract("text", f"^({blank}*)", 1)).otherwise("")
    rest = F.when(changed, F.regexp_replace("text", f"^{blank}+", "")).otherwise(F.col("text"))
    return (runs.withColumn("lead", lead).withColumn("_rest", rest)
            .withColumn("trail", F.when(changed & ~F.col("replaced"), F.regexp_extract("_rest", f"({blank}*)$", 1)).otherwise(""))
            .withColumn("text", F.when(changed, F.regexp_replace("_rest", f"{blank}+$", "")).otherwise(F.col("text")))
            .select(*keys, "run", "change", "lead", "text", "trail"))


def restore(runs: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """The text of one revision read back from its runs: strip what the other revision alone has."""
    dropped = "added" if side == "old" else "removed"
    body = F.when(F.col("change") == dropped, "").otherwise(F.col("text"))
    piece = F.concat("lead", body, "trail")
    return runs.groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("run", piece.alias("p")))), lambda s: s["p"]), "").alias("text"))


# --- lines as nodes --------------------------------------------------------------------------------------------

def line_status(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines paired k-th with k-th of the same text: same, removed or added. Counts only; order is not looked at."""
    def numbered(df, name):
        nth = F.row_number().over(Window.partitionBy(*keys, "text").orderBy("line_no"))
        return df.select(*keys, "text", nth.alias("_n"), F.col("line_no").alias(name))
    both = numbered(old, "i").join(numbered(new, "j"), [*keys, "text", "_n"], "full")
    status = F.when(F.col("i").isNull(), "added").when(F.col("j").isNull(), "removed").otherwise("same")
    return both.select(*keys, "i", "j", "text", status.alias("status"))


def _scripts(whole: DataFrame, same: Column, core) -> DataFrame:
    """Add the script of ``_old`` and ``_new``: plain where a side is empty or where ``same`` holds, else by the core.

    ``core`` takes two functions: what it wraps of a side, so that a settled row hands the core NULLs.
    """
    plain = (F.when(F.size("_old") == 0, _one_sided(F.col("_new"), INSERT)).when(F.size("_new") == 0, _one_sided(F.col("_old"), DELETE))
             .when(same, _kept_all(F.col("_old"))))
    settled = whole.withColumn("_plain", plain)
    open_only = lambda column: F.when(F.col("_plain").isNull(), column)
    return settled.withColumn("script", F.coalesce("_plain", core(open_only))).drop("_plain")


def diff_nodes(old: DataFrame, new: DataFrame, keys: Sequence[str], threshold: float = V.PAIRING_THRESHOLD) -> DataFrame:
    """(keys, pos, change, i, j, old_text, new_text): same, edited, removed and added nodes in reading order.

    Nodes pair by exact text, k-th with k-th, then by similar wording, first come first served; pairs out of order
    are a removal and an addition. Both revisions of a document are one row, and what differs of it is paired and
    scripted there. A revision missing on one side is an empty one.
    """
    whole = PR.listed(PR.two_sides(old, new, keys, "line_no"), keys, ["text"]).select(
        *keys, PR.texts_of("_old").alias("_old"), PR.texts_of("_new").alias("_new"))
    whole = _scripts(whole, F.col("_old") == F.col("_new"), lambda some: PP.script_of_nodes(
        some(F.col("_old")), some(F.col("_new")), threshold))
    spelled = F.transform("script", lambda s: F.struct(
        s["op"].alias("op"), F.when(s["op"] != INSERT, s["a"] + 1).cast("bigint").alias("i"),
        F.when(s["op"] != DELETE, s["b"] + 1).cast("bigint").alias("j"),
        F.when(s["op"] != INSERT, F.get("_old", s["a"])).alias("old_text"),
        F.when(s["op"] != DELETE, F.get("_new", s["b"])).alias("new_text")))
    change = (F.when(F.col("op") == DELETE, "removed").when(F.col("op") == INSERT, "added")
              .when(F.col("old_text") == F.col("new_text"), "same").otherwise("edited"))
    return whole.select(*keys, F.posexplode(spelled).alias("pos", "_s")).select(*keys, "pos", "_s.*").select(
        *keys, "pos", change.alias("change"), "i", "j", "old_text", "new_text")


def changed_beneath(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every node with a change on it or beneath it. ``nodes``: keys, node_id, ancestors, change."""
    own = F.concat(F.array("node_id"), F.col("ancestors"))
    marked = nodes.filter("change <> 'same'").select(*keys, F.explode(own).alias("node_id")).distinct()
    return nodes.join(marked.withColumn("_c", F.lit(True)), [*keys, "node_id"], "left").withColumn(
        "changed", F.coalesce("_c", F.lit(False))).drop("_c")


def refuse_marked(nodes: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Split documents into those without any mark, which may be diffed, and the keys of the others."""
    marked = nodes.filter("change <> 'same'").select(*keys).distinct()
    return nodes.join(marked, list(keys), "left_anti"), marked


def all_marked(nodes: DataFrame, change: str) -> DataFrame:
    """Mark whole documents: the mark stands on top-level nodes alone and covers what is beneath."""
    return nodes.withColumn("change", F.when(F.size("ancestors") == 0, change).otherwise("same"))


def apply_context(nodes: DataFrame, keys: Sequence[str], context: str) -> DataFrame:
    """What a reader is shown: ``all``; ``changed`` top-level nodes with a change; ``items`` also elides inside them;
    ``decls`` elides unchanged descriptions too.

    ``nodes``: keys, node_id, parent, ancestors, is_heading, change, described, description_changed.
    """
    from palimpsest.operators.sequences import elide_unchanged
    seen = changed_beneath(nodes, keys)
    if context == "all":
        return seen.withColumn("action", F.lit("shown"))
    top = F.when(F.size("ancestors") == 0, F.col("node_id")).otherwise(F.get("ancestors", 0))
    kept = seen.filter("changed").filter(F.size("ancestors") == 0).select(*keys, F.col("node_id").alias("_top"))
    inside = seen.withColumn("_top", top).join(kept, [*keys, "_top"], "left_semi").drop("_top")
    if context == "changed":
        return inside.withColumn("action", F.lit("shown"))
    whole = inside.withColumn("ord", F.col("node_id"))
    elided = elide_unchanged(whole, keys).withColumn("action", F.when(
        F.col("action") == "elided", "elided").otherwise("shown")).drop("ord")
    if context == "decls":
        elided = elided.withColumn("action", F.when(
            (F.col("action") == "shown") & F.col("described") & ~F.col("description_changed") & (F.col("change") == "same"),
            "description_elided").otherwise(F.col("action")))
    return elided


# --- elements, lists, code --------------------------------------------------------------------------------------

def diff_elements(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The k-th element of a kind with the k-th of that kind. Both sides: keys, kind, ord, text."""
    def numbered(df, side):
        nth = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("ord"))
        return df.select(*keys, "kind", nth.alias("nth"), F.col("ord").alias(f"{side}_ord"), F.col("text").alias(f"{side}_text"))
    both = numbered(old, "old").join(numbered(new, "new"), [*keys, "kind", "nth"], "full")
    change = (F.when(F.col("old_ord").isNull(), "added").when(F.col("new_ord").isNull(), "removed")
              .when(F.col("old_text") == F.col("new_text"), "same").otherwise("edited"))
    return both.withColumn("change", change)


def diff_alike(old: DataFrame, new: DataFrame, keys: Sequence[str], threshold: float = V.PAIRING_THRESHOLD,
               lone_pair: bool = False, agree: Sequence[str] = ()) -> DataFrame:
    """Script of two lists whose elements match when their words are alike: list items, rows, signatures, blocks.

    Both sides: keys, ord from 1, text and the ``agree`` columns, which must be equal for two elements to match. With
    ``lone_pair``, a single element on each side matches whatever its words.
    """
    whole = PR.listed(PR.two_sides(old, new, keys, "ord", agree), keys, [*agree, "text"])
    kinds = [PR.kinds_of(side, agree) for side in ("_old", "_new")]
    lone = F.lit(lone_pair) & (F.size("_old") == 1) & (F.size("_new") == 1) & (kinds[0] == kinds[1])
    scripted = _scripts(whole, lone, lambda some: PP.script_of_alike(
        some(PR.texts_of("_old")), some(PR.texts_of("_new")), *map(some, kinds), threshold))
    return edits(scripted, keys)


def diff_code(df: DataFrame, keys: Sequence[str], a: str = "old_text", b: str = "new_text",
              threshold: float = V.PAIRING_THRESHOLD) -> DataFrame:
    """Lines of two listings: kept, merged (diffed by token), rewrapped (one run of tokens), removed, added.

    Inside a change the k-th removed line meets the k-th added one and the two are merged when they read alike. A
    change with different line counts that reads nearly the same as a whole is the same code laid out anew.
    """
    # A listing with no line left is the empty text.
    of = lambda side: F.when(F.col(side) == "", F.array().cast("array<string>")).otherwise(X.lines_of(side))
    lines = df.select(*keys, of(a).alias("_a"), of(b).alias("_b"))
    scripted = with_scripts(lines, "_a", "_b")
    spelled = F.transform("script", lambda s: F.struct(
        s["op"].alias("op"), s["a"].alias("a"), s["b"].alias("b"),
        F.when(s["op"] == INSERT, F.get("_b", s["b"])).otherwise(F.get("_a", s["a"])).alias("text")))
    steps = scripted.select(*keys, F.posexplode(spelled).alias("pos", "_s")).select(*keys, "pos", "_s.*")
    w = Window.partitionBy(*keys).orderBy("pos")
    kept = F.col("op") == KEEP
    runs = steps.withColumn("run", F.sum(F.when(F.lag(kept).over(w).eqNullSafe(kept), 0).otherwise(1)).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = runs.groupBy(*keys, "run").agg(
        F.first(kept).alias("_kept"), F.array_sort(F.collect_list(F.struct("pos", "op", "a", "b", "text"))).alias("_s"))
    whole = whole.withColumns({"_d": F.filter("_s", lambda s: s["op"] == DELETE), "_i": F.filter("_s", lambda s: s["op"] == INSERT)})
    words = lambda side: F.filter(F.array_distinct(F.flatten(F.transform(
        side, lambda s: X.code_token_set(s["text"])))), lambda t: t != "")
    rewrapped = ((F.size("_d") > 0) & (F.size("_i") > 0) & (F.size("_d") != F.size("_i"))
                 & (X.jaccard(words("_d"), words("_i")) >= max(threshold, V.REWRAP_THRESHOLD)))

    def row(action, i, j):
        none = F.lit(None).cast("int")
        return F.struct(F.lit(action).alias("action"), (none if i is None else i["a"]).alias("i"), (none if j is None else j["b"]).alias("j"))

    def meet(k):
        d, i = F.get("_d", k - 1), F.get("_i", k - 1)
        alike = X.jaccard(X.code_token_set(d["text"]), X.code_token_set(i["text"])) >= threshold
        return (F.when(F.col("_w"), F.array(row("rewrapped", d, i)))
                .when(d.isNotNull() & i.isNotNull() & alike, F.array(row("merged", d, i)))
                .otherwise(F.array_compact(F.array(F.when(d.isNotNull(), row("removed", d, None)),
                                                   F.when(i.isNotNull(), row("added", None, i))))))

    steps = F.sequence(F.lit(1), F.greatest(F.size("_d"), F.size("_i"), F.lit(1)))
    actions = F.when(F.col("_kept"), F.transform("_s", lambda s: row("kept", s, s))).otherwise(F.flatten(F.transform(steps, meet)))
    return whole.withColumn("_w", rewrapped).select(*keys, "run", F.explode(actions).alias("_r")).select(*keys, "run", "_r.*")


# --- overlay ----------------------------------------------------------------------------------------------------

def inherit_descriptions(own: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overlay an item's own elements on its baseline's first element of each kind; the rest is inherited.

    Both sides: keys, kind, ord, text; ``own`` also has ``derived``. The last authored element of a kind takes the
    place. A derived one replaces nothing that is there: it stays beside the text as evidence, and an authored
    element that comes after it takes its place whole.
    """
    authored = F.when(~F.col("derived"), F.col("ord"))
    derived = F.when(F.col("derived"), F.col("ord"))
    mine = own.groupBy(*keys, "kind").agg(
        F.max_by("text", authored).alias("_a"), F.max(authored).alias("_ao"), F.max_by("text", derived).alias("_dl"),
        F.max(derived).alias("_do"), F.min_by("text", derived).alias("_df"), F.count(derived).alias("_dn"),
        F.lit(1).alias("nth"))
    nth = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("ord"))
    theirs = base.select(*keys, "kind", nth.alias("nth"), F.col("text").alias("_b"))
    both = mine.join(theirs, [*keys, "kind", "nth"], "full")
    has_a, has_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    evidence = (F.when(has_a, F.when(F.col("_do") > F.col("_ao"), F.col("_dl"))).when(has_b, F.col("_dl"))
                .when(F.col("_dn") > 1, F.col("_dl")))
    origin = F.when(has_a & has_b, "replaced").when(has_b, "inherited").otherwise("own")
    return both.select(*keys, "kind", "nth", F.coalesce("_a", "_b", "_df").alias("text"), evidence.alias("evidence"),
                       origin.alias("origin"))


def uncovered_claims(covers: DataFrame, resolved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Claims that name an element their item has in neither revision. ``covers``: keys, kind."""
    return covers.join(resolved.select(*keys, "kind").distinct(), [*keys, "kind"], "left_anti").select(
        *keys, F.lit("error").alias("severity"), X.template(V.COVERS_MISSING, F.col("kind")).alias("message"))
