"""Conversation structure repair: cheapest edits that make roles alternate, by rank-convergence parallel Viterbi.

A conversation's turns, in order, are kept, given another role, deleted, or joined by inserted ones, so that the
initials of the roles read ``(s?(ua)+)?``. Four states say what has been read; costs to the end form a vector per turn.

Turns are range-partitioned by conversation and turn, so a conversation of any length is many chunks of ``CHUNK`` turns
and ``CHUNK_BYTES``. Every chunk first runs from a speculative vector behind it, that of a conversation's end. Fix-up
passes then give each chunk the vector of its successor and run it again, until a vector differs from the one
kept from before only by a constant: the rest of the chunk is then right. Passes end when no chunk was given a new
vector. Where vectors are slow to converge, each further pass lets one task carry them through sixteen times as many
chunks, so a pass reaches the start of any conversation soon. States are then handed forwards the same way, and each
chunk traces the least audit string along the true vectors.

Turns are ordered by turn (null first), then role, then a digest of the text. Null roles and texts count as one space.
Repeated rows are duplicates of the first. A null conversation id is a conversation of its own. An empty table gives an
empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.jaccard import written
from palimpsest.session import checkpointed

CHUNK = 4096  # turns
CHUNK_BYTES = 4 << 20
PLAIN_PASSES = 4  # fix-up passes in which each chunk is given its neighbour's value only
WIDEN = 16

ANY, AFTER_S, WANT_A, DONE = range(4)  # nothing read, "s", "...u", "...a"
END = (0, 10, 5, 0)  # cost of what must be inserted at the end
FORCED = 255  # code of a turn that must be deleted; other codes are 4 * truncated + kind of role
_OPENS = {"s": 0, "u": 1, "a": 2}
_LEGAL = {"su", "ua", "au"}
_SPACE = " \t\n\v\f\r"

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


# -- the kernel: one turn, then one chunk ----------------------------------------------------------------------------

def _inserted(state: int) -> int:
    return DONE if state == WANT_A else WANT_A


def _kept(state: int, kind: int) -> int | None:
    if kind == 0:
        return AFTER_S if state == ANY else None
    if kind == 1:
        return WANT_A if state != WANT_A else None
    return DONE if kind == 2 and state == WANT_A else None


@cache
def before(vector: tuple[int, ...], code: int) -> tuple[int, ...]:
    """Costs before a turn from those behind it."""
    late = 5 if code >= 4 else 0
    costs = []
    for state in range(4):
        kept = _kept(state, code % 4)
        costs.append(min(2 + vector[state], 1 + late + vector[_inserted(state)],
                         late + vector[kept] if kept is not None else 1 << 40))
    want, done = min(costs[2], 5 + costs[3]), min(costs[3], 5 + costs[2])
    return min(costs[0], 5 + want), min(costs[1], 5 + want), want, done


@cache
def _normal(vector: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(v - min(vector) for v in vector)


@cache
def choose(vector: tuple[int, ...], code: int, state: int) -> tuple[str, int]:
    """The least letters on a cheapest way past a turn, and the state behind it."""
    costs, late, letters = before(vector, code), 5 if code >= 4 else 0, ""
    while True:
        kept = _kept(state, code % 4)
        if 2 + vector[state] == costs[state]:
            return letters + "D", state
        if 5 + costs[_inserted(state)] == costs[state]:
            letters, state = letters + "I", _inserted(state)
        elif kept is not None and late + vector[kept] == costs[state]:
            return letters + "K", kept
        else:
            return letters + "R", _inserted(state)


def backward(codes: bytes, end: bytes, known: bytes | None = None) -> tuple[bytes, bytes]:
    """The vectors behind each turn, up to a constant, and the one before the first; four bytes each.

    ``known`` vectors, of an earlier run, stay from where the new ones equal them up to a constant.
    """
    out = bytearray(known or bytes(4 * len(codes)))
    vector = tuple(end)
    for i in range(len(codes) - 1, -1, -1):
        now = bytes(vector)
        if known is not None and known[4 * i:4 * i + 4] == now:
            vector = None
            break
        out[4 * i:4 * i + 4] = now
        if codes[i] != FORCED:
            vector = _normal(before(vector, codes[i]))
    if vector is None:
        first = tuple(out[:4])
        vector = first if codes[0] == FORCED else _normal(before(first, codes[0]))
    return bytes(out), bytes(vector)


def forward(codes: bytes, vectors: bytes, state: int) -> tuple[list[str], int]:
    """The letters spent at each turn and the state behind the last."""
    letters = []
    for i, code in enumerate(codes):
        if code == FORCED:
            letters.append("D")
        else:
            spent, state = choose(tuple(vectors[4 * i:4 * i + 4]), code, state)
            letters.append(spent)
    return letters, state


class Chunk:
    """Turns of one conversation, in order, and the faults among them. ``seen`` digests came in earlier chunks."""

    def __init__(self, turns: list, roles: list, texts: list, digests: list, seen: set):
        self.turns, self.roles, self.texts = turns, roles, texts
        self.blank = self.duplicate = self.truncated = 0
        codes = bytearray()
        held = set(seen)
        for role, text, digest in zip(roles, texts, digests):
            said = text.strip(_SPACE)
            if not said or digest in held:
                self.blank += not said
                self.duplicate += bool(said)
                codes.append(FORCED)
                continue
            held.add(digest)
            late = said[-1] not in ".!?"
            self.truncated += late
            codes.append(4 * late + _OPENS.get(role[:1], 3))
        self.codes = bytes(codes)
        self.illegal = sum(a[:1] + b[:1] not in _LEGAL for a, b in zip(roles, roles[1:]))

    def repaired(self, letters: list[str], state: int) -> tuple[list[str], int]:
        """Lines of the repaired turns, and the cost of the edits."""
        lines, cost = [], 0
        for i, spent in enumerate(letters):
            for letter in spent:
                if letter == "D":
                    cost += 2
                    continue
                cost += {"I": 5, "K": 0, "R": 1}[letter]
                if letter != "I" and self.codes[i] >= 4:
                    cost += 5
                state = _kept(state, self.codes[i] % 4) if letter == "K" else _inserted(state)
                role = self.roles[i] if letter == "K" else "user" if state == WANT_A else "assistant"
                lines.append(f"{role}:{'' if letter == 'I' else self.texts[i]}")
        return lines, cost


def closing(state: int) -> tuple[list[str], str]:
    """Lines and letters inserted at a conversation's end."""
    roles = {AFTER_S: ["user", "assistant"], WANT_A: ["assistant"]}.get(state, [])
    return [f"{role}:" for role in roles], "I" * len(roles)


class Total:
    """What the chunks of one conversation come to, taken in order."""

    def __init__(self):
        self.counts = dict.fromkeys(COUNTS, 0)
        self.first = self.last = self.role = None
        self.distinct, self.audit, self.lines, self.sha = 0, [], 0, hashlib.sha256()

    def add(self, part: dict) -> None:
        for name in COUNTS[1:]:
            self.counts[name] += part[name]
        if part["n"]:
            if self.role is not None and self.role + part["first_role"] not in _LEGAL:
                self.counts["illegal"] += 1
            self.role = part["last_role"]
        if part["first_turn"] is not None:
            self.distinct += part["distinct"] - (self.last == part["first_turn"])
            self.first = part["first_turn"] if self.first is None else self.first
            self.last = part["last_turn"]
        self.audit.append(part["audit"])
        if part["lines"]:
            self.sha.update(b"\n" * bool(self.lines) + part["body"])
            self.lines += part["lines"]

    def row(self, ident) -> dict:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return {"id": ident, **self.counts, "gaps": gaps, "audit": "".join(self.audit),
                "repaired_sha256": self.sha.hexdigest()}


def _part(chunk: Chunk, letters: list[str], state: int, after: tuple[list[str], str]) -> dict:
    lines, cost = chunk.repaired(letters, state)
    lines += after[0]
    return {"audit": "".join(letters) + after[1], "body": "\n".join(lines).encode(), "lines": len(lines),
            "cost": cost + 5 * len(after[1]), **_facts(chunk)}


def _facts(chunk: Chunk) -> dict:
    known = [t for t in chunk.turns if t is not None]
    return {"n": len(chunk.turns), "blank": chunk.blank, "duplicate": chunk.duplicate, "truncated": chunk.truncated,
            "illegal": chunk.illegal, "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None,
            "distinct": len(set(known)), "first_role": chunk.roles[0][:1] if chunk.roles else "",
            "last_role": chunk.roles[-1][:1] if chunk.roles else ""}


# -- the job ---------------------------------------------------------------------------------------------------------

def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``id``, ``turn``, ``role``, ``text`` of the rows after damage; a dropped row stays with a true ``gone``.

    A row's fate is the CRC-32 of ``id:turn`` modulo 20: 0 drops it, 1 empties its text, 2 takes out its sentence ends,
    3 repeats it, 4 gives it to the user.
    """
    def said(c):
        return F.coalesce(c.cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said(turns[conv]), F.lit(":"), said(turns[turn]))) % 20
    words = said(turns[text])
    given = turns.select(
        turns[conv].alias("id"), turns[turn].cast("bigint").alias("turn"), (fate == 0).alias("gone"),
        F.when(fate == 4, "user").otherwise(said(turns[role])).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(words, "[.!?]", "")).otherwise(words).alias("text"),
        F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return given.drop("copy")


_RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, " \
          "repaired_sha256 string"
_PIECE = "part bigint, turns array<bigint>, roles array<string>, texts array<string>, digests array<binary>"


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in schema} for r in rows], schema)


def _schema(ident: pa.DataType, **others: pa.DataType) -> pa.Schema:
    return pa.schema([("id", ident), *others.items()])


_RESULT_ARROW = {**{c: pa.int64() for c in COUNTS}, "audit": pa.string(), "repaired_sha256": pa.string()}
_PIECE_ARROW = {"part": pa.int64(), "turns": pa.list_(pa.int64()), "roles": pa.list_(pa.string()),
                "texts": pa.list_(pa.string()), "digests": pa.list_(pa.binary())}


def _grouped(batches: Iterator[pa.RecordBatch], chunk: int, limit: int) -> Iterator[tuple]:
    """(id, rows, opens, closes) of each run of one conversation, cut at ``chunk`` turns and ``limit`` bytes."""
    rows, size, ident, opens, started = [], 0, None, True, False
    for batch in batches:
        for row in batch.to_pylist():
            if started and (row["id"] != ident or len(rows) >= chunk or size >= limit):
                closes = row["id"] != ident
                yield ident, rows, opens, closes
                rows, size, opens = [], 0, closes
            ident, started = row["id"], True
            if row["gone"]:
                continue
            rows.append(row)
            size += len(row["text"])
    if started:
        yield ident, rows, opens, True


def assemble(damaged: DataFrame, chunk: int = CHUNK, limit: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of turns in order. A conversation that surely lies in one chunk is settled at once and has no part."""
    keyed = damaged.withColumn("digest", F.unhex(F.md5(F.concat_ws("\u0000", "role", "text"))))
    order = ["id", "turn", "role", "digest"]
    n = int(damaged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("place", F.spark_partition_id())
    kind = damaged.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.RecordBatch] = []

        def watched():
            for batch in batches:
                seen[:] = [batch]
                yield batch
        out, held, place, cut = [], None, 0, 0

        def emit(run_of, last):
            nonlocal cut
            name, rows, opens, closes, first = run_of
            lists = [[r[c] for r in rows] for c in ("turn", "role", "text", "digest")]
            if opens and closes and not first and not last:
                got = Chunk(*lists, set())
                letters, state = forward(got.codes, backward(got.codes, bytes(END))[0], ANY)
                total = Total()
                total.add(_part(got, letters, ANY, closing(state)))
                return total.row(name)
            cut += 1
            return {"id": name, "part": (place << 32) + cut, **dict(zip(("turns", "roles", "texts", "digests"), lists))}
        first, size = True, 0
        for name, rows, opens, closes in _grouped(watched(), chunk, limit):
            schema = _schema(seen[0].schema.field("id").type, **_RESULT_ARROW, **_PIECE_ARROW)
            place = seen[0].column("place")[0].as_py()
            if held is not None:
                out.append(emit(held, False))
                size += sum(map(len, out[-1].get("texts") or [])) + 200
                first = first and not held[3]
            held = (name, rows, opens, closes, first)
            if size > limit:
                yield _batch(out, schema)
                out, size = [], 0
        if held is not None:
            out.append(emit(held, True))
            yield _batch(out, schema)
    return laid.mapInArrow(run, f"id {kind}, {_RESULT}, {_PIECE}")


def _settle(chunks: DataFrame, given: str, gives: str, start: bytes, step: int,
            run: Callable[[dict, bytes], dict], changed: tuple[str, ...]) -> DataFrame:
    """Hand values along the chunks of each conversation until none is given another than it ran with.

    A chunk takes ``given`` from the neighbour ``step`` before it in ``no``, which holds it in ``gives``; one without a
    neighbour takes ``start``. ``run`` gives the columns ``changed`` of a chunk anew.
    """
    state, passes, columns = chunks, 0, chunks.columns
    schema = chunks.schema
    while True:
        handed = state.select("key", (F.col("no") + step).alias("no"), F.col(gives).alias("_handed"))
        joined = state.join(handed, ["key", "no"], "left").withColumn("_handed", F.coalesce("_handed", F.lit(bytearray(start))))
        stale = joined.withColumn("_stale", F.col("_handed") != F.col(given))
        if not stale.filter("_stale").limit(1).count():
            return state
        reach = WIDEN ** max(0, passes - PLAIN_PASSES)
        order = F.col("no").desc() if step == -1 else F.col("no").asc()
        laid = stale.withColumn("_group", F.expr(f"no div {reach}")).repartition("key", "_group").sortWithinPartitions("key", "_group", order)

        def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            carried, at = None, None
            for batch in batches:
                kept = batch.select(columns)
                rows = batch.to_pylist()
                for row in rows:
                    here = (row["key"], row["_group"])
                    value = carried if here == at else row["_handed"]
                    if value != row[given]:
                        row.update(run(row, value))
                        row[given] = value
                    carried, at = row[gives], here
                for name in {given, *changed}:
                    where = kept.schema.get_field_index(name)
                    kept = kept.set_column(where, name, pa.array([r[name] for r in rows], kept.schema.field(where).type))
                yield kept
        state = checkpointed(laid.mapInArrow(fix, schema))
        passes += 1


def repair(turns: DataFrame, ident: str = "conv_id", chunk: int = CHUNK, limit: int = CHUNK_BYTES) -> DataFrame:
    """Each conversation's faults, the least cost of its repair, the audit string and the digest of what is left.

    ``turns`` has ``id``, ``turn``, ``role``, ``text`` and ``gone`` as ``damage`` gives them.
    """
    kind = turns.schema["id"].dataType.simpleString()
    laid = written(assemble(turns, chunk, limit), "chunks")
    results = ["id", *COUNTS, "audit", "repaired_sha256"]
    whole = laid.filter(F.col("part").isNull()).select(*results)
    open_chunks = laid.filter(F.col("part").isNotNull()).withColumn(
        "key", F.coalesce(F.to_json(F.struct("id")), F.lit("")))

    # A turn said in an earlier chunk is a duplicate in the later ones.
    said = open_chunks.select("key", "part", F.explode(F.array_distinct("digests")).alias("digest"))
    first = said.groupBy("key", "digest").agg(F.min("part").alias("least"))
    again = said.join(first, ["key", "digest"]).filter(F.col("part") > F.col("least")).groupBy("key", "part").agg(
        F.collect_set("digest").alias("again"))
    numbers = open_chunks.select("key", "part").withColumn("no", F.row_number().over(
        Window.partitionBy("key").orderBy("part")).cast("bigint"))
    full = open_chunks.join(numbers, ["key", "part"]).join(again, ["key", "part"], "left")

    def of(row: dict) -> Chunk:
        return Chunk(row["turns"], row["roles"], row["texts"], row["digests"], set(row["again"] or ()))

    def speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [of(row).codes for row in batch.to_pylist()]
            runs = [backward(c, bytes(END)) for c in codes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("no"), pa.array(codes, pa.binary()), pa.array([bytes(END)] * len(codes), pa.binary()),
                 pa.array([v for v, _ in runs], pa.binary()), pa.array([s for _, s in runs], pa.binary())],
                ["key", "no", "codes", "end", "vectors", "start"])
    state = checkpointed(full.select("key", "no", "turns", "roles", "texts", "digests", "again").mapInArrow(
        speculate, "key string, no bigint, codes binary, end binary, vectors binary, start binary"))

    def rerun(row: dict, end: bytes) -> dict:
        vectors, start = backward(row["codes"], end, row["vectors"])
        return {"vectors": vectors, "start": start}
    state = _settle(state, "end", "start", bytes(END), -1, rerun, ("vectors", "start"))

    def trace(row: dict, entry: bytes) -> dict:
        return {"exit": bytes([forward(row["codes"], row["vectors"], entry[0])[1]])}

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            entry = [bytes([ANY if row["no"] == 1 else DONE]) for row in rows]
            leave = [trace(row, state)["exit"] for row, state in zip(rows, entry)]
            yield batch.append_column("entry", pa.array(entry, pa.binary())).append_column("exit", pa.array(leave, pa.binary()))
    states = checkpointed(state.select("key", "no", "codes", "vectors").mapInArrow(
        guess, "key string, no bigint, codes binary, vectors binary, entry binary, exit binary"))
    states = _settle(states, "entry", "exit", bytes([ANY]), 1, trace, ("exit",))

    # Chunks of a conversation meet in order and leave as one row; the digest reads them as a stream.
    last = numbers.groupBy("key").agg(F.max("no").alias("last"))
    ordered = full.join(states.select("key", "no", "vectors", "entry", "exit"), ["key", "no"]).join(last, "key")
    parts_schema = pa.schema([("key", pa.string()), ("no", pa.int64()), ("audit", pa.string()), ("body", pa.binary()), (
        "lines", pa.int64()), *((c, pa.int64()) for c in [*COUNTS[1:], "n", "first_turn", "last_turn", "distinct"]),
        ("first_role", pa.string()), ("last_role", pa.string())])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                got, entry = of(row), row["entry"][0]
                letters, exit_state = forward(got.codes, row["vectors"], entry)
                after = closing(exit_state) if row["no"] == row["last"] else ([], "")
                part = _part(got, letters, entry, after) | {"key": row["key"], "no": row["no"]}
                one = _batch([part], parts_schema)
                yield one.add_column(1, "id", batch.column("id").slice(i, 1))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, name, schema = None, None, None, None
        for batch in batches:
            schema = _schema(batch.schema.field("id").type, **_RESULT_ARROW)
            for row in batch.to_pylist():
                if row["key"] != at:
                    if total is not None:
                        yield _batch([total.row(name)], schema)
                    at, total, name = row["key"], Total(), row["id"]
                total.add(row)
        if total is not None:
            yield _batch([total.row(name)], schema)
    parts = ordered.mapInArrow(spell, f"key string, id {kind}, no bigint, audit string, body binary, lines bigint, "
                               + "".join(f"{c} bigint, " for c in COUNTS[1:])
                               + "n bigint, first_turn bigint, last_turn bigint, distinct bigint, first_role string, last_role string")
    joined = parts.repartition("key").sortWithinPartitions("key", "no").mapInArrow(combine, f"id {kind}, {_RESULT}")
    return whole.union(joined.select(*results)).withColumnRenamed("id", ident)
