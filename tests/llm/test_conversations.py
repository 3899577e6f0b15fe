"""Conversation repair against a plain forward search; chunks of any size; slow convergence; odd rows."""

import hashlib
import random
import zlib

import pytest

from palimpsest.llm import conversations as C
from palimpsest.llm import queries

SPACE = " \t\n\v\f\r"


def plain(rows):
    """The contract in plain Python: every way through the four states, the least (cost, audit) of each."""
    conversations = {}
    for conv, turn, role, text in rows:
        kept = conversations.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        kept += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv, kept in conversations.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(f"{r[1]}\0{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in kept:
            said = text.strip(SPACE)
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else
                          "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))

        def insert(best):
            for _ in range(2):
                for state, (cost, audit, lines) in list(best.items()):
                    new, role = (3, "assistant") if state == 2 else (2, "user")
                    way = (cost + 5, audit + "I", [*lines, f"{role}:"])
                    best[new] = min(best.get(new, way), way)
            return best
        best = {0: (0, "", [])}
        for (_, role, text), fault in zip(kept, faults):
            ways = {}
            for state, (cost, audit, lines) in insert(best).items():
                steps = [(state, 2, "D", [])]
                late = 5 * (fault == "truncated")
                if fault not in ("blank", "duplicate"):
                    new, named = (3, "assistant") if state == 2 else (2, "user")
                    steps.append((new, 1 + late, "R", [f"{named}:{text}"]))
                    first = role[:1]
                    if (first == "s" and state == 0) or (first == "u" and state != 2) or (first == "a" and state == 2):
                        steps.append(({"s": 1, "u": 2, "a": 3}[first], late, "K", [f"{role}:{text}"]))
                for new, more, letter, line in steps:
                    way = (cost + more, audit + letter, lines + line)
                    ways[new] = min(ways.get(new, way), way)
            best = ways
        cost, audit, lines = min(way for state, way in insert(best).items() if state in (0, 3))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in (
            "blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def spark_rows(spark, rows, **limits):
    given = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS id", "2 AS part")
    got = C.repair(C.damage(given), **limits).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r[0]: tuple(r)[1:] for r in got}


def some_rows(dice, conversations=25, longest=14):
    roles = ["user", "assistant", "system", "tool", None, "", "sys", "agent"]
    texts = ["Yes.", "No", "Why?", "", " ", None, "ok! ", "...", "so", "öh.", "1", "2.", "3", "a b\n"]
    rows = []
    for conv in [*range(conversations), None]:
        for turn in range(dice.randrange(longest)):
            turn = None if dice.random() < 0.05 else turn + dice.choice([0, 0, 0, 1, 7])
            rows.append((conv, turn, dice.choice(roles[:2] * 4 + roles), dice.choice(texts) if dice.random() < 0.6 else f"t {turn}."))
    return rows


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_equals_a_plain_search(spark, chunk):
    rows = some_rows(random.Random(chunk))
    rows += rows[:5]
    assert spark_rows(spark, rows, chunk=chunk) == plain(rows)


def test_long_conversation_in_chunks(spark, monkeypatch):
    """Most turns share one conversation; in another all turns are cut off, so vectors do not converge."""
    dice = random.Random(5)
    roles = ["user", "assistant", "user", "assistant", "tool"]
    rows = [(1, t, dice.choice(roles), f"{dice.randrange(200)} {dice.choice(['end.', 'end', 'why?'])}") for t in range(500)]
    rows += [(2, t, dice.choice(roles), f"cut {t}") for t in range(300)] + [(2, 300, "assistant", "Done.")]
    rows += [(3, t, "user", "same.") for t in range(100)]
    monkeypatch.setattr(C, "PLAIN_PASSES", 1)
    monkeypatch.setattr(C, "WIDEN", 4)
    assert spark_rows(spark, rows, chunk=16) == plain(rows)
    assert spark_rows(spark, rows, limit=100) == plain(rows)


def test_parallel_vectors_stop_a_rerun():
    dice = random.Random(1)
    codes = bytes(dice.choice([0, 1, 2, 3, 4, 5, 6, 255]) for _ in range(2000))
    for end in [(0, 10, 5, 0), (0, 0, 0, 0), (3, 5, 0, 5)]:
        fresh = C.backward(codes, bytes(end))
        known, _ = C.backward(codes, bytes(C.END))
        assert C.backward(codes, bytes(end), known) == fresh
        assert fresh[0][:4 * 1500] == known[:4 * 1500]  # far from the end the speculation was right


def test_odd_tables(spark, tmp_path):
    assert spark_rows(spark, []) == {}
    dropped = next(t for t in range(99) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    rows = [(7, dropped, "user", "Hi."), (8, None, None, None), (None, None, "assistant", "x" * 100000 + ".")]
    got = spark_rows(spark, rows)
    assert got == plain(rows) and got[7] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    assert queries.QUERIES["op13_conversations"](spark, str(tmp_path)).count() == 3
