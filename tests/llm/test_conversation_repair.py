"""Structure repair against an enumeration of all edits, across chunk borders, and on nulls, ties, hot and empty conversations."""

import hashlib
import random
import re
import zlib

import pytest

from palimp.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, c string, part int, cost long"


def faults(rows):
    """Rows (turn, role, text) in order to their faults."""
    seen, out = set(), []
    for _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "none")
        seen.add((role, text))
    return out


def enumerated(rows):
    """(cost, audit, lines): the best of all edits that keep to the pattern and cost no more than deleting every row."""
    n, best, fault = len(rows), [], faults(rows)

    def legal(lines):
        return re.fullmatch("s?(ua)*u?", "".join(role[:1] or "-" for role, _ in lines))

    def go(i, cost, audit, lines):
        if cost > 4 * n or not legal(lines):
            return
        if i == n and re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in lines)):
            best.append((cost, audit, [f"{role}:{text}" for role, text in lines]))
        for role in ("user", "assistant"):
            go(i, cost + 3, audit + "I", lines + [(role, "")])
        if i == n:
            return
        _, role, text = rows[i]
        go(i + 1, cost + 4, audit + "D", lines)
        if fault[i] not in ("blank", "duplicate"):
            late = 3 if fault[i] == "truncated" else 0
            go(i + 1, cost + late, audit + "K", lines + [(role, text)])
            for to in ("user", "assistant"):
                go(i + 1, cost + 3 + late, audit + "R", lines + [(to, text)])

    go(0, 0, "", [])
    return min(best)


def placed(rows):
    said = lambda r: hashlib.sha256((hashlib.sha256(r[1].encode()).hexdigest() + r[2]).encode()).hexdigest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, said(r)))


def expected(messages):
    out, convs = {}, {}
    for conv, *row in messages:
        convs.setdefault(conv, []).append(tuple(row))
    for conv, rows in convs.items():
        rows = placed(rows)
        f, initials = faults(rows), [r[1][:1] for r in rows]
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit, lines = enumerated(rows)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count("blank"), f.count("duplicate"), f.count("truncated"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(n, longest):
    random.seed(11)
    rows = []
    for conv in range(n):
        for turn in range(random.randint(1, longest)):
            role = random.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "aide"])
            text = random.choice(["Yes.", "Yes.", "no", "", " \t", "What?\n", "ends, so", f"t{turn}!", "é. ", "x" * 9])
            rows.append((conv, random.choice([turn * 2, turn, None]), role, text))
    return rows


def found(spark, messages):
    df = spark.createDataFrame([(*m, "c", 1, 2) for m in messages], SCHEMA)
    return {r.conv_id: tuple(r)[1:] for r in repair.repaired(df).collect()}


@pytest.mark.parametrize("rows_per_chunk", [16, 1, 2])
def test_repair_equals_enumeration(spark, monkeypatch, rows_per_chunk):
    monkeypatch.setattr(repair, "CHUNK_ROWS", rows_per_chunk)
    messages = conversations(24, 3) + [(None, 0, "user", "Hi."), (None, 1, "user", "Hi.")]
    assert found(spark, messages) == expected(messages)


def test_search_keeps_to_the_bound_of_long_conversations(spark):
    """A conversation of one role, and one of a row repeated often, in many chunks: the cost is known by count."""
    rows = [(1, i, "user", f"Line {i}.") for i in range(3000)] + [(2, 5, "user", "Same.")] * 2000 + [(3, i, "system", "go") for i in range(500)]
    got = found(spark, rows)
    assert got[1][5] == 4500 and got[1][6] == "KR" * 1500
    assert got[2][1:6] == (0, 1999, 0, 1999, 4 * 1999 + 3) and got[2][6] == "K" + "D" * 1999 + "I"
    assert got[3][1:6] == (0, 499, 1, 499, 4 * 500) and got[3][7] == hashlib.sha256(b"").hexdigest()


def test_damage_and_report(spark):
    table = [(c, t, r, x) for c in range(30) for t, r, x in [(0, "system", "Be brief."), (1, "user", None), (2, None, "A.b!"), (None, "assistant", "Ok?")]] + [(None, None, None, None)]
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in table], SCHEMA)
    want = []
    for conv, turn, role, text in table:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        want += [] if h == 0 else [(conv, turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)] * (2 if h == 3 else 1)
    messages = repair.damaged(df)
    assert sorted(map(tuple, messages.collect()), key=str) == sorted(want, key=str)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {r.conv_id: tuple(r)[1:] for r in repair.repair_report(df, messages).collect()} == {c: nothing for c, *_ in table} | expected(want)
    gone = repair.repair_report(df, messages.limit(0)).collect()
    assert {tuple(r)[1:] for r in gone} == {nothing} and len(gone) == 31
    assert repair.repair_report(df.limit(0), messages.limit(0)).count() == 0
