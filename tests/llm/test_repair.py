"""Conversation repair against brute force: damage, faults, cheapest edits, segments."""

import hashlib
import random
import re
import zlib

import pytest

from docshield.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, code string, seg string"


def cheapest(rows):
    """(cost, letters, repaired rows) by trying all edits layer by layer; rows: (initial, fault)."""
    best = {"": (0, "")}  # what the roles' initials have come to: s, then u or a; "" at the start

    def inserted(best):
        for _ in range(3):
            for q, (c, w) in list(best.items()):
                to = "a" if q == "u" else "u"
                best[to] = min(best.get(to, (1e9, "")), (c + 5, w + "I"))
        return best

    for initial, fault in rows:
        new = {}
        for q, (c, w) in inserted(dict(best)).items():
            due, more = "a" if q == "u" else "u", 5 if fault == "truncated" else 0
            steps = [(q, 2, "D")]
            if fault not in ("blank", "duplicate"):
                steps.append((due, 1 + more, "R"))
                if initial == due or initial == "s" and q == "":
                    steps.append((initial, more, "K"))
            for to, cost, letter in steps:
                new[to] = min(new.get(to, (1e9, "")), (c + cost, w + letter))
        best = new
    return min(x for q, x in inserted(best).items() if q in ("", "a"))


def brute(rows):
    out, convs = [], {}
    for conv, turn, role, text, *_ in rows:
        own = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, codes, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, None: 0}
        for _, role, text in own:
            body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            counts[fault] += 1
            codes.append((role[:1], fault))
        turns = [t for t, _, _ in own if t is not None]
        cost, audit = cheapest(codes)
        said, k, last = [], 0, ""
        for letter in audit:
            due = "a" if last == "u" else "u"
            if letter == "D":
                k += 1
                continue
            last = "s" if letter == "K" and codes[k][0] == "s" else due
            name = {"u": "user", "a": "assistant"}.get(last)
            said.append(f"{name}:" if letter == "I" else f"{own[k][1] if letter == 'K' else name}:{own[k][2]}")
            k += letter != "I"
        assert k == len(own)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"],
                    sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:])), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=str)


def dialogues(n, seed):
    r, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(r.choice([1, 2, 3, 5, 8, 30])):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "s", None])
            text = r.choice(["Yes.", "No", "Why? ", "", " \t\n", None, "a. b", "fine!", f"row {r.randrange(9)}.", "é.\x0b", " ", "x. "])
            rows.append((conv, turn if r.random() < 0.95 else None, role, text, "c", "s"))
    return rows


@pytest.mark.parametrize("segment", [1024, 3])
def test_equals_brute_force(spark, segment):
    rows = dialogues(120, 1) + [(None, 0, "user", "Hello.", "c", "s"), (None, 1, "assistant", "Yes.", "c", "s"), (7, 2, "user", "Yes.", "c", "s"), (7, 2, "user", "Yes.", "c", "s")]
    rows += [(-1, t, ("user", "assistant")[t % 2] if t % 7 else "user", f"turn {t // 2}." if t % 5 else "cut off", "c", "s") for t in range(400)]  # a conversation over many segments and tasks
    rows += [(-2, t, "system", " ", "c", "s") for t in range(50)]
    got = repair.repaired(spark.createDataFrame(rows, SCHEMA).repartition(5), segment)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_all_rows_dropped_and_empty_table(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    got = repair.repaired(spark.createDataFrame([(1, gone, "user", "Hi.", "c", "s")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repaired(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_text(spark):
    text = "long " * 1_000_000 + "end."
    turns = [t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 > 4][:3]
    rows = [(5, t, r, text, "c", "s") for t, r in zip(turns, ("user", "assistant", "user"))]
    assert [tuple(r) for r in repair.repaired(spark.createDataFrame(rows, SCHEMA)).collect()] == brute(rows)


def test_prices_and_traces_equal_exhaustive_search():
    r = random.Random(4)
    names = ["", "truncated", "blank", "duplicate"]
    for _ in range(400):
        codes = bytes(r.choice([0, 1, 2, 2, 1, 3, 5, 6, 9, 14]) for _ in range(r.randrange(0, 40)))
        want = cheapest([("sua?"[c % 4], names[c // 4]) for c in codes])
        p = repair.prices(codes, list(repair.ENDS))
        letters, state = repair.traces(codes, p)[0]
        assert (p[0], letters + "I" * (repair.ENDS[state] // 5)) == want
        for k in range(len(codes)):  # feasible prices: no arc costs less than the prices' difference
            for q in range(4):
                assert all(p[4 * k + q] <= cost + p[4 * k + 4 + to] for _, cost, to in repair.ARCS[codes[k]][q])
