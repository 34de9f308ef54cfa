import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from tessera.llm import repair

KIND = "conv_id long, turn long, role string, text string, i int, seg string"
WS = " \t\n\x0b\x0c\r"


def harmed(rows):
    """Rows of one conversation after damage, in order."""
    said = lambda x: " " if x is None else str(x)
    out = []
    for conv, turn, role, text in rows:
        harm = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        out += [(turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        out.append("blank" if not text.strip(WS) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(WS)[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, audit, repaired lines) by a table of the best way to each (row, initials so far): no grammar states, no bound on inserts but the length."""
    legal = re.compile("(s?(ua)+)?")
    best = None
    n = len(rows)
    # all edit strings by depth-first search with pruning on cost
    stack = [(0, 0, "", "", ())]
    top = 2 * n + 8
    while stack:
        i, cost, audit, ini, lines = stack.pop()
        if best and cost > best[0] or cost > top:
            continue
        if i == n and legal.fullmatch(ini):
            best = min(best or (cost, audit, lines), (cost, audit, lines))
        if len(ini) <= n + 2:
            for role in ("user", "assistant"):
                if not re.fullmatch("(s?(ua)*u?)?", ini + role[0]):
                    continue
                stack.append((i, cost + 2, audit + "I", ini + role[0], (*lines, f"{role}:")))
                if i < n and marks[i] not in ("blank", "duplicate"):
                    stack.append((i + 1, cost + 2 + (marks[i] == "truncated"), audit + "R", ini + role[0], (*lines, f"{role}:{rows[i][2]}")))
        if i < n:
            stack.append((i + 1, cost + 3, audit + "D", ini, lines))
            if marks[i] not in ("blank", "duplicate") and rows[i][1][:1] in ("s", "u", "a") and re.fullmatch("(s?(ua)*u?)?", ini + rows[i][1][0]):
                stack.append((i + 1, cost + (marks[i] == "truncated"), audit + "K", ini + rows[i][1][0], (*lines, f"{rows[i][1]}:{rows[i][2]}")))
    return best


def stepped(rows, marks):
    """The same by dynamic programming over initials' states in plain Python, for long ones."""
    start, order = {"": (0, "", ())}, {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def put(to, state, way):
        if state not in to or way[:2] < to[state][:2]:
            to[state] = way

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for s, (c, a, ls) in list(out.items()):
                for role in ("user", "assistant"):
                    if (s, role[0]) in order:
                        put(out, order[s, role[0]], (c + 2, a + "I", (ls, f"{role}:")))
        return out

    for (_, role, text), mark in zip(rows, marks):
        to = {}
        for s, (c, a, ls) in inserted(start).items():
            put(to, s, (c + 3, a + "D", ls))
            if mark in ("blank", "duplicate"):
                continue
            more = mark == "truncated"
            if (s, role[:1]) in order:
                put(to, order[s, role[:1]], (c + more, a + "K", (ls, f"{role}:{text}")))
            for r in ("user", "assistant"):
                if (s, r[0]) in order:
                    put(to, order[s, r[0]], (c + 2 + more, a + "R", (ls, f"{r}:{text}")))
        start = to
    cost, audit, ls = min(w for s, w in inserted(start).items() if s in ("", "a"))
    lines = []
    while ls:
        ls, line = ls
        lines.append(line)
    return cost, audit, tuple(lines[::-1])


def want(rows, solve):
    out = {}
    for conv in {r[0] for r in rows}:
        own = harmed([r for r in rows if r[0] == conv])
        if not own:
            out[conv] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
            continue
        marks = faults(own)
        turns = {t for t, _, _ in own if t is not None}
        ini = [r[:1] for _, r, _ in own]
        cost, audit, lines = solve(own, marks)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def run(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 1, "x") for r in rows], KIND).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = repair.op11_repair(spark, str(tmp_path)).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: tuple(r[c] for c in names) for r in got}


def drawn(seed, n, most, ids=None):
    draw = np.random.default_rng(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None], ["a.", "b!", "c", " ", None, "d?\n", "e. f", "é."]
    out = []
    for k in range(n):
        for t in range(int(draw.integers(1, most + 1))):
            turn = None if draw.random() < 0.1 else int(draw.integers(0, most)) if draw.random() < 0.2 else t
            out.append(((ids or range(n))[k], turn, roles[draw.integers(0, 8)], texts[draw.integers(0, 8)] if draw.random() < 0.6 else f"text {t}."))
    return out


def test_the_state_table_against_all_edits():
    for (rows,) in itertools.islice(((harmed(list(g)),) for _, g in itertools.groupby(drawn(1, 60, 4), key=lambda r: r[0])), 60):
        assert stepped(rows, faults(rows)) == cheapest(rows, faults(rows))


def test_short_conversations(spark, tmp_path):
    rows = drawn(2, 150, 9, [None, *range(149)])
    assert run(spark, tmp_path, rows) == want(rows, stepped)


@pytest.mark.parametrize("segment", [3, 7])
def test_long_ones_are_cut(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    monkeypatch.setattr(repair.repair, "__defaults__", (segment,))
    monkeypatch.setattr(repair, "ROWS", 10)
    rows = drawn(3, 6, 60, [None, 1, 2, 3, 4, 5]) + drawn(4, 20, 6, list(range(10, 30))) + [(1, 5, "user", "again and again.")] * 40 + [(40, 1, None, None)] * 9
    assert run(spark, tmp_path, rows) == want(rows, stepped)


def test_one_conversation_holds_most_rows(spark, tmp_path):
    rows = [(7, t // 2, ("user", "assistant", "user", "x")[t % 4], f"turn {t}" + ".!?  "[t % 5] * (1 if t % 7 else 0)) for t in range(1500)] + drawn(5, 30, 8, list(range(100, 130)))
    assert run(spark, tmp_path, rows) == want(rows, stepped)


def test_odd_rows(spark, tmp_path):
    long = "word " * 300_000
    rows = [(1, 0, "user", long + "."), (1, 1, "assistant", long), (2, None, "user", "x."), (2, None, "assistant", "x."), (3, 0, "system", "s.")]
    assert run(spark, tmp_path, rows) == want(rows, cheapest)
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert run(spark, tmp_path, [(gone, 0, "user", "x.")]) == want([(gone, 0, "user", "x.")], cheapest)
    assert run(spark, tmp_path, []) == {}
