"""Conversation repair against a plain dynamic program and full enumeration."""
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from storeflow.llm import conversations as C
from storeflow.llm.stages import table

from .conftest import DATA

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n int, d string, piece int"
EDGES = {"": "su", "s": "u", "u": "a", "a": "u"}


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(c, t, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """(cost, audit, repaired rows) by a forward dynamic program over strings."""
    best = {"": (0, "", ())}

    def insert(best):
        for _ in range(2):
            for s, (cost, audit, made) in list(best.items()):
                role = "user" if s != "u" else "assistant"
                new = (cost + 5, audit + "I", made + (f"{role}:",))
                best[role[0]] = min(best.get(role[0], new), new)
        return best
    for (role, text), f in zip(rows, fault):
        now = {}

        def put(s, cost, audit, made):
            now[s] = min(now.get(s, (cost, audit, made)), (cost, audit, made))
        for s, (cost, audit, made) in insert(best).items():
            put(s, cost + 2, audit + "D", made)
            if f not in ("blank", "duplicate"):
                extra = 5 if f == "truncated" else 0
                if role[:1] and role[:1] in EDGES[s]:
                    put(role[0], cost + extra, audit + "K", made + (f"{role}:{text}",))
                to = "assistant" if s == "u" else "user"
                put(to[0], cost + extra + 1, audit + "R", made + (f"{to}:{text}",))
        best = now
    return min(x for s, x in insert(best).items() if s in ("", "a"))


def enumerated(rows, fault):
    """The same by trying all edits, with up to two inserts at every place."""
    best = None
    places = list(itertools.chain.from_iterable((None, r) for r in zip(rows, fault))) + [None]
    options = [["", "u", "a", "ua", "au"] if p is None else (["D"] if p[1] in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"]) for p in places]
    for edit in itertools.product(*options):
        made, audit, cost = [], "", 0
        for p, e in zip(places, edit):
            if p is None:
                made += [({"u": "user", "a": "assistant"}[x], "") for x in e]
                audit, cost = audit + "I" * len(e), cost + 5 * len(e)
            else:
                (role, text), f = p
                audit += e[0]
                cost += {"D": 2, "K": 0, "R": 1}[e[0]] + (5 if f == "truncated" and e != "D" else 0)
                if e != "D":
                    made.append((role if e == "K" else {"u": "user", "a": "assistant"}[e[1]], text))
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in made)) and all(r for r, _ in made):
            best = min(best or (cost, audit), (cost, audit))
    return best


def brute(rows):
    out = []
    damaged = damage(rows)
    for c in {r[0] for r in rows}:
        mine = [(t is not None, t or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text) for k, t, role, text in damaged if k == c]
        mine.sort()
        turns = {t for some, t, *_ in mine if some}
        told = [(role, text) for *_, role, _, text in mine]
        fault = faults(told)
        cost, audit, made = cheapest(told, fault)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((c, gaps, *(fault.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df, rows=None):
    return sorted((tuple(r) for r in C.audited(df, C.damaged(df)).collect()), key=str)


def random_rows(rng, convs, most):
    rows = []
    for c in convs:
        for t in range(rng.randrange(most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "No!", "Why?", "and then", " \n", "", None, f"Turn {t}.", f"turn {t}", "Yes. \t"])
            rows.append((c, rng.choice([t, t, t, t + 1, None, 3 * t]), role, text))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame([(*r, 7, "d", 1) for r in rows], SCHEMA)


def test_plain_program_against_enumeration():
    rng = random.Random(1)
    for _ in range(150):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "no", " ", "Ah!"])) for _ in range(rng.randrange(4))]
        assert cheapest(rows, faults(rows))[:2] == enumerated(rows, faults(rows))


@pytest.mark.parametrize("bits", [16, 2, 0])
def test_random(frame, monkeypatch, bits):
    monkeypatch.setattr(C, "PIECE_BITS", bits)
    rng = random.Random(bits)
    rows = random_rows(rng, [*range(60), None], 9) + random_rows(rng, [100, 101], 120)
    assert got(frame(rows)) == brute(rows)


def test_table(spark):
    df = table(spark, DATA, "conversations")
    assert got(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_empty_and_extreme(frame):
    assert got(frame([(1, 1, "user", "a.")]).limit(0)) == []
    dropped = next(t for t in range(99) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = [(5, dropped, "user", "Hello."), (6, -(1 << 62), "user", "word " * 200000 + "."), (6, 1 << 62, "assistant", "x.")] + [(7, 3, "user", "Same.")] * 500
    assert got(frame(rows)) == [x if x[1] < 1 << 63 else (x[0], None, *x[2:]) for x in brute(rows)]
    assert (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) in got(frame(rows))


def test_repaired_rows(frame):
    rows = random_rows(random.Random(8), range(30), 8)
    df = frame(rows)
    told = {}
    for r in C.repaired(C.damaged(df)).collect():
        told.setdefault(r.conv, []).append(((r.turn is not None, r.turn or 0, r.row_role, r.d, r.place), f"{r.role}:{r.text}"))
    want = {str(x[0]): x[-1] for x in brute(rows)}
    for conv, sha in want.items():
        assert hashlib.sha256("\n".join(x for _, x in sorted(told.get(conv, []))).encode()).hexdigest() == sha


def test_ranks_follow_the_audits():
    """Random graphs forward in node order; every node's arcs have different letters."""
    rng = np.random.default_rng(2)
    for n in (1, 2, 9, 60):
        target = np.minimum(np.arange(n) + rng.integers(1, 4, (4, n)), n - 1)
        ok = rng.random((4, n)) < 0.5
        ok[:, -1] = False
        audits = [""] * n
        for k in range(n - 2, -1, -1):
            arcs = [(C.LETTERS[x], target[x, k]) for x in range(4) if ok[x, k]]
            audits[k] = min(c + audits[t] for c, t in arcs) if arcs else ""
        letter, rank, jumps, length = C.ranked_paths(ok, target)
        which, path = C.read_paths(np.arange(n), jumps, length)
        assert ["".join(C.LETTERS[x] for x in letter[path[which == k]]) for k in range(n)] == audits
        assert np.array_equal(np.argsort(np.array(audits), kind="stable"), np.argsort(rank, kind="stable"))
