import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import groupby

import pytest

from docgauge.llm import conversations as cv


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(cv.BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "none")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """By suffixes, with the rendered lines; no trie, no layers."""

    @lru_cache(None)
    def best(i, state, inserts):
        ways = [(0, "", ())] if i == len(rows) and state in "-a" else []
        put = lambda to, cost, edit, line, j, k: ways.append((cost + best(j, to, k)[0], edit + best(j, to, k)[1], line + best(j, to, k)[2])) if best(j, to, k) else None
        if inserts < 2:
            role = "assistant" if state == "u" else "user"
            put(role[0], 2, "I", (f"{role}:",), i, inserts + 1)
        if i < len(rows):
            _, _, role, text = rows[i]
            put(state, 3, "D", (), i + 1, 0)
            if found[i] in ("none", "truncated"):
                more, ok = int(found[i] == "truncated"), {"-": "su", "s": "u", "u": "a", "a": "u"}[state]
                if role[:1] and role[:1] in ok:
                    put(role[0], more, "K", (f"{role}:{text}",), i + 1, 0)
                for new in ("user", "assistant"):
                    if new[0] in ok:
                        put(new[0], 2 + more, "R", (f"{new}:{text}",), i + 1, 0)
        return min(ways, default=None)

    return best(0, "-", 0)


def mark(r):
    return hashlib.sha256(f"{'-' if r[0] is None else r[0]}:{len(r[2].encode())}:{r[2]}{r[3]}".encode()).digest()


def brute(rows, ids):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, mark(r)))
    by_conv = {k: list(g) for k, g in groupby(order, key=lambda r: r[0])}
    out = []
    for conv in {*ids, *by_conv}:
        mine = by_conv.get(conv, [])
        found = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((x[2][:1] + y[2][:1]) not in cv.LEGAL for x, y in zip(mine, mine[1:]))
        cost, audit, lines = cheapest(mine, found)
        out.append((conv, min(gaps, cv.MOST), *(found.count(f) for f in cv.FAULTS[1:]), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def made(seed, n):
    rnd = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "sys", "u"]
    texts = ["Hi.", "Hi.", "Yes!", "no", "", " \n", None, "a?", "b. \t", "c .. d", "é…", "long. " * 4000, "　", "x\x1f"]
    rows = [(rnd.choice([None, 1, 2, -3, k // 6, k // 6]), rnd.choice([None, k % 7, k % 7, k % 7, 9, 2**63 - 1, -(2**63)] if k % 5 == 0 else [k % 7]), rnd.choice(roles), rnd.choice(texts)) for k in range(n)]
    return rows + rows[: n // 10]


key = lambda r: tuple((x is None, x) for x in r)


@pytest.mark.parametrize(("seed", "n", "segment"), [(1, 0, 9), (2, 400, 9), (3, 400, 1), (4, 300, 2)])
def test_repair_against_brute_force(spark, monkeypatch, seed, n, segment):
    monkeypatch.setattr(cv, "SEGMENT", segment)
    rows = made(seed, n)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, mark string, n long").repartition(5)
    monkeypatch.setattr(cv, "read", lambda *_: table)
    got = cv.op11_conversation_repair(spark, "")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(damage(rows), {r[0] for r in rows}), key=key)


def test_rows_all_dropped_and_undamaged_repair(spark):
    rows = [(7, 0, "user", "a?"), (7, 1, "assistant", "b."), (8, 0, "assistant", "only.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in cv.repair(table, spark.createDataFrame([(9,)], "conv_id long")).collect()}
    assert (got[7]["cost"], got[7]["audit"], got[7]["repaired_sha256"]) == (0, "KK", hashlib.sha256(b"user:a?\nassistant:b.").hexdigest())
    assert (got[8]["cost"], got[8]["audit"]) == (2, "IK")
    assert tuple(got[9])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_shared_prefixes_are_computed_once():
    rnd = random.Random(0)
    words = sorted({"".join(rnd.choice("AEIFH") for _ in range(rnd.randrange(1, 9))) for _ in range(3000)})
    path = cv.Path()
    for w in words:
        layer = path.at(w)
        plain = cv.ROOT
        for x in w:
            plain = [cv.grown(s, x) for s in plain]
        assert layer == plain
    assert path.computed == len({w[:k] for w in words for k in range(1, len(w) + 1)})
