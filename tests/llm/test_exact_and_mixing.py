import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from docgauge.llm.exact_dedup import exact_dedup, keep_first
from docgauge.llm.mixing import SIZE_POWER, mix, plan_mix, take_mix

SCHEMA = "doc_id long, text string, source string, size long, kept string, k0 string, once string"


def docs(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, 1, "x", "y", "z")[:7] for r in rows], schema)


LONG = "word " * 30_000
ROWS = [
    (3, "a  b\tc", "s1"), (1, "a b c", "s1"), (2, "a b\n\nc", "s2"), (4, None, None), (5, "", "s2"), (6, LONG, "s2"), (7, LONG + " ", "s3"), (8, LONG.replace(" ", "\n"), "s1"),
    (9, "x" * 300 + "1", "s1"), (10, "x" * 300 + "2", "s1"), (11, " a b c", "s3"), (1, "a b c", "s1"), (None, "a b c", "s2"), (12, "ünï cödé", "ß"),
]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("digest_all", [False, True])
def test_exact_dedup_equals_brute_force(spark, digest_all):
    got = exact_dedup(docs(spark, ROWS), digest_all=digest_all).collect()
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[norm(t)].append(i)
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    assert len(got) == len(ROWS)
    for i, t, _ in ROWS:
        own = groups[norm(t)]
        for r in by_id[i]:
            assert r["group_size"] == len(own)
            assert r["keep_id"] == min((x for x in own if x is not None), default=None)
            sha = hashlib.sha256(norm(t).encode()).hexdigest()
            assert r["text_sha256"] == sha or (not digest_all and len(own) == 1 and r["text_sha256"] is None)
    assert sum(r["kept"] for r in got) == len(groups)  # of repeated rows one stays


def test_exact_dedup_of_nothing_and_filter(spark):
    empty = docs(spark, [])
    assert exact_dedup(empty).count() == 0 and keep_first(empty).count() == 0
    kept = keep_first(docs(spark, ROWS))
    assert kept.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    assert sorted(norm(r["text"]) for r in kept.collect()) == sorted({norm(t) for _, t, _ in ROWS})


def fill(sizes, weights=(5, 2, 1), cap=3):
    """The contract in its own words: share by weight, stop at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        for s in open_:
            target[s] += left * w[s] / total
        left = sum(max(0.0, target[s] - cap * sizes[s]) for s in open_)
        for s in list(open_):
            if target[s] >= cap * sizes[s]:
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def test_mixing_targets_and_takes(spark):
    rows = [(k, " ".join(["w"] * (k % 37 + 1)), ["hot", "b", "c", None, "e", "é"][k % 6 if k % 3 else 0]) for k in range(3000)] + [(5000, None, "empty"), (5001, "", "empty")]
    got = mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken, source = fill(sizes), defaultdict(int), {i: s for i, _, s in rows}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2, (s, taken[s], t)
    again = mix(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mixing_caps_and_empty(spark):
    rows = [(1, "a b c d", "a")] + [(k, "w " * 100, "z") for k in range(2, 30)]
    got = {r["doc_id"]: r for r in mix(docs(spark, rows)).collect()}
    assert got[1]["target"] == 12.0 and got[1]["taken"] == 12
    assert mix(docs(spark, [])).count() == 0
    only_empty = mix(docs(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert {(r["size"], r["taken"], r["target"]) for r in only_empty} == {(0, 0, 0.0)}


def chance(sizes, goal, power):
    """Inclusion probabilities by octave: proportional to the octave's weight, at most 1, expected words equal to goal."""
    lo, hi = 0.0, 1e9
    for _ in range(400):
        c = (lo + hi) / 2
        lo, hi = (c, hi) if sum(s * min(1.0, c * 2.0 ** (power * o)) for o, s in sizes.items()) < goal else (lo, c)
    return {o: min(1.0, hi * 2.0 ** (power * o)) for o in sizes}


def test_mixing_selects_by_random_over_inclusion_odds(spark):
    rng = random.Random(8)
    rows = [(k, "w " * rng.choice([1, 3, 9, 40, 200]), rng.choice("aabc")) for k in range(2500)]
    d = docs(spark, [*rows, *rows[:40]])
    plan = plan_mix(d)
    lam = {(r["source"], r["octave"]): r["lam"] for r in plan.classes.collect()}
    by_source = defaultdict(list)
    for r in plan.rows.collect():
        by_source[r["source"]].append(r)
    assert len({v for v in lam.values() if 0 < v < 1}) > 3  # the probabilities differ within a source
    for r in (r for own in by_source.values() for r in own):  # sure and rank again: random odds by inclusion odds
        p = lam[r["source"], r["octave"]]
        assert r["sure"] == (p >= 1) and (r["rank"] is not None) == (0 < p < 1 and r["size"] > 0)
        if r["rank"] is not None:
            u = Fraction(2 * ((r["key"] % 2**64 >> 12) % 2**51) + 1, 2**52)
            odds = u / (1 - u) / (Fraction(p) / (1 - Fraction(p)))
            assert abs(r["rank"] - min(int(odds / (1 + odds) * 2**44), 2**44 - 1)) <= 1
    for source, own in by_source.items():
        goal = own[0]["target"] - own[0]["whole"] * own[0]["source_size"]
        sizes = defaultdict(int)
        for r in own:
            sizes[r["octave"]] += r["size"]
        want = chance(sizes, goal, SIZE_POWER)
        assert all(abs(lam[source, o] - p) < 1e-6 for o, p in want.items()) or goal == 0
        got = sum(r["size"] for r in own if r["sure"])
        assert all(r["head"] for r in own if r["sure"])
        head, rest = set(), []
        for r in sorted((r for r in own if r["rank"] is not None), key=lambda r: (r["rank"], r["key"], r["rid"])):
            if got + r["size"] <= goal and not rest:
                got += r["size"]
                head.add(r["rid"])
            else:
                rest.append(r)
        for _ in range(3):
            fit = [r for r in rest if r["rid"] not in head and got < goal and r["size"] < 2 * (goal - got)]
            if fit:
                gap = goal - got
                best = min(fit, key=lambda r: (abs(gap - r["size"]), r["rank"], r["key"], r["rid"]))
                head.add(best["rid"])
                got += best["size"]
        assert {r["rid"] for r in own if r["head"] and not r["sure"]} == head


def test_take_mix_counts_repeated_and_clashing_rows(spark):
    rows = [(k % 30, "w " * (k % 7 + 1) + str(k % 60), "ab"[k % 2]) for k in range(120)]  # each row twice; two texts for an id
    rows += [(7, "v " * 5, "a"), (7, "x " * 5, "a"), (None, "n n", "b"), (None, "m m", "b"), (1, None, "a"), (2, " ", "b")]
    want, got = defaultdict(int), defaultdict(int)
    plan = plan_mix(docs(spark, rows))
    text = {(i, t, s) for i, t, s in rows}
    for r in mix(docs(spark, rows)).collect():
        want[r["doc_id"]] += r["copies"]
    out = [(r["doc_id"], r["text"], r["source"]) for r in take_mix(docs(spark, rows)).collect()]
    for r in out:
        assert r in text
        got[r[0]] += 1
    assert dict(got) == {i: n for i, n in want.items() if n}
    target = {r["source"]: r["target"] for r in plan.rows.select("source", "target").distinct().collect()}
    for s in "ab":
        assert abs(sum(len(t.split()) for _, t, x in out if x == s) - target[s]) <= 3
    assert take_mix(docs(spark, [])).count() == 0


def test_copies_of_a_hot_group_stay_apart(spark):
    rows = [(k, "the same text" if k % 3 else f"own text {k}", "s") for k in range(3000)]
    got = exact_dedup(docs(spark, rows).repartition(5)).collect()
    same = [r for r in got if r["doc_id"] % 3]
    assert {(r["keep_id"], r["group_size"]) for r in same} == {(1, 2000)} and sum(r["kept"] for r in got) == 1001
    odd = spark.createDataFrame([(1, "a", "x", 1, True), (2, "a", "y", 2, False)], "doc_id long, text string, `__row` string, doc int, hit boolean")
    left = keep_first(odd)
    assert left.columns == odd.columns and [tuple(r) for r in left.collect()] == [(1, "a", "x", 1, True)]


def test_take_mix_repeats_rows(spark):
    d = docs(spark, [(k, "w " * (k + 1), "ab"[k % 2]) for k in range(200)])
    plan = {r["doc_id"]: r["copies"] for r in mix(d).collect()}
    out = take_mix(d)
    assert out.columns == d.columns
    counts = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert counts == {i: c for i, c in plan.items() if c}


def test_mixing_gives_the_drivers_memory_back(spark, monkeypatch):
    """On check_h the pipeline's driver outgrew its limit by memory that its C allocator and its heap held unused."""
    from docgauge.llm import common, mixing

    trimmed = []
    real = common.trim_native
    monkeypatch.setattr(common, "trim_native", lambda s: trimmed.append(real(s)))
    df = spark.createDataFrame([(i, "a b c " * (i + 1), "xyz"[i % 3]) for i in range(12)], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 12
    assert trimmed and all(trimmed)
