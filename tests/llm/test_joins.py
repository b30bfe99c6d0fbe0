import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docgauge.llm import repeats, wordhash
from docgauge.llm.graph import chains, components
from docgauge.llm.line_dedup import drop_repeated_lines, keys_of, within
from docgauge.llm.near_join import near_join, one_of_each
from docgauge.llm.substring_dedup import remove_repeats, repeated_spans

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n long, once string, comp string")


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = split((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                up[find(i)] = find(j)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    return [(i, len(sets[k]), min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)]


def corpus(seed, groups=8, copies=9, noise=40):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    passage = " ".join(rng.choices(vocab, k=60))
    rows = []
    for _ in range(groups):
        base = rng.choices(vocab, k=rng.choice([3, 5, 6, 12, 60, 200]))
        for _ in range(copies):
            x = list(base)
            for _ in range(rng.randrange(0, 4)):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            if rng.random() < 0.3:
                x += passage.split()
            rows.append(rng.choice(["  ", " ", "\n"]).join(x).upper() if rng.random() < 0.1 else " ".join(x))
    rows += [" ".join(rng.choices(vocab, k=rng.randrange(1, 150))) + " " + passage for _ in range(noise)]
    rows += ["", None, "   ", "one", "ONE", "a b c d", "A b c  d", rows[0], rows[0]]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [*zip(ids, rows), (None, rows[5]), (ids[3], rows[3])]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_join_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got = near_join(docs(spark, rows).repartition(3)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_components(rows), key=key)


def test_near_copies_in_a_large_group(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(400):
        x = list(base)
        for _ in range(rng.randrange(0, 5)):
            x[rng.randrange(len(x))] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(x)))
    got = sorted(map(tuple, near_join(docs(spark, rows)).collect()))
    assert got == sorted(brute_components(rows))
    kept = one_of_each(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "n", "once", "comp"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in got})


def test_members_of_a_group_link_past_its_first(spark):
    rows = []
    for f in range(60):
        a = [f"f{f}x{k}" for k in range(12)]
        for x in (a, [*a[:-1], f"f{f}last"], [f"f{f}first", *a[1:]]):  # the first links with both others, these two don't
            rows += [" ".join(x)] * 2
    rows = list(enumerate(rows))
    got = sorted(map(tuple, near_join(docs(spark, rows)).collect()))
    assert got == sorted(brute_components(rows))


def test_one_of_each_with_null_and_clashing_ids(spark):
    text = lambda name, n=30: [f"{name}{k}" for k in range(n)]
    near = lambda name: " ".join([*text(name)[:-1], "other"])
    a, b, c, d = (" ".join(text(x)) for x in "abcd")
    clean = [(None, "clean one"), (None, "clean two"), (2, "clean three"), (None, None)]
    rows = [(1, a), (None, near("a")), (None, b), (None, near("b")), (3, c), (2, near("c")), (4, d), (4, near("d")), (4, d), *clean]
    got = [(r["doc_id"], r["text"]) for r in one_of_each(docs(spark, rows).repartition(3)).collect()]
    assert all(got.count(x) == 1 for x in clean)
    left = [x for x in got if x not in clean]
    assert len(left) == 4 and (1, a) in left and (2, near("c")) in left
    assert sorted(t.split()[0] for _, t in left) == ["a0", "b0", "c0", "d0"]


def test_passage_that_unlinked_documents_share(spark):
    passage = [f"p{k}" for k in range(80)]
    rows = [(k, " ".join([*(f"d{k}x{j}" for j in range(20)), *passage])) for k in range(1500)]  # 76 of 121 shingles in common
    rows += [(5000, " ".join([*(f"d7x{j}" for j in range(20)), *passage[:-1], "end"])), (5001, " ".join(f"w{k}" for k in range(100_000)) + " " + " ".join(passage))]
    got = {r["doc_id"]: r["component_id"] for r in near_join(docs(spark, rows)).collect()}
    assert got == {**{k: k for k, _ in rows}, 5000: 7}


def test_lines_of_one_template(spark):
    rng = random.Random(4)
    lines = [f"Posted by {''.join(rng.choices('abcdefgh', k=6))} in the forum of the old town on day {rng.randrange(400)} of the year" for _ in range(500)]
    lines += [x.replace("old", rng.choice(["odd", "new"]))[: 200 - k % 3] for k, x in enumerate(lines[:40])]
    up = list(range(len(lines)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    pairs = [(i, j) for i in range(len(lines)) for j in range(i)]
    for (i, j), near in zip(pairs, within([lines[i] for i, _ in pairs], [lines[j] for _, j in pairs], 2)):
        if near:
            up[find(i)] = find(j)
    first = {}
    for k in range(len(lines)):
        first.setdefault(find(k), k)
    got = {r["doc_id"]: r["n_dropped"] for r in drop_repeated_lines(docs(spark, list(enumerate(lines)))).collect()}
    assert got == {k: int(first[find(k)] != k) for k in range(len(lines))}


def test_joins_of_nothing(spark):
    empty = docs(spark, [])
    assert near_join(empty).count() == 0 and drop_repeated_lines(empty).count() == 0 and remove_repeats(empty).count() == 0


def brute_windows(rows, k):
    seen = defaultdict(int)
    words = [split(t) for _, t in rows]
    for w in words:
        for a in range(len(w) - k + 1):
            seen[tuple(w[a : a + k])] += 1
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for a in range(len(w) - k + 1):
            if seen[tuple(w[a : a + k])] > 1:
                gone |= set(range(a, a + k))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_substring_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"v{k}" for k in range(50)] + ["é", "日本"]
    passages = [rng.choices(vocab, k=n) for n in (34, 35, 36, 90)]
    rows = []
    for i in range(60):
        w = rng.choices(vocab, k=rng.randrange(0, 120))
        for p in rng.sample(passages, rng.randrange(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = p if rng.random() < 0.7 else p[: len(p) - 1] + ["odd"]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(100, "same " * 200), (101, None), (102, ""), (103, " ".join(passages[3] * 2)), (104, rows[7][1]), (7, rows[7][1]), (None, rows[8][1]), (105, "Same " * 36)]
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in remove_repeats(docs(spark, rows).repartition(4)).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(brute_windows(rows, 35), key=key)


def brute_paths(rows, k):
    """The path of each repeated edge, as its first edge (a cycle's smallest), by walking the graph from node to node."""
    seen = defaultdict(int)
    for _, t in rows:
        w = split(t)
        for a in range(len(w) - k + 1):
            seen[tuple(w[a : a + k])] += 1
    edges = {e for e, n in seen.items() if n > 1}
    into, out = defaultdict(list), defaultdict(list)
    for e in edges:
        out[e[:-1]].append(e)
        into[e[1:]].append(e)
    head = {}
    for e in edges:
        at, walked = e, [e]
        while len(into[at[:-1]]) == 1 == len(out[at[:-1]]) and into[at[:-1]][0] != e:
            at = into[at[:-1]][0]
            walked.append(at)
        closed = len(into[at[:-1]]) == 1 == len(out[at[:-1]])
        head[e] = min(walked) if closed else at
    return head


def test_compacted_paths_equal_brute_force(spark):
    rng = random.Random(11)
    vocab, k = [f"v{i}" for i in range(30)], 6
    passages = [rng.choices(vocab, k=n) for n in (5, 6, 20, 90, 200)]
    rows = []
    for i in range(40):
        w = rng.choices(vocab, k=rng.randrange(0, 30))
        for p in rng.sample(passages, rng.randrange(0, 3)):
            a, z = sorted(rng.sample(range(len(p) + 1), 2)) if rng.random() < 0.5 else (0, len(p))
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[a:z] if rng.random() < 0.7 else p[: len(p) // 2] + ["odd"] + p[len(p) // 2 :]
        rows.append((i, " ".join(w)))
    rows += [(100, "ring a b c d e f " * 30), (101, "same " * 90)]
    df = docs(spark, rows).repartition(3).withColumn("th", F.xxhash64("text"))
    got, text, spans = {}, dict(rows), 0
    for r in repeated_spans(df, k, 2).collect():
        w = text[r["doc_id"]].split()
        for s in r["found"]:
            spans += 1
            for a in range(s["start"], s["start"] + s["edges"]):
                assert got.setdefault(tuple(w[a : a + k]), s["path"]) == s["path"]
    want = brute_paths(rows, k)
    assert got.keys() == want.keys()
    assert len(set(got.values())) == len(set(want.values())) == len({(got[e], want[e]) for e in want})
    assert spans < len(want)


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


TEXT = st.text(alphabet="abé\U0001f600", max_size=70)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 70), st.sampled_from(["", "a", "zz"])), max_size=5), st.integers(1, 3))
def test_edit_distance_and_segment_keys(a, edits, most):
    b = a
    for at, new in edits:
        b = b[:at] + new + b[at + 1 :]
    near = distance(a, b) <= most
    assert within([a], [b], most).tolist() == [near]
    if near and a != b and min(len(a), len(b)) >= 12:
        at, keys, roles, _ = keys_of([a, b], most, 12)
        one, two = ({(int(k)) for i, k in zip(at, keys) if i == j} for j in (0, 1))
        assert one & two


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdefghij klmé", k=rng.randrange(45, 120))).strip().ljust(45, "q") for _ in range(12)]
    rows = []
    for i in range(50):
        lines = []
        for _ in range(rng.randrange(0, 7)):
            x = list(rng.choice(base))
            for _ in range(rng.randrange(0, 4)):
                x[rng.randrange(len(x))] = rng.choice("xyz")
            lines.append("".join(x) if rng.random() < 0.8 else rng.choice(["short", "", "  "]))
        rows.append((i, "\n".join(lines)))
    rows += [(90, None), (91, ""), (92, "short\nshort"), (None, rows[1][1]), (93, "L" * 50_000)]
    occ = [(i is None, i or 0, k, x.strip()) for i, t in rows for k, x in enumerate((t or "").split("\n")) if len(x.strip()) >= 40]
    lines = sorted({o[3] for o in occ})
    up = {x: x for x in lines}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, a in enumerate(lines):
        for b in lines[:n]:
            if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
                up[find(a)] = find(b)
    classes = defaultdict(list)
    for o in occ:
        classes[find(o[3])].append(o[:3])
    gone = {o for c in classes.values() for o in sorted(c)[1:]}
    want = []
    for i, t in rows:
        own = (t or "").split("\n")
        left = [x for k, x in enumerate(own) if (i is None, i or 0, k) not in gone]
        want.append((i, len(own), len(own) - len(left), "\n".join(left)))
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in drop_repeated_lines(docs(spark, rows).repartition(3)).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_line_query_drops_exact_copies_of_short_lines(spark, tmp_path):
    from docgauge.llm.line_dedup import op4_line_dedup

    texts = {1: "Menu\n\nfirst\n x", 2: " Menu \n\nMenus\nx", 3: None, 4: "x\nx\n  \n" + "l" * 39, 5: "l" * 39 + "\n" + "l" * 38, 6: "l" * 40 + "\n" + "l" * 41}
    docs(spark, list(texts.items())).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op4_line_dedup(spark, str(tmp_path)).collect()}
    assert {i: (r["n_lines"], r["n_dropped"]) for i, r in got.items()} == {1: (4, 0), 2: (4, 2), 3: (1, 0), 4: (4, 2), 5: (2, 2), 6: (2, 2)}  # 38 to 41 letters: one class
    assert got[2]["kept_sha256"] == hashlib.sha256(b"\nMenus").hexdigest()


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (3, 4), (20, 20), (11, 10), *[(100 + k, 101 + k) for k in range(40)]]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, **{100 + k: 100 for k in range(41)}}


@pytest.mark.parametrize("find", [components, chains])
def test_sizes_that_spark_takes_tables_to_have_do_not_grow_with_rounds(spark, find):
    out = find(spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long"))
    assert out.count() == 201 and {r["comp"] for r in out.collect()} == {0}
    assert int(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 64


def test_lines_are_never_broadcast(spark):
    rows = docs(spark, [(k, f"a line that many have\na line of its own, number {k * 7919} of all\na line that many hav{k % 3}") for k in range(30)])
    out = drop_repeated_lines(rows, short=True)
    assert len(out.collect()) == 30
    sent = re.findall(r"BroadcastHashJoin \[(.*?)\]", out._jdf.queryExecution().executedPlan().toString())
    assert sent and all("__row" in x for x in sent), sent  # the sketch, whose rows are bounded


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0b\x1c日", max_size=40)), max_size=8))
def test_word_hashes_follow_the_words(texts):
    h, starts, ends, firsts, data = wordhash.words(pa.array(texts, pa.string()), fold=True)
    want = [[w.translate(LOWER) for w in split(t)] for t in texts]
    raw = data.tobytes()
    got = [[raw[starts[k] : ends[k]].decode().translate(LOWER) for k in range(firsts[i], firsts[i + 1])] for i in range(len(texts))]
    assert got == want
    flat = [w for t in want for w in t]
    assert len(set(flat)) == len(set(h.tolist())) and all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


def test_words_over_chunks(monkeypatch):
    monkeypatch.setattr(wordhash, "CHUNK_BYTES", 16)
    texts = pa.array(["aa bb " * 20, "x" * 100, "", "y " + "z" * 50 + " end", "q" * 16 + " r"])
    a = wordhash.words(texts)
    monkeypatch.setattr(wordhash, "CHUNK_BYTES", 1 << 20)
    b = wordhash.words(texts)
    assert all(np.array_equal(x, y) for x, y in zip(a, b))


@pytest.mark.parametrize("log_blocks", [5, 13])
def test_sketch_never_misses(spark, log_blocks):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**64, 20_000, np.uint64)
    keys[:500] = keys[500:1000]
    keys[1000:1100] = keys[1100]
    rows = list(repeats.blocks([keys[:7000], keys[7000:]], log_blocks))
    df = spark.createDataFrame(pa.Table.from_batches(rows).to_pandas(), repeats.BLOCK)
    found = repeats.collect(df, log_blocks, len(keys))
    again = found.has(keys)
    assert again[:1101].all() and again[1101:].mean() < 0.05
    assert found.rank(keys)[1000] == 6 and (found.rank(keys[1101:]) == 6).mean() < 0.01


def test_sketch_shapes():
    assert [repeats.key_bytes(k) for k in (4, 11, 12, 19, 20, 22)] == [5, 5, 6, 6, 7, 7]
    assert [repeats.shape_for(n) for n in (1, 32, 800_000, 10**9)] == [4, 7, 22, 22]
    keys = np.array([1 << 63, 5, 1 << 63, 7], np.uint64)
    assert all(np.array_equal(repeats._of_planes(repeats._planes(np.sort(keys), 8), 8), np.sort(keys)) for _ in range(1))


def test_anchors_never_miss_a_repeated_window_and_are_few():
    """A filter of all repeated windows is full at 6 GB; anchors are a quarter as many, lie in their windows and depend on them alone."""
    from docgauge.llm import substring_dedup as sd

    rng = random.Random(5)
    passage = [f"p{i}" for i in range(50)]
    texts = [" ".join(rng.choices("abcdefgh", k=400)) + " " + " ".join(passage) for _ in range(3)] + ["a " * 90, "a b c " * 40, "", "one two"]
    texts.append(" ".join(f"w{i}" for i in range(3000)))
    for k in (35, 8, 5, 1):
        at, _, _, h = sd._places(pa.array(texts), k)
        anchors, mine = sd._anchors(h, at, k)
        counts = Counter(anchors.tolist())
        windows = wordhash.windows(h, k)[at].tolist()
        often = Counter(windows)
        assert all(counts[anchors[m]] > 1 for w, m in zip(windows, mine.tolist()) if often[w] > 1)
        seen = {}
        assert all(seen.setdefault(w, anchors[m]) == anchors[m] for w, m in zip(windows, mine.tolist()))
    at, _, _, h = sd._places(pa.array(texts[-1:]), 35)
    assert len(sd._anchors(h, at, 35)[0]) < 0.3 * len(at)
