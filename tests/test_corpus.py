"""Languages, scripts, words and personal data against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docgauge.functions import spans
from docgauge.operators import compliance as cp
from docgauge.operators import language as lg
from docgauge.operators import lexical as lx
from docgauge.plans.measure import measure
from docgauge.sources.tables import read_documents, read_table

SF = "/root/testdata/sf0.01"


# --- languages and scripts ----------------------------------------------------


def grams(text):
    t = " " + re.sub(r"[^a-zà-ÿ]+", " ", (text or "").lower()).strip() + " "
    return [(ord(t[i]) * lg.FIRST + ord(t[i + 1]) * lg.SECOND + ord(t[i + 2])) % lg.BUCKETS for i in range(len(t) - 2)]


def test_language_model_and_labels(spark):
    rnd = random.Random(3)
    syl = {"a": ["ka", "lo", "mi", "tu"], "b": ["stre", "gno", "xi", "lo"], "c": ["éa", "où", "re", "mi"]}
    say = lambda k, n: " ".join("".join(rnd.choices(syl[k], k=3)) for _ in range(n))
    rows = [(i, k, say(k, 40)) for i, k in enumerate("abc" * 20)] + [(90, None, say("b", 30)), (91, "a", None), (92, None, ""), (93, "c", "x"), (94, "a", say("a", 300) + ". " + say("c", 200)), (94, None, say("b", 30))]
    docs = spark.createDataFrame(rows, "doc_id int, lang string, text string").repartition(3)
    model = lg.fit(docs)
    counts = defaultdict(Counter)
    for _, k, t in rows:
        if k:
            counts[k].update(grams(t))
    assert model.languages == ("a", "b", "c")
    for k, row in zip(model.languages, model.table):
        n = sum(counts[k].values())
        assert all(abs(row[c] - 1000 * math.log((counts[k][c] + 1) / (n + lg.BUCKETS))) <= 0.500001 for c in range(lg.BUCKETS))
    want = []
    for i, _, t in rows:
        g = grams(t)
        score = {k: sum(model.table[j][c] for c in g) for j, k in enumerate(model.languages)}
        best = max(sorted(score), key=score.get)
        sure = round(1 / sum(math.exp((score[k] - score[best]) / 1000 / math.sqrt(max(len(g), 1))) for k in score), 6) if g else 0.0
        share = Counter()
        for p in range(0, len(g), lg.PIECE):
            s = {k: sum(model.table[j][c] for c in g[p : p + lg.PIECE]) for j, k in enumerate(model.languages)}
            share[max(sorted(s), key=s.get)] += len(g[p : p + lg.PIECE])
        second = max((k for k in sorted(share) if k != best and share[k]), key=share.get, default=None) if g else None
        want.append((i, best if len(g) >= lg.LEAST and sure >= lg.SURE else "unknown", sure, second, round(share[second] / len(g), 6) if second else 0.0, len(g)))
    got = sorted(map(tuple, lg.identify(docs, model).collect()), key=str)
    assert [(*r[:2], *r[3:]) for r in got] == [(*r[:2], *r[3:]) for r in sorted(want, key=str)]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, sorted(want, key=str)))
    mixed = next(r for r in got if r[0] == 94 and r[5] > 2000)
    assert mixed[1] == "a" and mixed[3] == "c" and mixed[4] > lg.SECOND_SHARE
    assert lg.identify(docs, lg.Model((), ())).where("label <> 'unknown'").count() == 0


def test_language_accuracy_on_held_out_documents(spark):
    from docgauge.plans.corpus_queries import language_held_out

    rows = language_held_out(spark, SF).collect()
    assert len(rows) == 4 and sum(r["right"] for r in rows) / sum(r["docs"] for r in rows) > 0.97


def test_language_as_a_family(spark):
    docs = read_documents(spark, "/root/testdata/sf0.001")
    family = lg.Language(model=lg.fit(read_table(spark, SF, "documents")))
    from docgauge.operators.families import REGISTRY, register

    register(family)
    try:
        m = measure(docs, ["volume", "language"])
    finally:
        del REGISTRY["language"]
    values = {r["metric_id"]: r["value"] for r in m.results}
    assert sum(values["lang.histogram"].values()) == values["vol.total_docs"] == docs.count()
    assert values["lang.en.count"] > values["lang.es.count"] > 0 and 0 <= values["lang.mixed_rate"] < 0.2
    m.docs.unpersist()


def test_scripts(spark):
    texts = ["", None, "123 !?", "plain words", "при вет hi", "pаypal", "日本のテスト", "ελ λη νικά abc", "ⴰⵣⵓⵍ a", "한글 한글"]  # the a of paypal is Cyrillic
    got = {r["doc_id"]: tuple(r)[1:] for r in lg.scripts(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert got == {
        0: (None, None, 0, 0), 1: (None, None, 0, 0), 2: (None, None, 0, 0), 3: ("Latin", 1.0, 2, 0), 4: ("Cyrillic", 0.75, 3, 0), 5: ("Latin", 0.833333, 3, 2),
        6: ("Katakana", 0.5, 3, 2), 7: ("Greek", 0.727273, 4, 0), 8: ("Other", 0.8, 5, 0), 9: ("Hangul", 1.0, 2, 0),
    }
    codes = spark.range(0, 0xD7FF, 7).select("id", lg.script_of(F.col("id")).alias("s")).collect()
    assert all(r["s"] == next((n for a, b, n in lg.SCRIPTS if a <= r["id"] <= b), "Other") for r in codes)


# --- words ---------------------------------------------------------------------


def factors(words):
    whole, types, n = 0, set(), 0
    for w in words:
        types.add(w)
        n += 1
        if len(types) * 100 <= n * 72:
            whole, types, n = whole + 1, set(), 0
    return whole + ((1 - len(types) / n) / 0.28 if n else 0)


def test_mtld(spark):
    rnd = random.Random(5)
    texts = [None, "", "one", "a a", "A b a c", "the same " * 50, " ".join(f"w{k}" for k in range(30_000))]
    texts += [" ".join(rnd.choices("abcdefghijkl", k=rnd.randrange(1, 300))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", lx.mtld(F.col("t")).alias("m"), lx.ttr(F.col("t")).alias("r"))
    for r in rows.collect():
        w = re.findall(r"\w+", (texts[r["i"]] or "").lower())
        if not w:
            assert r["m"] is None and r["r"] is None
            continue
        f, b = factors(w), factors(w[::-1])
        want = sum(len(w) / x if x > 0 else len(w) for x in (f, b)) / 2
        assert abs(r["m"] - want) < 2e-6 * max(1, want) and abs(r["r"] - len(set(w)) / len(w)) < 1e-6


@pytest.mark.parametrize("cells", [4, 1 << 16])
def test_salient_terms(spark, monkeypatch, cells):
    monkeypatch.setattr(lx, "CELLS", cells)
    rnd = random.Random(6)
    rows = [(rnd.choice(["x", "y", None, "z"]), " ".join(rnd.choices([f"t{k}" for k in range(60)], weights=[1 / (k + 1) for k in range(60)], k=80)) + rnd.choice([" own own", ""])) for _ in range(60)] + [("z", None), ("lone", "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "part string, text string, cell int")
    got = sorted((tuple(r) for r in lx.salient_terms(docs, "part", top=5, support=100).collect()), key=str)
    here = defaultdict(Counter)
    for p, t in rows:
        here[p].update((t or "").split())
    every, total = sum(here.values(), Counter()), sum(sum(c.values()) for c in here.values())
    want = []
    for p, c in here.items():
        size, found = sum(c.values()), []
        for t, a in c.items():
            b, rest = every[t] - a, total - size
            if a * 100 >= size and a * rest > b * size:
                share = (a + b) / total
                found.append((-round(2 * (a * math.log(a / (size * share)) + (b * math.log(b / (rest * share)) if b else 0)), 4), t, a, b))
        want += [(p, k + 1, t, a, b, -s) for k, (s, t, a, b) in enumerate(sorted(found)[:5])]
    assert [r[:5] for r in got] == [r[:5] for r in sorted(want, key=str)] and all(abs(x[5] - y[5]) < 2e-4 for x, y in zip(got, sorted(want, key=str)))


# --- personal data ---------------------------------------------------------------


def proven(kind, x):
    d = re.sub("[^0-9]", "", x)
    if kind == "iban":
        p = x.replace(" ", "")
        return 15 <= len(p) <= 34 and int("".join(str(int(c, 36)) for c in p[4:] + p[:4])) % 97 == 1
    if kind == "card":
        return 13 <= len(d) <= 19 and any(c != "0" for c in d) and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    if kind == "ssn":
        m = re.fullmatch(r"(\d{3})-(\d\d)-(\d{4})", x)
        return bool(m) and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"
    if kind == "ipv4":
        p = x.split(".")
        return len(p) == 4 and all(str(int(q)) == q and int(q) < 256 for q in p)
    return 8 <= len(d) <= 15 if kind == "phone" else len(x) <= 254


def brute_pii(text):
    found = sorted((m.start(), -m.end(), k, kind) for k, (kind, p) in enumerate(cp.PATTERNS.items()) for m in re.finditer(p, text or "") if proven(kind, m[0]))
    out, last = [], -1
    for a, e, _, kind in found:
        if a >= last:
            out.append((kind, a, -e))
            last = -e
    return out


def test_pii_against_plain_python(spark):
    rnd = random.Random(8)
    bits = ["4111 1111 1111 1111", "4111 1111 1111 1112", "5500-0000-0000-0004", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "DE89370400440532013001", "a.b+c@mail.example.com", "x@y", "123-45-6789", "666-45-6789", "1-123-45-6789",
            "900-11-1111", "10.0.0.1", "256.1.1.1", "1.2.3.4.5", "01.2.3.4", "+49 (0)30 1234567", "+1-202-555-0143", "0000 0000 0000 0000", "é😀", "word", "12345", "10.0.0.1@host.example", "+4111 1111 1111 1111"]
    texts = [None, "", *bits, *(rnd.choice(["", " ", "é "]).join(rnd.choices(bits, k=rnd.randrange(2, 9))) for _ in range(150)), " ; ".join(f"u{k}@example.com 10.0.{k % 256}.7" for k in range(1500))]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id int, text string, spans int").repartition(3)
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in cp.scan(docs).collect()}
    assert got == {k: brute_pii(t) for k, t in enumerate(texts)}
    assert sum(len(x) for x in got.values()) > 3000
    plan = cp.scan(read_table(spark, SF, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("EvalPython|MapIn|Exchange", plan)


def test_pii_as_a_family(spark):
    family = cp.Pii()
    docs = spark.createDataFrame([("h1", "mail a@b.example and 123-45-6789"), ("h2", "none"), ("h3", None)], "doc_hash string, text string")
    values = {r["metric_id"]: r["value"] for r in family.results(family.extend(docs))}
    assert values["pii.hit_rate"] == values["pii.usp_indicator_rate"] == round(1 / 3, 6) and values["pii.by_category"] == {"iban": 0, "card": 0, "email": 1, "ssn": 1, "ipv4": 0, "phone": 0}


def test_running_sums(spark):
    rows = spark.createDataFrame([([k % 7 for k in range(n)],) for n in (1, 511, 512, 513, 2000)], "x array<bigint>").select("x", spans.sums_before(F.col("x")).alias("s")).collect()
    assert all(r["s"] == [sum(r["x"][:k]) for k in range(len(r["x"]))] for r in rows)
