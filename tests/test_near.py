"""Near duplicates against all pairs, and how many pairs documents of one template make."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from docgauge.operators import near, ranks


def docs_of(kind, n, seed):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(50_000)}"
    base = [word() for _ in range(300)]
    out = []
    for k in range(n):
        if kind == "template":  # 300 of 380 words are everyone's
            at = rnd.randrange(250)
            out.append(base[:at] + [word() for _ in range(80)] + base[at:])
        elif kind == "edited":  # a few words are changed, more with k
            x = list(base)
            for _ in range(k % 40):
                x[rnd.randrange(300)] = word()
            out.append(x)
        else:
            out.append([word() for _ in range(60)])
    return [" ".join(x) for x in out]


def frame(spark, texts):
    return spark.createDataFrame([(hashlib.sha256(t.encode()).hexdigest(), t) for t in texts], "doc_hash string, text string").repartition(4)


def brute(texts):
    found, sigs = set(), {hashlib.sha256(t.encode()).hexdigest(): near._signature(t.lower().split()) for t in texts}
    keys = list(sigs)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sigs[a], sigs[b]
            if x and y and sum(p == q for p, q in zip(x, y)) >= near.THRESHOLD * near.SLOTS and any(x[k : k + near.ROWS] == y[k : k + near.ROWS] for k in range(0, near.BANDS * near.ROWS, near.ROWS)):
                found |= {a, b}
    return found


@pytest.mark.parametrize("broadcast", [0, 50_000])
def test_near_hashes_equal_all_pairs(spark, monkeypatch, broadcast):
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", broadcast)
    texts = docs_of("template", 60, 1) + docs_of("edited", 120, 2) + docs_of("alone", 40, 3) + ["too few words", ""]
    texts += [t + " more words at its end" for t in texts[:10]]
    got = {r["doc_hash"] for r in near.near_hashes(frame(spark, texts)).collect()}
    want = brute(texts)
    assert got == want and 20 < len(want) < len(texts)


def test_documents_of_one_template_make_few_pairs(spark):
    counts = []
    for n in (300, 600):
        sigs = near.signatures(frame(spark, docs_of("template", n, 7))).select(F.col("doc_hash").alias("h"), "sig").persist()
        assert sigs.count() == n
        counts.append(near.rare_pairs(sigs, sigs, int(near.THRESHOLD * near.SLOTS) + 1).count())
        sigs.unpersist()
    assert counts[1] < 600 * 30 and counts[1] < 3 * max(counts[0], 600), counts


def test_signatures_take_words_as_one_string(spark):
    from docgauge.operators.near import _A, _B, PRIME, signatures

    text = " ".join(f"Wort{k % 7} Σ{k}" for k in range(400))
    rows = signatures(spark.createDataFrame([("h", text), ("few", "a b c d")], "doc_hash string, text string"))
    assert "regexp_extract_all" not in rows._jdf.queryExecution().optimizedPlan().toString()
    words = text.lower().split(" ")
    shingles = {int(hashlib.sha1(" ".join(words[k : k + 5]).encode()).hexdigest()[:7], 16) for k in range(len(words) - 4)}
    assert [tuple(r) for r in rows.collect()] == [("h", [min((int(a) * h + int(b)) % PRIME for h in shingles) for a, b in zip(_A, _B)])]
