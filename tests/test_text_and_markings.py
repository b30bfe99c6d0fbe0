import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docgauge.functions import markings as mk
from docgauge.functions import text as tx

CASES = {
    "empty": ("", dict(empty=True, near_empty=True)),
    "blank but long": (" " * 90, dict(empty=True, near_empty=False)),
    "70 characters": ("a" * 69 + ".", dict(near_empty=True)),
    "71 characters": ("a" * 70 + ".", dict(near_empty=False, truncated=False)),
    "cut": ("word " * 20 + "and then", dict(truncated=True)),
    "banner last": ("word " * 20 + "end.\nSECRET//NOFORN\n\nCUI", dict(truncated=False)),
    "tag last": ("word " * 20 + "end.</p>&nbsp;\n", dict(truncated=False)),
    "bell": ("a\x07b", dict(control=True)),
    "tabs": ("a\t\x0b\f\r\nb", dict(control=False)),
    "replacement": ("a�", dict(control=True)),
    "next line": ("a\x85b", dict(control=True)),
    "tag": ("<br/>", dict(markup=True)),
    "attributes": ('<a href="x">', dict(markup=True)),
    "less than": ("a < b > c", dict(markup=False)),
    "entity": ("&amp; &#39;", dict(markup=True)),
    "upper entity": ("&AMP;", dict(markup=False)),
    "mojibake": ("cafÃ©", dict(mojibake=True)),
    "curly mojibake": ("itâ€™s", dict(mojibake=True)),
    "accents": ("café été », Ünïcödé", dict(mojibake=False)),
    "french quote": ("été\xa0» voilà\xa0»", dict(mojibake=False)),
}


def test_predicates(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], "name string, text string")
    t = F.col("text")
    cols = dict(empty=tx.is_empty(t), near_empty=tx.is_near_empty(t), truncated=tx.is_truncated(t, mk.BANNER), control=tx.has_control_chars(t), markup=tx.has_markup(t), mojibake=tx.is_mojibake(t))
    got = {r["name"]: r for r in df.select("name", *[c.alias(k) for k, c in cols.items()]).collect()}
    for name, (_, want) in CASES.items():
        for k, v in want.items():
            assert got[name][k] is v, (name, k)


def test_tokens_round_halves_to_even(spark):
    df = spark.createDataFrame([("",), ("a",), ("a" * 9,), ("é" * 27,), ("a" * 1000,)], "text string")
    assert [r[0] for r in df.select(tx.token_estimate(F.col("text"))).collect()] == [0, 1, 2, 8, 278]


def _grams(text):
    import re

    w = [x.lower() for x in re.findall(r"[^\W]+", text)]
    total, worst = sum(map(len, w)), 0.0
    if not total:
        return 0.0
    for n in (2, 3, 4):
        grams = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
        cover = {j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(k, k + n)}
        worst = max(worst, sum(len(w[j]) for j in cover) / total)
    return round(worst, 6)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "ccc", "é", "Bb"]), max_size=30))
def test_ngram_rule(words):
    import numpy as np

    text = " ".join(words)
    got = tx._repeated_share(np.array([w.lower() for w in words], object).astype(str)) if words else 0.0
    assert got == _grams(text)


def test_shares(spark):
    rows = [("alpha beta gamma delta",), ("alpha beta alpha beta",), ("one line only",), ("a b c d e\nA  b C d e\nshort\nall rights reserved to us here",), (None,)]
    df = spark.createDataFrame(rows, "text string").withColumn("text", F.coalesce("text", F.lit("")))
    got = df.select(tx.ngram_repetition(F.col("text")), tx.intra_doc_repetition(F.col("text")), tx.boilerplate_share(F.col("text"))).collect()
    assert [tuple(r) for r in got][:3] == [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
    assert tuple(got[3])[1:] == (0.25, 0.5) and tuple(got[4]) == (0.0, 0.0, 0.0)


MARKED = [
    ("SECRET//NOFORN\ntext", "S", None, "S", False, False, "NOFORN"),
    ("TOP SECRET//SI//REL TO USA, FVEY\n(TS//SI) x\n(U) y", "TS", "TS", "TS", False, False, "REL TO USA, FVEY,SI"),
    ("UNCLASSIFIED\n(S) x", "U", "S", "S", True, False, ""),
    ("SECRET\n(U) x", "S", "U", "S", True, False, ""),
    ("SECRET\nCUI\n", "S", None, "S", True, False, ""),
    ("- (C) x\n1. (CUI//SP-PRVCY) y\n• (U) z", None, "C", "C", False, True, ""),  # the inline mark of the second line is residue
    ("secret\nSECRET stuff", None, None, None, False, False, ""),
    ("see [redacted] and", None, None, None, False, True, ""),
    ("(b)(6) gone", None, None, None, False, True, ""),
    ("███ gone", None, None, None, False, True, ""),
    ("XXXXXX and xxxxxxx", None, None, None, False, True, ""),
    ("aXXXXXXb XXXXX", None, None, None, False, False, ""),
    ("pasted SECRET//NOFORN here", None, None, None, False, True, ""),
    ("", None, None, None, False, False, ""),
]


def test_markings(spark):
    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(MARKED)], "k int, text string")
    rows = mk.with_marks(df, "m").select("k", "m.banner", "m.portion_max", "m.level", "m.conflict", "m.redaction_residue", F.array_join("m.controls", ","), "m.marked").orderBy("k").collect()
    for r, want in zip(rows, MARKED):
        assert tuple(r)[1:7] == want[1:] and r["marked"] is (want[3] is not None), want
    one = spark.createDataFrame([("(S) a\n(S) b\n(U) c", ["CUI", "nothing"])], "text string, told array<string>")
    one = mk.with_marks(one, "m", "text", "told").first()["m"]
    assert one["portions"] == {"S": 2, "U": 1} and one["banners"] == ["CUI"] and one["conflict"]


@pytest.mark.parametrize(("ceiling", "above"), [("U", 4), ("CUI", 3), ("TS", 0), (None, 0)])
def test_ceiling(spark, ceiling, above):
    df = spark.createDataFrame([(x,) for x in ("U", "CUI", "C", "S", "TS", None)], "level string")
    assert df.where(mk.above(F.col("level"), ceiling)).count() == above


def test_minhash_confirms_near_copies(spark):
    from docgauge.operators.near import near_hashes

    rng = random.Random(1)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(base)]
    for k in range(40):
        x = list(base)
        x[rng.randrange(200)] = f"n{k}"
        texts.append(" ".join(x))
    texts += [" ".join(rng.choices([f"z{k}" for k in range(500)], k=100)) for _ in range(20)] + ["too few words", texts[0]]
    df = spark.createDataFrame([(str(hash(t)), t) for t in texts], "doc_hash string, text string")
    assert near_hashes(df).count() == 41


def test_shares_make_lines_once_and_send_words_as_one_string(spark):
    """Lines were split and stripped anew wherever an expression named them, and words went to Python as arrays."""
    plan = lambda c: spark.range(1).select(F.col("id").cast("string").alias("t")).select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(tx.intra_doc_repetition(F.col("t"))).count("split(") == 1
    assert plan(tx.boilerplate_share(F.col("t"))).count("split(") == 2  # texts that may have a phrase, and others
    assert "regexp_extract_all" not in plan(tx.ngram_repetition(F.col("t")))


@pytest.mark.parametrize(("text", "boiler", "intra"), [
    ("one two three four\nCOOKIE one two three four\nterms of ſervice and three more", 0.666667, 0.0), ("a  b\n　A \t B \n\x1c\n", 1.0, 0.5), ("cookie", 0.0, 0.0), ("x y z w\r\nx  y\tz w", 0.0, 0.5), ("", 0.0, 0.0),
])
def test_shares_of_odd_texts(spark, text, boiler, intra):
    row = spark.createDataFrame([(text,)], "t string").select(tx.boilerplate_share(F.col("t")).alias("b"), tx.intra_doc_repetition(F.col("t")).alias("i")).first()
    assert (row["b"], row["i"]) == (boiler, intra)
