"""License scan: phrase places, and an exact set-similarity join of text blocks with templates.

A block is a run of words, across lines, as notices are usually wrapped: runs
begin at every n-th word and have 3 n, n being the words of the longest template, so any 2 n words in a row
lie in one. A block's set is its distinct words. A template is found in a block when the
block holds at least CONTAINMENT of the template's distinct words. Words are ordered by how many
documents of the whole corpus hold them, rarest first. A block that meets the threshold must
hold one of the first n - ceil(c * n) + 1 words of the template in this order (prefix
filter), so only those words are exploded and joined; blocks with too few template words
(length filter), or with too few left from the matched place on (positional filter), go before the exact
count. Everything runs in DataFrame functions. The template index is broadcast; its size is
the templates', not the corpus's.

Defined cases: a null text is empty and has no words; repeated rows each get their result;
very long texts have many blocks, with line breaks or without; an empty table gives an empty result; rows are matched back
by id and text hash, so clashing ids don't mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read, text_of

#: Words of a lower-cased text: runs of 0-9, a-z and all beyond ASCII. The same set as a negated class takes Java ten times as long.
TERM = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: The same words before A-Z are lower-cased.
CASED_TERM = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.8

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label and typical sentence of a license notice.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-short": "licensed under cc by 4.0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "no-reproduction": "all rights reserved no part of this publication may be reproduced",
}


def terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _template_words(templates: dict[str, str]) -> dict[str, list[str]]:
    import re

    return {k: sorted(set(re.findall(r"[0-9a-z]+", v.lower()))) for k, v in templates.items()}


def _any_inside(text: Column, words) -> Column:
    """Whether the text has some of the words, be it inside of others: a cheap test without false negatives."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def word_order(docs: DataFrame, words: dict[str, list[str]]) -> list[str]:
    """All template words, those in the fewest documents of the corpus first; as many rows as templates have words."""
    vocabulary = sorted(set().union(*words.values()))
    held = docs.select(F.explode(F.array_intersect(_strings(vocabulary), terms(F.col("text")))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


#: Templates that a table may hold.
MOST_TEMPLATES = 10_000


def templates_of(table: DataFrame, label: str = "label", text: str = "text") -> dict[str, str]:
    """The notices of a table, to be given to scan(); texts of any length, MOST_TEMPLATES at most. Labels must be unique."""
    rows = table.select(label, text).limit(MOST_TEMPLATES + 1).collect()
    out = {r[0]: r[1] for r in rows if r[1]}
    if len(rows) > MOST_TEMPLATES or len({r[0] for r in rows}) < len(rows):
        raise ValueError("too many templates, or a label given twice")
    return out


def find_templates(docs: DataFrame, templates: dict[str, str], containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, key, label, share): each block's templates with the share of template words it holds; repeats stay."""
    words = _template_words(templates)
    order = word_order(docs, words)
    rank = {w: k for k, w in enumerate(order)}
    index, prefix_words = [], set()
    for label, own in words.items():
        own = sorted(own, key=rank.get)
        need = math.ceil(containment * len(own) - 1e-9)
        for pos, w in enumerate(own[: len(own) - need + 1]):
            prefix_words.add(w)
            index.append(F.struct(F.lit(w).alias("word"), F.lit(label).alias("label"), F.lit(pos).alias("pos"), F.lit(len(own)).alias("n"), F.lit(need).alias("need"), _strings(own).alias("own")))
    table = docs.sparkSession.range(1).select(F.explode(F.array(*index)).alias("t")).select("t.*")
    least = min(math.ceil(containment * len(own) - 1e-9) for own in words.values())
    step = max(len(t.split()) for t in templates.values())
    held = lambda words: F.array_intersect(_strings(order), words)
    # The explode of one element is a barrier here too: words is used twice.
    blocks = docs.where(_any_inside(F.col("text"), sorted(prefix_words))).select("doc_id", "key", F.explode(F.array(terms(F.col("text")))).alias("words"))
    blocks = blocks.where(F.size(held(F.col("words"))) >= least)
    runs = F.transform(F.sequence(F.lit(0), F.size("words") - 1, F.lit(step)), lambda at: held(F.slice("words", at + 1, F.lit(3 * step))))
    sets = blocks.select("doc_id", "key", F.explode(runs).alias("held"))
    sets = sets.where(F.size("held") >= least)
    probe = sets.select("doc_id", "key", "held", F.explode(F.array_intersect("held", _strings(sorted(prefix_words, key=rank.get)))).alias("word"))
    pairs = probe.join(F.broadcast(table), "word")
    at = F.array_position("held", F.col("word")) - 1
    # From the matched word on, block and template can share at most what either has left, plus the pos words before it.
    pairs = pairs.where((F.size("held") >= F.col("need")) & (F.least(F.size("held") - at, F.col("n") - F.col("pos")) + F.col("pos") >= F.col("need")))
    share = F.size(F.array_intersect("held", "own"))
    return pairs.where(share >= F.col("need")).select("doc_id", "key", "label", (share / F.col("n")).alias("share"))


def _places(words: Column, phrase: str) -> Column:
    """The indices at which the phrase's words begin."""
    parts = phrase.split()

    def begins(at: Column) -> Column:
        hit = F.lit(True)
        for k, w in enumerate(parts):
            hit = hit & (F.coalesce(F.get(words, at + k), F.lit("")) == F.lit(w))
        return hit

    return F.filter(F.sequence(F.lit(0), F.size(words)), begins)


def scan(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its words, base places, labels and score (the best share; 1 for a base place)."""
    base, templates = base or BASE, templates or TEMPLATES
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), F.regexp_count(text, F.lit(CASED_TERM)).alias("n"), F.explode(F.array(ascii_lower(text))).alias("text"))
    # The explode of one element is a barrier: the optimizer would else repeat the folding in every use of text.
    maybe = F.lit(False)
    for p in base:
        inside = F.lit(True)
        for w in sorted(p.split(), key=lambda w: -len(w)):
            inside = inside & F.contains(F.col("text"), F.lit(w))
        maybe = maybe | (inside & F.col("text").rlike(GAP.join(p.split())))
    # Places are sought only where the text has a phrase's words in a row; that test has no false negatives.
    hits = {p: _places(F.col("words"), p) for p in base}
    none = F.array().cast("array<int>")
    per = rows.select("doc_id", "key", F.col("n").cast("long").alias("n_words"), F.when(maybe, terms(F.col("text"))).alias("words"))
    per = per.select("doc_id", "key", "n_words", *[F.when(F.col("words").isNotNull(), hits[p]).otherwise(none).alias(f"p{k}") for k, p in enumerate(base)])
    places = F.concat(*[F.col(f"p{k}") for k in range(len(base))])
    own = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(v)) for k, v in enumerate(base.values())]), lambda x: x.isNotNull())))
    per = per.select(
        "doc_id", "key", "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), own.alias("own"),
    )
    found = find_templates(rows, templates, containment).groupBy("doc_id", "key").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    found = found.select(F.col("doc_id").alias("fid"), F.col("key").alias("fkey"), "more", "share")
    out = per.join(found, per["doc_id"].eqNullSafe(found["fid"]) & (per["key"] == found["fkey"]), "left")
    every = F.array_sort(F.array_union("own", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("own", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _sql() -> str:
    words, step = _template_words(TEMPLATES), max(len(t.split()) for t in TEMPLATES.values())
    t = ", ".join(f"('{k}', [{', '.join(repr(w) for w in v)}], {math.ceil(CONTAINMENT * len(v) - 1e-9)})" for k, v in words.items())
    place = " UNION ALL ".join(
        f"SELECT rid, i - 1 AS spot, '{label}' AS label FROM w, unnest(range(1, len(words) + 1)) AS u(i) WHERE "
        + " AND ".join(f"words[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        for phrase, label in BASE.items()
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, doc_id, regexp_extract_all(t, '{TERM}') AS words FROM d),
p AS ({place}),
b AS (SELECT rid, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list_sort(list(DISTINCT label)) AS own FROM p GROUP BY rid),
l AS (SELECT rid, list_distinct(list_slice(words, run + 1, run + {3 * step})) AS held FROM w, unnest(range(0, len(words), {step})) AS u(run)),
t(label, own, need) AS (VALUES {t}),
m AS (SELECT rid, label, len(list_intersect(held, own)) / len(own) AS share FROM l, t WHERE len(held) >= need AND len(list_intersect(held, own)) >= need),
f AS (SELECT rid, list(DISTINCT label) AS more, max(share) AS share FROM m GROUP BY rid)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(own, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (rid) LEFT JOIN f USING (rid)
"""


OP8_SQL = _sql()
