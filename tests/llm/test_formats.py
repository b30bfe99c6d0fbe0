import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docgauge.llm import license_scan, media, packing, warc
from docgauge.llm.common import scratch
from docgauge.llm.license_scan import BASE, CONTAINMENT, TEMPLATES, scan
from docgauge.llm.tokens import Encoder, default_vocabulary

# --- WARC -------------------------------------------------------------------

PAGES = [
    (5, "http://a/é?x=1\r\nX-Evil: 1", "<p>same</p>"), (3, "http://b", "<p>same</p>"), (9, None, "<p>same</p>"), (1, "http://c", None), (2, "http://d", ""),
    (7, "", "WARC/1.1\r\n\r\nfake: header\r\n\r\n"), (8, "http://e", "日本 " * 40_000), (3, "http://b", "<p>same</p>"), (None, "http://n", "<p>same</p>"), (10, "http://f", "tiny"), (11, "u", "tiny"),
]


def b32(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, sha1 string, n long")


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    index = warc.write_archives(pages(spark, PAGES).repartition(3), scratch(spark, "warc"), min_bytes=least, file_bytes=400)
    assert index.select("file").distinct().count() > 1
    got = warc.read_archives(index, block_bytes=300, gap=0).collect()
    assert len(got) == len(PAGES)
    first = defaultdict(list)
    for i, _, h in PAGES:
        first[h or ""].append(i)
    want = []
    for i, u, h in PAGES:
        h = h or ""
        low = min((x for x in first[h] if x is not None), default=None)
        again = len(h.encode()) >= least and i != low
        want.append((i, len(h.encode()), b32(h), "revisit" if again else "response", low if again else None, None if again else h.encode()))
    mine = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got]
    key = lambda r: tuple((x is None, x) for x in r[:5])
    assert sorted(mine, key=key) == sorted(want, key=key)
    assert all("\n" not in r["url"] for r in got)


def test_warc_selection_ranges_and_empty(spark):
    index = warc.write_archives(pages(spark, PAGES), scratch(spark, "warc"))
    some = warc.read_archives(index.where("page_id IN (7, 8)")).collect()
    assert sorted(r["page_id"] for r in some) == [7, 8]
    row = index.orderBy("offset").first()
    with open(row["file"].removeprefix("file://"), "rb") as f:
        raw = f.read()[row["offset"] : row["offset"] + row["length"]]
    assert zlib.decompress(raw, 31).startswith(b"WARC/1.1\r\nWARC-Type: ")
    assert warc.merged([(0, 10), (10, 5), (40, 2), (300, 1)], 30) == [(0, 42, [(0, 10), (10, 5), (40, 2)]), (300, 301, [(300, 1)])]
    assert warc.read_archives(warc.write_archives(pages(spark, []), scratch(spark, "warc"))).count() == 0


def test_damaged_record_is_found():
    raw = warc.record(1, "http://a", b"payload", 7, b32("payload"), "response", None)
    assert warc.parse(raw)[:3] == (1, "http://a", 7)
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(raw.replace(b"payload\r\n\r\n", b"paylxad\r\n\r\n"))


# --- media ------------------------------------------------------------------


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=3000).filter(lambda b: not b.endswith(b"\xff")))
def test_png_round_trip(data):
    payload = media.padded(data)
    assert len(payload) % 576 == 0 and len(payload) >= 576
    png = media.to_png(payload)
    assert media.from_png(png) == payload and payload.rstrip(b"\xff") == data


def test_media_by_digest(spark):
    texts = ["", None, "a" * 576, "é" * 1000, "x", "x", "long " * 20_000]
    docs = spark.createDataFrame([(k, t, "c<a", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, digest long")
    path = scratch(spark, "media")
    media.store_media(docs, path)
    got = {r["digest"]: r for r in media.read_media(spark, path).collect()}
    assert len(got) == len({t or "" for t in texts})
    for t in texts:
        raw = (t or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[hashlib.sha256(raw).hexdigest()]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        png = media.to_png(full)
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest())
    html = f"<p>one <b>two</b></p><figure><img src='media:sha256:{hashlib.sha256(b'x').hexdigest()}' alt='A'><figcaption>cap &amp; x</figcaption></figure>three<img src='http://u' alt='B'><script>no</script>"
    seq = media.html_segments(spark.createDataFrame([(1, html), (2, None), (3, "plain <i")], "page_id long, html string"))
    rows = media.interleave(seq, media.read_media(spark, path), "page_id")
    one = sorted((r for r in rows.collect() if r["page_id"] == 1), key=lambda r: r["position"])
    assert [(r["kind"], r["text"], r["caption"], r["n_bytes"]) for r in one] == [("text", "one two", None, None), ("media", None, "cap & x", 1), ("text", "three", None, None), ("media", None, "B", None)]
    assert {r["page_id"]: [x["position"] for x in r["sequence"]] for r in media.sequences(rows, "page_id").collect()}[1] == [0, 1, 2, 3]


def test_pages_are_parsed_once(spark, tmp_path):
    spark.createDataFrame([(1, "alpha", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    told = media.interleave(media.html_segments(media.document_pages(spark.read.parquet(f"{tmp_path}/documents.parquet"))), spark.createDataFrame([], media.MEDIA), "page")
    assert told._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def plain(html):
    return [(x["kind"], x["text"] or x["caption"]) for x in media.segments(html)]


def test_segments_of_broken_pages():
    assert plain("a<figcaption>b<p>c</p>d") == [("text", x) for x in "abcd"]
    assert plain("<noscript>x<p>tail") == [("text", "x"), ("text", "tail")]
    assert plain("<div><noscript>x</div>tail<noscript>gone<img src='u'></noscript>end") == [("text", "x"), ("text", "tailend")]
    assert plain("<figure><figcaption>first</figcaption><img src='u' alt='no'><img src='v'></figure>z") == [("media", "first"), ("media", "first"), ("text", "z")]
    assert plain("<figure>in<figcaption>alone</figure>z<p>y") == [("text", "in"), ("text", "alone"), ("text", "z"), ("text", "y")]
    assert plain("<figure><img src='u'><figcaption>open<h2>head</h2>text") == [("media", "open"), ("text", "head"), ("text", "text")]
    assert plain("<p>one<figure><img src='u'><figcaption>c <b>d</b><p>e</figcaption>more</figure>two") == [("text", "one"), ("media", "c d e"), ("text", "more"), ("text", "two")]


def test_media_query_equals_brute_force(spark, tmp_path):
    rows = [(1, "alpha", "en", "a<b & 'c'"), (2, None, None, None), (2, "alpha", "de", "src"), (None, "", "fr", "src"), (4, "w " * 50_000, "en", "alpha"), (1, "alpha", "en", "a<b & 'c'")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")

    def stored(text):
        full = media.padded((text or "").encode())
        png = media.to_png(full)
        return len((text or "").encode()), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]), len(png), hashlib.sha256(png).hexdigest(), media.features(full)

    want = []
    for i, text, lang, source in rows:
        before = int(bool(lang))
        want.append((i, *stored(text), before, f"from {source or ''}".strip(), before + 3))
    got = media.op6_media_columns(spark, str(tmp_path))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:-1] for r in got.collect()), key=key) == sorted(want, key=key)
    clash = spark.createDataFrame([(1, "<p>x", "kept")], "page_id long, html string, segments string")
    out = media.html_segments(clash).collect()[0]
    assert out["doc"]["segments"] == "kept" and out["segments"][0]["text"] == "x"


def test_media_query_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert media.op6_media_columns(spark, str(tmp_path)).count() == 0


# --- licenses ---------------------------------------------------------------

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))


def brute_scan(text):
    w, spots, own = words(text), [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        found = [k for k in range(len(w)) if w[k : k + len(p)] == p]
        spots += found
        own |= {label} if found else set()
    best, more = 0.0, set()
    n = max(len(words(t)) for t in TEMPLATES.values())
    for at in range(0, len(w), n):
        held = set(w[at : at + 3 * n])
        for label, t in TEMPLATES.items():
            need = set(words(t))
            share = len(held & need) / len(need)
            if share >= CONTAINMENT:
                best, more = max(best, share), more | {label}
    return len(w), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted(own)), ",".join(sorted(own | more)), 1.0 if spots else best


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [None, "", "CC-BY", "cc by cc.by CC\nBY", "ccby cc-bye", "All  RIGHTS, reserved!", "general public\nlicense", "İcc by ß日本 K", "x" * 200_000 + " cc by", "all rights", "licensed under K"]
    for t in TEMPLATES.values():
        w = t.split()
        for drop in (0, 1, 2, 4):
            x = list(w)
            for _ in range(min(drop, len(x) - 1)):
                x.pop(rng.randrange(len(x)))
            rng.shuffle(x)
            rows.append("noise words here\n" + " ".join(x).upper() + rng.choice(["", " and more words of a line"]))
    docs = [(k, t) for k, t in enumerate(rows)] + [(3, rows[3]), (3, "other"), (None, rows[3])]
    got = scan(spark.createDataFrame([(i, t, "n", 1) for i, t in docs], "doc_id long, text string, words string, key long").repartition(3)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(((i, *brute_scan(t)) for i, t in docs), key=key)
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_wrapped_license_notices_are_found(spark):
    bsd = "Copyright X.\n\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that"
    gpl = "# This program is free software; you can redistribute it and/or modify\r\n# it under the terms of the GNU General Public License as published by\r\n# the Free Software Foundation"
    narrow = "\n".join(TEMPLATES["mit"].split())
    texts = [bsd, "a b\n" * 300 + bsd, gpl, narrow, "\n".join(["Redistribution and use in source and binary", *["other words"] * 60, "forms with or without modification are permitted"])]
    got = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["labels"], r["score"]) for r in got} == {0: ("bsd", 1.0), 1: ("bsd", 1.0), 2: ("gpl,gpl-program", 1.0), 3: ("mit", 1.0), 4: ("", 0.0)}


def test_license_scan_of_long_lines_equals_sql_and_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    pool = sorted({x for t in TEMPLATES.values() for x in words(t)} | {f"w{k}" for k in range(400)})
    long_line = " ".join(rng.choices(pool, k=100_000))
    mit = TEMPLATES["mit"].split()
    texts = [" ".join(rng.choices(pool, k=3000)), long_line, f"{long_line} {' '.join(mit)} {long_line}", "\n".join([" ".join(mit[:5]), " ".join(mit[5:9]), " ".join(mit[9:12]), " ".join(mit[12:])]), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    monkeypatch.setattr(license_scan, "read", lambda *_: docs)
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan.op8_license_scan(spark, "").collect()}
    assert got == {k: brute_scan(t) for k, t in enumerate(texts)}
    assert got[0][5] == "" and got[3][5:] == ("mit", 1.0) and "mit" in got[2][5]
    documents = docs.where("length(text) < 100000 OR text IS NULL").toArrow()  # noqa: F841
    cur = duckdb.connect().execute(license_scan.OP8_SQL)
    names = [x[0] for x in cur.description]
    rows = cur.fetchall()
    assert got.keys() - {1, 2} == {r[names.index("doc_id")] for r in rows}
    assert {r[names.index("doc_id")]: tuple(r[names.index(c)] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) for r in rows}.items() <= got.items()


def test_templates_of_a_table(spark):
    full = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction " * 3
    table = license_scan.templates_of(spark.createDataFrame([("own", full), ("short", "do not copy this"), ("none", None)], "label string, text string"))
    assert set(table) == {"own", "short"}
    docs = spark.createDataFrame([(1, f"x {full.upper()} y"), (2, "do\nnot copy -- this"), (3, "nothing")], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in scan(docs, templates=table).collect()} == {1: "own", 2: "short", 3: ""}
    with pytest.raises(ValueError, match="twice"):
        license_scan.templates_of(spark.createDataFrame([("a", "x"), ("a", "y")], "label string, text string"))


# --- packing ----------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=40), st.booleans())
def test_pack_group_fills_windows(lengths, last):
    sequences, waits = packing.pack_group(lengths, last=last)
    seen = defaultdict(list)
    for tier, pieces in sequences:
        assert sum(n for _, _, n in pieces) == tier and tier & (tier - 1) == 0 and tier <= 4096
        for doc, start, n in pieces:
            seen[doc].append((start, n))
    for doc, start, n in waits:
        seen[doc].append((start, n))
    assert not (last and waits)
    for doc, total in enumerate(lengths):
        at = 0
        for start, n in sorted(seen[doc]):
            assert start == at
            at += n
        assert at == total
    assert len(packing.step_groups(sequences)) == len(sequences)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(default_vocabulary())
    rng = random.Random(2)
    texts = [None, "", "Hello, world!", "日本 <|endoftext|> x\x1cy", "word " * 9000, *[" ".join(rng.choices(["alpha", "beta", "it's", "Été", "12"], k=rng.randrange(1, 900))) for _ in range(60)]]
    docs = [*enumerate(texts), (2, texts[2]), (None, "no id")]
    got = packing.pack(spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, length long").repartition(2), group_tokens=20_000).collect()
    ids = [(i, np.array([*enc.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t in docs]
    left = defaultdict(int)
    for i, x in ids:
        left[i] += len(x)
    by_id = dict(ids)
    seqs = defaultdict(list)
    for r in got:
        x = by_id[r["doc_id"]]
        assert r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes())
        left[r["doc_id"]] -= r["length"]
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert not any(left.values())
    for pieces in seqs.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packing_of_a_document_longer_than_a_group(spark):
    text = "word " * 120_000
    rows = packing.pack(spark.createDataFrame([(1, text), (2, "short one"), (3, text)], "doc_id long, text string"), group_tokens=50_000).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    for own in pieces.values():
        at = 0
        for start, n, total in sorted(own):
            assert start == at
            at += n
        assert at == total
    assert len(pieces) == 3


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB 's.,!?éßΣİ1٣日\U0001f600\x00\x1c\x7f\n\xa0<|>", max_size=60))
def test_encoder_equals_tokenizer(text):
    global _ENC
    try:
        _ENC
    except NameError:
        _ENC = Encoder(default_vocabulary())
    assert _ENC.ids([text])[0].tolist() == _ENC.tokenizer.encode(text, add_special_tokens=False).ids


def test_documents_keep_order_columns(spark):
    out = packing.pack(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.agg(F.sum("length")).first()[0] == 3
