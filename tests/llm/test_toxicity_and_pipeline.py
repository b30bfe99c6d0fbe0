import random
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from docgauge.llm import toxicity
from docgauge.llm.queries import ORACLES, QUERIES

CLEAN = [f"word{k}" for k in range(200)]
BAD = ["vile", "nasty", "horrid"]


def corpus(spark, n=600, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        bad = k % 8 == 0
        w = rng.choices(CLEAN, k=rng.randrange(5, 80)) + (rng.choices(BAD, k=rng.randrange(1, 3)) if bad else [])
        rng.shuffle(w)
        docs.append((k, " ".join(w), "en", f"src{k % 4}", len(w)))
        if k % 2 == 0 or k % 3 == 0:
            labels.append((k, 0 if k % 5 == 0 else 1, int(bad)))
    docs += [(n, None, "en", None, 0), (n + 1, "", "en", "src1", 0), (n + 2, docs[1][1], "en", "src2", 3), (n + 3, docs[1][1] + " ", "en", "src2", 3)]
    labels += [(None, 1, 1), (2, None, 1), (3, 1, 0), (3, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_chain_finds_held_out_toxic_documents(spark):
    docs, labels = corpus(spark)
    chain = toxicity.fit(docs, labels.where("doc_id < 300 OR doc_id IS NULL"))
    assert chain.names == ["low_quality", "toxic", "toxic_low_quality"]
    assert [len(d) for d, _ in chain.chain] == [0, 1, 2]  # each later model sees the earlier log odds
    rows = {r["doc_id"]: r for r in toxicity.score(docs, chain).collect()}
    assert len(rows) == docs.count()
    held = [k for k in range(300, 600)]
    found = {k for k in held if rows[k]["p_toxic"] >= 0.5}
    true = {k for k in held if k % 8 == 0}
    assert len(found & true) >= 0.95 * len(true) and len(found - true) <= 3
    assert all(0 <= r[f"p_{c}"] <= 1 for r in rows.values() for c in chain.names)
    kept = toxicity.without_toxic(docs, chain)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in rows.items() if r["p_toxic"] < 0.5}


def brute_chain(docs, labels, folds):
    """The chain in plain loops and dense matrices: {doc: [probabilities]} for docs (id, text), labels {id: (quality, toxic)}."""
    sets = {}
    for i, t in docs:
        w = set(re.findall(r"\w+", (t or "").lower()))
        sets[i] = w | {x[:5] + "*" for x in w if len(x) > 5}
    ids = sorted(i for i in labels if i in sets)
    ys = [[int(labels[i][0] == 0) for i in ids], [int(labels[i][1] == 1) for i in ids], [int(labels[i] == (0, 1)) for i in ids]]
    n, vocabulary = len(ids), []
    for f in sorted(set().union(*(sets[i] for i in ids))):
        seen = sum(f in sets[i] for i in ids)
        for y in ys:
            pos, both = sum(y), sum(v for i, v in zip(ids, y) if f in sets[i])
            spread, more = seen * (n - seen) * pos * (n - pos), both * n - seen * pos - n / 2
            if spread > 0 and more > 0 and n * more * more / spread >= 25:
                vocabulary.append(f)
                break
    x = np.array([[float(f in sets[i]) for f in vocabulary] for i in ids])
    every = np.array([[float(f in sets[i]) for f in vocabulary] for i in sets])
    fold = np.array([folds[i] for i in ids])
    prev, prev_all, out = np.zeros((n, 0)), np.zeros((len(sets), 0)), []

    def train(a, y):
        rate = min(max(y.mean(), 0.5 / (len(y) + 1)), 1 - 0.5 / (len(y) + 1))
        w, b = np.zeros(a.shape[1]), float(np.log(rate / (1 - rate)))
        m, v = np.zeros(a.shape[1] + 1), np.zeros(a.shape[1] + 1)
        for t in range(1, 251):
            r = (1 / (1 + np.exp(-(a @ w + b))) - y) / len(y)
            g = np.append(a.T @ r + 5e-5 * w, r.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = 0.12 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
            w, b = w - step[:-1], b - step[-1]
        return w, b

    for y in map(np.array, ys):
        a, z = np.column_stack([x, prev]), np.zeros(n)
        for f in set(fold):
            w, b = train(a[fold != f], y[fold != f])
            z[fold == f] = a[fold == f] @ w + b
        w, b = train(a, y)
        told = np.clip(np.column_stack([every, prev_all]) @ w + b, -12, 12)
        out.append(1 / (1 + np.exp(-told)))
        prev, prev_all = np.column_stack([prev, np.clip(z, -12, 12)]), np.column_stack([prev_all, told])
    return dict(zip(sets, zip(*out))), vocabulary


def test_toxicity_query_equals_brute_force(spark, tmp_path):
    docs, labels = corpus(spark, 240)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    folds = {r["doc_id"]: r["f"] for r in docs.selectExpr("doc_id", f"CAST(pmod(xxhash64('fold', doc_id), {toxicity.FOLDS}) AS INT) AS f").collect()}
    told = {}
    for r in labels.dropna().collect():
        old = told.get(r["doc_id"], (1, 0))
        told[r["doc_id"]] = (min(old[0], r["quality"]), max(old[1], r["toxic"]))
    want, vocabulary = brute_chain(rows, told, folds)
    got = toxicity.op2_toxicity(spark, str(tmp_path)).collect()
    assert vocabulary and len(got) == len(rows)
    for r in got:
        p = [r["p_low_quality"], r["p_toxic"], r["p_toxic_low_quality"]]
        assert np.allclose(p, want[r["doc_id"]], atol=2e-3) and r["is_toxic"] == (p[1] >= 0.5), r["doc_id"]


def test_repeated_ids_do_not_exceed_the_bound(spark):
    docs, labels = corpus(spark, 60)
    many = docs.unionByName(docs.where("doc_id = 8").crossJoin(spark.range(300)).drop("id"))
    assert len(toxicity.fit(many, labels, max_labelled=20).labels) <= 20


def test_chain_without_labels_and_documents(spark):
    docs, labels = corpus(spark, 40)
    flat = toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()
    assert len({r["p_toxic"] for r in flat}) == 1
    one = toxicity.fit(docs, labels.where("toxic = 0"))
    assert all(r["p_toxic"] < 0.5 for r in toxicity.score(docs, one).collect())
    assert toxicity.score(docs.limit(0), one).count() == 0


def test_out_of_fold_values_come_from_other_folds():
    rng = np.random.default_rng(1)
    rows = [np.array([k]) for k in range(60)]  # each row has a feature of its own: only its own label could teach it
    labels = np.column_stack([rng.integers(0, 2, 60), rng.integers(0, 2, 60)])
    _, oof = toxicity.fit_chain(rows, labels, np.arange(60) % 5, 60)
    assert abs(np.corrcoef(oof[:, 0], labels[:, 0])[0, 1]) < 0.5


def test_bound_of_labelled_rows(spark):
    docs, labels = corpus(spark, 200)
    assert len(toxicity.fit(docs, labels, max_labelled=30).labels) <= 30


def test_pipeline_stages(spark, tmp_path):
    docs, labels = corpus(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert out.columns == docs.columns
        if name == "exact_dedup":
            texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in out.collect()]
            assert max(Counter(texts).values()) == 1
        if name in ("exact_dedup", "near_dedup"):
            assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in now.collect()}
        now = out
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert last.count() == now.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_equals_brute_force(spark, tmp_path):
    from test_exact_and_mixing import fill
    from test_joins import brute_components
    from tokenizers import Tokenizer

    from docgauge.llm.tokens import default_vocabulary

    docs, labels = corpus(spark, 150)
    base = [f"own{k}" for k in range(40)]
    more = [(900 + k, " ".join([*base[:38], f"x{k}", f"y{k}"]), "en", "src1", 40) for k in range(4)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r["doc_id"]: (r["text"], r["source"]) for r in docs.collect()}
    folds = {r["doc_id"]: r["f"] for r in docs.selectExpr("doc_id", f"CAST(pmod(xxhash64('fold', doc_id), {toxicity.FOLDS}) AS INT) AS f").collect()}
    told = {}
    for r in labels.dropna().collect():
        old = told.get(r["doc_id"], (1, 0))
        told[r["doc_id"]] = (min(old[0], r["quality"]), max(old[1], r["toxic"]))
    p, _ = brute_chain([(i, t) for i, (t, _) in rows.items()], told, folds)
    left = sorted(i for i in rows if p[i][1] < 0.5)
    seen, wants = set(), [set(left)]
    left = [i for i in left if (n := re.sub(r"[\x20\x09-\x0D]+", " ", rows[i][0] or "")) not in seen and not seen.add(n)]
    wants.append(set(left))
    left = [i for i, _, c in brute_components([(i, rows[i][0]) for i in left]) if i == c]
    wants.append(set(left))
    assert len(wants[0]) < len(rows) and len(wants[1]) < len(wants[0]) and len(wants[2]) < len(wants[1])
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES, wants):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        got = [r["doc_id"] for r in now.collect()]
        assert len(got) == len(set(got)) and set(got) == want, name
    size = Counter()
    for i in left:
        size[rows[i][1]] += len((rows[i][0] or "").split())
    mixed = corpus_pipeline.STAGES[3][1](spark, now, str(tmp_path)).collect()
    taken = Counter()
    for r in mixed:
        assert rows[r["doc_id"]] == (r["text"], r["source"])
        taken[r["source"]] += len(r["text"].split())
    for s, t in fill(size).items():
        assert abs(taken[s] - t) <= max(3, 0.01 * t), (s, taken[s], t)
    enc = Tokenizer.from_file(default_vocabulary())
    tokens = sum(len(enc.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.groupBy().sum("length").first()[0] == tokens


def test_pipeline_without_rows_and_with_clashing_names(spark, tmp_path):
    docs, labels = corpus(spark, 30)
    odd = docs.selectExpr("*", "1 AS size", "'a' AS doc", "true AS hit", "'k' AS __row", "2 AS k0")
    for name, d, y in (("none", docs.limit(0), labels.limit(0)), ("unlabelled", odd, labels.limit(0))):
        path = f"{tmp_path}/{name}"
        d.write.parquet(f"{path}/documents.parquet")
        y.write.parquet(f"{path}/labels.parquet")
        now = spark.read.parquet(f"{path}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, path)
            assert k == 4 or out.columns == d.columns
            out.write.parquet(f"{path}/{k}")
            now = spark.read.parquet(f"{path}/{k}")
        assert (now.count() == 0) == (name == "none")


def test_registered_names():
    assert [int(n.split("_")[0][2:]) for n in QUERIES] == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_oracles_agree(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, d)
        cur = con.execute(sql)
        names = [x[0] for x in cur.description]
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(got.columns) == sorted(names), name
        assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(cur.fetchall(), key=key), name
