"""Quality, language, nearest neighbours: held-out accuracy, recall, and odd inputs."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import language_id, quality
from ledgerline.llm.nearest import nearest
from ledgerline.llm.queries import op4_quality, op5_nearest, op7_language_id
from tests.llm.odd import frame

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = op4_quality(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in held]) > 0.93


def test_quality_odd(spark):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0), (4, None), (None, 1), (3, 0)], "doc_id bigint, quality int")
    docs = frame(spark)
    model = quality.fit(docs, labels)
    out = quality.score(docs, model)
    assert out.count() == docs.count() and sorted(out.columns) == sorted(docs.columns)
    assert out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality.fit(docs, labels.where("quality = 1")) is None
    more = labels.union(spark.createDataFrame([(9, 0), (9, 1)], "doc_id bigint, quality int"))  # both labels: neither counts
    assert (quality.fit(docs, more).weights == model.weights).all()
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(frame(spark, []), model).count() == 0


def test_language_held_out(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = op7_language_id(spark, SF).collect()
    held = [lang[r["doc_id"]] == r["lang_pred"] for r in got if r["held_out"]]
    assert np.mean(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd(spark):
    docs = frame(spark)
    model = language_id.fit(docs)
    again = language_id.fit(docs.unionByName(docs).where("lang IS NOT NULL"), per_language=5)
    assert again.languages == model.languages
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.predict(docs, model).collect()}
    assert {(100, "und"), (101, "und"), (102, "und")} <= got
    assert all(p in ("en", "fr", "und") for _, p in got)
    assert language_id.predict(docs, language_id.fit(frame(spark, []))).where("lang_pred <> 'und'").count() == 0
    many = {f"l{k:03}": np.arange(k * 50, k * 50 + 50, dtype=np.uint32) for k in range(100)}  # more than one word of bits
    f = language_id.LanguageFilter(many)
    mask = [bool(f.slots[70 // 64][a] & f.slots[70 // 64][b] & np.uint64(1 << 6)) for a, b in zip(*f._at(many["l070"]))]
    assert all(mask)


def truth(vectors, k):
    fine = {i: np.array(v, float) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8}
    out = {}
    for q in fine:
        if q % 20 == 0:
            near = sorted(((-float((fine[q] * fine[i]).sum()), i) for i in fine if i != q))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def test_nearest_exact_when_small(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=8).tolist()) for i in range(120)]
    rows += [(k, rows[0][1]) for k in range(200, 300)]  # a crowd of equal vectors
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [1.0, None] + [0.0] * 6), (404, [float("nan")] * 8), (405, [1.0, 2.0]), (420, [float("inf")] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<double>").repartition(2)
    got = {}
    for r in nearest(df, df.where("vec_id % 20 = 0"), k=10, pivots=16, prefix=8).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = truth(rows, 10)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(abs(s - dict(want[0] + got[0])[i]) < 1e-12 for i, s in got[0])
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]]  # ties among equal vectors to smaller ids
    assert nearest(df.where("vec_id < 0"), df.where("vec_id < 0")).count() == 0


def test_nearest_repeated_ids(spark):
    """An id with several vectors shows once, at its best score; copies of a row change nothing."""
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=8).tolist()) for i in range(60)]
    rows += rows[:30] + [(7, (np.array(rows[0][1]) * (1 + k / 10)).tolist()) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<double>").repartition(3)
    got = {}
    for r in nearest(df, df.where("vec_id % 20 = 0"), k=10, pivots=64, prefix=8, share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    asked = dict(rows[:60])
    for q in (0, 20, 40):
        best = {}
        for i, v in rows:
            if i != q:
                best[i] = max(best.get(i, -9e9), float(np.dot(v, asked[q])))
        assert got[q] == [(i, round(s, 9)) for s, i in sorted((-s, i) for i, s in best.items())[:10] for s in [-s]]


def test_nearest_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    got = op5_nearest(spark, sf).groupBy("query_id").agg(F.collect_set("vec_id").alias("v")).collect()
    hits = total = 0
    for r in got:
        k = int(np.flatnonzero(ids == r["query_id"])[0])
        s = x @ x[k]
        s[k] = -9
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hits += len(best & set(r["v"]))
        total += 20
    assert len(got) == (ids % 20 == 0).sum() and hits / total >= 0.9


def _many(kind, n=20000, d=64):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "norms":
        x *= rng.lognormal(0, 0.3, n)[:, None]
    if kind == "hot":  # a third of the rows in one crowd
        x[: n // 3] = x[0] + 0.05 * rng.normal(size=(n // 3, d))
        x = x[rng.permutation(n)]
    return x


@pytest.mark.parametrize("kind", ["uniform", "norms", "hot"])
def test_nearest_recall_large_shard(spark, kind):
    x = _many(kind)
    table = pa.table({"vec_id": np.arange(len(x)), "vector": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))})
    df = spark.createDataFrame(table).coalesce(1)  # one shard
    asked = np.arange(0, len(x), 200)
    got = {i: set() for i in asked.tolist()}
    for r in nearest(df, df.where("vec_id % 200 = 0"), k=20).collect():
        got[r["query_id"]].add(r["vec_id"])
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    recall = [len(set(np.argsort(-s[j])[:20].tolist()) & got[i]) / 20 for j, i in enumerate(asked.tolist())]
    print(kind, "recall", np.mean(recall), "lowest tenth", np.quantile(recall, 0.1))
    assert np.mean(recall) >= 0.9


def test_features_plain():
    """The vectorised features against a plain reading of the same text."""
    import math
    import re

    kinds = ["upper", "lower", "digit", "high", "blank", "stop", "other", "control"]

    def kind(b):
        c = chr(b)
        return kinds.index("high" if b >= 128 else "upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit() else "blank" if b in (9, 10, 11, 12, 13, 32) else "stop" if c in ".," else "control" if b < 32 or b == 127 else "other")

    texts = ["Hello, hello world. 12!", "", "éé aa aa aa", "x" * 600 + " y", "a\x00b\tc", None, "One one ONE two"]
    got = quality.features(pa.array(texts))
    for t, row in zip(texts, got):
        raw = (t or "").encode()
        seq = [kind(b) for b in raw]
        n = max(1, len(raw))
        assert np.allclose(row[:8], [seq.count(k) / n for k in range(8)])
        pairs = [(a, b) for a, b in zip(seq, seq[1:])]
        assert np.allclose(row[8:72], [pairs.count((a, b)) / n for a in range(8) for b in range(8)])
        words = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
        low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
        each, log = max(1, len(words)), math.log1p(len(words))
        base = 72 + sum(kind(b) == 6 for b in range(256))
        most = max((low.count(w) for w in low), default=0)
        again = sum(a == b for a, b in zip(low, low[1:]))
        want = [sum(map(len, words)) / each / 10, sum(min(len(w), 100) ** 2 for w in words) / each / 100, len(set(low)) / each, len(set(low)) / each * log / 5, most / each, again / each, log / 5, float(not words)]
        assert np.allclose(row[base : base + 8], want)


def test_language_plain(spark, sf):
    """Shares by the bit-sliced filter, less chance, against shares by plain sets of the same n-grams."""
    docs = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect() if r["text"]]
    known = {}
    for lang, t in docs[: len(docs) // 2]:
        known.setdefault(lang, set()).update(language_id._grams([t])[0].tolist())
    model = language_id.LanguageFilter({k: np.array(sorted(v), np.uint32) for k, v in known.items()})
    texts = [t for _, t in docs]
    shares = model.shares(texts)
    far = 0
    for t, row in zip(texts, shares):
        grams = language_id._grams([t])[0].tolist()
        plain = [sum(g in known[k] for g in grams) / max(1, len(grams)) for k in model.languages]
        far += np.abs(row - plain).max() > 0.1
        if len(grams) > 100 and sorted(plain)[-1] - sorted(plain)[-2] > 0.2:
            assert row.argmax() == int(np.argmax(plain))
    assert far <= 0.1 * len(texts)
