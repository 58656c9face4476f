"""Decontamination, mixing and the pipeline against brute force."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm.decontaminate import FMIndex, Windows, decontaminate, find_leaks, remove_spans, shard_hits, split_words
from ledgerline.llm.mixing import exponent, mix, word_count
from ledgerline.llm.queries import op8_mixing, op9_decontamination, queries
from tests.llm.odd import documents, frame


def leak_truth(texts, items, length):
    windows = defaultdict(set)
    for i, t in items:
        w = split_words(t)
        for k in range(max(1, len(w) - length + 1) if w else 0):
            windows[tuple(w[k : k + length])].add(str(i))
    out = []
    for t in texts:
        w, hit, own = split_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found:
                    hit |= set(range(k, k + n))
                    own |= found
        out.append((len(w), hit, sorted(own)))
    return out


def test_shards():
    rng = random.Random(7)
    for _ in range(120):
        v, length = ["a", "B", "c", "dé", "e1"][: rng.randint(1, 5)] + ["zz"], rng.randint(1, 5)
        make = lambda n: rng.choice([" ", ", ", " - "]).join(rng.choice(v) for _ in range(rng.randint(0, n)))  # noqa: E731,B023
        items = [(k, None if rng.random() < 0.1 else make(9)) for k in range(rng.randint(0, 6))]
        texts = [make(60) if rng.random() > 0.1 else rng.choice([None, ""]) for _ in range(rng.randint(1, 8))]
        counts, spans, own = shard_hits(texts, Windows([(str(i), t) for i, t in items], length))
        got = [(n, {x for p, q in s for x in range(p, q)}, sorted(o)) for n, s, o in zip(counts, spans, own)]
        assert got == leak_truth(texts, items, length)


def test_index():
    import numpy as np

    rng = np.random.default_rng(2)
    s = rng.integers(1, 4, 500)
    index = FMIndex(s, 3, sample=8)
    for n in (1, 2, 5):
        for _ in range(20):
            p = rng.integers(1, 4, n)
            lo, hi = index.search(p[None, :])
            want = [k for k in range(len(s) - n + 1) if (s[k : k + n] == p).all()]
            assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_leaks(spark, block_bytes):
    rows = documents()
    items = [(1, rows[0][1][20:160]), (2, "One."), (3, None), (4, "..."), (5, rows[5][1]), (6, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(((r["doc_id"], r["text"] or ""), r["n_words"], {x for s in r["spans"] for x in range(s["from"], s["to"])}, r["items"]) for r in find_leaks(frame(spark), benchmark, 6, block_bytes).collect())
    want = sorted(((r[0], r[1] or ""), n, hit, own) for r, (n, hit, own) in zip(rows, leak_truth([r[1] for r in rows], items, 6)))
    assert [g[:2] for g in got] == [w[:2] for w in want] and [(g[2], g[3]) for g in got] == [(w[2], w[3]) for w in want]
    clean = decontaminate(frame(spark), benchmark, 6, block_bytes)
    assert clean.columns == frame(spark).columns and clean.count() == len(rows)
    assert all(not x["spans"] for x in find_leaks(clean, benchmark, 6).collect())
    assert find_leaks(frame(spark), benchmark.where("item_id < 0")).where("size(items) > 0").count() == 0
    assert find_leaks(frame(spark, []), benchmark).count() == 0
    unnamed = spark.createDataFrame([*items, (None, rows[0][1][20:160])], "item_id bigint, text string")
    found = {tuple(r["items"]) for r in find_leaks(frame(spark), unnamed, 6, block_bytes).collect()}
    assert ("1", None) in found and ("1",) not in found
    assert remove_spans("A b, c! d", [(1, 3)]) == "A ! d" and remove_spans(None, [(0, 1)]) is None


def test_cuts_that_make_windows(spark):
    """Each cut brings the next pair together, and the pairs lie in different blocks."""
    items = [(k, f"p{k} q{k}") for k in range(8)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    text = "stays " + " ".join(f"p{k}" for k in range(8)) + " " + " ".join(f"q{k}" for k in reversed(range(8))) + " too"
    clean = decontaminate(spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string").coalesce(1), benchmark, 2, 12)
    got = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert got[2] is None and split_words(got[1]) == [b"stays", b"too"]


def test_exponent(spark):
    totals = spark.createDataFrame([("a", 1000.0), ("b", 100.0), ("c", 10.0)], "key string, n double")
    n = [1000.0, 100.0, 10.0]

    def entropy(a):
        w = [x**a for x in n]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    a = exponent(totals, entropy=0.8)
    assert abs(entropy(a) - 0.8) < 1e-6
    a = exponent(totals, max_repeats=3.0)
    assert abs((1000 / 10) ** (1 - a) - 3) < 1e-6
    a = exponent(totals, max_repeats=4.0, budget=1110)
    assert max(x ** (a - 1) / sum(y**a for y in n) * 1110 for x in n) <= 4 + 1e-6
    assert exponent(totals, max_repeats=1000.0) < 1e-6 and exponent(totals.where("n < 0"), max_repeats=2.0) == 1.0


def check_mix(rows, given, limit, block_tokens):
    tokens = Counter()
    for (i, s, n) in given:
        tokens[s] += n
    used = defaultdict(Counter)
    for r in rows:
        used[r["source"]][r["copy"]] += r["n_tokens"]
    top = max(tokens.values())
    least = max(n for _, _, n in given)
    for s, n in tokens.items():
        assert used[s][0] == n  # every document once
        assert sum(used[s].values()) <= limit * n + least
    weights = {r["source"]: r["weight"] for r in rows}
    assert abs(sum(weights.values()) - 1) < 1e-9
    total = sum(sum(u.values()) for u in used.values())
    for s in tokens:
        assert abs(sum(used[s].values()) - weights[s] / weights[max(tokens, key=tokens.get)] * top) <= least + 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["block"]].append(r["slot"])
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in slots.values())
    return total


def test_mix(spark):
    docs = frame(spark)
    given = [(i, s, max(1, len((t or "").split()))) for i, t, _, s, _ in documents()]
    rows = mix(docs, word_count(), max_repeats=2.0, block_tokens=500, buckets=7).collect()
    check_mix(rows, given, 2.0, 500)
    again = mix(docs, word_count(), max_repeats=2.0, block_tokens=500, buckets=3).collect()
    key = lambda rs: sorted((str(r["doc_id"]), str(r["source"]), r["copy"], r["n_tokens"], r["block"]) for r in rs)
    assert key(rows) == key(again)  # buckets are no more than a way to add up
    assert mix(frame(spark, []), word_count()).count() == 0
    small = mix(docs, word_count(), entropy=0.5, max_repeats=None, budget=300.0, block_tokens=100)
    assert abs(small.agg(F.sum("n_tokens")).first()[0] - 300) < 5 * max(n for _, _, n in given)


def test_queries_mix_and_leaks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    from ledgerline.llm.token_output import Encoder

    raw = Encoder(corpus_pipeline.tokenizer(corpus_pipeline.VOCABULARY))._raw([r["text"] for r in docs])
    given = [(r["doc_id"], r["source"], len(x) // 2 + 1) for r, x in zip(docs, raw)]
    check_mix(op8_mixing(spark, sf).collect(), given, 1.5, 1 << 20)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {r["doc_id"]: (n, len(h), len(o)) for r, (n, h, o) in zip(docs, leak_truth([r["text"] for r in docs], items, 10))}
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in op9_decontamination(spark, sf).collect()} == want


def test_pipeline(spark, sf):
    """Stage by stage: what each keeps follows from its own input by brute force."""
    import numpy as np

    from ledgerline.llm.common import Scratch
    from ledgerline.llm.token_output import Encoder
    from tests.llm.test_dedup import near_truth

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "token_output"]
    docs, scratch = spark.read.parquet(f"{sf}/documents.parquet"), Scratch(spark, "test")
    columns, kept = docs.columns, {}
    bad = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.table(stage(spark, docs, sf), f"{k}")
        after = docs.collect()
        kept[name] = after
        if name != "token_output":
            assert docs.columns == columns
        if name == "quality":
            labelled = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
            right = sum((i in bad) == (i in gone) for i in labelled)
            assert right >= 0.9 * len(labelled)
        if name == "near_dedup":
            want = {i for i, _, _, k in near_truth([tuple(r) for r in before], 5, 80) if k}
            assert {r["doc_id"] for r in after} == want
        if name == "decontamination":
            assert len(after) == len(before) and not any(h for _, h, _ in leak_truth([r["text"] for r in after], items, 10))
            clean = {r["doc_id"]: r["text"] for r, (_, h, _) in zip(before, leak_truth([r["text"] for r in before], items, 10)) if not h}
            assert all(r["text"] == clean[r["doc_id"]] for r in after if r["doc_id"] in clean)
        if name == "mixing":
            assert {tuple(r) for r in after} == {tuple(r) for r in before}
        if name == "token_output":
            raw = Encoder(__import__("public_tokenizers").path("word_bpe_49k.json"))._raw
            n = {r["doc_id"]: len(np.frombuffer(raw([r["text"]])[0], "<u2")) + 1 for r in before}
            assert sorted((r["doc_id"], r["n_tokens"]) for r in after) == sorted((r["doc_id"], n[r["doc_id"]]) for r in before)
        before = after
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, kept["token_output"]))
    starts = sorted((r["start"], r["n_tokens"]) for r in kept["token_output"])
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0


def test_stages_on_odd_rows(spark, sf, tmp_path):
    """Nulls, repeats, long and empty texts, columns with the names that the stages use inside; then empty tables."""
    from ledgerline.llm.common import Scratch

    scratch, clash = Scratch(spark, "odd"), ["place", "places", "row", "copy", "predicted", "score"]
    rows = documents() + [(None, "no id at all", "en", "s0", 5)]
    odd = frame(spark, rows).withColumns({c: F.lit(f"own {c}") for c in clash})
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = scratch.table(stage(spark, odd, sf), f"odd-{k}")
        assert out.columns == odd.columns
        kept = out.collect()
        assert kept and all(r[c] == f"own {c}" for r in kept for c in clash)
        if name in ("decontamination", "mixing"):
            assert {r["doc_id"] for r in kept} == {r[0] for r in rows}
            assert len(kept) >= len(rows)
    assert corpus_pipeline.token_output(spark, odd, sf).count() == len(rows)
    none = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 0")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = scratch.table(stage(spark, none, sf), f"none-{k}")
        assert out.count() == 0 and (name == "token_output" or out.columns == none.columns)


def test_order_of_the_mix(spark, sf):
    """The output holds the documents in the order of blocks and slots."""
    from ledgerline.llm.common import Scratch

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lengths = corpus_pipeline.token_lengths(docs, corpus_pipeline.tokenizer(corpus_pipeline.VOCABULARY))
    want = [r["doc_id"] for r in mix(lengths, F.col("n_tokens"), max_repeats=1.5).orderBy("block", "slot").collect()]
    mixed = Scratch(spark, "order").table(corpus_pipeline.mixing(spark, docs, sf), "mixed")
    assert [r["doc_id"] for r in corpus_pipeline.token_output(spark, mixed, sf).orderBy("start").collect()] == want
    assert want != sorted(want) and len(want) > docs.count()


def test_sql(spark, sf):
    from ledgerline.llm.queries import oracle_sql
    from tests.oracle import against_sql

    for name, sql in oracle_sql().items():
        against_sql(queries()[name](spark, sf), sql, sf)
