"""Substring, line and near dedup against brute force."""

import math
import re
from collections import defaultdict

import pytest

from ledgerline.llm import near_dedup
from ledgerline.llm.line_dedup import dedup_lines
from ledgerline.llm.near_dedup import near_duplicates
from ledgerline.llm.substring_dedup import dedup_substrings
from tests.llm.odd import documents, frame, lower

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def substring_truth(rows, length):
    first = {}
    docs = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    for i, w in docs:
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone |= set(range(k, k + length))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("length,chunks", [(13, 3), (5, 20), (1, 2)])
def test_substrings(spark, length, chunks):
    got = dedup_substrings(frame(spark), length=length, chunks=chunks).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got)) == substring_truth(documents(), length)


def test_substrings_extend(spark):
    base = [f"u{k}" for k in range(100)]
    rows = [(1, " ".join(base), "en", "s", 1), (2, "z " + " ".join(base[10:90]) + " y", "en", "s", 1), (3, " ".join(base[:7] + ["q"] * 3), "en", "s", 1), (None, " ".join(base), "en", "s", 1)]
    got = {r["doc_id"]: r for r in dedup_substrings(frame(spark, rows), length=5, chunks=3).collect()}
    assert [(s["from"], s["to"]) for s in got[2]["spans"]] == [(1, 81)]
    assert got[2]["longest"] == 80 and got[3]["longest"] == 5 and got[3]["n_removed"] == 7
    assert got[None]["n_removed"] == 0 and got[1]["n_removed"] == 0 and got[None]["longest"] == 0


def test_substrings_longest(spark):
    """The doubling against brute force; rows of one doc_id in several chunks repeat nothing of each other."""
    rows = documents() + [(300, "same words " * 40 + str(k), "en", "s", 1) for k in range(6)]
    docs = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    want = []
    for i, w in docs:
        best, n = 0, 5
        while n <= len(w):
            others = {tuple(x[k : k + n]) for j, x in docs if j != i for k in range(len(x) - n + 1)}
            if not any(tuple(w[k : k + n]) in others for k in range(len(w) - n + 1)):
                break
            best, n = n, 2 * n
        want.append((i, len(w), best))
    got = dedup_substrings(frame(spark, rows), length=5, chunk_bytes=2000).select("doc_id", "n_words", "longest").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_large_texts():
    """Text columns past 2 GiB are joined with 64-bit offsets."""
    import pyarrow as pa

    from ledgerline.llm.common import buffers

    part = pa.array(["x" * (1 << 20)] * 700)
    data, offs = buffers(pa.chunked_array([part] * 3))
    assert offs[-1] == 2100 << 20 and len(data) == offs[-1] + 8 and len(offs) == 2101


def line_truth(rows, min_chars, min_docs):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    docs = defaultdict(set)
    for i, t, *_ in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                docs[key(x)].add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or not (len(key(x)) >= min_chars and len(docs[key(x)]) >= min_docs and i != max(docs[key(x)]))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 4), (5, 2), (9, 3)])
def test_lines(spark, batches, fanout):
    line = "This line is shared by a good many of the documents here"
    once = "Ünly two documents hold this line, one of them four times over"
    rows = documents() + [(None, line, "en", "s", 1), *[(400, once, "en", "s", 1)] * 4, (401, once.upper().replace("Ü", "ü") + "\n" + once, "en", "s", 1)]
    got = dedup_lines(frame(spark, rows), min_chars=20, min_docs=3, batches=batches, fanout=fanout).collect()
    assert sorted(map(tuple, got), key=str) == line_truth(rows, 20, 3)


def test_line_runs(spark):
    """The anti-join decides: a key enters a run once, later sightings are tallied; compaction keeps every key once."""
    from ledgerline.llm.common import Scratch
    from ledgerline.llm.line_dedup import LineRuns

    runs, want = LineRuns(spark, Scratch(spark, "test"), fanout=2), defaultdict(list)
    for b in range(7):
        rows = [(10 * b + k, (b * k) % 5, 0) for k in range(6)]
        before = set(want)
        for d, h, _ in rows:
            want[h].append(d)
        _, tally = runs.add(spark.createDataFrame(rows, "doc_id bigint, hi bigint, lo bigint"))
        assert {r["hi"] for r in tally.collect()} == {h for _, h, _ in rows} & before
        held = [r["hi"] for r in runs._read(runs._runs()).collect()]
        assert sorted(held) == sorted(want)
        assert all(len(level) < 2 for level in runs.levels)
    assert {r["hi"]: (r["n_rows"], r["max_doc"]) for r in runs.merged().collect()} == {h: (len(d), max(d)) for h, d in want.items()}


def test_line_keys(spark):
    from pyspark.sql import functions as F

    from ledgerline.llm.line_dedup import keys_of, line_key

    texts = ["  Abc Déf\t", "ÀB\x0b\x0c\r x", "ⅣK İ ÉA", "plain", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.transform(keys_of(F.col("t"), 3), lambda k: F.array(k["hi"], k["lo"]))).collect()]
    assert got == [[list(line_key(t, 3))] if line_key(t, 3) else [] for t in texts]


def near_truth(rows, shingle, percent):
    sets, whose = [], []
    for i, t, *_ in rows:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set())
        whose.append(i)
    parent = {i: i for i in whose}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                p, q = root(whose[a]), root(whose[b])
                parent[max(p, q)] = min(p, q)
    return sorted((i, len(s), root(i), i == root(i)) for i, s in zip(whose, sets))


@pytest.mark.parametrize("shingle,block", [(2, 4096), (5, 4096), (2, 7)])
def test_near(spark, shingle, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "HEAD", 4 if block < 4096 else 512)
    rows = documents(80, seed=9)
    base = ("alpha beta gamma delta " * 3 + " ".join(f"k{k}" for k in range(60))).split()
    for k in range(40):  # a group around the threshold: single links matter
        w = list(base)
        for j in range(k % 9):
            w[(7 * j + k) % len(w)] = f"x{k}{j}"
        rows.append((200 + k, " ".join(w), "en", "s0", 1))
    got = near_duplicates(frame(spark, rows), shingle=shingle, percent=80).collect()
    assert sorted(map(tuple, got)) == near_truth(rows, shingle, 80)


def test_registered_near(spark, sf):
    from ledgerline.llm.queries import op6_near_dedup

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op6_near_dedup(spark, sf).collect())) == near_truth(rows, 2, 80)


def test_empty(spark):
    none = frame(spark, [])
    assert dedup_substrings(none, chunks=2).count() == 0
    assert dedup_lines(none).count() == 0
    assert near_duplicates(none).count() == 0


def test_stated_sift_miss():
    """The chance that the sift drops a pair, exactly: parity of twice as many balls as samples differ."""
    samples, bins, limit = near_dedup.BANDS * near_dedup.ROWS, 64 * near_dedup.SKETCH_LONGS, near_dedup.flips_at(0.62)
    odd, past = [1.0] + [0.0] * bins, []
    for _ in range(samples + 1):
        past.append(sum(odd[limit + 1 :]))
        for _ in range(2):
            odd = [(odd[o - 1] * (bins - o + 1) / bins if o else 0) + (odd[o + 1] * (o + 1) / bins if o < bins else 0) for o in range(bins + 1)]
    miss = lambda j: sum(math.comb(samples, d) * (1 - j) ** d * j ** (samples - d) * p for d, p in enumerate(past))
    said = [f"{miss(j):.1e}".replace("e-0", "e-") for j in (0.8, 0.85)]
    assert all(x in near_dedup.near_duplicates.__doc__ for x in said)
