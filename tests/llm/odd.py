"""Odd inputs for every operator: nulls, empty and long texts, repeated rows, shared ids, clashing names."""

import random

from pyspark.sql import functions as F

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside or return.
CLASHES = ["score", "predicted", "n", "node", "chunk", "kept", "copy", "hi", "lo", "drops", "bands", "n_words", "spans", "items", "h", "key", "bucket", "component", "shard", "last", "h_lang"]


def documents(n=60, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "über", "Ω", "a,b", "日本"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    line = "This line is shared by a good many of the documents here"
    rows = []
    for k in range(n):
        t = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80)))
        if k % 4 == 0:
            t = t + "\n" + passage + ".\n" + t[:50]
        if k % 3 == 0:
            t = f"  {line}\t\n" + t + f"\n{line.upper() if k % 2 else line}"
        if k % 7 == 0 and rows:
            t = rows[-1][1] or ""
        if k % 11 == 0 and k:
            t = (rows[0][1] or "") + " tail"
        rows.append((k, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", None]), len(t)))
    rows += [(100, None, "en", "s1", None), (101, "", "fr", "s0", 0), (102, " \n\t ", None, None, None), (103, "one", "en", "s0", 3), (104, "one two", "en", "s0", 7)]
    rows += [(105, "x" * 30_000 + " " + passage, "en", "s0", 1), (106, " ".join(vocabulary * 300), "fr", "s2", 1), (107, "...!!! 123 <|endoftext|> ▁ \u0000", None, "s1", 1)]
    rows += [rows[4], rows[4], (7, "same id, another text " + passage, "en", "s0", 5), (8, rows[0][1], "en", "s0", 5)]
    return rows


def frame(spark, rows=None, clash=True):
    df = spark.createDataFrame(documents() if rows is None else rows, COLUMNS).repartition(3)
    return df.withColumns({c: F.lit(None).cast("string") for c in CLASHES}) if clash else df


def sha(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)
