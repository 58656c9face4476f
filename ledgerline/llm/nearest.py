"""Approximate nearest neighbours by a permutation index.

A vector is known by its pivots, nearest first. A shard of rows posts each of its distinct vectors in the inverted files
of its first ``prefix`` pivots, with the pivot's place; a query walks the files of its own first pivots and sums, for
every vector it meets, how near the places are (the footrule distance over the prefixes, turned round). The best share
is scored exactly, and further steps of the order after it for as long as a step still changes the query's result: in a
crowd of much the same vectors the footrule alone does not tell which are nearest. Queries come in broadcast blocks of bounded size; each shard answers a block with its best k a query,
and those are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is neither null, empty nor zero and has no null or non-finite component."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = F.col(vector)
    return df.where(v.isNotNull() & F.forall(v, fine) & F.exists(v, lambda x: x != 0))


class _Index:
    """Inverted files of one shard's distinct vectors."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, pivots: np.ndarray, norm2: float, prefix: int, k: int):
        order = np.argsort(ids, kind="stable")
        vectors, ids = vectors[order], ids[order]
        raw = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
        _, first, group = np.unique(raw, return_index=True, return_inverse=True)
        self.vectors, self.prefix = vectors[first], prefix
        # An id with several vectors can stand with each of them among the best: so many more have to be kept.
        self.often = int(np.unique(ids, return_counts=True)[1].max())
        # Equal vectors score alike and ties go to smaller ids: beyond k + 1 of them (one may be the query) none can show.
        by = np.argsort(group, kind="stable")
        by = by[np.r_[True, (group[by][1:] != group[by][:-1]) | (ids[by][1:] != ids[by][:-1])]]
        g = group[by]
        nth = np.arange(len(g)) - np.searchsorted(g, g)
        keep = nth <= k
        self.members, self.begin = ids[by][keep], np.searchsorted(g[keep], np.arange(len(first) + 1))
        top = leading(self.vectors, pivots, norm2, prefix)
        flat = top.ravel()
        post = np.argsort(flat, kind="stable")
        self.bounds = np.searchsorted(flat[post], np.arange(len(pivots) + 1))
        self.posted, self.place = post // top.shape[1], (post % top.shape[1]).astype(np.int16)

    def search(self, query: np.ndarray, qid: int, mine: np.ndarray, k: int, share: float, step: float) -> tuple[np.ndarray, np.ndarray]:
        parts = [slice(self.bounds[p], self.bounds[p + 1]) for p in mine]
        at = np.concatenate([self.posted[s] for s in parts])
        near = np.concatenate([self.prefix - np.abs(self.place[s] - j) for j, s in enumerate(parts)])
        met = np.bincount(at, near, len(self.vectors))
        order = np.argsort(-met)
        falling = -met[order]
        got, score = np.empty(0, np.int64), np.empty(0)
        want = (k + 1) * self.often
        done, more = 0, max(4 * want, int(np.ceil(share * len(order))))
        while done < len(order):
            # Everything as near as the last one wanted is scored too; if that has met nothing, all are.
            end = np.searchsorted(falling, falling[min(done + more, len(order)) - 1], "right")
            found = order[done:end]
            worth = (self.vectors[found] * query).sum(1)
            worst = score.min() if len(score) >= want else -np.inf
            got, score = np.concatenate([got, found]), np.concatenate([score, worth])
            if len(got) > want:
                best = score >= np.partition(score, len(score) - want)[len(score) - want]
                got, score = got[best], score[best]
            if not (worth > worst).any():
                break
            done, more = end, max(want, int(np.ceil(step * len(order))))
        size = self.begin[got + 1] - self.begin[got]
        ids = self.members[np.repeat(self.begin[got], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        score = np.repeat(score, size)
        other = ids != qid
        ids, score = ids[other], score[other]
        top = np.lexsort((ids, -score))
        if self.often > 1:  # an id shows once, at its best
            top = top[np.sort(np.unique(ids[top], return_index=True)[1])]
        top = top[:k]
        return ids[top], score[top]


def leading(vectors: np.ndarray, pivots: np.ndarray, norm2: float, prefix: int, query: bool = False) -> np.ndarray:
    """The first ``prefix`` pivots of each vector, nearest first. An added coordinate gives stored vectors one norm, so that
    order by nearness is order by inner product; a query's added coordinate is 0."""
    lift = lambda x: np.sqrt(np.maximum(0, norm2 - (x * x).sum(1)))
    out = np.empty((len(vectors), prefix), np.int16)
    for a in range(0, len(vectors), 4096):  # bounds the full orders held at once
        part = vectors[a : a + 4096]
        near = part @ pivots.T
        if not query:
            near = near + lift(part)[:, None] * lift(pivots)[None, :]
        out[a : a + 4096] = np.argsort(-near, axis=1, kind="stable")[:, :prefix]
    return out


def _pivots(rows: DataFrame, wanted: int) -> np.ndarray:
    """The different vectors with the smallest hashes, by one pass that keeps so many a task; again over what lies past them
    while copies of one vector leave too few."""
    found: list = []
    past = None
    while len(found) < wanted:
        hashed = rows.select(F.xxhash64("vector").alias("h"), "vector")
        got = (hashed if past is None else hashed.where(F.col("h") > past)).orderBy("h").limit(2 * wanted).collect()
        if not got:
            break
        past = got[-1]["h"]
        for r in got:
            if not found or found[-1] != r["vector"]:
                found.append(r["vector"])
    return np.array(found[:wanted])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = 256, prefix: int = 64, share: float = 0.25, step: float = 0.1, block: int = 8192, shard: int = 65_536) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by inner product (double precision), ties to smaller ids.

    Both inputs have (vec_id, vector array). A query's own vec_id is no candidate. Unusable vectors (see ``usable``),
    null ids, and vectors of another length than the commonest one (of equally common ones the shortest) take no part:
    they have no inner product with the rest. Rows that share a vec_id are candidates each, and a query lists the id once,
    at its best score; of query rows that share an id the one with the smallest vector asks. The pivots are a bounded sample: the
    ``pivots`` usable vectors with the smallest hashes. Every row is indexed. ``share`` of a shard's vectors, the best by
    footrule with all their ties, is scored, then ``step`` of them more until a step brings nothing into the best k; so
    the work is bounded by the shard, and fewer candidates than k only come back if there are no more. Shards of every
    size are searched alike.
    """
    spark = vectors.sparkSession
    clean = lambda df: usable(df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector")).where("vec_id IS NOT NULL"), "vector")
    rows, asked = clean(vectors), clean(queries)
    schema = "query_id bigint, vec_id bigint, score double"
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    once = lambda df: df.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # noqa: E731  shards may share an id
    final = lambda df: once(df).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if common is None:
        return final(spark.createDataFrame([], schema))
    rows, asked = (x.where(F.size("vector") == common["d"]) for x in (rows, asked))
    asked = asked.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    norm2 = rows.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    pivot = _pivots(rows, pivots)
    prefix = min(prefix, len(pivot))
    total = asked.count()
    blocks = max(1, -(-total // block))
    out = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        got = part.collect()  # about ``block`` rows
        q = np.array([r["vector"] for r in got]).reshape(len(got), common["d"])
        first = leading(q, pivot, norm2, prefix, True)
        shared = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in got], np.int64), q, first, pivot))

        def search(batches, shared=shared):
            qids, q, first, pivot = shared.value
            ids, parts = [], []

            def answer():
                index = _Index(np.concatenate(parts), np.concatenate(ids), pivot, norm2, prefix, k)
                found = [index.search(q[j], qids[j], first[j], k, share, step) for j in range(len(qids))]
                n = [len(f[0]) for f in found]
                if sum(n):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n), pa.int64()), pa.array(np.concatenate([f[0] for f in found]), pa.int64()), pa.array(np.concatenate([f[1] for f in found]), pa.float64())], names=["query_id", "vec_id", "score"])

            for batch in batches:
                if not batch.num_rows:
                    continue
                ids.append(batch.column(0).to_numpy())
                parts.append(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1))
                if sum(map(len, ids)) >= shard:
                    yield from answer()
                    ids, parts = [], []
            if ids:
                yield from answer()

        found = rows.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return final(out)
