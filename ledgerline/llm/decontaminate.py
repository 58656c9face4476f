"""Benchmark decontamination with an FM-index for each training shard.

A shard is a bounded stretch of one partition's documents. Its words become symbols of the benchmark's vocabulary; a
word that no benchmark passage has can stand in no occurrence, so it only separates, and so does every stretch that is
shorter than the shortest window. Over what is left the shard's Burrows-Wheeler transform is built (prefix doubling to
full order), with a wavelet tree for ranks. All windows are searched backward together, one symbol a step; windows that
share an end share their steps' arrays. Occurrences are located by walking back to sampled suffix positions, and the
spans of one document are merged.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import ALNUM, LOWER, Scratch, pieces

_TABLE = bytes(int(LOWER[b]) if ALNUM[LOWER[b]] else 0x20 for b in range(256))


def split_words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class WaveletTree:
    """Ranks over a symbol array: one bit level a symbol bit, each with block counts (a wavelet matrix)."""

    BLOCK = 64

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(symbols), bits, []
        s = symbols.astype(np.int64)
        for k in range(bits - 1, -1, -1):
            bit = ((s >> k) & 1).astype(np.uint8)
            packed = np.packbits(np.r_[bit, np.zeros(-len(bit) % self.BLOCK + self.BLOCK, np.uint8)], bitorder="little").view("<u8")
            counts = np.r_[0, np.cumsum(np.bitwise_count(packed).astype(np.int64))]
            zeros = len(bit) - int(bit.sum())
            self.levels.append((k, packed, counts, zeros))
            s = np.r_[s[bit == 0], s[bit == 1]]

    @staticmethod
    def _ones(level, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return level[2][word] + np.bitwise_count(level[1][word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        lo, hi = np.zeros_like(at), at.copy()
        for level in self.levels:
            one = ((symbols >> level[0]) & 1).astype(bool)
            lo1, hi1 = self._ones(level, lo), self._ones(level, hi)
            lo, hi = np.where(one, level[3] + lo1, lo - lo1), np.where(one, level[3] + hi1, hi - hi1)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        out, at = np.zeros_like(at), at.copy()
        for level in self.levels:
            bit = (level[1][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self._ones(level, at)
            out |= bit << level[0]
            at = np.where(bit == 1, level[3] + ones, at - ones)
        return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling; settled suffixes leave the sorting."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.r_[True, s[order][1:] != s[order][:-1]]
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 1
    todo = order.copy()
    while True:
        # A group of equal ranks keeps its range of places; within it the suffixes are dealt anew by what follows.
        r = rank[todo]
        todo = todo[~(np.r_[True, r[1:] != r[:-1]] & np.r_[r[1:] != r[:-1], True])]
        if not len(todo):
            return order
        r = rank[todo]
        nxt = np.where(todo + step < n, rank[np.minimum(todo + step, n - 1)], -1)
        by = np.lexsort((nxt, r))
        todo, r, nxt = todo[by], r[by], nxt[by]
        head = np.r_[True, r[1:] != r[:-1]]
        place = r + np.arange(len(r)) - np.maximum.accumulate(np.where(head, np.arange(len(r)), 0))
        order[place] = todo
        fresh = head | np.r_[True, nxt[1:] != nxt[:-1]]
        rank[todo] = np.maximum.accumulate(np.where(fresh, place, 0))
        step *= 2


class FMIndex:
    """Full-text index of one symbol array (symbols from 1; 0 ends it)."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 16):
        s = np.r_[symbols, 0]
        order = suffix_array(s)
        bwt = s[order - 1]
        self.first = np.r_[0, np.cumsum(np.bincount(s, minlength=sigma + 1))]
        self.tree = WaveletTree(bwt, max(1, int(sigma).bit_length()))
        marked = (order % sample == 0).astype(np.uint8)
        self.marked = WaveletTree(marked, 1)
        self.flags, self.samples = marked.astype(bool), order[marked == 1]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that begin with each row of ``phrases`` (equal lengths), all stepped together."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.tree.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            lo[live] = self.first[c] + self.tree.rank(c, lo[live])
            hi[live] = self.first[c] + self.tree.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        hi = np.maximum(hi, lo)
        return lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text position of each suffix: back steps until one whose position is sampled."""
        at, steps, out = at.copy(), np.zeros_like(at), np.full(len(at), -1)
        live = np.arange(len(at))
        while len(live):
            done = self.flags[at[live]]
            d = live[done]
            out[d] = self.samples[self.marked.rank(np.ones(len(d), np.int64), at[d])] + steps[d]
            live = live[~done]
            c = self.tree.access(at[live])
            at[live] = self.first[c] + self.tree.rank(c, at[live])
            steps[live] += 1
        return out


class Windows:
    """All windows of a block of benchmark items, as symbol rows by length, and the items of each."""

    def __init__(self, items: list[tuple[object, str | None]], length: int):
        self.vocabulary: dict[bytes, int] = {}
        held: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            symbols = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in split_words(text)]
            for k in range(max(1, len(symbols) - length + 1) if symbols else 0):
                held[tuple(symbols[k : k + length])].add(item)
        by_length: dict[int, list] = defaultdict(list)
        for w, whose in held.items():
            by_length[len(w)].append((w, frozenset(whose)))
        self.groups = [(n, np.array([w for w, _ in rows], np.int64), [x for _, x in rows]) for n, rows in sorted(by_length.items())]
        self.shortest = min(by_length, default=0)


def shard_hits(texts: list[str | None], windows: Windows) -> tuple[list[int], list[list[tuple[int, int]]], list[set]]:
    """For each text of a shard: its words, its merged hit spans [from, to) in words, and the items that occur."""
    get, counts, symbols = windows.vocabulary.get, [], []
    for text in texts:
        own = split_words(text)
        counts.append(len(own))
        symbols.append(np.fromiter(map(get, own, repeat(0)), np.int64, len(own)))
        symbols.append(np.zeros(1, np.int64))
    spans: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    s = np.concatenate(symbols) if symbols else np.zeros(0, np.int64)
    if not windows.groups or not len(s):
        return counts, spans, items
    edge = np.flatnonzero(np.diff(np.r_[0, s > 0, 0].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= windows.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return counts, spans, items
    # The stretches that can hold a window, one separator after each; the separator is a symbol of its own.
    sigma = len(windows.vocabulary) + 1
    sizes = ends - starts + 1
    at = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = s[at]
    kept[np.cumsum(sizes) - 1] = sigma
    index = FMIndex(kept, sigma)
    offset = np.cumsum(np.r_[0, np.array(counts) + 1])
    found: list[list] = [[] for _ in texts]
    for n, phrases, whose in windows.groups:
        lo, hi = index.search(phrases)
        for a in range(0, len(phrases), 4096):
            size = (hi - lo)[a : a + 4096]
            if not size.sum():
                continue
            which = np.repeat(np.arange(len(size)), size) + a
            rows = np.repeat(lo[a : a + 4096], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            place = at[index.locate(rows)]
            doc = np.searchsorted(offset, place, "right") - 1
            for d, p, w in zip(doc.tolist(), (place - offset[doc]).tolist(), which.tolist()):
                found[d].append((p, p + n))
                items[d] |= whose[w]
    for d, own in enumerate(found):
        for p, q in sorted(own):
            if spans[d] and p <= spans[d][-1][1]:
                spans[d][-1] = (spans[d][-1][0], max(q, spans[d][-1][1]))
            else:
                spans[d].append((p, q))
    return counts, spans, items


def find_leaks(docs: DataFrame, benchmark: DataFrame, length: int = 10, block_bytes: int = 32 << 20, shard_bytes: int = 4 << 20) -> DataFrame:
    """The columns of ``docs`` with n_words, spans (array of [from, to) in words), items (sorted as strings) added.

    A window is ``length`` consecutive words of an item, or a shorter item whole; a null or wordless item has none and
    a null text no words. Items without an id are searched like all others and stand as one null, last, in ``items``. The benchmark goes to the executors in blocks of at most about ``block_bytes`` of text, one
    pass over the documents a block (one pass for any benchmark that fits); a single item is never cut. Rows that repeat
    are judged each for itself; names of ``docs`` that clash with the added ones give way to them. Nothing of the
    documents is shuffled.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = 1 + total // block_bytes
    out = docs.drop("n_words", "spans", "items").withColumns({"n_words": F.lit(0).cast("bigint"), "spans": F.expr("array_remove(array(named_struct('from', 0L, 'to', 0L)), named_struct('from', 0L, 'to', 0L))"), "items": F.array().cast("array<string>")})
    schema = out.schema
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in part.toLocalIterator()])

        def search(batches, shared=shared, cache={}):  # noqa: B006  one table of windows a task
            windows = cache.setdefault(0, Windows(shared.value, length))
            for batch in pieces(batches, shard_bytes):
                names = batch.schema.names
                texts = batch.column(names.index("text")).to_pylist()
                counts, spans, found = shard_hits(texts, windows)
                spans = [[*map(tuple, x)] + own for x, own in zip(([(y["from"], y["to"]) for y in z] for z in batch.column(names.index("spans")).to_pylist()), spans)]
                found = [sorted({*x, *own}, key=lambda i: (i is None, i or "")) for x, own in zip(batch.column(names.index("items")).to_pylist(), found)]
                arrow = batch.schema
                columns = {"n_words": pa.array(counts, pa.int64()), "spans": pa.array([[{"from": a, "to": b} for a, b in merge(x)] for x in spans], arrow.field("spans").type), "items": pa.array(found, arrow.field("items").type)}
                yield pa.RecordBatch.from_arrays([columns.get(n, batch.column(i)) for i, n in enumerate(names)], schema=arrow)

        out = out.mapInArrow(search, schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = 10, block_bytes: int = 32 << 20, shard_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with every occurrence of a benchmark window cut out of ``text``, again until none is left.

    Same rules and bounds as ``find_leaks``; rows, columns and texts without an occurrence come back as they were. With more
    than one block of items each round is written to the shared folder, and the last one stays there.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = 1 + total // block_bytes
    out = docs
    scratch, size = Scratch(spark, "cut"), lambda df: df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    # A cut of one block's windows can bring words together that any other block has: with several blocks, rounds over all
    # of them go on until one cuts nothing.
    turn, before = 0, size(docs) if blocks > 1 else None
    while True:
        for k in range(blocks):
            out = _cut(out, items, k, blocks, length, shard_bytes)
        if blocks == 1:
            return out
        out = scratch.table(out, f"round-{turn}")
        after = size(out)
        if turn:
            scratch.drop(f"round-{turn - 1}")
        if after == before:
            return out
        turn, before = turn + 1, after


def _cut(docs: DataFrame, items: DataFrame, k: int, blocks: int, length: int, shard_bytes: int) -> DataFrame:
    """``docs`` without the windows of one block of items, nor those that its own cuts make."""
    part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
    shared = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in part.toLocalIterator()])

    def cut(batches, shared=shared):
        windows = Windows(shared.value, length)
        for batch in pieces(batches, shard_bytes):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            todo = list(range(len(texts)))
            while todo:
                spans = shard_hits([texts[i] for i in todo], windows)[1]
                todo = [i for i, s in zip(todo, spans) if s]
                for i, s in zip(todo, [s for s in spans if s]):
                    texts[i] = remove_spans(texts[i], s)
            columns = [pa.array(texts, batch.schema.field(at).type) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(cut, docs.schema)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of ``spans`` and what stands between them; the rest stays byte for byte."""
    if not text or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    flat = np.frombuffer(raw.translate(_TABLE), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.r_[0, flat, 0].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : starts[a]])
        last = int(ends[b - 1])
    out.append(raw[last:])
    return b"".join(out).decode("utf-8", "surrogatepass")
