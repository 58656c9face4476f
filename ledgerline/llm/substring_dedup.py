"""Substring dedup by level-wise doubling.

Level 0 looks at seeds of half the wanted window: of each window the seed with the smallest hash stands for it, and only
windows whose seed occurs in two documents are extended to full length (twice the seed, less the overlap), which is level
1. Windows that are repeated at a length, with their neighbours, are extended to twice that length, and so on, until no
candidate survives. The removed words are decided at level 1; the further levels tell how long the repeated passages are.

The documents are dealt once, by hash, into chunks of bounded size: one bucketed table in the shared folder that the text
levels read without a shuffle. A level posts, for each chunk, its distinct candidate hashes (sorted, cut into hash ranges,
as byte planes) with the chunk's smallest and largest document of each; a range's postings meet in one task, which answers
every chunk with bit strings: has another document the hash, and has a smaller one it in another chunk. So a passage that a
million documents share costs one entry a chunk, and all that is ever shuffled besides the one dealing is postings, bits
and surviving windows. From level 1 on the surviving windows (place, hash, document) are the state: doubling joins the
hashes of two neighbours and never reads a text again.

Hashes have 64 bits. A window is removed only if its seed and its full hash are both repeated; a window whose seed is
truly repeated (a seventh to a fifth of the words may be) goes wrongly with a chance of (number of other windows) / 2**64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import BLANK, Scratch, buffers, hash_spans, inside, join_hashes, mix, partitions, window_hashes, words

#: Kinds of rows that a level writes: postings by hash range; surviving windows; covered words and lengths.
POST, STATE, MARK = 0, 1, 2
_LEVEL = "kind int, chunk int, range int, n bigint, a binary, b binary, c binary, d binary"
_REPLY = "chunk int, range int, n bigint, elsewhere binary, smaller binary"
_OUT = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<from:bigint,to:bigint>>, longest bigint, kept string"
_SPAN = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
_NONE = np.zeros(0, np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Eight-byte numbers, byte plane by byte plane: the planes of small or sorted numbers compress to little."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T).tobytes()


def _whole(raw: bytes, kind=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], schema=pa.schema(fields))


class _Text:
    """The words of one chunk's documents."""

    def __init__(self, table: pa.Table, hashed: bool = True):
        self.data, offs = buffers(table.column("text"))
        self.starts, self.lens, self.first = words(self.data, offs, BLANK)
        self.n = len(self.starts)
        ids = table.column("doc_id").combine_chunks()
        self.known = ~np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0), np.int64)
        self.owner = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))
        if hashed:
            self.hash = hash_spans(self.data, self.starts, self.lens)

    def seeds(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where windows of ``length`` words of documents with an id begin, the first of each run of neighbours that share
        their smallest seed (an index into the former), and that seed's hash, evenly spread."""
        if not self.n:
            return _NONE, _NONE, _NONE.view(np.uint64)
        at = np.flatnonzero(inside(self.first, length, self.n) & self.known[self.owner])
        seed = (length + 1) // 2
        low = window_hashes(self.hash, seed)
        span, have = length - seed + 1, 1
        while have < span:
            step = min(have, span - have)
            low = np.minimum(low[: max(0, len(low) - step)], low[step:])
            have += step
        low = low[at]
        head = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (self.owner[at[1:]] != self.owner[at[:-1]])]) if len(at) else _NONE
        return at, head, mix(low[head])  # smallest hashes crowd at the low end: mixed again they fill all ranges alike


def _distinct(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct hashes in order, smallest and largest document of each, and each entry's index among them."""
    order = np.argsort(hashes, kind="stable")
    h, d = hashes[order], docs[order]
    head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else _NONE
    back = np.empty(len(h), np.int64)
    back[order] = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(h)]))
    if not len(h):
        return h, d, d, back
    return h[head], np.minimum.reduceat(d, head), np.maximum.reduceat(d, head), back


def _posting(chunk: int, hashes: np.ndarray, docs: np.ndarray, bits: int) -> list[tuple]:
    """Rows of the distinct hashes, cut into hash ranges."""
    h, least, most, _ = _distinct(hashes, docs)
    cuts = np.searchsorted(h >> np.uint64(64 - bits) if bits else np.zeros(len(h), np.uint64), np.arange((1 << bits) + 1, dtype=np.uint64))
    return [(POST, chunk, k, int(b - a), _planes(h[a:b]), _planes(least[a:b]), _planes((most - least)[a:b]), None) for k, a, b in zip(range(1 << bits), cuts, cuts[1:]) if b > a]


def _answer(table: pa.Table) -> pa.Table:
    """All postings of one hash range: for each chunk's entries, has another document the hash, and a smaller one elsewhere."""
    chunks, ranges, sizes = (table.column(k).to_pylist() for k in ("chunk", "range", "n"))
    whole = lambda k, kind=np.int64: np.concatenate([_whole(x.as_py(), kind) for x in table.column(k)])
    h, d = whole("a", np.uint64), whole("b")
    top = d + whole("c")
    order = np.argsort(h, kind="stable")
    s = h[order]
    head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    size = np.diff(np.r_[head, len(s)])
    least, most = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(d[order], head), size)
    most[order] = np.repeat(np.maximum.reduceat(top[order], head), size)
    elsewhere, smaller = least != most, least < d
    ends = np.cumsum(sizes)
    return _rows([(c, r, n, np.packbits(elsewhere[e - n : e]).tobytes(), np.packbits(smaller[e - n : e]).tobytes()) for c, r, n, e in zip(chunks, ranges, sizes, ends)], _REPLY)


def _judged(hashes: np.ndarray, docs: np.ndarray, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry: is it in another document, and in one with a smaller id."""
    _, least, most, back = _distinct(hashes, docs)
    rows = sorted(replies.to_pylist(), key=lambda r: r["range"])
    bits = [np.concatenate([np.unpackbits(np.frombuffer(r[k], np.uint8), count=r["n"]).astype(bool) for r in rows] or [np.zeros(0, bool)]) for k in ("elsewhere", "smaller")]
    return bits[0][back] if len(back) else np.zeros(0, bool), bits[1][back] | (docs > least[back]) if len(back) else np.zeros(0, bool)


def _state(chunk: int, at: np.ndarray, h: np.ndarray, docs: np.ndarray, rows: np.ndarray) -> tuple:
    """Windows by place; but for the hashes, the steps from one to the next compress to almost nothing."""
    return (STATE, chunk, -1, len(at), _planes(np.diff(at, prepend=0)), _planes(h), _planes(np.diff(docs, prepend=0)), _planes(np.diff(rows, prepend=0)))


def _extend(chunk: int, state: pa.Table, replies: pa.Table, size: int, first: bool, bits: int) -> pa.Table:
    """The windows of ``size`` words after the answers: marks of what is covered and repeated, and the windows of twice the
    size that two repeated neighbours make."""
    if not state.num_rows:
        return _rows([], _LEVEL)
    row = state.to_pylist()[0]
    at, docs, whose = (np.cumsum(_whole(row[k])) for k in "acd")
    h = _whole(row["b"], np.uint64)
    repeated, later = _judged(h, docs, replies)
    out = [(MARK, chunk, size, 0, _planes(at[later]) if first else b"", _planes(np.unique(whose[repeated])), None, None)]
    at, h, docs, whose = at[repeated], h[repeated], docs[repeated], whose[repeated]
    if len(at):
        after = np.minimum(np.searchsorted(at, at + size), len(at) - 1)
        pair = np.flatnonzero((at[after] == at + size) & (whose[after] == whose))
        if len(pair):
            double = join_hashes(h[pair], h[after[pair]])
            out += [_state(chunk, at[pair], double, docs[pair], whose[pair]), *_posting(chunk, double, docs[pair], bits)]
    return _rows(out, _LEVEL)


def _finish(table: pa.Table, marks: pa.Table, length: int) -> pa.Table:
    """What is left of each document of a chunk."""
    text = _Text(table, hashed=False)
    cover, longest = np.zeros(text.n + 1, np.int64), np.zeros(len(text.ids), np.int64)
    for m in marks.to_pylist():
        at = _whole(m["a"])
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        whose = _whole(m["b"])
        longest[whose] = np.maximum(longest[whose], m["range"])
    gone = np.cumsum(cover[:-1]) > 0
    total = np.r_[0, np.cumsum(gone)]
    kept, spans = [], []
    for a, b in zip(text.first[:-1].tolist(), text.first[1:].tolist()):
        raw = text.data[text.starts[a] : text.starts[b - 1] + text.lens[b - 1]].tobytes().split() if b > a else []
        if total[b] > total[a]:
            own = gone[a:b]
            edge = np.flatnonzero(np.diff(np.r_[0, own, 0].astype(np.int8))).tolist()
            spans.append([{"from": p, "to": q} for p, q in zip(edge[::2], edge[1::2])])
            raw = [w for w, g in zip(raw, own.tolist()) if not g]
        else:
            spans.append([])
        kept.append(b" ".join(raw).decode("utf-8", "surrogatepass"))
    arrays = [pa.array(text.ids, pa.int64(), mask=~text.known), pa.array(np.diff(text.first), pa.int64()), pa.array(total[text.first[1:]] - total[text.first[:-1]], pa.int64()), pa.array(spans, _SPAN), pa.array(longest, pa.int64()), pa.array(kept, pa.string())]
    return pa.Table.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "spans", "longest", "kept"])


def dedup_substrings(docs: DataFrame, length: int = 13, chunk_bytes: int = 8 << 20, chunks: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, spans, longest, kept of every row.

    A word is a stretch without [\\x20\\x09-\\x0D]; every word covered by a window of ``length`` words that also starts in
    a document with a smaller doc_id is removed, judged on the input. ``spans`` are the removed [from, to) word ranges,
    ``kept`` the other words joined by one space, ``longest`` the largest of the lengths ``length``, 2 * ``length``, 4 *
    ``length``... at which a window of the document is repeated in one with another doc_id (0: none). A null text has no
    words; rows that share a doc_id never remove each other's words; a row without doc_id keeps all and removes nothing;
    other columns are ignored. A chunk holds about ``chunk_bytes`` of text, a single document more if it is longer; rows
    that share a doc_id are spread by their texts. ``chunks`` sets the number of chunks instead.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "substrings")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    if chunks is None:
        total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
        chunks = max(partitions(spark), -(-total // chunk_bytes))
    # A range takes what about two chunks post: small enough that some in one task do not stand out.
    bits = max(0, (-(-chunks // 2) - 1).bit_length())
    dealt = scratch.bucketed(rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")), "chunks", "chunk", chunks)

    def level(df: DataFrame, name: str) -> tuple[DataFrame, ...]:
        df.write.partitionBy("kind").option("compression", "zstd").parquet(scratch.path(name))
        table = spark.read.schema(df.schema).parquet(scratch.path(name))
        return tuple(table.where(F.col("kind") == kind).drop("kind") for kind in (POST, STATE, MARK))

    def answers(posted: DataFrame, name: str) -> DataFrame:
        return scratch.table(posted.groupBy("range").applyInArrow(_answer, _REPLY), name).groupBy("chunk")

    def begin(key, t):
        text = _Text(t)
        at, head, low = text.seeds(length)
        return _rows(_posting(key[0].as_py(), low, text.ids[text.owner[at[head]]], bits), _LEVEL)

    def windows(key, t, replies):
        if not t.num_rows:
            return _rows([], _LEVEL)
        text, chunk = _Text(t), key[0].as_py()
        at, head, low = text.seeds(length)
        repeated, _ = _judged(low, text.ids[text.owner[at[head]]], replies)
        at = at[np.repeat(repeated, np.diff(np.r_[head, len(at)]))] if len(at) else at
        if not len(at):
            return _rows([], _LEVEL)
        h, whose = window_hashes(text.hash, length)[at], text.owner[at]
        return _rows([_state(chunk, at, h, text.ids[whose], whose), *_posting(chunk, h, text.ids[whose], bits)], _LEVEL)

    def extend(size):
        return lambda key, state, replies: _extend(key[0].as_py(), state, replies, size, size == length, bits)

    posted, _, _ = level(dealt.groupBy("chunk").applyInArrow(begin, _LEVEL), "level-0")
    replies = answers(posted, "answers-0")
    posted, state, _ = level(dealt.groupBy("chunk").cogroup(replies).applyInArrow(windows, _LEVEL), "level-1")
    scratch.drop("level-0", "answers-0")
    scratch.release()
    marks, size, k = None, length, 1
    while marks is None or scratch.exists(f"level-{k}/kind={POST}"):  # a kind without a row has no folder
        replies = answers(posted, f"answers-{k}")
        scratch.drop(f"level-{k}/kind={POST}")
        if k < 3:  # the levels that shuffle much
            scratch.release()
        posted, state, marked = level(state.groupBy("chunk").cogroup(replies).applyInArrow(extend(size), _LEVEL), f"level-{k + 1}")
        scratch.drop(f"answers-{k}", f"level-{k}/kind={STATE}")
        marks = marked if marks is None else marks.unionByName(marked)
        size, k = 2 * size, k + 1

    def finish(key, t, marks):
        return _finish(t, marks, length) if t.num_rows else _EMPTY

    return dealt.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(finish, _OUT)


_EMPTY = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), _SPAN, pa.int64(), pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "longest", "kept"])
