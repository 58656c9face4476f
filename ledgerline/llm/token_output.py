"""Token-ID output: one concatenated id array a shard, with Elias-Fano coded document boundaries.

File format (Parquet, so that any Hadoop store and Spark's commit protocol carry it): documents ascend by key through the
shards, which are ranges of keys; a row is a block of a shard:

    shard, block        where the block stands
    n_docs, n_null      documents in it, of which so many, the first ones, have no key
    first               tokens of the shard before the block
    n_tokens, width     ids in the block, bytes an id (2 or 4, little-endian)
    ids                 the ids of all documents, end id after each
    bounds, keys        struct(n, base, low_bits, low, high, samples): Elias-Fano codes of the n_docs + 1 boundaries
                        within the block, and of the keys (document ids)
    names               where a name was given: int64 of each document, else null
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import partitions, pieces
from ledgerline.llm.elias_fano import EliasFano

_EF = "struct<n:bigint,base:bigint,low_bits:int,low:binary,high:binary,samples:binary>"
SCHEMA = f"shard int, block int, n_docs bigint, n_null bigint, first bigint, n_tokens bigint, width int, ids binary, bounds {_EF}, keys {_EF}, names binary"
_ARROW_EF = pa.struct([("n", pa.int64()), ("base", pa.int64()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())])
_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("bounds", _ARROW_EF), ("keys", _ARROW_EF), ("names", pa.binary())])


#: Between parts that are encoded together: a control character apart from all else is a pre-token with one id.
DIVIDER = " \x01 "
#: Punctuation that begins no contraction and no special string.
PLAIN = ".,!?;:%$&*#()-"


def _ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``at`` of a ragged array, end to end, and where each begins (one more at the end)."""
    n = sizes[at]
    ends = np.cumsum(n)
    first = ends - n
    return flat[np.arange(ends[-1] if len(n) else 0) + np.repeat(starts[at] - first, n)], np.r_[0, ends]


def _tails(parts: pa.Array, short: pa.Array, cut: pa.Array) -> pa.Array:
    """What ``short`` lacks of each part where ``cut`` says so, else nothing."""
    ends = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
    sizes = np.where(np.asarray(cut), np.diff(ends) - np.asarray(pc.binary_length(short), np.int64), 0)
    data = np.frombuffer(parts.buffers()[2] or b"", np.uint8)
    flat, first = _ragged(data, ends[1:] - sizes, sizes, np.arange(len(parts)))
    return pa.LargeStringArray.from_buffers(len(parts), pa.py_buffer(first.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat)))


class Encoder:
    """Whole texts to ids by the tokenizers library, through a bounded cache of what stands between blanks.

    The vocabulary's own rules drop blanks and never look across them, so the ids of a text are those of its parts
    between spaces and newlines, one after another. ``_parts_hold`` tries that on a probe when the file is loaded;
    for a vocabulary where it fails whole texts are encoded. A slice's parts are told apart and put together as arrays;
    only different ones are looked up, and only new ones go to the library.
    """

    def __init__(self, path: str, cache: int = 700_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.cache, self.known, self.by_parts = cache, {}, True
        self.divider = (self.tokenizer.encode(DIVIDER, add_special_tokens=False).ids + [-1])[0]
        self.by_parts = self._parts_hold()

    def _raw(self, texts: list[str]) -> list[bytes]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, self.kind).tobytes() for e in encode(texts, add_special_tokens=False)]

    def _raw_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of many short parts: encoded some hundreds at a time as one text, with a divider whose id nothing else has."""
        width, out = self.width, []
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        for a in range(0, len(parts), 400):
            group = parts[a : a + 400]
            text = DIVIDER.join(group)
            if text.count(DIVIDER) != text.count(DIVIDER[1]) or text.count(DIVIDER[1]) != len(group) - 1:
                out += self._raw(group)
                continue
            ids = np.array(encode([text], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.flatnonzero(ids == self.divider)
            if len(cuts) != len(group) - 1:
                out += self._raw(group)
                continue
            raw = ids.tobytes()
            out += [raw[p:q] for p, q in zip([0, *((cuts + 1) * width).tolist()], [*(cuts * width).tolist(), len(raw)])]
        return out

    def _parts_hold(self) -> bool:
        probe = ["It's  A\n\ntest, ofé é ́x 12 3.\n", " lead and trail ", "\n", "don 't stop", "a   b\t c", "J̌J. H̱, İ. ΟΣ!"]
        ids, bounds = self(pa.array(probe))
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])] == self._raw(probe)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and where each text's begin (one more at the end); null counts as empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not self.by_parts:
            raw = self._raw(texts.to_pylist())
            return np.frombuffer(b"".join(raw), self.kind), np.r_[0, np.cumsum([len(x) for x in raw], dtype=np.int64)] // self.width
        held = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = held.flatten().dictionary_encode()
        ids, bounds = _ragged(*self._part_ids(words.dictionary), np.asarray(words.indices))
        return ids, bounds[np.r_[0, np.cumsum(np.asarray(pc.list_value_length(held), np.int64))]]

    def _part_ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ragged ids of different parts. A part that ends in plain punctuation after a letter is two pre-tokens for the
        vocabulary's rule, and Latin letters are lower-cased by it, so most parts share the ids of a bare lower-case stem."""
        special = pc.match_substring(parts, "<|")
        short = pc.ascii_rtrim(parts, PLAIN)
        cut = pc.and_(pc.match_substring_regex(short, r"\pL$"), pc.invert(pc.or_(special, pc.match_substring_regex(short, "İ$"))))
        stem = pc.if_else(cut, short, parts)
        tail = _tails(parts, short, cut)
        plain = pc.and_(pc.match_substring_regex(stem, r"^[\x01-\x{24F}]*$"), pc.invert(pc.or_(special, pc.match_substring(stem, "İ"))))
        stem = pc.if_else(pc.and_(pc.string_is_ascii(stem), pc.invert(special)), pc.ascii_lower(stem), pc.if_else(plain, pc.utf8_lower(stem), stem))
        both = pa.concat_arrays([stem, tail]).dictionary_encode()
        raw = self._look_up(both.dictionary.to_pylist())
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // self.width
        at = np.asarray(both.indices, np.int64).reshape(2, -1).T.ravel()  # stem, tail, stem, tail
        flat, first = _ragged(np.frombuffer(b"".join(raw), self.kind), np.cumsum(sizes) - sizes, sizes, at)
        first = first[::2]
        return flat, first[:-1], np.diff(first)

    def _look_up(self, stems: list[str]) -> list[bytes]:
        known = self.known
        out = list(map(known.get, stems))
        new = [k for k, x in enumerate(out) if x is None]
        if new:
            if len(known) + len(new) > self.cache:
                known.clear()
            for k, x in zip(new, self._raw_parts([stems[k] for k in new])):
                out[k] = x
                if len(stems[k]) <= 64:  # longer ones would fill the cache
                    known[stems[k]] = x
        return out


_LOADED: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """The process's encoder of a file, with what it has cached. Tasks must call this by reference: a task's own function
    comes with copies of the globals it names, so a cache among those would start empty in every task."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def _ef(e: EliasFano) -> dict:
    return {"n": e.n, "base": e.base, "low_bits": e.low_bits, "low": e.low, "high": e.high, "samples": e.samples}


def _code(x: dict) -> EliasFano:
    return EliasFano(x["n"], x["base"], x["low_bits"], x["low"], x["high"], x["samples"])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, shards: int | None = None, block_tokens: int = 1 << 21, key: str = "doc_id", text: str = "text", name: str | None = None, slice_bytes: int = 4 << 20) -> None:
    """Encode every row's whole text, append ``end_id``, and write the ids in ascending ``key`` order.

    A null text counts as empty (its end id alone); rows without a key come first; rows that share a key all stay,
    ordered by a hash of their text and then by text, so that a key of any size is spread over ranges; an empty table
    writes no block; other columns are ignored. ``name`` is a column kept beside the key, where the key is only a place.
    One shuffle, by range; a shard is never held whole, and texts are encoded in slices of ``slice_bytes``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), (F.col(name).cast("long") if name else F.lit(None).cast("long")).alias("name"))
    rows = rows.withColumn("salt", F.xxhash64("text")).repartitionByRange(shards or partitions(spark), "key", "salt").sortWithinPartitions("key", "salt", "text")

    def encode(batches):
        encoder = encoder_for(tokenizer)
        shard, at, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []  # (keys, names, sizes, ids) of slices of the block to come
        have = 0

        def block():
            keys, names = (pa.concat_arrays([h[k] for h in held]) for k in (0, 1))
            sizes = np.concatenate([h[2] for h in held])
            bounds = np.r_[0, np.cumsum(sizes)]
            return {
                "shard": shard, "block": at, "n_docs": len(keys), "n_null": keys.null_count, "first": first, "n_tokens": int(bounds[-1]), "width": encoder.width,
                "ids": b"".join(h[3].tobytes() for h in held), "bounds": _ef(EliasFano.of(bounds)), "keys": _ef(EliasFano.of(np.asarray(keys.drop_null()))),
                "names": np.asarray(names.fill_null(0), "<i8").tobytes() if name else None,
            }

        for part in pieces(batches, slice_bytes):
            ids, bounds = encoder(part.column(1))
            sizes = np.diff(bounds) + 1
            bounds = np.r_[0, np.cumsum(sizes)]
            with_ends = np.full(bounds[-1], end_id, encoder.kind)
            own = np.ones(bounds[-1], bool)
            own[bounds[1:] - 1] = False
            with_ends[own] = ids
            cuts = np.flatnonzero(np.diff((have + bounds[1:]) // block_tokens, prepend=have // block_tokens)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
                if a == b:
                    continue
                held.append((part.column(0)[a:b], part.column(2)[a:b], sizes[a:b], with_ends[bounds[a] : bounds[b]]))
                if b in cuts:
                    row = block()
                    yield pa.RecordBatch.from_pylist([row], schema=_ARROW)
                    held, at, first = [], at + 1, first + row["n_tokens"]
            have = have + int(bounds[-1])
        if held:
            yield pa.RecordBatch.from_pylist([block()], schema=_ARROW)

    out = rows.select("key", "text", "name").mapInArrow(encode, SCHEMA)
    # The id arrays are packed already; a light codec takes what the frequent ids leave.
    out.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", 16).parquet(path)


def token_lengths(docs: DataFrame, tokenizer: str, text: str = "text", slice_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, source, n_tokens of every row: the ids that ``tokenizer`` makes of its whole text, and the end id. A null text
    counts as empty; other columns are ignored."""

    def count(batches):
        encoder = encoder_for(tokenizer)
        for part in pieces(batches, slice_bytes):
            bounds = encoder(part.column(2))[1]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(bounds) + 1, pa.int64())], names=["doc_id", "source", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "doc_id bigint, source string, n_tokens bigint")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the name, where one was written), start, n_tokens, ids_crc32 of every document, from the files alone.

    A block's boundaries come from its Elias-Fano code by select. ``start`` counts the ids of all documents before it in
    the whole set. The only figures brought together are one total a shard.
    """
    blocks = spark.read.schema(SCHEMA).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # One row a shard: as many as the partitions that wrote them.
    placed = blocks.join(F.broadcast(before), "shard").select("n_docs", "n_null", "first", "before", "width", "ids", "bounds", "keys", "names")

    def decode(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                bounds = _code(row["bounds"]).select(np.arange(row["n_docs"] + 1))
                wide = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(bounds, bounds[1:])]
                if row["names"] is None:
                    keys = pa.concat_arrays([pa.nulls(row["n_null"], pa.int64()), pa.array(_code(row["keys"]).select(np.arange(row["n_docs"] - row["n_null"])), pa.int64())])
                else:
                    keys = pa.array(np.frombuffer(row["names"], "<i8"), pa.int64())
                starts = pa.array(bounds[:-1] + row["first"] + row["before"], pa.int64())
                yield pa.RecordBatch.from_arrays([keys, starts, pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def document_ids(spark: SparkSession, path: str, key: int) -> list[np.ndarray]:
    """The ids of one document (of each row with that key): binary search by select on the blocks' key codes, then select of
    the two boundaries."""
    out = []
    last = F.col("keys.base")
    for row in spark.read.schema(SCHEMA).parquet(path).where((F.col("keys.n") > 0) & (last <= key)).orderBy(F.col("shard").desc(), F.col("block").desc()).toLocalIterator():
        keys, bounds = _code(row["keys"].asDict()), _code(row["bounds"].asDict())
        low, high = 0, keys.n
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if keys.value(mid) < key else (low, mid)
        at = low
        while at < keys.n and keys.value(at) == key:
            i = at + row["n_null"]
            out.append(np.frombuffer(row["ids"], f"<u{row['width']}")[bounds.value(i) : bounds.value(i + 1)])
            at += 1
        if keys.base < key:
            break
    return out
