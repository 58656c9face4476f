"""Language identification with a bit-sliced Bloom filter of n-grams.

The filter is one array of slots, each a bit mask of languages. An n-gram of a language sets that language's bit in its
two slots; the slots of a text's n-gram, and-ed, name all languages that (seem to) hold it. A text's bits are counted
for each language, the share that the filter's fill gives by chance is taken off, and the highest share decides.
N-grams are four bytes of text whose A-Z is lower-cased and whose other ASCII but letters is blank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import pieces

_TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_BLANK = int.from_bytes(b"    ", "little")


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Four-byte n-grams of each text with a letter in them, end to end, and the text of each."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer((b"    " + b"    ".join(raw) + b"    ").translate(_TABLE), np.uint8)
    grams = np.ndarray((len(data) - 3,), "<u4", data, 0, (1,))
    # A text's n-grams begin two bytes before it (a word's beginning) and end two bytes after it.
    width = np.where(sizes > 0, sizes + 1, 0)
    begin = 4 + np.cumsum(sizes + 4) - (sizes + 4) - 2
    owner = np.repeat(np.arange(len(raw)), width)
    at = np.arange(width.sum()) + np.repeat(begin - (np.cumsum(width) - width), width)
    g = grams[at]
    some = g != _BLANK
    return g[some], owner[some]


class LanguageFilter:
    """Slots of language bits, with each language's rate of chance hits."""

    def __init__(self, grams: dict[str, np.ndarray], bits: int = 18):
        self.languages, self.bits = sorted(grams), bits
        self.words = max(1, -(-len(self.languages) // 64))
        self.slots = np.zeros((self.words, 1 << bits), np.uint64)
        for k, name in enumerate(self.languages):
            for at in self._at(np.asarray(grams[name], np.uint32)):
                self.slots[k // 64][at] |= np.uint64(1 << (k % 64))
        fill = np.array([((self.slots[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(self.languages))])
        self.chance = fill**2
        if len(self.languages) <= 8:
            self.slots = self.slots.astype(np.uint8)

    def _at(self, g: np.ndarray) -> list[np.ndarray]:
        out = []
        for c in (0x9E3779B1, 0x85EBCA77):
            x = (g ^ (g >> np.uint32(15))) * np.uint32(c)
            out.append((x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - self.bits))
        return out

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """For each text and language, the share of n-grams the language holds beyond chance (0 to 1)."""
        g, owner = _grams(texts)
        n = np.bincount(owner, minlength=len(texts))
        a, b = self._at(g)
        out = np.zeros((len(texts), len(self.languages)))
        for w in range(self.words):
            mask = self.slots[w][a] & self.slots[w][b]
            own = range(64 * w, min(64 * w + 64, len(self.languages)))
            if self.slots.dtype == np.uint8:
                count = np.bincount(owner * 256 + mask, minlength=256 * len(texts)).reshape(-1, 256)
                for k in own:
                    out[:, k] = count[:, (np.arange(256) >> k & 1).astype(bool)].sum(1)
            else:
                for k in own:
                    out[:, k] = np.bincount(owner, (mask >> np.uint64(k % 64)) & np.uint64(1), len(texts))
        return np.maximum(0, (out / np.maximum(n, 1)[:, None] - self.chance) / (1 - self.chance))


def _first(rows: DataFrame, order: list, salt, n: int) -> DataFrame:
    """The first ``n`` rows of each language: first of each of 64 salted parts of it, then of what those give, so that no
    task gets more than 64 n rows of a language."""
    for keys in (["lang", "_s"], ["lang"]):
        w = Window.partitionBy(*keys).orderBy(*order)
        rows = rows.withColumn("_s", F.pmod(salt, F.lit(64))).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    return rows.drop("_s", "_k")


def fit(docs: DataFrame, per_language: int = 1000, grams: int = 6000) -> LanguageFilter:
    """A filter from rows of (doc_id, text, lang) with a lang.

    Bounds of the fit, both parameters: at most ``per_language`` rows of each language, those with the smallest hashes
    of doc_id, then of text (whole texts; rows without doc_id are not learned from), and of their n-grams the ``grams`` most frequent. Counting is distributed; only the chosen
    n-grams come to the driver.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang")
    chosen = _first(rows, [F.xxhash64("doc_id"), F.col("doc_id")], F.xxhash64("doc_id", F.lit(1)), per_language).select("doc_id").distinct()
    # At most per_language ids a language: bounded by the parameter. Rows that share an id are bounded once more.
    texts = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    texts = _first(texts, [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text"), F.col("text")], F.xxhash64("text", F.lit(1)), per_language).select("lang", "text")

    def count(batches):
        for batch in pieces(batches, 1 << 20):
            g, owner = _grams(batch.column(1).to_pylist())
            names = batch.column(0).to_pylist()
            kinds = sorted(set(names))
            index = np.array([kinds.index(n) for n in names], np.uint64)
            key, n = np.unique(index[owner] << np.uint64(32) | g, return_counts=True)
            langs = pa.array([kinds[k] for k in (key >> np.uint64(32)).tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([langs, pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64), pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    total = texts.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = _first(total, [F.col("n").desc(), F.col("gram")], F.xxhash64("gram"), grams)
    held: dict[str, list] = {}
    for r in top.select("lang", "gram").collect():
        held.setdefault(r["lang"], []).append(r["gram"])
    return LanguageFilter({k: np.array(v, np.uint32) for k, v in held.items()})


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """doc_id, lang_pred, score of every row's whole text.

    ``und`` with score 0 for a null text, one without a letter, or a model without languages; equal shares go to the
    name that sorts first. ``score`` is the winner's part of all languages' shares. Rows are judged each for itself;
    other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # two to the bits slots, whatever the data
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))

    def judge(batches):
        model = shared.value
        for batch in pieces(batches, 1 << 20):
            texts = batch.column(1).to_pylist()
            has = [bool(t) and any(map(str.isalpha, t)) for t in texts]
            if model.languages:
                share = model.shares(texts)
                best = share.argmax(1)
                score = share[np.arange(len(texts)), best] / np.maximum(share.sum(1), 1e-12)
            else:
                has = [False] * len(texts)
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
            name = [model.languages[b] if h else "und" for b, h in zip(best.tolist(), has)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.string()), pa.array(np.where(has, np.clip(score, 0, 1), 0.0), pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"doc_id {kind}, lang_pred string, score double")
