"""Token counts by rank-synchronous array merging.

The pieces of a byte-pair model with scores are held as arrays: a pair of symbols has at most one merged piece, and
that piece's score is its rank. Texts are cut where no piece of the vocabulary can reach across, the distinct cuts
(pre-tokens) of a batch are laid out as one ragged array of symbols, and all of them advance together: in each round
every sequence applies its lowest-rank pair. What survives is counted; a symbol that is no piece counts as its UTF-8
bytes (byte fallback). Nothing is shuffled: one narrow pass, memory bounded by a batch and a bounded cache.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import pieces

NONE = np.iinfo(np.int64).max


#: Texts on which other rules than those of ``PieceModel`` show: compatibility forms, composition, blanks, bytes.
PROBE = ["ﬁ ① Ａ ½ é ́x", "  two  blanks ", "a\tb\r\n\nc", "\u200b\u3000\u00a0x", "\x00\x01", "日本語 𝔘 🙂", "The quick brown fox, it's 12.5%!", "▁a▁▁b", ""]


class PieceModel:
    """Ranks and merges of a sentencepiece BPE model, read from the library's own tables."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): i for i in plain}
        self.symbols = {p: k for k, p in enumerate(pieces)}
        scores = np.array([sp.get_score(i) for i in pieces.values()])
        rank = np.unique(-scores, return_inverse=True)[1]
        self.size = len(pieces)
        rows = [(a, b, k) for p, k in self.symbols.items() for i in range(1, len(p)) if (a := self.symbols.get(p[:i])) is not None and (b := self.symbols.get(p[i:])) is not None]
        made = np.array(rows, np.int64).reshape(-1, 3)
        self._fill(made[:, 0] * (self.size + 1) + made[:, 1], made[:, 2], rank[made[:, 2]])
        chars = {c for p in pieces for c in p}
        self.inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.chars = chars
        self.mark = "▁"
        # A mark never follows another letter inside a piece, so a text may be cut before every run of marks.
        if any(self.mark in p.lstrip(self.mark) for p in pieces):
            raise ValueError(f"{path}: a piece goes over a blank")
        self.newline = "\n" not in chars
        # Counted here are models of pairs with scores that take texts as they are, a blank put in front, and that fall
        # back to bytes. Any other (normalising, user-defined pieces, unigrams) fails on this probe.
        probe = [*PROBE, " ".join(sorted(pieces, key=len)[-200:]).replace(self.mark, " ")]
        if self.counts_of(probe) != [len(x) for x in sp.encode(probe)]:
            raise ValueError(f"{path}: not a byte-fallback pair model without normalisation")

    def counts_of(self, texts: list[str]) -> list[int]:
        return Counter(self)(texts)

    def _fill(self, keys: np.ndarray, merged: np.ndarray, ranks: np.ndarray, bits: int = 19) -> None:
        """Pairs in an open hash table (linear probing), sized so that nearly every look-up ends at its first slot."""
        bits = max(bits, int(len(keys)).bit_length() + 3)
        self.shift, self.slots = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.merged, self.ranks = np.full(1 << bits, -1), np.full(1 << bits, -1, np.int32), np.full(1 << bits, NONE)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[at] < 0
            first = np.unique(at[free], return_index=True)[1]
            won = np.flatnonzero(free)[first]
            self.keys[at[won]], self.merged[at[won]], self.ranks[at[won]] = keys[todo[won]], merged[todo[won]], ranks[todo[won]]
            lost = np.ones(len(todo), bool)
            lost[won] = False
            todo, at = todo[lost], (at[lost] + 1) & self.slots

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NONE where they do not merge."""
        key = left * (self.size + 1) + right
        at = self._slot(key)
        have = self.keys[at]
        on = np.flatnonzero((have != key) & (have >= 0))
        while on.size:
            at[on] = (at[on] + 1) & self.slots
            have = self.keys[at[on]]
            on = on[(have != key[on]) & (have >= 0)]
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def counts(self, tokens: list[str]) -> np.ndarray:
        """Surviving symbols of each pre-token.

        A round applies, in every sequence, its lowest-rank pair at all places at once, left to right without
        overlap. Where that would make a new pair ranked no later than the one applied (then the order of
        application matters), that sequence applies the leftmost place alone.
        """
        lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
        text = "".join(tokens)
        other = self.size  # of a character without a piece
        sym = np.fromiter(map(self.symbols.get, text, repeat(other)), np.int64, len(text))
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        width = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        worth = np.where(sym == other, width, 1).astype(np.int64)
        seq = np.repeat(np.arange(len(tokens)), lens)
        out = np.bincount(seq, worth, len(tokens)).astype(np.int64)
        rank, made = self._pairs(sym, seq)
        while True:
            # Sequences that still have something to merge; the others leave the arrays.
            live = np.zeros(len(tokens), bool)
            live[seq[rank != NONE]] = True
            keep = live[seq]
            if not keep.any():
                return out
            if not keep.all():
                sym, seq, rank, made = sym[keep], seq[keep], rank[keep], made[keep]
            n = len(sym)
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, first)
            at = np.flatnonzero(rank == np.repeat(low, np.diff(np.r_[first, n])))
            # Left to right without overlap: within a run of adjacent places every second one is taken.
            fresh = np.r_[True, np.diff(at) > 1]
            at = at[(at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 0]
            new, own, limit = made[at], seq[at], rank[at]
            before, after = np.maximum(at - 1, 0), np.minimum(at + 2, n - 1)
            has_b, has_a = (at > 0) & (seq[before] == own), (at + 2 < n) & (seq[after] == own)
            early = has_b & (self.pair(sym[before], new)[0] <= limit)
            early |= has_a & (self.pair(new, sym[after])[0] <= limit)
            near = np.flatnonzero((np.diff(at) == 2) & (own[1:] == own[:-1])) + 1
            early[near] |= self.pair(new[near - 1], new[near])[0] <= limit[near]
            if early.any():
                alone = np.zeros(len(tokens), bool)
                alone[own[early]] = True
                leftmost = np.r_[True, own[1:] != own[:-1]]
                pick = ~alone[own] | leftmost
                at, new, own = at[pick], new[pick], own[pick]
            out -= np.bincount(own, minlength=len(tokens))
            sym[at] = new
            stay = np.ones(n, bool)
            stay[at + 1] = False
            sym, seq, rank, made = sym[stay], seq[stay], rank[stay], made[stay]
            at -= np.arange(len(at))
            for place in (at, at[at > 0] - 1):
                left = place[place + 1 < len(sym)]
                rank[place], made[place] = NONE, -1
                left = left[seq[left + 1] == seq[left]]
                rank[left], made[left] = self.pair(sym[left], sym[left + 1])

    def _pairs(self, sym, seq):
        rank, made = np.full(len(sym), NONE), np.full(len(sym), -1)
        left = np.flatnonzero(seq[1:] == seq[:-1])
        rank[left], made[left] = self.pair(sym[left], sym[left + 1])
        return rank, made

    def cuts(self, text: str) -> list[str]:
        """Pre-tokens of a text: its blanks as marks, one put in front, cut before each run of marks and round newlines."""
        if not text:
            return []
        mark = self.mark
        if self.newline and "\n" in text:
            out: list[str] = []
            for k, line in enumerate(text.split("\n")):
                if k:
                    out.append("\n")
                if line or not k:
                    out += self._line(line, k == 0)
            return out
        return self._line(text, True)

    def _line(self, line: str, first: bool) -> list[str]:
        mark = self.mark
        if mark in line:
            line = line.replace(mark, " ")
        parts = line.split(" ")
        if "" not in parts[1:] and (parts[0] or not first):
            head = [mark + parts[0]] if first else [parts[0]] if parts[0] else []
            return head + [mark + p for p in parts[1:]]
        out, marks = [], 0 if not first else 1
        if parts[0] or len(parts) == 1:
            out.append(mark * marks + parts[0])
            marks = 0
        for p in parts[1:]:
            marks += 1
            if p:
                out.append(mark * marks + p)
                marks = 0
        if marks:
            out.append(mark * marks)
        return out


class Counter:
    """Counts of whole texts through a bounded cache of pre-tokens."""

    def __init__(self, model: PieceModel, cache: int = 400_000):
        self.model, self.cache, self.known = model, cache, {}

    def __call__(self, texts: list[str]) -> list[int]:
        held = [self.model.cuts(t) for t in texts]
        need = set().union(*held) if held else set()
        if len(self.known) + len(need) > self.cache:
            self.known = {}
        new = [t for t in need if t not in self.known]
        new.sort(key=len)
        # Very long pre-tokens go apart, so that one of them does not keep a whole batch of short ones waiting.
        for a in range(0, len(new), 8_000):
            part = new[a : a + 8_000]
            self.known.update(zip(part, self.model.counts(part).tolist()))
        get = self.known.__getitem__
        return [sum(map(get, h)) for h in held]


_LOADED: dict[str, Counter] = {}


def counter_for(path: str) -> Counter:
    """The process's counter of a model, with what it has cached; called by reference from every task."""
    if path not in _LOADED:
        _LOADED[path] = Counter(PieceModel(path))
    return _LOADED[path]


def token_counts(docs: DataFrame, model: str, max_tokens: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_bytes, n_tokens, over_limit of every row's whole text.

    ``model`` names a sentencepiece BPE file; it is read where the rows are. A null text counts as empty: 0 bytes and
    0 tokens. Rows that share a key each give a row; other columns are ignored, whatever their names; an empty table
    gives an empty result. Texts are counted in slices of about 1 MB (a longer one by itself).
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def count(batches):
        counter = counter_for(model)
        for part in pieces(batches, 1 << 20):
            texts = [t or "" for t in part.column(1).to_pylist()]
            size = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
            n = counter(texts)
            over = pa.array([x > max_tokens for x in n], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n, pa.int64()), over], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
