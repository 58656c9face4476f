"""Token output and counts against the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm.elias_fano import EliasFano
from ledgerline.llm.token_counts import Counter, PieceModel, token_counts
from ledgerline.llm.token_output import Encoder, document_ids, read_tokens, write_tokens
from tests.llm.odd import documents, frame

WORD, PIECE = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(10**12), 10**12), max_size=700))
def test_elias_fano(values):
    values = sorted(values)
    e = EliasFano.of(values)
    assert e.values().tolist() == values
    for i in {0, len(values) // 2, len(values) - 1} & set(range(len(values))):
        assert e.value(i) == values[i]
    some = [i for i in range(0, len(values), 7)][::-1]
    assert e.select(some).tolist() == [values[i] for i in some]


def test_elias_fano_wide():
    values = [-(2**63), -5, 0, 3, 2**62, 2**63 - 1]
    e = EliasFano.of(values)
    assert e.values().tolist() == values and e.value(4) == 2**62
    dense = np.repeat(np.arange(5000), 3)
    assert EliasFano.of(dense).select(np.arange(0, 15000, 11)).tolist() == dense[::11].tolist()


def texts():
    rng = random.Random(3)
    parts = ["a", "B", "in", "er", "the", " ", "  ", "\n", "\t", "é", "é", "日", "▁", "'s", "12", "!", "!!", ".", ",", "<|endoftext|>", "<s>", "\x01", "\x00", "ΑΣ", "İ", "==", "x" * 70]
    return ["", " ", "a" * 3000, " " * 40] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(400)] + [r[1] or "" for r in documents()]


def test_encoder():
    e = Encoder(WORD, cache=500)
    assert e.by_parts
    for a in range(0, len(texts()), 50):
        part = texts()[a : a + 50]
        ids, bounds = e(pa.array(part + [None]))
        assert [ids[p:q].tobytes() for p, q in zip(bounds, bounds[1:])] == e._raw(part + [""])
    assert [len(x) for x in e(pa.array([], pa.string()))] == [0, 1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n.!,'aAéÉİǰJ̌Σς<|>"), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_encoder_any(given_texts):
    e = ENCODERS.setdefault(0, Encoder(WORD))
    ids, bounds = e(pa.array(given_texts, pa.string()))
    assert [ids[p:q].tobytes() for p, q in zip(bounds, bounds[1:])] == e._raw(given_texts)


ENCODERS: dict = {}


def test_counter():
    import sentencepiece

    sp, c = sentencepiece.SentencePieceProcessor(model_file=PIECE), Counter(PieceModel(PIECE), cache=500)
    for a in range(0, len(texts()), 50):
        part = texts()[a : a + 50]
        assert c(part) == [len(x) for x in sp.encode(part)]


def test_other_models(tmp_path):
    """Models with other rules are refused, not miscounted: here the same pieces with NFKC folding put before them."""
    import pytest
    import sentencepiece

    class Folding(sentencepiece.SentencePieceProcessor):
        def encode(self, texts, **more):
            import unicodedata

            return super().encode([unicodedata.normalize("NFKC", t) for t in texts], **more)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(sentencepiece, "SentencePieceProcessor", Folding)
        with pytest.raises(ValueError):
            PieceModel(PIECE)


def test_counts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = sorted(map(tuple, token_counts(frame(spark), PIECE, 50).collect()))
    want = sorted((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 50) for i, t, *_ in documents())
    assert got == want
    assert token_counts(frame(spark, []), PIECE).count() == 0


def test_files(spark, tmp_path):
    rows = documents() + [(None, "no id", "en", "s", 1), (-5, "negative", "en", "s", 1)]
    path = str(tmp_path / "tokens")
    write_tokens(frame(spark, rows), path, WORD, shards=3, block_tokens=500)
    got = [tuple(r) for r in read_tokens(spark, path).orderBy("start").collect()]
    raw = Encoder(WORD)._raw
    salt = lambda t: 42 if t is None else int(np.uint64(xxhash.xxh64(t.encode(), seed=42).intdigest()).astype(np.int64))  # noqa: E731  Spark's xxhash64
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, salt(r[1]), r[1] or ""))
    ids = [np.frombuffer(raw([t or ""])[0], "<u2").astype("<u4").tolist() + [1] for _, t, *_ in order]
    starts = np.cumsum([0] + [len(x) for x in ids])
    assert got == [(r[0], int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, s, x in zip(order, starts, ids)]
    assert [x.tolist() for x in document_ids(spark, path, 20)] == [x for r, x in zip(order, ids) if r[0] == 20]
    assert sorted(x.tolist() for x in document_ids(spark, path, 4)) == sorted(x for r, x in zip(order, ids) if r[0] == 4)
    assert document_ids(spark, path, 9999) == []
    named = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "place bigint, doc_id bigint, text string, lang string, source string, n_chars bigint")
    write_tokens(named, str(tmp_path / "named"), WORD, shards=3, block_tokens=500, key="place", name="doc_id")
    assert sorted(str(r["doc_id"] or 0) for r in read_tokens(spark, str(tmp_path / "named")).collect()) == sorted(str(r[0] or 0) for r in rows)
    placed = [r["doc_id"] or 0 for r in named.orderBy("place").collect()]
    assert [r["doc_id"] for r in read_tokens(spark, str(tmp_path / "named")).orderBy("start").collect()] == placed
    write_tokens(frame(spark, []), str(tmp_path / "none"), WORD)
    assert read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_registered(spark, sf):
    """The queries themselves over the whole table against the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    from ledgerline.llm.queries import op2_token_output, op10_token_counts

    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    sp, t, start, want = sentencepiece.SentencePieceProcessor(model_file=PIECE), Tokenizer.from_file(WORD), 0, []
    for i, text in docs:
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in op2_token_output(spark, sf).collect()) == want
    counts = [(i, len(x.encode()), n := len(sp.encode(x)), n > 4096) for i, x in docs]
    assert sorted(tuple(r) for r in op10_token_counts(spark, sf).collect()) == counts
