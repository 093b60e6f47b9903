"""Token operators against the libraries whose ids they must give."""

import cProfile
import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from twinfold.llm import common, piece_codec, token_counts, token_output

PIECES, BYTES, WORDS = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = ["a", "b", " ", "  ", "\n", " the", "ing", "'s", "é", "<|endoftext|>", "<|startoftext|>", "中", "1", "!", "\t", "\r",
         "　", "\x1c", "Σ", "́", "\x85", "😀", "▁", "<s>", "<0x0A>", "\x00"]


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(250)]
    return made + [None, "", " ", "\n", "x" * 70_000, "word " * 15_000, " " * 50_000, "ab <|endoftext|> cd\n" * 4_000, "same", "same"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i}", i) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, row int").repartition(3).cache()


def test_pieces_equal_the_library(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = {r.doc_id: r for r in piece_codec.op3_pieces(docs, PIECES).collect()}
    for i, text in enumerate(texts()):
        ids = sp.encode(text or "", add_eos=True)
        want = (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(sp.decode(ids).encode()).hexdigest())
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == want, i


def test_decode_any_ids_as_the_library_does():
    sp, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(2)
    for _ in range(3_000):
        ids = [rng.randrange(32_000) if rng.random() < 0.6 else rng.randrange(260) for _ in range(rng.randrange(12))]
        assert piece_codec.decode(np.array(ids, np.uint32), PIECES) == sp.decode(ids)


def test_counts_equal_the_library(docs, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", 900)
    monkeypatch.setattr(token_counts, "OVERLAP", 64)
    t = Tokenizer.from_file(BYTES)
    found = {r.doc_id: r for r in token_counts.op8_token_counts(docs, BYTES).collect()}
    assert len(found) == len(texts())
    for i, text in enumerate(texts()):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (found[i].n_bytes, found[i].n_tokens, found[i].over_limit) == (len((text or "").encode()), n, n > 1024), i


def test_token_files_hold_the_ids_in_order(docs):
    t, start = Tokenizer.from_file(WORDS), 0
    found = {r.doc_id: r for r in token_output.op5_token_output(docs, WORDS).collect()}
    for i, text in enumerate(texts()):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), crc32(ids.tobytes())), i
        start += len(ids)


def test_token_files_of_odd_ids(spark):
    rows = [(5, "b c"), (None, "a"), (-3, "x y"), (5, "b c"), (None, None), (5, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(token_output.op5_token_output(df, WORDS).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, -3, 5, 5, 5]
    t = Tokenizer.from_file(WORDS)
    sums = sorted(crc32(np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for _, x in rows)
    assert sorted(r.ids_crc32 for r in got) == sums
    ends = [r.start + r.n_tokens for r in got]
    assert [r.start for r in got] == [0, *ends[:-1]]


def test_memos_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(common, "MEMO_BYTES", 5_000)
    memo = common.Memo(lambda keys: [k.encode() * 2 for k in keys])
    for start in range(0, 2_000, 100):
        keys = [f"k{i}" for i in range(start, start + 100)] + ["x" * 5_000, "k0"]
        assert memo.fetch([keys, ["k0"]]) == [[k.encode() * 2 for k in keys], [b"k0k0"]]
        assert len(memo.young) + len(memo.old) < 60 and "x" * 5_000 not in memo.young
    common.give_back()
    assert not memo.young and not memo.old


def test_workers_empty_their_memos(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(80)], "doc_id bigint, text string").repartition(8)
    piece_codec.encoded(docs, path).collect()

    def left(batches):
        for batch in batches:
            memo = piece_codec._memo(path)
            yield pa.RecordBatch.from_arrays([pa.array([len(memo.young) + len(memo.old)])], names=["n"])

    assert {r.n for r in docs.mapInArrow(left, "n bigint").collect()} == {0}


def test_blocks_decode_from_any_place_and_notice_damage():
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.3, 120_000).clip(0, 4_999).astype(np.uint32)
    table = token_output.make_table(np.bincount(ids, minlength=5_000))
    assert int(table.freq.sum()) == 1 << table.bits
    for n in (1, 15, 16, 1_000, len(ids)):
        data = token_output.encode_block(ids[:n], table)
        assert (token_output.decode_block(data, table) == ids[:n]).all()
    assert len(data) < 1.05 * 120_000 * -np.log2((p := np.bincount(ids) / len(ids))[ids]).mean() / 8 + 60_000 and p.sum() > 0
    for lo, hi in ((0, 10), (70_000, 70_500), (119_999, 120_000)):
        assert (token_output.decode_block(data, table, lo, hi) == ids[lo:hi]).all()
    frame = bytearray(token_output.encode_frame([(3, ids[:10]), (9, ids[10:2_000])], table))
    assert [(k, x.tolist()) for k, x in token_output.decode_frame(bytes(frame), table)] == [(3, ids[:10].tolist()), (9, ids[10:2_000].tolist())]
    frame[-3] ^= 1
    with pytest.raises(ValueError):
        list(token_output.decode_frame(bytes(frame), table))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert piece_codec.op3_pieces(none, PIECES).count() == 0
    assert token_counts.op8_token_counts(none, BYTES).count() == 0
    assert token_output.op5_token_output(none, WORDS).count() == 0


def test_encoding_words_takes_no_step_of_python_per_token():
    rng, m = random.Random(3), piece_codec.load(PIECES)
    letters = sorted(c for c in m.known if c.isalpha())[:200]
    marked = [piece_codec.MARK + "".join(rng.choices(letters, k=rng.randrange(1, 24))) for _ in range(4000)]
    profile = cProfile.Profile()
    ids = profile.runcall(piece_codec.encode_marked, m, marked)
    assert sum(map(len, ids)) > 4 * 8 * len(marked)  # more than eight tokens a word
    assert sum(entry.callcount for entry in profile.getstats()) < 6 * len(marked)


def test_marked_texts_with_odd_characters_equal_the_library():
    sp, m, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.load(PIECES), random.Random(4)
    texts = ["", "\n", "a\nb", "]^-\\[", "\U0001f9ec", "x\U0001f9ec\U0001f9ecy", "\n"]
    texts += ["".join(rng.choices("abé \n]^-\\\U0001f9ec是", k=rng.randrange(40))) for _ in range(300)]
    for some in (texts, texts[:1], texts[3:4], []):
        found = piece_codec.encode_marked(m, [piece_codec.MARK + t.replace(" ", piece_codec.MARK) if t else "" for t in some])
        assert [np.frombuffer(x, np.uint32).tolist() for x in found] == [sp.encode(t) for t in some]
