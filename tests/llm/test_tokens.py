import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import _bpe, bpe, token_output
from corpusloom.llm.queries import tokenizer

ODD = [(3, "Hello  world\n\n x<|endoftext|>é"), (1, None), (2, ""), (5, "a" * 5000), (5, "a" * 5000), (4, "don't 'tis 're ' \t\r\n 日本 🙂 ½ ٣\x85\x1c!"), (9, "  " * 400), (8, "<|endoftext|>"), (7, "b"), (7, None), (7, "a b c"), (7, "")]
#: Two words that a polynomial hash of letters modulo 2^64 can't tell apart, whatever its base.
PAIR = ["a", "b"]
for _ in range(10):
    PAIR = [PAIR[0] + PAIR[1], PAIR[1] + PAIR[0]]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer())
    t.no_truncation(), t.no_padding()
    return t


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, decoded int")


@pytest.mark.parametrize("rows", [ODD, []])
def test_encode_and_decode_match_the_library(spark, library, rows):
    got = sorted(map(tuple, bpe.digests(frame(spark, rows), tokenizer()).collect()))
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want)


def test_documents_match_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in bpe.digests(docs, tokenizer()).collect()}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


@pytest.mark.parametrize("rows", [ODD, []])
def test_token_files(spark, library, rows):
    got = sorted(map(tuple, token_output.digests(frame(spark, rows), tokenizer()).collect()))
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)


def test_rows_without_an_id_come_first(spark, library):
    rows = [(None, "one"), (1, "two words"), (None, None)]
    got = token_output.digests(frame(spark, rows), tokenizer()).collect()
    assert sorted((r.start, r.doc_id, r.n_tokens) for r in got) == [(0, None, 1), (1, None, 2), (3, 1, 3)]


def test_words_made_to_collide(spark, library):
    got = {r.doc_id: r.ids_sha256 for r in bpe.digests(frame(spark, list(enumerate(PAIR))), tokenizer()).collect()}
    crc = {r.doc_id: r.ids_crc32 for r in token_output.digests(frame(spark, list(enumerate(PAIR))), tokenizer()).collect()}
    for i, t in enumerate(PAIR):
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and crc[i] == zlib.crc32(np.array([*ids, 2], "<u4").tobytes())


def test_several_files_of_one_partition(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    path = token_output.write_shards(docs, tokenizer(), shard_tokens=1000)
    assert spark.read.parquet(path).count() >= 1
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_output.read_shards(spark, path).collect()}
    for r in docs.collect():
        assert ids[r.doc_id] == [*library.encode(r.text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("bits,shift", [(16, 0), (18, 200000)])
def test_wavelet_matrix(bits, shift):
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        x = shift + (rng.integers(0, 50257, n) if n < 5000 else rng.integers(0, 300, n))
        w = token_output.WaveletMatrix.from_bytes(token_output.WaveletMatrix.build(x, bits).to_bytes())
        assert (w.tokens() == x).all()
        if n:
            at = rng.integers(0, n, 20)
            assert (w.access(at) == x[at]).all()
            assert w.count(int(x[0])) == (x == x[0]).sum() and w.rank(int(x[0]), n // 2) == (x[: n // 2] == x[0]).sum()
            assert (w.locate(int(x[0])) == np.flatnonzero(x == x[0])).all()


def test_transducer_knows_its_words_only(tmp_path):
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["the", "then", "they", "lay", "say", "saying", "é"])}
    bpe.Transducer.build(words).save(str(tmp_path / "t"))
    t = bpe.Transducer.open(str(tmp_path / "t"))
    data, sizes = bpe.piece_bytes([*(w.decode() for w in words), "th", "layer", "x"])
    rows = t.rows(data, sizes)
    assert [t.ids[t.first[r] : t.first[r + 1]].tolist() for r in rows[:-3]] == list(words.values())
    assert (rows[-3:] == -1).all()
    assert len(t.final) - 1 < sum(map(len, words))  # endings are shared


def test_bounded_piece_table(library):
    merges = _bpe.Merges(_bpe.load(tokenizer())["model"])
    table = _bpe.PieceTable(lambda p: merges.apply(*bpe.piece_bytes(p)), most=3)
    for t in ["a b c d e", "f g h", "a b c zz"]:
        assert _bpe.encode_texts([t], table, {})[0].tolist() == library.encode(t).ids


def test_long_pieces_without_blanks(library):
    """A megabyte of letters, and of Chinese characters, in one piece each, as the library merges them."""
    merges = _bpe.Merges(_bpe.load(tokenizer())["model"])
    r = np.random.default_rng(4)
    letters = bytes(r.integers(97, 123, 1 << 20, dtype=np.uint8)).decode()
    chinese = "".join(map(chr, r.integers(0x4E00, 0x5E00, 40000)))
    for text in (letters, chinese, "a" * 100000, "ab" * 700):
        ids, counts = merges.apply(np.frombuffer(text.encode(), np.uint8), np.array([len(text.encode())]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]
    pieces = [b"hello", letters[:3000].encode(), b"world", b"x" * 513, b"y"]
    ids, counts = merges.apply(np.frombuffer(b"".join(pieces), np.uint8), np.array(list(map(len, pieces))))
    assert np.split(ids, np.cumsum(counts)[:-1])[1].tolist() == library.encode(letters[:3000], add_special_tokens=False).ids
    assert len(counts) == 5 and ids.tolist() == sum((library.encode(p.decode(), add_special_tokens=False).ids for p in pieces), [])
