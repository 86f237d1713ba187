import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from cases import documents, nothing

from lakewright.llm import bpe, token_files
from lakewright.llm.chunks import LONG
from lakewright.session import table

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def texts():
    rng = random.Random(1)
    odd = ["", " ", "\n", "a \nb", "x a\n a\n", "tab\tx", "don't I'll x's", "<|endoftext|> x", "a<|endoftext|>b c", "x <|endoftext|>", "x  <|endoftext|> \n<|endoftext|><|endoftext|> y", "<|endoftext| > <|endoftext|>.", "é ü  ñ", "日本語 テスト", "a" * 2000]
    return odd + ["".join(rng.choice(" \n\tab1'sé.!　\xa0Zll") for _ in range(rng.randint(0, 40))) for _ in range(1500)]


def test_transducer_is_the_library(library):
    own = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    own.transducer.limit = 5000  # so that it starts anew in between
    for t in texts():
        assert own.encode([t]) == [library.encode_ordinary(t)], t
    assert bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encode(texts()) == [library.encode_ordinary(t) for t in texts()]


def test_long_matches_are_put_out_in_steps(library, monkeypatch):
    monkeypatch.setattr(bpe, "STEP", 7)
    own = bpe.Transducer(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), pairs=500)
    rng = random.Random(2)
    parts = "tion er eau ment ou the ing é a s 日 aa".split()
    for _ in range(400):
        word = "".join(rng.choice(parts) for _ in range(rng.randint(1, 60)))
        assert own.encode(word.encode()) == library._encode_single_piece(word.encode()), word


def test_long_chunks_are_not_kept():
    own = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    own.encode(["x" * 5000 + " y"])
    assert max(map(len, [*own.cache.known, *own.matches])) <= LONG


def test_chunked_encoder_is_the_library(tokenizer):
    own = token_files.Encoder(P.path("byte_bpe_50k.json"))
    own.cache.limit = 50
    for t in texts():
        assert np.frombuffer(own.encode([t])[0], own.code).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
    fresh = token_files.Encoder(P.path("byte_bpe_50k.json"))
    for t, ids in zip(texts(), fresh.encode(texts())):
        assert np.frombuffer(ids, own.code).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def bpe_rows(rows, library):
    out = []
    for key, t in rows:
        ids = library.encode_ordinary(t or "")
        out.append((key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_bpe_rows(spark, library):
    for d in (documents(spark), table(spark, TINY, "documents"), nothing(spark)):
        got = sorted(map(tuple, bpe.encode_texts(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()), key=repr)
        assert got == bpe_rows([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()], library)


def test_decoding_is_streamed():
    own = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = "日本語é" * 9000
    pieces = list(own.decode(own.encode([text])[0]))
    assert len(pieces) > 2 and "".join(pieces) == text


def test_packing_round_trip():
    rng = np.random.default_rng(2)
    for width in (1, 5, 8, 13, 16, 17, 24):
        ids = rng.integers(0, 1 << width, 10_001, dtype=np.uint32)
        assert (token_files.unpack(token_files.pack(ids, width), width, len(ids)) == ids).all()
        image = token_files.Image(token_files.write_image([3, None], [1, 10_000], ids, width))
        assert (image.document(1) == ids[1:]).all() and image.keys == [3, None]
        assert (image.ids(4090, 20) == ids[4090:4110]).all() and len(image.ids(5, 0)) == 0


def test_files_are_read_by_place_and_by_document(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "IMAGE_IDS", 3000)
    d = table(spark, TINY, "documents")
    images, index = token_files.write_tokens(d, P.path("byte_bpe_50k.json"))
    rows = sorted((r.doc_id, r.text) for r in d.select("doc_id", "text").collect())
    each = [tokenizer.encode(t, add_special_tokens=False).ids + [0] for _, t in rows]
    ids = [i for x in each for i in x]
    for start, count in ((0, 10), (2990, 5000), (len(ids) - 7, 100)):
        got = sorted(map(tuple, token_files.read_range(images, index, start, count).collect()))
        assert got[0][0] == start and [i for _, x in got for i in x] == ids[start : start + count]
    starts = np.cumsum([0, *map(len, each)])
    for i in (0, 57, len(rows) - 1):
        assert token_files.read_document(images, index, rows[i][0]).collect() == [(starts[i], each[i])]
    assert token_files.read_document(images, index, 1 << 40).collect() == []


def test_an_id_of_many_rows_is_spread(spark):
    rows = [(None, f"text {i}") for i in range(300)] + [(7, f"other {i}") for i in range(300)] + [(i, "x") for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    rows = token_files._in_ranges(d, P.path("byte_bpe_50k.json"), token_files.END, 8).selectExpr("doc_id", "tie", "spark_partition_id() AS part").collect()
    assert len(rows) == 700 and len({r.part for r in rows if r.doc_id is None}) > 2 and len({r.part for r in rows if r.doc_id == 7}) > 2
    order = [(-1 if r.doc_id is None else r.doc_id, r.tie) for r in sorted(rows, key=lambda r: r.part)]
    assert [max(a[:1] for a in order[:i]) <= order[i][:1] for i in range(1, len(order))].count(False) == 0


def test_token_files(spark, tokenizer):
    special = spark.createDataFrame([(1, "<|endoftext|> x"), (2, "a<|endoftext|>")], "doc_id long, text string")
    for d in (documents(spark), table(spark, TINY, "documents"), nothing(spark), special):
        rows = sorted([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        want, at = [], 0
        for key, t in rows:
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
            want.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        got = token_files.token_files(d, P.path("byte_bpe_50k.json")).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_ranges_are_even_and_found_as_fast_among_many(spark):
    import time

    import numpy as np
    import pyarrow as pa

    ids = np.random.default_rng(8).permutation(200_000)
    d = spark.createDataFrame([(int(i) if i % 3 else None,) for i in ids], "doc_id long")
    for n in (1, 8, 400):
        bounds = token_files.bounds_of(d, n)
        ties = pa.array(np.random.default_rng(n).integers(-(1 << 63), (1 << 63) - 1, len(ids)))
        found = token_files.places(pa.array([int(i) if i % 3 else None for i in ids], pa.int64()), ties, bounds)
        sizes = np.bincount(found, minlength=n)
        # a third of the rows has no id: they fill a third of the ranges
        assert len(sizes) == n and sizes.max() <= 2 * len(ids) / n
    seconds = {}
    for n in (8, 4000):
        bounds = np.sort(np.random.default_rng(1).integers(0, 200_000, n - 1))
        began = time.perf_counter()
        for _ in range(20):
            token_files.places(pa.array(ids), ties, bounds)
        seconds[n] = time.perf_counter() - began
    assert seconds[4000] < 6 * seconds[8], seconds
