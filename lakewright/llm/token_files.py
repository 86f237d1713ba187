"""Token ids in bit-packed files: fixed width, block offsets, random access."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.llm.chunks import LONG, ChunkCache, groups
from lakewright.llm.common import pick
from lakewright.session import materialize

#: A file image starts with this; then width, documents, ids, ids a block.
MAGIC, HEAD = b"LWTOK1\0\0", struct.Struct("<8sIIQI")
#: Ids of one block (whole bytes at any width), ids after which an image is closed, chunks that a worker keeps.
BLOCK, IMAGE_IDS, CHUNKS = 4096, 500_000, 1_000_000
END = 0
#: Marks that may stand behind a word, and how byte-level vocabularies spell bytes that don't print.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPELT = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


def pack(ids: np.ndarray, width: int) -> bytes:
    """width bits for each id, lowest bit first; the tail is filled with zero bits. Whole bytes are copied as such."""
    if width == 8 * ids.itemsize:
        return ids.tobytes()
    ids = ids.astype("<u4", copy=False)
    if width % 8 == 0:
        return np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4)[:, : width // 8]).tobytes()
    out = bytearray()
    step = BLOCK * 16
    for at in range(0, len(ids), step):
        bits = (ids[at : at + step, None] >> np.arange(width, dtype=np.uint32)).astype(np.uint8) & 1
        out += np.packbits(bits.reshape(-1), bitorder="little").tobytes()
    return bytes(out)


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    if width % 8 == 0:
        wide = np.zeros((count, 4), np.uint8)
        wide[:, : width // 8] = np.frombuffer(data, np.uint8, count * width // 8).reshape(count, -1)
        return wide.view("<u4").reshape(-1)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    out = np.zeros(count, np.uint32)
    for k in range(width):
        out |= bits[:, k].astype(np.uint32) << np.uint32(k)
    return out


def write_image(keys: list[int | None], lengths: list[int], ids: np.ndarray, width: int) -> bytes:
    """A file image: header, doc ids with their null flags, lengths, byte offset of each block, packed ids."""
    blocks = np.arange(0, max(len(ids), 1), BLOCK, dtype=np.uint64) * np.uint64(width) // np.uint64(8)
    return b"".join(
        (
            HEAD.pack(MAGIC, width, len(keys), len(ids), len(blocks)),
            np.array([0 if k is None else k for k in keys], np.int64).tobytes(),
            np.array([k is None for k in keys], np.uint8).tobytes(),
            np.array(lengths, np.uint32).tobytes(),
            blocks.tobytes(),
            pack(ids, width),
        )
    )


class Image:
    """Reads a file image: any range of ids, or all documents."""

    def __init__(self, data: bytes):
        magic, self.width, self.n_docs, self.n_ids, n_blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size
        keys = np.frombuffer(data, np.int64, self.n_docs, at)
        at += 8 * self.n_docs
        null = np.frombuffer(data, np.uint8, self.n_docs, at)
        at += self.n_docs
        self.lengths = np.frombuffer(data, np.uint32, self.n_docs, at)
        at += 4 * self.n_docs
        self.offsets = np.frombuffer(data, np.uint64, n_blocks, at)
        self.body = memoryview(data)[at + 8 * n_blocks :]
        self.keys = [None if z else int(k) for k, z in zip(keys, null)]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])

    def ids(self, start: int, count: int) -> np.ndarray:
        """Only the blocks that hold them are unpacked."""
        if count <= 0:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (start + count - 1) // BLOCK
        held = min((last + 1) * BLOCK, self.n_ids) - first * BLOCK
        lo = int(self.offsets[first])
        hi = lo + (held * self.width + 7) // 8
        return unpack(bytes(self.body[lo:hi]), self.width, held)[start - first * BLOCK :][:count]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.lengths[i]))


class Encoder:
    """The tokenizers library, as it is loaded, with a memory of recent chunks; texts that can't be cut into chunks go to it whole.

    An added token holds no blank, so it lies inside one chunk, and the library finds it there as in the whole text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = max(1, (self.library.get_vocab_size() - 1).bit_length())
        self.code = "<u2" if self.width <= 16 else "<u4"
        self.cache = ChunkCache(CHUNKS)
        self.model, self.marks = self.library.model, {}
        # the model's own memory of 10,000 words helps none of the words that come here, each being new
        self.model._resize_cache(0)
        # in a byte-level vocabulary each character of a token stands for one byte; an added token is spelt as it is
        vocab = self.library.get_vocab()
        self.bytes_in = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes_in[i] = len(token)
        for i, token in self.library.get_added_tokens_decoder().items():
            if " " in token.content or token.lstrip or token.rstrip or token.single_word:
                raise ValueError(f"added token {i} may reach over chunks")
            self.bytes_in[i] = len(token.content.encode())

    def _whole(self, text: str) -> np.ndarray:
        # the batch call leaves out the offsets, which nobody asks for
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.code)

    def _word(self, blank: str, word: str) -> bytes:
        """The ids of a word of letters, which the pre-tokeniser leaves whole, from the library's model."""
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(SPELT)
        ids = [t.id for t in self.model.tokenize(blank + spelt)]
        return struct.pack(f"<{len(ids)}{'H' if self.width <= 16 else 'I'}", *ids)

    def _of(self, chunks: list[str]) -> list[bytes]:
        """Letters with or without marks behind them go to the model, word and marks each by itself, as the pre-tokeniser
        splits them; the other chunks go to the library as one text, whose ids are cut where the chunks' bytes end."""
        out: list[bytes] = []
        others, known, older, marks = [], self.cache.known, self.cache.older, self.marks
        for c in chunks:
            blank, body = ("Ġ", c[1:]) if c[0] == " " else ("", c)
            word = body if body.isalpha() else body.rstrip(MARKS)
            if not (word.isalpha() and (word.isascii() or max(word) < "\u0250")):
                # without a blank before it, a text's first chunk would run into the one before
                out.append(b"" if blank else self._whole(c).tobytes())
                if blank:
                    others.append(c)
                continue
            tail = body[len(word) :]
            ids = (known.get(word) or older.get(word)) if blank and tail else None
            if ids is None:
                ids = self._word(blank, word)
                if blank and tail and len(word) <= LONG:
                    known[word] = ids
            if tail:
                if (more := marks.get(tail)) is None:
                    more = self._whole(tail).tobytes()
                    if len(tail) <= LONG and len(marks) < CHUNKS:
                        marks[tail] = more
                ids += more
            out.append(ids)
        if others:
            ids = self._whole("".join(others))
            data, size = ids.tobytes(), ids.itemsize
            lengths = list(map(len, map(str.encode, others)))
            ends = (np.searchsorted(np.cumsum(self.bytes_in[ids]), np.cumsum(lengths)) + 1) * size
            found = iter([data[a:b] for a, b in pairwise([0, *ends.tolist()])])
            out = [x or next(found) for x in out]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text in little-endian integers of self.code."""
        found = self.cache.values(texts, self._of)
        return [self._whole(t).tobytes() if v is None else b"".join(v) for t, v in zip(texts, found)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


#: Ids that are drawn for each range, to find the ranges' bounds.
DRAWN = 50


def bounds_of(docs: DataFrame, n: int) -> np.ndarray:
    """n - 1 ids that cut all of them into n ranges of about equal size, from at most some DRAWN * n drawn ones; null is the least."""
    key = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"))
    share = DRAWN * n / max(1, docs.count())
    drawn = np.sort((key if share >= 1 else key.sample(share, seed=8)).toArrow()["key"].to_numpy())
    return drawn[np.arange(1, n) * len(drawn) // n] if len(drawn) else np.array([], np.int64)


def places(ids: pa.Array, ties: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """The range of each row. An id that fills several ranges is spread over them by its ties."""
    key = ids.fill_null(-(1 << 63)).to_numpy()
    low, high = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
    high = np.where(high - low > 1, high - 1, low)
    share = ties.to_numpy() / float(1 << 64) + 0.5
    return np.minimum(low + np.floor(share * (high - low + 1)).astype(np.int64), high).astype(np.int32)


def encoded(docs: DataFrame, path: str, end: int = END, n: int = 1) -> DataFrame:
    """doc_id, tie (the text's hash), ids (packed, with the end id) and place (of n ranges of doc_id) for each row of docs; texts stay where they are."""
    bounds = docs.sparkSession.sparkContext.broadcast(bounds_of(docs, n))  # 8 bytes for each range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        last = np.array([end], own.code).tobytes()
        for batch in batches:
            at = 0
            for texts in groups(text or "" for text in batch.column(1).to_pylist()):
                part = batch.slice(at, len(texts))
                at += len(texts)
                ids = pa.array([x + last for x in own.encode(texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), ids, pa.array(places(part.column(0), part.column(2), bounds.value))], ["doc_id", "tie", "ids", "place"])

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    return d.mapInArrow(run, "doc_id long, tie long, ids binary, place int")


def _in_ranges(docs: DataFrame, path: str, end: int, n: int) -> DataFrame:
    """encoded in n partitions by ranges of doc_id and tie, in order inside, null ids first.

    Bounds come from the ids alone, so nothing is encoded twice; a row finds its range by binary search in them. An id that
    fills several ranges, or none (null), is spread over them by its ties.
    """
    return encoded(docs, path, end, n).repartitionById(n, F.col("place")).sortWithinPartitions("doc_id", "tie")


def write_tokens(docs: DataFrame, path: str, end: int = END) -> tuple[DataFrame, DataFrame]:
    """Writes all documents' ids as file images in the shared folder, in order of doc_id; gives the images and their index.

    Texts are encoded where they lie; what is dealt by ranges of doc_id (null ids first; repeated ids by the text's hash, so
    that rows of one id may be split) are the ids in 16 or 32 bits. They are sorted there and closed into images of about
    IMAGE_IDS ids. A long document is an image of its own. Images: part, seq, n_ids, n_docs, first_id, last_id (null with
    null ids in the image), image. Index: part, seq, start, n_ids, first_id, last_id; start is how many ids stand before
    the image, from one sum for each image.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        held: list[bytes] = []
        count = 0

        def image() -> pa.RecordBatch:
            data = write_image(keys, [len(x) // wide for x in held], np.frombuffer(b"".join(held), own.code), own.width)
            ends = [None, None] if None in keys else [keys[0], keys[-1]]
            row = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([count], pa.int64()), pa.array([len(keys)], pa.int64()), *(pa.array([k], pa.int64()) for k in ends), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["part", "seq", "n_ids", "n_docs", "first_id", "last_id", "image"])

        wide = np.dtype(own.code).itemsize
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(key)
                held.append(data)
                count += len(data) // wide
                if count >= IMAGE_IDS:
                    yield image()
                    keys, held, count, seq = [], [], 0, seq + 1
        if keys:
            yield image()

    n = max(1, docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = _in_ranges(docs, path, end, n).select("doc_id", "ids")
    images = materialize(ordered.mapInArrow(run, "part int, seq int, n_ids long, n_docs long, first_id long, last_id long, image binary"), "token-images")
    sums = images.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    before = sums.select(F.col("part").alias("_part"), (F.sum("_ids").over(Window.orderBy("part")) - F.col("_ids")).alias("_before"))
    own_start = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    index = images.select("part", "seq", "n_ids", "first_id", "last_id", own_start.alias("_own")).join(before, F.col("part") == F.col("_part"))
    return images, materialize(index.select("part", "seq", (F.col("_before") + F.col("_own")).alias("start"), "n_ids", "first_id", "last_id"), "token-index")


def _images_with(images: DataFrame, index: DataFrame, holds: Column) -> DataFrame:
    """start and image of those images whose index row meets the condition."""
    some = index.filter(holds).select(F.col("part").alias("_p"), F.col("seq").alias("_s"), "start")
    return images.select("part", "seq", "image").join(some, (F.col("part") == F.col("_p")) & (F.col("seq") == F.col("_s"))).select("start", "image")


def read_range(images: DataFrame, index: DataFrame, start: int, count: int) -> DataFrame:
    """(at, ids): the ids at global places start to start + count - 1, in slices; only the blocks that hold them are unpacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                image = Image(data)
                a, b = max(start, begin), min(start + count, begin + image.n_ids)
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([image.ids(a - begin, b - a).astype(np.int32)], pa.list_(pa.int32()))], ["at", "ids"])

    return _images_with(images, index, (F.col("start") < start + count) & (F.col("start") + F.col("n_ids") > start)).mapInArrow(run, "at long, ids array<int>")


def read_document(images: DataFrame, index: DataFrame, doc_id: int) -> DataFrame:
    """(at, ids) for each row that was written under this doc_id, with its end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                image = Image(data)
                hits = [i for i, k in enumerate(image.keys) if k == doc_id]
                yield pa.RecordBatch.from_arrays([pa.array([begin + int(image.starts[i]) for i in hits], pa.int64()), pa.array([image.document(i).astype(np.int32) for i in hits], pa.list_(pa.int32()))], ["at", "ids"])

    return _images_with(images, index, F.col("first_id").isNull() | F.lit(doc_id).between(F.col("first_id"), F.col("last_id"))).mapInArrow(run, "at long, ids array<int>")


def read_tokens(images: DataFrame, index: DataFrame) -> DataFrame:
    """Per document from the images: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                image = Image(data)
                ids = image.ids(0, image.n_ids).astype("<u4", copy=False)
                at = image.starts
                sums = [zlib.crc32(memoryview(ids[at[i] : at[i + 1]]).cast("B")) for i in range(image.n_docs)]
                yield pa.RecordBatch.from_arrays([pa.array(image.keys, pa.int64()), pa.array(at[:-1] + start, pa.int64()), pa.array(image.lengths.astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _images_with(images, index, F.lit(True)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str) -> DataFrame:
    """The contract's rows. Null text: only the end id. Repeated rows each have their place. A very long text is an image
    of its own, held whole by one worker at a time. Empty table: no rows."""
    return read_tokens(*write_tokens(docs, path))
