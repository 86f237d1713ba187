"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding."""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakewright.llm.chunks import LONG, ChunkCache, groups
from lakewright.llm.common import pick

#: Entries that a worker keeps: chunks and matches with their ids (some 250 bytes each), pairs of tokens, transitions of the transducer.
CHUNKS, MATCHES, PAIRS, TRANSITIONS = 250_000, 100_000, 250_000, 150_000
#: After so many bytes of a match those tokens leave on which all open places agree.
STEP = 64
#: Ids that the streaming decoder takes at a time.
DECODE_BLOCK = 4096

def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken file: a line for each token, base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Transducer:
    """Turns bytes into the ids that merging lowest ranks first gives, left to right.

    A sequence of tokens is the result of merging iff each two neighbours are the result for their own bytes. So the last
    token of each prefix's result follows from the results of shorter prefixes. A state is the set of the token tree's
    nodes that the tokens still open have reached; it tells which tokens end here, longest first. The first that is
    stable beside the last token of the prefix before it is this prefix's last token; just one is, so if no longer one is,
    the single byte's token is. These last tokens are registers of
    the walk, not part of the state, so states are few. Only the registers of open tokens' beginnings matter for what
    follows, so tokens on which all those agree are put out. States and transitions are made when first met.
    """

    ROOT = 0

    def __init__(self, ranks: dict[bytes, int], transitions: int = TRANSITIONS, pairs: int = PAIRS):
        self.ranks, self.limit, self.pair_limit = ranks, transitions, pairs
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at, self.depth = [-1], [0]
        for token, rank in ranks.items():
            node = self.ROOT
            for depth, b in enumerate(token, 1):
                key = node << 8 | b
                if (to := self.child.get(key)) is None:
                    to = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.depth.append(depth)
                node = to
            self.token_at[node] = rank
        self.halves: dict[int, tuple[int, int] | None] = {}
        #: By a token: whether it is stable behind another one.
        self.behind: dict[int, dict[int, bool]] = {}
        self.n_pairs = 0
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[tuple[int, ...], int] = {}
        self.open: list[tuple[int, ...]] = []
        #: Of a state: its number, the tokens that end there with their lengths and what is known of them, and the single byte's token.
        self.states: list[tuple[int, tuple[tuple[int, int, dict[int, bool]], ...], int]] = []
        self.move: dict[int, tuple[int, tuple[tuple[int, int, dict[int, bool]], ...], int]] = {}
        self._intern((self.ROOT,))

    def _intern(self, nodes: tuple[int, ...]) -> int:
        if (no := self.numbers.get(nodes)) is None:
            no = self.numbers[nodes] = len(self.open)
            self.open.append(nodes)
            ends = [(t, self.length[t], self.behind.setdefault(t, {})) for n in nodes if (t := self.token_at[n]) >= 0]
            self.states.append((no, tuple(ends[:-1]), ends[-1][0] if ends else -1))
        return no

    def _step(self, no: int, byte: int) -> tuple[int, tuple[tuple[int, int, dict[int, bool]], ...], int]:
        """Nodes stand in order of where their tokens began; a token may begin anew after each byte."""
        reached = [to for n in self.open[no] if (to := self.child.get(n << 8 | byte)) is not None]
        self.move[no << 8 | byte] = to = self.states[self._intern((*reached, self.ROOT))]
        return to

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens of which the token is merged last; None for a byte."""
        if token not in self.halves:
            data, parts = self.bytes_of[token], [bytes([b]) for b in self.bytes_of[token]]
            while len(parts) > 2:
                _, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(data) > 1 else None
        return self.halves[token]

    def stable(self, a: int, b: int) -> bool:
        """Whether the two tokens stay as they are, side by side.

        They don't if, before both are complete, a part at a's end and a part at b's start would merge. The parts that
        meet at the seam are undone from the last merge on; a merge across the seam must rank below the merges undone.
        """
        left, right, below, bytes_of, answer = a, b, 1 << 60, self.bytes_of, True
        # nothing stands before a text's first token
        while a >= 0:
            across = self.ranks.get(bytes_of[left] + bytes_of[right])
            # ranks alike on both sides: the left one merges first
            if across is not None and across < below:
                answer = False
                break
            lh, rh = self._halves(left), self._halves(right)
            if lh is None and rh is None:
                break
            if rh is None or lh is not None and left > right:
                below, left = left, lh[1]
            else:
                below, right = right + 1, rh[0]
        if self.n_pairs >= self.pair_limit:
            for known in self.behind.values():
                known.clear()
            self.n_pairs = 0
        self.behind.setdefault(b, {})[a] = answer
        self.n_pairs += 1
        return answer

    def _agreed(self, no: int, last: list[int]) -> int:
        """The furthest place at which the results of all prefixes before open tokens have a token's end in common."""
        places = {len(last) - 1 - self.depth[n] for n in self.open[no]}
        while len(places) > 1:
            p = max(places)
            places.remove(p)
            places.add(p - self.length[last[p]])
        return places.pop()

    def _trace(self, last: list[int], end: int) -> list[int]:
        out = []
        while end:
            out.append(last[end])
            end -= self.length[last[end]]
        out.reverse()
        return out

    def encode(self, data: bytes) -> list[int]:
        if len(self.move) > self.limit:
            self._reset()
        no, last, out = 0, [-1], []
        move, stable = self.move.get, self.stable
        for at in range(0, len(data), STEP):
            if at:
                done = self._agreed(no, last)
                out += self._trace(last, done)
                # the token that ends there stays as the one before
                last = last[done:]
            add = last.append
            for byte in data[at : at + STEP]:
                to = move(no << 8 | byte)
                if to is None:
                    to = self._step(no, byte)
                no, ends, single = to
                for token, length, known in ends:
                    fits = known.get(last[-length])
                    if fits is None:
                        fits = stable(last[-length], token)
                    if fits:
                        add(token)
                        break
                else:
                    add(single)
        return out + self._trace(last, len(last) - 1)


class Codec:
    """Encoding and decoding of whole texts with one vocabulary; one for each worker."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.transducer = Transducer(read_ranks(path))
        self.bytes_of = self.transducer.bytes_of
        self.pattern = regex.compile(pattern)
        self.cache = ChunkCache(CHUNKS)
        self.matches: dict[str, list[int]] = {}

    def _of(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.matches
        for match in self.pattern.findall(text):
            if (ids := known.get(match)) is None:
                ids = self.transducer.encode(match.encode())
                if len(match) <= LONG:
                    known[match] = ids
            out += ids
            if len(known) > MATCHES:
                known.clear()
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        found = self.cache.values(texts, lambda chunks: [tuple(self._of(c)) for c in chunks])
        return [self._of(t) if v is None else list(chain.from_iterable(v)) for t, v in zip(texts, found)]

    def decode(self, ids: list[int]) -> Iterator[str]:
        """The text in pieces; a character that is cut by a block's end comes with the next block."""
        decoder, bytes_of = codecs.getincrementaldecoder("utf-8")(), self.bytes_of
        for at in range(0, len(ids), DECODE_BLOCK):
            yield decoder.decode(b"".join(map(bytes_of.__getitem__, ids[at : at + DECODE_BLOCK])))
        yield decoder.decode(b"", final=True)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): n_tokens, ids_sha256, decoded_sha256; with_ids also the ids.

    Null and empty texts have no ids. Rows stay where they are: nothing is shuffled, repeated rows and ids don't matter,
    and an empty table gives no rows. A worker keeps the ids of recent chunks, and transitions, up to fixed numbers. Rows
    leave it in slices of bounded size; a very long text is a slice of its own.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        decimal = {i: str(i) for i in own.bytes_of}
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
        for batch in batches:
            at = 0
            for texts in groups(text or "" for text in batch.column(1).to_pylist()):
                counts, sums, back, kept = [], [], [], []
                for ids in own.encode(texts):
                    digest = hashlib.sha256()
                    for piece in own.decode(ids):
                        digest.update(piece.encode())
                    counts.append(len(ids))
                    sums.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    back.append(digest.hexdigest())
                    if with_ids:
                        kept.append(np.array(ids, np.int32))
                columns = [batch.column(0).slice(at, len(texts)), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, names)

    return pick(docs, "doc_id", "text").mapInArrow(run, schema)
