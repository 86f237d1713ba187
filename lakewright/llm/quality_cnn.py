"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import pick

#: Bytes of a chunk, from one chunk's start to the next, bytes under a filter, places from one to the next, filters.
CHUNK, STEP, WIDTH, STRIDE, FILTERS = 256, 240, 8, 2, 16
FOLDS, HELD_OUT = 3, 1
#: The network learns from about so many labelled rows, drawn by hash of id and text; from the whole text of each.
SAMPLE_DOCS = 2000
ROUNDS, BATCH, RATE, DECAY, SEED = 12, 64, 0.01, 1e-4, 7
#: Chunks that are scored together.
TOGETHER = 512


def _byte_features() -> np.ndarray:
    """For each byte its bits and the classes it is in; the zero byte, which fills the last chunk, is nothing."""
    out = np.zeros((256, 20), np.float32)
    for b in range(1, 256):
        c = chr(b)
        bits = [(b >> k & 1) * 2 - 1 for k in range(8)]
        kinds = [c.islower(), c.isupper(), c.isdigit(), c == " ", c == "\n", c in ".,;:'\"", c in "!?", c in "#*$%&|<>", c in "@/\\_=~^`+-()[]{}", b >= 128, c in "aeiouy", b < 32]
        out[b] = bits + [2 * (x and (i != 0 and i != 1 or b < 128)) for i, x in enumerate(kinds)]
    return out * 0.5


FEATURES = _byte_features()


def chunks(data: bytes) -> np.ndarray:
    """Overlapping chunks that cover the whole document, as rows; zeros fill the last. An empty document is one empty chunk."""
    n = max(1, -(-(len(data) - (CHUNK - STEP)) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


class Network:
    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        d = WIDTH * FEATURES.shape[1]
        self.w = (rng.normal(size=(d, FILTERS)) / np.sqrt(d)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.v = (rng.normal(size=FILTERS) / np.sqrt(FILTERS)).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    def windows(self, x: np.ndarray) -> np.ndarray:
        f = FEATURES[x]
        return np.lib.stride_tricks.sliding_window_view(f, WIDTH, axis=1)[:, ::STRIDE].transpose(0, 1, 3, 2).reshape(len(x), -1, WIDTH * f.shape[2])

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Each filter's largest response in each chunk. A filter's response is a sum of one table value for each byte under it."""
        out = np.empty((len(x), FILTERS), np.float32)
        for at in range(0, len(x), TOGETHER):
            out[at : at + TOGETHER] = self.responses(x[at : at + TOGETHER])[0]
        return np.maximum(out + self.b, 0)

    def scores(self, docs: list[bytes]) -> np.ndarray:
        """The mean of the chunks' logits decides, as a probability."""
        out = []
        for data in docs:
            x = chunks(data)
            total = sum(float((self.pooled(x[i : i + TOGETHER]) @ self.v).sum()) for i in range(0, len(x), TOGETHER))
            out.append(total / len(x) + float(self.c[0]))
        return 1 / (1 + np.exp(-np.clip(np.array(out), -50, 50)))

    def responses(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest response in each chunk, without bias, and the place of its window."""
        tables = (FEATURES @ self.w.reshape(WIDTH, FEATURES.shape[1], FILTERS)).astype(np.float32)
        places = (CHUNK - WIDTH) // STRIDE + 1
        z = tables[0][x[:, 0 : STRIDE * places : STRIDE]]
        for k in range(1, WIDTH):
            z += tables[k][x[:, k : k + STRIDE * (places - 1) + 1 : STRIDE]]
        top = z.argmax(axis=1)
        return np.take_along_axis(z, top[:, None], 1)[:, 0], top * STRIDE

    def gradient(self, samples: list[np.ndarray], labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean logistic loss of these documents and its gradient by w, b, v, c, through the places of the largest responses.

        A document's chunks are taken some at a time, so a very long one needs no more memory than what a place each takes.
        """
        x = np.concatenate(samples)
        doc = np.repeat(np.arange(len(samples)), [len(s) for s in samples])
        weight = 1 / np.bincount(doc)[doc]
        found = [self.responses(x[i : i + TOGETHER]) for i in range(0, len(x), TOGETHER)]
        h = np.maximum(np.concatenate([f[0] for f in found]) + self.b, 0)
        at = np.concatenate([f[1] for f in found])
        logit = np.bincount(doc, weight * (h @ self.v)) + self.c[0]
        loss = float(np.mean(np.logaddexp(0, logit) - labels * logit))
        g = (1 / (1 + np.exp(-logit)) - labels) / len(labels)
        gc = (g[doc] * weight)[:, None].astype(np.float32)
        gh = gc * self.v * (h > 0)
        gw = np.zeros((WIDTH, FEATURES.shape[1], FILTERS), np.float32)
        rows = np.arange(len(x))[:, None]
        for k in range(WIDTH):
            # the gradient summed up by the byte under this place of the window
            by_byte = np.zeros((256, FILTERS), np.float32)
            np.add.at(by_byte, (x[rows, at + k], np.arange(FILTERS)[None, :]), gh)
            gw[k] = FEATURES.T @ by_byte
        return loss, [gw.reshape(self.w.shape), gh.sum(0), (gc * h).sum(0), np.array([g.sum()], np.float32)]

    def fit(self, samples: list[np.ndarray], labels: np.ndarray) -> None:
        """Adam on the logistic loss."""
        params = [self.w, self.b, self.v, self.c]
        m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        rng, t = np.random.default_rng(SEED + 1), 0
        for turn in range(ROUNDS):
            order = rng.permutation(len(samples))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                _, grads = self.gradient([samples[i] for i in part], labels[part])
                grads[0] += DECAY * self.w
                t += 1
                rate = RATE * (1 - turn / ROUNDS)
                for p, grad, a, b in zip(params, grads, m, s):
                    a += 0.1 * (grad - a)
                    b += 0.001 * (grad * grad - b)
                    p -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """Whether the row is never learned from; so is a row without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Network:
    """Trains on a bounded sample of labelled rows, each with its whole text.

    A document with several labels has their mean; rows with the same id and text count once, so that copies of a drawn
    row don't come along. Ids and hashes of texts are counted first, and a row's text is dealt out only if it is drawn; only
    the drawn rows' texts come to the driver.
    """
    known = pick(labels, "doc_id", "quality").filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.avg("quality").alias("quality"))
    rows = pick(docs, "doc_id", "text").withColumn("hash", F.xxhash64("doc_id", "text"))
    labelled = lambda d: d.join(known, F.col("doc_id") == F.col("_id"))
    n = labelled(rows.select("doc_id", "hash")).select("hash").distinct().count()
    limit = (1 << 31) if n <= sample_docs else int((1 << 31) * sample_docs / n)
    drawn = labelled(rows.filter(F.col("hash").bitwiseAND(F.lit((1 << 31) - 1)) < limit)).groupBy("doc_id", "hash").agg(F.any_value("text").alias("text"), F.any_value("quality").alias("quality"))
    found = sorted(drawn.select("doc_id", "hash", "text", "quality").collect(), key=lambda r: (r["doc_id"], r["hash"]))
    net = Network()
    if found:
        net.fit([chunks((r["text"] or "").encode()) for r in found], np.array([r["quality"] for r in found], np.float64))
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted, from the whole text. Nothing is shuffled.

    Null texts count as empty; they have a score too. Repeated rows each have theirs. A very long text is scored in parts,
    whose logits are averaged over all. Nothing to learn from: the untrained network's scores. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = net.scores([(t or "").encode() for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    d = pick(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))
