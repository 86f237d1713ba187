"""Language of documents as a mixture: expectation-maximisation over n-gram likelihoods, languages chosen by penalised likelihood."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import pick

#: Bytes of an n-gram, buckets for them, n-grams of a segment (each segment is of one language), rounds of a fit.
GRAM, BUCKETS, SEGMENT, ROUNDS = 3, 1 << 14, 32, 12
FOLDS, HELD_OUT = 5, 0
#: What one more language must gain, in logarithms, besides half the logarithm of the number of segments.
PENALTY = 4.0
#: N-grams of neighbouring places tell the same again: likelihoods count by this power.
TEMPER = 0.5
UNKNOWN = "und"

_BLANK = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def grams(text: str) -> np.ndarray:
    """Buckets of the byte n-grams of the lower-cased text, with everything between words as one blank."""
    data = b" " + b" ".join(text.lower().encode().translate(_BLANK).split()) + b" "
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(x) < GRAM:
        return np.zeros(0, np.int64)
    code = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
    return ((code * np.uint32(2_654_435_761)) >> np.uint32(32 - 14)).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def held_out(doc_id: Column) -> Column:
    """Whether the row is never learned from; so is a row without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(True))


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over the whole texts of all rows that may be learned from. A task sends one row for each language and bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                sums[lang] += np.bincount(grams(text), minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    d = pick(docs, "doc_id", "text", "lang").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return d.select("text", "lang").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log-likelihood of each bucket under each language; languages in code point order."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        n = np.full((BUCKETS, max(1, len(self.langs))), 0.5)
        where = {lang: i for i, lang in enumerate(self.langs)}
        for lang, bucket, count in rows:
            n[bucket, where[lang]] += count
        self.table = np.log(n / n.sum(axis=0)).astype(np.float32)

    def segments(self, text: str) -> np.ndarray:
        """Tempered log-likelihoods of each segment."""
        each = self.table[grams(text)]
        return TEMPER * np.add.reduceat(each, np.arange(0, len(each), SEGMENT), axis=0).astype(np.float64)

    def mixture(self, text: str) -> np.ndarray:
        """Share of each language in the text; languages that aren't chosen have none.

        From the best single language on, the language with the largest gain joins while the gain exceeds the penalty. No
        fit is made for a set that even the best language for each segment could not bring over the penalty.
        """
        ll = self.segments(text)
        chosen = [int(ll.sum(axis=0).argmax())]
        share, value = np.ones(1), ll[:, chosen[0]].sum()
        need = PENALTY + 0.5 * np.log(len(ll))
        while len(chosen) < ll.shape[1]:
            best = None
            top = ll[:, chosen].max(axis=1)
            for k in range(ll.shape[1]):
                if k in chosen or np.maximum(top, ll[:, k]).sum() - value <= need:
                    continue
                got = fit(ll[:, [*chosen, k]])
                if got[1] - value > need and (best is None or got[1] > best[1]):
                    best = (got[0], got[1], k)
            if best is None:
                break
            share, value = best[0], best[1]
            chosen.append(best[2])
        out = np.zeros(ll.shape[1])
        # a few segments leave doubt
        out[chosen] = (share * len(ll) + 1 / ll.shape[1]) / (len(ll) + 1)
        return out


def fit(ll: np.ndarray) -> tuple[np.ndarray, float]:
    """Expectation-maximisation of the shares; gives them and the log-likelihood."""
    top = ll.max(axis=1, keepdims=True)
    p = np.exp(ll - top)
    share = np.full(ll.shape[1], 1 / ll.shape[1])
    for _ in range(ROUNDS):
        r = p * share
        share = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
    return share, float(np.log(p @ share).sum() + top.sum())


def learn(docs: DataFrame) -> Model:
    """The counts that come to the driver are BUCKETS for each language, however many documents there are."""
    return Model([tuple(r) for r in gram_counts(docs).collect()])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, lang_pred, score, shares (share of each language).

    Null texts, texts without a letter, and all texts where nothing was learned: und, score 0. Equal shares: the first
    language by code point. Rows stay where they are. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.float64())
        for batch in batches:
            langs, scores, shares = [], [], []
            for text in batch.column(2).to_pylist():
                if not text or not model.langs or not has_letter(text):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    shares.append([])
                    continue
                m = model.mixture(text)
                k = int(m.argmax())
                langs.append(model.langs[k])
                scores.append(float(min(1.0, m[k])))
                shares.append([(model.langs[i], float(m[i])) for i in np.flatnonzero(m)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, kind)], ["doc_id", "held_out", "lang_pred", "score", "shares"])

    d = pick(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return d.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, shares map<string,double>")


def languages(docs: DataFrame) -> DataFrame:
    return identify(docs, learn(docs)).select("doc_id", "held_out", "lang_pred", "score")
