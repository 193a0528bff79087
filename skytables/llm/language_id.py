"""Language identification by a mixture over character trigrams.

Training counts hashed trigrams of letters by language over all labelled
documents: each task sums its own, a partial aggregation adds them up, and
languages x buckets numbers reach the driver, whatever the corpus size.

A document is seen as a mixture of the languages. Expectation-maximisation
estimates the proportions from the trigrams' likelihoods; languages are then left
out, the least first, as long as the penalised likelihood (half the logarithm of
the number of trigrams for each language) rises. What remains is the document's
set of languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import column_of, slices, text_batches

#: Buckets of hashed trigrams, a power of two.
BUCKETS = 1 << 15
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]  # in alphabetical order
    likelihoods: np.ndarray  # (languages, BUCKETS), each row a distribution


@lru_cache(1)
def _letters() -> np.ndarray:
    """Lower case of every letter by code point; 0 for everything else."""
    codes = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            codes[i] = ord(low) if len(low) == 1 else i
    return codes


def trigrams(text: str) -> np.ndarray | None:
    """Buckets of the trigrams within words and across their edges; None if there is no letter."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not codes.any():
        return None
    codes = np.concatenate(([0], codes, [0])).astype(np.uint64)
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]  # runs of other characters count once
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    h = ((a * np.uint64(0x9E3779B1) + b) * np.uint64(0x85EBCA77) + c) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h[b != 0] >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4. False for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", smoothing: float = 0.1) -> Model:
    """Trigram distributions of each language over all documents with id, text and language that are not held out."""
    text_batches(docs)
    rows = docs.where(F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = trigrams(text.as_py())
                total = sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                if found is not None:
                    total += np.bincount(found, minlength=BUCKETS)
        for name, total in sums.items():
            at = np.flatnonzero(total) if total.any() else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(total[at])], names=["lang", "bucket", "n"])

    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.full((len(languages), BUCKETS), smoothing)
    counts[np.searchsorted(np.array(languages, object), found["lang"].to_numpy()) if languages else [], found["bucket"].to_numpy()] += found["n"].to_numpy()
    return Model(languages, (counts / counts.sum(1, keepdims=True)).astype(np.float64))


def proportions(given: np.ndarray, counts: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Mixture proportions and log likelihood; `given` holds the likelihoods (languages, trigrams)."""
    share, total = np.full(len(given), 1 / len(given)), counts.sum()
    for _ in range(rounds if len(given) > 1 else 0):
        new = share * (given @ (counts / (share @ given))) / total
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(counts @ np.log(share @ given))


def mixture(found: np.ndarray, likelihoods: np.ndarray, penalty: float = 0.5) -> np.ndarray:
    """Proportions of all languages, zero for those outside the selected set."""
    tally = np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(tally)
    counts = tally[at].astype(float)
    given = likelihoods[:, at]
    kept = np.arange(len(given))
    price = penalty * np.log(counts.sum() + 1)
    share, fit = proportions(given, counts)
    best, best_kept, best_score = share, kept, fit - price * len(kept)
    while len(kept) > 1:
        kept = np.delete(kept, share.argmin())
        share, fit = proportions(given[kept], counts)
        if (score := fit - price * len(kept)) >= best_score:
            best, best_kept, best_score = share, kept, score
    out = np.zeros(len(given))
    out[best_kept] = best
    return out


def predict(docs: DataFrame, model: Model, text: str | tuple[str, ...] = "text") -> DataFrame:
    """`docs` with `lang_pred`, `score` (the predicted language's proportion) and `languages` (the selected set).

    Existing columns of these names are replaced. Null text, text without any letter
    and a model without languages give `und`, score 0 and no languages. Of equal
    proportions the language first in the alphabet wins. Repeated rows are predicted
    alike; the text is used whole, and a very long one costs in proportion to its length.
    An empty table gives no row. `text` names a text column, or as a tuple one within a struct.
    """
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StringType()))]
    text_batches(docs)
    rows = docs.drop(*[f.name for f in added])
    schema = T.StructType([*rows.schema.fields, *added])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, likelihoods = shared.value
        for batch in slices(batches):
            names, scores, sets = [], [], []
            for value in column_of(batch, text).to_pylist():
                found = trigrams(value) if languages and value else None
                if found is None:
                    names.append(UNKNOWN), scores.append(0.0), sets.append([])
                    continue
                share = mixture(found, likelihoods)
                names.append(languages[int(share.argmax())])
                scores.append(min(1.0, float(share.max())))
                sets.append([languages[i] for i in np.flatnonzero(share > 0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string()))], names=schema.names)

    return rows.mapInArrow(guess, schema)
