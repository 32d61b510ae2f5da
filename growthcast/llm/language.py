"""Language identification by multinomial naive Bayes over hashed character n-grams.

A text becomes lower-case letters with one space for every run of other
characters, a space before and one after; its grams are all runs of one to
``ORDER`` of these, hashed into buckets.

1. *Learn.* Tasks count grams by language over all rows that may be learned
   from and add them up in arrays, so a task gives one row at most for each
   language and bucket; Spark sums them. No row is left out.
2. *Model.* Log probabilities, one row of floats for each bucket, are broadcast.
   Buckets are 2^16 for up to 64 languages and halve whenever those double,
   so the matrix holds 2^22 floats at most (16 MB).
3. *Score.* A task gathers the rows of a slice of documents' grams and sums
   them by document.

The score is the posterior probability of the predicted language, with document
frequencies as prior.

Nulls and edge cases: a text that is null or has no letter is ``und`` with score
0, and so is every text if nothing could be learned; rows without a language
are predicted, not learned from; a null id has crc32 of no bytes, remainder 0,
so it is learned from; ids may repeat; equal posteriors go to the language
that is first by code point; very long texts are counted and scored whole, in
slices; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Longest gram, bits of a bucket's number, pseudo-count of every gram, and characters that are scored together.
ORDER, BITS, SMOOTH, SLICE = 3, 16, 0.5, 250_000
LANGUAGES = 64
#: More languages than this would leave no buckets worth having.
MOST_LANGUAGES = 1 << 16
UNKNOWN = "und"
_MUL = np.uint64(0x9E3779B97F4A7C15)


class Model(NamedTuple):
    languages: list[str]
    prior: np.ndarray
    weights: np.ndarray  # bucket x language
    bits: int


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: remainder 2 of crc32 of the id's decimal text modulo 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row; learned from the rows that aren't held out."""
    known = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull())
    model = learn(known.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def learn(known: DataFrame) -> Model:
    """known: text, lang. Counts of every language's grams, over all rows."""
    n = known.agg(F.approx_count_distinct("lang", 0.01)).first()[0]
    bits = bits_for(n)
    counted = known.mapInArrow(_count(bits), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return fitted(counted.toArrow(), bits)


def bits_for(languages: int) -> int:
    """Bits of a bucket for so many languages, by an estimate a twentieth too low at most."""
    if languages > MOST_LANGUAGES:
        raise ValueError(f"{languages} languages to learn, {MOST_LANGUAGES} at most")
    bits = BITS
    while languages * 21 // 20 > LANGUAGES << (BITS - bits):
        bits -= 1
    return bits


def fitted(counted: pa.Table, bits: int) -> Model:
    """Model of (lang, bucket, n); bucket -1 has the documents of a language."""
    names = counted.column("lang").combine_chunks().dictionary_encode() if counted.num_rows else pa.array([], pa.string()).dictionary_encode()
    order = sorted(range(len(names.dictionary)), key=lambda i: names.dictionary[i].as_py())
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    bucket, n = counted.column("bucket").to_numpy(), counted.column("n").to_numpy()
    at = place[names.indices.to_numpy()] if len(order) else np.zeros(0, np.int64)
    prior = np.zeros(len(order))
    prior[at[bucket < 0]] = n[bucket < 0]
    counts = np.full((1 << bits, len(order)), SMOOTH)
    counts[bucket[bucket >= 0], at[bucket >= 0]] += n[bucket >= 0]
    weights = np.log(counts / counts.sum(0)).astype(np.float32)
    return Model([names.dictionary[i].as_py() for i in order], np.log(prior / max(prior.sum(), 1)), weights, bits)


def predict(rows: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = rows.drop("lang_pred", "score", text_col).schema
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            predicted, score = classify(batch.column(text_col), own)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(predicted, pa.string()), pa.array(score, pa.float64())],
                                             [*names, "lang_pred", "score"])

    return rows.select(*names, text_col).mapInArrow(run, schema.add("lang_pred", "string").add("score", "double"))


def classify(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """Predicted languages and their posteriors."""
    total = np.full((len(texts), len(model.languages)), 0.0)
    lettered = np.zeros(len(texts), bool)
    for places, buckets, starts, letters in grams(texts, model.bits):
        lettered[places] |= letters
        np.add.at(total, places, np.add.reduceat(model.weights[buckets], starts, axis=0, dtype=np.float64) if len(buckets) else 0.0)
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    total += model.prior
    best = total.argmax(1)
    score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    return [model.languages[b] if known else UNKNOWN for b, known in zip(best.tolist(), lettered.tolist())], np.where(lettered, score, 0.0)


@cache
def folded() -> np.ndarray:
    """Lower-case letter of every code point; 0 for those that are no letters."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 and low.isalpha() else i
    return out


def normalised(text: str) -> np.ndarray:
    """Code points of lower-case letters, one 0 for every run of others, 0 at both ends."""
    letters = np.zeros(len(text) + 2, np.uint32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letters[1:-1] = folded()[points]
    keep = letters != 0
    keep[0] = True
    keep[1:] |= letters[:-1] != 0
    return letters[keep]


def hashed(points: np.ndarray, bits: int) -> list[np.ndarray]:
    """Buckets of the grams of 1 to ORDER code points that begin at each place, as far as they go."""
    out, h = [], np.zeros(len(points), np.uint64)
    for n in range(ORDER):
        if len(points) <= n:
            break
        h = (h[:len(points) - n] + points[n:].astype(np.uint64) + np.uint64(n + 1)) * _MUL
        h ^= h >> np.uint64(29)
        out.append(((h * _MUL) >> np.uint64(64 - bits)).astype(np.int64))
    return out


def grams(texts: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of documents: their places, all buckets in order of document, where each one's begin, and whether it has letters.

    A document longer than a slice comes in several, each gram in one of them.
    """
    places, buckets, letters, held = [], [], [], 0
    for i, text in enumerate(texts):
        points = normalised(text.as_py() or "")
        for at in range(0, len(points), SLICE):
            # grams that begin in this slice may end after it
            part = points[at:at + SLICE + ORDER - 1]
            own = [h[:SLICE] for h in hashed(part, bits)]
            places.append(i)
            buckets.append(np.concatenate(own))
            letters.append(bool(part.any()))
            held += len(part)
            if held >= SLICE:
                yield _joined(places, buckets, letters)
                places, buckets, letters, held = [], [], [], 0
    if places:
        yield _joined(places, buckets, letters)


def _joined(places: list[int], buckets: list[np.ndarray], letters: list[bool]):
    starts = np.cumsum([0, *map(len, buckets[:-1])])
    return np.array(places), np.concatenate(buckets), starts, np.array(letters)


def _count(bits: int):
    """Grams of each language in a task; bucket -1 counts its documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            codes = batch.column("lang").dictionary_encode()
            names, of = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            for places, buckets, starts, _ in grams(batch.column("text"), bits):
                lengths = np.diff([*starts, len(buckets)])
                lang = of[places]
                for k in np.unique(lang).tolist():
                    own = counts.setdefault(names[k], np.zeros((1 << bits) + 1, np.int64))
                    own[:-1] += np.bincount(buckets[np.repeat(lang == k, lengths)], minlength=1 << bits)
            for k, n in enumerate(np.bincount(of, minlength=len(names)).tolist()):
                counts[names[k]][-1] += n
            if len(counts) > LANGUAGES << (BITS - bits):
                yield from _rows(counts)
                counts = {}
        yield from _rows(counts)
    return run


def _rows(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for name, own in counts.items():
        bucket = np.flatnonzero(own)
        n = own[bucket]
        bucket[bucket == len(own) - 1] = -1
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(bucket), pa.string()), pa.array(bucket, pa.int32()), pa.array(n)], ["lang", "bucket", "n"])
