"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of the labelled rows (``EXAMPLES`` of each label,
those with the least hashes of their ids); rows held out for testing are never
among them. Terms are words and the beginnings of words. All terms of the
examples make up the vectors, with document frequencies counted over all
documents; a term that goes with the label in the examples (``SUPPORT``,
``RATIO``) weighs more by its log-likelihood ratio.

The examples lie in an inverted index whose postings are cut into blocks.
Terms of many examples have each block's greatest weight beside it; the rest
are summed first. A query sums both to a bound for every block, reads the block
of the greatest bound, and then those whose bound reaches its k-th best cosine
there; so the k nearest are exact, ties to the smaller id. The votes are weighted by cosine; a logistic curve fitted to leave-one-out votes of
the examples, weighted to the labels' shares, turns them into scores. The
nearest examples are returned as evidence.

Texts are taken apart once: each becomes the numbers of its words' longest
known terms, written to the shared folder, and frequencies and scores are read
from there; the scores are written too, so that no index outlives them. Every worker builds the index from the examples' numbers, which are
broadcast; the driver holds those, the terms and their weights. They grow with
the text of the examples, not with the documents.

Nulls and edge cases: a null or empty text, or one without any term of the
examples, has no neighbours and gets the curve's value for no votes; null labels and ids are no
examples; an id labelled twice takes the greater label; without examples of
both labels the score is the share of label 1 (0 without any); texts are taken
whole; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from growthcast.session import materialise

#: Bounds: examples of each label, examples in a block of the index, neighbours, evidence rows.
EXAMPLES, BLOCK, NEAREST, SHOWN = 2_000, 64, 15, 3
#: A term weighs more from so many examples and such a log-likelihood ratio on (chi-squared with one degree of freedom).
SUPPORT, RATIO = 5, 20.0
#: Terms in one of so many examples, or more, are kept by blocks; so many queries are answered together.
COMMON, TOGETHER = 8, 128
#: Bytes of texts that go to Python together, texts numbered together, and unknown words and scores of texts that a worker keeps.
TEXT_BYTES, SOME, KEPT_WORDS, KEPT_SCORES = 4 << 20, 32, 100_000, 5_000
BEGINNINGS = (4, 5, 6)
WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    """Rows of the test fold: remainder 0 of crc32 of the id's decimal text modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", examples: int = EXAMPLES) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (doc_id, cosine, label of the nearest) for every row."""
    out = classify(docs.select(id_col, text_col), labels, id_col, text_col, label_col, examples, [id_col])
    return out.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), "score", "predicted", "evidence")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", examples: int = EXAMPLES, keep: list[str] | None = None) -> DataFrame:
    """The rows, with the columns of ``keep`` (all if None), and ``score``, ``predicted`` and ``evidence`` in addition.

    These columns, ``_terms`` and ``_scored`` must not be among those kept. What is kept is
    written with the terms and with the scores, so long columns are better joined later.
    """
    keep = docs.columns if keep is None else keep
    known = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
             .where("doc_id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("label").cast("int").alias("label")))
    shares = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = shares.get(1, 0) / max(sum(shares.values()), 1)
    sample = materialise(sampled(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), known, examples), "toxicity-examples")
    found = vocabulary(sample)
    if found is None:
        scored = docs.select(*keep, F.lit(share).alias("score"), F.array().cast(EVIDENCE_TYPE).alias("evidence"))
        return scored.select(*keep, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")
    sc = docs.sparkSession.sparkContext
    words = sc.broadcast(found.words)
    # the texts are taken apart once; frequencies and scores come from the numbers written here
    held = materialise(docs.select(*keep, F.arrow_udf(_numbered(words), "binary")(F.col(text_col)).alias("_terms")), "toxicity-terms", TEXT_BYTES)
    vectors = sample.select("doc_id", "label", F.arrow_udf(_numbered(words), "binary")(F.col("text")).alias("terms")).toArrow()
    words.destroy()
    index = sc.broadcast(index_of(held.select("_terms"), found, vectors, share))
    scored = F.arrow_udf(_scores(index, fit(docs.sparkSession, index)), f"score double, evidence {EVIDENCE_TYPE}")
    out = materialise(held.select(*keep, scored(F.col("_terms")).alias("_scored")), "toxicity-scores", TEXT_BYTES)
    index.destroy()
    return out.select(*keep, "_scored.score", F.when(F.col("_scored.score") >= 0.5, 1).otherwise(0).alias("predicted"), "_scored.evidence")


def terms_of(word: str) -> list[str]:
    """A word's terms: itself and, marked by a star, its beginnings."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


class Vocabulary(NamedTuple):
    """Terms of the examples in order, and for each the number of its longest beginning, or -1, and its weight by label."""
    words: dict
    parent: np.ndarray
    ratio: np.ndarray


def sampled(texts: DataFrame, known: DataFrame, examples: int) -> DataFrame:
    """doc_id, text, label of the examples: ids with the least hashes, so many of each label."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.where(F.col("label") == y).orderBy(*order).limit(examples) for y in (0, 1)]
    # at most 2 * examples rows
    return texts.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").select("doc_id", "text", "label")


def vocabulary(sample: DataFrame) -> Vocabulary | None:
    """All terms of the examples; None without examples of both labels. The driver gets the terms, in Arrow."""
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return None
    a, b = F.col("a"), F.col("b")
    counts = (sample.select("label", "text").mapInArrow(_distinct_terms, "label int, terms array<string>")
              .select("label", F.explode("terms").alias("term")).groupBy("term")
              .agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b")))
    ratio = F.when(a + b >= SUPPORT, _ratio(a, b, n1, n0)).otherwise(0.0)
    body = F.regexp_replace("term", r"\*$", "")
    cut = F.least(F.char_length(body) - 1, F.lit(BEGINNINGS[-1]))
    parent = F.when(cut >= BEGINNINGS[0], F.concat(F.substring(body, F.lit(1), cut), F.lit("*")))
    found = counts.select("term", ratio.alias("ratio"), parent.alias("parent")).toArrow().combine_chunks().sort_by("term")
    term = found.column("term").combine_chunks()
    upper = pc.fill_null(pc.index_in(found.column("parent").combine_chunks(), value_set=term), -1).to_numpy()
    return Vocabulary({"terms": term}, upper, found.column("ratio").to_numpy())


def index_of(held: DataFrame, found: Vocabulary, vectors: pa.Table, share: float) -> dict:
    """What the tasks build the index from: weights of the terms by all documents, and the examples."""
    spark, size = held.sparkSession, len(found.parent)
    parent = spark.sparkContext.broadcast(found.parent)
    got = held.mapInArrow(_frequencies(parent), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    parent.destroy()
    term, times = got.column("term").to_numpy(), got.column("n").to_numpy()
    df, n = np.zeros(size, np.int64), int(times[term < 0].sum())
    df[term[term >= 0]] = times[term >= 0]
    weight = (np.log((1 + n) / (1 + df)) + 1) * np.where(found.ratio >= RATIO, 1 + found.ratio, 1.0)
    examples = vectors.combine_chunks().sort_by([(c, "ascending") for c in vectors.column_names])
    return {"parent": found.parent, "weight": weight, "examples": examples, "share": share}


def fit(spark: SparkSession, index) -> tuple[float, float, float]:
    """The curve of the scores by leave-one-out votes of the examples; the driver gets three numbers of each."""
    size = index.value["examples"].num_rows
    got = spark.range(0, size, 1, max(1, -(-size // (2 * TOGETHER)))).mapInArrow(_votes(index), "label int, share double, top double").toArrow()
    return curve_of(*(got.column(c).to_numpy() for c in ("label", "share", "top")), index.value["share"])


def curve_of(label: np.ndarray, vote: np.ndarray, top: np.ndarray, share: float) -> tuple[float, float, float]:
    """Logistic curve over votes and greatest cosines, weighted to the share of label 1 among the labelled rows."""
    x, y = np.column_stack([np.ones(len(vote)), vote, top]), label.astype(float)
    # rows come in any order, sums do not depend on it
    order = np.lexsort((top, vote, y))
    x, y = x[order], y[order]
    by_label = np.array([(1 - share) / max((y == 0).sum(), 1), share / max((y == 1).sum(), 1)]) * len(y)
    row, beta = by_label[y.astype(int)], np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (row * (p - y)) + 1e-2 * beta
        step = np.linalg.solve((x * (row * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), slope)
        beta = beta - step
        if np.abs(step).max() < 1e-10:
            break
    return tuple(beta.tolist())


def _ratio(a: Column, b: Column, n1: int, n0: int) -> Column:
    """Log-likelihood ratio of a term in ``a`` of n1 toxic and ``b`` of n0 other examples; 0 if it isn't more frequent in the toxic ones."""
    both = (a + b) / F.lit(float(n1 + n0))

    def part(x: Column, p: Column) -> Column:
        return F.when((x > 0) & (p > 0), x * F.log(p)).otherwise(0.0)

    def fits(p1: Column, p0: Column) -> Column:
        return part(a, p1) + part(n1 - a, 1 - p1) + part(b, p0) + part(n0 - b, 1 - p0)

    return F.when(a * n0 > b * n1, 2 * (fits(a / n1, b / n0) - fits(both, both))).otherwise(0.0)


class WordNumbers(dict):
    """The numbers of the known terms, and of unknown words that were met: that of the longest known beginning, or -1.

    A known term's beginnings are known too, so this number stands for all known terms of a word.
    """

    def __init__(self, terms: Sequence[str], most: int = KEPT_WORDS):
        super().__init__(zip(terms, range(len(terms))))
        self.size, self.met, self.most = len(terms), [], most

    def __missing__(self, word: str) -> int:
        if len(self.met) >= self.most:
            for w in self.met:
                del self[w]
            self.met.clear()
        out = -1
        for n in reversed(BEGINNINGS):
            if len(word) > n and (out := self.get(word[:n] + "*", -1)) >= 0:
                break
        self.met.append(word)
        self[word] = out
        return out

    def packed(self, texts: Sequence[str | None]) -> list[bytes]:
        """Of each text the numbers of its words in order, and then how often each occurs, as 32-bit integers."""
        numbers = [np.fromiter(map(self.__getitem__, WORD.findall(x.lower())), np.int64) if x else np.empty(0, np.int64) for x in texts]
        text, number = np.repeat(np.arange(len(texts)), [len(x) for x in numbers]), np.concatenate([np.empty(0, np.int64), *numbers])
        key = np.sort((text * self.size + number)[number >= 0])
        first = np.flatnonzero(np.diff(key, prepend=-1))
        pairs = np.array([key[first] % max(self.size, 1), np.diff(first, append=len(key))], np.int32)
        edges = np.searchsorted(key[first], np.arange(len(texts) + 1) * self.size).tolist()
        return [pairs[:, i:j].tobytes() for i, j in zip(edges[:-1], edges[1:])]


def expanded(packed: list[bytes], parent: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Term numbers, in order, and counts of several texts, with the beginnings of their words."""
    sizes = [len(x) // 8 for x in packed]
    pairs = [np.frombuffer(x, np.int32).reshape(2, -1) for x in packed]
    at, n = np.concatenate(pairs, axis=1).astype(np.int64) if pairs else np.empty((2, 0), np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes) * len(parent)
    keys, counts = [], []
    while len(at):
        keys.append(text + at)
        counts.append(n)
        at = parent[at].astype(np.int64)
        at, n, text = at[at >= 0], n[at >= 0], text[at >= 0]
    if not keys:
        return [(np.empty(0, np.int64), np.empty(0)) for _ in packed]
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(place, np.concatenate(counts))
    edges = np.searchsorted(key, np.arange(len(sizes) + 1) * len(parent)).tolist()
    return [(key[i:j] - k * len(parent), count[i:j]) for k, (i, j) in enumerate(zip(edges[:-1], edges[1:]))]


def _made(shared, make):
    """What a worker makes of a broadcast dict, kept in it for the worker's next tasks."""
    held = shared.value
    if "made" not in held:
        held["made"] = make(held)
    return held["made"]


def _numbered(words):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        numbers = _made(words, lambda held: WordNumbers(held["terms"].to_pylist()))
        for batch in batches:
            yield pa.array([x for i in range(0, len(batch), SOME) for x in numbers.packed(batch[i:i + SOME].to_pylist())], pa.binary())
    return run


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [sorted({t for w in set(WORD.findall((x.as_py() or "").lower())) for t in terms_of(w)}) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(terms, pa.list_(pa.string()))], ["label", "terms"])


def _frequencies(parent):
    """Documents with each term of a task, and documents under the number -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = parent.value
        df, n = np.zeros(len(upper), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for i in range(0, batch.num_rows, TOGETHER):
                for at, _ in expanded(batch.column(0)[i:i + TOGETHER].to_pylist(), upper):
                    df[at] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n))], ["term", "n"])
    return run


def _model(held: dict) -> Model:
    examples = held["examples"]
    # some examples at a time: all that are taken apart together take many times their size
    vectors = (v for i in range(0, examples.num_rows, SOME) for v in expanded(examples.column("terms")[i:i + SOME].to_pylist(), held["parent"]))
    rows = ((i, y, *v) for i, y, v in zip(examples.column("doc_id").to_pylist(), examples.column("label").to_pylist(), vectors))
    return Model(range(len(held["weight"])), held["weight"], rows, held["share"])


def _votes(index):
    """Label, vote and greatest cosine of the examples of some numbers, each without itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _made(index, _model)
        packed, parent = index.value["examples"].column("terms"), index.value["parent"]
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            for i in range(0, len(numbers), TOGETHER):
                some = numbers[i:i + TOGETHER]
                vectors = [model.weighed(*v) for v in expanded([packed[k].as_py() for k in some], parent)]
                votes = np.array([model.votes(*f) for f in model.nearest_of(vectors, some)])
                yield pa.RecordBatch.from_arrays([pa.array(model.labels[some], pa.int32()), pa.array(votes[:, 0]), pa.array(votes[:, 1])], ["label", "share", "top"])
    return run


class Model:
    """Block-max inverted index over the examples in order of their ids."""

    def __init__(self, terms: Sequence, weight: np.ndarray, vectors: Iterable[tuple], share: float):
        self.number, self.weight, self.share = terms, weight, share
        ids, labels, ats, ws = [], [], [np.empty(0, np.int32)], [np.empty(0)]
        for i, y, at, tf in vectors:
            at, w = self.weighed(np.asarray(at, np.int32), np.asarray(tf, np.float64))
            ids.append(i)
            labels.append(y)
            ats.append(at)
            ws.append(w)
        self.ids, self.labels = np.array(ids, np.int64), np.array(labels, np.int64)
        self.blocks = -(-len(ids) // BLOCK)
        example = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in ats[1:]])
        at = np.concatenate(ats)
        ats.clear()
        w = np.concatenate(ws)
        ws.clear()
        held = np.bincount(at, minlength=len(terms))
        common = np.flatnonzero(held * COMMON >= max(len(ids), 1))
        # terms of many examples: a dense row in each block, and its maximum
        self.row = np.full(len(terms), -1, np.int32)
        self.row[common] = np.arange(len(common))
        dense = self.row[at] >= 0
        self.common = np.zeros((self.blocks, len(common), BLOCK))
        self.common[example[dense] // BLOCK, self.row[at[dense]], example[dense] % BLOCK] = w[dense]
        self.most = self.common.max(2).T.copy() if self.blocks else np.zeros((len(common), 0))
        # the others: runs of postings
        order = np.flatnonzero(~dense)
        order = order[np.argsort(at[order], kind="stable")].astype(np.int32 if len(at) < 1 << 31 else np.int64)
        self.place, self.w = example[order], w[order]
        self.start = np.concatenate(([0], np.cumsum(np.where(self.row < 0, held, 0)))).astype(np.int64)

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and weights (1 + log tf) * idf, times the label's weight, of length 1."""
        n = len(counts)
        at, tf = np.fromiter(counts.keys(), np.int64, n), np.fromiter(counts.values(), np.float64, n)
        order = np.argsort(at)
        return self.weighed(at[order], tf[order])

    def weighed(self, at: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vector of term numbers in order and their counts."""
        w = (1 + np.log(tf)) * self.weight[at]
        return at, w / np.sqrt((w * w).sum()) if len(at) else w

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEAREST, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples with a positive cosine, without example ``but``."""
        return self.nearest_of([(at, w)], [but], k)[0]

    def nearest_of(self, vectors: list[tuple], buts: list[int], k: int = NEAREST) -> list[tuple[np.ndarray, np.ndarray]]:
        """The nearest of several queries, so that a block is read once for all queries whose bound it reaches."""
        if not self.blocks:
            return [(np.empty(0, np.int64), np.empty(0)) for _ in vectors]
        query = np.zeros((len(vectors), self.common.shape[1]))
        rest = np.zeros((len(vectors), self.blocks, BLOCK))
        for q, (at, w) in enumerate(vectors):
            if len(at):
                row = self.row[at]
                query[q, row[row >= 0]] = w[row >= 0]
                first, length = self.start[at], self.start[at + 1] - self.start[at]
                upto = np.cumsum(length)
                posting = np.repeat(first - (upto - length), length) + np.arange(upto[-1])
                rest[q] = np.bincount(self.place[posting], self.w[posting] * np.repeat(w, length), self.blocks * BLOCK).reshape(self.blocks, BLOCK)
        bound = query @ self.most + rest.max(2)
        cosine = np.zeros_like(rest)
        best, read = bound.argmax(1), np.zeros(bound.shape, bool)
        # the best block of each query gives a least cosine for the others
        self._read(query, rest, cosine, read, np.arange(self.blocks) == best[:, None])
        for q, but in enumerate(buts):
            if but >= 0:
                cosine[q, but // BLOCK, but % BLOCK] = 0
        least = np.partition(cosine[np.arange(len(vectors)), best], -k, axis=1)[:, -k] if k <= BLOCK else np.zeros(len(vectors))
        # sums of other orders differ in the last bits
        self._read(query, rest, cosine, read, (bound > 0) & (bound >= least[:, None] - 1e-9) & ~read)
        out = []
        for q, but in enumerate(buts):
            found = np.round(cosine[q].ravel(), 12)
            if but >= 0:
                found[but] = 0
            last = np.partition(found, -k)[-k] if k < len(found) else 0.0
            number = np.flatnonzero((found >= last) & (found > 0))
            number = number[np.lexsort((number, -found[number]))][:k]
            out.append((number, cosine[q].ravel()[number]))
        return out

    def _read(self, query: np.ndarray, rest: np.ndarray, cosine: np.ndarray, read: np.ndarray, wanted: np.ndarray) -> None:
        for b in np.flatnonzero(wanted.any(0)).tolist():
            q = np.flatnonzero(wanted[:, b])
            cosine[q, b] = rest[q, b] + query[q] @ self.common[b]
            read[q, b] = True

    def votes(self, number: np.ndarray, cosine: np.ndarray) -> tuple[float, float]:
        """Share of label 1 among the neighbours, weighted by cosine, shrunk to none; and the greatest cosine."""
        if not len(number):
            return 0.0, 0.0
        return float((cosine * self.labels[number]).sum() / (cosine.sum() + 0.5)), float(cosine[0])

    def scores(self, vectors: list[tuple], curve: tuple[float, float, float]) -> list[tuple[float, tuple[np.ndarray, np.ndarray]]]:
        """Score and nearest examples of several documents' vectors."""
        out = []
        for found in self.nearest_of(vectors, [-1] * len(vectors)):
            vote, top = self.votes(*found)
            z = curve[0] + curve[1] * vote + curve[2] * top
            out.append((1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), found))
        return out


def _scores(index, curve: tuple[float, float, float]):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _made(index, _model)
        parent, known = index.value["parent"], {}
        for batch in batches:
            scores, evidence = [], []
            for i in range(0, len(batch), TOGETHER):
                packed = batch[i:i + TOGETHER].to_pylist()
                keys = [xxhash.xxh3_128_digest(x) for x in packed]
                if len(known) > KEPT_SCORES:
                    known.clear()
                new = {k: x for k, x in zip(keys, packed) if k not in known}
                vectors = [model.weighed(*v) for v in expanded(list(new.values()), parent)]
                for key, (score, (number, cosine)) in zip(new, model.scores(vectors, curve) if new else []):
                    known[key] = score, [{"doc_id": int(model.ids[i]), "cosine": float(c), "label": int(model.labels[i])}
                                         for i, c in zip(number[:SHOWN].tolist(), cosine[:SHOWN].tolist())]
                for key in keys:
                    scores.append(known[key][0])
                    evidence.append(known[key][1])
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(evidence, EVIDENCE)], ["score", "evidence"])
    return run


EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
EVIDENCE_TYPE = "array<struct<doc_id:long,cosine:double,label:int>>"
