"""Hard negatives by rotated one-bit codes.

Components become integers, floor(scale * x). A vector x is rotated and coded by
the signs of what its earlier codes leave: x = a1*s1 + ... + aL*sL + r, with
``a`` the stored alignment of a code and what it codes, and r the rest. An
anchor is rounded to eight bits, so that its product with a code is a sum of
popcounts over bit planes. The estimate of <anchor, x> after code l is off by

    |r| * sqrt(|anchor|^2 - <anchor, s_l>^2 / n)   (Cauchy-Schwarz, as r and s_l are orthogonal)
    + |anchor - rounded anchor| * |x|

at most, whatever the vectors. A candidate whose interval can't reach what is
sought goes; the next code is read only for those that stay, and whatever is
left after the last one is scored in integers, so the result is exact.

1. *Positives.* Every block of anchors meets every block of rows; each meeting
   gives an anchor's best rows of its label, of which the first are taken.
2. *Negatives.* The same blocks meet again: each gives, for every positive, the
   best rows of other labels between ``low`` and ``high`` percent of its score.

Rows are packed into blocks of some ``ROWS`` (dealt by a hash) once, with their
codes; blocks are sent to the blocks of ``ANCHORS`` anchors. A meeting returns a
few rows an anchor; nothing is collected or broadcast.

Nulls and edge cases: rows whose id, label or vector is null, or whose vector
holds nulls, NaN or infinities, take no part; vectors meet only those of their
own length; an anchor's own id is never its positive; rows that repeat an id are
rows of their own but ask once, with the least of their labels and vectors; of
rows that are equal throughout, as many as could be returned are kept; scores
beyond 64 bits are held at their ends; equal scores go to the smaller id; an empty vector
scores 0; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import io
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from growthcast.session import materialise

SCALE = 256
#: Rows and anchors of a block, one-bit codes of a row, bits of an anchor's component.
ROWS, ANCHORS, CODES, BITS = 16_384, 512, 4, 8
#: Products of lengths from which scores leave 64-bit arithmetic.
SAFE = float(1 << 45)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding",
                   positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    x = F.col(vec_col)
    usable = F.col(id_col).isNotNull() & label.isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.coalesce(usable, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
        F.transform(x, lambda c: c.cast("double") * float(scale)).alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = materialise(rows.groupBy("id", "label", "x", "asks").agg(F.least(F.count("*"), F.lit(max(positives, negatives))).alias("copies"))
                       .withColumn("n", F.size("x")), "vectors")
    anchors = rows.where("asks").groupBy("id").agg(F.min(F.struct("label", "x")).alias("v")).select("id", "v.*", F.size("v.x").alias("n"))
    blocks = blocks_of_rows(rows)

    found = meet(anchors.withColumn("sought", F.lit(None).cast("array<struct<score:long,id:long>>")), blocks, _positives(positives),
                 "anchor_id long, id long, score long")
    best = W.partitionBy("anchor_id").orderBy(F.col("score").desc(), "id")
    found = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= positives)
    sought = materialise(found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("sought")), "positives")

    asking = anchors.join(sought.withColumnRenamed("anchor_id", "id"), "id")
    mined = meet(asking, blocks, _negatives(negatives, low, high), "anchor_id long, positive_id long, positive_score long, copy int, id long, score long")
    best = W.partitionBy("anchor_id", "positive_id", "copy").orderBy(F.col("score").desc(), "id")
    return mined.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def blocks_of_rows(rows: DataFrame) -> DataFrame:
    """(n, c, data): rows packed with their codes, written once for both meetings."""
    each = rows.select("n", "id", "label", "x", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    sizes = rows.groupBy("n").agg(F.ceil(F.sum("copies") / ROWS).cast("int").alias("c_blocks"))
    dealt = each.join(sizes, "n").withColumn("c", F.pmod(F.xxhash64("id", "label", "x", "copy"), F.col("c_blocks")).cast("int"))
    count = _total(sizes, F.col("c_blocks"))
    return materialise(dealt.select("n", "c", "id", "label", "x").repartition(count, "n", "c").groupBy("n", "c")
                       .applyInArrow(_pack_rows, "n int, c int, data binary"), "blocks")


def meet(anchors: DataFrame, blocks: DataFrame, search: Callable, schema: str) -> DataFrame:
    """``search`` for every block of anchors and every block of rows of the same length of vector."""
    sizes = anchors.groupBy("n").agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("q_blocks"))
    dealt = anchors.join(sizes, "n").withColumn("q", F.pmod(F.xxhash64("id"), F.col("q_blocks")).cast("int"))
    packed = (dealt.select("n", "q", "id", "label", "x", "sought").repartition(_total(sizes, F.col("q_blocks")), "n", "q").groupBy("n", "q")
              .applyInArrow(_pack_anchors, "n int, q int, asked binary"))
    of = blocks.groupBy("n").agg((F.max("c") + 1).alias("c_blocks"))
    plan = sizes.join(of, "n")
    tasks = _total(plan, F.col("q_blocks").cast("long") * F.col("c_blocks"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asked = packed.join(plan, "n").select("n", "q", each("c_blocks").alias("c"), "asked")
    given = blocks.join(plan, "n").select(F.col("n").alias("n_"), each("q_blocks").alias("q_"), F.col("c").alias("c_"), "data")
    asked, given = asked.repartition(tasks, "n", "q", "c"), given.repartition(tasks, "n_", "q_", "c_")
    return asked.groupBy("n", "q", "c").cogroup(given.groupBy("n_", "q_", "c_")).applyInArrow(_met(search, schema), schema)


def _total(sizes: DataFrame, blocks: Column) -> int:
    """Partitions for so many blocks: one each, up to ten thousand."""
    return max(1, min(10_000, sizes.agg(F.sum(blocks)).first()[0] or 0))


# ---- codes

@cache
def rotation(n: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(29).standard_normal((n, n)))[0] if n else np.zeros((0, 0))


def words_of_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    if not bits.shape[1]:
        return np.zeros((len(bits), 0), np.uint64)
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def codes_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (code, row, word), alignments (code, row) and lengths of the rests (code, row) of integer vectors."""
    rest = v @ rotation(v.shape[1])
    words, along, left = [], [], []
    for _ in range(CODES):
        sign = rest >= 0
        s = np.where(sign, 1.0, -1.0)
        a = (rest * s).mean(1) if v.shape[1] else np.zeros(len(v))
        rest = rest - a[:, None] * s
        words.append(words_of_bits(sign))
        along.append(a)
        left.append(np.sqrt((rest * rest).sum(1)))
    return np.array(words), np.array(along), np.array(left)


class Anchor:
    """An anchor's bit planes, for estimates of its products."""

    def __init__(self, v: np.ndarray):
        turned = v @ rotation(len(v))
        self.n, self.length = len(v), float(np.sqrt(turned @ turned))
        top = (1 << (BITS - 1)) - 1
        self.step = max(np.abs(turned).max(initial=0.0) / top, 1e-300)
        rounded = np.rint(turned / self.step)
        self.off = float(np.sqrt(((turned - rounded * self.step) ** 2).sum()))
        self.square = float(rounded @ rounded)
        shifted = (rounded + top + 1).astype(np.int64)
        self.planes = [words_of_bits((shifted >> j & 1).astype(np.uint8)[None])[0] for j in range(BITS)]
        self.shift, self.sum = top + 1, float(rounded.sum())

    def product(self, words: np.ndarray) -> np.ndarray:
        """Of the rounded anchor and codes, in steps."""
        ones = lambda w: np.bitwise_count(w).sum(1, dtype=np.int64) if w.shape[1] > 1 else np.bitwise_count(w[:, 0]).astype(np.int64)
        total = -self.shift * ones(words)
        for j, plane in enumerate(self.planes):
            total += ones(words & plane) << j
        return 2.0 * total - self.sum


def intervals(anchor: Anchor, block: dict, rows: np.ndarray):
    """After each code, sure bounds (low, high) of the products of the rows still there; the caller sends back which of them stay."""
    estimate = np.zeros(len(rows))
    for l in range(CODES):  # noqa: E741
        code = anchor.product(block["words"][l][rows])
        estimate = estimate + block["along"][l][rows] * code * anchor.step
        across = np.sqrt(np.maximum(anchor.square - code * code / max(anchor.n, 1), 0.0)) * anchor.step
        length = block["length"][rows]
        room = block["left"][l][rows] * across + anchor.off * length + 1e-9 * (1 + anchor.length * length)
        stay = yield estimate - room, estimate + room
        if stay is not None:
            rows, estimate = rows[stay], estimate[stay]
            yield


def scores(block: dict, rows: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact products, held within 64 bits."""
    length = float(np.sqrt((v * v).sum()))
    with np.errstate(all="ignore"):
        safe = block["length"][rows] * length < SAFE
    out = np.empty(len(rows), np.int64)
    out[safe] = block["v"][rows[safe]].astype(np.float64) @ v if safe.any() else 0
    for i in np.flatnonzero(~safe).tolist():
        whole = sum(int(a) * int(b) for a, b in zip(block["v"][rows[i]].tolist(), v.tolist()))
        out[i] = max(-(1 << 63), min(whole, (1 << 63) - 1))
    return out


def survivors(block: dict, rows: np.ndarray, v: np.ndarray, stays: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Rows that ``stays(low, high)`` can't rule out by any code; large vectors are never ruled out."""
    with np.errstate(all="ignore"):
        small = block["length"][rows] * float(np.sqrt((v * v).sum())) < SAFE
    large, rows = rows[~small], rows[small]
    if not len(rows) or not len(v):
        return np.concatenate((rows, large))
    bounds = intervals(Anchor(v), block, rows)
    for low, high in bounds:
        stay = np.flatnonzero(stays(low, high))
        rows = rows[stay]
        bounds.send(stay)
        if not len(rows):
            break
    return np.concatenate((rows, large))


# ---- searches of one block for one anchor

def first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first: higher scores, then smaller ids."""
    return np.lexsort((ids, -score.astype(object) if (score == -(1 << 63)).any() else -score))[:k]


def _positives(k: int):
    def search(block: dict, anchor_id: int, label: int, v: np.ndarray, _) -> list[np.ndarray]:
        rows = np.flatnonzero((block["label"] == label) & (block["id"] != anchor_id))
        if not len(rows):
            return [np.empty(0, np.int64)] * 3

        def stays(low, high):
            return high >= np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else np.ones(len(low), bool)

        rows = survivors(block, rows, v, stays)
        score = scores(block, rows, v)
        best = first(score, block["id"][rows], k)
        return [np.full(len(best), anchor_id), block["id"][rows[best]], score[best]]
    return search


def _negatives(k: int, low_percent: int, high_percent: int):
    def search(block: dict, anchor_id: int, label: int, v: np.ndarray, sought: list[dict]) -> list[np.ndarray]:
        rows = np.flatnonzero(block["label"] != label)
        # whole scores from -(-p * low // 100) to p * high // 100
        bands = [(-(-p["score"] * low_percent // 100), p["score"] * high_percent // 100) for p in sought]
        wanted = {b for b in bands if b[0] <= b[1]}

        def stays(low, high):
            keep = np.zeros(len(low), bool)
            for least, most in wanted:
                inside = (high >= least) & (low <= most)
                sure = low[(low >= least) & (high <= most)]
                if len(sure) >= k:
                    inside &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
                keep |= inside
            return keep

        out = []
        if wanted and len(rows):
            rows = survivors(block, rows, v, stays)
            score = scores(block, rows, v)
            for copy, (p, (least, most)) in enumerate(zip(sought, bands)):
                own = np.flatnonzero((score >= least) & (score <= most))
                own = own[first(score[own], block["id"][rows[own]], k)]
                full = lambda x: np.full(len(own), x, np.int64)  # noqa: B023, E731
                out.append([full(anchor_id), full(p["id"]), full(p["score"]), full(copy), block["id"][rows[own]], score[own]])
        return [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 6
    return search


# ---- blocks

def _matrix(x: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in x.chunks]) if x.num_chunks else np.zeros(0)
    # scaled components beyond doubles are held at the greatest
    return np.clip(np.floor(flat), -np.finfo(float).max, np.finfo(float).max).reshape(len(x), n)


def _pack_rows(key: tuple, rows: pa.Table) -> pa.Table:
    n, c = (k.as_py() for k in key)
    rows = rows.sort_by("id")
    v = _matrix(rows.column("x"), n)
    with np.errstate(all="ignore"):
        words, along, left = codes_of(v)
        length = np.sqrt((v * v).sum(1))
    kind = next((t for t in (np.int16, np.int32) if not len(v) or np.abs(v).max(initial=0.0) <= np.iinfo(t).max), np.float64)
    data = io.BytesIO()
    np.savez(data, id=rows.column("id").to_numpy(), label=rows.column("label").to_numpy(), v=v.astype(kind), words=words, along=along, left=left, length=length)
    return pa.table({"n": pa.array([n], pa.int32()), "c": pa.array([c], pa.int32()), "data": pa.array([data.getvalue()], pa.binary())})


def _pack_anchors(key: tuple, rows: pa.Table) -> pa.Table:
    n, q = (k.as_py() for k in key)
    sink = io.BytesIO()
    own = rows.select(["id", "label", "x", "sought"]).sort_by("id")
    with pa.ipc.new_stream(sink, own.schema) as stream:
        stream.write_table(own)
    return pa.table({"n": pa.array([n], pa.int32()), "q": pa.array([q], pa.int32()), "asked": pa.array([sink.getvalue()], pa.binary())})


def _met(search: Callable, schema: str):
    fields = [f.split() for f in schema.split(", ")]
    types = pa.schema([(name, {"long": pa.int64(), "int": pa.int32()}[kind]) for name, kind in fields])

    def run(key: tuple, asked: pa.Table, given: pa.Table) -> pa.Table:
        out = []
        for data in given.column("data"):
            block = dict(np.load(io.BytesIO(data.as_py())))
            for packed in asked.column("asked"):
                anchors = pa.ipc.open_stream(packed.as_py()).read_all()
                vectors = _matrix(anchors.column("x"), key[0].as_py())
                for i, v in enumerate(vectors):
                    found = search(block, anchors.column("id")[i].as_py(), anchors.column("label")[i].as_py(), v, anchors.column("sought")[i].as_py())
                    if len(found[0]):
                        out.append(found)
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * len(fields)
        return pa.table([pa.array(c).cast(t.type) for c, t in zip(columns, types)], schema=types)
    return run
