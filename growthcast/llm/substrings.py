"""Substring deduplication by seed and extend.

A window is ``window`` consecutive words of one document. Words covered by a
window whose words also start earlier (smaller id, or same document and
earlier start) are removed; overlapping windows join up to maximal repeats.

1. *Seeds.* Every window picks an anchor, the run of ``seed`` words in it with
   the least hash (the leftmost of equal ones). Equal windows pick the same
   anchor at the same offset, and neighbouring windows mostly share theirs, so
   there is one anchor for every eight words or so.
2. *Join.* Anchors are counted; only occurrences of anchors that come more than
   once go on. Counting is combined before the shuffle.
3. *Extend.* The windows of one anchor occurrence, reaching to both sides of
   it, are first compared as a whole stretch: all but the first of equal
   stretches are repeats. Where an anchor has several stretches, the windows in
   the first of each are compared one by one.
4. Covered words are cut from the texts.

Nothing is paired: a group of equal stretches or windows is read in order of
place, and each row is compared with the first. Anchors with more than ``hot``
occurrences deal their rows over several tasks first, and the first rows of
those meet in a second round. Nothing grows on the driver.

Nulls and edge cases: a null or empty text has no words and comes back as the
empty string; texts of fewer than ``window`` words are kept whole; rows
with one id are one document, so of two
such rows neither is earlier at the same start; texts of any length are taken
whole; an empty table gives no rows; other columns are not looked at. Ids are
taken to be unique where texts differ: rows of one id with different texts
share their removed places. Rows of no id are documents of their own, after
every other and in an order of their own (the written one), so of equal ones all
but one lose their windows; with them, ids must lie 2^50 below the greatest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from growthcast.llm.common import words_of
from growthcast.llm.shingles import Hasher, Runs, mixed
from growthcast.session import materialise

WINDOW, SEED, HOT = 20, 6, 5_000
#: Rows of anchors or windows that a task puts into one batch, about.
BATCH = 200_000


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, seed: int = SEED, hot: int = HOT, carry: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """doc_id, kept (the kept words joined by one space), n_words, n_removed for every row, and the columns to ``carry``."""
    texts = _numbered(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                                  *(F.col(c).alias(f"_{c}") for c in carry if c != text_col)))
    anchors = materialise(texts.select("doc", "text").mapInArrow(_anchor_rows(window, seed), "anchor long, doc long, n int"), "anchors")
    shared = anchors.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1")
    salts = F.when(F.col("total") > hot, F.ceil(F.col("total") / hot)).otherwise(0).cast("int")
    # steps are written, so that the shuffle files of one are gone before the next; size estimates of written lists are far too small
    found = materialise(anchors.select("anchor", "doc").join(shared, "anchor").groupBy("doc")
                        .agg(F.collect_set(F.struct("anchor", salts.alias("salts"))).alias("found")), "found").hint("merge")
    # both joins up to what is gone take the same columns of texts, so their shuffle is made once
    stretches = (texts.join(found, "doc", "left").where(F.col("found").isNotNull())
                 .select(*texts.columns, "found.anchor", "found.salts").mapInArrow(_stretch_rows(window, seed), STRETCH))
    again, first = _repeats(stretches)
    several = first.groupBy("anchor").count().where("count > 1").select("anchor")
    unclear = first.join(several, "anchor").groupBy("doc").agg(F.collect_list(F.struct("pos", "len", "salts", "anchor")).alias("open"))
    windows = (texts.join(unclear, "doc", "left").where(F.col("open").isNotNull())
               .select(*texts.columns, "open.pos", "open.len", "open.salts", "open.anchor").mapInArrow(_window_rows(window), STRETCH))
    again = again.union(_repeats(windows)[0])
    gone = materialise(again.groupBy("doc").agg(F.collect_set(F.struct("pos", "len")).alias("gone")), "gone").hint("merge")
    cut = F.arrow_udf(_cut(window), "kept string, n_words long, n_removed long")
    return (texts.join(gone, "doc", "left").withColumn("_cut", cut("text", "gone.pos", "gone.len"))
            .select("doc_id", "_cut.kept", "_cut.n_words", "_cut.n_removed", *(F.col("text" if c == text_col else f"_{c}").alias(c) for c in carry)))


def _numbered(texts: DataFrame) -> DataFrame:
    """Rows of no id get numbers after the greatest id; they are written, so that the numbers stay."""
    ids = texts.agg(F.count_if(F.col("doc").isNull()).alias("none"), F.coalesce(F.max("doc"), F.lit(0)).alias("last")).first()
    if not ids.none:
        return texts
    rows = texts.where(F.col("doc").isNull()).withColumn("doc", F.lit(max(ids.last, 0)) + 1 + F.monotonically_increasing_id())
    return texts.where(F.col("doc").isNotNull()).union(materialise(rows, "no-ids"))


#: ``len`` windows from ``pos`` on, whose words are told apart by ``key``.
COLUMNS = ["anchor", "key", "salt", "salts", "doc", "pos", "len"]
TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
STRETCH = "anchor long, key long, salt int, salts int, doc long, pos int, len int"


def _repeats(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, pos, len) of all but the first rows of a key, and those first rows."""
    schema = STRETCH + ", again boolean"
    one = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "doc", "pos").mapInArrow(_mark, schema)
    two = (one.where("not again and salt >= 0").drop("again").repartition("key")
           .withColumn("salt", F.lit(-1)).sortWithinPartitions("key", "doc", "pos").mapInArrow(_mark, schema))
    again = one.where("again").select("doc", "pos", "len").union(two.where("again").select("doc", "pos", "len"))
    first = [x.select("anchor", "doc", "pos", "len", "salts") for x in (one.where("not again and salt < 0"), two.where("not again"))]
    return again, first[0].union(first[1])


def _places(runs: Runs, window: int, seed: int) -> np.ndarray:
    """Anchor position of every window."""
    hashes = runs.of(seed)
    span = window - seed + 1
    if len(hashes) < span:
        return np.empty(0, np.int64)
    parts = []
    # the low bits hold the place, so that a minimum tells where it is; very long texts go in overlapping pieces
    for at in range(0, len(hashes) - span + 1, PIECE):
        least = (hashes[at:at + PIECE + span - 1] & ~LOW) | np.arange(min(PIECE + span - 1, len(hashes) - at), dtype=np.uint64)
        m, wide = len(least) - span + 1, 1
        while 2 * wide <= span:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        parts.append((np.minimum(least[:m], least[span - wide:span - wide + m]) & LOW).astype(np.int64) + at)
    return np.concatenate(parts)


LOW, PIECE = np.uint64((1 << 24) - 1), 1 << 23


def _batch(parts: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*parts), types)], names)


def _in_batches(rows: Iterator[tuple], names: list[str], types: list) -> Iterator[pa.RecordBatch]:
    parts, n = [], 0
    for row in rows:
        parts.append(row)
        n += len(row[0])
        if n >= BATCH:
            yield _batch(parts, names, types)
            parts, n = [], 0
    if parts:
        yield _batch(parts, names, types)


def _anchor_rows(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()

        def rows():
            for batch in batches:
                for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text")):
                    runs = hasher.runs((text.as_py() or "").encode("utf-8", "replace"))
                    at = _places(runs, window, seed)
                    if len(at):
                        at = at[np.append(True, at[1:] != at[:-1])]
                        anchor, n = np.unique(runs.of(seed)[at], return_counts=True)
                        yield anchor.view(np.int64), np.full(len(anchor), doc), n.astype(np.int32)

        yield from _in_batches(rows(), ["anchor", "doc", "n"], [pa.int64(), pa.int64(), pa.int32()])
    return run


def _salt(doc: int, salts: np.ndarray) -> np.ndarray:
    return np.where(salts > 0, doc % np.maximum(salts, 1).astype(np.int64), -1).astype(np.int32)


def _stretch_rows(window: int, seed: int):
    """For each joined anchor of a document, the stretch of windows that picked it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()

        def rows():
            for batch in batches:
                for doc, text, anchor, salts in zip(*(batch.column(c) for c in ("doc", "text", "anchor", "salts"))):
                    doc, runs = doc.as_py(), hasher.runs((text.as_py() or "").encode("utf-8", "replace"))
                    at = _places(runs, window, seed)
                    if not len(at):  # a row of the same id may be shorter
                        continue
                    start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                    length = np.diff(np.append(start, len(at)))
                    at = at[start]
                    anchor, salts = anchor.values.to_numpy().view(np.uint64), salts.values.to_numpy()
                    order = np.argsort(anchor)
                    anchor, salts = anchor[order], salts[order]
                    own = runs.of(seed)[at]
                    found = np.minimum(np.searchsorted(anchor, own), len(anchor) - 1)
                    keep = anchor[found] == own
                    start, length, at, own, salts = start[keep], length[keep], at[keep], own[keep], salts[found[keep]]
                    # stretches are equal if their words and the anchor's place among them are
                    key = mixed(runs.between(start, start + length + window - 1) + (at - start).astype(np.uint64))
                    yield (own.view(np.int64), key.view(np.int64), _salt(doc, salts), salts, np.full(len(start), doc),
                           start.astype(np.int32), length.astype(np.int32))

        yield from _in_batches(rows(), COLUMNS, TYPES)
    return run


def _window_rows(window: int):
    """Every window of the given stretches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()

        def rows():
            for batch in batches:
                for doc, text, *lists in zip(*(batch.column(c) for c in ("doc", "text", "pos", "len", "salts", "anchor"))):
                    doc, runs = doc.as_py(), hasher.runs((text.as_py() or "").encode("utf-8", "replace"))
                    pos, length, salts, anchor = (x.values.to_numpy() for x in lists)
                    row = np.repeat(np.arange(len(pos)), length)
                    start = pos[row] + np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
                    inside = start + window <= runs.n
                    row, start = row[inside], start[inside]
                    if len(row):
                        yield (anchor[row], runs.between(start, start + window).view(np.int64), _salt(doc, salts[row]), salts[row],
                               np.full(len(row), doc), start.astype(np.int32), np.ones(len(row), np.int32))

        yield from _in_batches(rows(), COLUMNS, TYPES)
    return run


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tells rows in order of (key, salt, doc, pos) that come after their group's first one.

    Only the last group's first row is kept between batches.
    """
    last, first = None, None
    for batch in batches:
        key, salt, doc, pos = (batch.column(c).to_numpy() for c in ("key", "salt", "doc", "pos"))
        if not len(key):
            continue
        new = np.empty(len(key), bool)
        new[0] = last != (key[0], salt[0])
        new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        old = at < 0
        first_doc, first_pos = doc[at], pos[at]
        if old.any():
            first_doc, first_pos = np.where(old, first[0], first_doc), np.where(old, first[1], first_pos)
        last, first = (key[-1], salt[-1]), (first_doc[-1], first_pos[-1])
        again = pa.array((doc != first_doc) | (pos != first_pos))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in COLUMNS), again], [*COLUMNS, "again"])


def _cut(window: int):
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            kept, totals, gone = [], [], []
            for text, pos, length in zip(*batch):
                words = words_of(text.as_py())
                removed = np.zeros(len(words), bool)
                if pos.is_valid:
                    start, end = pos.values.to_numpy(), pos.values.to_numpy() + length.values.to_numpy() - 1 + window
                    # a row of the same id may be shorter than the one that a place comes from
                    fits = end <= len(words)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, start[fits], 1)
                    np.add.at(edge, end[fits], -1)
                    removed = np.cumsum(edge)[:-1] > 0
                left = [w for w, r in zip(words, removed.tolist()) if not r] if removed.any() else words
                kept.append(b" ".join(left).decode("utf-8", "replace"))
                totals.append(len(words))
                gone.append(int(removed.sum()))
            yield pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64())],
                                             ["kept", "n_words", "n_removed"])
    return run
