"""Alignment of two tokenizers' tokens over the same text.

A byte-level BPE file (A) reads space + text; a sentencepiece model (B), which
adds that space itself, reads the text. Each library's spans are the coarse
cuts: character offsets of the one, the proto spans of the other (in units of
ASCII, where a character is a byte, both follow from the pieces). A token whose
span is as long as its decoded bytes ends where the span ends; the others (parts
of a character, fallback bytes, the added space) end as many bytes after the
token before them as they decode to. Ends that both share cut the tokens into
groups; tokens whose bytes overlap are linked.

1. *Units.* Neither tokenizer has a token that goes on over a space after a
   character that isn't white space (``Aligner`` proves that on the vocabulary),
   so a text falls there into units that can be aligned alone. Each distinct
   unit of a chunk, the documents of one task up to ``CHUNK`` characters, is
   aligned once.
2. *Chunks.* Documents (counts, digest, their linked id pairs by number) and the
   chunk's id pairs with their documents are written as one table, so that all
   later steps see the same numbers, whichever tasks are repeated.
3. *Counts.* Documents of an id pair are summed over the chunks, with partial
   sums; the best count of an A id is a maximum over its pairs.
4. *Join.* Counts go back to the chunks by number and are laid out there.

A task holds a chunk at most, a very frequent pair has one row in each chunk.

Nulls and edge cases: a text that is null or empty, or whose bytes one of the
tokenizers doesn't give back, has no tokens: zeros and an empty digest. Ids may
be null or repeat: every row is a document. A text longer than ``CHUNK`` is a
chunk of its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from growthcast.llm.bpe import Numbers, pack, piece_bytes, unpack
from growthcast.llm.tokens import tokenizer_path
from growthcast.session import materialise

CHUNK = 32_000_000
SPACE = "▁"
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


class Aligner:
    """Aligns texts unit by unit."""

    def __init__(self, a_path: str, b_path: str):
        import regex
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.a_bytes = piece_bytes(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.alone = pieces.index(SPACE)
        over = regex.compile(rf"[^{SPACE}]{SPACE}").search
        self.separable = not any(over(p) for i, p in enumerate(pieces) if not (self.b.is_control(i) or self.b.is_unknown(i)))
        self.a_width, self.b_width = (np.array(list(map(len, b))) for b in (self.a_bytes, self.b_bytes))
        self.texts = [f"{i}{c}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for c in (",", "|", ";", "\n")]
        # white space by either definition, before a space
        self.mixed = regex.compile(r"[\s\p{White_Space}] ").search
        self.glued = regex.compile(r" (?:[^ ]|(?<=[\s\p{White_Space}]) )*").findall

    def units(self, text: str) -> list[str]:
        """Units of space + text, each without its first space."""
        if not self.separable:
            return [text]
        if text[0] == " " or self.mixed(text):
            return [u[1:] for u in self.glued(" " + text)]
        return text.split(" ")

    def align(self, units: list[str]) -> Aligned:
        """All units at once: their bytes lie one after another, so that one array of ends serves for all."""
        text = " " + " ".join(units)
        begins = np.cumsum([0, *(len(u) + 1 for u in units)])
        place = byte_places(text)
        unit_end = place[begins[1:]]
        by_a = self.a.encode_batch([" " + u for u in units], add_special_tokens=False)
        a_lists = [found.ids for found in by_a]
        b_lists = [ids if u else [self.alone] for u, ids in zip(units, self.b.encode(units, num_threads=1))]
        a_ids, b_ids = (np.array(list(chain.from_iterable(x)), np.int64) for x in (a_lists, b_lists))
        n_a, n_b = (np.array(list(map(len, x)), np.int64) for x in (a_lists, b_lists))
        # where every character is a byte, spans follow from the pieces and needn't be read
        start, wide = place[begins[:-1]], [i for i, u in enumerate(units) if not u.isascii()]
        a_read = (place[np.array(by_a[i].offsets) + begins[i]] for i in wide)
        protos = self.b.encode([units[i] for i in wide], return_type="proto", num_threads=1)
        b_read = (np.array([(p.begin, p.end) for p in found.pieces]) + int(start[i]) + 1 for i, found in zip(wide, protos))
        a_spans = read_spans(self.a_width[a_ids], n_a, start, wide, a_read)
        b_spans = read_spans(self.b_width[b_ids], n_b, start, wide, b_read)

        data = text.encode("utf-8", "replace")
        bad = self.differs(data, unit_end, a_ids, n_a, self.a_bytes, self.a_width) | self.differs(data, unit_end, b_ids, n_b, self.b_bytes, self.b_width)
        unit_a, unit_b = np.repeat(np.arange(len(units)), n_a), np.repeat(np.arange(len(units)), n_b)
        in_a, in_b = ~bad[unit_a], ~bad[unit_b]
        a_ids, a_spans, unit_a, b_ids, b_spans, unit_b = a_ids[in_a], a_spans[in_a], unit_a[in_a], b_ids[in_b], b_spans[in_b], unit_b[in_b]
        unit_start = place[begins[:-1]]
        a_end = byte_ends(a_spans, self.a_width[a_ids], unit_start[unit_a])
        b_end = byte_ends(b_spans, self.b_width[b_ids], unit_start[unit_b])

        # between two ends next to each other lies one token of each side: a link
        ends = np.union1d(a_end, b_end)
        shared = np.intersect1d(a_end, b_end, assume_unique=True)
        links = a_ids[np.searchsorted(a_end, ends)] << 32 | b_ids[np.searchsorted(b_end, ends)]
        count = lambda at: np.bincount(np.searchsorted(unit_end, at), minlength=len(units))
        n_links, n_groups = count(ends), count(shared)
        return Aligned(bad, np.array([n_a * ~bad, n_b * ~bad, n_groups, n_links]), links, self.written(a_ids, a_end, b_ids, b_end, shared, unit_end, bad))

    @staticmethod
    def differs(data: bytes, unit_end: np.ndarray, ids: np.ndarray, n: np.ndarray, parts: list[bytes], width: np.ndarray) -> np.ndarray:
        """Units whose tokens' bytes aren't the unit's."""
        joined = b"".join([parts[i] for i in ids.tolist()])
        if joined == data:
            return np.zeros(len(n), bool)
        upto = np.concatenate(([0], np.cumsum(width[ids])))[np.cumsum(n)]
        edges = zip([0, *unit_end.tolist()], unit_end.tolist(), [0, *upto.tolist()], upto.tolist())
        return np.array([data[s:e] != joined[s_:e_] for s, e, s_, e_ in edges])

    def written(self, a_ids, a_end, b_ids, b_end, shared, unit_end, bad) -> list[bytes]:
        """Text of every unit's groups."""
        group = np.concatenate((np.searchsorted(shared, a_end), np.searchsorted(shared, b_end)))
        side = np.repeat([0, 1], [len(a_ids), len(b_ids)])
        order = np.lexsort((side, group))  # stable: tokens stay in order
        group, side, ids = group[order], side[order], np.concatenate((a_ids, b_ids))[order]
        last = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True) if len(ids) else np.zeros(0, bool)
        # what follows a token: another one of its side, the other side, another group, another unit
        final = np.isin(shared[group], unit_end) if len(ids) else last
        follows = np.where(last, np.where(side == 0, 1, np.where(final, 3, 2)), 0)
        found = "".join([self.texts[c] for c in (ids * 4 + follows).tolist()]).split("\n")
        good = iter(found)
        return [b"" if b else next(good).encode() for b in bad.tolist()]


class Aligned(NamedTuple):
    """Units whose bytes differ, counts (as ``COUNTS``, by unit), linked ids as a << 32 | b in order, and the groups as text."""

    bad: np.ndarray
    counts: np.ndarray
    links: np.ndarray
    groups: list[bytes]


def byte_places(text: str) -> np.ndarray:
    """Byte where each character of a text begins, and the text's end."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    return np.concatenate(([0], np.cumsum(width)))


def read_spans(width: np.ndarray, n: np.ndarray, start: np.ndarray, wide: list[int], read: Iterable[np.ndarray]) -> np.ndarray:
    """Byte spans of the tokens of units: one piece after another, and as the library gives them for the units of ``wide``."""
    first, upto = np.cumsum(n) - n, np.concatenate(([0], np.cumsum(width)))
    end = upto[1:] + np.repeat(start - upto[first], n)
    spans = np.column_stack((end - width, end))
    for i, found in zip(wide, read):
        spans[first[i]:first[i] + n[i]] = found
    return spans


def byte_ends(spans: np.ndarray, width: np.ndarray, unit_start: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: their spans' where those are as long as the decoded bytes and follow on, else as many bytes after the last such end."""
    n = len(width)
    if not n:
        return np.zeros(0, np.int64)
    fresh = np.append(True, unit_start[1:] != unit_start[:-1])
    before = np.where(fresh, unit_start, np.append(0, spans[:-1, 1]))
    sure = (spans[:, 1] - spans[:, 0] == width) & (spans[:, 0] == before)
    upto = np.cumsum(width)
    # the last sure end at or before each token, or its unit's start
    at = np.arange(n)
    anchor = np.maximum.accumulate(np.where(sure, at, np.where(fresh, at - 1, -1)))
    own = np.maximum.accumulate(np.where(fresh, at, 0))
    inside = anchor >= own
    known = np.where(inside, spans[anchor, 1], unit_start)
    done = np.where(inside, upto[anchor], np.append(0, upto)[own])
    return known + upto - done


class Chunk:
    """Aligned units and id pairs of one chunk."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.number: dict[str, int] = {}
        self.pairs = Numbers()
        self.counts, self.links = [np.zeros((len(COUNTS), 0), np.int64)], [np.zeros(0, np.int32)]
        self.groups: list[bytes] = []
        self.bad: set[int] = set()
        self.docs = np.zeros(0, np.int64)

    def learn(self, units: Iterable[str], together: int = 20_000) -> None:
        new = [u for u in dict.fromkeys(units) if u not in self.number]
        for at in range(0, len(new), together):
            part = new[at:at + together]
            found, n = self.aligner.align(part), len(self.number)
            self.number.update(zip(part, range(n, n + len(part))))
            self.bad.update((n + np.flatnonzero(found.bad)).tolist())
            keys, of = np.unique(found.links, return_inverse=True)
            numbers = np.fromiter(map(self.pairs.__getitem__, keys.tolist()), np.int32, len(keys))
            self.counts.append(found.counts)
            self.links.append(numbers[of])
            self.groups += found.groups

    def rows(self, texts: list[str]) -> Iterator[tuple]:
        """n_a, n_b, n_groups, n_links, groups_sha256 and packed (numbers, times) of the linked id pairs."""
        split = [self.aligner.units(t) if t else [] for t in texts]
        self.learn(chain.from_iterable(split))
        self.counts, self.links = [np.concatenate(self.counts, axis=1)], [np.concatenate(self.links)]
        counts, links = self.counts[0], self.links[0]
        ends = np.cumsum(counts[3])
        if len(self.docs) < len(self.pairs):
            self.docs = np.concatenate((self.docs, np.zeros(len(self.pairs), np.int64)))
        for units in split:
            codes = np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))
            if not units or (self.bad and not self.bad.isdisjoint(codes.tolist())):
                yield 0, 0, 0, 0, "", pack(np.zeros(0, np.int64), np.zeros(0, np.int64))
                continue
            n = counts[3][codes]
            upto = np.cumsum(n, dtype=np.int64)
            found, times = np.unique(links[np.repeat(ends[codes] - upto, n) + np.arange(upto[-1])], return_counts=True)
            self.docs[found] += 1
            digest = sha256(b";".join([self.groups[c] for c in codes.tolist()])).hexdigest()
            yield *(int(c[codes].sum()) for c in counts), digest, pack(np.diff(found, prepend=0), times)


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None,
              b_path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row."""
    aligned = aligned_chunks(docs, id_col, text_col, a_path, b_path, chunk)
    kind = aligned.schema["doc_id"].dataType.simpleString()
    own = aligned.where("place IS NOT NULL").select("chunk", "place", "a", "b", "docs")
    counted = own.join(pair_counts(own), ["a", "b"]).select(F.col("chunk").alias("of"), F.col("place").alias("at"), "count", F.col("best").cast("int").alias("best"))
    rows = aligned.where("place IS NULL").select("chunk", "doc_id", *COUNTS, "groups_sha256", "links")
    return (counted.groupBy("of").cogroup(rows.groupBy("chunk"))
            .applyInArrow(_lay_out, f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, n_best long, count_sum long, groups_sha256 string"))


def aligned_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None,
                   b_path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Written rows of two sorts: a document, or (place not null) a chunk's id pair with its number and documents there."""
    paths = a_path or tokenizer_path(), b_path or tokenizer_path("piece_bpe_32k.model")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"chunk long, doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, links binary, place int, a int, b int, docs long"
    return materialise(texts.mapInArrow(_align_chunks(paths, chunk), schema), "aligned")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, docs) -> a, b, count over all rows, best: no pair of this a has more."""
    totals = pairs.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    top = totals.groupBy("a").agg(F.max("count").alias("top"))
    return totals.join(top, "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def _align_chunks(paths: tuple[str, str], size: int, together: int = 2_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, length, aligner = TaskContext.get().partitionId() << 32, 0, Aligner(*paths)
        chunk = Chunk(aligner)
        gc.disable()  # tables of a chunk are large and hold no cycles
        for batch in batches:
            texts = batch.column("text")
            for start, end in _parts(texts, together):
                part = [t or "" for t in texts.slice(start, end - start).to_pylist()]
                n = sum(map(len, part))
                if length and length + n > size:
                    yield from _pairs(at, chunk, batch.schema.field("doc_id").type)
                    at, length, chunk = at + 1, 0, Chunk(aligner)
                length += n
                yield _documents(at, batch.column("doc_id").slice(start, end - start), list(chunk.rows(part)))
        if length:
            yield from _pairs(at, chunk, batch.schema.field("doc_id").type)
    return run


def _parts(texts: pa.Array, together: int) -> Iterator[tuple[int, int]]:
    """Row ranges of some two million bytes, or of one longer text."""
    import pyarrow.compute as pc

    widths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = total = 0
    for i, w in enumerate(widths):
        if total and total + w > together:
            yield start, i
            start, total = i, 0
        total += w
    if start < len(widths):
        yield start, len(widths)


NAMES = ["chunk", "doc_id", *COUNTS, "groups_sha256", "links", "place", "a", "b", "docs"]


def _documents(at: int, ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    n = len(rows)
    *counts, digests, links = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, at)), ids, *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(links, pa.binary()),
         pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], NAMES)


def _pairs(at: int, chunk: Chunk, kind: pa.DataType, together: int = 100_000) -> Iterator[pa.RecordBatch]:
    keys = np.fromiter(chunk.pairs, np.int64, len(chunk.pairs))
    used = np.flatnonzero(chunk.docs[:len(keys)])  # units of texts left out may have pairs of no document
    for i in range(0, len(used), together):
        place = used[i:i + together]
        n = len(place)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, at)), pa.nulls(n, kind), *[pa.nulls(n, pa.int64())] * 4, pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()),
             pa.array(place.astype(np.int32)), pa.array((keys[place] >> 32).astype(np.int32)), pa.array((keys[place] & 0xFFFFFFFF).astype(np.int32)),
             pa.array(chunk.docs[place])], NAMES)


def _lay_out(counted: pa.Table, rows: pa.Table) -> pa.Table:
    """Sums over the links of each document of a chunk."""
    place = counted.column("at").to_numpy()
    count, best = np.zeros((2, 1 + place.max(initial=0)), np.int64)
    count[place], best[place] = counted.column("count").to_numpy(), counted.column("best").to_numpy()
    n_best, count_sum = [], []
    for links in rows.column("links"):
        step, times = unpack(links.as_py())
        found = np.cumsum(step, dtype=np.int64)
        n_best.append(int(best[found] @ times.astype(np.int64)))
        count_sum.append(int(count[found] @ times.astype(np.int64)))
    return pa.table({"doc_id": rows.column("doc_id"), **{c: rows.column(c) for c in COUNTS},
                     "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()), "groups_sha256": rows.column("groups_sha256")})
