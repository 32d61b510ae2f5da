"""BPE encoding and decoding through a table of distinct words.

1. *Split.* Tasks split their documents into words (pre-tokens and added
   tokens) and number the distinct words of a chunk, the documents of one task
   up to ``CHUNK`` characters. A document becomes the list of its words' numbers.
2. *Words.* The chunks' words are sorted, so that each distinct word of the
   corpus is a run of rows, whichever chunks have it; it is merged once and its
   ids go to all rows of the run.
3. *Join.* The ids come back to their chunk by number and are laid out by
   position in each document.

Decoding joins ids to the vocabulary's pieces (as many rows as the vocabulary
file has, so they are broadcast), once for each distinct word of a chunk, and
``decode`` does it for any frame of ids.

Nothing grows with the corpus in a task: a chunk is bounded, and a very
frequent word has one row in each chunk. A lost task is repeated with the same
chunks, as they follow the input's splits.

Nulls and edge cases: a null or empty text has no ids and decodes to the empty
string; ids of documents may be null or repeat; a text longer than ``CHUNK`` is a
chunk of its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from growthcast.llm.tokens import Splitter, byte_letters, tokenizer_path

CHUNK = 16_000_000


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids (array of int) and decoded (the text that the ids stand for) for every row."""
    path = path or tokenizer_path()
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # both maps read the same columns, so they see the same partitions and make the same chunks
    words = (texts.mapInArrow(_words(path, chunk), "chunk long, place long, word string")
             .repartition("word").sortWithinPartitions("word").mapInArrow(_merge(path), "chunk long, packed binary"))
    coded = texts.mapInArrow(_codes(path, chunk), f"chunk long, doc_ids array<{kind}>, packed binary")
    piece = pieces(texts.sparkSession, path).toArrow().sort_by("id").column("piece").to_pylist()
    return (words.groupBy("chunk").cogroup(coded.groupBy("chunk"))
            .applyInArrow(_lay_out(texts.sparkSession.sparkContext.broadcast(piece)), f"doc_id {kind}, ids array<int>, decoded string"))


def piece_bytes(path: str) -> list[bytes]:
    """Bytes of every id; ids that the file leaves out are empty."""
    split = Splitter(path)
    bytes_of = {c: bytes([b]) for b, c in enumerate(byte_letters())}
    vocabulary = split.tokenizer.get_vocab(with_added_tokens=False)
    out = [b""] * (1 + max([*vocabulary.values(), *split.added.values()]))
    for piece, i in vocabulary.items():
        out[i] = b"".join(bytes_of[c] for c in piece)
    for content, i in split.added.items():
        out[i] = content.encode()
    return out


def pieces(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id, piece): the vocabulary as a table. A task reads the file, so that the driver doesn't hold the tokenizer."""
    return spark.range(0, 1, 1, 1).mapInArrow(_pieces(path or tokenizer_path()), "id int, piece binary")


def decode(ids: DataFrame, keys: list[str], ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Texts of arrays of ids: exploded with their positions, joined to the pieces and put together again.

    ``keys`` name a row. A null or empty array gives the empty string; ids
    outside the vocabulary are left out; bytes that are no UTF-8 show as U+FFFD.
    """
    at = ids.select(*keys, F.posexplode_outer(ids_col).alias("_at", "_id"))
    joined = at.join(F.broadcast(pieces(ids.sparkSession, path)), F.col("_id") == F.col("id"), "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("_at", F.hex("piece").alias("h")))))
    text = F.decode(F.unhex(F.concat_ws("", F.transform("_parts", lambda x: x["h"]))), "utf-8")
    return joined.groupBy(*keys).agg(parts.alias("_parts")).select(*keys, text.alias("text"))


class Numbers(dict):
    """Numbers words in the order in which they come first."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers below 2^32, compressed for the shuffle: lengths, then byte by byte, as high bytes are mostly zero."""
    import zstandard

    body = b"".join(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(arrays), *map(len, arrays)], "<u4").tobytes() + body)


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    lengths = np.frombuffer(raw, "<u4", np.frombuffer(raw, "<u4", 1)[0], 4).tolist()
    out, at = [], 4 + 4 * len(lengths)
    for n in lengths:
        out.append(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T.copy().view("<u4").ravel())
        at += 4 * n
    return out


def _texts(batches: Iterator[pa.RecordBatch], chunk: int):
    """(chunk's number, id, text) in order; the number changes before a chunk would exceed its size."""
    from pyspark import TaskContext

    # 2^32 chunks a task, each of one text at least
    at, length = TaskContext.get().partitionId() << 32, 0
    last = at + (1 << 32) - 1
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            text = text.as_py() or ""
            if length and length + len(text) > chunk:
                if at == last:
                    raise OverflowError("a task has more than 2^32 chunks")
                at, length = at + 1, 0
            length += len(text)
            yield at, doc_id, text


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:  # one row
            found = piece_bytes(path)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found, pa.binary())], ["id", "piece"])
    return run


def _words(path: str, chunk: int):
    """The distinct words of every chunk with their numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(path)
        for at, rows in groupby(_texts(batches, chunk), lambda r: r[0]):
            number = Numbers()
            for _, _, text in rows:
                for word in dict.fromkeys(split(text)):
                    number[word]
            words = list(number)
            for i in range(0, len(words), 50_000):
                part = words[i:i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), at)), pa.array(np.arange(i, i + len(part))), pa.array(part, pa.string())],
                                                 ["chunk", "place", "word"])
    return run


def _codes(path: str, chunk: int, together: int = 500):
    """Documents as numbers of their words, some of them in each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(path)
        for at, rows in groupby(_texts(batches, chunk), lambda r: r[0]):
            number = Numbers()
            while part := list(islice(rows, together)):
                codes = []
                for _, _, text in part:
                    words = split(text)
                    codes.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                ids = pa.array([r[1].as_py() for r in part], part[0][1].type)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                     pa.array([pack(np.array(list(map(len, codes))), np.concatenate(codes))], pa.binary())], ["chunk", "doc_ids", "packed"])
    return run


def _merge(path: str):
    """Ids of sorted words: each run of one word is merged once. A batch gives one row to each chunk: numbers, lengths, ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, last, ids = Splitter(path), None, []
        for batch in batches:
            found, length = [], []
            for word in batch.column("word").to_pylist():
                if word != last:
                    last, ids = word, split.merge(word)
                found.append(ids)
                length.append(len(ids))
            chunk, k, length = batch.column("chunk").to_numpy(), batch.column("place").to_numpy(), np.array(length, np.int64)
            order = np.argsort(chunk, kind="stable")
            names, start = np.unique(chunk[order], return_index=True)
            packed = []
            for rows in np.split(order, start[1:]):
                packed.append(pack(k[rows], length[rows], np.array([i for r in rows.tolist() for i in found[r]], np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(packed, pa.binary())], ["chunk", "packed"])
    return run


def _lay_out(pieces):
    def run(words: pa.Table, coded: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py()) for x in words.column("packed")]
        k, count, ids = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.uint32) for i in range(3))
        first = np.cumsum(count, dtype=np.int64) - count
        # by number of the word: where its ids are, and its text
        place = np.argsort(k)
        first, count = first[place], count[place].astype(np.int64)
        piece = pieces.value
        flat = [piece[i] for i in ids.tolist()]
        text_of = [b"".join(flat[s:s + n]) for s, n in zip(first.tolist(), count.tolist())]
        values, ends, texts = [], [np.zeros(1, np.int64)], []
        for packed in coded.column("packed"):
            lengths, codes = unpack(packed.as_py())
            n = count[codes]
            upto = np.cumsum(n)
            values.append(ids[np.repeat(first[codes] - (upto - n), n) + np.arange(n.sum())].astype(np.int32))
            edges = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)))
            ends.append(ends[-1][-1] + np.concatenate((np.zeros(1, np.int64), upto))[edges[1:]])
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                texts.append(b"".join([text_of[c] for c in codes[s:e].tolist()]).decode("utf-8", "replace"))
        ids_of = pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int32), *values])))
        doc_ids = pa.chunked_array([c.flatten() for c in coded.column("doc_ids").chunks], coded.schema.field("doc_ids").type.value_type).combine_chunks()
        return pa.table({"doc_id": doc_ids, "ids": ids_of, "decoded": pa.array(texts, pa.string())})
    return run
