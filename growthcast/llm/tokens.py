"""Byte-level BPE tokens: pre-tokens, single-token strings and counts.

The counter takes most pre-tokens without merging: ``single_tokens`` proves
offline which vocabulary strings encode alone as one token, and a pre-token
found there counts one. Only the rest is merged, each distinct one once per
task (up to ``CACHE`` kept).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

#: The pre-token pattern of byte-level BPE files with ``use_regex``.
PRETOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
            r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Merged pre-tokens that a task keeps at most.
CACHE = 500_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_letters() -> list[str]:
    """Letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Splitter:
    """Splits a text as the tokenizer does: first at its added tokens, then into pre-tokens."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.find = regex.compile(PRETOKEN).findall
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in longest_first) + ")").split if self.added else None

    def __call__(self, text: str) -> list[str]:
        if self.cut is None or not any(t in text for t in self.added):
            return self.find(text)
        out: list[str] = []
        for part in self.cut(text):
            out += [part] if part in self.added else self.find(part)
        return out

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        if word in self.added:
            return [self.added[word]]
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]


def single_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that, as a whole pre-token, encode to that one token alone.

    A string qualifies if it is valid UTF-8, the splitter leaves it whole, and
    merging its bytes ends in its own id.
    """
    split = Splitter(path)
    bytes_of = {c: b for b, c in split.letters.items()}
    proven = set()
    for piece, i in split.tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            word = bytes(bytes_of[c] for c in piece).decode()
        except (UnicodeDecodeError, KeyError):
            continue
        if split(word) == [word] and split.merge(word) == [i]:
            proven.add(word)
    return frozenset(proven | set(split.added))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row, in one pass without a shuffle.

    A null or empty text has no bytes and no tokens; ids may be null or
    repeat; a very long text is counted whole; extra columns are not read.
    The broadcast set is as large as the vocabulary file at most.
    """
    path = path or tokenizer_path()
    spark: SparkSession = docs.sparkSession
    single = spark.sparkContext.broadcast(single_tokens(path))

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        split, whole = Splitter(path), single.value
        cost = _Costs(split, whole)
        for texts in batches:
            out = []
            for text in texts:
                out.append(sum(map(cost.__getitem__, split(text))) if text else 0)
                cost.trim()
            yield pd.Series(out, dtype="int64")

    counted = F.pandas_udf(count, "long")
    text = F.col(text_col)
    return (docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
                        counted(text).alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))


class _Costs(dict):
    """Tokens of a pre-token: one if it is proven single, else as many as merging gives."""

    def __init__(self, split: Splitter, single: frozenset[str]):
        super().__init__(dict.fromkeys(single, 1))
        self.split, self.single = split, single

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.split.merge(word))
        return n

    def trim(self) -> None:
        if len(self) > CACHE + len(self.single):
            self.clear()
            self.update(dict.fromkeys(self.single, 1))
