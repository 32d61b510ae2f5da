"""Alignment of tokens against both libraries over whole texts."""

import hashlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from growthcast.llm import alignment as A
from growthcast.llm.bpe import piece_bytes
from growthcast.llm.tokens import tokenizer_path

ODD = [None, "", " ", "  ", "a", " a", "a ", "a  ", "\n", "\n ", " \n", "a\n b", "é漢😀x y", "a▁b c", "<|endoftext|> it's <s> <0x0A>", "\x1c x\x1f y",
       "tab\t tab  x　 y", "🤷🏽‍♀️ 🤷🏽‍♀️z", "﻿ x", "é ﬁ ①", "12 345  67   8", "word " * 3000, "x" * 5000]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    return a, b, piece_bytes(tokenizer_path())


def brute_groups(text, libraries):
    """(groups, links) of the libraries' ids of the whole text, by decoded bytes alone."""
    a, b, a_bytes = libraries
    if not text:
        return None
    data = (" " + text).encode()
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_parts = [a_bytes[i] for i in a_ids]
    b_parts = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    if b"".join(a_parts) != data or b"".join(b_parts) != data:
        return None
    ranges = lambda parts: [(sum(map(len, parts[:i])), sum(map(len, parts[:i + 1]))) for i in range(len(parts))]
    if len(data) > 3_000:  # running sums
        def ranges(parts):
            out, at = [], 0
            for p in parts:
                out.append((at, at := at + len(p)))
            return out
    ra, rb = ranges(a_parts), ranges(b_parts)
    cuts = sorted({e for _, e in ra} & {e for _, e in rb})
    groups, start = [], 0
    for cut in cuts:
        groups.append(([i for i, (s, e) in zip(a_ids, ra) if s >= start and e <= cut], [i for i, (s, e) in zip(b_ids, rb) if s >= start and e <= cut])
                      if len(cuts) < 2_000 else None)
        start = cut
    links, j0 = [], 0
    for i, (s, e) in zip(a_ids, ra):
        while rb[j0][1] <= s:
            j0 += 1
        j = j0
        while j < len(rb) and rb[j][0] < e:
            links.append((i, b_ids[j]))
            j += 1
    return groups, links, a_ids, b_ids


def text_of(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def brute(docs, libraries):
    found = [(i, brute_groups(t, libraries)) for i, t in docs]
    count = Counter(p for _, f in found if f for p in set(f[1]))
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links, a_ids, b_ids = f
        out.append((i, len(a_ids), len(b_ids), len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links),
                    None if groups[0] is None else hashlib.sha256(text_of(groups).encode()).hexdigest()))
    return out


def same(got, want):
    got, want = sorted(got, key=str), sorted(want, key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:7] == w[:7] and (w[7] is None or g[7] == w[7])


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_odd_texts_in_small_chunks(spark, libraries):
    docs = [(i % 9 if i % 4 else None, t) for i, t in enumerate(ODD * 2)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("chunk", F.lit("x")).withColumn("n_a", F.lit("y"))
    for chunk in (1, 20_000, A.CHUNK):
        out = A.alignment(frame.repartition(3), chunk=chunk)
        assert out.columns == COLUMNS
        same([tuple(r) for r in out.collect()], brute(docs, libraries))


def test_whole_table(spark, sf, libraries):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same([tuple(r) for r in A.alignment(docs).collect()], brute(rows, libraries))


def test_empty_table(spark):
    assert A.alignment(spark.createDataFrame([], "doc_id string, text string")).collect() == []


@cache
def shared_aligner():
    return A.Aligner(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


ALPHABET = st.sampled_from(list("abcXYZ019 '.,-\n\t é漢😀ß▁<|>") + ["  ", "the ", " of", " ", "　", "\x1d", "‍", "é"])


@settings(max_examples=300, deadline=None)
@given(text=st.lists(ALPHABET, max_size=40).map("".join))
def test_units_give_what_whole_texts_give(text, libraries):
    aligner = shared_aligner()
    want = brute_groups(text, libraries)
    units = aligner.units(text) if text else []
    found = aligner.align(units) if units else None
    if want is None:
        assert not text or found.bad.any()
        return
    groups, links, a_ids, b_ids = want
    assert b";".join(found.groups).decode() == text_of(groups)
    assert found.links.tolist() == [a << 32 | b for a, b in links]
    assert found.counts.sum(1).tolist() == [len(a_ids), len(b_ids), len(groups), len(links)]


def test_units_whose_bytes_differ_leave_the_others_alone():
    found = shared_aligner().align(["the", "a▁b", "é漢", "▁", "", "of"])
    assert found.bad.tolist() == [False, True, False, True, False, False]
    alone = [shared_aligner().align([u]) for u in ("the", "é漢", "", "of")]
    assert [g for g, b in zip(found.groups, found.bad) if not b] == [x.groups[0] for x in alone]
    assert found.links.tolist() == [k for x in alone for k in x.links.tolist()]


def test_spans_and_bytes():
    # a whole token, two parts of a character that share its span, a fallback byte without one, and another unit's token
    spans = np.array([(0, 2), (2, 5), (2, 5), (5, 5), (6, 8), (9, 9)])
    assert A.byte_ends(spans, np.array([2, 2, 1, 1, 2, 1]), np.array([0, 0, 0, 0, 6, 6])).tolist() == [2, 4, 5, 6, 8, 9]
    # a unit that begins with a token without a span
    assert A.byte_ends(np.array([(0, 1), (2, 2), (2, 4)]), np.array([1, 1, 2]), np.array([0, 1, 1])).tolist() == [1, 2, 4]
