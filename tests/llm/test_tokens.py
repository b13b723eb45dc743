"""Encoding, counting and packing against the tokenizer libraries on whole texts."""

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import example, given, settings, strategies as st
from tokenizers import Tokenizer

from lanelytics.llm import byte_bpe, packing, token_counts
from lanelytics.llm.encoding import json_encoder, json_tokenizer, rank_encoder, rank_encoding
from lanelytics.llm.queries import BYTE_JSON, BYTE_RANKS, MULTI_RANKS, PATTERN, WORD_JSON
from tests.llm.conftest import EDGE_ROWS, PROSE

TEXTS = st.text(alphabet=st.sampled_from(list("ab'st 1\n\t\r.é漢 \x1c<|>")) | st.characters(exclude_categories=["Cs"]), max_size=60)


@pytest.fixture(scope="module")
def library():
    return rank_encoding(MULTI_RANKS, PATTERN)


def expected_digest(library, text):
    ids = library.encode_ordinary(text or "")
    packed = struct.pack(f"<{len(ids)}I", *ids)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_cached_words_give_the_ids_of_the_library(text):
    ids = rank_encoding(MULTI_RANKS, PATTERN).encode_ordinary(text)
    assert rank_encoder(MULTI_RANKS, PATTERN)(text) == struct.pack(f"<{len(ids)}I", *ids)
    ids = json_tokenizer(BYTE_JSON).encode(text, add_special_tokens=False).ids
    assert json_encoder(BYTE_JSON, BYTE_RANKS, PATTERN)(text) == struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_every_prefix_count_is_the_library_s(text):
    counter = token_counts.prefix_counter(WORD_JSON)
    words = counter.words(text)
    counter.learn(words)
    assert counter.prefix_counts(words)[-1] == counter.count(text)


@settings(max_examples=200, deadline=None)
@given(TEXTS, TEXTS)
def test_a_safe_boundary_splits_a_text_without_a_trace(left, right):
    encoding, text = rank_encoding(MULTI_RANKS, PATTERN), left + right
    for end in byte_bpe.safe_boundaries(text, regex.compile(PATTERN), True):
        assert encoding.encode_ordinary(text[:end]) + encoding.encode_ordinary(text[end:]) == encoding.encode_ordinary(text)


def test_documents_are_encoded_whole(library, make_docs):
    got = byte_bpe.encode_documents(make_docs(*EDGE_ROWS), MULTI_RANKS, PATTERN).collect()
    wanted = Counter((row[0], *expected_digest(library, row[1])) for row in EDGE_ROWS)
    assert Counter(tuple(r) for r in got) == wanted


def test_tiny_chunks_give_the_same_ids(library, make_docs):
    texts = [PROSE * 4, "x" * 300, "  \n\n word   " * 30, "ab cd " * 50 + "y" * 100 + " ef gh" * 40, "é漢 " * 80]
    docs = make_docs(*enumerate(texts))
    got = byte_bpe.encode_documents(docs, MULTI_RANKS, PATTERN, chunk=40, overlap=24).collect()
    assert {tuple(r) for r in got} == {(n, *expected_digest(library, text)) for n, text in enumerate(texts)}


def test_pieces_hold_the_text_once(make_docs):
    text = PROSE * 20
    keyed = make_docs((1, text)).selectExpr("'k' AS text_key", "text")
    pieces = byte_bpe.chunk_pieces(keyed, PATTERN, chunk=100, overlap=50).orderBy("chunk").collect()
    assert len(pieces) > 10
    assert "".join(p["text"][p["begin"] : p["end"]] for p in pieces) == text


def test_counts_of_documents(make_docs):
    library = Tokenizer.from_file(WORD_JSON)
    got = token_counts.count_tokens(make_docs(*EDGE_ROWS), WORD_JSON).collect()
    count = lambda text: len(library.encode(text or "", add_special_tokens=False).ids)
    wanted = Counter((i, len((text or "").encode()), count(text), count(text) > 2048) for i, text, *_ in EDGE_ROWS)
    assert Counter(tuple(r)[:4] for r in got) == wanted
    texts = {i: text or "" for i, text, *_ in EDGE_ROWS}
    for row in got:
        text, end = texts[row["doc_id"]], row["fitting_chars"]
        assert count(text[:end]) <= 2048
        assert end == len(text) or count(text[:end] + text[end:].split()[0].join("  ")) > 2048


def test_prefix_tables_answer_questions(spark, make_docs):
    from pyspark.sql import functions as F

    library, text = Tokenizer.from_file(WORD_JSON), PROSE * 2
    table = token_counts.prefix_table(make_docs((1, text)), WORD_JSON)
    row = table.select("*", token_counts.tokens_up_to(F.lit(19)).alias("n"), token_counts.words_within(F.lit(9)).alias("end")).first()
    for end, count in zip(row["ends"], row["counts"]):
        assert len(library.encode(text[:end], add_special_tokens=False).ids) == count
    assert row["n"] == len(library.encode(text[:19], add_special_tokens=False).ids)
    assert len(library.encode(text[: row["end"]], add_special_tokens=False).ids) == 9


def test_packing_holds_every_token_once(make_docs):
    library = Tokenizer.from_file(BYTE_JSON)
    rows = [*EDGE_ROWS, *((100 + n, PROSE * (n % 90)) for n in range(120)), (900, "x " * 2047), (901, "x " * 2048)]
    got = packing.pack_documents(make_docs(*rows), BYTE_JSON, BYTE_RANKS, PATTERN).toPandas()
    by_text = Counter()
    for i, text, *_ in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        first = (len(ids) % 2048 or 2048) if len(ids) > 2048 else len(ids)
        for piece, begin in enumerate([0, *range(first, len(ids), 2048)]):
            end = first if piece == 0 else begin + 2048
            by_text[i, piece, begin, end - begin, zlib.crc32(ids[begin:end].tobytes())] += 1
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    found = Counter((None if np.isnan(i) else int(i), *rest) for i, *rest in got[names].itertuples(index=False))
    assert found == by_text
    placed = got.sort_values(["sequence_id", "offset"])
    before = placed.groupby("sequence_id")["length"].cumsum() - placed["length"]
    assert (before == placed["offset"]).all()
    assert placed.groupby("sequence_id")["length"].sum().max() <= 2048


def test_partitions_with_gaps_exchange(monkeypatch, make_docs):
    monkeypatch.setattr(packing, "PARTITION", 8)
    rows = [(n, "x " * (600 + 37 * n % 700)) for n in range(160)]
    rounds = packing.pack_rounds(make_docs(*rows), BYTE_JSON, BYTE_RANKS, PATTERN)
    assert len(rounds) > 1
    got = packing.pack_documents(make_docs(*rows), BYTE_JSON, BYTE_RANKS, PATTERN).toPandas()
    assert sorted(got["doc_id"]) == list(range(160))
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id")["length"].cumsum() - placed["length"] == placed["offset"]).all()
    alone = rounds[0].filter("bin >= 0 or bin < 0").selectExpr("part", "bin").distinct().count()
    assert got["sequence_id"].nunique() <= alone


def test_certified_bounds():
    random = np.random.default_rng(1)
    for _ in range(50):
        lengths = random.integers(1, 101, random.integers(1, 60))
        bins, offsets, fills = packing.best_fit_decreasing(lengths, 100)
        assert fills.max() <= 100 and fills.sum() == lengths.sum()
        assert packing.lower_bound(lengths, 100) <= len(fills)
    assert packing.lower_bound(np.array([51] * 7), 100) == 7
    assert packing.lower_bound(np.array([34] * 9), 100) == 5  # two fit into a bin, by volume it would be four
    assert packing.lower_bound(np.array([], int), 100) == 0


def test_no_documents(make_docs):
    empty = make_docs()
    assert byte_bpe.encode_documents(empty, MULTI_RANKS, PATTERN).count() == 0
    assert token_counts.count_tokens(empty, WORD_JSON).count() == 0
    assert packing.pack_documents(empty, BYTE_JSON, BYTE_RANKS, PATTERN).count() == 0


def test_vocabularies_stay_outside_the_repository():
    assert all(not p.startswith("/root/repo") for p in (BYTE_JSON, BYTE_RANKS, MULTI_RANKS, WORD_JSON))
    assert public_tokenizers.PATTERN == PATTERN and isinstance(rank_encoding(BYTE_RANKS, PATTERN), tiktoken.Encoding)


UNSPACED = st.text(alphabet=st.sampled_from(list("ab'st1漢字é\u0301\u0327İ#<|>カ한\u1100\u1161\u11a8ไका\u09c7\u09be")), max_size=30)


@settings(max_examples=600, deadline=None)
@given(UNSPACED | TEXTS, st.integers(0, 12))
@example("\u1100\u11611", 0)
@example("\u1100\u1161\u11a81", 2)
@example("1\u1161\u11a8#\u0301\u0327b", 2)
def test_counts_inside_words(text, budget):
    counter = token_counts.prefix_counter(WORD_JSON)
    for word in counter.words(text):
        for end, tokens in counter.parts(word):
            assert counter.count(word[:end]) == tokens
        end = counter.part_within(word, budget)
        assert counter.count(word[:end]) <= budget


def test_texts_without_spaces_are_cut_inside(make_docs):
    library = Tokenizer.from_file(WORD_JSON)
    count = lambda text: len(library.encode(text, add_special_tokens=False).ids)
    texts = ["漢字を書く" * 2000, "x" * 70000, "Zm9vYmFy+/" * 2000, "Intro: " + "ไทย" * 5000, "if(a){b=1;}" * 1000]
    for row in token_counts.count_tokens(make_docs(*enumerate(texts)), WORD_JSON).collect():
        assert row["over_limit"] and 2040 < count(texts[row["doc_id"]][: row["fitting_chars"]]) <= 2048


def test_any_prefix_has_the_count_of_the_library(make_docs):
    from pyspark.sql import functions as F

    library = Tokenizer.from_file(WORD_JSON)
    texts = ["it's  l'été 漢字漢字 x1y2\n<|endoftext|>e\u0301#", "", " \x1c ab\x1fcd ", "漢字を書く" * 4]
    lengths = list(range(45)) + [None]
    docs = make_docs(*enumerate(texts)).withColumn("lengths", F.array(*map(F.lit, lengths)))
    for row in token_counts.prefix_tokens(docs, WORD_JSON).collect():
        wanted = [len(library.encode(texts[row["doc_id"]][: n or 0], add_special_tokens=False).ids) for n in lengths]
        assert row["counts"] == wanted
    table = token_counts.prefix_table(make_docs((0, "a1漢字b2")), WORD_JSON).first()
    assert table["ends"] == [0, 1, 2, 5, 6]
