"""Periodic runs against brute force."""

import hashlib
import zlib

import pytest
from hypothesis import example, given, settings, strategies as st

from lanelytics.llm import queries, runs
from lanelytics.llm.common import table
from tests.llm.conftest import EDGE_ROWS, PROSE

WORDS = st.lists(st.integers(0, 3), max_size=40) | st.builds(
    lambda before, unit, times, cut: before + (unit * times)[: len(unit) * times - cut],
    st.lists(st.integers(0, 3), max_size=8),
    st.lists(st.integers(0, 3), min_size=1, max_size=5),
    st.integers(2, 9),
    st.integers(0, 4),
)


def slow_runs(words, least, exponent):
    found = set()
    for period in range(1, len(words) // 2 + 1):
        same = [words[i] == words[i + period] for i in range(len(words) - period)] + [False]
        start = 0
        for at, equal in enumerate(same):
            if equal:
                continue
            length = at + period - start
            if start < at and length >= max(least, exponent * period):
                smaller = (all(words[i] == words[i + p] for i in range(start, start + length - p)) for p in range(1, period))
                if not any(smaller):
                    found.add((start, length, period))
            start = at + 1
    return sorted(found)


@settings(max_examples=500, deadline=None)
@given(WORDS, st.sampled_from([(6, 4), (2, 2), (3, 3), (2, 6), (9, 2)]))
@example([0] * 6, (6, 4))
@example([0, 1] * 4 + [0], (6, 4))
def test_runs(words, limits):
    wanted = slow_runs(words, *limits)
    assert runs.sequence_runs(words, *limits) == wanted
    texts = [[b"x"] * 3, [b"%d" % w for w in words], [], [b"%d" % w for w in words]]
    assert [r for r in runs.texts_runs(texts, *limits)][1::2] == [wanted, wanted]


@settings(max_examples=200, deadline=None)
@given(WORDS)
def test_pieces_of_the_path_are_longest_common_suffixes(words):
    """The accessed pieces against all earlier ends: of those with one length, the last."""
    automaton = runs.LinkCutAutomaton()
    for at, word in enumerate(words):
        common = {}
        for last in range(at):
            size = 0
            while size <= last and words[last - size] == words[at - size]:
                size += 1
            if size >= at - last and not any(words[at - size + 1 : at + 1] == words[j - size + 1 : j + 1] for j in range(last + 1, at) if j >= size - 1):
                common[last] = size
        assert dict(automaton.append(word)) == common


def wanted_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = slow_runs(words, 6, 4)
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    rest = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{l},{p}\n" for s, l, p in found).encode()
    exponent = 1000 * best[1] // best[2] if found else None
    return doc_id, len(found), *best, exponent, hashlib.sha256(listed).hexdigest(), hashlib.sha256(rest).hexdigest()


def test_digests(make_docs):
    planted = next(n for n in range(100, 200) if zlib.crc32(str(n).encode()) % 10 == 0)
    rows = [row if len(row[1] or "") < 5000 else (row[0], row[1][:2500]) for row in EDGE_ROWS] + [
        (planted, PROSE * 2),
        (201, "a a a a a a b a b a b a b a\xa0b"),
        (202, "x\x0by\x0cx y x y x y " + PROSE + "x\ty\nx\ry x y x y"),
    ]
    got = runs.digests(make_docs(*rows)).collect()
    key = lambda row: tuple((value is not None, value) for value in row)
    assert sorted(map(tuple, got), key=key) == sorted((wanted_row(*row[:2]) for row in rows), key=key)


def test_long_text(make_docs):
    words = (PROSE * 3000).split()
    row = runs.periodic_runs(make_docs((1, " ".join(words)))).first()
    period = len(PROSE.split())
    assert [tuple(r) for r in row["runs"]] == [(0, len(words), period)]
    assert row["collapsed"].split() == words[:period] and row["n_words"] == len(words)


@pytest.mark.parametrize("size", ["sf0.001"])
def test_whole_table(spark, size):
    sf_dir = f"/root/testdata/{size}"
    docs = [r for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r) for r in queries.queries()["op11_periodic_runs"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    small = [r for r in docs if len(r["text"] or "") < 6000]
    assert len(small) > 100
    assert all(got[r["doc_id"]] == wanted_row(r["doc_id"], r["text"]) for r in small)
    assert sum(row[1] > 0 for row in got.values()) > len(got) / 20


def test_no_documents(make_docs):
    assert runs.digests(make_docs()).count() == 0
