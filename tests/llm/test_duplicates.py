"""Fingerprints, pivot tables and components against brute force."""

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from lanelytics.llm import simhash
from lanelytics.llm.components import components
from tests.llm.conftest import EDGE_ROWS, PROSE


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ")
    words = [w for w in words.replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def slow_components(fps, distance=4):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("AbÉé \t\n\x0b\x0c\r\x1c\xa0")), max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_in_blocks(monkeypatch):
    whole = simhash.fingerprint(PROSE * 9)
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    assert simhash.fingerprint(PROSE * 9) == whole == slow_fingerprint(PROSE * 9)


@pytest.fixture(scope="module")
def crowded():
    """Fingerprints in chains and clusters of up to a few bits, among unrelated ones."""
    random = np.random.default_rng(4)
    fps = list(random.integers(0, 1 << 63, 300, dtype=np.uint64))
    for centre in fps[:12]:
        for _ in range(25):
            centre = centre ^ np.uint64(sum(1 << int(b) for b in random.choice(64, random.integers(1, 7), replace=False)))
            fps.append(centre)
    return sorted({int(f) for f in fps} | {0, 3, (1 << 64) - 1})


def test_spanning_links_of_one_group(crowded):
    fps = np.array(crowded, np.uint64)
    fps = fps[np.argsort(np.bitwise_count(fps ^ simhash.pivots(1)[0]), kind="stable")]
    rows, roots = simhash.spanning_links(np.zeros(len(fps), int), fps)
    root = np.arange(len(fps))
    root[rows] = roots
    assert root.tolist() == slow_components([int(f) for f in fps])


@pytest.mark.parametrize("n, split", [(10, 8192), (10**6, 8192), (10**9, 8192), (10, 40)])
def test_links_through_any_choice_of_blocks(spark, crowded, monkeypatch, n, split):
    monkeypatch.setattr(simhash, "SPLIT", split)
    monkeypatch.setattr(simhash, "block_masks", lambda _, masks=simhash.block_masks(n): masks)
    frame = spark.createDataFrame([(simhash._signed(f),) for f in crowded], "fp long")
    linked = {r["node"]: r["root"] for r in components(simhash.fingerprint_links(frame)).collect()}
    expected = slow_components(crowded)
    groups = {}
    for fp, root in zip(crowded, expected):
        groups.setdefault(root, []).append(simhash._signed(fp))
    for members in groups.values():
        assert {linked.get(m, m) for m in members} == {min(members)}


def test_blocks_cover_every_pair():
    for n in (1, 10**6, 10**10):
        masks = simhash.block_masks(n)
        random = np.random.default_rng(0)
        for _ in range(200):
            difference = sum(1 << int(b) for b in random.choice(64, 4, replace=False))
            assert any(difference & mask == 0 for mask in masks)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, n) for n in range(101, 160)] + [(7, 7), (300, 299), (299, 300)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{n: 0 for n in range(41)}, **{n: 100 for n in range(100, 160)}, 299: 299, 300: 299}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(make_docs):
    rows = [*EDGE_ROWS, (20, PROSE * 30), (21, PROSE * 30 + "and more"), (22, (PROSE * 30).upper()), (None, PROSE * 30)]
    got = simhash.near_duplicates(make_docs(*rows)).collect()
    fps = [slow_fingerprint(text) for _, text, *_ in rows]
    expected = []
    root = slow_components(fps)
    for n, (doc_id, *_) in enumerate(rows):
        ids = [r[0] for r, other in zip(rows, root) if other == root[n] and r[0] is not None]
        expected.append((doc_id, f"{fps[n]:016x}", min(ids, default=None)))
    order = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, got), key=order) == sorted(expected, key=order)


def test_one_row_of_each_component(make_docs):
    docs = make_docs(*EDGE_ROWS, (20, PROSE * 30), (21, (PROSE * 30).upper()), (None, "no id  at all", "fr", "z"))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    roots = {tuple(r) for r in simhash.near_duplicates(docs).select("component_id", "fingerprint").collect()}
    groups = len({c for c, _ in roots if c is not None}) + len({f for c, f in roots if c is None})
    assert kept.count() == groups
    ids = {r["doc_id"] for r in kept.collect()}
    assert {1, 9} <= ids and not ids & {5, 20, 21}  # 9 repeats the words of 20


def test_no_documents(make_docs):
    assert simhash.near_duplicates(make_docs()).count() == 0
    assert simhash.one_of_each(make_docs()).count() == 0
