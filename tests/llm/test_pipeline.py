"""The stages one after the other, and what each is to do on its own input."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline

from lanelytics.llm import quality, simhash, toxicity
from lanelytics.llm.common import table, written
from lanelytics.llm.queries import BYTE_JSON
from tests.llm.conftest import EDGE_ROWS, PROSE
from tests.llm.test_sql import slow_counts, slow_estimate


@pytest.fixture(autouse=True)
def short_training(monkeypatch):
    monkeypatch.setattr(toxicity, "LOOKS", 1500)


def test_stages(spark, sf_dir):
    docs = first = table(spark, sf_dir, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "packing"]
    before = docs.count()
    labels = table(spark, sf_dir, "labels")
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = written(stage(spark, docs, sf_dir), name)
        assert kept.columns == first.columns and 0 < kept.count() < before
        ids = {r[0] for r in kept.select("doc_id").collect()}
        if name == "toxicity":
            assert ids == {r[0] for r in toxicity.toxicity(docs, labels).filter("predicted = 0").select("doc_id").collect()}
        elif name == "quality_rules":
            assert ids == {r[0] for r in quality.quality_rules(docs).filter("kept").select("doc_id").collect()}
        else:
            assert ids == {r[0] for r in simhash.near_duplicates(docs).select("component_id").distinct().collect()}
        docs, before = kept, kept.count()
    packed = corpus_pipeline.STAGES[3][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == before
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.count() == packed.count() and set(whole.columns) == set(packed.columns)


def test_any_rows_pass_through(spark, make_docs, sf_dir):
    words = [(n, PROSE * 4 + " ".join(f"w{n}x{k}" for k in range(80)), None, None) for n in (40, 40, None)]
    docs = make_docs(*EDGE_ROWS, *words)
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, docs, sf_dir)
        assert kept.schema == docs.schema
        docs = written(kept, name)
    assert docs.count() > 0
    corpus_pipeline.STAGES[3][1](spark, docs, sf_dir).collect()
    empty = make_docs()
    for _, stage in corpus_pipeline.STAGES:
        empty_result = stage(spark, empty, sf_dir)
        assert empty_result.count() == 0


VOCABULARY = [a + b + c for a in ("ba", "de", "ki", "lo", "mu") for b in ("ran", "sel", "tim", "von") for c in ("", "a", "ist", "erung")]


def planted():
    """(doc_id, text, lang, source, n_chars) and (doc_id, quality, toxic): clean, toxic, poor and copied documents."""
    draw = random.Random(11)
    text = lambda n: "\n".join(" ".join(draw.choices(VOCABULARY, k=10)) for _ in range(n))
    clean = {n: text(draw.randrange(8, 40)) for n in range(90)}
    toxic = {n: re.sub(r"\b(ba|mu)\w+", lambda m: draw.choice(["zorgak", "vexhul", m[0]]), text(15)) for n in range(100, 150)}
    poor = {150: "too short", 151: "same words again " * 30, 152: "", 153: None}
    poor |= {n: " ".join(w + "###" for w in clean[n - 160].split()) for n in range(160, 164)}
    copies = {200: clean[3], 201: clean[3], 202: clean[3] + " ", 203: clean[9].upper(), 204: clean[60].replace("\n", " "), 2: clean[80]}
    long = {300: text(900), 301: text(260)}
    texts = clean | toxic | poor | copies | long
    docs = [(n, t, "en", "s", len(t or "")) for n, t in sorted(texts.items())]
    return docs, [(n, 1, int(n in toxic)) for n in texts if n not in poor], set(toxic)


def plain_kept(rows):
    """Rows that pass the base rules and lie near the estimate of their group, here a single one."""
    passed, vectors = [], []
    for row in rows:
        n, chars, symbols, lines, repeats = slow_counts(row[1]) if len(row[1] or "") < 20_000 else quick_counts(row[1])
        if n < 50 or 100 * repeats > 50 * n:
            continue
        n_lines = sum(bool(line.split()) for line in row[1].split("\n"))
        passed.append(row)
        vectors.append([round(1000 * x) for x in (np.log(chars / n), (symbols / chars) ** 0.5, (lines / n_lines) ** 0.5, (repeats / n) ** 0.5)])
    return [row for row, away in zip(passed, slow_estimate(vectors)) if away <= quality.CUTOFF]


def quick_counts(text):
    words, lines = text.split(), text.split("\n")
    windows = list(zip(words, words[1:], words[2:]))
    times = {}
    for window in windows:
        times[window] = times.get(window, 0) + 1
    covered = {i + k for i, window in enumerate(windows) if times[window] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def plain_groups(rows):
    """Smallest id reachable over links of at most four differing bits, by comparing all pairs until nothing changes."""
    prints, smallest = {}, {r[0]: r[0] for r in rows}
    for doc_id, text, *_ in rows:
        words = text.lower().split()
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), seed=42) for i in range(max(1, len(words) - 3))]
        prints[doc_id] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    before = None
    while before != smallest:
        before = dict(smallest)
        smallest = {a: min(before[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 4) for a in prints}
    return smallest


def test_run_equals_plain_python(spark, tmp_path):
    docs, labels, toxic = planted()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = plain_kept([row for row in docs if row[0] not in toxic])
    groups = plain_groups(kept)
    texts = {row[0]: row[1] for row in kept if groups[row[0]] == row[0]}
    assert not {150, 151, 152, 153, 160, 161, 162, 163, 200, 201, 202} & set(texts) and len(texts) > 80

    tokenizer = Tokenizer.from_file(BYTE_JSON)
    ids = {n: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for n, t in texts.items()}
    pieces, filled = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for doc_id, own in pieces.items():
        ends = np.cumsum([length for _, _, length in sorted(own)])
        assert [n for n, _, _ in sorted(own)] == list(range(len(own))) and ends[-1] == len(ids[doc_id])
        assert [start for _, start, _ in sorted(own)] == [0, *ends[:-1]] and all(length == 2048 for _, _, length in sorted(own)[1:])
    for own in filled.values():
        ends = np.cumsum([length for _, length in sorted(own)])
        assert [offset for offset, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 2048

    free = []  # first-fit decreasing
    for length in sorted((length for own in pieces.values() for _, _, length in own), reverse=True):
        place = next((n for n, room in enumerate(free) if room >= length), None)
        if place is None:
            free.append(2048 - length)
        else:
            free[place] -= length
    assert len(filled) <= len(free)
