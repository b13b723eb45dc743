"""Networks: gradients, held-out accuracy, and scores that depend on the text alone."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanelytics.llm import language, toxicity
from lanelytics.llm.common import WordTable, held_out, table
from tests.llm.conftest import EDGE_ROWS

BIG = "/root/testdata/sf0.1"


def test_held_out_ids(spark):
    from zlib import crc32

    ids = [None, 0, 1, -5, 123456789012]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(held_out()).collect()]
    assert got == [False, *(crc32(str(i).encode()) % 4 == 2 for i in ids[1:])]


def test_word_table_forgets_and_computes_again():
    calls = []
    kept = WordTable(lambda words: calls.append(len(words)) or np.array([[len(w), 1] for w in words], np.float32), limit=4)
    for texts in ([["a", "bb"], []], [["a", "ccc", "dddd"]], [["eeeee", "a"]], [["f" * n for n in range(1, 9)]]):
        for text, rows in zip(texts, kept.rows_of(texts)):
            assert rows[:, 0].tolist() == [len(w) for w in text] if text else len(rows) == 0
    assert calls == [2, 2, 2, 8]


def test_gradients_through_time():
    network = language.Network.fresh(["a", "b", "c"], hidden=3, seed=1)
    for parameter in network.parameters():
        parameter *= 2
    values = [p.astype(np.float64) for p in network.parameters()]
    network.forward.of_byte, network.forward.of_state, network.reverse.of_byte, network.reverse.of_state, network.out, network.bias = values
    data, labels = np.array([list(b"word"), list(b"tree")], np.uint8), np.array([0, 2])
    _, gradients = network.gradients(data, labels)
    random = np.random.default_rng(0)
    for value, gradient in zip(values, gradients):
        cells = [tuple(c) for c in np.argwhere(np.abs(gradient) > 1e-7)]
        for cell in random.permutation(len(cells))[:12]:
            cell, step = cells[cell], 1e-5
            before = value[cell]
            value[cell] = before + step
            up = network.gradients(data, labels)[0]
            value[cell] = before - step
            down = network.gradients(data, labels)[0]
            value[cell] = before
            assert gradient[cell] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=2e-5)


def test_sequences_cover_all_letters():
    text = "Ab1c_d " + "é" * 200 + " 漢字!"
    assert "".join(language.sequences(text)) == "abcd" + "é" * 200 + "漢字"
    assert max(map(len, language.sequences(text))) == language.LONGEST
    assert not language.has_letter("12 ² -_!") and language.has_letter("1x")


def test_marks_belong_to_their_letters():
    assert language.sequences("हिन्दी में, e\u0301te\u0301 می\u200cخواهم") == ["हिन्दी", "में", "e\u0301te\u0301", "می\u200cخواهم"]
    assert language.sequences("\u0301 12 \u0301") == []


def one_by_one(network, sequence):
    """Probabilities of each byte by plain loops over bytes, gates and states."""
    size = len(network.forward.of_state)
    squash = lambda x: 1 / (1 + math.exp(-x))

    def states(direction, data):
        state, result = [0.0] * size, []
        for byte in data:
            given = direction.of_byte[byte].tolist()
            pushed = [sum(state[i] * float(direction.of_state[i, j]) for i in range(size)) for j in range(3 * size)]
            update = [squash(given[j] + pushed[j]) for j in range(size)]
            reset = [squash(given[size + j] + pushed[size + j]) for j in range(size)]
            candidate = [math.tanh(given[2 * size + j] + reset[j] * pushed[2 * size + j]) for j in range(size)]
            state = [update[j] * state[j] + (1 - update[j]) * candidate[j] for j in range(size)]
            result.append(state)
        return result

    data, shares = sequence.encode(), []
    for ahead, back in zip(states(network.forward, data), reversed(states(network.reverse, data[::-1]))):
        powers = [math.exp(sum(x * float(network.out[i, c]) for i, x in enumerate(ahead + back)) + float(network.bias[c])) for c in range(len(network.languages))]
        shares.append([p / sum(powers) for p in powers])
    return shares


def test_labels_equal_plain_ones():
    network = language.Network.fresh(["a", "b", "c"], hidden=3, seed=4)
    texts = ["one two two हिन्दी", "", "12 !", "l'été " * 5 + "x" * 100, "two one"]
    got = language.Labeller(network).label(texts)
    for text, (name, score) in zip(texts, got):
        shares = [share for sequence in language.sequences(text) for share in one_by_one(network, sequence)]
        if not shares:
            assert (name, score) == ("und", 0.0)
            continue
        means = [sum(s[c] for s in shares) / len(shares) for c in range(3)]
        assert name == "abc"[means.index(max(means))] and abs(score - max(means)) < 1e-5


def test_language_is_learned_from_whole_texts(spark):
    rows = [(n, " ".join(f"{c}{chr(97 + k % 26)}" for k, c in enumerate("abcdefghij" * 40)) + " last", "en") for n in range(40)]
    rows += [(5, rows[5][1], "en")] * 30 + [(50, None, "en"), (51, "alone", None), (None, "no id", "en"), (52, "short text", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    sample = language.language_sample(docs, runs=100)
    taught = [n for n in range(40) if zlib.crc32(str(n).encode()) % 4 != 2]
    assert len([1 for _, lang in sample if lang == "en"]) <= len(taught) + 1 and sample == language.language_sample(docs.repartition(3), runs=100)
    drawn = [text.split() for text, lang in sample if lang == "en"]
    assert all(len(words) == 100 for words in drawn) and any("last" in words for words in drawn)
    assert [text for text, lang in sample if lang == "de"] == ["short text"] * (zlib.crc32(b"52") % 4 != 2)


def test_language_of_held_out_documents(spark):
    docs = table(spark, BIG, "documents")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, total, low, high = got.select(
        F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*"), F.min("score"), F.max("score")
    ).first()
    assert total > 2000 and right / total > 0.98 and low >= 0 and high <= 1


def test_toxicity_of_held_out_documents(spark):
    docs, labels = table(spark, BIG, "documents"), table(spark, BIG, "labels")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out")
    hits, called, toxic = got.select(
        F.sum(F.col("predicted") * F.col("toxic")), F.sum("predicted"), F.sum("toxic")
    ).first()
    assert hits / toxic > 0.85 and hits / called > 0.85


def test_thresholds_lie_in_the_gap():
    assert toxicity.best_threshold(np.array([3.0, 1.0, 2.0, -4.0]), np.array([1, 0, 1, 0])) == 1.5
    assert toxicity.best_threshold(np.array([1.0, 1.0]), np.array([1, 0])) is not None
    assert toxicity.best_threshold(np.array([1.0]), np.array([1])) is None
    assert toxicity.best_threshold(np.array([]), np.array([])) is None


def test_inflected_forms_share_a_beginning():
    assert set(toxicity.buckets("loweischaft")) & set(toxicity.buckets("loweiung")) - {0}
    assert toxicity.buckets("") == [0] * 4


def labels_for(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_edge_documents_are_scored(spark, make_docs, monkeypatch):
    monkeypatch.setattr(toxicity, "LOOKS", 3000)
    docs = make_docs(*EDGE_ROWS, *((100 + n, f"you are {'vile scum' if n % 2 else 'kind folk'} number {n}", "en") for n in range(80)))
    labels = labels_for(spark, *((100 + n, 1, n % 2) for n in range(80)), (None, 1, 1), (1, None, None), (101, 0, 1))
    scored = toxicity.toxicity(docs, labels)
    got = scored.collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2]["score"] == by_id[3]["score"] == by_id[4]["score"]
    assert sum(by_id[100 + n]["predicted"] == n % 2 for n in range(80)) > 70
    kept = toxicity.without_toxic(docs, labels)
    assert kept.schema == docs.schema
    assert kept.count() == len(got) - sum(r["predicted"] for r in got)
    named = language.identify(docs).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in named if r["doc_id"] in (2, 3, 4)} == {2: "und", 3: "und", 4: "und"}
    assert len(named) == docs.count() and {r["lang_pred"] for r in named} <= {"en", "fr", "und"}


def test_nothing_to_learn_from(spark, make_docs):
    docs = make_docs((1, "one two", None), (2, "three", None))
    assert {r["score"] for r in toxicity.toxicity(docs, labels_for(spark, (1, 1, 0))).collect()} == {0.0}
    assert {(r["lang_pred"], r["score"]) for r in language.identify(docs).collect()} == {("und", 0.0)}
    empty = make_docs()
    assert toxicity.toxicity(empty, labels_for(spark)).count() == language.identify(empty).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.labelled_sample(docs, labels) == toxicity.labelled_sample(docs, flipped)


def test_all_labelled_documents_are_learned_from(spark, make_docs, monkeypatch):
    """Insults and thresholds that a small start does not hold, and the same network however rows are split."""
    monkeypatch.setattr(toxicity, "LOOKS", 400)
    monkeypatch.setattr(toxicity, "LESSON", 150, raising=False)
    small = toxicity.labelled_sample
    monkeypatch.setattr(toxicity, "labelled_sample", lambda docs, labels: small(docs, labels, 12))
    insults = [f"{a}{b}" for a in "bdfg" for b in ("ork", "ulge", "irt", "aff", "ench", "oam")]
    praise = [f"{a}{b}" for a in "klmn" for b in ("ind", "air", "oft", "ice", "eat", "ure")]
    texts = {n: f"you are {(insults if n % 2 else praise)[n // 2 % 24] * 3} said number {n}" for n in range(900)}
    docs = make_docs(*((n, text, "en" if n % 3 else "de") for n, text in texts.items()), (1, "a second text", "en"))
    labels = labels_for(spark, *((n, 1, n % 2) for n in range(900)))
    scored = toxicity.toxicity(docs, labels)
    got = {r["doc_id"]: r["score"] for r in scored.filter("held_out").collect()}
    right = sum((score >= 0.3) == bool(n % 2) for n, score in got.items())
    assert len(got) > 150 and right / len(got) > 0.75  # 0.62 from the start alone, 0.85 from all
    again = toxicity.toxicity(docs.repartition(5), labels.repartition(3)).filter("held_out").collect()
    assert {r["doc_id"]: r["score"] for r in again} == got

    begun = toxicity.start(toxicity.labelled_sample(docs, labels))
    changes = toxicity.learned(docs, labels, begun)
    taught = [n for n in texts if zlib.crc32(str(n).encode()) % 4 != 2]
    words = sum(sum(changes[v].to_pylist()[k] for v in toxicity.VALUES) for k, part in enumerate(changes["part"].to_pylist()) if part == toxicity.WORDS)
    all_texts = [texts[n].split() for n in taught if n != 1]
    assert words in (sum(map(len, all_texts)) + extra for extra in (3, len(texts[1].split())))
    back = toxicity.counted(docs, labels, toxicity.merged(begun[0], changes))
    held = toxicity.labelled(docs, labels).filter("back")
    assert (sum(back["n"].to_pylist()), sum(back["hits"].to_pylist())) == held.select(F.count("*"), F.sum("toxic")).first()


def test_the_driver_neither_learns_nor_holds_texts(spark, make_docs, monkeypatch):
    """The start is learned in a task, from the same sample and to the same bits."""
    monkeypatch.setattr(toxicity, "SAMPLE", 12)
    docs = make_docs(*((n, f"you are {'vile scum' if n % 2 else 'kind folk'} number {n}", "en") for n in range(60)))
    labels = labels_for(spark, *((n, 1, n % 2) for n in range(60)))
    sample = toxicity.labelled_sample(docs, labels)
    assert len(sample) == 24 and sum(toxic for *_, toxic in sample) == 12
    network, shares = toxicity.start(sample)

    def learned_here(*_):
        raise AssertionError("learned in the driver")

    for name in ("_learn", "labelled_sample"):
        monkeypatch.setattr(toxicity, name, learned_here)
    begun, squares = toxicity.begin(docs, labels)
    assert all((a == b).all() for a, b in zip([network.embedding, *shares], [begun.embedding, *squares]))
    assert toxicity.begin(docs.filter("false"), labels) is None and toxicity.begin(docs, labels.filter("toxic = 1")) is None
    right = [(r["predicted"] == r["doc_id"] % 2) for r in toxicity.toxicity(docs, labels).collect()]
    assert sum(right) > 50


def test_thresholds_of_counted_ranges_equal_those_of_single_logits():
    random = np.random.default_rng(3)
    labels = random.integers(0, 2, 300)
    logits = np.round(random.normal(0, 1, 300) + labels, 2)
    values = np.unique(logits)
    n = np.array([(logits == v).sum() for v in values])
    hits = np.array([labels[logits == v].sum() for v in values])
    assert toxicity.best_of_counts(values, values, n, hits) == toxicity.best_threshold(logits, labels)
    f1 = lambda t: 2 * labels[logits > t].sum() / ((logits > t).sum() + labels.sum())
    assert f1(toxicity.best_threshold(logits, labels)) == max(f1(v - 0.001) for v in values)
