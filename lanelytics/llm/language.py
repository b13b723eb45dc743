"""Language of documents from a bidirectional gated recurrent network over bytes.

The sequences are the runs of letters, with the marks and joiners on them, in
a lower-cased text, as UTF-8 bytes; very long ones are cut.  The network labels
every byte with probabilities of the learned languages, and a document has the
mean of those of its bytes; what lies between runs has no part in it.  Training
is backpropagation through time in numpy, on at most ``RUNS`` runs drawn from
the whole texts of at most ``PARTS * PART`` documents of each language.  A run's
summed probabilities do not depend on its document, so they are kept.

Null texts and texts without a letter get ``und`` and score 0; so does every
text when nothing can be learned.  Ties go to the language that sorts first.
Every row is labelled, repeated and null ids too; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lanelytics.llm.common import WordTable, batch_of, held_out, rows, stored, whole_text

#: Parts by hash into which a language's documents are cut, documents learned from in each, and runs drawn from each of those.
PARTS, PART, RUNS = 64, 8, 64
HIDDEN, LONGEST = 16, 48
STEPS, BATCH, RATE = 700, 128, 0.01
UNKNOWN = "und"
#: Signs that belong to the letter before them: combining marks and the two joiners.
MARKS = "".join(chr(n) for n in range(sys.maxunicode + 1) if unicodedata.category(chr(n))[0] == "M") + "\u200c\u200d"
LETTERS = re.compile(rf"[^\W\d_]+(?:[{MARKS}]+[^\W\d_]*)*")


def sequences(text: str) -> list[str]:
    """Runs of letters and their marks, of at most ``LONGEST`` code points."""
    runs = LETTERS.findall(text.lower())
    if max(map(len, runs), default=0) <= LONGEST:
        return runs
    return [run[at : at + LONGEST] for run in runs for at in range(0, len(run), LONGEST)]


def has_letter(text: str) -> bool:
    return any(character.isalpha() for character in text)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """One direction of the recurrence: update and reset gates and candidate state from byte and state."""

    def __init__(self, random: np.random.Generator, hidden: int):
        self.of_byte = random.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.of_state = random.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)

    def forward(self, data: np.ndarray) -> tuple[np.ndarray, list]:
        """States (time, batch, hidden) of bytes (batch, time), and what the way back needs."""
        size = len(self.of_state)
        state = np.zeros((len(data), size), np.float32)
        states, kept = [], []
        for t in range(data.shape[1]):
            given, pushed = self.of_byte[data[:, t]], state @ self.of_state
            gates = _sigmoid(given[:, : 2 * size] + pushed[:, : 2 * size])
            update, reset = gates[:, :size], gates[:, size:]
            candidate = np.tanh(given[:, 2 * size :] + reset * pushed[:, 2 * size :])
            kept.append((state, update, reset, candidate, pushed[:, 2 * size :]))
            state = candidate + update * (state - candidate)
            states.append(state)
        return np.array(states), kept

    def backward(self, data: np.ndarray, kept: list, slopes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of both tables from those of the states, by backpropagation through time."""
        size = len(self.of_state)
        of_byte, of_state = np.zeros_like(self.of_byte), np.zeros_like(self.of_state)
        carried = np.zeros_like(slopes[0])
        for t in range(data.shape[1] - 1, -1, -1):
            before, update, reset, candidate, pushed = kept[t]
            slope = slopes[t] + carried
            at_candidate = slope * (1 - update) * (1 - candidate**2)
            at_update = slope * (before - candidate) * update * (1 - update)
            at_reset = at_candidate * pushed * reset * (1 - reset)
            given = np.concatenate([at_update, at_reset, at_candidate], axis=1)
            through = np.concatenate([at_update, at_reset, at_candidate * reset], axis=1)
            of_state += before.T @ through
            carried = slope * update + through @ self.of_state.T
            np.add.at(of_byte, data[:, t], given)
        return of_byte, of_state


@dataclass
class Network:
    languages: list[str]
    forward: Direction
    reverse: Direction
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 3) -> Network:
        random = np.random.default_rng(seed)
        out = random.normal(0, 0.2, (2 * hidden, len(languages))).astype(np.float32)
        directions = Direction(random, hidden), Direction(random, hidden)
        return cls(languages, *directions, out, np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.forward.of_byte, self.forward.of_state, self.reverse.of_byte, self.reverse.of_state, self.out, self.bias]

    def label(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Probabilities (time, batch, languages) of every byte of equally long sequences."""
        ahead, kept_ahead = self.forward.forward(data)
        back, kept_back = self.reverse.forward(data[:, ::-1])
        states = np.concatenate([ahead, back[::-1]], axis=2)
        logits = states @ self.out + self.bias
        shares = np.exp(logits - logits.max(2, keepdims=True))
        return shares / shares.sum(2, keepdims=True), states, (kept_ahead, kept_back)

    def gradients(self, data: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all bytes, each labelled like its sequence, and its gradients."""
        shares, states, (kept_ahead, kept_back) = self.label(data)
        batch = np.arange(len(data))
        loss = float(-np.log(shares[:, batch, labels] + 1e-12).mean())
        slope = shares.copy()
        slope[:, batch, labels] -= 1
        slope /= data.size
        hidden = len(self.forward.of_state)
        flat = slope.reshape(-1, slope.shape[2])
        at_states = slope @ self.out.T
        ahead = self.forward.backward(data, kept_ahead, at_states[:, :, :hidden])
        back = self.reverse.backward(data[:, ::-1], kept_back, at_states[::-1, :, hidden:])
        return loss, [*ahead, *back, states.reshape(-1, 2 * hidden).T @ flat, flat.sum(0)]

    def word_sums(self, words: list[str]) -> np.ndarray:
        """For each sequence the sums of its bytes' probabilities, and the number of bytes."""
        encoded = [word.encode() for word in words]
        result = np.zeros((len(words), len(self.languages) + 1), np.float32)
        lengths = np.array([len(x) for x in encoded])
        for length in np.unique(lengths):
            where = np.flatnonzero(lengths == length)
            for begin in range(0, len(where), 4096):
                part = where[begin : begin + 4096]
                data = np.frombuffer(b"".join([encoded[n] for n in part]), np.uint8).reshape(-1, length)
                result[part, :-1] = self.label(data)[0].sum(0)
                result[part, -1] = length
        return result


def train(sample: list[tuple[str, str]], steps: int = STEPS) -> Network | None:
    """From (text, language) rows, by Adam on batches of equally long sequences."""
    languages = sorted({lang for _, lang in sample})
    by_length: dict[int, list[tuple[bytes, int]]] = {}
    for text, lang in sample:
        for run in sequences(text):
            by_length.setdefault(len(run.encode()), []).append((run.encode(), languages.index(lang)))
    if not by_length:
        return None
    network = Network.fresh(languages)
    random = np.random.default_rng(5)
    lengths = np.array(sorted(by_length))
    weights = np.array([len(by_length[n]) for n in lengths], float)
    values = network.parameters()
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1):
        known = by_length[int(random.choice(lengths, p=weights / weights.sum()))]
        chosen = [known[n] for n in random.integers(0, len(known), BATCH)]
        data = np.frombuffer(b"".join(x for x, _ in chosen), np.uint8).reshape(len(chosen), -1)
        _, gradients = network.gradients(data, np.array([y for _, y in chosen]))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for value, gradient, m, v in zip(values, gradients, first, second):
            m += 0.1 * (gradient - m)
            v += 0.001 * (gradient**2 - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return network


class Labeller:
    def __init__(self, network: Network):
        self.network, self.table = network, WordTable(network.word_sums)

    def label(self, texts: list[str]) -> list[tuple[str, float]]:
        split_texts = [sequences(text) if has_letter(text) else [] for text in texts]
        results = []
        for sums in self.table.rows_of(split_texts):
            shares = sums.sum(0, dtype=np.float64)
            best = int(shares[:-1].argmax()) if len(sums) else 0
            results.append((self.network.languages[best], min(1.0, float(shares[best] / shares[-1]))) if len(sums) else (UNKNOWN, 0.0))
        return results


def _draw(runs: int):
    schema = pa.schema([("lang", pa.string()), ("place", pa.int64()), ("text", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows(batches):
            drawn = []
            for place, text in zip(part["place"], part["text"]):
                found = sequences(text)
                if len(found) > runs:
                    at = np.random.default_rng(place % 2**64).choice(len(found), runs, replace=False)
                    found = [found[n] for n in sorted(at)]
                drawn.append(" ".join(found))
            yield batch_of(schema, part["lang"], part["place"], drawn)

    return run


def language_sample(docs: DataFrame, runs: int = RUNS) -> list[tuple[str, str]]:
    """(runs, lang) of documents that may be learned from: in each part of a language those first by hash.

    Only hashes are shuffled to choose documents, at most ``PARTS * PART`` of a
    language; then the runs drawn from the whole text of each are gathered.
    """
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(
        F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("place"), "text"
    )
    parts = known.select("lang", "place").distinct().withColumn("part", F.pmod("place", F.lit(PARTS)))
    first = W.partitionBy("lang", "part").orderBy("place")
    chosen = parts.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= PART).select("lang", "place")
    texts = known.join(F.broadcast(stored(chosen)), ["lang", "place"]).select("lang", "place", "text")
    drawn = texts.mapInArrow(_draw(runs), "lang string, place long, text string")
    sample = drawn.groupBy("lang", "place").agg(F.min("text").alias("text")).orderBy("lang", "place")
    return [(r["text"], r["lang"]) for r in sample.collect()]


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs (doc_id, text, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(language_sample(docs)))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value) if shared.value else None
        for part in rows(batches):
            found = labeller.label(part["text"]) if labeller else [(UNKNOWN, 0.0)] * len(part["text"])
            yield batch_of(schema, part["doc_id"], part["held_out"], [x[0] for x in found], [x[1] for x in found])

    plain = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), whole_text())
    return plain.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
