"""Toxicity scores from a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings: one of the word and one of each of its
first letters, so that inflected forms share what they learn.  Filters of one
to three words slide over the whole text, each keeps its largest response, and
a logistic layer scores these.  Gradients flow to the words that gave the
largest responses only.

Learning takes every labelled document.  A first network is trained on at most
``SAMPLE`` documents of either class, those whose ids come first by hash, and
is nothing but a start: the documents are dealt by id to learners of some
``LESSON`` documents, each goes on from the start over all of its own, and what
they change is averaged, each word's embedding over the learners that met it.
A fifth of the documents is held back from this to place the threshold of each
language such that it comes out at ``THRESHOLD``; all of them are scored and
counted for it.  For this and for scoring, the language is guessed from the
words alone by a profile counted on all learned documents: a score depends on
nothing but the text.  Sums are of whole numbers, so that the same tables give
the same network however Spark splits its work.

Null texts count as empty and texts without words get the score of no
responses.  Without labels of both kinds every score is 0.  Every row is
scored, repeated and null ids too; other columns are ignored.
"""

from __future__ import annotations

import copy
import pickle
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from lanelytics.llm.common import SLICE, WordTable, batch_of, held_out, rows, whole_text

SAMPLE, THRESHOLD = 3000, 0.3
BUCKETS, DEPTH, WIDTHS, FILTERS = 1 << 16, 12, (1, 2, 3), 6
PREFIXES = (4, 5, 6)
#: Documents that training looks at in all, as many of either label, those of a step, and the step size.
LOOKS, BATCH, RATE = 16_000, 16, 0.15
#: Share of a document's different words that one look takes in, lest a few words that always show hide the others.
HEARD = 0.5
#: Documents of a learner, on average, and of what one is held back for the thresholds.
LESSON, HELD_BACK = 4000, 5
#: Changes are added up as whole numbers of this part of one, logits counted in steps of that.
UNIT, STEP = 2.0**-24, 2.0**-8
WORD = re.compile(r"\w+")


def buckets(word: str) -> list[int]:
    """Bucket 0 stands for nothing."""
    if not word:
        return [0] * (1 + len(PREFIXES))
    starts = [f"{n} {word[:n]}" if len(word) >= n else "" for n in PREFIXES]
    return [1 + zlib.crc32(x.encode()) % (BUCKETS - 1) if x else 0 for x in (word, *starts)]


def split(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Network:
    embedding: np.ndarray  # BUCKETS x DEPTH
    filters: list[np.ndarray]  # for each width: width x DEPTH x FILTERS
    bias: np.ndarray  # widths * FILTERS
    weights: np.ndarray
    intercept: float
    profile: np.ndarray  # BUCKETS x languages: log shares of words
    shift: np.ndarray  # by guessed language

    @classmethod
    def fresh(cls, languages: int, seed: int = 7) -> Network:
        random = np.random.default_rng(seed)
        embedding = random.normal(0, 0.1, (BUCKETS, DEPTH)).astype(np.float32)
        embedding[0] = 0
        filters = [random.normal(0, 0.3, (w, DEPTH, FILTERS)).astype(np.float32) for w in WIDTHS]
        size = len(WIDTHS) * FILTERS
        weights = np.abs(random.normal(0, 0.3, size)).astype(np.float32)
        profile = np.zeros((BUCKETS, languages), np.float32)
        return cls(embedding, filters, np.zeros(size, np.float32), weights, -1.0, profile, np.zeros(languages, np.float32))

    def responses(self, features: np.ndarray) -> np.ndarray:
        """Of words: what each filter row gives, widths in turn, then the language profile."""
        vectors = self.embedding[features].sum(1)
        parts = [vectors @ row for by_width in self.filters for row in by_width]
        return np.concatenate([*parts, self.profile[features[:, 0]]], axis=1)

    def slide(self, by_word: np.ndarray) -> list[np.ndarray]:
        """Responses of each width at each place; a text shorter than a filter is padded by nothing."""
        found, column = [], 0
        for width in WIDTHS:
            places = max(1, len(by_word) - width + 1)
            total = np.zeros((places, FILTERS), np.float32)
            for step in range(width):
                rows = by_word[step : step + places, column : column + FILTERS]
                total[: len(rows)] += rows
                column += FILTERS
            found.append(total)
        return found

    def logit(self, by_word: np.ndarray) -> tuple[float, int]:
        """Raw score and guessed language of a text's word responses."""
        pooled = np.concatenate([x.max(0) for x in self.slide(by_word)]) + self.bias
        value = float(np.maximum(pooled, 0) @ self.weights + self.intercept)
        languages = len(self.shift)
        return value, int(by_word[:, -languages:].sum(0).argmax()) if languages else 0

    def score(self, logit: float, language: int) -> float:
        return 1 / (1 + float(np.exp(-(logit - self.shift[language]))))


def _fresh_shares(network: Network) -> list[np.ndarray]:
    """Squared gradients so far of each parameter, the intercept last."""
    return [*[np.full_like(x, 0.1) for x in (network.embedding, *network.filters, network.bias, network.weights)], np.full((), 0.1)]


def _learn(network: Network, shares: list[np.ndarray], texts: list[np.ndarray], labels: np.ndarray, order: np.ndarray, random) -> None:
    """Adagrad over small batches of the texts' word features, in the given order."""
    for begin in range(0, len(order), BATCH):
        chosen = order[begin : begin + BATCH]
        by_filter = [np.zeros_like(f) for f in network.filters]
        by_bias, by_weight, by_intercept = np.zeros_like(network.bias), np.zeros_like(network.weights), 0.0
        touched, pulls = [], []
        for n in chosen:
            words = texts[n]
            heard = random.random(BUCKETS, np.float32)[words[:, 0]] < HEARD
            words = words[heard] if heard.any() else words
            vectors = network.embedding[words].sum(1)
            by_word = np.concatenate([vectors @ row for f in network.filters for row in f], axis=1)
            slid = network.slide(by_word)
            tops = [x.argmax(0) for x in slid]
            pooled = np.concatenate([x.max(0) for x in slid]) + network.bias
            kept = np.maximum(pooled, 0)
            logit = float(kept @ network.weights + network.intercept)
            slope = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[n]) / len(chosen)
            by_weight += slope * kept
            by_intercept += slope
            pull = slope * network.weights * (pooled > 0)
            by_bias += pull
            for k, width in enumerate(WIDTHS):
                mine = pull[k * FILTERS : (k + 1) * FILTERS]
                for step in range(width):
                    place = tops[k] + step
                    inside = place < len(words)
                    place = place[inside]
                    by_filter[k][step][:, inside] += vectors[place].T * mine[inside]
                    touched.append(words[place])
                    pulls.append((network.filters[k][step][:, inside] * mine[inside]).T)
        cells = np.concatenate(touched)
        gradient = np.repeat(np.concatenate(pulls), cells.shape[1], axis=0)
        rows, where = np.unique(cells.ravel(), return_inverse=True)
        by_row = np.zeros((len(rows), DEPTH), np.float32)
        np.add.at(by_row, where, gradient)
        by_row[rows == 0] = 0
        shares[0][rows] += by_row**2
        network.embedding[rows] -= RATE * by_row / np.sqrt(shares[0][rows])
        for value, share, change in zip([*network.filters, network.bias, network.weights], shares[1:-1], [*by_filter, by_bias, by_weight]):
            share += change**2
            value -= RATE * change / np.sqrt(share)
        shares[-1] += by_intercept**2
        network.intercept -= RATE * by_intercept / float(np.sqrt(shares[-1]))


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float | None:
    """In the middle of the gap that gives the best F1; nothing without both classes."""
    values, where = np.unique(logits, return_inverse=True)
    n = np.bincount(where, minlength=len(values))
    return best_of_counts(values, values, n, np.bincount(where, labels, minlength=len(values)))


def best_of_counts(low: np.ndarray, high: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float | None:
    """The same between ranges of logits, from the least and the largest logit, the texts and the toxic ones of each."""
    if not 0 < hits.sum() < n.sum():
        return None
    order = np.argsort(-low, kind="stable")
    low, high = low[order], high[order]
    f1 = 2 * np.cumsum(hits[order]) / (np.cumsum(n[order]) + hits.sum())
    best = int(f1.argmax())
    return float((low[best] + high[best + 1]) / 2 if best + 1 < len(low) else low[best] - 1)


def features(texts: Iterable[str]) -> list[np.ndarray]:
    """The buckets of each text's words, a row for each word."""
    known: dict[str, list[int]] = {}
    found = []
    for text in texts:
        words = split(text) or [""]
        for word in set(words).difference(known):
            known[word] = buckets(word)
        found.append(np.array([known[word] for word in words], np.int32))
    return found


def start(sample: list[tuple[str, str | None, int]], seed: int = 11) -> tuple[Network, list[np.ndarray]] | None:
    """A first network from (text, language, label) rows, and its squared gradients; None unless both labels occur."""
    labels = np.array([label for _, _, label in sample])
    if not len(labels) or labels.min() == labels.max():
        return None
    network, texts, random = Network.fresh(1), features(text for text, _, _ in sample), np.random.default_rng(seed)
    shares = _fresh_shares(network)
    of_label = [np.flatnonzero(labels == label) for label in (0, 1)]
    half = min(map(len, of_label))
    for _ in range(-(-LOOKS // (2 * half))):
        order = random.permutation(np.concatenate([random.choice(x, half, replace=False) for x in of_label]))
        _learn(network, shares, texts, labels, order, random)
    return network, shares


def _globals(network: Network) -> np.ndarray:
    """All parameters but the embedding, one after the other."""
    return np.concatenate([*[f.ravel() for f in network.filters], network.bias, network.weights, [network.intercept]])


VALUES = [f"v{n}" for n in range(DEPTH)]
#: What a learner gives: rows of the embedding that changed, the other parameters, and words counted by language.
EMBEDDING, OTHERS, WORDS = range(3)
LEARNED = ", ".join(["part int", "name string", "place int", "n long", *[f"{v} long" for v in VALUES]])


def _in_rows(values: np.ndarray) -> np.ndarray:
    return np.pad(values, (0, -len(values) % DEPTH)).reshape(-1, DEPTH)


def lesson(begun: tuple[Network, list[np.ndarray]], docs: pd.DataFrame) -> pd.DataFrame:
    """What one learner changes in a look at each of its documents (text, lang, toxic, back).

    Those of the rarer label are looked at again until there are as many of either; those held back are only counted.
    """
    network, shares = copy.deepcopy(begun)
    texts, labels, taught = features(docs["text"]), docs["toxic"].to_numpy(), ~docs["back"].to_numpy(bool)
    found = []

    def add(part: int, name: str, places: np.ndarray, values: np.ndarray) -> None:
        frame = pd.DataFrame(np.rint(values).astype(np.int64), columns=VALUES)
        frame.insert(0, "n", 1)
        frame.insert(0, "place", places.astype(np.int32))
        frame.insert(0, "name", name)
        frame.insert(0, "part", np.int32(part))
        found.append(frame)

    random = np.random.default_rng(13)
    of_label = [x for x in (random.permutation(np.flatnonzero(taught & (labels == label))) for label in (0, 1)) if len(x)]
    if of_label:
        most = max(map(len, of_label))
        order = random.permutation(np.concatenate([np.resize(x, most) for x in of_label]))
        _learn(network, shares, texts, labels, order, random)
        change = network.embedding.astype(np.float64) - begun[0].embedding
        places = np.flatnonzero(change.any(1))
        add(EMBEDDING, "", places, change[places] / UNIT)
        others = _in_rows((_globals(network) - _globals(begun[0])) / UNIT)
        add(OTHERS, "", np.arange(len(others)), others)
    for name in docs["lang"].dropna().unique():
        words = [texts[n][:, 0] for n in np.flatnonzero((docs["lang"] == name).to_numpy())]
        counts = _in_rows(np.bincount(np.concatenate(words), minlength=BUCKETS).astype(np.float64))
        places = np.flatnonzero(counts.any(1))
        add(WORDS, name, places, counts[places])
    return pd.concat(found) if found else pd.DataFrame(columns=["part", "name", "place", "n", *VALUES])


def merged(begun: Network, learned: pa.Table) -> Network:
    """The start with the mean change of all learners, and the profile of all counted words; shifts are still zero."""
    part, place, n = (learned[c].to_numpy() for c in ("part", "place", "n"))
    values = np.column_stack([learned[v].to_numpy() for v in VALUES]).reshape(-1, DEPTH)
    names = np.array(learned["name"].to_pylist(), object)
    network = copy.deepcopy(begun)
    mine = part == EMBEDDING
    network.embedding[place[mine]] += (values[mine] * UNIT / n[mine, None]).astype(np.float32)
    mine = part == OTHERS
    change = np.zeros((int(mine.sum()), DEPTH))
    change[place[mine]] = values[mine] * UNIT / n[mine, None]
    change, used = change.ravel(), 0
    for value in (*network.filters, network.bias, network.weights):
        if mine.any():
            value += change[used : used + value.size].reshape(value.shape).astype(np.float32)
        used += value.size
    network.intercept += float(change[used]) if mine.any() else 0.0
    languages = sorted(set(names[part == WORDS])) or [""]
    counts = np.ones((BUCKETS, len(languages)))
    for column, language in enumerate(languages):
        mine = (part == WORDS) & (names == language)
        cells = np.zeros((-(-BUCKETS // DEPTH), DEPTH))
        cells[place[mine]] = values[mine]
        counts[:, column] += cells.ravel()[:BUCKETS]
    network.profile = np.log(counts / counts.sum(0)).astype(np.float32)
    network.profile -= network.profile.mean(1, keepdims=True)
    network.shift = np.zeros(len(languages), np.float32)
    return network


def calibrate(network: Network, counted: pa.Table) -> None:
    """Shifts each language so that its best threshold comes out at THRESHOLD; all languages' where it has none."""
    guessed, *columns = (counted[c].to_numpy() for c in ("guessed", "low", "high", "n", "hits"))
    by_step: dict[float, list[float]] = {}
    for low, high, n, hits in zip(*columns):
        kept = by_step.setdefault(np.floor(low / STEP), [low, high, 0, 0])
        kept[:] = min(kept[0], low), max(kept[1], high), kept[2] + n, kept[3] + hits
    overall = best_of_counts(*np.array(list(by_step.values()), float).reshape(-1, 4).T)
    for language in range(len(network.shift)):
        best = best_of_counts(*[column[guessed == language] for column in columns])
        best = best if best is not None else overall if overall is not None else 0.0
        network.shift[language] = best - np.log(THRESHOLD / (1 - THRESHOLD))


class Scorer:
    """Scores texts; the responses of words are kept."""

    def __init__(self, network: Network):
        self.network = network
        self.table = WordTable(lambda words: network.responses(np.array([buckets(word) for word in words], np.int32)))

    def logits(self, texts: list[str]) -> list[tuple[float, int]]:
        """Raw score and guessed language of each text."""
        return [self.network.logit(by_text) for by_text in self.table.rows_of([split(text) or [""] for text in texts])]

    def scores(self, texts: list[str]) -> list[float]:
        return [self.network.score(*found) for found in self.logits(texts)]


def held_back() -> Column:
    """Whether a document serves the thresholds instead of the network."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(HELD_BACK)), F.lit(HELD_BACK)) == 0


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the documents that may be learned from; of several labels the toxic one counts."""
    return (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )


def sampled(docs: DataFrame, labels: DataFrame, size: int | None = None) -> DataFrame:
    """(text, lang, toxic, place, doc_id) of at most ``size`` documents (``SAMPLE``) of each class to begin with.

    They are first by hash of the id, their place.  Of rows with the same id the text with the least hash counts.
    """
    size = SAMPLE if size is None else size
    known = known_labels(labels).filter(~held_back()).withColumn("place", F.xxhash64("doc_id"))
    # hashes under a bound that some four times as many documents stay below, so that tasks need not pass on more
    rows = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    bound = {c: min((1 << 63) - 1, int(-(1 << 63) + (1 << 64) * 4 * size / max(1, rows.get(c, 0)))) for c in (0, 1)}
    chosen = [
        known.filter((F.col("toxic") == c) & (F.col("place") <= bound[c])).orderBy("place", "doc_id").limit(size)
        for c in (0, 1)
    ]
    texts = docs.select(F.col("doc_id").cast("long"), whole_text(), F.col("lang").cast("string").alias("lang"))
    # at most two samples of ids and labels, whatever the tables hold
    sample = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "lang")).alias("first")
    once = sample.groupBy("doc_id", "place", "toxic").agg(first).orderBy("place", "doc_id")
    return once.limit(2 * size).select("first.text", "first.lang", "toxic", "place", "doc_id")


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int | None = None) -> list[tuple[str, str | None, int]]:
    """(text, lang, toxic) of the sample, by place."""
    rows = sampled(docs, labels, size).orderBy("place", "doc_id").collect()
    return [(r["text"], r["lang"], r["toxic"]) for r in rows]


def begin(docs: DataFrame, labels: DataFrame) -> tuple[Network, list[np.ndarray]] | None:
    """What ``start`` makes of the sample, in one task: texts and what learning takes stay out of the driver."""

    def run(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["place", "doc_id"])
        return pd.DataFrame({"begun": [pickle.dumps(start(list(zip(sample["text"], sample["lang"], sample["toxic"]))))]})

    # at most two samples of documents; an empty one gives no row
    found = sampled(docs, labels).groupBy().applyInPandas(run, "begun binary").first()
    return None if found is None else pickle.loads(found["begun"])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, lang, toxic, back) of every document that may be learned from, once each."""
    texts = docs.select(F.col("doc_id").cast("long"), whole_text(), F.col("lang").cast("string").alias("lang"))
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "lang")).alias("first")
    once = texts.filter(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(first)
    return once.join(known_labels(labels), "doc_id").select(
        "doc_id", "first.text", "first.lang", "toxic", held_back().alias("back")
    )


def changes(docs: DataFrame, labels: DataFrame, shared: Broadcast) -> DataFrame:
    """The summed changes and counts of all learners: at most a row a bucket, and a few a language."""
    learners = max(1, round(known_labels(labels).count() / LESSON))
    dealt = labelled(docs, labels).withColumn("learner", F.pmod(F.xxhash64("doc_id"), F.lit(learners)))

    def learn(mine: pd.DataFrame) -> pd.DataFrame:
        return lesson(shared.value, mine.sort_values("doc_id"))

    by_learner = dealt.groupBy("learner").applyInPandas(learn, LEARNED)
    return by_learner.groupBy("part", "name", "place").agg(*[F.sum(c).alias(c) for c in ("n", *VALUES)])


def learned(docs: DataFrame, labels: DataFrame, begun: tuple[Network, list[np.ndarray]]) -> pa.Table:
    """The changes as a table."""
    return changes(docs, labels, docs.sparkSession.sparkContext.broadcast(begun)).toArrow()


def taught(docs: DataFrame, labels: DataFrame, begun: tuple[Network, list[np.ndarray]]) -> Network:
    """The start merged with the changes of all learners, in one task that gets the sums."""
    shared = docs.sparkSession.sparkContext.broadcast(begun)

    def run(summed: pa.Table) -> pa.Table:
        return pa.table({"network": [pickle.dumps(merged(shared.value[0], summed))]}, pa.schema([("network", pa.binary())]))

    return pickle.loads(changes(docs, labels, shared).groupBy().applyInArrow(run, "network binary").first()["network"])


def counted(docs: DataFrame, labels: DataFrame, network: Network) -> pa.Table:
    """Of all documents held back, those of either label by guessed language and step of the logit."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("logit", pa.float64()), ("guessed", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Scorer(shared.value)
        for part in rows(batches):
            found = model.logits(part["text"])
            yield batch_of(schema, part["doc_id"], part["hash"], [x for x, _ in found], [g for _, g in found])

    texts = docs.select(F.col("doc_id").cast("long"), whole_text())
    back = texts.filter(F.col("doc_id").isNotNull() & ~held_out() & held_back()).withColumn("hash", F.xxhash64("text"))
    scored = back.mapInArrow(run, "doc_id long, hash long, logit double, guessed int")
    first = scored.groupBy("doc_id").agg(F.min(F.struct("hash", "logit", "guessed")).alias("first"))
    rows_of = first.join(known_labels(labels), "doc_id").select("first.logit", "first.guessed", "toxic")
    logit = F.col("logit")
    return (
        rows_of.groupBy("guessed", F.floor(logit / STEP).alias("step"))
        .agg(F.min(logit).alias("low"), F.max(logit).alias("high"), F.count("*").alias("n"), F.sum("toxic").alias("hits"))
        .toArrow()
    )


def train(docs: DataFrame, labels: DataFrame) -> Network | None:
    """The network learned from all labelled documents; None unless both labels occur."""
    begun = begin(docs, labels)
    if begun is None:
        return None
    network = taught(docs, labels, begun)
    calibrate(network, counted(docs, labels, network))
    return network


def scorer(docs: DataFrame, labels: DataFrame) -> Callable[[], Scorer | None]:
    """A function from texts to scores, trained and handed to the workers."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def scores() -> Scorer | None:
        return None if shared.value is None else Scorer(shared.value)

    return scores


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text, lang)."""
    make = scorer(docs, labels)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for part in rows(batches):
            scores = model.scores(part["text"]) if model else [0.0] * len(part["text"])
            yield batch_of(schema, part["doc_id"], part["held_out"], scores, [int(s >= THRESHOLD) for s in scores])

    plain = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), whole_text())
    return plain.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score is under the threshold, with all their columns."""
    make = scorer(docs, labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                texts = [text or "" for text in part.column("text").to_pylist()]
                scores = model.scores(texts) if model else [0.0] * len(texts)
                yield part.filter(pa.array([score < THRESHOLD for score in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
