"""Periodic runs of words, by a suffix automaton whose suffix links are a link-cut tree.

The words of a text are appended one by one.  The suffixes of what has been
read lie on the path from the newest state to the root, and each state holds
where its words ended last.  Preferred paths of the link-cut tree are the
states with the same last end; an access to the newest state walks over them
and gives the whole path the new end.  A piece of the path with the last end
``j`` and the length ``len`` of its deepest state tells that the last ``len``
words also end at ``j`` and no longer ones do.  If the distance ``i - j`` is
at most ``len``, the words from ``i - (i - j) - len + 1`` to ``i`` repeat with
that distance: a square at least, which nothing extends to the left.  Later
words that keep the distance extend it to the right, up to the whole run.
Since a nearer end would have been the last one, the distance is the smallest
period, and every run of twice its period or more is found at its last word.

Only parts of a text that can hold a run of the wanted length are read this
way.  Within such a run, every window of ``WINDOW`` words occurs several times;
stretches of the text in which all windows do so within the stretch, found
by sorting numbers of windows, hold every run whole.  This leaves out words,
never runs.

Words are what white space of ASCII parts.  Null texts have no words.  Every
row gives one row, repeated and null ids too; other columns are ignored.  A
worker holds one text and the automaton of its longest stretch, about 600
bytes for each word of that.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lanelytics.llm.common import batch_of, let, rows, whole_text

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 3
#: Words that are searched for stretches at a time, if no text has more.
WORDS = 300_000
_FACTORS = (np.int64(-7046029254386353131), np.int64(-4417276706812531889), np.int64(1609587929392839161))


class LinkCutAutomaton:
    """Suffix automaton of a growing sequence; state 1 is the root, 0 is none.

    ``left`` and ``right`` are the children of a state in the splay tree of its preferred path, by depth;
    ``up`` is its parent there, or for the root of a splay tree the state above the path.  The last end
    of a path is kept at the root of its splay tree.
    """

    def __init__(self) -> None:
        self.size, self.after, self.link = [0, 0], [{}, {}], [0, 0]
        self.left, self.right, self.up, self.end = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.newest, self.length = 1, 0

    def _state(self, size: int, after: dict, link: int) -> int:
        for column, value in ((self.size, size), (self.after, after), (self.link, link)):
            column.append(value)
        for column, value in ((self.left, 0), (self.right, 0), (self.up, 0), (self.end, -1)):
            column.append(value)
        return len(self.size) - 1

    def _rotate(self, x: int, y: int, z: int) -> None:
        """Puts x in the place of its parent y, whose parent is z."""
        left, right, up = self.left, self.right, self.up
        if left[z] == y:
            left[z] = x
        elif right[z] == y:
            right[z] = x
        if left[y] == x:
            moved = left[y] = right[x]
            right[x] = y
        else:
            moved = right[y] = left[x]
            left[x] = y
        up[moved] = y
        up[y], up[x] = x, z

    def _splay(self, x: int) -> None:
        left, right, up, end, rotate = self.left, self.right, self.up, self.end, self._rotate
        y = up[x]
        while y and (left[y] == x or right[y] == x):
            z = up[y]
            if not z or (left[z] != y and right[z] != y):
                end[x] = end[y]
                rotate(x, y, z)
                return
            end[x] = end[z]
            above = up[z]
            if (left[z] == y) == (left[y] == x):
                rotate(y, z, above)
                rotate(x, y, above)
            else:
                rotate(x, y, z)
                rotate(x, z, above)
            y = above

    def _split(self, state: int, size: int) -> int:
        """A state for the shorter words of a state, put above it in its path."""
        self._splay(state)
        shorter = self._state(size, self.after[state].copy(), self.link[state])
        self.link[state] = shorter
        above = self.left[shorter] = self.left[state]
        if above:
            self.up[above] = shorter
        self.left[state], self.up[shorter] = shorter, state
        return shorter

    def append(self, word: int) -> list[tuple[int, int]]:
        """(last end, length) of the pieces of the path of all suffixes that are at least as long as their distance."""
        size, after, link, right, up, end = self.size, self.after, self.link, self.right, self.up, self.end
        at, previous = self.length, self.newest
        new = self.newest = self._state(at + 1, {}, 0)
        while previous and word not in after[previous]:
            after[previous][word] = new
            previous = link[previous]
        target = 1
        if previous:
            target = after[previous][word]
            if size[previous] + 1 != size[target]:
                whole, target = target, self._split(target, size[previous] + 1)
                while previous and after[previous].get(word) == whole:
                    after[previous][word] = target
                    previous = link[previous]
        link[new] = up[new] = target
        found, below, state = [], new, target
        while state:
            self._splay(state)
            last = end[state]
            if 0 <= at - size[state] <= last:
                found.append((last, size[state]))
            if right[state]:
                end[right[state]] = last
            right[state] = below
            below, state = state, up[state]
        end[below] = at
        self.length = at + 1
        return found


def sequence_runs(words: Iterable[int], least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs with at least ``least`` words and ``exponent`` periods (two or more)."""
    automaton, ends = LinkCutAutomaton(), {}
    for at, word in enumerate(words):
        for last, size in automaton.append(word):
            ends[last - size + 1, at - last] = at
    runs = [(start, at - start + 1, period) for (start, period), at in ends.items()]
    return sorted(run for run in runs if run[1] >= max(least, exponent * run[2]))


def _repeats(least: int, exponent: int) -> int:
    """How often each window of a run occurs in it at least."""
    return min((max(least, exponent * period) - WINDOW + 1) // period for period in range(1, least + WINDOW))


def stretches(words: np.ndarray, text: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """(begin, end) of parts that hold every run whole; ``text`` numbers the text of each word, in order."""
    repeats, smallest = _repeats(least, exponent), max(least, exponent) - WINDOW + 1
    if repeats < 2 or len(words) < WINDOW:
        bounds = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
        return list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
    size = len(words) - WINDOW + 1
    with np.errstate(over="ignore"):
        window = sum(words[k : k + size] * factor for k, factor in enumerate(_FACTORS))
    places = np.flatnonzero(text[:size] == text[WINDOW - 1 :])
    window, part = np.unique(window[places], return_inverse=True)[1], text[places]
    before = -1
    while len(places) != before and len(places):
        before = len(places)
        _, number, count = np.unique(part * (window.max() + 1) + window, return_inverse=True, return_counts=True)
        often = count[number] >= repeats
        places, window, part = places[often], window[often], part[often]
        breaks = (np.diff(places, prepend=-2) != 1) | (np.diff(part, prepend=-1) != 0)
        part = np.cumsum(breaks) - 1
        if len(part):
            large = np.bincount(part)[part] >= smallest
            places, window, part = places[large], window[large], part[large]
    first = np.flatnonzero(np.diff(part, prepend=-1))
    last = np.append(first[1:], len(part))[: len(first)] - 1
    return list(zip(places[first].tolist(), (places[last] + WINDOW).tolist()))


def texts_runs(texts: list[list[bytes]], least: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, by start and period."""
    known: dict[bytes, int] = {}
    numbers = np.fromiter((known.setdefault(word, len(known)) for words in texts for word in words), np.int64)
    bounds = np.cumsum([0, *map(len, texts)])
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for begin, end in stretches(numbers, text, least, exponent):
        number = text[begin]
        offset = begin - int(bounds[number])
        runs = sequence_runs(numbers[begin:end].tolist(), least, exponent)
        found[number] += [(start + offset, length, period) for start, length, period in runs]
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that lie in a run behind its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    stays = np.ones(len(words), bool)
    for start, length, period in runs:
        stays[start + period : start + length] = False
    return b" ".join([words[n] for n in np.flatnonzero(stays).tolist()])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def _of_batches(least: int, exponent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows(batches):
            ids, texts, size = [], [], 0
            for number, (doc_id, text) in enumerate(zip(part["doc_id"], part["text"]), 1):
                ids.append(doc_id)
                texts.append(text.encode().split())
                size += len(texts[-1])
                if size >= WORDS or number == len(part["text"]):
                    runs = texts_runs(texts, least, exponent)
                    rest = [collapsed(words, found).decode() for words, found in zip(texts, runs)]
                    keys = ("start", "length", "period")
                    yield batch_of(_FOUND, ids, list(map(len, texts)), [[dict(zip(keys, r)) for r in found] for found in runs], rest)
                    ids, texts, size = [], [], 0

    return run


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of docs (doc_id, text).

    ``runs`` are structs of start, length and (smallest) period of the stretches of words that repeat, have
    at least ``least`` words and ``exponent`` periods, and that no word beside them extends, by start and
    period.  ``collapsed`` is the text with one period left of each run, its words joined by one space.
    """
    docs = docs.select(F.col("doc_id").cast("long"), whole_text())
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.mapInArrow(_of_batches(least, exponent), schema)


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by a hash of the id, with their words from some place on repeated.

    With h the crc32 of the id as text and g = floor(h / 10), the words from a = g % n on repeat the first
    p = 1 + floor((n - a) / (3 + g % 8)) of them.  Rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        source = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        places = F.sequence(F.lit(0).cast("long"), n - 1)
        planted = F.array_join(F.transform(places, lambda i: F.get(words, source(i))), " ")
        return F.when(n > 0, planted).otherwise(F.lit(""))

    text = F.coalesce("text", F.lit(""))
    planted = let(F.regexp_extract_all(text, F.lit(WORD), 0), repeat)
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(text).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """Number of runs, the longest run and digests of every row of docs, with repeats planted in a tenth of them."""
    found = periodic_runs(with_planted_repeats(docs))
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    )
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.select("doc_id", F.array_size("runs").cast("long").alias("n_runs"), longest.alias("best"), "runs", "collapsed")
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return best.select(
        "doc_id",
        "n_runs",
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
