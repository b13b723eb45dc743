"""Exact token counts of prefixes: a running sum over words answers length and budget questions.

The tokenizer drops white space and never lets a token span it, so the count
of a text up to the end of a word is the count up to the word before plus the
word's own.  Inside a word the same holds for the ends of its pre-tokens
(letter runs, digits, sign runs).  ``prefix_table`` stores that recurrence for
every pre-token end: a prefix that ends in white space has the count of the
last end before it, and one that ends inside a word adds the count of that
part of the word, which ``prefix_tokens`` does for any lengths.  Counts of
words come from the library itself and are kept.

Null texts count as empty.  Every row gives one row, repeated ids included;
other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lanelytics.llm.common import batch_of, rows, whole_text
from lanelytics.llm.encoding import CACHED_WORDS, LONGEST_CACHED, json_tokenizer

#: Characters at which Python splits words but the tokenizer does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")


class PrefixCounter:
    def __init__(self, path: str):
        self.tokenizer, self.known = json_tokenizer(path), {}

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def words(self, text: str) -> list[str]:
        """Words in order; white space lies between them."""
        return re.findall(r"[^ \t\n\r]+", text) if _SEPARATORS.search(text) else text.split()

    def learn(self, words: Iterable[str]) -> None:
        """Counts of words not yet known, in one call of the library."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        new = list(set(words).difference(self.known))
        encoded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        self.known.update(zip(new, (len(e.ids) for e in encoded)))

    def prefix_counts(self, words: list[str]) -> list[int]:
        """Tokens up to each word end; entry 0 is the empty prefix."""
        return list(accumulate(map(self.known.__getitem__, words), initial=0))

    def forget_long(self) -> None:
        for word in [w for w in self.known if len(w) > LONGEST_CACHED]:
            del self.known[word]

    def spans(self, text: str) -> Iterator[re.Match]:
        """The words as matches, in order."""
        return re.finditer(r"[^ \t\n\r]+" if _SEPARATORS.search(text) else r"\S+", text)

    def apart(self, left: str, right: str) -> bool:
        """Whether the normaliser changes nothing across the border between two pieces of a text."""
        normalizer = self.tokenizer.normalizer
        if normalizer is None or right[:1] < "\u0300":  # no sign below joins the one before it
            return True
        normal = normalizer.normalize_str
        return normal(left) + normal(right) == normal(left + right)

    def parts(self, word: str) -> list[tuple[int, int]]:
        """(end, tokens up to there) of each pre-token of a word.

        An end counts only if the normaliser gives both sides by themselves what it gives them together, so
        that no mark, vowel or final sign is parted from the signs it joins.
        """
        encoded = self.tokenizer.encode(word, add_special_tokens=False)
        ids, offsets, found, last = encoded.word_ids, encoded.offsets, {}, 0
        for n, (begin, end) in enumerate(offsets[1:], 1):
            # begin lies behind the signs that joined those before them, which belong to no token's offsets
            if ids[n] != ids[n - 1] and offsets[n - 1][1] <= begin and self.apart(word[last:begin], word[begin:end]):
                found[begin], last = n, begin
        found[len(word)] = len(ids)
        return sorted(found.items())

    def part_within(self, word: str, budget: int) -> int:
        """Where the last of the first ``budget`` tokens of a word ends up to which it has no more by itself."""
        offsets = self.tokenizer.encode(word, add_special_tokens=False).offsets
        for end in sorted({end for _, end in offsets[:budget]}, reverse=True):
            if self.count(word[:end]) <= budget:
                return end
        return 0

    def longest_prefix(self, text: str, counts: list[int], budget: int) -> int:
        """Code points up to the last token within ``budget`` tokens, by the counts of the words; all if they fit."""
        within = bisect_right(counts, budget) - 1
        if within == len(counts) - 1:
            return len(text)
        around = list(islice(self.spans(text), max(within - 1, 0), within + 1))
        part = self.part_within(around[-1].group(), budget - counts[within])
        return around[-1].start() + part if part else around[0].end() if within else 0


@lru_cache(maxsize=2)
def prefix_counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _tables(path: str):
    numbers = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("ends", numbers), ("counts", numbers)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for part in rows(batches):
            ends, counts = [], []
            for text in part["text"]:
                places, sums = [0], [0]
                for word in counter.spans(text):
                    before = sums[-1]
                    for end, tokens in counter.parts(word.group()):
                        places.append(word.start() + end)
                        sums.append(before + tokens)
                ends.append(places)
                counts.append(sums)
            yield batch_of(schema, part["doc_id"], ends, counts)

    return run


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ends, counts): at each pre-token end, code points before it and the exact tokens of that prefix."""
    docs = docs.select(F.col("doc_id").cast("long"), whole_text())
    return docs.mapInArrow(_tables(path), "doc_id long, ends array<long>, counts array<long>")


def tokens_up_to(length: Column) -> Column:
    """On a prefix table: tokens of the pre-tokens that end within the first ``length`` code points.

    A pre-token that the prefix cuts adds what only the text can tell: see ``prefix_tokens``.
    """
    return F.element_at("counts", F.size(F.filter("ends", lambda end: end <= length)))


def words_within(budget: Column) -> Column:
    """On a prefix table: where the last pre-token ends up to which the text has at most ``budget`` tokens."""
    return F.element_at("ends", F.size(F.filter("counts", lambda count: count <= budget)))


def _at_lengths(path: str):
    numbers = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("lengths", numbers), ("counts", numbers)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for part in rows(batches):
            counts = []
            for text, lengths in zip(part["text"], part["lengths"]):
                words = list(counter.spans(text))
                counter.learn(word.group() for word in words)
                sums, starts = counter.prefix_counts([word.group() for word in words]), [word.start() for word in words]
                found = []
                for length in lengths or []:
                    at = bisect_right(starts, max(length or 0, 0) - 1) - 1
                    if at < 0:
                        found.append(0)
                    elif words[at].end() <= length:
                        found.append(sums[at + 1])
                    else:
                        found.append(sums[at] + counter.count(text[starts[at] : length]))
                counts.append(found)
            counter.forget_long()
            yield batch_of(schema, part["doc_id"], part["lengths"], counts)

    return run


def prefix_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, lengths, counts) of docs (doc_id, text, lengths): the exact tokens of the prefixes of any lengths."""
    docs = docs.select(F.col("doc_id").cast("long"), whole_text(), F.col("lengths").cast("array<long>"))
    return docs.mapInArrow(_at_lengths(path), "doc_id long, lengths array<long>, counts array<long>")


def _totals(path: str, limit: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fitting_chars", pa.int64())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for part in rows(batches):
            split = [counter.words(text) for text in part["text"]]
            counter.learn(word for words in split for word in words)
            counts = [counter.prefix_counts(words) for words in split]
            totals = [c[-1] for c in counts]
            fitting = [counter.longest_prefix(text, c, limit) for text, c in zip(part["text"], counts)]
            counter.forget_long()
            sizes = [len(text.encode()) for text in part["text"]]
            yield batch_of(schema, part["doc_id"], sizes, totals, [t > limit for t in totals], fitting)

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fitting_chars): the last row of each prefix table, which is not stored.

    ``fitting_chars`` is where a text is to be cut to stay within ``limit`` tokens: behind the last
    token that fits, which lies inside a word where its end does not fit.
    """
    docs = docs.select(F.col("doc_id").cast("long"), whole_text())
    return docs.mapInArrow(
        _totals(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long"
    )
