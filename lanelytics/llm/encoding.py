"""Cached encoding of whole texts with public byte-level vocabularies, as ids in little-endian bytes."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Words a worker keeps, and the longest word it keeps.
CACHED_WORDS, LONGEST_CACHED = 300_000, 48
#: White space before a space: there the cut before the space is no certain boundary.
_UNCERTAIN = re.compile(r"\s ")
_SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=4)
def rank_encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def json_tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def packed(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


class WordCache(dict):
    """``encode`` of a word behind a space; forgets everything when full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(" " + word)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids


class TextEncoder:
    """Ids of whole texts.

    In a byte-level pattern no match runs from a non-space character into
    white space, so a space after one begins a match whatever stands before:
    words between such spaces are encoded apart, and once each.  A text with
    white space in front of a space is given to ``encode`` whole.
    """

    def __init__(self, encode):
        self.encode, self.words = encode, WordCache(encode)

    def __call__(self, text: str) -> bytes:
        if _UNCERTAIN.search(text):
            return self.encode(text)
        first, *others = text.split(" ")
        return self.encode(first) + b"".join(map(self.words.__getitem__, others))


@lru_cache(maxsize=4)
def rank_encoder(path: str, pattern: str) -> TextEncoder:
    """Encoder by a rank file, without special tokens."""
    encode = rank_encoding(path, pattern).encode_ordinary
    return TextEncoder(lambda text: packed(encode(text)))


@lru_cache(maxsize=4)
def json_encoder(json_path: str, rank_path: str, pattern: str) -> TextEncoder:
    """Encoder with the results of the JSON tokenizer, special strings included.

    The rank file holds the same vocabulary and is quicker; it serves words of
    Latin letters, for which the two libraries share their character classes.
    """
    slow, quick = json_tokenizer(json_path), rank_encoding(rank_path, pattern).encode_ordinary

    def encode(text: str) -> bytes:
        if text and (max(text) >= "ɐ" or _SPECIAL in text):
            return packed(slow.encode(text, add_special_tokens=False).ids)
        return packed(quick(text))

    encoder = TextEncoder(encode)

    def whole(text: str) -> bytes:
        return encode(text) if _SPECIAL in text else encoder(text)

    return whole
