"""Byte-level BPE of whole documents: overlapping chunks, stitched where their pre-token boundaries agree.

Texts of up to ``chunk`` code points are encoded where they are.  Longer texts
are cut into chunks that overlap.  Every chunk is pre-tokenised from its own
first character, which may lie inside a match; a match depends only on the
text from its start on, so once two neighbours share a boundary they agree
from there.  The first shared boundary behind a non-space character is where
the pieces meet, and each piece is encoded by itself.  A text with a pair of
neighbours that share no boundary is encoded as one piece.

Null texts count as empty (no ids).  Rows with the same id, or none, are
encoded each; equal long texts are encoded once.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window as W, functions as F

from lanelytics.llm.common import batch_of, rows, whole_text
from lanelytics.llm.encoding import rank_encoder, rank_encoding

CHUNK, OVERLAP = 32768, 512

_DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"
_LONG, _TEXT = pa.int64(), pa.string()


def _digests(path: str, pattern: str):
    """Short documents: count and digests of the ids and of the decoded bytes."""
    schema = pa.schema([("doc_id", _LONG), ("n_tokens", _LONG), ("ids_sha256", _TEXT), ("decoded_sha256", _TEXT)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = rank_encoder(path, pattern), decoder(path, pattern)
        for part in rows(batches):
            ids = [encode(text) for text in part["text"]]
            yield batch_of(
                schema,
                part["doc_id"],
                [len(x) // 4 for x in ids],
                [hashlib.sha256(x).hexdigest() for x in ids],
                [hashlib.sha256(decode(x)).hexdigest() for x in ids],
            )

    return run


def decoder(path: str, pattern: str):
    """Packed ids to bytes: every id stands for a run of raw bytes, and these are concatenated."""
    encoding = rank_encoding(path, pattern)
    of_id = [b""] * (encoding.max_token_value + 1)
    for token in encoding.token_byte_values():
        of_id[encoding.encode_single_token(token)] = token
    return lambda packed: b"".join(map(of_id.__getitem__, memoryview(packed).cast("I")))


def _cut(chunk: int, overlap: int):
    schema = pa.schema([("text_key", _TEXT), ("chunk", _LONG), ("last", pa.bool_()), ("text", _TEXT)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                key, text = batch.column("text_key")[at].as_py(), batch.column("text")[at].as_py()
                count = -(-len(text) // chunk)
                for i in range(count):
                    piece = text[i * chunk : (i + 1) * chunk + overlap]
                    yield batch_of(schema, [key], [i], [i == count - 1], [piece])

    return run


def safe_boundaries(text: str, pattern: regex.Pattern, ends_here: bool) -> list[int]:
    """Ends of matches behind a non-space character that no later text can move.

    Behind white space the cut would change the look-ahead of the last match.
    """
    ends = [m.end() for m in pattern.finditer(text)]
    return [0] + [end for end in ends if (ends_here or end < len(text)) and not text[end - 1].isspace()]


def _bounds(pattern: str, chunk: int, overlap: int):
    numbers = pa.list_(_LONG)
    schema = pa.schema([("text_key", _TEXT), ("chunk", _LONG), ("last", pa.bool_()), ("head", numbers), ("tail", numbers)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for part in rows(batches):
            heads, tails = [], []
            for i, last, text in zip(part["chunk"], part["last"], part["text"]):
                ends = safe_boundaries(text, compiled, last)
                heads.append([e for e in ends if 0 < e < overlap])
                tails.append([e - chunk for e in ends if chunk < e < chunk + overlap])
            yield batch_of(schema, part["text_key"], part["chunk"], part["last"], heads, tails)

    return run


def _encode_pieces(path: str, pattern: str):
    schema = pa.schema([("text_key", _TEXT), ("chunk", _LONG), ("ids", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_encoder(path, pattern)
        for part in rows(batches):
            ids = [
                encode(text[begin:end])
                for text, begin, end in zip(part["text"], part["begin"], part["end"])
            ]
            yield batch_of(schema, part["text_key"], part["chunk"], ids)

    return run


def _stitch(path: str, pattern: str):
    """Pieces sorted by text and place: running digests, one text at a time."""
    schema = pa.schema([("text_key", _TEXT), ("n_tokens", _LONG), ("ids_sha256", _TEXT), ("decoded_sha256", _TEXT)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(path, pattern)
        key = None
        for part in rows(batches):
            for text_key, ids in zip(part["text_key"], part["ids"]):
                if text_key != key:
                    if key is not None:
                        yield batch_of(schema, [key], [count], [of_ids.hexdigest()], [of_bytes.hexdigest()])
                    key, count, of_ids, of_bytes = text_key, 0, hashlib.sha256(), hashlib.sha256()
                count += len(ids) // 4
                of_ids.update(ids)
                of_bytes.update(decode(ids))
        if key is not None:
            yield batch_of(schema, [key], [count], [of_ids.hexdigest()], [of_bytes.hexdigest()])

    return run


def chunk_pieces(
    long_texts: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """Pieces (text_key, chunk, text, begin, end) of distinct texts (text_key, text); together they are the texts."""
    chunks = long_texts.mapInArrow(_cut(chunk, overlap), "text_key string, chunk long, last boolean, text string")
    bounds = chunks.mapInArrow(
        _bounds(pattern, chunk, overlap),
        "text_key string, chunk long, last boolean, head array<long>, tail array<long>",
    )
    in_text = W.partitionBy("text_key").orderBy("chunk")
    meets = bounds.withColumn("begin", F.array_min(F.array_intersect("head", F.lag("tail").over(in_text))))
    pieces = meets.select(
        "text_key",
        "chunk",
        F.when(F.col("chunk") == 0, 0).otherwise(F.col("begin")).alias("begin"),
        F.when(~F.col("last"), F.lead("begin").over(in_text) + chunk).alias("end"),
        F.max(F.col("begin").isNull() & (F.col("chunk") > 0)).over(W.partitionBy("text_key")).alias("apart"),
    )
    met = chunks.join(pieces.filter(~F.col("apart")), ["text_key", "chunk"])
    apart = long_texts.join(
        pieces.filter(F.col("apart") & (F.col("chunk") == 0)).select("text_key"), "text_key", "left_semi"
    )
    columns = ["text_key", "chunk", "text", "begin", "end"]
    nothing = F.lit(None).cast("long")
    whole = apart.select("text_key", F.lit(0).cast("long").alias("chunk"), "text", nothing.alias("begin"), nothing.alias("end"))
    return met.select(columns).unionByName(whole)


def encode_documents(
    docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), whole_text())
    is_long = F.length("text") > chunk
    short = docs.filter(~is_long).mapInArrow(_digests(path, pattern), f"doc_id long, {_DIGEST}")
    keyed = docs.filter(is_long).withColumn("text_key", F.sha2("text", 256))
    pieces = chunk_pieces(keyed.select("text_key", "text").dropDuplicates(["text_key"]), pattern, chunk, overlap)
    ids = pieces.mapInArrow(_encode_pieces(path, pattern), "text_key string, chunk long, ids binary")
    stitched = (
        ids.repartition("text_key")
        .sortWithinPartitions("text_key", "chunk")
        .mapInArrow(_stitch(path, pattern), f"text_key string, {_DIGEST}")
    )
    return short.unionByName(keyed.select("doc_id", "text_key").join(stitched, "text_key").drop("text_key"))
