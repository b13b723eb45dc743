"""Near-duplicate documents: SimHash fingerprints linked through pivot distance tables.

A fingerprint has the majority bits of the hashes of a document's shingles.
Equal fingerprints collapse to one row.  Two that differ in at most
``DISTANCE`` bits agree on all but that many of the blocks into which the bits
are cut, so they meet under some choice of equal blocks.  Those who meet have
their distances to ``PIVOTS`` reference fingerprints in a table; by the
triangle inequality each coordinate of two linked rows differs by at most
``DISTANCE``.  Rows stand in order of the first coordinate, which bounds how
far a row looks ahead; the largest difference over the other coordinates
discards nearly all of the rest, and survivors are verified.  (Distances of
unrelated fingerprints gather around 32, so pivots alone would leave about half of
all pairs for one coordinate, and no order that avoids visiting all pairs;
the blocks propose, the pivots discard.)

Pairs already known to hang together are not looked at again, and a task
returns links that span its groups, not pairs.  A group of over ``SPLIT``
fingerprints is cut into parts, and each pair of parts is a group of its own.

Null texts count as empty; documents without a word have fingerprint 0.  Every
row takes part, repeated and null ids too; a component is named by its
smallest id, null if it has none.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lanelytics.llm.common import KEY, batch_of, keyed, rows, stored
from lanelytics.llm.components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
PIVOTS = 16
#: Fingerprints that unrelated ones may leave in a group on average, and the size at which groups are cut.
CROWD, SPLIT = 64, 8192
#: Shingles whose bits are counted at a time.
_BLOCK = 1 << 16
_LONG = pa.int64()


def fingerprint(text: str) -> int:
    """64 majority bits of the XXH64 hashes of the shingles, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - SHINGLE].tolist()
    ends = ends[SHINGLE - 1 :].tolist()
    count = np.zeros(64, np.int64)
    for at in range(0, len(starts), _BLOCK):
        spans = zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK])
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(starts), bitorder="little").view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns but the text, and the fingerprint."""
    for batch in batches:
        fps = [_signed(fingerprint(text)) for part in rows([batch]) for text in part["text"]]
        yield batch.drop_columns(["text"]).append_column("fp", pa.array(fps, _LONG))


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, spread by hashing their numbers."""
    return np.array([xxhash.xxh64_intdigest(bytes([n]), SEED) for n in range(count)], np.uint64)


def block_masks(n: int, distance: int = DISTANCE, crowd: int = CROWD) -> list[int]:
    """Masks of the block choices for n fingerprints: the fewest blocks whose choices are as fine as n needs."""
    blocks = distance + 1
    while n > crowd << (64 // blocks * (blocks - distance)) and comb(blocks + 1, distance) <= 210:
        blocks += 1
    edges = [64 * b // blocks for b in range(blocks + 1)]
    masks = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(masks, blocks - distance)]


def _first_coordinate(fp: str) -> Column:
    return F.bit_count(F.col(fp).bitwiseXOR(F.lit(_signed(int(pivots(1)[0])))))


def _groups(distinct: DataFrame, masks: list[int]) -> DataFrame:
    """Rows (choice, agreed, cell, fp, near): fingerprints that share choice, agreed bits and cell form a group."""
    meet = distinct.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(mask))) for mask in masks])).alias("choice", "agreed"),
    )
    crowded = meet.groupBy("choice", "agreed").count().filter(F.col("count") > SPLIT)
    parts = F.coalesce(F.ceil(F.col("count") / SPLIT), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    return (
        meet.join(crowded, ["choice", "agreed"], "left")
        .withColumn("parts", parts)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "choice",
            "agreed",
            (F.least("own", "other") * F.col("parts") + F.greatest("own", "other")).alias("cell"),
            "fp",
            _first_coordinate("fp").alias("near"),
        )
    )


def spanning_links(group: np.ndarray, fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Positions (row, root) that span the linked rows of each group.

    Rows are in order of group and of their distance to the first pivot.
    """
    table = np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)
    root = np.arange(len(fps))

    def find(at: int) -> int:
        while root[at] != at:
            root[at] = root[root[at]]
            at = root[at]
        return at

    rows_left, step = np.arange(len(fps)), 0
    while len(rows_left):
        step += 1
        rows_left = rows_left[: np.searchsorted(rows_left, len(fps) - step)]
        ahead = rows_left + step
        near = (group[rows_left] == group[ahead]) & (table[ahead, 0] - table[rows_left, 0] <= distance)
        rows_left = rows_left[near]
        a, b = rows_left, rows_left + step
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        for coordinate in range(1, table.shape[1]):
            close = np.abs(table[a, coordinate] - table[b, coordinate]) <= distance
            a, b = a[close], b[close]
        linked = np.bitwise_count(fps[a] ^ fps[b]) <= distance
        if linked.any():
            for x, y in zip(a[linked].tolist(), b[linked].tolist()):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
            while (root[root] != root).any():
                root = root[root]
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return linked, root[linked]


def _link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of a sorted partition, several at a time; the last one waits for its remaining rows."""
    schema = pa.schema([("a", _LONG), ("b", _LONG)])
    names = ("choice", "agreed", "cell", "fp")

    def links(waiting: list[np.ndarray], final: bool) -> tuple[list[np.ndarray], pa.RecordBatch | None]:
        choice, agreed, cell, fps = waiting
        new = (np.diff(choice) != 0) | (np.diff(agreed) != 0) | (np.diff(cell) != 0)
        group = np.concatenate([[0], np.cumsum(new)])
        end = len(fps) if final else int(np.searchsorted(group, group[-1]))
        if not end:
            return waiting, None
        fp = fps[:end].view(np.uint64)
        a, b = spanning_links(group[:end], fp)
        return [x[end:] for x in waiting], batch_of(schema, fps[a], fps[b])

    waiting = [np.zeros(0, np.int64) for _ in names]
    for batch in batches:
        waiting = [
            np.concatenate([w, batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)])
            for w, n in zip(waiting, names)
        ]
        if len(waiting[0]) >= _BLOCK:
            waiting, found = links(waiting, final=False)
            if found:
                yield found
    if len(waiting[0]):
        yield links(waiting, final=True)[1]


def fingerprints(docs: DataFrame) -> DataFrame:
    """The rows with the fingerprint (fp) in place of their text."""
    plain = docs.withColumn("text", F.coalesce("text", F.lit("")))
    schema = T.StructType([*[field for field in docs.schema if field.name != "text"], T.StructField("fp", T.LongType())])
    return plain.mapInArrow(_fingerprints, schema)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between fingerprints (fp) that span everything linked directly or through others."""
    masks = block_masks(distinct.count())
    groups = _groups(distinct.select("fp"), masks).repartition("choice", "agreed", "cell")
    return groups.sortWithinPartitions("choice", "agreed", "cell", "near").mapInArrow(_link, "a long, b long")


def _rooted(classes: DataFrame) -> DataFrame:
    """The rows of classes (fp, ...) with the smallest fingerprint (root) that each reaches."""
    roots = components(fingerprint_links(classes)).withColumnRenamed("node", "fp")
    return classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; the component is its smallest id."""
    of_doc = stored(fingerprints(docs.select(F.col("doc_id").cast("long"), "text")))
    classes = stored(of_doc.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    rooted = stored(_rooted(classes))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    component = stored(rooted.join(named, "root").select("fp", "component_id"))
    return of_doc.join(component, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, with all its columns: the smallest id, then the least text hash."""
    rows = keyed(docs)
    of_doc = stored(fingerprints(rows.select(*KEY, "text")))
    first = F.min(F.struct((~F.col(f"`{KEY[0]}`")).alias("none"), F.col(f"`{KEY[1]}`").alias("id"), F.col(f"`{KEY[2]}`").alias("hash")))
    classes = stored(of_doc.groupBy("fp").agg(first.alias("first")))
    chosen = _rooted(classes).groupBy("root").agg(F.min("first").alias("first"))
    keys = chosen.select(*[value.alias(name) for value, name in zip((~F.col("first.none"), F.col("first.id"), F.col("first.hash")), KEY)])
    kept = rows.join(keys, list(KEY), "left_semi").dropDuplicates(list(KEY))
    return kept.select(*[F.col(f"`{name}`") for name in docs.columns])
