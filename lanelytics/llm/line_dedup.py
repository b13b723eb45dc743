"""Line deduplication: lines that many documents share stay in one of them, with DataFrame functions only.

Lines are exploded and normalised to a key: white space at both ends goes and
A to Z become small.  Long keys are hashed, and the distinct documents of each
hash are counted, spread by hash and document first, so that a line of a third
of all documents shrinks to a row per task.  Lines whose key stands in
``documents`` or more of them go everywhere but in the largest id that holds
it; the places of the lines to drop are gathered by text, and the others are
joined in order again.

Keys are told apart by two independent 64-bit hashes.  Lines are matched with
the hashes to drop by a join in which a hash of many lines is dealt to several
tasks (``LINES`` lines each, or more once that gives over ``HOT`` such hashes;
these, a bounded number, are the only rows that are broadcast).

Null and empty texts are one empty line.  Documents are told apart by id; rows
without an id count as one document, which comes before any other.  A line
that a document repeats stays as often as it was where that document keeps it.
Every row gives one row, repeated ones too; other columns are ignored.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from lanelytics.llm.common import KEY, keyed, let, stored, whole_text

LEAST_CHARS, DOCUMENTS = 40, 5
WHITE = " \t\n\x0b\x0c\r"
#: Lines of a hash that a task takes, and how many hashes with more there may be.
LINES, HOT = 1_000, 10_000


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A to Z in lower case."""
    bare = F.btrim(line, F.lit(WHITE))
    plain = F.octet_length(bare) == F.char_length(bare)  # lower() changes the same letters in texts without others
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, ascii_uppercase, ascii_lowercase))


def long_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(key of the row, place, a, b): the lines of keyed docs with long keys, and both hashes of these."""
    lines = docs.select(*KEY, F.posexplode(F.split("text", "\n")).alias("place", "line"))
    long = lines.select(*KEY, "place", line_key(F.col("line")).alias("line")).filter(F.char_length("line") >= least_chars)
    return long.select(*KEY, "place", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))


def shared_hashes(lines: DataFrame, documents: int) -> DataFrame:
    """(a, b, lines, keeper): hashes in that many distinct documents, how many they are, and the largest of them."""
    document = F.struct(*[F.col(name) for name in KEY[:2]])
    by_document = lines.groupBy("a", "b", document.alias("document")).agg(F.count("*").alias("lines"))
    by_hash = by_document.groupBy("a", "b").agg(
        F.count("*").alias("n"), F.sum("lines").alias("lines"), F.max("document").alias("keeper")
    )
    return by_hash.filter(F.col("n") >= documents).drop("n")


def dropped_places(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """(key of the row, dropped): the places of the lines that go, at most once each."""
    total = shared.agg(F.sum("lines")).first()[0] or 0
    share = max(LINES, -(-total // HOT))
    parts = F.ceil(F.col("lines") / share).cast("int")
    hot = shared.filter(F.col("lines") > share).select("a", "b", parts.alias("parts"))
    part = F.pmod(F.xxhash64(*KEY, "place"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = lines.join(F.broadcast(hot), ["a", "b"], "left").select(*lines.columns, part.alias("part"))
    wanted = shared.select("a", "b", "keeper", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    elsewhere = F.struct(*[F.col(name) for name in KEY[:2]]) != F.col("keeper")
    return dealt.join(wanted, ["a", "b", "part"]).filter(elsewhere).groupBy(*KEY).agg(F.collect_set("place").alias("dropped"))


def without(text: Column, dropped: Column) -> Column:
    """The text without the lines at some places."""

    def rest(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
        return F.array_join(F.transform(places, lambda place: F.get(lines, place)), "\n")

    return F.when(dropped.isNull(), text).otherwise(let(F.split(text, "\n"), rest))


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, documents: int = DOCUMENTS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of every row of docs (doc_id, text); text is what stays."""
    docs = keyed(docs.select("doc_id", whole_text()))
    lines = long_lines(docs, least_chars)
    places = dropped_places(lines, stored(shared_hashes(lines, documents)))
    joined = docs.join(places, list(KEY), "left")
    return joined.select(
        "doc_id",
        without(F.col("text"), F.col("dropped")).alias("text"),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row of docs."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
