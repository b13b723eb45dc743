"""Helpers shared by the operators: reading tables, cutting lineage, walking Arrow batches."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from uuid import uuid4
from zipfile import ZipFile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows turned into Python objects at a time, so that long texts are not all held as objects at once.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Hands this package to Python workers that cannot import it, as ``--py-files`` would; once per application."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parents[1]
    name = f"{package.name}-{context.applicationId}.zip"
    if not any(path.endswith(name) for path in context._python_includes):
        archive = Path(tempfile.mkdtemp()) / name
        with ZipFile(archive, "w") as out:
            for module in sorted(package.rglob("*.py")):
                out.write(module, module.relative_to(package.parent))
        context.addPyFile(str(archive))


def whole_text(name: str = "text") -> Column:
    """The text as it is; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; a session on one machine without one gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The frame in the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written_to(df: DataFrame, name: str) -> str:
    """A new folder in the shared one that holds the frame as Parquet."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid4()}.parquet"
    df.write.parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as Parquet in the shared folder, read again."""
    return df.sparkSession.read.parquet(written_to(df, name))


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``written_to`` made and nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


#: Columns that tell documents apart where ids may be null or repeated; no column of a table has such names.
KEY = ("llm key: id known", "llm key: id", "llm key: text")


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key of id and text that is never null."""
    doc_id = F.col("doc_id").cast("long")
    values = (doc_id.isNotNull(), F.coalesce(doc_id, F.lit(0)), F.xxhash64("text"))
    return docs.withColumns(dict(zip(KEY, values)))


def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Slices of Arrow batches as lists by column name."""
    for batch in batches:
        for begin in range(0, batch.num_rows, SLICE):
            yield batch.slice(begin, SLICE).to_pydict()


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


#: Words that a worker's table keeps.
TABLE_WORDS = 400_000


class WordTable:
    """Rows of numbers of words, computed once for each word; forgets everything when full."""

    def __init__(self, compute: Callable[[list[str]], np.ndarray], limit: int = TABLE_WORDS):
        self.compute, self.limit = compute, limit
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, 0), np.float32)

    def rows_of(self, texts: list[list[str]]) -> Iterator[np.ndarray]:
        """For each text the rows of its words."""
        words = {word for text in texts for word in text}
        new = words.difference(self.known)
        if len(self.known) + len(new) > self.limit and self.known:
            self.known, new = {}, words
        if new:
            used, fresh = len(self.known), self.compute(list(new))
            self.known.update(zip(new, range(used, used + len(new))))
            if len(self.known) > len(self.table) or self.table.shape[1] != fresh.shape[1]:
                grown = np.zeros((max(2 * len(self.known), 1024), fresh.shape[1]), np.float32)
                if used:
                    grown[:used] = self.table[:used]
                self.table = grown
            self.table[used : used + len(new)] = fresh
        for text in texts:
            yield self.table[np.fromiter(map(self.known.__getitem__, text), np.int64, len(text))]
