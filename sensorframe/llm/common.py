"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.session import work_dir

#: White space of the text contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_noted: list[list[str]] = []


@contextmanager
def noting() -> Iterator[list[str]]:
    """Collects the folders that ``saved`` writes meanwhile, for whoever removes them."""
    _noted.append([])
    try:
        yield _noted[-1]
    finally:
        _noted.pop()


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the cluster's shared folder and read again: cuts
    the lineage and lets several consumers share one computation."""
    spark = df.sparkSession
    path = work_dir(spark, f"llm-{name}")
    for folders in _noted:
        folders.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts as empty; other columns are left out, so
    none of them can clash with an operator's own."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


#: The column that tells the rows of a numbered table apart.
ROW = "__row"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a last column ``ROW``, different for every row, saved so that
    every reader sees the same numbers."""
    return saved(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def row_texts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text) as ``doc_texts``; row is ``ROW`` of a numbered table
    and a fresh number of any other."""
    row = F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()
    return docs.select(row.alias("row"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id's decimal text (null ids: crc of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def keep_rows(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows of a numbered table whose number is in ``keep`` (row), without the number."""
    return docs.join(keep.select(F.col("row").alias(ROW)), ROW, "left_semi").drop(ROW)


def drop_rows(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """Rows of a numbered table whose number is not in ``drop`` (row), without the number."""
    return docs.join(drop.select(F.col("row").alias(ROW)), ROW, "left_anti").drop(ROW)


class WordIds(dict):
    """Word -> 64-bit hash, computed once per distinct word of a task; emptied
    when it grows past ``limit`` words."""

    limit = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        self[word] = value
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply), element by element."""
    h = h ^ (h >> np.uint64(32))
    h = h * _ODD[4]
    h = h ^ (h >> np.uint64(29))
    h = h * _ODD[5]
    return h ^ (h >> np.uint64(32))


def shingle_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word ids."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _ODD[j % 4] + ids[j:j + n]
        h ^= h >> np.uint64(31)
    return mix64(h)


def list_column(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from one array per row."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
