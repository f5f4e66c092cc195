"""Helpers that the corpus operators share: tables, tokens, batches and written intermediate results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treescan.functions.storage import written as materialize  # noqa: F401

if TaskContext.get() is not None:  # Python workers live long: what a batch took goes back to the system
    pa.set_memory_pool(pa.system_memory_pool())

BATCH_BYTES = 4 << 20
SYMBOLS = b"#*$%&|<>"
#: A word is a run of characters other than blank and \x09-\x0D: the words of ``bytes.split()``.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
UPPER = bytes(range(65, 91))
LOWER = bytes.maketrans(UPPER, bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of_id(id_col: str) -> Column:
    """crc32 of the decimal text of an id; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def free_name(df: DataFrame, wish: str) -> str:
    """wish, with underscores until no column of df has the name in any case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, so that what a worker holds at once is bounded whatever the texts' length."""
    if as_bytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def as_bytes(size: str) -> int:
    """Bytes of a setting such as 64m or 67108864b."""
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    text = size.strip().lower().removesuffix("ib").removesuffix("b") if size.strip().lower()[-2:-1] in units else size.strip().lower()
    return int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def chunks(texts: list[bytes], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about most bytes together, one text at least: bounds what a batch builds at once."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)
