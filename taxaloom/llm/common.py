"""Helpers shared by the operators: table reading, blocks of documents, intermediate tables, word hashes."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaloom.session import shared_folder

# Bytes of text in one block. A task holds one block at a time, whatever the size of the corpus.
BLOCK_BYTES = 12 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """df written to the folder that all executors share, and read back: lineage ends here."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of about block_bytes of text that docs need, from one pass over the text lengths."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(6, -(-total // block_bytes))


def with_block(docs: DataFrame, blocks: int) -> DataFrame:
    """block, doc_id, text. Rows without a doc_id spread by their text."""
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    return docs.select(block.alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text")


class Blocks:
    """Documents written once as a table bucketed by block.

    Grouping or co-grouping it by block needs no shuffle of the texts, so an operator can pass over
    them several times. ``drop`` takes the table out of the catalog. With ``encode`` and its schema (which
    has block) the table holds what encode makes of each block instead.
    """

    def __init__(self, docs: DataFrame, block_bytes: int = BLOCK_BYTES, encode=None, schema: str = ""):
        spark = docs.sparkSession
        self.count = block_count(docs, block_bytes)
        self.name = f"llm_blocks_{uuid.uuid4().hex}"
        rows = with_block(docs, self.count).repartition(self.count, "block")
        if encode is not None:
            rows = rows.groupBy("block").applyInArrow(encode, schema)
        (
            rows.write.bucketBy(self.count, "block")
            .option("path", shared_folder(spark, "blocks"))
            .option("compression", "zstd")
            .saveAsTable(self.name)
        )
        self.frame = spark.table(self.name)
        self.names = [self.name]

    def beside(self, rows: DataFrame, purpose: str) -> DataFrame:
        """Rows with a block, as a table in the same buckets: joining it with the blocks moves neither."""
        spark, name = rows.sparkSession, f"{self.name}_{purpose}"
        (
            rows.repartition(self.count, "block")
            .write.bucketBy(self.count, "block")
            .option("path", shared_folder(spark, purpose))
            .option("compression", "zstd")
            .saveAsTable(name)
        )
        self.names.append(name)
        return spark.table(name)

    def drop(self) -> None:
        """Takes the tables out of the catalog. Their files stay in the shared folder."""
        for name in self.names:
            self.frame.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def forget_shuffles(spark: SparkSession) -> None:
    """Has shuffle files of jobs that nothing refers to removed now, not at the driver's next collection of garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus. NULL ids count as the empty text."""
    text = F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, NULL as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batch_rows(
    batches: Iterator[pa.RecordBatch], *names: str
) -> Iterator[tuple[pa.RecordBatch, list[list]]]:
    """Each batch with the named columns as lists; text columns as bytes."""
    for batch in batches:
        yield batch, [
            texts(batch[n]) if pa.types.is_string(batch[n].type) or pa.types.is_large_string(batch[n].type)
            else batch[n].to_pylist()
            for n in names
        ]


class WordHashes(dict):
    """64-bit hashes of words, each computed once. Forgets all when it holds too many."""

    LIMIT = 1_000_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, length: int, multiplier: int) -> np.ndarray:
    """A hash of every run of length numbers, from prefix sums modulo 2**64. multiplier is odd."""
    n = len(hashes) - length + 1
    if n < 1:
        return np.empty(0, np.uint64)
    powers, inverse = _powers(len(hashes), multiplier), _powers(n, pow(multiplier, -1, 2**64))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers, out=sums[1:])
    return mix((sums[length:] - sums[:n]) * inverse)


_KEPT: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    have = _KEPT.get(base)
    if have is None or len(have) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _KEPT[base] = have = np.multiply.accumulate(have)
    return have[:n]


def signed(keys: np.ndarray) -> pa.Array:
    """Unsigned 64-bit keys as the longs Spark knows."""
    return pa.array(keys.view(np.int64))
