"""Token counts through a cache that is keyed by content and tokenizer digests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path, task_count, text_or_empty
from .tokens import TokenizerSpec, default_tokenizer, encoder

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
#: Missing digests, 32 bytes each, that are broadcast to find their texts; more are joined by a shuffle.
FEW = 200_000


class TokenCountCache:
    """An append-only Parquet table of (tokenizer digest, content digest) -> count.

    Rows that two runs append for the same content are equal, so readers take
    any of them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, tokenizer: str) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        rows = self.spark.read.schema(CACHE_SCHEMA).parquet(self.path).where(F.col("tokenizer") == tokenizer)
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame, tokenizer: str) -> None:
        counts.select(F.lit(tokenizer).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(self.path)


def _digest(col: str = "text"):
    return F.unhex(F.sha2(F.col(col).cast("binary"), 256))


def _local_distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First occurrence of each content in a batch, its text compressed for the shuffle."""
    pack = zstandard.ZstdCompressor(level=1)
    for b in batches:
        first = {d: i for i, d in reversed(list(enumerate(b.column(0).to_pylist())))}
        keep = sorted(first.values())
        texts = b.column(1)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(keep, pa.int64())), pa.array([pack.compress(texts[i].as_py().encode()) for i in keep], pa.binary())], ["digest", "packed"]
        )


def _encode_distinct(spec: TokenizerSpec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, unpack, last = encoder(spec), zstandard.ZstdDecompressor(), None
        for b in batches:
            digests, counts = [], []
            for d, packed in zip(b.column(0).to_pylist(), b.column(1)):
                if d != last:  # sorted by digest within the partition
                    last = d
                    digests.append(d)
                    counts.append(enc.count(unpack.decompress(packed.as_py()).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str | None = None, cache_path: str | None = None, limit: int = 512) -> DataFrame:
    """Count the tokens of every row of docs (doc_id, text), encoding each distinct content once.

    The content is the UTF-8 text itself, null taken as empty: any stronger
    normalisation would change counts. Digests are joined with the cache first,
    and only texts of digests that it lacks for this tokenizer file are touched
    again: they are compressed, shuffled once, sorted by digest so that a
    repeated content is met in one place, encoded, and appended. A very long
    text is encoded by one task. Equal rows each get their result, a null doc_id
    stays null, and no rows give no rows. Without ``cache_path`` a new cache in
    the shared folder is filled and used.
    """
    spark = docs.sparkSession
    spec = TokenizerSpec.from_file(tokenizer_path or default_tokenizer())
    cache = TokenCountCache(spark, cache_path or scratch_path(spark, "token-cache"))
    rows = docs.select(F.col("doc_id"), text_or_empty().alias("text")).withColumn("digest", _digest())
    contents, missing, few = rows.select("digest", "text"), None, False
    known = cache.read(spec.digest)
    if known is not None:
        missing = materialize(rows.select("digest").distinct().join(known, "digest", "left_anti"), "missing-digests")
        n = missing.count()
        few = n <= FEW
        if few:
            contents = contents.join(F.broadcast(missing), "digest", "left_semi")
    if missing is None or n:
        packed = contents.mapInArrow(_local_distinct, "digest binary, packed binary")
        if missing is not None and not few:
            packed = packed.join(missing, "digest", "left_semi")
        counts = packed.repartition(task_count(rows), "digest").sortWithinPartitions("digest").mapInArrow(_encode_distinct(spec), "digest binary, n_tokens long")
        cache.append(counts, spec.digest)
    # read back from a table: a join with an aggregate could not split a digest that many rows share
    known = materialize(cache.read(spec.digest), "known-counts")
    keyed = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return keyed.join(known, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
