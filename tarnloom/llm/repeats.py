"""Deduplicating new batches against all history.

A record is a 32-byte content digest and a 128-bit picture signature. Records
are cut into chunks and kept in a persistent chunk-to-record table
(``ChunkStore``); an arriving batch is appended to it and joined with it, shared
bytes (or bits) are totalled per pair of records, and the share of the record
that is covered decides. History is written once and never built again.

* Digests are cut by content: a polynomial rolling hash over ``WINDOW`` bytes
  ends a chunk wherever its value is divisible by ``DIVISOR``. Records are the
  same when the shared chunks cover all 32 bytes; their digests are compared
  afterwards.
* Signatures are cut at fixed places (see ``nearbits``): flipped bits never move
  a boundary, and ten scattered flips leave no rolling window whole, so content
  boundaries would miss pairs. A pair is near-same when at least
  128 - ``radius`` bits are shared.

Equal records of one delivery are one class, so a picture that fills a third of
the history is one row of the chunk table; classes are expanded to record pairs
at the end, with hot classes cut into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import kept, with_hex
from ..functions.spread import cut, lookup, salted_join, scratch, small
from . import nearbits

RADIUS = 10
WINDOW, DIVISOR, LEAST = 2, 11, 6
BLOCK = 50_000
DIGEST_BYTES = 32


def chunk_bounds(data: np.ndarray) -> list[np.ndarray]:
    """Content-defined bounds of rows of DIGEST_BYTES bytes, as a list over k of each
    row's k-th bound (DIGEST_BYTES once a row has no more).

    A bound before byte i needs the rolling value of the WINDOW bytes before it,
    times an odd constant, to have upper bits divisible by DIVISOR, and LEAST
    bytes since the bound before and up to the end.
    """
    rolling = np.zeros(data.shape, np.uint64)
    for back in range(WINDOW, 0, -1):
        rolling[:, WINDOW:] = rolling[:, WINDOW:] * np.uint64(256) + data[:, WINDOW - back : data.shape[1] - back]
    ends = (rolling * np.uint64(40503) >> np.uint64(4)) % np.uint64(DIVISOR) == 0
    last, rank = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
    bounds = [last.copy()] + [np.full(len(data), DIGEST_BYTES) for _ in range(DIGEST_BYTES // LEAST + 1)]
    for i in range(LEAST, DIGEST_BYTES - LEAST + 1):
        at = np.nonzero(ends[:, i] & (i - last >= LEAST))[0]
        last[at] = i
        rank[at] += 1
        for k in np.unique(rank[at]):
            rows = at[rank[at] == k]
            bounds[k][rows] = i
    return bounds


def content_chunks(classes: DataFrame) -> DataFrame:
    """(delivery, chunk, bytes, record, many, digest): the content-defined chunks of rows
    (delivery, digest, record, many); a record's first chunk carries its digest.

    A chunk is a 64-bit hash of its bytes, its length and its offset (digests
    have a fixed layout); the bytes are hashed as a polynomial over the ring of
    64-bit integers and mixed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, DIGEST_BYTES)
            # prefix values make any chunk's polynomial a difference
            power = np.cumprod(np.full(DIGEST_BYTES + 1, 1099511628211, np.uint64))
            prefix = np.concatenate([np.zeros((len(data), 1), np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:DIGEST_BYTES], axis=1, dtype=np.uint64)], axis=1)
            bounds, row = chunk_bounds(data), np.arange(len(data))
            for k, (start, end) in enumerate(zip(bounds, bounds[1:])):
                some = np.nonzero(start < DIGEST_BYTES)[0]
                if not len(some):
                    break
                x = prefix[row[some], end[some]] - prefix[row[some], start[some]]
                x ^= (start[some].astype(np.uint64) << np.uint64(8)) + end[some].astype(np.uint64)
                x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(29)
                at = pa.array(some)
                delivery, digest, record, many = (c.take(at) for c in batch.columns)
                yield pa.RecordBatch.from_arrays(
                    [delivery, pa.array(x.view(np.int64)), pa.array((end[some] - start[some]).astype(np.int32)), record, many, digest if k == 0 else pa.nulls(len(some), pa.binary())],
                    ["delivery", "chunk", "bytes", "record", "many", "digest"],
                )

    return classes.select("delivery", "digest", "record", "many").mapInArrow(run, "delivery string, chunk long, bytes int, record long, many boolean, digest binary")


def arrivals(images: DataFrame, new_batches: DataFrame, *columns: str) -> DataFrame:
    """(image_id, batch, seq, *columns): seq is the arrival number, 0 for accepted history.

    Images without an id are left out; null batches are a batch of their own.
    """
    number = new_batches.where("image_batch_id is not null").groupBy("image_batch_id").agg(F.min(F.coalesce("arrival_no", F.lit(1))).cast("int").alias("_no"))
    own = images.where("id is not null").select(F.col("id").alias("image_id"), "image_batch_id", *columns)
    return own.join(small(number), "image_batch_id", "left").select("image_id", F.coalesce("image_batch_id", F.lit(-1)).alias("batch"), F.coalesce("_no", F.lit(0)).alias("seq"), *columns)


TABLES = {
    "content": "chunk long, bytes int, record long, many boolean, digest binary",
    "members": "digest binary, image_id long, batch long, seq int",
    "marks": "hi long, lo long, many boolean",
    "signatures": "hi long, lo long, image_id long, batch long, seq int",
}
BUCKET_ROWS = 250_000


class ChunkStore:
    """The persistent chunk-to-record tables under ``path``, on any Hadoop file system.

    ``append`` adds deliveries, each once; ``pairs`` joins deliveries with all that
    is stored. What a delivery wrote is never read as a whole again: the content
    and member tables lie in buckets by chunk, digest and signature, as many for a
    delivery as its rows need (``bucket_rows`` each), and a probe reads the buckets
    it hits, so what a small arrival reads does not grow with the history. Near
    signatures need all distinct stored signatures, 16 bytes each: every route is
    within reach of any arrival of some thousand records, so an index by route
    would be read as a whole, at several times the bytes.

    A delivery counts from the moment its marker is created, after its rows; files
    of an append that failed are removed by the next one, and a delivery that is
    stored already is left as it is.
    """

    def __init__(self, spark: SparkSession, path: str, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.radius, self.bucket_rows = spark, path.rstrip("/"), radius, bucket_rows
        self.jvm = spark.sparkContext._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def deliveries(self) -> dict[str, int]:
        """The stored deliveries and their numbers of buckets."""
        there = self._at("stored")
        names = [x.getPath().getName() for x in self.fs.listStatus(there)] if self.fs.exists(there) else []
        return {key: int(buckets) for key, _, buckets in (n.rpartition("@") for n in names)}

    def append(self, digests: DataFrame, marks: DataFrame, sizes: dict[str, int]) -> list[str]:
        """Adds rows digests (delivery, image_id, batch, seq, digest) and marks (delivery,
        image_id, batch, seq, hi, lo) of the deliveries in ``sizes`` (about how many rows
        each has); gives the deliveries that were new."""
        stored = self.deliveries()
        buckets = {key: max(1, ceil(n / self.bucket_rows)) for key, n in sizes.items() if key not in stored}
        if not buckets:
            return []
        if bad := [key for key in buckets if not key.replace("-", "").isalnum()]:
            raise ValueError(f"not the name of a delivery: {bad[0]!r}")
        for table in TABLES:
            for key in buckets:
                self.fs.delete(self._at(table, f"delivery={key}"), True)
        of = F.create_map(*[F.lit(x) for pair in buckets.items() for x in pair])

        def write(table: str, rows: DataFrame, by: Column) -> DataFrame:
            placed = rows.where(F.col("delivery").isin(*buckets)).withColumn("bucket", F.pmod(by, of[F.col("delivery")]).cast("int"))
            # a bucket that one picture fills is written by several tasks
            placed.hint("rebalance", "delivery", "bucket").write.mode("append").partitionBy("delivery", "bucket").parquet(f"{self.path}/{table}")
            return self._read(table, list(buckets))

        members = write("members", digests.select("delivery", "digest", "image_id", "batch", "seq"), F.xxhash64("digest"))
        classes = members.groupBy("delivery", "digest").agg(F.min("image_id").alias("record"), (F.min("batch") != F.max("batch")).alias("many"))
        write("content", content_chunks(classes), F.col("chunk"))
        signed = write("signatures", marks.select("delivery", "hi", "lo", "image_id", "batch", "seq"), F.xxhash64("hi", "lo"))
        write("marks", signed.groupBy("delivery", "hi", "lo").agg((F.min("batch") != F.max("batch")).alias("many")), F.xxhash64("hi", "lo"))
        for key, n in buckets.items():
            self.fs.create(self._at("stored", f"{key}@{n}"), False).close()
        return list(buckets)

    def _read(self, table: str, keys: list[str]) -> DataFrame:
        schema = f"{TABLES[table]}, delivery string, bucket int"
        there = [k for k in keys if self.fs.exists(self._at(table, f"delivery={k}"))]
        if not there:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/delivery={k}" for k in there])

    def hit(self, table: str, probes: DataFrame, by: Column) -> DataFrame:
        """The stored rows of the buckets that the probes' keys fall into."""
        stored = self.deliveries()
        counts = sorted(set(stored.values()))
        found = probes.agg(*[F.collect_set(F.pmod(by, F.lit(n)).cast("int")) for n in counts]).first()  # bucket numbers
        rows = self._read(table, list(stored))
        conditions = []
        for n, numbers in zip(counts, found):
            own = F.col("delivery").isin(*[k for k, v in stored.items() if v == n])
            conditions.append(own if len(numbers) == n else own & F.col("bucket").isin(*sorted(numbers)))
        return rows.where(reduce(lambda a, b: a | b, conditions))

    def same(self, keys: list[str]) -> DataFrame:
        """(digest) of records of the deliveries whose bytes are covered by the chunks of a
        record of another delivery, or that have members in several batches of their own."""
        fresh = self._read("content", keys)
        new = fresh.select("chunk", F.col("delivery").alias("delivery_new"), F.col("record").alias("record_new"), "many")
        old = self.hit("content", fresh, F.col("chunk")).select("chunk", "bytes", F.col("delivery").alias("delivery_old"), F.col("record").alias("record_old"))
        shared = new.join(old, "chunk").groupBy("delivery_new", "record_new", "delivery_old", "record_old").agg(F.sum("bytes").alias("bytes"), F.max("many").alias("many"))
        own = (F.col("delivery_new") == F.col("delivery_old")) & (F.col("record_new") == F.col("record_old"))
        covered = shared.where((F.col("bytes") >= DIGEST_BYTES) & (~own | F.col("many"))).select(F.col("delivery_new").alias("delivery"), F.col("record_new").alias("record")).distinct()
        return fresh.where("digest is not null").join(covered, ["delivery", "record"]).select("digest").distinct()

    def near(self, keys: list[str]) -> DataFrame:
        """(p_hi, p_lo, i_hi, i_lo): signatures of the deliveries and stored ones that share at least
        128 - radius bits; a signature with itself where several batches or deliveries have it."""
        fresh = self._read("marks", keys)
        pairs = ["p_hi", "p_lo", "i_hi", "i_lo"]
        links = nearbits.near(fresh.select("hi", "lo"), self._read("marks", list(self.deliveries())).select("hi", "lo"), self.radius)
        own = (F.col("p_hi") == F.col("i_hi")) & (F.col("p_lo") == F.col("i_lo"))
        links = links.groupBy(*pairs).agg(F.count(F.lit(1)).alias("n")).where(~own | (F.col("n") > 1)).select(*pairs)
        spans = fresh.where("many").select(F.col("hi").alias("p_hi"), F.col("lo").alias("p_lo"), F.col("hi").alias("i_hi"), F.col("lo").alias("i_lo"))
        return links.union(spans).distinct()

    def pairs(self, keys: list[str], block: int = BLOCK) -> DataFrame:
        """(image_id_a, image_id_b), a < b: images of the deliveries that arrived (seq above 0)
        and the same or near-same stored ones of other batches that were there before or with them."""
        arrived = F.col("delivery").isin(*keys) & (F.col("seq") > 0)
        heads = cut(self.same(keys), "heads")
        members = cut(lookup(heads, self.hit("members", heads, F.xxhash64("digest")), ["digest"], block), "members")
        hot = members.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.count_if(arrived).alias("m"))
        old = members.select("digest", F.col("image_id").alias("y"), F.col("batch").alias("y_batch"), F.col("seq").alias("y_seq"))
        copies = _ordered(salted_join(members.where(arrived).drop("delivery", "bucket"), old, ["digest"], hot, block))
        links = cut(self.near(keys), "links")
        touched = cut(links.select(F.col("p_hi").alias("hi"), F.col("p_lo").alias("lo")).union(links.select("i_hi", "i_lo")).distinct(), "touched")
        signed = cut(lookup(touched, self.hit("signatures", touched, F.xxhash64("hi", "lo")), ["hi", "lo"], block), "signed")
        x = signed.where(arrived).select("hi", "lo", "image_id", "batch", "seq")
        y = signed.select("hi", "lo", F.col("image_id").alias("y"), F.col("batch").alias("y_batch"), F.col("seq").alias("y_seq"))
        near = _ordered(nearbits.expand(links, x, y, block))
        return copies.union(near).distinct()


def _ordered(both: DataFrame) -> DataFrame:
    """(image_id_a, image_id_b) of rows (image_id, batch, seq, y, y_batch, y_seq): an arrival with what
    came earlier. Two arrivals of one number meet from both sides, other pairs from one."""
    found = both.where((F.col("batch") != F.col("y_batch")) & (F.col("y_seq") <= F.col("seq")))
    return found.select(F.least("image_id", "y").alias("image_id_a"), F.greatest("image_id", "y").alias("image_id_b"))


def find_repeats(images: DataFrame, signatures: DataFrame, new_batches: DataFrame, radius: int = RADIUS, block: int = BLOCK, store: ChunkStore | None = None) -> DataFrame:
    """(image_id_a, image_id_b), a < b: pairs of same or near-same images of
    different batches of which at least one arrived in ``new_batches``.

    Each arrival is a delivery to the store, accepted batches are the delivery
    ``history``; what the store has already is not read again and may be missing
    from the tables. All arrivals are probed together: a record matches only what
    has a smaller arrival number (or the same number, in another batch), which is
    what checking and appending batch by batch gives. Missing hashes and
    placeholders match nothing; an image with several signatures has each of them.
    Empty inputs give no rows. Without ``store`` the tables go to a scratch folder.
    """
    spark = images.sparkSession
    store = store or ChunkStore(spark, scratch(spark, "chunks"), radius)
    delivery = F.when(F.col("seq") > 0, F.concat(F.lit("arrival-"), F.col("seq"))).otherwise("history")
    every = arrivals(images, new_batches, "blake3_hash").withColumn("delivery", delivery)
    sizes = {r[0]: r[1] for r in every.groupBy("delivery").count().collect()}  # a row for each arrival number
    known = store.deliveries()
    fresh = every.where(~F.col("delivery").isin(*known)) if known else every
    digests = kept(with_hex(fresh, "blake3_hash", 64, "_hex"), "_hex").select("delivery", "image_id", "batch", "seq", F.unhex("_hex").alias("digest"))
    marks = kept(nearbits.with_signature(signatures.select("image_id", "signature")), "image_id", "hi", "lo").select("image_id", "hi", "lo").distinct()
    marks = marks.join(fresh.select("delivery", "image_id", "batch", "seq"), "image_id")
    store.append(digests, marks, sizes)
    keys = [k for k in sizes if k != "history"]
    return store.pairs(keys, block) if keys else spark.createDataFrame([], "image_id_a long, image_id_b long")
