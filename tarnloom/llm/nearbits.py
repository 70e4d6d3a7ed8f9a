"""Near-equality of 128-bit signatures by a table of segment chunks.

A signature is cut at fixed places into ``m`` segments. If two signatures differ
in at most ``radius`` bits, some segment i differs in at most ``radii[i]`` bits
(pigeonhole), so looking up every segment value within that distance in the
chunk table finds every pair: nothing is approximate. ``m`` is chosen from the
sizes of the two sides so that probes plus chance candidates are fewest; each
choice is complete.

A chunk travels by the upper bits of its segment value (its route). Flips among
the upper bits are probed by copies of the row, flips among the lower bits inside
the partition that receives the route, in sorted arrays. Copies of one signature
are one row; the route's bits grow with the rows. Pictures with like borders share
segments, so routes are counted first: one with more than a partition's rows is
cut into parts by the whole signature, and its probes go to each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import hex_long, with_hex
from ..functions.spread import salted_join, small

BITS = 128
ROWS_PER_PARTITION = 1_000_000
SIDE, USED, SEGMENT, PART = 38, 40, 44, 52  # bit places in a chunk: stored side, flips used on the route, segment number, part of a crowded route
MOST_PARTS = 2048
ROUTE = (1 << SIDE) - 1 | 0xFF << SEGMENT
PAIRS = 4_000_000  # candidate pairs compared at a time


def with_signature(df: DataFrame, source: str = "signature") -> DataFrame:
    """``df`` with (hi, lo) of a signature however it is written; null if missing or a placeholder."""
    return with_hex(df, source, 32, "_hex").withColumn("hi", hex_long(F.col("_hex"), 1)).withColumn("lo", hex_long(F.col("_hex"), 17)).drop("_hex")


def segments(m: int, radius: int) -> list[tuple[int, int, int]]:
    """(first bit, width, radius) of each of m segments; a radius below 0 needs no probe."""
    each, rest = divmod(radius, m)
    out, at = [], 0
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        out.append((at, width, each if i <= rest else each - 1))
        at += width
    return out


def plan(radius: int, indexed: int, probing: int) -> int:
    """The number of segments with the least estimated work for these many distinct signatures."""

    def work(m: int) -> float:
        total = 0.0
        for _, width, r in segments(m, radius):
            if r >= 0:
                probes = sum(comb(width, k) for k in range(r + 1))
                total += indexed + probing * probes * (1 + indexed / 2.0**width)
        return total

    return min(range(ceil(BITS / 38), BITS // 8 + 1), key=work)


def route_bits(m: int, partitions: int) -> int:
    """Upper bits that make a route: at least 16 routes for each partition, as far as the
    narrowest segment goes."""
    return min(BITS // m - 2, max(4, ceil(log2(16 * partitions / m))))


def _cut(hi: Column, lo: Column, at: int, width: int) -> Column:
    end = at + width
    mask = F.lit((1 << width) - 1)
    if end <= 64:
        return F.shiftrightunsigned(hi, 64 - end).bitwiseAND(mask)
    low = F.shiftrightunsigned(lo, 128 - end)
    if at < 64:
        low = F.shiftleft(hi, end - 64).bitwiseOR(low)
    return low.bitwiseAND(mask)


def _route(i: int, at: int, bits: int) -> Column:
    return F.lit(i << SEGMENT).bitwiseOR(_cut(F.col("hi"), F.col("lo"), at, bits))


def chunk_table(signatures: DataFrame, m: int, radius: int, bits: int) -> DataFrame:
    """(chunk, hi, lo): which signatures have which routes; the stored side."""
    keys = [_route(i, at, bits).bitwiseOR(F.lit(1 << SIDE)) for i, (at, _, r) in enumerate(segments(m, radius)) if r >= 0]
    return signatures.select(F.explode(F.array(*keys)).alias("chunk"), "hi", "lo")


def probes(signatures: DataFrame, m: int, radius: int, bits: int) -> DataFrame:
    """(chunk, hi, lo): every route within each segment's radius, with the flips it took."""

    def within(i: int, at: int, r: int) -> Column:
        masks = [sum(1 << b for b in flip) | k << USED for k in range(min(r, bits) + 1) for flip in combinations(range(bits), k)]
        own = _route(i, at, bits)
        return F.transform(F.lit(masks).cast("array<bigint>"), lambda mask: own.bitwiseXOR(mask))

    lists = [within(i, at, r) for i, (at, _, r) in enumerate(segments(m, radius)) if r >= 0]
    return signatures.select(F.explode(F.concat(*lists)).alias("chunk"), "hi", "lo")


def _values(hi: np.ndarray, lo: np.ndarray, at: int, width: int) -> np.ndarray:
    end = at + width
    mask = np.uint64((1 << width) - 1)
    if end <= 64:
        return (hi >> np.uint64(64 - end)) & mask
    low = lo >> np.uint64(128 - end)
    if at < 64:
        low = (hi << np.uint64(end - 64)) | low
    return low & mask


def _meet(chunk: np.ndarray, hi: np.ndarray, lo: np.ndarray, m: int, radius: int, bits: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of a partition's probe and stored rows within the radius, segment by segment."""
    stored = (chunk >> np.int64(SIDE)) & 1 == 1
    segment = (chunk >> np.int64(SEGMENT)) & 0xFF
    used = (chunk >> np.int64(USED)) & 0xF
    upper = chunk & np.int64((1 << bits) - 1)
    part = ((chunk >> np.int64(PART)) & (MOST_PARTS - 1)).astype(np.uint64) << np.uint64(PART)
    for i, (at, width, r) in enumerate(segments(m, radius)):
        s, p = np.nonzero(stored & (segment == i))[0], np.nonzero(~stored & (segment == i))[0]
        if r < 0 or not len(s) or not len(p):
            continue
        low = width - bits
        values = _values(hi[s], lo[s], at, width) | part[s]
        order = np.argsort(values, kind="stable")
        s, values = s[order], values[order]
        own = (_values(hi[p], lo[p], at, width) & np.uint64((1 << low) - 1)) | (upper[p].astype(np.uint64) << np.uint64(low)) | part[p]
        for k in range(min(r, low) + 1):
            able = used[p] <= r - k
            q, start = p[able], own[able]
            for flip in combinations(range(low), k):
                want = start ^ np.uint64(sum(1 << b for b in flip))
                left = np.searchsorted(values, want, "left")
                hit = np.nonzero((left < len(values)) & (values[np.minimum(left, len(values) - 1)] == want))[0]
                if not len(hit):
                    continue
                n = np.searchsorted(values, want[hit], "right") - left[hit]
                for some in np.split(np.arange(len(hit)), np.searchsorted(np.cumsum(n), np.arange(PAIRS, n.sum(), PAIRS))):
                    own_n = n[some]
                    a = np.repeat(q[hit[some]], own_n)
                    b = s[np.repeat(left[hit[some]] - np.cumsum(own_n) + own_n, own_n) + np.arange(own_n.sum())]
                    high, low_ = hi[a] ^ hi[b], lo[a] ^ lo[b]
                    gap = np.bitwise_count(high) + np.bitwise_count(low_)
                    near = gap <= radius
                    # a pair that meets in several segments is given in the first of them
                    for at_, width_, r_ in segments(m, radius)[:i]:
                        near &= np.bitwise_count(_values(high, low_, at_, width_)) > max(r_, -1)
                    if near.any():
                        yield hi[a[near]], lo[a[near]], hi[b[near]], lo[b[near]], BITS - gap[near].astype(np.int32)


def crowded(indexed: DataFrame, m: int, radius: int, bits: int, most: int) -> DataFrame:
    """(route, parts): routes that more than ``most`` stored rows have, and into how many parts they are cut."""
    own = [(i, at) for i, (at, _, r) in enumerate(segments(m, radius)) if r >= 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(own), 1 << bits), np.int64)
        for batch in batches:
            hi, lo = (np.asarray(batch.column(k)).view(np.uint64) for k in (0, 1))
            for k, (_, at) in enumerate(own):
                total[k] += np.bincount(_values(hi, lo, at, bits).astype(np.int64), minlength=1 << bits)
        k, upper = np.nonzero(total)
        number = np.array([i for i, _ in own], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((number[k] << SEGMENT) | upper), pa.array(total[k, upper])], ["route", "n"])

    loads = indexed.select("hi", "lo").mapInArrow(run, "route long, n long").groupBy("route").agg(F.sum("n").alias("n"))
    return loads.where(F.col("n") > most).select("route", F.least(F.lit(MOST_PARTS), F.ceil(F.col("n") / most)).cast("int").alias("parts"))


def parted(stored: DataFrame, probing: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored and probe rows with the part of a crowded route in their chunk; probes go to every part."""
    mark = small(hot)
    parts = F.coalesce("parts", F.lit(1))
    route = F.col("chunk").bitwiseAND(F.lit(ROUTE))
    put = lambda df, part: df.join(mark, route == F.col("route"), "left").withColumn("_part", part).select(F.col("chunk").bitwiseOR(F.expr(f"shiftleft(CAST(_part AS BIGINT), {PART})")).alias("chunk"), "hi", "lo")
    return put(stored, F.pmod(F.xxhash64("hi", "lo"), parts).cast("int")), put(probing, F.explode(F.sequence(F.lit(0), parts - 1)))


def meet(probing: DataFrame, stored: DataFrame, m: int, radius: int, bits: int, partitions: int) -> DataFrame:
    """(p_hi, p_lo, i_hi, i_lo, shared): pairs of probe rows and chunk-table rows that share
    at least 128 - radius bits, each pair once."""
    route = F.col("chunk").bitwiseAND(F.lit(ROUTE | (MOST_PARTS - 1) << PART))
    names = ["p_hi", "p_lo", "i_hi", "i_lo", "shared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = list(batches)
        if not whole:
            return
        chunk, hi, lo = (np.concatenate([np.asarray(b.column(i)) for b in whole]) for i in range(3))
        whole.clear()
        for found in _meet(chunk, hi.view(np.uint64), lo.view(np.uint64), m, radius, bits):
            columns = [pa.array(x.view(np.int64)) for x in found[:4]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found[4])], names)

    rows = probing.union(stored).repartition(partitions, route)
    return rows.mapInArrow(run, "p_hi long, p_lo long, i_hi long, i_lo long, shared int")


def near(probing: DataFrame, indexed: DataFrame, radius: int, most: int = ROWS_PER_PARTITION) -> DataFrame:
    """(p_hi, p_lo, i_hi, i_lo, shared) for two tables of (hi, lo); a pair comes as often as
    its rows do."""
    n, q = indexed.count(), probing.count()
    m = plan(radius, n, q)
    least = int(probing.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = route_bits(m, max(least, ceil(n * m / most)))
    copies = sum(sum(comb(bits, k) for k in range(r + 1)) for _, _, r in segments(m, radius) if r >= 0)
    partitions = max(least, ceil((n * m + q * copies) / most))
    stored, probe = chunk_table(indexed, m, radius, bits), probes(probing, m, radius, bits)
    hot = crowded(indexed, m, radius, bits, most)
    if hot.take(1):
        stored, probe = parted(stored, probe, hot)
    return meet(probe, stored, m, radius, bits, partitions)


def expand(links: DataFrame, left: DataFrame, right: DataFrame, block: int) -> DataFrame:
    """``links`` (p_hi, p_lo, i_hi, i_lo, ...) with the rows of ``left`` that have the p
    signature and those of ``right`` that have the i signature (both by hi, lo; other
    columns of different names). Signatures that many rows have are cut into blocks."""
    side = lambda df, mark: df.withColumnsRenamed({"hi": f"{mark}_hi", "lo": f"{mark}_lo"})
    p, i = ["p_hi", "p_lo"], ["i_hi", "i_lo"]
    count = lambda df, mark: side(df.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n")), mark)
    own = count(left, "p")
    partners = links.groupBy(*p).agg(F.count(F.lit(1)).alias("m"))
    reached = links.join(own, p).groupBy(*i).agg(F.sum("n").alias("m"))
    half = salted_join(links, side(left, "p"), p, own.join(partners, p), block)
    return salted_join(half, side(right, "i"), i, count(right, "i").join(reached, i), block)
