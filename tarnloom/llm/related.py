"""Splits that keep related records together.

Images of one subject and images joined by lineage form components. Subjects are
contracted first (one node for each, its smallest image), so the iterative part
runs on the lineage edges alone: alternating large-star and small-star rounds,
each written to the shared folder.

For the split, the histogram of component sizes (distinct sizes, not
components) goes to the driver. Largest differencing fills many equal bins: what
each size has beyond full rounds of the bins is combined by repeatedly merging
the two partitions of the largest difference, heavy bins of one onto light bins
of the other; the full rounds are then dealt so that the bins level. Whole bins
are given to splits by target share. Components find their bin by
their position in their size class, which is numbered without gathering it.
"""

from __future__ import annotations

import heapq
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import kept, with_subject
from ..functions.spread import cut, ranked, salted_join, small

BINS = 200
BLOCK = 50_000


def stars(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, root): connected components of (a, b), root the smallest node.

    Large-star and small-star rounds until the edges stay the same; every round
    is cut, so a lost executor costs one round at most. A node with many edges, as
    every root of a large component becomes, is cut into blocks of them.
    """
    own = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    number = own.count()
    mark = None
    while True:
        # no node can have more than a block of edges where there are no more in all
        hot = 2 * number > block
        kept = cut if hot else lambda df, name: df

        def with_least(rows: DataFrame, least: DataFrame, hot: bool = hot) -> DataFrame:
            return salted_join(least.select("a", "m"), rows, ["a"], least.select("a", "n"), block) if hot else rows.join(least.select("a", "m"), "a")

        both = own.union(own.select("b", "a"))
        low = kept(both.groupBy("a").agg(F.min("b").alias("_m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "_m").alias("m"), "n"), "low")
        large = with_least(both, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = kept(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), "down")
        least = kept(down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        joined = with_least(down, least)
        small_star = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        own = cut(small_star.where("a <> b").distinct(), "edges")
        now = own.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return own.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
        mark, number = now, now[0]


def _subjects(subjects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(image_id, subject) with one subject for each image; (subject, rep, n) with the smallest
    image of each and the number of images it is the one of; edges between subjects of one image."""
    rows = kept(with_subject(subjects.select("image_id", "subject_id"), "subject_id", "subject"), "subject", "image_id").select("image_id", "subject").distinct()
    rows = cut(rows, "subjects")
    own = rows.groupBy("image_id").agg(F.min("subject").alias("subject"), F.max("subject").alias("_other"))
    extra = own.where("subject <> _other").select("image_id").join(rows, "image_id").join(own.select("image_id", F.col("subject").alias("_own")), "image_id").where("subject <> _own")
    count = own.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    reps = rows.groupBy("subject").agg(F.min("image_id").alias("rep")).join(count, "subject", "left").select("subject", "rep", F.coalesce("n", F.lit(0)).alias("n"))
    reps = cut(reps, "reps")
    pairs = extra.select("subject", "_own").distinct().join(reps.select("subject", F.col("rep").alias("a")), "subject").join(reps.select(F.col("subject").alias("_own"), F.col("rep").alias("b")), "_own")
    return own.select("image_id", "subject"), reps, pairs.select("a", "b")


def groups(subjects: DataFrame, lineage: DataFrame, block: int = BLOCK) -> DataFrame:
    """(image_id, group_image_id, members): every image that is related to another one.

    Null ids, edges from an image to itself and repeated rows relate nothing.
    """
    own, reps, extra = _subjects(subjects)
    edges = lineage.where("parent_image_id is not null and child_image_id is not null and parent_image_id <> child_image_id").select("parent_image_id", "child_image_id").distinct()
    # lineage between the subjects' nodes
    ends = edges.select(F.col("parent_image_id").alias("image_id")).union(edges.select("child_image_id")).distinct().join(own, "image_id", "left")
    known = salted_join(reps.select("subject", "rep"), ends.where("subject is not null"), ["subject"], reps.select("subject", "n"), block).select("image_id", F.col("rep").alias("node"))
    nodes = cut(known.union(ends.where("subject is null").select("image_id", F.col("image_id").alias("node"))), "nodes")
    lifted = edges.join(nodes.select(F.col("image_id").alias("parent_image_id"), F.col("node").alias("a")), "parent_image_id").join(nodes.select(F.col("image_id").alias("child_image_id"), F.col("node").alias("b")), "child_image_id")
    parts = stars(lifted.select("a", "b").union(extra), block)
    # roots of subjects and of images without one
    rooted = reps.join(parts, reps.rep == parts.node, "left").select("subject", "n", F.coalesce("root", "rep").alias("root"))
    alone = nodes.where("image_id = node").select("image_id").join(own.select("image_id"), "image_id", "left_anti").join(parts, F.col("image_id") == F.col("node"), "left").select("image_id", F.coalesce("root", "image_id").alias("root"))
    size = rooted.select("root", "n").union(alone.select("root", F.lit(1).cast("long"))).groupBy("root").agg(F.sum("n").alias("members")).where("members > 1")
    chosen = rooted.join(size, "root").where("n > 0").select("subject", "root", "members")
    named = salted_join(chosen, own, ["subject"], reps.select("subject", "n"), block).select("image_id", "root", "members")
    return named.union(alone.join(size, "root").select("image_id", "root", "members")).select("image_id", F.col("root").alias("group_image_id"), "members")


def level(weights: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` components of one size each bin takes so that the bins end as
    level as they can: all bins rise to one height, the last few go to the lightest."""
    low, high = min(weights), max(weights) + size * (count // len(weights) + 1)
    while low < high:
        mid = (low + high + 1) // 2
        if sum(max(0, mid - w) // size for w in weights) <= count:
            low = mid
        else:
            high = mid - 1
    take = [max(0, low - w) // size for w in weights]
    for i in sorted(range(len(weights)), key=lambda i: weights[i] + size * take[i])[: count - sum(take)]:
        take[i] += 1
    return take


def difference(sizes: dict[int, int], bins: int) -> list[Counter]:
    """Largest differencing: ``bins`` counters size -> components with nearly equal weights.

    What each size has beyond full rounds of the bins is differenced. A full round of
    one size, combined with itself, leaves no difference, and onto a partition with
    one it goes where differencing puts single components, on the lightest bins; so
    full rounds, large sizes first, are dealt all at once where they level the bins.
    """
    heap, number = [], 0
    for s in sorted(sizes):
        for _ in range(sizes[s] % bins):
            # a partition: weights in falling order with their contents
            heap.append((-s, number, [(s, Counter({s: 1}))] + [(0, Counter())] * (bins - 1)))
            number += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda t: -t[0])
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], number, merged))
        number += 1
    out = heap[0][2] if heap else [(0, Counter())] * bins
    weights, held = [w for w, _ in out], [Counter(c) for _, c in out]
    for s in sorted(sizes, reverse=True):
        for i, n in enumerate(level(weights, s, sizes[s] // bins * bins)):
            if n:
                held[i][s] += n
                weights[i] += s * n
    return held


def allocate(bins: list[Counter], shares: list[float]) -> list[int]:
    """The split of each bin: heavy bins first, each to the split that lacks most."""
    weights = [sum(s * n for s, n in b.items()) for b in bins]
    total, whole = sum(weights), sum(shares) or 1.0
    lack = [total * x / whole for x in shares]
    out = [0] * len(bins)
    for i in sorted(range(len(bins)), key=lambda i: -weights[i]):
        best = max(range(len(lack)), key=lambda k: (lack[k], -k))
        lack[best] -= weights[i]
        out[i] = best
    return out


def splits(images: DataFrame, subjects: DataFrame, lineage: DataFrame, plan: DataFrame, bins: int = BINS, block: int = BLOCK) -> DataFrame:
    """(image_id, split_name): every image, related ones in one split, about the plan's shares.

    Shares that are null or not positive count as 0; a plan without a usable
    share gives no rows. Images without relatives are components of their own.
    """
    shares = [(r[0], float(r[1])) for r in plan.where("split_name is not null and share > 0").orderBy("manual_set_version_id", "split_name").select("split_name", "share").collect()]  # the plan's rows
    spark = images.sparkSession
    if not shares:
        return spark.createDataFrame([], "image_id long, split_name string")
    related = cut(groups(subjects, lineage, block).join(images.select(F.col("id").alias("image_id")).distinct(), "image_id", "left_semi"), "related")
    every = images.where("id is not null").select(F.col("id").alias("image_id")).distinct()
    heads = related.groupBy(F.col("group_image_id").alias("root")).agg(F.count(F.lit(1)).alias("size"))
    single = every.join(related.select("image_id"), "image_id", "left_anti").select(F.col("image_id").alias("root"), F.lit(1).cast("long").alias("size"))
    parts = ranked(heads.union(single), "size", ["root"], "place")
    histogram = {int(r[0]): int(r[1]) for r in parts.groupBy("size").count().collect()}  # distinct sizes: at most sqrt(2 * images)
    filled = difference(histogram, bins)
    to = allocate(filled, [s for _, s in shares])
    # positions of a size class: first those of split 0, then 1, ...
    table = []
    for s in histogram:
        end = 0
        for k, (name, _) in enumerate(shares):
            start, end = end, end + sum(b[s] for b, t in zip(filled, to) if t == k)
            if end > start:
                table.append((s, start, end, name))
    quota = spark.createDataFrame(table or [(0, 0, 0, "")], "size long, start long, end long, split_name string")
    placed = cut(parts.join(small(quota), "size").where("place >= start and place < end").select("root", "size", "split_name"), "placed")
    alone = placed.join(related.select(F.col("group_image_id").alias("root")).distinct(), "root", "left_anti").select(F.col("root").alias("image_id"), "split_name")
    hot = placed.select(F.col("root").alias("group_image_id"), F.col("size").alias("n"))
    rest = salted_join(placed.select(F.col("root").alias("group_image_id"), "split_name"), related.select("image_id", "group_image_id"), ["group_image_id"], hot, block)
    return rest.select("image_id", "split_name").union(alone)
