"""Best representative of each duplicate group by token-level consensus.

The values of a group are token sequences; they are aligned progressively into
columns, heaviest first, weighted tokens are voted per column, and what exists
closest to the consensus is emitted.

``survivors`` decides field by field which member's value a group keeps. A
member's tokens are its fields, a column holds one field. Votes are ordered by
trust, then recency, then id, and each outweighs all below it; a missing value
is no vote. A field's value is taken from the heaviest member that has the
voted token, and the record is the member that leaves least of the consensus
empty. Of members with the same usable fields only the heaviest can win
anything, so a partial aggregate keeps one for each of the eight patterns, and a
group of any size is never gathered.

``spellings`` is the same for free text: the written forms of a group's subject.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import captured, kept, with_hex, with_subject
from ..functions.spread import cut, lookup, salted_join, small

FIELDS = ("license_id", "date_captured", "subject_id")


def members(images: DataFrame, subjects: DataFrame, batches: DataFrame, trust: DataFrame) -> DataFrame:
    """One row for each image of a group of two or more with the same digest: what it offers and how it ranks.

    A batch or set that is not listed ranks last; an image with several subject
    rows has the first subject that names somebody.
    """
    base = with_hex(images.where("id is not null").select(F.col("id").alias("image_id"), "image_batch_id", "blake3_hash", "license_id", "date_captured"), "blake3_hash", 64, "_hex")
    base = cut(kept(base, "_hex").select("image_id", "image_batch_id", F.unhex("_hex").alias("digest"), "license_id", captured("date_captured").alias("date_captured")), "digests")
    groups = cut(base.groupBy("digest").agg(F.min("image_id").alias("group_image_id"), F.max("image_id").alias("_last")).where("group_image_id <> _last").drop("_last"), "groups")
    own = lookup(groups, base, ["digest"])
    named = kept(with_subject(subjects.select("image_id", "subject_id").join(small(own.select("image_id")), "image_id", "left_semi"), "subject_id", "_key"), "_key")
    named = named.groupBy("image_id").agg(F.min("_key").alias("subject"))
    ranks = trust.where("original_set_name is not null").groupBy("original_set_name").agg(F.min("trust_rank").alias("trust_rank"))
    made = batches.where("batch_kind = 'image'").groupBy(F.col("batch_id").alias("image_batch_id")).agg(F.max(F.struct("created_at", "original_set_name")).alias("_b"))
    made = made.select("image_batch_id", "_b.created_at", "_b.original_set_name").join(small(ranks), "original_set_name", "left")
    return own.join(small(made), "image_batch_id", "left").join(named, "image_id", "left").select("image_id", "group_image_id", "license_id", "date_captured", "subject", "trust_rank", "created_at")


def survivors(images: DataFrame, subjects: DataFrame, batches: DataFrame, trust: DataFrame) -> DataFrame:
    """(group_image_id, field_name, image_id) for groups of two or more images of same content.

    For each field the member with a usable value of lowest trust rank, then
    latest batch, then smallest id; no row if no member has one. ``record`` is
    the member with the most usable fields, ties in the same order. Missing
    ranks and dates come last. Empty tables give no rows.
    """
    values = dict(zip(FIELDS, ("license_id", "date_captured", "subject")))
    pattern = sum(F.col(c).isNotNull().cast("int") * (1 << k) for k, c in enumerate(values.values()))
    tokens = F.array(*[F.concat(F.lit(f"{name}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for name, c in values.items()])
    order = [-F.col("trust_rank").cast("long"), F.col("created_at"), -F.col("image_id")]  # the largest struct is the heaviest; null is smallest
    own = members(images, subjects, batches, trust).select("group_image_id", pattern.alias("pattern"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], tokens.alias("tokens")).alias("vote"))
    best = own.groupBy("group_image_id").agg(*[F.max(F.when(F.col("pattern") == k, F.col("vote"))).alias(f"v{k}") for k in range(1 << len(values))])
    voters = F.sort_array(F.array_compact(F.array(*[F.col(f"v{k}") for k in range(1 << len(values))])), asc=False)
    groups = best.select("group_image_id", F.transform(voters, lambda v: F.struct((-v["o2"]).alias("image_id"), v["tokens"].alias("tokens"))).alias("voters"))

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            rows = [(g, *w) for g, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in winners([(x["image_id"], x["tokens"]) for x in v])]
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["group_image_id", "field_name", "image_id"])

    return groups.mapInArrow(run, "group_image_id long, field_name string, image_id long")


def field_of(token: str) -> str:
    return token.partition("=")[0]


def winners(voters: list[tuple[int, list[str]]]) -> list[tuple[str, int]]:
    """(field, member) for members and their field tokens that come heaviest first: each vote is
    twice the one below it, so more than all of them together."""
    same = lambda a, b: field_of(a) == field_of(b)
    void = lambda t: not t or t.endswith("=")
    agreed = voted(((t, 2.0**-k) for k, (_, t) in enumerate(voters)), same, void)
    out = [(field_of(t), next(i for i, own in voters if t in own)) for t in agreed]
    record = min(range(len(voters)), key=lambda k: (distance([t for t in voters[k][1] if not void(t)], agreed, same), k))
    return [*out, ("record", voters[record][0])]


TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\s+")


Same = Callable[[str, str], bool]


def align(columns: list[dict[str, float]], total: float, tokens: list[str], weight: float, same: Same | None = None) -> None:
    """Adds a token sequence to the profile by global alignment. A column maps a token
    ('' is a gap) to its votes, of ``total`` in all; matching costs the share of other votes.
    ``same`` says which tokens may share a column, all if it is not given."""
    n, m = len(columns), len(tokens)
    gap = [1 - c.get("", 0.0) / total for c in columns]

    def match(i: int, j: int) -> float:
        if same and not same(next(t for t in columns[i] if t), tokens[j]):
            return float("inf")
        return 1 - columns[i].get(tokens[j], 0.0) / total

    cost = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        cost[i][0] = cost[i - 1][0] + gap[i - 1]
    for j in range(1, m + 1):
        cost[0][j] = j
        for i in range(1, n + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + match(i - 1, j - 1), cost[i - 1][j] + gap[i - 1], cost[i][j - 1] + 1)
    i, j = n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + match(i - 1, j - 1):
            i, j = i - 1, j - 1
            columns[i][tokens[j]] = columns[i].get(tokens[j], 0.0) + weight
        elif i and cost[i][j] == cost[i - 1][j] + gap[i - 1]:
            i -= 1
            columns[i][""] = columns[i].get("", 0.0) + weight
        else:
            j -= 1
            columns.insert(i, {"": total, tokens[j]: weight})


def voted(votes: Iterable[tuple[list[str], float]], same: Same | None = None, void: Callable[[str], bool] | None = None) -> list[str]:
    """The weighted consensus of token sequences that come heaviest first. They are read
    once; only the profile is held. Tokens (and '' for gaps) that are ``void`` have no vote."""
    columns: list[dict[str, float]] = []
    total = 0.0
    for tokens, weight in votes:
        if total:
            align(columns, total, tokens, weight, same)
            total += weight
        else:
            columns, total = [{t: weight} for t in tokens], weight
    said = ([t for t in sorted(c) if not (void and void(t))] for c in columns)
    return [t for c, own in zip(columns, said) if (t := max(own, key=lambda x: c[x], default=""))]


def distance(a: list[str], b: list[str], same: Same | None = None) -> int:
    """Insertions, deletions and replacements between two sequences; a token replaces a same one for nothing."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (not same(x, y) if same else x != y))
    return row[-1]


def closest(values: list[str], weights: list[float]) -> int:
    """Index of the value closest to the weighted token consensus; ties go to the
    heavier, then to the smaller value."""
    order = sorted(range(len(values)), key=lambda i: (-weights[i], values[i]))
    consensus = voted((TOKEN.findall(values[i]), weights[i]) for i in order)
    return min(order, key=lambda i: distance(TOKEN.findall(values[i]), consensus))


def spellings(images: DataFrame, subjects: DataFrame, batches: DataFrame, trust: DataFrame, lists: int = 64) -> DataFrame:
    """(group_image_id, subject_id, votes): for each group of same content with a named
    subject, the written form of the subject closest to the members' consensus.

    Votes are weighted by trust (1 / rank, 1 / 100 if unranked) and added up per
    distinct spelling before anything is aligned. A group of up to ``lists``
    distinct spellings is aligned as a list. A larger one is read as a sorted
    stream into its profile, which is all that is held of it, and its spellings
    are compared with the consensus where they are: the same result.
    """
    own = members(images, subjects, batches, trust).where("subject is not null").select("image_id", "group_image_id", "trust_rank")
    named = kept(with_subject(subjects.select("image_id", "subject_id"), "subject_id", "_key"), "_key").drop("_key").distinct()
    level = cut(own.join(named, "image_id").groupBy("group_image_id", "subject_id").agg(F.sum(1 / F.coalesce("trust_rank", F.lit(100))).alias("votes")), "spellings")

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            ids, values, weights = (batch.column(i).to_pylist() for i in range(3))
            best = [closest(v, w) for v, w in zip(values, weights)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([v[b] for v, b in zip(values, best)], pa.string()), pa.array([sum(w) for w in weights], pa.float64())], ["group_image_id", "subject_id", "votes"])

    def profile(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for batch in batches_ for r in zip(*(batch.column(i).to_pylist() for i in range(3))))
        for group, own_ in groupby(stream, key=lambda r: r[0]):
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([voted((TOKEN.findall(r[1]), r[2]) for r in own_)], pa.list_(pa.string()))], ["group_image_id", "consensus"])

    def compare(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            far = [distance(TOKEN.findall(v), c) for v, c in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(far, pa.int64())], ["group_image_id", "subject_id", "votes", "far"])

    sizes = level.groupBy("group_image_id").agg(F.count(F.lit(1)).alias("n"))
    few, many = sizes.where(F.col("n") <= lists), sizes.where(F.col("n") > lists)
    lists_ = level.join(few, "group_image_id").groupBy("group_image_id").agg(F.sort_array(F.collect_list(F.struct("subject_id", "votes"))).alias("s"))
    best = lists_.select("group_image_id", F.col("s.subject_id").alias("v"), F.col("s.votes").alias("w")).mapInArrow(run, "group_image_id long, subject_id string, votes double")
    if not many.take(1):
        return best
    many = cut(many, "sizes")
    large = level.join(small(many.select("group_image_id")), "group_image_id")
    stream = large.select("group_image_id", "subject_id", "votes").repartition("group_image_id").sortWithinPartitions("group_image_id", F.col("votes").desc(), "subject_id")
    agreed = cut(stream.mapInArrow(profile, "group_image_id long, consensus array<string>"), "agreed")
    pairs = salted_join(agreed, large, ["group_image_id"], many, 10_000).select("group_image_id", "subject_id", "votes", "consensus")
    far = pairs.mapInArrow(compare, "group_image_id long, subject_id string, votes double, far long")
    least = far.groupBy("group_image_id").agg(F.min(F.struct("far", -F.col("votes"), "subject_id")).alias("b"), F.sum("votes").alias("votes"))
    return best.union(least.select("group_image_id", "b.subject_id", "votes"))
