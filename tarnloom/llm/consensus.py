"""Consensus from several annotators' labels.

Expectation-maximisation after Dawid and Skene: every person has a confusion
matrix, every labelled item a posterior over the categories named for it. The
category namespaces differ by annotation batch, so the matrices' coordinates
are positions in the batch's category list (by id); a person who slips to the
next entry of the list or falls back to its first one does so in every batch.

Smoothing is in two steps: a person's cell (true position, given position) is
drawn to the person's pooled rates of four relations (hit, next entry, first
entry, other), and these to the pooled rates of all persons.

Items are collapsed once into arrays and written to the shared folder; an
iteration is one scan of them, adding up sparse expected counts per task. What
reaches the driver is bounded by the (person, true, given) triples that occur,
not by the labels.
Chance-corrected agreement (Krippendorff's alpha) is computed separately.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import person_key
from ..functions.spread import cut, small

PSEUDO = 20.0  # weight of the pooled rates in a person's cell
POOLED = 10.0  # weight of all persons' rates in a person's rates
ROUNDS, TOLERANCE = 100, 1e-3  # the fit ends where no person's rates move more; it says so if it never does
HIT, NEXT, FIRST, OTHER = range(4)


def people(annotators: DataFrame) -> DataFrame:
    """(annotator_id, person_id): ids whose names are written alike belong to the person with the smallest id."""
    named = annotators.where("id is not null").select(F.col("id").alias("annotator_id"), person_key("name").alias("key"))
    own = named.where(F.col("key").isNull() | (F.col("key") == "")).select("annotator_id", F.col("annotator_id").alias("person_id"))
    keyed = named.where(F.col("key") != "")
    return keyed.join(keyed.groupBy("key").agg(F.min("annotator_id").alias("person_id")), "key").select("annotator_id", "person_id").union(own).groupBy("annotator_id").agg(F.min("person_id").alias("person_id"))


def claimed(labels: DataFrame, annotators: DataFrame) -> DataFrame:
    """(annotation_batch_id, image_id, person_id, category_id) of labels of score above 0.
    Rows with a null in any of these are no claim; an annotator who is not listed is
    a person of their own."""
    full = labels.where("score > 0 and annotation_batch_id is not null and image_id is not null and category_id is not null and annotator_id is not null")
    who = full.join(small(people(annotators)), "annotator_id", "left").withColumn("person_id", F.coalesce("person_id", "annotator_id"))
    return who.select("annotation_batch_id", "image_id", "person_id", "category_id")


def claims(labels: DataFrame, annotators: DataFrame) -> DataFrame:
    """``claimed``, each once."""
    return claimed(labels, annotators).distinct()


def positions(categories: DataFrame) -> DataFrame:
    """(category_id, position, listed): 1-based place in the batch's list, and its length."""
    own = categories.where("id is not null").select(F.col("id").alias("category_id"), "annotation_batch_id").distinct()
    place = F.row_number().over(Window.partitionBy("annotation_batch_id").orderBy("category_id"))
    length = own.groupBy("annotation_batch_id").agg(F.count(F.lit(1)).cast("int").alias("listed"))
    # a category that is listed under several batches keeps one place
    return own.withColumn("position", place).join(length, "annotation_batch_id").groupBy("category_id").agg(F.min("position").alias("position"), F.max("listed").alias("listed"))


def items(labels: DataFrame, annotators: DataFrame, categories: DataFrame) -> DataFrame:
    """(annotation_batch_id, image_id, persons, listed, claims): one row for each labelled
    image of a batch. ``claims`` holds each (person, category) once, so its length is
    bounded by the persons times the batch's list."""
    own = claimed(labels, annotators).join(small(positions(categories)), "category_id", "left")
    entry = F.struct(F.col("person_id").alias("p"), F.coalesce("position", F.lit(1)).alias("l"), F.col("category_id").alias("c"))
    # the set drops repeats, so rows are shuffled once
    sets = own.groupBy("annotation_batch_id", "image_id").agg(F.coalesce(F.max("listed"), F.lit(1)).alias("listed"), F.sort_array(F.collect_set(entry)).alias("claims"))
    return sets.select("annotation_batch_id", "image_id", F.size(F.array_distinct("claims.p")).cast("long").alias("persons"), "listed", "claims")


@dataclass
class Model:
    """Expected counts: ``cells`` by (person, true, given), ``rates`` by (person, relation), ``prior`` by position; positions are the lists' own."""

    cells: dict
    totals: dict
    rates: dict
    pooled: np.ndarray
    prior: dict

    @classmethod
    def start(cls) -> Model:
        """Everybody mostly right: the first posterior is close to a vote."""
        return cls({}, {}, {}, np.array([0.7, 0.1, 0.05, 0.15]), {})

    def chance(self, p: np.ndarray, t: np.ndarray, given: np.ndarray, listed: np.ndarray) -> np.ndarray:
        """P(given | true, person) for arrays of them."""
        rel = relation(t, given, listed)
        people_, at = np.unique(p, return_inverse=True)
        rates = np.stack([self.person(x) for x in people_]) if len(people_) else np.zeros((0, 4))
        share = np.where(rel == OTHER, 1.0 / np.maximum(1, listed - 3), 1.0)
        base = rates[at, rel] * share
        side = int(max(t.max(initial=0), given.max(initial=0))) + 1
        codes, where = np.unique((at.astype(np.int64) * side + t) * side + given, return_inverse=True)
        keys = [(int(people_[c // side // side]), int(c // side % side), int(c % side)) for c in codes]
        cell = np.array([self.cells.get(k, 0.0) for k in keys])
        total = np.array([self.totals.get(k[:2], 0.0) for k in keys])
        return (cell[where] + PSEUDO * base) / (total[where] + PSEUDO)

    def common(self, t: np.ndarray) -> np.ndarray:
        """P(true) for an array of positions, up to a factor."""
        places, at = np.unique(t, return_inverse=True)
        return np.array([1.0 + self.prior.get(int(x), 0.0) for x in places])[at]

    def person(self, p: int) -> np.ndarray:
        own = self.rates.get(int(p), np.zeros(4))
        return (own + POOLED * self.pooled) / (own.sum() + POOLED)


def relation(t: np.ndarray, given: np.ndarray, listed: np.ndarray) -> np.ndarray:
    return np.where(given == t, HIT, np.where(given == t % np.maximum(1, listed) + 1, NEXT, np.where(given == 1, FIRST, OTHER)))


def _pairs(claim: pa.ListArray, listed: np.ndarray):
    """Flattens a batch of items: candidates (item, category, position) and, for each
    candidate and claim of its item, the claim's person, position and the candidate's index."""
    flat = claim.flatten()
    p, given, c = (np.asarray(flat.field(x)) for x in ("p", "l", "c"))
    item = np.repeat(np.arange(len(claim)), np.asarray(claim.value_lengths()))
    cand = pd.DataFrame({"item": item, "c": c, "t": given}).drop_duplicates(["item", "c"]).sort_values(["item", "c"])
    ci, cc, ct = cand["item"].to_numpy(), cand["c"].to_numpy(), cand["t"].to_numpy()
    number = np.bincount(ci, minlength=len(claim))
    start = np.concatenate([[0], np.cumsum(number)[:-1]])
    rep = number[item]
    k = np.repeat(start[item], rep) + np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep)
    return ci, cc, ct, np.repeat(p, rep), np.repeat(given, rep), k, listed[ci[k]] if len(k) else listed[:0]


def _posterior(model: Model, claim: pa.ListArray, listed: np.ndarray):
    ci, cc, ct, p, given, k, n = _pairs(claim, listed)
    score = np.log(model.common(ct))
    np.add.at(score, k, np.log(np.maximum(model.chance(p, ct[k], given, n), 1e-12)))
    top = np.full(len(claim), -np.inf)
    np.maximum.at(top, ci, score)
    weight = np.exp(score - top[ci])
    total = np.zeros(len(claim))
    np.add.at(total, ci, weight)
    return ci, cc, ct, weight / total[ci], p, given, k, n


def _lists(batch: pa.RecordBatch, column: int) -> pa.ListArray:
    x = batch.column(column)
    return x if isinstance(x, pa.ListArray) else x.cast(pa.list_(x.type.value_type))


def fit(shared: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model after at most ``rounds`` scans of the items that two or more persons labelled."""
    model = Model.start()
    several = shared.where("persons >= 2").select("listed", "claims")
    schema = "kind int, p long, a int, b int, w double"

    for _ in range(rounds):

        def step(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            parts = []
            for batch in batches:
                ci, _, ct, post, p, given, k, n = _posterior(model, _lists(batch, 1), np.asarray(batch.column(0)))
                rel = relation(ct[k], given, n)
                cells = pd.DataFrame({"kind": 0, "p": p, "a": ct[k], "b": given, "w": post[k]})
                rates = pd.DataFrame({"kind": 1, "p": p, "a": rel, "b": 0, "w": post[k]})
                prior = pd.DataFrame({"kind": 2, "p": 0, "a": ct, "b": 0, "w": post})
                parts.append(pd.concat([cells, rates, prior]).groupby(["kind", "p", "a", "b"], as_index=False)["w"].sum())
                if len(parts) > 20:
                    parts = [pd.concat(parts).groupby(["kind", "p", "a", "b"], as_index=False)["w"].sum()]
            if parts:
                out = pd.concat(parts).groupby(["kind", "p", "a", "b"], as_index=False)["w"].sum()
                yield pa.RecordBatch.from_pandas(out.astype({"kind": "int32", "p": "int64", "a": "int32", "b": "int32", "w": "float64"}), preserve_index=False)

        counts = several.mapInArrow(step, schema).groupBy("kind", "p", "a", "b").agg(F.sum("w").alias("w")).toPandas().sort_values(["kind", "p", "a", "b"])
        cells, totals, rates, prior = {}, {}, {}, {}
        pooled = np.ones(4)
        for kind, p, a, b, w in counts.itertuples(index=False):
            if kind == 0:
                cells[p, a, b] = w
                totals[p, a] = totals.get((p, a), 0.0) + w
            elif kind == 1:
                rates.setdefault(p, np.zeros(4))[a] += w
                pooled[a] += w
            else:
                prior[a] = w
        new = Model(cells, totals, rates, pooled / pooled.sum(), prior)
        moved = max((float(np.abs(new.person(p) - model.person(p)).max()) for p in rates), default=0.0)
        model = new
        if moved < TOLERANCE:
            return model
    warnings.warn(f"rates still move by {moved:.4f} after {rounds} rounds", stacklevel=2)
    return model


def consensus(labels: DataFrame, annotators: DataFrame, categories: DataFrame, least: int = 3) -> DataFrame:
    """(annotation_batch_id, image_id, category_id, posterior, persons): the most credible
    category of every image that at least ``least`` persons labelled in a batch; of
    equally credible ones the smallest id. Empty tables give no rows."""
    shared = cut(items(labels, annotators, categories), "items")
    model = fit(shared)
    schema = "annotation_batch_id long, image_id long, category_id long, posterior double, persons int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ci, cc, _, post, *_ = _posterior(model, _lists(batch, 4), np.asarray(batch.column(3)))
            best = pd.DataFrame({"i": ci, "c": cc, "post": post}).sort_values(["i", "post", "c"], ascending=[True, False, True]).drop_duplicates("i")
            keep = pa.array(best["i"].to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(keep), batch.column(1).take(keep), pa.array(best["c"].to_numpy(), pa.int64()), pa.array(best["post"].to_numpy(), pa.float64()), batch.column(2).take(keep).cast(pa.int32())],
                ["annotation_batch_id", "image_id", "category_id", "posterior", "persons"],
            )

    return shared.where(F.col("persons") >= least).select("annotation_batch_id", "image_id", "persons", "listed", "claims").mapInArrow(run, schema)


def reliability(labels: DataFrame, annotators: DataFrame, categories: DataFrame) -> DataFrame:
    """(person_id, expected_labels, hit_rate, next_rate, first_rate, other_rate): how
    reliable each person is, from labels on images that others labelled too; a
    person without any has the rates of all persons."""
    shared = cut(items(labels, annotators, categories), "items")
    model = fit(shared)
    spark = shared.sparkSession
    who = [r[0] for r in people(annotators).select("person_id").distinct().union(shared.select(F.explode("claims.p"))).distinct().collect()]  # bounded by the persons
    rows = [(int(p), float(model.rates.get(p, np.zeros(4)).sum()), *map(float, model.person(p))) for p in sorted(who)]
    return spark.createDataFrame(rows, "person_id long, expected_labels double, hit_rate double, next_rate double, first_rate double, other_rate double")


def agreement(labels: DataFrame, annotators: DataFrame) -> DataFrame:
    """(annotation_batch_id, items, ratings, observed_disagreement, expected_disagreement, alpha):
    Krippendorff's alpha for nominal data per annotation batch, over images with at
    least two ratings; null where all ratings name one category."""
    given = claims(labels, annotators).groupBy("annotation_batch_id", "image_id", "category_id").agg(F.count(F.lit(1)).alias("n"))
    item = given.groupBy("annotation_batch_id", "image_id").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("q")).where("m >= 2")
    seen = item.groupBy("annotation_batch_id").agg(F.count(F.lit(1)).alias("items"), F.sum("m").alias("ratings"), F.sum((F.col("m") * F.col("m") - F.col("q")) / (F.col("m") - 1)).alias("pairs"))
    used = given.join(item.select("annotation_batch_id", "image_id"), ["annotation_batch_id", "image_id"]).groupBy("annotation_batch_id", "category_id").agg(F.sum("n").alias("c"))
    share = used.groupBy("annotation_batch_id").agg(F.sum(F.col("c") * F.col("c")).alias("squares"))
    n = F.col("ratings")
    observed = F.col("pairs") / n
    expected = (n * n - F.col("squares")) / (n * (n - 1))
    return seen.join(share, "annotation_batch_id").select("annotation_batch_id", "items", "ratings", observed.alias("observed_disagreement"), expected.alias("expected_disagreement"), F.when(expected > 0, 1 - observed / expected).alias("alpha"))
