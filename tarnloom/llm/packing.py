"""Filling fixed-capacity containers with items.

Only the histogram of item sizes matters for how to pack: at most ``capacity``
numbers, however many items there are. On it the configuration linear program
(fewest containers so that every size is covered) is solved by multiplicative
weights: a size's price is its length times a weight that falls with the share of
it that is served, so that full containers of sizes that lag behind are dearest.
Knapsack dynamic programming finds the dearest completion of every size at once;
the largest sizes left, the hardest to combine, are completed. A round's share of each container found is rounded to a whole number at
once and taken off the histogram: the program is always solved for what is left,
and rounding errors do not add up. Above a capacity of ``EXACT``, sizes are priced
in classes of a grid of ``GRID`` units, so a round costs the same at any capacity.
What is left at the end, a few containers' worth, and
the smallest items, which are held back for it, fill the open containers best-fit
decreasing; the containers with most room are then packed once more.

Items find their place by their number within their size: the plan says which
numbers of a size go to which containers.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spread import cut, ranked

EXACT = 4096  # capacity up to which sizes are priced as they are
GRID = 1024  # units of a larger container, which holds more items to even out what rounding leaves
RATE = 0.2  # how fast a served size's weight falls
SHARE = 0.25  # of what is left of the scarcest size, served at once
SEEDS = 16  # sizes, largest first, that one pricing serves
HELD = 0.1  # share of the volume, in the smallest items, that fills what is left open
END = 8  # containers' worth at which solving ends

Pattern = tuple[tuple[int, int], ...]  # ((size, how many), ...), sizes falling


def priced(capacity: int, sizes: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best, took): for each room the highest total price that fits, and the size to take
    first for it, or 0 to leave a unit empty: knapsack over sizes (rising), repeats allowed."""
    # a size that costs no less room than a dearer one is never needed
    need = np.nonzero(price > np.concatenate([[0.0], np.maximum.accumulate(price)[:-1]]))[0]
    small, worth = sizes[need], price[need]
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    fits = np.searchsorted(small, np.arange(capacity + 1), "right").tolist()
    for c in range(int(small[0]) if len(small) else capacity + 1, capacity + 1):
        f = fits[c]
        value = best[c - small[:f]] + worth[:f]
        k = value.argmax()
        if value[k] > best[c - 1]:
            best[c], took[c] = value[k], small[k]
        else:
            best[c] = best[c - 1]
    return best, took


def filled(room: int, took: np.ndarray, left: dict[int, int], sizes: list[int]) -> Counter:
    """The dearest content of a room, from what is left of the sizes (rising): where a size
    is used up, the largest one that fits stands for it."""
    out: Counter = Counter()
    while room > 0:
        s = int(took[room])
        if s and out[s] >= left.get(s, 0):
            k = bisect_right(sizes, room) - 1
            while k >= 0 and out[sizes[k]] >= left.get(sizes[k], 0):
                k -= 1
            s = sizes[k] if k >= 0 else 0
            if not s:
                break
        if s:
            out[s] += 1
        room -= s or 1
    return +out


def classes(histogram: dict[int, int], unit: int) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for s, n in histogram.items():
        out[-(-s // unit)] += n
    return out


def drawn(pattern: Pattern, times: int, queues: dict[int, list[list[int]]]) -> list[tuple[Pattern, int]]:
    """``times`` containers of a pattern of classes with items taken from the classes' queues
    of [size, number]; equal containers together."""
    slots = []  # runs of one size along the containers, for each place in the pattern
    for c, n in pattern:
        for _ in range(n):
            runs, left = [], times
            while left:
                head = queues[c][-1]
                some = min(left, head[1])
                runs.append((head[0], some))
                head[1] -= some
                left -= some
                if not head[1]:
                    queues[c].pop()
            slots.append(runs)
    out, at = [], [[0, runs[0][1]] for runs in slots]
    left = times
    while left:
        some = min(left, *(a[1] for a in at))
        content: dict[int, int] = defaultdict(int)
        for a, runs in zip(at, slots):
            content[runs[a[0]][0]] += 1
            a[1] -= some
            if not a[1] and a[0] + 1 < len(runs):
                a[0] += 1
                a[1] = runs[a[0]][1]
        left -= some
        out.append((tuple(sorted(content.items(), reverse=True)), some))
    return out


def rounded(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Whole numbers of containers of the program, and the items left over."""
    unit = 1 if capacity <= EXACT else -(-capacity // GRID)
    room = capacity // unit
    queues: dict[int, list[list[int]]] = defaultdict(list)
    for s in sorted(histogram):
        queues[-(-s // unit)].append([s, histogram[s]])  # the largest of a class is taken first
    need = {c: n for c, n in classes(histogram, unit).items() if c <= room}
    left = dict(need)
    volume = sum(c * n for c, n in left.items())
    plan: list[tuple[Pattern, int]] = []
    while volume > END * room:
        sizes = np.array(sorted(left), dtype=np.int64)
        served = np.array([1 - left[int(c)] / need[int(c)] for c in sizes])
        _, took = priced(room, sizes, sizes * np.exp(-RATE * served))
        order = sizes.tolist()
        for seed in order[: -SEEDS - 1 : -1]:
            if not left.get(seed):
                continue
            left[seed] -= 1
            pattern = filled(room - seed, took, left, order) + Counter({seed: 1})
            left[seed] += 1
            times = max(1, int(SHARE * min(left[c] // n for c, n in pattern.items())))
            plan += drawn(tuple(sorted(pattern.items(), reverse=True)), times, queues)
            for c, n in pattern.items():
                left[c] -= n * times
                volume -= c * n * times
                if not left[c]:
                    del left[c]
    rest: dict[int, int] = defaultdict(int)
    for own in queues.values():
        for s, n in own:
            rest[s] += n
    return plan, rest


def best_fit(histogram: dict[int, int], capacity: int, there: list[tuple[Pattern, int]] = ()) -> list[tuple[Pattern, int]]:
    """Best fit decreasing on counts into the containers that are there and new ones: equal
    containers are handled together."""
    open_by: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)  # room -> (content, containers)
    rooms: list[int] = []
    done: list[tuple[Pattern, int]] = []

    def add(room: int, content: dict[int, int], times: int) -> None:
        if room == 0:
            done.append((tuple(sorted(content.items(), reverse=True)), times))
            return
        if not open_by[room]:
            k = bisect_left(rooms, room)
            if k == len(rooms) or rooms[k] != room:
                rooms.insert(k, room)
        open_by[room].append((content, times))

    for p, times in there:
        add(capacity - sum(s * n for s, n in p), dict(p), times)
    for s in sorted(histogram, reverse=True):
        n = histogram[s]
        while n:
            k = bisect_left(rooms, s)
            if k == len(rooms):
                fit = min(capacity // s, n)
                times = n // fit
                add(capacity - s * fit, {s: fit}, times)
                n -= fit * times
                continue
            room = rooms[k]
            content, times = open_by[room].pop()
            if not open_by[room]:
                rooms.pop(k)
            some = min(times, n)
            if some < times:
                add(room, content, times - some)
            fit = min(room // s, n // some)
            add(room - s * fit, {**content, s: content.get(s, 0) + fit}, some)
            n -= some * fit
    return done + [(tuple(sorted(c.items(), reverse=True)), t) for room in rooms for c, t in open_by[room]]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """(container, how often), all items exactly once: the rounded program, with the
    smallest items in what it leaves open."""
    usable = {s: n for s, n in histogram.items() if 0 < s <= capacity and n > 0}
    held: dict[int, int] = {}
    keep = HELD * sum(s * n for s, n in usable.items())
    for s in sorted(usable):
        some = min(usable[s], int(keep // s))
        if not some:
            break
        held[s] = some
        keep -= s * some
    large = {s: n - held.get(s, 0) for s, n in usable.items() if n > held.get(s, 0)}
    patterns, rest = rounded(large, capacity)
    for s, n in held.items():
        rest[s] += n
    return mended(best_fit({s: n for s, n in rest.items() if n > 0}, capacity, patterns), capacity)


def mended(patterns: list[tuple[Pattern, int]], capacity: int) -> list[tuple[Pattern, int]]:
    """The containers, of which those with most room, up to a quarter, are emptied and packed
    again where that saves some."""
    room = lambda p: capacity - sum(s * n for s, n in p)
    total = sum(t for _, t in patterns)
    for part in (32, 16, 8, 4):
        out, loose, taken = [], Counter(), 0
        for p, times in sorted(patterns, key=lambda x: -room(x[0])):
            some = min(times, max(0, total // part + 1 - taken)) if room(p) else 0
            taken += some
            for s, n in p:
                loose[s] += n * some
            if times > some:
                out.append((p, times - some))
        again = best_fit(+loose, capacity)
        if sum(t for _, t in again) < taken:
            patterns = out + again
            total = sum(t for _, t in patterns)
    return patterns


def slots(patterns: list[tuple[Pattern, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By size: first item number, first container and items per container of each block of equal containers."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    number: dict[int, int] = defaultdict(int)
    base = 0
    for p, times in patterns:
        for s, n in p:
            out[s].append((number[s], base, n))
            number[s] += n * times
        base += times
    return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for s, rows in out.items()}


def pack(sizes: DataFrame, containers: DataFrame, id_column: str = "doc_id", size_column: str = "tokens") -> DataFrame:
    """(container_kind, container_id, id, piece_no, tokens): every item in each kind of container.

    An item above the capacity is cut into pieces of the capacity, one container
    each, and a rest; no other item is cut. Items of size 0 (null sizes count as
    0) take no space and are spread over the containers, container 0 if there is
    none. Kinds with a null or non-positive capacity are left out. Rows are
    items: repeated rows are placed as often as they come.
    """
    spark = sizes.sparkSession
    kinds = [(r[0], int(r[1])) for r in containers.where("capacity_tokens > 0 and container_kind is not null").groupBy("container_kind").agg(F.min("capacity_tokens")).orderBy("container_kind").collect()]  # a few kinds
    kind = sizes.schema[id_column].dataType.simpleString()
    schema = f"container_kind string, container_id long, {id_column} {kind}, piece_no int, tokens int"
    own = sizes.select(F.col(id_column).alias("_id"), F.coalesce(F.col(size_column), F.lit(0)).cast("int").alias("_size"))
    placed = None
    for name, capacity in kinds:
        pieces = own.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("_size") / capacity).cast("int") - 1))))
        pieces = pieces.withColumn("size", F.least(F.lit(capacity), F.col("_size") - F.col("piece_no") * capacity))
        numbered = ranked(pieces, "size", ["_id", "piece_no"], "number")
        histogram = {int(r[0]): int(r[1]) for r in numbered.groupBy("size").count().collect()}  # at most capacity + 1 rows
        patterns = plan(histogram, capacity)
        blocks, total = slots(patterns), sum(t for _, t in patterns)

        def run(batches: Iterator[pa.RecordBatch], name: str = name, blocks: dict = blocks, total: int = total) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size, number = np.asarray(batch.column(2)), np.asarray(batch.column(3))
                where = number % max(1, total)  # items without size
                for s in np.unique(size[size > 0]):
                    first, base, each = blocks[int(s)]
                    rows = np.nonzero(size == s)[0]
                    k = np.searchsorted(first, number[rows], "right") - 1
                    where[rows] = base[k] + (number[rows] - first[k]) // each[k]
                yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows, pa.string()), pa.array(where, pa.int64()), batch.column(0), batch.column(1), pa.array(size, pa.int32())], ["container_kind", "container_id", id_column, "piece_no", "tokens"])

        part = numbered.select("_id", "piece_no", "size", "number").mapInArrow(run, schema)
        placed = part if placed is None else placed.union(part)
    return placed if placed is not None else spark.createDataFrame([], schema)


def pack_documents(documents: DataFrame, containers: DataFrame, **tokenizer: str) -> DataFrame:
    """``pack`` of the documents' token counts by a public tokenizer."""
    from .tokens import count

    return pack(cut(count(documents, **tokenizer), "sizes"), containers)
