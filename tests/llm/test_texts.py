"""p7 to p9: tokens, packing, look-alikes."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnloom.llm import lookalike, packing, queries, tokens
from tests.conftest import DATA, rows

SPACES = " \n\t　"
ODD = ["", None, " ", "\n\n  x", "a" * 3000, "日本語の文" * 400, "<|endoftext|>", "'s'll don't", "👩‍⚕️ 123,456", "​", "é́ß", "\x00a", "0" * 999]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{tokens.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_equal_the_library(spark, library):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = {r[0]: list(r[1]) for r in tokens.encode(documents).collect()}
    assert got == dict(zip(texts, library(texts.values())))


def test_odd_texts_and_tables(frame, library):
    given_ = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "a b", "y"), (0, "", "z")]
    documents = frame(given_, "doc_id long, text string, ids string")
    want = sorted(zip([g[0] for g in given_], library([g[1] for g in given_])), key=repr)
    assert sorted(((r[0], list(r[1])) for r in tokens.encode(documents).collect()), key=repr) == want
    assert sorted(map(tuple, tokens.count(documents).collect()), key=repr) == sorted(((a, len(b)) for a, b in want), key=repr)
    assert rows(tokens.encode(documents.limit(0))) == []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_library(library, text):
    assert tokens.encoder().encode(text) == library([text])[0]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12), st.integers(50, 64))
def test_plans_hold_every_item_once(histogram, capacity):
    used = Counter()
    for pattern, times in packing.plan(histogram, capacity):
        assert times > 0 and sum(s * n for s, n in pattern) <= capacity
        for s, n in pattern:
            used[s] += n * times
    assert used == Counter(histogram)


@pytest.mark.parametrize("capacity", [256, 1024, 8192, 32768])
@pytest.mark.parametrize("kind", ["long tail", "even", "few"])
def test_program_needs_no_more_than_best_fit(kind, capacity):
    import time

    rng = random.Random(2)
    draw = {"long tail": lambda: max(1, int(rng.lognormvariate(5.5, 1.0))), "even": lambda: rng.randint(1, 999), "few": lambda: rng.choice([300, 420, 170, 90])}[kind]
    sizes = Counter()
    for s in (draw() for _ in range(20_000)):
        sizes[capacity] += s // capacity
        sizes[s % capacity] += 1
    histogram = {s: n for s, n in sizes.items() if s and n}
    began = time.time()
    own = packing.plan(histogram, capacity)
    assert time.time() - began < 10
    assert sum(n for _, n in own) <= sum(n for _, n in packing.best_fit(histogram, capacity))


def test_knapsack_is_optimal():
    import numpy as np

    rng = random.Random(1)
    for _ in range(30):
        sizes = np.array(sorted(rng.sample(range(1, 15), 4)))
        price = np.array([rng.random() for _ in sizes])
        found = packing.filled(20, packing.priced(20, sizes, price)[1], dict.fromkeys(sizes.tolist(), 99), sizes.tolist())
        best = max(sum(n * p for n, p in zip(c, price)) for c in itertools.product(*[range(20 // s + 1) for s in sizes]) if sum(n * s for n, s in zip(c, sizes)) <= 20)
        assert sum(found[s] * p for s, p in zip(sizes.tolist(), price)) == pytest.approx(best)


CONTAINERS = "container_kind string, capacity_tokens int"


def placed(sizes, got, capacity):
    load, pieces = Counter(), defaultdict(list)
    for kind, container, item, piece, size in got:
        load[container] += size
        pieces[item].append((piece, size))
    assert max(load.values(), default=0) <= capacity
    for item, size in sizes.items():
        own = sorted(pieces[item])
        assert sum(s for _, s in own) == (size or 0) and [p for p, _ in own] == list(range(len(own)))
        assert len(own) == max(1, -(-(size or 0) // capacity))
    return sum(1 for v in load.values() if v)


def bound(pieces, capacity):
    """Containers that any packing needs: large pieces fit in no common one (Martello and Toth)."""
    best = -(-sum(pieces) // capacity)
    for k in range(capacity // 2 + 1):
        alone = [s for s in pieces if s > capacity - k]
        half = [s for s in pieces if capacity / 2 < s <= capacity - k]
        rest = sum(s for s in pieces if k <= s <= capacity / 2) - (len(half) * capacity - sum(half))
        best = max(best, len(alone) + len(half) + max(0, -(-rest // capacity)))
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_items_are_placed_whole_and_tightly(frame, seed):
    rng = random.Random(seed)
    sizes = {i: rng.choice([0, None, 64, 65, 128, 300, *range(1, 64)]) for i in range(400)}
    got = rows(packing.pack(frame([(i, s, "q") for i, s in sizes.items()], "doc_id long, tokens int, size string"), frame([("small", 64), ("bad", 0), (None, 9)], CONTAINERS)))
    pieces = [min(64, s - at) for s in sizes.values() if s for at in range(0, s, 64)]
    assert placed(sizes, got, 64) <= 1.01 * bound(pieces, 64) + 1


def test_packing_edges(frame):
    empty = frame([], "doc_id long, tokens int")
    kinds = frame([("a", 10)], CONTAINERS)
    assert rows(packing.pack(empty, kinds)) == rows(packing.pack(empty, kinds.limit(0))) == []
    assert rows(packing.pack(frame([(1, 0), (2, None)], "doc_id long, tokens int"), kinds)) == [("a", 0, 1, 0, 0), ("a", 0, 2, 0, 0)]
    same = rows(packing.pack(frame([(1, 5)] * 3 + [(None, 4)], "doc_id long, tokens int"), kinds))
    assert len(same) == 4 and max(Counter(r[1] for r in same).values()) == 2


def test_documents_are_packed_close_to_the_bound(spark):
    placed_ = queries.p8_placement(spark, DATA).collect()
    for kind, capacity in (("short_window", 256), ("train_window", 1024)):
        own = [r for r in placed_ if r["container_kind"] == kind]
        total = sum(r["tokens"] for r in own)
        assert len({r["container_id"] for r in own if r["tokens"]}) <= 1.03 * -(-total // capacity) + 1


SAME = [
    ("Film of the left lung", "Fi​lm of the lеft lung"),
    ("ABC 12", "ＡＢＣ　１２"),
    ("café", "café"),
    ("a b", "a b"),
    ("film", "ﬁlm"),
    ("é", "e​́"),
    ("ё", "ё"),
    ("バ", "ﾊﾞ"),
    ("a-b", "a‑b"),
    ("12 µGy", "12 μGy"),
    ("Cο", "Co"),
    ("𝐀𝑏𝒸", "Abc"),
    ("Ⅳ ⅸ", "IV ix"),
    ("ℓ 5", "l 5"),
    ("օk ᴏk", "ok ok"),
    ("ﻻ", "لا"),
    ("ㄱ", "ᄀ"),
    ("ǆ", "dž"),
]
APART = [("abc", "Abc"), ("cafe", "café"), ("l", "1"), ("O", "0"), ("a b", "a  b"), ("👩‍⚕️", "👩⚕"), ("rn", "m"), ("a", "b"), ("x", "x."), ("x²", "x2"), ("①", "1"), ("½", "1/2"), ("H₂", "H2"), ("㎏", "kg")]


def test_texts_that_look_the_same_have_one_form(frame):
    pairs = SAME + APART
    given_ = [(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)]
    form = dict(map(tuple, lookalike.forms(frame(given_, "doc_id long, text string")).collect()))
    for i, (a, b) in enumerate(pairs):
        assert (form[2 * i] == form[2 * i + 1]) == (i < len(SAME)), (a, b, form[2 * i], form[2 * i + 1])


def test_forms_are_stable(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    once = lookalike.forms(documents)
    again = lookalike.forms(once, text_column="form")
    assert rows(once) == rows(again)


def test_found_pairs_and_what_does_not_count(frame):
    texts = [(1, "ab"), (2, "a​b"), (3, "ab"), (4, "ａｂ"), (5, None), (6, ""), (7, "​"), (8, " "), (9, "x" * 20000), (10, "х" * 20000), (None, "ａb"), (11, " ")]
    documents = frame([(i, t, "f") for i, t in texts], "doc_id long, text string, form string")
    want = [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (9, 10)]
    assert rows(lookalike.found(documents)) == sorted(want, key=repr) == rows(lookalike.found(documents, block=1))
    assert rows(lookalike.found(documents.union(documents))) == sorted(want, key=repr)
    assert rows(lookalike.found(documents.limit(0))) == []


def test_queries_run_and_say_which_have_sql(spark):
    names = set(queries.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 9)} | {"p7_ids", "p8_placement", "p5_splits"} <= names
    assert set(queries.oracle_sql()) <= names
    assert queries.p2_report(spark, DATA).columns == ["eval_version_id", "original_set_name", "reason", "eval_images", "pairs"]
