"""p3 to p6: consensus, representatives, related splits, vocabulary."""

import random
from collections import Counter, defaultdict
from datetime import date, datetime

import pytest

from tarnloom.llm import consensus, related, representative, vocabulary
from tests.conftest import rows

LABELS = "id long, annotation_batch_id long, image_id long, category_id long, score double, annotator_id long"


def planted(seed=1, images=500, persons=9, cats=8):
    """Images with a true category and persons who hit it, slip to the next entry or name the first."""
    rng = random.Random(seed)
    hit = [0.95, 0.9, 0.85, 0.9] + [0.08] * 3 + [0.3] * 2
    truth, labels, n = {}, [], 0
    for i in range(images):
        t = rng.randrange(cats)
        truth[i] = t + 1
        for p in rng.sample(range(persons), rng.randint(3, 5)):
            wrong = (t + 1) % cats if 4 <= p < 7 else 0 if p >= 7 else rng.randrange(cats)
            labels.append((n := n + 1, 1, i, (t if rng.random() < hit[p] else wrong) + 1, 0.7, p))
    return truth, labels


def tables(frame, labels, names=None, cats=8):
    people = frame(names or [(p, f"reader_{p}") for p in range(9)], "id long, name string")
    return frame(labels, LABELS), people, frame([(c, 1, f"c{c}", None) for c in range(1, cats + 1)], "id long, annotation_batch_id long, name string, supercategory string")


def test_consensus_beats_the_vote_where_people_slip_alike(frame):
    truth, labels = planted()
    got = {r["image_id"]: r["category_id"] for r in consensus.consensus(*tables(frame, labels)).collect()}
    votes = defaultdict(Counter)
    for _, _, i, c, _, _ in labels:
        votes[i][c] += 1
    vote = sum(min(v.items(), key=lambda x: (-x[1], x[0]))[0] == truth[i] for i, v in votes.items())
    right = sum(got[i] == t for i, t in truth.items())
    assert len(got) == len(truth) and right > vote and right / len(truth) > 0.9


def test_consensus_of_late_list_positions(frame):
    """Two who name the entry five places on outvote one who is right, beyond position 32 as before it."""
    rng, labels, truth, n = random.Random(3), [], {}, 0
    for i in range(400):
        truth[i] = t = 33 + rng.randrange(20)
        for p, right in ((0, True), (1, True), (2, True)) if i % 2 else ((0, True), (3, False), (4, False)):
            labels.append((n := n + 1, 1, i, t if right else t + 5, 0.7, p))
        if not i % 2:
            labels += [(n := n + 1, 1, 1000 + i, t, 0.7, p) for p in (0, 1)] + [(n := n + 1, 1, 1000 + i, t + 5, 0.7, 3 + i // 2 % 2)]
            truth[1000 + i] = t
    got = {r["image_id"]: r["category_id"] for r in consensus.consensus(*tables(frame, labels, cats=60)).collect()}
    assert sum(got[i] == t for i, t in truth.items()) > 0.95 * len(truth)
    early = [(a, b, c, d - 30, e, f) for a, b, c, d, e, f in labels]
    assert {r["image_id"]: r["category_id"] + 30 for r in consensus.consensus(*tables(frame, early, cats=60)).collect()} == got


def test_reliability_ranks_people(frame):
    _, labels = planted(2)
    rate = {r["person_id"]: r["hit_rate"] for r in consensus.reliability(*tables(frame, labels)).collect()}
    assert min(rate[p] for p in range(4)) > 0.75 > 0.5 > max(rate[p] for p in range(4, 9))


def test_one_person_under_several_names_counts_once(frame):
    names = [(1, "Reader_Kilo_01"), (2, " reader kilo  01"), (3, "ｒｅａｄｅｒ＿ｋｉｌｏ＿０１"), (4, "reаder-kilo-01"), (5, "reader_kilo_02"), (6, None), (7, "")]
    labels = [(i, 1, 1, 1, 0.5, i) for i in (1, 2, 3, 4, 5)]
    t = tables(frame, labels, names)
    assert rows(consensus.people(t[1])) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 6), (7, 7)]
    assert rows(consensus.consensus(*t)) == []
    assert [r[:3] for r in rows(consensus.consensus(frame([*labels, (9, 1, 1, 2, 0.5, 99)], LABELS), *t[1:]))] == [(1, 1, 1)]


def test_labels_without_a_claim(frame):
    odd = [(1, 1, 1, 1, 0.0, 1), (2, 1, 1, 1, None, 2), (3, None, 1, 1, 1.0, 3), (4, 1, None, 1, 1.0, 4), (5, 1, 1, None, 1.0, 5), (6, 1, 1, 1, 1.0, None)]
    assert rows(consensus.consensus(*tables(frame, odd))) == []
    empty = tables(frame, [])
    assert rows(consensus.consensus(*empty)) == rows(consensus.agreement(*empty[:2])) == []


def test_agreement_of_known_ratings(frame):
    # two raters, four items, three agree: by hand alpha = 1 - (2/8) / (1 - (5*4 + 3*2) / (8*7))
    pairs = [(1, 1), (1, 1), (2, 2), (1, 2)]
    labels = [(2 * i + k, 1, i, c, 1.0, k) for i, p in enumerate(pairs) for k, c in enumerate(p)]
    got = consensus.agreement(*tables(frame, labels)[:2]).first()
    assert got["alpha"] == pytest.approx(1 - (2 / 8) / (1 - 26 / 56)) and got["items"] == 4


IMAGES = "id long, image_batch_id long, file_name string, height int, width int, blake3_hash string, license_id long, date_captured date"
BATCHES = "original_set_name string, batch_kind string, version string, batch_id long, created_at timestamp"


def test_survivors_by_trust_recency_and_id(frame):
    h, d = "ab" * 32, date(2020, 1, 1)
    images = [(5, 1, "", 1, 1, h, 1, None), (4, 2, "", 1, 1, h.upper(), None, d), (6, 3, "", 1, 1, "0x" + h, 2, date(1900, 1, 1)), (7, 9, "", 1, 1, h, 1, d), (8, 1, "", 1, 1, "12" * 32, 1, d), (9, 1, "", 1, 1, None, 1, d), (10, 1, "", 1, 1, None, 1, d)]
    batches = [("a", "image", "V1", 1, datetime(2020, 1, 1)), ("a", "image", "V2", 2, datetime(2021, 1, 1)), ("b", "image", "V1", 3, None), ("b", "annotation", "V1", 1, datetime(2029, 1, 1))]
    subjects = frame([(5, "n/a"), (6, "X-1"), (7, "X-1"), (7, "X-1")], "image_id long, subject_id string")
    got = representative.survivors(frame(images, IMAGES), subjects, frame(batches, BATCHES), frame([("a", 2), ("b", 1)], "original_set_name string, trust_rank int"))
    assert rows(got) == sorted([(4, "license_id", 6), (4, "date_captured", 4), (4, "subject_id", 6), (4, "record", 7)], key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_survivors_equal_a_sort_of_each_group(frame, seed):
    rng = random.Random(seed)
    trust = {"a": 1, "b": 1, "c": 2}
    batches = [(s, "image", f"V{v}", 10 * k + v, rng.choice([None, datetime(2020, 1, v)])) for k, s in enumerate("abcd") for v in (1, 2)]
    images = [(i, rng.choice(batches)[3], "", 1, 1, f"{rng.randrange(12):02x}" * 16 + "ab" * 16, rng.choice([None, 1, 2]), rng.choice([None, date(1900, 1, 1), date(2020, 5, rng.randint(1, 9))])) for i in range(1, 80)]
    people = {i[0]: rng.choice(["X-1", "x 01", "Y-2", "n/a", "", None]) for i in images}
    made = {b[3]: (trust.get(b[0], 99), -(b[4].timestamp() if b[4] else -1e18)) for b in batches}
    groups = defaultdict(list)
    for i in images:
        groups[i[5]].append(i)
    want = []
    for g in (g for g in groups.values() if len(g) > 1):
        rank = sorted(g, key=lambda i: (*made[i[1]], i[0]))
        ok = {i[0]: (i[6] is not None, i[7] is not None and i[7].year > 1970, people[i[0]] in ("X-1", "x 01", "Y-2")) for i in g}
        low = min(i[0] for i in g)
        for k, name in enumerate(("license_id", "date_captured", "subject_id")):
            want += [(low, name, next(i[0] for i in rank if ok[i[0]][k]))] if any(x[k] for x in ok.values()) else []
        want.append((low, "record", max(rank, key=lambda i: sum(ok[i[0]]))[0]))
    got = representative.survivors(frame(images, IMAGES), frame(list(people.items()), "image_id long, subject_id string"), frame(batches, BATCHES), frame(list(trust.items()), "original_set_name string, trust_rank int"))
    assert rows(got) == sorted(want, key=repr)


def test_survivors_of_empty_tables(frame):
    t = frame([], IMAGES), frame([], "image_id long, subject_id string"), frame([], BATCHES), frame([], "original_set_name string, trust_rank int")
    assert rows(representative.survivors(*t)) == rows(representative.spellings(*t)) == []


def test_token_consensus_emits_an_existing_value():
    values = ["ALB-00000331", "ALB-00000331 ", "Alb/00000331", "ALB-331"]
    assert values[representative.closest(values, [1, 1, 1, 1])] in values[:2]
    assert representative.closest(["a-1", "a-2"], [1.0, 1.0]) == 0 and representative.closest(["a-1", "a-2"], [1.0, 2.0]) == 1
    assert representative.closest([""], [1.0]) == 0


@pytest.mark.parametrize("lists", [64, 3])
def test_spellings_in_blocks(frame, lists):
    images = [(i, 1, "", 1, 1, "ab" * 32, None, None) for i in range(12)]
    names = [(i, "ALB-00000012" if i % 2 else f"alb {'0' * i}12") for i in range(12)]
    got = rows(representative.spellings(frame(images, IMAGES), frame(names, "image_id long, subject_id string"), frame([("a", "image", "V1", 1, None)], BATCHES), frame([("a", 1)], "original_set_name string, trust_rank int"), lists=lists))
    assert [(g[0], g[1]) for g in got] == [(0, "ALB-00000012")] and got[0][2] == pytest.approx(12)


@pytest.mark.parametrize("lists", [64, 3])
def test_spellings_of_a_large_group_equal_one_alignment(frame, lists):
    for seed in range(3):
        rng = random.Random(seed)
        names = sorted({rng.choice(["ALB", "alb", "Alb", "NVK"]) + rng.choice("-_/ ") + rng.choice(["", "x "]) + f"{rng.randrange(60):0{rng.randint(2, 6)}d}" + rng.choice(["", " ", "-a"]) for _ in range(250)})
        ids = [(i, n) for i, n in enumerate(names)] + [(1000 + i, n) for i, n in enumerate(rng.choices(names, k=90))]
        images = [(i, 1, "", 1, 1, "ab" * 32, None, None) for i, _ in ids]
        votes = Counter(n for _, n in ids)
        want = names[representative.closest(names, [float(votes[n]) for n in names])]
        got = rows(representative.spellings(frame(images, IMAGES), frame(ids, "image_id long, subject_id string"), frame([("a", "image", "V1", 1, None)], BATCHES), frame([("a", 1)], "original_set_name string, trust_rank int"), lists=lists))
        assert got == [(0, want, float(len(ids)))]


def components(people, edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    first = {}
    for i, s in people:
        find(i)
        if s in first:
            a, b = find(first[s]), find(i)
            parent[max(a, b)] = min(a, b)
        first.setdefault(s, i)
    groups = defaultdict(list)
    for x in parent:
        groups[find(x)].append(x)
    return sorted(((x, min(g)) for g in groups.values() if len(g) > 1 for x in g), key=repr)


@pytest.mark.parametrize("seed,block", [(1, 50_000), (2, 2), (3, 50_000)])
def test_groups_equal_union_find(frame, seed, block):
    rng = random.Random(seed)
    people = sorted({(rng.randint(1, 80), f"S{rng.randint(1, 40)}") for _ in range(70)} | {(200 + i, "S1") for i in range(9)})
    edges = [(rng.randint(60, 120), rng.randint(60, 120)) for _ in range(25)] + [(i, i + 1) for i in range(300, 330)]
    given = [(i, s) for i, s in people] + [(1, "n/a"), (2, ""), (3, None), (None, "S1")]
    got = related.groups(frame(given + given[:5], "image_id long, subject_id string"), frame(edges + [(None, 3), (5, 5)] + edges[:3], "parent_image_id long, child_image_id long"), block)
    assert rows(got.select("image_id", "group_image_id")) == components(people, [e for e in edges if e[0] != e[1]])


def test_splits_keep_groups_and_shares(frame):
    rng = random.Random(4)
    people = [(i, f"S{rng.randint(1, 60)}") for i in range(1, 401)]
    images = frame([(i, 1, "", 1, 1, None, None, None) for i in range(1, 1001)] + [(None, 1, "", 1, 1, None, None, None)], IMAGES)
    edges = [(i, i + 500) for i in range(390, 420)]
    plan = frame([(1, "train", 0.7), (2, "validation", 0.15), (3, "test", 0.15)], "manual_set_version_id long, split_name string, share double")
    got = {r[0]: r[1] for r in related.splits(images, frame(people, "image_id long, subject_id string"), frame(edges, "parent_image_id long, child_image_id long"), plan, bins=50).collect()}
    assert set(got) == set(range(1, 1001))
    groups = defaultdict(set)
    for x, g in components(people, edges):
        groups[g].add(got[x])
    assert all(len(s) == 1 for s in groups.values())
    share = Counter(got.values())
    assert abs(share["train"] - 700) <= 20 and abs(share["test"] - 150) <= 20
    empty = frame([], IMAGES), frame([], "image_id long, subject_id string"), frame([], "parent_image_id long, child_image_id long")
    assert rows(related.splits(*empty, plan)) == [] and rows(related.splits(images, *empty[1:], plan.limit(0))) == []


def test_differencing_is_even():
    sizes = {40: 3, 17: 11, 9: 25, 3: 70, 1: 500}
    bins = related.difference(sizes, 10)
    weights = [sum(s * n for s, n in b.items()) for b in bins]
    assert sum(bins, Counter()) == Counter(sizes) and max(weights) - min(weights) <= 2


def test_values_map_by_name_beginning_and_slips(spark, frame):
    reference = frame([(1, "Normal", "NORM"), (2, "Pneumonia", "PNEU"), (3, "Pleural Effusion", "EFFU"), (4, "Ground Glass Opacity", "GGO"), (5, "Lung Nodule", "NODU"), (6, "Pleural Thickening", "PTHK"), (7, "Kyphosis", "KYPH")], "finding_id long, name string, abbrev string")
    names = {
        "NORMAL ": 1, "N.O.R.M.": 1, "(norm)": 1, "Norál": 1, "Nоrmal": 1, "Ｎｏｒｍａｌ": 1, "No­mrmal": 1, "suspected Pneuomnia [old]": 2, "r/o pneumonia (mild)": 2, "Pneum...": 2,
        "EFFUSION, PLEURAL": 3, "Pleural eff.": 3, "Pleural": 0, "opacity, ground, glass": 4, "Gruond glsas opacity": 4, "lungnodule": 5, "lung volume": 0, "Pleural tap": 0, "kyphoplasty": 0,
        "": 0, None: 0, "---": 0, "???": 0, "x" * 5000: 0, "日本": 0, "1: Lung Nodule/severe": 5, "Lnug Noudle": 5, "lugn nudole x": 0,
    }
    given = [(i, 1, n, None, n) for i, n in enumerate(names)] + [(0, 1, "NORMAL ", None, None), (None, 1, "Normal", None, None)]
    categories = frame(given, "id long, annotation_batch_id long, name string, supercategory string, finding_id string")
    got = dict(rows(vocabulary.map_values(spark, categories, reference)))
    assert {n: got[i] for i, n in enumerate(names)} == names and len(got) == len(names)
    assert set(dict(rows(vocabulary.map_values(spark, categories, reference.limit(0)))).values()) == {0}
    assert rows(vocabulary.map_values(spark, categories.limit(0), reference)) == []


def test_short_names_and_any_qualifier(spark, frame):
    """Slips by length, in entries of any length; words around a name qualify it."""
    reference = frame([(1, "Rib", "RB"), (2, "Cyst", None), (3, "Edema", "EDM"), (4, "Lung Edema", None), (5, "Ox", "")], "finding_id long, name string, abbrev string")
    names = {
        "rbi": 1, "ribs": 1, "rub": 1, "ruby": 0, "cysts": 2, "cyts": 2, "cist": 2, "crusts": 0, "edme": 0, "edmea": 3, "oedema": 3, "oedama": 0, "eda": 0, "EDM": 3, "EDN": 0, "ox": 5, "oxx": 0,
        "questionable edema, third review": 3, "possibly lung edema of the lower lobes": 4, "some lnug edema": 4, "edema lung": 4, "a cyst (not edema)": 2, "nothing of that kind": 0,
    }
    categories = frame([(i, 1, n, None) for i, n in enumerate(names)], "id long, annotation_batch_id long, name string, supercategory string")
    got = dict(rows(vocabulary.map_values(spark, categories, reference)))
    assert {n: got[i] for i, n in enumerate(names)} == names


def test_slips_equal_restricted_edit_distance(spark, frame):
    """Random slips against an exhaustive comparison."""
    import duckdb

    rng = random.Random(6)
    reference = ["pneumothorax", "cardiomegaly", "atelectasis", "emphysema", "fibrosis"]
    names = set()
    for _ in range(150):
        w = list(rng.choice(reference))
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(len(w) - 1)
            kind = rng.randrange(4)
            if kind == 0:
                w[k], w[k + 1] = w[k + 1], w[k]
            elif kind == 1:
                w[k] = rng.choice("abcdefgh")
            elif kind == 2:
                del w[k]
            else:
                w.insert(k, rng.choice("abcdefgh"))
        names.add("".join(w))
    names = sorted(n for n in names if not any(r.startswith(n) for r in reference))
    con = duckdb.connect()
    far = {(a, b): con.execute("SELECT damerau_levenshtein(?, ?)", [a, b]).fetchall()[0][0] for a in names for b in reference}
    got = dict(rows(vocabulary.map_values(spark, frame([(i, 1, n, None) for i, n in enumerate(names)], "id long, annotation_batch_id long, name string, supercategory string"), frame([(i + 1, r, None) for i, r in enumerate(reference)], "finding_id long, name string, abbrev string"))))
    for i, n in enumerate(names):
        best = min(far[n, r] for r in reference)
        if best <= 2:
            assert got[i] and far[n, reference[got[i] - 1]] == best, n
        elif best > 3:
            assert got[i] == 0, n
