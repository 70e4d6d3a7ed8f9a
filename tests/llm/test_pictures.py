"""p1 and p2: repeats across batches and overlaps across splits, against brute force."""

import random

import numpy as np
import pytest

from tarnloom.llm import nearbits, overlaps, repeats
from tests.conftest import rows

IMAGES = "id long, image_batch_id long, file_name string, height int, width int, blake3_hash string, license_id long, date_captured date"


def flip(sig: int, bits: int, rng) -> int:
    for b in rng.sample(range(128), bits):
        sig ^= 1 << b
    return sig


def corpus(seed: int, n: int = 120):
    """Images over six batches, of which 4, 5 arrive; with copies, near copies at 1..14 bits, odd spellings."""
    rng = random.Random(seed)
    images, signatures = [], []
    for i in range(1, n + 1):
        sig, digest = rng.getrandbits(128), f"{rng.getrandbits(256):064x}"
        if i > 20 and rng.random() < 0.6:
            base = rng.randrange(i - 1)
            sig = flip(int(signatures[base][1], 16), rng.randint(0, 14), rng) if rng.random() < 0.7 else sig
            digest = images[base][5] if rng.random() < 0.4 else digest
        images.append((i, rng.randint(1, 6), f"{i}.png", 1, 1, digest, None, None))
        signatures.append((i, f"{sig:032x}"))
    return images, signatures


def spelled(images, signatures, rng):
    ways = [lambda h: h, lambda h: h.upper(), lambda h: "0x" + h, lambda h: f" {h}\n", lambda h: h[:16] + "-" + h[16:]]
    return [(*i[:5], rng.choice(ways)(i[5]), *i[6:]) for i in images], [(i, rng.choice(ways)(s)) for i, s in signatures]


def brute(images, signatures, new):
    sig = {i: int(s, 16) for i, s in signatures}
    out = set()
    for a in images:
        for b in images:
            if a[0] < b[0] and a[1] != b[1] and (a[1] in new or b[1] in new):
                if a[5] == b[5] or (sig[a[0]] ^ sig[b[0]]).bit_count() <= 10:
                    out.add((a[0], b[0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(frame, seed):
    images, signatures = corpus(seed)
    want = brute(images, signatures, {4, 5})
    im, sg = spelled(images, signatures, random.Random(seed))
    got = repeats.find_repeats(frame(im, IMAGES), frame(sg, "image_id long, signature string"), frame([(4, 1), (5, 2)], "image_batch_id long, arrival_no int"))
    assert rows(got) == want and want


def test_hot_class_is_cut_into_blocks_without_loss(frame):
    images = [(i, i % 3, f"{i}", 1, 1, "ab" * 32 if i % 4 else "cd" * 32, None, None) for i in range(40)]
    signatures = [(i, "0123456789abcdef" * 2) for i in range(40)]
    got = repeats.find_repeats(frame(images, IMAGES), frame(signatures, "image_id long, signature string"), frame([(2, 1)], "image_batch_id long, arrival_no int"), block=3)
    assert rows(got) == brute(images, signatures, {2})


def test_nothing_matches_missing_values_and_placeholders(frame):
    bad = [None, "", "0" * 64, "f" * 64, "xyz", "ab" * 31, "n/a", "a" * 20000]
    images = [(i, i, None, None, None, h, None, None) for i, h in enumerate(bad + bad)]
    signatures = [(i, s) for i, s in enumerate([None, "", "0" * 32, "F" * 32, "12", "g" * 32] * 2)] + [(None, "ab" * 16)]
    new = frame([(i, 1) for i in range(16)] + [(None, 3)], "image_batch_id long, arrival_no int")
    assert rows(repeats.find_repeats(frame(images, IMAGES), frame(signatures, "image_id long, signature string"), new)) == []


def test_empty_tables_and_extra_columns(frame):
    none = frame([], IMAGES), frame([], "image_id long, signature string"), frame([], "image_batch_id long, arrival_no int")
    assert rows(repeats.find_repeats(*none)) == []
    h, s = "12" * 32, "34ab" * 8
    im = frame([(1, 1, "a", 1, 1, h, None, None, 9, "z"), (2, 2, "a", 1, 1, h, None, None, 8, "y")], IMAGES + ", seq int, digest string")
    sg = frame([(1, s, 1), (2, s, 2), (2, s, 2)], "image_id long, signature string, hi int")
    assert rows(repeats.find_repeats(im, sg, frame([(2, None, 7)], "image_batch_id long, arrival_no int, batch int"))) == [(1, 2)]


NEW = "image_batch_id long, arrival_no int"
SIGNED = "image_id long, signature string"


def test_history_is_not_needed_once_it_is_stored(frame, spark, tmp_path):
    images, signatures = corpus(5)
    store = repeats.ChunkStore(spark, str(tmp_path / "store"), bucket_rows=10)
    part = lambda keep: (frame([i for i in images if keep(i[1])], IMAGES), frame([(i, s) for i, s in signatures if keep(next(x[1] for x in images if x[0] == i))], SIGNED))
    assert rows(repeats.find_repeats(*part(lambda b: b not in (4, 5)), frame([], NEW), store=store)) == []
    assert set(store.deliveries()) == {"history"}
    # the tables now hold nothing but what arrives, one batch after the other
    first = rows(repeats.find_repeats(*part(lambda b: b == 4), frame([(4, 1)], NEW), store=store))
    second = rows(repeats.find_repeats(*part(lambda b: b == 5), frame([(5, 2)], NEW), store=store))
    assert sorted(first + second, key=repr) == brute(images, signatures, {4, 5}) and first and second
    # an arrival that is delivered again changes nothing
    files = sorted(str(p) for p in (tmp_path / "store").rglob("*.parquet"))
    assert rows(repeats.find_repeats(*part(lambda b: b == 5), frame([(5, 2)], NEW), store=store)) == second
    assert sorted(str(p) for p in (tmp_path / "store").rglob("*.parquet")) == files


def test_files_of_a_failed_append_are_replaced(frame, spark, tmp_path):
    images, signatures = corpus(6, 60)
    store = repeats.ChunkStore(spark, str(tmp_path / "store"))
    tables = frame(images, IMAGES), frame(signatures, SIGNED), frame([(4, 1)], NEW)
    want = rows(repeats.find_repeats(*tables, store=store))
    for marker in (tmp_path / "store" / "stored").iterdir():
        if "history" in marker.name:
            marker.unlink()  # as if the driver had gone between the rows and the marker
    assert rows(repeats.find_repeats(*tables, store=store)) == want == brute(images, signatures, {4})


def test_what_an_arrival_reads_does_not_grow_with_the_history(frame, spark, tmp_path):
    read = []
    for n in (2_000, 16_000):
        rng = random.Random(n)
        rows_ = [(i, 1, "", 1, 1, f"{rng.getrandbits(256):064x}", None, None) for i in range(n)]
        arrival = [(n + i, 2, "", 1, 1, rows_[i][5], None, None) for i in range(3)]
        store = repeats.ChunkStore(spark, str(tmp_path / str(n)), bucket_rows=50)
        got = repeats.find_repeats(frame(rows_ + arrival, IMAGES), frame([], SIGNED), frame([(2, 1)], NEW), store=store)
        assert rows(got) == [(i, n + i) for i in range(3)]
        hit = store.hit("content", store._read("content", ["arrival-1"]), repeats.F.col("chunk"))
        assert set(store.deliveries().values()) == {1, n // 50}
        read.append(hit.count())
    assert read[1] < 1.5 * read[0]


def test_chunks_cover_a_record_once(spark, frame, tmp_path):
    """Records that share some chunks, but not all, are not the same; nor are those of a repeated delivery."""
    rng = random.Random(11)
    a = rng.randbytes(32)
    half = [a] + [a[:k] + rng.randbytes(32 - k) for k in range(8, 31)]
    images = [(i, 1 + i, "", 1, 1, d.hex(), None, None) for i, d in enumerate(half + [a])]
    got = repeats.find_repeats(frame(images, IMAGES), frame([], SIGNED), frame([(1 + len(half), 1), (5, 2)], NEW))
    assert rows(got) == [(0, len(half))]


def test_like_borders_make_no_hot_task(frame):
    """Signatures that share whole segments: crowded routes are cut, and no pair is lost or repeated."""
    rng = random.Random(8)
    base = rng.getrandbits(64) << 64
    sigs = [base | rng.getrandbits(64) for _ in range(150)]
    sigs += [flip(x, rng.randint(1, 12), rng) for x in sigs[:60]]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    table = lambda some: frame([(signed(x >> 64), signed(x & (1 << 64) - 1)) for x in some], "hi long, lo long")
    want = sorted((signed(x >> 64), signed(x & (1 << 64) - 1), signed(y >> 64), signed(y & (1 << 64) - 1)) for x in sigs[:100] for y in sigs if (x ^ y).bit_count() <= 10)
    for most in (20, 1_000_000):
        got = nearbits.near(table(sigs[:100]), table(sigs), 10, most)
        assert sorted(tuple(r)[:4] for r in got.collect()) == want
    assert nearbits.crowded(table(sigs), 6, 10, 4, 20).count() > 0


def test_content_bounds_are_content_defined():
    data = np.frombuffer(random.Random(3).randbytes(32 * 500), np.uint8).reshape(-1, 32)
    bounds = np.stack(repeats.chunk_bounds(data), 1)
    widths = np.diff(bounds, axis=1)
    assert (bounds[:, 0] == 0).all() and (bounds[:, -1] == 32).all() and ((widths == 0) | (widths >= repeats.LEAST)).all()
    assert (bounds[:, 1] < 32).mean() > 0.5


@pytest.mark.parametrize("m", [4, 5, 6, 7, 9, 11])
def test_every_segmentation_is_complete(m):
    rng = random.Random(m)
    parts = nearbits.segments(m, 10)
    assert sum(w for _, w, _ in parts) == 128
    for _ in range(2000):
        flips = flip(0, rng.randint(0, 10), rng)
        assert any(r >= 0 and (flips >> 128 - at - w & (1 << w) - 1).bit_count() <= r for at, w, r in parts)


def test_plan_adapts_to_the_sizes():
    assert nearbits.plan(10, 5_000, 1_000) >= nearbits.plan(10, 500_000, 100_000) >= nearbits.plan(10, 10**9, 10**7)


def test_overlaps_equal_brute_force(frame):
    images, signatures = corpus(7, 90)
    rng = random.Random(7)
    people = {i[0]: rng.choice(["ALB-00000012", "alb 12", "ALB-12-II", "LMN.0000.0007", "n/a", "", None]) for i in images}
    split = [(rng.choice([1, 1, 2, 3]), i[0]) for i in images] + [(2, 1), (1, 1), (1, 1), (9, 5), (1, None)]
    plan = frame([(1, "train", 0.7), (2, "validation", 0.15), (3, "test", 0.15)], "manual_set_version_id long, split_name string, share double")
    key = {"ALB-00000012": "a12", "alb 12": "a12", "ALB-12-II": "aii12", "LMN.0000.0007": "l7"}
    by, sig = {i[0]: i for i in images}, {i: int(s, 16) for i, s in signatures}
    want = set()
    for v, e in split:
        for w, t in split:
            if v in (2, 3) and w == 1 and e and t:
                s = key.get(people[e])
                if e == t or by[e][5] == by[t][5] or (sig[e] ^ sig[t]).bit_count() <= 10 or (s and s == key.get(people[t])):
                    want.add((v, min(e, t), max(e, t)))
    im, sg = spelled(images, signatures, rng)
    tables = frame(im, IMAGES), frame(sg, "image_id long, signature string"), frame(list(people.items()), "image_id long, subject_id string"), frame(split, "manual_set_version_id long, image_id long"), plan
    assert rows(overlaps.found(*tables)) == sorted(want, key=repr) and want
    assert {tuple(r)[3] for r in overlaps.overlaps(*tables, block=2).collect()} == {"member", "content", "near", "subject"}
    assert len(rows(overlaps.overlaps(*tables, block=2))) == len(rows(overlaps.overlaps(*tables)))


def test_overlaps_of_empty_tables(frame):
    t = [frame([], d) for d in (IMAGES, "image_id long, signature string", "image_id long, subject_id string", "manual_set_version_id long, image_id long", "manual_set_version_id long, split_name string, share double")]
    assert rows(overlaps.found(*t)) == []
