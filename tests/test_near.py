"""Election of representatives against the sequential fold that defines it."""

import random

import pytest

from curaspark.operators import near

ROWS = "item_id string, candidate_id long, sha256 string, phash long, picture struct<aspect double, pixels array<int>>, x_photo boolean, auto_select boolean, entity_match boolean, detail double, width int, height int, total double"


def same(a, b):
    """The comparison of two pictures, by plain loops over 8 x 8 pixels in tiles of 4 x 4."""
    if a is None or b is None or abs(a[0] - b[0]) > 0.01:
        return False
    off = [abs(x - y) for x, y in zip(a[1], b[1], strict=True)]
    tiles = [sum(off[8 * (ty * 4 + y) + tx * 4 + x] for y in range(4) for x in range(4)) for ty in range(2) for tx in range(2)]
    return sum(off) / 64 <= 3.0 and sum(x > 16 for x in off) / 64 <= 0.025 and max(tiles) / 16 <= 8.0


def fold(rows, old_sha, old_bits):
    out = {}
    key = lambda r: (not r[5], not r[6], not r[7], -(r[8] or 0.0), -min(r[9] or 0, 1280) * min(r[10] or 0, 720), -(r[11] or 0.0), r[1])
    for item in {r[0] for r in rows}:
        leaders = []
        for r in sorted((r for r in rows if r[0] == item), key=key):
            of = next((p for p in leaders if r[2] and p[2] == r[2]), None)
            kind = "sha256" if of else None
            if not of:
                of = next((p for p in leaders if r[3] is not None and p[3] is not None and bin((r[3] ^ p[3]) & (2**64 - 1)).count("1") <= 8 and same(r[4], p[4])), None)
                kind = "perceptual_pixels" if of else None
            possible = None
            if not of:
                possible = next((p[1] for p in leaders if r[3] is not None and p[3] == r[3]), None)
                leaders.append(r)
            out[r[1]] = (of[1] if of else None, kind, possible, (r[2] is not None and r[2] in old_sha) or (r[3] is not None and r[3] in old_bits))
    return out


def candidates(seed, n):
    """Few scenes with noisy copies, hashes shared by different pictures, equal files, nulls, and one hot item and scene."""
    rng = random.Random(seed)
    scenes = [([rng.randrange(256) for _ in range(64)], rng.getrandbits(64)) for _ in range(12)]
    rows = []
    for i in range(n):
        pixels, bits = scenes[0] if i % 3 == 0 else rng.choice(scenes)
        noise = rng.choice([0, 0, 1, 2, 6])
        pixels = [max(0, min(255, p + rng.randint(-noise, noise))) for p in pixels]
        if rng.random() < 0.2:
            at = rng.randrange(64)
            pixels[at] = (pixels[at] + 128) % 256
        for _ in range(rng.choice([0, 0, 1, 4, 9])):
            bits ^= 1 << rng.randrange(64)
        bits = rng.choice(scenes)[1] if rng.random() < 0.05 else bits
        signed = bits - 2**64 if bits >= 2**63 else bits
        picture = None if rng.random() < 0.05 else (rng.choice([1.0, 1.0, 1.5]), pixels)
        sha = rng.choice([None, f"f{rng.randrange(n // 4)}", f"u{i}"])
        rows.append((f"n{0 if i % 2 else rng.randrange(4)}", i, sha, None if rng.random() < 0.05 else signed, picture, rng.random() < 0.1, rng.random() < 0.7, rng.choice([None, True, False]), rng.choice([None, 0.1, 0.5, 0.9]), rng.choice([None, 400, 2000]), rng.choice([None, 300, 900]), rng.choice([None, 10.0, 90.0])))
    return rows


@pytest.mark.parametrize("seed,n", [(1, 160), (2, 260)])
def test_election_equals_the_sequential_fold(spark, seed, n):
    rows = candidates(seed, n)
    old = [(r[2], None) for r in rows[::17]] + [(None, r[3]) for r in rows[::19]]
    got = near.representatives(spark.createDataFrame(rows, ROWS).repartition(3), spark.createDataFrame(old, "sha256 string, phash long"), near.pixel_confirmation(8, 4))
    want = fold(rows, {s for s, _ in old if s}, {b for _, b in old if b is not None})
    assert {r["candidate_id"]: (r["duplicate_of"], r["duplicate_kind"], r["possible_duplicate_of"], r["historical"]) for r in got.collect()} == want
    kinds = {v[1] for v in want.values()}
    assert kinds == {None, "sha256", "perceptual_pixels"} and any(v[2] is not None for v in want.values()) and any(v[3] for v in want.values())


def test_no_rows_and_no_history(spark):
    empty, none = spark.createDataFrame([], ROWS), spark.createDataFrame([], "sha256 string, phash long")
    assert near.representatives(empty, none, near.pixel_confirmation(8, 4)).count() == 0
    one = spark.createDataFrame([("n", 1, None, None, None, None, None, None, None, None, None, None)], ROWS)
    assert [tuple(r)[-4:] for r in near.representatives(one, none, near.pixel_confirmation(8, 4)).collect()] == [(None, None, None, False)]


@pytest.mark.parametrize("distance", [0, 3, 8])
def test_near_scenes_are_all_pairs_once(spark, distance):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(5)]
    rows = []
    for i in range(150):
        bits = base[i % 5]
        for _ in range(rng.randrange(12)):
            bits ^= 1 << rng.randrange(64)
        rows.append((i % 2, i, bits - 2**64 if bits >= 2**63 else bits))
    got = [tuple(r) for r in near.near_scenes(spark.createDataFrame(rows, "g int, k int, b long"), "g", "k", "b", distance).collect()]
    want = [(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and bin((a[2] ^ b[2]) & (2**64 - 1)).count("1") <= distance]
    assert sorted(got) == sorted(want) and want
