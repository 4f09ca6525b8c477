"""Likeness at scale: hashes by chunks, galleries by blocks, against all pairs."""

import random

import pytest

from vigil.operators import similarity


def test_near_hashes_against_all_pairs(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = base + [b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(9))) for b in base for _ in range(3)]
    values = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(values)), "id long, h long")
    for most in (0, 3, 5, 8):
        want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if ((values[i] ^ values[j]) & (1 << 64) - 1).bit_count() <= most}
        got = [(r.a, r.b) for r in similarity.near_hashes(df, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("most", [16_384, 8])
def test_galleries_of_any_size(spark, monkeypatch, most):
    """In blocks of a few poses, and with probes in groups, the same as by one matrix."""
    monkeypatch.setattr(similarity, "MAX_POSES", most)
    monkeypatch.setattr(similarity, "GROUP", 50)
    rng = random.Random(2)
    vector = lambda: [rng.gauss(0, 1) for _ in range(6)]
    poses = [(p, k, vector()) for p in range(9) for k in range(5)] + [(20, 0, [0.0] * 6)]
    poses.append((30, 0, poses[7][2]))  # as person 1's third pose
    probes = [(i, vector()) for i in range(160)] + [(200, [0.0] * 6), (201, None), (202, poses[7][2])]
    got = {r.vec_id: r for r in similarity.nearest_identity(spark.createDataFrame(probes, "vec_id long, embedding array<double>"), spark.createDataFrame(poses, "person_id long, pose_idx long, embedding array<double>"), 0.7).collect()}
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    assert set(got) == set(range(160)) | {202}
    for i, v in probes:
        if i in got:
            s, person = max((cosine(v, e), -p) for p, _, e in poses if any(e))
            assert abs(got[i].similarity - s) < 1e-5 and got[i].person_id == (-person if s >= 0.7 else None)
    assert got[202].person_id == 1 and got[202].status == "known"
