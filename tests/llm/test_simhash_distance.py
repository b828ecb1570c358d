"""Links within fewer bits than the query's two, in keys that count as crowded."""

import random

import pytest

from tallyforge.llm import simhash


@pytest.mark.parametrize("distance", [0, 1])
def test_crowded_links(spark, distance):
    rng = random.Random(4)
    fps = {0, 1 << 63}
    for _ in range(8):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for _ in range(rng.randint(1, 2)):
                x ^= 1 << rng.randint(0, 63)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance=distance, crowd=1).collect()
    pairs = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in got}
    assert pairs == {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= distance}
    assert bool(pairs) == (distance > 0)
