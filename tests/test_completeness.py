"""Inputs on which an operator once did less than its whole job."""

import random

from auditlake.operators import audits


def _greedy(rows, most=6):
    leader = {}
    for i, (name, h) in enumerate(rows):
        own = [n for n, x in rows[:i] if n not in leader and (h ^ x).bit_count() <= most]
        if own:
            leader[name] = own[0]
    return leader


def test_image_groups_reached_through_a_follower(spark):
    chain = [(f"a{k}", (1 << 5 * k) - 1) for k in range(9)]
    r = random.Random(1)
    rows = chain + [(f"b{k:02}", r.getrandbits(16) << 46) for k in range(60)]
    got = {x["name"]: x["leader"] for x in audits.image_duplicates(spark.createDataFrame(rows, "name string, ahash long")).collect()}
    assert got == _greedy(rows) and got["a1"] == "a0" and got["a3"] == "a2"
