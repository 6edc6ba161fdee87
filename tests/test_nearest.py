"""Nearest rows in time without a key, against brute force with ties, nulls and repeated moments."""

import random

from tallyloom.operators.sequences import nearest_in_time


def test_nearest_in_time_equals_brute_force(spark):
    draw = random.Random(9)
    left = [(i, draw.randrange(0, 400)) for i in range(120)] + [(900, None)]
    right = [(i, draw.randrange(0, 400)) for i in range(60)] + [(60, 100), (61, 100), (62, None)]
    want = {}
    for i, at in left:
        near = [(abs(at - t), -t, j) for j, t in right if at is not None and t is not None and abs(at - t) <= 7]
        if near:
            skew, t, j = min(near)
            want[i] = (j, -t, skew)
    lf, rf = spark.createDataFrame(left, "left_id int, turn bigint"), spark.createDataFrame(right, "right_id int, log bigint")
    got = {r.left_id: (r.right_id, r.right_at, r.skew) for r in nearest_in_time(lf, rf, "turn", "log", 7).collect()}
    assert got == want and len(want) > 50
    assert nearest_in_time(lf.limit(0), rf, "turn", "log", 7).count() == 0 and nearest_in_time(lf, rf.limit(0), "turn", "log", 7).count() == 0
