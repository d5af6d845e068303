import random

import pytest

from varuvakt.operators.reconcile import reconcile
from varuvakt.operators.throttle import throttle_attempts


def counted(log, limit, window_ms):
    """One attempt at a time."""
    state, out = {}, []
    for bucket, ip, ts, attempt in sorted(log, key=lambda a: (a[2], a[3])):
        used, expires = state.get((bucket, ip), (0, 0))
        if ts >= expires:
            used = 0
        if used < limit:
            state[bucket, ip] = (used + 1, ts + window_ms)
        out.append((bucket, ip, ts, attempt, used < limit))
    return sorted(out, key=repr)


def frame(spark, log):
    return spark.createDataFrame(log, "bucket string, ip string, ts long, attempt_id long")


def test_expiry_and_no_renewal_by_denied_attempts(spark, rows):
    log = [("login", "a", ts, i) for i, ts in enumerate([0, 10, 20, 999, 1009, 1010, 1011, 2010, 3011])]
    got = rows(throttle_attempts(frame(spark, log), 2, 1), "ts", "allowed")
    assert dict(got) == {0: True, 10: True, 20: False, 999: False, 1009: False, 1010: True, 1011: True, 2010: False, 3011: True}


@pytest.mark.parametrize(("limit", "fan_out"), [(1, 2), (3, 2), (5, 4)])
def test_hot_keys_match_a_sequential_count(spark, rows, limit, fan_out):
    rng = random.Random(limit)
    log = []
    for ip, mean in (("a", 40), ("b", 300), ("c", 900), ("d", 2500)):
        ts = rng.randrange(5000)
        for _ in range(250):
            ts += rng.choice([0, 1, int(rng.expovariate(1 / mean)), int(rng.expovariate(1 / mean))])
            log.append((rng.choice(["login", "signup"]) if ip == "b" else "login", ip, ts, len(log)))
    # Exact boundaries: attempts on slot edges and exactly at the expiry.
    log += [("login", "e", ts, 10_000 + i) for i, ts in enumerate([0, 999, 1000, 1999, 2000, 2999, 3000, 3999, 4998, 4999, 5000, 9000] * 2)]
    want = counted(log, limit, 1000)
    for hot_rows in (5, 10**9):
        assert rows(throttle_attempts(frame(spark, log), limit, 1, hot_rows=hot_rows, fan_out=fan_out)) == want


def test_reconcile(spark, rows):
    one = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3)], "id long, t string, n long")
    two = spark.createDataFrame([(1, "a", 1), (2, "b", 0), (4, "c", 3)], "id long, t string, n long")
    assert rows(reconcile(one, two, ["id"], "x")) == [("x", 3, 3, 1, 1, 1)]
    assert rows(reconcile(one, one, ["id"], "x")) == [("x", 3, 3, 0, 0, 0)]
    points = spark.createDataFrame([(1, 5), (1, 5), (2, 6)], "p long, v long")
    assert rows(reconcile(points, points.distinct(), ["p", "v"], "y")) == [("y", 3, 2, 0, 0, 1)]
    assert rows(reconcile(points.limit(0), points, ["p", "v"], "y")) == [("y", 0, 3, 0, 2, 0)]
