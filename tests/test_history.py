import random

from pyspark.sql import functions as F

from pulsegrid.operators import history as h
from pulsegrid.plans.definitions import Retention


def sequential(seconds, policy):
    """The tiers kept by taking seconds one at a time."""
    due = dict.fromkeys(("day", "hour", "minute", "second"), 0)
    held = {t: [] for t in due}
    steps = [("day", 86400), ("hour", 3600), ("minute", 60), ("second", 1)]
    caps = {t: c for t, _, c in policy.items()}
    for s in seconds:
        hit = next((t for t, _ in steps if s >= due[t]), None)
        if hit is None:
            continue
        held[hit].append(s)
        held[hit] = held[hit][-caps[hit] :] if caps[hit] else []
        passed = [t for t, _ in steps].index(hit)
        for t, step in steps[passed:]:
            due[t] = (s // step + 1) * step
    return sorted((s, t) for t, all_ in held.items() for s in all_)


def rows(spark, seconds):
    return spark.createDataFrame(list(enumerate(seconds)), "seq long, second long")


def kept(spark, seconds, policy):
    return sorted((r.second, r.tier) for r in h.retain(h.assign_tiers(rows(spark, seconds)), policy).collect())


def test_closed_form_equals_sequential(spark, monkeypatch):
    monkeypatch.setattr(h, "ARRIVAL_BLOCK", 7)
    rng = random.Random(5)
    for policy in (Retention(), Retention(2, 3, 4, 5), Retention(0, 1, 2, 0)):
        at, seconds = rng.choice([-50, 0, 86390]), []
        for _ in range(120):
            at += rng.choice([0, 1, 1, 1, 7, 61, 3700, 90000, -5, -4000])
            seconds.append(at)
        assert kept(spark, seconds, policy) == sequential(seconds, policy)


def test_kept_ticks_of_one_a_second():
    for lo, hi in ((0, 200_000), (12_345, 400_000), (86_400, 86_400), (5, 70), (86_399, 172_801)):
        for policy in (Retention(), Retention(1, 2, 3, 4), Retention(0, 0, 2, 9)):
            assert h.kept_ticks(lo, hi, policy) == sequential(range(lo, hi + 1), policy)
    assert h.kept_ticks(9, 8) == [] and h.kept_ticks(-9, -2) == []


def test_sixty_days():
    seconds = [s for s, _ in h.kept_ticks(0, 60 * 86400 - 1)]
    now = 60 * 86400
    counts = [sum(s >= now - back for s in seconds) for back in (2, 120, 180, 7200, 2 * 86400, 3 * 86400)]
    assert counts == [2, 120, 123, 240, 288, 291] and len(seconds) == 348


def test_boundaries(spark):
    got = spark.range(1).select(h.next_boundary(F.lit(59), 60), h.next_boundary(F.lit(60), 60), h.next_boundary(F.lit(0), 3600)).first()
    assert tuple(got) == (60, 120, 3600)
