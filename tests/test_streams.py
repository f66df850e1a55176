"""Streaming state over several batches against a plain replay."""

import random

import pytest

from lectern.streaming import jobs as S


def replay(events, window):
    """What one share of a class does with (page, at, done) in batches."""
    free, places, waiting, out = list(range(window))[::-1], {}, [], []
    for batch in events:
        for page, _, done in sorted(batch, key=lambda e: e[1]):
            if done:
                if page in places:
                    free.append(places.pop(page))
                elif page in waiting:
                    waiting.remove(page)
            else:
                waiting.append(page)
            while free and waiting:
                places[waiting[0]] = free.pop()
                out.append((waiting[0], places[waiting.pop(0)]))
    return out


def test_residency_waits_and_frees_places(spark):
    r = random.Random(1)
    events, at = [], 0
    alive = []
    for page in range(0, 120, 2):  # all of share 0
        at += 1
        events.append(("base", page, at, False))
        alive.append(page)
        while len(alive) > 2 and r.random() < 0.45:
            at += 1
            events.append(("base", alive.pop(r.randrange(len(alive))), at, True))
    events += [("big", p * 2, p * 3 + 1, False) for p in range(5)]
    rows = spark.createDataFrame(events, "class string, page long, at long, done boolean")
    got = S.drain(S.admit(S.stream_parts(rows, "at", 5), 6, 2), "admission").collect()
    top = max(e[2] for e in events)
    width = -(-top // 5)
    batches = [[(p, t, d) for c, p, t, d in events if c == "base" and k * width < t <= (k + 1) * width] for k in range(5)]
    assert sorted((x.page, x.place) for x in got if x["class"] == "base") == sorted(replay(batches, 3))
    assert sorted((x.page, x.place) for x in got if x["class"] == "big") == [(0, 0), (2, 1), (4, 2)]
    with pytest.raises(ValueError):
        S.admit(rows, 7, 2)


def test_late_steps_are_left_out_and_a_second_pass_counts_once(spark):
    steps = spark.createDataFrame([(1, 1, 0.5, False, 0), (1, 3, 0.25, False, 0), (1, 2, 0.9, False, 1), (1, 4, 0.25, True, 2), (1, 5, 0.1, True, 3), (2, 1, 0.5, False, 3)], "stream long, at long, p1 double, eos boolean, batch long")
    got = S.drain(S.retire(S.stream_parts(steps, "batch", 4).drop("batch")), "retire").collect()
    assert [(x.stream, x.ntok, x.conf) for x in got] == [(1, 4, (1 + 0.5 + 0.25 + 0.25) / 4)]
    pages = spark.createDataFrame([(1, 2, 0, 5, 0), (1, 2, 0, 7, 1), (1, 2, 1, 1, 2), (2, 2, 0, 9, 3)], "job_id long, pages long, page long, words long, batch long")
    assert [tuple(x) for x in S.drain(S.complete(S.stream_parts(pages, "batch", 4).drop("batch")), "completion").collect()] == [(1, 2, 8)]


def test_counters(spark):
    c = S.Counters()
    spark.streams.addListener(c)
    try:
        rows = spark.createDataFrame([(k, 3, k % 3, 1) for k in range(9)], "job_id long, pages long, page long, words long")
        S.drain(S.complete(S.stream_parts(rows, "job_id", 3)), "completion")
        import time

        for _ in range(50):
            if c.rows >= 9 and not c.running:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(c)
    assert (c.rows, c.running, c.failed) == (9, 0, 0) and c.batches >= 3
