import datetime as dt
import random
from collections import Counter

import pytest

from auditspark.streaming import statistics as S
from auditspark.streaming import voucher_state as V

HOUR = dt.timedelta(hours=1)
START = dt.datetime(2024, 1, 1)
EVENTS = "id long, ts timestamp, seq long, status string"


def write(spark, rows, at, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)


def follow(spark, at):
    V.track(spark.readStream.schema(EVENTS).parquet(f"{at}/in"), f"{at}/out", f"{at}/state", 6 * 3_600_000, "3 hours", ("done", "failed")).awaitTermination()


def test_state_is_the_batch_answer_after_restarts_and_out_of_order(spark, tmp_path):
    rng = random.Random(2)
    at, every = str(tmp_path), []
    for part in range(4):
        rows = [(rng.randrange(20), START + 12 * HOUR * part + HOUR * rng.random() * 12, n + 1000 * part, rng.choice(["pending", "pending", "done"])) for n in range(40)]
        # Out of order within the bound, at one time, and without an id.
        rows += [(99, START + 12 * HOUR * part, 2, "pending"), (99, START + 12 * HOUR * part, 1, "done"), (None, START, 0, "done")] if part < 2 else []
        rng.shuffle(rows)
        every += rows
        write(spark, rows, f"{at}/in")
        follow(spark, at)  # each time from the checkpoint
    got = {(r.id, r.status, r.at, r.stuck) for r in V.standing(spark.read.parquet(f"{at}/out")).collect()}
    want = {(r.id, r.status, r.at, r.stuck) for r in V.standing_of(spark.createDataFrame(every, EVENTS), 6 * 3_600_000, "3 hours", ("done", "failed")).collect()}
    assert got == want and len({s for *_, s in got}) == 2 and {r[1] for r in got if r[0] == 99} == {"pending"}


def test_a_stuck_voucher_goes_on_and_late_events_are_dropped(spark, tmp_path):
    at = str(tmp_path)
    state = lambda: {r.id: (r.status, r.stuck) for r in V.standing(spark.read.parquet(f"{at}/out")).collect()}
    write(spark, [(1, START, 1, "pending"), (2, START + 20 * HOUR, 2, "done")], f"{at}/in")
    follow(spark, at)
    assert state() == {1: ("pending", True), 2: ("done", False)}
    write(spark, [(1, START + 21 * HOUR, 3, "done"), (3, START, 4, "pending")], f"{at}/in")
    follow(spark, at)
    assert state() == {1: ("done", False), 2: ("done", False)}


ROWS = "category string, f_amount double, f_party string, f_date date, risk string"


@pytest.mark.parametrize("again", [False, True])
def test_statistics_follow_each_batch_and_a_batch_that_runs_twice_counts_once(spark, tmp_path, again):
    rng = random.Random(7)
    at, every = str(tmp_path), []
    for part in range(3):
        rows = [(rng.choice(["A", "B", None]), rng.choice([None, float(rng.randint(1, 900))]), rng.choice([None, "p", "q", f"r{part}"]), dt.date(2024, 1, rng.randint(1, 28)), rng.choice("RAN")) for _ in range(50)]
        every += rows
        write(spark, rows, f"{at}/in", ROWS)
        for q in S.keep(spark.readStream.schema(ROWS).parquet(f"{at}/in"), f"{at}/out", f"{at}/state"):
            q.awaitTermination()
        if again and part == 1:  # as if the last batch had failed after it wrote: its commit is missing, so it is run again
            for folder in ("sums", "parties"):
                for name in (tmp_path / "state" / folder / "commits").glob("*1*"):
                    name.unlink()
        got = {r.category: r for r in S.current(spark, f"{at}/out").collect()}
        for c in {r[0] for r in every}:
            own = [r for r in every if r[0] == c]
            amounts = [r[1] for r in own if r[1] is not None]
            g = got[c]
            assert (g.total, g.with_amount, g.without_amount, g.parties) == (len(own), len(amounts), len(own) - len(amounts), len({r[2] for r in own} - {None}))
            assert (g.risky, g.first_date, g.last_date, g.max_amount) == (Counter(r[4] for r in own)["R"], min(r[3] for r in own), max(r[3] for r in own), max(amounts))
            assert g.avg_amount == pytest.approx(sum(amounts) / len(amounts), abs=1e-3)


def test_vouchers_of_a_bundle_share_state_and_timer_and_are_told_apart(spark, tmp_path, monkeypatch):
    """Neighbours wait for different times and one is overtaken; far fewer keys than vouchers reach Python."""
    calls = spark.sparkContext.accumulator(0)
    take = V.Standing.handleInputRows

    class Counted(V.Standing):
        def handleInputRows(self, key, rows, timerValues):
            calls.add(1)
            yield from take(self, key, rows, timerValues)

    monkeypatch.setattr(V, "Standing", Counted)
    at, ids = str(tmp_path), [*range(-300, 300), 2**62]
    first = [(i, START + HOUR * (i % 7), n, "done" if i % 3 == 0 else "pending") for n, i in enumerate(ids)]
    second = [(i, START + 9 * HOUR, 2000 + n, "pending") for n, i in enumerate(ids) if i % 2 == 0]
    third = [(9999, START + 17 * HOUR, 9000, "done")]  # the mark is at 14 hours: the second events wait, until 15 hours, and the first do not
    every = []
    for part in (first, second, third):
        every += part
        write(spark, part, f"{at}/in")
        follow(spark, at)
        got = {(r.id, r.status, r.at, r.stuck) for r in V.standing(spark.read.parquet(f"{at}/out")).collect()}
        want = {(r.id, r.status, r.at, r.stuck) for r in V.standing_of(spark.createDataFrame(every, EVENTS), 6 * 3_600_000, "3 hours", ("done", "failed")).collect()}
        assert got == want
    assert {s for *_, s in got} == {True, False}
    assert 0 < calls.value <= 12
