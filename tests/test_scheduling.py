"""Round-robin by answers: the sort over recorded ones, a queue by hand, and the stream agree."""

import random
from collections import deque

import pytest

from quern.streaming import scheduling

WORK = "run long, item long, member boolean, ord long, used int, done boolean"
ANSWERS = "run long, item long, round int, finished boolean"
EVENTS = "run long, seq long, kind string, item long, member boolean, ord long, used int, done boolean, round int, finished boolean"


def recorded(seed):
    rnd = random.Random(seed)
    work = [(run, 100 * run + i, rnd.random() < 0.4, rnd.randint(0, 5), rnd.choice([0, 0, 1, 6]), rnd.random() < 0.1) for run in range(1, 9) for i in range(rnd.randint(0, 7))]
    answers = [(w[0], w[1], r, rnd.random() < 0.3) for w in work for r in range(1, 7) if rnd.random() < 0.9]
    return work, answers


def by_hand(work, answers, budget):
    """A run's queues, popped one by one; an answer that is missing doesn't finish."""
    known, out = {(a[0], a[1], a[2]): a[3] for a in answers}, []
    for run in {w[0] for w in work}:
        mine, turn = sorted((w for w in work if w[0] == run and not w[5] and w[4] < 6), key=lambda w: (w[3], w[1])), 0
        rounds = {w[1]: w[4] for w in mine}
        first = [w[1] for w in mine if not w[2]]
        for queue in (deque(sorted(first, key=lambda i: rounds[i] > 0)), deque(w[1] for w in mine if w[2])):
            while queue and turn < budget:
                item = queue.popleft()
                turn, rounds[item] = turn + 1, rounds[item] + 1
                out.append((run, turn, item, rounds[item]))
                if not known.get((run, item, rounds[item])) and rounds[item] < 6:
                    queue.append(item)
    return sorted(out)


@pytest.mark.parametrize("seed,budget", [(1, 7), (2, 100), (3, 0)])
def test_replay_is_the_queue(spark, seed, budget):
    work, answers = recorded(seed)
    calls = scheduling.replayed(spark.createDataFrame(work, WORK), spark.createDataFrame(answers, ANSWERS), budget)
    assert sorted(map(tuple, calls.collect())) == by_hand(work, answers, budget)
    if budget == 100:
        ends = {(r.run, r.item): (r.rounds, r.status) for r in scheduling.outcomes(spark.createDataFrame(work, WORK), spark.createDataFrame(answers, ANSWERS), calls).collect()}
        assert len(ends) == len(work) and {s for _, s in ends.values()} == {"done"}


def test_the_stream_agrees_with_the_replay(spark, tmp_path):
    work, answers = recorded(4)
    work = [w for w in work if w[4] < 6]
    answers = list({a[:3]: a for a in [*answers, *((w[0], w[1], r, False) for w in work for r in range(1, 7))][::-1]}.values())
    want = by_hand(work, answers, 9)
    rnd = random.Random(5)
    events = [(w[0], 0, "work", w[1], w[2], w[3], w[4], w[5], None, None) for w in work] + [(run, 1, "start", *[None] * 7) for run in {w[0] for w in work}]
    late = [(a[0], 2, "answer", a[1], None, None, None, None, a[2], a[3]) for a in answers]
    rnd.shuffle(late)
    parts = [events, late[: len(late) // 3], late[len(late) // 3 : len(late) // 2], late[len(late) // 2 :] + late[:3]]
    source = str(tmp_path / "events")
    for k, part in enumerate(parts):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{source}/{k}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    asked = scheduling.scheduled(stream, 9)
    run = asked.writeStream.format("memory").queryName("asked").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(300)
    got = sorted(tuple(r) for r in spark.table("asked").collect())
    assert got == want and len(got) > 20
