"""Whose turn it is to be asked: round-robin in which every answer decides what is asked next.

A run's items wait in two queues, representatives before members.  The first of a queue is asked for one round; if
its answer doesn't finish it and rounds are left, it goes to the queue's end.  A call costs one of the run's budget.
``replayed`` finds all calls of recorded answers at once: how many rounds an item takes is known from
its answers, and the k-th pass through a queue holds those that need k rounds, so the calls are a sort and no loop.
``scheduled`` does it while answers come in: the queues are state, and each answer brings out the next question.

Defined cases: an answer that wasn't recorded doesn't finish its item; answers that come before their question wait; a
second answer for a round is ignored; items with no round left, or ``done``, are never asked; of equal ``ord``
the smaller item comes first; runs without items ask nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: rounds that an item is asked for at most.
MAX_ROUNDS = 6


def replayed(work: DataFrame, answers: DataFrame, budget: int | None, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """run, turn, item and round of every call.

    ``work``: run, item, member, ord, used (rounds it was asked for before), done; ``answers``: run, item, round, finished.
    """
    last = answers.where("finished").join(work.select("run", "item", "used"), ["run", "item"]).where(F.col("round") > F.col("used")).groupBy("run", "item").agg(F.min("round").alias("last"))
    need = F.least(F.coalesce("last", F.lit(max_rounds)), F.lit(max_rounds))
    items = work.where("not done").join(last, ["run", "item"], "left").withColumn("need", need).where(F.col("need") > F.col("used"))
    calls = items.withColumn("round", F.explode(F.sequence(F.col("used") + 1, F.col("need"))))
    # representatives that were asked before begin behind the others
    order = Window.partitionBy("run").orderBy("member", F.col("round") - F.col("used"), ~F.col("member") & (F.col("used") > 0), "ord", "item")
    turns = calls.withColumn("turn", F.row_number().over(order))
    return (turns if budget is None else turns.where(F.col("turn") <= budget)).select("run", "turn", "item", F.col("round").cast("int").alias("round"))


def outcomes(work: DataFrame, answers: DataFrame, calls: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """run, item, rounds (used in all) and status: done, or pending where the budget ended before."""
    asked = calls.groupBy("run", "item").agg(F.max("round").alias("asked"))
    ended = calls.join(answers.where("finished").select("run", "item", "round").distinct(), ["run", "item", "round"]).select("run", "item").distinct().withColumn("ended", F.lit(True))
    both = work.join(asked, ["run", "item"], "left").join(ended, ["run", "item"], "left")
    rounds = F.coalesce("asked", "used")
    over = F.col("done") | F.coalesce("ended", F.lit(False)) | (rounds >= max_rounds)
    return both.select("run", "item", rounds.alias("rounds"), F.when(over, "done").otherwise("pending").alias("status"))


class _Queues:
    """The state of a run."""

    def __init__(self, saved: str | None, budget: int | None):
        kept = json.loads(saved) if saved else {}
        self.waiting, self.queues, self.asked = kept.get("waiting", []), kept.get("queues"), kept.get("asked")
        self.rounds, self.early, self.turn, self.budget = kept.get("rounds", {}), kept.get("early", {}), kept.get("turn", 0), budget

    def saved(self) -> str:
        return json.dumps({k: getattr(self, k) for k in ("waiting", "queues", "asked", "rounds", "early", "turn")})

    def see(self, event, max_rounds: int) -> Iterator[tuple[int, int, int]]:
        """What is asked after an event: (turn, item, round)."""
        item = None if pd.isna(event.item) else int(event.item)
        if event.kind == "work":
            self.rounds[str(item)] = int(event.used)
            if not event.done and event.used < max_rounds:
                self.waiting.append([bool(event.member), bool(not event.member and event.used > 0), int(event.ord), item])
        elif event.kind == "start" and self.queues is None:
            self.waiting.sort()
            self.queues = [[w[3] for w in self.waiting if not w[0]], [w[3] for w in self.waiting if w[0]]]
            yield from self._next()
        elif event.kind == "answer":
            self.early.setdefault(str(item), {}).setdefault(str(int(event.round)), bool(event.finished))
        while self.asked is not None:
            kind, now = self.asked
            held = self.early.get(str(now), {}).get(str(self.rounds[str(now)] + 1))
            if held is None:
                return
            self.rounds[str(now)] += 1
            if not held and self.rounds[str(now)] < max_rounds:
                self.queues[kind].append(now)
            self.asked = None
            yield from self._next()

    def _next(self) -> Iterator[tuple[int, int, int]]:
        kind = next((k for k, q in enumerate(self.queues) if q), None)
        if kind is None or self.budget is not None and self.turn >= self.budget:
            return
        item = self.queues[kind].pop(0)
        self.asked, self.turn = [kind, item], self.turn + 1
        yield self.turn, item, self.rounds[str(item)] + 1


def scheduled(events: DataFrame, budget: int | None, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """The questions (run, turn, item, round) that a stream of events brings out.

    ``events``: run, seq, kind (work, start, answer), item, member, ord, used, done, round, finished.  ``run`` and ``item`` are
    numbers; the events of a run count in the order of ``seq`` inside each batch.  State: the run's items and early answers.
    """

    def ask(key, frames, state):
        queues = _Queues(state.get[0] if state.exists else None, budget)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = [(key[0], *asked) for event in rows.itertuples(index=False) for asked in queues.see(event, max_rounds)]
        state.update((queues.saved(),))
        yield pd.DataFrame(out, columns=["run", "turn", "item", "round"])

    return events.groupBy("run").applyInPandasWithState(ask, "run long, turn int, item long, round int", "queues string", "append", "NoTimeout")
