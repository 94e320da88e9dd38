"""An evaluation run: propose, judge, ask what is worth asking, and report.

Proposals and verdicts are made for all questions at once; only the turns are a loop on the driver,
because each calls the phraser. Attempts come one by one, so that an interrupted run keeps what it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, graph, proposals
from ..scratch import Scratch
from ..sources.store import Store
from .turn import Phraser, Turn, turn

ATTEMPT = "question string, verdict string, reason string, outcome string, total long, correct long, fabricated long, seeds long, through_edges long, agree boolean"


@dataclass
class Attempt:
    note_id: str
    question: str
    verdict: str
    reason: str
    turn: Turn | None = None

    def row(self) -> tuple:
        if self.verdict == "dropped" and self.turn is not None:
            raise ValueError("a dropped question has an outcome")
        t = self.turn
        if t is None:
            return (self.question, self.verdict, self.reason, *[None] * 7)
        checked = (t.total, t.correct, len(t.fabricated)) if t.total is not None else (None, None, None)
        return (self.question, self.verdict, self.reason, t.outcome.kind, *checked, *(t.grounding or (None, None, None)))


@dataclass
class Gathered:
    attempts: list[Attempt]
    finished: bool = True
    fault: Exception | None = None


def judged(store: Store, scratch: Scratch, kind: str | None = None, normalise: bool = True) -> DataFrame:
    """Verdicts on all proposals of the store."""
    edges = store.edges() if kind is None else graph.of_kind(store.edges(), kind)
    notes = store.notes()
    stop = store.stop()
    proposed = scratch.save(proposals.proposals(notes, graph.adjacency(edges)), "proposed")
    return scratch.save(proposals.verdicts(proposed, notes, stop, normalise), "verdicts")


def run(store: Store, phrase: Phraser, limit: int | None = None, on_progress: Callable[[str], None] | None = None) -> Iterator[Attempt]:
    """Attempts by note and place; kept questions beyond ``limit`` are not asked."""
    told, asked = store.refresh(), 0
    verdicts = judged(store, Scratch(store.spark, "trial"))
    for r in verdicts.orderBy("note_id", "pos").select("note_id", "question", "verdict", "reason").toLocalIterator():
        out = Attempt(r["note_id"], r["question"], r["verdict"], r["reason"])
        if out.verdict == "kept" and (limit is None or asked < limit):
            asked += 1
            out.turn = turn(out.question, store, phrase, on_progress=on_progress, refreshed=told)
        yield out


def gather(attempts: Iterable[Attempt], on_attempt: Callable[[Attempt], None] | None = None) -> Gathered:
    """All attempts; an interrupt or a fault after the first keeps what there is."""
    out = Gathered([])
    try:
        for a in attempts:
            out.attempts.append(a)
            if on_attempt is not None:
                on_attempt(a)
    except KeyboardInterrupt:
        out.finished = False
    except Exception as e:
        if not out.attempts:
            raise
        out.finished, out.fault = False, e
    return out


def report(spark: SparkSession, attempts: list[Attempt]) -> dict:
    """Counts and rates of a run."""
    rows = spark.createDataFrame([a.row() for a in attempts], ATTEMPT)
    counts = evaluation.report(rows)
    reasons = {r["reason"]: r["n"] for r in rows.where("verdict = 'dropped'").groupBy("reason").agg(F.count("*").alias("n")).collect()}
    return counts.first().asDict() | evaluation.rates(counts).first().asDict() | {"dropped_for": reasons}
