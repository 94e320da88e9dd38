"""The command line: ask, index, graph, sessions, summarise, evaluate."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence
from pathlib import Path
from typing import TextIO

from pyspark.sql import SparkSession

from . import render
from .operators import evaluation, graph
from .plans import model, trial
from .plans.turn import Phraser, turn
from .session import session as spark_session
from .sources import sessions
from .sources.store import Store

STOPPED = 130


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillgraph", description="Ask a folder of notes.")
    p.add_argument("--branch", default=".", help="the folder of notes")
    p.add_argument("--state", default=str(Path.home() / ".quillgraph"), help="where sessions are kept")
    p.add_argument("--host", default=model.HOST, help="address of a local model server")
    p.add_argument("--model", default=None, help="name of its model; without one, sentences are picked from the notes")
    p.add_argument("--master", default=None, help="Spark master")
    sub = p.add_subparsers(dest="command", required=True)
    ask = sub.add_parser("ask", help="ask a question")
    ask.add_argument("question")
    ask.add_argument("--session", default=None, help="id of a session, or 'last'")
    for name, text in (("index", "bring the graph up to date"), ("graph", "measure the graph"), ("sessions", "list sessions"), ("summarise", "say what the folder holds")):
        sub.add_parser(name, help=text)
    sub.add_parser("evaluate", help="ask the notes' own questions").add_argument("--limit", type=int, default=None)
    return p


def _phraser(a) -> Phraser:
    return model.phrasing(model.server(a.model, a.host)) if a.model else model.extractive


def _ask(a, store: Store, say: Callable[[str], None], phrase: Phraser) -> int:
    folder = sessions.sessions_dir(a.state, a.branch)
    own = sessions.Session(folder) if a.session is None else sessions.resumed(folder, None if a.session == "last" else a.session)
    say(render.turn(turn(a.question, store, phrase, own, say)))
    return 0


def _evaluate(a, store: Store, say: Callable[[str], None], phrase: Phraser) -> int:
    found = trial.gather(trial.run(store, phrase, a.limit, say), lambda x: say(render.attempt(x)))
    say(render.report(trial.report(store.spark, found.attempts), found))
    return 0 if found.finished or found.fault is not None else STOPPED


def main(argv: Sequence[str] | None = None, out: TextIO | None = None, err: TextIO | None = None, spark: SparkSession | None = None, phrase: Phraser | None = None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    a = _parser().parse_args(argv)
    say = lambda text: print(text, file=out)
    if not Path(a.branch).is_dir():
        print(f"{a.branch} is no folder", file=err)
        return 2
    if a.command == "sessions":
        folder = sessions.sessions_dir(a.state, a.branch)
        for name in sessions.sessions(folder):
            first = sessions.Session(folder, name).messages
            say(f"{name}: {model.flat(first[0].content) if first else ''}")
        return 0
    store = Store(spark or spark_session(a.master), sessions.store_dir(a.branch), a.branch)
    phrase = phrase or _phraser(a)
    try:
        if a.command == "ask":
            return _ask(a, store, say, phrase)
        if a.command == "evaluate":
            return _evaluate(a, store, say, phrase)
        told = store.refresh()
        if a.command == "index":
            say(render.refresh(told))
        elif a.command == "graph":
            notes, edges = store.note_ids(), store.edges()
            say(render.metrics(evaluation.metrics(notes, edges).first().asDict(), evaluation.by_kind(edges), graph.unconnected(notes, edges)))
        else:
            name = Path(a.branch).resolve().name
            notes, edges = store.note_ids(), store.edges()
            say(render.profile(name, evaluation.profile(notes, edges, name), evaluation.related(notes, edges)))
        return 0
    except (KeyError, OSError) as e:
        print(f"could not {a.command}: {e}", file=err)
        return 1


if __name__ == "__main__":
    sys.exit(main())
