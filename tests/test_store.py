"""Folders, stores, refreshes, turns, sessions and the command line."""

import io
import json
import os
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from quillgraph import cli, render
from quillgraph.plans import model, trial
from quillgraph.plans.turn import turn
from quillgraph.operators import terms
from quillgraph.sources import branch, sessions
from quillgraph.sources import store as stores
from quillgraph.sources.store import Read, StaleGraph, Store
from quillgraph.streaming import refresh as stream

LISTS = {"english": ("the", "and", "with", "was"), "german": ("die", "der", "und", "nicht")}


def put(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


def state(store):
    return ({tuple(r) for r in store.edges().collect()}, {tuple(r) for r in store.dangling().collect()}, {tuple(r) for r in store.notes().collect()})


def test_scan_and_read(spark, tmp_path):
    put(tmp_path, {"a.md": "é", "_b/c.txt": "x", ".hidden/d.md": "x", ".e": "x", "nul.md": b"a\x00b", "latin.md": "é".encode("latin-1"), "deep/er/f": ""})
    os.symlink(tmp_path / "a.md", tmp_path / "link.md")
    os.symlink(tmp_path, tmp_path / "_b/loop")
    os.symlink(tmp_path / "nowhere", tmp_path / "broken")
    entries = branch.scan(spark, str(tmp_path))
    assert sorted(r["note_id"] for r in entries.collect()) == ["_b/c.txt", "a.md", "deep/er/f", "latin.md", "link.md", "nul.md"]
    opened = branch.read(entries).cache()
    assert {r["note_id"]: r["text"] for r in branch.notes(opened).collect()} == {"_b/c.txt": "x", "a.md": "é", "deep/er/f": "", "link.md": "é"}
    assert {r["note_id"]: r["reason"] for r in branch.unreadable(opened).collect()} == {"nul.md": "not text: it holds a NUL", "latin.md": "not text: not UTF-8"}
    gone = entries.where("note_id = 'a.md'")
    gone.collect()
    os.remove(tmp_path / "a.md")
    assert branch.read(entries.where("note_id = 'a.md'")).first()["reason"].startswith("could not read")


def test_empty_folder(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), str(tmp_path / "b"), LISTS)
    (tmp_path / "b").mkdir()
    assert store.derivation_version() is None and not store.current() and store.edges().isEmpty() and store.notes().isEmpty()
    assert store.refresh().rebuilt and store.edges().isEmpty() and store.current()


def test_refresh(spark, tmp_path):
    notes, s = tmp_path / "notes", str(tmp_path / "store")
    put(notes, {"a.md": "copper kettle spout [[b]] [[later]]", "b.md": "copper kettle", "c.md": "quiet", "bad.md": b"\xff"})
    store = Store(spark, s, str(notes), LISTS)
    first = store.refresh()
    assert first.rebuilt and not first.quiet and first.counts == {"added": 3} and [r["note_id"] for r in first.unreadable.collect()] == ["bad.md"]
    assert {(r["a"], r["b"], r["kind"], r["weight"]) for r in store.edges().collect()} == {("a.md", "b.md", "link", 1.0), ("a.md", "b.md", "cooccurrence", 2.0)}
    assert store.current() and store.refresh().quiet
    store.answer_from_current_graph()
    os.remove(notes / "b.md")
    put(notes, {"later.md": "spout copper", "c.md": "quiet [[a]]"})
    assert not store.current()
    with pytest.raises(StaleGraph):
        store.answer_from_current_graph()
    second = store.refresh()
    assert not second.rebuilt and (second.names("added"), second.names("changed"), second.names("removed")) == (["later.md"], ["c.md"], ["b.md"])
    assert {(r["a"], r["b"], r["kind"], r["weight"]) for r in store.edges().collect()} == {("a.md", "later.md", "link", 1.0), ("a.md", "c.md", "link", 1.0), ("a.md", "later.md", "cooccurrence", 2.0)}
    assert [tuple(r) for r in store.dangling().collect()] == [("a.md", "b")]
    assert store.note_text("c.md") == "quiet [[a]]" and store.note_text("b.md") is None
    assert "changed: 1 note" in render.refresh(second) and "and 1 more" in "\n".join(render.listed(["x"], 2))
    assert render.refresh(Read()) == "Nothing has changed."
    newer = Store(spark, s, str(notes), LISTS, derivation=2)
    assert not newer.current() and newer.refresh().rebuilt and state(newer) == state(store)


def test_a_word_becomes_a_stop_word(spark, tmp_path):
    notes = tmp_path / "notes"
    put(notes, {"a.md": "the the and with was die kettle", "b.md": "the and was with die kettle"})
    store = Store(spark, str(tmp_path / "store"), str(notes), LISTS)
    store.refresh()
    assert {r["weight"] for r in store.edges().collect()} == {2.0}
    mark = store.stop_fingerprint()
    put(notes, {"g.md": "die der und nicht"})
    assert not store.refresh().rebuilt and store.stop_fingerprint() != mark
    assert store.edges().isEmpty()


def test_refresh_equals_rebuild(spark, tmp_path):
    rng, notes = random.Random(11), tmp_path / "notes"
    vocabulary = [f"word{i}" for i in range(25)] + ["the", "and", "die", "der", "und"]

    def text():
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))]
        return " ".join(words) + "".join(f" [[n{rng.randrange(20)}]]" for _ in range(rng.randint(0, 3)))

    put(notes, {f"n{i}.md": text() for i in range(10)})
    store = Store(spark, str(tmp_path / "store"), str(notes), LISTS)
    store.refresh()
    for step in range(3):
        for _ in range(rng.randint(1, 4)):
            i = rng.randrange(20)
            p = notes / f"n{i}.md"
            if p.exists() and rng.random() < 0.4:
                p.unlink()
            else:
                put(notes, {f"n{i}.md": text() + " " * step})
                os.utime(p, (1000 + step, 1000 + step))
        store.refresh()
        fresh = Store(spark, str(tmp_path / f"fresh{step}"), str(notes), LISTS)
        fresh.refresh()
        assert state(store) == state(fresh), step
    before = state(store)
    store.compact()
    assert state(store) == before and len(store.versions("notes")) == 1 and store.refresh().quiet
    put(notes, {"n3.md": "word1 word2 word3 [[n1]]", "n1.md": "word1 word2"})
    store.refresh()
    fresh = Store(spark, str(tmp_path / "last"), str(notes), LISTS)
    fresh.refresh()
    assert state(store) == state(fresh)


def test_stored_terms_give_the_postings_of_the_texts(spark, tmp_path):
    notes = tmp_path / "notes"
    put(notes, {"the.md": "The kettle and the spout, copper", "b.md": "", "is.md": "and with was kettle"})
    store = Store(spark, str(tmp_path / "store"), str(notes), LISTS)
    for files in ({}, {"b.md": "copper spout was", "c.md": "die der und nicht"}):
        put(notes, files)
        store.refresh()
        stop = terms.stop_terms(terms.vocabulary(store.notes()), LISTS)
        assert sorted(store.stop().collect()) == sorted(stop.collect())
        assert sorted(store.postings().collect()) == sorted(terms.postings(store.notes(), stop).collect())
        assert ("the.md", "the") in {tuple(r) for r in store.postings().collect()}


def test_many_refreshes_compact_the_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "COMPACT_AFTER", 1)
    notes = tmp_path / "notes"
    put(notes, {"a.md": "copper kettle spout", "b.md": "copper kettle [[a]]"})
    store = Store(spark, str(tmp_path / "store"), str(notes), LISTS)
    store.refresh()
    for i in range(3):
        held = store.edges()
        before = {tuple(r) for r in held.collect()}
        put(notes, {f"n{i}.md": f"copper spout [[n{i - 1}]]"})
        assert store.refresh().names("added") == [f"n{i}.md"]
        assert {tuple(r) for r in held.collect()} == before, "a reader of the version before is not disturbed"
        at = store.meta()
        assert at["version"] - at["base"] <= 1
    fresh = Store(spark, str(tmp_path / "fresh"), str(notes), LISTS)
    fresh.refresh()
    assert state(store) == state(fresh) and store.refresh().quiet
    assert min(store.versions("notes")) > 1 and sorted(store.stop().collect()) == sorted(fresh.stop().collect())


def test_an_unfinished_version_does_not_count(spark, tmp_path):
    notes = tmp_path / "notes"
    put(notes, {"a.md": "x"})
    store = Store(spark, str(tmp_path / "store"), str(notes), LISTS)
    store.refresh()
    spark.createDataFrame([("z.md", 1.0, 1, "left behind")], "note_id string, mtime double, size bigint, text string").write.parquet(f"{tmp_path}/store/notes/v=2")
    assert [r["note_id"] for r in store.notes().collect()] == ["a.md"] and store.current()
    put(notes, {"b.md": "y"})
    store.refresh()
    assert sorted(r["note_id"] for r in store.notes().collect()) == ["a.md", "b.md"]


def test_stream_of_events(spark, tmp_path):
    notes, events = tmp_path / "notes", tmp_path / "events"
    put(notes, {"a.md": "copper kettle [[b]]", "b.md": "copper kettle"})
    store = Store(spark, str(tmp_path / "store"), str(notes), LISTS)
    events.mkdir()

    def emit(name, rows):
        (events / name).write_text("".join(json.dumps(r) + "\n" for r in rows))

    def entry(name, removed=False):
        p = notes / name
        return {"note_id": name, "path": str(p), "mtime": p.stat().st_mtime if p.exists() else 9e9, "size": p.stat().st_size if p.exists() else 0, "removed": removed}

    def run():
        df = spark.readStream.schema(stream.EVENT).json(str(events))
        stream.follow(store, df, str(notes), str(tmp_path / "check")).awaitTermination(120)

    emit("1.json", [entry("a.md"), entry("b.md")])
    run()
    assert len(state(store)[0]) == 2
    os.remove(notes / "b.md")
    put(notes, {"c.md": "copper kettle"})
    emit("2.json", [entry("b.md", True), entry("c.md")])
    run()
    assert {(r["a"], r["b"]) for r in store.edges().collect()} == {("a.md", "c.md")} and [tuple(r) for r in store.dangling().collect()] == [("a.md", "b")]


ANSWERABLE = {
    "press.md": "Why did the obsidian press jam? [[rollers]]", "rollers.md": "The rollers were worn. They slip. [[feeder]]", "feeder.md": "Feed belts stretch with age. [[rollers]]", "alone.md": "zebra",
}


@pytest.fixture
def asked(spark, tmp_path):
    put(tmp_path / "notes", ANSWERABLE)
    return Store(spark, str(tmp_path / "store"), str(tmp_path / "notes"), {})


def test_turns(asked, tmp_path):
    log = sessions.Session(tmp_path / "log")
    calls = []

    def phrase(question, evidence):
        calls.append([p for p, _ in evidence])
        return model.Reply("The rollers were worn.", [model.Citation("rollers.md", "The  rollers were worn.")])

    good = turn("obsidian?", asked, phrase, log)
    assert good.outcome.kind == "answer" and calls == [["press.md", "rollers.md", "feeder.md"]] and good.grounding == (1, 2, True) and good.refresh.rebuilt
    assert "rollers.md" in render.turn(good)
    assert turn("unknown words", asked, phrase, log).outcome.kind == "absent"
    lone = turn("zebra", asked, phrase, log)
    assert lone.outcome.kind == "unconnected" and lone.outcome.redirect_to == "alone.md" and len(calls) == 1
    assert turn("obsidian worn", asked, phrase, log).outcome.kind == "thin"
    half = turn("obsidian", asked, lambda q, e: model.Reply("x", [model.Citation("rollers.md", "They slip."), model.Citation("feeder.md", "made up")]), log)
    assert half.outcome.kind == "parts" and [c.quote for c in half.outcome.citations] == ["They slip."] and (half.total, half.correct) == (2, 1)
    assert turn("obsidian", asked, lambda q, e: model.Reply("x", []), log).outcome.kind == "thin"
    told = log.messages
    assert [m.next_step for m in told if m.role == "assistant"] == ["answered", "end", "redirect", "ask", "answered", "ask"]
    assert told[0].content == "obsidian?" and told[1].is_answer and told[1].evidence == [["rollers.md", "The  rollers were worn."]]
    table = sessions.messages(asked.spark, str(tmp_path / "log"))
    assert table.count() == len(told) and table.select("session_id").distinct().first()[0] == log.id
    assert sessions.resumed(tmp_path / "log").id == log.id
    with pytest.raises(KeyError):
        sessions.resumed(tmp_path / "log", "nope")


def test_trial(asked):
    found = trial.gather(trial.run(asked, model.extractive, limit=1))
    assert found.finished and [(a.note_id, a.verdict) for a in found.attempts] == [("press.md", "kept")]
    counts = trial.report(asked.spark, found.attempts)
    assert (counts["proposed"], counts["kept"], counts["measured"], counts["unasked"]) == (1, 1, 1, 0) and not counts["is_a_comparison"]
    assert "1 question proposed" in render.report(counts, found)
    unasked = trial.gather(trial.run(asked, model.extractive, limit=0))
    assert trial.report(asked.spark, unasked.attempts)["unasked"] == 1


def test_gather_keeps_what_it_has():
    a = trial.Attempt("n", "q", "dropped", "no support")

    def broken(after, error):
        for _ in range(after):
            yield a
        raise error

    assert not trial.gather(broken(1, KeyboardInterrupt())).finished
    assert isinstance(trial.gather(broken(1, OSError())).fault, OSError)
    with pytest.raises(OSError):
        trial.gather(broken(0, OSError()))
    with pytest.raises(ValueError):
        trial.Attempt("n", "q", "dropped", "r", object()).row()


def test_command_line(spark, tmp_path):
    put(tmp_path / "notes", ANSWERABLE)

    def run(*argv, phrase=model.extractive):
        out, err = io.StringIO(), io.StringIO()
        code = cli.main(["--branch", str(tmp_path / "notes"), "--state", str(tmp_path / "state"), *argv], out, err, spark, phrase)
        return code, out.getvalue(), err.getvalue()

    assert "added: 4 notes" in run("index")[1] and run("index")[1] == "Nothing has changed.\n"
    assert "4 notes" in run("graph")[1] and "alone.md" in run("graph")[1]
    assert "notes: 1 subject" in run("summarise")[1]
    code, text, _ = run("ask", "What of the obsidian press?")
    assert code == 0 and "reading press.md" in text
    assert "What of the obsidian press?" in run("sessions")[1]
    assert run("ask", "--session", "last", "zebra")[0] == 0 and len(run("sessions")[1].splitlines()) == 1
    assert run("ask", "--session", "nope", "zebra")[0] == 1
    assert run("evaluate", "--limit", "1")[0] == 0
    assert cli.main(["--branch", str(tmp_path / "none"), "index"], io.StringIO(), io.StringIO(), spark) == 2


def test_server_is_asked_once(spark, tmp_path):
    seen = []

    class Stub(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            body = json.dumps({"message": {"content": json.dumps({"answer": "One.", "note1": 1, "quote1": "One."})}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    httpd = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    phrase = model.phrasing(model.server("m", f"http://127.0.0.1:{httpd.server_port}"))
    reply = phrase("Why?", [("a.md", "One. Two.")])
    httpd.shutdown()
    assert reply == model.Reply("One.", [model.Citation("a.md", "One.")], True)
    assert len(seen) == 1 and seen[0][0] == "/api/chat" and seen[0][1]["options"]["temperature"] == 0 and seen[0][1]["model"] == "m"


def test_places(tmp_path):
    assert sessions.store_dir(str(tmp_path)).startswith(str(tmp_path / "."))
    assert sessions.sessions_dir("/s", str(tmp_path)) == sessions.sessions_dir("/s", str(tmp_path) + "/")
    assert sessions.sessions(tmp_path / "none") == []
