"""Conversations as append-only JSON lines, a file for each session, beside the corpus and never in it.

``Session`` records one conversation from the driver; ``messages`` reads all of them as a table.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a conversation does next, by kind of outcome.
NEXT = {"absent": "end", "unconnected": "redirect", "thin": "ask", "answer": "answered", "parts": "answered"}
SCHEMA = (
    "role string, content string, is_answer boolean, evidence array<array<string>>, nearest array<string>, "
    "refusal_kind string, next_step string, redirect_to string, wants string"
)


@dataclass
class Message:
    role: str
    content: str
    is_answer: bool = False
    evidence: list[list[str]] = field(default_factory=list)
    nearest: list[str] = field(default_factory=list)
    refusal_kind: str | None = None
    next_step: str = "answered"
    redirect_to: str | None = None
    wants: str | None = None


def sessions_dir(state: str, branch: str) -> Path:
    """A folder for each corpus, named by the SHA-256 of where it lies."""
    return Path(state) / "sessions" / hashlib.sha256(os.path.realpath(branch).encode()).hexdigest()[:8]


def store_dir(branch: str) -> str:
    """A hidden folder of the corpus, so that a scan never sees it."""
    return os.path.join(os.path.abspath(branch), ".quillgraph", "store")


class Session:
    def __init__(self, folder: Path, session_id: str | None = None):
        self.folder, self.id = Path(folder), session_id or uuid.uuid4().hex
        self.folder.mkdir(parents=True, exist_ok=True)

    @property
    def path(self) -> Path:
        return self.folder / f"{self.id}.jsonl"

    def append(self, message: Message) -> None:
        with self.path.open("a", encoding="utf-8") as f:
            f.write(json.dumps(asdict(message), ensure_ascii=False) + "\n")

    def ask(self, question: str) -> None:
        self.append(Message("user", question))

    def record(self, outcome) -> None:
        """An outcome of ``plans.turn``."""
        evidence = [[c.path, c.quote] for c in outcome.citations]
        kind = outcome.kind if outcome.kind in ("absent", "unconnected", "thin") else None
        self.append(Message(
            "assistant", outcome.text, outcome.kind == "answer", evidence, [n for n, _ in outcome.nearest],
            kind, NEXT[outcome.kind], outcome.redirect_to, outcome.wants,
        ))

    @property
    def messages(self) -> list[Message]:
        if not self.path.exists():
            return []
        return [Message(**json.loads(line)) for line in self.path.read_text(encoding="utf-8").splitlines()]


def sessions(folder: Path) -> list[str]:
    """Ids of recorded sessions, those written to last at the end."""
    found = Path(folder).glob("*.jsonl") if Path(folder).is_dir() else []
    return [p.stem for p in sorted(found, key=lambda p: (p.stat().st_mtime_ns, p.stem))]


def resumed(folder: Path, session_id: str | None = None) -> Session:
    """A session by its id, or the last one; an unknown id is an error."""
    known = sessions(folder)
    if session_id is None:
        return Session(folder, known[-1] if known else None)
    if session_id not in known:
        raise KeyError(f"no session {session_id}")
    return Session(folder, session_id)


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """All messages with the id of their session."""
    rows = spark.read.schema(SCHEMA).json(str(folder))
    return rows.withColumn("session_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl$", 1))
