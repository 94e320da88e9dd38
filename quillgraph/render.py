"""Text for people: turns, refreshes, measurements and reports. Lists are cut with a count of the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as X
from .plans.model import flat
from .plans.trial import Attempt, Gathered
from .plans.turn import Turn
from .sources.store import Read

ALONE, SUBJECTS, TOUCHES, RELATED, NEAREST = 10, 12, 4, 10, 100
SHARES = {0.5: "half", 0.75: "three quarters", 0.9: "nine tenths"}


def plural(n: int, one: str, many: str | None = None) -> str:
    return f"{n} {one if n == 1 else many or one + 's'}"


def percent(share: float) -> str:
    """Whole percents, halves to even."""
    return f"{round(share * 100)}%"


def share(value: float) -> str:
    return SHARES.get(value, percent(value))


def listed(rows: list[str], total: int) -> list[str]:
    """Indented rows, and how many more there are."""
    return [f"  {r}" for r in rows] + ([f"  and {total - len(rows)} more"] if total > len(rows) else [])


def refresh(read: Read, most: int = ALONE) -> str:
    if read.quiet:
        return "Nothing has changed."
    lines = ["Everything was derived again." if read.rebuilt else "The graph was brought up to date."]
    for status in ("added", "changed", "removed"):
        if n := read.counts.get(status, 0):
            lines += [f"{status}: {plural(n, 'note')}", *listed(read.names(status, most), n)]
    for title, table in (("no notes", read.unreadable), ("links to nothing", read.dangling)):
        if table is not None and (n := table.count()):
            first = table.orderBy(*table.columns).limit(most).collect()
            lines += [f"{title}: {n}", *listed([": ".join(map(str, r)) for r in first], n)]
    return "\n".join(lines)


def turn(t: Turn) -> str:
    o = t.outcome
    lines = [o.text] if o.text else []
    if o.kind == "parts":
        lines.append("No sentence of the notes answers this whole. What bears on it:")
    lines += [f"  {c.path}: {flat(c.quote)}" for c in o.citations]
    if o.nearest:
        lines += ["Near, but no answer:", *listed([f"{note}: {why}" for note, why in o.nearest[:NEAREST]], len(o.nearest))]
    if o.redirect_to:
        lines.append(f"Ask about {o.redirect_to} instead?")
    if o.wants:
        lines.append(f"It would take {o.wants}.")
    if t.grounding:
        seeds, through, agree = t.grounding
        lines.append(f"Read {plural(seeds + through, 'note')}: {seeds} by the question's words, {through} through relations; the rankings {'agree' if agree else 'differ'}.")
    if t.n_withheld:
        lines.append(f"{plural(t.n_withheld, 'note')} more were reached and not read.")
    if t.total:
        lines.append(f"{t.correct} of {plural(t.total, 'citation')} hold.")
    lines += [f"  {path}: {why}: {flat(quote)}" for path, why, quote in t.fabricated]
    return "\n".join(lines)


def metrics(row: dict, kinds: DataFrame, alone: DataFrame) -> str:
    n = row["notes"]
    lines = [f"{plural(n, 'note')}, {plural(row['edges'], 'edge')} over {plural(row['pairs'], 'pair')}; {row['density']:.1f} relations a note"]
    lines += [f"  {r['kind']}: {r['n_edges']} ({percent(r['n_edges'] / row['edges'])})" for r in kinds.orderBy("kind").collect()]
    if row["unconnected"]:
        first = [r[0] for r in alone.orderBy("note_id").limit(ALONE).collect()]
        lines += [f"{plural(row['unconnected'], 'note')} without a relation:", *listed(first, row["unconnected"])]
    return "\n".join(lines)


def profile(branch: str, subjects: DataFrame, related: DataFrame) -> str:
    """Subjects by size with what they touch most, and the notes with most relations."""
    n_subjects, n_related = subjects.count(), related.count()
    lines = [f"{branch}: {plural(n_subjects, 'subject')}"]
    rows = []
    for r in subjects.orderBy(F.desc("notes"), "subject").limit(SUBJECTS).collect():
        touched = sorted((r["touches"] or {}).items(), key=lambda x: (-x[1], x[0]))
        near = ", ".join(f"{name} ({n})" for name, n in touched[:TOUCHES]) + (f" and {len(touched) - TOUCHES} more" if len(touched) > TOUCHES else "")
        rows.append(f"{r['subject']}: {plural(r['notes'], 'note')}, {plural(r['inside'], 'pair')} within" + (f"; touches {near}" if near else ""))
    lines += listed(rows, n_subjects)
    if n_related:
        lines.append("Most related:")
        lines += listed([f"{r['note_id']} ({r['degree']})" for r in related.orderBy(F.desc("degree"), "note_id").limit(RELATED).collect()], n_related)
    return "\n".join(lines)


def attempt(a: Attempt) -> str:
    state = a.turn.outcome.kind if a.turn else a.verdict if a.verdict == "dropped" else "not asked"
    return f"{state}: {flat(a.question)} [{a.note_id}] {a.reason}"


def report(counts: dict, gathered: Gathered) -> str:
    lines = [f"{plural(counts['proposed'], 'question')} proposed, {counts['kept']} kept, {counts['measured']} asked, {counts['unasked']} not asked"]
    lines += [f"  dropped: {why}: {n}" for why, n in sorted(counts["dropped_for"].items())]
    lines.append(f"answers {counts['answers']} ({share(counts['answer_rate'])} of those asked), parts {counts['parts']}, refusals {counts['refusals']}")
    lines.append(f"citations {counts['citations']}, {share(counts['citation_rate'])} hold; {counts['fabricated']} made up; {plural(counts['uncorroborated'], 'reply', 'replies')} without any")
    if counts["grounded"]:
        lines.append(f"of what was read, {share(counts['edge_share'])} came through relations; the rankings agreed in {counts['breadth_agreed']} of {counts['grounded']}")
    if not counts["is_a_comparison"]:
        lines.append("Too few questions were kept to compare by.")
    if gathered.fault is not None:
        lines.append(f"The run ended early: {gathered.fault}")
    elif not gathered.finished:
        lines.append("The run was interrupted.")
    return "\n".join(lines)


def one_line(column: str):
    """A text column on one line."""
    return X.flattened(F.col(column))
