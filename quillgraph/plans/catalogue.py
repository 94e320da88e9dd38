"""The registered queries over the reference's operators, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answers, evaluation, graph, keyword, links, proposals, refresh, retrieval, terms
from ..scratch import grown
from ..sources import fixtures
from .corpus import Corpus
from .oracle import ORACLE_SQL  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def plain(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(fixtures.notes(spark, sf_dir).select("note_id", "text"))


def linked(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(fixtures.linked_notes(spark, sf_dir).select("note_id", "text"))


def styled(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(fixtures.styled_notes(spark, sf_dir))


# Text


@query
def note_terms(spark, sf_dir):
    notes = fixtures.notes(spark, sf_dir)
    return notes.select("note_id", F.size(X.terms(F.col("text"))).cast("long").alias("n_terms"))


@query
def corpus_vocabulary(spark, sf_dir):
    return terms.vocabulary(fixtures.notes(spark, sf_dir))


@query
def language_scores(spark, sf_dir):
    scores = terms.language_scores(terms.vocabulary(fixtures.notes(spark, sf_dir)))
    return scores.select("lang", "n_found", "n_words", F.round("score", 9).alias("score"))


@query
def detected_languages(spark, sf_dir):
    return terms.detected(terms.vocabulary(fixtures.notes(spark, sf_dir)))


@query
def stopword_list(spark, sf_dir):
    return plain(spark, sf_dir).stop


@query
def stop_fingerprint(spark, sf_dir):
    return terms.fingerprint(plain(spark, sf_dir).stop)


@query
def term_idf(spark, sf_dir):
    c = plain(spark, sf_dir)
    return terms.term_weights(c.postings, c.notes).select("term", "df", F.round("idf", 9).alias("idf"))


@query
def terms_in_every_note(spark, sf_dir):
    c = plain(spark, sf_dir)
    return terms.term_weights(c.postings, c.notes).where("idf = 0").select("term", "df")


@query
def note_names(spark, sf_dir):
    note = F.col("note_id")
    return fixtures.notes(spark, sf_dir).select("note_id", X.note_name(note).alias("name"), X.without_extension(note).alias("stem"), X.folder(note).alias("folder"))


@query
def flattened_texts(spark, sf_dir):
    flat = X.flattened(F.col("text"))
    return fixtures.linked_notes(spark, sf_dir).select("note_id", F.length(flat).cast("long").alias("n_chars"), F.md5(flat).alias("digest"))


@query
def lifted_questions(spark, sf_dir):
    return proposals.lifted(fixtures.linked_notes(spark, sf_dir))


@query
def questions_first_three(spark, sf_dir):
    return proposals.lifted(fixtures.linked_notes(spark, sf_dir), proposals.PER_NOTE)


@query
def stemmed_vocabulary(spark, sf_dir):
    from ..functions import stem

    words = terms.vocabulary(fixtures.notes(spark, sf_dir))
    return words.select("term", stem.normalised(F.col("term")).alias("key"))


# Relations


@query
def link_targets(spark, sf_dir):
    return links.targets(fixtures.linked_notes(spark, sf_dir))


@query
def link_resolution(spark, sf_dir):
    return linked(spark, sf_dir).resolved


@query
def link_edges(spark, sf_dir):
    return linked(spark, sf_dir).links


@query
def dangling_links(spark, sf_dir):
    return linked(spark, sf_dir).dangling


@query
def styled_targets(spark, sf_dir):
    return links.targets(fixtures.styled_notes(spark, sf_dir))


@query
def styled_resolution(spark, sf_dir):
    return styled(spark, sf_dir).resolved


@query
def styled_dangling(spark, sf_dir):
    return styled(spark, sf_dir).dangling


@query
def styled_unconnected(spark, sf_dir):
    c = styled(spark, sf_dir)
    return graph.unconnected(c.notes, c.links)


@query
def styled_note_set(spark, sf_dir):
    """Notes with an even number, and the ends of all links."""
    c = styled(spark, sf_dir)
    return graph.note_set(c.notes.where("note_id RLIKE '[02468].md$'"), c.links)


@query
def styled_profile(spark, sf_dir):
    c = styled(spark, sf_dir)
    found = evaluation.profile(c.notes, c.links, "branch")
    touches = F.array_join(F.transform(F.array_sort(F.map_entries("touches")), lambda x: F.concat_ws(":", x["key"], x["value"])), " ")
    return found.select("subject", "notes", "inside", touches.alias("touches"))


@query
def href_dangling(spark, sf_dir):
    urls = fixtures.table(spark, sf_dir, "pages").select(F.col("url").alias("href"))
    return fixtures.hrefs(spark, sf_dir).join(urls, "href", "left_anti").select("page_id", "href")


@query
def cooccurrence_edges(spark, sf_dir):
    return plain(spark, sf_dir).cooccurrences


@query
def edges_by_kind(spark, sf_dir):
    return linked(spark, sf_dir).kinds()


@query
def graph_metrics(spark, sf_dir):
    c = linked(spark, sf_dir)
    counts = c.kinds().agg(F.coalesce(F.sum("n_edges"), F.lit(0).cast("long")).alias("edges"))
    alone = c.lone_links.agg(F.count("*").alias("alone"))
    pairs = c.degrees.agg((F.coalesce(F.sum("n"), F.lit(0)) / 2).cast("long").alias("made")).crossJoin(alone).select((F.col("made") + F.col("alone")).alias("pairs"))
    lone = graph.unconnected(c.notes, c.links).join(grown(c.degrees.select("note_id")), "note_id", "left_anti")
    return evaluation.measured(c.notes, counts, pairs, lone)


@query
def unconnected_notes(spark, sf_dir):
    c = plain(spark, sf_dir)
    return graph.unconnected(c.notes, c.links)


@query
def unconnected_notes_all(spark, sf_dir):
    return plain(spark, sf_dir).unconnected()


@query
def adjacency_degree(spark, sf_dir):
    return graph.degrees(linked(spark, sf_dir).adjacency(links.LINK))


@query
def stage_filter_link(spark, sf_dir):
    return linked(spark, sf_dir).stage(links.LINK).orderBy("a", "b")


@query
def stage_filter_similarity(spark, sf_dir):
    return graph.of_kind(linked(spark, sf_dir).links, links.SIMILARITY)


# Walks


def _walk(spark, sf_dir, bound=None) -> tuple[Corpus, graph.Reach]:
    c = linked(spark, sf_dir)
    start = c.notes.where(X.note_name(F.col("note_id")) == "000000").select(F.col("note_id").alias("note"))
    return c, graph.reach(c.adjacency(links.LINK), start, bound, c.scratch)


@query
def reach_unbounded(spark, sf_dir):
    return _walk(spark, sf_dir)[1].reached


@query
def reach_all(spark, sf_dir):
    """The walk over edges of all kinds."""
    c = linked(spark, sf_dir)
    start = c.notes.where(X.note_name(F.col("note_id")) == "000000").select(F.col("note_id").alias("note"))
    return graph.reach_shared(c.adjacency(links.LINK), c.coded, start, c.scratch)


@query
def reach_depth2(spark, sf_dir):
    return _walk(spark, sf_dir, 2)[1].reached


@query
def reach_paths(spark, sf_dir):
    c, found = _walk(spark, sf_dir)
    return graph.paths(found, c.scratch).select("note", "depth", F.array_join("path", " ").alias("path"))


@query
def reach_truncated(spark, sf_dir):
    return _walk(spark, sf_dir, 2)[1].truncated()


@query
def reach_left_out(spark, sf_dir):
    c, found = _walk(spark, sf_dir, 2)
    return found.left_out(c.notes.select(F.col("note_id").alias("note")))


@query
def connected_components(spark, sf_dir):
    c = linked(spark, sf_dir)
    return graph.components(c.adjacency(links.LINK), c.scratch)


@query
def has_cycle(spark, sf_dir):
    c = linked(spark, sf_dir)
    return graph.has_cycle(c.adjacency(links.LINK), c.scratch)


@query
def cycle_notes(spark, sf_dir):
    c = linked(spark, sf_dir)
    return graph.cycle_notes(c.adjacency(links.LINK), c.scratch)


@query
def triangles(spark, sf_dir):
    return graph.triangles(linked(spark, sf_dir).adjacency(links.LINK))


@query
def short_cycles(spark, sf_dir):
    found = graph.cycles(linked(spark, sf_dir).adjacency(links.LINK), 4)
    return found.select("length", F.array_join("cycle", " ").alias("cycle"))


# Retrieval


def _seeds(c: Corpus, only=None) -> DataFrame:
    asked = retrieval.question_terms(fixtures.questions(c.notes.sparkSession, only), c.stop)
    return retrieval.seeds(retrieval.shared(terms.postings(c.notes, c.stop, asked), asked, c.n_notes, c.scratch))


@query
def question_seeds(spark, sf_dir):
    return retrieval.ranked(_seeds(plain(spark, sf_dir)))


@query
def seeds_by_strongest(spark, sf_dir):
    return retrieval.ranked(_seeds(plain(spark, sf_dir)), "strongest").select("qid", "note_id", "strongest", "rank")


@query
def seeds_agree(spark, sf_dir):
    return retrieval.leaders(_seeds(plain(spark, sf_dir)))


def _gathered(spark, sf_dir, qid=1) -> tuple[DataFrame, DataFrame]:
    c = linked(spark, sf_dir)
    found = c.scratch.save(_seeds(c, qid), "seeds")
    walk = graph.reach(c.adjacency(links.LINK), found.select(F.col("note_id").alias("note")), None, c.scratch)
    return retrieval.ordered(walk.reached, found), found


@query
def evidence_topk(spark, sf_dir):
    return retrieval.evidence(_gathered(spark, sf_dir)[0])


@query
def withheld_notes(spark, sf_dir):
    return retrieval.withheld(_gathered(spark, sf_dir)[0]).select("note", "depth", "worth")


@query
def grounding(spark, sf_dir):
    walk, found = _gathered(spark, sf_dir)
    return retrieval.grounding(retrieval.evidence(walk), retrieval.leaders(found))


@query
def refusal_fork(spark, sf_dir):
    c = linked(spark, sf_dir)
    parts = graph.components(c.adjacency(links.LINK), c.scratch)
    return retrieval.fork(fixtures.questions(spark), _seeds(c), parts)


@query
def styled_fork(spark, sf_dir):
    """Refusals on a graph of many components, where a question may lead nowhere."""
    c = styled(spark, sf_dir)
    return retrieval.fork(fixtures.questions(spark), _seeds(c), graph.components(c.adjacency(links.LINK), c.scratch))


@query
def bm25_search(spark, sf_dir):
    c = plain(spark, sf_dir)
    return keyword.search(c.notes, fixtures.questions(spark), c.stop)


@query
def bm25_match_set(spark, sf_dir):
    c = plain(spark, sf_dir)
    return keyword.match_set(keyword.bodies(c.notes), keyword.query_terms(fixtures.questions(spark), c.stop))


@query
def bm25_stemmed(spark, sf_dir):
    c = plain(spark, sf_dir)
    return keyword.search(c.notes, fixtures.questions(spark), c.stop, normalise=True)


# Answers


@query
def reply_citations(spark, sf_dir):
    out = answers.parsed(fixtures.replies(spark, sf_dir))
    spelled = F.array_join(F.transform("citations", lambda x: F.concat(x["path"], F.lit("="), x["quote"])), "|")
    return out.select("answer_id", "answer", F.size("citations").cast("long").alias("n_citations"), spelled.alias("citations"))


@query
def copied_answers(spark, sf_dir):
    return fixtures.sentences(spark, sf_dir).select("answer_id", answers.copied(F.col("answer"), F.col("texts")).alias("copied"))


def _checked(spark, sf_dir) -> DataFrame:
    return answers.checked(fixtures.citations(spark, sf_dir), fixtures.notes(spark, sf_dir))


@query
def citation_check(spark, sf_dir):
    return _checked(spark, sf_dir)


@query
def citation_summary(spark, sf_dir):
    return answers.summary(_checked(spark, sf_dir))


@query
def guard_outcome(spark, sf_dir):
    found = _checked(spark, sf_dir)
    return answers.guarded(found.select("answer_id").distinct(), found)


@query
def fallback_parts(spark, sf_dir):
    return answers.kept_parts(_checked(spark, sf_dir))


# Proposals and evaluation


def _proposed(spark, sf_dir) -> tuple[Corpus, DataFrame]:
    c = linked(spark, sf_dir)
    return c, c.scratch.save(proposals.proposals(c.notes, c.adjacency(links.LINK), scratch=c.scratch), "proposed")


@query
def question_proposals(spark, sf_dir):
    return _proposed(spark, sf_dir)[1].withColumn("answers", F.array_join("answers", " "))


@query
def question_proposals_all(spark, sf_dir):
    """Proposals over edges of all kinds; answers are many, so they are counted and digested."""
    c = linked(spark, sf_dir)
    out = proposals.proposals(c.notes, c.scratch.save(c.adjacency(), "adjacency"), scratch=c.scratch)
    return out.select("note_id", "pos", "question", F.size("answers").cast("long").alias("n_answers"), F.md5(F.array_join("answers", " ")).alias("digest"))


@query
def first_proposals(spark, sf_dir):
    c = linked(spark, sf_dir)
    return proposals.proposals(c.notes, c.adjacency(links.LINK), limit=20, scratch=c.scratch).select("note_id", "pos", "question")


@query
def question_verdicts(spark, sf_dir):
    c, proposed = _proposed(spark, sf_dir)
    return proposals.verdicts(proposed, c.notes, c.stop)


@query
def subject_counts(spark, sf_dir):
    c = linked(spark, sf_dir)
    return evaluation.subject_counts(evaluation.subjects(c.notes, "branch"), c.links)


@query
def subject_touches(spark, sf_dir):
    c = linked(spark, sf_dir)
    return evaluation.subject_touches(evaluation.subjects(c.notes, "branch"), c.links)


@query
def subject_listing(spark, sf_dir):
    c = linked(spark, sf_dir)
    return evaluation.listing(evaluation.subject_touches(evaluation.subjects(c.notes, "branch"), c.links))


@query
def subject_counts_all(spark, sf_dir):
    c = linked(spark, sf_dir)
    home = evaluation.subjects(c.notes, "branch")
    return evaluation.counts_of(home, c.between(home))


@query
def subject_touches_all(spark, sf_dir):
    c = linked(spark, sf_dir)
    return evaluation.touches_of(c.between(evaluation.subjects(c.notes, "branch")))


@query
def subject_listing_all(spark, sf_dir):
    c = linked(spark, sf_dir)
    return evaluation.listing(evaluation.touches_of(c.between(evaluation.subjects(c.notes, "branch"))))


@query
def kind_shares(spark, sf_dir):
    kinds = linked(spark, sf_dir).kinds()
    total = kinds.agg(F.sum("n_edges").alias("total"))
    return kinds.crossJoin(total).select("kind", evaluation.percent(F.col("n_edges") / F.col("total")).alias("percent"))


@query
def related_notes(spark, sf_dir):
    c = linked(spark, sf_dir)
    return evaluation.related_by(c.notes, c.degrees.unionByName(evaluation.degrees_of(c.lone_links)))


@query
def eval_report(spark, sf_dir):
    return evaluation.report(fixtures.attempts(spark, sf_dir))


@query
def eval_rates(spark, sf_dir):
    return evaluation.rates(evaluation.report(fixtures.attempts(spark, sf_dir)))


# Refresh and sessions


@query
def refresh_diff(spark, sf_dir):
    return refresh.diff(*fixtures.snapshots(spark, sf_dir))


@query
def refreshed_edges(spark, sf_dir):
    """Edges of the whole corpus, from those of a state that lacks some notes and has others shortened."""
    new = plain(spark, sf_dir)
    ids = fixtures.notes(spark, sf_dir)
    was = ids.where("doc_id % 50 != 7").select("note_id", F.when(F.col("doc_id") % 40 == 1, F.substring("text", 1, 200)).otherwise(F.col("text")).alias("text"))
    dirty = ids.where("doc_id % 50 = 7 OR doc_id % 40 = 1").select("note_id")
    before = Corpus(was, new.lists, new.scratch)
    before.__dict__["stop"] = new.stop
    return refresh.cooccurrence_after(before.cooccurrences, new.content, dirty, new.scratch)


@query
def session_messages(spark, sf_dir):
    rows = fixtures.table(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"))
