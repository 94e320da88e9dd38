"""Token counts of a unigram tokenizer, by a Viterbi pass that keeps counts only.

The vocabulary's pieces and scores come from a SentencePiece model file (a parameter). An
Aho-Corasick automaton lists all pieces that occur; dynamic programming over code points carries the
best score and the number of pieces. Ties follow the tokenizer: pieces are tried by where they
start, from the left, and a later one must be strictly better. A code point that no one-character
piece covers scores the least score minus 10 and counts a piece per byte of UTF-8 where the model has
pieces for bytes, else one unknown piece for the whole run of such code points.

A space becomes U+2581, and one is put before a text. As no piece has that sign after another one
(checked when loading), a text may be cut before each sign that follows another character and the
parts counted by themselves; each worker keeps the counts of up to CACHE parts. A null or empty
text has 0 tokens. Texts of any length are counted whole, in memory that grows with their longest part.
Rows are independent, so repeated ones get equal counts; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

SIGN, UNKNOWN_PENALTY, CACHE, LONG = "▁", 10.0, 400_000, 64
MODEL = "piece_bpe_32k.model"
_PART = re.compile(f"{SIGN}+[^{SIGN}]*|[^{SIGN}]+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def has_bytes(model: str) -> bool:
    """Whether the model has a piece for every byte."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    return sum(p.is_byte(i) for i in range(p.get_piece_size())) == 256


def pieces(model: str) -> list[tuple[str, float]]:
    """Ordinary pieces and their scores; control, unknown and byte pieces are never matched."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]], byte_pieces: bool = True):
        if any(SIGN in piece.lstrip(SIGN) for piece, _ in vocabulary):
            raise ValueError("a piece has the space sign after another character: parts cannot be counted alone")
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.byte_pieces = byte_pieces
        # Unknown runs are one piece, so parts stand alone only where no run goes on through the sign.
        self.parts = _PART.findall if byte_pieces or SIGN in self.single else lambda text: [text]
        self.cache: dict[str, int] = {}

    def part(self, text: str) -> int:
        """Pieces on the best path through a text."""
        if self.single.issuperset(text):
            return self._covered(text)
        n = len(text)
        ending: list[list | None] = [None] * (n + 1)
        for last, (length, score) in self.automaton.iter(text):
            if (at := ending[last + 1]) is None:
                at = ending[last + 1] = []
            at.append((length, score))
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            c = text[end - 1]
            options = sorted(ending[end] or (), reverse=True)  # the longest starts first
            if c not in self.single:
                options.append((1, self.unknown))
            length, score = options[0]
            top, k = best[end - length] + score, length
            for length, score in options[1:]:
                if (s := best[end - length] + score) > top:
                    top, k = s, length
            best[end] = top
            if k == 1 and c not in self.single:
                unknown[end] = True
                count[end] = count[end - 1] + (len(c.encode("utf-8", "surrogatepass")) if self.byte_pieces else not unknown[end - 1])
            else:
                count[end] = count[end - k] + 1
        return count[n]

    def _covered(self, text: str) -> int:
        """The same where pieces cover every character, so that one ends at each place. The automaton lists the longest first."""
        best, count, end = [0.0], [0], 0
        for last, (length, score) in self.automaton.iter(text):
            if last == end:
                end += 1
                best.append(best[end - length] + score)
                count.append(count[end - length] + 1)
            elif (s := best[end - length] + score) > best[end]:
                best[end], count[end] = s, count[end - length] + 1
        return count[end]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        total, cache = 0, self.cache
        for part in self.parts(SIGN + text.replace(" ", SIGN)):
            n = cache.get(part)
            if n is None:
                n = self.part(part)
                if len(part) <= LONG:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[part] = n
            total += n
        return total


_loaded: dict[str, Counter] = {}


def counter(model: str) -> Counter:
    """Kept as long as the worker lives."""
    if model not in _loaded:
        _loaded[model] = Counter(pieces(model), has_bytes(model))
    return _loaded[model]


def count(spark: SparkSession, docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_tokens of every row."""
    small_batches(spark)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model or default_model())
        for batch in batches:
            n = [own.text(x.as_py()) for x in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_chars"], pa.array(n, pa.int64())], ["doc_id", "n_chars", "n_tokens"])

    rows = docs.select("doc_id", "text", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
    return rows.mapInArrow(counted, f"doc_id {dict(docs.dtypes)['doc_id']}, n_chars long, n_tokens long")
