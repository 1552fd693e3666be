"""Token counts by a count-only Viterbi search.

Aho-Corasick enumerates every vocabulary piece that occurs in a word; dynamic programming over the end positions
carries only the best score and the number of pieces of the best path.  The rules are those of a unigram
tokenizer with white-space marks: a space becomes the mark U+2581, a text is given a leading mark, words are
split before each mark and segmented on their own; at equal scores the piece that starts first (the longest)
wins; a character that no single-character piece covers is unknown (lowest score - 10), adjoining unknowns are
one token, and with byte pieces in the vocabulary they are as many tokens as they have UTF-8 bytes.

The shipped vocabularies hold no unigram model.  The operator therefore takes (piece, score) pairs; the query
uses the 32k-piece SentencePiece vocabulary and its scores *as* a unigram model, and the tests hold the counts
against the ``tokenizers`` library's unigram model over the same pairs.

Defined cases: null and empty texts have 0 tokens; one very long word costs time in proportion to its length, and
memory only for the longest piece; repeated rows get equal counts; null ids pass through; other columns are not looked
at; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 400_000  # counts of distinct words that a worker keeps
BROADCAST_PIECES = 2_000_000  # a vocabulary is a bounded table; larger ones are refused

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def load_pieces(model_file: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) of a SentencePiece model file; kinds: normal, byte, other."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    out = []
    for i in range(model.get_piece_size()):
        kind = "byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) else "normal"
        out.append((model.id_to_piece(i), model.get_score(i), kind))
    return out


class WordCounts(dict):
    """Number of tokens by word (with its mark); segments a word when it is first asked for."""

    def __init__(self, pieces: Sequence[tuple[str, float, str]]):
        import ahocorasick

        super().__init__()
        self.matches = ahocorasick.Automaton()
        for piece, score, kind in pieces:
            if piece:
                self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.longest = max((len(piece) for piece, *_ in pieces), default=1) or 1
        self.unknown = min((s for _, s, _ in pieces), default=0.0) - UNKNOWN_PENALTY
        self.by_bytes = sum(kind == "byte" for *_, kind in pieces) == 256

    def __missing__(self, word: str) -> int:
        found = self.segment(word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(word) <= 200:
            self[word] = found
        return found

    def segment(self, word: str) -> int:
        # by end position, of the last ``longest`` ones: best score, pieces of the best path (runs of unknowns not yet
        # weighed), bytes of the run of unknowns that ends here, else 0
        kept = self.longest + 1
        best, count, run = [0.0] * kept, [0] * kept, [0] * kept
        matches = self.matches.iter(word)  # in order of their ends
        ahead = next(matches, None)
        for end in range(1, len(word) + 1):
            top, pieces, bytes_run = None, 0, 0
            here: list[tuple[int, float]] = []
            while ahead is not None and ahead[0] == end - 1:
                here.append(ahead[1])
                ahead = next(matches, None)
            here.sort(key=lambda m: -m[0])
            for length, score in here:  # longest first, so only a better score replaces
                before = (end - length) % kept
                candidate = best[before] + score
                if top is None or candidate > top:
                    top, pieces, bytes_run = candidate, count[before] + 1, 0
            if not here or here[-1][0] > 1:
                before = (end - 1) % kept
                candidate = best[before] + self.unknown
                if top is None or candidate > top:
                    size = len(word[end - 1].encode("utf-8", "replace"))
                    top, bytes_run = candidate, run[before] + size
                    pieces = count[before] + (size if self.by_bytes else not run[before])
            at = end % kept
            best[at], count[at], run[at] = top, pieces, bytes_run
        return count[len(word) % kept]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        if words[0] == "":  # the text starts with a mark of its own
            words = words[1:]
        return sum(map(self.__getitem__, [MARK + w for w in words]))


_LOADED: dict[str, WordCounts] = {}  # the last vocabulary used, by its digest


def count_tokens(
    docs: DataFrame, pieces: Sequence[tuple[str, float, str]], *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_tokens) per row of ``docs``; no shuffle, constant memory per task."""
    if len(pieces) > BROADCAST_PIECES:
        raise ValueError(f"vocabulary of {len(pieces)} pieces; the bound is {BROADCAST_PIECES}")
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(list(pieces))
    key = hashlib.sha256(repr(list(pieces)).encode()).hexdigest()
    id_field = docs.schema[id_col]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _LOADED.get(key)
        if counts is None:
            _LOADED.clear()
            counts = _LOADED[key] = WordCounts(shared.value)
        for batch in source:
            n = [counts.text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[id_col, "n_tokens"])

    schema = f"`{id_col}` {id_field.dataType.simpleString()}, n_tokens long"
    return docs.select(id_col, text_col).mapInArrow(batches, schema)
