"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece that ends at each character; dynamic
programming over the characters carries the best score and the number of pieces of the path that
has it, so no piece is built. Ties follow the tokenizers library's unigram
model: candidates of a position are met from the earliest start on and replace only a strictly
smaller score; a character that no piece of its own covers costs the smallest score less 10;
neighbouring unknown characters fuse, and with byte fallback they count one piece a byte. (Only
a word that spells out the unknown piece itself is traced back, since it fuses with neighbours.)

Text is split before every space as the library's Metaspace step does, so pieces never cross a
split and a word's count is kept in a bounded table per process.

The vocabulary is a parameter: (piece, score) pairs and the unknown piece's number, here read
from a public SentencePiece file.

Defined results: null and empty texts have 0 pieces; ids may be null or repeat; whole texts of
any length are counted. Only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestrank.llm.common import slices, texts

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
KNOWN_WORDS = 400_000

Vocabulary = tuple[list[tuple[str, float]], int]


def read_vocabulary(path: str) -> Vocabulary:
    """Pieces with scores, and the unknown piece's number, of a SentencePiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(size)], model.unk_id()


class Counter:
    """Piece counts of words and texts."""

    def __init__(self, vocabulary: Vocabulary, limit: int = KNOWN_WORDS) -> None:
        import ahocorasick

        pieces, unknown = vocabulary
        self.unknown_piece = pieces[unknown][0]
        self.unknown_score = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.byte_fallback = all(f"<0x{b:02X}>" in {p for p, _ in pieces} for b in (0, 255))
        self.scores = dict(pieces)
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.limit = limit
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of one word that holds no split."""
        size = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for end, match in self.matches.iter(word):
            ends[end].append(match)
        best, count = [0.0] * (size + 1), [0] * (size + 1)
        unknown, begins = [False] * (size + 1), [0] * (size + 1)
        for end in range(size):
            found, top, pieces, single = False, 0.0, 0, False
            for length, score in sorted(ends[end], reverse=True):
                start = end + 1 - length
                candidate = score + best[start]
                if not found or candidate > top:
                    found, top, pieces, begins[end + 1] = True, candidate, count[start] + 1, start
                single = single or length == 1
            if not single:
                candidate = self.unknown_score + best[end]
                if not found or candidate > top:
                    top, begins[end + 1] = candidate, end
                    unknown[end + 1] = True
                    if self.byte_fallback:
                        pieces = count[end] + len(word[end].encode("utf-8"))
                    else:
                        pieces = count[end] + (not unknown[end])
            best[end + 1], count[end + 1] = top, pieces
        return self._fused(word, begins, unknown) if self.unknown_piece in word else count[size]

    def _fused(self, word: str, begins: list[int], unknown: list[bool]) -> int:
        """Count of a word that spells out the unknown piece, which fuses with unknown neighbours."""
        total, run, end = 0, "", len(word)
        while True:
            piece = word[begins[end] : end] if end else ""
            if end and (unknown[end] or piece == self.unknown_piece):
                run = piece + run
            else:
                if run:
                    total += 1 if run in self.scores or not self.byte_fallback else len(run.encode("utf-8"))
                    run = ""
                if not end:
                    return total
                total += 1
            end = begins[end]

    def text(self, text: str) -> int:
        """Pieces of a whole text."""
        if not text:
            return 0
        words = text.replace(" ", SPACE)
        words = (words if words[0] == SPACE else SPACE + words).split(SPACE)[1:]
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > self.limit:
                known.clear()
                new = set(words)
            known.update((w, self.word(SPACE + w)) for w in new)
        return sum(map(known.__getitem__, words))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The process's counter of a vocabulary file; its table of words serves later tasks too."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(read_vocabulary(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).text
        for batch in batches:
            for part in slices(batch, text_col):
                found = [count(t) for t in texts(part, text_col)]
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(found, pa.int64())], [id_col, "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long"
    )
