"""Token counts by a linear longest-match automaton.

Method.  Word pieces are chosen greedily: the longest vocabulary piece at the
start of the word, then the longest continuation piece, and so on.  The pieces
form a trie with one root for word starts and one for continuations.  Where no
arc fits, a failure link leads to the state that is left after the pieces which
greedy matching would take now, and the link carries how many those are.  One
pass over a word adds these counts; no piece is ever built, and the work is
linear in the word's length.  With ``cover``, a word whose first character starts no
piece begins with the bare start mark and goes on with continuation pieces, and a
character that no piece covers is its bytes, so every word has its true length; an
unknown word is then one with a character that no piece holds.  Without ``cover`` a
word that cannot be covered is one unknown token.

Scale: one projection over the scan, no shuffle.  The automaton is built by the
driver from one vocabulary file, whose size bounds it, and broadcast; a task's
memory of words seen is bounded by ``CACHE_WORDS``.  Long texts are read in
pieces cut at white space.

Cases: null and empty texts have no words and no tokens; repeated rows stay
repeated; an empty table gives an empty result; other columns are not read, or pass
through ``with_token_counts`` unchanged.
"""
from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from functools import partial

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookspark.llm.text import free_names, to_bytes, word_pieces

CACHE_WORDS = 200_000
START, MORE = 0, 1
UNKNOWN = 1 << 40
COUNTS = ["n_words", "n_tokens", "n_unknown"]


def load_pieces(path: str, start_mark: str = "▁") -> tuple[set[str], set[str]]:
    """Word-start and continuation pieces of a piece-vocabulary file; control,
    unknown and single-byte entries are not pieces of text."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    starts, more = set(), set()
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        (starts if piece.startswith(start_mark) else more).add(piece.removeprefix(start_mark))
    return starts - {""}, more - {""}


def check_cover(path: str, start_mark: str = "▁") -> None:
    """Raises if the vocabulary lacks the bare start mark or one of the 256 bytes."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    if sum(map(model.is_byte, ids)) != 256 or not any(model.id_to_piece(i) == start_mark for i in ids):
        raise ValueError(f"{path} has no bare start mark or not all 256 bytes")


def _n_bytes(char: str) -> int:
    return len(char.encode("utf-8", "surrogatepass"))


class LongestMatch:
    """The automaton: arcs by state and character, a failure state and its piece count by state.
    If the start state has a failure link (the bare start mark), every word is covered."""

    def __init__(self, arcs: list[dict[str, int]], fail: list[int | None], popped: list[int]):
        self.arcs, self.fail, self.popped = arcs, fail, popped

    @classmethod
    def build(cls, starts: Iterable[str], more: Iterable[str], cover: bool = False) -> LongestMatch:
        arcs: list[dict[str, int]] = [{}, {}]
        ends = {}
        starts, more = set(starts), set(more)
        alone = {char for piece in starts | more for char in piece} - more if cover else set()  # only inside longer pieces
        for root, pieces in ((START, starts), (MORE, more | alone)):
            for piece in pieces:
                state = root
                for char in piece:
                    if char not in arcs[state]:
                        arcs[state][char] = len(arcs)
                        arcs.append({})
                    state = arcs[state][char]
                ends[state] = _n_bytes(piece) if root == MORE and piece in alone else 1
        fail: list[int | None] = [None] * len(arcs)
        popped = [0] * len(arcs)
        if cover:
            fail[START], popped[START] = MORE, 1
        queue = deque([START, MORE])
        while queue:
            state = queue.popleft()
            for char, below in arcs[state].items():
                queue.append(below)
                if below in ends:
                    fail[below], popped[below] = MORE, ends[below]
                    continue
                count, at = popped[state], fail[state]
                while at is not None and char not in arcs[at]:
                    count, at = count + popped[at], fail[at]
                if at is not None:
                    fail[below], popped[below] = arcs[at][char], count
        return cls(arcs, fail, popped)

    def count(self, word: str) -> int | None:
        """Pieces of the word, None if it cannot be covered."""
        arcs, fail, popped, state, n = self.arcs, self.fail, self.popped, START, 0
        for char in word:
            while char not in arcs[state]:
                if fail[state] is None:
                    return None
                n, state = n + popped[state], fail[state]
            state = arcs[state][char]
        while state != MORE:
            if fail[state] is None:
                return None
            n, state = n + popped[state], fail[state]
        return n


    def cover(self, word: str) -> tuple[int, bool]:
        """Pieces of the word, and whether no piece holds one of its characters: that one is its bytes."""
        arcs, fail, popped, state, n, unknown = self.arcs, self.fail, self.popped, START, 0, False
        for char in word:
            while char not in arcs[state] and state != MORE:
                n, state = n + popped[state], fail[state]
            if char in arcs[state]:
                state = arcs[state][char]
            else:
                n, unknown = n + _n_bytes(char), True
        while state != MORE:
            n, state = n + popped[state], fail[state]
        return n, unknown


class WordCounts(dict):
    """Tokens of a word, worked out once per task; an unknown word also adds UNKNOWN."""

    def __init__(self, automaton: LongestMatch):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        text = word.decode("utf-8", "surrogatepass")
        if self.automaton.fail[START] is not None:
            n, unknown = self.automaton.cover(text)
            value = n + UNKNOWN * unknown
        else:
            n = self.automaton.count(text)
            value = 1 + UNKNOWN if n is None else n
        self[word] = value
        return value


def _count_batches(batches, automaton, lower: bool, text_at: int, names: list[str]):
    known = WordCounts(LongestMatch(*automaton.value))
    for batch in batches:
        words, tokens, unknown = [], [], []
        for text in batch.column(text_at):
            n = total = 0
            for piece in word_pieces(to_bytes(text.as_py()), lower=lower):
                n += len(piece)
                total += sum(map(known.__getitem__, piece))
            words.append(n)
            tokens.append(total % UNKNOWN)
            unknown.append(total // UNKNOWN)
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, pa.int64()) for v in (words, tokens, unknown))],
                                         [*batch.schema.names, *names])


def added_names(columns: list[str]) -> dict[str, str]:
    """The names that ``with_token_counts`` gives its columns beside ``columns``."""
    return free_names(columns, COUNTS)


def with_token_counts(docs: DataFrame, vocabulary_path: str, text_col: str = "text", lower: bool = False,
                      cover: bool = False) -> DataFrame:
    """All columns, and ``n_words, n_tokens, n_unknown`` of every row's whole text;
    a name that is taken gets a number behind it (:func:`added_names`)."""
    if cover:
        check_cover(vocabulary_path)
    built = LongestMatch.build(*load_pieces(vocabulary_path), cover)
    automaton = docs.sparkSession.sparkContext.broadcast((built.arcs, built.fail, built.popped))
    names = list(added_names(docs.columns).values())
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in names)])
    return docs.mapInArrow(partial(_count_batches, automaton=automaton, lower=lower, text_at=docs.columns.index(text_col), names=names), schema)


def token_counts(docs: DataFrame, vocabulary_path: str, text_col: str = "text", id_col: str = "doc_id", lower: bool = False,
                 cover: bool = False) -> DataFrame:
    """``(id_col, n_words, n_tokens, n_unknown)`` of every row's whole text."""
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    return with_token_counts(rows, vocabulary_path, "_text", lower, cover).select(F.col("_id").alias(id_col), *COUNTS)
