"""Token counts by a linear longest-match automaton.

Greedy longest-match word pieces (a first piece, then continuing pieces; a word
that can't be cut this way is one unknown token) are counted without building
them. The vocabulary is a trie with two roots. Where the trie has no way on,
the failure link leads to the node for what is left after the pieces that a
greedy matcher would have popped by then; how many those are is known
beforehand, so each character is passed once and failures only add up counts.

Words are runs without ASCII white space, cut further so that each ASCII
punctuation mark is a word. Counts per run are kept in a bounded cache.

The vocabulary (a parameter, with a fixed number of entries) is broadcast; rows
are counted where they are, without a shuffle.

Defined cases: null, empty and blank texts count zero; an empty vocabulary makes
every word unknown; repeated rows count alike; an empty table gives no rows;
other columns of the input are not read.
"""

from __future__ import annotations

import re
import uuid
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

CACHE_ENTRIES = 500_000
_PART = re.compile(r"[!-/:-@\[-`{-~]|[^!-/:-@\[-`{-~]+")


class LongestMatch:
    """Counts of greedy word pieces for a vocabulary of first and continuing pieces."""

    def __init__(self, first: Iterable[str], continuing: Iterable[str]) -> None:
        self.next: list[dict[str, int]] = [{}, {}]  # node 0 begins words, node 1 continues them
        ends: set[int] = set()
        for root, pieces in ((0, first), (1, continuing)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                    node = self.next[node][c]
                if piece:
                    ends.add(node)
        self.fail, self.pops = [-1] * len(self.next), [0] * len(self.next)
        wait = deque([0, 1])
        while wait:
            parent = wait.popleft()
            for c, node in self.next[parent].items():
                wait.append(node)
                if node in ends:
                    self.fail[node], self.pops[node] = 1, 1
                    continue
                z, pops = self.fail[parent], self.pops[parent]
                while z >= 0 and c not in self.next[z]:
                    pops += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[node], self.pops[node] = self.next[z][c], pops

    def count(self, word: str) -> int:
        """Pieces of ``word``; -1 if it can't be cut."""
        node, n = 0, 0
        for c in word:
            while (to := self.next[node].get(c, -1)) < 0:
                n += self.pops[node]
                node = self.fail[node]
                if node < 0:
                    return -1
            node = to
        while node > 1:
            n += self.pops[node]
            node = self.fail[node]
        return n if node == 1 else (0 if not word else -1)


class Counter:
    """(words, tokens, unknown words) of texts."""

    def __init__(self, automaton: LongestMatch) -> None:
        self.automaton = automaton
        self.held: dict[bytes, tuple[int, int, int]] = {}

    def _run(self, run: bytes) -> tuple[int, int, int]:
        counts = [self.automaton.count(w) for w in _PART.findall(run.decode("utf-8", "replace"))]
        unknown = sum(n < 0 for n in counts)
        if len(self.held) >= CACHE_ENTRIES:
            self.held.clear()
        found = self.held[run] = (len(counts), sum(n for n in counts if n > 0) + unknown, unknown)
        return found

    def __call__(self, text: bytes | None) -> tuple[int, int, int]:
        words = tokens = unknown = 0
        get, run = self.held.get, self._run
        for piece in (text or b"").split():
            w, t, u = get(piece) or run(piece)
            words += w
            tokens += t
            unknown += u
        return words, tokens, unknown


_HELD: list[tuple[str, Counter]] = []


def _shared(name: str, vocabulary: Broadcast) -> Counter:
    """One counter, with its cache, for all tasks of a Python worker that use the vocabulary of this name."""
    if not _HELD or _HELD[0][0] != name:
        _HELD[:] = [(name, Counter(LongestMatch(*vocabulary.value)))]
    return _HELD[0][1]


def _count(vocabulary: Broadcast):
    name = uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _shared(name, vocabulary)
        for batch in batches:
            found = [count(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            made = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return run


def count_tokens(docs: DataFrame, first: Iterable[str], continuing: Iterable[str]) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown per row."""
    vocabulary = docs.sparkSession.sparkContext.broadcast((list(first), list(continuing)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_count(vocabulary), f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")


def sentence_pieces(path: str, mark: str = "▁") -> tuple[list[str], list[str]]:
    """First and continuing pieces of a sentencepiece model: those behind the
    word mark, and the others; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [p[1:] for p in pieces if p.startswith(mark) and len(p) > 1 and mark not in p[1:]], [p for p in pieces if mark not in p]
