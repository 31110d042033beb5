"""Token counts by greedy longest match in linear time.

A trie of the vocabulary gets, for every node, a failure link and the number of pieces that following it emits
("popped" pieces). A word is read once, byte by byte; where the trie has no edge, the automaton pops the known number
of pieces and goes on from the link. No piece is ever built and no byte is read twice.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Words that a task remembers; the memory is emptied beyond it. Longer words are not remembered.
MEMORY_WORDS, MEMORY_BYTES = 1 << 18, 64


class LongestMatch:
    """The automaton of a vocabulary of byte strings.

    ``start`` is read before each word (a vocabulary that marks word starts by a space has ``b" "``).
    """

    def __init__(self, pieces, start: bytes = b" "):
        edges: dict[int, int] = {}
        final, parents = [False], [(0, 0)]
        for piece in pieces:
            node = 0
            for b in piece:
                key = node << 8 | b
                node = edges.get(key, 0)
                if not node:
                    node = edges[key] = len(final)
                    final.append(False)
                    parents.append((key >> 8, b))
            final[node] = node > 0
        depth = [0] * len(final)
        for node in range(1, len(final)):
            depth[node] = depth[parents[node][0]] + 1
        link, popped = [-1] * len(final), [0] * len(final)
        for node in sorted(range(1, len(final)), key=depth.__getitem__):
            if final[node]:
                link[node], popped[node] = 0, 1
                continue
            parent, b = parents[node]
            at, count = link[parent], popped[parent]
            while at >= 0 and (at << 8 | b) not in edges:
                count += popped[at]
                at = link[at]
            if at >= 0:
                link[node], popped[node] = edges[at << 8 | b], count
        self.edges, self.link, self.popped, self.start = edges, link, popped, start

    def count(self, word: bytes) -> int:
        """The number of pieces; -1 if the greedy match gets stuck, so that the whole word is one unknown token."""
        edges, link, popped = self.edges, self.link, self.popped
        at = total = 0
        for b in self.start + word:
            while (to := edges.get(at << 8 | b)) is None:
                total += popped[at]
                at = link[at]
                if at < 0:
                    return -1
            at = to
        while at:
            total += popped[at]
            at = link[at]
            if at < 0:
                return -1
        return total


def read_pieces(path: str) -> list[bytes]:
    """The byte strings of a rank file: base64 and rank on each line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class _Memory(dict):
    def __init__(self, automaton: LongestMatch):
        self.count = automaton.count

    def __missing__(self, word: bytes) -> int:
        n = self.count(word)
        if len(word) <= MEMORY_BYTES:
            self[word] = n
        return n


def token_counts(docs: DataFrame, pieces: list[bytes], start: bytes = b" ", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_words, n_tokens, n_unknown`` of every whole text.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D; each, behind ``start``, is cut greedily into the
    longest pieces. A word that cannot be cut whole is one token and counts in ``n_unknown``. Null, empty and blank
    texts have no words and no tokens. A very long text is counted whole, and a very long word in time linear in its length.
    Repeated rows and rows with null ids are kept; other columns, whatever their names, are ignored. An empty table gives an
    empty result. The vocabulary, not the data, decides the size of what is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(LongestMatch(pieces, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(shared.value)
        for batch in batches:
            n_bytes, n_words, n_tokens, n_unknown = [], [], [], []
            for text in batch.column(1):
                found = (text.as_buffer() or b"") if text.is_valid else b""
                found = bytes(found)
                words = found.split()
                counts = list(map(memory.__getitem__, words))
                unknown = counts.count(-1)
                n_bytes.append(len(found))
                n_words.append(len(words))
                n_tokens.append(sum(counts) + 2 * unknown)
                n_unknown.append(unknown)
                if len(memory) > MEMORY_WORDS:
                    memory.clear()
            arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_words, n_tokens, n_unknown))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_bytes", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(scratch.column(docs, id_col).cast("long").alias("id"), scratch.column(docs, text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(run, "id long, n_bytes long, n_words long, n_tokens long, n_unknown long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_words", "n_tokens", "n_unknown")
