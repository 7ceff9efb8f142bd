"""Token counts by a linear longest-match automaton over a word-piece vocabulary."""

from __future__ import annotations

import json
import re
from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import filled

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: Ends a word; vocabulary entries that close a word end with it. No text word contains it.
END = "\x00"
#: Words of a text: runs of letters, digits and underscores, and single other signs but white space.
WORDS = re.compile(r"\w+|[^\w\s]")
_REMEMBERED = 1 << 17


def load_vocabulary(path: str = VOCABULARY, end: str = "</w>") -> list[str]:
    """The pieces of a tokenizer file, with its mark of a word's end turned into END."""
    with open(path, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    return sorted({p.removesuffix(end) + END if p.endswith(end) else p for p in pieces} - {"", END})


class Automaton:
    """Greedy longest-match-first piece counts in time linear in the word.

    A trie of the vocabulary. For a node whose string is a piece, failing pops that piece
    and goes on at the root; for any other, ``fail`` is where the rest of its string stands after the
    longest pieces at its front are popped, and ``popped`` how many those are. A word is read
    once, character by character; pieces are counted as they are popped and never built.
    """

    def __init__(self, vocabulary: list[str]):
        self.step: list[dict[str, int]] = [{}]
        piece, depth_order = [False], deque([0])
        for word in vocabulary:
            node = 0
            for c in word:
                nxt = self.step[node].get(c)
                if nxt is None:
                    nxt = self.step[node][c] = len(self.step)
                    self.step.append({})
                    piece.append(False)
                node = nxt
            piece[node] = True
        self.fail, self.popped = [-1] * len(self.step), [0] * len(self.step)
        while depth_order:
            node = depth_order.popleft()
            for c, child in self.step[node].items():
                depth_order.append(child)
                if piece[child]:
                    self.fail[child], self.popped[child] = 0, 1
                    continue
                z, count = self.fail[node], self.popped[node]
                while z >= 0 and c not in self.step[z]:
                    z, count = self.fail[z], count + self.popped[z]
                if z >= 0:
                    self.fail[child], self.popped[child] = self.step[z][c], count

    def count(self, word: str) -> int:
        """Pieces of a word; -1 if the greedy match gets stuck, which makes it one unknown token."""
        step, fail, popped = self.step, self.fail, self.popped
        node = total = 0
        for c in word:
            nxt = step[node].get(c)
            while nxt is None:
                if fail[node] < 0:
                    return -1
                total += popped[node]
                node = fail[node]
                nxt = step[node].get(c)
            node = nxt
        while node:
            if fail[node] < 0:
                return -1
            total += popped[node]
            node = fail[node]
        return total


def token_counts(docs: DataFrame, vocabulary: list[str] | None = None, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_pieces, n_unknown) for every row of ``docs``.

    Texts are lower-cased and split by WORDS; n_pieces counts an unknown word as one. A
    null or empty text has zeros. ``vocabulary`` defaults to the one in VOCABULARY, read on the driver;
    its size, not that of the data, bounds what each task receives. Words met before are
    looked up in a table of at most 131,072 entries.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary() if vocabulary is None else vocabulary)

    def run(batches):
        automaton = _automaton(shared)
        known = lru_cache(_REMEMBERED)(lambda word: automaton.count(word + END))
        for batch in batches:
            rows = []
            for value in batch.column(1).to_pylist():
                words = pieces = unknown = 0
                for m in WORDS.finditer(value.lower()):
                    words += 1
                    n = known(m[0])
                    unknown += n < 0
                    pieces += abs(n)
                rows.append((words, pieces, unknown))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))], ["doc_id", "n_words", "n_pieces", "n_unknown"])

    source = docs.select("doc_id", filled(text).alias("text"))
    return source.mapInArrow(run, StructType([source.schema["doc_id"], *StructType.fromDDL("n_words long, n_pieces long, n_unknown long").fields]))


_built: dict[int, Automaton] = {}


def _automaton(shared) -> Automaton:
    """One automaton for each worker process and vocabulary."""
    key = hash(tuple(shared.value))
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(shared.value)
    return _built[key]


def op9_token_counts(docs: DataFrame) -> DataFrame:
    return token_counts(docs)
