"""Token counts of greedy word pieces in linear time.

A trie of the vocabulary carries failure links. Each link knows how many tokens
are popped when it is followed, so the longest-match-first split of a word is
counted in one pass over its letters and no piece is ever built.

Defined cases: null and empty texts have no words and no tokens; a word that
cannot be split counts as one unknown token; words are runs without ASCII white
space; repeated rows are counted each; other input columns do not matter.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planisphere.llm.common import map_batches, slices

CACHE_WORDS = 400_000
INNER = "##"


def sentence_pieces(path: str) -> list[str]:
    """Word pieces of a SentencePiece file: word-initial pieces as they are, others with ``##`` before them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        if piece.startswith("▁"):
            if len(piece) > 1 and "▁" not in piece[1:]:
                out.append(piece[1:])
        elif "▁" not in piece:
            out.append(INNER + piece)
    return sorted(set(out))


class LongestMatch:
    """Trie, failure links and popped-token counts of one vocabulary."""

    def __init__(self, vocabulary, inner: str = INNER):
        # state 0: start of a word, state 1: after a piece inside a word
        self.next: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for piece in vocabulary:
            at, letters = (1, piece[len(inner) :]) if piece.startswith(inner) and len(piece) > len(inner) else (0, piece)
            for c in letters:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    final.append(False)
                at = self.next[at][c]
            final[at] = bool(letters)
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n
        line = deque([0, 1])
        while line:
            u = line.popleft()
            for c, v in self.next[u].items():
                if final[v]:
                    self.fail[v], self.popped[v] = 1, 1
                else:
                    z, more = self.fail[u], 0
                    while z >= 0 and c not in self.next[z]:
                        more += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.next[z][c], self.popped[u] + more
                line.append(v)

    def count(self, word: str) -> int:
        """Tokens of one word; 1 if no split exists (the unknown token)."""
        at, n = 0, 0
        nexts, fail, popped = self.next, self.fail, self.popped
        for c in word:
            while c not in nexts[at]:
                if fail[at] < 0:
                    return 1
                n += popped[at]
                at = fail[at]
            at = nexts[at][c]
        while at != 1:
            if fail[at] < 0:
                return 1
            n += popped[at]
            at = fail[at]
        return n


class _Counts(dict):
    def __init__(self, count):
        self.count = count

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = self.count(word)
        return found


_LIVE: dict[int, tuple[LongestMatch, _Counts]] = {}


def token_counts(df: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_tokens`` of every text; the vocabulary is broadcast (its size is fixed)."""
    shared, key = df.sparkSession.sparkContext.broadcast(vocabulary), hash(tuple(vocabulary))

    def run(batch):
        if key not in _LIVE:
            _LIVE.clear()
            match = LongestMatch(shared.value)
            _LIVE[key] = match, _Counts(match.count)
        counts = _LIVE[key][1].__getitem__
        for part in slices(batch, "text"):
            words, tokens = [], []
            for text in part.column(1).to_pylist():
                split = text.encode("utf-8").split()
                words.append(len(split))
                tokens.append(sum(map(counts, text.split() if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") else [w.decode("utf-8") for w in split])))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_batches(rows, run, "doc_id bigint, n_words bigint, n_tokens bigint")
