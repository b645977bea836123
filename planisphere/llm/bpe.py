"""Byte-pair encoding with word ends, and decoding.

Each pre-token is merged by a priority queue of merge ranks over a doubly linked
symbol list; queue entries whose symbols have changed meanwhile are skipped.
Decoding looks every id up and joins the vocabulary strings by a space, as the
tokenizers library does for a file without a decoder.

Defined cases: a null text encodes as an empty one, an empty text has no ids and
decodes to an empty string; repeated rows are encoded each; input columns beyond
the id and the text do not matter; a null id list decodes to an empty string.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planisphere.llm.common import map_batches, slices

#: Distinct words kept per Python worker; the memory of a worker stays bounded.
CACHE_WORDS = 200_000
#: The white space that the normaliser of the file replaces.
SPACE = regex.compile("[" + "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]+")
#: Characters that ``str.split`` takes for white space and the normaliser does not.
SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where printable, else the next one from 256 up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Words(dict):
    """Ids of a white-space-free word as little-endian 32-bit integers; computed when first asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = self.encode(word)
        return found


class WordBpe:
    """The model of one tokenizer file (JSON of the tokenizers library, BPE with an end-of-word suffix)."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.pieces = [pieces.get(i, "") for i in range(max(pieces) + 1)]
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[a] << 20 | self.vocab[b]] = (rank, self.vocab[a + b])
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.end] for c in letters]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = Words(self._word)

    def merge(self, token: str) -> list[int]:
        """Ids of one pre-token."""
        data = token.encode("utf-8")
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        n, ranks = len(ids), self.ranks
        if n == 1:
            return ids
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            found = ranks.get(ids[i] << 20 | ids[i + 1])
            if found:
                queue.append((found[0], i, found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            found = ranks.get(ids[i] << 20 | ids[j])
            if not found or found[1] != new:
                continue  # one of its two symbols has been merged since
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = ranks.get(new << 20 | ids[k])
                if found:
                    heapq.heappush(queue, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = ranks.get(ids[h] << 20 | new)
                if found:
                    heapq.heappush(queue, (found[0], h, found[1]))
        return [i for i in ids if i >= 0]

    def _word(self, word: str) -> bytes:
        out = []
        for token in self.split.findall(word):
            out += self.merge(token)
        return np.array(out, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case letter by letter
        text = text.lower()
        words = SPACE.split(text) if SEPARATORS.search(text) else text.split()
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.marks is None or not self.marks.search(text):
            return self._plain(text)
        found = [np.array([self.special[x]], "<u4").tobytes() if x in self.special else self._plain(x) for x in self.marks.split(text)]
        return b"".join(found)

    def decode(self, ids) -> str:
        return " ".join(map(self.pieces.__getitem__, np.asarray(ids).tolist()))


_MODELS: dict[int, WordBpe] = {}


def _model(content) -> WordBpe:
    """One model per worker process and broadcast file."""
    if content.id not in _MODELS:
        _MODELS.clear()
        _MODELS[content.id] = WordBpe(content.value)
    return _MODELS[content.id]


class _File:
    """A tokenizer file of fixed size, read on the driver and broadcast."""

    def __init__(self, spark, path: str):
        with open(path, "rb") as f:
            content = f.read()
        self.shared, self.id = spark.sparkContext.broadcast(content), hash(content)

    def __getstate__(self):
        return self.shared, self.id

    def __setstate__(self, state):
        self.shared, self.id = state

    @property
    def value(self) -> bytes:
        return self.shared.value


def _ids(coded: list[bytes], packed: bool) -> pa.Array:
    if packed:
        return pa.array(coded, pa.binary())
    ends = np.cumsum([0] + [len(c) // 4 for c in coded]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4")))


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False, decode: bool = False) -> DataFrame:
    """``doc_id`` and ``ids``: array<int>, or with ``packed`` the little-endian 32-bit integers as binary.

    With ``decode`` a column ``decoded`` is made of the ids as well, in the same worker and pass.
    """
    content = _File(df.sparkSession, path)

    def run(batch):
        model = _model(content)
        for part in slices(batch, "text", 1 << 20):
            coded = [model.encode(t) for t in part.column(1).to_pylist()]
            columns = {"doc_id": part.column(0), "ids": _ids(coded, packed)}
            if decode:
                columns["decoded"] = pa.array([model.decode(np.frombuffer(c, "<u4")) for c in coded], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_batches(rows, run, f"doc_id bigint, ids {'binary' if packed else 'array<int>'}" + (", decoded string" if decode else ""))


def bpe_decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id``, ``ids`` as they came and ``decoded``; takes both forms that :func:`bpe_encode` gives."""
    content = _File(df.sparkSession, path)
    packed = dict(df.dtypes)[ids_col] == "binary"

    def run(batch):
        model = _model(content)
        for part in slices(batch, "ids", 1 << 20):
            ids = part.column(1)
            lists = (np.frombuffer(x.as_py() or b"", "<u4") if packed else np.asarray(x.values) if x.is_valid else () for x in ids)
            yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(map(model.decode, lists), pa.string())], ["doc_id", "ids", "decoded"])

    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids"))
    return map_batches(rows, run, f"doc_id bigint, ids {'binary' if packed else 'array<int>'}, decoded string")
