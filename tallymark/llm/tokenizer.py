"""Exact byte-pair encoding by dynamic programming over prefixes.

For every prefix of a pre-token exactly one vocabulary entry can be the last token
of its encoding. An Aho-Corasick automaton lists the entries that end at each byte;
one of them is that last token if it starts the text or may follow the last token
of the prefix before it, which is decided on the merge table alone. Following the
back-pointers from the end gives the ids, in time linear in the text.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.arrowmap import map_batches
from ..session import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

# Fixed value: the pre-token pattern of the public byte-level BPE vocabulary.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct pre-tokens whose ids a worker keeps; the store is emptied when full.
MEMO = 200_000


def byte_alphabet() -> dict[int, str]:
    """Printable stand-in of each byte: itself if printable, else the next free code from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    spare = 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return table


class PrefixBpe:
    """Of the JSON text of a byte-level BPE vocabulary."""

    def __init__(self, text: str):
        model = json.loads(text)["model"]
        vocab = self.vocab = model["vocab"]
        self.alphabet = byte_alphabet()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for rank, (left, right) in enumerate(pairs):
            token = vocab[left + right]
            if token in self.halves:
                continue
            self.halves[token] = (vocab[left], vocab[right])
            self.joined[vocab[left], vocab[right]] = token
            self.rank[token] = rank
            self.automaton.add_word(left + right, (token, len(left + right)))
        for letter in self.alphabet.values():
            self.automaton.add_word(letter, (vocab[letter], 1))
            self.rank[vocab[letter]] = -1
        self.automaton.make_automaton()
        self.split = regex.compile(PRE_TOKEN).findall
        self.letters: dict[int, str] = {}
        self.memo: dict[str, list[int]] = {}
        self.allowed: dict[tuple[int, int], bool] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` apart in the text of ``a`` and ``b``.

        Undo, latest merge first, the merges that made the two tokens. At each state
        the pair at the seam must not be mergeable before the merge undone last.
        """
        key = (a, b)
        known = self.allowed.get(key)
        if known is None:
            if len(self.allowed) > MEMO:
                self.allowed.clear()
            known = self.allowed[key] = self._seam_holds(a, b)
        return known

    def _seam_holds(self, a: int, b: int) -> bool:
        rank, joined, halves = self.rank, self.joined, self.halves
        # Both orders of undoing are equal in rank only for the same token; the left
        # one is then merged first, so the right one is undone first.
        limit = (1 << 60, 0)
        while True:
            whole = joined.get((a, b))
            if whole is not None and (rank[whole], 1) < limit:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                limit = (rank[a], 1)
                a = halves[a][1]
            else:
                limit = (rank[b], 2)
                b = halves[b][0]

    def piece(self, text: str) -> list[int]:
        """Ids of one pre-token."""
        letters = "".join(map(self.alphabet.__getitem__, text.encode("utf-8", "surrogatepass")))
        last = [-1] * (len(letters) + 1)
        back = [0] * (len(letters) + 1)
        may_follow = self.may_follow
        for end, (token, size) in self.automaton.iter(letters):
            end += 1
            if last[end] < 0:
                start = end - size
                if start == 0 or (last[start] >= 0 and may_follow(last[start], token)):
                    last[end], back[end] = token, start
        ids, at = [], len(letters)
        while at:
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def decode(self, ids: list[int]) -> str:
        """The text of its ids."""
        if not self.letters:
            self.letters.update({i: t for t, i in self.vocab.items()})
        back = {c: b for b, c in self.alphabet.items()}
        return bytes(back[c] for i in ids for c in self.letters[i]).decode("utf-8", "surrogatepass")

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; a null or empty text has none."""
        if not text:
            return []
        out, memo = [], self.memo
        for part in self.split(text):
            ids = memo.get(part)
            if ids is None:
                if len(memo) >= MEMO:
                    memo.clear()
                ids = self.piece(part)
                if len(part) < 64:
                    memo[part] = ids
            out += ids
        return out


@lru_cache(maxsize=4)
def tokenizer(path: str = DEFAULT_VOCABULARY) -> PrefixBpe:
    """Of a file on this machine."""
    with open(path, encoding="utf-8") as f:
        return PrefixBpe(f.read())


_HELD: dict[str, PrefixBpe] = {}


def shipped(spark: SparkSession, path: str) -> Callable[[], PrefixBpe]:
    """Gets the tokenizer in a worker, one for each process. The driver reads the file and
    broadcasts its text, some megabytes, so the machines of the executors need none."""
    with open(path, encoding="utf-8") as f:
        text = spark.sparkContext.broadcast(f.read())

    def get() -> PrefixBpe:
        if path not in _HELD:
            _HELD[path] = PrefixBpe(text.value)
        return _HELD[path]

    return get


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key`` and ``ids``, the token ids of each text, without special tokens.

    Strings that look like special tokens are ordinary text. Null and empty texts
    have the empty list. One row for each input row; other columns are not read.
    """
    kind = dict(docs.dtypes)[key]

    ship = shipped(docs.sparkSession, path)

    def make():
        encode = ship().encode

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat, ends = array("i"), array("i", [0])
            for value in batch.column(1).to_pylist():
                flat.extend(encode(value))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.array(memoryview(flat), pa.int32()))
            return pa.RecordBatch.from_arrays([batch.column(0), ids], ["key", "ids"])

        return step

    pairs = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    return map_batches(pairs, f"key {kind}, ids array<int>", make).withColumnRenamed("key", key)


def decode_ids(encoded: DataFrame, key: str = "doc_id", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key`` and ``text`` of ``key, ids``: encoding undone. A null list has a null text."""
    kind = dict(encoded.dtypes)[key]
    ship = shipped(encoded.sparkSession, path)

    def make():
        decode = ship().decode

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [None if ids is None else decode(ids) for ids in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

        return step

    return map_batches(encoded.select(F.col(key).alias("key"), "ids"), f"key {kind}, text string", make).withColumnRenamed("key", key)
