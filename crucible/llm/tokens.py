"""Problem 6: encoding of a corpus with a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie; the driver reads the file and sends its bytes (under 1 MB) to the workers.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer cuts a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Trie nodes and known words after which a worker starts afresh.
MAX_NODES = 1_500_000
MAX_WORDS = 400_000


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte pair encoding of a few bytes by its definition: join the neighbours of lowest rank until none can be joined."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 30:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class PrefixTrie:
    """Encodes words so that a prefix common to many is worked out once.

    Every node is a prefix and holds the last token of its encoding. An encoding is a chain of tokens of which every two
    neighbours stand next to each other when they are encoded alone; for a prefix exactly one token that ends it fits the
    last token of what lies before, so a node's state follows from its ancestors'.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.bytes_of = {t: b for b, t in ranks.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.last: list[int] = [-1]

    def _fit(self, before: int, token: int) -> bool:
        pair = (before, token)
        ok = self.fits.get(pair)
        if ok is None:
            b = self.bytes_of[token]
            ok = merge(b, self.ranks) == [token] if before < 0 else merge(self.bytes_of[before] + b, self.ranks) == [before, token]
            self.fits[pair] = ok
        return ok

    def encode(self, word: bytes) -> list[int]:
        child, last, ranks = self.child, self.last, self.ranks
        path, node = [-1], 0  # last tokens of the prefixes
        for i in range(1, len(word) + 1):
            key = node << 8 | word[i - 1]
            node = child.get(key, -1)
            if node < 0:
                node = child[key] = len(last)
                for m in range(min(i, self.longest), 0, -1):
                    token = ranks.get(word[i - m : i])
                    if token is not None and self._fit(path[i - m], token):
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                last.append(token)
            path.append(last[node])
        out, i = [], len(word)
        while i:
            out.append(path[i])
            i -= len(self.bytes_of[path[i]])
        return out[::-1]

    def encode_all(self, words: list[bytes]) -> list[list[int]]:
        """Sorted words are a depth-first walk of the trie."""
        out: list[list[int]] = [[]] * len(words)
        for i in sorted(range(len(words)), key=words.__getitem__):
            out[i] = self.encode(words[i])
        return out


class Encoder:
    """Texts to ids, block by block, in one worker."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import regex

        self.split = regex.compile(pattern).findall
        self.trie = PrefixTrie({base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a})
        self.known: dict[str, list[int]] = {}

    def __call__(self, texts: list[str | None]) -> list[list[int]]:
        """Null and empty texts give no ids; white space is a text like any other."""
        cut = [self.split(t) if t else [] for t in texts]
        if len(self.trie.last) > MAX_NODES or len(self.known) > MAX_WORDS:
            self.trie.clear(), self.known.clear()
        new = list({w for ws in cut for w in ws if w not in self.known})
        self.known.update(zip(new, self.trie.encode_all([w.encode() for w in new]), strict=True))
        known = self.known
        return [[t for w in ws for t in known[w]] for ws in cut]


def _blocks(n: int, sizes: list[int], limit: int = 4_000_000) -> Iterator[slice]:
    """Runs of texts of a few million characters, so that memory doesn't follow the batch."""
    start, total = 0, 0
    for i in range(n):
        if total and total + sizes[i] > limit:
            yield slice(start, i)
            start, total = i, 0
        total += sizes[i]
    if start < n:
        yield slice(start, n)


def encode_texts(rows: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN, out: str = "ids") -> DataFrame:
    """(id, ids array<int>) of every row. Strings that look like special tokens are ordinary text.

    With out='tokens' the second column is the number of ids instead. No shuffle: every task walks the distinct words of its
    blocks through a trie of its own and keeps it from block to block. Null and empty texts have an empty list (or 0).
    """
    with open(vocabulary, "rb") as f:
        data = rows.sparkSession.sparkContext.broadcast(f.read())
    count = out == "tokens"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(data.value, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            for own in _blocks(len(texts), [len(t or "") for t in texts]):
                ids = encoder(texts[own])
                n = np.array([len(x) for x in ids], np.int32)
                if count:
                    column = pa.array(n.astype(np.int64))
                else:
                    ends = np.concatenate(([0], np.cumsum(n, dtype=np.int32))).astype(np.int32)
                    column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter((t for x in ids for t in x), np.int32, int(n.sum()))))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(own.start, own.stop - own.start), column], ["id", out])

    kind = dict(rows.dtypes)[id_col]
    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {out} {'long' if count else 'array<int>'}").withColumnRenamed("id", id_col)
