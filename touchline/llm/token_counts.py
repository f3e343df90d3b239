"""Token counts by a linear longest-match automaton.

The vocabulary becomes a trie. Each node has a failure link and the number of tokens that are popped when it is taken,
both computed beforehand; a word is then read once, from left to right, and only counts are kept: no piece is built.
The result is the greedy longest-match (word-piece) length of each pre-token.

Null and empty texts: 0 words, 0 tokens. A byte that no piece covers counts as one token. Repeated rows count each on
their own; extra columns of the input are ignored, whatever their names. An empty table gives no row. Very long texts are
read whole, word by word.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame

from .common import batch_rows, frugal, texts_of, tokenizer_path

#: Entries of a worker's memo of words; it is emptied when full and never changes a result.
MEMO = 600_000


class LongestMatch:
    """Trie with failure links over the bytes of a vocabulary."""

    def __init__(self, vocabulary: Iterable[bytes]):
        words = {w for w in vocabulary if w} | {bytes([b]) for b in range(256)}
        self.goto: list[dict[int, int]] = [{}]
        token = [False]
        order: list[tuple[int, int, int]] = []  # parent, byte, node: parents come first
        for w in sorted(words, key=lambda w: (len(w), w)):
            at = 0
            for b in w:
                to = self.goto[at].get(b)
                if to is None:
                    to = self.goto[at][b] = len(self.goto)
                    self.goto.append({})
                    token.append(False)
                    order.append((at, b, to))
                at = to
            token[at] = True
        depth = [0] * len(self.goto)
        for p, _, v in order:
            depth[v] = depth[p] + 1
        self.fail = [-1] * len(self.goto)
        self.pops = [0] * len(self.goto)
        for p, b, v in sorted(order, key=lambda x: depth[x[2]]):
            if token[v]:
                self.fail[v], self.pops[v] = 0, 1
                continue
            u, n = self.fail[p], self.pops[p]
            while u >= 0 and b not in self.goto[u]:
                n += self.pops[u]
                u = self.fail[u]
            if u >= 0:
                self.fail[v], self.pops[v] = self.goto[u][b], n

    def count(self, word: bytes) -> int:
        goto, fail, pops = self.goto, self.fail, self.pops
        u = n = 0
        for b in word:
            edges = goto[u]
            while b not in edges:
                n += pops[u]
                u = fail[u]
                edges = goto[u]
            u = edges[b]
        while u > 0:
            n += pops[u]
            u = fail[u]
        return n


def vocabulary(path: str) -> list[bytes]:
    """Byte strings of a byte-level vocabulary file: the printable stand-ins of bytes are undone."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    with open(path, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    return [bytes(back[c] for c in p) for p in pieces if all(c in back for c in p)]


class _Memo(dict):
    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        n = self.automaton.count(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self[word] = n
        return n


@functools.lru_cache(maxsize=2)
def _memo(path: str) -> _Memo:
    return _Memo(LongestMatch(vocabulary(path)))


@functools.lru_cache(maxsize=1)
def _splitter():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words (pre-tokens), n_tokens (greedy longest-match pieces) of every whole text."""
    import pyarrow as pa

    path = path or tokenizer_path("byte_bpe_50k.json")

    def batches(it):
        memo, split = _memo(path), _splitter().findall
        for b in it:
            words, tokens = [], []
            for t in b.column(1).to_pylist():
                w = split(t or "")
                words.append(len(w))
                tokens.append(sum(map(memo.__getitem__, w)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    batch_rows(docs.sparkSession)
    return texts_of(docs).mapInArrow(frugal(batches), "doc_id long, n_words long, n_tokens long")
