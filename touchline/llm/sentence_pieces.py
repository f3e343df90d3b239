"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three parts are compiled from the model's file. The normaliser reads characters and writes them with blanks as marks and
a mark in front. The pieces are a trie of states over the normaliser's symbols; at its end a piece's arc writes its id.
An unknown character's arc writes its bytes. An arc that reads piece b after piece a weighs 0 where the model, given
their texts joined, would leave them side by side, and 1 otherwise. Composed with
an input this is a lattice over its positions, and the tropical shortest path through it is the encoding: costs are added
along a path, and of the paths to a position the least stays. Words are composed many at a time, each step of the search
for all of them at once.

A BPE model's own encoding is the path of weight 0: its pieces are those that no two neighbours of would merge
otherwise, and each prefix has one such path, so that one state a position is enough. No piece reads a mark after another
character, nor a line end beside another one, so the lattice is cut there and words are remembered.

Null text: no ids, decoded "". Empty text: no ids. Decoding undoes the mark in front; encode and decode give the
text back (but for a text that holds the mark itself, which reads as a blank). Very long texts and words are whole.
Repeated rows: each on its own; extra columns are kept as they are. Ties: the longer last piece.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import batch_rows, frugal, LongMap, tokenizer_path

MARK, CUT = "▁", "\x1f"
PART = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words that a worker remembers, and pairs of pieces; they are forgotten when there are more, which changes no result.
MEMO, PAIRS = 200_000, 3_000_000
#: Words of more characters are cut where they can be, and what is still longer is composed alone; symbols of a batch of words.
LONG, BATCH = 48, 250_000


def fields(raw: bytes) -> list[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer's fields."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = raw[at]
            value, shift, at = value | (b & 127) << shift, shift + 7, at + 1
            if b < 128:
                return value, at

    out, at = [], 0
    while at < len(raw):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = (8, at) if key & 7 == 1 else (4, at) if key & 7 == 5 else varint(at)
            value, at = raw[at : at + size], at + size
        out.append((key >> 3, value))
    return out


class Normaliser:
    """Transducer of characters to symbols. Its states are `begin`, `blank` (a blank was read last) and `word`."""

    def __init__(self, path: str, model):
        with open(path, "rb") as f:
            parts = dict(fields(f.read()))  # the last of a repeated field: there is one normaliser
        if dict(fields(parts.get(2, b""))).get(3, 1) != 2:
            raise ValueError(f"{path}: not a BPE model")
        rules = dict(fields(parts.get(3, b"")))
        self.charsmap = bool(rules.get(2, b""))
        self.front, self.collapse, self.marks = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        self.model = model
        blank = MARK if self.marks else " "
        # state, whether a blank is read: what is written before the character (None: nothing is written at all), next state
        self.arcs = {
            ("begin", False): ((blank if self.front else ""), "word"),
            ("begin", True): (None, "begin") if self.collapse else ((blank if self.front else ""), "blank"),
            ("blank", False): (blank if self.collapse else "", "word"),
            ("blank", True): (None, "blank") if self.collapse else ("", "blank"),
            ("word", False): ("", "word"),
            ("word", True): (None, "blank") if self.collapse else ("", "blank"),
        }
        #: Whether the whole is: blanks as marks, and one in front.
        self.plain = self.front and self.marks and not (self.collapse or self.charsmap)

    def read(self, text: str) -> str:
        if self.charsmap:
            return self.model.normalize(text)
        if self.plain:
            return MARK + text.replace(" ", MARK) if text else ""
        out, state = [], "begin"
        for c in text:
            before, state = self.arcs[state, c == " "]
            if before is not None:
                out.append(before + (MARK if c == " " and self.marks else c))
        return "".join(out)


class Transducer:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.normaliser = Normaliser(path, model)
        self.piece = [model.id_to_piece(i) for i in range(n)]
        self.id = {self.piece[i]: i for i in normal}
        self.score = {self.piece[i]: model.get_score(i) for i in normal}
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        from_byte = {i: b for b, i in self.byte.items()}
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.id), default=1)
        written = [bytes([from_byte[i]]) if i in from_byte else b"" if model.is_control(i) else self.piece[i].replace(MARK, " ").encode("utf-8") for i in range(n)]
        self.bytes_of = np.frombuffer(b"".join(written), dtype=np.uint8)
        self.byte_ends = np.cumsum([0, *map(len, written)])
        self.written = written
        # the trie: an arc is state * symbols + symbol
        letters = sorted({c for p in self.id for c in p})
        self.symbol = np.zeros(0x110000, dtype=np.int64)
        self.symbol[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.symbols = len(letters) + 1
        arcs: dict[int, int] = {}
        ends = {}
        for p, i in self.id.items():
            at = 0
            for s in self.symbol[[ord(c) for c in p]].tolist():
                at = arcs.setdefault(at * self.symbols + s, len(arcs) + 1)
            ends[at] = i
        self.ends = np.full(len(arcs) + 1, -1, dtype=np.int64)
        self.ends[list(ends)] = list(ends.values())
        self.arcs = LongMap()
        self.arcs.put(np.array(list(arcs), dtype=np.int64), np.array(list(arcs.values()), dtype=np.int64))
        beside = sorted({int(a) * self.symbols + int(b) for p in self.id for a, b in zip(*(self.symbol[[ord(c) for c in q]] for q in (p[:-1], p[1:])))}) if self.longest > 1 else []
        self.beside = LongMap()
        self.beside.put(np.array(beside, dtype=np.int64), np.ones(len(beside), dtype=np.int64))
        self.cut = not any(MARK in p.lstrip(MARK) or "\n" in p[len(p) == 1 :] for p in self.id)
        self.first = np.full(n, -1, dtype=np.int8)  # the weight of a piece that begins a word, where known
        self.pairs = LongMap()
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {"": 0}  # where a word's ids begin and end
        self.pool, self.slots = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 16, dtype=np.int64)

    # --- weights ------------------------------------------------------------------------------------------------------

    def joined(self, text: str) -> list[str]:
        """What the model's rule makes of two pieces' text: of all neighbours whose union is a piece, the best and leftmost join first."""
        out = list(text)
        while len(out) > 1:
            best, at = None, -1
            for k in range(len(out) - 1):
                s = self.score.get(out[k] + out[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def weights(self, a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
        """Weights of the arcs that read b after a, or first (a: None). Unknown characters (below 0 or from n on) weigh 0."""
        out = np.zeros(len(b), dtype=np.int32)
        if a is None:
            at = np.flatnonzero(b < self.n)
            new = np.unique(b[at][self.first[b[at]] < 0])
            self.first[new] = [len(p) > 2 and self.joined(p) != [p] for p in (self.piece[i] for i in new.tolist())]
            out[at] = self.first[b[at]]
            return out
        at = np.flatnonzero((a < self.n) & (b < self.n))
        key = a[at] * self.n + b[at]
        got = self.pairs.get(key)
        new = np.unique(key[got < 0])
        if len(new):
            if self.pairs.size + len(new) > PAIRS:
                self.pairs = LongMap()
                new = np.unique(key)
            texts = [(self.piece[k // self.n], self.piece[k % self.n]) for k in new.tolist()]
            self.pairs.put(new, np.array([self.joined(x + y) != [x, y] for x, y in texts], dtype=np.int64))
            got = self.pairs.get(key)
        out[at] = got
        return out

    # --- composition and shortest paths ---------------------------------------------------------------------------------

    def compose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        whole, words, pieces = words, [], []
        for w in whole:
            cut = self.apart(w) if len(w) > LONG else [w]
            words += cut
            pieces.append(len(cut))
        ids: list[np.ndarray | None] = [None] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        at = 0
        while order and len(words[order[-1]]) > LONG:
            ids[order[-1]] = self._path(words[order[-1]])
            order.pop()
        while at < len(order):
            size = max(1, len(words[order[at]]))
            end = at + 1
            while end < len(order) and len(words[order[end]]) <= max(8, size + size // 2) and (end - at) * len(words[order[end]]) <= BATCH:
                end += 1
            flat, sizes = self._paths([words[k] for k in order[at:end]])
            for k, x in zip(order[at:end], np.split(flat, np.cumsum(sizes)[:-1])):
                ids[k] = x
            at = end
        sizes = np.array([0, *map(len, ids)], dtype=np.int64).cumsum()[np.array([0, *pieces]).cumsum()]
        return (np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)), np.diff(sizes)

    def apart(self, word: str) -> list[str]:
        """A long word, cut where two characters stand side by side in no piece: no arc leads over such a place."""
        symbols = self.symbol[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        places = np.flatnonzero(self.beside.get(symbols[:-1] * self.symbols + symbols[1:]) < 0) + 1
        return [word[a:b] for a, b in zip([0, *places.tolist()], [*places.tolist(), len(word)])]

    def _path(self, word: str) -> np.ndarray:
        """Shortest path of one long word."""
        n, known, seen = len(word), self.id, {}
        cost, last, back = [0] + [1 << 20] * n, [0] * (n + 1), [0] * (n + 1)
        for start in range(n):
            before, now = last[start], cost[start]
            for end in range(start + 1, min(n, start + self.longest) + 1):
                piece = known.get(word[start:end])
                if piece is None:
                    if end > start + 1:
                        continue
                    piece = self.n + ord(word[start])
                if now >= cost[end]:
                    continue
                key = (before if start else -1, piece)
                weight = seen.get(key)
                if weight is None:
                    weight = seen[key] = int(self.weights(np.array([before]) if start else None, np.array([piece]))[0])
                if now + weight < cost[end]:
                    cost[end], last[end], back[end] = now + weight, piece, end - start
        out = []
        while n:
            out.append(last[n])
            n -= back[n]
        return np.array([x for i in reversed(out) for x in ([i] if i < self.n else self.fallback(i - self.n))], dtype=np.int32)

    def _paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Shortest paths of some words of like lengths, all side by side."""
        n, lens = len(words), np.array(list(map(len, words)), dtype=np.int64)
        size = int(lens.max(initial=0))
        if not size:
            return np.zeros(0, dtype=np.int32), lens
        chars = np.zeros((size, n), dtype=np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        column = np.repeat(np.arange(n), lens)
        chars[np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens), column] = flat
        symbols = self.symbol[chars]
        cost = np.full((size + 1, n), 1 << 20, dtype=np.int32)
        last = np.zeros((size + 1, n), dtype=np.int64)  # the last piece, and how many characters it reads
        back = np.zeros((size + 1, n), dtype=np.int32)
        cost[0] = 0
        for start in range(size):  # positions in order: what leads to `start` is final
            who = np.flatnonzero(lens > start)
            state = np.zeros(len(who), dtype=np.int64)
            for reads in range(1, min(self.longest, size - start) + 1):
                end = start + reads
                more = lens[who] >= end
                who, state = who[more], state[more]
                state = self.arcs.get(state * self.symbols + symbols[end - 1, who])
                if reads == 1:  # a character of no piece is read by an arc of its own
                    state = np.where(symbols[start, who] > 0, state, -1)
                    odd = who[(state < 0) | (self.ends[state] < 0)]
                    self._arrive(cost, last, back, start, end, odd, self.n + chars[start, odd])
                alive = state >= 0
                who, state = who[alive], state[alive]
                if not len(who):
                    break
                piece = self.ends[state]
                ends = piece >= 0
                self._arrive(cost, last, back, start, end, who[ends], piece[ends])
        # back from the end
        at, out, row = lens.copy(), [], np.arange(n)
        who = row[at > 0]
        while len(who):
            out.append((who, last[at[who], who]))
            at[who] -= back[at[who], who]
            who = who[at[who] > 0]
        of, step = np.concatenate([w for w, _ in out]), np.repeat(np.arange(len(out)), [len(w) for w, _ in out])
        ids = np.concatenate([p for _, p in out])
        order = np.lexsort((-step, of))
        of, ids = of[order], ids[order]
        if (ids >= self.n).any():
            parts = [[i] if i < self.n else self.fallback(i - self.n) for i in ids.tolist()]
            of = np.repeat(of, list(map(len, parts)))
            ids = np.array([x for p in parts for x in p], dtype=np.int64)
        return ids.astype(np.int32), np.bincount(of, minlength=n)

    def _arrive(self, cost, last, back, start: int, end: int, who: np.ndarray, piece: np.ndarray) -> None:
        """Takes the arcs from `start` to `end` where they cost less than what led to `end` so far; of equal ones the longer stays."""
        can = cost[start, who] < cost[end, who]
        who, piece = who[can], piece[can]
        if not len(who):
            return
        new = cost[start, who] + self.weights(None if start == 0 else last[start, who], piece)
        better = new < cost[end, who]
        who = who[better]
        cost[end, who], last[end, who], back[end, who] = new[better], piece[better], end - start

    def fallback(self, char: int) -> list[int]:
        """Ids of an unknown character: its bytes."""
        return [self.byte[b] for b in chr(char).encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    # --- texts ----------------------------------------------------------------------------------------------------------

    def _learn(self, words: list[str]) -> None:
        new = [w for w in words if w not in self.slot]
        if len(self.slot) + len(new) > MEMO:
            self._forget()
            new = [w for w in words if w]
        if not new:
            return
        ids, sizes = self.compose(new)
        n, end = len(self.slot), int(self.slots[len(self.slot)])
        while n + len(new) + 1 > len(self.slots):
            self.slots = np.concatenate((self.slots, np.zeros_like(self.slots)))
        while end + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.slots[n + 1 : n + 1 + len(new)] = end + np.cumsum(sizes)
        self.pool[end : end + len(ids)] = ids
        self.slot.update(zip(new, range(n, n + len(new))))

    def encode_all(self, texts) -> list[np.ndarray]:
        """The ids of each text of a list or Arrow array; null as empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = (texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string())).fill_null("")
        if not len(texts):
            return []
        odd = np.ones(len(texts), dtype=bool)
        if self.cut and self.normaliser.plain:  # each blank begins a word; texts with several side by side go the long way
            odd = pc.starts_with(texts, " ").to_numpy(zero_copy_only=False).copy()
            for x in ("  ", MARK, CUT):
                odd |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        marked = pc.if_else(pc.equal(plain, ""), "", pc.binary_join_element_wise(MARK, pc.replace_substring(plain, " ", CUT + MARK), ""))
        split = pc.split_pattern(pc.replace_substring(marked, "\n", f"{CUT}\n{CUT}"), CUT)
        words = split.flatten().dictionary_encode()
        here = words.dictionary.to_pylist()
        self._learn(here)
        slot = np.fromiter(map(self.slot.__getitem__, here), dtype=np.int64, count=len(here))[words.indices.to_numpy()]
        first, n = self.slots[slot], self.slots[slot + 1] - self.slots[slot]
        end = np.cumsum(n)
        ids = self.pool[np.repeat(first - (end - n), n) + np.arange(end[-1])]
        out = np.split(ids, np.concatenate(([0], end))[np.cumsum(pc.list_value_length(split).to_numpy())][:-1])
        for k in np.flatnonzero(odd).tolist():
            text = self.normaliser.read(texts[k].as_py())
            parts = [w for p in PART.findall(text) for w in (re.split("(\n)", p) if self.cut else [p])] if self.cut else [text]
            self._learn(list(dict.fromkeys(parts)))
            out[k] = np.concatenate([np.zeros(0, dtype=np.int32), *(self.pool[self.slots[s] : self.slots[s + 1]] for s in map(self.slot.__getitem__, parts))])
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def bytes_from(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that a sequence of ids writes."""
        first, n = self.byte_ends[ids], self.byte_ends[ids + 1] - self.byte_ends[ids]
        end = np.cumsum(n)
        return self.bytes_of[np.repeat(first - (end - n), n) + np.arange(end[-1] if len(end) else 0)]

    def decode(self, ids) -> str:
        """Text of a sequence of ids; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.written.__getitem__, ids)).decode("utf-8", "replace")
        return text.removeprefix(" ") if self.normaliser.front else text


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def given_back(t: Transducer, ids: list[np.ndarray], texts: list[str | None]) -> list[bool]:
    """Whether each sequence of ids decodes to its text (whose marks read as blanks)."""
    return [not text and not len(i) or t.bytes_from(i).tobytes() == (" " + text.replace(MARK, " ")).encode("utf-8", "surrogatepass") if t.normaliser.plain else t.decode(i.tolist()) == text for i, text in zip(ids, (x or "" for x in texts))]


def encode(docs: DataFrame, path: str | None = None, verify: bool = False, keep_ids: bool = True) -> DataFrame:
    """All columns of `docs`, and piece_ids (array<int>; not without keep_ids), n_pieces, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers) and, with verify, decodes: whether decoding gives the text back.

    Columns of `docs` under these names are replaced.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    path = path or tokenizer_path("piece_bpe_32k.model")
    new = ["piece_ids"] * keep_ids + ["n_pieces", "ids_crc32"] + ["decodes"] * verify
    docs = docs.drop(*new)
    where = docs.columns.index("text")
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema), *["piece_ids array<int>"] * keep_ids, "n_pieces int", "ids_crc32 long", *["decodes boolean"] * verify])

    def batches(it):
        t = transducer(path)
        for b in it:
            at = 0
            upto = np.cumsum(pc.binary_length(b.column(where)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 2_000_000)))
                c = b.slice(at, end - at)
                ids = t.encode_all(c.column(where))
                sizes = list(map(len, ids))
                more = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))] if keep_ids else []
                more += [pa.array(sizes, pa.int32()), pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64())]
                if verify:
                    more.append(pa.array(given_back(t, ids, c.column(where).to_pylist()), pa.bool_()))
                yield pa.RecordBatch.from_arrays([*c.columns, *more], names=[*c.schema.names, *new])
                at = end

    batch_rows(docs.sparkSession)
    return docs.mapInArrow(frugal(batches), schema)


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of `df`, and decoded: the text of piece_ids (null: "")."""
    import pyarrow as pa

    path = path or tokenizer_path("piece_bpe_32k.model")
    df = df.drop("decoded")
    where = df.columns.index("piece_ids")
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema), "decoded string"])

    def batches(it):
        t = transducer(path)
        for b in it:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([t.decode(i or []) for i in b.column(where).to_pylist()], pa.string())], names=[*b.schema.names, "decoded"])

    batch_rows(df.sparkSession)
    return df.mapInArrow(frugal(batches), schema)
