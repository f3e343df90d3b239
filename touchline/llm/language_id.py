"""Language identification by cross-parsing.

For each language a suffix automaton of a bounded sample of labelled text is built. A text is parsed greedily against
it: each phrase is the longest prefix of the rest that occurs in the sample. The language whose automaton needs the
fewest phrases, normalised to bits per letter (phrases x log2 of the sample's length / length), wins.

Null texts, empty texts and texts without letters: `und`, score 0. Ties: the first language by name. Repeated rows are
predicted each on its own; extra columns of the input are ignored, whatever their names. No labelled row at all: every text
is `und`. An empty table gives no row. Very long texts are parsed whole. Alphabets may be of any size: the automata are
sparse tables. Of more than `max_languages` labels the most frequent are learned. What is learned is bounded: of each
language `per_language` rows, chosen by a hash, and of these as many in the order of doc_id as `max_chars` characters hold,
of a long text its first share; all else sees whole texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch_rows, frugal, texts_of

UND = "und"


def held_out(doc_id="doc_id"):
    """True for the fifth of the documents from which nothing is learned."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def training_texts(docs: DataFrame, per_language: int = 48, max_chars: int = 12_000, max_languages: int = 512) -> dict[str, str]:
    """A bounded sample: for each language the `per_language` rows of least hash outside the held-out fold, of each the same
    share of characters from its begin, `max_chars` characters in all.

    The bound is per_language x max_languages rows and max_chars x max_languages characters, at any size of the input.
    Only ids and labels are ranked; the texts of the chosen rows are fetched by a filter on their ids.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = [r.lang for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()]
    best = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = rows.where(F.col("lang").isin(languages)).select("doc_id", "lang").withColumn("k", F.row_number().over(best))
    found = picked.where(F.col("k") <= per_language).select("doc_id", "lang").distinct().collect()
    out: dict[str, list[tuple[int, str]]] = {}
    if not found:
        return {}
    texts = rows.where(F.col("doc_id").isin([r.doc_id for r in found]) & F.col("lang").isin(languages)).groupBy("doc_id", "lang").agg(F.min(F.substring("text", 1, max_chars)).alias("text"))
    for r in texts.collect():
        out.setdefault(r.lang, []).append((r.doc_id, r.text))
    share = max(200, max_chars // max(1, per_language // 4))
    sample = {k: " ".join(t[:share] for _, t in sorted(v))[:max_chars] for k, v in out.items()}
    return {k: v for k, v in sorted(sample.items()) if any(c.isalpha() for c in v)}


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the states of the suffix automaton of `codes`; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class CrossParser:
    """The automata of all languages as rows of one sparse table, shifted into each other's gaps.

    A state is where its row begins. `owner` of state + symbol is the state (else the state has no such edge, and the
    phrase ends), `next` the next state, and in its two lowest bits how many phrases end.
    """

    def __init__(self, texts: dict[str, str]):
        self.languages = list(texts)
        letters = sorted({c for t in texts.values() for c in t.lower() if c.isalpha()})
        self.width = len(letters) + 2  # 0: between words; 1: a letter of no sample
        code = np.zeros(0x110000, dtype=np.int32)
        code[[i for i in range(0x110000) if chr(i).isalpha()]] = 1
        for k, c in enumerate(letters, 2):
            for x in {c, c.upper(), c.title()}:
                if len(x) == 1:
                    code[ord(x)] = k
        self.code = code
        owner, target = {}, {}  # by slot
        self.roots, self.sizes, ends, end = [], [], [], 0
        for text in texts.values():
            codes = self.codes(text)
            edges = suffix_automaton(codes.tolist())
            # the start has all symbols; one that stands nowhere in the sample is a phrase of its own
            root = end
            state = np.full(len(edges), -1, dtype=np.int64)
            state[0] = root
            owner.update((root + c, root) for c in range(self.width))
            taken, free = {root}, end + self.width
            top = free + self.width
            for k in sorted(range(1, len(edges)), key=lambda k: -len(edges[k])):
                row = sorted(edges[k])
                lead = row[0] if row else 0
                low = at = max(free, root + self.width + lead)  # so that no row begins within another language's
                tries = 0
                while at - lead in taken or any(at + c - lead in owner for c in row):
                    tries += 1  # the next place, then any, then behind all others
                    at = at + 1 if tries < 32 else low + k * tries * 0x9E3779B1 % (top - low + 1) if tries < 128 else max(at + 1, top)
                begin = at - lead
                taken.add(begin)
                state[k] = begin
                owner.update((begin + c, begin) for c in row)
                top = max(top, begin + row[-1] + 1 if row else 0)
                while free in owner:
                    free += 1
            for k, row in enumerate(edges):
                target.update((int(state[k]) + c, int(state[s])) for c, s in row.items())
            ends.append((root, {c: int(state[s]) for c, s in edges[0].items()}))
            self.roots.append(root)
            self.sizes.append(max(2, len(codes)))
            end = top
        kind = np.int32 if end + self.width < 2**29 else np.int64
        self.owner, self.next = np.full(end + self.width, -1, dtype=kind), np.zeros(end + self.width, dtype=kind)
        self.owner[np.fromiter(owner, dtype=np.int64, count=len(owner))] = np.fromiter(owner.values(), dtype=np.int64, count=len(owner))
        self.next[np.fromiter(target, dtype=np.int64, count=len(target))] = np.fromiter(target.values(), dtype=np.int64, count=len(target)) << 2
        #: What follows where a phrase ends, by language and symbol: the next state and how many phrases end.
        self.reset = np.zeros((len(self.roots), self.width), dtype=kind)
        for k, (root, first) in enumerate(ends):
            self.reset[k] = root << 2 | 2
            known = list(first)
            self.reset[k, known] = [first[c] << 2 | 1 for c in known]
            odd = np.setdiff1d(np.arange(self.width), known)
            self.next[root + odd] = root << 2 | 1
        self.views = memoryview(self.owner), memoryview(self.next)

    def codes(self, text: str) -> np.ndarray:
        """Symbols of a text, each run of other characters as one 0, and a 0 at either end."""
        raw = self.code[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        return raw[np.concatenate(([True], (raw[1:] != 0) | (raw[:-1] != 0)))]

    def phrases(self, codes: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns). Texts go through the automata side by side, longest first."""
        order = sorted(range(len(codes)), key=lambda i: -len(codes[i]))
        lengths = np.array([len(codes[i]) for i in order])
        starts = np.cumsum(lengths) - lengths
        flat = np.concatenate([codes[i] for i in order]).astype(np.int32)
        roots = np.array(self.roots, dtype=self.next.dtype)[:, None]
        state = np.repeat(roots, len(codes), axis=1)
        count = np.zeros(state.shape, dtype=np.int32)
        k = len(codes)
        for t in range(int(lengths[0]) if len(lengths) else 0):
            while k and lengths[k - 1] <= t:
                k -= 1
            if k < 12:
                break
            c, now = flat[starts[:k] + t], state[:, :k]
            at = now + c
            step = np.where(self.owner.take(at) == now, self.next.take(at), self.reset.take(c, axis=1))
            count[:, :k] += step & 3
            state[:, :k] = step >> 2
        else:
            k = 0
        owner, nxt = self.views
        for j in range(k):  # the few longest: one by one
            rest = flat[starts[j] + t : starts[j] + lengths[j]].tolist()
            for lang in range(len(self.roots)):
                s, n, reset = int(state[lang, j]), 0, self.reset[lang].tolist()
                for c in rest:
                    v = nxt[s + c] if owner[s + c] == s else reset[c]
                    n += v & 3
                    s = v >> 2
                state[lang, j] = s
                count[lang, j] += n
        count += state != roots  # the phrase that the end cuts off
        out = np.empty((len(codes), len(self.roots)), dtype=np.int64)
        out[order] = count.T
        return out

    def predict(self, texts: list[str | None], chunk: int = 2_000_000) -> Iterator[tuple[str, float, float | None]]:
        """(language, score, bits per letter) of each text, in order."""
        bits = np.log2(np.array(self.sizes)) if self.sizes else None
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= chunk):
                chars += len(texts[end] or "")
                end += 1
            codes = [self.codes(t or "") for t in texts[at:end]]
            n = self.phrases(codes) if self.roots else None
            for k, c in enumerate(codes):
                letters = int(np.count_nonzero(c))
                if not letters or n is None:
                    yield UND, 0.0, None
                    continue
                cost = n[k] * bits / letters
                best = int(np.argmin(cost))
                others = np.delete(cost, best)
                yield self.languages[best], float(1 - cost[best] / others.min()) if len(others) else 1.0, float(cost[best])
            at = end


@functools.lru_cache(maxsize=2)
def parser(texts: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(dict(texts))


def predict(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred, score, bits of every row; the prediction sees the whole text and nothing else."""
    import pyarrow as pa

    given = tuple(texts.items())

    def batches(it):
        p = parser(given)
        for b in it:
            got = list(p.predict(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64())))], names=["doc_id", "lang_pred", "score", "bits"])

    batch_rows(docs.sparkSession)
    return texts_of(docs).mapInArrow(frugal(batches), "doc_id long, lang_pred string, score double, bits double")


def keep(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text has a language."""
    import pyarrow as pa

    given, where = tuple(texts.items()), docs.columns.index("text")

    def batches(it):
        p = parser(given)
        for b in it:
            yield b.filter(pa.array([g[0] != UND for g in p.predict(b.column(where).to_pylist())], pa.bool_()))

    batch_rows(docs.sparkSession)
    return docs.mapInArrow(frugal(batches), docs.schema)


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """Learns from the labelled rows outside the held-out fold and predicts every row: doc_id, held_out, lang_pred, score, bits."""
    return predict(docs, training_texts(docs, **bounds)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits")
