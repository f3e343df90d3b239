"""Alignment of two tokenizers' ids by segment deduplication.

A is a byte-level BPE tokenizer, which reads space+text; B a SentencePiece BPE model, which puts the space in front itself.
Where tokens of both end at the same byte a group of tokens ends; the two tokens that end there are a link.

A document is cut before a run of blanks that begins with a space and follows another character. No token goes over such a
place, and none on one side depends on the other, which `verified` reads from the two files: B has no piece with a blank
after another character and neither changes the text first; A's pre-tokenizer begins a new word there. So a place to cut
is the end of a group, and equal segments have equal tokens wherever they stand.

Documents go in chunks of CHUNK_BYTES; a chunk lists its distinct segments once and has each document as a row of numbers
in that list. The lists are dealt out by segment, so that each distinct segment of the corpus is tokenised and aligned once,
for all chunks that have it. Links are counted from the segments' occurrences; alignments and counts are joined back to the
chunks, and each chunk composes its documents. No word of a text is shuffled but as part of a chunk's packed row of numbers;
a frequent segment is one row a chunk, wherever it is dealt to.

Null and empty texts have no tokens, nor have texts in which B's mark for a blank stands (B's tokens read as another text):
zeros and an empty hash. Special tokens' strings are plain text. Very long texts, and texts without blanks, are whole (a chunk
of their own at most). Repeated rows and doc_ids: a row each, counted each. Ties for an id's highest count are all best. An
empty table gives no row. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_rows, few_rows, frugal, kept, parts, passing, release, tokenizer_path, trim
from .sentence_pieces import MARK, Normaliser

#: Bytes of text of a chunk, on average, and of what is cut at once.
CHUNK_BYTES, SLICE_BYTES = 32 << 20, 2 << 20
#: Characters that are white space for one of the libraries, or may be: no cut follows them.
BLANKS = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}"
#: Stands for a space to cut at, in texts that don't hold it (it is no character).
CUT = "\ufdd0"
IN_PYTHON = re.sub(r"\\x\{(\w+)\}", lambda m: "\\u" + m[1].zfill(4), BLANKS)
ENDS_BLANK = re.compile(f"[{IN_PYTHON}]$")
#: Segments that are tokenised as one text, and rows of a chunk's documents that are packed together.
TOGETHER, PACKED = 400, 2000


class Tokenizers:
    """Both tokenizers over segments, which begin with a space that is left out."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.apart = verified(path_a, path_b, self.b)
        byte = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        n = self.b.get_piece_size()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(n))]
        self.size_a, self.size_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        one, two = self.b.encode("x"), self.b.encode("x ")
        self.space_b = two[len(one) :]  # B adds no space to an empty text

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments by A and by B, one after another; those that may be joined are read as one text."""
        a, b, run = [], [], []

        def flush():
            if run:
                text = " ".join(run)
                a.append(self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids)
                b.append(self.b.encode(text) if text else self.space_b)
                run.clear()

        for s in segments:
            run.append(s)
            if len(run) >= TOGETHER or not self.apart or not s or ENDS_BLANK.search(s):  # the next space would join its blanks
                flush()
        flush()
        return tuple(np.fromiter((i for ids in each for i in ids), dtype=np.int64) for each in (a, b))


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def verified(path_a: str, path_b: str, b) -> bool:
    """Whether texts may be cut; a pair that doesn't keep texts as they are is refused."""
    with open(path_a, encoding="utf-8") as f:
        a = json.load(f)
    words = a["pre_tokenizer"] or {}
    if a["normalizer"] or a["model"]["type"] != "BPE" or words.get("type") != "ByteLevel" or words.get("add_prefix_space"):
        raise ValueError(f"{path_a}: not a byte-level BPE tokenizer over unchanged text")
    n = b.get_piece_size()
    if not Normaliser(path_b, b).plain or sum(map(b.is_byte, range(n))) != 256:
        raise ValueError(f"{path_b}: not a BPE model over unchanged text with byte fallback")
    joined = re.compile(f"[^{MARK}]{MARK}")
    return bool(words.get("use_regex", True)) and not any(joined.search(b.id_to_piece(i)) for i in range(n))


@functools.lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def cut(texts):
    """Of an Arrow array of texts (without nulls): how many segments each has, and all segments in order, dictionary-encoded."""
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.split_pattern(pc.replace_substring_regex(texts, f"([^{BLANKS}]) ", rf"\1{CUT}"), CUT)
    odd = np.flatnonzero(pc.match_substring(texts, CUT).to_numpy(zero_copy_only=False))
    if len(odd):  # texts that hold the stand-in themselves
        place = re.compile(f"(?<=[^{IN_PYTHON}]) ")
        lists = split.to_pylist()
        for k in odd.tolist():
            lists[k] = place.split(texts[k].as_py())
        split = pa.array(lists, pa.list_(pa.string()))
    return pc.list_value_length(split).to_numpy(), split.flatten().dictionary_encode()


def packed(codes: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes, their lowest bytes first, then the next ones."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


def chunks(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A written table of packed documents (chunk, ids, known, sizes, codes) and of the chunks' distinct segments (chunk,
    code, segment, n)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    schema = pa.schema([("chunk", pa.int64()), *((c, pa.binary()) for c in ("ids", "known", "sizes", "codes")), ("code", pa.int32()), ("segment", pa.string()), ("n", pa.int64())])

    def batches_of(batches):
        from pyspark import TaskContext

        chunk, apart = TaskContext.get().partitionId() << 33, tokenizers(path_a, path_b).apart
        some, size = [], 0

        def read(ids, texts):
            """Of some documents: ids, which have tokens, their numbers of segments, the segments; the text is let go of."""
            fit = pc.fill_null(pc.and_(pc.greater(pc.binary_length(texts), 0), pc.invert(pc.match_substring(texts, MARK))), False)
            whole, full = texts.filter(fit), fit.to_numpy(zero_copy_only=False)
            each, words = cut(whole) if apart else (np.ones(len(whole), dtype=np.int64), whole.dictionary_encode())
            sizes = np.zeros(len(ids), dtype="<i4")
            sizes[full] = each
            return ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), sizes, words

        def rows():
            known, numbers, sizes = (np.concatenate([s[k] for s in some]) for k in range(3))
            words = pa.chunked_array([s[3] for s in some]).unify_dictionaries()
            segments, m = words.chunk(0).dictionary, len(words.chunk(0).dictionary)
            codes = np.concatenate([c.indices.to_numpy() for c in words.chunks]).astype("<i4")
            del words
            counts = np.bincount(codes, minlength=m)
            order = np.argsort(-counts, kind="stable")  # frequent ones first: small numbers pack well
            renamed = np.empty(m, dtype="<i4")
            renamed[order] = np.arange(m, dtype="<i4")
            codes = renamed[codes]
            to = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
            for at in range(0, len(sizes), PACKED):
                end = min(len(sizes), at + PACKED)
                row = [chunk, numbers[at:end].astype("<i8").tobytes(), known[at:end].tobytes(), sizes[at:end].tobytes(), packed(codes[to[at] : to[end]])]
                yield pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in zip(row, schema.types)), *(pa.nulls(1, t) for t in schema.types[5:])], schema=schema)
            del codes
            for at in range(0, m, 50_000):
                here = order[at : at + 50_000]
                k = len(here)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, chunk)), *(pa.nulls(k, pa.binary()) for _ in range(4)), pa.array(np.arange(at, at + k, dtype=np.int32)), segments.take(pa.array(here)), pa.array(counts[here].astype(np.int64))], schema=schema)

        for b in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
            at = 0
            while at < b.num_rows:
                before = int(upto[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(upto, before + min(SLICE_BYTES, chunk_bytes - size))))
                some.append(read(b.column(0).slice(at, to - at), b.column(1).slice(at, to - at)))
                size, at = size + int(upto[to - 1]) - before, to
                if size >= chunk_bytes:
                    yield from rows()
                    chunk, some, size = chunk + 1, [], 0
        if some:
            yield from rows()

    batch_rows(docs.sparkSession)
    return kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(batches_of), "chunk long, ids binary, known binary, sizes binary, codes binary, code int, segment string, n long"), "chunks")


def aligned(lists: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A written table: for each row of the chunks' lists (chunk, code) its groups; and chunk, pair, n: how often the
    chunk's documents link a and b (pair = a * 2^32 + b), in parts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    schema = pa.schema([("chunk", pa.int64()), ("code", pa.int32()), ("groups", pa.string()), ("pair", pa.int64()), ("n", pa.int64())])

    def batches_of(batches):
        t, counted, held = tokenizers(path_a, path_b), [], 0

        def pairs():
            chunk, pair, n = (np.concatenate(c) for c in zip(*counted))
            order = np.lexsort((pair, chunk))
            chunk, pair, n = chunk[order], pair[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], (chunk[1:] != chunk[:-1]) | (pair[1:] != pair[:-1]))))
            k = len(first)
            return pa.RecordBatch.from_arrays([pa.array(chunk[first]), pa.nulls(k, pa.int32()), pa.nulls(k, pa.string()), pa.array(pair[first]), pa.array(np.add.reduceat(n, first))], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            rows = b.column(2)  # sorted: equal segments stand together
            new = np.concatenate(([True], pc.not_equal(rows.slice(1), rows.slice(0, len(rows) - 1)).to_numpy(zero_copy_only=False)))
            of = np.cumsum(new) - 1  # of each row, its segment's place
            segments = rows.filter(pa.array(new)).to_pylist()
            ids_a, ids_b = t.encode(segments)
            text = (" " + " ".join(segments)).encode()
            if not (b"".join(map(t.bytes_a.__getitem__, ids_a.tolist())) == text == b"".join(map(t.bytes_b.__getitem__, ids_b.tolist()))):
                raise ValueError("tokens don't read as their texts: the tokenizers change texts in a way that their files don't tell")
            # the batch is one text, whose segments end where both tokenizers' tokens do
            ends_a, ends_b = np.cumsum(t.size_a[ids_a]), np.cumsum(t.size_b[ids_b])
            meet = np.intersect1d(ends_a, ends_b, assume_unique=True)
            to_a, to_b = np.searchsorted(ends_a, meet), np.searchsorted(ends_b, meet)
            ends = np.cumsum([len(s.encode()) + 1 for s in segments])
            last = np.searchsorted(meet, ends)  # of each segment, its last group
            texts_a, texts_b = ids_a.astype(str).tolist(), ids_b.astype(str).tolist()
            groups, x, y = [], 0, 0
            for p, q in zip((to_a + 1).tolist(), (to_b + 1).tolist()):
                groups.append(f"{texts_a[x]}|{texts_b[y]}" if p - x == 1 == q - y else ",".join(texts_a[x:p]) + "|" + ",".join(texts_b[y:q]))
                x, y = p, q
            first = np.concatenate(([0], last + 1))
            joined = pa.array([";".join(groups[p:q]) for p, q in zip(first[:-1].tolist(), first[1:].tolist())], pa.string())
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), joined.take(pa.array(of)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], schema=schema)
            # every link of every row
            size = np.diff(first)[of]
            link = np.repeat(first[:-1][of] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            counted.append((np.repeat(b.column(0).to_numpy(), size), ((ids_a[to_a] << 32) + ids_b[to_b])[link], np.repeat(b.column(3).to_numpy(), size)))
            held += len(link)
            if held > 1_000_000:
                yield pairs()
                counted, held = [], 0
        if counted:
            yield pairs()

    spark = lists.sparkSession
    batch_rows(spark, 20_000)
    dealt = lists.select("chunk", "code", "segment", "n").repartition(parts(spark), "segment").sortWithinPartitions("segment")
    return kept(dealt.mapInArrow(frugal(batches_of), "chunk long, code int, groups string, pair long, n long"), "aligned")


def links(found: DataFrame) -> DataFrame:
    """pair, value (2 * how often it is linked in the corpus, and 1 more if no other link of its b is more frequent)."""
    counts = found.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("count"))
    best = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    return counts.select("pair", (F.col("count") * 2 + (F.col("count") == best).cast("long")).alias("value"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = docs.sparkSession
    path_a, path_b = path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model")
    table = chunks(docs, path_a, path_b, chunk_bytes)
    found = aligned(table.where("code is not null"), path_a, path_b)
    release(spark)
    with passing(spark) as stays:
        counts = few_rows(kept(links(found), "links"))
        linked = stays(kept(found.where("pair is not null").select("chunk", "pair").distinct().join(counts, "pair"), "linked"))
    release(spark)
    back = found.where("code is not null").select("chunk", "code", "groups").unionByName(linked, allowMissingColumns=True)
    out = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", pa.string())])

    def compose(documents: pa.Table, lists: pa.Table) -> pa.Table:
        """A chunk's documents; what is no longer needed is let go of on the way."""
        tokenizers.cache_clear()
        trim()
        known = lists.select(["pair", "value"]).filter(pc.is_valid(lists.column("pair")))
        pair, first = np.unique(known.column("pair").to_numpy(), return_index=True)
        value = known.column("value").to_numpy()[first]
        segments = lists.select(["code", "groups"]).filter(pc.is_null(lists.column("pair")))
        del known, first
        groups = segments.column("groups").take(pa.array(np.argsort(segments.column("code").to_numpy()))).combine_chunks()  # codes are 0, 1, 2, ...
        split = pc.split_pattern(groups, ";")
        each, to = split.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy())))
        del segments, split
        ends = pc.extract_regex(each, r"(?:^|,)(?P<a>\d+)\|(?:\d+,)*(?P<b>\d+)$")
        link = (pc.struct_field(ends, "a").cast(pa.int64()).to_numpy() << 32) + pc.struct_field(ends, "b").cast(pa.int64()).to_numpy()
        del ends
        counted = value[np.searchsorted(pair, link)]
        del link, pair, value
        commas = pc.count_substring(pc.split_pattern(each, "|").flatten(), ",").to_numpy() + 1
        del each
        each_segment = lambda x: np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[to])
        per_segment = [each_segment(commas[0::2]).astype(np.int32), each_segment(commas[1::2]).astype(np.int32), np.diff(to).astype(np.int32), each_segment(counted & 1).astype(np.int32), each_segment(counted >> 1)]
        del commas, counted
        texts = np.array(groups.to_pylist(), dtype=object)
        del groups
        columns, hashes = [[] for _ in range(6)], []
        for ids, there, sizes, codes in zip(*(documents.column(c).to_pylist() for c in ("ids", "known", "sizes", "codes"))):
            codes = unpacked(codes)
            at = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, dtype="<i4"))))
            columns[0].append(pa.array(np.frombuffer(ids, dtype="<i8"), mask=~np.frombuffer(there, dtype=bool)))
            for c, x in zip(columns[1:], per_segment):
                c.append(pa.array(np.diff(np.concatenate(([0], np.cumsum(x[codes], dtype=np.int64)))[at])))
            for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
                hashes.append(hashlib.sha256(";".join(texts[codes[x:y]].tolist()).encode()).hexdigest() if y > x else "")
        doc_id, n_a, n_b, n_groups, n_best, count_sum = map(pa.concat_arrays, columns)
        return pa.table([doc_id, n_a, n_b, n_groups, n_groups, n_best, count_sum, pa.array(hashes, pa.string())], schema=out)

    documents = table.where("ids is not null").select(F.col("chunk").alias("part"), "ids", "known", "sizes", "codes")
    kinds = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in out)
    return documents.groupBy("part").cogroup(back.groupBy("chunk")).applyInArrow(compose, kinds)
