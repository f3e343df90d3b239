"""Token ids as binary files with a shared zstandard dictionary.

A file holds a run of documents in ascending doc_id order. Each document is compressed on its own with a dictionary
trained on serialized id arrays, so that one short document can be read without its neighbours; the file keeps the
dictionary's hash and an index of offsets.

    b"TLTK" | version u16 | bytes of an id u16 | hash of the dictionary (16 bytes)
    the documents' zstandard frames
    the index, 5 x n int64 in one zstandard frame: 1 if there is a doc_id, doc_id, offset, compressed bytes, ids
    length of that frame u64 | n u64 | b"KTLT"

Null text: as an empty one; a document then has only its end id. Repeated doc_ids are all kept, one after another (a
doc_id that would fill several files is dealt out to them by its bytes; ties within a file by their bytes). A null
doc_id comes first. Very long texts are encoded whole. An empty table makes no file and no row. Extra columns are ignored.
Files are written under a temporary name and renamed, so a task that is run again leaves one whole file.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import struct
import uuid
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_rows, frugal, parts, scratch, texts_of, tokenizer_path

MAGIC, HEAD, TAIL = b"TLTK", "<4sHH16s", "<QQ4s"
#: Words that a worker remembers; they are forgotten when there are more, which never changes a result.
MEMO = 500_000
#: Bytes of text (and 128 a document) that go into one file, on average.
FILE_BYTES = 512 << 20


def open_fs(uri: str):
    """pyarrow's file system and path of a URI or plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":/" in uri else os.path.abspath(uri))


class Encoder:
    """Encodes with the tokenizers library, many texts at a time. The tokenizer drops white space and never joins across
    it, so words between blanks are encoded once and remembered: new ones all in one text, apart by a special token.
    Marks after a letter or digit of ASCII at a word's end are words of their own. Texts that may hold a special token's
    string are encoded as they are."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        self.marks = [t.content for t in added.values()]
        apart = [(i, t.content) for i, t in added.items() if t.special and not (t.normalized or t.single_word or t.lstrip or t.rstrip)]
        self.apart = apart[0] if apart else None
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {"": 0}  # of each word, where its ids begin and end
        self.pool = np.zeros(1 << 16, dtype=self.kind)
        self.ends = np.zeros(1 << 16, dtype=np.int64)  # slot k: pool[ends[k] : ends[k + 1]]

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        ids, sizes = [], []
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            if self.apart:
                got = np.array(self.tokenizer.encode_batch_fast([self.apart[1].join(some)], add_special_tokens=False)[0].ids, dtype=self.kind)
                cut = np.flatnonzero(got == self.apart[0])
                sizes.append(np.diff(np.concatenate(([-1], cut, [len(got)]))) - 1)
                ids.append(np.delete(got, cut))
            else:
                got = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                sizes.append(np.array(list(map(len, got))))
                ids += [np.array(g, dtype=self.kind) for g in got]
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, words: list[str]) -> None:
        ids, sizes = self._ids(words)
        n, end = len(self.slot), int(self.ends[len(self.slot)])
        while n + len(words) + 1 > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        while end + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.ends[n + 1 : n + 1 + len(words)] = end + np.cumsum(sizes)
        self.pool[end : end + len(ids)] = ids
        self.slot.update(zip(words, range(n, n + len(words))))

    def encode(self, texts) -> list[np.ndarray]:
        """The ids of each text of a list or Arrow array; null as empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = (texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string())).fill_null("")
        if not len(texts):
            return []
        whole = np.zeros(len(texts), dtype=bool)
        for m in self.marks:
            whole |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(whole), "", texts) if whole.any() else texts
        plain = pc.replace_substring_regex(plain, r"([A-Za-z0-9])([.,!?;:]+)(\s|$)", r"\1 \2\3")
        # A-Z as a-z, but in texts with combining marks: letters of either case may be composed differently
        plain = pc.if_else(pc.match_substring_regex(plain, r"\p{M}"), plain, pc.ascii_lower(plain))
        split = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        here = words.dictionary.to_pylist()
        new = [w for w in here if w not in self.slot]
        if len(self.slot) + len(new) > MEMO:
            self._forget()
            new = [w for w in here if w]
        if new:
            self._learn(new)
        slot = np.fromiter(map(self.slot.__getitem__, here), dtype=np.int64, count=len(here))[words.indices.to_numpy()]
        first, n = self.ends[slot], self.ends[slot + 1] - self.ends[slot]
        end = np.cumsum(n)
        ids = self.pool[np.repeat(first - (end - n), n) + np.arange(end[-1])]
        out = np.split(ids, np.concatenate(([0], end))[np.cumsum(pc.list_value_length(split).to_numpy())][:-1])
        for k in np.flatnonzero(whole).tolist():
            out[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, dtype=self.kind)
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; where there is too little to train on, the samples themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def dictionary_hash(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()[:16]


class Reader:
    """Random access to one file: `ids(k)` reads only the k-th document's bytes."""

    def __init__(self, uri: str, dictionary: bytes):
        import zstandard

        system, path = open_fs(uri)
        self.file = system.open_input_file(path)
        magic, version, self.width, mark = struct.unpack(HEAD, self.file.read_at(struct.calcsize(HEAD), 0))
        if magic != MAGIC or version != 2 or mark != dictionary_hash(dictionary):
            raise ValueError(f"{uri}: not a token file of this dictionary")
        size, tail = self.file.size(), struct.calcsize(TAIL)
        length, self.n, end = struct.unpack(TAIL, self.file.read_at(tail, size - tail))
        if end != MAGIC[::-1]:
            raise ValueError(f"{uri}: cut off")
        index = zstandard.ZstdDecompressor().decompress(self.file.read_at(length, size - tail - length))
        self.known, self.doc_ids, self.offsets, self.sizes, self.counts = np.frombuffer(index, dtype="<i8").reshape(5, self.n)
        self.zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def ids(self, k: int) -> np.ndarray:
        raw = self.zstd.decompress(self.file.read_at(int(self.sizes[k]), int(self.offsets[k])), max_output_size=max(1, int(self.counts[k]) * self.width))
        return np.frombuffer(raw, dtype=f"<u{self.width}")

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, out_uri: str, path: str | None = None, end_id: int = 2, files: int | None = None, dictionary_bytes: int = 64 << 10, train_rows: int = 400, train_chars: int = 8000, level: int = 1) -> list[dict]:
    """Writes the files, `dictionary.zstd` and `manifest.json` into `out_uri`; returns the manifest: file, start, n_docs, n_tokens by ascending doc_id.

    The dictionary is trained on the first `train_chars` characters of `train_rows` rows at most; it tells how small the
    files are, not what they hold. Cut points are quantiles of doc_id, one a file; there are as many files as
    FILE_BYTES asks for, and shuffle partitions at least.
    """
    import pyarrow as pa
    import zstandard

    spark, path = docs.sparkSession, path or tokenizer_path("word_bpe_49k.json")
    docs = texts_of(docs)
    if not files:
        files = max(parts(spark), -(-(docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 128)).first()[0] or 0) // FILE_BYTES))
    chosen = [r.doc_id for r in docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).collect() if r.doc_id is not None]
    texts = docs.where(F.col("doc_id").isin(chosen)).groupBy("doc_id").agg(F.min(F.substring("text", 1, train_chars)).alias("text")).orderBy("doc_id").collect() if chosen else []
    e = encoder(path)
    raw = train_dictionary([x.tobytes() for x in e.encode([r.text or "" for r in texts]) if len(x)], dictionary_bytes)
    cuts = (docs.select(F.percentile_approx("doc_id", [k / files for k in range(1, files)], max(10_000, 10 * files))).first() or [None])[0] if files > 1 else []
    cuts = np.sort(np.array(cuts or [], dtype=np.int64))
    system, folder = open_fs(out_uri)
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(f"{folder}/dictionary.zstd") as f:
        f.write(raw)

    def compress(it):
        import pyarrow.compute as pc

        e = encoder(path)
        z = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_content_size=True)
        last = array(e.kind, [end_id]).tobytes()
        for b in it:
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = b.column(0).fill_null(0).to_numpy()
            # a cut that stands more than once: so many files are its doc_id's
            part = np.where(known, np.searchsorted(cuts, ids, side="left"), 0)
            same = np.where(known, np.searchsorted(cuts, ids, side="right"), 0) - part
            column, at = b.column(1), 0
            upto = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False))
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 6_000_000)))
                got = [x.tobytes() + last for x in e.encode(column.slice(at, to - at))]
                where = part[at:to]
                for k in np.flatnonzero(same[at:to] > 1).tolist():
                    where[k] += zlib.crc32(got[k]) % int(same[at + k])
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), b.column(0).slice(at, to - at), pa.array([len(x) // e.width for x in got], pa.int64()), pa.array([z.compress(x) for x in got], pa.binary())], names=["part", "doc_id", "n", "blob"])
                at = to

    def save(it):
        system, folder = open_fs(out_uri)
        z, now, out, done = zstandard.ZstdCompressor(level=3), None, None, []

        def close():
            index = z.compress(b"".join(np.array(c, dtype="<i8").tobytes() for c in columns))
            out.write(index + struct.pack(TAIL, len(index), len(columns[0]), MAGIC[::-1]))
            out.close()
            system.move(temporary, f"{folder}/part-{now:05d}.tok")
            done.append((now, len(columns[0]), sum(columns[4])))

        for b in it:
            for part, doc_id, n, blob in zip(*(b.column(k).to_pylist() for k in range(4))):
                if part != now:
                    if out:
                        close()
                    now, columns, at = part, [array("q") for _ in range(5)], struct.calcsize(HEAD)
                    temporary = f"{folder}/.{part:05d}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(temporary)
                    out.write(struct.pack(HEAD, MAGIC, 2, encoder(path).width, dictionary_hash(raw)))
                out.write(blob)
                for c, x in zip(columns, (doc_id is not None, doc_id or 0, at, len(blob), n)):
                    c.append(x)
                at += len(blob)
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.int64()) for k in range(3)], names=["part", "n_docs", "n_tokens"])

    batch_rows(spark)
    dealt = docs.mapInArrow(frugal(compress), "part int, doc_id long, n long, blob binary").repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "blob")
    manifest, start = [], 0
    for r in sorted(dealt.mapInArrow(save, "part long, n_docs long, n_tokens long").collect()):  # a row a file
        manifest.append({"file": f"{out_uri}/part-{r.part:05d}.tok", "start": start, "n_docs": r.n_docs, "n_tokens": r.n_tokens})
        start += r.n_tokens
    with system.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_back(spark: SparkSession, uri: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone; a task reads whole files, some rows at a time."""
    import pyarrow as pa

    system, folder = open_fs(uri)
    manifest = json.loads(system.open_input_stream(f"{folder}/manifest.json").read())
    raw = system.open_input_stream(f"{folder}/dictionary.zstd").read()

    def digest(it):
        for b in it:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = Reader(file, raw)
                starts = start + np.cumsum(r.counts) - r.counts
                for at in range(0, r.n, 4096):
                    to = min(r.n, at + 4096)
                    sums = [zlib.crc32(r.ids(k).astype("<u4").tobytes()) for k in range(at, to)]
                    yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids[at:to], pa.int64(), mask=r.known[at:to] == 0), pa.array(starts[at:to], pa.int64()), pa.array(r.counts[at:to], pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                r.close()

    rows = spark.createDataFrame([(m["file"], m["start"]) for m in manifest], "file string, start long")
    return rows.repartition(max(1, min(len(manifest), parts(spark)))).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, out_uri: str | None = None, **how) -> DataFrame:
    """Writes the files and reads them back."""
    out_uri = out_uri or scratch(docs.sparkSession, "tokens")
    write(docs, out_uri, **how)
    return read_back(docs.sparkSession, out_uri)
