"""Token ids in a binary format of shuffled planes.

Rows are range-sorted by id; each task encodes its rows in order and packs the
ids. Ids go into blocks of ``BLOCK_IDS``; a block of little-endian unsigned
32-bit ids is transposed into its four byte planes (or 32 bit planes), and
each plane is compressed with zstandard (a plane of zeros is stored empty).
Blocks are gathered in chunks of whole documents. A chunk index holds the
place of every chunk in the id sequence, so any chunk can be read alone.

The container is a Parquet table in the shared folder, one row a chunk, so
Spark's committer handles lost tasks and the files need no local paths:

  part, chunk   place in the sorted order       first, n   ids before it in its part, ids in it
  doc_ids, doc_lens   its documents             block, planes   ids a block, compressed planes

Added tokens of the vocabulary file (``<|endoftext|>``) that stand in a text get
their own ids. Null and empty texts hold the end id alone; a long text only makes its chunk
long; rows with equal ids follow each other in the order of their text hashes;
null ids come first. Other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm.pretok import Interner, intern_pieces, text_groups
from patronage.session import scratch_path

END_ID = 2
BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 19
LEVEL = 3
KNOWN_PIECES = 2_000_000  # pieces remembered by a task before it starts anew

CHUNK_SCHEMA = ("part int, chunk int, first long, n long, doc_ids array<long>, doc_lens array<long>, "
                "block int, planes array<binary>")


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The byte (or bit) planes of one block of ids, each compressed."""
    b = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    planes = np.packbits(np.unpackbits(b, axis=1, bitorder="little").T, axis=1) if bits else b.T
    c = zstandard.ZstdCompressor(level=LEVEL)
    return [c.compress(np.ascontiguousarray(p).tobytes()) if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ``n`` ids of one block."""
    d = zstandard.ZstdDecompressor()
    bits = len(planes) == 32
    width = (n + 7) // 8 if bits else n
    out = np.zeros((len(planes), width), np.uint8)
    for row, p in zip(out, planes):
        if p:
            row[:] = np.frombuffer(d.decompress(p, max_output_size=width), np.uint8)
    if bits:
        out = np.packbits(np.unpackbits(out, axis=1)[:, :n].T, axis=1, bitorder="little").T
    return np.ascontiguousarray(out.T).reshape(-1).view("<u4")


def pack_ids(ids: np.ndarray, block: int, bits: bool) -> list[bytes]:
    return [p for a in range(0, len(ids), block) for p in to_planes(ids[a: a + block], bits)]


def unpack_ids(planes: list[bytes], n: int, block: int) -> np.ndarray:
    blocks = [(a, min(block, n - a)) for a in range(0, n, block)]
    per = len(planes) // max(1, len(blocks))
    parts = [from_planes(planes[k * per: (k + 1) * per], m) for k, (_, m) in enumerate(blocks)]
    return np.concatenate(parts) if parts else np.empty(0, "<u4")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _added(path: str) -> dict[str, int]:
    """The file's added tokens and their ids. They are looked for in the text
    as it is; options that match them otherwise are refused."""
    added = _tokenizer(path).get_added_tokens_decoder()
    for t in added.values():
        if t.normalized or t.single_word or t.lstrip or t.rstrip:
            raise ValueError(f"added token {t.content!r} has options that are not supported")
    return {t.content: i for i, t in added.items() if t.content}


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """Byte -> the printable letter that byte-level vocabularies write for it."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)}


def normalise(text: str) -> str:
    """NFC and per-character lower case (white space is dropped later)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Encoder:
    """Ids of whole texts: each distinct piece goes through the library's BPE
    model once and is remembered by its number. Texts are cut at the file's
    added tokens before they are normalised, as the library does unless its
    switch of the same name, ``encode_special_tokens``, is set."""

    def __init__(self, path: str, encode_special_tokens: bool = True):
        self.model = _tokenizer(path).model
        self.added = {} if encode_special_tokens else _added(path)
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cutter = re.compile(f"({'|'.join(map(re.escape, longest_first))})")
        self._reset()

    def _reset(self):
        self.seen, self.known = Interner(), 0
        self.flat = np.empty(0, np.uint32)
        self.size = np.empty(0, np.int64)

    def _learn(self):
        new = self.seen.order[self.known:]
        if not new:
            return
        letters = _byte_letters()
        ids = [[t.id for t in self.model.tokenize(p.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters))]
               for p in new]
        self.flat = np.concatenate([self.flat, np.array([i for x in ids for i in x], np.uint32)])
        self.size = np.concatenate([self.size, np.fromiter(map(len, ids), np.int64, len(ids))])
        self.known = len(self.seen.order)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        # plain text, token, plain text, ...
        cuts = [self.cutter.split(t) if any(x in t for x in self.added) else [t] for t in texts]
        plain = iter(self._plain([p for c in cuts for p in c[::2]]))
        out = []
        for c in cuts:
            ids = [next(plain)]
            for token in c[1::2]:
                ids += [np.array([self.added[token]], np.uint32), next(plain)]
            out.append(np.concatenate(ids) if len(ids) > 1 else ids[0])
        return out

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        clean = [normalise(t) for t in texts]
        for a, b in text_groups(clean):
            if self.known > KNOWN_PIECES:
                self._reset()
            idx, counts = intern_pieces(clean[a:b], self.seen, attach_space=False)
            self._learn()
            begin = np.cumsum(self.size) - self.size
            lens = self.size[idx]
            stop = np.cumsum(lens)
            ids = self.flat[np.arange(int(lens.sum())) + np.repeat(begin[idx] - (stop - lens), lens)]
            at = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(counts)])]
            out += [ids[at[i]: at[i + 1]] for i in range(b - a)]
        return out


def write_ids(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
              block: int = BLOCK_IDS, chunk: int = CHUNK_IDS, bits: bool = False) -> str:
    """Encode every row's whole text, write chunks and their index under a new
    folder of the shared location, and return that folder."""
    src = (df.select(df[id_col].cast("long").alias("doc_id"), F.xxhash64(df[text_col]).alias("_t"),
                     df[text_col].cast("string").alias("_text"))
             .repartitionByRange("doc_id", "_t").sortWithinPartitions("doc_id", "_t").drop("_t"))
    names = ["part", "chunk", "first", "n", "doc_ids", "doc_lens", "block", "planes"]

    def run(batches):
        part = TaskContext.get().partitionId()
        enc = Encoder(path, encode_special_tokens=False)
        first = number = held = 0
        doc_ids: list = []
        ids: list[np.ndarray] = []
        end = np.array([end_id], np.uint32)

        def close():
            nonlocal first, number, held, doc_ids, ids
            lens = [len(i) for i in ids]
            flat = np.concatenate(ids)
            row = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()),
                pa.array([len(flat)], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())),
                pa.array([lens], pa.list_(pa.int64())), pa.array([block], pa.int32()),
                pa.array([pack_ids(flat, block, bits)], pa.list_(pa.binary()))], names)
            first, number, held, doc_ids, ids = first + len(flat), number + 1, 0, [], []
            return row

        for b in batches:
            for a in range(0, b.num_rows, 512):
                sub = b.slice(a, 512)
                for d, i in zip(sub.column("doc_id").to_pylist(),
                                enc.encode([t or "" for t in sub.column("_text").to_pylist()])):
                    doc_ids.append(d)
                    ids.append(np.concatenate([i, end]))
                    held += len(i) + 1
                    if held >= chunk:
                        yield close()
        if doc_ids:
            yield close()

    folder = scratch_path(df.sparkSession, f"ids-{uuid.uuid4().hex}")
    src.mapInArrow(run, CHUNK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{folder}/chunks")
    chunks = df.sparkSession.read.schema(CHUNK_SCHEMA).parquet(f"{folder}/chunks")
    # one row a written part: as many as the write had tasks
    totals = chunks.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    base, rows = 0, []
    for r in totals:
        rows.append((r["part"], base))
        base += r["n"]
    bases = df.sparkSession.createDataFrame(rows, "part int, base long")
    (chunks.select("part", "chunk", "n", (F.col("first")).alias("first"), F.size("doc_ids").alias("n_docs"),
                   F.expr("aggregate(planes, 0L, (s, p) -> s + octet_length(p))").alias("n_bytes"))
           .join(F.broadcast(bases), "part")
           .select("part", "chunk", (F.col("base") + F.col("first")).alias("start"), "n", "n_docs", "n_bytes")
           .write.parquet(f"{folder}/index"))
    return folder


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """The documents of a written folder: doc_id, start, n_tokens, ids_crc32
    and, if asked for, ids (array<long>). Each chunk is decoded alone."""
    index = spark.read.parquet(f"{folder}/index").select("part", "chunk", "start")
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{folder}/chunks")
    # the index has one small row a chunk of CHUNK_IDS or more ids; Spark picks the join
    src = chunks.join(index, ["part", "chunk"]).select("start", "n", "doc_ids", "doc_lens", "block", "planes")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                start, n, doc_ids, lens, block, planes = (b.column(c)[r].as_py() for c in range(6))
                ids = unpack_ids(planes, n, block)
                lens = np.array(lens, np.int64)
                at = np.concatenate([[0], np.cumsum(lens)])
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * x: 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(start + at[:-1]), pa.array(lens),
                        pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32",
                                                        "ids"][: len(cols)])

    return src.mapInArrow(run, schema)
