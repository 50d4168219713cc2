"""Token ids in a binary block format, each document's ids compressed by themselves with one shared dictionary.

A block is one byte string; a table of blocks in ascending order of doc_id is the file (Parquet, uncompressed, so that it
can live in any store that Spark writes to). All numbers are little-endian:

    4 s   magic "GLTB"           1 B   version 1       1 B   bytes per id: 2 or 4      2 B   zero
    32 s  SHA-256 of the dictionary (of nothing, if there is none)
    q     documents n            q     ids of the same bucket before this block
    n q   doc ids                n B   1 where the doc id is null
    n q   ids of each document   n+1 q offset index into the frames
    rest  zstandard frames, one per document

The offset index finds one document's frame without touching the others. The dictionary is trained on the serialised ids
of a bounded sample of documents (`SAMPLE` documents by smallest hash, none over `SAMPLE_BYTES`); it only affects sizes. With fewer than
`FEWEST` sampled documents there is none. Null and empty texts have no ids but the end id. Rows with null ids come first;
rows that repeat an id follow each other by their content. Very long texts are one frame like any other.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import arrow
from geoloom.llm.tokens import chunk_encoder, vocabulary_path

SAMPLE, SAMPLE_BYTES, FEWEST, DICTIONARY_BYTES, LEVEL = 1000, 1 << 15, 16, 1 << 16, 3
#: Frame bytes after which a block is closed.
BLOCK_BYTES = 4 << 20
_HEAD = struct.Struct("<4sBBH32sqq")


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary, or nothing if the samples are too few or too alike to train one."""
    samples = [x for x in samples if 8 <= len(x) <= SAMPLE_BYTES]
    if len(samples) < FEWEST:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 4), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


@dataclass
class Block:
    """Reads one block; `ids(i)` decompresses just that document."""

    data: bytes
    dictionary: bytes

    def __post_init__(self) -> None:
        magic, version, self.width, _, digest, n, self.before = _HEAD.unpack_from(self.data)
        if magic != b"GLTB" or version != 1:
            raise ValueError("not a token block")
        if digest != hashlib.sha256(self.dictionary).digest():
            raise ValueError("the block was written with another dictionary")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(self.data, "<i8", n, at)
        self.null_ids = np.frombuffer(self.data, np.uint8, n, at + 8 * n).astype(bool)
        self.counts = np.frombuffer(self.data, "<i8", n, at + 9 * n)
        self.offsets = np.frombuffer(self.data, "<i8", n + 1, at + 17 * n)
        self.frames = at + 25 * n + 8
        self.reader = zstandard.ZstdDecompressor(dict_data=_dictionary(self.dictionary))

    def ids(self, i: int) -> np.ndarray:
        frame = memoryview(self.data)[self.frames + self.offsets[i] : self.frames + self.offsets[i + 1]]
        return np.frombuffer(self.reader.decompress(frame), f"<u{self.width}")

    def find(self, doc_id: int) -> np.ndarray | None:
        hit = np.flatnonzero((self.doc_ids == doc_id) & ~self.null_ids)
        return self.ids(int(hit[0])) if len(hit) else None


def pack_block(width: int, dictionary: bytes, before: int, rows: list[tuple[int | None, int, bytes]]) -> bytes:
    """rows: (doc id, number of ids, frame)."""
    n = len(rows)
    offsets = np.concatenate([[0], np.cumsum([len(x[2]) for x in rows])]).astype("<i8")
    parts = [_HEAD.pack(b"GLTB", 1, width, 0, hashlib.sha256(dictionary).digest(), n, before), np.array([x[0] or 0 for x in rows], "<i8").tobytes(), np.array([x[0] is None for x in rows], np.uint8).tobytes(), np.array([x[1] for x in rows], "<i8").tobytes(), offsets.tobytes()]
    return b"".join(parts + [x[2] for x in rows])


def _edges(docs: DataFrame, parts: int) -> list[float]:
    """Doc ids that cut the table into about equal runs; only ids are read."""
    if parts < 2:
        return []
    return sorted(set(docs.where("doc_id is not null").approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts)))


def _sample_ids(docs: DataFrame, path: str, end_id: int) -> list[bytes]:
    chosen = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).distinct()
    rows = docs.join(F.broadcast(chosen), "doc_id", "left_semi").where(F.octet_length("text") < 4 * SAMPLE_BYTES)

    def run(batches):
        coder = chunk_encoder(path)
        for batch in arrow.slices(batches):
            got = [np.append(x, coder.type.type(end_id)).tobytes() for x in coder.encode(arrow.texts(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x if len(x) <= SAMPLE_BYTES else b"" for x in got], pa.binary())], names=["doc_id", "ids"])

    return [bytes(x.ids) for x in rows.mapInArrow(run, "doc_id long, ids binary").orderBy("doc_id", "ids").limit(SAMPLE).collect()]


def write_tokens(df: DataFrame, target: str, path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """Encode, compress and write the blocks to `target`; gives the dictionary, which is also kept beside them."""
    path, spark, docs = path or vocabulary_path(), df.sparkSession, arrow.documents(df, id_col, text_col)
    parts = arrow.partitions(spark)
    edges = np.array(_edges(docs, parts))
    dictionary = train_dictionary(_sample_ids(docs, path, end_id))
    schema = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("frame", pa.binary())])

    def encode(batches):
        coder = chunk_encoder(path)
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_checksum=False)
        end = np.array([end_id], coder.type).tobytes()
        for batch in arrow.slices(batches):
            raw = [x.tobytes() + end for x in coder.encode(arrow.texts(batch))]
            ids = batch.column(0).to_pylist()
            yield arrow.table(schema, bucket=[0 if i is None else int(np.searchsorted(edges, i)) for i in ids], doc_id=batch.column(0), n=[len(x) // coder.type.itemsize for x in raw], frame=[writer.compress(x) for x in raw])

    def pack(batches):
        out = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])
        width = chunk_encoder(path).type.itemsize
        bucket, block, before, rows, size = None, 0, 0, [], 0

        def close():
            known = [x[0] for x in rows if x[0] is not None]
            return arrow.table(out, bucket=[bucket], block=[block], first_doc=[known[0] if known else None], last_doc=[known[-1] if known else None], n_docs=[len(rows)], n_ids=[sum(x[1] for x in rows)], data=[pack_block(width, dictionary, before, rows)])

        for batch in batches:
            for b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (b != bucket or size >= BLOCK_BYTES):
                    yield close()
                    before, block, rows, size = (before + sum(x[1] for x in rows), block + 1, [], 0) if b == bucket else (0, 0, [], 0)
                bucket = b
                rows.append(tuple(row))
                size += len(row[2])
        if rows:
            yield close()

    frames = docs.mapInArrow(encode, "bucket int, doc_id long, n long, frame binary").repartition(parts, "bucket").sortWithinPartitions("bucket", "doc_id", "n", F.xxhash64("frame"))
    frames.mapInArrow(pack, "bucket int, block int, first_doc long, last_doc long, n_docs long, n_ids long, data binary").write.mode("overwrite").option("compression", "none").parquet(f"{target}/blocks")
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").write.mode("overwrite").parquet(f"{target}/dictionary")
    return dictionary


def read_tokens(spark: SparkSession, source: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids before the document in the whole file), n_tokens, ids_crc32 and, if asked for, ids."""
    arrow.prepare(spark)
    dictionary = bytes(spark.read.parquet(f"{source}/dictionary").first()[0])
    blocks = spark.read.schema("bucket int, block int, first_doc long, last_doc long, n_docs long, n_ids long, data binary").parquet(f"{source}/blocks")
    # One number per bucket, of which there are as many as shuffle partitions.
    totals = sorted((r[0], r[1]) for r in blocks.groupBy("bucket").agg(F.sum("n_ids")).collect())
    base = dict(zip([b for b, _ in totals], np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist(), strict=False))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches):
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(data.as_buffer().to_pybytes(), dictionary)
                start = base[bucket] + block.before + np.concatenate([[0], np.cumsum(block.counts)])[:-1]
                crc, ids = [], []
                for i in range(len(block.counts)):
                    got = block.ids(i).astype("<u4")
                    if len(got) != block.counts[i]:
                        raise ValueError("a frame holds another number of ids than its block says")
                    crc.append(zlib.crc32(got))
                    if with_ids:
                        ids.append(got.astype(np.int32))
                yield arrow.table(schema, doc_id=pa.array(block.doc_ids, mask=block.null_ids), start=start, n_tokens=block.counts, ids_crc32=crc, **({"ids": ids} if with_ids else {}))

    return blocks.select("bucket", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def find_document(spark: SparkSession, source: str, doc_id: int) -> list[int] | None:
    """One document's ids: the block is found by its range of ids, the frame by the block's index."""
    dictionary = bytes(spark.read.parquet(f"{source}/dictionary").first()[0])
    for row in spark.read.parquet(f"{source}/blocks").where(F.col("first_doc") <= doc_id).where(F.col("last_doc") >= doc_id).select("data").toLocalIterator():
        ids = Block(bytes(row[0]), dictionary).find(doc_id)
        if ids is not None:
            return ids.tolist()
    return None


def token_file_digest(df: DataFrame, path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a token file to the shared folder and describe each document as read back from it."""
    stash = arrow.Stash(df.sparkSession, "tokens")
    write_tokens(df, f"{stash.root}/file", path, end_id, id_col, text_col)
    return read_tokens(df.sparkSession, f"{stash.root}/file")
