"""Files of token ids: documents in ascending order of doc_id, coded in checked blocks.

A file image holds a head, an index of its documents (doc_id, number of ids) with a CRC-32, and the
blocks of ``rangecoder``. The images are rows of a Parquet table in the shared folder, written by
Spark's committed writer; (part, file) is their order. No document spans two files,
so every file is read alone.

Defined results: a null text is empty and holds the end id alone; rows that share a
doc_id stay apart, in order of their text; rows without a doc_id come first; an empty table gives no file and no row.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.ranges import shuffle_parts
from vectide.llm.rangecoder import BLOCK, LANES, block_size, decode_blocks, encode_blocks
from vectide.llm.scratch import materialize, ship
from vectide.llm.textvec import runs, strings
from vectide.llm.tokens import Encoder, vocabulary

END = 2
_HEAD = struct.Struct("<4sIII")  # magic, documents, crc32 of the index, blocks
_MAGIC = b"vtf1"
_NONE = -(1 << 63)
FILE_SCHEMA = "part long, file long, n_tokens long, image binary"


def write_image(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, size: int) -> bytes:
    index = np.array([_NONE if d is None else d for d in doc_ids], "<i8").tobytes() + np.array(sizes, "<i8").tobytes()
    blocks = encode_blocks(ids, size)
    return b"".join([_HEAD.pack(_MAGIC, len(doc_ids), zlib.crc32(index), len(blocks)), index, *blocks])


def read_image(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, bounds of each document's ids, and the ids."""
    if len(image) < _HEAD.size or image[:4] != _MAGIC:
        raise ValueError("not a file of ids")
    _, n, crc, count = _HEAD.unpack_from(image)
    at = _HEAD.size + 16 * n
    index = image[_HEAD.size : at]
    if len(index) != 16 * n or zlib.crc32(index) != crc:
        raise ValueError("the index's checksum differs")
    blocks = []
    for _ in range(count):
        end = at + block_size(image, at)
        blocks.append(image[at:end])
        at = end
    ids = decode_blocks(blocks)
    doc_ids = [None if d == _NONE else d for d in np.frombuffer(index, "<i8", n).tolist()]
    bounds = np.concatenate(([0], np.cumsum(np.frombuffer(index, "<i8", n, 8 * n))))
    if bounds[-1] != len(ids):
        raise ValueError("the index and the blocks differ")
    return doc_ids, bounds, ids


def _write(path: str, end: int):
    def run(batches):
        encoder, part, number = Encoder.open(path), TaskContext.get().partitionId(), 0
        size = max(encoder.library.get_vocab_size(), end + 1)
        kind = np.uint16 if size <= 1 << 16 else np.uint32
        doc_ids: list = []
        sizes: list[int] = []
        ids: list[np.ndarray] = []
        held = 0

        def close():
            nonlocal doc_ids, sizes, ids, held, number
            image = write_image(doc_ids, sizes, np.concatenate(ids), size)
            row = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([held]), pa.array([image], pa.binary())], names=["part", "file", "n_tokens", "image"])
            doc_ids, sizes, ids, held, number = [], [], [], 0, number + 1
            return row

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            raw, bounds = strings(batch.column("text"))
            for i, j in runs(bounds):
                flat, at = encoder.encode(raw, bounds[i : j + 1])
                n = j - i
                ids.append(np.insert(flat.astype(kind, copy=False), at[1:], kind(end)))
                sizes += (np.diff(at) + 1).tolist()
                doc_ids += names[i:j]
                held += len(flat) + n
                if held >= BLOCK * LANES:
                    yield close()
        if doc_ids:
            yield close()

    return run


def write(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end: int = END) -> DataFrame:
    """The table of file images (part, file, n_tokens, image), written once."""
    spark = ship(docs.sparkSession)
    # A step of the coder costs much the same whatever its lanes, so two parts' blocks are coded side by side.
    parts = max(min(shuffle_parts(spark), spark.sparkContext.defaultParallelism), shuffle_parts(spark) // 2)
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(rows.mapInArrow(_write(vocabulary(tokenizer), end), FILE_SCHEMA), "ids")


READ_SCHEMA = "part long, file long, doc_id long, local long, n_tokens long, ids binary"


def _read(batches):
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    for batch in batches:
        for k in range(batch.num_rows):
            part, file, image = (batch.column(c)[k].as_py() for c in ("part", "file", "image"))
            doc_ids, bounds, ids = read_image(image)
            raw = ids.astype("<u4", copy=False).tobytes()
            del ids
            for i in range(0, len(doc_ids), 2000):
                own = bounds[i : i + 2001]
                body = [raw[4 * a : 4 * b] for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
                n = len(body)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n), pa.array([file] * n), pa.array(doc_ids[i : i + n], pa.int64()), pa.array(own[:-1]), pa.array(np.diff(own)), pa.array(body, pa.binary())], names=names)


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the files; ids: little-endian 32-bit."""
    spark = ship(files.sparkSession)
    base, bases = 0, []
    for r in files.select("part", "file", "n_tokens").orderBy("part", "file").collect():  # a row for each file
        bases.append((r.part, r.file, base))
        base += r.n_tokens
    rows = files.select("part", "file", "image").mapInArrow(_read, READ_SCHEMA)
    at = spark.createDataFrame(bases, "part long, file long, base long")
    return rows.join(F.broadcast(at), ["part", "file"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids")


def query(docs: DataFrame) -> DataFrame:
    rows = read(write(docs))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
