"""Token ids in a binary format: static range asymmetric numeral systems.

A segment holds the ids of consecutive documents under one shared, static frequency table. Its
ids are cut into blocks of BLOCK, each coded on its own by LANES interleaved states; the words that the
states shed go to one stream a block. Every CHECK steps a checkpoint keeps the states and
the place in the stream, so a decoder can start at any of them; all units between checkpoints
are decoded side by side. A checksum guards each block and the header.

Layout, little-endian::

    "TRNS2\\0\\0\\0"  u32 header bytes, u32 crc32 of the header; header (zlib): JSON with the counts and the lengths of
    the parts; then parts: doc ids i64 and null flags u8, document lengths u32, symbols u32, frequencies u32,
    states u64 [blocks, checkpoints, LANES], places u32 [blocks, checkpoints], block crc32 u32, stream lengths u32, streams u32
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.common import batch_from, executor_file, text_column
from tessera.llm.segments import ByteLevel, once

MAGIC = b"TRNS2\0\0\0"
LANES, CHECK = 32, 128
BLOCK = LANES * CHECK * 4
SCALE = 18
LOW = np.uint64(1 << 31)
SEGMENT_IDS = 1 << 21
MANIFEST_ROWS = 1_000_000
#: Bytes of text for a task.
PART_BYTES = 64_000_000


class CorruptSegment(ValueError):
    pass


def scaled_frequencies(counts: np.ndarray) -> np.ndarray:
    """Positive integers that sum to 2**SCALE, in proportion to the counts as nearly as that allows."""
    total = counts.sum()
    f = np.maximum(1, np.floor(counts * ((1 << SCALE) / total)).astype(np.int64))
    gap = (1 << SCALE) - int(f.sum())
    order = np.argsort(-counts, kind="stable")
    while gap:
        if gap > 0:
            share = order[: min(gap, len(order))]
            f[share] += 1
            gap -= len(share)
        else:
            can = order[f[order] > 1]
            share = can[: min(-gap, len(can))]
            f[share] -= 1
            gap += len(share)
    return f


def encode_ids(ids: np.ndarray, lengths: np.ndarray, doc_ids: list) -> bytes:
    """A segment of the given documents: ids are those of all documents one after another."""
    n = len(ids)
    counts = np.bincount(ids, minlength=1)
    symbols = np.flatnonzero(counts)
    slot, counts = np.cumsum(counts > 0) - 1, counts[symbols]
    sym = slot[ids]
    blocks = -(-n // BLOCK)
    steps, points = BLOCK // LANES, BLOCK // LANES // CHECK
    if n:
        f = scaled_frequencies(counts).astype(np.uint64)
        cum = np.concatenate(([0], np.cumsum(f)[:-1])).astype(np.uint64)
        padded = np.full(blocks * BLOCK, int(counts.argmax()), np.int64)
        padded[:n] = sym
        grid = padded.reshape(blocks, steps, LANES)
        x = np.full((blocks, LANES), LOW, np.uint64)
        states = np.zeros((blocks, points, LANES), np.uint64)
        shed = np.zeros((steps, blocks), np.int64)
        words: list = [None] * steps
        top = f << np.uint64(63 - SCALE)  # a state from here on sheds a word first: (LOW >> SCALE << 32) * f
        for t in range(steps - 1, -1, -1):
            s = grid[:, t]
            full = x >= top[s]
            words[t] = (x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            shed[t] = full.sum(axis=1)
            x[full] >>= np.uint64(32)
            fs = f[s]
            q = x // fs
            x = (q << np.uint64(SCALE)) + (x - q * fs) + cum[s]
            if t % CHECK == 0:
                states[:, t // CHECK] = x
        flat = np.concatenate(words)
        block_of = np.repeat(np.tile(np.arange(blocks), steps), shed.ravel())
        stream = flat[np.argsort(block_of, kind="stable")]
        place = np.concatenate((np.zeros((1, blocks), np.int64), np.cumsum(shed, axis=0)))[:steps:CHECK].T
        per_block = shed.sum(axis=0)
        ids32 = ids.astype("<u4")
        crcs = np.array([zlib.crc32(ids32[b * BLOCK : (b + 1) * BLOCK].tobytes()) for b in range(blocks)], "<u4")
    else:
        f, states, place, crcs, per_block, stream = np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0)
    parts = [
        np.array([0 if d is None else d for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"), np.asarray(lengths).astype("<u4"), symbols.astype("<u4"), f.astype("<u4"),
        states.astype("<u8"), place.astype("<u4"), crcs.astype("<u4"), per_block.astype("<u4"), stream.astype("<u4"),
    ]
    raw = [zlib.compress(p.tobytes(), 1) if i < 5 else p.tobytes() for i, p in enumerate(parts)]
    head = zlib.compress(json.dumps({"ids": n, "docs": len(doc_ids), "blocks": blocks, "lanes": LANES, "check": CHECK, "block": BLOCK, "scale": SCALE, "parts": [len(r) for r in raw]}).encode(), 1)
    return MAGIC + struct.pack("<II", len(head), zlib.crc32(head)) + head + b"".join(raw)


def read_header(data: bytes) -> tuple[dict, list[memoryview]]:
    if data[:8] != MAGIC:
        raise CorruptSegment("no segment")
    size, crc = struct.unpack_from("<II", data, 8)
    head = data[16 : 16 + size]
    if zlib.crc32(head) != crc:
        raise CorruptSegment("header checksum")
    info = json.loads(zlib.decompress(head))
    parts, at = [], 16 + size
    for n in info["parts"]:
        parts.append(memoryview(data)[at : at + n])
        at += n
    return info, parts


def decode_ids(data: bytes, blocks: slice | None = None) -> tuple[np.ndarray, np.ndarray, list]:
    """ids, document lengths and document ids of a segment; with blocks, the ids of those blocks only."""
    info, parts = read_header(data)
    doc, null, lengths, symbols, f = (np.frombuffer(zlib.decompress(p), t) for p, t in zip(parts[:5], ("<i8", "u1", "<u4", "<u4", "<u4"), strict=True))
    doc_ids = [None if z else int(d) for d, z in zip(doc, null, strict=True)]
    n, count, lanes, check, scale = info["ids"], info["blocks"], info["lanes"], info["check"], info["scale"]
    if not n:
        return np.zeros(0, np.uint32), lengths, doc_ids
    points = info["block"] // lanes // check
    states = np.frombuffer(parts[5], "<u8").reshape(count, points, lanes)
    place = np.frombuffer(parts[6], "<u4").astype(np.int64).reshape(count, points)
    crcs, per_block, stream = (np.frombuffer(p, "<u4") for p in parts[7:10])
    base = np.concatenate(([0], np.cumsum(per_block.astype(np.int64))[:-1]))
    which = np.arange(count)[blocks or slice(None)]
    x = states[which].reshape(-1, lanes).astype(np.uint64)
    at = (place[which] + base[which, None]).ravel()
    slot = np.repeat(np.arange(len(f)), f)
    f64, cum = f.astype(np.uint64), np.concatenate(([0], np.cumsum(f.astype(np.uint64))[:-1])).astype(np.uint64)
    out = np.empty((len(x), check, lanes), np.uint32)
    mask, stream = np.uint64((1 << scale) - 1), np.concatenate((stream, np.zeros(lanes, np.uint32))).astype(np.uint64)
    for t in range(check):
        low = x & mask
        s = slot[low.astype(np.int64)]
        out[:, t] = symbols[s]
        x = f64[s] * (x >> np.uint64(scale)) + low - cum[s]
        dry = x < LOW
        rank = np.cumsum(dry, axis=1)
        i = np.minimum((at[:, None] + rank - 1)[dry], len(stream) - 1)
        x[dry] = (x[dry] << np.uint64(32)) | stream[i]
        at = at + rank[:, -1]
    ids = out.reshape(-1).astype("<u4")
    size = info["block"]
    ends = [min(n, (b + 1) * size) - b * size for b in which]
    for k, b in enumerate(which):
        if zlib.crc32(ids[k * size : k * size + ends[k]].tobytes()) != crcs[b]:
            raise CorruptSegment(f"block {b} checksum")
    return ids[: (len(which) - 1) * size + ends[-1]] if len(which) else ids[:0], lengths, doc_ids


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2) -> None:
    """Encodes every whole text and writes segments to path in ascending doc_id order (null ids first).

    Null and empty texts give the end id alone; an empty table gives no segment. Repeated rows are documents of their own, and rows
    of one id follow each other in the order of their texts. A very long text is one document of one segment. Only doc_id
    and text are read, so other columns may have any names. Each output row is one segment: part, seg, n_ids, n_docs, data.
    Spark's committer publishes the rows of finished tasks only, so a lost executor leaves no half segment.
    """
    executor_file(vocabulary)
    schema = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("data", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        tok, part, seg = once(ByteLevel, vocabulary), TaskContext.get().partitionId(), 0
        held, lengths, names, size = [], [], [], 0

        def flush():
            data = encode_ids(np.concatenate(held), np.concatenate(lengths), names)
            return batch_from({"part": [part], "seg": [seg], "n_ids": [size], "n_docs": [len(names)], "data": [data]}, schema)

        for b in batches:
            for row, data, off in K.chunks(b.column(1)):
                ids, count = tok.encode_chunk(data, off)
                ends = np.cumsum(count)
                held.append(np.insert(ids, ends, ids.dtype.type(end_id)))
                lengths.append(count + 1)
                names += b.column(0)[row : row + len(count)].to_pylist()
                size += len(held[-1])
                if size >= SEGMENT_IDS:
                    yield flush()
                    held, lengths, names, size, seg = [], [], [], 0, seg + 1
        if names:
            yield flush()

    spark = docs.sparkSession
    text = text_column(docs)
    size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size) // PART_BYTES + 1)
    # rows that share an id, or have none, are split by how their texts begin, which agrees with the order of the texts
    begin = F.substring("text", 1, 24).asc_nulls_first()
    ordered = text.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), begin).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    ordered.mapInArrow(run, "part int, seg int, n_ids long, n_docs long, data binary").write.mode("overwrite").parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the segments at path.

    start counts the ids of all documents before; each segment's base comes from the table of
    segment lengths, a row for two million ids. It is broadcast up to MANIFEST_ROWS rows and joined by its key beyond.
    """
    segs = spark.read.schema("part int, seg int, n_ids long, n_docs long, data binary").parquet(path)
    w = Window.orderBy("part", "seg").rowsBetween(Window.unboundedPreceding, -1)
    base = segs.select("part", "seg", "n_ids").withColumn("base", F.coalesce(F.sum("n_ids").over(w), F.lit(0))).drop("n_ids")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            for base, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids, lengths, names = decode_ids(data.as_py())
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield batch_from({"doc_id": names, "start": starts + base, "n_tokens": lengths.astype(np.int64), "ids_crc32": crc}, schema)

    if segs.select("seg").limit(MANIFEST_ROWS + 1).count() <= MANIFEST_ROWS:
        base = F.broadcast(base)
    return segs.join(base, ["part", "seg"]).select("base", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
