"""Bags: messages of topics with a time and a JSON payload, in one file; and the same as a table.

A table partitioned by topic is the native form; the file form is read and written for exchange.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThanOrEqual, WriterCommitMessage

from tessera.errors import BagError, SensorError
from tessera.shared import file_system

# Signature, version and footer of the format.
# A record: u32 bytes after this field, u16 length of the topic, topic, f64 time, JSON.
MAGIC, VERSION, FOOTER = b"\x89SBAG\r\n\x1a\n", 1, b"SEND"


def messages(data: bytes):
    """(offset, topic, timestamp, payload text); a cut-off last record is tolerated, the version is not enforced."""
    if data[: len(MAGIC)] != MAGIC:
        raise BagError("no bag")
    at = len(MAGIC) + 1
    while at + 6 <= len(data) and data[at : at + 4] != FOOTER:
        size, n = struct.unpack_from("<IH", data, at)
        end = at + 4 + size
        if end > len(data):
            return
        (t,) = struct.unpack_from("<d", data, at + 6 + n)
        yield at, data[at + 6 : at + 6 + n].decode(), t, data[at + 14 + n : end].decode()
        at = end


def record(topic: str, timestamp: float, payload: bytes) -> bytes:
    name = topic.encode()
    return struct.pack("<IH", 10 + len(name) + len(payload), len(name)) + name + struct.pack("<d", float(timestamp)) + payload


class Writer:
    def __init__(self, path: str):
        self.file = open(path, "wb")
        self.file.write(MAGIC + bytes([VERSION]))

    def write(self, topic: str, timestamp: float, payload: dict) -> None:
        if self.file is None:
            raise BagError("the bag is closed")
        if not topic or not isinstance(payload, dict):
            raise SensorError("a message has a topic and a dictionary")
        self.file.write(record(topic, timestamp, json.dumps(payload, default=lambda v: v.tolist()).encode()))

    def close(self) -> None:
        if self.file is not None:
            self.file.write(FOOTER)
            self.file.close()
            self.file = None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


COLUMNS = "path string, offset long, topic string, timestamp double, data string"
INDEX = "path string, start long, end long, first long, next long"
#: Bytes of a range that one task reads.
SPLIT = 64 << 20
#: Bytes read at a time.
BLOCK = 4 << 20
#: Records in a row that must look like records before a place counts as the beginning of one.
LIKELY = 16
#: Rows of a batch that is handed to Spark.
ROWS = 4096
NOWHERE = 1 << 62


class _Window:
    """Bytes of a file by place, read in blocks; what lies between two places that are asked for is skipped."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes from there; fewer only at the end of the file."""
        i = at - self.at
        if i < 0 or i + n > len(self.data):
            have = self.data[i:] if 0 <= i < len(self.data) else b""
            self.file.seek(at + len(have))
            self.at, self.data, i = at, have + self.file.read(max(n - len(have), min(BLOCK, self.size - at - len(have)))), 0
        return self.data[i : i + n]


def _stop(window: _Window, at: int) -> int | None:
    """Where the record at a place ends; None if there is none: the footer, the end, or a record that was cut off."""
    head = window.get(at, 6)
    if len(head) < 6 or head[:4] == FOOTER:
        return None
    stop = at + 4 + int.from_bytes(head[:4], "little")
    return stop if stop <= window.size else None


def _likely(window: _Window, at: int) -> bool:
    """If the next records look like messages: sizes that fit, a readable topic, a finite time, a JSON object."""
    for step in range(LIKELY):
        if at == window.size or window.get(at, 4) == FOOTER and at + 4 == window.size:
            return step > 0
        head = window.get(at, 6)
        if len(head) < 6:
            return step > 0
        size, n = struct.unpack("<IH", head)
        if n < 1 or size < n + 12:
            return False
        stop = at + 4 + size
        body = window.get(at + 6, n + 9)
        try:
            fine = body[:n].decode().isprintable()
        except UnicodeDecodeError:
            return False
        if not fine or len(body) < n + 9 or not math.isfinite(struct.unpack_from("<d", body, n)[0]) or body[n + 8] != 0x7B:
            return False
        if stop > window.size:
            return step > 0
        if window.get(stop - 1, 1) != b"}":
            return False
        at = stop
    return True


def _first_likely(window: _Window, start: int, end: int) -> int | None:
    """The first place in [start, end) from which on there seem to be records. Places are sifted many at a time."""
    at = start
    while at < end:
        raw = np.frombuffer(window.get(at, min(1 << 20, end - at) + 65_600), np.uint8)
        m = min(1 << 20, end - at, len(raw) - 15)
        if m <= 0:
            return None
        b = raw.astype(np.int64)
        size = b[:m] | b[1 : m + 1] << 8 | b[2 : m + 2] << 16 | b[3 : m + 3] << 24
        n = b[4 : m + 4] | b[5 : m + 5] << 8
        place = np.arange(m)
        brace = np.minimum(place + 14 + n, len(raw) - 1)
        for i in np.flatnonzero((n > 0) & (size >= n + 12) & (at + place + 4 + size <= window.size) & (raw[brace] == 0x7B)).tolist():
            if _likely(window, at + i):
                return at + i
        at += m
    return None


@dataclass
class Range(InputPartition):
    """Bytes [start, end) of a file of that size: the records that begin there. first is where the first of them begins, -1 for none, None if that is to be found."""

    path: str
    size: int
    start: int
    end: int
    first: int | None


class BagReader(DataSourceReader):
    """Reads ranges of bag files. Topics and times are tested on a record's head, before its payload is touched.

    What is tested comes from options alone. Spark keeps one reader for all plans over a frame, so a filter of one of them must not narrow the others: of the filters that
    Spark offers, those that the options hold anyway are taken, and all others are left to Spark.
    """

    def __init__(self, options: dict):
        self.index = options.get("index") == "true"
        self.files = json.loads(options["files"])
        self.split = int(options.get("split", SPLIT))
        self.known = {(p, s): f for p, s, f in json.loads(options.get("starts", "[]"))}
        self.topics = set(json.loads(options["topics"])) if "topics" in options else None
        self.above, self.below = float(options.get("above", "-inf")), float(options.get("below", "inf"))

    def pushFilters(self, filters):
        for f in filters:
            column = getattr(f, "attribute", None)
            topic = column == ("topic",) and (isinstance(f, EqualTo) and {f.value} == self.topics or isinstance(f, In) and set(f.value) == self.topics)
            time = column == ("timestamp",) and (isinstance(f, GreaterThanOrEqual) and f.value == self.above or isinstance(f, LessThanOrEqual) and f.value == self.below)
            if not (topic or time or isinstance(f, IsNotNull) and column in (("topic",), ("timestamp",))):
                yield f

    def _wanted(self, t: float) -> bool:
        """As Spark compares: NaN is above every number."""
        return not t < self.above and (t <= self.below or self.below == math.inf)

    def partitions(self):
        """Ranges of all files, from their sizes alone."""
        out = []
        for path, size in self.files:
            for start in range(0, max(size, 1), self.split):
                out.append(Range(path, size, start, min(start + self.split, max(size, 1)), self.known.get((path, start))))
        return out

    def read(self, part: Range):
        system, name = file_system(part.path)
        with system.open_input_file(name) as file:
            window = _Window(file, part.size)
            if part.start == 0 and window.get(0, len(MAGIC)) != MAGIC:
                raise BagError(f"no bag: {part.path}")
            first = len(MAGIC) + 1 if part.start == 0 else part.first
            if first is None:
                first = _first_likely(window, part.start, part.end)
            at = NOWHERE if first is None or first < 0 else first
            if self.index:
                last = self._walk(window, at, part.end)
                found = None if at == NOWHERE else at
                yield pa.RecordBatch.from_pydict({"path": [part.path], "start": [part.start], "end": [part.end], "first": pa.array([found], pa.int64()), "next": pa.array([None if found is None else last], pa.int64())})
            else:
                yield from self._messages(window, part.path, at, part.end)

    def _walk(self, window: _Window, at: int, end: int) -> int:
        """Where the record after the range's last one begins; NOWHERE after the file's last one."""
        while at < end:
            stop = _stop(window, at)
            if stop is None:
                return NOWHERE
            at = stop
        return at

    def _messages(self, window: _Window, path: str, at: int, end: int):
        topics = None if self.topics is None else {t.encode() for t in self.topics}
        offsets, names, times, bodies, held = [], [], [], [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([path] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(times, pa.float64()), pa.array(bodies, pa.binary()).cast(pa.string())], names=["path", "offset", "topic", "timestamp", "data"])

        while at < end:
            stop = _stop(window, at)
            if stop is None:
                break
            n = int.from_bytes(window.get(at + 4, 2), "little")
            head = window.get(at + 6, n + 8)
            name, (t,) = head[:n], struct.unpack_from("<d", head, n)
            if (topics is None or name in topics) and self._wanted(t):
                offsets.append(at)
                names.append(name)
                times.append(t)
                bodies.append(window.get(at + 14 + n, stop - at - 14 - n))
                held += len(bodies[-1])
                if len(offsets) >= ROWS or held > BLOCK:
                    yield batch()
                    offsets, names, times, bodies, held = [], [], [], [], 0
            at = stop
        if offsets:
            yield batch()


@dataclass
class Part(WriterCommitMessage):
    name: str


class BagWriter(DataSourceWriter):
    """One bag a partition, in the order of its rows. Files get their names when all are whole."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, rows):
        from pyspark import TaskContext

        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.sbag"
        with system.open_output_stream(f"{folder}/_{name}") as file:
            file.write(MAGIC + bytes([VERSION]))
            for r in rows:
                payload = json.loads(r.data) if r.data is not None else None
                if not r.topic or r.timestamp is None or not isinstance(payload, dict):
                    raise SensorError("a message has a topic, a time and a dictionary")
                file.write(record(r.topic, r.timestamp, r.data.encode()))
            file.write(FOOTER)
        return Part(name)

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        names = [m.name for m in messages if m is not None]
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(folder)):
                if f.base_name.endswith(".sbag") and f.base_name[0] != "_":
                    system.delete_file(f.path)
        for n in names:
            system.move(f"{folder}/_{n}", f"{folder}/{n}")

    def abort(self, messages) -> None:
        system, folder = file_system(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{folder}/_{m.name}")


class BagSource(DataSource):
    """Format ``bag``. It reads what ``read`` lists, and writes a folder of bags."""

    @classmethod
    def name(cls) -> str:
        return "bag"

    def schema(self) -> str:
        return INDEX if self.options.get("index") == "true" else COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return BagReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return BagWriter(dict(self.options), overwrite)


def _format(spark: SparkSession, **options):
    spark.dataSource.register(BagSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("bag").options(**options)


def read(spark: SparkSession, path: str, topics=None, start: float | None = None, end: float | None = None, split: int = SPLIT) -> DataFrame:
    """path, offset, topic, timestamp, data (JSON text) of a bag, a folder of bags or a pattern of paths; of topics (a name or several) within [start, end], if given.

    Files are read by ranges of ``split`` bytes, so no task holds a file. A range finds where its records begin by what records look like; since that is a guess, a pass over the
    heads of all records (payloads are skipped) checks it first: the chain of records of the ranges before must arrive at the same place. A range that guessed
    wrong is given the right place, and its chain is followed again. Files of one range need no such pass. A last record that was cut off is left out. The files' system is
    one that pyarrow opens (local, HDFS, S3, GCS).
    """
    files = [(r.path, r.length) for r in spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").collect()]
    options, starts = {"files": json.dumps(files), "split": split}, {}
    while any(size > split for _, size in files):
        index = _format(spark, index="true", starts=json.dumps([[p, s, f] for (p, s), f in starts.items()]), **options).load()
        before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        came = F.last("next", ignorenulls=True).over(before)
        right = F.when(F.col("came") < F.col("end"), F.col("came"))
        wrong = index.withColumn("came", came).where("start > 0").where(~right.eqNullSafe(F.col("first"))).select("path", "start", F.coalesce(right, F.lit(-1)).alias("first")).collect()
        if not wrong:
            break
        starts |= {(r.path, r.start): r.first for r in wrong}
    if topics is not None:
        options["topics"] = json.dumps([topics] if isinstance(topics, str) else list(topics))
    options |= {k: repr(float(v)) for k, v in (("above", start), ("below", end)) if v is not None}
    whole = _format(spark, starts=json.dumps([[p, s, f] for (p, s), f in starts.items()]), **options).load()
    return read_messages(whole, topics, start, end)


def read_messages(bag: DataFrame, topics=None, start=None, end=None) -> DataFrame:
    """Messages of topics (a name or several) within [start, end]; order by offset for the file's own order."""
    if topics is not None:
        bag = bag.where(F.col("topic").isin([topics] if isinstance(topics, str) else list(topics)))
    if start is not None:
        bag = bag.where(F.col("timestamp") >= start)
    return bag if end is None else bag.where(F.col("timestamp") <= end)


def topic_counts(bag: DataFrame) -> DataFrame:
    return bag.groupBy("topic").agg(F.count("*").alias("messages"))


def write_parts(bag: DataFrame, path: str, mode: str = "append", parts: int | None = None) -> None:
    """A folder of bags, one a partition; in order of their names and offsets the messages are in order of file and offset."""
    bag.sparkSession.dataSource.register(BagSource)
    place = [c for c in ("path", "offset") if c in bag.columns]
    rows = bag.repartitionByRange(*[parts] * bool(parts), *place).sortWithinPartitions(*place) if place else bag
    rows.select("topic", F.col("timestamp").cast("double").alias("timestamp"), "data").write.format("bag").option("path", path).mode(mode).save()


def write(bag: DataFrame, path: str) -> None:
    """One file. Parts are written side by side and their records joined, as bytes."""
    folder = f"{path}.parts"
    write_parts(bag, folder, "overwrite")
    system, name = file_system(path)
    from pyarrow import fs

    _, parts = file_system(folder)
    with system.open_output_stream(name) as out:
        out.write(MAGIC + bytes([VERSION]))
        for f in sorted(system.get_file_info(fs.FileSelector(parts)), key=lambda f: f.base_name):
            if f.base_name[0] in "_.":
                continue
            with system.open_input_file(f.path) as file:
                left = f.size - len(MAGIC) - 1 - len(FOOTER)
                file.seek(len(MAGIC) + 1)
                while left:
                    piece = file.read(min(left, BLOCK))
                    out.write(piece)
                    left -= len(piece)
        out.write(FOOTER)
    system.delete_dir(parts)


def to_mcap(bag: DataFrame, path: str) -> None:
    """Transcodes to MCAP; needs the optional mcap package."""
    try:
        from mcap.writer import Writer as Mcap
    except ImportError as e:
        raise BagError("the mcap package is not installed") from e
    with open(path, "wb") as f:
        w = Mcap(f)
        w.start()
        schema = w.register_schema(name="json", encoding="jsonschema", data=b"{}")
        channels: dict = {}
        for r in bag.orderBy("offset").toLocalIterator():
            if r.topic not in channels:
                channels[r.topic] = w.register_channel(topic=r.topic, message_encoding="json", schema_id=schema)
            ns = int(r.timestamp * 1e9)
            w.add_message(channel_id=channels[r.topic], log_time=ns, publish_time=ns, data=r.data.encode())
        w.finish()
