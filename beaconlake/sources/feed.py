"""The live feed: line-based TCP services, and text files that one was landed in."""

from __future__ import annotations

import json
import socket
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bits of a seq that number the lines of one feed in one batch, and those that number the feeds.
LINES, FEEDS = 24, 6


class FeedSource(DataSource):
    """``spark.readStream.format("beacon_feed")`` with options feeds (host:port, several separated by commas), user, filter,
    spool, wait (seconds that a batch listens), silence (seconds without a line after which the connection is made anew) and
    keepalive (seconds between our own comment lines). One row for each line: seq, received, value."""

    @classmethod
    def name(cls) -> str:
        return "beacon_feed"

    def schema(self) -> str:
        return "seq long, received long, value string"

    def streamReader(self, schema: StructType) -> FeedReader:
        return FeedReader(self.options)


@dataclass
class Listening(InputPartition):
    """One feed for the time of one batch."""

    feed: int
    start: int
    end: int


class Connection:
    """A feed's socket, kept open by the worker process from batch to batch."""

    def __init__(self, host: str, port: int, user: str, login: str, wait: float, silence: float, keepalive: float):
        self.at, self.user, self.login, self.wait, self.silence, self.keepalive = (host, port), user, login, wait, silence, keepalive
        self.sock: socket.socket | None = None
        self.rest, self.last, self.said = b"", 0.0, 0.0

    def _connect(self) -> None:
        self.sock = socket.create_connection(self.at, timeout=min(self.wait, 1.0))
        self.sock.sendall(self.login.encode() + b"\r\n")
        self.rest, self.last, self.said = b"", time.time(), time.time()

    def lines(self) -> Iterator[tuple[int, bytes]]:
        """What arrives within ``wait`` seconds, with its time. A broken connection is made anew, at most once a second."""
        until = time.time() + self.wait
        while time.time() < until:
            try:
                if self.sock is None or time.time() - self.last > self.silence:
                    self._connect()
                if time.time() - self.said > self.keepalive:
                    self.sock.sendall(f"# {self.user} alive\r\n".encode())
                    self.said = time.time()
                data = self.sock.recv(1 << 16)
                if not data:
                    raise ConnectionError("closed")
                self.last = time.time()
                *whole, self.rest = (self.rest + data).split(b"\n")
                yield from ((int(self.last), x) for x in whole)
            except TimeoutError:
                pass
            except OSError:
                self.sock = None
                time.sleep(min(1.0, max(0.0, until - time.time())))


_OPEN: dict[tuple, Connection] = {}


class FeedReader(DataSourceStreamReader):
    """Executors listen: each feed is a partition, read by a task for ``wait`` seconds, and no line passes through the driver.

    A service repeats nothing. With ``spool``, a folder that driver and executors share (a path or a URI that pyarrow's file
    systems open), a task writes its lines there before it hands them on; a batch that was planned but not finished, or a
    task that is run again, reads them from there. Files go when their batch is committed. Without one such a batch has what
    arrives when it is run again. What arrives while a lost executor's feed is connected anew is lost, as for any client.
    Offsets are seconds of the clock: they go on after a restart.
    """

    def __init__(self, options) -> None:
        self.feeds = [(f.rpartition(":")[0] or "localhost", int(f.rpartition(":")[2])) for f in options.get("feeds", "localhost:14580").split(",")]
        self.user = options.get("user", "N0CALL")
        self.login = f"user {self.user} pass -1 vers beaconlake 1" + (f" filter {options['filter']}" if "filter" in options else "")
        self.times = tuple(float(options.get(k, v)) for k, v in (("wait", "5"), ("silence", "60"), ("keepalive", "60")))
        self.spool = options.get("spool")

    def initialOffset(self) -> dict:
        return {"at": int(time.time()) - 1}

    def latestOffset(self) -> dict:
        return {"at": int(time.time())}

    def partitions(self, start: dict, end: dict) -> Sequence[Listening]:
        return [Listening(i, start["at"], end["at"]) for i in range(len(self.feeds))]

    def _folder(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.spool)

    def read(self, partition: Listening) -> Iterator[tuple]:
        name = f"{partition.end:012d}-{partition.feed}.jsonl"
        if not self.spool:
            yield from self._listen(partition)
            return
        fs, root = self._folder()
        if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/{name}.working") as out:
                for row in self._listen(partition):
                    out.write((json.dumps(row) + "\n").encode())
            fs.move(f"{root}/{name}.working", f"{root}/{name}")
        with fs.open_input_stream(f"{root}/{name}") as f:
            rest = b""
            while data := f.read(1 << 20):
                *whole, rest = (rest + data).split(b"\n")
                yield from (tuple(json.loads(x)) for x in whole)

    def _listen(self, p: Listening) -> Iterator[tuple]:
        key = (*self.feeds[p.feed], self.login)
        open_ = _OPEN.setdefault(key, Connection(*self.feeds[p.feed], self.user, self.login, *self.times))
        first = (p.end << FEEDS | p.feed) << LINES
        for i, (received, line) in enumerate(open_.lines()):
            yield first + i, received, line.decode("utf-8", "replace").rstrip("\r")

    def commit(self, end: dict) -> None:
        if not self.spool:
            return
        fs, root = self._folder()
        for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if f.base_name.endswith(".jsonl") and int(f.base_name[:12]) <= end["at"]:
                fs.delete_file(f.path)


def live(spark: SparkSession, **options: str) -> DataFrame:
    spark.dataSource.register(FeedSource)
    return spark.readStream.format("beacon_feed").options(**options).load()


def landed(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Lines of text files, with the time their file was written as received."""
    reader = spark.readStream if streaming else spark.read
    return reader.format("text").load(path).select(F.unix_seconds("_metadata.file_modification_time").alias("received"), "value")
