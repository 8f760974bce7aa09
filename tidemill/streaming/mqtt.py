"""Lines from an MQTT broker as a stream: a data source of our own, with the little of MQTT 3.1.1 that it needs.

Messages are asked for with quality of service 1 and acknowledged once their batch is
committed, which Spark does when the next one begins; so a broker sends again what a
stopped stream had not finished: each message arrives at least once, and a store settles
repeats.  At most ``max_lines``
messages wait in the reader at a time; more stay with the broker.
"""

from __future__ import annotations

import json
import select
import socket
import struct
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

# Packet types of the protocol.
CONNECT, CONNACK, PUBLISH, PUBACK, SUBSCRIBE, SUBACK = 1, 2, 3, 4, 8, 9


def packet(kind: int, body: bytes, flags: int = 0) -> bytes:
    """A packet with its head: type, flags, and the length in groups of seven bits."""
    n, size = len(body), bytearray()
    while True:
        n, low = n >> 7, n & 127
        size.append(low | 128 if n else low)
        if not n:
            return bytes([kind << 4 | flags]) + bytes(size) + body


def text(value: str) -> bytes:
    data = value.encode()
    return struct.pack(">H", len(data)) + data


class Connection:
    """One session with a broker; the broker keeps it, so what is not acknowledged is sent again."""

    def __init__(self, host: str, port: int, client: str, topics: list[str], timeout: float = 10):
        self.socket, self.held = socket.create_connection((host, port), timeout), b""
        self.socket.sendall(packet(CONNECT, text("MQTT") + bytes([4, 0]) + struct.pack(">H", 0) + text(client)))
        answer = self._next(timeout)
        if answer is None or answer[0] >> 4 != CONNACK or answer[1][1]:
            raise ConnectionError(f"the broker {host}:{port} refused")
        body = struct.pack(">H", 1) + b"".join(text(t) + b"\x01" for t in topics)
        self.socket.sendall(packet(SUBSCRIBE, body, 2))

    def _take(self) -> tuple[int, bytes] | None:
        """A whole packet from what has arrived."""
        size, at = 0, 1
        while at < len(self.held):
            b = self.held[at]
            size |= (b & 127) << 7 * (at - 1)
            at += 1
            if not b & 128:
                if len(self.held) < at + size:
                    return None
                out, self.held = (self.held[0], self.held[at : at + size]), self.held[at + size :]
                return out
        return None

    def _next(self, wait: float) -> tuple[int, bytes] | None:
        end = time.monotonic() + wait
        while (found := self._take()) is None:
            ready, _, _ = select.select([self.socket], [], [], max(0, end - time.monotonic()))
            if not ready:
                return None
            more = self.socket.recv(1 << 16)
            if not more:
                raise ConnectionError("the broker hung up")
            self.held += more
        return found

    def messages(self, most: int, wait: float) -> Iterator[tuple[str, str, int]]:
        """(topic, payload, number to acknowledge, 0 for none) until ``most``, or none comes for ``wait`` seconds."""
        while most and (found := self._next(wait)) is not None:
            head, body = found
            if head >> 4 != PUBLISH:
                continue
            n = struct.unpack(">H", body[:2])[0]
            topic, at, number = body[2 : 2 + n].decode(), 2 + n, 0
            if head & 6:
                number, at = struct.unpack(">H", body[at : at + 2])[0], at + 2
            most -= 1
            yield topic, body[at:].decode("utf-8", "replace"), number

    def acknowledge(self, number: int) -> None:
        if number:
            self.socket.sendall(packet(PUBACK, struct.pack(">H", number)))


class Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.host, self.port = options["host"], int(options.get("port", 1883))
        self.client, self.topics = options.get("client", "tidemill"), json.loads(options["topics"])
        self.most, self.wait = int(options.get("max_lines", 10000)), float(options.get("wait", 0.5))
        self.connection: Connection | None = None
        #: Messages by place that are not committed yet.
        self.open: dict[int, tuple[str, str, int]] = {}

    def initialOffset(self) -> dict:
        return {"n": 0}

    def _more(self, place: int, most: int) -> int:
        if self.connection is None:
            self.connection = Connection(self.host, self.port, self.client, self.topics)
        for message in self.connection.messages(most, self.wait):
            self.open[place] = message
            place += 1
        return place

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = self._more(start["n"], max(0, self.most - len(self.open)))
        return self._rows(start["n"], end), {"n": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """After a restart: the broker sends what was not acknowledged, in its order."""
        place = max([start["n"], *[k + 1 for k in self.open]])
        if place < end["n"]:
            self._more(place, end["n"] - place)
        return self._rows(start["n"], end["n"])

    def _rows(self, start: int, end: int) -> Iterator[tuple]:
        return iter([self.open[k][:2] for k in range(start, end) if k in self.open])

    def commit(self, end: dict) -> None:
        for k in [k for k in self.open if k < end["n"]]:
            self.connection.acknowledge(self.open.pop(k)[2])


class MqttLines(DataSource):
    """``topic, text``; options host, port, client, topics (a JSON list), max_lines, wait (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "mqtt_lines"

    def schema(self) -> str:
        return "topic string, text string"

    def simpleStreamReader(self, schema) -> Reader:
        return Reader(self.options)


def mqtt_lines(spark: SparkSession, host: str, port: int, topics: list[str], kind: str = "put", **options) -> DataFrame:
    """Lines of the topics for ``ingest``: a message may hold several.  Plain ones with quotation marks are passed over."""
    spark.dataSource.register(MqttLines)
    x = spark.readStream.format("mqtt_lines").options(host=host, port=port, topics=json.dumps(topics), **options).load()
    is_json = F.ltrim("text").rlike(r"^[\[{]")
    one = F.when(is_json, F.array("text")).otherwise(F.split("text", "\n"))
    x = x.where(~F.contains("text", F.lit('"')) | (is_json if kind != "line" else F.lit(False)))
    return x.select(F.explode(one).alias("text")).where("text <> ''")
