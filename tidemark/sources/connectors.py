"""Sources and sinks that speak to other systems, over an injectable transport.

A transport is a picklable function; none is built in for a protocol that needs a client library, so engines and tests bring
their own.  Sinks run in ``foreachBatch`` or on a DataFrame, one connection for each partition.
"""

from __future__ import annotations

import json
import re
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Takes an address or topic and a body, and where a sink has any, headers or options as a third argument; gives a status.
Transport = Callable[..., int]


class Connector(Protocol):
    """What ``foreachBatch`` and ``send`` need of a sink."""

    stats: Stats

    def send(self, topic: str, payload: bytes) -> bool: ...

    def is_connected(self) -> bool: ...


@dataclass
class Stats:
    sent: int = 0
    failed: int = 0
    bytes: int = 0
    reconnections: int = 0
    last_error: str | None = None


def payloads(readings: DataFrame, size: int = 100, keys: tuple[str, ...] = ("sensor_type",)) -> DataFrame:
    """JSON bodies ``{"count": n, "readings": [...]}`` of at most ``size`` readings, in order, numbered for each key."""
    at = F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy("ts_ms", "seq")) - 1) / size)
    reading = F.struct("seq", "sensor_id", "ts_ms", "value", "quality")
    grouped = readings.withColumn("chunk_no", at).groupBy(*keys, "chunk_no").agg(F.array_sort(F.collect_list(reading)).alias("_r"))
    body = F.to_json(F.struct(F.size("_r").alias("count"), F.col("_r").alias("readings")))
    return grouped.select(*keys, "chunk_no", F.size("_r").alias("count"), body.alias("body"))


def topic_batches(messages: DataFrame, size: int = 50) -> DataFrame:
    """Arrays of {topic, payload, timestamp} from columns topic, payload, ts_ms, seq."""
    at = F.floor((F.row_number().over(Window.partitionBy("topic").orderBy("ts_ms", "seq")) - 1) / size)
    one = F.struct("ts_ms", "seq", F.struct("topic", "payload", F.col("ts_ms").alias("timestamp")).alias("m"))
    grouped = messages.withColumn("batch_no", at).groupBy("topic", "batch_no").agg(F.array_sort(F.collect_list(one)).alias("_m"))
    return grouped.select("topic", "batch_no", F.to_json(F.transform("_m", lambda m: m["m"])).alias("body"))


@dataclass
class HttpSink:
    """Posts with retries on 429, 5xx and errors of the transport, after 100 ms doubled each time; other refusals fail at once."""

    transport: Transport
    url: str
    retries: int = 3
    base_ms: float = 100
    auth: dict = field(default_factory=dict)
    sleep: Callable[[float], None] = time.sleep

    def headers(self) -> dict[str, str]:
        kind = self.auth.get("type")
        if kind == "bearer":
            return {"Authorization": f"Bearer {self.auth['token']}"}
        if kind == "basic":
            import base64

            return {"Authorization": "Basic " + base64.b64encode(f"{self.auth['user']}:{self.auth['password']}".encode()).decode()}
        return {self.auth["header"]: self.auth["key"]} if kind == "api_key" else {}

    def post(self, body: bytes, stats: Stats) -> bool:
        headers = self.headers()
        for attempt in range(self.retries + 1):
            try:
                code = self.transport(self.url, body, headers) if headers else self.transport(self.url, body)
            except OSError as e:
                stats.last_error, code = str(e), 599
            if code < 400:
                stats.sent, stats.bytes = stats.sent + 1, stats.bytes + len(body)
                return True
            stats.last_error = f"status {code}" if code != 599 else stats.last_error
            if code != 429 and code < 500:
                break
            if attempt < self.retries:
                self.sleep(self.base_ms * 2**attempt / 1000)
        stats.failed += 1
        return False


@dataclass
class Publisher:
    """Publishes to topics; while the transport fails, messages wait in a buffer that drops the oldest when full.

    ``qos`` (0 to 2) and ``retain`` go to the transport as options where they are not 0 and false.  With ``batch`` messages
    of a topic are gathered and sent as one JSON array of {topic, payload, timestamp} when there are so many or the first has
    waited ``batch_ms``; retained messages and those of QoS 2 go one by one.
    """

    transport: Transport
    qos: int = 0
    retain: bool = False
    buffer: int = 1000
    batch: int = 0
    batch_ms: int = 100
    clock: Callable[[], float] = time.time
    waiting: deque = field(default_factory=deque)
    stats: Stats = field(default_factory=Stats)
    gathered: dict = field(default_factory=dict)
    connected: bool = True

    def __post_init__(self):
        if self.qos not in (0, 1, 2):
            raise ValueError("qos is 0, 1 or 2")

    def is_connected(self) -> bool:
        return self.connected

    def send(self, topic: str, payload: bytes) -> bool:
        if self.batch <= 1 or self.retain or self.qos == 2:
            return self.publish(topic, payload, self.stats)
        now = int(self.clock() * 1000)
        self.gathered.setdefault(topic, []).append({"topic": topic, "payload": payload.decode("utf-8", "replace"), "timestamp": now})
        return self.flush_batches(now)

    def flush_batches(self, now: int | None = None) -> bool:
        """Sends the batches that are full or old; all of them without a time."""
        good = True
        for topic, messages in list(self.gathered.items()):
            if now is None or len(messages) >= self.batch or now - messages[0]["timestamp"] >= self.batch_ms:
                del self.gathered[topic]
                good &= self.publish(topic, json.dumps(messages).encode(), self.stats)
        return good

    def publish(self, topic: str, payload: bytes, stats: Stats) -> bool:
        self.waiting.append((topic, payload))
        while len(self.waiting) > self.buffer:
            self.waiting.popleft()
            stats.failed += 1
        return self.flush(stats)

    def flush(self, stats: Stats) -> bool:
        options = {"qos": self.qos, "retain": self.retain} if self.qos or self.retain else None
        while self.waiting:
            topic, payload = self.waiting[0]
            try:
                code = self.transport(topic, payload, options) if options else self.transport(topic, payload)
            except OSError as e:
                stats.last_error, code = str(e), 599
            if code >= 400:
                self.connected = False
                return False
            stats.reconnections += not self.connected
            self.connected = True
            self.waiting.popleft()
            stats.sent, stats.bytes = stats.sent + 1, stats.bytes + len(payload)
        return True


@dataclass
class Subscriptions:
    """Topic filters that a client has subscribed to; a filter may hold ``+`` for one level and end in ``#`` for all that follow."""

    filters: set[str] = field(default_factory=set)

    def subscribe(self, topic_filter: str) -> None:
        levels = topic_filter.split("/")
        if not topic_filter or "#" in levels[:-1] or any(len(x) > 1 and ("#" in x or "+" in x) for x in levels):
            raise ValueError(f"no topic filter: {topic_filter!r}")
        self.filters.add(topic_filter)

    def unsubscribe(self, topic_filter: str) -> None:
        self.filters.discard(topic_filter)

    def delivered(self, messages: DataFrame, topic: str = "topic") -> DataFrame:
        """The messages of a table or stream whose topic is subscribed to; null topics are not."""
        fits = [topic_matches(F.col(topic), f) for f in sorted(self.filters)]
        return messages.where(reduce(lambda a, b: a | b, fits, F.lit(False)))


def topic_matches(topic: Column, topic_filter: str) -> Column:
    """Whether a topic fits a filter, as MQTT has it: wildcards do not fit a first level that begins with ``$``."""
    rest = topic_filter.endswith("/#")
    levels = (topic_filter[:-2] if rest else topic_filter).split("/")
    if topic_filter == "#":
        return ~topic.startswith("$")
    pattern = "/".join("[^/]*" if x == "+" else re.escape(x) for x in levels) + ("(/.*)?" if rest else "")
    fits = topic.rlike(f"^{pattern}$")
    return fits & ~topic.startswith("$") if levels[0] == "+" else fits


def send(bodies: DataFrame, sink: HttpSink, body: str = "body") -> DataFrame:
    """Posts every body, each partition over its own sink; one row of statistics a partition."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stats = Stats()
        for part in parts:
            for text in part[body]:
                sink.post(text.encode(), stats)
        yield pd.DataFrame([asdict(stats)])

    return bodies.select(body).mapInPandas(run, "sent long, failed long, bytes long, reconnections long, last_error string")


def blocks(messages: DataFrame, payload: str, exponent: int) -> DataFrame:
    """Blocks of 2**(exponent + 4) bytes: ``block_no``, ``more``, ``option`` (number, more flag and exponent in one) and ``block``."""
    size = 1 << (exponent + 4)
    count = F.greatest(F.ceil(F.octet_length(payload) / size), F.lit(1))
    out = messages.withColumn("_n", count).withColumn("block_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    more = F.col("block_no") < F.col("_n") - 1
    option = F.col("block_no") * 16 + F.when(more, 8).otherwise(0) + exponent
    block = F.substring(F.col(payload), (F.col("block_no") * size + 1).cast("int"), F.lit(size))
    return out.withColumns({"more": more, "option": option.cast("long"), "block": block}).drop("_n")


def coap_encode(kind: int, code: int, message_id: int, token: bytes = b"", options: list[tuple[int, bytes]] = (), payload: bytes = b"") -> bytes:
    """A CoAP message (RFC 7252): version 1, options by rising number."""
    out = bytearray([0x40 | kind << 4 | len(token), code, message_id >> 8, message_id & 0xFF]) + token
    last = 0
    for number, value in sorted(options, key=lambda o: o[0]):
        nibbles, tail = [], b""
        for n in (number - last, len(value)):
            if n < 13:
                nibbles.append(n)
            elif n < 269:
                nibbles.append(13)
                tail += bytes([n - 13])
            else:
                nibbles.append(14)
                tail += (n - 269).to_bytes(2, "big")
        out += bytes([nibbles[0] << 4 | nibbles[1]]) + tail + value
        last = number
    return bytes(out + (b"\xff" + payload if payload else b""))


@dataclass
class CoapMessage:
    kind: int
    code: int
    message_id: int
    token: bytes
    options: list[tuple[int, bytes]]
    payload: bytes


def coap_decode(raw: bytes) -> CoapMessage:
    """The message in a datagram; ValueError for what is none."""
    if len(raw) < 4 or raw[0] >> 6 != 1 or (size := raw[0] & 15) > 8 or len(raw) < 4 + size:
        raise ValueError("no CoAP message of version 1")
    at, number, options = 4 + size, 0, []

    def extended(nibble: int) -> int:
        nonlocal at
        width = {13: 1, 14: 2}.get(nibble, 0)
        if nibble == 15 or at + width > len(raw):
            raise ValueError("broken option")
        at += width
        return nibble if not width else int.from_bytes(raw[at - width : at], "big") + (13 if width == 1 else 269)

    while at < len(raw) and raw[at] != 0xFF:
        head = raw[at]
        at += 1
        number += extended(head >> 4)
        length = extended(head & 15)
        if at + length > len(raw):
            raise ValueError("broken option")
        options.append((number, raw[at : at + length]))
        at += length
    if at == len(raw) - 1:
        raise ValueError("a payload marker without a payload")
    return CoapMessage(raw[0] >> 4 & 3, raw[1], int.from_bytes(raw[2:4], "big"), raw[4 : 4 + size], options, raw[at + 1 :])


# Fixed values of RFC 7252: request codes, the option of a path segment, and the first success code after the last.
COAP_GET, COAP_POST, URI_PATH, COAP_SUCCESS = 1, 2, 11, range(64, 96)


@dataclass
class CoapClient:
    """Requests over a transport that takes a datagram and gives the answer's; confirmable unless told otherwise."""

    exchange: Callable[[bytes], bytes]
    confirmable: bool = True
    next_id: int = 1

    def request(self, code: int, path: str, payload: bytes = b"", token: bytes = b"") -> CoapMessage:
        segments = [(URI_PATH, x.encode()) for x in path.strip("/").split("/") if x]
        sent, self.next_id = self.next_id, (self.next_id + 1) % (1 << 16)
        answer = coap_decode(self.exchange(coap_encode(0 if self.confirmable else 1, code, sent, token, segments, payload)))
        if answer.token != token:
            raise OSError("the answer is to another request")
        if answer.code not in COAP_SUCCESS:
            raise OSError(f"status {answer.code >> 5}.{answer.code & 31:02d}")
        return answer

    def get(self, path: str) -> bytes:
        return self.request(COAP_GET, path).payload

    def post(self, path: str, payload: bytes) -> bytes:
        return self.request(COAP_POST, path, payload).payload


class PolledSource(DataSource):
    """A source that asks a transport for JSON lines: ``fetch`` (option) names ``module:function`` giving them for ``url``."""

    @classmethod
    def name(cls) -> str:
        return "polled"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema):
        return _PolledReader(self.options)


class _PolledReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [InputPartition(url) for url in self.options["url"].split(",")]

    def read(self, partition):
        import importlib

        module, _, function = self.options["fetch"].partition(":")
        for item in getattr(importlib.import_module(module), function)(partition.value):
            yield (item if isinstance(item, str) else json.dumps(item),)
