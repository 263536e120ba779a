"""Exchange frames from a live socket: a small client, a spool of files, and the stream over it.

A collector (one process a shard of symbols) reads messages and spools them into files that appear whole; Spark's file
stream takes them from there, so that a query that starts again reads the same frames again."""

from __future__ import annotations

import base64
import hashlib
import os
import socket
import ssl
import struct
import time
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

#: Fixed value of the protocol (RFC 6455): what a server's answer to a key is made with.
ANSWER = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"
TEXT, BINARY, CLOSE, PING, PONG = 1, 2, 8, 9, 10


def _exactly(read: Callable[[int], bytes], n: int) -> bytes:
    out = b""
    while len(out) < n:
        part = read(n - len(out))
        if not part:
            raise ConnectionError("the connection ended within a frame")
        out += part
    return out


def _send(sock: socket.socket, kind: int, body: bytes) -> None:
    """One frame from a client, masked as the protocol asks; control frames only, so of 125 bytes at most."""
    mask = os.urandom(4)
    sock.sendall(bytes([0x80 | kind, 0x80 | len(body)]) + mask + bytes(b ^ mask[i % 4] for i, b in enumerate(body)))


def messages(url: str, timeout_s: float = 30.0) -> Iterator[str]:
    """The text messages of a WebSocket address (ws or wss), whole ones, until the server closes. A silence over the timeout, or a broken connection, is an OSError."""
    at = urlsplit(url)
    if at.scheme not in ("ws", "wss"):
        raise ValueError(f"no socket address: {url}")
    sock = socket.create_connection((at.hostname, at.port or (443 if at.scheme == "wss" else 80)), timeout_s)
    try:
        if at.scheme == "wss":
            sock = ssl.create_default_context().wrap_socket(sock, server_hostname=at.hostname)
        key = base64.b64encode(os.urandom(16)).decode()
        path = (at.path or "/") + (f"?{at.query}" if at.query else "")
        sock.sendall(f"GET {path} HTTP/1.1\r\nHost: {at.netloc}\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {key}\r\nSec-WebSocket-Version: 13\r\n\r\n".encode())
        reader = sock.makefile("rb")
        status, *headers = iter(lambda: reader.readline().decode("latin-1").strip(), "")
        given = dict((x.strip() for x in h.split(":", 1)) for h in headers)
        given = {k.lower(): v for k, v in given.items()}
        if " 101 " not in f"{status} " or given.get("sec-websocket-accept") != base64.b64encode(hashlib.sha1((key + ANSWER).encode()).digest()).decode():
            raise ConnectionError(f"no socket there: {status}")
        parts, first = [], TEXT
        while True:
            head, size = _exactly(reader.read, 2)
            size &= 0x7F
            if size > 125:
                size = struct.unpack(">H" if size == 126 else ">Q", _exactly(reader.read, 2 if size == 126 else 8))[0]
            body, kind = _exactly(reader.read, size), head & 0x0F
            if kind == CLOSE:
                _send(sock, CLOSE, body[:2])
                return
            if kind == PING:
                _send(sock, PONG, body)
            elif kind != PONG:
                first = kind or first
                parts.append(body)
                if head & 0x80:
                    whole, parts = b"".join(parts), []
                    if first == TEXT:
                        yield whole.decode("utf-8", "replace")
    finally:
        sock.close()


def spool(spark: SparkSession, frames: Iterator[str], folder: str, most: int = 1000, most_s: float = 5.0, clock: Callable[[], float] = time.monotonic) -> int:
    """Writes messages, one a line, into files of at most so many, or of what came in most_s; a file is named only when it is whole. Gives the number of files."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held, since, files = [], clock(), 0

    def flush() -> None:
        nonlocal held, since, files
        if held:
            name = f"frames-{int(time.time() * 1000):013d}-{uuid.uuid4().hex}.txt"
            out = fs.create(hadoop(f"{folder}/_{name}"), False)
            try:
                out.write(bytearray(("\n".join(held) + "\n").encode()))
            finally:
                out.close()
            fs.rename(hadoop(f"{folder}/_{name}"), hadoop(f"{folder}/{name}"))
            files += 1
        held, since = [], clock()

    try:
        for m in frames:
            held.append(m.replace("\n", " "))
            if len(held) >= most or clock() - since >= most_s:
                flush()
    finally:
        flush()
    return files


def frame_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """The spooled frames as a stream with one column, value; see parse.exchange_frames."""
    reader = spark.readStream
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).text(folder)
