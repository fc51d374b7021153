"""A streaming source of UDP packets: spark.readStream.format('udp_packets').option('port', 8514).load().

One row per datagram: packet (a running number), recv (host seconds) and
payload.  Datagrams live in the reader's memory only; for exactly-once, let a
forwarder write them to files or a log and read those.
"""

from __future__ import annotations

import select
import socket
import time

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "packet long, recv double, payload binary"


class PacketReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.most = int(options.get("maxPackets", 10_000))
        self.wait = float(options.get("waitSeconds", 0.2))
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        self.socket.bind((options.get("host", "0.0.0.0"), int(options.get("port", 8514))))
        self.socket.setblocking(False)
        self.kept: dict[int, tuple] = {}

    def initialOffset(self) -> dict:
        return {"packet": 0}

    def read(self, start: dict):
        at, rows = start["packet"], []
        stop = time.monotonic() + self.wait
        while len(rows) < self.most and (left := stop - time.monotonic()) > 0:
            if select.select([self.socket], [], [], left)[0]:
                rows.append((at + len(rows), time.monotonic(), self.socket.recv(65_536)))
        self.kept |= {r[0]: r for r in rows}
        return iter(rows), {"packet": at + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([self.kept[k] for k in range(start["packet"], end["packet"]) if k in self.kept])

    def commit(self, end: dict) -> None:
        for k in [k for k in self.kept if k < end["packet"]]:
            del self.kept[k]


class UdpPackets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "udp_packets"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> PacketReader:
        return PacketReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(UdpPackets)
