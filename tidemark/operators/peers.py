"""Tasks of one barrier stage that keep their part of a model between steps and send each other what a step needs.

Spark starts all tasks of the stage together and, if one is lost, all of them again from the stage's input. Messages go from
task to task, not through the driver, which only passes on where each one listens.
"""

from __future__ import annotations

import json
import secrets
import socket
import struct
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import BarrierTaskContext
from pyspark.sql import SparkSession

#: Seconds without a byte from a peer after which a task fails (and with it the stage, which Spark then runs again).
TIMEOUT = 600
_LENGTH = struct.Struct("<q")


class Peers:
    """me of n tasks. With one task there is no socket."""

    def __init__(self, context: BarrierTaskContext | None = None):
        self.me, self.n, self.links = 0, 1, {}
        if context is None:
            return
        infos = context.getTaskInfos()
        self.me, self.n = context.partitionId(), len(infos)
        if self.n == 1:
            return
        own_key = secrets.token_hex(16)
        host = infos[self.me].address.rsplit(":", 1)[0]
        with socket.create_server(("", 0), backlog=self.n) as server:
            server.settimeout(TIMEOUT)
            told = [json.loads(x) for x in context.allGather(json.dumps([host, server.getsockname()[1], own_key]))]
            for other in range(self.me):
                at, port, key = told[other]
                link = socket.create_connection((at, port), TIMEOUT)
                link.sendall(key.encode() + _LENGTH.pack(self.me))
                self.links[other] = link
            while len(self.links) < self.n - 1:
                link, _ = server.accept()
                link.settimeout(TIMEOUT)
                hello = self._exactly(link, 32 + _LENGTH.size)
                if hello[:32] == own_key.encode():
                    self.links[_LENGTH.unpack(hello[32:])[0]] = link
                else:
                    link.close()
        for link in self.links.values():
            link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        self.sender = ThreadPoolExecutor(1)

    @staticmethod
    def _exactly(link: socket.socket, n: int) -> bytearray:
        out = bytearray(n)
        view, got = memoryview(out), 0
        while got < n:
            more = link.recv_into(view[got:], n - got)
            if not more:
                raise ConnectionError("a peer has gone")
            got += more
        return out

    def swap(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """parts[j] goes to task j; what each task sent to this one comes back, flat, in the order of tasks.

        All send in the order of tasks and receive in it, so none waits for another in a circle."""
        if self.n == 1:
            return [parts[0].ravel()]
        flat = [np.ascontiguousarray(p).ravel() for p in parts]

        def send() -> None:
            for other, link in sorted(self.links.items()):
                link.sendall(_LENGTH.pack(flat[other].nbytes))
                link.sendall(flat[other].data.cast("B") if flat[other].nbytes else b"")

        sent = self.sender.submit(send)
        out = []
        for other in range(self.n):
            if other == self.me:
                out.append(flat[other])
                continue
            size = _LENGTH.unpack(self._exactly(self.links[other], _LENGTH.size))[0]
            out.append(np.frombuffer(self._exactly(self.links[other], size), flat[other].dtype))
        sent.result()
        return out

    def pass_on(self, part: Callable[[int], np.ndarray], take: Callable[[int, np.ndarray], None]) -> None:
        """swap() with one part held at a time: part(j) is made when its turn comes, take(j, x) gets the flat x that task j sent."""
        own = np.ascontiguousarray(part(self.me)).ravel()
        if self.n == 1:
            return take(0, own)

        def send() -> None:
            for other, link in sorted(self.links.items()):
                x = np.ascontiguousarray(part(other)).ravel()
                link.sendall(_LENGTH.pack(x.nbytes))
                link.sendall(x.data.cast("B") if x.nbytes else b"")

        sent = self.sender.submit(send)
        take(self.me, own)
        kind = own.dtype
        del own
        for other, link in sorted(self.links.items()):
            size = _LENGTH.unpack(self._exactly(link, _LENGTH.size))[0]
            take(other, np.frombuffer(self._exactly(link, size), kind))
        sent.result()

    def total(self, x: np.ndarray) -> np.ndarray:
        """The sum over all tasks, added in their order, the same for each. Large arrays are added in parts, one a task."""
        if self.n == 1:
            return x
        if x.size < 1 << 12:
            return sum(self.swap([x] * self.n)).reshape(x.shape)
        mine = sum(self.swap(np.array_split(x.ravel(), self.n)))
        return np.concatenate(self.swap([mine] * self.n)).reshape(x.shape)

    def close(self) -> None:
        if self.links:
            self.sender.shutdown()
            for link in self.links.values():
                link.close()


class Routes:
    """Which rows of other tasks this one needs, agreed once: wanted ids with the task that owns each, against the sorted own ids."""

    def __init__(self, peers: Peers, wanted: np.ndarray, owners: np.ndarray, own: np.ndarray):
        order = np.argsort(owners, kind="stable")
        self.peers, self.back = peers, np.argsort(order, kind="stable")
        self.order, self.counts = order, np.bincount(owners, minlength=peers.n)
        ends = np.cumsum(self.counts)
        asked = peers.swap([wanted[order][e - c : e].astype(np.int64) for e, c in zip(ends, self.counts, strict=True)])
        self.places = [np.searchsorted(own, a) for a in asked]
        for a, at in zip(asked, self.places, strict=True):
            if len(a) and (at.max() >= len(own) or (own[at] != a).any()):
                raise ValueError("a row was asked for that its owner does not have")

    @classmethod
    def each(cls, peers: Peers, wanted: list[np.ndarray], owners: list[np.ndarray], own: np.ndarray) -> list[Routes]:
        """The routes of many steps, agreed together: two exchanges, not one a step."""
        out, asks = [], [[] for _ in range(peers.n)]
        for ids, at in zip(wanted, owners, strict=True):
            r = cls.__new__(cls)
            r.peers, r.order = peers, np.argsort(at, kind="stable")
            r.back, r.counts, r.places = np.argsort(r.order, kind="stable"), np.bincount(at, minlength=peers.n), []
            for j, part in enumerate(np.split(ids[r.order].astype(np.int64), np.cumsum(r.counts)[:-1])):
                asks[j].append(part)
            out.append(r)
        counts = peers.swap([np.array([len(x) for x in a], np.int64) for a in asks])
        for n, asked in zip(counts, peers.swap([np.concatenate([*a, np.zeros(0, np.int64)]) for a in asks]), strict=True):
            places = np.searchsorted(own, asked)
            if len(asked) and (places.max() >= len(own) or (own[places] != asked).any()):
                raise ValueError("a row was asked for that its owner does not have")
            for r, at in zip(out, np.split(places, np.cumsum(n)[:-1]), strict=True):
                r.places.append(at)
        return out

    def fetch(self, rows: np.ndarray) -> np.ndarray:
        """The wanted rows, in the order asked, from the own rows of every task. Beside them a task holds what it sends to one other
        and gets from one other."""
        out, ends = np.empty((len(self.order), rows.shape[1]), rows.dtype), np.cumsum(self.counts)

        def take(j: int, x: np.ndarray) -> None:
            out[self.order[ends[j] - self.counts[j] : ends[j]]] = x.reshape(-1, rows.shape[1])

        self.peers.pass_on(lambda j: rows[self.places[j]], take)
        return out

    def deliver(self, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """One row for each wanted id goes to its owner; what comes back are own rows' places with what each task sent for them."""
        ends = np.cumsum(self.counts)
        mine = rows[self.order]
        got = self.peers.swap([mine[e - c : e] for e, c in zip(ends, self.counts, strict=True)])
        return [(at, part.reshape(-1, rows.shape[1])) for at, part in zip(self.places, got, strict=True)]

    def push(self, rows: np.ndarray, into: np.ndarray) -> None:
        """Adds one row for each wanted id to that id's row at its owner, in the order of tasks."""
        for at, part in self.deliver(rows):
            into[at] += part  # a task asks for a row once

    def push_total(self, rows: np.ndarray, into: np.ndarray, x: np.ndarray) -> np.ndarray:
        """push() and Peers.total() of the flat x in one exchange, where x is small."""
        if self.peers.n == 1 or x.size >= 1 << 12:
            self.push(rows, into)
            return self.peers.total(x)
        mine = np.split(rows[self.order], np.cumsum(self.counts)[:-1])
        got = self.peers.swap([np.concatenate([x, part.ravel()]) for part in mine])
        for at, part in zip(self.places, got, strict=True):
            into[at] += part[x.size :].reshape(-1, rows.shape[1])
        return sum(part[: x.size] for part in got)


def task_count(spark: SparkSession, rows: int, a_task: int) -> int:
    """One task for so many rows, as many as run at once at most: a barrier stage needs all its tasks running."""
    return max(1, min(spark.sparkContext.defaultParallelism, -(-rows // a_task)))
