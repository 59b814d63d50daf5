"""One rate for the calls of all tasks.

The driver keeps a schedule: call number n of a run is due at n over the rate.
A task asks for the next places when it has a call to make, and waits until they
are due.  So tasks that have nothing to call take no part of the rate, and more
tasks do not exceed it.  Places are given out in ranges, of which a task keeps
what it does not need at once.  A place that a lost task had is lost with it."""

from __future__ import annotations

import json
import secrets
import socket
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from socketserver import StreamRequestHandler, ThreadingTCPServer
from threading import Lock, Thread

#: Seconds after which a task that gets no answer gives up.
PATIENCE = 60.0


class Schedule:
    """When the next calls are due; `burst` of them may be late at once."""

    def __init__(self, rate: float, burst: int = 1, clock: Callable[[], float] = time.monotonic):
        if rate <= 0:
            raise ValueError("the rate must be positive")
        self.rate, self.burst, self.clock, self.lock = rate, burst, clock, Lock()
        self.next = clock() - (burst - 1) / rate

    def take(self, places: int) -> list[float]:
        """For each of so many places the seconds until it is due."""
        with self.lock:
            now = self.clock()
            # What was not used for a while is lost but for the burst.
            self.next = max(self.next, now - (self.burst - 1) / self.rate)
            due = [self.next + i / self.rate for i in range(places)]
            self.next += places / self.rate
            return [max(0.0, d - now) for d in due]


class Handler(StreamRequestHandler):
    def handle(self) -> None:
        for line in self.rfile:
            asked = json.loads(line)
            if not secrets.compare_digest(str(asked.get("key", "")), self.server.key):
                return
            self.wfile.write(json.dumps(self.server.schedule.take(int(asked["places"]))).encode() + b"\n")


class Server(ThreadingTCPServer):
    daemon_threads, allow_reuse_address = True, True


class SharedRate:
    """The driver's side: serves a schedule until it is closed."""

    def __init__(self, rate: float, burst: int = 1, host: str = "127.0.0.1"):
        self.server = Server((host, 0), Handler)
        self.server.schedule, self.server.key = Schedule(rate, burst), secrets.token_hex(16)
        Thread(target=self.server.serve_forever, daemon=True).start()

    def places(self, ahead: int = 1) -> Places:
        host, port = self.server.server_address
        return Places(host, port, self.server.key, ahead)

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()

    def __enter__(self) -> SharedRate:
        return self

    def __exit__(self, *_) -> None:
        self.close()


@dataclass
class Places:
    """A task's side: it goes to the tasks with their functions."""

    host: str
    port: int
    key: str
    ahead: int = 1

    def __post_init__(self):
        self.reset()

    def reset(self) -> None:
        self.lock, self.held, self.line = Lock(), deque(), None

    def __getstate__(self):
        return self.host, self.port, self.key, self.ahead

    def __setstate__(self, state):
        self.host, self.port, self.key, self.ahead = state
        self.reset()

    def due(self) -> float:
        """When the next call may be made."""
        with self.lock:
            if not self.held:
                if self.line is None:
                    self.line = socket.create_connection((self.host, self.port), PATIENCE).makefile("rwb")
                self.line.write(json.dumps({"key": self.key, "places": self.ahead}).encode() + b"\n")
                self.line.flush()
                answer = self.line.readline()
                if not answer:
                    raise ConnectionError("the driver gives out no places")
                now = time.monotonic()
                self.held.extend(now + x for x in json.loads(answer))
            return self.held.popleft()

    def acquire(self) -> None:
        time.sleep(max(0.0, self.due() - time.monotonic()))
