"""Two ends of a connection within one process, for tests and for vats that live side by side."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from ..kernel.wire import FrameError, Limits
from .vat import Handlers, Vat


@dataclass
class _Line:
    """What both ends share."""

    closed: bool = False


@dataclass
class End:
    """One end: whole frames go out in order and come in in order; nothing waits."""

    inbox: deque[bytes]
    outbox: deque[bytes]
    line: _Line = field(default_factory=_Line)

    def send(self, frame) -> None:
        """Hand a frame to the other end, as a copy; a closed connection takes none."""
        if self.line.closed:
            raise FrameError("ARG", "the connection is closed")
        self.outbox.append(bytes(frame))

    def receive(self) -> bytes | None:
        """The next frame, or None; what was sent before the connection closed still comes."""
        return self.inbox.popleft() if self.inbox else None

    @property
    def pending(self) -> int:
        return len(self.inbox)

    def close(self) -> None:
        self.line.closed = True

    @property
    def closed(self) -> bool:
        return self.line.closed


def memory_pair() -> tuple[End, End]:
    """Two connected ends."""
    one, two, line = deque(), deque(), _Line()
    return End(one, two, line), End(two, one, line)


def serve(vat: Vat, ends: dict[str, End], handlers: Handlers | None = None, limits: Limits = Limits()) -> int:
    """Let a vat answer all frames that wait at its ends, by connection; how many there were."""
    n = 0
    while waiting := [c for c, e in ends.items() if e.pending]:
        for c in waiting:
            for to, out in vat.receive(c, ends[c].receive(), handlers, limits):
                if not ends[to].closed:
                    ends[to].send(out)
            n += 1
    return n
