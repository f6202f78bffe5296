"""Failures on purpose: raise once at a named point of a batch."""

from __future__ import annotations


class InjectedFault(RuntimeError):
    pass


class FaultOnce:
    """Raises the first time `point` is reached at or after `batch_id`.

    Points are 'staged' (data written, nothing published) and 'committed'
    (published, the stream's own commit log not yet written).
    """

    def __init__(self, point: str, batch_id: int):
        self.point, self.batch_id, self.fired_at = point, batch_id, None

    def __call__(self, point: str, batch_id: int) -> None:
        if self.fired_at is None and point == self.point and batch_id >= self.batch_id:
            self.fired_at = batch_id
            raise InjectedFault(f"injected at {point} of batch {batch_id}")
