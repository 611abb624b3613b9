"""Means of named values."""

from __future__ import annotations


class UnknownMetricException(KeyError):
    """No value of that name has been pushed."""


class MetricMeter:
    """Sums and counts of named values until they are flushed."""

    def __init__(self):
        self._totals: dict[str, tuple[float, int]] = {}

    def push(self, name: str, value: float) -> None:
        total, n = self._totals.get(name, (0.0, 0))
        self._totals[name] = (total + float(value), n + 1)

    def get(self, name: str, flush: bool = False) -> float:
        """The mean; with flush the name is forgotten."""
        if name not in self._totals:
            raise UnknownMetricException(name)
        total, n = self._totals.pop(name) if flush else self._totals[name]
        return total / n

    def get_all(self, flush: bool = True):
        """(name, mean) of all; with flush the meter is empty after a full pass."""
        yield from [(name, total / n) for name, (total, n) in self._totals.items()]
        if flush:
            self.flush()

    def flush(self) -> None:
        self._totals = {}

    def is_empty(self) -> bool:
        return not self._totals
