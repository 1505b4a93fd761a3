"""Connectors by name and capability, with retries that back off and a breaker that stops calls after repeated failures."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


class Unavailable(RuntimeError):
    """The connector failed too often and is not called until reset()."""


@dataclass
class Connector:
    """loader(operation, params) gives a DataFrame; operations are what the connector can do."""

    name: str
    loader: Callable[[str, dict], DataFrame]
    operations: tuple[str, ...] = ("discover_tables", "profile_table", "query")
    retries: int = 3
    backoff: float = 2.0
    pause: Callable[[float], None] = time.sleep
    failures: int = 0

    def call(self, operation: str, **params) -> DataFrame:
        if operation not in self.operations:
            raise ValueError(f"{self.name} cannot {operation}")
        if self.failures >= self.retries:
            raise Unavailable(self.name)
        for attempt in range(self.retries):
            try:
                out = self.loader(operation, params)
                self.failures = 0
                return out
            except Exception:
                self.failures += 1
                if attempt + 1 == self.retries:
                    raise
                self.pause(self.backoff**attempt)
        raise AssertionError

    def healthy(self) -> bool:
        return self.failures < self.retries

    def reset(self) -> None:
        self.failures = 0


@dataclass
class Registry:
    """Connectors by name; a later registration of a name takes its place, so project settings override general ones."""

    connectors: dict[str, Connector] = field(default_factory=dict)

    def add(self, connector: Connector) -> None:
        self.connectors[connector.name] = connector

    def able(self, operation: str) -> list[str]:
        return sorted(n for n, c in self.connectors.items() if operation in c.operations)

    def call(self, operation: str, name: str | None = None, **params) -> DataFrame:
        """By name, or by the first healthy connector that can do the operation."""
        if name is None:
            name = next((n for n in self.able(operation) if self.connectors[n].healthy()), None)
            if name is None:
                raise Unavailable(operation)
        return self.connectors[name].call(operation, **params)
