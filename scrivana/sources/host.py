"""What a host has to offer, and discovery through it."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame

from scrivana.operators import policy, snapshot


@runtime_checkable
class Host(Protocol):
    """The calls that discovery and refreshing rely on; each takes and gives DataFrames."""

    def discover_candidates(self, request: dict) -> DataFrame: ...  # (id, kind, uri, ...)

    def retrieve_source(self, sources: DataFrame) -> DataFrame: ...  # (id, body, error)

    def refresh_context(self, sources: DataFrame) -> DataFrame: ...  # (id, body, error)

    def propose_implementation(self, plan: dict) -> list: ...

    def apply_implementation(self, edits: list) -> dict: ...

    def verify(self, result: dict) -> dict: ...


REQUIRED = ("discover_candidates", "retrieve_source", "refresh_context", "propose_implementation", "apply_implementation", "verify")


@dataclass(frozen=True)
class Adapter:
    """Discovery behind an allow-list: sources are authorized before any of them is fetched."""

    host: Host
    hosts: dict
    remotes: tuple = ()

    def __post_init__(self):
        for name in REQUIRED:
            if not callable(getattr(self.host, name, None)):
                raise TypeError(f"{name} must be a function")

    def discover(self, request: dict) -> tuple[DataFrame, DataFrame]:
        """(sources with bodies, gaps)."""
        decided = policy.authorized(self.host.discover_candidates(request), self.hosts, list(self.remotes))
        accepted, rejected = policy.partitioned(decided)
        sources, failed = snapshot.refreshed(accepted, self.host.retrieve_source(accepted))
        return sources, rejected.unionByName(failed)

    def refresh(self, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(sources with new bodies, gaps) for sources that are stale or of unknown age."""
        return snapshot.refreshed(sources, self.host.refresh_context(sources))


@dataclass(frozen=True)
class Settings:
    """Where documents go, and defaults; None leaves a target out."""

    drive_folder: str | None = None
    vault: str | None = None
    books: str = "Books"
    attachments: str = "Attachments"
    index: str = "Books/Index.md"
    max_words: int = 8000

    @classmethod
    def of(cls, values: dict) -> Settings:
        """Settings out of a mapping; names that aren't settings are left out, empty values take the default."""
        return cls(**{k: v for k, v in values.items() if k in cls.__dataclass_fields__ and v not in (None, "")})
