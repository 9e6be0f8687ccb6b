"""Settings from the environment with overrides."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

PREFIX = "TICKETLOOM_"


def read_text(name: str, default: str | None = None) -> str | None:
    value = os.environ.get(PREFIX + name, "").strip()
    return value or default


def read_int(name: str, default: int) -> int:
    value = read_text(name)
    return default if value is None else int(value)


def read_bool(name: str, default: bool) -> bool:
    value = read_text(name)
    return default if value is None else value.lower() in ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Settings:
    """source: json, jdbc, parquet or rest. limit: rows to load (None: all; 0: none from JSON, all from a database). pool: candidates per query."""

    source: str = "json"
    path: str | None = None
    jdbc_url: str | None = None
    jdbc_user: str | None = None
    jdbc_password: str | None = None
    limit: int | None = None
    include_comments: bool = True
    comment_limit: int = 5
    #: Connections that read a database table; it is cut by ranges of its id.
    partitions: int = 8
    pool: int = 250
    results_dir: str = "results"
    #: Whether the loss curves of fitted networks are written, to <results_dir>/diagnostics.
    diagnostics: bool = True

    @classmethod
    def from_env(cls) -> "Settings":
        limit = read_text("LIMIT")
        return cls(
            source=read_text("SOURCE", "json"), path=read_text("PATH"), jdbc_url=read_text("JDBC_URL"), jdbc_user=read_text("JDBC_USER"), jdbc_password=read_text("JDBC_PASSWORD"),
            limit=None if limit is None else int(limit), include_comments=read_bool("INCLUDE_COMMENTS", True), comment_limit=read_int("COMMENT_LIMIT", 5), partitions=read_int("PARTITIONS", 8), pool=read_int("POOL", 250), results_dir=read_text("RESULTS_DIR", "results"),
            diagnostics=read_bool("DIAGNOSTICS", True),
        )

    def with_overrides(self, **given) -> "Settings":
        return replace(self, **{k: v for k, v in given.items() if v is not None})
