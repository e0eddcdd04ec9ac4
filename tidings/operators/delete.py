"""Deletion of one source's notices before they are collected again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.operators.sources import require_known
from tidings.sources.store import written


@dataclass(frozen=True)
class DeleteResult:
    version: int
    deleted: int
    blocked: int


@dataclass(frozen=True)
class Deletion:
    """``kept`` is the table afterwards, ``deleted`` the rows that go, ``blocked`` the rows
    that would go but are referenced; blocked rows are part of ``kept``."""

    kept: DataFrame
    deleted: DataFrame
    blocked: DataFrame


def delete_range(
    rows: DataFrame,
    source_column: str,
    source,
    time_column: str,
    before=None,
    after=None,
    references: DataFrame | None = None,
    key: str = "id",
) -> Deletion:
    """Delete rows of one source, optionally only those strictly before and strictly after.

    ``references`` holds the key of rows other tables point to.
    """
    hit = F.col(source_column) == F.lit(source)
    kind = rows.schema[time_column].dataType  # bounds are read as what the column holds
    if before is not None:
        hit = hit & (F.col(time_column) < F.lit(before).cast(kind))
    if after is not None:
        hit = hit & (F.col(time_column) > F.lit(after).cast(kind))
    hit = F.coalesce(hit, F.lit(False))
    chosen = rows.filter(hit)
    kept = rows.filter(~hit)
    if references is None:
        return Deletion(kept, chosen, chosen.limit(0))
    used = references.select(key)
    blocked = chosen.join(used, key, "left_semi")
    return Deletion(kept.unionByName(blocked), chosen.join(used, key, "left_anti"), blocked)


def delete_from_store(
    store, source: str, sites, before=None, after=None, references: DataFrame | None = None
) -> DeleteResult:
    """Delete one source's notices, by their time of creation, from a stored table.

    A source without rules is refused. The rows left become a new version of that source;
    other sources are not read.
    """
    require_known(source, sites)
    base = store.state()
    parts = store.parts_of_sources(base, [source])
    stored = store.read_parts(base, parts)
    gone = delete_range(stored, "source_code", source, "created_at", before, after, references)
    deleted, blocked = gone.deleted.count(), gone.blocked.count()
    version = store.replace(gone.kept, parts, base, sources=written([source]))
    return DeleteResult(version, deleted, blocked)
