"""Identities of tables, names of indexes, and names that are safe in paths and SQL."""

from __future__ import annotations

import re
import uuid

# They make the names of indexes.
INDEX_NAMESPACE = uuid.UUID("3f2a6c1e-7d54-4b98-9a0f-6c5d2e8b41a7")
INDEX_PREFIX, INDEX_LONGEST, INDEX_DIGEST = "ix_", 63, 16


def identity(table: str | tuple[str, ...] | list[str]) -> tuple[str, ...]:
    """The ordered components of a table's identity: a sequence is taken as it is, a text is parted at
    each dot, and empty components stay."""
    return tuple(table.split(".")) if isinstance(table, str) else tuple(table)


def index_physical_name(table: str | tuple[str, ...] | list[str], index: str) -> str:
    """A name for a logical index of a table: lower case, at most 63 characters, and different for
    identities that would look alike once joined, since the digest knows where each part ends."""
    parts = identity(table)
    known = "".join(f"{len(x)}:{x}" for x in (str(len(parts)), *parts, index))
    digest = uuid.uuid5(INDEX_NAMESPACE, known).hex[:INDEX_DIGEST]
    slug = re.sub(r"[^a-z0-9]+", "_", f"{'.'.join(parts)}_{index}".lower()).strip("_")
    room = INDEX_LONGEST - len(INDEX_PREFIX) - 1 - INDEX_DIGEST
    slug = slug[-room:].lstrip("_")
    return f"{INDEX_PREFIX}{slug}_{digest}" if slug else f"{INDEX_PREFIX}{digest}"


def path_name(name: str) -> str:
    """A name as one component of a path: a letter, then the name with whatever isn't a letter of ASCII,
    a digit or _ as its code between dashes. Different names give different components."""
    return "t" + re.sub(r"[^A-Za-z0-9_]", lambda m: f"-{ord(m[0]):x}-", name)


def quoted(column: str) -> str:
    """A column name for Spark SQL."""
    return "`" + column.replace("`", "``") + "`"


def random_id() -> str:
    """A new identifier that begins with a letter."""
    return "a" + uuid.uuid4().hex
