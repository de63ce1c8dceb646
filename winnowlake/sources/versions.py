"""Layout of the metadata table: column names, schema metadata, versions.

Version 4 is written. 1 lacks name lengths, 2 keeps parameters as `k:v` strings, 3 lacks partition
columns; their min/max and value-list columns are read and are rewritten by a refresh. Bloom filters
of those versions were stored in another form and are dropped.
"""

from __future__ import annotations

from enum import Enum
from typing import Any

VERSION, LEAST_VERSION, PARTITIONS_SINCE = 4, 1, 4
OBJ_NAME = "obj_name"


class Status(Enum):
    CURRENT = "CURRENT"
    DEPRECATED_SUPPORTED = "DEPRECATED_SUPPORTED"
    DEPRECATED_UNSUPPORTED = "DEPRECATED_UNSUPPORTED"
    TOO_NEW = "TOO_NEW"


def status(version: int) -> Status:
    if version > VERSION:
        return Status.TOO_NEW
    if version == VERSION:
        return Status.CURRENT
    return Status.DEPRECATED_SUPPORTED if version >= LEAST_VERSION else Status.DEPRECATED_UNSUPPORTED


def escaped(name: str) -> str:
    return name.replace("#", "##").replace(".", "$#$")


def column_name(cols: tuple[str, ...], index: str, version: int = VERSION) -> str:
    """Of the metadata column of an index."""
    names = [escaped(c) for c in cols]
    if version < LEAST_VERSION or version > VERSION:
        raise ValueError(f"no such version: {version}")
    head = "_".join(names) + "_" + index
    return head if version == 1 else f"{head}_{'-'.join(str(len(n)) for n in names)}"


def virtual(name: str) -> str:
    return f"virtual_{escaped(name)}"


def params_of(raw: Any) -> dict[str, str]:
    """Parameters as a map, whatever the version."""
    if isinstance(raw, dict):
        return {k: str(v) for k, v in raw.items()}
    return dict(p.split(":", 1) for p in raw or [] if ":" in p)


def index_of(field_metadata: dict[str, Any]) -> dict[str, Any] | None:
    found = field_metadata.get("index")
    if not found:
        return None
    out = {"name": found["name"], "cols": list(found["cols"]), "params": params_of(found.get("params"))}
    return out | ({"key_metadata": found["key_metadata"]} if found.get("key_metadata") else {})
