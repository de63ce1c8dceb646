"""Typed configuration. A value that can't be parsed or isn't valid gives the default, never an error."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

PREFIX = "winnowlake."


def _bool(x: Any) -> bool:
    if isinstance(x, bool):
        return x
    return {"true": True, "false": False}[str(x).strip().lower()]


@dataclass(frozen=True)
class Entry:
    key: str
    default: Any
    parse: Callable[[Any], Any]
    valid: Callable[[Any], bool] = lambda _: True
    doc: str = ""

    def of(self, values: Mapping[str, Any]) -> Any:
        if self.key not in values:
            return self.default
        try:
            got = self.parse(values[self.key])
        except (ValueError, KeyError, TypeError):
            return self.default
        return got if self.valid(got) else self.default


ENTRIES: dict[str, Entry] = {}


def _entry(name: str, default: Any, parse: Callable[[Any], Any], valid: Callable[[Any], bool] = lambda _: True, doc: str = "") -> Entry:
    e = Entry(PREFIX + name, default, parse, valid, doc)
    ENTRIES[e.key] = e
    return e


_positive, _fraction = (lambda n: n > 0), (lambda x: 0 < x < 1)
LOCATION_TYPES = ("EXPLICIT_LOCATION", "EXPLICIT_BASE_PATH_LOCATION", "HIVE_TABLE_NAME", "HIVE_DB_NAME")

EVALUATION = _entry("evaluation.enabled", False, _bool, doc="only report what would be skipped; indexed relations give no rows")
PARALLELISM = _entry("index.parallelism", 10, int, _positive, "kept for callers; a build is one distributed job")
MIN_CHUNK = _entry("index.minchunksize", 1, int, _positive, "kept for callers; a build is one distributed job")
BLOOM_FPP = _entry("index.bloom.fpp", 0.01, float, _fraction, "false positive probability of a bloom filter")
BLOOM_NDV = _entry("index.bloom.ndv", 100_000, int, _positive, "expected distinct values of a bloom filter")
FOOTERS = _entry("index.minmax.readoptimized.parquet", True, _bool, "kept for callers; see README")
FOOTER_PARALLELISM = _entry("index.minmax.readoptimized.parquet.parallelism", 10_000, int, _positive)
IN_THRESHOLD = _entry("index.minmax.inFilterThreshold", 10, int, _positive, "values from which IN is checked by its range")
TIMEOUT = _entry("timeout", 10, int, _positive, "minutes that the metadata query may take")
MEMORY_FRACTION = _entry("index.memoryFraction", 0.2, float, _fraction)
IDENTIFIER = _entry("identifierclass", "winnowlake.identifiers.Identifier", str)
STORE = _entry("metadatastore", "parquet", str, doc="name of the store, as registered")
LOCATION = _entry("parquet.mdlocation", "", str)
LOCATION_TYPE = _entry("parquet.mdlocation.type", "EXPLICIT_BASE_PATH_LOCATION", str, lambda x: x in LOCATION_TYPES)
CHUNK = _entry("parquet.index.chunksize", 25_000, int, _positive, "most files whose metadata one task writes")
MAX_RECORDS = _entry("parquet.maxRecordsPerMetadataFile", 50_000, int, _positive)
MAX_FILE_BYTES = _entry("parquet.maxMetadataFileSize", 32 << 20, int, _positive)
REFRESH_DEDUP = _entry("parquet.refresh.dedup", True, _bool)
FILTER_DEDUP = _entry("parquet.filter.dedup", False, _bool)
FOOTER_KEY = _entry("parquet.encryption.footer.key", "", str)
PLAIN_FOOTER = _entry("parquet.encryption.plaintext.footer", False, _bool)


class Conf:
    """A map of strings with typed reads; `parent` gives what is not set here."""

    def __init__(self, parent: Conf | None = None):
        self.parent, self.values = parent, {}

    def set(self, key: str, value: Any) -> None:
        self.values[key] = str(value)

    def set_all(self, values: Mapping[str, Any]) -> None:
        for k, v in values.items():
            self.set(k, v)

    def unset(self, key: str) -> None:
        self.values.pop(key, None)

    def clear(self) -> None:
        self.values.clear()

    def merged(self) -> dict[str, str]:
        return (self.parent.merged() if self.parent else {}) | self.values

    def get(self, key: str) -> str:
        """As text: the value that is set, else the entry's default, else the empty string."""
        found = self.merged()
        if key in found:
            return found[key]
        return str(ENTRIES[key].default) if key in ENTRIES else ""

    def of(self, entry: Entry) -> Any:
        return entry.of(self.merged())
