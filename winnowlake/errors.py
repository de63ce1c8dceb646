"""What goes wrong, and the texts for it."""

from __future__ import annotations


class SkipError(Exception):
    pass


INDEX_NOT_FOUND = "dataset is not indexed"
ALREADY_INDEXED = "dataset is already indexed; use refresh, or drop the index first"
NO_INDEXES = "no index was asked for"
DUPLICATE = "the same index was asked for twice: {0}"
NO_COLUMN = "column {0} doesn't exist"
PARTITION_COLUMN = "column {0} is a partition column; those can't be indexed"
BAD_TYPE = "index {0} doesn't take column {1} of type {2}"
GLOB = "a path with glob characters can't be indexed: {0}"
VIEW = "a view can't be indexed: {0}"
NOT_PARTITIONED = "a table without partition columns can't be indexed by name; index its location: {0}"
NO_TABLE = "no such table: {0}"
BAD_ID = "a table is named <db>.<table> or <table>: {0}"
BAD_SCHEMA = "column names with a dot can't be indexed: {0}"
NO_ENCRYPTION = "the metadata store doesn't support encryption"
NO_FOOTER_KEY = "an index has a key but the footer key isn't set"
NOT_FILES = "the dataset isn't read from files by a V1 source"
TOO_NEW = "metadata of version {0} is newer than this library reads"
TOO_OLD = "metadata of version {0} is no longer supported; drop the index and build it anew"
NO_LOCATION = "no metadata location is set"
