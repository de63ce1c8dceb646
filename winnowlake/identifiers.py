"""Names of datasets and files; a class of one's own is named by the configuration."""

from __future__ import annotations

import importlib
from urllib.parse import urlsplit

from .config import IDENTIFIER, Conf


class Identifier:
    def table_identifier(self, uri: str) -> str:
        """A table name as it is; a path without its last slashes, with one form for local files."""
        if "://" not in uri and not uri.startswith(("/", "file:")):
            return uri
        parts = urlsplit(uri)
        if parts.scheme in ("", "file"):
            return "file:" + ("/" + parts.path.strip("/"))
        return uri.rstrip("/")

    def file_id(self, path: str, modified_ms: int) -> str:
        return f"{path}#{modified_ms}"

    def display_name(self, uri: str) -> str:
        return self.table_identifier(uri)


class ObjectStoreIdentifier(Identifier):
    """Bucket names without the service that serves them: cos://bucket.service/x is cos://bucket/x."""

    SCHEMES = ("cos", "s3d", "swift2d")

    def _plain(self, path: str) -> str:
        parts = urlsplit(path)
        if parts.scheme not in self.SCHEMES:
            return path
        return f"{parts.scheme}://{parts.netloc.split('.')[0]}{parts.path}"

    def table_identifier(self, uri: str) -> str:
        return super().table_identifier(self._plain(uri))

    def file_id(self, path: str, modified_ms: int) -> str:
        return super().file_id(self._plain(path), modified_ms)


def identifier(conf: Conf) -> Identifier:
    """What the configuration names; the default if that can't be loaded."""
    module, _, name = conf.of(IDENTIFIER).rpartition(".")
    try:
        return getattr(importlib.import_module(module), name)()
    except (ImportError, AttributeError, ValueError, TypeError):
        return Identifier()
