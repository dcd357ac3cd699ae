"""Index profiles: a root, the types to index and the place of the index; kept as JSON."""

from __future__ import annotations

import json
import logging
import os
import uuid
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from gleanwork import catalog
from gleanwork.sources import storage

log = logging.getLogger(__name__)
DEFAULT_MAX_BYTES = 200 * 1024 * 1024


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


@dataclass
class Profile:
    name: str
    root_path: str
    storage_path: str
    included_extensions: list[str] = field(default_factory=lambda: list(catalog.EXTENSIONS))
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    incremental_enabled: bool = True
    max_content_bytes: int = DEFAULT_MAX_BYTES
    ocr_enabled: bool = False
    created_at: str = field(default_factory=_now)
    last_updated_at: str | None = None
    status: str = "Building"
    file_count: int = 0
    total_size_bytes: int = 0

    @classmethod
    def create(cls, name: str, root_path: str, storage_path: str, extensions: list[str] | None = None, max_mb: str | int = "200", **more) -> Profile:
        """A checked new profile. A size that isn't a positive number is 200 MB."""
        extensions = list(catalog.EXTENSIONS) if extensions is None else [e.lstrip(".").lower() for e in extensions]
        if not (name.strip() and root_path.strip() and storage_path.strip()):
            raise ValueError("name, root and storage must not be blank")
        if not extensions:
            raise ValueError("at least one file type is needed")
        try:
            mb = int(max_mb)
        except ValueError:
            mb = 200
        return cls(name.strip(), root_path.strip(), storage_path.strip(), extensions, max_content_bytes=(mb if mb > 0 else 200) * 1024 * 1024, **more)


def normalize(path: str) -> str:
    """For comparing places: absolute, without closing slashes, whatever the case."""
    return (path if "://" in path else os.path.abspath(path)).rstrip("/\\").lower()


def evaluate_status(root_exists: bool, index_exists: bool, file_count: int) -> str:
    if root_exists:
        return "Ok" if index_exists and file_count > 0 else "NeedsUpdate"
    return "SourceUnavailable"


class ProfileStore:
    """A registry of storage paths and a profile.json in each."""

    def __init__(self, spark: SparkSession, registry_path: str):
        self.spark, self.registry_path = spark, registry_path

    def registry(self) -> list[str]:
        """The registered paths; none where the registry is missing or broken."""
        try:
            found = json.loads(storage.read_text(self.spark, self.registry_path) or "[]")
        except ValueError:
            return []
        return [p for p in found if isinstance(p, str)] if isinstance(found, list) else []

    def load(self, storage_path: str) -> Profile | None:
        """The profile at a place, or None. Its storage path is where it was found."""
        try:
            raw = json.loads(storage.read_text(self.spark, f"{storage_path}/profile.json") or "null")
            known = {k: v for k, v in raw.items() if k in Profile.__dataclass_fields__} if isinstance(raw, dict) else None
            return Profile(**known | {"storage_path": storage_path}) if known else None
        except (ValueError, TypeError):
            return None

    def load_all(self) -> tuple[list[Profile], list[str]]:
        """Profiles, and registered paths without one."""
        found = [(p, self.load(p)) for p in self.registry()]
        return [x for _, x in found if x], [p for p, x in found if not x]

    def save(self, profile: Profile) -> None:
        storage.write_text(self.spark, f"{profile.storage_path}/profile.json", json.dumps(asdict(profile), ensure_ascii=False, indent=1))
        paths = self.registry()
        if normalize(profile.storage_path) not in map(normalize, paths):
            self._write([*paths, profile.storage_path])

    def unregister(self, storage_path: str) -> None:
        """Forget a place; its data stay."""
        self._write([p for p in self.registry() if normalize(p) != normalize(storage_path)])

    def delete(self, profile: Profile) -> None:
        """Unregister and remove the index, never the root."""
        self.unregister(profile.storage_path)
        if normalize(profile.root_path).startswith(normalize(profile.storage_path) + "/") or normalize(profile.root_path) == normalize(profile.storage_path):
            log.warning("%s holds the root; it is kept", profile.storage_path)
            return
        try:
            storage.delete(self.spark, profile.storage_path)
        except Exception as e:  # an index in use is left behind, as it is no longer registered
            log.warning("%s was not removed: %s", profile.storage_path, e)

    def _write(self, paths: list[str]) -> None:
        storage.write_text(self.spark, self.registry_path, json.dumps(paths, ensure_ascii=False))
