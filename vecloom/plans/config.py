"""Enumerations, configuration objects, presets and errors."""

from __future__ import annotations

import enum
import json
from dataclasses import asdict, dataclass, field, fields


class Metric(str, enum.Enum):
    L2 = "l2"
    IP = "ip"
    COSINE = "cosine"
    L1 = "l1"
    HAMMING = "hamming"


class IndexType(str, enum.Enum):
    FLAT = "flat"
    AUTO = "auto"
    IVF = "ivf"
    IVF_SQ = "ivf_sq"
    IVF_PQ = "ivf_pq"
    HNSW = "hnsw"
    HNSW_SQ = "hnsw_sq"
    HNSW_PQ = "hnsw_pq"


class VecloomError(Exception):
    """Base of all errors; code is the status number."""

    code = -1


class InvalidParameter(VecloomError, ValueError):
    code = -2


class NotFound(VecloomError, KeyError):
    code = -4


class AlreadyExists(VecloomError):
    code = -5


class IndexNotReady(VecloomError):
    code = -6


class NotSupported(VecloomError, NotImplementedError):
    code = -7


class Conflict(VecloomError):
    """Another writer changed the collection in the meantime; nothing was written."""


#: What each status means.
MESSAGES = {0: "success", -1: "error", -2: "invalid parameter", -4: "not found", -5: "already exists", -6: "index not ready", -7: "not supported"}


def error_message(code: int) -> str:
    return MESSAGES.get(code, "unknown error")


@dataclass
class IndexConfig:
    type: IndexType = IndexType.FLAT
    nlist: int = 16
    nprobe: int = 3
    max_iter: int = 20
    tolerance: float = 1e-4
    seed: int = 42
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 100
    shards: int = 1
    nsub: int = 8
    nbits: int = 8

    def __post_init__(self):
        self.type = IndexType(self.type)
        if self.nlist < 1 or self.nprobe < 1:
            raise InvalidParameter("nlist and nprobe must be positive")
        self.m = self.m if self.m >= 2 else 16
        if not 1 <= self.nbits <= 8:
            raise InvalidParameter("nbits must be from 1 to 8")

    def to_dict(self) -> dict:
        return asdict(self) | {"type": self.type.value}


@dataclass
class CollectionConfig:
    name: str
    dim: int
    metric: Metric = Metric.L2
    index: IndexConfig = field(default_factory=IndexConfig)
    max_vid: int = 10_000_000

    def __post_init__(self):
        self.metric = Metric(self.metric)
        if isinstance(self.index, dict):
            self.index = IndexConfig(**self.index)
        if self.dim < 1:
            raise InvalidParameter("dim must be positive")
        if not self.name or "/" in self.name or self.name.startswith("."):
            raise InvalidParameter(f"not a collection name: {self.name!r}")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> CollectionConfig:
        return cls(**json.loads(text))


#: Named graph settings.
PRESETS = {
    "low_memory": {"m": 16, "ef_construction": 100, "ef_search": 50},
    "high_performance": {"m": 32, "ef_construction": 200, "ef_search": 100},
    "embedded": {"m": 8, "ef_construction": 50, "ef_search": 32},
}


def preset(name: str) -> IndexConfig:
    if name not in PRESETS:
        raise NotFound(name)
    return IndexConfig(type=IndexType.HNSW, **PRESETS[name])


class Settings:
    """Nested settings read and written by dotted keys."""

    def __init__(self, values: dict | None = None):
        self.values = values or {}

    @classmethod
    def load(cls, path: str) -> Settings:
        with open(path) as f:
            return cls(json.load(f))

    def dump(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(self.values, f)

    def get(self, key: str, default=None, kind: type | None = None):
        at = self.values
        for part in key.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return kind(at) if kind else at

    def has(self, key: str) -> bool:
        missing = object()
        return self.get(key, missing) is not missing

    def set(self, key: str, value) -> None:
        *parents, last = key.split(".")
        at = self.values
        for part in parents:
            at = at.setdefault(part, {})
        at[last] = value

    def collection(self, name: str) -> CollectionConfig:
        own = dict(self.get(f"collections.{name}", {}))
        index = {k: v for k, v in own.pop("index", {}).items() if k in {f.name for f in fields(IndexConfig)}}
        return CollectionConfig(name=name, index=IndexConfig(**index), **own)


#: From so many rows on, AUTO prefers an index over the exact scan.
AUTO_ROWS = 50_000


def access_path(config: IndexConfig, rows: int, indexed: bool) -> IndexType:
    """The way that a search takes: the built index if there is one, else the exact scan."""
    if not indexed or config.type is IndexType.FLAT:
        return IndexType.FLAT
    if config.type is IndexType.AUTO:
        return IndexType.IVF if rows >= AUTO_ROWS else IndexType.FLAT
    return config.type
