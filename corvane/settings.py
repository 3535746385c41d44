"""Validated settings. Each value out of range is an error when the object is made."""

from __future__ import annotations

import math
import os
import re
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from uuid import UUID

from corvane.errors import InvalidDocument, InvalidFilter, InvalidQuery, InvalidSettings

# Defaults and ceilings.
CONTENT_TYPES = ("application/json", "text/markdown", "text/plain")
MAX_CANDIDATES, MAX_FINAL, MAX_QUERY_BYTES, MAX_FILTER_VALUES = 500, 100, 8192, 100
MAX_WEIGHT, MAX_RRF_K, MAX_VARIANTS = 16.0, 1_000_000.0, 8
MAX_DOCUMENT_BYTES, MAX_CHUNK_SIZE = 10 * 1024 * 1024, 1_048_576
MAX_HOPS, MAX_FRONTIER, MAX_EDGES = 3, 200, 500
MAX_SEED_NAME_BYTES, MAX_RELATION_BYTES = 512, 128
MAX_EVIDENCE_TOKENS, MAX_OUTPUT_TOKENS = 16_384, 4_096
MIN_EXTRACTION_BYTES, MAX_ENTITIES, MAX_RELATIONS = 40, 32, 64


def _check(ok: bool, message: str, kind: type[Exception] = InvalidSettings) -> None:
    if not ok:
        raise kind(message)


@dataclass(frozen=True)
class RetrievalSettings:
    candidate_limit: int = 32
    final_limit: int = 8
    query_max_bytes: int = 8192
    max_document_ids: int = 100
    max_content_types: int = 16
    vector_weight: float = 1.0
    bm25_weight: float = 1.0
    graph_weight: float = 1.0
    rrf_k: float = 60.0

    def __post_init__(self) -> None:
        _check(1 <= self.candidate_limit <= MAX_CANDIDATES, f"candidate_limit must be from 1 to {MAX_CANDIDATES}")
        _check(1 <= self.final_limit <= MAX_FINAL, f"final_limit must be from 1 to {MAX_FINAL}")
        _check(self.final_limit <= self.candidate_limit, "final_limit must not exceed candidate_limit")
        _check(1 <= self.query_max_bytes <= MAX_QUERY_BYTES, f"query_max_bytes must be from 1 to {MAX_QUERY_BYTES}")
        _check(1 <= self.max_document_ids <= MAX_FILTER_VALUES, f"max_document_ids must be from 1 to {MAX_FILTER_VALUES}")
        _check(1 <= self.max_content_types <= MAX_FILTER_VALUES, f"max_content_types must be from 1 to {MAX_FILTER_VALUES}")
        for name in ("vector_weight", "bm25_weight", "graph_weight"):
            w = getattr(self, name)
            _check(math.isfinite(w) and 0 <= w <= MAX_WEIGHT, f"{name} must be finite and from 0 to {MAX_WEIGHT}")
        _check(self.vector_weight > 0 or self.bm25_weight > 0, "one of vector_weight and bm25_weight must be above 0")
        k = self.rrf_k
        _check(math.isfinite(k) and 0 < k <= MAX_RRF_K and k == int(k), f"rrf_k must be a positive whole number up to {MAX_RRF_K:.0f}")


@dataclass(frozen=True)
class Bm25Settings:
    k1: float = 1.2
    b: float = 0.75
    content_boost: float = 1.0
    title_boost: float = 2.0
    section_boost: float = 1.5

    def __post_init__(self) -> None:
        _check(math.isfinite(self.k1) and self.k1 > 0, "k1 must be finite and above 0")
        _check(math.isfinite(self.b) and 0 <= self.b <= 1, "b must be from 0 to 1")
        for name in ("content_boost", "title_boost", "section_boost"):
            _check(math.isfinite(getattr(self, name)) and getattr(self, name) >= 0, f"{name} must be finite and not negative")


@dataclass(frozen=True)
class ChunkSettings:
    strategy: str
    size: int
    overlap: int

    STRATEGIES = ("fixed_size", "structure_aware")

    def __post_init__(self) -> None:
        _check(self.strategy in self.STRATEGIES, f"chunk_strategy must be one of {self.STRATEGIES}", InvalidDocument)
        _check(1 <= self.size <= MAX_CHUNK_SIZE, f"chunk_size must be from 1 to {MAX_CHUNK_SIZE}", InvalidDocument)
        _check(0 <= self.overlap < self.size, "chunk_overlap must be at least 0 and below chunk_size", InvalidDocument)

    @classmethod
    def parse(cls, metadata: dict[str, str]) -> ChunkSettings:
        """From the three required metadata keys."""
        for key in ("chunk_strategy", "chunk_size", "chunk_overlap"):
            _check(key in metadata, f"{key} is missing", InvalidDocument)
        try:
            return cls(metadata["chunk_strategy"], int(metadata["chunk_size"]), int(metadata["chunk_overlap"]))
        except ValueError as error:
            raise error if isinstance(error, InvalidDocument) else InvalidDocument(str(error)) from error


def document_uuid(value: str, kind: type[Exception] = InvalidFilter) -> str:
    """The canonical form of a version-4 UUID; anything else is an error."""
    try:
        found = UUID(value.strip())
    except ValueError as error:
        raise kind(f"{value!r} is no UUID") from error
    _check(found.version == 4, f"{value!r} is no version-4 UUID", kind)
    return str(found)


@dataclass(frozen=True)
class Filters:
    """Sorted distinct values; an empty tuple lets everything pass."""

    document_ids: tuple[str, ...] = ()
    content_types: tuple[str, ...] = ()

    @classmethod
    def normalise(cls, document_ids=(), content_types=(), settings: RetrievalSettings | None = None) -> Filters:
        """Trimmed, canonical and distinct; the limits hold for the distinct values."""
        settings = settings or RetrievalSettings()
        ids = tuple(sorted({document_uuid(v) for v in document_ids}))
        types = tuple(sorted({v.strip().lower() for v in content_types}))
        _check(len(ids) <= settings.max_document_ids, f"more than {settings.max_document_ids} document ids", InvalidFilter)
        for t in types:
            _check(t in CONTENT_TYPES, f"unknown content type {t!r}", InvalidFilter)
        _check(len(types) <= settings.max_content_types, f"more than {settings.max_content_types} content types", InvalidFilter)
        return cls(ids, types)


@dataclass(frozen=True)
class Query:
    text: str
    filters: Filters = Filters()

    @classmethod
    def normalise(cls, text: str, document_ids=(), content_types=(), settings: RetrievalSettings | None = None) -> Query:
        settings = settings or RetrievalSettings()
        trimmed = text.strip()
        _check(bool(trimmed), "the query is empty", InvalidQuery)
        _check(len(trimmed.encode()) <= settings.query_max_bytes, f"the query has more than {settings.query_max_bytes} bytes", InvalidQuery)
        return cls(trimmed, Filters.normalise(document_ids, content_types, settings))


def hop_limit(requested: int, configured: int = MAX_HOPS) -> int:
    """A number of hops within the ceiling; 0 or more than that is an error, never a default."""
    ceiling = min(MAX_HOPS, configured)
    _check(1 <= requested <= ceiling, f"hops must be from 1 to {ceiling}")
    return requested


def bounded(value: str, most: int, name: str) -> str:
    _check(len(value.encode()) <= most, f"{name} has more than {most} bytes", InvalidQuery)
    return value


@dataclass(frozen=True)
class GroundingLimits:
    evidence_tokens: int = 8192
    output_tokens: int = 2048
    allow_model_only: bool = False

    def __post_init__(self) -> None:
        _check(1 <= self.evidence_tokens <= MAX_EVIDENCE_TOKENS, f"evidence_tokens must be from 1 to {MAX_EVIDENCE_TOKENS}")
        _check(1 <= self.output_tokens <= MAX_OUTPUT_TOKENS, f"output_tokens must be from 1 to {MAX_OUTPUT_TOKENS}")

    @property
    def total_tokens(self) -> int:
        return self.evidence_tokens + self.output_tokens


@dataclass(frozen=True)
class Timeouts:
    """Milliseconds of each step."""

    reformulate: int = 5_000
    embedding: int = 10_000
    retrieve: int = 10_000
    graph_operation: int = 4_000
    graph: int = 15_000
    assemble: int = 2_000
    generate: int = 65_000
    provider: int = 30_000

    def __post_init__(self) -> None:
        for f in fields(self):
            _check(getattr(self, f.name) > 0, f"{f.name} must be above 0")
        _check(self.graph >= self.embedding + self.graph_operation, "graph must cover embedding and graph_operation")
        _check(self.generate >= 2 * self.provider, "generate must cover two provider calls")


@dataclass(frozen=True)
class GraphSettings:
    hops: int = MAX_HOPS
    seed_match_min_score: float = 0.5

    def __post_init__(self) -> None:
        _check(1 <= self.hops <= MAX_HOPS, f"hops must be from 1 to {MAX_HOPS}")
        _check(0 <= self.seed_match_min_score <= 1, "seed_match_min_score must be from 0 to 1")


@dataclass(frozen=True)
class Settings:
    retrieval: RetrievalSettings = field(default_factory=RetrievalSettings)
    bm25: Bm25Settings = field(default_factory=Bm25Settings)
    grounding: GroundingLimits = field(default_factory=GroundingLimits)
    timeouts: Timeouts = field(default_factory=Timeouts)
    graph: GraphSettings = field(default_factory=GraphSettings)
    allow_model_only: bool = False
    citation_repair: bool = True
    excerpt_chars: int = 512

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None, prefix: str = "CORVANE") -> Settings:
        """From TOML, then from variables such as CORVANE__RETRIEVAL__FINAL_LIMIT.

        A number that can't be read in a variable is ignored; a truth value that can't be read is an error.
        """
        data = tomllib.loads(Path(path).read_text()) if path else {}
        settings = cls()
        for f in fields(cls):
            part = getattr(settings, f.name)
            if f.name in data:
                part = replace(part, **data[f.name]) if isinstance(data[f.name], dict) else data[f.name]
            settings = replace(settings, **{f.name: part})
        for key, raw in (os.environ if env is None else env).items():
            names = re.fullmatch(rf"{prefix}__(?:(\w+?)__)?(\w+)", key)
            if not names:
                continue
            section, name = (names[1] or "").lower(), names[2].lower()
            owner = getattr(settings, section, None) if section else settings
            if owner is None or not hasattr(owner, name):
                continue
            old = getattr(owner, name)
            if isinstance(old, bool):
                _check(raw.strip().lower() in ("true", "false", "1", "0"), f"{key} must be true or false")
                new: object = raw.strip().lower() in ("true", "1")
            else:
                try:
                    new = type(old)(raw)
                except ValueError:
                    continue
            owner = replace(owner, **{name: new})
            settings = replace(settings, **{section: owner}) if section else owner
        return settings
