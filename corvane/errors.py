"""Errors with the kind that callers tell apart."""

from __future__ import annotations


class EngineError(ValueError):
    """Base of all errors that a caller can act on."""


class InvalidSettings(EngineError):
    """A setting is out of its range."""


class InvalidQuery(EngineError):
    """A query is empty or too long."""


class InvalidFilter(EngineError):
    """A filter value is malformed, unknown or one too many."""


class InvalidDocument(EngineError):
    """A document or its chunk settings are malformed."""


class IndexBuildError(EngineError):
    """A row can't be indexed: the row, the field and the reason."""

    def __init__(self, row: object, field: str, reason: str):
        super().__init__(f"row {row}, field {field}: {reason}")
        self.row, self.field, self.reason = row, field, reason


class NonFiniteScore(EngineError):
    """A source gave a score that is not a finite number."""


class SchemaDrift(EngineError):
    """A stored table's schema isn't the declared one."""


class MissingTable(EngineError):
    """A declared table isn't there."""


class GraphLimitExceeded(EngineError):
    """A traversal met more edges or vertices than allowed."""


class NotFound(EngineError):
    """What was asked for isn't there."""


class EmptyEvidence(EngineError):
    """There is no evidence to pack."""


class NoEvidenceFits(EngineError):
    """The first evidence block is over the budget."""


class GroundingFailed(EngineError):
    """An answer breaks a grounding rule."""


class TimedOut(EngineError):
    """A step took longer than allowed; its jobs were cancelled."""


class QueueFull(EngineError):
    """There is no room for more; nothing was staged."""


class WriteNotSeen(EngineError):
    """What was written is not what a reader finds."""
