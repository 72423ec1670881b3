"""Errors of the engine."""

from __future__ import annotations


class QuiverineError(Exception):
    """Any error of the engine."""


class InvalidArgs(QuiverineError, ValueError):
    """Arguments, or the shape of the data they name, can't be used."""


class InvalidData(QuiverineError):
    """Stored data contradicts itself."""


class InvalidContext(QuiverineError):
    """An operation at a time when it can't be done."""


class VerificationFailure(QuiverineError):
    """Stored bytes do not have the digest that names them."""


class StorageError(QuiverineError, OSError):
    """Reading or writing failed."""
