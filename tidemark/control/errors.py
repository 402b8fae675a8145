"""Typed errors with stable codes; ``retryable`` is None where it depends on the cause."""

from __future__ import annotations


class TidemarkError(Exception):
    code = "INTERNAL"
    retryable: bool | None = False

    def __init__(self, message: str = "", **details):
        super().__init__(message or self.code)
        self.details = details


def _kind(name: str, code: str, retryable: bool | None = False) -> type[TidemarkError]:
    return type(name, (TidemarkError,), {"code": code, "retryable": retryable})


# Code, and whether a retry can help.
CODES = {
    "VALIDATION_FAILED": False, "SERIALIZATION_FAILED": False, "CONNECTION_ERROR": True, "VERSION_CONFLICT": False, "HISTORY_UNAVAILABLE": False,
    "TRANSACTION_KEY_REUSE": False, "NOT_FOUND": False, "CHUNK_MISSING": False, "CHUNK_INTEGRITY": False, "MANIFEST_CORRUPT": False,
    "TRANSACTION_ROLLED_BACK": False, "TRANSACTION_FAULT": True, "TRANSACTION_HANDLE_INVALID": False, "LEASE_TIMEOUT": True, "LEASE_NOT_HELD": False,
    "LEASE_FAULT": False, "VERSION_UNSUPPORTED": False, "CORRUPT": False, "EXCLUSION_VIOLATION": False, "CLOCK_REGRESSION": None,
    "UNRECOGNIZED_POSTGRES_ERROR": False, "DURABILITY_CONTRACT_VIOLATION": False, "TRANSACTION_POOLER_DETECTED": False, "MIGRATION_LOCK_TIMEOUT": True,
    "BLOB_INTEGRITY": False, "BLOB_MISSING": False, "BLOCK_NOT_FOUND": False,
}
#: Codes that only the archive raises.
INTERNAL = frozenset({"BLOB_INTEGRITY", "BLOB_MISSING", "BLOCK_NOT_FOUND"})
ERRORS = {code: _kind("".join(w.title() for w in code.split("_")), code, retry) for code, retry in CODES.items()}

#: The error that a violated audit stands for.
AUDIT_CODES = {
    "overlap": "EXCLUSION_VIOLATION", "clock": "CLOCK_REGRESSION", "key_reuse": "TRANSACTION_KEY_REUSE", "density": "MANIFEST_CORRUPT", "manifest_hash": "MANIFEST_CORRUPT",
    "chunk_missing": "CHUNK_MISSING", "chunk_hash": "CHUNK_INTEGRITY", "blob_missing": "BLOB_MISSING", "blob_hash": "BLOB_INTEGRITY", "block_missing": "BLOCK_NOT_FOUND",
}


def raise_error(code: str, message: str = "", **details):
    raise ERRORS[code](message, **details)


def of_audit(name: str, message: str = "", **details) -> TidemarkError:
    """The typed error of a violated audit."""
    return ERRORS[AUDIT_CODES.get(name, "UNRECOGNIZED_POSTGRES_ERROR")](message, **details)
