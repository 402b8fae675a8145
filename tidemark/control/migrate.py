"""Forward-only migrations: each applied once, in order, under a lease with a bound, recorded in a ledger."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from .commit import Log, Transaction
from .errors import ERRORS, raise_error
from .lease import Leases

LEDGER = "name string, position long"


def namespace(name: str) -> str:
    """A checked namespace: a letter or underscore, then letters, digits and underscores, at most 63 bytes."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{0,62}", name):
        raise_error("VALIDATION_FAILED", f"not a namespace: {name!r}")
    return name


def applied(log: Log) -> DataFrame:
    return log.read("_migrations", LEDGER)


def migrate(log: Log, leases: Leases, steps: Sequence[tuple[str, Callable[[Transaction], None]]], timeout: float = 30.0) -> list[str]:
    """Names of the steps applied now; steps applied before must be a prefix of ``steps``."""
    try:
        lease = leases.acquire("migrations", timeout)
    except ERRORS["LEASE_TIMEOUT"]:
        raise_error("MIGRATION_LOCK_TIMEOUT", "migrations are running elsewhere")
    try:
        done = [r.name for r in applied(log).orderBy("position").collect()]
        names = [n for n, _ in steps]
        if names[: len(done)] != done:
            raise_error("VALIDATION_FAILED", "migrations only go forward", applied=done)
        for position, (name, step) in enumerate(steps[len(done) :], len(done)):
            with log.transaction(migration=name) as tx:
                step(tx)
                tx.append("_migrations", log.spark.createDataFrame([(name, position)], LEDGER))
        return names[len(done) :]
    finally:
        leases.release(lease)
