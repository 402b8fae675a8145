"""Single-holder leases by lock files: blocking, timed and non-blocking; never stolen, freed when the holder ends."""

from __future__ import annotations

import fcntl
import hashlib
import os
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field

from .errors import raise_error


@dataclass
class Lease:
    key: str
    token: str
    acquired_at: float
    _file: object = field(repr=False, default=None)


class Leases:
    """Leases of one folder on the driver's host."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def try_acquire(self, key: str) -> Lease | None:
        """The lease, or None while another holds it."""
        if not key:
            raise_error("VALIDATION_FAILED", "a lease needs a key")
        handle = open(os.path.join(self.folder, hashlib.sha256(key.encode()).hexdigest()), "a")  # noqa: SIM115
        try:
            fcntl.flock(handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            handle.close()
            return None
        except OSError as fault:
            handle.close()
            raise_error("LEASE_FAULT", str(fault))
        return Lease(key, uuid.uuid4().hex, time.time(), handle)

    def acquire(self, key: str, timeout: float | None = None, poll: float = 0.02) -> Lease:
        until = None if timeout is None else time.monotonic() + timeout
        while (got := self.try_acquire(key)) is None:
            if until is not None and time.monotonic() >= until:
                raise_error("LEASE_TIMEOUT", f"{key} is held by another")
            time.sleep(poll)
        return got

    def release(self, lease: Lease) -> None:
        if lease._file is None or lease._file.closed:
            raise_error("LEASE_NOT_HELD", lease.key)
        lease._file.close()

    @contextmanager
    def held(self, key: str, timeout: float | None = None):
        """Holds a lease for a block; a fault of both the block and the release is raised as a group."""
        lease = self.acquire(key, timeout)
        try:
            yield lease
        except BaseException as fault:
            try:
                self.release(lease)
            except Exception as second:
                raise BaseExceptionGroup("block and release failed", [fault, second]) from None
            raise
        self.release(lease)
