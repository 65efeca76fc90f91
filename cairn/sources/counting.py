"""A file that counts what is read through it, and stops at a byte cap."""

from __future__ import annotations

import io

from ..functions import fixed


class CapPassed(RuntimeError):
    """More bytes were read than the cap allows."""


class CountedFile(io.RawIOBase):
    """``file`` with ``requests`` and ``bytes`` of its reads; every read that returns data is one request.

    ``cap`` is looked at after a read, so the read that passes it is counted and then raises.
    """

    def __init__(self, file, cap: int | None = None):
        super().__init__()
        self.file, self.cap, self.requests, self.bytes = file, cap, 0, 0

    def _count(self, n: int) -> None:
        if n:
            self.requests += 1
            self.bytes += n
        if self.cap is not None and self.bytes > self.cap:
            raise CapPassed(f"byte cap {self.cap} passed ({self.bytes})")

    def read(self, size: int | None = -1) -> bytes:
        data = self.file.read() if size is None or size < 0 else self.file.read(size)
        self._count(len(data))
        return data

    def readall(self) -> bytes:
        return self.read()

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        self._count(len(data))
        return len(data)

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.file.seek(offset, whence)
        return self.file.tell()

    def tell(self) -> int:
        return self.file.tell()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def close(self) -> None:
        if not self.closed:
            self.file.close()
        super().close()


def opened(path: str, cap: int | None = None) -> CountedFile:
    """A local path or an address that Arrow's filesystems know, counted."""
    from .parquet_footer import _filesystem

    store, inner = _filesystem(path)
    return CountedFile(store.open_input_file(inner), cap)


def is_auth_error(error: BaseException) -> bool:
    """Whether the text of an error says that the request was refused or led to a sign-in page."""
    text = str(error).lower()
    return any(marker in text for marker in (*fixed.LOGIN_MARKERS, *fixed.AUTH_MARKERS))
