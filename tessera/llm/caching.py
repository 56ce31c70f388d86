"""Caches of results per distinct key, bounded in bytes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

#: Bytes that the caches of one Python worker may hold together, by default; entries are
#: reckoned with some reserve, so about three quarters of it are used.
CACHE_BYTES = 256 << 20
#: Bytes of a dictionary's slot for one entry, growth included.
SLOT_BYTES = 60


class GenerationCache(dict):
    """``cache[key]`` makes and keeps what is missing, in at most ``limit`` bytes.

    ``size`` tells the bytes of a key and its value.  When half the limit is held, what
    is held becomes the older generation, from which keys still in use move back and
    rare ones go.  An entry of more than a 64th of the limit is made anew every time.
    """

    def __init__(self, make: Callable, limit: int, size: Callable[[object, object], int]):
        super().__init__()
        self.make, self.size, self.half, self.largest = make, size, limit // 2, limit // 64
        self.older: dict = {}
        self.held = 0

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        size = SLOT_BYTES + self.size(key, value)
        if size > self.largest:
            return value
        if self.held + size > self.half:
            self.older = {}
            self.older = dict(self)
            self.clear()
            self.held = 0
        self.held += size
        self[key] = value
        return value


class BytesCache(GenerationCache):
    """A ``GenerationCache`` of bytes by bytes or texts, which are reckoned without a call."""

    #: Two objects of 33 to 49 bytes, rounded up, and their slot.
    FIXED = 82 + SLOT_BYTES

    def __init__(self, make: Callable[[bytes | str], bytes], limit: int):
        super().__init__(make, limit, lambda key, value: 82 + len(key) + len(value))

    def __missing__(self, key: bytes | str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        size = len(key) + len(value) + self.FIXED
        if size > self.largest:
            return value
        held = self.held + size
        if held > self.half:
            self.older = {}
            self.older = dict(self)
            self.clear()
            held = size
        self.held = held
        self[key] = value
        return value


_tables: dict[str, dict] = {}


def owned(name: str) -> dict:
    """The process-wide table of one operator (codecs with their caches).

    Python workers are reused from stage to stage; taking one operator's table drops
    the others', so a worker holds the caches of one operator only.
    """
    if name not in _tables:
        _tables.clear()
        _tables[name] = {}
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:  # hand what the operator before has freed back to the system
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass
    return _tables[name]
