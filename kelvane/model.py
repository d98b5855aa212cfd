"""Types shared by all modules: operations, conditions, options, errors and schemas."""

from __future__ import annotations

import enum
from dataclasses import dataclass, field

from pyspark.sql import types as T

# Limits of a record's fields.
MAX_KEY, MAX_VALUE, MAX_BATCH, OP_HEADER = 2**31 - 1, 2**32 - 1, 2**32 - 1, 8

#: One operation of the log. (seq, op_idx) orders it; ts is kept but decides nothing.
LOG_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType(), False), T.StructField("op_idx", T.IntegerType(), False),
    T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType()),
    T.StructField("tombstone", T.BooleanType(), False), T.StructField("ts", T.LongType(), False),
])


class StoreError(Exception):
    """Base of all errors; `code` is its name on the wire."""

    code, text = "Io", "io error"

    def __init__(self, text: str | None = None):
        super().__init__(text or self.text)


class AlreadyLocked(StoreError):
    code, text = "AlreadyLocked", "another handle holds the write lock of this store"


class EmptyKey(StoreError):
    code, text = "EmptyKey", "a key has at least one byte"


class KeyTooLarge(StoreError):
    code, text = "KeyTooLarge", "a key has 2^31 - 1 bytes at most"


class ValueTooLarge(StoreError):
    code, text = "ValueTooLarge", "a value has 2^32 - 1 bytes at most"


class ReadOnly(StoreError):
    code, text = "ReadOnly", "this handle only reads"


class Unordered(StoreError):
    code, text = "Unordered", "ranges of keys are for stores opened with KeyOrder.SORTED"


class BatchTooLarge(StoreError):
    code, text = "BatchTooLarge", "the operations of a batch have 2^32 - 1 bytes together at most"


class ConditionFailed(StoreError):
    code = "ConditionFailed"

    def __init__(self, index: int):
        super().__init__(f"check {index} of the batch does not hold; the batch wrote nothing")
        self.index = index


class CompactedAway(StoreError):
    code, text = "CompactedAway", "the log before that sequence number has been compacted"


class KeyOrder(enum.Enum):
    HASHED = "hashed"
    SORTED = "sorted"


class Direction(enum.Enum):
    FORWARD = "forward"
    REVERSE = "reverse"


@dataclass(frozen=True)
class Bound:
    """One end of a range; no key: unbounded."""

    key: bytes | None = None
    included: bool = True


UNBOUNDED = Bound()


def included(key: bytes) -> Bound:
    return Bound(key, True)


def excluded(key: bytes) -> Bound:
    return Bound(key, False)


@dataclass(frozen=True)
class Versioned:
    value: bytes
    version: int


@dataclass(frozen=True)
class Put:
    key: bytes
    value: bytes


@dataclass(frozen=True)
class Delete:
    key: bytes


@dataclass(frozen=True)
class Check:
    """A condition on a key as it is before the batch: "absent", "exists", or a version."""

    key: bytes
    cond: str | int

    def holds(self, version: int | None) -> bool:
        if self.cond == "absent":
            return version is None
        return version is not None if self.cond == "exists" else version == self.cond


@dataclass
class Options:
    key_order: KeyOrder = KeyOrder.HASHED
    read_only: bool = False
    sync_on_put: bool = False
    max_file_size: int = 64 << 20  # bytes of keys and values in a compacted file, about
    retain: int = 2  # manifests whose files a compaction leaves in place
    metrics: object | None = field(default=None)


def validate(ops) -> None:
    """Each key and value in the order of the operations, then the total. Checks count for keys alone."""
    total = 0
    for op in ops:
        if not op.key:
            raise EmptyKey
        if len(op.key) > MAX_KEY:
            raise KeyTooLarge
        if isinstance(op, Put) and len(op.value) > MAX_VALUE:
            raise ValueTooLarge
        if not isinstance(op, Check):
            total += OP_HEADER + len(op.key) + (len(op.value) if isinstance(op, Put) else 0)
    if total > MAX_BATCH:
        raise BatchTooLarge
