"""Texts of Arrow batches as bytes, and their words."""

from __future__ import annotations

import pyarrow as pa

#: Lower-cases A-Z and turns every ASCII byte but digits and letters into a space; bytes of other letters stay.
_WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of each row; null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Runs of a-z, 0-9 and non-ASCII letters, after lower-casing A-Z."""
    return text.translate(_WORD_TABLE).split()


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
