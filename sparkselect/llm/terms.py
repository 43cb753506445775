"""Normalised terms of texts, with places in the original.

A term is a run of ASCII letters and digits and of characters outside ASCII; A-Z are
lower-cased, nothing else is. Normalising maps each byte of UTF-8 to one byte, so a place
in the normalised text is the same place in the original.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Words

_KEPT = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
#: Byte -> its normal form: a kept byte (A-Z lower-cased) or a space.
NORMAL = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _KEPT else 0x20 for b in range(256))


class Terms(Words):
    """The terms of one Arrow batch of texts as integer codes (see ``Words``). Null texts have none."""

    def __init__(self, texts: pa.Array):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2]
        raw = data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if data is not None else b""
        #: bytes of all texts end to end, and where each text starts
        self.raw, self.at = raw, ends - ends[0]
        self.normal = raw.translate(NORMAL)
        super().__init__(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(self.at.tobytes()), pa.py_buffer(self.normal)))

    def places(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the terms of a row start and end in its original text, in code points."""
        lo, hi = int(self.at[row]), int(self.at[row + 1])
        inside = np.zeros(hi - lo + 2, np.int8)
        inside[1:-1] = np.frombuffer(self.normal, np.uint8, hi - lo, lo) != 0x20
        edge = np.diff(inside)
        first = (np.frombuffer(self.raw, np.uint8, hi - lo, lo) & 0xC0) != 0x80
        point = np.append(0, np.cumsum(first))
        return point[np.flatnonzero(edge == 1)], point[np.flatnonzero(edge == -1)]


def lists(values: list[list], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column of Python lists."""
    return pa.array(values, pa.list_(kind))
