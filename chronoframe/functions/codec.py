"""The compressed block format, for interchange: delta-of-delta timestamps and XORed doubles, bit by bit.

Ordinary queries never use it; they read Parquet.
"""

from __future__ import annotations

import struct

#: Timestamp classes: control bits, their number, payload bits, and the largest shifted magnitude (fixed values of the format).
CLASSES = ((0b10, 2, 7), (0b110, 3, 9), (0b1110, 4, 12), (0b1111, 4, 32))
FIRST_BITS, LEADING_BITS, SIZE_BITS, MAX_LEADING = 32, 5, 6, 31


class Writer:
    def __init__(self) -> None:
        self.value, self.bits = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value = self.value << bits | value & (1 << bits) - 1
        self.bits += bits

    def bytes(self) -> bytes:
        pad = -self.bits % 8
        return (self.value << pad).to_bytes((self.bits + pad) // 8, "big")


class Reader:
    def __init__(self, data: bytes) -> None:
        self.text = bin(int.from_bytes(b"\1" + data, "big"))[3:]
        self.at = 0

    def get(self, bits: int) -> int:
        if self.at + bits > len(self.text):
            raise ValueError("the block ends early")
        self.at += bits
        return int(self.text[self.at - bits : self.at], 2) if bits else 0


def _bits(value: float) -> int:
    return struct.unpack(">Q", struct.pack(">d", value))[0]


def encode_block(points: list[tuple[int, float]], default_delta: int = 60) -> tuple[bytes, int]:
    """The block's bytes and how many bits of them count; timestamps must lie in 0 .. 2**32 - 1 and not fall."""
    w = Writer()
    last_ts = last_delta = bits = 0
    lead = trail = 0
    for k, (ts, value) in enumerate(points):
        if not 0 <= ts < 1 << 32:
            raise ValueError(f"timestamp {ts} doesn't fit a block")
        if k == 0:
            w.put(ts, FIRST_BITS)
            last_delta = default_delta
        else:
            if ts < last_ts:
                raise ValueError("timestamps fall")
            change = ts - last_ts - last_delta
            last_delta = ts - last_ts
            if change == 0:
                w.put(0, 1)
            else:
                shifted = change - 1 if change > 0 else change
                for control, n, payload in CLASSES:
                    half = 1 << payload - 1
                    if -half < shifted < half:
                        w.put(control, n)
                        w.put(shifted + half, payload)
                        break
                else:
                    raise ValueError("the step doesn't fit a block")
        last_ts = ts
        x = _bits(value) ^ bits
        bits ^= x
        if not x:
            w.put(0, 1)
            continue
        w.put(1, 1)
        leading, trailing = min(MAX_LEADING, 64 - x.bit_length()), (x & -x).bit_length() - 1
        size = 64 - leading - trailing
        window = 64 - lead - trail
        if leading >= lead and trailing >= trail and window < LEADING_BITS + SIZE_BITS + size:
            w.put(1, 1)
            w.put(x >> trail, window)
        else:
            w.put(0, 1)
            w.put(leading, LEADING_BITS)
            w.put(size - 1, SIZE_BITS)
            w.put(x >> trailing, size)
            lead, trail = leading, trailing
    return w.bytes(), w.bits


def decode_block(data: bytes, count: int, default_delta: int = 60) -> list[tuple[int, float]]:
    """The first ``count`` points of a block."""
    r = Reader(data)
    out: list[tuple[int, float]] = []
    ts, delta, bits, lead, trail = 0, default_delta, 0, 0, 0
    for k in range(count):
        if k == 0:
            ts = r.get(FIRST_BITS)
        else:
            ones = 0
            while ones < 4 and r.get(1):
                ones += 1
            if ones:
                payload = CLASSES[ones - 1][2]
                x = r.get(payload) - (1 << payload - 1)
                delta += x + 1 if x >= 0 else x
            ts += delta
        if r.get(1):
            if not r.get(1):
                lead, size = r.get(LEADING_BITS), r.get(SIZE_BITS) + 1
                trail = 64 - lead - size
            bits ^= r.get(64 - lead - trail) << trail
        out.append((ts, struct.unpack(">d", struct.pack(">Q", bits))[0]))
    return out
