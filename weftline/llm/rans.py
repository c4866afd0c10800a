"""Static range asymmetric numeral system over token ids, in interleaved lanes.

A shard of tokens shares one frequency table of 2^SCALE slots. Its blocks are
independent: each has its own lanes (token j * lanes + l is step j of lane l), the
lanes' states at its first step and at every CHECK_STEPS-th step with the place in
the stream, and the CRC of its tokens. So blocks, and the stretches between
checkpoints, decode in any order and in parallel. All lanes of a step are coded at
once as arrays.

States are 64-bit in [2^31, 2^63) and renormalise by 32-bit little-endian words.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

SCALE = 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
MASK = np.uint64((1 << SCALE) - 1)
LANES = 2048
BLOCK_TOKENS = 1 << 19
CHECK_STEPS = 128


class Corrupt(ValueError):
    """A block whose tokens don't have its checksum."""


@dataclass(frozen=True)
class Table:
    """Symbols of a shard in ascending order and their slots, which sum to 2^SCALE."""

    symbols: np.ndarray
    slots: np.ndarray

    @staticmethod
    def of(tokens: np.ndarray) -> Table:
        if not len(tokens):
            return Table(np.zeros(0, np.uint32), np.zeros(0, np.uint32))
        counts = np.bincount(tokens)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols].astype(np.float64)
        total = 1 << SCALE
        if len(symbols) > total // 2:
            raise ValueError(f"more than {total // 2} different tokens in a shard")
        slots = np.maximum(1, np.floor(counts * ((total - len(symbols)) / counts.sum()))).astype(np.int64)
        slots[np.argmax(counts)] += total - slots.sum()
        return Table(symbols.astype(np.uint32), slots.astype(np.uint32))

    def pack(self) -> bytes:
        """Symbols as gaps and slots, both in LEB128, then deflated."""
        return zlib.compress(_leb(np.diff(self.symbols, prepend=np.uint32(0))) + _leb(self.slots), 1)

    @staticmethod
    def unpack(raw: bytes) -> Table:
        x = _unleb(zlib.decompress(raw))
        n = len(x) // 2
        return Table(np.cumsum(x[:n]).astype(np.uint32), x[n:].astype(np.uint32))

    def starts(self) -> np.ndarray:
        return (np.cumsum(self.slots, dtype=np.int64) - self.slots).astype(np.uint64)


def _leb(x: np.ndarray) -> bytes:
    x = x.astype(np.uint64)
    n = 1 + sum((x >= np.uint64(1 << (7 * k))).astype(np.int64) for k in range(1, 5))
    at = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for k in range(5):
        have = n > k
        more = (n > k + 1).astype(np.uint8) << 7
        out[at[have] + k] = ((x >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8)[have] | more[have]
    return out.tobytes()


def _unleb(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    last = b < 128
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(first, np.diff(np.concatenate([first, [len(b)]])))
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), first)


def crc(tokens: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(tokens, "<u4"))


def encode_block(symbol: np.ndarray, slots: np.ndarray, starts: np.ndarray, tokens: np.ndarray, lanes: int) -> dict:
    """`symbol`: the tokens as indices of the table."""
    n = len(symbol)
    steps = -(-n // lanes)
    x = np.full(lanes, LOW)
    words, marks = [], []
    for j in range(steps - 1, -1, -1):
        s = symbol[j * lanes : (j + 1) * lanes]
        m = len(s)
        f, y = slots[s], x[:m]
        spill = y >= f << np.uint64(63 - SCALE)
        out = y[spill]
        words.append((out & np.uint64(0xFFFFFFFF)).astype("<u4"))
        y[spill] = out >> WORD
        q = y // f
        x[:m] = (q << np.uint64(SCALE)) + (y - q * f) + starts[s]
        if j % CHECK_STEPS == 0:
            marks.append((sum(map(len, words)), x.copy()))
    total = sum(map(len, words))
    return {
        "n": n,
        "lanes": lanes,
        "stream": np.concatenate(words[::-1] or [np.zeros(0, "<u4")]).tobytes(),
        "marks": [{"at": total - used, "states": state.astype("<u8").tobytes()} for used, state in reversed(marks)],
        "crc": crc(tokens),
    }


def decode_block(block: dict, symbols: np.ndarray, slots: np.ndarray, starts: np.ndarray, lookup: np.ndarray, mark: int = 0, stretch: bool = False) -> np.ndarray:
    """The tokens from checkpoint `mark` on: to the next one with `stretch`, else to the block's end (whole blocks are checked)."""
    n, lanes = block["n"], block["lanes"]
    words = np.frombuffer(block["stream"], "<u4").astype(np.uint64)
    if not n:
        return np.zeros(0, np.uint32)
    at, x = block["marks"][mark]["at"], np.frombuffer(block["marks"][mark]["states"], "<u8").astype(np.uint64)
    first, end = mark * CHECK_STEPS, -(-n // lanes)
    end = min(end, first + CHECK_STEPS) if stretch else end
    out = np.empty(min(n, end * lanes) - first * lanes, np.uint32)
    for j in range(first, end):
        m = min(lanes, n - j * lanes)
        y = x[:m]
        slot = y & MASK
        s = lookup[slot]
        y = slots[s] * (y >> np.uint64(SCALE)) + slot - starts[s]
        low = np.flatnonzero(y < LOW)
        if at + len(low) > len(words):
            raise Corrupt("a block's stream ends early")
        y[low] = (y[low] << WORD) | words[at : at + len(low)]
        at += len(low)
        x[:m] = y
        out[(j - first) * lanes : (j - first) * lanes + m] = symbols[s]
    if not mark and len(out) == n and crc(out) != block["crc"]:
        raise Corrupt("a block's tokens differ from its checksum")
    return out


def encode_shard(tokens: np.ndarray) -> tuple[bytes, list[dict]]:
    """(table, blocks) of the tokens of one shard."""
    table = Table.of(tokens)
    slots, starts = table.slots.astype(np.uint64), table.starts()
    index = np.zeros(int(table.symbols[-1]) + 1 if len(table.symbols) else 0, np.uint32)
    index[table.symbols] = np.arange(len(table.symbols))
    blocks = []
    for a in range(0, len(tokens), BLOCK_TOKENS):
        part = tokens[a : a + BLOCK_TOKENS]
        blocks.append(encode_block(index[part], slots, starts, part, max(1, min(LANES, len(part) // 64))))
    return table.pack(), blocks


def decode_shard(table: bytes, blocks: list[dict]) -> np.ndarray:
    t = Table.unpack(table)
    slots, starts = t.slots.astype(np.uint64), t.starts()
    lookup = np.repeat(np.arange(len(t.slots)), t.slots)
    return np.concatenate([decode_block(b, t.symbols, slots, starts, lookup) for b in blocks] or [np.zeros(0, np.uint32)])
