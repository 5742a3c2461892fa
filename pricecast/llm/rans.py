"""A static range asymmetric numeral coder over interleaved lanes, for arrays of token ids.

Token t of a block belongs to lane t mod lanes; one numpy step codes one token of every lane. At each checkpoint the
states of all lanes and the position in the word stream are noted, so a reader can start there: the segments of
a block decode independently of each other, and so do blocks.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
MAGIC = b"rANSblk1"
HEAD = struct.Struct("<8sQQIIIIII")


@dataclass(frozen=True)
class Frequencies:
    """Shares of 2**bits for every id that occurs, shared by all blocks."""

    bits: int
    share: np.ndarray
    before: np.ndarray

    @staticmethod
    def of_counts(ids: np.ndarray, counts: np.ndarray, bits: int = 20) -> Frequencies:
        """Proportional shares of at least one each; what rounding leaves over goes to the most frequent ids."""
        while len(ids) * 2 > 1 << bits:
            bits += 1
        share = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
        if len(ids):
            spare = (1 << bits) - len(ids)
            own = 1 + np.floor(counts * (spare / counts.sum())).astype(np.int64)
            order = np.lexsort((ids, -counts))
            rest = (1 << bits) - own.sum()
            own[order] += rest // len(ids)
            own[order[: rest % len(ids)]] += 1
            share[ids] = own
        return Frequencies(bits, share.astype(np.uint64), (np.cumsum(share) - share).astype(np.uint64))

    def by_slot(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.share), dtype=np.uint32), self.share.astype(np.int64))


def encode(ids: np.ndarray, table: Frequencies, lanes: int, steps_per_segment: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The word stream, and for each segment the word it starts at and the lanes' states there."""
    lanes = max(1, min(lanes, len(ids)))
    steps = -(-len(ids) // lanes)
    states = np.full(lanes, LOW, np.uint64)
    bits = np.uint64(table.bits)
    fits = np.uint64(63 - table.bits)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    symbols = ids.astype(np.intp)
    shares, befores = table.share.take(symbols), table.before.take(symbols)
    limits = shares << fits
    for step in range(steps - 1, -1, -1):
        own = slice(step * lanes, (step + 1) * lanes)
        f, c = shares[own], befores[own]
        n = len(f)
        x = states[:n]
        full = np.flatnonzero(x >= limits[own])
        if len(full):
            out = x.take(full)
            words.append(out.astype(np.uint32))
            written += len(out)
            x[full] = out >> WORD
        q = x // f
        q *= (np.uint64(1) << bits) - f
        q += c
        x += q
        if step % steps_per_segment == 0:
            marks.append((written, states.copy()))
    stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    return stream, [(written - at, x) for at, x in reversed(marks)]


def decode(stream: np.ndarray, start: tuple[int, np.ndarray], n: int, table: Frequencies, by_slot: np.ndarray) -> np.ndarray:
    """``n`` ids from a checkpoint on."""
    at, states = start[0], start[1].copy()
    lanes = len(states)
    out = np.empty(n, np.uint32)
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    for first in range(0, n, lanes):
        width = min(lanes, n - first)
        x = states[:width]
        slot = x & mask
        symbols = by_slot.take(slot.view(np.intp))
        out[first : first + width] = symbols
        places = symbols.astype(np.intp)
        x >>= bits
        x *= table.share.take(places)
        x += slot
        x -= table.before.take(places)
        low = np.flatnonzero(x < LOW)
        take = len(low)
        if take:
            x[low] = (x.take(low) << WORD) | stream[at : at + take]
            at += take
    return out


def pack(doc_ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, ids: np.ndarray, start: int, table: Frequencies, lanes: int, steps_per_segment: int) -> bytes:
    """One block as a self-contained record with a checksum over all that follows it."""
    stream, marks = encode(ids, table, lanes, steps_per_segment)
    width = len(marks[0][1]) if marks else 0
    body = b"".join(
        [
            doc_ids.astype("<i8").tobytes(),
            known.astype("u1").tobytes(),
            sizes.astype("<u4").tobytes(),
            *(struct.pack("<QI", at, zlib.crc32(ids[i * steps_per_segment * width : (i + 1) * steps_per_segment * width].astype("<u4").tobytes())) + states.astype("<u8").tobytes() for i, (at, states) in enumerate(marks)),
            stream.astype("<u4").tobytes(),
        ]
    )
    head = HEAD.pack(MAGIC, start, len(ids), len(sizes), width, steps_per_segment, len(marks), len(stream), zlib.crc32(body))
    return head + body


@dataclass(frozen=True)
class Block:
    start: int
    n_ids: int
    doc_ids: np.ndarray
    known: np.ndarray
    sizes: np.ndarray
    span: int
    marks: list[tuple[int, np.ndarray]]
    checks: list[int]
    stream: np.ndarray

    def segment(self, i: int, table: Frequencies, by_slot: np.ndarray) -> np.ndarray:
        """Segment ``i`` alone, checked."""
        n = min(self.span, self.n_ids - i * self.span)
        ids = decode(self.stream, self.marks[i], n, table, by_slot)
        if zlib.crc32(ids.astype("<u4").tobytes()) != self.checks[i]:
            raise ValueError(f"segment {i} of a token block does not match its checksum")
        return ids

    def ids(self, table: Frequencies, by_slot: np.ndarray) -> np.ndarray:
        parts = [self.segment(i, table, by_slot) for i in range(len(self.marks))]
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def unpack(record: bytes) -> Block:
    magic, start, n_ids, n_docs, width, steps, n_marks, n_words, check = HEAD.unpack_from(record)
    if magic != MAGIC or zlib.crc32(memoryview(record)[HEAD.size :]) != check:
        raise ValueError("a token block does not match its checksum")
    at = HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(record, kind, n, at)
        at += found.nbytes
        return found

    doc_ids, known, sizes = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
    marks, checks = [], []
    for _ in range(n_marks):
        word, crc = struct.unpack_from("<QI", record, at)
        at += 12
        marks.append((word, take("<u8", width)))
        checks.append(crc)
    return Block(start, n_ids, doc_ids, known, sizes, width * steps, marks, checks, take("<u4", n_words))
