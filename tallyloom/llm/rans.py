"""Range asymmetric numeral system with static tables: blocks of token ids as binary frames.

A state below ``2**53`` takes each id by its share of ``2**scale`` slots and gives up 32-bit words; so
a division in doubles is exact. A block's ids are dealt over interleaved lanes, each with a state of its own, and many blocks go side by side,
so that one NumPy step codes an id of every lane. At checkpoints a frame keeps all states and the
place in its words: decoding starts at any of them. Frames hold checksums of the ids and of
themselves, and an index of the documents in them.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC = b"TLRA"
_HEAD = struct.Struct("<4sIIIIIIII")
#: States are from here up to 2**32 times as much.
_LOW = 1 << 21


@dataclass(frozen=True)
class Table:
    """Slots of each id: ``freq`` of them from ``cum`` on; together ``2**scale``."""

    freq: np.ndarray
    scale: int

    @property
    def cum(self) -> np.ndarray:
        return np.append(0, np.cumsum(self.freq.astype(np.int64))[:-1])

    @property
    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.uint16 if len(self.freq) <= 1 << 16 else np.uint32), self.freq)

    @property
    def crc(self) -> int:
        return zlib.crc32(self.freq.astype("<u4").tobytes(), self.scale)


def table_of(counts: np.ndarray, scale: int = 20) -> Table:
    """The table for these counts by id. Every id has a slot at least, so each can be coded."""
    size = max(1, len(counts))
    scale = max(scale, (2 * size - 1).bit_length())
    if scale > 21:
        raise ValueError("at most 2**20 different ids")
    counts, spare, total = np.resize(counts, size).astype(object) if len(counts) else np.zeros(1, object), (1 << scale) - size, int(np.sum(counts)) or 1
    freq = np.array([1 + int(c) * spare // total for c in counts], np.uint32)
    freq[int(np.argmax(freq))] += (1 << scale) - int(freq.sum(dtype=np.uint64))
    return Table(freq, scale)


@dataclass(frozen=True)
class Documents:
    """The documents that reach into a block: their ids (and whether null), first id's number among
    all ids, and sizes."""

    doc_id: np.ndarray
    null: np.ndarray
    start: np.ndarray
    size: np.ndarray


def _coded(ids: np.ndarray, table: Table, lanes: int, every: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each block's words, and all blocks' states and words ahead at each checkpoint. Blocks are of one
    size, one a row, a multiple of ``lanes`` ids."""
    blocks, n = ids.shape
    steps = n // lanes
    order = np.ascontiguousarray(ids.reshape(blocks, steps, lanes).transpose(1, 0, 2)).reshape(steps, blocks * lanes)
    freq, cum, scale = table.freq.astype(np.int64), table.cum, table.scale
    x = np.full(blocks * lanes, _LOW)
    words, given = np.empty((steps, blocks, lanes), np.uint32), np.empty((steps, blocks, lanes), bool)
    flat_words, flat_given = words.reshape(steps, -1), given.reshape(steps, -1)
    states = np.empty((-(-steps // every), blocks, lanes), np.int64)
    most = 53 - scale
    for t in range(steps - 1, -1, -1):
        now = order[t].astype(np.int64)
        f = freq[now]
        full = np.greater_equal(x >> most, f, out=flat_given[t])
        flat_words[t] = x
        x >>= full.astype(np.int64) << 5
        q = (x / f).astype(np.int64)
        x -= q * f
        x += q << scale
        x += cum[now]
        if t % every == 0:
            states[t // every] = x.reshape(blocks, lanes)
    ahead = np.concatenate([np.zeros((1, blocks), np.int64), np.cumsum(given.sum(2, dtype=np.int64), 0)])[:steps:every]
    return [words[:, i][given[:, i]] for i in range(blocks)], states, ahead


def encode_blocks(blocks: list[tuple[np.ndarray, Documents]], table: Table, lanes: int = 128, every: int = 256, together: int = 32) -> list[bytes]:
    """A frame for each block of ids. Blocks of one size are coded side by side."""
    out: list[bytes] = [b""] * len(blocks)
    by_size: dict[int, list[int]] = {}
    for i, (ids, _) in enumerate(blocks):
        by_size.setdefault(-(-len(ids) // lanes) * lanes, []).append(i)
    filler, table_crc = int(np.argmax(table.freq)), table.crc
    for n, of_size in by_size.items():
        for first in range(0, len(of_size), together):
            group = of_size[first : first + together]
            padded = np.full((len(group), n), filler, np.uint32)
            for row, i in enumerate(group):
                padded[row, : len(blocks[i][0])] = blocks[i][0]
            words, states, ahead = _coded(padded, table, lanes, every)
            for row, i in enumerate(group):
                ids, docs = blocks[i]
                held = words[row].astype("<u4")
                head = _HEAD.pack(MAGIC, table_crc, len(ids), lanes, every, len(held), len(states), len(docs.size), zlib.crc32(ids.astype("<u4").tobytes()))
                parts = [head, ahead[:, row].astype("<u4").tobytes(), states[:, row].astype("<u8").tobytes(), held.tobytes(), docs.doc_id.astype("<i8").tobytes(), docs.start.astype("<i8").tobytes(), docs.size.astype("<i8").tobytes(), docs.null.astype("<u1").tobytes()]
                body = b"".join(parts)
                out[i] = body + struct.pack("<I", zlib.crc32(body))
    return out


class Frame:
    """A frame's parts; the checksum of the whole is tested, the ids' one when they are decoded."""

    def __init__(self, data: bytes, table_crc: int | None = None) -> None:
        if len(data) < _HEAD.size + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a frame's checksum is wrong")
        magic, crc, self.n, self.lanes, self.every, n_words, points, docs, self.ids_crc = _HEAD.unpack_from(data)
        if magic != MAGIC or (table_crc is not None and crc != table_crc):
            raise ValueError("a frame of another kind or table")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(data, kind, n, at)
            at += part.nbytes
            return part

        self.ahead = take("<u4", points).astype(np.int64)
        self.states = take("<u8", points * self.lanes).reshape(points, self.lanes)
        self.words = take("<u4", n_words)
        doc_id, start, size, null = (take(k, docs) for k in ("<i8", "<i8", "<i8", "<u1"))
        self.docs = Documents(doc_id, null.astype(bool), start, size)

    @property
    def steps(self) -> int:
        return -(-self.n // self.lanes)


class Decoder:
    """Decodes segments between checkpoints, all of one length side by side."""

    def __init__(self, table: Table) -> None:
        self.table, self.slots = table, table.slots
        self.freq, self.cum, self.crc = table.freq.astype(np.int64), table.cum, table.crc

    def segments(self, wanted: list[tuple[Frame, int]], together: int = 64) -> list[np.ndarray]:
        """The ids of each ``(frame, checkpoint)``'s segment."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(wanted)
        shapes: dict[tuple[int, int], list[int]] = {}
        for i, (f, k) in enumerate(wanted):
            shapes.setdefault((min(f.every, f.steps - k * f.every), f.lanes), []).append(i)
        for (steps, lanes), members in shapes.items():
            for first in range(0, len(members), together):
                group = members[first : first + together]
                frames = [wanted[i] for i in group]
                found = self._run(frames, steps, lanes)
                for row, i in enumerate(group):
                    f, k = wanted[i]
                    out[i] = found[row][: min(f.n - k * f.every * lanes, steps * lanes)]
        return out

    def _run(self, frames: list[tuple[Frame, int]], steps: int, lanes: int) -> np.ndarray:
        parts, at, place = [], [], 0
        for f, k in frames:
            end = int(f.ahead[k + 1]) if k + 1 < len(f.ahead) else len(f.words)
            parts.append(f.words[int(f.ahead[k]) : end])
            at.append(place)
            place += len(parts[-1])
        words = np.concatenate([*parts, np.zeros(1, "<u4")]).astype(np.int64)
        # One row a lane: the ranks of the lanes that take a word are sums down the rows.
        x = np.stack([f.states[k] for f, k in frames], 1).astype(np.int64)
        at = np.array(at, np.int64) - 1
        scale, mask = self.table.scale, (1 << self.table.scale) - 1
        out = np.empty((steps, lanes, len(frames)), self.slots.dtype)
        for t in range(steps):
            slot = x & mask
            ids = out[t] = self.slots[slot]
            ids = ids.astype(np.int64)
            x >>= scale
            x *= self.freq[ids]
            x += slot
            x -= self.cum[ids]
            low = x < _LOW
            place = np.cumsum(low, 0)
            place += at
            at = place[-1]
            taken = np.flatnonzero(low)
            flat = x.reshape(-1)
            flat[taken] = flat[taken] << 32 | words[place.reshape(-1)[taken]]
        return out.transpose(2, 0, 1).reshape(len(frames), steps * lanes).astype(np.uint32)

    def blocks(self, frames: list[Frame]) -> list[np.ndarray]:
        """All ids of each frame, tested against its checksum."""
        wanted = [(f, k) for f in frames for k in range(len(f.ahead))]
        found, out, place = self.segments(wanted), [], 0
        for f in frames:
            ids = np.concatenate(found[place : place + len(f.ahead)])
            place += len(f.ahead)
            if zlib.crc32(ids.astype("<u4").tobytes()) != f.ids_crc:
                raise ValueError("a block's checksum is wrong")
            out.append(ids)
        return out


# -- checksums of parts ----------------------------------------------------------------------

#: The polynomial of crc32, lowest power first in the highest bit (a fixed value).
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two such polynomials modulo the one of crc32."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


def crc32_joined(first: int, second: int, second_bytes: int) -> int:
    """crc32 of two joined byte strings from those of the parts."""
    shift, power, n = 0x80000000, 0x00800000, second_bytes  # x to the 0 and x to the 8
    while n:
        if n & 1:
            shift = _times(shift, power)
        power = _times(power, power)
        n >>= 1
    return _times(first, shift) ^ second
