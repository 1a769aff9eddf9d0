"""Fixed-width bit packing of token ids and the file format built on it.

A file holds the ids of whole documents, one after the other:

* payload: blocks of ``BLOCK`` ids (the last may be shorter); id k of a block takes the bits
  [k * width, (k + 1) * width) of the block's little-endian 64-bit words;
* index: block offsets, document ids, flags of missing document ids, ends of the documents in ids;
* trailer of fixed length: magic, width, block length, numbers of ids, documents and blocks, place of
  the index.

Any id range is read by its block offsets alone, without the blocks before it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np

MAGIC = b"TOKBITS1"
BLOCK = 4096
_TRAILER = struct.Struct("<8sIIQQQQ")


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold the ids 0 to vocabulary - 1."""
    if not 1 <= vocabulary <= 2**32:
        raise ValueError("a vocabulary has 1 to 2**32 ids")
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> np.ndarray:
    """Ids as 64-bit words; 64 ids fill ``width`` words, a shorter tail as many as it needs."""
    n = len(ids)
    if n and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    lanes = np.zeros((-(-n // 64), 64), np.uint64)
    lanes.reshape(-1)[:n] = ids
    words = np.zeros((len(lanes), width), np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        words[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return words.reshape(-1)[: -(-n * width // 64)]


def unpack(words: np.ndarray, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed words."""
    groups = -(-n // 64)
    full = np.zeros((groups, width), np.uint64)
    full.reshape(-1)[: min(len(words), groups * width)] = words[: groups * width]
    ids = np.empty((groups, 64), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        value = full[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (full[:, word + 1] << np.uint64(64 - shift))
        ids[:, lane] = value & mask
    return ids.reshape(-1)[:n]


@dataclass
class PackedWriter:
    """Appends documents to an open file; holds one unfinished block and the index."""

    out: BinaryIO
    width: int
    block: int = BLOCK
    n_ids: int = 0
    _at: int = 0
    _rest: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint32))
    _offsets: list[np.ndarray] = field(default_factory=list)
    _docs: list[np.ndarray] = field(default_factory=list)
    _absent: list[np.ndarray] = field(default_factory=list)
    _ends: list[np.ndarray] = field(default_factory=list)

    def append(self, doc_ids: Sequence[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents with ``counts`` ids each, taken from ``ids`` in turn."""
        self._docs.append(np.array([d if d is not None else 0 for d in doc_ids], np.int64))
        self._absent.append(np.array([d is None for d in doc_ids], np.uint8))
        self._ends.append(np.cumsum(counts).astype(np.uint64) + np.uint64(self.n_ids))
        self.n_ids += len(ids)
        held = np.concatenate([self._rest, ids]).astype(np.uint32)
        whole = len(held) // self.block * self.block
        self._write(held[:whole])
        self._rest = held[whole:]

    def _write(self, ids: np.ndarray) -> None:
        if not len(ids):
            return
        data = pack(ids, self.width).astype("<u8").tobytes()
        step = self.block * self.width // 8
        self._offsets.append(np.arange(self._at, self._at + len(data), step, dtype=np.uint64))
        self.out.write(data)
        self._at += len(data)

    def close(self) -> None:
        self._write(self._rest)
        parts = [self._offsets, self._docs, self._absent, self._ends]
        kinds = ["<u8", "<i8", "u1", "<u8"]
        index = [np.concatenate([np.empty(0, k), *p]).astype(k) for p, k in zip(parts, kinds, strict=True)]
        for column in index:
            self.out.write(column.tobytes())
        self.out.write(
            _TRAILER.pack(MAGIC, self.width, self.block, self.n_ids, len(index[1]), len(index[0]), self._at)
        )


class PackedReader:
    """Random access to a packed file that is open for reading and seeking."""

    def __init__(self, source: BinaryIO):
        self.source = source
        end = source.seek(0, 2)
        source.seek(end - _TRAILER.size)
        magic, self.width, self.block, self.n_ids, docs, blocks, at = _TRAILER.unpack(source.read(_TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        source.seek(at)
        self.end = at
        self.offsets = np.frombuffer(source.read(8 * blocks), "<u8")
        self.doc_ids = np.frombuffer(source.read(8 * docs), "<i8")
        self.absent = np.frombuffer(source.read(docs), "u1")
        self.ends = np.frombuffer(source.read(8 * docs), "<u8").astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``, from the blocks that hold them."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        begin = int(self.offsets[first])
        end = int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.end
        self.source.seek(begin)
        words = np.frombuffer(self.source.read(end - begin), "<u8")
        base = first * self.block
        return unpack(words, self.width, min(self.n_ids, (last + 1) * self.block) - base)[start - base : stop - base]

    def documents(self, blocks: int = 256) -> Iterator[tuple[int | None, Iterator[np.ndarray]]]:
        """Each document with its ids in pieces; ``blocks`` blocks are in memory at a time."""
        step = blocks * self.block
        held, base = np.empty(0, np.uint32), 0

        def pieces(start: int, stop: int) -> Iterator[np.ndarray]:
            nonlocal held, base
            while start < stop:
                if not base <= start < base + len(held):
                    base = start // self.block * self.block
                    held = self.ids(base, base + step)
                upto = min(stop, base + len(held))
                yield held[start - base : upto - base]
                start = upto

        start = 0
        for doc, absent, stop in zip(self.doc_ids.tolist(), self.absent.tolist(), self.ends.tolist(), strict=True):
            yield (None if absent else doc), pieces(start, stop)
            start = stop
