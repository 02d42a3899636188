"""Canonical length-limited Huffman codes for arrays of token ids.

Ids are coded in blocks that decode on their own; a block has a checkpoint, the bit offset of a code, for
every ``STRIDE`` ids. All checkpoints of a file are decoded side by side, one table lookup a code.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 1 << 16
STRIDE = 256
MAGIC = b"TWHUF1\0\0"


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n == 0:
        return out
    if n == 1:
        out[used] = 1
        return out
    limit = max(limit, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    is_leaf, level = [], weight
    flags = np.ones(n, bool)
    for _ in range(limit - 1):
        is_leaf.append(flags)
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        at = np.argsort(both, kind="stable")
        level, flags = both[at], at < n
    is_leaf.append(flags)
    length = np.zeros(n, np.int64)
    take = 2 * n - 2
    for flags in reversed(is_leaf):
        leaves = int(flags[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        n = int(lengths[i])
        if n:
            code <<= n - last
            codes[i] = code
            code += 1
            last = n
    return codes


class Codec:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        self.codes = canonical(lengths).astype(np.uint64)
        self.bits = max(1, int(self.lengths.max(initial=0)))
        if self.bits > 25:
            raise ValueError("codes of over 25 bits don't fit the decoder's window")
        self.symbol = np.zeros(1 << self.bits, np.uint32)
        self.width = np.ones(1 << self.bits, np.uint8)
        for i in np.flatnonzero(self.lengths):
            pad = self.bits - int(self.lengths[i])
            a = int(self.codes[i]) << pad
            self.symbol[a : a + (1 << pad)] = i
            self.width[a : a + (1 << pad)] = self.lengths[i]

    def block(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of one block and its checkpoints' bit offsets."""
        width = self.lengths[ids].astype(np.int64)
        if not width.all():
            raise ValueError("an id has no code")
        end = np.cumsum(width)
        at = end - width
        word, off = at >> 5, at & 31
        # A code of up to 32 bits from bit ``off`` of a 32-bit word spans that word and the next.
        value = self.codes[ids] << (64 - off - width).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(int(end[-1] >> 5) + 2, np.uint32)
        # Codes don't overlap, so sums of a word's parts are their union.
        out[word[first]] += np.add.reduceat(value >> np.uint64(32), first).astype(np.uint32)
        out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first).astype(np.uint32)
        return out.astype(">u4").tobytes()[: int(end[-1] + 7) >> 3], at[::STRIDE].astype(np.uint32)

    def lanes(self, data: bytes, at: np.ndarray, total: int) -> np.ndarray:
        """The ``total`` ids that start at the bit offsets ``at``, ``STRIDE`` from each but the last."""
        raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        pos, out = at.astype(np.int64), np.empty((STRIDE, len(at)), np.uint32)
        shift, mask, top = 32 - self.bits, (1 << self.bits) - 1, len(window) - 1
        for i in range(STRIDE):
            w = (window[pos >> 3] >> (shift - (pos & 7)).astype(np.uint32)) & mask
            out[i] = self.symbol[w]
            pos += self.width[w]
            if pos[-1] >> 3 > top:  # the last lane may run past its end
                pos[-1] = top << 3
        return out.T.reshape(-1)[:total]


def write_file(codec: Codec, doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """Header, code lengths, document table, checkpoints, blocks and a CRC of it all."""
    blocks, marks, starts, at = [], [], [], 0
    for i in range(0, len(ids), BLOCK):
        data, points = codec.block(ids[i : i + BLOCK])
        blocks.append(data)
        marks.append(points)
        starts.append(at)
        at += len(data)
    null = np.array([x is None for x in doc_ids], np.uint8)
    names = np.array([0 if x is None else x for x in doc_ids], np.int64)
    parts = [codec.lengths.tobytes(), null.tobytes(), names.tobytes(), sizes.astype("<u4").tobytes(), np.array(starts, "<u8").tobytes(), b"".join(m.astype("<u4").tobytes() for m in marks)]
    packed = [zlib.compress(p, 1) for p in parts]
    head = MAGIC + struct.pack("<QQQ6Q", len(ids), len(doc_ids), at, *map(len, packed))
    body = head + b"".join(packed) + b"".join(blocks)
    return body + struct.pack("<I", zlib.crc32(body))


def _open(data: bytes):
    if data[:8] != MAGIC or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a whole file of Huffman-coded ids")
    n_ids, n_docs, size, *lens = struct.unpack_from("<QQQ6Q", data, 8)
    at, parts = 8 + 72, []
    for n in lens:
        parts.append(zlib.decompress(data[at : at + n]))
        at += n
    return n_ids, n_docs, data[at : at + size], parts


def read_file(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, sizes and all ids of a file."""
    n_ids, _, body, (lengths, null, names, sizes, starts, marks) = _open(data)
    codec = Codec(np.frombuffer(lengths, np.uint8))
    block_of = np.arange(-(-n_ids // STRIDE)) // (BLOCK // STRIDE)
    at = np.frombuffer(starts, "<u8").astype(np.int64)[block_of] * 8 + np.frombuffer(marks, "<u4")
    ids = codec.lanes(body, at, n_ids) if n_ids else np.empty(0, np.uint32)
    doc_ids = [None if n else int(x) for n, x in zip(null, np.frombuffer(names, np.int64), strict=True)]
    return doc_ids, np.frombuffer(sizes, "<u4"), ids


def read_block(data: bytes, k: int) -> np.ndarray:
    """The ids of block ``k`` alone."""
    n_ids, _, body, (lengths, _, _, _, starts, marks) = _open(data)
    starts = np.frombuffer(starts, "<u8").astype(np.int64)
    end = starts[k + 1] if k + 1 < len(starts) else len(body)
    per = BLOCK // STRIDE
    marks = np.frombuffer(marks, "<u4")[k * per : (k + 1) * per]
    return Codec(np.frombuffer(lengths, np.uint8)).lanes(body[starts[k] : end], marks, min(BLOCK, n_ids - k * BLOCK))
