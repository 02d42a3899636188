"""Normalisation by a compiled character map, with source alignment.

The map in a SentencePiece model is a double-array trie over UTF-8 bytes and a pool of replacements. At
each place the longest prefix in the trie is replaced; without one, one character is copied. Every byte
of the normalised text records the source byte that it comes from, so offsets project back.
"""

from __future__ import annotations

import struct

import numpy as np

SPACE = "▁".encode()


class CharsMap:
    def __init__(self, blob: bytes):
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.trie = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.pool = blob[4 + size :]
        else:
            self.trie, self.pool = [], b""

    def __bool__(self) -> bool:
        return bool(self.trie)

    def longest(self, data: bytes, at: int) -> tuple[int, int] | None:
        """Length of the longest prefix of ``data[at:]`` in the trie, and its pool offset."""
        found, node = None, 0
        node ^= self._offset(self.trie[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.trie):
                break
            unit = self.trie[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, self.trie[node] & 0x7FFFFFFF)
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def step(self, data: bytes, at: int) -> tuple[bytes, int]:
        """What stands for the source at ``at``, and how many bytes of it."""
        if self.trie and (found := self.longest(data, at)):
            length, pool = found
            return self.pool[pool : self.pool.index(b"\0", pool)], length
        first = data[at]
        n = 1 if first < 0x80 else 2 if first >> 5 == 6 else 3 if first >> 4 == 14 else 4
        return data[at : at + n], n


def normalise(text: str, chars: CharsMap, dummy_prefix: bool, strip_extra: bool, escape: bool) -> tuple[bytes, np.ndarray]:
    """Normalised bytes, and for each of them and the end its source byte offset."""
    data = text.encode("utf-8", "replace")
    out, source = bytearray(), []
    at = 0

    def put(part: bytes, where: int) -> None:
        out.extend(part)
        source.extend([where] * len(part))

    space = SPACE if escape else b" "
    if strip_extra:
        while at < len(data):
            part, n = chars.step(data, at)
            if part != b" ":
                break
            at += n
    if at < len(data) and dummy_prefix:
        put(space, at)
    gap = strip_extra
    while at < len(data):
        part, n = chars.step(data, at)
        while gap and part.startswith(b" "):
            part = part[1:]
        if part:
            for k in range(len(part)):
                put(space if part[k : k + 1] == b" " else part[k : k + 1], at)
            gap = strip_extra and part.endswith(b" ")
        at += n
    if strip_extra:
        while out.endswith(space):
            del out[-len(space) :]
            at = source[-len(space)]
            del source[-len(space) :]
    source.append(at)
    return bytes(out), np.array(source, np.int64)
