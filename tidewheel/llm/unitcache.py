"""A bounded memo of encoded text units, shared by the tokenizer operators.

Tokenizers treat the units between certain boundaries apart from each other, so each different unit of a
worker's texts is encoded once. Two generations bound the memory: what was used since the last turnover
stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable


class UnitCache:
    def __init__(self, encode: Callable[[list[str]], list], limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self.now: dict = {}
        self.before: dict = {}

    def ready(self, units: Iterable[str]) -> dict:
        """A mapping that has all of ``units``; valid until the next call."""
        if len(self.now) > self.limit:
            self.before, self.now = self.now, {}
        now, before = self.now, self.before
        new = []
        for u in set(units).difference(now):
            if u in before:
                now[u] = before[u]
            else:
                new.append(u)
        if new:
            now.update(zip(new, self.encode(new), strict=True))
        return now


class Memo(dict):
    """``make`` of each key, made when first asked for; two generations as above."""

    def __init__(self, make: Callable[[str], bytes], before: dict | None = None):
        super().__init__()
        self.make, self.before = make, before or {}

    def __missing__(self, key: str) -> bytes:
        got = self.before.get(key)
        if got is None:
            got = self.make(key)
        self[key] = got
        return got

    def turned(self, limit: int = 400_000) -> Memo:
        """This memo, or its next generation if it is full."""
        return self if len(self) <= limit else Memo(self.make, dict(self))


def portions(texts: list[str], size: int = 1 << 18) -> Iterable[list[int]]:
    """Indexes of consecutive texts in portions of about ``size`` characters."""
    part, n = [], 0
    for i, t in enumerate(texts):
        part.append(i)
        n += len(t)
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def plain(text: str) -> bool:
    """Whether white space comes only as single spaces and line ends between other characters."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\u180e" in text:
        return False
    return len(text.split()) == text.count(" ") + text.count("\n") + 1
