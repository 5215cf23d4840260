"""A memo of bounded size for pure functions of texts."""

from __future__ import annotations

from collections.abc import Callable

#: Longer texts are not kept: they seldom come again.
LONG = 64
#: What an entry takes besides four bytes a character and its value, about.
ENTRY = 150


class Memo(dict):
    """Values (bytes) made on first use. At ``limit`` bytes the memo starts anew but looks into the last one first, so what
    is frequent stays and at most twice the limit is held."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.limit, self.held, self.old = make, limit, 0, {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > LONG:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.held += ENTRY + (len(key) if key.isascii() else 4 * len(key)) + len(value)
        if self.held >= self.limit:
            self.old, self.held = dict(self), 0
            self.clear()
        self[key] = value
        return value
