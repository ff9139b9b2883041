"""Bounded memos of two generations: what is used often stays, what isn't goes, and their size in bytes has a fixed bound.

Keys of more than LONGEST characters aren't remembered.
"""

from __future__ import annotations

from collections.abc import Callable


LONGEST = 256


class Memo(dict):
    """memo[key] is make(key), remembered; holds `most` keys in the young generation and as many in the old one."""

    def __init__(self, make: Callable, most: int = 200_000) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Recent(dict):
    """memo[key] is make([key])[0], remembered; holds `most` keys in the young generation and as many in the old one."""

    def __init__(self, make: Callable, most: int = 200_000) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make([key])[0]
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def fill(self, keys: set) -> None:
        """Have all keys but long ones in the young generation; what is unknown is made in one call."""
        missing = {k for k in keys - self.keys() if len(k) <= LONGEST}
        if len(self) + len(missing) > self.most:
            self.old = dict(self)
            self.clear()
            missing = {k for k in keys if len(k) <= LONGEST}
        old = self.old
        self.update({k: old[k] for k in missing if k in old})
        new = [k for k in missing if k not in self]
        self.update(zip(new, self.make(new), strict=True))
