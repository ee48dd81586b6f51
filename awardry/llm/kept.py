"""A bounded memory for values that are costly to make, for use inside tasks."""

from __future__ import annotations


#: Longer keys (a whole text without spaces, say) are made anew each time: entries stay small.
LONGEST = 64


class Kept(dict):
    """Makes missing values by make(key); has at most 2 * size of them, of LONGEST characters, and those in use stay."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.older = size, {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        if len(key) > LONGEST:
            return self.make(key)
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
