"""A bounded memory of values by key, for work that repeats with a long tail of rare keys."""
from __future__ import annotations

from collections.abc import Callable, Iterable


class Memo(dict):
    """Two generations: when the young one is full it becomes the old one, and what is asked for again moves back.

    `compute` takes a list of keys and gives a value for each, so that many missing keys are computed by one call.
    """

    def __init__(self, compute: Callable[[list], Iterable], limit: int = 500_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def learn(self, keys: set) -> None:
        """Have the values of these keys at hand; `compute` may add further keys."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        keys = keys.difference(self)
        known = keys.intersection(self.old)
        self.update(zip(known, map(self.old.__getitem__, known)))
        new = list(keys.difference(known))
        if new:
            self.update(zip(new, self.compute(new)))

    def gather(self, groups: list[list]) -> list[list]:
        """The values of each group of keys."""
        self.learn(set().union(*groups))
        return [list(map(self.__getitem__, g)) for g in groups]
