"""Blocks of a stated set, such as questions or passages, that are sent to executors one by one."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator


def blocks(items: Iterable, size: Callable, most: int) -> Iterator[list]:
    """Runs of items whose sizes add up to most at the most; an item above that is a block of its own."""
    held: list = []
    total = 0
    for x in items:
        n = size(x)
        if held and total + n > most:
            yield held
            held, total = [], 0
        held.append(x)
        total += n
    if held:
        yield held
