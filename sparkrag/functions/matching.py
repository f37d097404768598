"""Many words looked for at once in the texts of a batch: one walk over a text, whatever their number."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick


@functools.lru_cache(maxsize=4)
def automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    """Finds all places of all ``words``; a word's value is its first number among them.

    Kept per worker, so that the batches of a job and its later tasks share it.
    """
    found = ahocorasick.Automaton()
    for i in range(len(words) - 1, -1, -1):
        if words[i]:
            found.add_word(words[i], i)
    found.make_automaton()
    return found


def places(text: str, words: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """``(end, number)`` of every occurrence, by end; ``end`` is exclusive."""
    finder = automaton(words)
    if not len(finder):
        return
    for last, number in finder.iter(text):
        yield last + 1, number


def first_numbers(text: str, words: tuple[str, ...], groups: list[list[int]]) -> dict[int, int]:
    """Smallest word number per group that a text holds; ``groups`` lists the groups of a word."""
    best: dict[int, int] = {}
    for _, number in places(text, words):
        for group in groups[number]:
            if best.get(group, number + 1) > number:
                best[group] = number
    return best


def longest_first(text: str, words: tuple[str, ...]) -> tuple[list[tuple[int, str]], bytearray]:
    """Words of a text that don't overlap, longer ones placed before shorter ones, and a mark for each
    character that they take.  Equally long words are placed in the order of ``words``, one word
    from left to right."""
    taken, found = bytearray(len(text)), []
    order = sorted((-len(words[n]), n, end) for end, n in places(text, words))
    for size, n, end in order:
        begin = end + size
        if taken.find(1, begin, end) < 0:
            taken[begin:end] = b"\1" * -size
            found.append((begin, words[n]))
    return sorted(found), taken
