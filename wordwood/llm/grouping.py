"""Suffix sorting by grouping, in linear time, for the byte strings that one task holds.

Suffixes are put into groups by a prefix that they share, at first one byte. The groups are
processed from the greatest down. Each suffix of the group is absorbed by the nearest suffix
before it that is in a smaller group: the previous-smaller pointer. Suffixes that absorb the same
run leave their group for a new one right above it, as their prefix is now longer by that run.
What is absorbed is done: its prefix is the longest Lyndon word that it starts with, and ends
where the next smaller suffix begins.

Then the groups are in order, and only the order inside them is open. It is read off in one pass
from the smallest suffix up: whenever a suffix gets its place, so do all suffixes whose prefix
ends where it begins, each the next in its group. Nothing is renamed and nothing is sorted again.
"""

from __future__ import annotations

import numpy as np

BYTES = 256


def suffix_order(text: bytes) -> np.ndarray:
    """Starts of all suffixes of ``text`` in ascending order; an end is below every byte."""
    groups, ends = _lyndon_groups(text)
    return _emitted(groups, ends)


def _lyndon_groups(text: bytes) -> tuple[list[list[int]], list[int]]:
    """Suffixes by their longest Lyndon prefix, smallest first, and where these prefixes end."""
    n = len(text)
    members: list[list[int]] = [[] for _ in range(BYTES)]
    for i, byte in enumerate(text):
        members[byte].append(i)
    # The order of the groups, as a list that is linked both ways.
    below = list(range(-1, BYTES - 1))
    above = [*range(1, BYTES), -1]
    group_of = list(text)
    # The suffixes that are not yet done, linked in text order.
    before = list(range(-1, n - 1))
    after = list(range(1, n + 1))
    done = []
    group = BYTES - 1
    while group >= 0:
        own = [i for i in members[group] if group_of[i] == group]
        members[group] = []
        if own:
            done.append(own)
            absorbed: dict[tuple[int, int], list[int]] = {}
            for first in own:
                p = before[first]
                if p >= 0 and group_of[p] == group:
                    continue
                length, i = 0, first
                while i < n and group_of[i] == group:
                    length += 1
                    i = after[i]
                if i < n:
                    before[i] = p
                if p >= 0:
                    after[p] = i
                    key = (length, group_of[p])
                    if key in absorbed:
                        absorbed[key].append(p)
                    else:
                        absorbed[key] = [p]
            # Longer runs go in first, so that shorter ones end up below them.
            for key in sorted(absorbed, reverse=True):
                old, new, movers = key[1], len(members), absorbed[key]
                members.append(movers)
                for i in movers:
                    group_of[i] = new
                upper = above[old]
                above[old] = new
                above.append(upper)
                below.append(old)
                if upper >= 0:
                    below[upper] = new
        group = below[group]
    done.reverse()
    return done, after


def _emitted(groups: list[list[int]], ends: list[int]) -> np.ndarray:
    n = len(ends)
    free = [0] * n
    at = 0
    for group in groups:
        for i in group:
            free[i] = at
        at += len(group)
    # ``free`` holds a place for the group of each suffix; ``next_free`` counts it up.
    next_free = list(range(n))
    first_child, sibling = [-1] * (n + 1), [-1] * n
    for i, end in enumerate(ends):
        sibling[i] = first_child[end]
        first_child[end] = i
    order = [0] * n
    child = first_child[n]
    place = 0
    while True:
        while child >= 0:
            start = free[child]
            order[next_free[start]] = child
            next_free[start] += 1
            child = sibling[child]
        if place == n:
            break
        child = first_child[order[place]]
        place += 1
    return np.array(order, np.int64)
