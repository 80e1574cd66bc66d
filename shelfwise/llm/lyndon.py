"""Suffix arrays in linear time by grouping suffixes of one Lyndon prefix."""

from __future__ import annotations

from collections.abc import Sequence


def lyndon_suffix_array(text: Sequence[int]) -> list[int]:
    """The suffix array of text, without recursion or renaming.

    First all suffixes are grouped by their first symbol. Groups are taken in descending order; each suffix of
    the group points to the nearest earlier one of a smaller group, whose Lyndon prefix grows by this group's: with
    more of them it goes into a later part of its group. Then groups hold the suffixes of one Lyndon prefix, in
    order, and one ascending pass places each suffix when the one that follows its Lyndon prefix is placed.
    """
    n = len(text)
    # the empty suffix n is the smallest
    order = sorted(range(n), key=text.__getitem__)
    start, members = [0] * (n + 1), {0: {n}}
    group_at, begin = None, 0
    for place, i in enumerate(order, 1):
        if group_at is None or text[i] != group_at:
            group_at, begin = text[i], place
            members[begin] = set()
        members[begin].add(i)
        start[i] = begin
    before = [-1] * (n + 1)
    for place in range(n, 0, -1):
        group = members.get(place)
        if not group:
            continue
        grown: dict[int, int] = {}
        for i in sorted(group):
            p = i - 1
            while p >= 0 and start[p] >= place:
                p = before[p]
            before[i] = p
            if p >= 0:
                grown[p] = grown.get(p, 0) + 1
        split: dict[int, dict[int, list[int]]] = {}
        for p, count in grown.items():
            split.setdefault(start[p], {}).setdefault(count, []).append(p)
        for old, parts in split.items():
            stay = members[old]
            for moved in parts.values():
                stay.difference_update(moved)
            at = old + len(stay)
            if not stay:
                del members[old]
            for count in sorted(parts):
                members[at] = set(parts[count])
                for i in parts[count]:
                    start[i] = at
                at += len(parts[count])
    free = {place: place for place in members}
    out, placed = [-1] * (n + 1), [False] * (n + 1)
    out[0], placed[n] = n, True
    for r in range(n + 1):
        j = out[r] - 1
        while j >= 0 and not placed[j]:
            g = start[j]
            out[free[g]], placed[j] = j, True
            free[g] += 1
            j = before[j]
    return out[1:]
