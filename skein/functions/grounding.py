"""Where in a text the strings stand that an extractor says are in it.

A string's places are tried in turn: as it is, with whole words at both ends; word by word without regard to case and to what lies
between the words; and at last the longest run of its words that the text has, if that is at least SHARE of them. The same string
several times takes its places one after the other, and the last one again when they run out.
"""

from __future__ import annotations

import re

#: Words, and the share of a string's words that a run must have.
WORD, SHARE = re.compile(r"\w+"), 0.5

Place = tuple[int, int]


def _exact(text: str, name: str) -> list[Place]:
    """Occurrences that neither begin nor end within a word; they don't overlap."""
    out, at = [], text.find(name)
    while at >= 0:
        end = at + len(name)
        inside = WORD.match(name[0]) and at and WORD.match(text[at - 1]) or WORD.match(name[-1]) and end < len(text) and WORD.match(text[end])
        if not inside:
            out.append((at, end))
        at = text.find(name, at + 1 if inside else end)
    return out


def _runs(words: list[tuple[str, int, int]], name: list[str]) -> list[Place]:
    """Places of consecutive words, which don't overlap."""
    out, i, n = [], 0, len(name)
    while i + n <= len(words):
        if all(words[i + k][0] == name[k] for k in range(n)):
            out.append((words[i][1], words[i + n - 1][2]))
            i += n
        else:
            i += 1
    return out


def _longest(words: list[tuple[str, int, int]], name: list[str], share: float) -> list[Place]:
    """Places of the longest run of a name's words, of equally long ones the one that begins first in the name."""
    at: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        at.setdefault(w[0], []).append(i)
    best = (0, 0)
    for k in range(len(name)):
        for i in at.get(name[k], ()):
            n = 0
            while k + n < len(name) and i + n < len(words) and words[i + n][0] == name[k + n]:
                n += 1
            best = max(best, (n, -k))
    n, k = best[0], -best[1]
    return _runs(words, name[k : k + n]) if n and n >= share * len(name) else []


def places(text: str, names: list[str], share: float = SHARE) -> list[Place | None]:
    """(start, end) of each name, None for those that aren't in the text."""
    words = [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text)]
    found: dict[str, list[Place]] = {}
    taken: dict[str, int] = {}
    out: list[Place | None] = []
    for name in names:
        name = name.strip()
        if name not in found:
            own = [w.lower() for w in WORD.findall(name)]
            found[name] = (_exact(text, name) or (own and (_runs(words, own) or _longest(words, own, share))) or []) if name else []
        k = taken.get(name, 0)
        taken[name] = k + 1
        out.append(found[name][min(k, len(found[name]) - 1)] if found[name] else None)
    return out
