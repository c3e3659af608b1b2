"""Problem 4: occurrences and records of every term, by last-seen counters.

A term is a longest run of letters in a block, in lower case.  Within a task the
records come one after another, so a term's counter needs only its occurrences,
its records and the last record that it was seen in; no set of records is kept.
Records never span tasks, so counters of several tasks add up exactly.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable

#: Characters that the regex engine takes for word characters and that are no letters.
_NUMERIC = "".join(re.escape(c) for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isdecimal() and not c.isalpha())
_LETTERS = re.compile(rf"[^\W\d_{_NUMERIC}]+")
_NEARLY = re.compile(r"[^\W\d_]+")
#: Counters that a task holds before it hands them on.
HELD = 400_000


def letter_runs(text: str) -> list[str]:
    """Longest runs of letters (category L).

    The engine's word characters hold letters and some numeric signs; the rare
    runs with such a sign are split again.
    """
    found = _NEARLY.findall(text)
    if "".join(found).isalpha():
        return found
    out = []
    for t in found:
        if t.isalpha():
            out.append(t)
        else:
            out += _LETTERS.findall(t)
    return out


def terms(blocks: list[str]) -> list[str]:
    """Terms of a record's blocks, one per occurrence."""
    return [t.lower() for t in letter_runs("\n".join(blocks))]


class LastSeen:
    """Counters ``term -> [occurrences, records, last record]``."""

    def __init__(self):
        self.of: dict[str, list[int]] = {}
        self.record = 0

    def add(self, found: Iterable[str]) -> None:
        """Count one record's terms as they come; they are read once and not kept."""
        self.record += 1
        now, of = self.record, self.of
        for t in found:
            c = of.get(t)
            if c is None:
                of[t] = [1, 1, now]
            else:
                c[0] += 1
                if c[2] != now:
                    c[1] += 1
                    c[2] = now

    def drain(self) -> tuple[list[str], list[int], list[int]]:
        out = list(self.of), [c[0] for c in self.of.values()], [c[1] for c in self.of.values()]
        self.of = {}
        return out
