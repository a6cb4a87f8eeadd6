"""Context-free text units for byte-level BPE.

The split pattern of the vocabulary never joins a character that is not white
space with white space after it.  So a text may be cut before each space that
follows something else, and every piece is tokenized on its own: the tokens of
the text are the tokens of its pieces, one after the other.  Pieces repeat
(they are mostly one word), so what is known of a piece is kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Unicode White_Space, as \\s of the vocabulary's pattern has it.
SPACE = "\t-\r \x85\xa0  -     　"
_EDGE = re.compile(f"^[{SPACE}]|[{SPACE}]$")
_CUT = re.compile(f"(?<=[^{SPACE}])(?= )")
#: Entries kept per process; beyond that the memory is emptied and fills again.
KEEP = 400_000
SPECIAL = "<|endoftext|>"


class _Unsafe(Exception):
    """A unit that begins or ends with white space: its neighbours matter."""


class Memo(dict):
    """unit -> value(" " + unit), filled on demand."""

    def __init__(self, value: Callable[[str], object], keep: int):
        super().__init__()
        self.value, self.keep = value, keep

    def __missing__(self, unit: str):
        if not unit or _EDGE.search(unit):
            raise _Unsafe
        if len(self) >= self.keep:
            self.clear()
        out = self[unit] = self.value(" " + unit)
        return out


class Units:
    """Applies ``value`` to the units of a text; gives the values in order."""

    def __init__(self, value: Callable[[str], object], keep: int = KEEP):
        self.value, self.memo = value, Memo(value, keep)

    def of(self, part: str) -> list:
        """Values of the units of a text that has no special token."""
        if not part:
            return []
        first, *rest = part.split(" ")
        try:
            if first and rest and _EDGE.search(first[-1]):
                raise _Unsafe
            if not first and rest:
                head = []
                if not rest[0]:
                    raise _Unsafe
            else:
                head = [self.value(first)]
            return head + list(map(self.memo.__getitem__, rest))
        except _Unsafe:
            return [self.value(x) for x in _CUT.split(part)]
