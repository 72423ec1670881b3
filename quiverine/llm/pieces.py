"""Cutting texts where every pre-token pattern of the byte-level vocabularies cuts, and a bounded memo.

The pattern never joins a non-space with a space after it: only a space that
follows white space can share a match with what stands before it. So a text may
be cut before each space that follows a non-space, and the parts encoded alone.
Parts recur, so their results are kept by part.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

# Python's white space holds the pattern's white space, so fewer cuts are made here, never more.
_RUN = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")


def parts(text: str) -> list[str]:
    """The text cut before spaces; every part but the first has lost its leading space."""
    return _CUT.split(text) if _RUN.search(text) else text.split(" ")


class Memo(dict):
    """``make(key)`` by key; forgets all at ``most`` entries, and keeps no key over ``longest`` characters."""

    def __init__(self, make: Callable[[str], Any], most: int = 400_000, longest: int = 48) -> None:
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key: str) -> Any:
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value
