"""Cutting texts into pieces that can be encoded alone, and a bounded cache of their ids.

A byte-level BPE pre-tokenizer never joins a character that is not white space with the
white space after it, so a text may be cut before each single space or line break and its
pieces encoded alone. Texts in which white space meets a cut are encoded whole.
"""

from __future__ import annotations

import re

#: Code points below this have the same classes in every Unicode version in use.
STABLE = 0x250
#: Bytes that one of the two generations of a task's cache may take.
CACHE_BYTES = 40 << 20
#: Bytes of an entry beyond its texts: two object headers and its place in the table.
ENTRY_BYTES = 200


class Generations:
    """A cache of text -> ids bounded in bytes: at half its bound the older half is dropped, so that
    texts met often, which move to the younger half, stay."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.used = limit, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __contains__(self, key: str) -> bool:
        return key in self.young or key in self.old

    def __getitem__(self, key: str) -> bytes:
        ids = self.young.get(key)
        if ids is None:
            ids = self.old[key]
            self.put(key, ids)
        return ids

    def put(self, key: str, ids: bytes) -> None:
        self.young[key] = ids
        self.used += ENTRY_BYTES + len(key) + len(ids)

    def shrink(self) -> None:
        """Called between batches: entries found in a batch stay until its end."""
        if self.used > self.limit:
            self.old, self.young, self.used = self.young, {}, 0


def cut_pieces(text: str) -> list[str] | None:
    """``text`` cut before each single space or line break; None where white space meets a cut."""
    head, *rest = text.replace("\n", " \n").split(" ")
    if not head or head[-1].isspace():
        return None
    for piece in rest:
        if not piece or piece[-1].isspace():
            return None
    return [head] + [piece if piece[0] == "\n" else " " + piece for piece in rest]


_BEFORE_SPACE = re.compile(r"(?<=\S)(?=[ \n])")


def cut_at_space(text: str) -> list[str]:
    """``text`` cut before each space or line break that follows no white space; runs of it stay whole."""
    return _BEFORE_SPACE.split(text) if text else []


#: Marks that a pre-token of letters or digits ends before; no special token ends with one.
TAIL = ".,!?;:*%#$&"


def cut_tail(piece: str, core: str) -> tuple[str, str]:
    """``piece`` in two where only marks follow ``core`` (the piece without them) and it ends in a known letter or digit."""
    if len(core) < len(piece) and core[-1].isalnum() and ord(core[-1]) < STABLE:
        return core, piece[len(core):]
    return piece, ""
