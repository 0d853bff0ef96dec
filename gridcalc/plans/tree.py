"""Formula trees and references."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from gridcalc.errors import InvalidReference


class RefType(Enum):
    """Whether the first and the last row of a reference move with the formula's row (R) or stay (F)."""

    RR = "RR"
    RF = "RF"
    FR = "FR"
    FF = "FF"


@dataclass(frozen=True)
class Ref:
    """A rectangle of cells, zero-based and inclusive, as the formula in the first row sees it."""

    row: int
    column: int
    last_row: int
    last_column: int
    kind: RefType
    is_cell: bool
    text: str

    @property
    def columns(self) -> range:
        return range(self.column, self.last_column + 1)


@dataclass(frozen=True)
class Literal:
    value: object
    text: str


@dataclass(frozen=True)
class Call:
    """A function or operator with its arguments; operators are named by their sign, the prefix minus by NEGATE."""

    name: str
    args: tuple
    text: str


def column_index(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def column_letters(index: int) -> str:
    out = ""
    index += 1
    while index:
        index, r = divmod(index - 1, 26)
        out = chr(65 + r) + out
    return out


def parse_reference(text: str) -> Ref:
    def corner(part: str) -> tuple[int, int, bool]:
        body = part.lstrip("$")
        k = 0
        while body[k].isalpha():
            k += 1
        letters, rest = body[:k], body[k:]
        row = int(rest.lstrip("$")) - 1
        if row < 0:
            raise InvalidReference(f"rows count from 1: {text}")
        return row, column_index(letters), rest.startswith("$")

    first, _, last = text.partition(":")
    r1, c1, f1 = corner(first)
    r2, c2, f2 = corner(last) if last else (r1, c1, f1)
    if c2 < c1:
        c1, c2 = c2, c1
    if r2 < r1 and f1 == f2:
        r1, r2 = r2, r1
    return Ref(r1, c1, r2, c2, RefType(("F" if f1 else "R") + ("F" if f2 else "R")), not last, text)
