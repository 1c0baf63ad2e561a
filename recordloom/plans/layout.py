"""Layouts: what a binary resource is made of, declared as data and checked once."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

#: Width in bytes of the number types; a declared size overrides it.
WIDTHS = {
    "byte": 1, "char": 1, "word": 2, "dword": 4, "sbyte": 1, "schar": 1, "sword": 2, "short": 2, "sdword": 4,
    "bitfield": 4, "bitmask": 4, "enum": 2, "resref": 8, "strref": 4,
}
SIGNED = {"sbyte", "schar", "sword", "short", "sdword"}
SIZED = {"char_array", "bytes", "byte_array", "word_array", "strref_array", "resref_array", "word_scalar_array"}
ENTRY_WIDTHS = {"byte_array": 1, "word_array": 2, "word_scalar_array": 2, "strref_array": 4, "resref_array": 8}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    offset: int
    size: int
    attributes: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Section:
    """A repeating group; count is a number, a field's name, or rest; one entry without it."""

    name: str
    fields: tuple[Field, ...]
    offset_field: str | None = None
    offset_from: tuple[str, int, str] | None = None
    count: Any = None
    promote: bool = False
    #: (section, field, stride field): pointers into this section that entries of another hold.
    offset_update: tuple[str, str, str | None] | None = None

    @property
    def stride(self) -> int:
        return sum(f.size for f in self.fields)


@dataclass(frozen=True)
class Layout:
    name: str
    version: str
    games: tuple[str, ...]
    sections: tuple[Section, ...]

    @property
    def header(self) -> Section:
        return self.sections[0]


def width(kind: str, declared: Mapping[str, Any]) -> int:
    if "size" in declared:
        return int(declared["size"])
    if kind in ENTRY_WIDTHS and "count" in declared:
        return int(declared["count"]) * int(declared.get("entry_size", ENTRY_WIDTHS[kind]))
    if kind in ("computed", "pointer_string") or "size_ref" in declared:
        return 0
    if kind in WIDTHS:
        return WIDTHS[kind]
    raise ValueError(f"type {kind!r} needs a size" if kind in SIZED else f"no type {kind!r}")


def section(name: str, declared: Mapping[str, Any]) -> Section:
    """Fields must be named once and stand one right after the other."""
    fields: list[Field] = []
    at = 0
    for entry in declared["fields"]:
        kind, own = entry["type"], {k: v for k, v in entry.items() if k not in ("name", "type", "offset")}
        size = width(kind, own)
        if any(f.name == entry["name"] for f in fields):
            raise ValueError(f"{name}: two fields {entry['name']!r}")
        if size and entry.get("offset", at) != at:
            raise ValueError(f"{name}.{entry['name']}: declared at {entry['offset']}, follows at {at}")
        fields.append(Field(entry["name"], kind, at, size, own))
        at += size
    origin, update = declared.get("offset_from"), declared.get("offset_update")
    return Section(
        name, tuple(fields), declared.get("offset_field"),
        (origin["section"], int(origin.get("index", 0)), origin["field"]) if origin else None,
        declared.get("count"), bool(declared.get("promote", False)),
        (update["section"], update["field"], update.get("stride_expr", {}).get("field")) if update else None,
    )


def layout(declared: Mapping[str, Any]) -> Layout:
    """A checked layout from its declaration (name, version, games, sections in order)."""
    sections = tuple(section(n, d) for n, d in declared["sections"].items())
    if not sections or sections[0].name != "header":
        raise ValueError("a layout starts with its header")
    known = {f.name for f in sections[0].fields}
    for s in sections[1:]:
        if s.offset_from is None and s.offset_field not in known:
            raise ValueError(f"{s.name}: its offset field {s.offset_field!r} is not in the header or a promoted section")
        if s.promote:
            known |= {f.name for f in s.fields}
    return Layout(declared["name"], str(declared.get("version", "")), tuple(declared.get("games", ())), sections)


class Registry:
    """Layouts by name, and by game where one declares games."""

    def __init__(self, layouts: Iterable[Layout] = ()):
        self.by_key: dict[tuple[str, str | None], Layout] = {}
        for x in layouts:
            self.add(x)

    def add(self, x: Layout) -> None:
        for game in x.games or (None,):
            self.by_key[x.name, game] = x

    def get(self, name: str, game: str | None = None) -> Layout | None:
        return self.by_key.get((name, game)) or self.by_key.get((name, None))

    @classmethod
    def from_json(cls, text: str) -> Registry:
        return cls(layout(d) for d in json.loads(text))
