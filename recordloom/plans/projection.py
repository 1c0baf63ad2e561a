"""Views of a layout: groups of fields under names of their own, checked once against it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from recordloom.plans.layout import Field, Layout


@dataclass(frozen=True)
class Shown:
    """A field of a view: a field of a section, or a part of its bits."""

    name: str
    section: str
    source: str
    part: str | None = None
    least: float | None = None
    most: float | None = None
    nullable: bool = True


@dataclass(frozen=True)
class Group:
    """Fields of one resource, or of each entry of a section; inner groups have the entries
    that the fields first and count of the outer section's entry name."""

    name: str
    section: str
    fields: tuple[Shown, ...]
    repeating: bool = False
    first: str | None = None
    count: str | None = None
    inner: tuple[Group, ...] = ()


def found(layout: Layout, name: str, hint: str | None) -> tuple[str, Field]:
    """The section and field of that name; without a hint it must be in one section only."""
    hits = [(s.name, f) for s in layout.sections for f in s.fields if f.name == name and hint in (None, s.name)]
    if not hits:
        raise ValueError(f"no field {name!r}" + (f" in {hint}" if hint else ""))
    if len(hits) > 1:
        raise ValueError(f"field {name!r} is in several sections ({', '.join(s for s, _ in hits)}): name one")
    return hits[0]


def shown(declared: Mapping[str, Any], layout: Layout, section: str | None, game: str | None) -> Shown:
    origin, part = declared.get("from", declared["name"]), None
    if isinstance(origin, Mapping):
        origin = origin.get(game, declared["name"])
    if "from_bitfield" in declared:
        origin, part = declared["from_bitfield"]["field"], declared["from_bitfield"]["subfield"]
    where, field = found(layout, origin, declared.get("section", section))
    if part is not None and part not in field.attributes.get("bitfields", {}):
        raise ValueError(f"{origin} has no part {part!r}")
    return Shown(declared["name"], where, origin, part, declared.get("min"), declared.get("max"), bool(declared.get("nullable", True)))


def group(declared: Mapping[str, Any], layout: Layout, game: str | None, nested: bool = False) -> Group:
    """Fields that are declared for other games are left out."""
    repeating = bool(declared.get("repeating", False))
    section = declared.get("from_section")
    if repeating and section not in {s.name for s in layout.sections}:
        raise ValueError(f"{declared['name']}: no section {section!r}")
    if nested and not ("first" in declared and "count" in declared):
        raise ValueError(f"{declared['name']}: an inner group needs first and count")
    own = [d for d in declared["fields"] if game is None or game in d.get("games", [game])]
    fields = tuple(shown(d, layout, section, game) for d in own if not d.get("repeating"))
    single = {"header", *(s.name for s in layout.sections if s.promote)}
    for f in fields:
        if f.section != section if repeating else f.section not in single:
            raise ValueError(f"{declared['name']}.{f.name}: section {f.section} has entries of its own")
    inner = tuple(group(d, layout, game, nested=True) for d in own if d.get("repeating"))
    return Group(declared["name"], section or "header", fields, repeating, declared.get("first"), declared.get("count"), inner)


def view(declared: Mapping[str, Any], layout: Layout, game: str | None = None) -> dict[str, Group]:
    """The groups of a view by name; wrong or ambiguous fields are errors before anything runs."""
    return {d["name"]: group(d, layout, game) for d in declared["groups"]}
