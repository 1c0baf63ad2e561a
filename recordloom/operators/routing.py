"""Which layout reads a resource, where its type and game alone don't tell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions import binary as B
from recordloom.plans.layout import Registry

#: Fixed places of the area header: first field of both layouts' actors, and the map notes.
ACTORS, OLD_ACTORS, MARK, NOTES, NOTE_COUNT = 0x54, 0x84, 0xC4, 0xC8, 0xCC
#: The mark of the older area layout, the number of notes from which it is none.
MARKED, TOO_MANY = 0xFFFFFFFF, 0x100000


def version(content: Column) -> Column:
    return F.regexp_replace(F.decode(B.slice_at(content, 4, 4), "ISO-8859-1"), "\\x00+$", "")


def routed(restype: Column, game: Column, content: Column, registry: Registry) -> Column:
    """(name, game) of the layout for each resource, null for those that have no sections.

    An older layout is taken only if the registry has it. Creatures of PSTEE in version V1.1
    are read by PST's if the item slots that it points to lie within the resource, those of
    IWD2 in version V9.1 by IWD's; areas of PSTEE in version V1.0 by PST's if they have its
    mark with plausible notes, or actors only where it has them.
    """
    size, at = F.length(content), version(content)
    of = lambda name, own: F.struct(F.lit(name).alias("name"), own.alias("game"))
    # what is missing at the end reads as zero
    number = lambda place: B.uint_le(F.concat(content, F.lit(bytes(4))), place, 4)
    rules = [(restype == "PVRZ", F.lit(None)), ((restype == "BAM") & (size >= 8) & (F.trim(at) == "V2"), of("BAM_V2", game))]
    old = registry.by_key.get(("CRE", "PST"))
    slots = next((s for s in old.sections if s.name == "item_slots"), None) if old else None
    pointer = next((f.offset for f in old.header.fields if f.name == "offset_to_item_slots"), None) if old else None
    if slots and pointer is not None:
        first = B.uint_le(content, pointer, 4)
        rules.append(((restype == "CRE") & (game == "PSTEE") & (at == "V1.1") & (first > 0) & (first + slots.stride <= size), of("CRE", F.lit("PST"))))
    if ("CRE", "IWD") in registry.by_key:
        rules.append(((restype == "CRE") & (game == "IWD2") & (at == "V9.1"), of("CRE", F.lit("IWD"))))
    if ("ARE", "PST") in registry.by_key:
        notes = F.coalesce(number(NOTES), F.lit(0))
        marked = (B.uint_le(content, MARK, 4) == MARKED) & ((notes == 0) | ((notes <= size) & (F.coalesce(number(NOTE_COUNT), F.lit(0)) < TOO_MANY)))
        moved = (number(ACTORS) == 0) & (number(OLD_ACTORS) > 0)
        rules.append(((restype == "ARE") & (game == "PSTEE") & (size >= OLD_ACTORS + 4) & (at == "V1.0") & (F.coalesce(marked, F.lit(False)) | moved), of("ARE", F.lit("PST"))))
    out = F.struct(restype.alias("name"), game.alias("game"))
    for condition, layout in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), layout).otherwise(out)
    return out
