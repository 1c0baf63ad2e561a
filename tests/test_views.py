"""Views of layouts, checks of values, requests by name, detail levels."""

import pytest
from pyspark.sql import functions as F

from recordloom.operators import audit, projection, search
from recordloom.plans.projection import view
from recordloom.queries.viewing import ACCOUNT


def groups(*fields, **more):
    return {"groups": [{"name": "G", "fields": list(fields), **more}]}


def test_fields_must_be_clear():
    with pytest.raises(ValueError, match="several sections .orders, lines."):
        view(groups({"name": "key"}), ACCOUNT)
    with pytest.raises(ValueError, match="no field 'nothing'"):
        view(groups({"name": "nothing"}), ACCOUNT)
    with pytest.raises(ValueError, match="entries of its own"):
        view(groups({"name": "key", "section": "lines"}), ACCOUNT)
    with pytest.raises(ValueError, match="no part 'size'"):
        view(groups({"name": "x", "from_bitfield": {"field": "state", "subfield": "size"}}, repeating=True, from_section="orders"), ACCOUNT)
    with pytest.raises(ValueError, match="needs first and count"):
        view(groups({"name": "In", "repeating": True, "from_section": "lines", "fields": []}, repeating=True, from_section="orders"), ACCOUNT)


def test_fields_of_other_games_are_left_out():
    declared = groups({"name": "orders", "from": {"A": "order_count"}, "games": ["A"]}, {"name": "mark", "from": "signature", "games": ["B"]})
    assert [f.source for f in view(declared, ACCOUNT, "A")["G"].fields] == ["order_count"]
    assert [f.source for f in view(declared, ACCOUNT, "B")["G"].fields] == ["signature"]


def test_problems(spark):
    g = view(groups({"name": "a", "from": "order_count", "min": 1, "max": 3}, {"name": "b", "from": "line_count", "nullable": False}), ACCOUNT)["G"]
    rows = spark.createDataFrame([(0, 1), (1, None), (4, 1), (None, 1), (3, 0)], "a int, b int")
    assert [r[0] for r in rows.select(projection.problems(g)).collect()] == [["a"], ["b"], ["a"], [], []]


def test_inner_entries_end_with_their_section(spark):
    g = view(groups({"name": "number", "section": "orders", "from": "key"}, {"name": "In", "repeating": True, "from_section": "lines", "first": "first_line", "count": "lines", "fields": [{"name": "number"}]}, repeating=True, from_section="orders"), ACCOUNT)["G"]
    orders = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 1, 4_000_000_000), (1, 2, 9, 1), (1, 3, 0, 0), (2, 0, 0, 1)], "id int, entry int, first_line long, lines long")
    lines = spark.createDataFrame([(1, k, 10 + k) for k in range(3)], "id int, entry int, number long")
    rows = projection.nested({"orders": orders, "lines": lines}, g, g.inner[0], ["id"])
    assert sorted(map(tuple, rows.collect())) == [(1, 0, 0, 10), (1, 0, 1, 11), (1, 1, 0, 11), (1, 1, 1, 12)]
    told = projection.controls(orders, rows, ["id"])
    assert sorted(map(tuple, told.collect())) == [(1, 0, 0, 2), (1, 1, 2, 2), (1, 2, 4, 0), (1, 3, 4, 0), (2, 0, 0, 0)]
    assert projection.controls(orders, rows.limit(0), ["id"]).agg(F.sum("count")).first()[0] == 0


def test_requests_by_name(spark):
    index = spark.createDataFrame([("SW1H01", "ITM"), ("SW1H01", "BAM"), ("misc", "ITM"), (None, "ITM")], "resref string, restype string")
    wanted = spark.createDataFrame([("sw1h01",), ("sw1h01.bam",), ("MISC",), ("misc.spl",), ("none",), ("sw1h01",), (None,)], "request string")
    assert {r[0]: (r[1], r[2]) for r in search.opened(wanted, index).where("request is not null").collect()} == {
        "sw1h01": ("ambiguous", ["BAM", "ITM"]), "sw1h01.bam": ("found", ["BAM"]), "MISC": ("found", ["ITM"]), "misc.spl": ("missing", []), "none": ("missing", []),
    }


def test_detail_levels(spark):
    gaps = spark.createDataFrame([(0, 8, 0, 0), (0, 8, 1, 0), (0, 9, 0, 5), (0, 20, 2, 5)], "start long, end long, pointer_hits long, nz long")
    sizes = lambda level, **more: [[(c["entry_size"], c["entry_count"], c["confidence"]) for c in r["candidates"]] for r in audit.detailed(gaps, F.col("nz"), level, **more).collect()]
    assert sizes("summary") == [[], [], [], []]
    assert sizes("nonzero") == [[], [(2, 4, "low"), (4, 2, "low"), (8, 1, "low")], [], [(2, 10, "high"), (4, 5, "high")]]
    assert sizes("full", most=0)[0] == [(2, 4, "low")]
    assert sizes("full", layout="WED")[3][2:] == [(10, 2, "high"), (4, 5, "high")]
    with pytest.raises(ValueError):
        audit.detailed(gaps, F.col("nz"), "all")
