"""Wide tables by declared references, and hierarchies with depth and circles."""

import pytest

from tablewright.operators import marts


def test_mart(spark):
    """Composite keys, two ways to one table, missing and repeated targets; rows never multiply."""
    sale = spark.createDataFrame([(1, 10, 20, "x", 1), (2, 10, None, "y", 9), (3, 30, 10, None, None)], "id int, seller int, buyer int, shop string, no int")
    person = spark.createDataFrame([(10, "ann", 7), (20, "bob", 8), (20, "abe", 7), (None, "nobody", 7)], "pid int, name string, town int")
    town = spark.createDataFrame([(7, "rome"), (8, "oslo")], "tid int, name string")
    shop = spark.createDataFrame([("x", 1, 5.0), ("y", 2, 6.0)], "shop string, no int, rent double")
    refs = [("sale", ("seller",), "person", ("pid",)), ("sale", ("buyer",), "person", ("pid",)), ("person", ("town",), "town", ("tid",)), ("sale", ("shop", "no"), "shop", ("shop", "no"))]
    got = marts.mart({"sale": sale, "person": person, "town": town, "shop": shop}, "sale", refs)
    assert got.columns[:5] == sale.columns and len(set(got.columns)) == len(got.columns) == 12
    rows = {r.id: r for r in got.collect()}
    assert len(rows) == got.count() == 3
    assert rows[1]["person_by_seller_town_name"] == "rome" and rows[1]["person_by_buyer_name"] == "abe" and rows[1]["rent"] == 5.0
    assert rows[2]["person_by_buyer_name"] is None and rows[2]["rent"] is None and rows[3]["person_by_seller_name"] is None and rows[3]["person_by_buyer_town_name"] == "rome"
    assert marts.mart({"sale": sale.where("false"), "person": person, "town": town, "shop": shop}, "sale", refs).count() == 0
    with pytest.raises(ValueError, match="circle: a -> b -> a"):
        marts.join_tree("a", [("a", ("x",), "b", ("y",)), ("b", ("z",), "a", ("w",))])


def test_ancestors(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (1, 2), (4, 4), (None, 1), (5, None), (6, 7), (7, 8), (8, 6), (9, 6)], "c long, p long")
    got = sorted(map(tuple, marts.ancestors(links, "c", "p").collect()))
    plain = [(1, 2, 1, False), (1, 3, 1, False), (2, 3, 1, False)]
    circle = [(a, b, (b - a) % 3 or 3, True) for a in (6, 7, 8) for b in (6, 7, 8)]
    assert got == sorted(plain + circle + [(9, 6, 1, False), (9, 7, 2, False), (9, 8, 3, False)])
    assert marts.ancestors(links.where("false"), "c", "p").count() == 0
