"""Small relations with known answers."""

import datetime as dt

import pytest

from relspark.operators import constraint as c
from relspark.operators.orderer import ascending, by_locale, descending
from relspark.operators.relation import Ambiguous, NotFound, Range, Relation, RelationDef


def names(df, column="Name"):
    return "".join(r[column] for r in df.collect())


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "a@b.cd", "A", 0, 0), (1, "b@b.cd", "B", -1, 0), (2, "a@c.cd", "C", 0, 1), (2, "b@c.cd", "D", -1, 1)]
    df = spark.createDataFrame(rows, "TenantId long, Email string, Name string, Enum1 int, Enum2 int")
    return Relation(df, RelationDef(["TenantId", "Email"], secondary={"Email": ["Email"], "Signed": ["Enum1"], "Unsigned": ["Enum2"]}))


@pytest.fixture(scope="module")
def cube(spark):
    rows = [(a, b, d, 100 * a + 10 * b + d) for a in range(1, 6) for b in range(1, 6) for d in range(1, 6)]
    return Relation(spark.createDataFrame(rows, "N1 long, N2 long, N3 long, Id long"), RelationDef(["N1", "N2", "N3"]))


@pytest.fixture(scope="module")
def things(spark):
    rows = [(1, "A", 5), (1, "B", 6), (2, "C", 6), (3, "D", 7)]
    return Relation(spark.createDataFrame(rows, "Tenant long, Name string, Age long"), RelationDef(["Tenant", "Name"], secondary={"Name": ["Name", "Age"]}))


@pytest.mark.parametrize("prefix,want", [("a", "AC"), ("b", "BD"), ("", "ABCD"), ("c", "")])
def test_starts_with(people, prefix, want):
    assert names(people.scan_by(c.anything(), c.starts_with(prefix))) == want


def test_string_scans(people):
    assert names(people.scan_by(c.anything(), c.contains("b"))) == "ABD"
    assert names(people.scan_by(c.contains("b"), index="Email")) == "ABD"
    assert names(people.scan_by(c.contains(""), index="Email")) == "ACBD"
    assert names(people.scan_by(c.anything(), index="Signed")) == "BDAC"
    assert names(people.scan_by(c.exact(1), index="Unsigned")) == "CD"


def ids(df):
    return [r["Id"] for r in df.collect()]


def test_gather(cube):
    over3 = c.predicate(lambda x: x > 3)
    assert cube.gather_total(c.anything(), over3).first()[0] == 50
    assert ids(cube.gather(1, 2, c.anything(), over3)) == [142, 143]
    assert ids(cube.gather(-2, 5)) == [111, 112, 113]
    assert ids(cube.gather(0, 0)) == [] and ids(cube.gather(0, -1)) == []
    assert ids(cube.gather(0, 9, c.first(c.anything()), c.anything())) == [111]
    assert ids(cube.gather(0, 9, c.up_to(3), c.first(c.predicate(lambda x: x > 2)))) == [131, 231, 331]
    by_n2 = ids(cube.gather(0, 125, orderers=[descending("N2")]))
    assert by_n2 == sorted(ids(cube.scan()), key=lambda i: (-(i // 10 % 10), i))
    mixed = ids(cube.gather(0, 125, c.predicate(lambda x: x > 2), orderers=[ascending("N3"), descending("N2")]))
    assert mixed == sorted((i for i in ids(cube.scan()) if i > 300), key=lambda i: (i % 10, -(i // 10 % 10), i))
    with pytest.raises(ValueError, match="Id"):
        cube.gather(0, 1, orderers=[ascending("Id")])
    with pytest.raises(ValueError):
        cube.scan_by(*[c.anything()] * 4)


def test_first_and_last(things):
    assert names(things.gather(0, 9, index="Name", orderers=[descending("Tenant")])) == "DCAB"
    assert names(things.gather(1, 2, index="Name", orderers=[ascending("Tenant")])) == "BC"
    assert names(things.first(index="Name", orderers=[descending("Tenant")])) == "D"
    assert things.one(things.first(c.exact("Z"), index="Name"), default=True) is None
    with pytest.raises(NotFound):
        things.one(things.first(c.exact("Z"), index="Name"))
    assert names(things.last(c.anything(), c.exact(6), index="Name")) == "C"
    assert names(things.last(c.anything(), c.exact(5), index="Name")) == "A"
    assert names(things.last(c.first(c.anything()), c.exact(5), index="Name")) == ""
    assert names(things.last(index="Name", orderers=[descending("Tenant")])) == "A"
    assert names(things.last(index="Name", orderers=[ascending("Tenant")])) == "D"


def test_first_on_three_keys(spark):
    rows = [(1, i, v) for i in (1, 2) for v in (1, 2)] + [(2, i, v) for i in (1, 2, 3) for v in (1, 2, 3, 4)]
    rel = Relation(spark.createDataFrame(rows, "T long, I long, V long"), RelationDef(["T", "I", "V"]))
    found = lambda *cs: [tuple(r) for r in rel.scan_by(*cs).collect()]
    assert found(c.exact(1), c.anything(), c.first(c.anything())) == [(1, 1, 1), (1, 2, 1)]
    assert found(c.anything(), c.first(c.anything())) == [(1, 1, 1), (2, 1, 1)]
    assert found(c.anything(), c.first(c.anything()), c.exact(3)) == [(2, 1, 3)]
    assert found(c.anything(), c.first(c.anything()), c.exact(2)) == [(1, 1, 2), (2, 1, 2)]
    assert [tuple(r) for r in rel.last().collect()] == [(2, 3, 4)]
    assert [tuple(r) for r in rel.last(c.exact(1)).collect()] == [(1, 2, 2)]


def test_times_and_nulls(spark):
    t = dt.datetime(2024, 1, 1)
    rel = Relation(spark.createDataFrame([(t, "a"), (t + dt.timedelta(hours=1), "b"), (t + dt.timedelta(hours=2), "c")], "Time timestamp, Name string"), RelationDef(["Time"]))
    assert names(rel.scan_by(c.between(t, t + dt.timedelta(hours=1)))) == "ab"
    assert names(rel.scan_by(c.between(t + dt.timedelta(minutes=30), t + dt.timedelta(hours=1), including=False))) == ""
    rows = [(None, "N"), (dt.datetime(2024, 1, 1), "A"), (dt.datetime(2025, 1, 1), "B"), (dt.datetime(2026, 1, 1), "C")]
    rel = Relation(spark.createDataFrame(rows, "Time timestamp, Name string"), RelationDef(["Time"]))
    assert names(rel.scan()) == "NABC"
    assert names(rel.scan_by(c.predicate(lambda x: x.isNull()))) == "N"
    assert names(rel.scan_by(c.up_to(dt.datetime(2025, 1, 1)))) == "AB"
    assert names(rel.scan_by(c.up_to(dt.datetime(2025, 1, 1), including=False))) == "A"
    assert names(rel.scan_by(c.exact(None))) == "N"
    text = Relation(spark.createDataFrame([(None, "N"), ("b", "B"), ("A", "A"), ("é", "E")], "K string, Name string"), RelationDef(["K"]))
    assert names(text.scan()) == "ABEN"
    assert names(text.gather(0, 9, orderers=[descending("K")])) == "NEBA"
    assert names(text.scan_by(c.exact_ignoring_case(""))) == "N"


def test_floats_never_match_nan(spark):
    rel = Relation(spark.createDataFrame([(float("nan"), "N"), (1.0, "A")], "K double, Name string"), RelationDef(["K"]))
    assert names(rel.scan_by(c.exact(float("nan")))) == "" and names(rel.scan_by(c.exact(1.0))) == "A"


def test_lists(spark):
    rows = [(["a", "d"],), (["d"],), (["d", "e"],), ([],)]
    rel = Relation(spark.createDataFrame(rows, "K array<string>"), RelationDef(["K"]))
    assert rel.gather_total(c.list_contains("d")).first()[0] == 3 and rel.gather_total(c.list_contains("e")).first()[0] == 1
    rows = [(1, []), (1, [1]), (2, [1, 2]), (3, [2, 3, 4]), (3, [2, 2, 3, 4]), (2, [1, 2, 3, 4, 5])]
    rel = Relation(spark.createDataFrame(rows, "T long, U array<long>"), RelationDef(["T", "U"]))
    assert rel.gather_total(c.anything(), c.list_starts_with(1)).first()[0] == 3
    assert rel.gather_total(c.exact(3), c.list_starts_with(2)).first()[0] == 2


def test_locale(spark):
    rel = Relation(spark.createDataFrame([("Bob",), ("ach",), ("Ada",)], "K string"), RelationDef(["K"]))
    assert [r.K for r in rel.gather(0, 9, orderers=[by_locale("K", "en")]).collect()] == ["ach", "Ada", "Bob"]


def test_lookups(people, spark):
    assert people.find_one(1, "a@b.cd").Name == "A"
    assert people.find_one(9, "x", default=True) is None
    with pytest.raises(NotFound):
        people.find_one(9, "x")
    with pytest.raises(Ambiguous):
        people.find_one(0, index="Signed")
    assert people.contains(1) and not people.contains(3)
    assert names(people.list(bounds=Range(1, descending=True))) == "DCBA"
    assert names(people.page(position=1, count=2)) == "BC"
    excluded = Relation(spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "P long, S long"), RelationDef(["P"], secondary={"S": ["S"]}))
    assert excluded.count(bounds=Range(5, start_included=False), index="S").first()[0] == 1
    with pytest.raises(ValueError):
        RelationDef(["a", "b"], in_key=["a"])


def test_dereference_over_two_key_columns(spark):
    there = Relation(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "x long, y long, name string"), RelationDef(["x", "y"]))
    here = Relation(spark.createDataFrame([(1, 1, 2), (2, 2, 1), (3, 9, 9)], "k long, x long, y long"), RelationDef(["k"]))
    rows = here.dereference(["x", "y"], there, "to_").select("k", "to_name").orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, "b"), (2, "c"), (3, None)]
    with pytest.raises(ValueError):
        here.dereference("x", there)


def test_constraints_are_for_types(spark):
    rel = Relation(spark.createDataFrame([(1, "stra\u00dfe")], "k long, name string"), RelationDef(["k"], secondary={"Name": ["name"]}))
    for bad in (c.exact("x"), c.starts_with("x"), c.contains("x"), c.list_contains(1), c.exact(True)):
        with pytest.raises(TypeError):
            rel.scan_by(bad)
    with pytest.raises(TypeError):
        rel.scan_by(c.exact(1), index="Name")
    found = lambda x: rel.scan_by(x, index="Name").count()
    assert found(c.contains_ignoring_case("SS")) == 0 and found(c.contains_ignoring_case("STRA\u00dfE")) == 1 and found(c.exact_ignoring_case("STRA\u00dfE")) == 1
