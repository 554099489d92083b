"""Changes, collections, conditions, upgrades, snapshots, pairs and logs."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspark.functions import casts, nested
from relspark.operators import mutate
from relspark.operators.collections import Bitmap, OrderedDictionary
from relspark.operators.objects import Objects
from relspark.operators.relation import NotFound, Range, RelationDef
from relspark.plans.query import Field, Query
from relspark.plans.upgrade import Version, check_key, upgraded
from relspark.sources import pairs
from relspark.sources.store import Store
from relspark.sources.work import kept, ranked, work_path
from relspark.streaming import events as log

KV = RelationDef(["k"])


def content(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def kv(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")


def test_upserts(spark, kv):
    new = spark.createDataFrame([(2, "B"), (3, "c"), (None, "N")], "k long, v string")
    assert content(mutate.insert(kv, new, KV)[0]) == content(spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (3, "c")], kv.schema))
    assert content(mutate.insert(kv, new, KV)[1]) == [(1, 2)]
    out, counts = mutate.upsert(kv, new, KV)
    assert content(out) == content(spark.createDataFrame([(1, "a"), (2, "B"), (None, "N"), (3, "c")], kv.schema)) and content(counts) == [(1, 2)]
    several = spark.createDataFrame([(5, "x", 1), (5, "y", 2), (1, "z", 3)], "k long, v string, s int")
    out, counts = mutate.upsert(kv, several, KV, "s")
    assert ("y",) in content(out.select("v")) and ("x",) not in content(out.select("v")) and content(counts) == [(1, 2)]
    with pytest.raises(NotFound):
        mutate.update(kv, new, KV)
    assert content(mutate.update_by_id(kv, {"k": None}, {"v": "q"})[0]) == [(1, "a"), (2, "b"), (None, "q")]


def test_removals(spark):
    d = RelationDef(["c", "e"])
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (None, 9)], "c long, e long")
    out, counts = mutate.remove(df, d, bounds=Range(1, 2, end_included=False))
    assert content(counts) == [(2,)] and out.count() == 4
    assert content(mutate.remove(df, d, 2, veto=F.col("e") == 2)[1]) == [(1,)]
    out, counts = mutate.remove_partial(df, d, 2, 2, veto=F.col("e") == 1)
    assert content(counts) == [(1,)] and out.count() == 5
    assert mutate.remove_all(df).count() == 0 and mutate.remove_all(df, F.col("c") == 1).count() == 2
    ids = mutate.allocate_ids(df, [F.col("c"), F.col("e")], 10, "id")
    assert content(ids.select("id")) == [(k,) for k in range(10, 16)]


def test_ranked_over_many_ranges(spark):
    df = kept(spark.range(5000).withColumn("x", (F.col("id") * 7919) % 1000))
    got = {r.id: r.rn for r in ranked(df.repartition(7), [F.col("x"), F.col("id")]).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda p: p[1])] == sorted(range(5000), key=lambda i: (i * 7919 % 1000, i)) and sorted(got.values()) == list(range(1, 5001))


def test_dictionary(spark):
    d = OrderedDictionary(spark.createDataFrame([(1, "A"), (3, "C")], "key int, value string"))
    text = lambda df: "".join(r.value for r in df.collect())
    assert text(d.reverse()) == "CA" and text(d.increasing(2)) == "C" and text(d.increasing(4)) == ""
    assert text(d.decreasing(0)) == "" and text(d.decreasing(2)) == "A" and text(d.decreasing(4)) == "CA"
    assert content(d.remove_range(Range(3, 1))[1]) == [(0,)] and content(d.upsert(spark.createDataFrame([(3, "X")], "key int, value string")).df) == [(1, "A"), (3, "X")]


def test_bitmap(spark):
    make = lambda *v: Bitmap.of(spark.createDataFrame([(x,) for x in v], "x long"), "x")
    got = make(1, 2, 65537, 131074).either(make(2, 65538, 131074, 196611)).both(make(2, 196611).negate(200_000))
    assert content(got.df) == [(1,), (131074,), (65537,), (65538,)] and content(got.count()) == [(4,)]
    assert content(make(1, 65537).negate(65538).count()) == [(65537,)]
    assert content(make(1, 5).negate(9).negate(3).df) == [(1,)]
    assert content(make(1, 65537).pages()) == [(0, 1), (1, 1)]


def test_conditions(spark):
    rows = [(1, "ada@example.com", "Ada", 41.0), (1, "bob@example.com", "Bob", float("nan")), (2, "c@example.com", None, 28.0)]
    q = Query(spark.createDataFrame(rows, "t long, email string, name string, age double"), ["email"])
    assert len(content(q.where((Field("email") == "ada@example.com") | (Field("name") == None)).df())) == 2  # noqa: E711
    assert content(q.where(Field("age") == float("nan")).df()) == []
    assert content(q.where(Field("t") == 1).where(Field("name") == "Bob").df()) == [("bob@example.com",)]
    with pytest.raises(TypeError):
        Field("t") == Field("age")


def test_upgrade(spark):
    old = spark.createDataFrame([(1, 300, True, 2.9), (2, None, False, float("nan"))], "id int, n int, b boolean, f double")
    to = Version(T._parse_datatype_string("id bigint, n tinyint, b string, f int, l array<string>, added string"), {"added": "d"})
    assert [tuple(r) for r in upgraded(old, to).orderBy("id").collect()] == [(1, 44, "1", 2, None, "d"), (2, None, "0", None, None, "d")]
    lists = spark.createDataFrame([("x",), (None,)], "l string")
    assert content(upgraded(lists, Version(T._parse_datatype_string("l array<string>")))) == [(["x"],), ([],)]
    with pytest.raises(ValueError):
        check_key(T._parse_datatype_string("id int"), T._parse_datatype_string("id string"), ["id"])


def test_casts_and_nested(spark):
    one = spark.range(1)
    assert one.select(casts.version_text(casts.version_parts(F.lit("1.2.3")))).first()[0] == "1.2.3"
    assert [one.select(casts.wrap(F.lit(x), "tinyint")).first()[0] for x in (128, -129, 255, 5)] == [-128, 127, -1, 5]
    v = nested.parse(F.lit('{"first": [0, 1], "last": [10, 11], "n": null}'))
    got = one.select(nested.at(v, "$.last[1]", "int"), nested.is_null(v, "$.n"), nested.is_null(v, "$.x"), nested.is_undefined(v, "$.x"), nested.parse(F.lit("{")).isNull()).first()
    assert tuple(got) == (11, True, False, True, True)


def test_store(spark):
    a, b = Store(spark, work_path(spark)), Store(spark, work_path(spark))
    for s in (a, b):
        s.commit({"t": spark.range(3)}, {"n": 3})
    a.commit({"t": spark.range(4)})
    b.commit({"t": spark.range(5)})
    assert a.versions() == [1, 2] and a.read("t").count() == 4 and a.read("t", 1).count() == 3 and a.user() == {"n": 3} and a.tables() == ["t"]
    assert a.first_difference(b, "t") == 2 and a.first_difference(a, "t") is None
    a.prune(2)
    assert a.versions() == [2] and a.read("t").count() == 4


def test_pairs(spark):
    p = spark.createDataFrame([(bytearray(k), bytearray(b"v")) for k in (b"a\x01", b"a\xff", b"b")], "key binary, value binary")
    key = lambda df: bytes(df.first().key) if df.first() else None
    assert key(pairs.first(p)) == b"a\x01" and key(pairs.last(p, b"a")) == b"a\xff" and key(pairs.after(p, b"a\x01")) == b"a\xff" and key(pairs.before(p, b"a")) is None
    assert [pairs.find(p, k).first().how for k in (b"b", b"ab", b"a")] == ["exact", "previous", "next"]
    assert [pairs.update_suffix(p, k, n)[1] for k, n in ((b"b", b"bb"), (b"b", b"b"), (b"z", b"zz"), (b"a", b"aa"))] == ["Updated", "NothingToDo", "NotFound", "NotUniquePrefix"]
    assert content(pairs.count(p, b"a")) == [(2,)] and content(pairs.index_of(p, b"b")) == [(2,)] and pairs.put(p, p.limit(1)).count() == 3


def test_log(spark):
    rows = [(0, 0, "m", "user", '{"id":1,"a":"x"}'), (0, 1, "m", "other", "{}"), (1, 0, None, "user", '{"id":2}')]
    df = spark.createDataFrame(rows, log.SCHEMA)
    assert log.observe(df, F.col("metadata") == "m", ["user"]).count() == 1 and log.observe(df, stop_after=0).count() == 2
    assert log.observe(df, F.col("n_events") == 1).count() == 1
    got = log.decode(df.where("type = 'user'"), "id long, b string", {"b": "d"})
    assert content(got.select("id", "b")) == [(1, "d"), (2, "d")]
    known, waiting = log.with_type(spark.createDataFrame([(1, 1), (2, 9)], "e int, type_id int"), spark.createDataFrame([(1, "T")], "type_id int, name string"))
    assert known.count() == 1 and waiting.count() == 1


def test_single_keys_of_a_dictionary(spark):
    d = OrderedDictionary(spark.createDataFrame([(1, "a"), (2, "b")], "key long, value string"))
    assert sorted(map(tuple, d.add(3, "c").set(1, "z").df.collect())) == [(1, "z"), (2, "b"), (3, "c")]
    with pytest.raises(KeyError):
        d.add(1, "x")
    left, found = d.remove(2)
    assert [tuple(r) for r in left.df.collect()] == [(1, "a")] and found.first()[0] and not d.remove(9)[1].first()[0]
    assert d.clear().df.isEmpty()
    s = OrderedDictionary(spark.createDataFrame([(1,)], "key long"), value=None)
    assert sorted(r.key for r in s.add(2).df.collect()) == [1, 2]


def test_two_writers_do_not_touch_each_other(spark, tmp_path):
    a, b = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")
    first = a.commit({"t": spark.range(3)})
    b.versions = lambda: []  # as seen before the other had published
    with pytest.raises(RuntimeError):
        b.commit({"t": spark.range(50)})
    assert a.read("t").count() == 3 and a.read("t", first).count() == 3
    with pytest.raises(KeyError):
        a.read("t", 0)


def test_objects(spark):
    o = Objects(spark.createDataFrame([(1, "a", "x"), (4, "b", "yy")], "oid long, type string, content string"))
    new = spark.createDataFrame([(None, "a", "q"), (None, "a", "p"), (4, "b", "z")], "oid long, type string, content string")
    assert sorted(map(tuple, o.store(new).df.collect())) == [(1, "a", "x"), (4, "b", "z"), (5, "a", "p"), (6, "a", "q")]
    left, n = o.delete(4)
    assert n.first()[0] == 1 and [r.oid for r in left.df.collect()] == [1]
    assert o.singleton("b").first().content == "yy" and o.singleton("c").isEmpty() and [r.oid for r in o.enumerate("a").collect()] == [1]


def test_rows_are_created_once(spark):
    old = spark.createDataFrame([(1, "old")], "k long, made string")
    new = spark.createDataFrame([(1, "again"), (2, None)], old.schema)
    d = RelationDef(["k"])
    hook = {"made": F.lit("now")}
    assert sorted(map(tuple, mutate.upsert(old, new, d, on_create=hook)[0].collect())) == [(1, "again"), (2, "now")]
    assert sorted(map(tuple, mutate.insert(old, new, d, on_create=hook)[0].collect())) == [(1, "old"), (2, "now")]
