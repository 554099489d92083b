"""Registered queries of the relational operators, each over whole tables, with the SQL that gives the same rows.

Where an operator orders rows, the place is a column (rn). Pages are ranked after they are cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspark.functions import casts, nested
from relspark.operators import collections as coll
from relspark.operators import constraint as c
from relspark.operators import mutate, stats
from relspark.operators.objects import Objects
from relspark.operators.orderer import ascending, by_locale, descending
from relspark.operators.relation import Range, Relation, RelationDef
from relspark.plans.query import Field, Query
from relspark.plans.upgrade import Version, read_versions
from relspark.sources import pairs
from relspark.sources.store import Store, export_pairs, import_pairs
from relspark.sources.work import ranked, work_path
from relspark.streaming import events as log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


ORDERS = RelationDef(["o_orderkey"], secondary={"Customer": ["o_custkey", "o_orderdate"], "Status": ["o_orderstatus", "o_orderdate"], "Priority": ["o_orderpriority"], "Date": ["o_orderdate"]})
EVENTS = RelationDef(["event_type", "user_id", "event_id"], secondary={"Time": ["ts"], "User": ["user_id", "ts"]})
CUSTOMER = RelationDef(["c_custkey"], secondary={"Segment": ["c_mktsegment", "c_name"], "Nation": ["c_nationkey"], "Note": ["c_note"], "Ref": ["c_ref"]})
PART = RelationDef(["p_partkey"], secondary={"Brand": ["p_brand", "p_type"], "Name": ["p_name"], "Words": ["p_words"], "Size": ["p_size"]}, computed={"p_words": lambda: F.split("p_name", " ")})
TURNS = RelationDef(["conv_id", "turn"])
DOCUMENTS = RelationDef(["doc_id"], secondary={"Source": ["lang", "source"]})
NOTE = "case when c_custkey % 3 = 0 then null else c_mktsegment end"
REF = "case when c_custkey % 4 = 0 then null else c_nationkey end"


def orders(spark, d):
    return Relation(table(spark, d, "orders"), ORDERS)


def events(spark, d):
    return Relation(table(spark, d, "events"), EVENTS)


def customer(spark, d):
    return Relation(table(spark, d, "customer").withColumns({"c_note": F.expr(NOTE), "c_ref": F.expr(REF)}), CUSTOMER)


def part(spark, d):
    return Relation(table(spark, d, "part"), PART)


def turns(spark, d):
    return Relation(table(spark, d, "conversations"), TURNS)


def numbered(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """A page of at most limit rows with their place."""
    return df.limit(limit).withColumn("rn", F.row_number().over(Window.orderBy(*order)).cast("long"))


# lookups


@query("select o_orderkey, o_custkey, row_number() over (order by o_orderkey) as rn from orders")
def scan_ranked(spark, d):
    return orders(spark, d).scan_ranked().select("o_orderkey", "o_custkey", "rn")


@query("select event_type, user_id, event_id, row_number() over (order by event_type, user_id, event_id) as rn from events")
def scan_three_keys_ranked(spark, d):
    return events(spark, d).scan_ranked().select("event_type", "user_id", "event_id", "rn")


@query("select count(*) as n from orders")
def count_all(spark, d):
    return orders(spark, d).count()


@query("select * from orders where o_orderkey = 7")
def find_by_id(spark, d):
    return orders(spark, d).find(7)


@query("select * from orders where o_orderkey = -1")
def find_by_id_absent(spark, d):
    return orders(spark, d).find(-1)


@query("select conv_id, turn, role, row_number() over (order by turn) as rn from conversations where conv_id = 3")
def find_by_prefix(spark, d):
    return ranked(turns(spark, d).find(3, columns=["conv_id", "turn", "role"]), [F.col("turn")])


@query("select o_custkey, o_orderdate, o_orderkey from orders where o_custkey = 10")
def find_by_secondary(spark, d):
    return orders(spark, d).find(10, index="Customer").select("o_custkey", "o_orderdate", "o_orderkey")


@query("select count(*) > 0 as found from orders where o_custkey = 10")
def contains_key(spark, d):
    return orders(spark, d).any(10, index="Customer")


@query("select o_orderkey, o_orderstatus from orders")
def project_subset(spark, d):
    return orders(spark, d).project({"o_orderkey": "bigint", "o_orderstatus": "string"})


@query("select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as integer) as o_custkey from orders")
def project_converted(spark, d):
    return orders(spark, d).project({"o_orderkey": "string", "o_custkey": "int"})


@query("select c_custkey, c_mktsegment from customer where (c_mktsegment = 'BUILDING' or c_nationkey = 3) and c_nationkey = 3")
def where_and_or(spark, d):
    q = Query(customer(spark, d).df, ["c_custkey", "c_mktsegment"])
    return q.where((Field("c_mktsegment") == "BUILDING") | (Field("c_nationkey") == 3)).where(Field("c_nationkey") == 3).df()


@query(f"select c_custkey from (select *, {NOTE} as c_note from customer) where c_note is null or c_note = 'MACHINERY'")
def where_null_equals_null(spark, d):
    return Query(customer(spark, d).df, ["c_custkey"]).where((Field("c_note") == None) | (Field("c_note") == "MACHINERY")).df()  # noqa: E711


@query("select event_id from events where value = (select value from events where event_id = 0) or ts = (select ts from events where event_id = 1)")
def where_float_and_time(spark, d):
    rel = events(spark, d)
    value, ts = (rel.df.where(F.col("event_id") == k).first()[name] for k, name in ((0, "value"), (1, "ts")))
    return Query(rel.df, ["event_id"]).where((Field("value") == value) | (Field("ts") == at(str(ts)))).df()


OBJECTS = "(select doc_id as oid, 'document' as type, lang as name from documents union all select 1000000000 + c_custkey, 'customer', c_name from customer)"


def objects(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("oid"), F.lit("document").alias("type"), F.col("lang").alias("name"))
    return Objects(docs.union(table(spark, d, "customer").select(F.col("c_custkey") + 1_000_000_000, F.lit("customer"), "c_name")))


@query(f"select * from {OBJECTS}")
def object_enumerate(spark, d):
    return objects(spark, d).enumerate()


@query(f"""with n as (select row_number() over (order by s_name) as rn, 'supplier' as type, s_name as name from supplier)
    select oid, type, case when oid = 5 then 'new' else name end as name from {OBJECTS} union all select (select max(oid) from {OBJECTS}) + rn, type, name from n""")
def object_store(spark, d):
    """One object replaced by its oid, and one added for each supplier."""
    new = table(spark, d, "supplier").select(F.lit(None).cast("long").alias("oid"), F.lit("supplier").alias("type"), F.col("s_name").alias("name"))
    return objects(spark, d).store(new.union(spark.range(1).select(F.lit(5).cast("long"), F.lit("document"), F.lit("new")))).df


@query(f"select * from {OBJECTS} where oid <> 7")
def object_delete(spark, d):
    return objects(spark, d).delete(7)[0].df


@query(f"select * from {OBJECTS} where type = 'customer' order by oid limit 1")
def object_singleton(spark, d):
    return objects(spark, d).singleton("customer")


@query(f"select oid, type, strlen(name) as size from {OBJECTS}")
def object_sizes(spark, d):
    return objects(spark, d).sized()


@query("select doc_id, length(text) as size from documents where doc_id = 5")
def object_get_with_size(spark, d):
    return Relation(table(spark, d, "documents"), DOCUMENTS).find(5).select("doc_id", F.length("text").cast("long").alias("size"))


# ranges

RANGED = "o_orderkey between 100 and 160"


@query(f"select o_orderkey, row_number() over (order by o_orderkey) as rn from orders where {RANGED}")
def list_by_id_range(spark, d):
    return ranked(orders(spark, d).list(bounds=Range(100, 160)).select("o_orderkey"), [F.col("o_orderkey")])


@query("select o_custkey, o_orderdate, o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey desc) as rn from orders where o_custkey = 10 and o_orderdate >= timestamp '1995-06-01' and o_orderdate < timestamp '2000-06-01'")
def list_by_secondary_descending(spark, d):
    bounds = Range(at("1995-06-01"), at("2000-06-01"), end_included=False, descending=True)
    rows = orders(spark, d).list(10, bounds=bounds, index="Customer").select("o_custkey", "o_orderdate", "o_orderkey")
    return ranked(rows, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])


@query("select c_custkey, c_nationkey from customer where c_nationkey > 3 and c_nationkey <= 5")
def list_start_excluded(spark, d):
    return customer(spark, d).list(bounds=Range(3, 5, start_included=False), index="Nation").select("c_custkey", "c_nationkey")


@query("select o_orderkey, rn - 20 as rn from (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as rn from orders) where rn between 21 and 35")
def list_page_at_position(spark, d):
    return numbered(orders(spark, d).page(index="Date", position=20, count=15).select("o_orderkey", "o_orderdate"), 15, F.col("o_orderdate"), F.col("o_orderkey")).drop("o_orderdate")


@query("select count(*) as n from orders where o_orderstatus = 'F' and o_orderdate >= timestamp '1997-01-01'")
def count_by_range(spark, d):
    return orders(spark, d).count("F", bounds=Range(at("1997-01-01")), index="Status")


@query("select count(*) > 0 as found from orders where o_orderstatus = 'F' and o_orderdate > timestamp '2030-01-01'")
def any_by_range(spark, d):
    return orders(spark, d).any("F", bounds=Range(at("2030-01-01"), start_included=False), index="Status")


# constraint scans


@query("select event_type, user_id, event_id, row_number() over (order by event_type, user_id, event_id) as rn from events where event_type like 'c%' and user_id <= 20")
def scan_by_id(spark, d):
    rows = events(spark, d).scan_by(c.starts_with("c"), c.up_to(20)).select("event_type", "user_id", "event_id")
    return ranked(rows, [F.col("event_type"), F.col("user_id"), F.col("event_id")])


@query("select o_custkey, o_orderdate, o_orderkey from orders where o_custkey = 10 and o_orderdate <= timestamp '1998-01-01'")
def scan_by_secondary(spark, d):
    return orders(spark, d).scan_by(c.exact(10), c.up_to(at("1998-01-01")), index="Customer").select("o_custkey", "o_orderdate", "o_orderkey")


@query("select event_id, rn - 5 as rn from (select event_id, row_number() over (order by event_type, user_id, event_id) as rn from events where user_id > 30) where rn between 6 and 15")
def gather_page(spark, d):
    rows = events(spark, d).gather(5, 10, c.anything(), c.predicate(lambda x: x > 30))
    return numbered(rows, 10, F.col("event_type"), F.col("user_id"), F.col("event_id")).select("event_id", "rn")


@query("select event_id, rn from (select event_id, row_number() over (order by event_type, user_id, event_id) as rn from events) where rn <= 3")
def gather_negative_skip(spark, d):
    return numbered(events(spark, d).gather(-2, 5), 5, F.col("event_type"), F.col("user_id"), F.col("event_id")).select("event_id", "rn")


@query("select count(*) as total from events where user_id > 30")
def gather_total(spark, d):
    return events(spark, d).gather_total(c.anything(), c.predicate(lambda x: x > 30))


@query("select o_orderkey, rn from (select o_orderkey, row_number() over (order by o_orderdate desc, o_orderstatus, o_orderkey) as rn from orders where o_orderstatus <> 'P') where rn <= 12")
def gather_by_secondary_ordered(spark, d):
    rows = orders(spark, d).gather(0, 12, c.predicate(lambda x: x != "P"), index="Status", orderers=[descending("o_orderdate")])
    return numbered(rows, 12, F.col("o_orderdate").desc(), F.col("o_orderstatus"), F.col("o_orderkey")).select("o_orderkey", "rn")


@query(f"select c_custkey, rn from (select c_custkey, row_number() over (order by c_note desc nulls first, c_custkey) as rn from (select *, {NOTE} as c_note from customer)) where rn <= 700")
def gather_ordered_nulls(spark, d):
    rows = customer(spark, d).gather(0, 700, index="Note", orderers=[ascending("c_note").backwards()])
    return numbered(rows, 700, F.col("c_note").desc_nulls_first(), F.col("c_custkey")).select("c_custkey", "rn")


@query()
def gather_by_locale(spark, d):
    rows = customer(spark, d).gather(0, 10, index="Segment", orderers=[by_locale("c_mktsegment", "en")])
    return rows.select("c_custkey", "c_mktsegment")


@query("select * from (select event_id, user_id from events where event_type = 'view' and user_id >= 40 order by event_type, user_id, event_id limit 1)")
def first_by_id(spark, d):
    return events(spark, d).first(c.exact("view"), c.predicate(lambda x: x >= 40)).select("event_id", "user_id")


@query("select * from (select event_id, user_id from events where user_id <= 40 order by event_type desc, user_id desc, event_id desc limit 1)")
def last_by_id(spark, d):
    return events(spark, d).last(c.anything(), c.up_to(40)).select("event_id", "user_id")


@query("select * from (select event_id, user_id from events order by user_id desc, event_type, event_id limit 1)")
def first_ordered(spark, d):
    return events(spark, d).first(orderers=[descending("user_id")]).select("event_id", "user_id")


@query("select * from (select event_id, user_id from events order by user_id desc, event_type, event_id limit 1)")
def last_ordered_takes_least_of_ties(spark, d):
    return events(spark, d).last(orderers=[ascending("user_id")]).select("event_id", "user_id")


# constraints


def _customers(rel: Relation, *cs, index: str) -> DataFrame:
    return rel.scan_by(*cs, index=index).select("c_custkey")


@query("select c_custkey from customer")
def constraint_any(spark, d):
    return _customers(customer(spark, d), c.anything(), index="Segment")


@query("select c_custkey from customer where c_mktsegment = 'BUILDING'")
def constraint_string_exact(spark, d):
    return _customers(customer(spark, d), c.exact("BUILDING"), index="Segment")


@query(f"select c_custkey from customer where ({NOTE}) is null")
def constraint_exact_null(spark, d):
    return _customers(customer(spark, d), c.exact(None), index="Note")


@query("select doc_id from labels where toxic = 1")
def constraint_bool_exact(spark, d):
    labels = table(spark, d, "labels").withColumn("is_toxic", casts.to_boolean(F.col("toxic")))
    return Relation(labels, RelationDef(["is_toxic", "doc_id"])).scan_by(c.exact(True)).select("doc_id")


@query("select o_orderkey from orders where o_orderkey < 500")
def constraint_number_up_to(spark, d):
    return orders(spark, d).scan_by(c.up_to(500, including=False)).select("o_orderkey")


@query("select o_orderkey from orders where o_orderkey % 7 = 3")
def constraint_number_predicate(spark, d):
    return orders(spark, d).scan_by(c.predicate(lambda x: x % 7 == 3)).select("o_orderkey")


@query("select o_orderkey from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01'")
def constraint_time_range(spark, d):
    return orders(spark, d).scan_by(c.between(at("1996-01-01"), at("1997-01-01"), including=False), index="Date").select("o_orderkey")


@query("select event_id from events where ts = (select ts from events where event_id = 1)")
def constraint_time_exact(spark, d):
    rel = events(spark, d)
    ts = rel.df.where("event_id = 1").first()["ts"]
    return rel.scan_by(c.exact(at(str(ts))), index="Time").select("event_id")


@query(f"select c_custkey from customer where ({REF}) <= 5")
def constraint_nullable_up_to(spark, d):
    return _customers(customer(spark, d), c.up_to(5), index="Ref")


@query(f"select c_custkey from customer where ({REF}) is null or ({REF}) > 20")
def constraint_nullable_predicate(spark, d):
    return _customers(customer(spark, d), c.predicate(lambda x: x.isNull() | (x > 20)), index="Ref")


@query(f"select c_custkey from customer where ({NOTE}) like 'M%'")
def constraint_starts_with(spark, d):
    return _customers(customer(spark, d), c.starts_with("M"), index="Note")


@query("select c_custkey from customer")
def constraint_starts_with_empty(spark, d):
    return _customers(customer(spark, d), c.starts_with(""), index="Note")


@query(f"select c_custkey from customer where coalesce({NOTE}, '') like '%ING'")
def constraint_ends_with(spark, d):
    return _customers(customer(spark, d), c.ends_with("ING"), index="Note")


@query(f"select c_custkey from customer where contains(coalesce({NOTE}, ''), 'OUSE')")
def constraint_contains(spark, d):
    return _customers(customer(spark, d), c.contains("OUSE"), index="Note")


@query(f"select c_custkey from customer where contains(upper(coalesce({NOTE}, '')), 'HOLD')")
def constraint_contains_ignoring_case(spark, d):
    return _customers(customer(spark, d), c.contains_ignoring_case("hold"), index="Note")


@query(f"select c_custkey from customer where upper(coalesce({NOTE}, '')) = 'BUILDING'")
def constraint_exact_ignoring_case(spark, d):
    return _customers(customer(spark, d), c.exact_ignoring_case("building"), index="Note")


@query(f"select c_custkey from customer where coalesce({NOTE}, '') = ''")
def constraint_exact_ignoring_case_empty(spark, d):
    return _customers(customer(spark, d), c.exact_ignoring_case(""), index="Note")


@query(f"select c_custkey from customer where ({NOTE}) <= 'FURNITURE'")
def constraint_string_up_to(spark, d):
    return _customers(customer(spark, d), c.up_to("FURNITURE"), index="Note")


@query(f"select c_custkey from customer where length(coalesce({NOTE}, '')) <> 8")
def constraint_string_predicate(spark, d):
    return _customers(customer(spark, d), c.text_predicate(lambda x: F.length(x) != 8), index="Note")


@query("select p_partkey from part where list_contains(string_split(p_name, ' '), (select min(string_split(p_name, ' ')[1]) from part))")
def constraint_list_contains(spark, d):
    rel = part(spark, d)
    word = rel.df.agg(F.min(F.get("p_words", F.lit(0)))).first()[0]
    return rel.scan_by(c.list_contains(word), index="Words").select("p_partkey")


@query("select p_partkey from part where string_split(p_name, ' ')[1] = (select max(string_split(p_name, ' ')[1]) from part)")
def constraint_list_starts_with(spark, d):
    rel = part(spark, d)
    word = rel.df.agg(F.max(F.get("p_words", F.lit(0)))).first()[0]
    return rel.scan_by(c.list_starts_with(word), index="Words").select("p_partkey")


@query("select o_orderkey from orders where md5(cast(o_custkey as varchar)) = md5('10')")
def constraint_guid_exact(spark, d):
    rel = Relation(table(spark, d, "orders").withColumn("guid", F.md5(F.col("o_custkey").cast("string"))), RelationDef(["o_orderkey"], secondary={"Guid": ["guid"]}))
    return rel.scan_by(c.exact(rel.df.select(F.md5(F.lit("10"))).first()[0]), index="Guid").select("o_orderkey")


@query("select distinct on (event_type) event_type, user_id, event_id from events where user_id > 5 order by event_type, user_id, event_id")
def constraint_first(spark, d):
    return events(spark, d).scan_by(c.anything(), c.first(c.predicate(lambda x: x > 5))).select("event_type", "user_id", "event_id")


@query("""with a as (select *, min(user_id) over (partition by event_type) as least from events)
select event_type, user_id, min(event_id) as event_id from a where user_id = least and event_id % 2 = 1 group by event_type, user_id""")
def constraint_first_then_other(spark, d):
    return events(spark, d).scan_by(c.anything(), c.first(c.anything()), c.predicate(lambda x: x % 2 == 1)).select("event_type", "user_id", "event_id")


@query("select event_type, user_id, min(event_id) as event_id from events where event_type = 'click' group by event_type, user_id")
def constraint_first_last_column(spark, d):
    return events(spark, d).scan_by(c.exact("click"), c.anything(), c.first(c.anything())).select("event_type", "user_id", "event_id")


# joins and aggregates


@query("select o_orderkey, c_name from orders left join customer on o_custkey = c_custkey")
def dereference(spark, d):
    return orders(spark, d).dereference("o_custkey", customer(spark, d)).select("o_orderkey", "c_name")


@query("""select a.conv_id, a.turn, b.role as before from conversations a left join conversations b on a.conv_id = b.conv_id and a.turn - 1 = b.turn""")
def dereference_composite(spark, d):
    """Each turn with the one before it, by both columns of the key."""
    rel = turns(spark, d)
    rel.df = rel.df.withColumn("earlier", F.col("turn") - 1)
    return rel.dereference(["conv_id", "earlier"], turns(spark, d), "b_").select("conv_id", "turn", F.col("b_role").alias("before"))


@query("select n_name, c_custkey from nation join customer on n_nationkey = c_nationkey")
def owned_content(spark, d):
    nation = Relation(table(spark, d, "nation"), RelationDef(["n_nationkey"]))
    return nation.owned(table(spark, d, "customer"), "n_nationkey", "c_nationkey").select("n_name", "c_custkey")


@query("select event_type, count(*) as n from events group by event_type")
def group_count(spark, d):
    return stats.group_count(table(spark, d, "events"), "event_type")


@query("select distinct event_type from events")
def distinct_leading_keys(spark, d):
    return table(spark, d, "events").select("event_type").distinct()


@query("select min(o_orderdate) as least, max(o_orderdate) as most from orders")
def key_bounds(spark, d):
    return stats.key_bounds(table(spark, d, "orders"), "o_orderdate")


@query("""select kind, size, count(*) as n from (select 'key' as kind, strlen(cast(conv_id as varchar)) + strlen(cast(turn as varchar)) as size from conversations
union all select 'value', strlen(role) + strlen(text) from conversations) group by kind, size""")
def size_histograms(spark, d):
    return stats.size_histograms(table(spark, d, "conversations"), ["conv_id", "turn"])


@query("select case when o_orderkey % 3 = 0 then 1 else 2 end as version, count(*) as n from orders group by 1")
def version_histogram(spark, d):
    return stats.version_histogram(table(spark, d, "orders").withColumn("v", F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(2)), "v")


@query("select source, count(*) as n, sum(strlen(text)) as bytes from documents group by source")
def type_report(spark, d):
    return stats.type_report(table(spark, d, "documents").select("source", "text"), "source")


@query("select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 40)")
def unreachable_keys(spark, d):
    return stats.unreachable(table(spark, d, "part").select("p_partkey"), "p_partkey", table(spark, d, "lineitem").where("l_quantity > 40"), "l_partkey")


@query("select * from (select 'customer' as name, count(*) as n from customer union all select 'events', count(*) from events union all select 'orders', count(*) from orders)")
def catalogue(spark, d):
    return stats.catalogue({t: table(spark, d, t) for t in ("customer", "events", "orders")})


# sets and bitmaps


def _users(spark, d, kind: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("event_type") == kind).select("user_id")


def _bitmap(spark, d, kind: str) -> coll.Bitmap:
    return coll.Bitmap.of(_users(spark, d, kind), "user_id")


@query("select user_id from events where event_type = 'click' union select user_id from events where event_type = 'error'")
def set_union(spark, d):
    return coll.union_with(_users(spark, d, "click"), _users(spark, d, "error"))


@query("select user_id from events where event_type = 'click' and user_id % 5 > 0 except select user_id from events where event_type = 'error' and event_id % 2 = 0")
def set_except(spark, d):
    ev = table(spark, d, "events")
    return coll.except_with(ev.where("event_type = 'click' and user_id % 5 > 0").select("user_id"), ev.where("event_type = 'error' and event_id % 2 = 0").select("user_id"))


@query("select user_id as value from events where event_type = 'click' union select user_id from events where event_type = 'view'")
def bitmap_or(spark, d):
    return _bitmap(spark, d, "click").either(_bitmap(spark, d, "view")).df


@query("select user_id as value from events where event_type = 'click' intersect select user_id from events where event_type = 'view'")
def bitmap_and(spark, d):
    return _bitmap(spark, d, "click").both(_bitmap(spark, d, "view")).df


@query("select range as value from range(0, 5001) where range not in (select user_id from events where event_type = 'click')")
def bitmap_not(spark, d):
    return _bitmap(spark, d, "click").negate(5000).df


@query("select user_id as value from events where event_type = 'click' except select user_id from events where event_type = 'view' and event_id % 3 = 0")
def bitmap_and_not(spark, d):
    other = coll.Bitmap.of(table(spark, d, "events").where("event_type = 'view' and event_id % 3 = 0"), "user_id")
    return _bitmap(spark, d, "click").both(other.negate(5000)).df


@query("select distinct user_id as value from events where event_type = 'click' and user_id <= 50")
def bitmap_build_bounded(spark, d):
    return _bitmap(spark, d, "click").build(50)


@query("select distinct user_id as value from events where event_type = 'click' and user_id <= 50")
def bitmap_built(spark, d):
    return _bitmap(spark, d, "click").built(50).df


@query("select count(distinct user_id) as n from events where event_type = 'click'")
def bitmap_count(spark, d):
    return _bitmap(spark, d, "click").count()


@query("select distinct x as value from (select user_id as x from events where event_type = 'click' and user_id <> 7 union all select 123456)")
def bitmap_set_and_clear(spark, d):
    return _bitmap(spark, d, "click").clear(7).set(123_456).df


@query("select count(*) > 0 as found from events where event_type = 'click' and user_id = 7")
def bitmap_get(spark, d):
    return _bitmap(spark, d, "click").get(7)


@query("select floor(x / 65536) as page, count(*) as n from (select distinct o_orderkey * 977 as x from orders) group by 1")
def bitmap_pages(spark, d):
    return coll.Bitmap.of(table(spark, d, "orders").select((F.col("o_orderkey") * 977).alias("x")), "x").pages()


# casts, upgrades, nested values


@query("""select p_partkey, cast(((p_partkey * 7919) % 256 + 256) % 256 - case when ((p_partkey * 7919) % 256 + 256) % 256 >= 128 then 256 else 0 end as integer) as wrapped,
cast(trunc(-p_retailprice) as bigint) as truncated, cast(p_size as double) as exact, [p_brand] as brands from part""")
def casts_of_numbers(spark, d):
    f = table(spark, d, "part")
    return f.select("p_partkey", casts.wrap(F.col("p_partkey") * 7919, "tinyint").cast("int").alias("wrapped"), casts.truncated(-F.col("p_retailprice")).alias("truncated"), casts.to_decimal(F.col("p_size")).cast("double").alias("exact"), casts.to_list(F.col("p_brand")).alias("brands"))


@query("select doc_id, case when quality <> 0 then '1' else '0' end as text, toxic <> 0 as flag, coalesce(case when toxic = 1 then quality end, -1) as filled from labels")
def casts_of_flags(spark, d):
    f = table(spark, d, "labels")
    return f.select("doc_id", casts.to_text(casts.to_boolean(F.col("quality")), "boolean").alias("text"), casts.to_boolean(F.col("toxic")).alias("flag"), casts.not_null(F.when(F.col("toxic") == 1, F.col("quality")), -1).alias("filled"))


STATUSES = {0: "F", 1: "O", 2: "P"}


@query("select o_orderkey, case o_orderstatus when 'F' then 0 when 'O' then 1 when 'P' then 2 end as code, o_orderstatus as name from orders")
def casts_of_enums(spark, d):
    f = table(spark, d, "orders").withColumn("code", casts.enum_value(F.col("o_orderstatus"), STATUSES))
    return f.select("o_orderkey", "code", casts.enum_name(F.col("code"), STATUSES).alias("name"))


@query("select p_partkey, cast(p_size as varchar) || '.' || cast(p_partkey as varchar) as version, p_size as major, -1 as build from part")
def casts_of_versions(spark, d):
    f = table(spark, d, "part").withColumn("v", casts.version_parts(F.concat_ws(".", F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))))
    return f.select("p_partkey", casts.version_text(F.col("v")).alias("version"), F.col("v.major").alias("major"), F.col("v.build").alias("build"))


@query("select s_suppkey, s_name as name from supplier")
def casts_of_encrypted(spark, d):
    key = "0123456789abcdef"
    return table(spark, d, "supplier").select("s_suppkey", casts.decrypted(casts.encrypted(F.col("s_name"), key), key).alias("name"))


@query("""select s_suppkey as id, s_name as name, cast(s_nationkey as bigint) as score, 'new' as added from supplier where s_suppkey % 2 = 0
union all select s_suppkey, s_name, cast(-s_suppkey as bigint), 'kept' from supplier where s_suppkey % 2 = 1""")
def schema_upgrade(spark, d):
    f = table(spark, d, "supplier")
    old = f.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("score"), F.lit(1).alias("ignored"))
    new = f.where("s_suppkey % 2 = 1").select(F.col("s_suppkey").alias("id"), (-F.col("s_suppkey")).alias("score"), F.lit("kept").alias("added"), F.col("s_name").alias("name"))
    to = Version(T._parse_datatype_string("id bigint, score bigint, added string, name string"), {"added": "new"})
    return read_versions([old, new], to)


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k, cast(null as varchar) as missing from events")
def nested_drill_down(spark, d):
    f = table(spark, d, "events").withColumn("v", nested.parse(F.col("props")))
    return f.select("event_id", nested.at(F.col("v"), "$.k", "bigint").alias("k"), nested.at(F.col("v"), "$.a.b[1]", "string").alias("missing"))


@query("select event_id, false as is_null, true as is_undefined, cast(json_extract(props, '$.k') as double) as as_double, cast(null as boolean) as as_bool from events")
def nested_typed_reads(spark, d):
    v = F.col("v")
    f = table(spark, d, "events").withColumn("v", nested.parse(F.col("props")))
    return f.select("event_id", nested.is_null(v, "$.k").alias("is_null"), nested.is_undefined(v, "$.none").alias("is_undefined"), nested.at(v, "$.k", "double").alias("as_double"), nested.at(v, "$.k.x", "boolean").alias("as_bool"))


@query("""select event_id, '{"id":' || event_id || ',"kind":"' || event_type || '"}' as json from events""")
def nested_build_to_json(spark, d):
    return table(spark, d, "events").select("event_id", nested.to_json(nested.build(id=F.col("event_id"), kind=F.col("event_type"))).alias("json"))


# ordered dictionaries


def _dict(spark, d) -> coll.OrderedDictionary:
    return coll.OrderedDictionary(table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value")))


@query("select s_suppkey as key, s_name as value, row_number() over (order by s_suppkey desc) as rn from supplier")
def dict_reverse(spark, d):
    return ranked(_dict(spark, d).reverse(), [F.col("key").desc()])


@query("select s_suppkey as key, s_name as value from supplier where s_suppkey >= 40")
def dict_increasing(spark, d):
    return _dict(spark, d).increasing(40)


@query("select s_suppkey as key, s_name as value from supplier where s_suppkey <= 40")
def dict_decreasing(spark, d):
    return _dict(spark, d).decreasing(40)


@query("select s_suppkey as key, s_name as value from supplier where s_suppkey > 10 and s_suppkey <= 20")
def dict_advanced(spark, d):
    return _dict(spark, d).advanced(Range(10, 20, start_included=False, descending=True))


@query("select s_suppkey as key, s_name as value from supplier where not (s_suppkey between 5 and 50)")
def dict_remove_range(spark, d):
    return _dict(spark, d).remove_range(Range(5, 50))[0].df


@query("select 0 as removed")
def dict_remove_inverted_range(spark, d):
    return _dict(spark, d).remove_range(Range(50, 5))[1]


@query("select s_suppkey as key, case when s_suppkey % 2 = 0 then 'x' else s_name end as value from supplier union all select 1000000 + s_suppkey, 'x' from supplier where s_suppkey % 2 = 0")
def dict_upsert(spark, d):
    even = table(spark, d, "supplier").where("s_suppkey % 2 = 0")
    new = even.select(F.col("s_suppkey").alias("key"), F.lit("x").alias("value")).union(even.select(F.col("s_suppkey") + 1_000_000, F.lit("x")))
    return _dict(spark, d).upsert(new).df


@query("select s_suppkey as key, case when s_suppkey = 7 then 'seven' else s_name end as value from supplier union all select -1, 'less' union all select -2, 'new'")
def dict_set_and_add(spark, d):
    return _dict(spark, d).set(7, "seven").set(-1, "less").add(-2, "new").df


@query("select s_suppkey as key, s_name as value from supplier where s_suppkey <> 7")
def dict_remove(spark, d):
    return _dict(spark, d).remove(7)[0].df


@query("select count(*) as n from supplier where false")
def dict_clear(spark, d):
    return _dict(spark, d).clear().count()


@query("select s_suppkey as key, strlen(cast(s_suppkey as varchar)) as key_size, strlen(s_name) as value_size from supplier")
def dict_sizes(spark, d):
    return _dict(spark, d).sizes()


@query("select count(*) > 0 as found from supplier where s_suppkey = 3")
def dict_contains(spark, d):
    return _dict(spark, d).contains(3)


# mutations


def _halves(spark, d) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return o.where("o_orderkey % 3 > 0"), o.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("N"))


@query("""select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey % 3 > 0
union all select o_orderkey, o_custkey, 'N' from orders where o_orderkey % 2 = 0 and o_orderkey % 3 = 0""")
def insert(spark, d):
    return mutate.insert(*_halves(spark, d), ORDERS)[0]


@query("select count(*) filter (o_orderkey % 3 = 0) as inserted, count(*) filter (o_orderkey % 3 > 0) as rejected from orders where o_orderkey % 2 = 0")
def insert_counts(spark, d):
    return mutate.insert(*_halves(spark, d), ORDERS)[1]


@query("""select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey % 3 > 0 and o_orderkey % 2 = 1
union all select o_orderkey, o_custkey, 'N' from orders where o_orderkey % 2 = 0""")
def upsert(spark, d):
    return mutate.upsert(*_halves(spark, d), ORDERS)[0]


@query("select count(distinct o_custkey) filter (o_custkey % 2 = 1) as inserted, count(*) - count(distinct o_custkey) filter (o_custkey % 2 = 1) as updated from orders")
def upsert_range_counts(spark, d):
    old = table(spark, d, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("k"), F.lit(0).cast("long").alias("v")).distinct()
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderkey").alias("seq"))
    return mutate.upsert(old, new, RelationDef(["k"]), "seq")[1]


@query("select o_custkey as k, max(o_orderkey) as v from orders group by o_custkey")
def upsert_range_last_wins(spark, d):
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderkey").alias("seq"))
    return mutate.upsert(new.select("k", F.lit(0).cast("long").alias("v")).limit(0), new, RelationDef(["k"]), "seq")[0]


@query("select o_orderkey, case when o_orderkey % 6 in (2, 4) then 'N' else o_orderstatus end as o_orderstatus from orders where o_orderkey % 3 > 0")
def update(spark, d):
    old, new = _halves(spark, d)
    return mutate.update(old, new.where("o_orderkey % 3 > 0"), ORDERS)[0].select("o_orderkey", "o_orderstatus")


@query("select conv_id, turn, case when conv_id = 3 and turn = 1 then 'edited' else text end as text from conversations")
def update_by_id(spark, d):
    return mutate.update_by_id(table(spark, d, "conversations"), {"conv_id": 3, "turn": 1}, {"text": "edited"})[0].select("conv_id", "turn", "text")


@query("select conv_id, turn from conversations where conv_id <> 3")
def remove_by_prefix(spark, d):
    return mutate.remove(table(spark, d, "conversations"), TURNS, 3)[0].select("conv_id", "turn")


@query("select conv_id, turn from conversations where not (conv_id >= 5 and conv_id < 20)")
def remove_by_range(spark, d):
    return mutate.remove(table(spark, d, "conversations"), TURNS, bounds=Range(5, 20, end_included=False))[0].select("conv_id", "turn")


@query("select count(*) as removed from conversations where conv_id = 3 and role <> 'user'")
def remove_with_veto(spark, d):
    return mutate.remove(table(spark, d, "conversations"), TURNS, 3, veto=F.col("role") == "user")[1]


@query("select event_type, user_id, event_id from (select *, row_number() over (order by event_type, user_id, event_id) as rn from events where event_type = 'view') where rn > 25 union all select event_type, user_id, event_id from events where event_type <> 'view'")
def remove_partial(spark, d):
    return mutate.remove_partial(table(spark, d, "events"), EVENTS, 25, "view")[0].select("event_type", "user_id", "event_id")


@query("select count(*) as removed, coalesce(sum(strlen(cast(conv_id as varchar)) + strlen(cast(turn as varchar))), 0) as key_bytes, coalesce(sum(strlen(role) + strlen(text)), 0) as value_bytes from conversations where conv_id = 3")
def remove_with_sizes(spark, d):
    return mutate.remove_with_sizes(table(spark, d, "conversations"), TURNS, 3)[1]


@query("select conv_id, turn from conversations where false")
def remove_all(spark, d):
    return mutate.remove_all(table(spark, d, "conversations")).select("conv_id", "turn")


@query("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey <> 3)")
def cascade_removal(spark, d):
    left = mutate.remove(table(spark, d, "customer").select("c_nationkey", "c_custkey"), RelationDef(["c_nationkey", "c_custkey"]), 3)[0]
    return mutate.cascade(table(spark, d, "orders"), "o_custkey", left, "c_custkey").select("o_orderkey")


@query("select event_id, 999 + row_number() over (order by ts, event_id) as id from events")
def allocate_ids(spark, d):
    return mutate.allocate_ids(table(spark, d, "events").select("event_id", "ts"), [F.col("ts"), F.col("event_id")], 1000, "id").select("event_id", "id")


# pairs, snapshots, logs


def _pairs(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.concat("c_mktsegment", F.lit("/"), "c_name").cast("binary").alias("key"), F.col("c_custkey").cast("string").cast("binary").alias("value"))


SEEK = "BUILDING/Customer#0000005"


@query(f"""with k as (select c_mktsegment || '/' || c_name as key from customer)
select key, how from (select key, case when key = '{SEEK}' then 'exact' when key < '{SEEK}' then 'previous' else 'next' end as how,
row_number() over (order by case when key = '{SEEK}' then 0 when key < '{SEEK}' then 1 else 2 end, case when key <= '{SEEK}' then key end desc, key) as rn from k) where rn = 1""")
def pairs_find(spark, d):
    return pairs.find(_pairs(spark, d), SEEK.encode()).select(F.col("key").cast("string").alias("key"), "how")


@query("select count(*) as n from customer where c_mktsegment = 'BUILDING'")
def pairs_count(spark, d):
    return pairs.count(_pairs(spark, d), b"BUILDING/")


@query("select count(*) as at from customer where c_mktsegment || '/' || c_name < 'FURNITURE/'")
def pairs_index_of(spark, d):
    return pairs.index_of(_pairs(spark, d), b"FURNITURE/")


@query("select c_mktsegment || '/' || c_name as key from customer where c_mktsegment <> 'BUILDING' and not (c_mktsegment || '/' || c_name between 'FURNITURE/' and 'FURNITURE/z')")
def pairs_erase(spark, d):
    return pairs.erase_up_to(pairs.erase_all(_pairs(spark, d), b"BUILDING/"), b"FURNITURE/", b"FURNITURE/z").select(F.col("key").cast("string").alias("key"))


@query("select min(c_mktsegment || '/' || c_name) as first, max(c_mktsegment || '/' || c_name) as last from customer where c_mktsegment like 'M%'")
def pairs_first_last(spark, d):
    p = _pairs(spark, d)
    ends = pairs.first(p, b"M").select(F.col("key").alias("first"), F.lit(None).cast("binary").alias("last")).union(pairs.last(p, b"M").select(F.lit(None).cast("binary"), "key"))
    return ends.agg(F.max("first").cast("string").alias("first"), F.max("last").cast("string").alias("last"))


@query("select s_suppkey, case when s_suppkey % 2 = 0 then 'set on creation' else s_name end as note from supplier")
def upsert_on_create(spark, d):
    """Odd keys are there already; only the others are created."""
    new = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("note"))
    return mutate.upsert(new.where("s_suppkey % 2 = 1"), new, RelationDef(["s_suppkey"]), on_create={"note": F.lit("set on creation")})[0]


@query("select s_suppkey, upper(s_name) as s_name from supplier")
def insert_normalized(spark, d):
    new = table(spark, d, "supplier").select("s_suppkey", "s_name")
    d_ = RelationDef(["s_suppkey"])
    return mutate.insert(new.limit(0), mutate.normalized(new, {"s_name": F.upper("s_name")}), d_)[0]


@query("select c_mktsegment || '/' || c_name as key, cast(c_custkey as varchar) as value from customer")
def pairs_export_import(spark, d):
    path = work_path(spark)
    export_pairs(_pairs(spark, d), path)
    return import_pairs(spark, path).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("select s_suppkey, s_name, 'a' as side from supplier where s_suppkey % 10 = 1 union all select s_suppkey, 'x', 'b' from supplier where s_suppkey % 10 = 1")
def compare_tables(spark, d):
    a = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return stats.difference(a, a.withColumn("s_name", F.when(F.col("s_suppkey") % 10 == 1, "x").otherwise(F.col("s_name"))))


@query("select s_suppkey, 1 as version from supplier union all select s_suppkey, 2 from supplier where s_suppkey > 10")
def snapshots_time_travel(spark, d):
    store, s = Store(spark, work_path(spark)), table(spark, d, "supplier").select("s_suppkey")
    store.commit({"supplier": s})
    store.commit({"supplier": store.read("supplier").where("s_suppkey > 10")}, {"rows": 1})
    return store.read("supplier", 1).withColumn("version", F.lit(1)).union(store.read("supplier").withColumn("version", F.lit(2)))


def _log(spark, d) -> DataFrame:
    return log.batches(table(spark, d, "events"), F.floor(F.col("event_id") / 100), F.col("event_id"), F.concat(F.lit("m"), (F.floor(F.col("event_id") / 100) % 3).cast("string")), "event_type")


@query("select event_id // 100 as batch_id, event_id % 100 as seq, event_type as type from events where (event_id // 100) % 3 = 1 and event_type in ('click', 'view') and event_id // 100 <= 60")
def log_observe(spark, d):
    return log.observe(_log(spark, d), F.col("metadata") == "m1", ["click", "view"], 60).select("batch_id", "seq", "type")


@query("select event_id // 100 as batch_id, event_id % 100 as seq, event_type as type, event_id, user_id, -1 as added from events")
def log_decode_evolved(spark, d):
    return log.decode(_log(spark, d), "event_id bigint, user_id bigint, added bigint", {"added": -1})


@query("select event_id, case event_type when 'click' then 'press' else event_type end as kind, user_id from events")
def log_renamed_values(spark, d):
    """A field and one of its named values that had other names when the events were written."""
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("user_id", T.LongType())])
    return read_versions([table(spark, d, "events")], Version(schema, renamed={"kind": "event_type"}, values={"kind": {"click": "press"}}))


@query("select event_id // 100 as batch_id, event_id % 100 as seq, event_type as type from events")
def log_incremental_read(spark, d):
    """Two appends, each read by a streaming query that resumes at its checkpoint."""
    root, out = work_path(spark), work_path(spark)
    rows = _log(spark, d)
    for half in (0, 1):
        log.append(rows.where(F.col("batch_id") % 2 == half), f"{root}/log")
        log.read_new(spark, f"{root}/log", f"{root}/checkpoint", lambda df, n: df.write.mode("append").parquet(out))
    return spark.read.schema(log.SCHEMA).parquet(out).select("batch_id", "seq", "type")


@query("select event_id, 'T' || event_type as name from events where event_type <> 'error'")
def log_types_from_metadata(spark, d):
    data = table(spark, d, "events").withColumnRenamed("event_type", "type_id")
    types = data.where("type_id <> 'error'").select("type_id", F.concat(F.lit("T"), "type_id").alias("name")).distinct()
    return log.with_type(data, types)[0].select("event_id", "name")


@query("select c_mktsegment || '/' || c_name as key, case when c_custkey % 5 = 0 then 'new' else cast(c_custkey as varchar) end as value from customer")
def pairs_put(spark, d):
    p = _pairs(spark, d)
    new = table(spark, d, "customer").where("c_custkey % 5 = 0").select(F.concat("c_mktsegment", F.lit("/"), "c_name").cast("binary").alias("key"), F.lit("new").cast("binary").alias("value"))
    return pairs.put(p, new).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("select case when s_suppkey = 1 then s_name || '/renamed' else s_name end as key from supplier")
def pairs_update_suffix(spark, d):
    s = table(spark, d, "supplier")
    name = s.where("s_suppkey = 1").first().s_name
    p = s.select(F.col("s_name").cast("binary").alias("key"), F.lit("v").cast("binary").alias("value"))
    return pairs.update_suffix(p, name.encode(), f"{name}/renamed".encode())[0].select(F.col("key").cast("string").alias("key"))


@query("select sum(strlen(cast(o_orderkey as varchar))) as new_key_bytes, sum(strlen(cast(o_custkey as varchar)) + 1) as new_value_bytes, sum(case when o_orderkey % 3 > 0 then strlen(cast(o_orderkey as varchar)) else 0 end) as old_key_bytes, sum(case when o_orderkey % 3 > 0 then strlen(cast(o_custkey as varchar)) + strlen(o_orderstatus) else 0 end) as old_value_bytes from orders where o_orderkey % 2 = 0")
def upsert_with_sizes(spark, d):
    return mutate.upsert_with_sizes(*_halves(spark, d), ORDERS)[1]


@query("select o_custkey, case when o_custkey % 2 = 0 then timestamp '2030-01-01' else max(o_orderdate) end as last from orders group by o_custkey")
def upsert_in_key(spark, d):
    """A new in-key value takes the place of the row with the same unique key."""
    old = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    new = old.where("o_custkey % 2 = 0").select("o_custkey", at("2030-01-01").alias("last"))
    return mutate.upsert(old, new, RelationDef(["o_custkey", "last"], in_key=["last"]))[0]


@query("select s_suppkey as key from supplier where s_suppkey <> 3")
def dict_keys_after_removal(spark, d):
    return _dict(spark, d).remove_range(Range(3, 3))[0].keys()


@query("select count(*) as n from supplier")
def dict_count(spark, d):
    return _dict(spark, d).count()


@query("select s_name as value from supplier")
def dict_values(spark, d):
    return _dict(spark, d).values()


@query("select conv_id, count(*) as n from conversations group by conv_id")
def count_by_prefix_for_all(spark, d):
    return stats.group_count(table(spark, d, "conversations"), "conv_id")


@query("select p_partkey, p_size from part where p_brand = 'Brand#1' and p_type like '%A%'")
def scan_by_brand_and_type(spark, d):
    return part(spark, d).scan_by(c.exact("Brand#1"), c.contains("A"), index="Brand").select("p_partkey", "p_size")


@query("select count(*) as total from part where p_size < 20")
def gather_total_by_secondary(spark, d):
    return part(spark, d).gather_total(c.up_to(20, including=False), index="Size")


@query(f"select * from {OBJECTS} where type <> 'document'")
def object_delete_all_of_type(spark, d):
    """Objects left when those of one kind are gone."""
    return objects(spark, d).delete_all("document").df


@query("select 2 as version")
def snapshots_first_difference(spark, d):
    a, b = Store(spark, work_path(spark)), Store(spark, work_path(spark))
    s = table(spark, d, "supplier")
    for store, least in ((a, 5), (b, 6)):
        store.commit({"supplier": s})
        store.commit({"supplier": s.where(F.col("s_suppkey") > least)})
    return spark.range(1).select(F.lit(a.first_difference(b, "supplier")).alias("version"))
