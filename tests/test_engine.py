"""The engine on small tables with nulls, empty children, composites and ranges."""
import pytest
from decimal import Decimal

from trellis.errors import QueryError
from trellis.plans.session import Session
from trellis.plans.wellknown import WellKnown
from trellis.sources.catalog import Catalog, Computed, Field, ForeignKey, Function, Parameter, Relation, frame
from trellis.streaming.rows import array_chunks
from pyspark.sql import functions as F


def dot(*n):
    return [".", *n]


HOTELS = [(1, 1, "Grand", 5, ("Main", "Oslo")), (2, 1, "Inn", 3, None), (3, None, "Hut", None, ("Hill", None))]
ROOMS = [(1, 1, "A1", ["sea", "tv"], Decimal("100.00")), (2, 1, "A2", [], Decimal("80.50")), (3, 1, "B1", None, None), (4, 2, "C1", ["tv"], Decimal("45.00"))]
STAYS = [(1, 1, (1, 5, True, False)), (2, 1, (5, 9, True, False)), (3, 2, (3, None, True, False))]


def catalog(**more):
    return Catalog([
        Relation("chain", frame([(1, "Blue")], "id int, name string"), ("id",), {"chain_name": ("name",)}),
        Relation("hotel", frame(HOTELS, "id int, chain_id int, name string, stars int, home struct<street: string, city: string>"), ("id",),
                 foreign_keys=(ForeignKey(("chain_id",), "chain", ("id",)),), fields={"id": Field(identity=True), "name": Field(nullable=False), "stars": Field(default=2, has_default=True)},
                 computed={"shout": Computed(lambda c: F.upper(c["name"])), "all_rooms": Computed(relation="room", on=(("hotel_id", "id"),))}),
        Relation("room", frame(ROOMS, "id int, hotel_id int, code string, tags array<string>, price decimal(10,2)"), ("id",), {"room_code": ("hotel_id", "code")},
                 (ForeignKey(("hotel_id",), "hotel", ("id",)),), fields={"id": Field(identity=True)}),
        Relation("stay", frame(STAYS, "id int, room_id int, span struct<lower: int, upper: int, lower_inc: boolean, upper_inc: boolean>"), ("id",), foreign_keys=(ForeignKey(("room_id",), "room", ("id",)),)),
        Relation("loose", frame([(1, 1)], "a int, b int"), indexes=(("a", "b"),), foreign_keys=(ForeignKey(("b",), "hotel", ("id",)),)),
    ], [
        Function("rooms_under", (Parameter("most", "int"), Parameter("of", "int", None, True)), "id int, hotel_id int, code string, tags array<string>, price decimal(10,2)",
                 "SELECT * FROM {room} WHERE price < most AND (of IS NULL OR hotel_id = of)", table=True, relation="room"),
        Function("twice", (Parameter("x", "int"),), "int", "x * 2"), Function("twice", (Parameter("x", "int"), Parameter("y", "int")), "int", "(x + y) * 2"),
        Function("pairs", (), "a int", "SELECT 1", table=True),
    ], **more)


@pytest.fixture
def s(spark):
    return Session(spark, catalog())


ROOM_JOIN = {"rooms": {"relation": "room", "on": {"hotel_id": "id"}, "select": ["col", "code"]}}


def run(s, **q):
    return s.execute(q)


def test_embeds_null_and_empty(s):
    got = run(s, relation="hotel", join={**ROOM_JOIN, "chain": {"relation": "chain", "on": {"id": "chain_id"}}}, select={"n": dot("name"), "c": dot("chain"), "r": dot("rooms"), "cn": dot("chain", "name")}, order_by=[dot("id")])
    assert got == [
        {"n": "Grand", "c": {"id": 1, "name": "Blue"}, "r": ["A1", "A2", "B1"], "cn": "Blue"}, {"n": "Inn", "c": {"id": 1, "name": "Blue"}, "r": ["C1"], "cn": "Blue"},
        {"n": "Hut", "c": None, "r": [], "cn": None}]


def test_null_ordering(s):
    stars = lambda *order: [r["stars"] for r in run(s, relation="hotel", select=["*~"], order_by=list(order))]
    assert stars(dot("stars")) == [3, 5, None]
    assert stars(["desc", dot("stars")]) == [5, 3, None]
    assert stars(["asc-nulls-first", dot("stars")]) == [None, 3, 5]


def test_child_order_with_nulls_and_text_descending(s):
    q = {"relation": "hotel", "where": ["=", dot("id"), 1], "join": {"rooms": {**ROOM_JOIN["rooms"], "order_by": [["desc", dot("price")]]}}, "select": dot("rooms")}
    assert s.execute(q) == [["A1", "A2", "B1"]]
    q["join"]["rooms"]["order_by"] = [["desc", dot("code")]]
    assert s.execute(q) == [["B1", "A2", "A1"]]


def test_aggregates_on_nothing(s):
    got = run(s, relation="hotel", join=ROOM_JOIN, order_by=[dot("id")], select={
        "n": ["agg", "count", [dot("rooms")]], "p": ["agg", "count", [dot("rooms", "price")]], "s": ["agg", "sum", [dot("rooms", "price")]], "a": ["agg", "array_agg", [dot("rooms", "price")]]})
    assert got[0] == {"a": [100, Decimal("80.5"), None], "n": 3, "p": 2, "s": Decimal("180.5")}
    assert got[2] == {"a": None, "n": 0, "p": 0, "s": None}


def test_composites_arrays_and_ranges(s):
    assert run(s, relation="hotel", select=dot("home", "city"), order_by=[dot("id")]) == ["Oslo", None, None]
    assert run(s, relation="room", where=["@>", dot("tags"), ["array", "tv"]], select=dot("id"), order_by=[dot("id")]) == [1, 4]
    assert run(s, relation="room", where=["is_false", ["&&", dot("tags"), ["array", "tv"]]], select=dot("id")) == [2]
    assert run(s, relation="room", where=["any", "=", "sea", dot("tags")], select=dot("id")) == [1]
    assert run(s, relation="room", select=["index", dot("tags"), 2], order_by=[dot("id")]) == ["tv", None, None, None]
    inside = lambda n: run(s, relation="stay", where=["@>", dot("span"), n], select=dot("id"), order_by=[dot("id")])
    assert (inside(5), inside(4), inside(1000)) == ([2, 3], [1, 3], [3])
    q = {"relation": "stay", "join": {"room": {"relation": "room", "on": {"id": "room_id"}}}, "where": ["&&", dot("span"), dot("span")], "select": dot("id")}
    assert len(s.execute(q)) == 3


def test_computed_fields(s):
    got = run(s, relation="hotel", where=["=", dot("id"), 2], select=["*~", ["home"], {"loud": dot("shout"), "rooms": dot("all_rooms")}])
    assert got[0]["loud"] == "INN" and [r["code"] for r in got[0]["rooms"]] == ["C1"]
    assert "shout" not in run(s, relation="hotel", limit=1)[0]


def test_functions(s):
    assert run(s, function="twice", arguments=[4]) == 8 and run(s, function="twice", arguments={"x": 1, "y": 2}) == 6
    assert [r["id"] for r in run(s, function="rooms_under", arguments=[90], order_by=[dot("id")])] == [2, 4]
    got = run(s, relation="hotel", order_by=[dot("id")], join={"cheap": {"function": "rooms_under", "arguments": [90, dot("id")], "select": dot("code")}}, select=dot("cheap"))
    assert got == [["A2"], ["C1"], []]


@pytest.mark.parametrize(("q", "code"), [
    ({"relation": "nothing"}, "UNKNOWN_IDENTIFIER"), ({"relation": "hotel", "schema": "pg_catalog"}, "UNKNOWN_IDENTIFIER"), ({"relation": "hotel", "select": ["col", "shout"]}, "UNKNOWN_IDENTIFIER"),
    ({"relation": "hotel", "join": {"x": {"relation": "loose", "on": {"b": "id"}}}}, "JOIN_MISSING_INDEX"), ({"relation": "hotel", "join": {"x": {"relation": "room", "on": {"id": "stars"}}}, "select": dot("x"), "where": ["=", dot("x", "nope"), 1]}, "UNKNOWN_IDENTIFIER"),
    ({"relation": "room", "join": {"x": {"relation": "stay", "on": {"id": "code"}}}, "select": dot("y")}, "UNKNOWN_IDENTIFIER"), ({"relation": "hotel", "join": {"x": {"relation": "room", "on": {"code": "name"}}}}, "JOIN_MISSING_INDEX"),
    ({"relation": "hotel", "join": ROOM_JOIN, "select": dot("rooms", "code")}, "QUERY_INVALID_EXPRESSION"), ({"relation": "hotel", "select": ["*", ["shout"]]}, "UNKNOWN_IDENTIFIER"),
    ({"relation": "hotel", "select": ["*", {"name": 1}]}, "QUERY_INVALID_EXPRESSION"), ({"relation": "hotel", "join": {"name": ROOM_JOIN["rooms"]}, "select": dot("name")}, "UNKNOWN_IDENTIFIER"),
    ({"relation": "hotel", "distinct_on": [dot("id")], "order_by": [dot("name")]}, "QUERY_INVALID_EXPRESSION"), ({"function": "twice", "arguments": []}, "UNKNOWN_IDENTIFIER"),
    ({"relation": "hotel", "select": ["call", "nothing", 1]}, "UNKNOWN_IDENTIFIER"), ({"relation": "hotel", "join": {"p": {"function": "pairs"}}}, "JOIN_MISSING_INDEX"),
])
def test_refusals(s, q, code):
    with pytest.raises(QueryError) as e:
        s.execute(q)
    assert e.value.code == code


def test_depth_limit(spark):
    with pytest.raises(QueryError):
        Session(spark, catalog(max_depth=1)).execute({"relation": "hotel", "join": ROOM_JOIN})


def test_envelope(s):
    got = s.execute({"query": {"relation": "hotel", "limit": 1, "offset": 1, "order_by": [dot("id")], "select": dot("id")}, "count": True, "sql": True, "query_plan": True})
    assert got["result"] == [2] and got["count"] == 3 and got["limit"] == 1 and got["offset"] == 1 and got["sql"] and got["query_plan"]
    assert s.execute([{"relation": "chain", "select": dot("id")}, {"relation": "hotel", "limit": 0}]) == [[1], []]
    assert s.execute([{"relation": "chain", "select": dot("id")}]) == [1]


def test_write_texts_and_plans(s):
    q = {"query": {"relation": "chain", "write_mode": "upsert"}, "data": [{"id": 1, "name": "x"}, {"id": 2, "name": "y"}], "returns": "none", "rollback": True}
    assert [list(x) for x in s.execute({**q, "sql": True})["sql"]] == [["path", "update"], ["path", "insert"]]
    assert all(x["plan"]["node"] and x["plan"]["reads"] for x in s.execute({**q, "query_plan": True})["query_plan"]) and s.execute({"relation": "chain", "select": dot("id")}) == [1]


def test_grants(spark):
    s = Session(spark, catalog(), grants={"count": False, "rollback": False})
    assert "count" not in s.execute({"query": {"relation": "chain"}, "count": True})
    with pytest.raises(QueryError) as e:
        s.execute({"query": {"relation": "chain"}, "rollback": True})
    assert e.value.code == "QUERY_ROLLBACK_NOT_GRANTED"


def test_well_known(spark):
    q = {"name": "q", "params": {"n": {"type": "int4", "default": 4}}, "query": {"relation": "hotel", "where": [">=", dot("stars"), ["$param", "n", "int4"]], "select": dot("id")}}
    known = WellKnown([q, {**q, "name": "bad", "params": {}}, {**q, "name": "two"}, {**q, "name": "two"}, {**q, "name": "extra", "params": {**q["params"], "m": {}}}])
    s = Session(spark, catalog(), known)
    assert s.execute({"wellknown": "q"}) == [1] and s.execute({"wellknown": "q", "params": {"n": 3}}) is not None
    assert {k: e.code for k, e in known.problems.items()} == {"bad": "WELL_KNOWN_UNKNOWN_PARAM", "two": "WELL_KNOWN_DUPLICATE_NAME", "extra": "WELL_KNOWN_UNUSED_PARAM"}
    for name, params, code in (("two", {}, "WELL_KNOWN_UNKNOWN_QUERY"), ("q", {"n": "x"}, "WELL_KNOWN_PARAM_TYPE_MISMATCH")):
        with pytest.raises(QueryError) as e:
            s.execute({"wellknown": name, "params": params})
        assert e.value.code == code


def hotels(s):
    return {r["id"]: r for r in s.execute({"relation": "hotel", "select": ["*~"]})}


HOTEL = {"relation": "hotel", "select": {"id": dot("id"), "name": dot("name"), "stars": dot("stars"), "city": dot("home", "city"), "chain": dot("chain"), "rooms": dot("rooms")},
         "join": {"chain": {"relation": "chain", "on": {"id": "chain_id"}}, "rooms": {"relation": "room", "on": {"hotel_id": "id"}, "select": {"id": dot("id"), "code": dot("code"), "price": dot("price")}}}}


def test_nested_insert_numbers_and_threads_keys(s):
    got = s.execute({"query": HOTEL, "data": [{"name": "New", "chain": {"id": 9, "name": "Red"}, "rooms": [{"code": "Z"}, {"code": "Y", "price": "3.50"}]}], "stats": True})
    assert got["result"][0]["id"] == 4 and got["result"][0]["stars"] == 2 and got["result"][0]["chain"] == {"id": 9, "name": "Red"}
    assert [r["code"] for r in got["result"][0]["rooms"]] == ["Z", "Y"] and {x["table"]: x["inserted"] for x in got["stats"]} == {"main.chain": 1, "main.hotel": 1, "main.room": 2}


def test_absent_null_and_empty_joins(s):
    q = {**HOTEL, "write_mode": "update-existing"}
    s.execute({"query": q, "data": [{"id": 1, "rooms": [{"id": 1, "code": "A1x"}]}, {"id": 2, "chain": None}]})
    rooms = {r["id"]: r for r in s.execute({"relation": "room", "select": ["*~"]})}
    # rooms missing from hotel 1's array go, those of hotel 2, which left the key out, stay; names left out stay
    assert set(rooms) == {1, 4} and rooms[1]["code"] == "A1x"
    assert hotels(s)[2]["chain_id"] is None and hotels(s)[1]["chain_id"] == 1 and hotels(s)[1]["name"] == "Grand"
    s.execute({"query": q, "data": [{"id": 2, "rooms": []}]})
    assert s.execute({"relation": "room", "select": dot("id")}) == [1]


def test_composite_sub_field(s):
    s.execute({"query": {**HOTEL, "write_mode": "update-existing"}, "data": [{"id": 1, "city": "Rome"}, {"id": 2, "city": "Bari"}]})
    assert hotels(s)[1]["home"] == {"street": "Main", "city": "Rome"} and hotels(s)[2]["home"]["city"] == "Bari" and hotels(s)[3]["home"] == {"street": "Hill", "city": None}


@pytest.mark.parametrize(("data", "code"), [
    ([{"id": 1, "name": "x"}], "PG_UNIQUE_VIOLATION"), ([{"id": 8}], "PG_NOT_NULL_VIOLATION"), ([{"id": 8, "name": 5}], "PG_INVALID_TEXT_REPRESENTATION"), ([{"id": 1.0, "name": "x"}], "PG_INVALID_TEXT_REPRESENTATION"),
    ([{"id": 8, "name": "x"}, {"id": 8, "name": "y"}], "PG_UNIQUE_VIOLATION"), ({"id": 8}, "QUERY_INVALID_EXPRESSION"),
])
def test_a_failed_write_leaves_nothing(s, data, code):
    first = {"query": {"relation": "chain"}, "data": [{"id": 5, "name": "Five"}]}
    with pytest.raises(QueryError) as e:
        s.execute([first, {"query": HOTEL, "data": data}])
    assert e.value.code == code and s.execute({"relation": "chain", "select": dot("id")}) == [1]


def test_forbidden_writes(s):
    for q in ({"relation": "loose", "write_mode": "upsert"}, {"relation": "hotel", "write_mode": "merge"}, {"relation": "hotel", "write_mode": "update"}, {"relation": "hotel", "write_mode": "upsert", "select": {"name": dot("name")}}, {"relation": "hotel", "write_mode": "readonly"}):
        with pytest.raises(QueryError) as e:
            s.execute({"query": q, "data": [{}]})
        assert e.value.code == "WRITE_FORBIDDEN"


def test_save_and_load(s, spark, tmp_path):
    s.execute({"query": {"relation": "chain", "write_mode": "delete", "where": True}})
    s.save(f"file://{tmp_path}/store")
    again = Session(spark, catalog())
    again.load(f"file://{tmp_path}/store")
    assert again.execute({"relation": "chain"}) == [] and len(again.execute({"relation": "hotel"})) == 3


def test_stream(s):
    assert list(s.stream({"relation": "chain", "select": dot("name")})) == ['"Blue"']
    assert "".join(array_chunks(s.stream({"relation": "chain"}))) == '[{"id":1,"name":"Blue"}]'


def test_export(s, spark):
    assert '"room_code"' in s.catalog.export(spark)


def test_cbor_stream(s):
    from trellis.sources import cbor
    from trellis.streaming.rows import cbor_chunks, values

    q = {"relation": "room", "order_by": [dot("id")], "limit": 1}
    assert cbor.loads(b"".join(cbor_chunks(values(s.frame(q))))) == [{"id": 1, "hotel_id": 1, "code": "A1", "tags": ["sea", "tv"], "price": Decimal("100.00")}]


def test_where_driven_writes(s):
    q = {"relation": "room", "where": ["<", dot("price"), 90], "select": {"id": dot("id"), "price": dot("price")}}
    got = s.execute([{"query": {**q, "write_mode": "update"}, "data": {"price": "50.00"}}, {"query": {**q, "write_mode": "update"}, "data": {"price": 95}}])
    assert sorted(r["id"] for r in got[0]) == [2, 4] and got[1] == []
    gone = s.execute({"query": {"relation": "room", "write_mode": "delete", "where": ["is_null", dot("price")]}, "stats": True})
    assert gone["result"] == [] and gone["stats"][0]["deleted"] == 1 and len(s.execute({"relation": "room"})) == 3
    with pytest.raises(QueryError):
        s.execute({"query": {"relation": "hotel", "write_mode": "delete", "where": True, "join": ROOM_JOIN}})


def test_enums_sort_as_declared(spark):
    rows = [(1, "low"), (2, "high"), (3, None), (4, "middle")]
    jobs = Relation("job", frame(rows, "id int, level string"), ("id",), fields={"level": Field(enum=("low", "middle", "high"))})
    s = Session(spark, Catalog([jobs]))
    assert s.execute({"relation": "job", "order_by": [["desc", dot("level")]], "select": dot("id")}) == [2, 4, 1, 3]
    with pytest.raises(QueryError) as e:
        s.execute({"query": {"relation": "job"}, "data": [{"id": 9, "level": "none"}]})
    assert e.value.code == "PG_INVALID_TEXT_REPRESENTATION"


@pytest.mark.parametrize(("select", "code"), [(["+", dot("tags"), 1], "QUERY_INVALID_EXPRESSION"), (["/", 1, ["-", dot("id"), dot("id")]], "TRANSACTION_ERROR")])
def test_spark_errors_have_codes(s, select, code):
    with pytest.raises(QueryError) as e:
        s.execute({"relation": "room", "select": select})
    assert e.value.code == code


def test_casts_and_dates_cover_all_orders(spark):
    """sf0.1 has more orders than the smaller folders."""
    from trellis import queries

    folder = "/root/testdata/sf0.1"
    assert queries.QUERIES["e4_casts_and_dates"](spark, folder).count() == spark.read.parquet(f"{folder}/orders.parquet").count() == 150_000


def test_distinct_statistics(spark):
    import math

    from pyspark.sql import types as T
    from trellis.functions import aggregates

    pairs = [(1, 2), (1, 2), (1, 2), (4, 3), (4, 3), (9, 11), (None, 5), (6, None)]
    df = spark.createDataFrame([(1, y, x) for y, x in pairs] + [(2, None, None)], "k int, y int, x int")
    names = [n for n in aggregates.PLAIN if n not in aggregates.UNMOVED and n != "mode"]

    def told(frame, distinct):
        args = lambda n: [F.col("y"), F.col("x")][: aggregates.ARITY.get(n, (1, 1))[0]]
        kinds = [T.IntegerType(), T.IntegerType()]
        return frame.groupBy("k").agg(*(aggregates.aggregate(n, args(n), kinds, distinct, None, [], []).alias(n) for n in names)).orderBy("k").collect()
    got, want, plain = told(df, True), told(df.distinct(), False), told(df, False)
    for n in names:
        for a, b in zip(got, want, strict=True):
            assert a[n] == b[n] or math.isclose(a[n], b[n]), n
        assert n in ("bit_xor", "median") or not math.isclose(got[0][n], plain[0][n]), n
    least = df.groupBy("k").agg(aggregates.aggregate("mode", [F.col("y")], [T.IntegerType()], True, None, [], []).alias("m")).orderBy("k").collect()
    assert [r["m"] for r in least] == [1, None]


def call(*a):
    return ["call", *a]


TIME = ["::", "2024-03-05 14:07:09.123456", "timestamp"]


@pytest.mark.parametrize(("e", "value"), [
    (call("to_char", TIME, "YYYY-MM-DD HH24:MI:SS"), "2024-03-05 14:07:09"), (call("to_char", TIME, "FMDD Mon YY, HH12:MI am"), "5 Mar 24, 02:07 pm"), (call("to_char", TIME, "FMDay|Month|DY|DDD|Q|MS"), "Tuesday|March    |TUE|065|1|123"),
    (call("to_char", TIME, 'YYYY"at"HH24'), "2024at14"), (call("to_char", ["::", "2024-12-30", "date"], "IYYY-IW-ID W"), "2025-01-1 5"), (call("to_char", TIME, "MI$SS"), "07$09"),
    (call("to_char", ["numeric", "1234.5"], "9,999.00"), " 1,234.50"), (call("to_char", ["numeric", "-1234.567"], "FM9,999,990.99"), "-1,234.57"), (call("to_char", 7, "000"), " 007"), (call("to_char", 0, "9.99"), "  .00"),
    (call("to_char", ["numeric", "0.5"], "FM990.0"), "0.5"), (call("to_char", 12345, "999"), " ###"), (call("to_char", -5, "99PR"), " <5>"), (call("to_char", 5, "S99"), " +5"), (call("to_char", -5, "99MI"), " 5-"), (call("to_char", None, "99"), None),
    (call("to_date", "05/03/2024", "DD/MM/YYYY"), "2024-03-05"), (call("to_date", "5 mar 2024", "FMDD Mon YYYY"), "2024-03-05"), (call("to_char", call("to_timestamp", "2024-03-05 14.07", "YYYY-MM-DD HH24.MI"), "HH12:MI AM"), "02:07 PM"), (call("to_char", call("to_timestamp", 0), "YYYY"), "1970"),
    (call("regexp_replace", "abcabc", "(b)", "X"), "aXcabc"), (call("regexp_replace", "abcabc", "(b)", "<\\1>"), "a<b>cabc"), (call("regexp_replace", "abcabc", "(b)(c)", "\\2\\1$", "g"), "acb$acb$"), (call("regexp_replace", "aBa", "b", "[\\&]", "i"), "a[B]a"),
    (call("regexp_replace", "x\ny\nz", "y.", "-"), "x\n-z"), (call("regexp_replace", "aa bb", "(.)\\1", "<\\1>", "g"), "<a> <b>"), (call("regexp_replace", "abc", "(?<=b)c", "!"), "ab!"), (call("regexp_replace", "abc", "q", "!"), "abc"),
    (call("regexp_match", "foobar", "(o)(b)"), ["o", "b"]), (call("regexp_match", "foobar", "o+"), ["oo"]), (call("regexp_match", "foobar", "q"), None), (call("regexp_match", "FOO", "(?:f)(o)[(]?", "i"), ["O"]), (call("regexp_split_to_array", "a1b22c", "[0-9]+"), ["a", "b", "c"]),
    (call("jsonb_build_object", "a", 1, "b", True, "c", None, "d", "x"), {"a": 1, "b": True, "c": None, "d": "x"}), (call("jsonb_build_object", "o", call("jsonb_build_array", 1, "two", ["array", 3])), {"o": [1, "two", [3]]}),
    (call("jsonb_build_object", call("lower", "K"), 1), {"k": 1}), (call("to_jsonb", {"a": 1}), {"a": 1}), (call("to_jsonb", "t"), "t"),
    (call("jsonb_extract_path_text", '{"a.b": {"c": [5, 6]}}', "a.b", "c", "1"), "6"), (call("jsonb_extract_path", '{"a\'b": {"c": [5]}}', "a'b"), {"c": [5]}), (call("jsonb_extract_path_text", '{"a": 1}', "z"), None),
    (call("jsonb_set", '{"a": {"b": 1}}', "{a,b}", ["::", "[2]", "jsonb"]), {"a": {"b": [2]}}), (call("jsonb_set", '{"a": [1, 2]}', ["array", "a", "-1"], call("to_jsonb", 9)), {"a": [1, 9]}), (call("jsonb_set", '{"a": 1}', "{b}", call("to_jsonb", 2), False), {"a": 1}),
    (call("jsonb_insert", '{"a": [1, 2]}', "{a,0}", call("to_jsonb", 9), True), {"a": [1, 9, 2]}), (call("jsonb_strip_nulls", '{"a": null, "b": [null, {"c": null}]}'), {"b": [None, {}]}), (["||", ["::", '{"a": 1}', "jsonb"], ["::", '{"b": 2}', "jsonb"]], {"a": 1, "b": 2}),
    (["-", ["::", '{"a": 1, "b": 2, "c": 3}', "jsonb"], "a", ["array", "c", "z"]], {"b": 2}), (["-", ["::", '["a", 1, "b"]', "jsonb"], -1, "a"], [1]),
    (call("jsonb_typeof", ["::", "[1]", "jsonb"]), "array"), (call("jsonb_array_length", ["::", "[1, 2]", "jsonb"]), 2), (["@>", ["::", '{"a": [1, {"b": 2}], "c": 3}', "jsonb"], ["::", '{"a": [{"b": 2}]}', "jsonb"]], True), (["<@", ["::", "[1]", "jsonb"], ["::", "[2, 1.0]", "jsonb"]], True),
    (call("div", ["bigint", "9007199254740993"], 1), 9007199254740993), (call("div", -7, 2), -3), (call("div", ["numeric", "7.5"], 2), 3), (call("trunc", ["bigint", "9007199254740993"]), 9007199254740993), (call("trunc", ["numeric", "-12.345"], 2), Decimal("-12.34")), (call("trunc", 1299, -2), 1200),
    (call("age", ["::", "2024-03-05", "timestamp"], ["::", "2023-01-01", "timestamp"]), "1 year 2 mons 4 days"), (call("age", ["::", "2024-03-01", "timestamp"], ["::", "2024-01-31 12:00", "timestamp"]), "1 mon 12:00:00"), (call("age", ["::", "2023-01-01", "date"], ["::", "2024-03-05", "date"]), "-1 years -2 mons -4 days"), (call("age", TIME, TIME), "00:00:00"),
    (call("gcd", 12, 18), 6), (call("lcm", 4, 6), 12), (call("overlay", "Txxxxas", "hom", 2, 4), "Thomas"), (call("array_positions", ["array", 1, 2, 1], 1), [1, 3]), (call("quote_ident", "a b"), '"a b"'), (call("num_nulls", 1, None, None), 2), (call("upper", "a"), "A"), (call("trim_array", ["array", 1, 2, 3], 2), [1]),
])
def test_function_library(s, e, value):
    got = s.execute({"relation": "chain", "select": e})
    assert got == [value] and (isinstance(value, (bool, type(None))) or type(got[0]) is not bool)


@pytest.mark.parametrize(("query", "found"), [
    ("cat dog", [1, 4]), (call("to_tsquery", "cat & !dog"), [2]), (call("to_tsquery", "(cat | bird) & do:*"), [1, 3, 4]), (call("to_tsquery", "'big' <-> dog"), [4]), (call("phraseto_tsquery", "big dog"), [4]),
    (call("websearch_to_tsquery", 'cat -dog'), [2]), (call("websearch_to_tsquery", '"big dog" or bird'), [3, 4]), (["||", "cat", " dog"], [1, 4]), ("", [1, 2, 3, 4]), (call("to_tsquery", "ca"), []),
])
def test_text_search(spark, query, found):
    rows = [(1, "A Cat, a DOG"), (2, "cat's"), (3, "Bird_do"), (4, "cat: big dog"), (5, None)]
    s = Session(spark, Catalog([Relation("note", frame(rows, "id int, body string"), ("id",))]))
    assert s.execute({"relation": "note", "where": ["@@", call("to_tsvector", "simple", dot("body")), query], "select": dot("id"), "order_by": [dot("id")]}) == found


def test_text_search_refuses_what_it_cannot_read(s):
    for q in ("a &", "(a", "a <-> !b", "| a"):
        with pytest.raises(QueryError):
            s.execute({"relation": "chain", "where": ["@@", dot("name"), call("to_tsquery", q)]})


def test_own_aggregates_and_variadics(spark):
    from trellis.sources.catalog import Aggregate

    base = catalog()
    c = Catalog(base.relations.values(), [
        Function("longest", (Parameter("least", "int"), Parameter("words", "array<string>", variadic=True)), "string", "array_max(transform(filter(words, w -> length(w) >= least), w -> struct(length(w) AS n, w AS w))).w"),
        Function("rooms_of", (Parameter("ids", "array<int>", variadic=True),), "id int, hotel_id int, code string, tags array<string>, price decimal(10,2)", "SELECT * FROM {room} WHERE array_contains(ids, hotel_id)", table=True, relation="room"),
    ], aggregates=[Aggregate("spread", lambda x: F.max(x) - F.min(x)), Aggregate("dot_product", lambda x, y: F.sum(x * y), 2)])
    s = Session(spark, c)
    word = lambda *a: s.execute({"function": "longest", "arguments": list(a)})
    assert word(2, "a", "bcd", "ef") == "bcd" and word(9, "a") is None and word(1) is None and s.execute({"function": "longest", "arguments": {"least": 1, "words": ["array", "x", "yz"]}}) == "yz"
    assert s.execute({"relation": "room", "select": call("longest", 0, dot("code"), "B10"), "order_by": [dot("id")], "limit": 2}) == ["B10", "B10"]
    assert [r["id"] for r in s.execute({"function": "rooms_of", "arguments": [2, 7], "order_by": [dot("id")]})] == [4] and s.execute({"function": "rooms_of"}) == []
    got = s.execute({"relation": "hotel", "join": {"r": {"relation": "room", "on": {"hotel_id": "id"}}}, "order_by": [dot("id")], "limit": 1, "select": {
        "all": ["agg", "spread", [dot("r", "price")]], "some": ["agg", "spread", [dot("r", "price")], {"filter": ["<", dot("r", "price"), 90]}], "two": ["agg", "dot_product", [dot("r", "id"), dot("r", "hotel_id")]],
        "mid": ["agg", "percentile_cont", [dot("r", "id"), 0.5]], "at": ["agg", "percentile_disc", [dot("r", "id"), 0.5]]}})
    assert got == [{"all": Decimal("19.5"), "at": 2, "mid": 2, "some": 0, "two": 6}]
    for bad in (["agg", "spread", [dot("r", "id")], {"distinct": True}], ["agg", "spread", [dot("r", "id"), dot("r", "id")]], ["agg", "nothing", [dot("r", "id")]]):
        with pytest.raises(QueryError):
            s.execute({"relation": "hotel", "join": {"r": {"relation": "room", "on": {"hotel_id": "id"}}}, "select": bad})


def test_joins_need_an_index_that_begins_with_their_columns(spark):
    def linked(indexes, on):
        base = frame([(1, 1, 1)], "a int, b int, c int")
        c = Catalog([Relation("up", base, ("a", "b"), {"whole": ("a", "b", "c"), "one": ("a",)}), Relation("down", base, ("c", "a"), indexes=indexes, foreign_keys=(ForeignKey(("a", "b"), "up", ("a", "b")), ForeignKey(("a",), "up", ("a",))))])
        return Session(spark, c).execute({"relation": "up", "join": {"d": {"relation": "down", "on": {k: k for k in on}}}, "select": ["agg", "count", [dot("d")]]})
    assert linked(None, "a") == linked((("b", "a"),), "ab") == linked((("a", "b", "c"),), "ab") == linked((("a", "c"),), "a") == [1]
    for indexes, on in (((), "a"), ((("b", "a"),), "a"), ((("a",),), "ab"), ((("a", "c", "b"),), "ab")):
        with pytest.raises(QueryError) as e:
            linked(indexes, on)
        assert e.value.code == "JOIN_MISSING_INDEX"


def test_denied_functions(s, spark):
    for q in ({"relation": "hotel", "select": call("pg_sleep", 1)}, {"relation": "hotel", "select": call({"schema": "pg_catalog", "name": "set_config"}, "a", "b", True)}):
        with pytest.raises(QueryError) as e:
            s.execute(q)
        assert "not allowed" in e.value.message


def test_responses_in_pieces(s):
    import json

    q = [{"relation": "hotel", "select": dot("name"), "order_by": [dot("id")]}, {"query": {"relation": "chain"}, "data": [{"id": 2, "name": "Two"}], "stats": True}, {"function": "twice", "arguments": [4]}, {"query": {"relation": "chain"}, "count": True, "returns": "none"}]
    pieces = s.respond(q)
    first = next(pieces)
    assert first == "["
    assert json.loads(first + "".join(pieces)) == [["Grand", "Inn", "Hut"], {"stats": [{"path": [], "table": "main.chain", "submitted": 1, "inserted": 1, "updated": 0, "deleted": 0}], "result": [{"id": 2, "name": "Two"}]}, 8, {"count": 2, "offset": 0}]
    # one that is not taken to its end, or fails late, has written nothing
    half = s.respond([{"query": {"relation": "chain", "write_mode": "delete", "where": True}}, {"relation": "chain"}])
    next(half), next(half)
    half.close()
    with pytest.raises(QueryError):
        list(s.respond([{"query": {"relation": "chain", "write_mode": "delete", "where": True}}, {"relation": "room", "select": ["/", 1, ["-", dot("id"), dot("id")]]}]))
    assert len(s.execute({"relation": "chain"})) == 2


def test_many_writes_do_not_deepen_a_plan(s, spark, tmp_path):
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    for i in range(40):
        s.execute({"query": {"relation": "chain", "write_mode": "upsert"}, "data": [{"id": i, "name": str(i)}], "returns": "none", "stats": True})
    assert len(s.table(s.catalog.relation("chain"))._jdf.queryExecution().optimizedPlan().toString().splitlines()) < 200 and s.count({"relation": "chain"}) == 40


def test_frames_as_payload(s, spark):
    new = spark.range(10, 2010).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("c"), "id").alias("name"), F.lit(1).alias("unknown"))
    got = s.execute({"query": {"relation": "chain"}, "data": new, "stats": True, "returns": "none"})
    assert got["stats"][0]["inserted"] == 2000 and s.count({"relation": "chain"}) == 2001
    both = spark.createDataFrame([(1, "one"), (11, "eleven"), (5000, "new")], "id int, name string")
    got = s.execute({"query": {"relation": "chain", "write_mode": "upsert"}, "data": both, "stats": True})
    assert sorted(r["name"] for r in got["result"]) == ["eleven", "new", "one"] and (got["stats"][0]["inserted"], got["stats"][0]["updated"]) == (1, 2) and s.count({"relation": "chain"}) == 2002
    got = s.execute({"query": {"relation": "chain", "write_mode": "update-existing"}, "data": both.withColumn("id", F.col("id") * 11), "stats": True})
    assert sorted(r["id"] for r in got["result"]) == [11, 121] and got["stats"][0]["updated"] == 2 and s.count({"relation": "chain"}) == 2002
    # numbers, defaults and the columns left out
    rooms = spark.createDataFrame([("X1", "1.25"), ("X2", None)], "code string, price string")
    s.execute({"query": {"relation": "room", "select": {"code": dot("code"), "price": dot("price")}}, "data": rooms, "returns": "none", "stats": True})
    got = s.execute({"relation": "room", "where": ["like", dot("code"), "X%"], "select": ["*~"], "order_by": [dot("code")]})
    assert [(r["code"], r["price"], r["hotel_id"]) for r in got] == [("X1", Decimal("1.25"), None), ("X2", None, None)] and len({r["id"] for r in got} | {1, 2, 3, 4}) == 6
    hotel = spark.createDataFrame([("H",)], "name string")
    assert s.execute({"query": {"relation": "hotel", "select": {"name": dot("name"), "stars": dot("stars")}}, "data": hotel}) == [{"name": "H", "stars": 2}]


@pytest.mark.parametrize(("q", "rows", "code"), [
    ({"relation": "chain"}, "select 1 as id, 'x' as name", "PG_UNIQUE_VIOLATION"), ({"relation": "chain"}, "select 5 as id, 'Blue' as name", "PG_UNIQUE_VIOLATION"), ({"relation": "chain"}, "values (5, 'a'), (5, 'b') t(id, name)", "PG_UNIQUE_VIOLATION"),
    ({"relation": "chain"}, "select null as id, 'x' as name", "PG_NOT_NULL_VIOLATION"), ({"relation": "chain"}, "select 'x' as id, 'x' as name", "TRANSACTION_ERROR"), ({"relation": "chain", "write_mode": "upsert"}, "select 'x' as name", "WRITE_FORBIDDEN"),
    ({"relation": "chain", "write_mode": "upsert"}, "select 9 as id, 'Blue' as name", "PG_UNIQUE_VIOLATION"), ({"relation": "hotel", "join": ROOM_JOIN}, "select 9 as id, 'x' as name, array('r') as rooms", "WRITE_FORBIDDEN"),
])
def test_frames_are_refused(s, spark, q, rows, code):
    with pytest.raises(QueryError) as e:
        s.execute({"query": q, "data": spark.sql(rows if rows.startswith("select") else "select * from " + rows)})
    assert e.value.code == code and s.count({"relation": "chain"}) == 1


def test_json_edits_need_no_package_in_workers():
    import subprocess
    import sys

    from pyspark import cloudpickle
    from trellis.functions import jsons

    made = [jsons.holding({"a": [1]}), jsons.held_by([1, 2]), jsons.without_all(["a"]), jsons.placed(["a", "b"], True, False), jsons.merged, jsons.stripped, jsons.holds]
    code = "import sys; from pyspark import cloudpickle; f = cloudpickle.loads(sys.stdin.buffer.read()); print(f[0]({'a': [1, 2]}), f[1]([2]), f[2]({'a': 1}), f[3]({'a': {}}, 5), f[4]([1], 2), f[5]({'a': None}), f[6](1, 1), 'trellis' in sys.modules)"
    out = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(made), cwd="/", env={"PATH": "/usr/bin:/bin"}, capture_output=True, check=True)
    assert out.stdout.decode().strip() == "True True {} {'a': {'b': 5}} [1, 2] {} True False"
