import pytest
from trellis.errors import QueryError
from trellis.plans import syntax
from trellis.plans.syntax import Expr, expression, lit
from trellis.sources import cbor, querystring


def test_atoms_are_literals():
    assert expression("x") == lit("x")
    assert expression(1) == lit(1) and expression(None) == lit(None) and expression(True) == lit(True)
    assert expression(1) != expression(True)


def test_folds():
    a, b = Expr(".", ("a",)), Expr(".", ("b",))
    assert expression(["add", [".", "a"], [".", "b"]]) == Expr("+", (a, b))
    assert expression(["and", [".", "a"]]) == a
    assert expression(["<", 1, [".", "a"], 3]) == Expr("and", (Expr("<", (lit(1), a)), Expr("<", (a, lit(3)))))


def test_minus_and_tilde_go_by_operands():
    assert expression(["-", 1]).op == "neg" and expression(["-", 1, 2]).op == "-"
    assert expression(["~", 1]).op == "bnot" and expression(["~", "a", "b"]).op == "match"


def test_star_forms():
    assert expression(["*"]) == Expr("star", (True, (), ()))
    assert expression(["*~", ["a"], {"b": 1}]) == Expr("star", (False, ("a",), (("b", lit(1)),)))
    assert expression(["*", [".", "a"], 2]).op == "*"


def test_agg_options():
    e = expression(["agg", "count", [[".", "x", "id"]], {"distinct": True, "filter": ["=", 1, 1]}])
    assert e.args[1] == "count" and e.args[4] is True and e.args[3] is not None
    with pytest.raises(QueryError):
        expression(["agg", "count", [1], {"nothing": 1}])


@pytest.mark.parametrize("bad", [[], [1], ["nothing", 1], ["?:", 1, 2], ["::", 1, "in t;"], ["between", 1, 2], ["bigint", "1.5"], ["col", 1]])
def test_refused_expressions(bad):
    with pytest.raises(QueryError):
        expression(bad)


@pytest.mark.parametrize("bad", [{}, {"relation": ""}, {"relation": "a", "function": "b"}, {"relation": "a", "limit": "1"}, {"relation": "a", "limit": True}, {"relation": "a", "order_by": [1]}, {"relation": "a", "write_mode": "x"}])
def test_refused_requests(bad):
    with pytest.raises(QueryError):
        syntax.request(bad)


@pytest.mark.parametrize(("flags", "code"), [
    ({"returns": "all"}, "QUERY_INVALID_RETURNS"), ({"returns": "none"}, "QUERY_UNSUPPORTED_RETURNS"), ({"count": True, "data": []}, "QUERY_COUNT_IS_READ_ONLY"),
    ({"stats": True}, "QUERY_STATS_IS_WRITE_ONLY"), ({"stats": True, "query_plan": True, "data": []}, "QUERY_STATS_QUERY_PLAN_CONFLICT"),
])
def test_flags(flags, code):
    with pytest.raises(QueryError) as e:
        syntax.items({"query": {"relation": "a"}, **flags})
    assert e.value.code == code


def test_malformed_json():
    with pytest.raises(QueryError) as e:
        syntax.items("{")
    assert e.value.code == "QUERY_MALFORMED_JSON"


def test_query_string():
    got = querystring.decode("relation=p&where=and(gte(stars,4),eq(name,'it''s, (x)'))&select=id,total:agg(sum,pay.amount)&order_by=-stars,name&limit=3&join.r.relation=rooms&join.r.on.pid=id&distinct_on=id")
    assert got == {
        "relation": "p", "where": ["and", ["gte", [".", "stars"], 4], ["eq", [".", "name"], "it's, (x)"]], "select": {"id": [".", "id"], "total": ["agg", "sum", [[".", "pay", "amount"]]]},
        "order_by": [["desc", [".", "stars"]], [".", "name"]], "limit": 3, "join": {"r": {"relation": "rooms", "on": {"pid": "id"}}}, "distinct_on": [[".", "id"]]}
    assert querystring.decode("relation=p&select=*~(a,b; c:neg(a))")["select"] == ["*~", ["a", "b"], {"c": ["neg", [".", "a"]]}]
    assert querystring.decode("relation=p&select=*(;c:a.b)")["select"] == ["*", {"c": [".", "a", "b"]}]
    assert querystring.decode("wellknown=q&params.n=4&params.s=x") == {"wellknown": "q", "params": {"n": 4, "s": "x"}}


@pytest.mark.parametrize("bad", ["relation=p&write_mode=insert", "relation=p&join.x.insert_columns=a", "relation=p&where=nothing(a)", "relation=p&where=eq(a", "relation=p&select=eq(a,1)", "relation=p&limit=x", "relation=p&zzz=1", "query=1"])
def test_refused_query_strings(bad):
    with pytest.raises(QueryError):
        querystring.decode(bad)


def test_cbor_round_trip():
    from decimal import Decimal

    v = {"a": [1, -5, 2**40, 2**70, -(2**70), 1.5, "é", b"\x00", None, True, Decimal("1.50"), Decimal("-3E+2")], "b": {}}
    back = cbor.loads(cbor.dumps(v))
    assert back == v and str(back["a"][10]) == "1.50"
    data = cbor.dumps(v)
    for n in range(len(data)):
        with pytest.raises(QueryError):
            cbor.loads(data[:n])
    assert cbor.loads(b"\x9f\x01\x7f\x61a\x61b\xff\xff") == [1, "ab"]
    assert cbor.loads(b"\xf9\x3c\x00") == 1.0


def test_cbor_structures():
    from trellis.streaming.rows import cbor_chunks

    rows = [{"id": i, "kids": [{"id": j, "kids": []} for j in range(2)], "one": {"a": i}} for i in range(3)]
    data = b"".join(cbor_chunks(rows, structures=True))
    assert cbor.loads(data) == rows and data.count(b"kids") == 2 < b"".join(cbor_chunks(rows)).count(b"kids")
    for bad in (b"\xd9\xe0\x00\x80", b"\xd9\xdf\xff\x83\x19\xe0\x00\x82aaaa\x01", b"\xd9\xdf\xff\x81\x19\xe0\x00"):
        with pytest.raises(QueryError):
            cbor.loads(bad)
