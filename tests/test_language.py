import datetime as dt

import pytest

from siltlog.acl import ACL, Permission
from siltlog.errors import BadRequest, ContractError, QueryExecutionError, QuerySyntaxError
from siltlog.functions.evid import EVID_MAX, EVID_MIN, Evid
from siltlog.functions.fieldtypes import parse_int
from siltlog.plans.ast import All, And, Not, Or, Term
from siltlog.plans.parser import parse_query, parse_tail
from siltlog.settings import Settings
from siltlog.sources.syslog import selected
from siltlog.stats import Stats
from siltlog.streaming.contracts import Assertion, Contract, chain
from siltlog.streaming.routes import routes_of

NOW = dt.datetime(2020, 1, 10)


def bare(v):
    return Term(None, None, None, v)


@pytest.mark.parametrize(
    "text,node",
    [
        ("foo", bare("foo")),
        ("'foo bar'", bare("foo bar")),
        ('"AND"', bare("AND")),
        ("a.b/c:d|e", bare("a.b/c:d|e")),
        ("ALL", All()),
        ("ALLOW", bare("ALLOW")),
        ("ORDER AND NOTE", And((bare("ORDER"), bare("NOTE")))),
        ("f1=v", Term("f1", None, None, "v")),
        ("f1 = 'a b'", Term("f1", None, None, "a b")),
        ("f1=gt(5)", Term("f1", None, "gt", "5")),
        (r"f1=text:in(a \) b)", Term("f1", "text", "in", "a ) b")),
        ("a AND b OR NOT c", Or((And((bare("a"), bare("b"))), Not(bare("c"))))),
        ("a OR b AND c", Or((bare("a"), And((bare("b"), bare("c")))))),
        ("NOT (a OR b) AND c", And((Not(Or((bare("a"), bare("b")))), bare("c")))),
        ("a AND b AND c", And((And((bare("a"), bare("b"))), bare("c")))),
    ],
)
def test_terms(text, node):
    assert parse_tail(text) == node
    got, period = parse_query(text, NOW)
    assert got == node and period.end - period.start == dt.timedelta(hours=1)


@pytest.mark.parametrize("text", ["", "a b", "a AND", "(a", "a-b", "f1=", "NOT", "ALL AND a", "a WHERE", "a WHERE DATE", "a WHERE DATE FROM 2000/13/1", "a WHERE DATE FROM 1 MONTH AGO", "a WHERE DATE FROM 01 DAY AGO", "f1=gt(5"])
def test_syntax_errors(text):
    with pytest.raises(QuerySyntaxError):
        parse_query(text, NOW)


def test_error_place():
    with pytest.raises(QuerySyntaxError) as e:
        parse_tail("foo\nAND bar baz")
    assert (e.value.line, e.value.column, e.value.remaining) == (2, 9, "baz")


def test_dates():
    p = parse_query("ALL WHERE DATE FROM 2000/1/1T12:00:00 EXCLUSIVE TO 1 DAY AGO EXCLUSIVE", NOW)[1]
    assert p.bounds() == (dt.datetime(2000, 1, 1, 12, 0, 1), dt.datetime(2020, 1, 9))
    p = parse_query("ALL WHERE DATE TO 2000/1/2", NOW)[1]
    assert p.bounds() == (None, dt.datetime(2000, 1, 2, 0, 0, 1)) and p.contains_second(0)
    p = parse_query("ALL WHERE DATE FROM 2 WEEKS AGO", NOW)[1]
    assert p.start == NOW - dt.timedelta(days=14) and p.end == NOW
    for unit in ("SECOND", "SECONDS", "MINUTE", "MINUTES", "HOUR", "HOURS", "DAY", "DAYS", "WEEK", "WEEKS"):
        parse_query(f"ALL WHERE DATE FROM 1 {unit} AGO", NOW)


def test_numbers():
    assert [parse_int(x) for x in ("10", "0x1f", "017", "0", "-5")] == [10, 31, 15, 0, -5]
    for bad in ("x", "08", "9223372036854775808", ""):
        with pytest.raises(QueryExecutionError):
            parse_int(bad)


def test_evid():
    assert Evid(1, 2**64 - 1) + 1 == Evid(2, 0) and Evid(2, 0) - 1 == Evid(1, 2**64 - 1)
    assert str(Evid.parse("5:7")) == "5:7" and EVID_MIN < Evid(0, 1) < Evid(1, 0) < EVID_MAX
    for f in (lambda: EVID_MIN - 1, lambda: EVID_MAX + 1, lambda: Evid.parse("x")):
        with pytest.raises(ValueError):
            f()


def test_acl():
    acl = ACL("-RPC::TAIL;index=secret", "RPC")
    assert acl.test("RPC::TAIL", index="secret") == Permission.DENY
    assert acl.test("rpc::tail", index="open") == Permission.ALLOW
    assert acl.test("ADMIN") == Permission.PASS and ACL("RPC::ITER").test("RPC") == Permission.PASS
    assert ACL("RPC;index=a,index=b").test("RPC", index="c") == Permission.PASS
    assert ACL("RPC;index=").test("RPC", index="c") == Permission.ALLOW
    with pytest.raises(ValueError):
        ACL("A::-")


def test_selectors():
    assert selected("kern.err") == {0, 1, 2, 3} and selected("kern.=err") == {3}
    assert selected("mail.*;mail.!err") == {20, 21, 22, 23} and selected("mail.*;mail.!=err") == set(range(16, 24)) - {19}
    assert selected("*.*;*.none") == set() and len(selected("*.emerg")) == 24
    assert selected("auth.=info") == {4 * 8 + 6, 13 * 8 + 6, 14 * 8 + 6}
    for bad in ("x.err", "kern.x", "kern"):
        with pytest.raises(BadRequest):
            selected(bad)


def test_contracts():
    c = Contract(Assertion("test", "text"))
    assert len(c) == 4
    c.sign()
    for f in (c.sign, lambda: c.add(Assertion("more", "int"))):
        with pytest.raises(ContractError):
            f()
    needs = Contract(Assertion("test", "text", expects=True), sign=True)
    assert len(chain([c, needs])) == 4
    for bad in ([needs], [Contract(Assertion("test", "int"), sign=True), needs]):
        with pytest.raises(ContractError):
            chain(bad)
    with pytest.raises(ValueError):
        Contract(Assertion("__x", "int"))


def test_routes_from_settings(caplog):
    s = Settings("[filter:web]\ntype=apache_common\n[filter:num]\ntype=regex\npattern=(?P<number>\\d+)\n[route:a]\ninput=i\nfilter=web | num\noutput=o, p\n[route:bad]\ninput=i\nfilter=nosuch\noutput=o\n")
    routes = routes_of(s)
    assert list(routes) == ["a"] and routes["a"][2] == ["o", "p"] and "bad" in caplog.text
    assert routes["a"][1].types()["status"] == "int"


def test_settings():
    s = Settings("[x]\na=1\nb=yes\nc=1.5\nd=p, q\n", {"x": {"a": "2"}}).section("x")
    assert s.integer("a") == 2 and s.flag("b") and s.number("c") == 1.5 and s.items("d") == ["p", "q"] and s.text("e", "z") == "z"


def test_stats(tmp_path):
    st = Stats(str(tmp_path / "s"))
    st.add("rpc.iter.calls")
    st.set("kept.it", 2.5, persistent=True)
    assert st.show("rpc", recursive=True) == [("rpc.iter.calls", 1)] and st.show("rpc") == []
    st.save()
    assert Stats(str(tmp_path / "s")).values == {"kept.it": 2.5}
