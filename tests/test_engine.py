import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from siltlog.acl import ACL
from siltlog.engine import Engine
from siltlog.errors import BadRequest, NotAuthorized, QueryExecutionError
from siltlog.operators import filters
from siltlog.plans.ast import All, And, Not, Or, Term
from siltlog.plans.catalog import Catalog, Index
from siltlog.plans.compiler import compile_query
from siltlog.queries import ORACLES, QUERIES
from siltlog.sources.files import TailReader, collect, landing_folder, load_csv, save_csv
from siltlog.sources.store import Store, forward
from siltlog.streaming.routes import Route
from siltlog.streaming.tail import start, tail_stream

DAY = dt.datetime(2012, 1, 1, 12)
PERIOD = " WHERE DATE FROM 2012/1/1T12:00:01 TO 2012/1/1T12:00:10"
COLUMNS = "ts timestamp_ntz, evid_offset long, input string, hostname string, message string, number long, kind string"


def rows(n=10):
    return [(DAY + dt.timedelta(seconds=i), i, "in", "host", f"test{i} Été", None if i % 3 == 0 else i, "Odd" if i % 2 else "") for i in range(1, n + 1)]


@pytest.fixture(scope="module")
def index(spark):
    return Index("a", spark.createDataFrame(rows(), COLUMNS), {("number", "int"): "number", ("kind", "literal"): "kind", ("kind", "text"): "kind"})


def offsets(result):
    return [r.evid.offset for r in result.data.collect()]


def test_every(spark, index):
    e = Engine(spark, Catalog(index))
    assert offsets(e.iter_events("ALL" + PERIOD)) == list(range(1, 11))
    assert offsets(e.iter_events("ALL" + PERIOD, reverse=True)) == list(range(10, 0, -1))
    assert offsets(e.iter_events("ALL" + PERIOD, limit=3, last=f"{1325419203}:3")) == [4, 5, 6]
    assert offsets(e.iter_events("ALL", now=DAY + dt.timedelta(minutes=1))) == list(range(1, 11))
    assert e.iter_events("test3" + PERIOD).meta["fields"] == ["hostname", "input", "kind"]
    assert e.iter_events("ALL" + PERIOD, fields=["number"]).data.first().fields == {"number": "1"}


def test_errors(spark, index):
    e = Engine(spark, Catalog(index))
    for q, kw, err in [("message=text:is(foo)", {}, QueryExecutionError), ("number=x", {}, QueryExecutionError), ("ALL", {"limit": 0}, BadRequest), ("ALL", {"indices": ["b"]}, BadRequest), ("ALL" + PERIOD, {"last": "5:5"}, BadRequest), ("ALL" + PERIOD, {"last": "x"}, BadRequest)]:
        with pytest.raises(err):
            e.iter_events(q, **kw)
    closed = Engine(spark, Catalog(index), ACL("RPC::ITER;index=b"))
    with pytest.raises(NotAuthorized):
        closed.iter_events("ALL")
    assert Engine(spark, Catalog(index), ACL("RPC")).list_indices() == ["a"]


def test_random_trees(spark, index):
    """Any boolean tree gives what set algebra gives."""
    rng = random.Random(1)
    leaves = {Term(None, None, None, "test3"): {3}, Term("number", None, "gt", "4"): {5, 7, 8, 10}, Term("kind", "literal", "is", "Odd"): {1, 3, 5, 7, 9}, Term("kind", None, None, "odd"): {1, 3, 5, 7, 9}, Term("message", None, None, "TEST1 été"): {1}, All(): set(range(1, 11))}

    def make(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(list(leaves.items()))
        if rng.random() < 0.25:
            n, s = make(depth - 1)
            return Not(n), set(range(1, 11)) - s
        (a, x), (b, y) = make(depth - 1), make(depth - 1)
        return (And((a, b)), x & y) if rng.random() < 0.5 else (Or((a, b)), x | y)

    made = [make(4) for _ in range(40)]
    flags = index.df.select("evid_offset", *(compile_query(n, index).alias(f"q{i}") for i, (n, _) in enumerate(made))).collect()
    for i, (n, want) in enumerate(made):
        assert {r.evid_offset for r in flags if r[f"q{i}"]} == want, n


def test_pushdown(spark):
    from siltlog import queries

    e = queries.engine(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = e.iter_events("event_type=error WHERE DATE FROM 2024/1/5 TO 2024/1/10").data._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-05" in plan and "EqualTo(event_type,error)" in plan and "TakeOrderedAndProject" in plan


def test_tail(spark, index, tmp_path):
    e = Engine(spark, Catalog(index))
    cursor, nothing = e.tail_events("ALL")
    assert cursor == "1325419210:10" and nothing is None
    cursor, got = e.tail_events("number=gt(4)", last="1325419205:5")
    assert offsets(got) == [7, 8, 10] and cursor == "1325419210:10"
    landing, seen = str(tmp_path / "in"), []
    index.df.write.parquet(landing)
    live = spark.readStream.schema(index.df.schema).parquet(landing)
    q = start(tail_stream("kind=literal:is(Odd)", index, live), lambda df, _: seen.extend(r.evid_offset for r in df.collect()), str(tmp_path / "cp"), 1)
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [1, 3, 5, 7, 9]


LINE = '10.0.0.1 - bob [10/Oct/2000:13:55:36 -0700] "GET /a.gif HTTP/1.0" 200 2326'


def lines(spark, *texts):
    return spark.createDataFrame([(None, "log", "here", t) for t in texts], "ts timestamp_ntz, input string, hostname string, message string")


def test_route_to_store_and_back(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text(LINE + "\n\nnonsense\n" + LINE.replace("bob", "anna") + "\n")
    route = Route("web", [filters.apache_common(), filters.dt_expander()])
    store = Store(spark, str(tmp_path / "store"), "web")
    for _ in range(2):  # the second query finds nothing new
        q = route.store(landing_folder(spark, str(folder), "web", "h1"), store, checkpoint=str(tmp_path / "cp"), rejects=str(tmp_path / "bad"), availableNow=True)
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "bad")).select("message").collect()[0].message == "nonsense"
    e = Engine(spark, Catalog(store.index()))
    got = e.iter_events("remoteuser=bob AND status=ge(200) AND remotehost='10.0.0.1' WHERE DATE FROM 2000/10/10 TO 2000/10/11").data.collect()
    assert len(got) == 1 and got[0].fields["dt_weekday"] == "1" and got[0].evid.ts == 971211336
    assert e.show_index("web")["index_size"] == 2
    plan = e.iter_events("GET WHERE DATE FROM 2000/10/10 TO 2000/10/11").data._jdf.queryExecution().executedPlan().toString()
    assert "message__tokens" in plan


def test_store_batches(spark, index, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "s", rotation=5, retention=2)
    types = {"number": "int", "kind": "literal"}
    store.append(index.df.filter("evid_offset <= 5"), types, numbered=True)
    store.append(index.df.filter("evid_offset <= 5"), types, numbered=True)
    assert store.index().df.count() == 5  # the same ids again are left out
    store.append(index.df.filter("evid_offset > 5"), {"kind": "text"}, numbered=True)
    assert store.fields() == {("number", "int"): "number", ("kind", "literal"): "kind", ("kind", "text"): "kind__text"}
    assert len(store.segments()) == 2 and store.index().df.agg(F.max("evid_offset")).first()[0] == 10
    assert forward(index.df, str(tmp_path / "peer")) is None and spark.read.parquet(str(tmp_path / "peer")).count() == 10


def test_csv(spark, index, tmp_path):
    r = Engine(spark, Catalog(index)).iter_events("ALL" + PERIOD)
    save_csv(r.data, str(tmp_path / "c"), r.field_names())
    back = load_csv(spark, str(tmp_path / "c"))
    key = lambda x: x.evid.offset
    assert sorted(back.collect(), key=key) == sorted(r.data.collect(), key=key)


def test_filters(spark):
    def run(f, *texts):
        return filters.accepted(f.apply(lines(spark, *texts))).collect()

    r = run(filters.apache_combined(), LINE + ' "http://x/" "Mozilla/4.08"')[0]
    assert (r.ts, r.referrer, r.useragent, r.byteswritten) == (dt.datetime(2000, 10, 10, 20, 55, 36), "http://x/", "Mozilla/4.08", 2326)
    assert run(filters.apache_common(), LINE[:-4] + "-") == []
    got = run(filters.syslog(year=2011), "Oct 10 13:55:36 web1 sshd[42]: Accepted key", "Oct  1 13:55:36 web1 kernel: up", "bad", "Oct 99 13:55:36 w k: x")
    assert [(r.ts.day, r.hostname, r.syslog_tag, r.syslog_pid, r.message) for r in got] == [(10, "web1", "sshd", 42, "Accepted key"), (1, "web1", "kernel", None, "up")]
    r = run(filters.syslog_packet("auth.*", 2003), "<34>Oct 11 22:14:15 mymachine su[7]: failed", "<8>Oct 11 22:14:15 m su: x", "<034>Oct 11 22:14:15 m su: x", "<34>1 2003-10-11T22:14:15Z m")
    assert [(x.syslog_facility, x.syslog_severity, x.syslog_pid) for x in r] == [("4", "2", 7)]
    got = run(filters.mysql_server(), "001010 13:55:36 InnoDB: started", "plain line")
    assert [(r.ts, r.message) for r in got] == [(dt.datetime(2000, 10, 10, 13, 55, 36), "InnoDB: started"), (None, "plain line")]
    got = run(filters.nagios(), "[1325419200] HOST ALERT: db1;DOWN;HARD;3;ping; lost", "[1325419200] SERVICE ALERT: db1;disk;CRITICAL;SOFT;1;95% full", "[1325419200] LOG ROTATION: DAILY", "[1325419200] Error: boom", "[x] Error: y", "[1325419200] HOST ALERT: db1;DOWN")
    assert [(r.nagios_host, r.nagios_service, r.nagios_status, r.nagios_state, r.nagios_attempt, r.message) for r in got] == [("db1", None, "DOWN", "HARD", 3, "ping; lost"), ("db1", "disk", "CRITICAL", "SOFT", 1, "95% full"), (None, None, None, None, None, "boom")]
    r = run(filters.regex(r"(?P<user>\w+)@(?P<host>\w+)"), "to me@there", "none")
    assert [(x.user, x.host) for x in r] == [("me", "there")]


def test_tail_reader(tmp_path):
    p = tmp_path / "f"
    p.write_text("old\n")
    reader = TailReader({"path": str(p), "maxLine": "20"})
    at = reader.initialOffset()

    def more(text=None, mode="a"):
        nonlocal at
        if text is not None:
            with open(p, mode) as f:
                f.write(text)
        got, at = reader.read(at)
        return [x for (x,) in got]

    assert more("hello world!\n\n  \npart") == ["hello world!"]
    assert more("ial\n") == ["partial"]
    assert more("x" * 30 + "\nok\n") == ["ok"]
    assert more("short\n", "w") == ["short"]
    p.rename(tmp_path / "g")
    with open(tmp_path / "g", "a") as f:
        f.write("last of old\n")
    p.write_text("new file\n")
    assert more() == ["last of old"] and more() == ["new file"] and more() == []
    time.sleep(0)


def test_registered_queries(spark):
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 70
    for name in ("phrase", "multi_index_union", "nagios", "retention_newest"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_lines_are_matched_once(spark):
    for name, most in [("apache_combined", 2), ("syslog_lines", 4), ("syslog_packets", 9), ("nagios", 0)]:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert sum(plan.lower().count(x) for x in ("regexp_", "rlike")) <= most and plan.count("split(") <= 1, name


def test_streams_share_a_store(spark, index, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "s", rotation=8)
    route = Route("lines", [])
    for name in "ab":
        folder = tmp_path / name
        folder.mkdir()
        (folder / "x.log").write_text("".join(f"{name} {i}\n" for i in range(4)))
        route.store(landing_folder(spark, str(folder), name, "h"), store, checkpoint=str(tmp_path / f"cp-{name}"), availableNow=True).awaitTermination()
    assert store.index().df.count() == 8
    # a new checkpoint begins again at batch 0 and replaces nothing
    route.store(landing_folder(spark, str(tmp_path / "a"), "a", "h"), store, checkpoint=str(tmp_path / "cp-a2"), availableNow=True).awaitTermination()
    df = store.index().df
    assert df.count() == 12 and df.select("evid_offset").distinct().count() == 12
    assert store.segments() == [0, 1] and store.head()["count"] == 4
    # a batch that is tried again replaces itself, whatever came between
    three = index.df.filter("evid_offset <= 3").select("ts", "input", "hostname", "message")
    for _ in range(2):
        store.append(three, stream="q", batch=0)
        store.append(three)
    df = store.index().df
    assert df.count() == 12 + 3 + 6 and df.select("evid_offset").distinct().count() == 21
    # numbered events are told apart by their ids
    for _ in range(2):
        store.append(index.df.select("ts", F.col("evid_offset") + 1000, "input", "hostname", "message").toDF("ts", "evid_offset", "input", "hostname", "message"), numbered=True)
    assert store.index().df.count() == 31 and store.head()["offset"] == 1010


def test_forward_tries_again(spark, index, tmp_path):
    from siltlog.stats import Stats

    stats, blocked = Stats(), tmp_path / "peer"
    blocked.write_text("a file where the folder should be")
    with pytest.raises(Exception):
        forward(index.df, str(blocked / "x"), tries=2, backoff=0.01, stats=stats)
    assert stats.get("forward.retries") == 2 and stats.get("forward.forwardedevents") == 0
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    index.df.write.parquet(src)
    live = spark.readStream.schema(index.df.schema).parquet(src)
    forward(live, out, str(tmp_path / "cp"), stats=stats, availableNow=True).awaitTermination()
    forward(live, out, str(tmp_path / "cp"), stats=stats, availableNow=True).awaitTermination()
    assert stats.get("forward.forwardedevents") == 10
    back = collect(spark, out, COLUMNS, stream=False)
    assert back.count() == 10 and sorted(back.columns) == sorted(index.df.columns)


def test_server(spark, tmp_path, capsys, caplog):
    from siltlog.__main__ import main
    from siltlog.errors import ConfigurationError
    from siltlog.settings import Settings
    from siltlog.streaming.server import Server

    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text(LINE + "\n\nnonsense\n" + LINE.replace("bob", "anna") + "\n")
    config = tmp_path / "server.ini"
    config.write_text(f"""
[server]
checkpoints = {tmp_path}/cp
statistics = {tmp_path}/stats.json
[input:weblogs]
type = folder
path = {logs}
files per batch = 10
[output:web]
type = store
path = {tmp_path}/web
rotation = 1000
[output:peer]
type = forward
path = {tmp_path}/peer
[route:main]
input = weblogs
filter = apache_common
output = web, peer
[route:broken]
input = nowhere
filter = apache_common
output = web
""")
    server = Server(spark, Settings.read(str(config)))
    assert list(server.routes) == ["main"] and "broken" in caplog.text
    for q in server.start(availableNow=True):
        q.awaitTermination()
    period = " WHERE DATE FROM 2000/10/10 TO 2000/10/11"
    assert len(server.engine().iter_events("status=ge(200)" + period).data.collect()) == 2
    assert server.stats.get("rpc.iter.calls") == 1 and server.stats.get("rpc.iter.time") > 0 and server.stats.get("output.peer.forwardedevents") == 2
    server.stats.set("kept", 5, persistent=True)
    server.stop()
    main(["search", "remoteuser=anna" + period, "--config", str(config)])
    main(["list-indices", "--store", f"web={tmp_path}/web"])
    main(["show-index", "web", "--store", f"web={tmp_path}/web"])
    main(["show-stats", "kept", "--config", str(config)])
    main(["flush-stats", "--all", "--config", str(config)])
    main(["show-stats", "--recursive", "--config", str(config)])
    said = capsys.readouterr().out
    assert "1 matches in" in said and "web\n" in said and "index_size: 2" in said and "kept: 5" in said and "kept: 0" in said
    with pytest.raises(ConfigurationError):
        Server(spark, Settings("[output:x]\ntype = nothing"))
    with pytest.raises(ConfigurationError):
        Server(spark, Settings("[output:x]\ntype = store\npath = /x\ncolour = red"))
