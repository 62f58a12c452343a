"""Queries of the engine over the sample tables, each over the whole of its tables, and SQL that says what they return."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, QueryResult
from .functions import text, times
from .functions.evid import Evid, beyond, evid_string, from_string
from .operators import filters, indexstats, paging, postfilter, postings, project, segments
from .plans.ast import And, Or, Term
from .plans.catalog import Catalog, Index
from .runtime import shared_folder
from .sources.files import collect, load_csv, save_csv
from .sources.store import Store, forward
from .sources.syslog import facility_name, selected, severity_name
from .streaming.contracts import Assertion, Contract
from .streaming.routes import Route

NOW = dt.datetime(2024, 2, 1)
ALWAYS = " WHERE DATE FROM 1990/1/1 TO 2100/1/1"


# --- indexes ------------------------------------------------------------------------------------------------------------------


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def events(spark: SparkSession, d: str) -> Index:
    e = _read(spark, d, "events")
    df = e.select(
        "ts", (F.col("event_id") + 1).alias("evid_offset"), F.lit("events").alias("input"), F.concat(F.lit("user-"), "user_id").alias("hostname"),
        F.concat_ws(" ", "event_type", "props").alias("message"), "event_type", "user_id", F.round(F.col("value") * 100).cast("long").alias("value_cents"),
    )
    return Index("events", df, {("event_type", "literal"): "event_type", ("user_id", "int"): "user_id", ("value_cents", "int"): "value_cents", ("happened", "datetime"): "ts"})


def documents(spark: SparkSession, d: str) -> Index:
    t = _read(spark, d, "documents")
    quality = _read(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("long").alias("quality"))
    df = t.join(quality, "doc_id", "left").select(
        F.expr("timestampadd(SECOND, doc_id, TIMESTAMP_NTZ '2024-01-01 00:00:00')").alias("ts"), (F.col("doc_id") + 1).alias("evid_offset"), F.lit("documents").alias("input"),
        F.col("source").alias("hostname"), F.col("text").alias("message"), "lang", "n_chars", "quality",
    )
    return Index("documents", df, {("lang", "literal"): "lang", ("n_chars", "int"): "n_chars", ("quality", "int"): "quality"})


def orders(spark: SparkSession, d: str) -> Index:
    df = _read(spark, d, "orders").select(
        F.col("o_orderdate").alias("ts"), (F.col("o_orderkey") + 1).alias("evid_offset"), F.lit("orders").alias("input"), F.lit("shop").alias("hostname"),
        F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("message"), F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority"),
    )
    return Index("orders", df, {("custkey", "int"): "custkey", ("priority", "text"): "priority"})


def chats(spark: SparkSession, d: str) -> Index:
    df = _read(spark, d, "conversations").select(
        F.expr("timestampadd(SECOND, conv_id, TIMESTAMP_NTZ '2024-01-01 00:00:00')").alias("ts"), (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("evid_offset"), F.lit("conversations").alias("input"), F.lit("chat").alias("hostname"),
        F.col("text").alias("message"), "role",
    )
    return Index("conversations", df, {("role", "literal"): "role", ("role", "text"): "role"})


def engine(spark: SparkSession, d: str, *makers) -> Engine:
    return Engine(spark, Catalog(*(m(spark, d) for m in makers or (events,))))


def flat(result: QueryResult | DataFrame, *fields: str) -> DataFrame:
    data = result.data if isinstance(result, QueryResult) else result
    return data.select(F.col("evid.ts").alias("ts_sec"), F.col("evid.offset").alias("evid_offset"), "default_value", *(F.col("fields")[f].alias(f) for f in fields))


_E = """e AS (SELECT ts, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS ts_sec, event_id + 1 AS evid_offset, 'events' AS input, 'user-' || user_id AS hostname,
  event_type || ' ' || props AS message, event_type, user_id, CAST(round(value * 100) AS BIGINT) AS value_cents FROM events)"""
_D = r"""d AS (SELECT 1704067200 + doc_id AS ts_sec, doc_id + 1 AS evid_offset, 'documents' AS input, source AS hostname, text AS message, lang, n_chars, quality,
  list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS toks
  FROM documents LEFT JOIN (SELECT doc_id, CAST(max(quality) AS BIGINT) AS quality FROM labels GROUP BY doc_id) USING (doc_id))"""
_C = """c AS (SELECT 1704067200 + conv_id AS ts_sec, conv_id * 1000 + turn + 1 AS evid_offset, 'conversations' AS input, 'chat' AS hostname, text AS message, role FROM conversations)"""
_O = """o AS (SELECT o_orderdate AS ts, CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT) AS ts_sec, o_orderkey + 1 AS evid_offset, o_orderstatus || ' ' || o_orderpriority AS message, o_custkey AS custkey, o_orderpriority AS priority FROM orders)"""
_WITH = {"e": _E, "d": _D, "c": _C, "o": _O}
_MAKERS = {"e": events, "d": documents, "c": chats, "o": orders}
_ROW = "ts_sec, evid_offset, message AS default_value"


def _has(*words: str) -> str:
    """SQL for a phrase or a single token."""
    return f"contains(' ' || array_to_string(toks, ' ') || ' ', ' {' '.join(words)} ')"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def search(name: str, table: str, ql: str, where: str, **options) -> None:
    """Register a search without a limit whose rows are those of ``table`` with ``where``."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return flat(engine(spark, d, _MAKERS[table]).iter_events(ql, limit=None, now=NOW, **options))

    QUERIES[name] = run
    ORACLES[name] = f"WITH {_WITH[table]} SELECT {_ROW} FROM {table} WHERE {where}"


# --- periods, predicates and their combinations -------------------------------------------------------------------------------

search("every_period", "e", "ALL WHERE DATE FROM 2024/1/5 TO 2024/1/10T12:00:00", "ts >= '2024-01-05' AND ts < TIMESTAMP '2024-01-10 12:00:01'")
search("every_period_exclusive", "e", "ALL WHERE DATE TO 2024/1/10T12:00:00 EXCLUSIVE FROM 2024/1/5 EXCLUSIVE", "ts >= TIMESTAMP '2024-01-05 00:00:01' AND ts < TIMESTAMP '2024-01-10 12:00:00'")
search("every_open_start", "e", "ALL WHERE DATE TO 2024/1/3", "ts < TIMESTAMP '2024-01-03 00:00:01'")
search("every_relative", "e", "ALL WHERE DATE FROM 2 WEEKS AGO TO 30 HOURS AGO", "ts >= TIMESTAMP '2024-01-18 00:00:00' AND ts < TIMESTAMP '2024-01-30 18:00:01'")
search("period_inverted", "e", "ALL WHERE DATE TO 2000/1/1 FROM 2010/1/1", "false")
search("literal_is", "e", "event_type=error" + ALWAYS, "event_type = 'error'")
search("literal_typed", "e", "event_type=literal:is(click)" + ALWAYS, "event_type = 'click'")
search("int_eq", "e", "user_id=10" + ALWAYS, "user_id = 10")
search("int_hex", "e", "user_id=is(0x1f)" + ALWAYS, "user_id = 31")
search("int_octal", "e", "user_id=is(017)" + ALWAYS, "user_id = 15")
search("int_gt", "e", "value_cents=gt(5000)" + ALWAYS, "value_cents > 5000")
search("int_gt_zero", "e", "user_id=gt(0)" + ALWAYS, "user_id > 0")
search("int_ge", "e", "value_cents=int:ge(5000)" + ALWAYS, "value_cents >= 5000")
search("int_lt", "e", "user_id=lt(20)" + ALWAYS, "user_id < 20")
search("int_le", "e", "user_id=le(20)" + ALWAYS, "user_id <= 20")
search("int_range", "e", "user_id=ge(20) AND user_id=lt(40)" + ALWAYS, "user_id >= 20 AND user_id < 40")
search("datetime_is", "e", "happened=is(2024/01/01T00:00:07)" + ALWAYS, "ts >= TIMESTAMP '2024-01-01 00:00:07' AND ts < TIMESTAMP '2024-01-01 00:00:08'")
search("term_default_field", "d", "license" + ALWAYS, "list_contains(toks, 'license')")
search("term_case_insensitive", "d", "message=LICENSE" + ALWAYS, "list_contains(toks, 'license')")
search("term_non_ascii", "d", "message=text:in(é)" + ALWAYS, "list_contains(toks, 'é')")
search("phrase", "d", '"in the"' + ALWAYS, _has("in", "the"))
search("phrase_long", "d", "message=in(under the MIT License.)" + ALWAYS, _has("under", "the", "mit", "license"))
search("bool_and", "d", "the AND of" + ALWAYS, "list_contains(toks, 'the') AND list_contains(toks, 'of')")
search("bool_or", "d", "license OR lang=es" + ALWAYS, "list_contains(toks, 'license') OR lang = 'es'")
search("bool_not", "d", "NOT lang=en" + ALWAYS, "lang <> 'en'")
search("bool_and_not", "d", "lang=en AND NOT the" + ALWAYS, "lang = 'en' AND NOT list_contains(toks, 'the')")
search("bool_or_not", "d", "lang=en OR NOT the" + ALWAYS, "lang = 'en' OR NOT list_contains(toks, 'the')")
search("bool_or_not_compat", "d", "lang=en OR NOT the" + ALWAYS, "lang = 'en' AND NOT list_contains(toks, 'the')", compat=True)
search("bool_nots_compat", "d", "NOT lang=en AND NOT the" + ALWAYS, "false", compat=True)
search("bool_nested", "d", "(lang=en OR lang=fr) AND NOT (the OR n_chars=gt(1000))" + ALWAYS, "lang IN ('en', 'fr') AND NOT (list_contains(toks, 'the') OR n_chars > 1000)")
search("bool_precedence", "d", "lang=de OR lang=en AND NOT the" + ALWAYS, "lang = 'de' OR (lang = 'en' AND NOT list_contains(toks, 'the'))")
search("unknown_field_dropped", "d", "lang=de AND nosuch=x" + ALWAYS, "lang = 'de'")
search("unknown_field_alone", "d", "nosuch=x" + ALWAYS, "false")
search("not_absent_field", "d", "NOT quality=1" + ALWAYS, "coalesce(quality = 1, false) = false")
search("several_types", "c", "role=USER" + ALWAYS, "role = 'USER' OR lower(role) = 'user'")
search("one_of_several_types", "c", "role=literal:is(USER)" + ALWAYS, "role = 'USER'")
search("text_field_phrase", "o", 'priority="1 urgent"' + ALWAYS, r"regexp_replace(lower(priority), '[^a-z0-9]+', ' ', 'g') = '1 urgent'")


# --- order, limits, pages, several indexes ------------------------------------------------------------------------------------


@query(f"WITH {_E} SELECT {_ROW} FROM e ORDER BY ts_sec DESC, evid_offset DESC LIMIT 100")
def every_reverse_limit(spark, d):
    return flat(engine(spark, d).iter_events("ALL" + ALWAYS, reverse=True))


@query(f"WITH {_E} SELECT {_ROW} FROM e WHERE event_type = 'error' ORDER BY ts_sec, evid_offset LIMIT 25")
def limit_first(spark, d):
    return flat(engine(spark, d).iter_events("event_type=error" + ALWAYS, limit=25))


@query(f"WITH {_E}, p AS (SELECT ts_sec, evid_offset FROM e WHERE evid_offset = 101) SELECT {_ROW} FROM e WHERE (ts_sec, evid_offset) > (SELECT (ts_sec, evid_offset) FROM p) ORDER BY ts_sec, evid_offset LIMIT 50")
def page_keyset(spark, d):
    e = engine(spark, d)
    first = e.catalog.indexes["events"]
    last = first.df.filter("evid_offset = 101").select(first.ts_sec()).first().ts_sec
    return flat(e.iter_events("ALL" + ALWAYS, last=f"{last}:101", limit=50))


@query(f"WITH {_E}, p AS (SELECT ts_sec, evid_offset FROM e WHERE evid_offset = 101) SELECT {_ROW} FROM e WHERE (ts_sec, evid_offset) < (SELECT (ts_sec, evid_offset) FROM p) ORDER BY ts_sec DESC, evid_offset DESC LIMIT 50")
def page_keyset_reverse(spark, d):
    e = engine(spark, d)
    first = e.catalog.indexes["events"]
    last = first.df.filter("evid_offset = 101").select(first.ts_sec()).first().ts_sec
    return flat(e.iter_events("ALL" + ALWAYS, last=Evid(last, 101), limit=50, reverse=True))


@query(f"WITH {_E} SELECT ts_sec, evid_offset, message FROM e ORDER BY ts_sec DESC, evid_offset DESC LIMIT 1000")
def scrollback_newest(spark, d):
    i = events(spark, d)
    return paging.scrollback(i.df.withColumn("ts_sec", i.ts_sec())).select("ts_sec", "evid_offset", "message")


_BOTH = f"""WITH {_E}, {_D}, u AS (SELECT 0 AS r, ts_sec, evid_offset, message, input FROM d UNION ALL SELECT 1, ts_sec, evid_offset, message, input FROM e),
 f AS (SELECT *, row_number() OVER (PARTITION BY ts_sec, evid_offset ORDER BY r) AS rn FROM u) SELECT ts_sec, evid_offset, message AS default_value, input FROM f WHERE rn = 1"""


@query(_BOTH)
def multi_index_union(spark, d):
    return flat(engine(spark, d, events, documents).iter_events("ALL" + ALWAYS, limit=None), "input")


@query(_BOTH + " ORDER BY ts_sec, evid_offset LIMIT 100")
def multi_index_limit(spark, d):
    return flat(engine(spark, d, events, documents).iter_events("ALL" + ALWAYS), "input")


@query(f"WITH {_E} SELECT {_ROW} FROM e WHERE event_type = 'view'")
def index_without_field(spark, d):
    """Documents lack the field, so that index gives nothing."""
    return flat(engine(spark, d, events, documents).iter_events("event_type=view" + ALWAYS, limit=None))


@query(f"WITH {_E} SELECT {_ROW} FROM e WHERE (ts_sec, evid_offset) > (SELECT (ts_sec, evid_offset) FROM e WHERE evid_offset = 501) AND event_type = 'click'")
def tail_after(spark, d):
    e = engine(spark, d)
    i = e.catalog.indexes["events"]
    last = i.df.filter("evid_offset = 501").select(i.ts_sec()).first().ts_sec
    return flat(e.tail_events("event_type=click", last=f"{last}:501", limit=None)[1])


@query(f"WITH {_E} SELECT max(ts_sec) || ':' || (SELECT max(evid_offset) FROM e WHERE ts_sec = (SELECT max(ts_sec) FROM e)) AS cursor FROM e")
def tail_cursor(spark, d):
    cursor, _ = engine(spark, d).tail_events("ALL")
    return spark.createDataFrame([(cursor,)], "cursor string")


# --- projection ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {_E} SELECT {_ROW}, event_type, NULL::VARCHAR AS hostname FROM e WHERE event_type = 'purchase'")
def project_fields(spark, d):
    return flat(engine(spark, d).iter_events("event_type=purchase" + ALWAYS, limit=None, fields=["event_type"]), "event_type", "hostname")


@query(f"WITH {_E} SELECT ts_sec, evid_offset, 'message' AS default_field, message AS default_value, hostname, CAST(user_id AS VARCHAR) AS user_id FROM e")
def split_events(spark, d):
    i = events(spark, d)
    s = project.split_event(i, i.df)
    return s.select("ts_sec", "evid_offset", "default_field", "default_value", F.col("fields")["hostname"].alias("hostname"), F.col("fields")["user_id"].alias("user_id"))


_NAMED = "UNPIVOT (SELECT hostname, input, lang, message, CAST(n_chars AS VARCHAR) AS n_chars, CAST(quality AS VARCHAR) AS quality FROM d) ON COLUMNS(*) INTO NAME field_name VALUE v"


@query(f"WITH {_D} SELECT DISTINCT field_name FROM ({_NAMED}) WHERE field_name <> 'message'")
def result_field_names(spark, d):
    return project.field_names(engine(spark, d, documents).iter_events("ALL" + ALWAYS, limit=None).data)


@query(f"WITH {_E} SELECT strftime(make_timestamp(ts_sec * 1000000) + INTERVAL 1 HOUR, '%d %b %Y %H:%M:%S') || ' Europe/Paris: ' || message || chr(10) || chr(9) || 'event_type=' || event_type || chr(10) || chr(9) || 'user_id=' || user_id AS line FROM e WHERE event_type = 'signup'")
def display_lines(spark, d):
    r = engine(spark, d).iter_events("event_type=signup" + ALWAYS, limit=None)
    return project.display(r.data, zone="Europe/Paris", wanted=["event_type", "user_id"])


@query(f"WITH {_D} SELECT evid_offset, 'hostname=' || hostname || ';lang=' || lang || ';n_chars=' || n_chars || CASE WHEN quality IS NULL THEN '' ELSE ';quality=' || quality END AS listed FROM d")
def expanded_fields(spark, d):
    i = documents(spark, d)
    s = project.split_event(i, i.df)
    entries = project.expanded(F.col("fields"), hidden=("input",))
    return s.select("evid_offset", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("listed"))


@query(f"WITH {_E} SELECT ts_sec || ':' || evid_offset AS id, ts_sec AS ts_back, evid_offset AS offset_back FROM e")
def evid_strings(spark, d):
    i = events(spark, d)
    ids = i.df.select(i.ts_sec(), "evid_offset").select(evid_string().alias("id"))
    return ids.select("id", from_string(F.col("id"))["ts"].alias("ts_back"), from_string(F.col("id"))["offset"].alias("offset_back"))


# --- filters on results -------------------------------------------------------------------------------------------------------


def _post(name: str, stack: postfilter.Stack, where: str) -> None:
    def run(spark, d):
        i = events(spark, d)
        return stack.apply(project.split_event(i, i.df)).select("ts_sec", "evid_offset", "default_value")

    QUERIES[name] = run
    ORACLES[name] = f"WITH {_E} SELECT {_ROW} FROM e WHERE {where}"


_S = postfilter.Stack()
_post("post_is", _S.push("event_type", "is", "error"), "event_type = 'error'")
_post("post_is_any", _S.push("*", "is", "user-7"), "hostname = 'user-7'")
_post("post_contains", _S.push("hostname", "contains", "-1"), "contains(hostname, '-1')")
_post("post_matches", _S.push("hostname", "matches", "-[13]$"), "regexp_matches(hostname, '-[13]$')")
_post("post_gt", _S.push("user_id", "gt", "140"), "user_id > 140")
_post("post_lt", _S.push("value_cents", "lt", "100.5"), "value_cents < 100.5")
_post("post_gt_uncastable", _S.push("hostname", "gt", "1"), "false")
_post("post_stack", _S.push("event_type", "is", "click").push("user_id", "lt", "50").push("*", "is", "nothing").pop(), "event_type = 'click' AND user_id < 50")


@query(f"WITH {_E} SELECT evid_offset, regexp_matches(message, 'err') OR regexp_matches(event_type, 'err') AS found FROM e")
def post_find(spark, d):
    i = events(spark, d)
    return postfilter.find(project.split_event(i, i.df), "err").select("evid_offset", "found")


# --- statistics and postings --------------------------------------------------------------------------------------------------


@query(f"WITH {_E}, m AS (SELECT max(ts_sec) AS t FROM e) SELECT count(*) AS index_size, max(ts_sec) AS last_ts, max(evid_offset) FILTER (ts_sec = (SELECT t FROM m)) AS last_offset, CAST(1 AS BIGINT) AS segments, count(*) AS current_segment_size FROM e")
def index_stats(spark, d):
    return indexstats.index_stats(events(spark, d)).drop("last_modified")


_DP = f"""{_D}, p AS (SELECT 'message' AS field, 'text' AS type, unnest(list_distinct(toks)) AS term, ts_sec, evid_offset FROM d
 UNION ALL SELECT 'lang', 'literal', lang, ts_sec, evid_offset FROM d UNION ALL SELECT 'quality', 'int', CAST(quality AS VARCHAR), ts_sec, evid_offset FROM d WHERE quality IS NOT NULL
 UNION ALL SELECT 'hostname', 'literal', hostname, ts_sec, evid_offset FROM d UNION ALL SELECT 'input', 'literal', input, ts_sec, evid_offset FROM d
 UNION ALL SELECT 'n_chars', 'int', CAST(n_chars AS VARCHAR), ts_sec, evid_offset FROM d)"""


def _postings(spark, d, positions: bool = False) -> DataFrame:
    return postings.build_postings(documents(spark, d), None, positions)


@query(f"WITH {_DP} SELECT field, type, count(*) AS n_postings FROM p GROUP BY ALL")
def field_doc_counts(spark, d):
    return postings.field_counts(_postings(spark, d))


@query(f"WITH {_DP} SELECT field, type, term, count(*) AS n_events FROM p GROUP BY ALL")
def term_doc_freq(spark, d):
    return postings.term_counts(_postings(spark, d))


@query(f"WITH {_DP} SELECT DISTINCT term FROM p WHERE field = 'message'")
def term_scan(spark, d):
    return postings.terms(_postings(spark, d), "message", "text")


@query(f"WITH {_D}, t AS (SELECT ts_sec, evid_offset, list_filter(range(0, len(toks)), lambda i: toks[i + 1] = 'license') AS ps FROM d) SELECT ts_sec, evid_offset, array_to_string(ps, ',') AS places FROM t WHERE len(ps) > 0")
def posting_lookup(spark, d):
    return postings.lookup(_postings(spark, d, True), "message", "text", "license").select("ts_sec", "evid_offset", F.array_join(F.transform("pos", lambda x: x.cast("string")), ",").alias("places"))


@query(f"WITH {_DP} SELECT DISTINCT ts_sec, evid_offset FROM p WHERE field = 'message' AND term > 'tha' AND term <= 'the'")
def posting_range(spark, d):
    return postings.lookup_range(_postings(spark, d), "message", "text", "tha", "the", low_exclusive=True)


@query(f"WITH {_D} SELECT ts_sec, evid_offset FROM d WHERE list_contains(toks, 'the') AND lang = 'en'")
def postings_intersect(spark, d):
    p = _postings(spark, d)
    return postings.intersect(postings.lookup(p, "message", "text", "the"), postings.lookup(p, "lang", "literal", "en")).select("ts_sec", "evid_offset")


@query(f"WITH {_D} SELECT ts_sec, evid_offset FROM d WHERE list_contains(toks, 'the') AND lang <> 'en'")
def postings_except(spark, d):
    p = _postings(spark, d)
    return postings.subtract(postings.lookup(p, "message", "text", "the"), postings.lookup(p, "lang", "literal", "en")).select("ts_sec", "evid_offset")


@query(f"WITH {_D} SELECT ts_sec, evid_offset FROM d WHERE list_contains(toks, 'license') OR lang = 'de'")
def postings_union(spark, d):
    p = _postings(spark, d)
    return postings.unite(postings.lookup(p, "message", "text", "license"), postings.lookup(p, "lang", "literal", "de"))


@query(f"WITH {_D} SELECT ts_sec, evid_offset, lang FROM d WHERE {_has('of', 'the')}")
def postings_phrase(spark, d):
    i = documents(spark, d)
    return postings.fetch(i.df.withColumn("ts_sec", i.ts_sec()), postings.phrase(_postings(spark, d, True), "message", ["of", "the"])).select("ts_sec", "evid_offset", "lang")


@query(f"WITH {_D} SELECT count_if(list_contains(toks, 'the')) AS term_size, least(count_if(list_contains(toks, 'the')), count_if(lang = 'en')) AS and_bound, count_if(list_contains(toks, 'the') OR lang = 'en') AS or_size FROM d")
def estimates(spark, d):
    i = documents(spark, d)
    the, en = Term(None, None, None, "the"), Term("lang", None, None, "en")
    return spark.createDataFrame([(indexstats.exact_size(the, i), indexstats.estimate(And((the, en)), i), indexstats.exact_size(Or((the, en)), i))], "term_size long, and_bound long, or_size long")


@query(f"WITH {_D} SELECT DISTINCT field_name, CASE WHEN field_name = 'message' THEN 'text' WHEN bool_and(TRY_CAST(v AS BIGINT) IS NOT NULL) THEN 'int' ELSE 'literal' END AS field_type FROM ({_NAMED}) GROUP BY field_name")
def field_list(spark, d):
    return indexstats.field_list(documents(spark, d))


@query(f"WITH {_DP} SELECT count(*) AS size FROM p WHERE field = 'message' AND term > 'tha' AND term <= 'the'")
def range_estimate(spark, d):
    return indexstats.range_estimate(postings.term_counts(_postings(spark, d)), "message", "text", "tha", "the", low_exclusive=True)


@query(f"WITH {_D} SELECT count(*) AS size FROM d WHERE n_chars >= 100 AND n_chars < 2000")
def range_estimate_int(spark, d):
    return indexstats.range_estimate(postings.term_counts(_postings(spark, d)), "n_chars", "int", 100, 2000, high_exclusive=True)


@query(f"WITH {_D} SELECT unnest(['hostname', 'input', 'lang', 'message', 'n_chars', 'quality']) AS field_name, unnest(['literal', 'literal', 'literal', 'text', 'int', 'int']) AS field_type, unnest([count(hostname), count(input), count(lang), count(message), count(n_chars), count(quality)]) AS n_events FROM d")
def field_presence(spark, d):
    return indexstats.field_presence(documents(spark, d))


@query(f"WITH {_E} SELECT evid_offset FROM e WHERE (ts_sec, evid_offset) = (SELECT (ts_sec, evid_offset) FROM e WHERE evid_offset = 77)")
def event_lookup(spark, d):
    i = events(spark, d)
    rows = i.df.select(i.ts_sec(), "evid_offset")
    at = rows.filter("evid_offset = 77").first()
    return rows.filter((F.col("ts_sec") == at.ts_sec) & (F.col("evid_offset") == at.evid_offset)).select("evid_offset")


@query(f"WITH {_E}, n AS (SELECT *, (row_number() OVER (ORDER BY ts_sec, evid_offset) - 1) // 3000 AS segment FROM e) SELECT evid_offset, CAST(segment AS BIGINT) AS segment FROM n WHERE segment > (SELECT max(segment) FROM n) - 2")
def retention_newest(spark, d):
    i = events(spark, d)
    return segments.retain(segments.rotate(i.df.select(i.ts_sec(), "evid_offset"), 3000), 2).select("evid_offset", "segment")


# --- functions and filters ----------------------------------------------------------------------------------------------------


@query(f"WITH {_D} SELECT evid_offset, len(toks) AS n_tokens, toks[1] AS first_token, toks[len(toks)] AS last_token FROM d")
def tokenize(spark, d):
    t = documents(spark, d).df.select("evid_offset", text.tokens(F.col("message")).alias("toks"))
    return t.select("evid_offset", F.size("toks").cast("long").alias("n_tokens"), F.get("toks", F.lit(0)).alias("first_token"), F.get("toks", F.size("toks") - 1).alias("last_token"))


@query("SELECT event_id, year(ts) AS dt_year, month(ts) AS dt_month, day(ts) AS dt_day, hour(ts) AS dt_hour, minute(ts) AS dt_minute, second(ts) AS dt_second, (dayofweek(ts) + 6) % 7 AS dt_weekday, dayofyear(ts) AS dt_yearday FROM events")
def dt_expand(spark, d):
    e = _read(spark, d, "events")
    return filters.accepted(filters.dt_expander().apply(e)).select("event_id", *times.expand(F.col("ts")))


def _lines(spark, d, *parts) -> DataFrame:
    """Events whose messages are log lines made of the columns of events."""
    return _read(spark, d, "events").select("event_id", F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit("log").alias("input"), F.lit("here").alias("hostname"), F.concat(*parts).alias("message"))


def _s(c: str):
    return F.col(c).cast("string")


_TS = "epoch(date_trunc('second', ts))::BIGINT"


def _apache(combined: bool) -> list:
    head = [F.lit("10.0.0."), (F.col("user_id") % 256).cast("string"), F.lit(" - user"), _s("user_id"), F.lit(" ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' -0700] "GET /'), F.col("event_type"), F.lit('?id=1 HTTP/1.0" '), (F.col("event_id") % 3 * 100 + 200).cast("string"), F.lit(" ")]
    size = [F.when(F.col("event_id") % 7 == 0, "-").otherwise(_s("event_id"))]
    return head + size + ([F.lit(' "http://x.example/'), F.col("event_type"), F.lit('" "Agent/1.0 (x)"')] if combined else [])


@query(f"SELECT event_id, {_TS} + 25200 AS ts_sec, '10.0.0.' || user_id % 256 AS remotehost, '-' AS remotelog, 'user' || user_id AS remoteuser, 'GET /' || event_type || '?id=1 HTTP/1.0' AS request, event_id % 3 * 100 + 200 AS status, event_id AS byteswritten FROM events WHERE event_id % 7 <> 0")
def apache_common(spark, d):
    r = Route("a", [filters.apache_common()]).accepted(_lines(spark, d, *_apache(False)))
    return r.select("event_id", times.seconds(F.col("ts"), "timestamp_ntz").alias("ts_sec"), "remotehost", "remotelog", "remoteuser", "request", "status", "byteswritten")


@query(f"SELECT event_id, {_TS} + 25200 AS ts_sec, '10.0.0.' || user_id % 256 AS remotehost, 'GET /' || event_type || '?id=1 HTTP/1.0' AS request, event_id % 3 * 100 + 200 AS status, event_id AS byteswritten, 'http://x.example/' || event_type AS referrer, 'Agent/1.0 (x)' AS useragent FROM events WHERE event_id % 7 <> 0")
def apache_combined(spark, d):
    r = Route("a", [filters.apache_combined()]).accepted(_lines(spark, d, *_apache(True)))
    return r.select("event_id", times.seconds(F.col("ts"), "timestamp_ntz").alias("ts_sec"), "remotehost", "request", "status", "byteswritten", "referrer", "useragent")


@query("SELECT event_id, 'apache_common: the line has another format' AS error FROM events WHERE event_id % 7 = 0")
def apache_rejects(spark, d):
    return Route("a", [filters.apache_common()]).rejected(_lines(spark, d, *_apache(False))).select("event_id", "error")


def _bsd_line() -> list:
    tag = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("sshd["), _s("user_id"), F.lit("]: "))).otherwise(F.lit("kernel: "))
    day = F.lpad(F.dayofmonth("ts").cast("string"), 2, " ")
    return [F.date_format("ts", "MMM "), day, F.date_format("ts", " HH:mm:ss"), F.lit(" host"), _s("user_id"), F.lit(" "), tag, F.col("event_type"), F.lit(" from x")]


_BSD_COLUMNS = f"event_id, {_TS} AS ts_sec, 'host' || user_id AS hostname, CASE WHEN event_id % 2 = 0 THEN 'sshd' ELSE 'kernel' END AS syslog_tag, CASE WHEN event_id % 2 = 0 THEN user_id END AS syslog_pid, event_type || ' from x' AS message"


@query(f"SELECT {_BSD_COLUMNS} FROM events")
def syslog_lines(spark, d):
    r = Route("s", [filters.syslog(year=2024)]).accepted(_lines(spark, d, *_bsd_line()))
    return r.select("event_id", times.seconds(F.col("ts"), "timestamp_ntz").alias("ts_sec"), "hostname", "syslog_tag", "syslog_pid", "message")


@query(f"SELECT {_BSD_COLUMNS}, CAST(event_id % 192 // 8 AS VARCHAR) AS syslog_facility, CAST(event_id % 8 AS VARCHAR) AS syslog_severity FROM events WHERE event_id % 192 // 8 IN (4, 13, 14, 2) AND event_id % 8 <= 4 AND NOT (event_id % 192 // 8 = 2 AND event_id % 8 = 3)")
def syslog_packets(spark, d):
    pri = F.concat(F.lit("<"), (F.col("event_id") % 192).cast("string"), F.lit(">"))
    r = Route("s", [filters.syslog_packet(selectors="auth,mail.warning;mail.!=err", year=2024)]).accepted(_lines(spark, d, pri, *_bsd_line()))
    return r.select("event_id", times.seconds(F.col("ts"), "timestamp_ntz").alias("ts_sec"), "hostname", "syslog_tag", "syslog_pid", "message", "syslog_facility", "syslog_severity")


_PRIS = "p AS (SELECT DISTINCT CAST(event_id % 192 AS INT) AS pri FROM events), q AS (SELECT pri, pri // 8 AS f, pri % 8 AS s FROM p)"


@query(f"WITH {_PRIS} SELECT pri FROM q WHERE (f = 0 AND s = 7) OR (f IN (4, 13, 14) AND s <= 5 AND NOT s <= 2)")
def syslog_selectors(spark, d):
    """The priorities among those of the events that selectors choose."""
    pri = _read(spark, d, "events").select((F.col("event_id") % 192).cast("int").alias("pri")).distinct()
    return pri.filter(F.col("pri").isin(sorted(selected("kern.=debug;auth.notice;auth.!crit"))))


_FACILITY = "['kern', 'user', 'mail', 'daemon', 'auth', 'syslog', 'lpr', 'news', 'uucp', 'cron', 'authpriv', 'ftp', 'ntp', 'auth', 'auth', 'cron']"


@query(f"WITH {_PRIS} SELECT pri, CASE WHEN f >= 16 THEN 'local' || (f - 16) ELSE {_FACILITY}[f + 1] END AS facility, ['emerg', 'alert', 'crit', 'err', 'warning', 'notice', 'info', 'debug'][s + 1] AS severity FROM q")
def priority_names(spark, d):
    pri = _read(spark, d, "events").select((F.col("event_id") % 192).cast("int").alias("pri")).distinct()
    return pri.select("pri", facility_name(F.col("pri")).alias("facility"), severity_name(F.col("pri")).alias("severity"))


@query(f"SELECT event_id, {_TS} - 7200 AS ts_sec FROM events")
def dt_rfc2822(spark, d):
    lines = _lines(spark, d, F.lit("x")).drop("ts").join(_read(spark, d, "events").select("event_id", F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss +0200").alias("rfc2822_date")), "event_id").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    source = Contract(Assertion("rfc2822_date", "literal"), sign=True)
    r = Route("r", [filters.dt_rfc2822()], source).accepted(lines)
    return r.select("event_id", times.seconds(F.col("ts"), "timestamp_ntz").alias("ts_sec"))


@query(f"SELECT event_id, {_TS} AS ts_sec, false AS has_source_field FROM events")
def dt_syslog(spark, d):
    e = _read(spark, d, "events")
    day = F.lpad(F.dayofmonth("ts").cast("string"), 2, " ")
    lines = e.select("event_id", F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit("log").alias("input"), F.lit("here").alias("hostname"), F.col("event_type").alias("message"), F.concat(F.date_format("ts", "MMM "), day, F.date_format("ts", " HH:mm:ss")).alias("syslog_date"))
    r = Route("r", [filters.dt_syslog(year=2024)], Contract(Assertion("syslog_date", "literal"), sign=True)).accepted(lines)
    return r.select("event_id", times.seconds(F.col("ts"), "timestamp_ntz").alias("ts_sec"), F.lit("syslog_date" in r.columns).alias("has_source_field"))


@query(f"SELECT event_id, CASE WHEN event_id % 3 > 0 THEN {_TS} END AS ts_sec, CASE WHEN event_id % 3 > 0 THEN 'InnoDB: ' || event_type ELSE event_type END AS message FROM events")
def mysql_server(spark, d):
    dated = F.concat(F.date_format("ts", "yyMMdd HH:mm:ss"), F.lit(" InnoDB: "), "event_type")
    r = Route("m", [filters.mysql_server()]).accepted(_lines(spark, d, F.when(F.col("event_id") % 3 > 0, dated).otherwise(F.col("event_type"))))
    return r.select("event_id", times.seconds(F.col("ts"), "timestamp_ntz").alias("ts_sec"), "message")


@query(f"""SELECT event_id, {_TS} AS ts_sec, CASE event_id % 4 WHEN 0 THEN 'HOST ALERT' WHEN 1 THEN 'SERVICE ALERT' ELSE 'Warning' END AS nagios_evtype,
 CASE WHEN event_id % 4 < 2 THEN 'db' || user_id END AS nagios_host, CASE WHEN event_id % 4 = 1 THEN 'disk' END AS nagios_service, CASE WHEN event_id % 4 < 2 THEN 'DOWN' END AS nagios_status, CASE WHEN event_id % 4 < 2 THEN 'HARD' END AS nagios_state,
 CASE WHEN event_id % 4 < 2 THEN event_id % 5 END AS nagios_attempt, CASE WHEN event_id % 4 < 2 THEN 'ping; ' || event_type ELSE event_type END AS message FROM events WHERE event_id % 4 < 3""")
def nagios(spark, d):
    kind = F.col("event_id") % 4
    attempt = (F.col("event_id") % 5).cast("string")
    host = F.concat(F.lit("HOST ALERT: db"), _s("user_id"), F.lit(";DOWN;HARD;"), attempt, F.lit(";ping; "), "event_type")
    service = F.concat(F.lit("SERVICE ALERT: db"), _s("user_id"), F.lit(";disk;DOWN;HARD;"), attempt, F.lit(";ping; "), "event_type")
    other = F.when(kind == 2, F.concat(F.lit("Warning: "), "event_type")).otherwise(F.lit("LOG ROTATION: DAILY"))
    seconds = times.seconds(F.col("ts"), "timestamp_ntz").cast("string")
    r = Route("n", [filters.nagios()]).accepted(_lines(spark, d, F.lit("["), seconds, F.lit("] "), F.when(kind == 0, host).when(kind == 1, service).otherwise(other)))
    return r.select("event_id", times.seconds(F.col("ts"), "timestamp_ntz").alias("ts_sec"), "nagios_evtype", "nagios_host", "nagios_service", "nagios_status", "nagios_state", "nagios_attempt", "message")


_URL = r"^(\w+)://([^/:]+)"


@query(f"SELECT page_id, regexp_extract(url, '{_URL}', 1) AS scheme, regexp_extract(url, '{_URL}', 2) AS host FROM pages WHERE regexp_matches(url, '{_URL}')")
def regex_filter(spark, d):
    pages = _read(spark, d, "pages").select("page_id", F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit("web").alias("input"), F.lit("h").alias("hostname"), F.lit("m").alias("message"), "url")
    r = Route("x", [filters.regex(r"^(?P<scheme>\w+)://(?P<host>[^/:]+)", field="url")]).accepted(pages)
    return r.select("page_id", "scheme", "host")


@query("SELECT outcome, n FROM (SELECT 'failed' AS outcome, count(*) FILTER (event_id % 7 = 0) AS n FROM events UNION ALL SELECT 'accepted', count(*) FILTER (event_id % 7 <> 0 AND event_type = 'click') FROM events UNION ALL SELECT 'dropped', count(*) FILTER (event_id % 7 <> 0 AND event_type <> 'click') FROM events)")
def route_outcomes(spark, d):
    route = Route("a", [filters.apache_common(), filters.regex(r"/(?P<page>click)", field="request")])
    return route.counts(_lines(spark, d, *_apache(False)))


@query(f"WITH {_E} SELECT evid_offset, strftime(make_timestamp(ts_sec * 1000000) - INTERVAL 5 HOUR, '%d %b %Y %H:%M:%S') || ' America/New_York' AS shown FROM e")
def display_times(spark, d):
    i = events(spark, d)
    return i.df.select("evid_offset", times.display(F.col("ts"), "timestamp_ntz", "America/New_York").alias("shown"))


@query(f"WITH {_E} SELECT evid_offset FROM e WHERE (ts_sec, evid_offset) > (1705000000, 0)")
def ids_beyond(spark, d):
    i = events(spark, d)
    return i.df.select(i.ts_sec(), "evid_offset").filter(beyond(Evid(1705000000, 0))).select("evid_offset")


# --- stores and files, written to the shared folder and read again ------------------------------------------------------------


def _scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _log_events(spark, d) -> DataFrame:
    i = events(spark, d)
    return i.df.select("ts", "evid_offset", "input", "hostname", "message", "event_type", "user_id")


@query(f"WITH {_E} SELECT {_ROW}, user_id FROM e WHERE event_type = 'error' AND ts >= '2024-01-05'")
def store_round_trip(spark, d):
    """Two batches of numbered events, the second of which brings some of the first again, and a search of the store."""
    store = Store(spark, _scratch(spark, "store"), "log", rotation=4000)
    e, types = _log_events(spark, d), {"event_type": "literal", "user_id": "int"}
    store.append(e.filter("user_id < 100"), types, numbered=True)
    store.append(e.filter("user_id >= 50"), types, numbered=True)
    found = Engine(spark, Catalog(store.index())).iter_events("event_type=error WHERE DATE FROM 2024/1/5 TO 2100/1/1", limit=None)
    return flat(found, "user_id").withColumn("user_id", F.col("user_id").cast("long"))


@query("SELECT row_number() OVER (ORDER BY ts, event_id) AS evid_offset, event_type || ' ' || props AS message FROM events")
def store_numbering(spark, d):
    """Events without ids get them in the order of their times."""
    store = Store(spark, _scratch(spark, "store"), "log")
    store.append(_log_events(spark, d).drop("evid_offset").repartition(5))
    return store.index().df.select("evid_offset", "message")


@query(f"WITH {_E} SELECT {_ROW}, hostname, CAST(user_id AS VARCHAR) AS user_id FROM e WHERE event_type = 'view'")
def csv_round_trip(spark, d):
    found, path = engine(spark, d).iter_events("event_type=view" + ALWAYS, limit=None), _scratch(spark, "csv")
    save_csv(found.data, path, found.field_names())
    return flat(load_csv(spark, path), "hostname", "user_id")


@query(f"WITH {_E} SELECT evid_offset, hostname, message FROM e")
def forward_and_collect(spark, d):
    e, path = _log_events(spark, d), _scratch(spark, "peer")
    forward(e, path)
    return collect(spark, path, ", ".join(f"{n} {t}" for n, t in e.dtypes), stream=False).select("evid_offset", "hostname", "message")
