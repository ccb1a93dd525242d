"""Access-log queries on the given tables: ``events`` stand for log lines, ``pages.url`` for request URIs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions.text import humanize_seconds
from tallyfield.operators import traffic as op

from .registry import query

CLASSES = ("click", "view", "purchase", "signup", "error")
NOW = "timestamp_ntz'2024-01-31 00:00:00'"

_SESSIONS = """
WITH g AS (
  SELECT *, date_diff('microsecond', lag(ts) OVER w, ts) // 1000000 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), s AS (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no,
         CASE WHEN gap IS NULL OR gap > {gap} THEN 0 ELSE gap END AS active_seconds FROM g
)
"""


def _sessions(read, gap: int):
    return op.sessionize(read("events"), ["user_id"], "ts", gap, "event_id")


@query(_SESSIONS.format(gap=1800) + "SELECT event_id, user_id, CAST(session_no AS BIGINT) AS session_no, CAST(active_seconds AS BIGINT) AS active_seconds FROM s")
def sessionize(read):
    """T-28 at the half-hour gap."""
    return _sessions(read, 1800).select("event_id", "user_id", F.col("session_no").cast("long").alias("session_no"), F.col("active_seconds").cast("long").alias("active_seconds"))


@query(_SESSIONS.format(gap=86400) + "SELECT event_id, user_id, CAST(session_no AS BIGINT) AS session_no FROM s")
def sessionize_day_gap(read):
    """T-28 at a gap of one day, so that sessions hold several events."""
    return _sessions(read, 86400).select("event_id", "user_id", F.col("session_no").cast("long").alias("session_no"))


@query(
    _SESSIONS.format(gap=86400)
    + "SELECT user_id, CAST(session_no AS BIGINT) AS session_no, CAST(sum(CASE WHEN active_seconds > 0 THEN least(active_seconds, 300) ELSE 0 END) AS BIGINT) AS seconds, count(*) AS requests FROM s GROUP BY 1, 2"
)
def active_time(read):
    """T-30."""
    return op.active_time(_sessions(read, 86400), ["user_id"]).select("user_id", F.col("session_no").cast("long").alias("session_no"), F.col("seconds").cast("long").alias("seconds"), "requests")


_RECORDS = (
    _SESSIONS.format(gap=86400)
    + """, p AS (
  SELECT user_id, session_no, page, min(struct_pack(t := ts, o := event_id)) AS pos FROM (SELECT *, props AS page FROM s) GROUP BY 1, 2, 3
), pr AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_no ORDER BY pos) AS rn FROM p
), pages AS (SELECT user_id, session_no, list(page ORDER BY rn) AS pages FROM pr WHERE rn <= 20 GROUP BY 1, 2
), c AS (
  SELECT user_id, session_no, event_type, count(*) AS n, min(struct_pack(t := ts, o := event_id)) AS pos, min(ts) AS f, max(ts) AS l,
         sum(CASE WHEN active_seconds > 0 THEN least(active_seconds, 300) ELSE 0 END) AS sec FROM s GROUP BY 1, 2, 3
), d AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_no ORDER BY n DESC, pos) AS rn FROM c
), r AS (
  SELECT user_id, session_no, max(CASE WHEN rn = 1 THEN event_type END) AS dominant, CAST(sum(n) AS BIGINT) AS requests, min(f) AS first_seen, max(l) AS last_seen, CAST(sum(sec) AS BIGINT) AS seconds
  FROM d GROUP BY 1, 2
), records AS (
SELECT r.user_id, CAST(r.session_no AS BIGINT) AS session_no, dominant, requests, first_seen, last_seen, seconds,
       CASE WHEN seconds < 60 THEN seconds || 's' WHEN seconds < 3600 THEN (seconds // 60) || 'm ' || (seconds % 60) || 's'
            ELSE (seconds // 3600) || 'h ' || ((seconds // 60) % 60) || 'm' END AS time_on_site,
       pages[1] AS entry_page, pages[-1] AS exit_page, CAST(len(pages) AS BIGINT) AS page_count, array_to_string(pages, '|') AS pages
FROM r JOIN pages USING (user_id, session_no))
"""
)


def _records(read):
    out = op.session_records(_sessions(read, 86400), ["user_id"], "ts", "props", "event_type", "event_id")
    return out.withColumns({c: F.col(c).cast("long") for c in ("session_no", "seconds", "page_count")})


_REFERRER = "CASE WHEN event_id % 4 = 0 THEN '(direct)' ELSE 'r' || (event_id % 17) || '.example' END"
_AGENT = "CASE WHEN event_id % 3 = 0 THEN 'Mozilla/5.0 (Windows NT 10.0) Firefox/1' ELSE 'curl/8' END"


@query(
    _SESSIONS.format(gap=86400)
    + f""", v AS (SELECT *, {_REFERRER} AS ref, {_AGENT} AS ua FROM s
), f AS (
  SELECT user_id, session_no, arg_min(ref, struct_pack(t := ts, o := event_id)) AS first_referrer, arg_min(ua, struct_pack(t := ts, o := event_id)) AS agent, {", ".join(f"count(*) FILTER (event_type = '{c}') AS n_{c}" for c in CLASSES)} FROM v GROUP BY 1, 2
), q AS (SELECT user_id, session_no, ref, min(struct_pack(t := ts, o := event_id)) AS pos FROM v WHERE ref <> '(direct)' GROUP BY 1, 2, 3
), qr AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_no ORDER BY pos) AS rn FROM q
), refs AS (SELECT user_id, session_no, string_agg(ref, '|' ORDER BY rn) AS referrers FROM qr WHERE rn <= 10 GROUP BY 1, 2)
SELECT f.user_id, CAST(f.session_no AS BIGINT) AS session_no, first_referrer, coalesce(referrers, '') AS referrers, agent, CASE WHEN agent = 'curl/8' THEN 'script' ELSE 'desktop' END AS device, CASE WHEN agent = 'curl/8' THEN 'Unknown' ELSE 'Windows 10/11' END AS os,
  CASE WHEN agent = 'curl/8' THEN 'curl' ELSE 'Firefox' END AS browser, {", ".join(f"n_{c}" for c in CLASSES)} FROM f LEFT JOIN refs ON refs.user_id = f.user_id AND refs.session_no = f.session_no"""
)
def session_origins(read):
    """T-29: referrers, agent facts and category counts of each session."""
    rows = read("events").withColumns({"ref": F.expr(_REFERRER), "ua": F.expr(_AGENT)})
    out = op.session_records(op.sessionize(rows, ["user_id"], "ts", 86400, "event_id"), ["user_id"], "ts", "props", "event_type", "event_id", referrer="ref", agent="ua", categories=CLASSES)
    return out.select("user_id", F.col("session_no").cast("long").alias("session_no"), "first_referrer", "referrers", "agent", "device", "os", "browser", *[f"n_{c}" for c in CLASSES])


@query(_RECORDS + "SELECT * FROM records")
def session_records(read):
    """T-29."""
    return _records(read)


@query(_RECORDS + "SELECT * FROM records ORDER BY last_seen DESC, user_id, session_no DESC LIMIT 120")
def newest_sessions(read):
    """T-36."""
    return op.newest_sessions(_records(read), ["user_id"])


@query(
    """SELECT CASE WHEN g = 0 THEN 'event_type' WHEN g = 1 THEN 'user_id' ELSE 'day' END AS dimension, label, n FROM (
    SELECT 0 AS g, event_type AS label, count(*) AS n FROM events GROUP BY 2 UNION ALL
    SELECT 1, CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY 2 UNION ALL
    SELECT 2, strftime(ts, '%Y-%m-%d'), count(*) FROM events GROUP BY 2)"""
)
def counts_by_dimension(read):
    """T-21: one pass with grouping sets."""
    return op.counts_by_dimension(read("events").select("event_type", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")), ["event_type", "user_id", "day"])


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def conditional_counts(read):
    """T-22."""
    return op.conditional_counts(read("events"), "user_id", F.col("event_type") == "error")


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{c}') AS n_{c}" for c in CLASSES) + " FROM events GROUP BY 1")
def category_pivot(read):
    """T-23."""
    return op.category_pivot(read("events"), "user_id", "event_type", CLASSES)


@query("SELECT event_type, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1")
def distinct_by_category(read):
    """T-24."""
    return op.distinct_by(read("events"), ["event_type"], "user_id")


@query("SELECT o_orderpriority, o_orderstatus, count(DISTINCT o_custkey) AS visitors FROM orders GROUP BY 1, 2")
def distinct_by_host_and_category(read):
    """T-24 over two keys."""
    return op.distinct_by(read("orders"), ["o_orderpriority", "o_orderstatus"], "o_custkey")


@query(
    """SELECT count(*) AS requests, count(DISTINCT o_custkey) AS visitors,
  count(*) FILTER (o_orderstatus = 'F') AS requests_F, count(*) FILTER (o_orderstatus = 'O') AS requests_O,
  count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F') AS visitors_F, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'O') AS visitors_O
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"""
)
def alias_union_distinct(read):
    """T-15 and T-25: two priorities stand for the aliases of one host."""
    return op.host_focus(read("orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"], "o_orderstatus", "o_custkey", ["F", "O"])


@query("SELECT user_id, count(*) AS n, arg_max(event_type, event_id) AS last_event_type, arg_max(ts, event_id) AS last_ts FROM events GROUP BY 1")
def last_wins_per_visitor(read):
    """T-26: the last line, not the latest time."""
    return op.last_line_wins(read("events"), "user_id", "event_id", ["event_type", "ts"])


@query("SELECT count(*) AS visitors, CAST(sum(n) AS BIGINT) AS requests, count(*) FILTER (n > 1) AS repeat_visitors, max(l) AS last_seen FROM (SELECT user_id, count(*) AS n, max(ts) AS l FROM events GROUP BY 1)")
def all_time_totals(read):
    """T-27."""
    return op.all_time_totals(read("events"), "user_id", "ts")


@query("SELECT p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10")
def top_labels(read):
    """T-32: a top-k report."""
    return op.top_labels(read("lineitem").join(read("part"), F.col("l_partkey") == F.col("p_partkey")), "p_type")


@query(
    """SELECT c_custkey AS o_custkey, t.n, t.last_seen, t.category, coalesce(n_name, '??') AS country FROM
  (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last_seen, max_by(o_orderstatus, o_orderkey) AS category FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 15) t
  JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey"""
)
def top_visitors(read):
    """T-33: the busiest customers with their country."""
    geo = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("country"))
    return op.top_visitors(read("orders"), "o_custkey", "o_orderdate", geo, category="o_orderstatus", line="o_orderkey")


@query(
    """WITH c AS (SELECT l_shipmode, p_brand, count(*) AS n FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
  h AS (SELECT l_shipmode, sum(n) AS a FROM c GROUP BY 1 ORDER BY a DESC, 1 LIMIT 5)
  SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY l_shipmode ORDER BY n DESC, p_brand) AS place FROM c SEMI JOIN h USING (l_shipmode)) WHERE place <= 6"""
)
def nested_topk(read):
    """T-34: top brands of the top flags."""
    rows = read("lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("l_shipmode"), "l_partkey").join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
    return op.nested_top(rows, "l_shipmode", "p_brand").withColumn("place", F.col("place").cast("long"))


@query("SELECT p_brand, count(DISTINCT l_suppkey) AS visitors FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY visitors DESC, p_brand LIMIT 12")
def top_by_distinct(read):
    """T-35."""
    return op.top_by_distinct(read("lineitem").join(read("part"), F.col("l_partkey") == F.col("p_partkey")), "p_brand", "l_suppkey")


_PATH = "CASE WHEN p = '' THEN '/' ELSE p END"


@query(f"SELECT page_id, {_PATH} AS path FROM (SELECT page_id, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS p FROM pages)")
def url_normalize(read):
    """T-07."""
    return read("pages").select("page_id", op.normalize_path(F.col("url")).alias("path"))


_HOST = "regexp_replace(lower(regexp_extract({0}, '^[^:/?#]*://([^/?#]*)', 1)), ':(80|443)$', '')"


@query(f"SELECT page_id, {_HOST.format('url')} AS host, {_HOST.format('url')} AS referrer FROM pages")
def host_normalize(read):
    """T-06 and T-08."""
    return read("pages").select("page_id", op.normalize_host(F.col("url")).alias("host"), op.normalize_referrer(F.col("url")).alias("referrer"))


@query(
    f"""SELECT page_id, NOT regexp_matches(path, '^/(api|_next|\\.well-known)/') AND NOT regexp_matches(path, '(?i)\\.(css|js|mjs|map|ico|png|jpg|jpeg|gif|svg|webp|woff|woff2|ttf|eot|txt|xml|json|pdf|zip|gz|tar|mp4|webm|mp3|wav)$') AS page_like
  FROM (SELECT page_id, {_PATH} AS path FROM (SELECT page_id, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS p FROM pages))"""
)
def page_like(read):
    """T-12."""
    return read("pages").select("page_id", op.is_page_like(F.col("url")).alias("page_like"))


def _any(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{t}')" for t in terms) + ")"


@query(
    f"""SELECT doc_id, CASE WHEN {_any('source', op.SUSPICIOUS_PATHS)} THEN 'suspicious' WHEN {_any('text', op.BOT_TERMS)} THEN 'bot' WHEN {_any('text', op.SCRIPT_TERMS)} THEN 'suspicious'
  WHEN {_any('text', op.BROWSER_TERMS)} THEN 'human' ELSE 'unknown' END AS category,
  CASE WHEN {_any('text', op.BOT_TERMS)} THEN 'bot' WHEN {_any('text', op.SCRIPT_TERMS)} THEN 'script' WHEN {_any('text', ('ipad', 'tablet'))} THEN 'tablet'
  WHEN {_any('text', ('iphone', 'android', 'mobile'))} THEN 'mobile' WHEN {_any('text', ('windows', 'macintosh', 'linux', 'x11', 'cros'))} THEN 'desktop' ELSE 'unknown' END AS device,
  CASE WHEN {_any('text', ('windows nt 10.0',))} THEN 'Windows 10/11' WHEN {_any('text', ('windows nt 6.3',))} THEN 'Windows 8.1' WHEN {_any('text', ('windows nt 6.2',))} THEN 'Windows 8'
  WHEN {_any('text', ('windows nt 6.1',))} THEN 'Windows 7' WHEN {_any('text', ('iphone', 'ipad'))} THEN 'iOS' WHEN {_any('text', ('android',))} THEN 'Android'
  WHEN {_any('text', ('mac os x', 'macintosh'))} THEN 'macOS' WHEN {_any('text', ('cros',))} THEN 'ChromeOS' WHEN {_any('text', ('linux', 'x11'))} THEN 'Linux' ELSE 'Unknown' END AS os,
  CASE WHEN {_any('text', ('edg/',))} THEN 'Edge' WHEN {_any('text', ('opr/', 'opera'))} THEN 'Opera' WHEN {_any('text', ('firefox/',))} THEN 'Firefox' WHEN {_any('text', ('chrome/',))} THEN 'Chrome'
  WHEN {_any('text', ('safari/',))} THEN 'Safari' WHEN {_any('text', ('curl/',))} THEN 'curl' WHEN {_any('text', ('wget/',))} THEN 'wget' ELSE 'Unknown' END AS browser
  FROM documents"""
)
def classify_text_rules(read):
    """T-05, T-09 to T-11: documents stand for user agents, their source for the path."""
    t = F.col("text")
    return read("documents").select("doc_id", op.classify_request(t, F.col("source")).alias("category"), op.device_type(t).alias("device"), op.operating_system(t).alias("os"), op.browser(t).alias("browser"))


@query("SELECT event_id, event_type, value FROM events WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 72 HOURS")
def rolling_hours(read):
    """T-14 over three days."""
    return op.since(read("events"), F.expr(NOW), 72).select("event_id", "event_type", "value")


@query(
    """WITH h AS (SELECT DISTINCT sha1(text) AS line_hash FROM documents WHERE doc_id % 2 = 1)
  SELECT line_hash FROM (SELECT DISTINCT sha1(text) AS line_hash FROM documents) WHERE line_hash NOT IN (SELECT line_hash FROM h)"""
)
def line_dedupe(read):
    """T-19: texts of even documents that no odd document has."""
    docs = read("documents")
    seen = docs.filter(F.col("doc_id") % 2 == 1).select(F.sha1("text").alias("line_hash"))
    return op.new_lines(docs.select("text"), seen, "text").select("line_hash")


@query(
    """SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAYS) WHERE r <= 5"""
)
def retention_last_n(read):
    """T-31: the last five of each visitor within 20 days."""
    return op.retain_last(read("events"), "user_id", "event_id", "ts", F.expr(NOW), 5, 20).select("event_id", "user_id")


@query("SELECT c_custkey, c_name, coalesce(n_name, '??') AS country FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def geo_enrich(read):
    """T-20."""
    geo = read("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    return op.enrich_geo(read("customer").select("c_custkey", "c_name", "c_nationkey"), geo, "c_nationkey").select("c_custkey", "c_name", "country")


@query(
    """SELECT c_custkey, last_order IS NULL AS no_email, c_acctbal < 0 AS no_name FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS last_order FROM orders GROUP BY 1) ON o_custkey = c_custkey
  WHERE last_order IS NULL OR c_acctbal < 0"""
)
def profile_gaps(read):
    """T-18 and T-37: customers without an order, or with a blank name (a negative balance stands for it)."""
    last = read("orders").groupBy("o_custkey").agg(F.max("o_orderpriority").alias("email"))
    users = read("customer").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").withColumn("name", F.when(F.col("c_acctbal") >= 0, F.col("c_name")).otherwise(" "))
    return op.profile_gaps(users, "c_custkey", "email", "name")


@query(
    """SELECT event_id, event_id % 7 <> 6 AS parsed,
  CASE WHEN event_id % 7 <> 6 THEN CAST(user_id AS VARCHAR) END AS ip, CASE WHEN event_id % 7 <> 6 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at,
  CASE WHEN event_id % 7 <> 6 THEN upper(event_type) END AS method, CASE WHEN event_id % 7 <> 6 THEN '/e/' || event_type END AS path,
  CASE WHEN event_id % 7 = 6 THEN NULL WHEN event_id % 5 = 0 THEN 0 ELSE CAST(200 + event_id % 300 AS INTEGER) END AS status,
  CASE WHEN event_id % 7 = 6 THEN NULL WHEN event_id % 2 = 0 THEN '(direct)' ELSE 'r.example' END AS referrer_host,
  CASE WHEN event_id % 7 = 6 THEN NULL WHEN event_id % 2 = 0 THEN 'h' || (event_id % 3) ELSE '(unknown host)' END AS host FROM events"""
)
def log_parse(read):
    """T-02 to T-04: events rendered as JSON lines (even ids), combined lines (odd ids) or neither, then parsed back."""
    e = read("events")
    i, uri = F.col("event_id"), F.concat(F.lit("/e/"), "event_type", F.lit("?k=1#x"))
    status = F.when(i % 5 == 0, "-").otherwise((200 + i % 300).cast("string"))
    as_json = F.to_json(
        F.struct(
            F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("ts"),
            F.col("event_type").alias("method"),
            uri.alias("request_uri"),
            F.concat(F.lit("H"), (i % 3).cast("string"), F.lit(":443")).alias("host"),
            F.col("user_id").cast("string").alias("remote_addr"),
            status.alias("status"),
        )
    )
    at = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    combined = F.concat(F.col("user_id").cast("string"), F.lit(" - - ["), at, F.lit(' +0000] "'), "event_type", F.lit(" "), uri, F.lit(' HTTP/1.1" '), status, F.lit(' 12 "http://R.example:80/a" "Mozilla"'))
    line = F.when(i % 7 == 6, F.lit("{broken")).when(i % 2 == 0, as_json).otherwise(combined)
    out = op.parse_log(e.select("event_id", line.alias("value")), keep=["event_id"])
    return out.select("event_id", "parsed", "ip", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "method", "path", "status", "referrer_host", "host")


@query(
    """SELECT user_id, seconds, CASE WHEN seconds < 60 THEN seconds || 's' WHEN seconds < 3600 THEN (seconds // 60) || 'm ' || (seconds % 60) || 's'
  ELSE (seconds // 3600) || 'h ' || ((seconds // 60) % 60) || 'm' END AS said FROM (SELECT user_id, CAST(sum(event_id % 50) AS BIGINT) AS seconds FROM events GROUP BY 1)"""
)
def humanized_durations(read):
    """T-17."""
    t = read("events").groupBy("user_id").agg(F.sum(F.col("event_id") % 50).alias("seconds"))
    return t.select("user_id", "seconds", humanize_seconds(F.col("seconds")).alias("said"))


@query("SELECT user_id, regexp_replace(lower(trim(max(props))), '\\s+', ' ', 'g')[:240] AS agent FROM events GROUP BY 1")
def agent_keys(read):
    """T-13: the props text stands for the user agent."""
    return read("events").groupBy("user_id").agg(F.max("props").alias("ua")).select("user_id", op.agent_key(F.col("ua")).alias("agent"))
