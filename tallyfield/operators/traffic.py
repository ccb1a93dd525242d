"""Access-log analytics: parsing, classification, counters, distinct visitors, sessions (T-01 to T-37)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.text import contains_any, humanize_seconds
from tallyfield.functions.times import whole_seconds_between
from tallyfield.operators.ordering import with_previous, with_running_sum

UNKNOWN_HOST, DIRECT = "(unknown host)", "(direct)"

# The terms that decide a request's class, its device, and static suffixes.
BOT_TERMS = ("bot", "crawl", "crawler", "spider", "censys", "zgrab", "uptimerobot", "googlebot", "bingbot", "bingpreview", "duckduckbot", "facebookexternalhit", "slurp")
SCRIPT_TERMS = ("curl", "wget", "python", "scrapy", "nikto", "sqlmap", "masscan", "go-http-client", "nmap", "scanner")
BROWSER_TERMS = ("mozilla", "chrome", "safari", "firefox", "edge", "opera")
SUSPICIOUS_PATHS = (
    ".env", "wlwmanifest.xml", "xmlrpc.php", "wp-includes", "/wordpress", "/blog/wp-", "/storage/logs", "laravel", ".git", "phpmyadmin", "/boaform",
    "/cgi-bin", "/actuator", "production.key", "mail.log", "email.log", ".aws/", ".msmtprc", ".muttrc", ".directadmin", ".cpanel", ".plesk",
)
STATIC_SUFFIX = r"(?i)\.(?:css|js|mjs|map|ico|png|jpg|jpeg|gif|svg|webp|woff|woff2|ttf|eot|txt|xml|json|pdf|zip|gz|tar|mp4|webm|mp3|wav)$"
LOG_SCHEMA = "ts string, method string, request_uri string, uri string, host string, server_name string, remote_addr string, request string, status string, referrer string, user_agent string"
COMBINED = r'^([0-9a-fA-F:.]+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"([^"]*)"\s+(\d{3}|-)\s+\S+\s+"([^"]*)"\s+"([^"]*)"'


def normalize_host(col: Column) -> Column:
    """Lower case without scheme and default port; missing is UNKNOWN_HOST (T-06)."""
    host = F.lower(F.trim(col))
    host = F.when(host.contains("://"), F.coalesce(F.nullif(F.regexp_extract(host, r"^[^:/?#]*://([^/?#]*)", 1), F.lit("")), host)).otherwise(host)
    host = F.regexp_replace(host, r":(?:80|443)$", "")
    return F.when(col.isNull() | col.isin("", "-") | (host == ""), F.lit(UNKNOWN_HOST)).otherwise(host)


def normalize_path(col: Column) -> Column:
    """Without scheme, authority, query and fragment; an empty path is ``/``, a missing one ``(unknown)`` (T-07)."""
    path = F.regexp_extract(col, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.when(col.isNull() | (col == ""), F.lit("(unknown)")).when(path == "", F.lit("/")).otherwise(path)


def normalize_referrer(col: Column) -> Column:
    """The referrer's host, or DIRECT (T-08)."""
    authority = F.regexp_extract(col, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.when(col.isNull() | col.isin("", "-"), F.lit(DIRECT)).otherwise(normalize_host(F.when(authority == "", col).otherwise(authority)))


def classify_request(ua: Column, path: Column) -> Column:
    """Suspicious path, bot, suspicious agent, browser, unknown: the first that holds (T-05)."""
    return (
        F.when(contains_any(path, SUSPICIOUS_PATHS), "suspicious")
        .when(contains_any(ua, BOT_TERMS), "bot")
        .when(contains_any(ua, SCRIPT_TERMS), "suspicious")
        .when(contains_any(ua, BROWSER_TERMS), "human")
        .otherwise("unknown")
    )


def _first_of(ua: Column, rules: Sequence[tuple[Sequence[str], str]], default: str) -> Column:
    return reduce(lambda c, r: c.when(contains_any(ua, r[0]), r[1]), rules[1:], F.when(contains_any(ua, rules[0][0]), rules[0][1])).otherwise(default)


def device_type(ua: Column) -> Column:
    """T-09."""
    rules = ((BOT_TERMS, "bot"), (SCRIPT_TERMS, "script"), (("ipad", "tablet"), "tablet"), (("iphone", "android", "mobile"), "mobile"), (("windows", "macintosh", "linux", "x11", "cros"), "desktop"))
    return _first_of(ua, rules, "unknown")


def operating_system(ua: Column) -> Column:
    """T-10."""
    rules = (
        (("windows nt 10.0",), "Windows 10/11"), (("windows nt 6.3",), "Windows 8.1"), (("windows nt 6.2",), "Windows 8"), (("windows nt 6.1",), "Windows 7"),
        (("iphone", "ipad"), "iOS"), (("android",), "Android"), (("mac os x", "macintosh"), "macOS"), (("cros",), "ChromeOS"), (("linux", "x11"), "Linux"),
    )
    return _first_of(ua, rules, "Unknown")


def browser(ua: Column) -> Column:
    """T-11: Edge and Opera before Chrome, Chrome before Safari."""
    rules = ((("edg/",), "Edge"), (("opr/", "opera"), "Opera"), (("firefox/",), "Firefox"), (("chrome/",), "Chrome"), (("safari/",), "Safari"), (("curl/",), "curl"), (("wget/",), "wget"))
    return _first_of(ua, rules, "Unknown")


def is_page_like(path: Column) -> Column:
    """T-12."""
    p = normalize_path(path)
    return (p != "(unknown)") & ~p.rlike(r"^/(?:api|_next|\.well-known)/") & ~p.rlike(STATIC_SUFFIX)


def agent_key(ua: Column) -> Column:
    """T-13."""
    return F.substring(F.regexp_replace(F.lower(F.trim(F.coalesce(ua, F.lit("")))), r"\s+", " "), 1, 240)


def parse_log(lines: DataFrame, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """JSON lines first, then the combined format; each line with ``parsed`` true or false (T-02 to T-04).

    Columns: ``raw, parsed, ip, ts, request, method, raw_path, path, status, referrer, referrer_host, ua, host``. A line
    that is neither stays, all NULL, so rejects can go to a table of their own. ``keep`` names columns to carry along.
    """
    raw = F.col(value)
    j = F.from_json(F.when(F.trim(raw).rlike(r"^\{[\s\S]*\}$"), F.trim(raw)), LOG_SCHEMA)
    blank = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), F.lit(d))
    part = lambda k: F.regexp_extract(raw, COMBINED, k)
    words = F.filter(F.split(F.trim(part(3)), r"\s+"), lambda x: x != "")
    rows = lines.select(*keep, raw.alias("raw"), j.alias("j"), raw.rlike(COMBINED).alias("combined"), words.alias("words"), *[part(k).alias(f"g{k}") for k in (1, 2, 3, 4, 5, 6)])
    g = F.col
    from_json = F.struct(
        F.coalesce(g("j.remote_addr"), F.lit("")).alias("ip"),
        F.try_to_timestamp(g("j.ts")).alias("ts"),
        F.coalesce(g("j.request"), F.lit("")).alias("request"),
        F.upper(blank(g("j.method"), "(unknown)")).alias("method"),
        F.coalesce(F.nullif(g("j.request_uri"), F.lit("")), blank(g("j.uri"), "(unknown)")).alias("raw_path"),
        g("j.status").alias("status"),
        blank(g("j.referrer"), "-").alias("referrer"),
        F.coalesce(g("j.user_agent"), F.lit("")).alias("ua"),
        F.coalesce(F.nullif(g("j.host"), F.lit("")), g("j.server_name")).alias("host"),
    )
    legacy = F.struct(
        g("g1").alias("ip"),
        F.try_to_timestamp(g("g2"), F.lit("dd/MMM/yyyy:HH:mm:ss Z")).alias("ts"),
        F.trim(g("g3")).alias("request"),
        F.upper(F.coalesce(F.try_element_at("words", F.lit(1)), F.lit("(UNKNOWN)"))).alias("method"),
        F.coalesce(F.try_element_at("words", F.lit(2)), F.lit("(unknown)")).alias("raw_path"),
        g("g4").alias("status"),
        g("g5").alias("referrer"),
        g("g6").alias("ua"),
        F.lit(None).cast("string").alias("host"),
    )
    e = rows.select(*keep, "raw", F.coalesce(F.when(from_json["ts"].isNotNull(), from_json), F.when(g("combined") & legacy["ts"].isNotNull(), legacy)).alias("e"))
    ok = g("e").isNotNull()
    return e.select(
        *keep,
        "raw",
        ok.alias("parsed"),
        "e.ip",
        "e.ts",
        "e.request",
        F.when(g("e.method") == "(UNKNOWN)", "(unknown)").otherwise(g("e.method")).alias("method"),
        "e.raw_path",
        F.when(ok, normalize_path(g("e.raw_path"))).alias("path"),
        F.when(ok, F.coalesce(g("e.status").try_cast("int"), F.lit(0))).alias("status"),
        "e.referrer",
        F.when(ok, normalize_referrer(g("e.referrer"))).alias("referrer_host"),
        "e.ua",
        F.when(ok, normalize_host(g("e.host"))).alias("host"),
    )


def since(df: DataFrame, now: Column, hours: int = 24, ts: str = "ts") -> DataFrame:
    """Rows strictly later than ``hours`` before ``now`` (T-14)."""
    return df.filter(F.col(ts) > now - F.expr(f"INTERVAL {hours} HOURS"))


def new_lines(lines: DataFrame, seen: DataFrame, value: str = "value") -> DataFrame:
    """Lines whose SHA-1 is not in ``seen.line_hash``, one of each (T-19)."""
    return lines.withColumn("line_hash", F.sha1(value)).join(seen.select("line_hash"), "line_hash", "left_anti").dropDuplicates(["line_hash"])


def enrich_geo(df: DataFrame, geo: DataFrame, key: str, columns: Sequence[str] = ("country",)) -> DataFrame:
    """Left join a geo table; missing places are ``??`` (T-20). The optimizer broadcasts ``geo`` where its size allows."""
    return df.join(geo.select(key, *columns), key, "left").withColumns({c: F.coalesce(c, F.lit("??")) for c in columns})


def counts_by_dimension(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """``dimension, label, n`` of each dimension in one pass by grouping sets (T-21)."""
    sets = df.groupingSets([[d] for d in dimensions], *dimensions).agg(F.grouping_id().alias("_g"), F.count("*").alias("n"))
    ids = {d: (1 << len(dimensions)) - 1 - (1 << (len(dimensions) - 1 - k)) for k, d in enumerate(dimensions)}
    which = reduce(lambda c, d: c.when(F.col("_g") == ids[d], d), dimensions[1:], F.when(F.col("_g") == ids[dimensions[0]], dimensions[0]))
    label = F.coalesce(*[F.when(F.col("_g") == ids[d], F.col(d).cast("string")) for d in dimensions])
    return sets.select(which.alias("dimension"), label.alias("label"), "n")


def conditional_counts(df: DataFrame, by: str, condition: Column) -> DataFrame:
    """Rows that meet a condition, counted by a column (T-22)."""
    return df.filter(condition).groupBy(by).agg(F.count("*").alias("n"))


def category_pivot(df: DataFrame, by: str, category: str, values: Sequence[str]) -> DataFrame:
    """Counts of each category as columns, 0 where there is none (T-23)."""
    return df.groupBy(by).agg(*[F.count_if(F.col(category) == v).alias(f"n_{v}") for v in values])


def distinct_by(df: DataFrame, by: Sequence[str], who: str) -> DataFrame:
    """Exact distinct visitors (T-24), in two steps so that a hot group's visitors are spread before they are counted."""
    return df.select(*by, who).distinct().groupBy(*by).agg(F.count(who).alias("visitors"))


def host_focus(df: DataFrame, host: str, aliases: Sequence[str], category: str, who: str, classes: Sequence[str]) -> DataFrame:
    """Requests and distinct visitors over all aliases of one host, whole and by class (T-15, T-25)."""
    rows = df.filter(F.col(host).isin(*aliases))
    per_visitor = rows.groupBy(who).agg(F.count("*").alias("_n"), *[F.count_if(F.col(category) == c).alias(f"_{c}") for c in classes])
    return per_visitor.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("requests"),
        F.count(who).alias("visitors"),
        *[F.coalesce(F.sum(f"_{c}"), F.lit(0)).alias(f"requests_{c}") for c in classes],
        *[F.count_if(F.col(f"_{c}") > 0).alias(f"visitors_{c}") for c in classes],
    )


def last_line_wins(df: DataFrame, who: str, line: str, values: Sequence[str]) -> DataFrame:
    """Per visitor the count and the values of its last line, by line number and not by time (T-26)."""
    return df.groupBy(who).agg(F.count("*").alias("n"), F.max_by(F.struct(*values), line).alias("_last")).select(who, "n", *[F.col(f"_last.{v}").alias(f"last_{v}") for v in values])


def all_time_totals(df: DataFrame, who: str, ts: str) -> DataFrame:
    """Visitors, requests, repeat visitors, last time (T-27)."""
    per = df.groupBy(who).agg(F.count("*").alias("_n"), F.max(ts).alias("_last"))
    return per.agg(F.count("*").alias("visitors"), F.sum("_n").alias("requests"), F.count_if(F.col("_n") > 1).alias("repeat_visitors"), F.max("_last").alias("last_seen"))


def retain_last(df: DataFrame, who: str, order: str, ts: str, now: Column, most: int = 200, days: int = 30) -> DataFrame:
    """The last ``most`` rows of each visitor that are at most ``days`` old (T-31)."""
    recent = df.filter(F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS"))
    rank = F.row_number().over(Window.partitionBy(who).orderBy(F.col(order).desc()))
    return recent.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")


def top_labels(df: DataFrame, label: str, k: int = 10) -> DataFrame:
    """The k most frequent labels; ties by label (T-32)."""
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(label).asc_nulls_last()).limit(k)


def top_visitors(df: DataFrame, who: str, ts: str, geo: DataFrame | None = None, k: int = 15, category: str | None = None, line: str | None = None) -> DataFrame:
    """The k busiest visitors with their last time, their country, and the category of their last line by ``line`` (T-33)."""
    last = [F.max_by(category, line).alias("category")] if category and line else []
    top = df.groupBy(who).agg(F.count("*").alias("n"), F.max(ts).alias("last_seen"), *last).orderBy(F.desc("n"), who).limit(k)
    return top if geo is None else enrich_geo(top, geo, who)


def nested_top(df: DataFrame, outer: str, inner: str, k_outer: int = 5, k_inner: int = 6) -> DataFrame:
    """The k_inner most frequent inner labels of the k_outer most frequent outer ones (T-34)."""
    counts = df.groupBy(outer, inner).agg(F.count("*").alias("n"))
    hosts = counts.groupBy(outer).agg(F.sum("n").alias("_all")).orderBy(F.desc("_all"), outer).limit(k_outer)
    rank = F.row_number().over(Window.partitionBy(outer).orderBy(F.desc("n"), inner))
    return counts.join(hosts, outer, "left_semi").withColumn("place", rank).filter(F.col("place") <= k_inner)


def top_by_distinct(df: DataFrame, by: str, who: str, k: int = 12) -> DataFrame:
    """The k groups with the most distinct visitors (T-35)."""
    return distinct_by(df, [by], who).orderBy(F.desc("visitors"), by).limit(k)


def profile_gaps(users: DataFrame, uid: str, email: str, name: str) -> DataFrame:
    """Users without an email, without a name, or both (T-18, T-37)."""
    missing = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    return users.filter(missing(email) | missing(name)).select(uid, missing(email).alias("no_email"), missing(name).alias("no_name"))


def sessionize(df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: int = 1800, tie: str | None = None, bucket_seconds: int = 86_400) -> DataFrame:
    """``session_no`` of each row within its keys: a new one after a gap of more than ``gap_seconds`` whole seconds (T-28).

    Also ``active_seconds``, the row's whole-second gap to the one before it in its session (0 for the first). Histories
    are split by ``bucket_seconds`` of time, so a visitor with most of the log is not one task; gaps and numbers go on
    across the buckets.
    """
    ties = [tie] if tie else []
    bucket = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / bucket_seconds)
    rows = with_previous(df, keys, ts, ties, bucket, "_before_ts")
    gap = whole_seconds_between(F.col(ts), F.col("_before_ts"))
    rows = rows.withColumn("_gap", gap).withColumn("_new", (F.col("_gap").isNull() | (F.col("_gap") > gap_seconds)).cast("int"))
    rows = with_running_sum(rows, keys, [ts, *ties], "_new", "session_no")
    return rows.withColumn("active_seconds", F.when(F.col("_new") == 1, 0).otherwise(F.col("_gap"))).drop("_gap", "_new", "_before_ts", "_bucket")


def active_time(sessions: DataFrame, keys: Sequence[str], cap: int = 300) -> DataFrame:
    """Time on site: positive gaps of at most ``cap`` seconds each (T-30)."""
    return sessions.groupBy(*keys, "session_no").agg(F.sum(F.when(F.col("active_seconds") > 0, F.least("active_seconds", F.lit(cap))).otherwise(0)).alias("seconds"), F.count("*").alias("requests"))


def _first_seen(sessions: DataFrame, keys: Sequence[str], what: str, at: Column, most: int, name: str) -> DataFrame:
    """The ``most`` values of a column first seen in each session, in that order.

    Cut before they are gathered, so an array never has more than ``most``.
    """
    session = [*keys, "session_no"]
    by_value = sessions.filter(F.trim(what) != "").groupBy(*session, what).agg(F.min(at).alias("_at"))
    first = by_value.withColumn("_place", F.row_number().over(Window.partitionBy(*session).orderBy("_at"))).filter(F.col("_place") <= most)
    return first.groupBy(*session).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(what).alias("v")))), lambda x: x["v"]).alias(name))


def session_records(
    sessions: DataFrame, keys: Sequence[str], ts: str, page: str, category: str, tie: str, cap: int = 300, most_pages: int = 20,
    referrer: str | None = None, agent: str | None = None, categories: Sequence[str] = (), most_referrers: int = 10,
) -> DataFrame:
    """One record a session (T-29): pages in the order first seen (20 at most), entry and exit page, dominant category.

    The exit page is the last first-seen page among those kept; a session without a page has none. Equal category counts: the
    one seen first. With ``referrer`` also the first one and the ten other than direct first seen; with ``agent`` the first
    row's agent and its device, system and browser; with ``categories`` a count ``n_<category>`` of each.
    """
    session = [*keys, "session_no"]
    at = F.struct(F.col(ts).alias("t"), F.col(tie).alias("o"))
    pages = _first_seen(sessions, keys, page, at, most_pages, "pages")
    extra = [c for c in (referrer, agent) if c]
    by_category = sessions.groupBy(*session, category).agg(
        F.count("*").alias("_n"), F.min(F.struct(at.alias("at"), *extra)).alias("_at"), F.max(ts).alias("_last"), F.min(ts).alias("_first"),
        F.sum(F.when(F.col("active_seconds") > 0, F.least("active_seconds", F.lit(cap))).otherwise(0)).alias("_s"),
    )
    facts = by_category.groupBy(*session).agg(
        F.min_by(category, F.struct(-F.col("_n"), "_at.at")).alias("dominant"), F.sum("_n").alias("requests"), F.min("_first").alias("first_seen"), F.max("_last").alias("last_seen"), F.sum("_s").alias("seconds"), F.min("_at").alias("_start"),
        *[F.sum(F.when(F.col(category) == c, F.col("_n")).otherwise(0)).alias(f"n_{c}") for c in categories],
    )
    out, more = facts.join(pages, session, "left"), [f"n_{c}" for c in categories]
    if referrer:
        named = sessions.filter(F.col(referrer) != DIRECT)
        out = out.join(_first_seen(named, keys, referrer, at, most_referrers, "_referrers"), session, "left")
        more += [F.col("_start")[referrer].alias("first_referrer"), F.coalesce(F.array_join("_referrers", "|"), F.lit("")).alias("referrers")]
    if agent:
        ua = F.col("_start")[agent]
        more += [ua.alias("agent"), device_type(ua).alias("device"), operating_system(ua).alias("os"), browser(ua).alias("browser")]
    return out.select(
        *session, "dominant", "requests", "first_seen", "last_seen", "seconds", humanize_seconds(F.col("seconds")).alias("time_on_site"),
        F.try_element_at("pages", F.lit(1)).alias("entry_page"), F.try_element_at("pages", F.lit(-1)).alias("exit_page"),
        F.when(F.col("pages").isNull(), 0).otherwise(F.size("pages")).alias("page_count"), F.coalesce(F.array_join("pages", "|"), F.lit("")).alias("pages"), *more,
    )


def newest_sessions(records: DataFrame, keys: Sequence[str], k: int = 120) -> DataFrame:
    """T-36."""
    return records.orderBy(F.desc("last_seen"), *keys, F.desc("session_no")).limit(k)


# Country names by code.
COUNTRIES = {
    "US": "United States", "CA": "Canada", "GB": "United Kingdom", "UK": "United Kingdom", "IE": "Ireland", "DE": "Germany", "FR": "France", "NL": "Netherlands",
    "BE": "Belgium", "SE": "Sweden", "NO": "Norway", "FI": "Finland", "DK": "Denmark", "IT": "Italy", "ES": "Spain", "CH": "Switzerland", "AT": "Austria", "PL": "Poland",
    "CZ": "Czech Republic", "RO": "Romania", "BG": "Bulgaria", "LT": "Lithuania", "UA": "Ukraine", "TR": "Turkey", "AU": "Australia", "NZ": "New Zealand", "JP": "Japan",
    "KR": "South Korea", "CN": "China", "HK": "Hong Kong", "IN": "India", "PK": "Pakistan", "SG": "Singapore", "ZA": "South Africa", "NG": "Nigeria", "GH": "Ghana",
    "BR": "Brazil", "MX": "Mexico",
}


def country_name(code: Column) -> Column:
    """The code's country, else the code itself, ``??`` without one (T-16)."""
    known = F.create_map(*[F.lit(x) for pair in COUNTRIES.items() for x in pair])
    key = F.upper(F.trim(code))
    return F.coalesce(F.try_element_at(known, key), F.nullif(key, F.lit("")), F.lit("??"))


def parse_geo(text: Column) -> Column:
    """Struct ``country, area, city`` of a geo tool's answer for a country or a city edition (T-16)."""
    answer = F.trim(F.regexp_extract(text, r"^[^:]*:\s*(.*)$", 1))
    parts = F.transform(F.split(answer, ","), lambda x: F.trim(x))
    blank = lambda c: F.when(F.coalesce(c, F.lit("")).isin("", "N/A"), F.lit("")).otherwise(c)
    city = F.coalesce(text.contains("City Edition") & (F.size(parts) >= 3), F.lit(False))
    nothing = text.isNull() | (text == "") | text.contains("IP Address not found")
    named = F.regexp_extract(text, r":\s*[A-Z0-9-]+,\s*(.+)$", 1)
    country = F.coalesce(F.nullif(F.trim(named), F.lit("")), F.nullif(answer, F.lit("")), F.lit("??"))
    return F.struct(
        F.when(nothing, "??").when(city, country_name(parts[0])).otherwise(country).alias("country"),
        F.when(city & ~nothing, blank(F.try_element_at(parts, F.lit(2)))).otherwise("").alias("area"),
        F.when(city & ~nothing, blank(F.try_element_at(parts, F.lit(3)))).otherwise("").alias("city"),
    )
