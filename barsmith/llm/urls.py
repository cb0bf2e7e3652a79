"""URL filters by a temporal list join.

A list changes over time: dated entries add a pattern to it or take it off. The entries of a pattern, in
order of date, become validity intervals [added, taken off), and every capture of a page is judged by the
intervals that hold at the time of its fetch, not by the list of today.

A pattern is a host (it covers the host and all hosts below it), or a host and the start of a path. Hosts are compared
in lower case, paths as they are. The join is by host and start of path: the distinct hosts of the captures are expanded
to the hosts above them and joined with the list, which gives each listed host the lengths of the paths listed under
it; a capture asks for its path cut to each of those lengths, so the join is by equality however many paths a
host has on the list. The as-of test is made on what meets.

No key is hot. A host above so many others that it holds more than a ``SHARE``-th of them (a "com") is looked up in the list by
itself: there are at most ``SHARE`` such, a table that may be broadcast, and what is not listed of it is dropped before
hosts and list meet. In the same way hosts with more than a ``SHARE``-th of all captures are dealt out in parts, and only what they
are joined with is repeated for each part. Only DataFrame functions.

Nulls: a null or unparsable URL has no host and matches nothing; a null fetch date matches nothing; list entries with a
null pattern, date or action are left out. URLs may be very long; they are read whole. Entries of one pattern and day count in the order remove, add (so the
add wins). Rows that repeat are judged each. Empty tables give an empty result, an empty list blocks nothing. Only
the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.llm.common import table, written

#: A key with more than this part of all rows is heavy; so there are no more heavy keys than this.
SHARE = 256
#: (pattern, category, day, action). The list of the query.
ENTRIES = (
    ("casino-win.example.com", "gambling", "2024-01-10", "add"),
    ("casino-win.example.com", "gambling", "2024-05-01", "remove"),
    ("casino-win.example.com", "gambling", "2024-08-15", "add"),
    ("free-bets.example.com", "gambling", "2024-02-01", "add"),
    ("ads-track.example.com", "tracking", "2023-11-30", "add"),
    ("ads-track.example.com", "tracking", "2024-06-01", "remove"),
    ("spam-farm.example.com", "spam", "2024-03-15", "add"),
    ("spam-farm.example.com", "spam", "2024-03-15", "remove"),
    ("cheap-pills.example.com", "pharmacy", "2024-01-01", "add"),
    ("cheap-pills.example.com", "pharmacy", "2024-12-01", "remove"),
    ("adult-x.example.net", "adult", "2023-01-01", "add"),
    ("tionsh.example.com/es/", "language", "2024-04-01", "add"),
    ("tionsh.example.com/es/", "language", "2024-09-01", "remove"),
    ("tionble.example.org/en/5", "topic", "2024-07-01", "add"),
)


def entries(spark) -> DataFrame:
    return spark.createDataFrame(list(ENTRIES), "pattern string, category string, day string, action string").withColumn("day", F.to_date("day"))


def _pattern() -> Column:
    """The host of a pattern in lower case, its path as it is."""
    return F.concat(F.lower(F.regexp_extract("pattern", "^([^/]*)", 1)), F.regexp_extract("pattern", "^[^/]*(/.*)$", 1))


def intervals(listed: DataFrame) -> DataFrame:
    """host, path, category, valid_from, valid_to: when each pattern is on the list; valid_to is null while it stays."""
    w = Window.partitionBy("pattern").orderBy("day", F.desc("action"))
    events = listed.where("pattern is not null and day is not null and action in ('add', 'remove')").select(_pattern().alias("pattern"), "category", "day", "action")
    spans = events.withColumn("until", F.lead("day").over(w)).where("action = 'add' and (until is null or until > day)")
    path = F.regexp_extract("pattern", "^[^/]*(/.*)$", 1)
    return spans.select(F.regexp_extract("pattern", "^([^/]*)", 1).alias("host"), path.alias("path"), "category", F.col("day").alias("valid_from"), F.col("until").alias("valid_to"))


def host_of(url: Column) -> Column:
    """The host of an absolute URL in lower case, without user, port or a final dot; null if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), "[.]$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def above(host: Column) -> Column:
    """The host and all hosts above it."""
    labels = F.split(host, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def heavy(counts: DataFrame, key: str, n: str) -> DataFrame:
    """(key, parts): keys with more than a SHARE-th of all ``n``, and in how many parts to deal each. At most SHARE rows."""
    whole = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("all")).scalar()
    rows = counts.withColumn("parts", F.ceil(F.col(n) * SHARE / whole).cast("int"))
    return rows.where((F.col(n) * SHARE > whole) & (F.col("parts") > 1)).select(key, "parts")


def _in_parts(rows: DataFrame) -> DataFrame:
    """A row for each of its ``parts`` (null: one), numbered by ``part``."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def _dealt(rows: DataFrame, by: Column) -> DataFrame:
    """The part of ``parts`` (null: one) that a row goes to by a hash."""
    return rows.withColumn("part", F.pmod(by, F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")


def judge(captures: DataFrame, listed: DataFrame, *, id_col: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """(page_id, host, fetched, blocked, categories, n_entries): the entries that cover the URL and hold on the day of its fetch."""
    url_ = F.col(url)
    rows = captures.select(F.col(id_col).alias("page_id"), host_of(url_).alias("host"), path_of(url_).alias("path"), F.col(fetched).alias("fetched"))
    rows = rows.withColumn("_k", F.xxhash64(F.col("page_id").isNull(), "page_id", "host", "path", "fetched"))
    spans = intervals(listed).withColumnRenamed("host", "on").withColumnRenamed("path", "start")
    # a host's paths may be many, their lengths are bounded by that of a URL
    lengths = spans.groupBy("on").agg(F.collect_set(F.length("start")).alias("lengths"))
    hosts = written(rows.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n")), "url-hosts")
    under = hosts.select("host", F.explode(above(F.col("host"))).alias("on"))
    wide = written(heavy(under.groupBy("on").agg(F.count(F.lit(1)).alias("n")), "on", "n").join(lengths, "on", "left"), "url-wide")
    wide_ = F.broadcast(wide.select("on", "parts", F.col("lengths").isNotNull().alias("listed")))
    under = under.join(wide_, "on", "left").where("parts is null or listed").drop("listed")
    busy = written(heavy(hosts, "host", "n"), "url-busy")
    few = _in_parts(lengths.join(F.broadcast(wide.select("on", "parts")), "on", "left"))
    asked = _dealt(under, F.xxhash64("host")).join(few, ["on", "part"]).groupBy("host").agg(F.collect_list(F.struct("on", "lengths")).alias("asks"))
    asked = written(asked.join(F.broadcast(busy), "host", "left"), "url-asks")
    dealt = _dealt(rows.where("fetched is not null").join(F.broadcast(busy), "host", "left"), F.col("_k"))
    met = dealt.join(_in_parts(asked), ["host", "part"]).withColumn("ask", F.explode("asks"))
    met = met.select("_k", "path", "fetched", "part", "ask.on", F.explode("ask.lengths").alias("n")).where(F.col("n") <= F.length("path"))
    # entries of what busy hosts are under, once for each part of the busiest of them
    wanted = asked.select("parts", F.explode("asks.on").alias("on")).where("parts > 1").groupBy("on").agg(F.max("parts").alias("parts"))
    spans = _in_parts(spans.join(wanted, "on", "left"))
    met = met.withColumn("start", F.substring("path", F.lit(1), F.col("n"))).join(spans, ["on", "start", "part"])
    now = met.where((F.col("valid_from") <= F.col("fetched")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("fetched"))))
    # rows that repeat meet the same spans, so a span counts once for all of them
    found = now.groupBy("_k").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.count_distinct("on", "start", "valid_from", F.coalesce("category", F.lit(""))).alias("n_entries"))
    judged = rows.join(found, "_k", "left")
    return judged.select("page_id", "host", "fetched", F.col("n_entries").isNotNull().alias("blocked"), F.coalesce("categories", F.lit("")).alias("categories"), F.coalesce("n_entries", F.lit(0)).cast("bigint").alias("n_entries"))


def op6_url_filter(spark, sf_dir):
    """All ``pages`` against ENTRIES. The table has no fetch date, so a page's is its id's day of the year 2024."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched"))
    return judge(pages, entries(spark)).withColumn("fetched", F.date_format("fetched", "yyyy-MM-dd"))


#: The same as one join by pattern and date for each capture.
ORACLE = r"""
with e(pattern, category, day, action) as (values
""" + ",\n".join(f"  ('{p}', '{c}', date '{d}', '{a}')" for p, c, d, a in ENTRIES) + r"""),
p as (select page_id, date '2024-01-01' + cast(page_id % 366 as integer) as f, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#@]*@)?([^/:?#]+)', 2)), '') as host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) as path from pages),
h as (select p.page_id, e.pattern, e.category, arg_max(e.action, (e.day, case e.action when 'add' then 1 else 0 end)) as state
  from p join e on e.day <= p.f
    and (p.host = split_part(e.pattern, '/', 1) or ends_with(p.host, '.' || split_part(e.pattern, '/', 1)))
    and (strpos(e.pattern, '/') = 0 or starts_with(p.path, substr(e.pattern, strpos(e.pattern, '/'))))
  group by all),
m as (select page_id, string_agg(distinct category, ',' order by category) as c, count(*) as n from h where state = 'add' group by page_id)
select p.page_id, p.host, strftime(p.f, '%Y-%m-%d') as fetched, m.n is not null as blocked, coalesce(m.c, '') as categories, coalesce(m.n, 0) as n_entries
from p left join m on p.page_id = m.page_id
"""
