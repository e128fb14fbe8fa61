"""Operator 3, temporal list join for URL filters.

Only DataFrame functions.  Dated list entries (a pattern is added or removed on a
day) become validity intervals, by the order of each pattern's events.  A pattern
is a host, which stands for its subdomains too, or a host with a path prefix
ending in a slash.  A capture asks for every suffix of its host and every path
prefix of its URL; it is blocked when one of them is valid on its fetch day.

Many captures ask the same: distinct (pattern, day) pairs are looked up once, as
of their day, and joined back by pattern and day.  A host with a third of all
captures is thereby one look-up a day, and its captures spread over the days.

Defined cases: hosts and paths are compared in lower case; of events on one day
the removal counts; an entry without pattern or day is ignored, so is another
action than add or remove; a capture without URL, host or day is never blocked;
repeated captures are rows of their own; a pattern added twice is valid from the
first day; the longest active pattern (then the least) is reported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path_of(url) -> F.Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))


def asked_patterns(url) -> F.Column:
    """Host suffixes of two labels or more, and path prefixes, as an array."""
    host, labels, parts = host_of(url), F.split(host_of(url), r"\."), F.split(path_of(url), "/")
    suffixes = F.when(F.size(labels) >= 2, F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.when(F.size(parts) >= 2, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(host, F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(suffixes, none), F.coalesce(prefixes, none)))


def intervals(entries: DataFrame) -> DataFrame:
    """``pattern, category, valid_from, valid_to`` (exclusive; null: still valid)."""
    events = (entries.where("pattern is not null and listed_on is not null and action in ('add', 'remove')")
              .withColumn("pattern", F.lower("pattern")).groupBy("pattern", "listed_on")
              .agg(F.max(F.col("action") == "remove").alias("off"), F.min("category").alias("category")))
    order = Window.partitionBy("pattern").orderBy("listed_on")
    # an event counts when it changes the state, which starts as off
    changes = events.withColumn("_before", F.coalesce(F.lag("off").over(order), F.lit(True))).where("off <> _before")
    return (changes.withColumn("valid_to", F.lead("listed_on").over(order)).where("not off")
            .select("pattern", "category", F.col("listed_on").alias("valid_from"), "valid_to"))


def temporal_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``page_id, url, fetched_on, blocked, n_active, pattern, category,
    valid_from`` of every row of ``captures(page_id, url, fetched_on)``."""
    valid = intervals(entries)
    captures = captures.select("page_id", "url", "fetched_on").withColumn("host", host_of("url"))
    # what a URL asks for depends on its host and directory only
    captures = captures.withColumn("place", F.when(F.col("host") != "", F.concat("host", F.regexp_extract(path_of("url"), r"^(.*/)[^/]*$", 1))))
    asked = (captures.where("place is not null and fetched_on is not null").select("place", "fetched_on").distinct()
             .withColumn("pattern", F.explode(asked_patterns(F.concat(F.lit("a://"), F.col("place"))))))
    lookups = asked.select("pattern", "fetched_on").distinct()
    # as-of: the last interval of the pattern that begins on or before the day, unless it has ended
    events = (valid.select("pattern", F.col("valid_from").alias("day"), F.struct("category", "valid_from", "valid_to").alias("entry"), F.lit(False).alias("ask"))
              .unionByName(lookups.select("pattern", F.col("fetched_on").alias("day"), F.lit(None).cast("struct<category:string,valid_from:date,valid_to:date>").alias("entry"), F.lit(True).alias("ask"))))
    order = Window.partitionBy("pattern").orderBy("day", "ask").rowsBetween(Window.unboundedPreceding, 0)
    active = (events.withColumn("entry", F.last("entry", ignorenulls=True).over(order))
              .where("ask and entry is not null and (entry.valid_to is null or entry.valid_to > day)")
              .select("pattern", F.col("day").alias("fetched_on"), "entry"))
    best = F.struct(-F.length("pattern"), F.col("pattern"), F.col("entry.category").alias("category"), F.col("entry.valid_from").alias("valid_from"))
    verdict = asked.join(active, ["pattern", "fetched_on"]).groupBy("place", "fetched_on").agg(F.count(F.lit(1)).cast("int").alias("n_active"), F.min(best).alias("_m"))
    return (captures.join(verdict, ["place", "fetched_on"], "left")
            .select("page_id", "url", "fetched_on", F.col("n_active").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0)).alias("n_active"),
                    F.col("_m.pattern").alias("pattern"), F.col("_m.category").alias("category"), F.col("_m.valid_from").alias("valid_from")))


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages as captures, with fetch days spread over 2024 by their id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("fetched_on"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A block list about the hosts of the pages, dated by their least page id:
    hosts that are listed, delisted and listed again, parent domains, directories."""
    hosts = (pages.select("page_id", host_of("url").alias("host"), F.regexp_extract(path_of("url"), r"^(/[^/]+/)", 1).alias("top"))
             .where("host <> ''").groupBy("host").agg(F.min("page_id").alias("first"), F.min("top").alias("top")))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    first = F.col("first")
    rows = [
        (first % 3 == 0, F.col("host"), "add", day(first % 200), "spam"),
        (first % 6 == 0, F.col("host"), "remove", day(first % 200 + 60), "spam"),
        (first % 12 == 0, F.col("host"), "add", day(first % 200 + 120), "adult"),
        (first % 5 == 1, F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1), "add", day(first % 330), "malware"),
        (first % 4 == 1, F.concat("host", "top"), "add", day(first % 300), "phishing"),
    ]
    return hosts.select(F.explode(F.filter(F.array(*(F.when(rule, F.struct(pattern.alias("pattern"), F.lit(action).alias("action"), on.alias("listed_on"), F.lit(kind).alias("category")))
                                                     for rule, pattern, action, on, kind in rows)), lambda x: x.isNotNull())).alias("e")).select("e.*").where("pattern <> ''")


SQL = r"""
with p as (select page_id, url, (date '2024-01-01' + ((((page_id * 37) % 366) + 366) % 366)::int)::date as fetched_on,
                  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) as host,
                  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) as path from pages),
h as (select host, min(page_id) as f, min(regexp_extract(path, '^(/[^/]+/)', 1)) as top from p where host <> '' group by host),
e as (select host as pattern, 'add' as action, f % 200 as d, 'spam' as category from h where f % 3 = 0
      union all select host, 'remove', f % 200 + 60, 'spam' from h where f % 6 = 0
      union all select host, 'add', f % 200 + 120, 'adult' from h where f % 12 = 0
      union all select regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1), 'add', f % 330, 'malware' from h where f % 5 = 1
      union all select host || top, 'add', f % 300, 'phishing' from h where f % 4 = 1),
v as (select pattern, (date '2024-01-01' + d::int)::date as day, bool_or(action = 'remove') as off, min(category) as category from e where pattern <> '' group by all),
c as (select * from v qualify off <> coalesce(lag(off) over (partition by pattern order by day), true)),
i as (select pattern, category, day as valid_from, off, lead(day) over (partition by pattern order by day) as valid_to from c),
a as (select page_id, url, fetched_on, unnest(list_distinct(
        [array_to_string(string_split(host, '.')[k:], '.') for k in range(1, len(string_split(host, '.')))]
        || [host || array_to_string(string_split(path, '/')[:k], '/') || '/' for k in range(2, len(string_split(path, '/')))])) as pattern
      from p where host <> ''),
m as (select a.page_id, a.url, a.fetched_on, i.pattern, i.category, i.valid_from
      from a join i on a.pattern = i.pattern and not i.off and i.valid_from <= a.fetched_on and (i.valid_to is null or a.fetched_on < i.valid_to)),
b as (select page_id, url, count(*)::int as n_active, first(pattern order by length(pattern) desc, pattern) as pattern,
             first(category order by length(pattern) desc, pattern) as category, first(valid_from order by length(pattern) desc, pattern) as valid_from
      from m group by page_id, url)
select p.page_id, p.url, p.fetched_on, b.n_active is not null as blocked, coalesce(b.n_active, 0)::int as n_active, b.pattern, b.category, b.valid_from
from p left join b on p.page_id = b.page_id and p.url = b.url
"""
