"""URL filters with dated lists: entries become validity intervals, and captures are joined to those active at fetch time.

An entry says that from a day on a key is blocked, allowed, or off the list. Keys are a host, a domain above it, or a host and the first
parts of a path, as many as it likes. Per list and key, an entry holds until the next one. Intervals are cut at the borders of periods of PERIOD days, so that
a capture meets, by an equal key and period, only what is active near its day, and the as-of condition is the rest of the join: a key with
very many entries, or very many captures, is many small groups. Of what is active the longest key decides, and of equal ones, blocking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PERIOD = 32
_URL = r"^(?i)[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)(?::\d*)?([^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(url, _URL, 1))


def keys_of(url: Column, deepest: int) -> Column:
    """array<string>: host, the domains above it of two labels or more, and the host with the first parts of the path, one up to deepest."""
    host, parts = F.split(host_of(url), r"\."), F.filter(F.split(F.regexp_extract(url, _URL, 2), "/"), lambda p: p != "")
    n = F.size(host)
    above = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(host, i, n), "."))
    paths = F.transform(F.filter(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(deepest))), lambda k: k > 0), lambda k: F.concat_ws("/", host_of(url), F.array_join(F.slice(parts, F.lit(1), k), "/")))
    return F.when(F.coalesce(host_of(url), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(above, paths)))


def intervals(entries: DataFrame, last: Column) -> DataFrame:
    """(list, key, action, listed_on, until, period): an entry holds from listed_on up to, without, until, and has a row for each period up to the day last.

    Of entries of one list, key and day, the last action by name holds; rows that repeat are one. Entries without key, day or action are none.
    """
    good = entries.select("list", "key", "action", "listed_on").dropna(subset=["key", "action", "listed_on"])
    day = good.groupBy("list", "key", "listed_on").agg(F.max("action").alias("action"))
    held = day.withColumn("until", F.lead("listed_on").over(W.partitionBy("list", "key").orderBy("listed_on"))).filter("action != 'off'")
    to = F.least(F.coalesce(F.date_sub("until", 1), last), last)
    number = lambda d: F.floor(F.unix_date(d) / PERIOD)
    return held.filter(F.col("listed_on") <= to).withColumn("period", F.explode(F.sequence(number(F.col("listed_on")), number(to))))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures' page_id, url, fetched_on with verdict (block, allow or none), matched_key, list, listed_on.

    captures: page_id, url, fetched_on date. Rows that repeat are evaluated once and given back as often as they came. A null or odd URL, or a
    null day, meets no entry. No captures give no rows, no entries only verdicts of none. Other columns aren't read.
    """
    same = captures.select("page_id", "url", "fetched_on").groupBy("page_id", "url", "fetched_on").agg(F.count("*").alias("times"))
    deepest = entries.agg(F.max(F.size(F.split("key", "/")) - 1).alias("n")).first()["n"] or 0
    wanted = same.select("page_id", "url", "fetched_on", F.explode(keys_of(F.col("url"), deepest)).alias("key"), F.floor(F.unix_date("fetched_on") / PERIOD).alias("period")).dropna(subset=["fetched_on"])
    spread = same.agg(F.max("fetched_on").alias("last")).first()["last"]
    active = intervals(entries, F.lit(spread).cast("date"))
    hit = wanted.join(active, ["key", "period"]).filter((F.col("listed_on") <= F.col("fetched_on")) & (F.col("until").isNull() | (F.col("until") > F.col("fetched_on"))))
    rank = F.struct(F.length("key").alias("n"), F.col("action"), F.col("list"), F.col("key"), F.col("listed_on"))  # block comes after allow
    best = hit.groupBy("page_id", "url", "fetched_on").agg(F.max(rank).alias("best"))
    on = [F.col(f"s.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("page_id", "url", "fetched_on")]
    out = same.alias("s").join(best.alias("b"), on, "left").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select("s.page_id", "s.url", "s.fetched_on", F.coalesce("best.action", F.lit("none")).alias("verdict"), F.col("best.key").alias("matched_key"), F.col("best.list").alias("list"), F.col("best.listed_on").alias("listed_on"))


FIRST = "2024-01-01"


def fetched(pages: DataFrame) -> DataFrame:
    """Captures of pages: the table has no fetch time, so a page's is a day of 2024 by its number. A page without a number has no day, and meets no entry."""
    return pages.select("page_id", "url", F.date_add(F.lit(FIRST).cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched_on"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """Dated entries by a rule on the URLs that occur, more than there are pages: hosts are blocked and taken off again, domains allowed and blocked, language folders
    allowed, and each URL's whole path is blocked and allowed again or, a part deeper, blocked to no effect. URLs without a host, and null ones, have none; equal ones have theirs once."""
    day = lambda n: F.date_add(F.lit(FIRST).cast("date"), n.cast("int"))
    entry = lambda name, key, action, on: F.struct(F.lit(name).alias("list"), key.alias("key"), F.lit(action).alias("action"), day(on).alias("listed_on"))
    told = lambda df, entries: df.select(F.explode(entries).alias("e")).select("e.*")
    url = pages.select(host_of(F.col("url")).alias("h"), F.array_join(F.filter(F.split(F.regexp_extract("url", _URL, 2), "/"), lambda p: p != ""), "/").alias("path")).filter("h != ''").distinct()
    host = url.select("h").distinct()
    n, domain = F.length("h"), F.substring_index("h", ".", -2)
    of_host = told(host.filter(n % 3 == 0), F.array(entry("hosts", F.col("h"), "block", n * 7 % 120), entry("hosts", F.col("h"), "off", n * 7 % 120 + 90), entry("hosts", F.col("h"), "block", n * 7 % 120 + 200)))
    of_folder = told(host.filter(n % 4 == 1), F.array(entry("folders", F.concat("h", F.lit("/en")), "allow", n % 60)))
    m = F.length("d")
    of_domain = told(host.select(domain.alias("d")).distinct(), F.array(entry("domains", F.col("d"), "allow", m % 30), entry("domains", F.col("d"), "block", m % 30 + 150), entry("domains", F.col("d"), "off", m % 30 + 240)))
    whole = F.concat_ws("/", "h", "path")
    k = F.length(whole)
    of_path = told(url.filter("path != ''"), F.array(entry("paths", whole, "block", k * 11 % 150), entry("paths", whole, "allow", k * 11 % 150 + 130), entry("paths", F.concat(whole, F.lit("/x")), "block", k % 90)))
    return of_host.union(of_folder).union(of_domain).union(of_path)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return evaluate(fetched(pages), dated_entries(pages)).drop("url")


#: The keys are matched as prefixes and suffixes of the URL here, and entries by an as-of condition without periods.
OP10_SQL = r"""
WITH c AS (
  SELECT page_id, url, DATE '2024-01-01' + (((page_id % 366) + 366) % 366)::INTEGER AS fetched_on,
    lower(regexp_extract(url, '^(?i)[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS h,
    regexp_extract(url, '^(?i)[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)(?::\d*)?([^?#]*)', 2) AS p
  FROM pages
), w AS (SELECT *, list_filter(string_split(p, '/'), lambda x: x <> '') AS parts FROM c WHERE h <> ''),
u AS (SELECT DISTINCT h, array_to_string(string_split(h, '.')[-2:], '.') AS d, length(h) AS n FROM w),
x AS (SELECT DISTINCT h || '/' || array_to_string(parts, '/') AS f FROM w WHERE len(parts) > 0), y AS (SELECT f, length(f) AS n FROM x),
e AS (
  SELECT 'hosts' AS list, h AS key, unnest(['block', 'off', 'block']) AS action, DATE '2024-01-01' + unnest([n * 7 % 120, n * 7 % 120 + 90, n * 7 % 120 + 200])::INTEGER AS listed_on FROM u WHERE n % 3 = 0
  UNION SELECT 'folders', h || '/en', 'allow', DATE '2024-01-01' + (n % 60)::INTEGER FROM u WHERE n % 4 = 1
  UNION SELECT 'domains', d, unnest(['allow', 'block', 'off']), DATE '2024-01-01' + unnest([length(d) % 30, length(d) % 30 + 150, length(d) % 30 + 240])::INTEGER FROM u
  UNION SELECT 'paths', unnest([f, f, f || '/x']), unnest(['block', 'allow', 'block']), DATE '2024-01-01' + unnest([n * 11 % 150, n * 11 % 150 + 130, n % 90])::INTEGER FROM y
), i AS (SELECT *, lead(listed_on) OVER (PARTITION BY list, key ORDER BY listed_on) AS until FROM e),
k AS (
  SELECT page_id, fetched_on, unnest(list_distinct([array_to_string(string_split(h, '.')[j:], '.') for j in range(1, greatest(len(string_split(h, '.')), 2))])) AS key FROM w
  UNION ALL SELECT page_id, fetched_on, unnest([h || '/' || array_to_string(parts[1:j], '/') for j in range(1, len(parts) + 1)]) FROM w
), m AS (
  SELECT k.page_id, i.*, row_number() OVER (PARTITION BY k.page_id ORDER BY length(i.key) DESC, i.action DESC, i.list DESC, i.key DESC, i.listed_on DESC) AS r
  FROM k JOIN i ON i.key = k.key AND i.listed_on <= k.fetched_on AND (i.until IS NULL OR i.until > k.fetched_on) WHERE i.action <> 'off'
)
SELECT c.page_id, c.fetched_on, coalesce(m.action, 'none') AS verdict, m.key AS matched_key, m.list, m.listed_on
FROM c LEFT JOIN m ON m.page_id = c.page_id AND m.r = 1
"""
