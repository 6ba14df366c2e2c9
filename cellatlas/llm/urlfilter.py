"""URL filters by a temporal list join, with DataFrame functions only.

A list is a log of dated entries: at ``effective`` a domain is added to, or dropped from, a named list. The log becomes
validity intervals [from, to); a capture is blocked if, when it was fetched, an interval of its host or of one of the
host's parent domains was in force.

Scale: the join is not made per capture. Distinct hosts (pre-aggregated before the shuffle, so a host with a third of
the captures is one row per task) are expanded into their parent domains and joined with the intervals; what a host
gathers is bounded by its labels times the revisions of those entries. Captures then meet the few hosts that are on
some list in one join, which Spark broadcasts only below its size threshold and splits when skewed, and the as-of test
is an array filter inside the row: nothing is grouped by capture.

Edge cases: a null or unparsable URL has a null host and is not blocked; a null fetch time matches only intervals
without a start (``effective`` null: in force from the beginning). Entries with equal list, domain and time: a drop wins
over an add. Repeated entries change nothing. Empty tables give empty or unblocked results. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"

# The dated entries (list, domain, day, action) that the registered query applies.
ENTRIES = (
    ("adult", "adult-x.example.net", "2023-03-01", "add"),
    ("adult", "adult-x.example.net", "2023-11-15", "drop"),
    ("adult", "adult-x.example.net", "2024-02-01", "add"),
    ("gambling", "casino-win.example.com", "2023-01-01", "add"),
    ("gambling", "m.casino-win.example.com", "2023-06-01", "add"),
    ("gambling", "casino-win.example.com", "2024-06-01", "drop"),
    ("malware", "tionsh.example.com", "2023-07-10", "add"),
    ("malware", "tionsh.example.com", "2023-07-24", "drop"),
    ("spam", "spam-farm.example.com", "2023-02-01", "add"),
    ("spam", "ththon.example.org", "2023-09-01", "add"),
    ("spam", "ththon.example.org", "2023-09-01", "drop"),
    ("spam", "tionble.example.org", "2024-04-01", "add"),
)
#: The made-up pages carry no fetch time: page p was fetched p modulo DAYS days after FIRST_DAY.
FIRST_DAY, DAYS = "2023-01-01", 730


def host(url: Column) -> Column:
    """Lower-case host without user, port or closing dot; null where there is none."""
    found = F.rtrim(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit("."))
    return F.when(found != "", found)


def intervals(entries: DataFrame) -> DataFrame:
    """Dated entries (list, domain, effective, action) to (list, domain, since, until); until null: still in force."""
    log = entries.select("list", F.lower("domain").alias("domain"), "effective", F.col("action") != "drop")
    log = log.toDF("list", "domain", "effective", "listed").where("list IS NOT NULL AND domain IS NOT NULL")
    state = log.groupBy("list", "domain", "effective").agg(F.min("listed").alias("listed"))
    w = Window.partitionBy("list", "domain").orderBy(F.col("effective").asc_nulls_first())
    spans = state.select("list", "domain", F.col("effective").alias("since"), F.lead("effective").over(w).alias("until"), "listed")
    return spans.where("listed").drop("listed")


def parents(name: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def filter_urls(captures: DataFrame, entries: DataFrame, *, url_col: str = "url", time_col: str = "fetched", keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns, host, fetched, blocked, lists (names in order, joined by commas), domain (the longest that
    matched) and since (of that entry) for each capture."""
    rows = captures.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], host(F.col(url_col)).alias("host"), F.col(time_col).alias("fetched"))
    hosts = rows.where("host IS NOT NULL").select("host").distinct()
    spans = intervals(entries)
    hits = hosts.select("host", F.explode(parents(F.col("host"))).alias("domain")).join(spans, "domain")
    listed = hits.groupBy(F.col("host").alias("listed_host")).agg(F.collect_list(F.struct("list", "domain", "since", "until")).alias("spans"))
    joined = rows.join(listed, rows["host"] == listed["listed_host"], "left")

    def in_force(s: Column) -> Column:
        begun = s["since"].isNull() | F.coalesce(s["since"] <= F.col("fetched"), F.lit(False))
        return begun & F.coalesce(s["until"].isNull() | (F.col("fetched") < s["until"]), s["since"].isNull())

    active = F.coalesce(F.filter("spans", in_force), F.array().cast("array<struct<list:string,domain:string,since:date,until:date>>"))
    best = F.array_sort(F.transform("active", lambda s: F.struct((-F.length(s["domain"])).alias("n"), s["since"].alias("since"), s["domain"].alias("domain"))))
    joined = joined.withColumn("active", active).withColumn("best", F.get(best, 0))
    return joined.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "host", "fetched", (F.size("active") > 0).alias("blocked"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("active", lambda s: s["list"]))), ",").alias("lists"), F.col("best.domain").alias("domain"), F.col("best.since").alias("since"),
    )


def entries_frame(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(ENTRIES), "list string, domain string, effective string, action string")
    return rows.withColumn("effective", F.to_date("effective"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id"), F.lit(DAYS)).cast("int"))
    return filter_urls(pages.withColumn("fetched", fetched), entries_frame(spark), keep=("page_id",))


ORACLE = f"""
WITH e(list, domain, effective, action) AS (VALUES {", ".join(f"('{a}', '{b}', DATE '{c}', '{d}')" for a, b, c, d in ENTRIES)}),
 st AS (SELECT list, domain, effective, min(CAST(action <> 'drop' AS INT)) AS listed FROM e GROUP BY ALL),
 sp AS (SELECT list, domain, effective AS since, lead(effective) OVER (PARTITION BY list, domain ORDER BY effective) AS until, listed FROM st),
 c AS (SELECT page_id, nullif(rtrim(lower(regexp_extract(url, '{_HOST}', 1)), '.'), '') AS host,
              CAST(DATE '{FIRST_DAY}' + CAST(((page_id % {DAYS}) + {DAYS}) % {DAYS} AS INT) AS DATE) AS fetched FROM pages),
 h AS (SELECT c.page_id, sp.list, sp.domain, sp.since FROM c JOIN sp ON sp.listed = 1 AND (c.host = sp.domain OR ends_with(c.host, '.' || sp.domain))
        AND sp.since <= c.fetched AND (sp.until IS NULL OR c.fetched < sp.until)),
 b AS (SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, first(domain ORDER BY -length(domain), since, domain) AS domain,
              first(since ORDER BY -length(domain), since, domain) AS since FROM h GROUP BY page_id)
SELECT c.page_id, c.host, c.fetched, b.lists IS NOT NULL AS blocked, coalesce(b.lists, '') AS lists, b.domain, b.since FROM c LEFT JOIN b USING (page_id)
"""
