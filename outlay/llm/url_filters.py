"""URL filters by a temporal list join.

A list is a log of dated entries: a key is added to a list or taken off. Entries become validity intervals, from an
addition to the next entry of the same list and key. A capture has a URL and a fetch time; its candidate keys are its host,
each parent domain, and the host with each leading part of the path, as deep as the deepest key of the entries. A key with a
path belongs to its very host, not to hosts below it. An equal-key join with the interval condition gives the entries active when the capture was fetched: the as-of join of captures and entries.

Intervals hold their start and not their end. Of entries of one list and key at the same time, removals come last; repeated
entries count once; a removal of what is not listed does nothing. Entries with a null key, list, action or date, and
captures with a null URL or fetch time, match nothing; such captures stay with no list. Hosts are lower-cased on both sides,
and empty path parts and closing slashes dropped; user names, ports, queries and fragments are no part of a key. Captures are numbered by their content, so repeated rows are
evaluated alike; other columns are kept in ``row`` under any name. Empty lists leave all captures with no list.

A hot host is a hot join key: captures of it meet the few intervals of that key, and the adaptive join splits it. Only
captures with a match are grouped, by capture, never by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay.llm.common import table

ADD, REMOVE = "add", "remove"


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and trailing dot; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*?)\.?(?::\d*)?(?:[/?#]|$)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?i:[a-z][a-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)", 1)


def _parts(path: Column) -> Column:
    return F.array_remove(F.split(path, "/"), "")


def entry_key(key: Column) -> Column:
    """The key of an entry as captures have it: the host lower-cased, the parts of the path joined by single slashes."""
    host, path = F.lower(F.regexp_extract(key, "^[^/]*", 0)), _parts(F.regexp_extract(key, "/.*$", 0))
    return F.concat_ws("/", host, F.when(F.size(path) > 0, F.array_join(path, "/")))


def candidate_keys(url: Column, depth: Column | None = None) -> Column:
    """Host, parent domains of two labels or more, and host with the first 1 .. depth parts of the path, or with all."""
    labels = F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = _parts(path_of(url))
    count = F.size(parts) if depth is None else F.least(F.size(parts), F.coalesce(depth, F.lit(0)))
    paths = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))))
    return F.when(host_of(url) != "", F.array_distinct(F.concat(domains, F.coalesce(paths, F.array().cast("array<string>")))))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, from, until) of entries (list, key, action, at); until is null while the key stays listed."""
    good = entries.where("list IS NOT NULL AND key IS NOT NULL AND at IS NOT NULL").where(F.col("action").isin(ADD, REMOVE))
    good = good.select("list", entry_key(F.col("key")).alias("key"), "action", "at").distinct()
    w = Window.partitionBy("list", "key").orderBy("at", "action")
    spans = good.withColumn("until", F.lead("at").over(w)).where(F.col("action") == ADD)
    return spans.where("until IS NULL OR until > at").select("list", "key", F.col("at").alias("from"), "until")


def evaluated(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """(row, lists, n_entries): each capture with the lists active for it at fetch time, sorted, and how many entries.

    Additions that follow each other without a removal are one entry after the other: the later one is active.
    """
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in captures.columns]).alias("row"), F.col(f"`{url}`").alias("url"), F.col(f"`{at}`").alias("t"))
    spans = intervals(entries)
    depth = spans.agg(F.max(F.length("key") - F.length(F.replace(F.col("key"), F.lit("/"), F.lit("")))).alias("d")).scalar()
    keyed = rows.select("url", "t").where("url IS NOT NULL AND t IS NOT NULL").distinct().select("url", "t", depth.alias("depth"))
    keyed = keyed.select("url", "t", F.explode(candidate_keys(F.col("url"), F.col("depth"))).alias("key"))
    hits = keyed.join(spans, "key").where((F.col("from") <= F.col("t")) & (F.col("until").isNull() | (F.col("t") < F.col("until"))))
    found = hits.groupBy("url", "t").agg(F.sort_array(F.collect_set("list")).alias("lists"), F.count("*").alias("n_entries"))
    none = F.array().cast("array<string>")
    return rows.join(found, ["url", "t"], "left").select("row", F.coalesce("lists", none).alias("lists"), F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"))


def keep_allowed(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """Captures that no list held at fetch time, with their own columns."""
    return evaluated(captures, entries, url, at).where(F.size("lists") == 0).select("row.*")


# ----- the sample tables as captures and lists -----


def _part(text: Column, place: int) -> Column:
    """A number from 0 to 65,535: four hex digits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), place, 4), 16, 10).cast("long")


def sample_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures: the fetch day within 1,000 days comes from the page's own URL and id."""
    day = F.pmod(_part(F.concat_ws("|", "url", "page_id"), 1), F.lit(1000)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2020-01-01").cast("date"), day).alias("fetched_at"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """A dated list log over the hosts and first path parts of the pages: some are added, taken off and added again."""
    host = host_of(F.col("url"))
    hosts = pages.where("url IS NOT NULL").select(host.alias("key")).distinct().where("key <> ''")
    sections = pages.where("url IS NOT NULL").select(F.concat(host, F.lit("/"), F.get(F.array_remove(F.split(path_of(F.col("url")), "/"), ""), F.lit(0))).alias("key")).distinct().where("key IS NOT NULL")
    keys = hosts.select(F.lit("hosts").alias("list"), "key").unionByName(sections.select(F.lit("sections").alias("list"), "key"))
    keys = keys.where(F.pmod(_part(F.col("key"), 5), F.lit(3)) == 0)
    first = F.pmod(_part(F.col("key"), 9), F.lit(600)).cast("int")
    step = (F.pmod(_part(F.col("key"), 13), F.lit(200)) + 1).cast("int")
    log = F.array(*[F.struct(F.lit(a).alias("action"), (first + step * k).alias("d")) for k, a in enumerate((ADD, REMOVE, ADD))])
    return keys.select("list", "key", F.explode(log).alias("e")).select("list", "key", "e.action", F.date_add(F.lit("2020-01-01").cast("date"), F.col("e.d")).alias("at"))


def op8(spark, sf_dir: str) -> DataFrame:
    """(page_id, host, fetched_at, blocked, lists, n_entries) of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = evaluated(sample_captures(pages), sample_entries(pages))
    return out.select("row.page_id", host_of(F.col("row.url")).alias("host"), "row.fetched_at", (F.size("lists") > 0).alias("blocked"), F.array_join("lists", ",").alias("lists"), "n_entries")


_HOST = r"lower(regexp_extract(url, '^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*?)\.?(?::\d*)?(?:[/?#]|$)', 1))"
_PARTS = r"list_filter(string_split(regexp_extract(url, '^(?i:[a-z][a-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '')"


def _hex(text: str, place: int) -> str:
    return f"CAST('0x' || substr(md5({text}), {place}, 4) AS BIGINT)"


OP8_SQL = f"""
WITH p AS (SELECT page_id, url, {_HOST} AS host, {_PARTS} AS parts,
  DATE '2020-01-01' + CAST({_hex("url || '|' || page_id", 1)} % 1000 AS INTEGER) AS t FROM pages),
k AS (SELECT DISTINCT 'hosts' AS list, host AS key FROM p WHERE host <> '' UNION ALL
  SELECT DISTINCT 'sections', host || '/' || parts[1] FROM p WHERE len(parts) > 0),
e AS (SELECT list, key, DATE '2020-01-01' + CAST({_hex("key", 9)} % 600 AS INTEGER) AS a, CAST({_hex("key", 13)} % 200 + 1 AS INTEGER) AS s
  FROM k WHERE {_hex("key", 5)} % 3 = 0),
i AS (SELECT list, key, a AS f, a + s AS u FROM e UNION ALL SELECT list, key, a + 2 * s, NULL FROM e),
c AS (SELECT DISTINCT page_id, unnest(list_concat(list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1),
    lambda n: array_to_string(string_split(host, '.')[n:], '.')),
  list_transform(range(1, len(parts) + 1), lambda n: host || '/' || array_to_string(parts[1:n], '/')))) AS key, t FROM p WHERE host <> ''),
h AS (SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, count(*) AS n FROM c JOIN i USING (key) WHERE f <= t AND (u IS NULL OR t < u) GROUP BY 1)
SELECT page_id, host, t AS fetched_at, lists IS NOT NULL AS blocked, coalesce(lists, '') AS lists, coalesce(n, 0) AS n_entries FROM p LEFT JOIN h USING (page_id)"""
