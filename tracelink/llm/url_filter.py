"""URL filter rules by a sort-merge range join, with DataFrame functions only.

A rule (host, path, verdict) fits a url if the url's host is the rule's or below it and the url's path starts
with the rule's. Among the rules' hosts only a few label counts occur. For each such count n, the url's key is
its last n host labels reversed, "/" and its path; a rule with n labels then is an interval of keys, and two
intervals are nested or apart. The rules' end points, sorted, drive a stack of active rules; each end point
carries the top of the stack after it. Urls and end points are sorted together and each url takes what the
last end point before it carries.

Every sorted run (one for each salt) holds all end points, 2 * rules rows, and an even share of the urls
whatever their hosts are, so a hot host is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: (host, path, verdict) as the contract gives them.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DEFAULT_VERDICT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str):
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str):
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(labels, n: int, path):
    """Null where the host has fewer than n labels."""
    last = F.slice(F.reverse(labels), 1, n)
    return F.when(F.size(labels) >= n, F.concat(F.array_join(last, "."), F.lit("/"), path))


def endpoints(spark: SparkSession, rules=RULES) -> DataFrame:
    """n, pos, key, top: sorted end points of the rules with n host labels, each with the innermost rule active after it (length -1: none)."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in sorted(set(rules))]
    table = spark.range(1).select(F.inline(F.array(*rows)))
    labels = F.split("host", r"\.")
    low = F.concat(F.array_join(F.reverse(labels), "."), F.lit("/"), F.col("path"))
    last = F.ascii(F.substring("low", -1, 1))
    above = F.when(last < 127, F.expr("concat(substring(low, 1, length(low) - 1), char(ascii(substring(low, -1, 1)) + 1))")).otherwise(F.concat("low", F.lit("\U0010ffff")))
    rule = F.struct(F.length("path").alias("length"), F.col("verdict"), F.concat("host", "path").alias("rule"))
    table = table.withColumn("n", F.size(labels)).withColumn("low", low).withColumn("above", above).withColumn("is", rule)
    # ends come before starts; of rules that start together the shorter first, and "block" over "allow"
    event = lambda key, opens: F.struct(key.alias("key"), F.lit(opens).alias("opens"), F.col("is"))
    events = table.select("n", F.explode(F.array(event(F.col("low"), True), event(F.col("above"), False))).alias("e"))
    listed = events.groupBy("n").agg(F.array_sort(F.collect_list("e")).alias("events"))
    folded = listed.select("n", F.expr("""
        aggregate(
          events,
          named_struct('stack', slice(transform(events, e -> e.is), 1, 0),
                       'out', slice(transform(events, e -> named_struct('key', e.key, 'top', e.is)), 1, 0)),
          (s, e) -> named_struct(
            'stack', if(e.opens, concat(s.stack, array(e.is)), filter(s.stack, x -> x <> e.is)),
            'out', concat(s.out, array(named_struct('key', e.key, 'top',
              coalesce(try_element_at(if(e.opens, concat(s.stack, array(e.is)), filter(s.stack, x -> x <> e.is)), -1),
                       named_struct('length', -1, 'verdict', '', 'rule', '')))))),
          s -> s.out) as out"""))
    return folded.select("n", F.posexplode("out").alias("pos", "o")).select("n", "pos", "o.key", "o.top")


def url_filter(pages: DataFrame, rules=RULES, url: str = "url", default: str = DEFAULT_VERDICT, salts: int | None = None) -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict; one row for each row of pages.

    The longest fitting rule wins, host and path together; of equally long ones block. A url
    that is null or has no :// has an empty host and path, and gets the default verdict as any url that no rule fits.
    Columns of pages with these four names are replaced.
    """
    spark = pages.sparkSession
    salts = salts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    depths = sorted({h.count(".") + 1 for h, _, _ in rules})
    own = pages.drop("host", "path", "rule", "verdict")
    labels = F.split(F.col("host"), r"\.")
    probes = own.select(F.struct("*").alias("row"), host_of(url).alias("host"), path_of(url).alias("path"))
    probes = probes.select("row", "host", "path", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int").alias("salt"), F.lit(1 << 30).alias("pos"), *[_key(labels, n, F.col("path")).alias(f"k{n}") for n in depths])
    ends = endpoints(spark, rules).select(
        "pos", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
        *[F.when(F.col("n") == n, F.col("key")).alias(f"k{n}") for n in depths],
        *[F.when(F.col("n") == n, F.col("top")).alias(f"e{n}") for n in depths],
    )
    swept = probes.unionByName(ends, allowMissingColumns=True)
    found = []
    for n in depths:
        order = Window.partitionBy("salt").orderBy(F.col(f"k{n}").asc_nulls_first(), "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        top = F.last(f"e{n}", ignorenulls=True).over(order)
        swept = swept.withColumn(f"t{n}", top).withColumn(f"f{n}", F.when(F.col(f"k{n}").isNotNull() & (F.col(f"t{n}.length") >= 0), F.col(f"t{n}")))
        found.insert(0, F.col(f"f{n}"))
    ranked = [F.when(x.isNotNull(), F.struct(F.length(x["rule"]).alias("length"), x["verdict"].alias("verdict"), x["rule"].alias("rule"))) for x in found]
    best = F.greatest(*ranked, F.lit(None)) if len(ranked) > 1 else ranked[0]
    return swept.where("row is not null").select("row.*", "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS row_of_page,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT p.*, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY row_of_page ORDER BY length(rhost || rpath) DESC NULLS LAST, rverdict DESC) AS k
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM m WHERE k = 1
"""
