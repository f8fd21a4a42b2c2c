"""Operator 9: URL rules, and the empirical-Bayes reputation of hosts where no rule fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import cut, read

#: (verdict, host and path) of the rules that the query applies.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Second-level labels that are part of a suffix before a country's two letters, and patterns over a host that use them.
SECOND = ("ac", "co", "com", "edu", "go", "gob", "gov", "mil", "ne", "net", "nom", "or", "org", "sch")
BARE = r"^.*@|:[0-9]*$|\.+(:[0-9]*)?$"
ADDRESS = r"^([0-9.]+|\[.*)$"
DOMAIN = r"(?:^|\.)([^.]*(?:\.(?:{0})\.[a-z][a-z]|\.[^.]*)?)$"
SUFFIX = r"(?:^|\.)((?:{0})\.[a-z][a-z]|[^.]*)$"
#: Pseudo-pages of a prior where no spread can be seen.
STRENGTH = 8.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an absolute URL; both empty for null or a text without `://`."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.regexp_extract(url, URL, 2)


def match_rules(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. A rule fits its host and all subdomains of it.

    The rules are a short list (up to some thousands) and become part of the expression.
    """
    fits = []
    for verdict, rule in rules:
        at = rule.index("/")
        fit = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    best = fits[0] if len(fits) == 1 else F.greatest(*fits)
    return best


def levels(host: Column, second: tuple[str, ...] = SECOND) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user, port and final dots. The suffix is the last label, or the last two where
    one of `second` stands before a country's two letters; the domain has a label more. An address is its own domain, of suffix ''."""
    bare = F.regexp_replace(host, BARE, "")
    own = bare.rlike(ADDRESS)
    two = "|".join(second)
    domain, suffix = F.regexp_extract(bare, DOMAIN.format(two), 1), F.regexp_extract(bare, SUFFIX.format(two), 1)
    return F.when(own, bare).otherwise(domain), F.when(own, "").otherwise(suffix)


def _strength(k: str, n: str, m: str) -> Column:
    """The pseudo-pages that a prior of mean m is worth, from how far shares k / n spread around it (moments of the beta-binomial law,
    over all rows); STRENGTH where nothing tells."""
    pq, n = F.col(m) * (1 - F.col(m)), F.col(n)
    off = F.col(k) / n - F.col(m)
    labelled = n > 0
    spread = F.sum(F.when(labelled, n * off * off - pq))
    room = F.sum(F.when(labelled, pq * (n - 1)))
    rho = F.when(room > 0, F.least(F.lit(0.5), F.greatest(F.lit(0.001), spread / room)))
    return F.coalesce(1 / rho - 1, F.lit(STRENGTH))


def _weight(strength: str, n: Column) -> Column:
    """Pseudo-pages of a prior that n labelled pages tell of: never more than these."""
    return F.col(strength) * n / (F.col(strength) + n)


def _above(up: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """What the levels in `up` say without the row's own pages (k bad of n): the mean, each level's shrunk towards the one before it,
    and the labelled pages of the last."""
    k, n = F.col("k"), F.col("n")
    m, pages = (F.col("k0") - k + 1) / (F.col("n0") - n + 2), F.col("n0") - n
    for ks, ns, strength in up:
        w = _weight(strength, pages)
        m, pages = (F.col(ks) - k + w * m + 1) / (F.col(ns) - n + w + 2), F.col(ns) - n
    return m, pages


def reputation(outcomes: DataFrame, second: tuple[str, ...] = SECOND) -> DataFrame:
    """Posterior of each host's share of bad pages: rows (host, mean, sd, labelled).

    outcomes: rows (host, bad), bad 1, 0 or null (not labelled). Counts are pooled from host to registered domain to suffix to all.
    A level's prior is a beta law around the level above, worth as many pseudo-pages as the spread of all its shares tells
    (empirical Bayes, from the top down), but no more than that level has labelled; what a level above says leaves the host's own
    pages out, so none counts twice. Besides, each has the uniform law's two: where nobody labelled anything, all stays uncertain.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    domain, suffix = levels(F.col("host"), second)
    hosts = cut(hosts.withColumns({"domain": domain, "suffix": suffix}))  # read several times
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n2"), F.sum("k").alias("k2"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n2").alias("n1"), F.sum("k2").alias("k1"))
    every = suffixes.agg(F.sum("n1").alias("n0"), F.sum("k1").alias("k0"))  # one row, as those of strengths are

    def around(rows: DataFrame, k: str, n: str, up: list) -> DataFrame:
        rows = rows.withColumns({"k": F.col(k), "n": F.col(n)})
        return rows.withColumn("m", _above(up)[0])

    up: list[tuple[str, str, str]] = []
    at1 = around(suffixes.crossJoin(every), "k1", "n1", up)
    s1 = at1.agg(_strength("k", "n", "m").alias("s1"))
    suffixes = suffixes.crossJoin(every).crossJoin(s1)
    up = [("k1", "n1", "s1")]
    both = domains.join(suffixes, "suffix")
    at2 = around(both, "k2", "n2", up)
    s2 = at2.agg(_strength("k", "n", "m").alias("s2"))
    up = [*up, ("k2", "n2", "s2")]
    hosts = hosts.join(both.crossJoin(s2).drop("suffix"), "domain")
    mean, pages = _above(up)
    at3 = hosts.withColumns({"m": mean, "above": pages})
    s3 = at3.agg(_strength("k", "n", "m").alias("s3"))
    at3 = at3.crossJoin(s3)
    w = _weight("s3", F.col("above"))
    a, b = 1 + F.col("k") + w * F.col("m"), 1 + F.col("n") - F.col("k") + w * (1 - F.col("m"))
    return at3.select("host", (a / (a + b)).alias("mean"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("sd"), F.col("n").alias("labelled"))


def judge(pages: DataFrame, rules=RULES, url_col: str = "url", threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """pages with host, path, rule, verdict and the host's posterior (bad_mean, bad_sd).

    A page under a rule has the rule's verdict, and is a labelled outcome (block: bad) for its host's reputation. Any other
    page is blocked if the lower bound mean - z * sd of its host's share of bad pages exceeds the threshold, else allowed.
    Null or malformed urls have the empty host. Columns of pages of these names are replaced. Repeated rows stay.
    """
    out = ["host", "path", "rule", "verdict", "bad_mean", "bad_sd"]
    pages = pages.drop(*out, "_rule")
    host, path = split_url(F.col(url_col))
    p = pages.withColumns({"host": host, "path": path}).withColumn("_rule", match_rules(F.col("host"), F.col("path"), rules))
    known = reputation(p.select("host", F.when(F.col("_rule.verdict") == "block", 1).when(F.col("_rule.verdict") == "allow", 0).alias("bad")))
    known = known.select("host", F.col("mean").alias("bad_mean"), F.col("sd").alias("bad_sd"))
    own = F.when(F.col("bad_mean") - z * F.col("bad_sd") > threshold, "block").otherwise("allow")
    return p.join(known, "host", "left").select(*pages.columns, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", own).alias("verdict"), "bad_mean", "bad_sd")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return judge(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op9_url_filters": op9_url_filters}

ORACLE = {
    "op9_url_filters": r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(verdict, rule, rh, rp) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
  ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
m AS (SELECT u.*, (SELECT max(struct_pack(n := length(r.rule), rule := r.rule, verdict := r.verdict)) FROM r
  WHERE (u.host = r.rh OR ends_with(u.host, '.' || r.rh)) AND starts_with(u.path, r.rp)) AS x FROM u),
l AS (SELECT host, CASE x.verdict WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS bad FROM m),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::DOUBLE AS k, regexp_replace(host, '^.*@|:[0-9]*$|\.+(:[0-9]*)?$', '', 'g') AS bare FROM l GROUP BY host),
h AS (SELECT host, n, k, CASE WHEN regexp_matches(bare, '^([0-9.]+|\[.*)$') THEN bare ELSE regexp_extract(bare, '(?:^|\.)([^.]*(?:\.(?:SECOND)\.[a-z][a-z]|\.[^.]*)?)$', 1) END AS dom,
  CASE WHEN regexp_matches(bare, '^([0-9.]+|\[.*)$') THEN '' ELSE regexp_extract(bare, '(?:^|\.)((?:SECOND)\.[a-z][a-z]|[^.]*)$', 1) END AS suf FROM h0),
d AS (SELECT suf, dom, sum(n) AS n2, sum(k) AS k2 FROM h GROUP BY 1, 2),
s AS (SELECT suf, sum(n2) AS n1, sum(k2) AS k1 FROM d GROUP BY 1),
g AS (SELECT sum(n1) AS n0, sum(k1) AS k0 FROM s),
a1 AS (SELECT s.*, g.*, n1 AS n, k1 AS k, (k0 - k1 + 1) / (n0 - n1 + 2) AS m FROM s, g),
s1 AS (SELECT STRENGTH AS s1 FROM a1),
a2 AS (SELECT d.*, n1, k1, n0, k0, s1, n2 AS n, k2 AS k, (k1 - k2 + s1 * (n0 - n2) / (s1 + n0 - n2) * (k0 - k2 + 1) / (n0 - n2 + 2) + 1) / (n1 - n2 + s1 * (n0 - n2) / (s1 + n0 - n2) + 2) AS m FROM d JOIN s USING (suf), g, s1),
s2 AS (SELECT STRENGTH AS s2 FROM a2),
a3 AS (SELECT host, n, k, n2 - n AS up, (k2 - k + w * m1 + 1) / (n2 - n + w + 2) AS m FROM (SELECT *, s2 * (n1 - n) / (s2 + n1 - n) AS w FROM (SELECT h.host, h.n, h.k, k2, n2, n1, s2,
  (k1 - h.k + s1 * (n0 - h.n) / (s1 + n0 - h.n) * (k0 - h.k + 1) / (n0 - h.n + 2) + 1) / (n1 - h.n + s1 * (n0 - h.n) / (s1 + n0 - h.n) + 2) AS m1 FROM h JOIN a2 USING (suf, dom), s2))),
s3 AS (SELECT STRENGTH AS s3 FROM a3),
ab AS (SELECT host, 1 + k + s3 * up / (s3 + up) * m AS a, 1 + n - k + s3 * up / (s3 + up) * (1 - m) AS b FROM a3, s3),
post AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM ab)
SELECT page_id, m.host, path, x.rule AS rule, coalesce(x.verdict, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM m LEFT JOIN post USING (host)""".replace("SECOND", "|".join(SECOND)).replace("STRENGTH AS", "coalesce(1 / (CASE WHEN sum(m * (1 - m) * (n - 1)) FILTER (n > 0) > 0 THEN least(0.5, greatest(0.001, sum(n * (k / n - m) * (k / n - m) - m * (1 - m)) FILTER (n > 0) / sum(m * (1 - m) * (n - 1)) FILTER (n > 0))) END) - 1, 8.0)::DOUBLE AS")
}
