"""URL filters: rules first, then the reputation of hosts by empirical Bayes, with DataFrame functions only.

Outcomes of labelled pages are summed by host, by registered domain and by suffix. The overall rate is the prior of
suffixes, a suffix's posterior that of its domains, a domain's that of its hosts. How strongly a prior holds is estimated
from the data: the beta-binomial overdispersion at each level, by moments. A host is blocked when even at the upper bound of
its rate its odds of a good page are below `CUT` times those of all pages: what counts as bad depends on how good pages are at
large. What goes to the driver is three numbers a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import aside, back, lower_ascii, settled, without

#: Verdict, host and path of the rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Suffixes of two parts under which names are registered.
TWO_PART = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.mx", "com.ar", "co.in", "co.kr", "co.za", "com.cn", "com.tr")
CUT, Z = 0.5, 1.64
LEAST_RHO, MOST_RHO = 0.001, 0.9
ADDED = ("host", "path", "rule", "reputation", "reputation_bound", "verdict")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(lower_ascii(found), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one name before it. Ports and user names don't count."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    two = F.regexp_extract(bare, r"([^.]+\.(?:" + "|".join(x.replace(".", r"\.") for x in TWO_PART) + r"))$", 1)
    one = F.regexp_extract(bare, r"([^.]+\.[^.]+)$", 1)
    return F.when(two != "", two).when(one != "", one).otherwise(bare)


def suffix_of(domain: Column) -> Column:
    return F.regexp_replace(domain, r"^[^.]*\.", "")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as its text; null if none does. A rule fits its host and what ends with a dot and its host."""
    rule = F.lit(None).cast("string")
    for _, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        rule = F.when(((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)), F.lit(h + p)).otherwise(rule)
    return rule


def _rho(stats: DataFrame) -> tuple[float, float]:
    """Overall rate, with one good and one bad page added, and the overdispersion of groups (n, k) by moments."""
    t = stats.where("n > 0").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk")).first()
    if not t.n:
        return 0.5, MOST_RHO
    rate, p = (t.k + 1) / (t.n + 2), t.k / t.n
    spread = t.kk - p * t.k  # the sum of n (k / n - p)^2
    below = p * (1 - p) * (t.n - t.nn / t.n - (t.g - 1))
    return rate, min(MOST_RHO, max(LEAST_RHO, (spread - p * (1 - p) * (t.g - 1)) / below)) if below > 0 else LEAST_RHO


def reputations(pages: DataFrame) -> DataFrame:
    """pages: host and outcome (1 good, 0 bad, null unlabelled). For each host: reputation (posterior mean), reputation_bound (mean
    and Z standard deviations, at most 1), and `bad`: whether the bound's odds are below CUT times the overall ones. Without labelled
    pages no host is bad."""
    hosts = pages.groupBy("host").agg(F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).cast("long").alias("k"))
    hosts = settled(hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain"))), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    (rate, r0), (_, r1), (_, r2) = _rho(suffixes), _rho(domains), _rho(hosts)

    def mean(prior: Column, rho: float) -> Column:
        s = (1 - rho) / rho
        return (prior * s + F.col("k")) / (F.lit(s) + F.col("n"))

    suffixes = suffixes.select("suffix", mean(F.lit(rate), r0).alias("m0"))
    domains = domains.join(suffixes, "suffix").select("domain", mean(F.col("m0"), r1).alias("m1"))
    m = hosts.join(domains, "domain").select("host", mean(F.col("m1"), r2).alias("reputation"), (F.lit((1 - r2) / r2) + F.col("n")).alias("weight"))
    r = F.col("reputation")
    m = m.select("host", "reputation", F.least(F.lit(1.0), r + Z * F.sqrt(r * (1 - r) / (F.col("weight") + 1))).alias("reputation_bound"))
    b = F.col("reputation_bound")
    return m.withColumn("bad", b * (1 - rate) < CUT * rate * (1 - b))


def judged(pages: DataFrame, outcomes: DataFrame | None = None, url: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule, reputation, reputation_bound and verdict (allow or block: the rule's, else the method's).

    outcomes: `url` and `outcome` of labelled pages; without any, only rules block. A row out for each row in. A null url, or
    one without ://, has an empty host and path, no rule, and is judged as the host of that name. Columns of the names
    added are replaced. The hosts' table is joined by host, with a hot host's rows split by the engine.
    """
    names = without(pages, ADDED).columns
    pages = pages.select(*aside(pages, names), host_of(pages[f"`{url}`"]).alias("host"), path_of(pages[f"`{url}`"]).alias("path"))
    known = pages.select("host", F.lit(None).cast("int").alias("outcome"))
    if outcomes is not None:
        known = known.unionByName(outcomes.select(host_of(F.col("url")).alias("host"), F.col("outcome").cast("int").alias("outcome")))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    said = F.lit(None).cast("string")
    for verdict, h, p in rules:
        said = F.when(F.col("rule") == h + p, F.lit(verdict)).otherwise(said)
    done = pages.join(reputations(known), "host", "left").withColumn("rule", rule)
    return done.select(*back(names), "host", "path", "rule", "reputation", "reputation_bound", F.coalesce(said, F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of pages whose path names a labelled document (/language/number): its quality."""
    named = pages.select("url", F.expr("try_cast(nullif(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1), '') AS BIGINT)").alias("doc_id"))
    good = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("outcome"))
    return named.where(F.col("doc_id").isNotNull()).join(good, "doc_id").select("url", "outcome")


def sql() -> str:
    """The whole of it in DuckDB's SQL, over `pages` and `labels`."""
    two = "|".join(x.replace(".", r"\.") for x in TWO_PART)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    says = " ".join(f"WHEN '{h + p}' THEN '{v}'" for v, h, p in RULES)

    def level(name: str, of: str) -> str:
        return f"""{name}t AS (SELECT count(*) AS g, sum(n) AS n, sum(k) AS k, sum(n * n) AS nn, sum(k * k / CAST(n AS DOUBLE)) AS kk FROM {of} WHERE n > 0),
{name}r AS (SELECT CASE WHEN coalesce(n, 0) = 0 THEN {MOST_RHO} WHEN k / n * (1 - k / n) * (n - nn / n - (g - 1)) > 0 THEN least({MOST_RHO}, greatest({LEAST_RHO},
(kk - k / n * k - k / n * (1 - k / n) * (g - 1)) / (k / n * (1 - k / n) * (n - nn / n - (g - 1))))) ELSE {LEAST_RHO} END AS rho, CASE WHEN coalesce(n, 0) = 0 THEN 0.5 ELSE (k + 1) / (n + 2) END AS rate
FROM (SELECT CAST(g AS DOUBLE) AS g, CAST(n AS DOUBLE) AS n, CAST(k AS DOUBLE) AS k, CAST(nn AS DOUBLE) AS nn, kk FROM {name}t))"""

    return rf"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{upper}', '{lower}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
TRY_CAST(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) AS BIGINT) AS doc_id FROM pages),
l AS (SELECT doc_id, max(quality) AS outcome FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, count(outcome) AS n, coalesce(sum(outcome), 0) AS k, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM p LEFT JOIN l USING (doc_id) GROUP BY host),
hd AS (SELECT host, n, k, CASE WHEN regexp_extract(bare, '([^.]+\.({two}))$', 1) <> '' THEN regexp_extract(bare, '([^.]+\.({two}))$', 1) WHEN regexp_extract(bare, '([^.]+\.[^.]+)$', 1) <> '' THEN regexp_extract(bare, '([^.]+\.[^.]+)$', 1) ELSE bare END AS domain FROM h),
hs AS (SELECT *, regexp_replace(domain, '^[^.]*\.', '') AS suffix FROM hd),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hs GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
{level("s", "s")},
{level("d", "d")},
{level("h", "hs")},
ms AS (SELECT suffix, (rate * ((1 - rho) / rho) + k) / ((1 - rho) / rho + n) AS m0 FROM s, sr),
md AS (SELECT domain, (m0 * ((1 - rho) / rho) + k) / ((1 - rho) / rho + n) AS m1 FROM d JOIN ms USING (suffix), dr),
mh AS (SELECT host, sr.rate AS rate, (m1 * ((1 - hr.rho) / hr.rho) + k) / ((1 - hr.rho) / hr.rho + n) AS m2, (1 - hr.rho) / hr.rho + n AS w FROM hs JOIN md USING (domain), hr, sr),
mb AS (SELECT host, rate, least(1.0, m2 + {Z} * sqrt(m2 * (1 - m2) / (w + 1))) AS b FROM mh)
SELECT page_id, host, path, rule, CASE rule {says} ELSE CASE WHEN b * (1 - rate) < {CUT} * rate * (1 - b) THEN 'block' ELSE 'allow' END END AS verdict
FROM (SELECT *, CASE {cases} END AS rule FROM p) JOIN mb USING (host)
"""
