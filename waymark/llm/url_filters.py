"""URL filters: rules by host and path, then the reputation of the host.

Reputation is empirical Bayes: labelled pages of a host are shrunk to its registered domain, that one's to its suffix, that
one's to all labelled pages, each through a beta-binomial prior whose strength is fitted by moments to the spread among the
children of its level. A host is blocked when the upper bound of its posterior rate of good pages stays below a threshold (the
normal approximation of the beta posterior's quantile).

The suffix is the last label of a host, or its last two where a fixed table has them as a public suffix under which anyone may
register; the registered domain is one label more. Ports don't count, and a numeric address is a domain and a suffix by itself.

Null urls and urls without :// have an empty host and path, fit no rule and are judged by the mean of all labelled pages;
so are hosts nobody labelled, by the nearest labelled level. With no labelled page at all the prior is one half at strength
two and nothing is blocked. Repeated urls each keep their row, very long ones are taken whole, other columns don't matter. A host with a third of all rows is a row like any other in
the aggregates; the join that brings scores back is an equi-join that AQE broadcasts or splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, shared_table

#: The rules of the query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MAX_RULES = 1000
#: Public suffixes of two labels, by country and by host of other people's pages.
SUFFIXES = tuple("""
ac.uk co.uk gov.uk ltd.uk me.uk net.uk nhs.uk org.uk plc.uk sch.uk
asn.au com.au edu.au gov.au id.au net.au org.au
ac.nz co.nz geek.nz govt.nz net.nz org.nz school.nz
ac.jp ad.jp co.jp ed.jp go.jp gr.jp lg.jp ne.jp or.jp
ac.kr co.kr go.kr ne.kr or.kr re.kr
ac.za co.za gov.za net.za org.za web.za
ac.in co.in edu.in firm.in gen.in gov.in ind.in net.in nic.in org.in
ac.id co.id go.id or.id sch.id web.id
ac.th co.th go.th in.th or.th
ac.il co.il gov.il net.il org.il
com.br edu.br gov.br net.br org.br
com.ar edu.ar gob.ar net.ar org.ar
com.mx edu.mx gob.mx net.mx org.mx
com.cn edu.cn gov.cn net.cn org.cn
com.hk edu.hk gov.hk net.hk org.hk
com.tw edu.tw gov.tw net.tw org.tw
com.sg edu.sg gov.sg net.sg org.sg
com.my edu.my gov.my net.my org.my
com.tr edu.tr gov.tr net.tr org.tr
com.ua edu.ua gov.ua net.ua org.ua
com.pl edu.pl gov.pl net.pl org.pl
com.es gob.es nom.es org.es
com.co com.pe com.ph com.vn com.eg com.sa com.pk com.ng co.ke co.at or.at
appspot.com azurewebsites.net blogspot.com cloudfront.net firebaseapp.com github.io gitlab.io herokuapp.com
myshopify.com netlify.app onrender.com pages.dev readthedocs.io surge.sh vercel.app web.app wordpress.com workers.dev
""".split())
Z, LEAST_RATE = 1.645, 0.5
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0


def rest_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(rest_of(url), F.lit("")), "^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(rest_of(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def bare(host: Column) -> tuple[Column, Column, Column]:
    """The host without its port, whether that is a numeric address, and whether its last two labels are a public suffix."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    return name, name.rlike(r"^[0-9.]+$"), F.substring_index(name, ".", -2).isin(*SUFFIXES)


def domain_of(host: Column) -> Column:
    name, numeric, long = bare(host)
    return F.when(numeric, name).when(long, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def suffix_of(host: Column) -> Column:
    name, numeric, long = bare(host)
    return F.when(numeric, name).when(long, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"rules are compiled into the plan; {MAX_RULES} at most")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, suffix, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == suffix) | host.endswith(f".{suffix}")) & path.startswith(prefix)
        name, verdict = F.when(fits, suffix + prefix).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def strength(children: DataFrame, parent_mean: Column) -> Column:
    """Moments: what the children's rates spread beyond their own sampling noise, as a prior size."""
    m = parent_mean
    noise = F.sum(m * (1 - m))
    spread = F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - m, 2))
    # E[n (p - m)^2] = m(1-m) (1 + (n-1)/(s+1)), summed over the children
    excess = (spread - noise) / F.sum((F.col("n") - 1) * m * (1 - m))
    s = F.when(excess > 0, 1 / excess - 1).otherwise(MOST_STRENGTH)
    return F.least(F.greatest(F.coalesce(s, F.lit(MOST_STRENGTH)), F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))


def reputation(outcomes: DataFrame) -> DataFrame:
    """outcomes: host string, good int (1 or 0). Rows of levels: (level, key, alpha, beta), for host, domain, suffix, all."""
    hosts = outcomes.where("good is not null").groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("good").cast("double").alias("k"))
    # each level is a table of its own, a row a key; single numbers pass through the driver
    hosts = shared_table(hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "hosts")
    domains = shared_table(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    n, k = suffixes.agg(F.sum("n"), F.sum("k")).first()
    mean = ((k or 0.0) + 1) / ((n or 0.0) + 2)
    one = lambda df: F.lit(df.agg(strength(df, F.col("m")).alias("s")).first()["s"])
    shrunk = lambda df, s: df.withColumn("a", s * F.col("m") + F.col("k")).withColumn("b", s * (1 - F.col("m")) + F.col("n") - F.col("k"))
    up = lambda df, key: df.select(key, (F.col("a") / (F.col("a") + F.col("b"))).alias("m"))
    suffixes = suffixes.withColumn("m", F.lit(mean))
    suffixes = shrunk(suffixes, one(suffixes))
    domains = domains.join(up(suffixes, "suffix"), "suffix")
    domains = shared_table(shrunk(domains, one(domains)), "domains")
    hosts = hosts.join(up(domains, "domain"), "domain")
    hosts = shrunk(hosts, one(hosts))
    level = lambda df, name, key: df.select(F.lit(name).alias("level"), F.col(key).alias("key"), F.col("a").alias("alpha"), F.col("b").alias("beta"))
    all_ = outcomes.sparkSession.sql("select 'all' level, '' key").select("level", "key", F.lit(mean * 2).alias("alpha"), F.lit(2 - mean * 2).alias("beta"))
    return level(hosts, "host", "host").unionByName(level(domains, "domain", "domain")).unionByName(level(suffixes, "suffix", "suffix")).unionByName(all_)


def upper_bound(a: Column, b: Column, z: float = Z) -> Column:
    mean = a / (a + b)
    return mean + z * F.sqrt(mean * (1 - mean) / (a + b + 1))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, least_rate: float = LEAST_RATE) -> DataFrame:
    """pages: page_id, url. Rules first; where none fits, block if even the upper bound of the host's posterior is too low."""
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    p = p.withColumn("_domain", domain_of(F.col("host"))).withColumn("_suffix", suffix_of(F.col("host")))
    levels = shared_table(reputation(outcomes), "levels").withColumn("bad", upper_bound(F.col("alpha"), F.col("beta")) < least_rate)
    for name, key in (("host", "host"), ("domain", "_domain"), ("suffix", "_suffix")):
        p = p.join(levels.where(F.col("level") == name).select(F.col("key").alias(key), F.col("bad").alias(f"_bad_{name}")), key, "left")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    overall = F.lit(levels.where("level = 'all'").first()["bad"])
    bad = F.when(F.col("host") == "", overall).otherwise(F.coalesce("_bad_host", "_bad_domain", "_bad_suffix", overall))
    return p.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(bad, "block").otherwise("allow")).alias("verdict"))


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A page is good if the document that its url numbers is labelled of good quality and not toxic; urls without number: none."""
    number = F.expr("try_cast(nullif(regexp_extract(_path, '/([0-9]+)', 1), '') as bigint)")
    numbered = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("_path")).where("host != ''").select("host", number.alias("doc_id")).where("doc_id is not null")
    good = labels.where("doc_id is not null and quality is not null and toxic is not null").select("doc_id", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0).alias("good"))
    return numbered.join(good, "doc_id").select("host", "good")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return filter_urls(pages, labelled_outcomes(pages, labels))
