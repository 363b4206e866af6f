"""URL filter: given rules first, host reputation by empirical Bayes for the
rest, in DataFrame and SQL functions only.

Host and path are cut from the url; a rule fits its host and all subdomains
and every path that starts with the rule's, the longest rule wins. Labelled
page outcomes are counted by host, registered domain and public suffix. A
suffix's rate of bad pages is shrunk towards that of all pages, a domain's
towards its suffix's and a host's towards its domain's: at each level the rates
of the units are beta distributed around their parent's, and the strength of
that prior comes from the spread of the units by the method of moments. A host
is blocked if the lower bound of its posterior (logit-normal) reaches ``limit``;
hosts without outcomes have their domain's prior as posterior.

Rules meet distinct hosts, one row each, not pages. A host with more than one
``SPREAD``-th of all pages is dealt over as many keys as it has such parts; the
list of those hosts, as 64-bit hashes, is all that is broadcast: at most
``SPREAD`` rows.

Null urls and urls without ``://`` have host and path empty, and fit no rule
(a rule's host is not empty). Nulls in labels count as no label; a document
labelled twice is bad if one label says so. Equal rows are judged alike, one row
out for each. Without any labelled page the rate is that of one bad page in two
with next to no weight, which blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LIMIT = 0.5                  # bad share from which a host is blocked
BOUND_Z = 1.6448536269514722  # one-sided 95 % bound
SPREAD = 4096
LEAST_RHO, MOST_RHO = 1e-4, 0.5  # bounds of the correlation of two pages of a unit
# Public suffixes of two labels; others have one.
TWO_LABELS = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "com.mx", "gov.uk", "org.uk")


def with_host(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``host`` and ``path`` beside the columns of ``pages`` (which has none of these names)."""
    url = F.col(url_col).cast("string")
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr(f"substring(`{url_col}`, locate('://', `{url_col}`) + 3)")).otherwise(F.lit(""))
    out = pages.withColumn("_rest", F.coalesce(rest, F.lit("")))
    out = out.withColumn("host", F.regexp_extract("_rest", "^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(_rest, length(host) + 1)"), "^[^?#]*", 0)
    return out.withColumn("path", path).withColumn("host", F.translate("host", UPPER, LOWER)).drop("_rest")


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows of a short list of rules."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def numbered_outcomes(paged: DataFrame, labels: DataFrame, number: str = r"(?s)^/[^/]+/([0-9]{1,18})([/.].*)?$") -> DataFrame:
    """(host, n, bad): labelled pages by host, where the path names a labelled
    document by number. A page is bad if its document is toxic or of low quality."""
    key = F.expr("try_cast(" + "nullif(regexp_extract(path, r'" + number + "', 1), '') as bigint)")
    seen = (paged.select("host", key.alias("doc_id")).filter("doc_id is not null")
                 .groupBy("host", "doc_id").agg(F.count(F.lit(1)).alias("c")))
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(
        F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), bad.alias("bad")).filter("bad is not null")
                   .groupBy("doc_id").agg(F.max("bad").alias("bad")))
    return seen.join(known, "doc_id").groupBy("host").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("bad")).cast("long").alias("bad"))


def _levels(hosts: DataFrame) -> DataFrame:
    """``domain`` and ``suffix`` of each host; user names, ports and a last dot do not count."""
    name = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), r"(:[0-9]*)?\.?$", "")
    out = hosts.withColumn("_name", name)
    two = F.substring_index("_name", ".", -2)
    address = F.col("_name").rlike(r"^[0-9.]*$|^\[|:")
    suffix = F.when(address, F.lit("")).when(two.isin(*TWO_LABELS), two).otherwise(F.substring_index("_name", ".", -1))
    out = out.withColumn("suffix", suffix)
    domain = F.when(address, F.col("_name")).when(F.col("suffix").contains("."), F.substring_index("_name", ".", -3)).otherwise(two)
    return out.withColumn("domain", domain).drop("_name")


def _strength(units: DataFrame) -> float:
    """The prior's strength a + b from units (n, bad, mean), by moments: the
    excess of the squared standardised deviations over their binomial share."""
    r = units.agg(
        F.sum((F.col("bad") - F.col("n") * F.col("mean")) ** 2 / (F.col("mean") * (1 - F.col("mean")))).alias("z"),
        F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("nn")).first()
    rho = (r["z"] - r["n"]) / r["nn"] if r["nn"] else MOST_RHO
    return 1 / min(max(rho, LEAST_RHO), MOST_RHO) - 1


def reputation(hosts: DataFrame, limit: float = LIMIT, z: float = BOUND_Z) -> DataFrame:
    """``hosts`` (host, n, bad) with domain, suffix, the posterior's mean and
    ``bound``, and ``blocked``."""
    h = store(_levels(hosts), "hosts-levels")
    d = store(h.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "hosts-domains")
    s = store(d.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "hosts-suffixes")
    total = s.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    rate = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1)

    def shrunk(units, name):
        k = _strength(units.filter("n > 0"))
        return k, units.withColumn(name, (F.col("bad") + F.lit(k) * F.col("mean")) / (F.col("n") + F.lit(k)))

    _, s = shrunk(s.withColumn("mean", F.lit(rate)), "m")
    d = d.join(s.select("suffix", F.col("m").alias("mean")), "suffix")
    _, d = shrunk(store(d, "hosts-domain-priors"), "m")
    h = h.join(d.select("domain", "suffix", F.col("m").alias("mean")), ["domain", "suffix"])
    k, h = shrunk(store(h, "hosts-priors"), "rate")
    a, b = F.col("bad") + F.lit(k) * F.col("mean"), F.col("n") - F.col("bad") + F.lit(k) * (1 - F.col("mean"))
    low = F.log(a / b) - F.lit(z) * F.sqrt(1 / a + 1 / b)
    return (h.withColumn("bound", F.round(1 / (1 + F.exp(-low)), 6)).withColumn("blocked", F.col("bound") >= F.lit(limit))
             .select("host", "domain", "suffix", "n", "bad", "rate", "bound", "blocked"))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules (length, rule, path, verdict) that fit each
    host or a domain above it; hosts without any are left out."""
    labels = F.split("host", "[.]")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    r = rules.select(F.translate("host", UPPER, LOWER).alias("_up"), "path", "verdict").filter(
        "_up <> '' and path is not null and verdict in ('allow', 'block')").distinct()
    return (hosts.filter("host <> ''").select("host", F.explode(above).alias("_up")).join(r, "_up")
                 .groupBy("host").agg(F.collect_list(F.struct(
                     F.length(F.concat("_up", "path")).alias("size"), F.concat("_up", "path").alias("rule"),
                     "path", "verdict")).alias("rules")))


def judge(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          limit: float = LIMIT, spread: int = SPREAD) -> DataFrame:
    """page_id, host, path, rule (null where none fits), verdict and the bound
    of the host for every row of ``pages``. ``outcomes`` (host, n, bad) counts
    labelled pages; equally long rules: the last by code point, block before allow."""
    src = with_host(pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"))).drop("url")
    seen = store(src.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts-seen")
    known = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    counted = seen.join(known, "host", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"),
                                                      F.coalesce("bad", F.lit(0)).alias("bad"))
    ranked = reputation(counted, limit).select("host", "bound", "blocked")
    table = store(ranked.join(host_rules(seen, rules), "host", "left").join(seen, "host"), "hosts-judged")
    part = max(1, (table.agg(F.sum("pages")).first()[0] or 0) // spread)
    keys = F.ceil(F.col("pages") / F.lit(part)).cast("int")
    hot = table.filter(F.col("pages") > part).groupBy(F.xxhash64("host").alias("_h")).agg(F.max(keys).alias("_keys"))
    deal = F.broadcast(hot)  # at most ``spread`` rows of 12 bytes
    salted = (src.withColumn("_h", F.xxhash64("host")).join(deal, "_h", "left")
                 .withColumn("_salt", F.pmod(F.xxhash64("page_id", "path"), F.coalesce("_keys", F.lit(1))).cast("int")))
    dealt = (table.withColumn("_h", F.xxhash64("host")).join(deal, "_h", "left")
                  .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_keys", F.lit(1)) - 1)))
                  .select("host", "_salt", "bound", "blocked", "rules"))
    best = F.expr("array_max(transform(filter(rules, r -> startswith(path, r.path)), "
                  "r -> named_struct('size', r.size, 'rule', r.rule, 'verdict', r.verdict)))")
    return (salted.join(dealt, ["host", "_salt"], "left").withColumn("_best", best)
                  .select("page_id", "host", "path", F.col("_best.rule").alias("rule"),
                          F.coalesce(F.col("_best.verdict"), F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
                          "bound"))
