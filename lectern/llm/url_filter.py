"""URL filters: fixed rules, and the reputation of hosts from labelled pages.

A host's rate of bad pages is shrunk through three beta-binomial levels: the suffix towards the
overall rate, the registered domain towards its suffix, the host towards its domain. At each level the prior's
mean is the posterior mean of the level above, and its weight comes from how much more the groups
of that level differ than binomial chance (a moment estimate over all groups). A host is blocked if the
lower bound of its posterior rate, a quantile of the beta distribution, is above ``limit``; hosts without
labels inherit the level above.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.tasks import stored

LIMIT = 0.5
DOUBT = 0.05
# Suffixes of more than one label under which names are registered; all others are the last label. A
# parameter, as such lists change: ``*.x`` stands for any one label before x, ``!y.x`` for an exception to it.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk", "sch.uk",
    "com.au", "edu.au", "gov.au", "id.au", "net.au", "org.au",
    "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp",
    "com.br", "gov.br", "net.br", "org.br", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn",
    "ac.in", "co.in", "gov.in", "net.in", "org.in", "ac.kr", "co.kr", "go.kr", "or.kr",
    "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz", "ac.za", "co.za", "gov.za", "org.za",
    "com.ar", "com.mx", "com.tr", "com.tw", "com.ua", "com.hk", "com.sg", "com.my", "co.id", "co.il", "co.th",
    "*.bd", "*.ck", "!www.ck", "*.er", "*.fk", "*.kh", "*.mm", "*.np", "*.pg",
)
# What addresses have for a suffix; no name has a blank.
ADDRESS = "an address"

_LOW = "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path; both empty for null and where there is no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit("")), _LOW.upper(), _LOW)
    return host, F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule ``host/path`` that fits, as a struct (size, rule, verdict), or null.

    ``rules`` is a short list written into the plan, up to some hundreds.
    """
    fits = []
    for rule, verdict in rules:
        name, _, rest = rule.partition("/")
        own = (host == name) | F.endswith(host, F.lit("." + name))
        hit = F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(own & F.startswith(path, F.lit("/" + rest)), hit))
    if not fits:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return F.array_max(F.array_compact(F.array(*fits)))


def plain_host(host: Column) -> Column:
    """A host without user part, port and final dot; brackets of an address stay."""
    return F.rtrim(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), F.lit("."))


def with_domains(hosts: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Add ``domain`` (one label more than the suffix, at most the host) and ``suffix`` to distinct ``host``s.

    Every ending of a host is looked up in the table of rules; an exception goes before all others, then the
    longest rule counts, and the last label where there is none. Addresses are domains of their own.
    """
    spark = hosts.sparkSession
    name = plain_host(F.col("host"))
    numeric = F.rlike(name, F.lit(r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$"))
    named = hosts.withColumns({"_name": name, "_address": numeric, "_parts": F.split(name, r"\.", -1)})
    last = lambda n: F.array_join(F.slice("_parts", -n, n), ".")
    size = F.size("_parts")
    endings = F.transform(F.sequence(F.lit(1), size), lambda n: F.struct(n.alias("n"), last(n).alias("own"), last(F.greatest(n - 1, F.lit(1))).alias("above")))
    each = named.where(~F.col("_address")).select("host", F.explode(endings).alias("e"))
    keys = F.array(
        F.struct(F.col("e.own").alias("rule"), F.col("e.n").alias("n"), F.lit(False).alias("exception")),
        F.struct(F.concat(F.lit("*."), F.when(F.col("e.n") > 1, F.col("e.above"))).alias("rule"), F.col("e.n").alias("n"), F.lit(False).alias("exception")),
        F.struct(F.concat(F.lit("!"), F.col("e.own")).alias("rule"), (F.col("e.n") - 1).alias("n"), F.lit(True).alias("exception")),
    )
    rules = spark.createDataFrame([(r,) for r in suffixes], "rule string").distinct()
    met = each.select("host", F.explode(keys).alias("k")).select("host", "k.*").join(rules, "rule")
    labels = met.groupBy(F.col("host").alias("_host")).agg(F.max(F.struct("exception", "n")).alias("found"))
    labels = stored(labels.select("_host", F.greatest(F.col("found.n"), F.lit(1)).alias("_labels")), "labels")
    joined = named.join(labels, F.col("host") == F.col("_host"), "left").withColumn("_labels", F.least(F.coalesce("_labels", F.lit(1)), size))
    domain = F.when(F.col("_address"), F.col("_name")).otherwise(last(F.least(F.col("_labels") + 1, size)))
    suffix = F.when(F.col("_address"), ADDRESS).otherwise(last(F.col("_labels")))
    return joined.select(*hosts.columns, domain.alias("domain"), suffix.alias("suffix"))


def _beta_below(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """P(X <= x) for X beta of a and b, by the continued fraction (on the side where it converges fast)."""
    swap = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    logs = np.array([math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) for p, q in zip(a, b, strict=True)])
    with np.errstate(divide="ignore"):
        front = np.exp(logs + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    total = d.copy()
    for m in range(1, 300):
        moved = np.zeros(len(x), bool)
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            total = total * d * c
            moved |= np.abs(d * c - 1) > 1e-12
        if not moved.any():
            break
    below = np.where(x <= 0, 0.0, front * total)
    return np.clip(np.where(swap, 1 - below, below), 0.0, 1.0)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The value that X, beta of a and b, stays below with probability ``p``, by bisection."""
    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(40 if len(a) else 0):
        middle = (low + high) / 2
        below = _beta_below(middle, a, b) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return low


def _lower(doubt: float):
    def lower(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(beta_quantile(doubt, a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)))

    return F.arrow_udf(lower, T.DoubleType())


def _shrunk(groups: DataFrame, mean: Column, floor: float = 0.001) -> DataFrame:
    """Add ``weight`` (of the prior) and ``posterior`` to groups with n, k and the prior mean."""
    m = F.greatest(F.lit(0.001), F.least(F.lit(0.999), mean))
    groups = groups.withColumn("mean", m)
    off = F.pow(F.col("k") / F.col("n") - F.col("mean"), 2) * F.col("n") / (F.col("mean") * (1 - F.col("mean")))
    seen = groups.where("n > 0").agg(F.sum(off).alias("s"), F.count(F.lit(1)).alias("g"), F.sum("n").alias("n")).first()
    rho = (seen["s"] - seen["g"]) / (seen["n"] - seen["g"]) if seen["g"] and seen["n"] > seen["g"] else floor
    weight = 1 / min(0.999, max(floor, rho)) - 1
    posterior = (F.col("k") + F.col("mean") * weight) / (F.col("n") + weight)
    return groups.withColumn("weight", F.lit(weight)).withColumn("posterior", posterior)


def reputation(outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES, doubt: float = DOUBT) -> DataFrame:
    """Hosts with n (labelled pages), k (bad ones), posterior and lower bound of their rate of bad pages.

    ``outcomes`` has ``host``, n and k, one row per host, with n = 0 where nothing is known. The true rate lies
    below the bound with probability ``doubt``.
    """
    hosts = stored(with_domains(outcomes.select("host", "n", "k"), suffixes), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    total = hosts.agg(*sums).first()
    overall = total["k"] / total["n"] if total["n"] else 0.0
    level = stored(_shrunk(hosts.groupBy("suffix").agg(*sums), F.lit(overall)), "suffixes")
    above = level.select("suffix", F.col("posterior").alias("prior"))
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    level = stored(_shrunk(stored(domains.join(above, "suffix"), "domains"), F.col("prior")), "domains")
    above = level.select("domain", "suffix", F.col("posterior").alias("prior"))
    judged = _shrunk(stored(hosts.join(above, ["domain", "suffix"]), "hosts"), F.col("prior"))
    good, bad = F.col("mean") * F.col("weight") + F.col("k"), (1 - F.col("mean")) * F.col("weight") + F.col("n") - F.col("k")
    lower = _lower(doubt)(good.cast("double"), bad.cast("double"))
    return judged.select("host", "domain", "suffix", "n", "k", "posterior", lower.alias("lower"))


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[tuple[str, str]],
    id: str = "page_id",
    url: str = "url",
    limit: float = LIMIT,
    suffixes: tuple[str, ...] = SUFFIXES,
) -> DataFrame:
    """One row per page: ``id``, host, path, rule, verdict, lower.

    ``labels`` has ``id`` and ``bad`` (0 or 1) of labelled pages; of several labels of a page
    the worst counts, null ones and null ids count nothing. A rule's verdict goes before the reputation. Null urls have
    an empty host with a reputation of its own. Repeated pages are judged each and count once per row; without
    labels nothing but the rules blocks; an empty table gives an empty one; other columns are not read.
    """
    host, path = host_and_path(F.col(url))
    rows = stored(pages.select(F.col(id).alias("id"), host.alias("host"), path.alias("path")), "pages")
    bad = labels.where(F.col("bad").isNotNull()).groupBy(F.col(id).alias("id")).agg(F.max("bad").alias("bad"))
    bad = stored(bad, "bad")
    marked = rows.select("id", "host").join(bad, "id", "left")
    outcomes = marked.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    known = stored(reputation(outcomes, suffixes).select("host", "lower"), "reputation")
    judged = rows.join(known, "host").withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("lower") > limit, "block").otherwise("allow")
    return judged.select(
        F.col("id").alias(id), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"), "lower"
    )
