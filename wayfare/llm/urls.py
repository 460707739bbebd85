"""URL filter: listed rules first, then the host's reputation by empirical Bayes.

Reputation is the rate of bad pages among the labelled ones. Suffix, registered domain and
host form a hierarchy; at each level a rate has a beta prior around the posterior mean of the
level above. How strongly the prior holds is fitted per level: the beta-binomial variance is
the binomial one times ``1 + (n - 1) * rho``, and ``rho`` is estimated by moments over all
nodes. What is not known about the level above makes the prior weaker: the variances add up.
A host with many labels thus follows its own pages, one with few its domain's, one with none
its domain's or suffix's, as far as those are known. A page is blocked if the lower bound of its
host's posterior, in logit-normal approximation, lies above ``MAX_BAD_RATE``.

A rule is a host, a slash and the beginning of a path; it fits the host and all subdomains.
Of the rules that fit, the longest decides, whatever the reputation says.

Defined cases: a NULL url, or one without ``://``, has an empty host and path; those pages
share the reputation of the empty host. A NULL id has no label. Repeated pages and repeated labels
each count. Without any labels every rate is that of an even prior, and nothing is blocked
by reputation. Only the columns named are read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.scratch import stored

# Rules of the production run: verdict and rule.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
MAX_BAD_RATE = 0.4
# Standard normal quantile of the bound: 95 % of the posterior lie above it.
BOUND = 1.645
# Intraclass correlations are kept in this range, and are the first where nothing can be fitted.
DEFAULT_RHO, LEAST_RHO, MOST_RHO = 0.1, 0.001, 0.9

# Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp",
    "co.kr", "co.in", "com.br", "com.cn", "com.mx", "com.tr", "co.za",
)

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, _URL, 1), F.lit(""))
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _name(host: Column) -> Column:
    """The host without user, port and final dot."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$|\.$", "")


def suffix_of(host: Column) -> Column:
    name = _name(host)
    two = F.substring_index(name, ".", -2)
    known = two.isin(*TWO_LABEL_SUFFIXES)
    number = name.rlike(r"^[0-9.]+$|^\[")
    return F.when(number, name).when(known, two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    name = _name(host)
    known = F.substring_index(name, ".", -2).isin(*TWO_LABEL_SUFFIXES)
    number = name.rlike(r"^[0-9.]+$|^\[")
    return (
        F.when(number, name)
        .when(known, F.substring_index(name, ".", -3))
        .otherwise(F.substring_index(name, ".", -2))
    )


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Verdict and rule of the longest rule that fits; NULL if none does."""
    longest_first = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    chosen = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in reversed(longest_first):
        site, slash, start = rule.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + start)
        both = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        chosen = F.when(fits, both).otherwise(chosen)
    return chosen


def outcomes(labels: DataFrame) -> DataFrame:
    """``doc_id``, ``n`` and ``bad``: labels of a page, and those that say poor or toxic."""
    poor, toxic = F.col("quality") == 0, F.col("toxic") == 1
    said = F.col("quality").isNotNull() | F.col("toxic").isNotNull()
    bad = F.coalesce(poor, F.lit(False)) | F.coalesce(toxic, F.lit(False))
    return (
        labels.where(F.col("doc_id").isNotNull() & said)
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"))
    )


def _strength(nodes: DataFrame) -> float:
    """Weight in labels of a prior whose mean is known, from nodes with ``n``, ``bad``, ``prior``."""
    binomial = F.col("prior") * (1 - F.col("prior"))
    squared = F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2)
    above, whole = (
        nodes.where("n > 0")
        .agg(F.sum(squared - binomial), F.sum(binomial * (F.col("n") - 1)))
        .first()
    )
    rho = min(max(above / whole, LEAST_RHO), MOST_RHO) if whole else DEFAULT_RHO
    return 1 / rho - 1


def _posterior(nodes: DataFrame) -> DataFrame:
    """Beta parameters ``a`` and ``b`` of nodes with ``n``, ``bad``, ``prior`` and ``held``.

    ``held`` is the weight in labels of what the level above knows about ``prior``. The
    variance of a beta of weight ``w`` goes with ``1 / (w + 1)``.
    """
    weight = 1 / (1 / F.lit(_strength(nodes) + 1) + 1 / (F.col("held") + 1)) - 1
    return nodes.withColumn("weight", weight).withColumns(
        {
            "a": F.col("prior") * F.col("weight") + F.col("bad"),
            "b": (1 - F.col("prior")) * F.col("weight") + F.col("n") - F.col("bad"),
        }
    )


def _summed(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return nodes.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def reputation(hosts: DataFrame) -> DataFrame:
    """Per host the posterior ``bad_rate`` and its lower bound ``bad_rate_low``.

    ``hosts`` has each ``host`` once, with its labels ``n`` and ``bad``; a written table.
    """
    named = hosts.withColumns(
        {"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}
    )
    n, bad = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()

    def above(nodes: DataFrame, key: str, name: str) -> DataFrame:
        """What the nodes of a level are to the level below."""
        held = F.col("a") + F.col("b")
        known = _posterior(nodes).select(key, (F.col("a") / held).alias("prior"), held.alias("held"))
        return stored(known, name)

    whole = {"prior": F.lit((bad + 1) / (n + 2)), "held": F.lit(float(n + 2))}
    suffixes = above(_summed(named, ["suffix"]).withColumns(whole), "suffix", "suffixes")
    domains = stored(_summed(named, ["suffix", "domain"]), "domains").join(suffixes, "suffix")
    known = _posterior(named.join(above(domains, "domain", "domains"), "domain"))
    a, b = F.col("a"), F.col("b")
    low = 1 / (1 + F.exp(-(F.log(a / b) - BOUND * F.sqrt(1 / a + 1 / b))))
    return known.select("host", (a / (a + b)).alias("bad_rate"), low.alias("bad_rate_low"))


def judge(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES
) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and the posterior."""
    located = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    # pages without an id meet no label, and are kept from meeting in one partition
    spread = F.when(F.col("page_id").isNull(), F.xxhash64("host", "path")).otherwise(F.lit(0))
    marked = outcomes(labels).select(F.col("doc_id").alias("page_id"), F.lit(0).cast("long").alias("spread"), "n", "bad")
    counted = (
        located.withColumn("spread", spread)
        .join(marked, ["page_id", "spread"], "left")
        .groupBy("host")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
            F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
        )
    )
    rated = stored(reputation(stored(counted, "hosts")), "reputation")
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    by_rate = F.when(F.col("bad_rate_low") > MAX_BAD_RATE, F.lit("block")).otherwise(F.lit("allow"))
    return (
        located.withColumn("fits", rule)
        .join(rated, "host")
        .select(
            "page_id",
            "host",
            "path",
            F.col("fits.rule").alias("rule"),
            F.coalesce("fits.verdict", by_rate).alias("verdict"),
            F.round("bad_rate", 6).alias("bad_rate"),
            F.round("bad_rate_low", 6).alias("bad_rate_low"),
        )
    )


def _sql() -> str:
    two = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
    values = ", ".join(f"('{v}', '{r}')" for v, r in RULES)
    rho = "least(greatest({0} / nullif({1}, 0), {2}), {3})"

    def strength(nodes: str) -> str:
        above = "sum(n * power(bad / n - prior, 2) - prior * (1 - prior)) FILTER (n > 0)"
        whole = "sum(prior * (1 - prior) * (n - 1)) FILTER (n > 0)"
        fitted = rho.format(above, whole, LEAST_RHO, MOST_RHO)
        kept = f"CASE WHEN coalesce({whole}, 0) = 0 THEN {DEFAULT_RHO} ELSE {fitted} END"
        return f"(SELECT 1 / ({kept}) - 1 FROM {nodes})"

    def posterior(key: str, nodes: str) -> str:
        return f"""SELECT {key}, prior * w + bad AS a, (1 - prior) * w + n - bad AS b
  FROM (SELECT *, 1 / (1 / (k + 1) + 1 / (held + 1)) - 1 AS w FROM {nodes}, (SELECT {strength(nodes)} AS k))"""

    return rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{_URL}', 1), ''),
      '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    coalesce(regexp_extract(url, '{_URL}', 2), '') AS path FROM pages
), o AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad
  FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id
), hosts AS (
  SELECT host, regexp_replace(host, '^.*@|:[0-9]*$|\.$', '', 'g') AS name,
    coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad
  FROM p LEFT JOIN o ON page_id = doc_id GROUP BY host
), cut AS (
  SELECT *, string_split(name, '.') AS parts, regexp_matches(name, '^[0-9.]+$|^\[') AS number FROM hosts
), named AS (
  SELECT host, n, bad,
    CASE WHEN number THEN name WHEN array_to_string(parts[-2:], '.') IN ({two}) THEN array_to_string(parts[-2:], '.')
      ELSE parts[-1] END AS suffix,
    CASE WHEN number THEN name WHEN array_to_string(parts[-2:], '.') IN ({two}) THEN array_to_string(parts[-3:], '.')
      ELSE array_to_string(parts[-2:], '.') END AS domain
  FROM cut
), s0 AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(p0) AS prior, any_value(h0) AS held
  FROM named, (SELECT (sum(bad) + 1) / (sum(n) + 2) AS p0, sum(n) + 2 AS h0 FROM hosts) GROUP BY suffix
), s1 AS (
  {posterior("suffix", "s0")}
), d0 AS (
  SELECT domain, sum(n) AS n, sum(bad) AS bad, any_value(a / (a + b)) AS prior, any_value(a + b) AS held
  FROM named JOIN s1 USING (suffix) GROUP BY domain
), d1 AS (
  {posterior("domain", "d0")}
), h0 AS (
  SELECT host, named.n, named.bad, a / (a + b) AS prior, a + b AS held FROM named JOIN d1 USING (domain)
), h1 AS (
  {posterior("host", "h0")}
), rated AS (
  SELECT host, a / (a + b) AS bad_rate, 1 / (1 + exp(-(ln(a / b) - {BOUND} * sqrt(1 / a + 1 / b)))) AS bad_rate_low FROM h1
), listed AS (
  SELECT verdict AS listed, rule, split_part(rule, '/', 1) AS site, substr(rule, strpos(rule, '/')) AS start
  FROM (VALUES {values}) t(verdict, rule)
), fits AS (
  SELECT host, path, arg_max(listed, length(rule)) AS listed, arg_max(rule, length(rule)) AS rule
  FROM (SELECT DISTINCT host, path FROM p) JOIN listed
    ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start) GROUP BY host, path
)
SELECT page_id, host, path, rule,
  coalesce(listed, CASE WHEN bad_rate_low > {MAX_BAD_RATE} THEN 'block' ELSE 'allow' END) AS verdict,
  round(bad_rate, 6) AS bad_rate, round(bad_rate_low, 6) AS bad_rate_low
FROM p JOIN rated USING (host) LEFT JOIN fits USING (host, path)
"""


JUDGE_SQL = _sql()
