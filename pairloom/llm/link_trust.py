"""URL filter: rules, and trust that flows along the links between hosts.

A rule is a host followed by a path, to allow or to block. It fits its host and all
subdomains where the url's path starts with the rule's; the longest rule wins.

Pages without a rule get their host's verdict. Hosts with allowed pages are trusted
seeds, hosts with blocked pages distrusted ones, each weighted by its pages. Trust is a
personalised PageRank from the trusted seeds along the links; distrust runs from the
blocked seeds against the links (who links to bad hosts is suspect). Links are the
absolute hrefs of the pages; besides, a host and the domain it lies in link to each other
(FAMILY times each), up to the domain of two labels, whether that has pages or not: hosts
of one domain meet there. A host is blocked if its distrust exceeds THRESHOLD times the
sum of both; a host that neither reaches is allowed.

A step passes on DAMPING of all rank, so after n steps at most DAMPING**n of it is still to
come: STEPS is the first number that leaves less than TOLERANCE, whatever the links.

Host pairs are counted before anything is joined; both ranks are computed in one pass
per step, over edges that carry their share. A host with very many links is dealt over
salts, in proportion to its links. The ranks are written every few steps.

Host and path: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; then up to ``?``, ``#`` or the end. A null url or one without ``://`` has
both empty, fits no rule and is allowed like any host of which nothing is known. Null
html has no links. Repeated rows are judged each; their pages and links count each.
Equally long rules are taken by their text. Very long texts are searched whole for links.
An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.common import saved

DAMPING, TOLERANCE, WRITE_EVERY = 0.85, 1e-3, 4
STEPS = ceil(log(TOLERANCE) / log(DAMPING))
THRESHOLD, FAMILY = 0.5, 1
LINKS_PER_SALT = 100_000
PAGE_SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""href\s*=\s*["']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path, such as ``example.org/es/``."""

    text: str
    allow: bool

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


RULES = (
    Rule("org/", True),
    Rule("example.org/es/", False),
    Rule("example.org/en/1", False),
    Rule("com/fr/", True),
    Rule("com/de/", False),
)


def folded(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return folded(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def rule_of(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """The text of the longest rule that fits (of equally long ones the first by text), or null."""
    longest = sorted(rules, key=lambda r: (-len(r.text), r.text))
    return F.coalesce(F.lit(None).cast("string"), *(F.when(_fits(r, host, path), F.lit(r.text)) for r in longest))


def _allowed(rules: tuple[Rule, ...], rule: Column) -> Column:
    return rule.isin([r.text for r in rules if r.allow])


def host_facts(judged: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Per host: pages, allowed and blocked ones."""
    named = judged.filter("host <> ''")
    allow = F.coalesce(_allowed(rules, F.col("rule")), F.lit(False))
    return named.groupBy("host").agg(
        F.sum(allow.cast("long")).alias("good"), F.sum((F.col("rule").isNotNull() & ~allow).cast("long")).alias("bad")
    )


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, n): counted links between different hosts, family links with them."""
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_HREF), 1)).alias("dst"))
    links = found.select("src", folded(F.col("dst")).alias("dst")).filter("src <> '' and dst <> src")
    links = links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    # a name and the one without its first label, as long as that has two
    names = F.split("host", r"\.")
    above = F.transform(
        F.when(F.size(names) > 2, F.sequence(F.lit(1), F.size(names) - 2)),
        lambda i: F.struct(F.array_join(F.slice(names, i, F.size(names)), ".").alias("host"), F.array_join(F.slice(names, i + 1, F.size(names)), ".").alias("parent")),
    )
    family = hosts.select(F.explode(above).alias("f")).select("f.*").distinct()
    count = F.lit(FAMILY).cast("long").alias("n")
    both = family.select(F.col("host").alias("src"), F.col("parent").alias("dst"), count).union(
        family.select(F.col("parent").alias("src"), F.col("host").alias("dst"), count)
    )
    return links.union(both).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def host_ranks(hosts: DataFrame, edges: DataFrame, steps: int = STEPS) -> DataFrame:
    """(host, trust, distrust) after ``steps`` steps; every kind starts with a sum of 1 over its seeds."""
    good, bad = F.lit("good"), F.lit("bad")
    ways = edges.select(good.alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n").union(
        edges.select(bad.alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n")
    )
    degree = ways.groupBy("kind", "host").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("links"))
    degree = saved(degree.withColumn("salts", F.ceil(F.col("links") / LINKS_PER_SALT).cast("int")), "degree")
    shares = saved(
        ways.join(degree, ["kind", "host"]).select(
            "kind", "host", "to", (F.col("n") / F.col("all")).alias("share"), F.pmod(F.xxhash64("to"), F.col("salts")).cast("int").alias("salt")
        ),
        "shares",
    )
    totals = hosts.agg(F.sum("good").alias("goods"), F.sum("bad").alias("bads"))
    seeds = hosts.select("*", totals.select("goods").scalar().alias("goods"), totals.select("bads").scalar().alias("bads"))
    seeds = seeds.select(
        "host",
        F.explode(
            F.array(
                F.struct(good.alias("kind"), F.try_divide("good", "goods").alias("seed")),
                F.struct(bad.alias("kind"), F.try_divide("bad", "bads").alias("seed")),
            )
        ).alias("s"),
    )
    seeds = saved(seeds.select("s.kind", "host", "s.seed").filter("seed > 0"), "seeds")
    ranks = seeds.withColumnRenamed("seed", "rank")
    for step in range(1, steps + 1):
        spread = ranks.join(degree.select("kind", "host", "salts"), ["kind", "host"]).withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
        )
        moved = spread.join(shares, ["kind", "host", "salt"]).select(
            "kind", F.col("to").alias("host"), (F.col("rank") * F.col("share") * DAMPING).alias("rank")
        )
        again = seeds.select("kind", "host", (F.col("seed") * (1 - DAMPING)).alias("rank"))
        ranks = moved.union(again).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if step % WRITE_EVERY == 0 or step == steps:
            ranks = saved(ranks, "ranks")
    kind = F.col("kind")
    return ranks.groupBy("host").agg(
        F.sum(F.when(kind == "good", F.col("rank")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(kind == "bad", F.col("rank")).otherwise(0.0)).alias("distrust"),
    )


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, steps: int = STEPS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page; without steps a host knows its own seeds alone."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = saved(
        pages.select("page_id", host.alias("host"), path.alias("path"), rule_of(rules, host, path).alias("rule")), "judged"
    )
    hosts = saved(host_facts(judged, rules), "hosts")
    # both directions and their degrees use the edges: the pages are read for them once
    ranks = host_ranks(hosts, saved(host_edges(pages, hosts), "edges"), steps)
    # copies of each host's row, so that the pages of one host are spread; pages choose by their id and path
    copies = ranks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(PAGE_SALTS - 1))))
    spread = judged.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(PAGE_SALTS)).cast("int"))
    out = spread.join(copies, ["host", "salt"], "left")
    # equal ranks summed in another order must not differ
    blocked = F.coalesce(F.col("distrust") > (THRESHOLD + 1e-9) * (F.col("trust") + F.col("distrust")), F.lit(False))
    verdict = F.when(F.col("rule").isNull(), F.when(blocked, "block").otherwise("allow")).when(
        _allowed(rules, F.col("rule")), "allow"
    ).otherwise("block")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
