"""URL filter: rules by host and path, and for all other urls trust and distrust that travel along links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
# An error no verdict depends on, where a score lies on the margin itself.
SETTLED = 1e-12
# A host is blocked when its distrust exceeds its trust by what a host gets that lies alone
# and has half its pages blocked.
MARGIN = 0.5 * (1 - DAMPING)
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*([^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """`host/path` with a verdict; holds for the host and its subdomains where the path starts with the rule's."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first `://`: the host to `/`, `?`, `#` or the end, A-Z lower-cased, and the path to `?`, `#` or the end."""
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rules_of_hosts(hosts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Every host that a rule fits, with all its rules; hosts meet rules on their suffixes."""
    spark = hosts.sparkSession
    table = spark.createDataFrame(
        [(r.host, r.path, r.text, r.verdict) for r in rules], "suffix string, rule_path string, rule string, rule_verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = hosts.where("host <> ''").select("host", F.explode(suffixes).alias("suffix"))
    return named.join(table, "suffix").groupBy("host").agg(
        F.collect_set(F.struct("rule_path", "rule", "rule_verdict")).alias("rules"))


def edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts, with the number of pages that have them; `pages` has `host` and `html`."""
    target = F.transform(
        F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK)),
        lambda url: host_and_path(F.when(url.startswith("//"), F.concat(F.lit("x:"), url)).when(
            url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), url).otherwise(F.lit("")))[0])
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(target)).alias("dst"))
    return links.where("dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """`trust` and `distrust` of every host from seeds (host, allowed, blocked, each 0 to 1).

    Trust is personalised PageRank along links; distrust the same against their direction,
    from a blocked host to those that link to it. Both go in one join and one sum a round,
    written below `spark.checkpoint.dir`. A round shrinks the sum of all moves to DAMPING of
    it at most, so what is still to come is bounded by the last round's sum; it ends when no
    host with links lies nearer to MARGIN than that, or the bound is below SETTLED.
    """
    out = links.groupBy("src").agg(F.sum("n").alias("of"))
    into = links.groupBy("dst").agg(F.sum("n").alias("of"))
    forth = links.join(out, "src").select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("n") / F.col("of")).alias("forth"), F.lit(0.0).alias("back"))
    back = links.join(into, "dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0.0).alias("forth"), (F.col("n") / F.col("of")).alias("back"))
    steps = cut(forth.unionByName(back), "hosts")
    known = seeds.select("host").union(links.select("src")).union(links.select("dst")).distinct()
    rest = 1 - DAMPING
    start = cut(known.join(seeds, "host", "left").select(
        "host", (rest * F.coalesce("allowed", F.lit(0.0))).alias("own_trust"), (rest * F.coalesce("blocked", F.lit(0.0))).alias("own_distrust")), "hosts")
    now = start.select("host", F.col("own_trust").alias("trust"), F.col("own_distrust").alias("distrust"))
    if steps.isEmpty():
        return now
    while True:
        got = steps.join(now, steps.a == now.host).groupBy(F.col("b").alias("host")).agg(
            F.sum(F.col("trust") * F.col("forth")).alias("t"), F.sum(F.col("distrust") * F.col("back")).alias("d"))
        after = cut(start.join(got, "host", "left").select(
            "host", (F.col("own_trust") + DAMPING * F.coalesce("t", F.lit(0.0))).alias("trust"),
            (F.col("own_distrust") + DAMPING * F.coalesce("d", F.lit(0.0))).alias("distrust"), F.col("t").isNotNull().alias("linked")), "hosts")
        trust, distrust, gap = after.where("linked").join(now.toDF("host", "t", "d"), "host").agg(
            F.sum(F.abs(F.col("trust") - F.col("t"))), F.sum(F.abs(F.col("distrust") - F.col("d"))),
            F.min(F.abs(F.col("distrust") - F.col("trust") - MARGIN))).first()
        now = after.select("host", "trust", "distrust")
        to_come = (trust + distrust) * DAMPING / (1 - DAMPING)
        if to_come < max(gap, SETTLED):
            return now


def judge_urls(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """`host`, `path`, `rule` and `verdict` of every url, one row per row of `pages`.

    The longest rule that fits decides (of two as long, a block). Urls without a rule take
    the verdict of their host: seeds are the shares of a host's pages that rules allow and
    block, links between hosts carry them on, and a host is blocked where distrust exceeds
    trust by more than MARGIN. A host with no such evidence is allowed.

    A null url, or one without `://`, has empty host and path and is allowed; its links do
    not count. Null html has no links. Repeated rows count as pages of their own and are all
    returned; an empty table gives an empty result; other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).select(
        "id", "html", host.alias("host"), path.alias("path"))
    urls = named.select("id", "host", "path")
    of_hosts = rules_of_hosts(urls.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).select("host"), rules)
    fitting = F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(
        F.length(r["rule"]).alias("length"), (r["rule_verdict"] == "block").alias("block"), r["rule"].alias("rule"), r["rule_verdict"].alias("verdict"))))
    ruled = cut(urls.join(of_hosts, "host", "left").select("id", "host", "path", best.alias("best")).select(
        "id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict")), "hosts")

    seeds = ruled.where("host <> ''").groupBy("host").agg(
        F.avg((F.coalesce("rule_verdict", F.lit("")) == "allow").cast("double")).alias("allowed"),
        F.avg((F.coalesce("rule_verdict", F.lit("")) == "block").cast("double")).alias("blocked"))
    scores = propagate(seeds, cut(edges(named), "hosts"))
    blocked = scores.select("host", (F.col("distrust") - F.col("trust") > MARGIN).alias("distrusted"))
    judged = ruled.join(blocked, "host", "left")
    return judged.select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(F.col("distrusted"), "block").otherwise("allow")).alias("verdict"))
