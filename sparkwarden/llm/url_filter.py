"""URL filters: host/path rules first, then link-graph propagation per host.

Trust spreads from hosts whose pages the rules allow along host edges
(personalised PageRank), distrust from blocked hosts along the reversed edges;
a host is blocked when its distrust exceeds both a floor and its trust.  Seeds
come from the rules and from a table of the caller's, if there is one.  Host
edges are hyperlinks that name a host, absolute or without a scheme (``//host/``),
quoted in any way or not at all, plus the tie between a host and its parent host
(``www.a.example.com`` - ``a.example.com``).  DataFrame functions only.

Nulls and odd input: a null url, or one without ``://``, has an empty host and
path, fits no rule and is allowed; null html has no links; the longest rule wins
and no two rules that fit one url are equally long; trust wins a tie with
distrust; repeated rows are judged alike, and their links count as often; very
long html is read whole; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""[Hh][Rr][Ee][Ff][ \t\n\r\f]*=[ \t\n\r\f]*["']?[ \t\n\r\f]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'<> \t\n\r\f]*)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


@dataclass(frozen=True)
class Propagation:
    damping: float = 0.85
    iterations: int = 12
    seed_share: float = 0.5  # a host seeds when so large a share of its pages is judged by a rule
    floor: float = 0.05
    parent_labels: int = 3  # parents with fewer labels tie no hosts together
    broadcast_hosts: int = 200_000  # host verdicts beyond this many rows are joined by shuffle


def rest_of(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def with_host_path(pages: DataFrame) -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``."""
    raw = F.regexp_extract("_rest", "^[^/?#]*", 0)
    return (
        pages.withColumn("_rest", F.coalesce(rest_of(F.col("url")), F.lit("")))
        .withColumn("host", F.translate(raw, UPPER, LOWER))
        .withColumn("path", F.regexp_extract(F.substring("_rest", F.length(raw) + 1, F.length("_rest")), "^[^?#]*", 0))
        .drop("_rest")
    )


def rule_columns(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is tried first, being outermost
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, p: Propagation) -> DataFrame:
    """``src, dst, w``: links between hosts, and host to parent both ways."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    hosts = pages.select("host").distinct()
    parent = hosts.where(F.size(F.split("host", r"\.")) > p.parent_labels).select(F.col("host").alias("src"), F.regexp_replace("host", r"^[^.]*\.", "").alias("dst"))
    ties = parent.union(parent.select("dst", "src"))
    return links.union(ties).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def host_scores(pages: DataFrame, p: Propagation = Propagation(), given: DataFrame | None = None) -> DataFrame:
    """``host, trust, distrust`` from pages with host, html and rule_verdict, and seeds ``given(host, trust, distrust)``."""
    share = lambda v: F.count_if(F.col("rule_verdict") == v) / F.count("*")
    seeds = pages.where("host <> ''").groupBy("host").agg(share("allow").alias("t0"), share("block").alias("d0"))
    seeds = seeds.select("host", *[F.when(F.col(c) >= p.seed_share, F.col(c)).otherwise(0.0).alias(c) for c in ("t0", "d0")])
    if given is not None:
        seeds = seeds.union(given.select(F.translate("host", UPPER, LOWER), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("trust", "distrust")]).where("host is not null"))
    edges = materialise(host_edges(pages, p), "hosts-edges")
    out = edges.groupBy(F.col("src").alias("from")).agg(F.sum("w").alias("total"))
    into = edges.groupBy(F.col("dst").alias("from")).agg(F.sum("w").alias("total"))
    forward = edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), "w").join(out, "from").select("from", "to", (F.col("w") / F.col("total")).alias("wt"), F.lit(0.0).alias("wd"))
    back = edges.select(F.col("dst").alias("from"), F.col("src").alias("to"), "w").join(into, "from").select("from", "to", F.lit(0.0).alias("wt"), (F.col("w") / F.col("total")).alias("wd"))
    steps = materialise(forward.union(back), "hosts-steps")
    nodes = seeds.union(edges.select(F.col("dst").alias("host"), F.lit(0.0), F.lit(0.0))).groupBy("host").agg(F.max("t0").alias("t0"), F.max("d0").alias("d0"))
    nodes = materialise(nodes, "hosts-nodes")
    rank = nodes.select("host", F.col("t0").alias("t"), F.col("d0").alias("d"))
    for i in range(p.iterations):
        got = steps.join(rank, F.col("from") == F.col("host")).groupBy(F.col("to").alias("host")).agg(F.sum(F.col("t") * F.col("wt")).alias("gt"), F.sum(F.col("d") * F.col("wd")).alias("gd"))
        moved = lambda s, g: (1 - p.damping) * F.col(s) + p.damping * F.coalesce(g, F.lit(0.0))
        rank = nodes.join(got, "host", "left").select("host", moved("t0", F.col("gt")).alias("t"), moved("d0", F.col("gd")).alias("d"))
        if i % 3 == 2:
            rank = materialise(rank, "hosts-rank")
    scale = 1 - p.damping  # a seed without links keeps its seed weight
    return rank.select("host", F.round(F.col("t") / scale, 9).alias("trust"), F.round(F.col("d") / scale, 9).alias("distrust"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, p: Propagation = Propagation(), seeds: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every row; ``seeds(host, trust, distrust)`` adds to those of the rules."""
    name, verdict = rule_columns(rules)
    judged = with_host_path(pages.select("page_id", "url", "html")).withColumn("rule", name).withColumn("rule_verdict", verdict)
    scores = materialise(host_scores(judged, p, seeds), "hosts-scores")
    if scores.count() <= p.broadcast_hosts:
        scores = F.broadcast(scores)
    both = judged.drop("html", "url").join(scores, "host", "left")
    bad = (F.coalesce("distrust", F.lit(0.0)) > p.floor) & (F.col("distrust") > F.col("trust"))
    return both.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def oracle(rules: tuple[Rule, ...] = RULES, p: Propagation = Propagation()) -> str:
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = [f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')" for r in ordered]
    pick = lambda what: "case " + " ".join(f"when {f} then '{getattr(r, what)}'" for f, r in zip(fits, ordered)) + " end"
    rounds = "".join(
        f""", r{i + 1} as materialized (select n.host, {1 - p.damping!r} * t0 + {p.damping!r} * coalesce(gt, 0) as t, {1 - p.damping!r} * d0 + {p.damping!r} * coalesce(gd, 0) as d
        from nodes n left join (select "to" as host, sum(t * wt) as gt, sum(d * wd) as gd from steps join r{i} on "from" = r{i}.host group by 1) g on g.host = n.host)"""
        for i in range(p.iterations)
    )
    return f"""
    with a as (select page_id, html, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
    b as (select page_id, html, coalesce(regexp_extract(rest, '^[^/?#]*'), '') as raw, coalesce(rest, '') as rest from a),
    c as (select page_id, html, translate(raw, '{UPPER}', '{LOWER}') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from b),
    judged as materialized (select *, {pick("name")} as rule, {pick("verdict")} as rule_verdict from c),
    shares as (select host, count(*) filter (rule_verdict = 'allow') / count(*) as t, count(*) filter (rule_verdict = 'block') / count(*) as d from judged where host <> '' group by host),
    seeds as (select host, case when t >= {p.seed_share} then t else 0 end as t0, case when d >= {p.seed_share} then d else 0 end as d0 from shares),
    links as (select host as src, translate(unnest(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1)), '{UPPER}', '{LOWER}') as dst from judged),
    parent as (select distinct host as src, regexp_replace(host, '^[^.]*\\.', '') as dst from judged where len(string_split(host, '.')) > {p.parent_labels}),
    edges as materialized (select src, dst, count(*)::double as w from (select * from links union all select * from parent union all select dst, src from parent) where src <> dst and src <> '' and dst <> '' group by all),
    steps as materialized (select src as "from", dst as "to", w / sum(w) over (partition by src) as wt, 0.0::double as wd from edges union all select dst, src, 0.0::double, w / sum(w) over (partition by dst) from edges),
    nodes as materialized (select host, max(t0)::double as t0, max(d0)::double as d0 from (select * from seeds union all select dst, 0, 0 from edges) group by host),
    r0 as (select host, t0 as t, d0 as d from nodes){rounds},
    scores as (select host, round(t / {1 - p.damping!r}, 9) as trust, round(d / {1 - p.damping!r}, 9) as distrust from r{p.iterations})
    select page_id, judged.host, path, rule, coalesce(rule_verdict, case when distrust > {p.floor} and distrust > trust then 'block' else 'allow' end) as verdict
    from judged left join scores on judged.host = scores.host"""


QUERIES = {"op5_url_filters": op5_url_filters}
ORACLE_SQL = {"op5_url_filters": oracle()}
