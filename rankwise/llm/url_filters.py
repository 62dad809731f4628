"""URL filters: explicit rules and a path-template tree (native).

Rules name a host (with its subdomains) and a path prefix; the longest that
fits decides.  The urls they decide are the labelled ones from which a tree of
path templates per host learns about the rest:

1. numbers and long ids in a path become wildcards; so do the children of a
   tree node that are rare in it where it has many of them (slugs, names);
2. sibling branches (templates that differ in their first segment) whose
   share of blocked urls doesn't differ significantly from their siblings'
   joint share (Wilson interval) are merged into one template;
3. a template's purity is its share of blocked urls among the labelled ones,
   smoothed by ``SMOOTHING`` urls at the host's share, which is in turn
   smoothed by as many at ``PRIOR``.  A template of purity ``REJECT`` or more
   is rejected.

A host's share takes its unlabelled urls as not blocked, so that a few
blocked paths don't condemn a host.  Urls are counted per shape before
anything is joined; joins that a hot host or shape could burden are salted.

Defined results: a url that is null or has no ``://`` has empty host, path and
template and is allowed unless labelled otherwise; repeated rows are judged
alike and all count.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwise.llm.common import lower_ascii, salted_join

#: A node's child is rare if it has at most this share of the node's urls; wildcards need so many rare children.
RARE_SHARE, RARE_CHILDREN = 0.02, 16
Z = 1.96
SMOOTHING, PRIOR, REJECT = 4.0, 0.25, 0.5


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"),
         Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def with_address(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``host`` (A-Z in lower case) and ``path``."""
    url, at = F.col(url_col), F.locate("://", F.col(url_col))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (pages.withColumn("_rest", rest).withColumn("host", lower_ascii(F.regexp_extract("_rest", "^[^/?#]*", 0)))
            .withColumn("path", F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1)).drop("_rest"))


def matching_rule(rules: Sequence[Rule], field: str) -> Column:
    """``text`` or ``verdict`` of the longest rule that fits ``host`` and ``path``; null if none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, field))).otherwise(out)
    return out


def shape() -> Column:
    """The path with long hexadecimal ids and numbers as wildcards."""
    ids = F.regexp_replace("path", r"(?<=/)[0-9a-fA-F-]{16,}(?=[/.]|$)", "{id}")
    return F.regexp_replace(ids, "[0-9]+", "{n}")


def _templates(shapes: DataFrame) -> DataFrame:
    """``(host, shape, n)`` distinct -> ``(host, shape, template)`` with rare children as wildcards."""
    parts = shapes.select("host", "shape", "n", F.split("shape", "/").alias("parts")).select(
        "host", "shape", "n", "parts", F.posexplode("parts").alias("pos", "part"))
    parts = parts.select("host", "shape", "n", "pos", "part",
                         F.xxhash64(F.col("pos"), F.slice("parts", F.lit(1), F.col("pos"))).alias("parent"))
    nodes = parts.groupBy("host", "parent", "part").agg(F.sum("n").alias("c"))
    totals = nodes.groupBy("host", "parent").agg(F.sum("c").alias("all"), F.count("*").alias("children")).where(
        F.col("children") >= RARE_CHILDREN).drop("children")
    rare = salted_join(nodes, totals, ["host", "parent"], "part", "inner").where(
        F.col("c") <= F.greatest(F.lit(1.0), F.col("all") * RARE_SHARE))
    many = rare.groupBy("host", "parent").agg(F.count("*").alias("rare")).where(F.col("rare") >= RARE_CHILDREN)
    wild = salted_join(rare.select("host", "parent", "part"), many.drop("rare"), ["host", "parent"], "part", "inner")
    named = parts.join(wild.withColumn("wild", F.lit(True)), ["host", "parent", "part"], "left").withColumn(
        "part", F.when(F.col("wild") & (F.col("part") != ""), "*").otherwise(F.col("part")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "/")
    return named.groupBy("host", "shape").agg(joined.alias("template"))


def _wilson(blocked: str, n: str, sign: int) -> Column:
    b, k = F.col(blocked).cast("double"), F.nullif(F.col(n), F.lit(0)).cast("double")
    p = b / k
    return (p + Z * Z / (2 * k) + sign * Z * F.sqrt(p * (1 - p) / k + Z * Z / (4 * k * k))) / (1 + Z * Z / k)


def _merged(counts: DataFrame) -> DataFrame:
    """``(host, template, n, labelled, blocked)`` -> with ``branch``: the merged template's name."""
    rest = F.regexp_replace("template", "^/[^/]*", "/*")
    counts = counts.withColumn("family", rest)
    joint = counts.where("labelled > 0").groupBy("host", "family").agg(
        (F.sum("blocked") / F.sum("labelled")).alias("share"), F.count("*").alias("siblings"))
    both = salted_join(counts, joint, ["host", "family"], "template", "left")
    alike = (F.col("labelled") > 0) & (F.col("siblings") > 1) & (F.col("share") >= _wilson("blocked", "labelled", -1) - 1e-12) & (
        F.col("share") <= _wilson("blocked", "labelled", 1) + 1e-12)
    return both.withColumn("branch", F.when(alike, F.col("family")).otherwise(F.col("template"))).drop(
        "family", "share", "siblings")


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``id_col, host, path, rule, verdict, template, purity`` for every page."""
    rows = with_address(pages.select(F.col(id_col), F.col(url_col)), url_col)
    rows = rows.select(F.col(id_col), "host", "path", matching_rule(rules, "text").alias("rule"),
                       matching_rule(rules, "verdict").alias("said"), shape().alias("shape"))
    shapes = rows.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("said").alias("labelled"), F.count_if(F.col("said") == "block").alias("blocked"))
    named = shapes.join(_templates(shapes.select("host", "shape", "n")), ["host", "shape"])
    counts = named.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
    merged = _merged(counts)
    of_host = counts.groupBy("host").agg(
        ((F.sum("blocked") + SMOOTHING * PRIOR) / (F.sum("n") + SMOOTHING)).alias("host_share"))
    sums = merged.groupBy("host", "branch").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    sums = salted_join(sums, of_host, ["host"], "branch", "inner").withColumn(
        "purity", F.round((F.col("b") + SMOOTHING * F.col("host_share")) / (F.col("l") + SMOOTHING), 9)).select("host", "branch", "purity")
    learned = named.select("host", "shape", "template").join(
        merged.select("host", "template", "branch"), ["host", "template"]).join(sums, ["host", "branch"])
    out = salted_join(rows, learned.select("host", "shape", F.col("branch").alias("template"), "purity"),
                      ["host", "shape"], id_col, "inner")
    verdict = F.coalesce("said", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return out.select(F.col(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


#: The same in DuckDB.
ORACLE_SQL = r"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
           from pages),
a as (select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r as (select *, case when (host = 'example.net' or suffix(host, '.example.net')) and prefix(path, '/en/') then 'example.net/en/'
                     when (host = 'example.com' or suffix(host, '.example.com')) and prefix(path, '/de/') then 'example.com/de/'
                     when (host = 'org' or suffix(host, '.org')) and prefix(path, '/fr/') then 'org/fr/'
                     when (host = 'net' or suffix(host, '.net')) and prefix(path, '/') then 'net/' end as rule from a),
rows as (select page_id, host, path, rule,
                case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' end as said,
                regexp_replace(regexp_replace(regexp_replace(path,
                  '(/)[0-9a-fA-F-]{16,}([/.]|$)', '\1{id}\2', 'g'),
                  '(/)[0-9a-fA-F-]{16,}([/.]|$)', '\1{id}\2', 'g'), '[0-9]+', '{n}', 'g') as shape
         from r),
shapes as (select host, shape, count(*) as n, count(said) as labelled,
                  count(*) filter (where said = 'block') as blocked from rows group by all),
exploded as (select host, shape, n, string_split(shape, '/') as ps, unnest(range(len(string_split(shape, '/')))) as pos from shapes),
parts as (select host, shape, n, pos, ps[pos + 1] as part, array_to_string(ps[1:pos], '/') || '#' || pos as parent from exploded),
nodes as (select host, parent, part, sum(n) as c from parts group by all),
totals as (select host, parent, sum(c) as s from nodes group by all having count(*) >= 16),
rare as (select host, parent, part from nodes join totals using (host, parent) where c <= greatest(1.0, s * 0.02)),
many as (select host, parent from rare group by all having count(*) >= 16),
wild as (select host, parent, part from rare semi join many using (host, parent)),
named as (select p.host, p.shape, string_agg(case when w.part is not null and p.part <> '' then '*' else p.part end, '/'
                                             order by p.pos) as template
          from parts p left join wild w on p.host = w.host and p.parent = w.parent and p.part = w.part
          group by p.host, p.shape),
counts as (select host, template, sum(n) as n, sum(labelled) as labelled, sum(blocked) as blocked,
                  regexp_replace(template, '^/[^/]*', '/*') as family
           from named join shapes using (host, shape) group by all),
joint as (select host, family, sum(blocked) / sum(labelled)::double as share, count(*) as siblings
          from counts where labelled > 0 group by all),
w as (select c.*, share, siblings, blocked::double / nullif(labelled, 0) as p, nullif(labelled, 0)::double as k
      from counts c left join joint j on c.host = j.host and c.family = j.family),
merged as (select host, template, n, labelled, blocked, case when labelled > 0 and siblings > 1
  and share >= (p + 1.96*1.96/(2*k) - 1.96*sqrt(p*(1-p)/k + 1.96*1.96/(4*k*k))) / (1 + 1.96*1.96/k) - 1e-12
  and share <= (p + 1.96*1.96/(2*k) + 1.96*sqrt(p*(1-p)/k + 1.96*1.96/(4*k*k))) / (1 + 1.96*1.96/k) + 1e-12
  then family else template end as branch from w),
of_host as (select host, (sum(blocked) + 1.0::double) / (sum(n) + 4.0::double) as host_share from counts group by all),
sums as (select host, branch, round((sum(blocked) + 4.0::double * any_value(host_share)) / (sum(labelled) + 4.0::double), 9) as purity
         from merged join of_host using (host) group by all)
select page_id, host, path, rule, coalesce(said, case when purity >= 0.5 then 'block' else 'allow' end) as verdict,
       branch as template, purity
from rows join named using (host, shape) join merged using (host, template) join sums using (host, branch)
"""
