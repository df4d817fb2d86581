"""URL filter: fixed rules first, and for other urls a tree of path templates per host.

A path's segments are generalised (runs of digits, long hexadecimal names) to a template; those after DEPTH are one
segment, whole. Urls are counted by (host, template), and labels are the verdicts of the rules. Below a node with more
than FAN children that are more than FAN_SHARE of its urls, the segment is variable and becomes a wildcard.

Sibling branches differ in their first literal segment only. A branch merges with its siblings into a wildcard if it is
statistically similar: its urls are spread over the templates below it as those of all siblings together (a chi-square
sum of at most its expectation and Z standard deviations), and its share of blocked labels, if it has labels, is within
Z standard errors of that of all similar siblings. A branch without labels takes the labels of those it merged with.

A template is rejected if its smoothed purity, (blocked + 0.5) / (labelled + 1), is at least PURITY and at least
EVIDENCE of its urls are labelled. Without labelled urls there is no evidence, and it is allowed.

All steps are aggregates and equi-joins over distinct (host, template); only the last join is as long as the input, and
there a template with many urls is dealt over parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import LETTERS_UPPER, durable, hot_keys, salted_join, table

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
FAN = 16
FAN_SHARE = 0.2
Z = 1.96
PURITY = 0.9
EVIDENCE = 0.05
DEPTH = 12
BUCKET = 4096  # urls of a template that one task joins with its verdict


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path: of a null url, or one without ://, both are empty."""
    rest = F.expr("if(instr(url, '://') > 0, substring(url, instr(url, '://') + 3), '')")
    df = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", F.coalesce(rest, F.lit("")).alias("rest"))
    host = F.regexp_extract("rest", "^[^/?#]*", 0)
    path = F.regexp_extract(F.expr("substring(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1)"), "^[^?#]*", 0)
    return df.select("page_id", F.translate(host, LETTERS_UPPER, LETTERS_UPPER.lower()).alias("host"), path.alias("path"))


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule of (host, path) as text, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def template() -> Column:
    """The path's segments, generalised, each after a slash; what follows the first DEPTH is one segment."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    general = F.transform(segments, lambda s: F.when(s.rlike("^[0-9a-fA-F-]{16,}$"), F.lit("{h}")).otherwise(F.regexp_replace(s, "[0-9]+", "{n}")))
    first = F.array_join(F.transform(F.slice(general, 1, DEPTH), lambda s: F.concat(F.lit("/"), s)), "")
    deep = F.size(general) > DEPTH
    return F.concat(first, F.when(deep, F.concat(F.lit("/"), F.array_join(F.slice(general, DEPTH + 1, F.greatest(F.size(general) - DEPTH, F.lit(0))), "\x1f"))).otherwise(""))


#: A starred template's leading segments that are variable, its first literal one, and the rest.
LEAD = r"^((?:/[^/]*[{*][^/]*)*)/([^/{*]+)((?:/.*)?)$"


def starred(counted: DataFrame) -> DataFrame:
    """(host, template, star) of counted (host, template, n): variable segments as wildcards."""
    nodes = counted.select("host", "template", "n", F.posexplode(F.filter(F.split("template", "/"), lambda s: s != "")).alias("at", "child"), F.split("template", "/").alias("parts"))
    nodes = nodes.select("host", "template", "n", "at", "child", F.concat_ws("/", F.slice("parts", F.lit(1), F.col("at") + 1)).alias("parent"))
    fan = nodes.groupBy("host", "parent", "child").agg(F.sum("n").alias("n")).groupBy("host", "parent").agg(F.count("*").alias("kids"), F.sum("n").alias("n"))
    wide = fan.where((F.col("kids") > FAN) & (F.col("kids") > FAN_SHARE * F.col("n"))).select("host", "parent", F.lit(True).alias("wide"))
    found = (
        nodes.join(wide, ["host", "parent"], "left")
        .groupBy("host", "template")
        .agg(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("wide"), "*").otherwise(F.col("child")).alias("s")))).alias("parts"))  # DEPTH + 1 segments at most
        .select("host", "template", F.concat_ws("", F.transform("parts", lambda p: F.concat(F.lit("/"), p["s"]))).alias("star"))
    )
    return counted.select("host", "template").join(found, ["host", "template"], "left").select("host", "template", F.coalesce("star", F.lit("")).alias("star"))


def merged(stars: DataFrame) -> DataFrame:
    """(host, star, final) of stars (host, star, n, labelled, blocked): similar siblings under one template."""
    at = stars.withColumn("pre", F.regexp_extract("star", LEAD, 1)).withColumn("lead", F.regexp_extract("star", LEAD, 2)).where("lead <> ''").withColumn("rest", F.regexp_extract("star", LEAD, 3))
    family, branch = ["host", "pre"], ["host", "pre", "lead"]
    below = at.groupBy(*family, "rest").agg(F.sum("n").alias("n_rest"))
    whole = below.groupBy(*family).agg(F.sum("n_rest").alias("n_all"), (F.count("*") - 1).alias("free"))
    branches = at.groupBy(*branch).agg(*[F.sum(c).alias(f"{c}_b") for c in ("n", "labelled", "blocked")])
    seen = at.select(*branch, "rest", "n").join(below, [*family, "rest"]).groupBy(*branch).agg(F.sum(F.col("n") * F.col("n") / F.col("n_rest")).alias("x"))
    spread = seen.join(branches, branch).join(whole, family).withColumn("chi", F.col("x") * F.col("n_all") / F.col("n_b") - F.col("n_b"))
    alike = spread.where(F.col("chi") <= F.col("free") + Z * F.sqrt(2.0 * F.col("free")) + 1e-6)
    rates = alike.groupBy(*family).agg(F.try_divide(F.sum("blocked_b"), F.sum("labelled_b")).alias("rate"))
    judged = alike.join(rates, family)
    agrees = (F.col("labelled_b") == 0) | (F.abs(F.try_divide("blocked_b", "labelled_b") - F.col("rate")) <= Z * F.sqrt(F.try_divide(F.col("rate") * (1 - F.col("rate")), F.col("labelled_b"))) + 1e-9)
    joins = judged.where(agrees).select(*branch, F.lit(True).alias("joins"))
    into = at.join(joins, branch).select("host", "star", F.concat("pre", F.lit("/*"), "rest").alias("into"))
    return stars.join(into, ["host", "star"], "left").select("host", "star", F.coalesce("into", "star").alias("final"))


def verdicts(counted: DataFrame) -> DataFrame:
    """Of (host, template, n, labelled, blocked): (host, template, reject)."""
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    branches = durable(counted.join(starred(counted), ["host", "template"]), "branches")
    stars = durable(branches.groupBy("host", "star").agg(*sums), "stars")
    final = durable(stars.join(merged(stars), ["host", "star"]), "final")
    judged = final.groupBy("host", "final").agg(*sums)
    reject = ((F.col("blocked") + 0.5) / (F.col("labelled") + 1.0) >= PURITY) & (F.col("labelled") >= EVIDENCE * F.col("n")) & (F.col("labelled") > 0)
    judged = judged.select("host", "final", reject.alias("reject"))
    return branches.select("host", "template", "star").join(final.select("host", "star", "final"), ["host", "star"]).join(judged, ["host", "final"]).select("host", "template", "reject")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict.

    A null url, or one without ://, has an empty host and path, which no rule fits, and is allowed. Repeated rows and
    null ids are kept. An empty table gives no rows. Of a very long path every segment counts (see DEPTH).
    """
    name, verdict = rule_of(rules)
    rows = parsed(pages).withColumn("rule", name).withColumn("label", verdict).withColumn("template", template())
    labelled = F.count("label").alias("labelled")
    counted = durable(rows.groupBy("host", "template").agg(F.count("*").alias("n"), labelled, F.count_if(F.col("label") == "block").alias("blocked")), "templates")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = hot_keys(counted, ["host", "template"], total, BUCKET, F.col("n"))
    found = salted_join(rows, verdicts(counted), ["host", "template"], hot, ["page_id"])
    method = F.when(F.col("reject"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("label", method).alias("verdict"))


def op9(spark, sf_dir: str) -> DataFrame:
    """judge() over the table pages by RULES; rows as there."""
    return judge(table(spark, sf_dir, "pages"))


#: The same steps for DuckDB.
OP9_SQL = r"""
with rest as (
  select page_id, case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end as rest from pages
), parsed as (
  select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substring(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1), '^[^?#]*') as path
  from rest
), pages_ as (
  select *,
    case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
         when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
         when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
         when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule,
    list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
      lambda s: case when regexp_matches(s, '^[0-9a-fA-F-]{16,}$') then '{h}' else regexp_replace(s, '[0-9]+', '{n}', 'g') end) as parts
  from parsed
), ruled as (
  select *, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' end as label,
    coalesce(array_to_string(list_transform(parts[1:12], lambda s: '/' || s), ''), '') || case when len(parts) > 12 then '/' || array_to_string(parts[13:], chr(31)) else '' end as template
  from pages_
), counted as (
  select host, template, count(*) as n, count(label) as labelled, count(*) filter (where label = 'block') as blocked from ruled group by host, template
), parts as (
  select host, template, n, string_split(template, '/') as p, unnest(range(1, len(string_split(template, '/')))) as pos from counted where template <> ''
), nodes as (
  select host, template, n, pos, p[pos + 1] as child, array_to_string(p[1:pos], '/') as parent from parts
), fan as (
  select host, parent, count(distinct child) as kids, sum(n) as n from nodes group by host, parent
), starred as (
  select nodes.host, nodes.template, string_agg('/' || case when kids > 16 and kids > 0.2 * fan.n then '*' else child end, '' order by pos) as star
  from nodes join fan using (host, parent) group by nodes.host, nodes.template
), branches as (
  select c.*, coalesce(star, '') as star from counted c left join starred s on c.host = s.host and c.template = s.template
), by_star as (
  select host, star, sum(n) as n, sum(labelled) as labelled, sum(blocked) as blocked from branches group by host, star
), split_ as (
  select *, regexp_extract(star, '^((?:/[^/]*[{*][^/]*)*)/([^/{*]+)((?:/.*)?)$', 1) as pre, regexp_extract(star, '^((?:/[^/]*[{*][^/]*)*)/([^/{*]+)((?:/.*)?)$', 2) as lead,
    regexp_extract(star, '^((?:/[^/]*[{*][^/]*)*)/([^/{*]+)((?:/.*)?)$', 3) as rest from by_star
), at_ as (select * from split_ where lead <> ''
), below as (select host, pre, rest, sum(n) as n_rest from at_ group by all
), whole as (select host, pre, sum(n_rest) as n_all, count(*) - 1 as free from below group by all
), spread as (
  select a.host, a.pre, a.lead, sum(a.n) as n_b, sum(labelled) as labelled_b, sum(blocked) as blocked_b, sum(a.n::double * a.n / n_rest) as x
  from at_ a join below b on a.host = b.host and a.pre = b.pre and a.rest = b.rest group by all
), alike as (
  select s.* from spread s join whole w on s.host = w.host and s.pre = w.pre where x * n_all / n_b - n_b <= free + 1.96 * sqrt(2.0 * free) + 1e-6
), rates as (
  select host, pre, case when sum(labelled_b) > 0 then sum(blocked_b) / sum(labelled_b) end as rate from alike group by all
), joins as (
  select a.host, a.pre, a.lead from alike a join rates r on a.host = r.host and a.pre = r.pre
  where labelled_b = 0 or abs(blocked_b / labelled_b - rate) <= 1.96 * sqrt(rate * (1 - rate) / labelled_b) + 1e-9
), final as (
  select l.host, l.star, l.n, l.labelled, l.blocked, case when j.lead is not null then l.pre || '/*' || l.rest else l.star end as final
  from split_ l left join joins j on l.lead <> '' and l.host = j.host and l.pre = j.pre and l.lead = j.lead
), judged as (
  select host, final, (sum(blocked) + 0.5) / (sum(labelled) + 1.0) >= 0.9 and sum(labelled) >= 0.05 * sum(n) and sum(labelled) > 0 as reject from final group by host, final
), verdicts as (
  select b.host, b.template, j.reject from branches b join final f on b.host = f.host and b.star = f.star join judged j on f.host = j.host and f.final = j.final
)
select page_id, r.host, r.path, r.rule, coalesce(r.label, case when v.reject then 'block' else 'allow' end) as verdict
from ruled r left join verdicts v on r.host = v.host and r.template = v.template
"""
