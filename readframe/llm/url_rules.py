"""URL filter: block and allow rules, carried along redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readframe.llm.shared import components, join_back

#: The rules of the registered query, (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ATTRIBUTE = r"""\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What a URL names: host, path and query, whatever its scheme and fragment; null without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def resolved(target: Column, url: Column) -> Column:
    """The absolute URL of a link on the page at ``url``; null if it names no other page by host and path."""
    target = F.regexp_replace(target, "&(?:amp|AMP|#0*38|#[xX]0*26);", "&")
    path = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    rest = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    own = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    host = F.concat(F.lit("http://"), host_of(url))
    return (
        F.when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") | target.startswith("#") | (target == ""), F.lit(None).cast("string"))
        .when(target.startswith("?"), F.concat(host, own, target))
        .otherwise(F.concat(host, without_dots(F.when(target.startswith("/"), path).otherwise(F.concat(F.regexp_extract(own, "(?s)^(.*/)", 1), path))), rest))
    )


def without_dots(path: Column) -> Column:
    """A path that begins with ``/`` with its segments ``.`` and ``..`` resolved."""
    segments = F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), r"((?:^|/)[.]{1,2})$", "$1/"), "/")
    none = F.array().cast("array<string>")
    steps = F.aggregate(
        segments, none, lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x)))
    )
    return F.concat(F.lit("/"), F.array_join(steps, "/"))


def alias_edges(pages: DataFrame) -> DataFrame:
    """Pairs (a, b) of URLs that name one page by its own word: canonical links, and redirects by refresh.

    Links without a scheme and host are taken relative to the page's URL, with dot segments resolved.  Ampersands may be
    written as entities.  Links inside the page (``#...``) and other schemes (``mailto:``) name nothing.
    """
    html = F.coalesce("html", F.lit(""))
    canonical = F.regexp_extract_all(html, F.lit(r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)"), 1)
    refresh = F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)"), 1)
    named = F.concat(
        F.transform(canonical, lambda t: F.regexp_extract(t, r"(?is)\bhref" + ATTRIBUTE, 1)),
        F.transform(refresh, lambda t: F.regexp_extract(t, r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1)),
    )
    links = pages.where(F.col("url").contains("://")).select("url", F.explode(named).alias("target"))
    return links.select(node_of(F.col("url")).alias("a"), node_of(resolved(F.col("target"), F.col("url"))).alias("b")).where("b is not null")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], edges: DataFrame | None = None) -> DataFrame:
    """Verdict for every page's URL: (page_id, host, path, rule, verdict).

    A rule (host, path, verdict) fits its host and all subdomains if the path starts with the rule's; the longest wins,
    of equally long ones allow.  A URL without a rule takes the verdict of its aliases, the URLs of its component over
    ``edges`` (by default :func:`alias_edges`): allow if a rule allows one of them, else block if a rule blocks one, else
    allow.  Rules decide first, so an allowed alias of a blocked page stays allowed.

    Null url, or one without ``://``: empty host and path, no rule, no alias, allowed.  Null html: no links.  Null or
    repeated page_id: one row for each input row.  Further columns are ignored.  No rows: no rows.
    """
    return _judged(pages.select(F.struct("page_id").alias("row"), "url"), alias_edges(pages) if edges is None else edges, rules).select(
        "row.page_id", "host", "path", "rule", "verdict"
    )


def _judged(rows: DataFrame, edges: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rows (row, host, path, rule, verdict) from rows (row, url)."""
    asked = rows.select("row", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    groups = components(edges.select("a", "b"))
    url = F.concat(F.lit("x://"), "node")
    groups = groups.select("node", "component", host_of(url).alias("host"), path_of(url).alias("path"))
    given = rows.sparkSession.createDataFrame(rules, "rule_host string, rule_path string, decision string")
    ruled = ruling(asked.select("host", "path").union(groups.select("host", "path")), given)
    votes = _with_rule(groups, ruled).groupBy("component").agg(F.min("decision").alias("voted"))  # allow sorts before block
    aliases = join_back(groups, votes, "component").select("node", "voted")
    verdict = F.coalesce("decision", "voted", F.lit("allow")).alias("verdict")
    return _with_rule(asked, ruled).join(aliases, "node", "left").select("row", "host", "path", "rule", verdict)


def _with_rule(rows: DataFrame, ruled: DataFrame) -> DataFrame:
    """Add the rule and decision of each row's host and path.

    Both sides are dealt out anew by one name for the two: ``ruled`` comes from an aggregate by host and path, and where a
    join takes its partitions over, adaptive execution cannot split the rows of a hot path.  A host holds no slash.
    """
    name = F.concat("host", F.lit("/"), "path")
    return rows.withColumn("_name", name).join(ruled.select(name.alias("_name"), "rule", "decision"), "_name", "left").drop("_name")


def ruling(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule that fits each (host, path): (host, path, rule, decision); no row where none fits."""
    labels = F.split("host", "[.]")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = paths.distinct().select("host", "path", F.explode(hosts).alias("rule_host"))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), (F.col("decision") == "allow").alias("allows"), rule.alias("rule"), F.col("decision").alias("decision")))
    fitting = tried.join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    return fitting.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.decision")


def allowed_pages(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Pages whose URL is allowed, with all their columns; each row goes by its own URL, whatever its page_id."""
    rows = pages.select(F.struct("*").alias("row"), "url")
    return _judged(rows, alias_edges(pages), rules).where("verdict = 'allow'").select("row.*")
