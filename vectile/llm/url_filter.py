"""Block and allow rules for urls, carried to the aliases of a page over redirects and canonical links.

DataFrame functions only. Pages whose urls differ only in scheme, mobile or www host, fragment, tracking parameters or
a closing slash are one address; the canonical and refresh links that pages declare join addresses into groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectile.operators.graph import connected_components


@dataclass(frozen=True)
class Rule:
    verdict: str  # block or allow
    host: str  # and all its subdomains
    path: str  # what the path begins with

    @property
    def name(self) -> str:
        return self.host + self.path


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty for null or no ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return _lower(F.regexp_extract(rest, r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Name of the longest rule that fits, or null; of equal lengths an allow rule, then the first by name."""
    order = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "allow", r.name))
    tests = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.name)) for r in order]
    return F.coalesce(*tests, F.lit(None).cast("string"))


def address(url: Column) -> Column:
    """One form for urls that lead to the same page; a url without host is itself."""
    host = F.regexp_replace(url_host(url), r"^(www|m)\.", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)")))
    form = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(host == "", url).otherwise(form)


def declared_links(html: Column) -> Column:
    """Targets of canonical links and refresh redirects in a page's markup, as written but for ``&amp;``."""
    canonical = F.regexp_extract_all(html, F.lit(r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?\s*canonical\b)[^>]*(?<![\w-])href\s*=\s*(\"[^\">]*|'[^'>]*|[^\s\"'>]+)"), 1)
    refresh = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b)[^>]*(?<![\w-])url\s*=\s*[\"']?\s*([^\"'>\s]+)"), 1)
    links = F.transform(F.concat(canonical, refresh), lambda x: F.regexp_replace(F.regexp_replace(x, r"^[\"']?\s+|^[\"']|\s+$", ""), r"(?i)&(?:amp|#38|#x26);", "&"))
    return F.filter(links, lambda x: x != "")


def resolved(link: Column, url: Column) -> Column:
    """A link of the page ``url`` as a whole url; null if it leads to no page or if the page has no host."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0)
    path = url_path(url)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"(?s)^.*/", 0), F.lit("")), F.lit("/"))
    rel = F.regexp_extract(link, r"(?s)^[^?#]*", 0)
    tail = F.substring(link, F.length(rel) + 1, F.length(link))
    own = F.regexp_extract(url, r"(?s)^[^#?]*(\?[^#]*)", 1)  # a fragment alone keeps the page's query
    parts = F.split(F.concat(F.when(rel.startswith("/"), "").otherwise(folder), rel), "/")
    # "." goes, ".." takes the folder before it along
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(
        x == "..", F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)
    ).otherwise(F.concat(a, F.array(x))))
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    there = F.concat(root, F.array_join(done, "/"), ends, tail)
    same = F.concat(root, path, F.when(tail.startswith("?"), tail).otherwise(F.concat(own, tail)))
    whole = F.when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(rel == "", same).otherwise(there)
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(~link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & (root != ""), whole)


def judge_urls(
    pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """(id, host, path, rule, verdict, address_group) of every row.

    A rule that fits the url itself decides. Else the url takes part in what is decided for its aliases, which are the
    urls connected with it by equal addresses, declared links and ``redirects`` (src, dst urls): allow if a rule allows
    one of them, block if a rule blocks one of them, and allow if nothing is known. Null, empty and hostless urls
    have no rule and no aliases but equal urls; null html declares nothing. Relative links are taken from the page's url. Equal
    rows are kept; other columns are not read.
    """
    url = F.col(url_col).cast("string")
    base = pages.select(F.col(id_col).alias("id"), url.alias("url"), F.col(html_col).cast("string").alias("html"))
    known = base.select("id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), address(F.col("url")).alias("at"))
    known = known.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    told = base.select("url", F.explode(declared_links(F.coalesce("html", F.lit("")))).alias("to"))
    links = told.select(address(F.col("url")).alias("i"), address(resolved(F.col("to"), F.col("url"))).alias("j"))
    if redirects is not None:
        links = links.unionByName(redirects.select(address(F.col("src")).alias("i"), address(F.col("dst")).alias("j")))
    groups = connected_components(links.where("i <> '' AND j <> ''").distinct(), forests=False)
    verdicts = {r.name: r.verdict for r in rules}
    says = F.lit(None).cast("string")
    for name, verdict in verdicts.items():
        says = F.when(F.col("rule") == name, verdict).otherwise(says)
    grouped = known.withColumn("says", says).join(groups.withColumnRenamed("id", "at").hint("merge"), "at", "left")
    grouped = grouped.withColumn("grp", F.coalesce("component", "at"))
    # only the ruled rows of a group meet, as two flags; rows without rule look their group up
    flags = grouped.where("says IS NOT NULL AND grp <> ''").groupBy("grp").agg(F.max(F.col("says") == "allow").alias("ok"), F.max(F.col("says") == "block").alias("bad"))
    ruled = grouped.where("says IS NOT NULL").withColumn("verdict", F.col("says"))
    free = grouped.where("says IS NULL").join(flags.hint("merge"), "grp", "left")
    free = free.withColumn("verdict", F.when(F.col("ok"), "allow").when(F.col("bad"), "block").otherwise("allow"))
    cols = ["id", "host", "path", "rule", "verdict", F.col("grp").alias("address_group")]
    return ruled.select(*cols).unionByName(free.select(*cols)).withColumnRenamed("id", id_col)
