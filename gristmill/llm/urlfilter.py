"""URL filters whose block decisions reach a page's aliases over redirects and canonical links.

Rules name a host and a path prefix; the longest that fits an address decides. An address that no rule fits takes
its decision from the addresses it is equivalent to: redirects and canonical links are edges of a graph of addresses, and
a connected component that holds an address blocked by a rule blocks all of its addresses that have no rule of their own.
An explicit allow is stronger: it is never overruled by an alias.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components, scratch

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The first ``://`` ends the scheme, then come host and path.
_ADDRESS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)([^#]*)"

#: What a reader of a page skips, then the tags that hold links.
_TAGS = re.compile(r"<!--.*?(?:-->|$)|<(script|style|textarea|title|noscript|template)\b.*?(?:</\1\s*>|$)|<(link|meta|base)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I | re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
_REFRESH = re.compile(r"^\s*[\d.]*\s*[;,\s]\s*url\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(.*))", re.I | re.S)
_MAY_LINK = re.compile(r"canonical|refresh", re.I)


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to a slash, question mark or number sign, A to Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, _ADDRESS, 2), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark or number sign; empty where there is no host."""
    return F.coalesce(F.regexp_extract(url, _ADDRESS, 3), F.lit(""))


def address_of(url: Column) -> Column:
    """One spelling for an address: scheme and host lower-cased, an empty path as ``/``, no fragment. Null without ``://``."""
    path = F.regexp_extract(url, _ADDRESS, 3)
    whole = F.concat(F.translate(F.regexp_extract(url, _ADDRESS, 1), _UPPER, _LOWER), F.lit("://"), host_of(url), F.when(path == "", "/").otherwise(path), F.regexp_extract(url, _ADDRESS, 4))
    return F.when(F.contains(url, F.lit("://")), whole)


def deciding_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The rule (action, host, path) that fits and is longest, as a struct of ``rule`` and ``action``; null if none fits.

    A rule fits its host, all subdomains, and the paths that start with its own. Of two equally long ones an allow wins.
    """
    best = F.lit(None).cast("struct<rule:string,action:string>")
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != ALLOW, r[1] + r[2]))
    cases = [F.when(((host == own) | host.endswith(f".{own}")) & path.startswith(start), F.struct(F.lit(own + start).alias("rule"), F.lit(action).alias("action"))) for action, own, start in order]
    return F.coalesce(*cases, best)


def page_links(url: str, page: str) -> list[str]:
    """Where a page says it is also found: its canonical links and the target of an immediate or timed refresh, made absolute.

    Comments, scripts and other raw text are skipped; a ``base`` counts from where it stands first.
    """
    found, base = [], url
    for tag in _TAGS.finditer(page):
        if not tag[2]:
            continue
        values: dict[str, str] = {}
        for name, *value in _ATTRIBUTE.findall(tag[3]):
            values.setdefault(name.lower(), html.unescape("".join(value)).strip())
        kind, target = tag[2].lower(), None
        if kind == "base" and base is url and values.get("href"):
            base = joined(url, values["href"]) or url
        elif kind == "link" and "canonical" in values.get("rel", "").lower().split():
            target = values.get("href")
        elif kind == "meta" and values.get("http-equiv", "").lower() == "refresh" and (m := _REFRESH.match(values.get("content", ""))):
            target = next((x for x in m.groups() if x), "").strip()
        if target and (target := joined(base, target)):
            found.append(target)
    return found


def joined(base: str, link: str) -> str | None:
    """The link seen from ``base``; None if it is no address with a host."""
    try:
        out = urljoin(base, link)
    except ValueError:
        return None
    return out if "://" in out else None


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (url, html) to (src, dst)."""
    for batch in batches:
        src, dst = [], []
        for url, page in zip(*batch.columns, strict=True):
            page = page.as_py()
            if page and _MAY_LINK.search(page):
                own = url.as_py()
                for target in page_links(own, page):
                    src.append(own)
                    dst.append(target)
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(dst, pa.string())], ["src", "dst"])


def alias_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): the redirects and canonical links that stand in pages with an address."""
    rows = pages.select(scratch.column(pages, url_col).cast("string").alias("url"), scratch.column(pages, html_col).cast("string").alias("html"))
    return rows.where("contains(url, '://')").mapInArrow(_linked, "src string, dst string")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, host, path, rule, verdict, via_alias`` for every row of ``pages``.

    ``rules`` are (action, host, path) with actions ``allow`` and ``block``. ``redirects`` may hold further equivalences (src,
    dst), such as a crawler's log; those in the pages themselves are always used. The verdict is the rule's; without a rule it is
    ``block`` if an address of the same component is blocked by a rule, whether or not it is a page here, and ``allow`` if not.
    ``via_alias`` tells the former case.

    A null address, or one without ``://``, has an empty host and path, no rule, no aliases, and is allowed. A null or empty
    page has no links. Repeated rows, and different rows of one id, are judged each by itself; a null id stays null. Very long
    pages are read whole. Further columns of any name are ignored. An empty table gives an empty result.

    Addresses meet by a 64-bit hash: of n linked addresses two are mixed up with a chance of n^2 / 2^65. Only addresses that have a
    link are in the graph, and only pages without a rule look up their component.
    """
    url = scratch.column(pages, url_col).cast("string")
    rows = pages.select(scratch.column(pages, id_col).alias("id"), url.alias("url")).select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.xxhash64(address_of(F.col("url"))).alias("node"), F.contains("url", F.lit("://")).alias("known"))
    rows = rows.select("*", deciding_rule(F.col("host"), F.col("path"), rules).alias("own"))

    links = alias_links(pages, url_col, html_col)
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("src").cast("string"), F.col("dst").cast("string")))
    links = links.select(address_of(F.col("src")).alias("src"), address_of(F.col("dst")).alias("dst")).where("src <> dst")
    links = scratch.write(links.select("src", "dst", F.xxhash64("src").alias("a"), F.xxhash64("dst").alias("b")), "alias-links")
    of = components.connected_components(links.select("a", "b"))
    ends = links.select(F.col("a").alias("node"), F.col("src").alias("url")).unionByName(links.select(F.col("b").alias("node"), F.col("dst").alias("url")))
    blocked = ends.where(deciding_rule(host_of(F.col("url")), path_of(F.col("url")), rules)["action"] == BLOCK).select("node").distinct()
    reached = of.join(blocked, "node", "left_semi").select("component").distinct()
    aliases = scratch.write(of.join(reached, "component", "left_semi").select("node", F.lit(True).alias("hit")), "blocked-aliases")

    ruled, free = rows.where("own is not null or not coalesce(known, false)"), rows.where("own is null and known")
    free = free.join(aliases, "node", "left")
    judged = ruled.withColumn("hit", F.lit(False)).unionByName(free.select(*rows.columns, F.coalesce("hit", F.lit(False)).alias("hit")))
    verdict = F.coalesce("own.action", F.when(F.col("hit"), BLOCK).otherwise(ALLOW))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), F.col("hit").alias("via_alias"))
