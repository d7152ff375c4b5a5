"""URL filters: a trie over reversed host labels and path segments, broadcast to the executors.

A rule is ``host/path``: it fits the host and all its subdomains where the URL's path starts with the
rule's path.  The most specific rule wins: the longest host first, then the longest path.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule; an empty table
gives an empty result; extra columns pass through :func:`judge` unless it writes them itself (``host``,
``path``, ``rule``, ``verdict`` replace columns of those names); repeated rows are judged one by one.
Rules of equal host and path must agree, otherwise :class:`ValueError`.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelforge.llm.common import quoted, unused

#: (verdict, rule) as the query of this operator uses them.
BASE_RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: The rule list is shipped whole to every executor; this bounds it.
MAX_RULES = 1_000_000

OUT = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])


class Node:
    __slots__ = ("below", "path")

    def __init__(self) -> None:
        self.below: dict[str, Node] = {}
        self.path: PathNode | None = None


class PathNode:
    """Whole segments lead on; ``ends`` holds the last, perhaps unfinished segment of rules that end here."""

    __slots__ = ("below", "ends")

    def __init__(self) -> None:
        self.below: dict[str, PathNode] = {}
        self.ends: dict[str, tuple[str, str]] = {}


def build(rules: Iterable[tuple[str, str]]) -> Node:
    root = Node()
    for n, (verdict, rule) in enumerate(rules):
        if n >= MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        host, slash, path = rule.partition("/")
        at = root
        for label in reversed(host.lower().split(".")):
            at = at.below.setdefault(label, Node())
        at.path = p = at.path or PathNode()
        *whole, last = (slash + path).split("/")
        for segment in whole:
            p = p.below.setdefault(segment, PathNode())
        if p.ends.setdefault(last, (rule, verdict)) != (rule, verdict):
            raise ValueError(f"rules disagree: {rule}")
    return root


def find_path(node: PathNode, path: str) -> tuple[str, str] | None:
    """The longest rule path that ``path`` starts with."""
    found, segments = None, path.split("/")
    for k, segment in enumerate(segments):
        for end in range(len(segment), -1, -1):
            if segment[:end] in node.ends:
                found = node.ends[segment[:end]]
                break
        following = node.below.get(segment) if k + 1 < len(segments) else None
        if following is None:
            break
        node = following
    return found


def find(root: Node, host: str, path: str) -> tuple[str, str] | None:
    found, at = None, root
    for label in reversed(host.split(".")) if host else ():
        at = at.below.get(label)
        if at is None:
            break
        if at.path is not None:
            found = find_path(at.path, path) or found
    return found


def split_url(url) -> tuple:
    """(host, path) columns of a URL column.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to
    ``?``, ``#`` or the end.
    """
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]] = BASE_RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (null where none fits) and ``verdict`` to every row."""
    trie = pages.sparkSession.sparkContext.broadcast(build(rules))

    @F.pandas_udf(OUT)
    def look(hosts, paths):
        import pandas as pd

        known: dict[tuple[str, str], tuple[str | None, str]] = {}
        rows = []
        for key in zip(hosts, paths):
            if key not in known:
                known[key] = find(trie.value, *key) or (None, default)
            rows.append(known[key])
        return pd.DataFrame(rows, columns=["rule", "verdict"], dtype=object)

    host, path = split_url(quoted(url))
    # Both columns first: host and path of the input must not be read in place of the new ones.
    h, p, found = unused(pages, "pf_host", "pf_path", "pf_found")
    named = pages.select("*", host.alias(h), path.alias(p)).withColumn(found, look(h, p))
    own = [quoted(c) for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    return named.select(*own, F.col(h).alias("host"), F.col(p).alias("path"), F.col(f"{found}.rule").alias("rule"), F.col(f"{found}.verdict").alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


#: DuckDB: every rule against every url, the longest kept.
SQL = r"""
WITH rules(verdict, host, path) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, r,
  translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT p.page_id, u.verdict, u.host || u.path AS rule,
  row_number() OVER (PARTITION BY p.page_id ORDER BY length(u.host) DESC, length(u.path) DESC) AS k
  FROM parts p JOIN rules u ON (p.host = u.host OR p.host LIKE '%.' || u.host) AND starts_with(p.path, u.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1
"""
