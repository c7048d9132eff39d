"""URL filters: a trie over reversed host labels and path segments.

The trie goes from the top-level label inwards (`org`, `example`), and from each host on through the path's
segments. A rule's last path segment is a prefix (`/en/1` covers `/en/17`), so each path node keeps its
endings in a small table by length. The longest matching rule decides: the deepest host first, then the
longest path. Rules are a bounded parameter (`MOST_RULES`); the trie is built once and broadcast.

Defined cases: a null url, or one without `://`, has an empty host and path, matches nothing and gets the
default verdict; rows that repeat a page_id are each judged; an empty table gives an empty result; an empty
rule list leaves the default to all; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DEFAULT = "allow"
#: A trie of so many rules stays within some 500 MB; more are refused rather than broadcast.
MOST_RULES = 1_000_000
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass
class _Path:
    #: whole segments that lead further
    next: dict[str, _Path] = field(default_factory=dict)
    #: length -> ending -> (rule, verdict); an ending is a prefix of the segment that stands here
    endings: dict[int, dict[str, tuple[str, str]]] = field(default_factory=dict)


@dataclass
class _Host:
    next: dict[str, _Host] = field(default_factory=dict)
    path: _Path | None = None


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty if it has no `://`."""
    m = _URL.search(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def build(rules: Iterable[tuple[str, str, str]]) -> _Host:
    """The trie. Of two rules for the same host and path the blocking one stays."""
    root = _Host()
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.next.setdefault(label, _Host())
        node.path = node.path or _Path()
        at = node.path
        *whole, last = path.split("/")
        for segment in whole:
            at = at.next.setdefault(segment, _Path())
        ends = at.endings.setdefault(len(last), {})
        if last not in ends or verdict == "block":
            ends[last] = (host + path, verdict)
    return root


def longest_path(node: _Path, segments: list[str]) -> tuple[str, str] | None:
    found = None
    for segment in segments:
        fits = [n for n in node.endings if n <= len(segment) and segment[:n] in node.endings[n]]
        if fits:
            found = node.endings[max(fits)][segment[: max(fits)]]
        if segment not in node.next:
            return found
        node = node.next[segment]
    return found


def judge(root: _Host, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest match, or None."""
    node, found, segments = root, None, path.split("/")
    for label in reversed(host.split(".")):
        if label not in node.next:
            break
        node = node.next[label]
        if node.path is not None:
            found = longest_path(node.path, segments) or found
    return found


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for every row."""
    rules = tuple(rules)
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    shared = pages.sparkSession.sparkContext.broadcast(build(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = shared.value
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [judge(root, *p) for p in parts]
            text = lambda values: pa.array(values, pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), text([p[0] for p in parts]), text([p[1] for p in parts]), text([f and f[0] for f in found]), text([f[1] if f else default for f in found])],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return narrow.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def op5_urlfilter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


OP5_SQL = r"""
WITH r(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (
  SELECT page_id, row_number() OVER () AS n,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), m AS (
  SELECT n, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY n ORDER BY len(rh) DESC, len(rp) DESC) AS k
  FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m ON u.n = m.n AND m.k = 1
"""
