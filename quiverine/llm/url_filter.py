"""URL filters: a trie over reversed host labels, with path prefixes.

A rule is a host and a path; it fits its host and every subdomain of it if the
url's path starts with the rule's path. The rules make a trie: the labels of
the host from the right (``org``, ``example``, ...), and under each host node a
second trie over the path's segments, whose last, perhaps unfinished, segment
is a prefix test. The lookup walks the host labels once and the path segments
once; the deepest host with a fitting path wins, then the longest path. The
trie is broadcast; its size is that of the rule list and is checked.

Defined results: a null url, or one without ``://``, has an empty host and path
and takes the default verdict. A url repeated is judged alike each time. An
empty table gives an empty result. A rule's host is read in lower case (A-Z), as
a url's is; a rule that stands twice counts once, and two that give one host
and path different verdicts are refused.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverine.llm.common import arrow_map, read

ALLOW, BLOCK = "allow", "block"
_LOWER = {c: c + 32 for c in range(65, 91)}
#: The largest pickled trie that is broadcast; longer lists belong in a join.
MAX_TRIE_BYTES = 256 << 20


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The contract's rule list, in its order.
RULES = (
    Rule("org", "/", ALLOW),
    Rule("example.org", "/es/", BLOCK),
    Rule("example.org", "/en/1", BLOCK),
    Rule("com", "/fr/", ALLOW),
    Rule("com", "/de/", BLOCK),
)


class PathNode:
    """Rules of one host under a sequence of whole path segments."""

    __slots__ = ("children", "whole", "starts")

    def __init__(self) -> None:
        self.children: dict[str, PathNode] = {}
        self.whole: Rule | None = None  # the rule's path ends with the slash that leads here
        self.starts: list[tuple[str, Rule]] = []  # unfinished last segments, longest first


class HostNode:
    __slots__ = ("children", "paths")

    def __init__(self) -> None:
        self.children: dict[str, HostNode] = {}
        self.paths: PathNode | None = None


class UrlTrie:
    def __init__(self, rules: Iterable[Rule]) -> None:
        self.root = HostNode()
        for rule in rules:
            self.add(rule)

    def add(self, rule: Rule) -> None:
        if rule.verdict not in (ALLOW, BLOCK):
            raise ValueError(f"verdict of {rule.name!r} must be {ALLOW} or {BLOCK}")
        node, host = self.root, rule.host.translate(_LOWER)
        for label in reversed(host.split(".")):
            node = node.children.setdefault(label, HostNode())
        node.paths = at = node.paths or PathNode()
        *whole, last = rule.path.split("/")
        for segment in whole:
            at = at.children.setdefault(segment, PathNode())
        known = at.whole if not last else next((r for s, r in at.starts if s == last), None)
        if known is not None:
            if known.verdict != rule.verdict:
                raise ValueError(f"{rule.name!r} is both allowed and blocked")
        elif not last:
            at.whole = rule
        else:
            at.starts.append((last, rule))
            at.starts.sort(key=lambda x: -len(x[0]))

    @staticmethod
    def _path(at: PathNode, segments: list[str]) -> Rule | None:
        """The rule with the longest path that starts this path."""
        best = at.whole
        for k, segment in enumerate(segments):
            for start, rule in at.starts:
                if segment.startswith(start):
                    best = rule
                    break
            if k == len(segments) - 1 or (at := at.children.get(segment)) is None:
                break
            best = at.whole or best
        return best

    def find(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits: the deepest host first, then the path."""
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            if (node := node.children.get(label)) is None:
                break
            if node.paths is not None:
                best = self._path(node.paths, segments) or best
        return best


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty without ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(url, parts, 1), upper, lower)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def judge_urls(df: DataFrame, rules: Iterable[Rule], key: str = "page_id", url: str = "url", default: str = ALLOW) -> DataFrame:
    """``key``, host, path, rule and verdict of every row of ``df``.

    Only the two named columns are read, so others may have any name.
    """
    trie = pickle.dumps(UrlTrie(rules))
    if len(trie) > MAX_TRIE_BYTES:
        raise ValueError(f"the rules' trie has {len(trie)} bytes; at most {MAX_TRIE_BYTES} are broadcast")
    shared = df.sparkSession.sparkContext.broadcast(trie)
    host, path = url_parts(F.col(url))
    parts = df.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    kind = parts.schema["key"].dataType.simpleString()
    kept: dict[str, UrlTrie] = {}

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "trie" not in kept:
            kept["trie"] = pickle.loads(shared.value)
        find = kept["trie"].find
        found = [find(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        rule = pa.array([r and r.name for r in found], pa.string())
        verdict = pa.array([r.verdict if r else default for r in found], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns[:3], rule, verdict], [key, "host", "path", "rule", "verdict"])

    return arrow_map(parts, judge, f"`{key}` {kind}, host string, path string, rule string, verdict string")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rules over every url of ``pages``."""
    return judge_urls(read(spark, sf_dir, "pages"), RULES)


ORACLE = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), judged AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/' END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""
