"""URL rules by a sort-merge range join.

The canonical key of a host is its labels in reverse order, each followed by a dot, so that a host and its
subdomains fill one interval of the key order; the urls under a path prefix fill one interval of the path
order. Each partition's rows are sorted by (key, path) and swept against the sorted rules: a stack holds the
nested rule hosts that contain the current host, and for each of them a stack holds the nested rule paths that
contain the current path. The longest rule on the stacks wins.

Rows never move between tasks. Rules are sent along in blocks of at most ``RULES_PER_BLOCK``; more rules mean
more sweeps over the same rows, which carry the best rule so far.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, table

#: Host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Bound of what a task gets at once.
RULES_PER_BLOCK = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` and the path up to ``?`` or ``#``; empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: str) -> str:
    return "".join(f"{label}." for label in reversed(host.split("."))) if host else ""


class PrefixSweep:
    """Of sorted distinct prefixes, keeps those on a stack that begin the current key; keys must ascend."""

    def __init__(self, prefixes: Sequence[str]):
        self.prefixes, self.next, self.stack = prefixes, 0, []

    def to(self, key: str) -> list[int]:
        p, stack = self.prefixes, self.stack
        while stack and not key.startswith(p[stack[-1]]):
            stack.pop()
        while self.next < len(p) and p[self.next] <= key:
            if key.startswith(p[self.next]):
                stack.append(self.next)
            self.next += 1
        return stack


class RuleSweep:
    """The winning rule for rows in ascending (host key, path): longest rule string, then longest host, then first in order."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        nodes: dict[str, dict[str, tuple[str, str]]] = {}
        hosts: dict[str, str] = {}
        for host, path, verdict in sorted(rules):
            nodes.setdefault(key := host_key(host), {}).setdefault(path, (host + path, verdict))
            hosts[key] = host
        self.keys = sorted(nodes)
        self.hosts = [hosts[k] for k in self.keys]
        self.paths = [sorted(nodes[k]) for k in self.keys]
        self.rules = [[nodes[k][p] for p in ps] for k, ps in zip(self.keys, self.paths, strict=True)]
        self.sweep, self.key, self.active = PrefixSweep(self.keys), None, []

    def to(self, key: str, path: str) -> tuple[str, str] | None:
        if key != self.key:
            self.key = key
            self.active = [(i, PrefixSweep(self.paths[i])) for i in self.sweep.to(key)]
        best, rank = None, (-1, -1)
        for i, sweep in self.active:
            if (found := sweep.to(path)) and (r := (len((rule := self.rules[i][found[-1]])[0]), len(self.hosts[i]))) > rank:
                best, rank = rule, r
        return best


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, *, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: its id, host, path, the winning rule (null if none fits) and the verdict.

    A rule fits its host and the subdomains if the url's path starts with the rule's path; an empty rule host
    fits every url. Null urls have an empty host and path. Repeated rows are judged each; other columns are not
    read; no pages give no rows; no rules give the default verdict everywhere.
    """
    ship(pages.sparkSession)
    rules = sorted(set(map(tuple, rules)))
    host, path = host_and_path(F.col("url"))
    rows = (
        pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"))
        .select("page_id", host.alias("host"), path.alias("path"))
        .withColumn("key", F.when(F.col("host") == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("."))))
        .withColumn("rule", F.lit(None).cast("string"))
        .withColumn("verdict", F.lit(default))
        .sortWithinPartitions("key", "path")
    )
    for k in range(0, len(rules), RULES_PER_BLOCK):
        rows = rows.mapInArrow(_swept(rules[k : k + RULES_PER_BLOCK]), rows.schema)
    return rows.drop("key")


def _swept(rules: list[tuple[str, str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = RuleSweep(rules)
        for b in batches:
            won, verdicts = b.column("rule").to_pylist(), b.column("verdict").to_pylist()
            for i, (key, path) in enumerate(zip(b.column("key").to_pylist(), b.column("path").to_pylist(), strict=True)):
                found = sweep.to(key, path)
                if found and (won[i] is None or len(found[0]) > len(won[i])):
                    won[i], verdicts[i] = found
            n = b.schema.names
            b = b.set_column(n.index("rule"), "rule", pa.array(won, pa.string()))
            yield b.set_column(n.index("verdict"), "verdict", pa.array(verdicts, pa.string()))

    return run


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rhost, rpath, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT s.page_id, s.host, s.path, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST, length(r.rhost) DESC) AS rn
  FROM split s LEFT JOIN rules r ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE rn = 1
"""
