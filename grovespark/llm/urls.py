"""URL filters: a trie over reversed host labels, then path segments, with longest-match precedence.

The trie is broadcast if its pickled size is small; a larger rule list goes through a join instead. Both give the same results.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Rule = tuple[str, str, str]

#: Rules of the query: host, path, verdict.
RULES: list[Rule] = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: The verdict where no rule fits.
DEFAULT = "allow"
#: Bytes of a pickled trie that is broadcast at most (about ten times as much in a worker's memory); larger ones aren't built, but joined.
BROADCAST_BYTES = 16_000_000


def host_of(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark, number sign or the end, with A-Z lowered; else empty."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, number sign or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Nodes are dicts: host labels from the last to the first, then, under the key None, path segments.

    A path's last segment need not be whole: its node keeps (start of the next segment, rule number) pairs under "".
    """

    def __init__(self, rules: Iterable[Rule]):
        self.rules = list(dict.fromkeys(rules))
        self.root: dict = {}
        for number, (host, path, _) in enumerate(self.rules):
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *segments, rest = path.split("/")
            for segment in segments:
                node = node.setdefault((segment,), {})
            node.setdefault("", []).append((rest, number))
        # longest first; of equally long ones blocking wins, then the smaller text of host and path together, by bytes, as Spark orders strings
        order = sorted(range(len(self.rules)), key=lambda i: (-len(self.rules[i][0] + self.rules[i][1]), self.rules[i][2] != "block", (self.rules[i][0] + self.rules[i][1]).encode(), self.rules[i][2].encode()))
        self.rank = {number: place for place, number in enumerate(order)}

    def match(self, host: str, path: str) -> int:
        """The number of the longest rule that fits, or -1."""
        found, node = [], self.root
        for label in reversed(host.split(".")):
            if (node := node.get(label)) is None:
                break
            if None in node:
                self._paths(node[None], path, found)
        return min(found, key=self.rank.__getitem__, default=-1)

    @staticmethod
    def _paths(node: dict, path: str, found: list[int]) -> None:
        at = 0
        while True:
            found += [number for rest, number in node.get("", ()) if path.startswith(rest, at)]
            end = path.find("/", at)
            if end < 0 or (node := node.get((path[at:end],))) is None:
                return
            at = end + 1


def judge(pages: DataFrame, rules: Iterable[Rule], default: str = DEFAULT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins, of equally long ones blocking. rule is null and
    verdict is the default where none fits, as for null urls and those without ://. Repeated rows stay; an empty table
    gives an empty one; urls of any length are read whole; other columns, also such named host or rule, are ignored.
    """
    rules = list(dict.fromkeys(rules))
    rows = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    trie = Trie(rules) if sum(len(h) + len(p) for h, p, _ in rules) <= broadcast_bytes else None
    if trie is None or len(pickle.dumps(trie)) > broadcast_bytes:
        return judge_by_join(rows, rules, default)
    shared = pages.sparkSession.sparkContext.broadcast(trie)

    @F.pandas_udf("rule string, verdict string")
    def told(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        own = shared.value
        fits = [own.rules[i] if i >= 0 else None for i in map(own.match, host, path)]
        return pd.DataFrame({"rule": [r and r[0] + r[1] for r in fits], "verdict": [r[2] if r else default for r in fits]}, dtype=object)

    return rows.withColumn("told", told("host", "path")).select("page_id", "host", "path", "told.rule", "told.verdict")


def judge_by_join(rows: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same for rule lists that are too large to broadcast: each distinct (host, path) meets the rules of its host's suffixes."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(h, p, v, h + p) for h, p, v in rules], "rule_host string, rule_path string, rule_verdict string, rule string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = rows.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes))
    fits = pairs.join(table, "rule_host").where(F.expr("startswith(path, rule_path)"))
    best = fits.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("n"), (F.col("rule_verdict") != "block").alias("b"), "rule", "rule_verdict")).alias("best"))
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", "best.rule", F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by the fixed rules; null and odd urls, repeats, ties and an empty table as in judge()."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_url_filter": op8_url_filter}
SQL: dict[str, str] = {
    "op8_url_filter": r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(rule_host, rule_path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT u.*, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1""",
}
