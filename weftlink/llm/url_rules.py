"""URL allow and block rules: a trie over reversed host labels, then path segments.

The longest fitting rule wins: most host characters first, then most path characters.
Rules are few; ``judge_urls`` broadcasts the trie while the rules hold at most
``broadcast_rules`` entries and joins by host suffix beyond that.

Defined results: null url or one without ``://`` has empty host and path, fits no rule
and gets ``default``; a url without a path has path ``''``, which no rule with a path
fits; of equal rules the last one counts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm.common import table

#: The rules of the registered query, (host, path, verdict).
CONTRACT_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


class UrlTrie:
    """Host labels from the top-level one down; at the end of a rule's host, its path's segments."""

    __slots__ = ("hosts", "paths")

    def __init__(self) -> None:
        self.hosts: dict[str, UrlTrie] = {}
        self.paths: PathTrie | None = None

    @classmethod
    def of(cls, rules: Sequence[tuple[str, str, str]]) -> UrlTrie:
        top = cls()
        for host, path, verdict in rules:
            node = top
            for label in reversed(host.split(".")) if host else ():
                node = node.hosts.setdefault(label, cls())
            node.paths = node.paths or PathTrie()
            node.paths.add(path, (host + path, verdict))
        return top

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest fitting rule."""
        node, fits = self, self.paths and self.paths.find(path)
        for label in reversed(host.split(".")) if host else ():
            node = node.hosts.get(label)
            if node is None:
                break
            fits = (node.paths and node.paths.find(path)) or fits
        return fits or None


class PathTrie:
    """Whole segments lead from node to node; a rule's last, perhaps partial segment is kept as a prefix."""

    __slots__ = ("ends", "nodes")

    def __init__(self) -> None:
        self.nodes: dict[str, PathTrie] = {}
        self.ends: dict[str, tuple[str, str]] = {}

    def add(self, path: str, value: tuple[str, str]) -> None:
        *whole, last = path.split("/")
        node = self
        for segment in whole:
            node = node.nodes.setdefault(segment, PathTrie())
        node.ends[last] = value

    def find(self, path: str) -> tuple[str, str] | None:
        node, best = self, None
        for segment in path.split("/"):
            fitting = [e for e in node.ends if segment.startswith(e)]
            if fitting:
                best = node.ends[max(fitting, key=len)]
            node = node.nodes.get(segment)
            if node is None:
                break
        return best


def _host(url):
    after = F.element_at(F.split(url, "://", 2), 2)
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    return F.when(F.instr(url, "://") > 0, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def _path(url):
    after = F.element_at(F.split(url, "://", 2), 2)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def parse_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path) of every row."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    return pages.select(F.col(id_col), _host(url).alias("host"), _path(url).alias("path"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    broadcast_rules: int = 100_000,
) -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``."""
    parsed = parse_urls(pages, id_col, url_col)
    spark = pages.sparkSession
    if len(rules) > broadcast_rules:
        return _judge_by_join(parsed, rules, id_col, default)
    trie = spark.sparkContext.broadcast(UrlTrie.of(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = trie.value
        for batch in batches:
            found = [top.find(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            rule = pa.array([f and f[0] for f in found], pa.string())
            verdict = pa.array([f[1] if f else default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[*batch.schema.names, "rule", "verdict"])

    kind = dict(parsed.dtypes)[id_col]
    return parsed.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def _judge_by_join(parsed: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str, default: str) -> DataFrame:
    """As the trie, by an equi-join on host suffixes: for rule lists too large to broadcast."""
    last = {(h, p): v for h, p, v in rules}
    listed = parsed.sparkSession.createDataFrame([(h, p, v) for (h, p), v in last.items()], "r_host string, r_path string, r_verdict string")
    hosts = parsed.select("host").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = (
        hosts.select("host", F.explode(F.array_union(suffixes, F.array(F.lit("")))).alias("r_host"))
        .join(listed, "r_host")
        .groupBy("host")
        .agg(F.collect_list(F.struct(F.length("r_host").alias("n"), F.length("r_path").alias("m"), "r_host", "r_path", "r_verdict")).alias("rules"))
    )
    best = F.array_max(F.filter("rules", lambda r: F.col("path").startswith(r["r_path"])))
    return (
        parsed.join(fits, "host", "left")
        .withColumn("best", best)
        .select(
            id_col,
            "host",
            "path",
            F.concat(F.col("best.r_host"), F.col("best.r_path")).alias("rule"),
            F.coalesce(F.col("best.r_verdict"), F.lit(default)).alias("verdict"),
        )
    )


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url against the fixed rules."""
    return judge_urls(table(spark, sf_dir, "pages"), CONTRACT_RULES)


OP5_SQL = r"""
with p as (
  select page_id, coalesce(url, '') as url, position('://' in coalesce(url, '')) as k from pages
), s as (
  select page_id, case when k > 0 then substr(url, k + 3) else '' end as rest from p
), u as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from s
), r(r_host, r_path, v) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m as (
  select page_id, r_host || r_path as rule, v,
         row_number() over (partition by page_id order by length(r_host) desc, length(r_path) desc) as n
  from u join r on ('.' || host) like ('%.' || r_host) and starts_with(path, r_path)
)
select u.page_id, u.host, u.path, m.rule, coalesce(m.v, 'allow') as verdict
from u left join m on m.page_id = u.page_id and m.n = 1
"""
