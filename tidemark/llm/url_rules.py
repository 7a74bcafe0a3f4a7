"""URL filters: a sort-merge range join of canonical url keys with rule intervals, swept with a stack of the rules in force.

A key is the host's labels in reverse order, each with a dot: ``www.example.com`` is ``com.example.www.``. All keys below a host begin
with the host's key, so a rule's host is an interval of the key order, and two intervals are nested or apart. Each partition of pages is
sorted by key and merged with the sorted rules: rules are pushed as the sweep reaches their begin and popped when a key leaves them, so
the stack holds the rules of all hosts above a page. Of these a rule fits if the page's path begins with its path; the longest rule
(host and path together, then host) wins, and of equal ones a block.

Pages are not shuffled, so no host and no repeated url can crowd a task. Rules go to the tasks in blocks of ``BLOCK_RULES``, one sweep
for each block; the longest of all blocks wins.

A null url, or one without ``://``, has an empty host and path, and no rule fits it. Rules without a host fit nothing; a null path is
empty. Pages that repeat are judged alike. Without rules every page gets the default verdict.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lower-cased) after the first ``://`` up to ``/ ? #``, and the path after it up to ``? #``."""
    parts = F.regexp_extract_all(url, F.lit("(?s)^.*?://([^/?#]*)([^?#]*)"), F.lit(0))  # one match or none
    whole = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    host = F.regexp_extract(whole, "(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(whole, "(?s)^.*?://([^/?#]*)([^?#]*)", 2)


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


class Sweep:
    """Sorted rules of one block, and the stack of those in force at the last key."""

    def __init__(self, rules: list[tuple[str, str, str, str]]):
        by_key: dict[str, tuple[int, dict[int, dict[str, tuple]]]] = {}
        for key, host, path, verdict in rules:
            paths = by_key.setdefault(key, (len(host), {}))[1].setdefault(len(path), {})
            if path not in paths or verdict == "block":
                paths[path] = (host + path, verdict)
        self.rules = sorted(by_key.items())
        self.next, self.stack = 0, []

    def at(self, key: str) -> list[tuple]:
        """Rules in force at a key; keys come in ascending order."""
        while self.next < len(self.rules) and self.rules[self.next][0] <= key:
            rule = self.rules[self.next]
            self.next += 1
            if key.startswith(rule[0]):
                while self.stack and not rule[0].startswith(self.stack[-1][0]):
                    self.stack.pop()
                self.stack.append(rule)
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()
        return self.stack

    def best(self, key: str, path: str) -> tuple[int, int, str, str] | None:
        """(length, host's length, rule, verdict) of the longest rule that fits."""
        found = None
        for _, (host, by_length) in self.at(key):
            for n, paths in by_length.items():
                if (rule := paths.get(path[:n])) and (found is None or (host + n, host) > found[:2]):
                    found = (host + n, host, *rule)
        return found


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", block: int = BLOCK_RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of every page, for rules ``(host, path, verdict)``."""
    host, path = host_and_path(F.col(url_col))
    out = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).select(
        "*", key_of(F.col("host")).alias("key"), F.lit(None).cast("struct<length: int, host: int, rule: string, verdict: string>").alias("best"))
    own = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''").withColumn("key", key_of(F.col("host")))
    out = out.sortWithinPartitions("key")
    n = max(1, -(-own.count() // block))
    for k in range(n):
        part = [tuple(r) for r in own.where(F.pmod(F.xxhash64("host", "path"), F.lit(n)) == k).select("key", "host", "path", "verdict").collect()]
        out = out.mapInArrow(_sweep(pages.sparkSession.sparkContext.broadcast(part)), out.schema)
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _sweep(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(shared.value)
        for batch in batches:
            best = []
            for key, path, old in zip(*(batch.column(c).to_pylist() for c in ("key", "path", "best"))):
                new = sweep.best(key, path)
                if new and (old is None or (*new[:2], new[3] == "block") > (old["length"], old["host"], old["verdict"] == "block")):
                    old = dict(zip(("length", "host", "rule", "verdict"), new))
                best.append(old)
            at = batch.schema.get_field_index("best")
            yield batch.set_column(at, batch.schema.field(at), pa.array(best, batch.schema.field(at).type))
    return run
