"""URL filters: allow and block rules in a trie over reversed host labels and path segments.

A rule is a host and a path prefix.  It fits its host and all subdomains where the URL's
path starts with the rule's path.  Of the rules that fit, the one with more host labels
wins, then the longer path; where the same host and path is both allowed and blocked, the
block wins.  The trie is broadcast.  Lists beyond MAX_RULES rules are cut into tries of
that size, which the pages pass one after the other, keeping the best match so far.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULES = 500_000
"""Rules in one broadcast trie."""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        """From ``host/path``: everything before the first slash is the host."""
        host, slash, rest = text.partition("/")
        return cls(verdict, host.lower(), slash + rest)

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass
class _Node:
    """A host label or a path segment; ``rules`` are those whose path ends here, by the rest of it within a segment."""

    below: dict[str, _Node] = field(default_factory=dict)
    paths: _Node | None = None
    rules: dict[str, Rule] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)
    """Lengths of the rules' rests, longest first."""

    def add(self, rest: str, rule: Rule) -> None:
        self.rules[rest] = rule
        self.lengths = sorted({*self.lengths, len(rest)}, reverse=True)


class Trie:
    def __init__(self, rules: Iterable[Rule]):
        self.root = _Node()
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.below.setdefault(label, _Node())
            node.paths = node.paths or _Node()
            *whole, rest = rule.path.split("/")
            node = node.paths
            for segment in whole:
                node = node.below.setdefault(segment, _Node())
            held = node.rules.get(rest)
            if held is None or rule.verdict == "block":
                node.add(rest, rule)

    def match(self, host: str, path: str) -> tuple[int, Rule] | None:
        """The winning rule and its number of host labels."""
        node, depth, best = self.root, 0, None
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            depth += 1
            if node.paths and (rule := self._longest(node.paths, path)):
                best = depth, rule
        return best

    @staticmethod
    def _longest(node: _Node, path: str) -> Rule | None:
        best, segments = None, path.split("/")
        for i, segment in enumerate(segments):
            # only the lengths that rules have, so a segment of any length costs a few lookups
            best = next((node.rules[segment[:n]] for n in node.lengths if n <= len(segment) and segment[:n] in node.rules), best)
            if i == len(segments) - 1 or segment not in node.below:
                break
            node = node.below[segment]
        return best


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))})


_BEST = "page_id long, host string, path string, rule string, verdict string, depth int, length int"


def _matcher(shared):
    """shared: a broadcast trie, pickled so that workers without this package can read it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: Trie = cloudpickle.loads(shared.value)
        for batch in batches:
            rows = batch.to_pydict()
            for i, (host, path) in enumerate(zip(rows["host"], rows["path"])):
                if found := trie.match(host, path):
                    depth, rule = found
                    if (depth, len(rule.path)) > (rows["depth"][i], rows["length"][i]) or (depth, len(rule.path), rule.verdict) == (rows["depth"][i], rows["length"][i], "block"):
                        rows["rule"][i], rows["verdict"][i], rows["depth"][i], rows["length"][i] = rule.name, rule.verdict, depth, len(rule.path)
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in batch.schema], schema=batch.schema)

    return run


def url_verdicts(pages: DataFrame, rules: Iterable[Rule], default: str = "allow") -> DataFrame:
    """Judge every page: page_id, host, path, rule (name of the winning rule, else null), verdict.

    ``pages``: (page_id long, url string, ...); other columns are ignored, also if they are
    named host or path.  A null URL has an empty host and path, fits no rule and gets the
    default verdict, as any URL that no rule fits.  Repeated rows are judged each; an empty
    table or rule list is fine; URLs of any length are read whole.
    """
    rules, spark = list(rules), pages.sparkSession
    judged = with_host_and_path(pages.select("page_id", "url")).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(-1).alias("depth"), F.lit(-1).alias("length"))
    for at in range(0, len(rules), MAX_RULES):
        judged = judged.mapInArrow(_matcher(spark.sparkContext.broadcast(cloudpickle.dumps(Trie(rules[at : at + MAX_RULES])))), _BEST)
    return judged.drop("depth", "length")
