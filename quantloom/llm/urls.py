"""URL filters: host and path rules, indexed by their rarest literal token.

A rule is a host and the start of a path (``example.com/en/7``; ``*`` stands for any
text within the path) and a verdict. It fits its host and all subdomains. Its
literal tokens are the runs of letters and digits that every fitting URL holds
as whole tokens. The rule is filed under the one that is rarest among all URLs;
ties go to the longer token. The tokens of a URL fetch the rules filed under
them, and only those run their regular expression. The longest fitting rule wins.

Rules are given on the driver and sent to the executors in shards of a limited
number; a list of any length is applied shard by shard in the same pass over
the URLs, without a shuffle.

Defined cases: a null URL, or one without ``://``, has an empty host and path and
fits no rule; URLs that repeat are judged each; other columns are returned as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import ascii_lower

#: Rules of one shard; each takes about a kilobyte on an executor.
SHARD_RULES = 100_000
_TOKEN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return self.host + self.path

    def pattern(self) -> str:
        """A regular expression over host and path written together."""
        path = ".*".join(map(re.escape, self.path.split("*")))
        return r"(?s:(?:[^/]*\.)?" + re.escape(self.host) + (path if self.path else r"(?=/|\Z)") + ")"

    def tokens(self) -> list[str]:
        """Tokens that each fitting URL holds whole; the last of the path may go on and does not count."""
        host = _TOKEN.findall(self.host)
        parts = [m for m in _TOKEN.finditer(self.path)]
        whole = [m.group() for m in parts if m.end() < len(self.path) and "*" not in self.path[max(0, m.start() - 1) : m.end() + 1]]
        return host + whole


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path of a URL; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def token_counts(urls: DataFrame, tokens: set[str], host: str, path: str) -> dict[str, int]:
    """In how many URLs each of ``tokens`` occurs; as many rows as the rules have tokens come back."""
    if not tokens:
        return {}
    wanted = urls.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "token string")
    found = F.array_distinct(F.regexp_extract_all(F.concat(host, path), F.lit(r"([\p{L}\p{N}]+)"), 1))
    each = urls.select(F.explode(found).alias("token"))
    return {r.token: r.n for r in each.join(F.broadcast(wanted), "token").groupBy("token").agg(F.count("*").alias("n")).collect()}


class RuleIndex:
    """Rules filed under their rarest token."""

    def __init__(self, rules: Sequence[UrlRule], counts: dict[str, int]):
        self.by_token: dict[str, list[tuple[UrlRule, re.Pattern]]] = {}
        for rule in rules:
            rarest = min(rule.tokens(), key=lambda t: (counts.get(t, 0), -len(t), t), default="")
            self.by_token.setdefault(rarest, []).append((rule, re.compile(rule.pattern())))

    def best(self, host: str, path: str) -> UrlRule | None:
        if not host:
            return None
        url = host + path
        best = None
        for token in {"", *_TOKEN.findall(url)}:
            for rule, pattern in self.by_token.get(token, ()):
                if (best is None or _order(rule) > _order(best)) and pattern.match(url):
                    best = rule
        return best


def _order(rule: UrlRule) -> tuple:
    """Longer rules first; of equal ones the longer host, then block, then the text."""
    return len(rule.text), len(rule.host), rule.verdict == "block", rule.text


def judge(urls: DataFrame, rules: Sequence[UrlRule], url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """``urls`` with the columns ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``.

    Columns of these names are replaced.
    """
    names = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(url_col))
    split = urls.select(*names, host.alias("host"), path.alias("path"))
    rules = sorted(set(rules), key=_order)
    if any(not r.host for r in rules):
        raise ValueError("a rule needs a host")
    counts = token_counts(split, {t for r in rules for t in r.tokens()}, "host", "path")
    context = urls.sparkSession.sparkContext
    shards = [context.broadcast(rules[at : at + SHARD_RULES]) for at in range(0, len(rules), SHARD_RULES)]
    sent = context.broadcast(counts)

    @F.pandas_udf("string")
    def best_rule(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        # Shards come in order of length, so a fit of a later shard is the longer one.
        indexes = [RuleIndex(s.value, sent.value) for s in reversed(shards)]
        for hosts, paths in batches:
            yield pd.Series([next((f"{r.verdict} {r.text}" for i in indexes if (r := i.best(h, p))), None) for h, p in zip(hosts, paths, strict=True)], dtype=object)

    found = split.withColumn("__fit", best_rule("host", "path"))
    return found.select(
        *names, "host", "path", F.regexp_extract("__fit", r"(?s)^\S+ (.*)$", 1).alias("rule"), F.coalesce(F.split("__fit", " ")[0], F.lit(otherwise)).alias("verdict")
    )
