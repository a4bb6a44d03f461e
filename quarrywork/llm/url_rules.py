"""URL verdicts from pattern rules that are indexed by their rarest literal token.

A rule is a pattern over ``host + path``: letters stand for themselves, ``*`` for any
run of characters. ``|`` at the start ties the rule to the start of the host, ``||`` to
the start of the host or of one of its labels; ``|`` at the end ties it to the end of the
path. Every rule is compiled to one regular expression.

A literal token of a rule is a run of ASCII letters and digits that other characters (or a
tie) bound on both sides, so any URL that fits has the same run as a token of its own. Of
a rule's tokens the one that is rarest among the URLs of the table is its index entry;
rules without a token are tried on every URL and listed in ``Index.always``. A URL's
tokens fetch the candidate rules, and only those run.

The longest fitting rule decides; of equals a blocking one, then the first by name. A URL
that fits none gets the default verdict. A null URL, or one without ``://``, has an empty
host and path. Repeated rows are judged each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import in_batches

ALLOW, BLOCK = "allow", "block"
#: Rules travel to every worker; beyond this many, split the list by verdict or topic.
MOST_RULES = 500_000
_TOKEN = re.compile("[a-z0-9]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    pattern: str
    verdict: str
    name: str

    @property
    def regex(self) -> str:
        body, head, tail = self.pattern, "", ""
        if body.startswith("||"):
            body, head = body[2:], r"\A(?:[^/]*\.)?"
        elif body.startswith("|"):
            body, head = body[1:], r"\A"
        if body.endswith("|"):
            body, tail = body[:-1], r"\Z"
        return head + ".*".join(re.escape(part) for part in body.split("*")) + tail

    @property
    def tokens(self) -> set[str]:
        """Runs that are whole tokens of any URL that fits."""
        body = self.pattern.lstrip("|")
        tied_start, tied_end = body != self.pattern, body.endswith("|")
        body = body.removesuffix("|").translate(str.maketrans(_UPPER, _LOWER))
        found = set()
        for run in _TOKEN.finditer(body):
            before = body[run.start() - 1] if run.start() else ("|" if tied_start else "*")
            after = body[run.end()] if run.end() < len(body) else ("|" if tied_end else "*")
            if "*" not in (before, after):
                found.add(run[0])
        return found


def domain_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for ``host`` and its subdomains, for paths that start with ``path``."""
    return Rule(f"||{host}{path}", verdict, host + path)


@dataclass
class Index:
    by_token: dict[str, list[Rule]] = field(default_factory=dict)
    always: list[Rule] = field(default_factory=list)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lowered and path; both empty where there is no ``://``. Built-in functions only."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct runs of ASCII letters and digits, lowered."""
    text = F.translate(F.concat(host, path), _UPPER, _LOWER)
    return F.array_distinct(F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), F.lit(1)))


def build_index(pages: DataFrame, rules: list[Rule], url: str = "url") -> Index:
    """Count the rules' own tokens over all URLs; at most one row per token of a rule comes back."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} fit a worker")
    wanted = sorted(set().union(*[r.tokens for r in rules]) if rules else set())
    counts = dict.fromkeys(wanted, 0)
    if wanted:
        tokens = pages.select(F.explode(url_tokens(*host_and_path(F.col(url)))).alias("token"))
        mine = tokens.join(F.broadcast(pages.sparkSession.createDataFrame([(t,) for t in wanted], "token string")), "token", "left_semi")
        counts |= {r["token"]: r["n"] for r in mine.groupBy("token").agg(F.count("*").alias("n")).toLocalIterator()}
    index = Index()
    for rule in rules:
        own = sorted(rule.tokens, key=lambda t: (counts[t], t))
        (index.by_token.setdefault(own[0], []) if own else index.always).append(rule)
    return index


def judge(pages: DataFrame, rules: list[Rule], default: str = ALLOW, key: str = "page_id", url: str = "url",
          named: set[str] | None = None) -> DataFrame:
    """``key``, host, path, rule and verdict for every row.

    ``named`` limits the rules that are reported by name; the others give only their verdict.
    """
    index = build_index(pages, rules, url)
    kind = pages.schema[key].dataType.simpleString()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[str, re.Pattern] = {}

        def fits(rule: Rule, target: str) -> bool:
            if rule.pattern not in compiled:
                compiled[rule.pattern] = re.compile(rule.regex, re.DOTALL)
            return compiled[rule.pattern].search(target) is not None

        for batch in batches:
            chosen, verdicts = [], []
            rows = zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), batch.column("tokens").to_pylist())
            for host, path, tokens in rows:
                candidates = index.always + [r for t in tokens for r in index.by_token.get(t, ())]
                found = [r for r in candidates if fits(r, host + path)]
                # rules that are reported by name come before the others
                best = min(found, default=None, key=lambda r: (named is not None and r.name not in named, -len(r.name), r.verdict == ALLOW, r.name))
                chosen.append(best.name if best and (named is None or best.name in named) else None)
                verdicts.append(best.verdict if best else default)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("host"), batch.column("path"), pa.array(chosen, pa.string()), pa.array(verdicts, pa.string())],
                names=["key", "host", "path", "rule", "verdict"],
            )

    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path")).withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    return in_batches(rows, decide, f"key {kind}, host string, path string, rule string, verdict string").withColumnRenamed("key", key)
