"""URL filter: pattern rules indexed by their rarest literal token.

A URL is cut into tokens (runs of a-z and 0-9). Each rule needs some tokens whole; it is filed under the
one of them that the fewest URLs of the corpus hold. The tokens of a URL fetch the candidate rules, and
only those run their regular expressions. Rules that need no token are tried on every URL.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_RULE_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path; ``tokens`` must occur whole in every URL that it fits.

    ``name`` is what the result shows; ``listed`` rules (host and path) come before free patterns, the
    longest first.
    """

    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    name: str
    listed: bool = False


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits the host and its subdomains where the path starts with ``path``."""
    pattern = rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    # The last token of the path may go on in the URL, so only closed ones are needed whole.
    closed = path if path.endswith("/") else path[: path.rfind("/") + 1]
    return Rule(pattern, verdict, tuple(TOKEN.findall(f"{host}{closed}".lower())), f"{host}{path}", True)


def host_words(words: str, verdict: str = "block") -> Rule:
    """Fits a host with these words in a row in one of its labels, as in ``free-bets.example.net``."""
    parts = words.split()
    joined = "-".join(map(re.escape, parts))
    return Rule(rf"\A(?:[^/]*[.-])?{joined}(?=[.\-:/]|\Z)", verdict, tuple(parts), words)


#: The method's own patterns: hosts that name their trade.
DEFAULT_PATTERNS = tuple(
    host_words(w)
    for w in ("ads track", "free bets", "cheap pills", "spam farm", "casino win", "adult x", "casino", "porn", "viagra", "payday loan")
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _lowered(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def token_counts(urls: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """In how many URLs (``host``, ``path``) each token of the rules occurs; at most a row per rule token."""
    needed = sorted({t for r in rules for t in r.tokens})
    tokens = F.array_distinct(F.split(_lowered(F.concat("host", "path")), "[^a-z0-9]+"))
    wanted = F.array_intersect(tokens, F.array(*[F.lit(t) for t in needed])) if needed else F.array().cast("array<string>")
    return {r["t"]: r["count"] for r in urls.select(F.explode(wanted).alias("t")).groupBy("t").count().toLocalIterator()}


class RuleIndex:
    """Rules by their rarest token."""

    def __init__(self, rules: Iterable[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[tuple[re.Pattern, Rule]]] = defaultdict(list)
        self.always: list[tuple[re.Pattern, Rule]] = []
        for rule in rules:
            entry = (re.compile(rule.pattern, re.DOTALL), rule)
            if rule.tokens:
                self.by_token[min(rule.tokens, key=lambda t: (counts.get(t, 0), t))].append(entry)
            else:
                self.always.append(entry)

    def judge(self, host: str, path: str) -> tuple[str | None, str | None, str]:
        """(host-and-path rule, pattern rule, verdict)."""
        where = host + path
        best = found = None
        for candidates in (self.always, *(self.by_token.get(t, ()) for t in set(TOKEN.findall(where.translate(_LOWER))))):
            for pattern, rule in candidates:
                if rule.listed:
                    if (best is None or _weight(rule) > _weight(best)) and pattern.search(where):
                        best = rule
                elif (found is None or rule.name < found.name) and pattern.search(where):
                    found = rule
        last = best or found
        return best and best.name, found and found.name, last.verdict if last else "allow"


_LOWER = str.maketrans(UPPER, LOWER)


def _weight(rule: Rule) -> tuple[int, str]:
    return len(rule.name), rule.name


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    patterns: Sequence[Rule] = DEFAULT_PATTERNS,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict and pattern of every row; row-local apart from the token counts.

    The longest listed rule decides; without one a pattern that fits blocks, and any other URL is
    allowed. A null URL or one without ``://`` has an empty host and path and is allowed. Patterns see
    the path as it is and the host in lower case; other columns of ``pages`` are not read. Rules travel
    to the tasks, so they may take ``MAX_RULE_BYTES`` together.
    """
    everything = [*rules, *patterns]
    if sum(len(r.pattern) for r in everything) > MAX_RULE_BYTES:
        raise ValueError("rules are larger than what may be sent to every task")
    url = F.col(url_col)
    urls = pages.select(F.col(id_col).alias(id_col), url_host(url).alias("host"), url_path(url).alias("path"))
    index = RuleIndex(everything, token_counts(urls, everything))
    schema = T.StructType([urls.schema[id_col]] + [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict", "pattern")])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [index.judge(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            text = lambda i: pa.array([j[i] for j in judged], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text(0), text(2), text(1)], names=schema.names)

    return urls.mapInArrow(judge, schema)
