"""Secret scans with corpus-wide ownership frequency.

Every text is scanned once for candidates. A candidate's value is hashed, and over the whole corpus each
hash is counted by the distinct repositories and owners that hold it. A value that many owners hold is a
copied example; one that stays with its owner and looks random is taken for a live credential.

Runs of mixed letters and digits are candidates too, of kind ``opaque``. Nothing around them says that they
are secret, so they become spans only where the corpus shows them to be owner-specific and live-looking.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import release
from textlab.plans.durable import scratch_path
from textlab.plans.layout import join_frequent

# Fixed values of the contract: the three base kinds, in their order.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
BASE_KINDS = ("assign", "access", "hex")

COPIED_OWNERS = 3  # from so many distinct owners on a value is a copied example
COPIED_REPOSITORIES = 10  # or from so many repositories, if more than one owner holds it
LIVE_BITS = 3.0  # bits a character; hex digits have 4, words of a language about 2.5 in so short a text
OPAQUE_BITS = 3.5
SLICE_ROWS = 256

SPAN = "struct<kind:string,start:int,end:int,verdict:string,owners:bigint,repositories:bigint>"
FOUND = (
    "row bigint, id bigint, repo string, owner string, "
    "spans array<struct<kind:string,start:int,end:int,value:binary,live:boolean>>"
)


def _base(text: str) -> Iterator[tuple[str, int, int, str]]:
    """Kind, start, end and secret part of the base matches; one that is too short still uses up its place."""
    if ":" in text or "=" in text:
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                yield "assign", m.start(), m.end(), m.group(2)
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                yield "access", m.start(), m.end(), m.group()
    # Runs of [0-9a-f]+ are as long as they can be, so asking for 32 at once gives the same ones.
    for m in _LONG_HEX.finditer(text):
        yield "hex", m.start(), m.end(), m.group()


_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")

#: Further kinds: a mark that must be in the text, the pattern, and the group that holds the secret.
FURTHER: tuple[tuple[str, str, re.Pattern, int], ...] = (
    ("private_key", "PRIVATE KEY-----", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}-----END"), 0),
    ("web_token", "eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"), 0),
    ("login_url", "://", re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]{1,15}://[^\s:/@]{1,64}:([^\s:/@]{3,128})@"), 1),
    ("prefixed", "_", re.compile(r"\b(?:gh[pousr]|sk_live|rk_live|glpat|npm|xox[abprs])[_-][A-Za-z0-9-]{16,}"), 0),
)
# Whole runs of 20 characters or more; what such a run must hold is asked afterwards.
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}", re.ASCII)


def bits(value: str) -> float:
    """Entropy of the value's own characters, in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_live(value: str, least: float = LIVE_BITS) -> bool:
    """Random-looking and no placeholder: enough entropy, and digits beside letters."""
    return bits(value) >= least and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def candidates(text: str) -> list[tuple[str, int, int, str, bool]]:
    """(kind, start, end, value, live-looking) by start, then kind as listed; places are code points."""
    found = [(kind, a, b, value, looks_live(value)) for kind, a, b, value in _base(text)]
    for kind, mark, pattern, group in FURTHER:
        if mark in text:
            found += [(kind, m.start(), m.end(), m.group(group), looks_live(m.group(group))) for m in pattern.finditer(text)]
    taken = sorted((a, b) for _, a, b, _, _ in found)
    at = 0
    for m in OPAQUE.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if any(a < m.end() and m.start() < b for a, b in taken[at:at + 1]):
            continue
        value = m.group()
        if value.lower() != value and value.upper() != value and looks_live(value, OPAQUE_BITS):
            found.append(("opaque", m.start(), m.end(), value, True))
    order = {kind: i for i, kind in enumerate((*BASE_KINDS, *[f[0] for f in FURTHER], "opaque"))}
    return sorted(found, key=lambda f: (f[1], order[f[0]], f[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.binary()), ("live", pa.bool_())]))
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            spans = [
                [
                    {"kind": k, "start": a, "end": b, "value": hashlib.blake2b(v.encode("utf-8", "surrogatepass"), digest_size=16).digest(), "live": live}
                    for k, a, b, v, live in candidates(text or "")
                ]
                for text in part.column(4).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), part.column(3), pa.array(spans, kind)],
                names=["row", "id", "repo", "owner", "spans"],
            )
        release()


def ownership(values: DataFrame) -> DataFrame:
    """value, repositories, owners, live: how many distinct repositories and owners hold each value.

    ``values`` has value, repo, owner (null counts as one of its own) and live. Repeats combine before every
    shuffle, so a value in a third of all rows is one row per task and owner; no set is gathered.
    """
    held = values.groupBy("value", "owner", "repo").agg(F.max("live").alias("live"))
    by_owner = held.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.max("live").alias("live"))
    return by_owner.groupBy("value").agg(
        F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"), F.max("live").alias("live")
    )


def verdict(owners: Column, repositories: Column, live: Column) -> Column:
    """``copied``: widely held. ``live``: with few owners and random-looking. ``weak``: neither."""
    copied = (owners >= COPIED_OWNERS) | ((owners > 1) & (repositories >= COPIED_REPOSITORIES))
    return F.when(copied, "copied").when(live, "live").otherwise("weak")


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None
) -> DataFrame:
    """id and ``spans``: what was found in each whole text, as structs of kind, start, end (code points, end
    exclusive), verdict, owners and repositories, by start and kind.

    Spans of the base kinds, and of the further ones, are all there whatever their verdict; ``opaque`` runs
    only where the verdict is ``live``. ``repo`` and ``owner`` say whose a row is, by default the id and the
    column ``source``. A repository is told apart within its owner.

    A row per row of ``docs``: repeated rows and ids are answered each, a null text has no spans, a null owner
    is one owner of its own, and an empty table gives no rows. Texts of any length are scanned whole, in time
    that follows their length. Other columns are not read. Each row is scanned once and what was found is
    stored; texts and values are not.
    """
    spark = docs.sparkSession
    repo = F.col(id_col) if repo is None else repo
    owner = F.col("source") if owner is None else owner
    stored = scratch_path(spark, "secrets")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"),
        repo.cast("string").alias("repo"), owner.cast("string").alias("owner"), F.col(text_col).alias("text"),
    )
    rows.mapInArrow(_scan, FOUND).write.parquet(stored)  # the row numbers hold from here on
    found = spark.read.parquet(stored)
    spans = found.where(F.size("spans") > 0).select("row", "repo", "owner", F.inline("spans"))
    known = ownership(spans)
    judged = known.select("value", "owners", "repositories", verdict(F.col("owners"), F.col("repositories"), F.col("live")).alias("verdict"))
    answered = join_frequent(spans.drop("repo", "owner", "live"), judged, "value", "row")
    shown = answered.where((F.col("kind") != "opaque") | (F.col("verdict") == "live"))
    place = F.array_position(F.array(*[F.lit(k) for k in (*BASE_KINDS, *[f[0] for f in FURTHER], "opaque")]), F.col("kind"))
    listed = shown.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", place.alias("place"), "end", "kind", "verdict", "owners", "repositories"))).alias("spans")
    )
    ordered = F.transform("spans", lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "verdict", "owners", "repositories")]))
    every = found.select("row", "id").join(listed.select("row", ordered.alias("spans")), "row", "left")
    empty = F.array().cast(f"array<{SPAN}>")
    return every.select(F.col("id").alias(id_col), F.coalesce("spans", empty).alias("spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of ``find_secrets``."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    counts: list[Column] = [F.size(F.filter("spans", _is_kind(k))).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS]
    verdicts = [F.size(F.filter("spans", _has_verdict(v))).cast("bigint").alias(f"n_{v}") for v in ("live", "copied", "weak")]
    return found.select(
        id_col, *counts, F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"), *verdicts
    )


def _is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def _has_verdict(name: str) -> Callable[[Column], Column]:
    return lambda s: s["verdict"] == name
