"""Secrets in texts: fixed patterns, and what ownership over the whole corpus tells of other candidates.

Base spans are the matches of three fixed patterns; they always stay. Candidates are what looks like a credential but
no fixed pattern takes: values assigned to names of keys, passwords in addresses, keys with a provider's prefix, long
random-looking tokens, hex digits in upper or mixed case. Of each value only a hash leaves the task. Spark counts
the distinct repositories and owners that have a value. One that many owners have is an example that
was copied; one of a single owner is owner-specific and looks live. Candidates of at most LIVE_OWNERS owners
become added spans; every span, base ones too, carries the counts of its value.

Texts are read once; documents' spans are written to the shared folder. Values are made distinct by (value, owner, repository) before
they are counted, so a value that a third of all documents hold is a row for each of these, spread over all tasks. Counts are
broadcast up to a size, else joined by a shuffle in which Spark splits hot values.

Defined cases: a null text counts as empty; no match gives empty lists. All rows without an owner count as one owner, all without
a repository as one repository of theirs. Repeated rows and null ids are rows of their own. Very long words cost
time in proportion to their length. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankmail.llm.base import bounded_batches, materialize, small
from bankmail.llm.hashing import portions

KINDS = ("assign", "access", "hex")
#: Owners that a candidate's value may have at most, and different characters that a random-looking value has at least.
LIVE_OWNERS, DIFFERENT = 1, 10
# The patterns of the base.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
# Candidates: names of keys with any sign of assignment, passwords in addresses, prefixes of providers, bare tokens.
_NAMED = re.compile(r"""(?<![A-Za-z0-9])[A-Za-z0-9_-]{0,64}?(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|auth|credentials?)[A-Za-z0-9_-]{0,64}["']?\s{0,8}(?:=>|:=|[:=])\s{0,8}["']?([A-Za-z0-9+/_.=-]{8,})""", re.I | re.A)
_ADDRESS = re.compile(r"://[^\s:/@]{1,256}:([^\s:/@]{6,})@", re.A)
_PREFIXED = re.compile(r"(?<![A-Za-z0-9])(?:(?:ASIA|AROA|AIDA)[A-Z0-9]{16,}|gh[opsur]_[A-Za-z0-9]{20,}|(?:sk|rk|pk)_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{16,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_.-]{10,})", re.A)
_BARE = re.compile(r"(?<![A-Za-z0-9_+/=.@-])[A-Za-z0-9_+=-]{20,}(?![A-Za-z0-9_+/=.@-])", re.A)
_HEX_ANY = re.compile(r"[0-9A-Fa-f]{24,}")
_TURN = re.compile(r"[A-Za-z][0-9]|[0-9][A-Za-z]")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_NAMES, _MARKS = ("pass", "secret", "token", "key"), ("pwd", "auth", "credential")

Span = tuple[int, int, int, str]


def base_spans(text: str, low: str | None = None) -> list[Span]:
    """(start, kind, end, value) of the fixed patterns' matches, in order. `low` is the text in lower case."""
    low = text.lower() if low is None else low
    found = []
    if any(name in low for name in _NAMES):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def looks_random(value: str) -> bool:
    """Letters and digits that change places often, and many different characters."""
    return len(set(value)) >= DIFFERENT and len(_TURN.findall(value)) >= 2 and not _UUID.fullmatch(value)


def candidates(text: str, base: list[Span], low: str | None = None) -> list[Span]:
    """(start, kind, end, value) of what may be a secret beside the base spans; none overlaps another."""
    low = text.lower() if low is None else low
    found: list[Span] = []
    if any(name in low for name in _NAMES + _MARKS):
        found += [(m.start(), 0, m.end(), m[1]) for m in _NAMED.finditer(text) if looks_random(m[1])]
    if "://" in text:
        found += [(m.start(1), 0, m.end(1), m[1]) for m in _ADDRESS.finditer(text)]
    found += [(m.start(), 1, m.end(), m[0]) for m in _PREFIXED.finditer(text)]
    found += [(m.start(), 2 if _HEX_ANY.fullmatch(m[0]) else 1, m.end(), m[0]) for m in _BARE.finditer(text) if looks_random(m[0])]
    out: list[Span] = []
    # by start; those of a kind listed earlier first; what the base or an earlier one covers is left out
    taken = [(s, e) for s, _, e, _ in base]
    k, upto = 0, 0
    for s, kind, e, value in sorted(found, key=lambda c: (c[0], c[1], -c[2])):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if s < upto or any(a < e and s < b for a, b in taken[k : k + 8]):
            continue
        out.append((s, kind, e, value))
        upto = e
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def _hashed(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


_SPANS = "array<struct<start:long,kind:int,end:long,added:boolean,value:long>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("added", pa.bool_()), ("value", pa.int64())]))
FINDINGS = "array<struct<start:long,kind:int,end:long,added:boolean,owners:long,repositories:long>>"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        spans, sha = [], []
        for text in batch.column("text").to_pylist():
            low = text.lower()
            base = base_spans(text, low)
            both = [(s, False) for s in base] + [(s, True) for s in candidates(text, base, low)]
            spans.append([{"start": s, "kind": k, "end": e, "added": added, "value": _hashed(v)} for (s, k, e, v), added in both])
            sha.append(hashlib.sha256(_joined(base).encode()).hexdigest())
        kept = ["id", "row", "owner", "repository"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(spans, _SPAN), pa.array(sha)], [*kept, "spans", "base_sha256"])


def ownership(uses: DataFrame) -> DataFrame:
    """(value, owners, repositories): distinct owners of each value, and distinct repositories of an owner.

    `uses` has value, owner and repository, with repeats. Each step counts within tasks before it shuffles.
    """
    once = uses.select("value", "owner", "repository").distinct()
    by_owner = once.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None, live_owners: int = LIVE_OWNERS) -> DataFrame:
    """For each row: id, base_sha256 and findings: spans in code points with their kind, whether added, and the counts of their value.

    `repository` names the column that tells an owner's repositories apart; without it, each id is one.
    Findings are base spans and the candidates whose value at most `live_owners` owners have, by start, then kind.
    """
    rows = bounded_batches(docs).select(
        F.col(id).alias("id"), F.monotonically_increasing_id().alias("row"), F.xxhash64(F.col(owner)).alias("owner"),
        F.xxhash64(F.col(repository or id)).alias("repository"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    kind = docs.schema[id].dataType.simpleString()
    found = materialize(rows.mapInArrow(_found, f"id {kind}, row long, owner long, repository long, spans {_SPANS}, base_sha256 string"), "spans")
    places = found.where(F.size("spans") > 0).select("row", "owner", "repository", F.explode("spans").alias("s")).select("row", "owner", "repository", "s.*")
    owned = small(materialize(ownership(places), "ownership"))
    kept = places.join(owned, "value").where(~F.col("added") | (F.col("owners") <= live_owners))
    span = F.struct("start", "kind", "end", "added", "owners", "repositories")
    lists = small(materialize(kept.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("findings")), "findings"))
    none = F.expr(f"cast(array() as {FINDINGS})")
    return found.join(lists, "row", "left").select(F.col("id").alias(id), "base_sha256", F.coalesce("findings", none).alias("findings"))
