"""Personal data: fixed patterns, and what contexts learned from them discover.

Base spans are the matches of four fixed patterns. They are the seeds of a bootstrapped
extraction: the one and two whole words before a place, and the one after it, are lexical patterns of its kind, and tokens and runs of
digit groups that look like an identifier but that no fixed pattern takes are candidates. Groups may be joined by
what the fixed patterns of a kind allow; of a run with too many digits, the longest beginning that fits. Spark scores the
graph of patterns and instances in rounds. A pattern's confidence is the summed score of its instances over this sum, the other places
where its words occur in any document, and a tenth of its unknown candidates: a number passes the check of its kind by chance once in
ten, so many more unknown ones than known ones speak against a pattern. Patterns of high confidence that several different known instances
support make their candidates known: one minus the product of the patterns' doubts. Known candidates then support other patterns,
until a round finds nothing new. Candidates beside such a pattern become added spans of that kind. Base spans always stay.

Texts are read twice. First each task finds spans, candidates and contexts of its documents; what leaves
it are documents' spans and (pattern, instance) pairs with counts, both written to the shared folder.
Pairs are summed before and after they are shuffled by pattern, so that a frequent context is one row a task.
Then every task counts the occurrences of the patterns that several instances share in all its texts, by
hashes of words; PATTERNS of them are broadcast at a time, and more take further passes.

Defined cases: a null text counts as empty; no match gives an empty span list. Null and repeated
ids are rows of their own. Very long words cost time in proportion to their length. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bankmail.llm.base import bounded_batches, materialize, small
from bankmail.llm.hashing import U64, Words, mix, portions, text_buffers

KINDS = ("email", "ip", "card", "phone")
CONFIDENT, SEEDS, DOUBT = 0.8, 3, 0.5
#: How much an unknown candidate counts against a pattern.
UNKNOWN = 0.1
#: Hashes of patterns, eight bytes each, that a pass over the texts counts at most.
PATTERNS = 1_000_000
# The patterns of the base. Possessive repeats where giving back cannot help a match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TOKEN = re.compile(r"[^\x20\x09-\x0D,;!?()\[\]\"']+")
_GROUPS = re.compile(r"(?<![\w+])\+?(?:\([0-9]++\)|[0-9]++)(?!\w)(?:[\x20().-]++[0-9]++(?!\w))*+")
_GROUP = re.compile(r"[0-9]+")
_DIGIT_OR_AT = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match holds one @: its local part is what may stand before it, from the end of the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        if first < at and (m := _DOMAIN.match(text, at + 1)):
            yield first, m.end()
            done = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, in order."""
    if not _DIGIT_OR_AT.search(text):
        return []
    found = [(s, 0, e) for s, e in emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and (len(p) < 5 or not p[:-4].strip("0")) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def shapes(token: str) -> list[int]:
    """The kinds that a candidate may be."""
    digits = sum(c.isascii() and c.isdigit() for c in token)
    letters = any(c.isalpha() for c in token)
    if "@" in token:
        return [0]
    kinds = []
    if token.count(".") == 3 and not letters and digits >= 4:
        kinds.append(1)
    if not letters and 12 <= digits <= 19:
        kinds.append(2)
    if not letters and 7 <= digits <= 15:
        kinds.append(3)
    return kinds


def grouped(text: str, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind) of runs of digit groups in a part of the text that may be an identifier."""
    for m in _GROUPS.finditer(text, start, end):
        digits, last, ends = 0, 0, {}
        plain = dotted = "0" <= text[m.start()] <= "9"
        for k, g in enumerate(_GROUP.finditer(text, m.start(), m.end())):
            between = text[last : g.start()] if k else ""
            plain, dotted = plain and between in ("", " ", "-"), dotted and between in ("", ".")
            digits, last = digits + g.end() - g.start(), g.end()
            if k == 3 and dotted:
                ends[1] = last
            elif k > 3 and dotted:
                ends.pop(1, None)
            if plain and 12 <= digits <= 19:
                ends[2] = last
            if 7 <= digits <= 15:
                ends[3] = last
            if not dotted and digits > 19:
                break
        yield from ((m.start(), e, kind) for kind, e in ends.items())


_BLANK, _SPACE = frozenset(" \t\v\f\r"), frozenset(" \t\n\v\f\r")


def _contexts(text: str, start: int, end: int) -> list[str]:
    """Patterns of a place: `<` and the one and two words before it, `>` and the one after it, within its line."""
    words, at = [], start
    for _ in range(2):
        while at and text[at - 1] in _BLANK:
            at -= 1
        upto = at
        while at and text[at - 1] not in _SPACE:
            at -= 1
        if at == upto:
            break
        words.insert(0, text[at:upto].lower())
    out = ["<" + " ".join(words[-n:]) for n in (1, 2) if len(words) >= n]
    while end < len(text) and text[end] in _BLANK:
        end += 1
    upto = end
    while end < len(text) and text[end] not in _SPACE:
        end += 1
    return [*out, ">" + text[upto:end].lower()] if upto < end else out


def _instance(kind: int, found: str) -> str:
    """An identifier without the separators of its groups."""
    return re.sub(r"[\x20().-]", "", found.lower()) if kind > 1 else found.lower()


def _document(text: str):
    """Base spans, candidates (start, end, kinds, contexts), and counted (kind, pattern, instance, seed, uses)."""
    base = base_spans(text)
    if not _DIGIT_OR_AT.search(text):
        return base, [], []
    taken = [(s, e) for s, _, e in base]
    places: dict[tuple[int, int], set[int]] = {}
    k = 0
    for m in _TOKEN.finditer(text):
        token = m[0].rstrip(".")
        if not _DIGIT_OR_AT.search(token):
            continue
        s, e = m.start(), m.start() + len(token)
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if any(a < e and s < b for a, b in taken[k : k + 8]):
            continue
        if kinds := shapes(token):
            places[s, e] = set(kinds)
    done = 0
    for a, b in [*taken, (len(text), len(text))]:
        for s, e, kind in grouped(text, done, a):
            places.setdefault((s, e), set()).add(kind)
        done = max(done, b)
    candidates = [(s, e, sorted(kinds), _contexts(text, s, e)) for (s, e), kinds in sorted(places.items())]
    uses: Counter = Counter()
    for s, kind, e in base:
        for c in _contexts(text, s, e):
            uses[kind, c, _instance(kind, text[s:e]), True] += 1
    for s, e, kinds, contexts in candidates:
        for kind in kinds:
            for c in contexts:
                uses[kind, c, _instance(kind, text[s:e]), False] += 1
    return base, candidates, [(*key, n) for key, n in uses.items()]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


FOUND = "doc_id {id}, row long, base array<struct<start:long,kind:int,end:long>>, base_text string, base_sha256 string, candidates array<struct<start:long,end:long,kind:int,contexts:array<string>,instance:string>>, uses array<struct<kind:int,pattern:string,instance:string,seed:boolean,n:long>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_CAND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("contexts", pa.list_(pa.string())), ("instance", pa.string())]))
_USES = pa.list_(pa.struct([("kind", pa.int32()), ("pattern", pa.string()), ("instance", pa.string()), ("seed", pa.bool_()), ("n", pa.int64())]))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        base, sha, cands, uses = [], [], [], []
        for text in batch.column("text").to_pylist():
            b, c, u = _document(text)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in b])
            sha.append(_joined(b))
            cands.append([{"start": s, "end": e, "kind": k, "contexts": x, "instance": _instance(k, text[s:e])} for s, e, ks, x in c for k in ks])
            uses.append([{"kind": k, "pattern": p, "instance": i, "seed": seed, "n": n} for k, p, i, seed, n in u])
        columns = [batch.column("doc_id"), batch.column("row"), pa.array(base, _SPAN), pa.array(sha), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in sha]), pa.array(cands, _CAND), pa.array(uses, _USES)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "base", "base_text", "base_sha256", "candidates", "uses"])


def _keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, in lower case, and of all pairs of neighbouring words; and where each text's words begin."""
    words = Words(*text_buffers(pa.array([t.lower() for t in texts], pa.large_string())))
    h = words.hashes
    inside = np.ones(max(len(h) - 1, 0), bool)
    ends = words.starts[1:-1]
    inside[ends[(ends > 0) & (ends < len(h))] - 1] = False
    return h, mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])[inside], words.starts


def occurrences(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Written: how often the words of each pattern occur in all texts. `rows` has text; `wanted`, a written table, has pattern."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "pattern"):
            one, two, starts = _keys(batch.column("pattern").to_pylist())
            n = np.diff(starts)
            key = one[starts[:-1]]
            key[n == 2] = two
            yield pa.RecordBatch.from_arrays([batch.column("pattern"), pa.array(key.view(np.int64))], ["pattern", "key"])

    keys = materialize(wanted.select("pattern").distinct().mapInArrow(keyed, "pattern string, key long"), "keys")
    times = max(1, -(-keys.count() // PATTERNS))
    context = rows.sparkSession.sparkContext

    def counts(k: int) -> DataFrame:
        chosen = keys.where(F.pmod("key", F.lit(times)) == k).select("key").distinct().toArrow()
        shared = context.broadcast(np.sort(np.asarray(chosen["key"], np.int64).view(U64)))

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            total = np.zeros(len(known), np.int64)
            for batch in portions(batches) if len(known) else ():
                for h in _keys(batch.column("text").to_pylist())[:2]:
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    np.add.at(total, at[known[at] == h], 1)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(known[at].view(np.int64)), pa.array(total[at])], ["key", "n"])

        return materialize(rows.select("text").mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("seen")), "seen")

    seen = counts(0)
    for k in range(1, times):
        seen = seen.union(counts(k))
    return keys.join(seen, "key").select("pattern", "seen")


def patterns(edges: DataFrame) -> DataFrame:
    """(kind, pattern, confidence) of patterns that make candidates known, scored on the graph until no candidate is new.

    `edges` has a row for each (kind, pattern, instance, seed) with n uses and `seen` occurrences of the pattern's words. What is known only grows,
    so the rounds end.
    """
    edges = materialize(edges, "edges")
    known, before = None, 0
    while True:
        believed = F.lit(None).cast("double").alias("believed")
        scored = edges.withColumn("believed", believed) if known is None else edges.join(small(known), ["kind", "instance"], "left")
        scored = scored.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("believed", F.lit(0.0))))
        held, unknown = F.sum(F.col("n") * F.col("score")), F.sum(F.col("n") * (1 - F.col("score")))
        elsewhere = F.greatest(F.max("seen") - F.sum("n"), F.lit(0))
        found = scored.groupBy("kind", "pattern").agg((held / (held + UNKNOWN * unknown + elsewhere + DOUBT)).alias("confidence"), F.count_if(F.col("score") >= CONFIDENT).alias("known"))
        good = materialize(found.where((F.col("confidence") >= CONFIDENT) & (F.col("known") >= SEEDS)).drop("known"), "patterns")
        doubts = edges.join(small(good), ["kind", "pattern"]).where(~F.col("seed")).groupBy("kind", "instance")
        known = materialize(doubts.agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence") * 0.999)))).alias("believed")), "instances")
        now = known.count()
        if now <= before:
            return good
        before = now


def personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: id, base and added spans (arrays of start, kind, end in code points), base_sha256."""
    rows = bounded_batches(docs).select(F.col(id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = materialize(rows.mapInArrow(_found, FOUND.format(id=docs.schema[id].dataType.simpleString())), "spans")

    uses = found.select(F.explode("uses").alias("u")).select("u.*")
    edges = materialize(uses.groupBy("kind", "pattern", "instance", "seed").agg(F.sum("n").alias("n")), "uses")
    support = edges.groupBy("kind", "pattern").agg(F.count("*").alias("instances"), F.count_if(~F.col("seed")).alias("others"))
    support = materialize(support.where((F.col("instances") >= SEEDS) & (F.col("others") > 0)).select("kind", "pattern"), "supported")
    words = support.withColumn("words", F.substr("pattern", F.lit(2)))
    counted = occurrences(rows, words.select(F.col("words").alias("pattern"))).withColumnRenamed("pattern", "words")
    seen = words.join(counted, "words", "left").select("kind", "pattern", F.coalesce("seen", F.lit(0)).alias("seen"))
    good = patterns(edges.join(small(materialize(seen, "occurrences")), ["kind", "pattern"]))

    places = found.where(F.size("candidates") > 0).select("row", F.explode("candidates").alias("c")).select("row", "c.start", "c.end", "c.kind", F.explode("c.contexts").alias("pattern"))
    hits = places.join(small(good.select("kind", "pattern")), ["kind", "pattern"]).select("row", "start", "kind", "end").distinct()
    earlier = Window.partitionBy("row", "kind").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("upto", F.max("end").over(earlier)).where("upto is null or upto < end")  # none within another
    added = hits.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))
    added = small(materialize(added, "added"))
    out = found.join(added, "row", "left")
    return out.select(F.col("doc_id").alias(id), "base", F.coalesce("added", F.expr("cast(array() as array<struct<start:long,kind:int,end:long>>)")).alias("added"), "base_sha256")
