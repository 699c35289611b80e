"""The registered queries of this subpackage, and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bankmail.llm.base import WORD, documents, materialize, small
from bankmail.llm.credentials import KINDS as SECRET_KINDS
from bankmail.llm.credentials import secrets
from bankmail.llm.exact_dedup import exact_duplicates
from bankmail.llm.fingerprints import neighbours
from bankmail.llm.learn import fold
from bankmail.llm.mixing import mix
from bankmail.llm.ngram_join import jaccard_components
from bankmail.llm.packing import pack
from bankmail.llm.pii import KINDS, personal_data
from bankmail.llm.quality import quality
from bankmail.llm.runs import periodic_runs
from bankmail.llm.substring_dedup import without_repeats
from bankmail.llm.token_counts import length_histogram
from bankmail.llm.toxicity import toxicity
from bankmail.llm.trie import KEYS, prefix_trie, turn_keys

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


ORACLES["op1_exact_dedup"] = """
with d as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
    doc_id = max(doc_id) over same as kept, sha256(text) as text_sha256
from d window same as (partition by text)"""


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("copies")


ORACLES["op4_mixing"] = r"""
with sizes as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
        ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as h
    from documents),
sources as (
    select source, sum(size)::bigint as source_size,
        [5, 2, 1][1 + ((row_number() over (order by source nulls last) - 1) % 3)::int]::bigint as weight
    from sizes group by source),
ordered as (
    select *, 3 * sum(source_size) over () - 4 * coalesce(sum(source_size) over before, 0) as remaining,
        2 * (sum(weight) over () - coalesce(sum(weight) over before, 0)) as per
    from sources window before as (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
rest as (select arg_min(remaining, -per) as remaining, min(-per) as per from ordered where 2 * source_size * per > weight * remaining),
goals as (
    select source, source_size, case when 2 * source_size * o.per <= weight * o.remaining then (2 * source_size)::double
        else (weight * rest.remaining)::double / (-rest.per)::double end as target
    from ordered o left join rest on true),
run as (
    select s.*, source_size, target, case when target >= source_size then 1 else 0 end as base,
        sum(size) over (partition by s.source order by h range between unbounded preceding and current row) as upto,
        sum(size) over (partition by s.source, h) as same
    from sizes s join goals g on s.source is not distinct from g.source)
select doc_id, size, source_size, target,
    (size * (base + case when target - base * source_size >= source_size or 2 * upto - same <= 2 * (target - base * source_size) then 1 else 0 end))::bigint as taken
from run"""


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), checksum=True)


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(documents(spark, sf_dir))


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir))
    named = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    spans = F.array_join(F.transform(F.sort_array(F.concat("base", "added")), named), ",")
    return found.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)], "base_sha256", spans.alias("spans"), F.size("added").cast("long").alias("n_added"))


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(documents(spark, sf_dir))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 5) == 0
    scored = quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), learn=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 4) == 2
    scored = toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), learn=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def repeating(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the words of a tenth of the texts, told by a hash of the id, from some word on repeated in place of the rest."""
    h = F.crc32(F.col(id).cast("string"))
    g = F.floor(h / 10)

    def rebuilt(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        word = lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0), n - 1), word))

    # as a variable of a function, the words are extracted once for a text
    repeated = F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), rebuilt), 0)
    return docs.withColumn(text, F.when((h % 10 == 0) & (F.regexp_count(text, F.lit(WORD)) > 0), repeated).otherwise(F.col(text)))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(repeating(documents(spark, sf_dir).select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r["start"], r["period"])))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are the owners; each document is a repository."""
    found = secrets(documents(spark, sf_dir))
    named = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, SECRET_KINDS)), s["kind"] + 1), s["start"], s["end"])
    count = lambda test: F.size(F.filter("findings", test)).cast("long")
    # a function of one argument: a second one would be given the place in the array
    base = lambda k: lambda s: (s["kind"] == k) & ~s["added"]
    kinds = [count(base(k)).alias(f"n_{kind}") for k, kind in enumerate(SECRET_KINDS)]
    spans = F.array_join(F.transform("findings", named), ",").alias("spans")
    return found.select("doc_id", *kinds, "base_sha256", spans, count(lambda s: s["added"]).alias("n_added"), count(lambda s: s["owners"] == 1).alias("n_live"))


def rebuilt(keys: DataFrame) -> DataFrame:
    """`keys` of conversations that begin with the first turns of another: as many as a hash of the id says, in place of as many of their own."""
    head = F.coalesce(F.crc32(F.col("conv").cast("string")) % 4, F.lit(0))
    source = F.col("conv") - F.col("conv") % 20
    convs = keys.select("conv").distinct()
    firsts = small(materialize(keys.where(source.eqNullSafe(F.col("conv")) & (F.col("at") < 3)).withColumnRenamed("conv", "source"), "firsts"))
    begun = convs.select("conv", source.alias("source"), head.alias("head")).join(firsts, "source").where(F.col("at") < F.col("head")).select(KEYS)
    lengths = small(materialize(firsts.groupBy("source").agg(F.count("*").alias("n")), "lengths"))
    own = keys.withColumns({"source": source, "head": head}).where(F.col("at") >= F.col("head")).join(lengths, "source", "left")
    return begun.unionByName(own.withColumn("at", F.col("at") - F.col("head") + F.least("head", F.coalesce("n", F.lit(0)))).select(KEYS))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = turn_keys(documents(spark, sf_dir, "conversations"))
    return prefix_trie(rebuilt(keys), keys.select("conv"))


ORACLES["op12_prefix_trie"] = r"""
with turns as (
    select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos
    from conversations),
convs as (
    select c, c - c % 20 as source, xor(list_reduce([4294967295::bigint] || list_transform(string_split(c::varchar, ''), lambda d: ascii(d)::bigint),
        lambda a, b: list_reduce([xor(a, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 as h
    from (select distinct conv_id as c from conversations)),
heads as (select v.c, t.pos, t.role, t.text from convs v join turns t on t.c = v.source and t.pos < v.h),
lens as (select c, count(*) as n from heads group by c),
rebuilt as (
    select * from heads
    union all select t.c, t.pos - v.h + coalesce(l.n, 0), t.role, t.text from turns t join convs v on v.c = t.c left join lens l on l.c = t.c where t.pos >= v.h),
keyed as (
    select c, pos + 1 as d, len(regexp_extract_all(text, '[^ 	-
]+')) as words,
        md5(string_agg(md5(role) || md5(text), '' order by pos) over (partition by c order by pos rows between unbounded preceding and current row)) as node
    from rebuilt),
paths as (select c, d, words, node from keyed union all select c, 0, 0, '' from convs),
nodes as (select d, node, min(c) as c, count(*) as n, max(words) as words from paths group by d, node),
up as (select n.d, n.node, n.c, n.n, n.words, p.node as parent from nodes n left join paths p on p.c = n.c and p.d = n.d - 1),
kids as (select d - 1 as d, parent, count(*) as k from up group by 1, 2),
own as (select u.*, coalesce(k.k, 0) as k from up u left join kids k on k.d = u.d and k.parent = u.node),
sums as (
    select p.d, p.node, count(*) filter (o.k = 0) as leaves, sum((o.n - 1) * o.words) as saved
    from own o join paths p on p.c = o.c and p.d <= o.d group by p.d, p.node),
ends as (
    select d, node, sha256(string_agg(c::varchar, ',' order by c)) as sha
    from (select c, max(d) as d, arg_max(node, d) as node from paths group by c) group by d, node)
select o.c as conv_id, o.d as depth, q.c as parent_conv_id, o.n as n_convs, o.k as n_children, s.leaves as n_leaves, s.saved::bigint as saved_tokens,
    coalesce(e.sha, sha256('')) as ends_sha256
from own o join sums s on s.d = o.d and s.node = o.node left join ends e on e.d = o.d and e.node = o.node
left join nodes q on q.d = o.d - 1 and q.node = o.parent"""
