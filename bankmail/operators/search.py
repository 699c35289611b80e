"""Ranked word search over mail subject, body and bank.

A postings row says: this word stands at this position of this field of this document.
Postings are made row by row, without a shuffle. Stored in folders by a hash of the word and sorted by word
(`plans.index`), a query reads the folders and row groups of its own words only.

Scoring follows BM25 with k1 = 1.2 and b = 0.75 over all fields together; lower is better.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from bankmail.operators.joins import counted

FIELDS = ("subject", "body_text", "bank_name")
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Folders that the words of a stored index are dealt to, groups of folders that are written by the same tasks, and parts of the documents, which bound such a task.
BUCKETS, GROUPS, PARTS = 32, 4, 8


def _accents() -> tuple[str, str]:
    """Accented Latin, Greek and Cyrillic letters and their base letters, from Unicode itself."""
    marked, plain = [], []
    for code in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(p) for p in parts[1:]):
            marked.append(chr(code))
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _accents()


def fold(text: Column) -> Column:
    """Lower case, accents off. Pure ASCII text skips the accent table."""
    bare = F.translate(F.regexp_replace(text, "[̀-̱]", ""), _MARKED, _PLAIN)
    return F.lower(F.when(F.octet_length(text) == F.length(text), text).otherwise(bare))


def words(text: Column) -> Column:
    """Runs of letters and digits, folded. The pattern names plain letters first, which spares most characters a look-up."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), r"[^a-z0-9\p{L}\p{N}]+"), lambda w: w != "")


def _split(docs: DataFrame, id_col: str, fields: tuple[str, ...]) -> tuple[DataFrame, Column]:
    """The words of each field of a document, and their number in all."""
    split = docs.select(F.col(id_col).alias("doc_id"), *[words(F.col(f)).alias(f) for f in fields])
    return split, sum((F.size(f) for f in fields[1:]), F.size(fields[0]))


def postings(docs: DataFrame, id_col: str = "id", fields: tuple[str, ...] = FIELDS, with_distinct: bool = False) -> DataFrame:
    """(doc_id, field, pos, token, doc_len); doc_len counts the words of all fields.

    `with_distinct` adds `field_words`, the number of different words of the field: known where a text is split, it spares who
    asks for it a shuffle of all words.
    """
    split, length = _split(docs, id_col, fields)
    # counted here, once a text: beside `posexplode` it would be counted again for every word
    part = lambda name, words: F.struct(
        F.lit(name).alias("field"), words.alias("words"), *([F.size(F.array_distinct(words)).alias("distinct")] if with_distinct else [])
    )
    parts = [part(f, F.col(f)) for f in fields]
    spread = split.select("doc_id", length.alias("doc_len"), F.explode(F.array(*parts)).alias("f"))
    distinct = [F.col("f.distinct").alias("field_words")] if with_distinct else []
    return spread.select("doc_id", F.col("f.field").alias("field"), "doc_len", *distinct, F.posexplode("f.words").alias("pos", "token"))


def doc_lengths(docs: DataFrame, id_col: str = "id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, doc_len) of every document, wordless ones too."""
    length = sum((F.size(words(F.col(f))) for f in fields[1:]), F.size(words(F.col(fields[0]))))
    return docs.select(F.col(id_col).alias("doc_id"), length.alias("doc_len"))


def bucket(token: Column, buckets: int = BUCKETS) -> Column:
    """The folder of a word in a stored index; of a constant word, a constant."""
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def bucketed_postings(docs: DataFrame, id_col: str = "id", fields: tuple[str, ...] = FIELDS, buckets: int = BUCKETS) -> DataFrame:
    """`postings` with their folder, and the empty word once for every document in a field without a name; the words of a folder lie in few tasks.

    A row per document and group of folders is shuffled, not one per word: the id is sent once for all the words in it.
    """
    split, length = _split(docs, id_col, fields)
    word = lambda k, token, pos: F.struct(F.lit(k).cast("byte").alias("k"), pos.alias("pos"), token.alias("token"), bucket(token, buckets).alias("bucket"))
    placed = lambda k: lambda w, i: word(k, w, i)
    found = F.concat(F.array(word(len(fields), F.lit(""), F.lit(0))), *[F.transform(f, placed(k)) for k, f in enumerate(fields)])
    size = -(-buckets // GROUPS)
    of = lambda g: lambda w: (w["bucket"] >= g * size) & (w["bucket"] < (g + 1) * size)
    groups = [F.struct(F.lit(g).alias("group"), F.filter("found", of(g)).alias("words")) for g in range(GROUPS)]
    rows = split.select("doc_id", length.alias("doc_len"), found.alias("found")).select("doc_id", "doc_len", F.explode(F.array(*groups)).alias("g"))
    rows = rows.select("doc_id", "doc_len", "g.group", "g.words", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part"))
    dealt = rows.filter(F.size("words") > 0).hint("rebalance", F.col("group"), F.col("part"))
    name = F.element_at(F.array(*[F.lit(f) for f in (*fields, "")]), F.col("k") + 1)
    return dealt.select("doc_id", "doc_len", F.inline("words")).select("doc_id", name.alias("field"), "doc_len", "pos", "token", "bucket")


def index_layout(rows: DataFrame, files: int) -> DataFrame:
    """Postings in range partitions of (token, doc_id), sorted: a frequent word spans many files."""
    return rows.repartitionByRange(files, "token", "doc_id").sortWithinPartitions("token", "doc_id")


def reindexed(rows: DataFrame, changed: DataFrame, docs: DataFrame, id_col: str = "id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Postings after documents changed: those of the ids in `changed` out, their new ones in.

    `docs` is the table after the change; ids gone from it simply lose their postings.
    """
    ids = changed.select(F.col(id_col).alias("doc_id")).distinct()
    kept = rows.join(ids, "doc_id", "left_anti")
    now = docs.join(ids, docs[id_col] == ids["doc_id"], "left_semi")
    return kept.unionByName(postings(now, id_col, fields))


def reindexed_from(before: DataFrame, changed: DataFrame, docs: DataFrame, id_col: str = "id", fields: tuple[str, ...] = FIELDS, with_distinct: bool = False) -> DataFrame:
    """`reindexed` where no postings are stored and `before` is the table before the change.

    Which documents count is settled before any is split: a changed one is not split for nothing, and no join meets a row per word.
    """
    ids = counted(changed.select(F.col(id_col).alias("__k")).distinct())
    same = F.col(id_col) == F.col("__k")
    columns = [id_col, *fields]
    rows = before.select(*columns).join(ids, same, "left_anti").unionByName(docs.select(*columns).join(ids, same, "left_semi"))
    return postings(rows, id_col, fields, with_distinct=with_distinct)


def _tokens(text: str) -> list[str]:
    """Words of a query argument, folded as the documents are."""
    folded = "".join(
        _PLAIN[_MARKED.index(c)] if c in _MARKED else c for c in text.lower() if not "̀" <= c <= "̱"
    )
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in folded).split()


def _phrase_starts(rows: DataFrame, tokens: list[str]) -> DataFrame:
    """(doc_id, field, pos) where the words follow one another.

    Every word votes for the start it implies; a start with all votes is a hit. One
    aggregate per (document, field, start), no self join.
    """
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(tokens)])
    votes = rows.filter(F.col("token").isin(tokens)).select(
        "doc_id", "field", "doc_len", "pos",
        F.explode(F.filter(places, lambda p: p["t"] == F.col("token"))["i"]).alias("i"),
    )
    return (
        votes.groupBy("doc_id", "field", (F.col("pos") - F.col("i")).alias("pos"))
        .agg(F.count(F.lit(1)).alias("votes"), F.max("doc_len").alias("doc_len"))
        .filter(F.col("votes") == len(tokens))
        .select("doc_id", "field", "pos", "doc_len")
    )


def _near_hits(rows: DataFrame, tokens: list[str], distance: int) -> DataFrame:
    """Places of words that stand in one field with at most `distance` words between first and last.

    Windows run over the matching words of one field of one document. A clump starts
    at a place if the next place of every word from there on is close enough; a place
    counts if it is the next place of its word for some start.
    """
    matching = rows.filter(F.col("token").isin(tokens))
    ahead = Window.partitionBy("doc_id", "field").orderBy("pos").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    behind = Window.partitionBy("doc_id", "field").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("doc_id", "field", "token").orderBy("pos")
    following = [F.min(F.when(F.col("token") == t, F.col("pos"))).over(ahead) for t in tokens]
    marked = matching.select(
        "*", *[f.alias(f"n{i}") for i, f in enumerate(following)], F.lag("pos", 1, -1).over(same).alias("before")
    )
    nexts = [F.col(f"n{i}") for i in range(len(tokens))]
    complete = nexts[0].isNotNull()
    for c in nexts[1:]:
        complete = complete & c.isNotNull()
    starts = complete & (F.greatest(*nexts) - F.col("pos") - 1 <= distance) if len(nexts) > 1 else complete
    last_start = F.max(F.when(starts, F.col("pos"))).over(behind)
    return marked.withColumn("s", last_start).filter(F.col("s") > F.col("before")).select("doc_id", "field", "pos", "token", "doc_len")


def search(
    rows: DataFrame,
    lengths: DataFrame,
    all: list[str] | tuple[str, ...] = (),
    any: list[str] | tuple[str, ...] = (),
    none: list[str] | tuple[str, ...] = (),
    phrase: str | None = None,
    prefix: str | None = None,
    near: tuple[list[str], int] | None = None,
    column: str | None = None,
    limit: int | None = 20,
    among: DataFrame | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(doc_id, rank) of matching documents, best first.

    all / any / none: words a document must all have, must have one of, must not have,
    over any fields together. phrase: words that follow one another inside one field.
    prefix: the beginning of a word. near: (words, most words between). column: look in this
    field only. among: ids (column `id`) of the documents that may be found; they are chosen before the
    limit. No words at all give an empty result.

    `rows` are postings (made on the fly or stored), `lengths` is (doc_id, doc_len). Where postings say
    the bucket of their word, only the buckets of the words asked for are read; a prefix may be in any.
    """
    if column is not None:
        rows = rows.filter(F.col("field") == column)
    items: list[tuple[str, object]] = []
    roles: dict[str, list[int]] = {"all": [], "any": [], "none": []}

    def item(role: str, kind: str, value) -> None:
        roles[role].append(len(items))
        items.append((kind, value))

    for role, texts in (("all", all), ("any", any), ("none", none)):
        for text in texts:
            tokens = _tokens(text)
            if role == "all":
                for token in tokens:
                    item(role, "word", token)
            elif tokens:
                item(role, "word" if len(tokens) == 1 else "phrase", tokens[0] if len(tokens) == 1 else tokens)
    if phrase and _tokens(phrase):
        tokens = _tokens(phrase)
        item("all", "phrase" if len(tokens) > 1 else "word", tokens if len(tokens) > 1 else tokens[0])
    if prefix and _tokens(prefix):
        item("all", "prefix", _tokens(prefix)[0])
    near_tokens = list(dict.fromkeys(_tokens(w)[0] for w in near[0] if _tokens(w))) if near else []
    # a near word is found near the others only, but is as rare as the word alone: the
    # plain word is counted beside it, for its document frequency
    rarity: dict[int, int] = {}
    for token in near_tokens:
        rarity[len(items)] = len(items) + 1
        item("all", "near", token)
        items.append(("word", token))

    wanted = roles["all"] + roles["any"]
    if not wanted:
        return rows.select("doc_id", F.lit(0.0).alias("rank")).limit(0)

    if "bucket" in rows.columns and "prefix" not in [kind for kind, _ in items]:
        asked = {w for kind, value in items for w in (value if kind == "phrase" else [value])}
        rows = rows.filter(F.col("bucket").isin(*[bucket(F.lit(w), buckets) for w in sorted(asked)]))

    hits = None

    def add(df: DataFrame) -> None:
        nonlocal hits
        hits = df if hits is None else hits.unionByName(df)

    simple = [(i, k, v) for i, (k, v) in enumerate(items) if k in ("word", "prefix")]
    if simple:
        test = F.lit(False)
        which = []
        for i, kind, value in simple:
            match = F.col("token") == value if kind == "word" else F.startswith("token", F.lit(value))
            test = test | match
            which.append(F.when(match, F.lit(i)))
        found = rows.filter(test).select(
            "doc_id", "doc_len", F.explode(F.filter(F.array(*which), lambda x: x.isNotNull())).alias("item")
        )
        add(found)
    for i, (kind, value) in enumerate(items):
        if kind == "phrase":
            add(_phrase_starts(rows, value).select("doc_id", "doc_len", F.lit(i).alias("item")))
    if near_tokens:
        place = F.create_map(*[x for i, (k, v) in enumerate(items) if k == "near" for x in (F.lit(v), F.lit(i))])
        clumps = _near_hits(rows, near_tokens, near[1])
        add(clumps.select("doc_id", "doc_len", F.element_at(place, F.col("token")).alias("item")))

    per_doc = hits.groupBy("doc_id").agg(
        F.max("doc_len").alias("doc_len"),
        *[F.count_if(F.col("item") == i).alias(f"f{i}") for i in range(len(items))],
    )
    corpus = lengths.select(F.struct(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("mean"))).scalar()
    # `doc_len` rides along so that this reads the very shuffle the scores read
    found_in = per_doc.select(
        F.struct(
            F.max("doc_len").alias("longest"),
            *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(items))],
        )
    ).scalar()

    matches = F.lit(True)
    for i in roles["all"]:
        matches = matches & (F.col(f"f{i}") > 0)
    if roles["any"]:
        one = F.lit(False)
        for i in roles["any"]:
            one = one | (F.col(f"f{i}") > 0)
        matches = matches & one
    for i in roles["none"]:
        matches = matches & (F.col(f"f{i}") == 0)

    length = K1 * (1 - B + B * F.col("doc_len") / corpus["mean"])
    score = F.lit(0.0)
    for i in wanted:
        d, f = found_in[f"d{rarity.get(i, i)}"], F.col(f"f{i}")
        idf = F.greatest(F.log((corpus["n"] - d + 0.5) / (d + 0.5)), F.lit(IDF_FLOOR))
        score = score + idf * f * (K1 + 1) / (f + length)
    ranked = per_doc.filter(matches).select("doc_id", (-score).alias("rank"))
    if among is not None:
        ranked = ranked.join(among.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    if limit is None:
        return ranked
    return ranked.orderBy("rank", "doc_id").limit(limit)


def search_emails(emails: DataFrame, hits: DataFrame, limit: int = 20) -> DataFrame:
    """Mails of the hits with `rank`, best first; only the mails of these few ids are looked up."""
    top = hits.orderBy("rank", "doc_id").limit(limit)
    return emails.join(top, emails["id"] == top["doc_id"]).drop("doc_id").orderBy("rank", "id")
