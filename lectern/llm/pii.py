"""Personal data: fixed detectors, and terms that disclose what the detectors found.

After the detectors, corpus co-occurrence tells which terms give an entity away: the share of an
entity's information content that seeing a term near it removes, PMI(entity; term) / IC(entity),
is estimated over all documents, smoothed, so that rare entities have terms too. Every occurrence of
a term at or above the disclosure threshold is generalised, near certainty removed. DataFrame
functions only.

Arrays of a text's matches are bounded by the text; nothing gathers matches across texts but sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import written

KINDS = ("email", "ip", "card", "phone")
#: The detectors' patterns. Possessive quantifiers and start conditions change no match; they keep failed attempts linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a detector to be worth running.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: Characters looked at on either side of an entity; distinct contexts that must show a term with it; thresholds.
REACH, CONTEXTS, DISCLOSES, REVEALS = 80, 1, 0.9, 0.98
#: Matches of a kind have 5 characters at least: so many matches and pieces on a side hold REACH characters.
_BESIDE = REACH // 5
#: Disclosing terms up to this number are broadcast (8 bytes each), more are joined by a shuffle.
_FEW = 200_000
_NEAR_TERM = r"(?<=\s)\p{L}[\p{L}\p{M}]{2,}+(?=[.,;:!?]{0,3}\s)"
_ANY_TERM = r"(?<!\S)\p{L}[\p{L}\p{M}]{2,}+(?=[.,;:!?]{0,3}(?:\s|$))"
_BLOCK = 64


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often and under whichever lambda `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column) -> Column:
    """Running sums before each element of an array, in blocks so that long arrays stay near linear."""

    def sums(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("t"), F.array().cast("array<int>").alias("a"))
        return F.aggregate(block, start, lambda s, x: F.struct((s["t"] + x).alias("t"), F.concat(s["a"], F.array(s["t"])).alias("a")))

    def in_blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: sums(F.slice(v, b * _BLOCK + 1, _BLOCK)))

    def added(blocks: Column) -> Column:
        totals = sums(F.transform(blocks, lambda s: s["t"]))["a"]
        return F.flatten(F.zip_with(blocks, totals, lambda s, t: F.transform(s["a"], lambda x: x + t)))

    return _bound(values, lambda v: F.when(F.size(v) > 0, _bound(in_blocks(v), added)).otherwise(F.array().cast("array<int>")))


def located(text: Column, pattern: str) -> tuple[Column, Column]:
    """The matches of a pattern and the pieces of text around them, one more than matches."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) < 4) & F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 4).try_cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(F.when(F.length(digits) <= 19, digits).otherwise(F.lit("1")))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def detected(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, key, and for each kind an array of (start, end, value, left, right), with the text on either side."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    out = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("key"), text.alias("text"))
    for kind in KINDS:
        there = F.col("text").rlike(HINTS[kind])
        matches, pieces = located(F.col("text"), PATTERNS[kind])
        out = out.withColumns({"_m": F.when(there, matches), "_p": F.when(there, pieces)})
        m, p = F.col("_m"), F.col("_p")
        size = F.transform(m, lambda x, i: F.length(F.get(p, i)) + F.length(x))
        out = out.withColumn("_s", F.when(F.size(m) > 0, running(size)))
        s = F.col("_s")
        # text beside a match, also past other matches of its kind; a space stands for the text's edge
        before = F.zip_with(p, m, lambda a, b: F.concat(F.right(a, F.lit(REACH)), F.right(F.coalesce(b, F.lit("")), F.lit(REACH))))
        after = F.zip_with(m, F.slice(p, 2, F.size(m)), lambda b, a: F.concat(F.left(b, F.lit(REACH)), F.left(a, F.lit(REACH))))
        out = out.withColumns({"_l": F.when(F.size(m) > 0, before), "_r": F.when(F.size(m) > 0, after)})

        def left(i: Column) -> Column:
            near = F.array_join(F.slice("_l", F.greatest(i - _BESIDE, F.lit(0)) + 1, F.least(i, F.lit(_BESIDE))), "")
            return F.right(F.concat(F.when(i <= _BESIDE, " ").otherwise(""), near, F.right(F.get(p, i), F.lit(REACH))), F.lit(REACH))

        def right(i: Column) -> Column:
            near = F.array_join(F.slice("_r", i + 2, F.lit(_BESIDE)), "")
            return F.left(F.concat(F.left(F.get(p, i + 1), F.lit(REACH)), near, F.when(i + _BESIDE + 1 >= F.size(m), " ").otherwise("")), F.lit(REACH))

        def span(x: Column, i: Column) -> Column:
            start = F.get(s, i) + F.length(F.get(p, i))
            return F.struct(
                start.cast("long").alias("start"),
                (start + F.length(x)).cast("long").alias("end"),
                x.alias("value"),
                left(i).alias("left"),
                right(i).alias("right"),
            )

        spans = F.filter(F.transform(m, span), lambda x: _passes(kind, x["value"]))
        empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string,left:string,right:string>>")
        out = out.withColumn(kind, F.when(F.size(m) > 0, spans).otherwise(empty)).drop("_m", "_p", "_s", "_l", "_r")
    return out.drop("text")


def occurrences(found: DataFrame) -> DataFrame:
    """Terms near entities: (key, entity, context, term), at most some 2 * REACH / 4 for each entity."""
    every = F.flatten(F.array(*[F.transform(k, lambda x: F.struct(F.xxhash64(F.lit(k), F.lower(x["value"])).alias("entity"), x["left"].alias("left"), x["right"].alias("right"))) for k in KINDS]))
    one = found.where(" OR ".join(f"size({k}) > 0" for k in KINDS)).select("key", F.inline(every)).withColumn("context", F.xxhash64("left", "entity", "right"))
    terms = F.concat(*[F.regexp_extract_all(F.lower(F.col(side)), F.lit(_NEAR_TERM), F.lit(0)) for side in ("left", "right")])
    return one.select("key", "entity", "context", F.explode(F.array_distinct(terms)).alias("term"))


def _shape(word: Column) -> Column:
    """The class that a word is generalised to."""
    return F.when(word.rlike(r"^\p{Lu}+$"), "acronym").when(word.rlike(r"^\p{Lu}"), "name").otherwise("term")


def everywhere(docs: DataFrame, words: DataFrame, shares: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, start, end, kind, share): all occurrences of the terms of `shares` (word, share), wherever they stand.

    `words` are the (key, word) of all documents. Only texts that hold one of the terms are searched,
    each once; a text's terms get their places by a running sum over its rows, linear in the text and
    able to spill.
    """
    few = shares.limit(_FEW + 1).count() <= _FEW
    marked = F.broadcast(shares) if few else shares
    own = words.join(marked, "word")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.select(F.xxhash64(F.col(f"`{id_col}`"), text).alias("key"), text.alias("text"))
    held = keyed.join(own.select("key").distinct(), "key").dropDuplicates(["key"])
    matches, pieces = located(F.col("text"), _ANY_TERM)
    # the piece after the last match has no match beside it and falls away
    each = F.zip_with(matches, pieces, lambda x, gap: F.struct(F.xxhash64(F.lower(x)).alias("word"), F.length(gap).cast("long").alias("gap"), F.length(x).alias("size"), _shape(x).alias("kind")))
    terms = held.select("key", F.posexplode(each).alias("at", "x")).select("key", "at", "x.*").where("size IS NOT NULL")
    upto = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = terms.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto))
    # beyond what is broadcast, rows meet by document and word: no word is hot
    shown = placed.join(marked, "word") if few else placed.join(own.distinct(), ["key", "word"])
    return shown.select("key", (F.col("end") - F.col("size")).alias("start"), "end", "kind", "share")


def distinct_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, word): each row and the hashes of the terms in it."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_ANY_TERM), F.lit(0)))
    return docs.select(F.xxhash64(F.col(f"`{id_col}`"), text).alias("key"), F.explode(words).alias("w")).select("key", F.xxhash64("w").alias("word"))


def disclosing(words: DataFrame, near: DataFrame, found: DataFrame, contexts: int = CONTEXTS, discloses: float = DISCLOSES) -> DataFrame:
    """(entity, term, share): terms that remove at least the share `discloses` of an entity's information content.

    share = log(p * N / n_e) / log(N / n_e), by documents of the whole corpus: N in all, n_e with the
    entity, n_t with the term. p, the probability of the entity given the term, is
    (n_et + 1) / (n_t + 2) by the rule of succession, with n_et the distinct contexts, one a document,
    that show the term near the entity: a single sight is weak evidence, not none, and copies of one
    text, which add to n_t alone, speak against the term. A pair must stand in `contexts` contexts.
    """
    seen = near.groupBy("entity", "term", "key").agg(F.min("context").alias("context")).groupBy("entity", "term")
    pairs = written(seen.agg(F.count_distinct("context").alias("n_et")).where(F.col("n_et") >= contexts), "pairs")
    entities = found.select("key", F.explode(F.array_distinct(F.flatten(F.array(*[F.transform(k, lambda x: F.xxhash64(F.lit(k), F.lower(x["value"]))) for k in KINDS])))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    terms = words.groupBy("word").agg(F.count("*").alias("n_t"))
    n = found.agg(F.count("*").alias("n"))
    wanted = pairs.withColumn("word", F.xxhash64("term"))
    both = wanted.join(entities, "entity").join(terms, "word").join(F.broadcast(n))  # one row
    content = F.log2(F.col("n") / F.col("n_e"))
    mutual = content + F.log2((F.least(F.col("n_et"), F.col("n_t")) + 1) / (F.col("n_t") + 2))
    share = both.withColumn("share", F.when(content > 0, mutual / content))
    return share.where(F.col("share") >= discloses).select("entity", "term", "share")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", contexts: int = CONTEXTS, discloses: float = DISCLOSES, reveals: float = REVEALS) -> DataFrame:
    """Per row: id, key (a hash of id and text), the detectors' spans by kind, and `term`, the disclosing terms.

    Spans are (start, end, ...) in characters, end exclusive; a term's span has `action`: remove where
    the share of information it gives away reaches `reveals`, else generalise, and `kind`, the class it
    is generalised to. Terms are looked for within REACH characters of an entity, the window of
    co-occurrence, and marked wherever they stand. Null texts count as empty and have no span. Rows that repeat both id and text get the same spans each.
    """
    found = written(detected(docs, id_col, text_col), "found")
    near = written(occurrences(found), "near")
    words = distinct_words(docs, id_col, text_col)
    pairs = disclosing(words, near, found, contexts, discloses)
    shares = written(pairs.groupBy(F.xxhash64("term").alias("word")).agg(F.max("share").alias("share")), "shares")
    shown = everywhere(docs, words, shares, id_col, text_col)
    by_row = shown.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", F.when(F.col("share") >= reveals, "remove").otherwise("generalise").alias("action"), "kind"))).alias("term")
    ).withColumnRenamed("key", "_key")
    none = F.array().cast("array<struct<start:bigint,end:bigint,action:string,kind:string>>")
    return found.join(by_row, F.col("key") == F.col("_key"), "left").drop("_key").withColumn("term", F.coalesce("term", none))


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the hash of the detectors' spans and all spans as text, from personal_data()."""

    def said(kind: str) -> Column:
        return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))

    base = F.concat(*[said(k) for k in KINDS])
    return spans.select(
        F.col("id").alias(id_col),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, said("term")), ",").alias("spans"),
    )


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """The documents with their personal data replaced: all columns, text_col rewritten.

    An entity becomes its kind in brackets, a generalised term its class: [ACRONYM] in capitals, [NAME]
    with a capital first, else [TERM]; removed terms leave nothing.
    Of overlapping spans the first, and of two with one start the longer, is replaced.
    """
    spans = personal_data(docs, id_col, text_col, **options)
    every = F.flatten(F.array(
        *[F.transform(k, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("neg"), F.lit(f"[{k.upper()}]").alias("by"))) for k in KINDS],
        F.transform("term", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("neg"), F.when(x["action"] == "remove", "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).alias("by"))),
    ))
    cuts = spans.groupBy("key").agg(F.first(F.array_sort(every)).alias("cuts")).where(F.size("cuts") > 0)
    # the input row travels in one struct, so that no column of it can clash
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.xxhash64(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("key"))
    both = keyed.join(cuts, "key", "left")
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(s: Column, x: Column) -> Column:
        kept = F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        return F.when(x["start"] < s["at"], s).otherwise(F.struct((-x["neg"]).alias("at"), F.concat(s["out"], F.array(kept, x["by"])).alias("out")))

    done = F.aggregate("cuts", start, cut, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    new = F.when(F.col("cuts").isNull(), F.col("row").getField(text_col)).otherwise(done)
    return both.select(*[new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
