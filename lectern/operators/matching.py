"""Joins with rules of their own: ordered fallback, first or last wins, blocking then verification, recursion."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.python import ratio_reaches, sequence_ratio
from lectern.functions.text import compact_title, normalize_title, set_jaccard, surname, title_jaccard
from lectern.operators.lineage import saved
from lectern.operators.ranking import ranked


SHARES = 16  # of the points of a cell


def doi_then_title(entries: DataFrame, records: DataFrame) -> DataFrame:
    """entries with match_key: the last record (by pos) with the DOI, else the first with the title.

    DOIs are compared trimmed and lower-cased, titles without separators; empty ones never match.
    An entry whose DOI misses falls back to its title.
    """
    doi = F.lower(F.trim(F.coalesce("doi", F.lit(""))))
    by_doi = records.select(doi.alias("_doi"), "key", "pos").where("_doi <> ''").groupBy("_doi").agg(F.max_by("key", "pos").alias("_by_doi"))
    by_title = records.select(compact_title(F.col("title")).alias("_title"), "key", "pos").where("_title <> ''").groupBy("_title").agg(F.min_by("key", "pos").alias("_by_title"))
    out = entries.withColumns({"_doi": doi, "_title": compact_title(F.col("title"))}).join(by_doi, "_doi", "left").join(by_title, "_title", "left")
    return out.withColumn("match_key", F.coalesce("_by_doi", "_by_title")).drop("_doi", "_title", "_by_doi", "_by_title")


def all_matches(entries: DataFrame, records: DataFrame, entry_id: str) -> DataFrame:
    """entry_id and the sorted array of every record that shares its DOI or title.

    The records of a key are gathered once, and once more for what entries have together: those that agree in DOI
    and title read the same array, so no row is made for a pair of an entry and a record.
    """
    doi = F.lower(F.trim(F.coalesce("doi", F.lit(""))))
    keys = F.array_compact(F.array(F.when(doi != "", F.concat(F.lit("d:"), doi)), F.when(compact_title(F.col("title")) != "", F.concat(F.lit("t:"), compact_title(F.col("title"))))))
    held = records.select("key", F.explode(keys).alias("_k")).groupBy("_k").agg(F.collect_set("key").alias("_held"))
    asked = entries.groupBy(entry_id).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(keys)))).alias("_keys"))  # two, unless rows share an id
    found = asked.select("_keys").distinct().select("_keys", F.explode("_keys").alias("_k")).join(held, "_k")
    found = found.groupBy("_keys").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_held")))).alias("matches"))
    return asked.join(found, "_keys", "left").select(entry_id, F.coalesce("matches", F.array().cast("array<string>")).alias("matches"))


def identity_ladder(rows: DataFrame, records: DataFrame, rungs: Sequence[tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """rows with match_key and match_rung by the first rung (column, key function) that hits; the first record wins."""
    out, keys = rows, []
    for i, (column, normal) in enumerate(rungs):
        side = records.select(normal(F.col(column)).alias(f"_k{i}"), "key", "pos").where(F.col(f"_k{i}") != "").groupBy(f"_k{i}").agg(F.min_by("key", "pos").alias(f"_m{i}"))
        out = out.withColumn(f"_k{i}", normal(F.col(column))).join(side, f"_k{i}", "left")
        keys.append(f"_m{i}")
    rung = F.lit(None).cast("string")
    for i in reversed(range(len(rungs))):
        rung = F.when(F.col(f"_m{i}").isNotNull(), F.lit(rungs[i][0])).otherwise(rung)
    return out.withColumns({"match_key": F.coalesce(*keys), "match_rung": rung}).drop(*keys, *[f"_k{i}" for i in range(len(rungs))])


def lenient_match(wanted: DataFrame, served: DataFrame, jaccard: float = 0.8, least: int = 4, by: str | None = None) -> DataFrame:
    """(want_id, hit): DOI equality, containment of the shorter title of `least` words or more, or token Jaccard.

    Rows of one title are one text: texts are matched, each with the least key of its rows, and DOIs beside them, each
    with the least key too, so copies never meet in pairs. Candidate texts share one of the rarest words of both, of
    each as many as a Jaccard of the threshold cannot all miss, with sizes that allow it; or the rarest inner word of the
    shorter title, which containment in the longer one must share. Each is then verified. With `by` only rows of equal
    groups match: the group is part of every key, so rows of different groups never meet.
    """
    def keyed(df: DataFrame, ident: str) -> DataFrame:
        group = F.struct(F.col(by).alias("g")) if by else F.struct(F.lit(0).alias("g"))
        there = df.where(F.col(by).isNotNull()) if by else df  # a null group equals none
        return there.select(F.col(ident), group.alias("g"), F.lower(F.trim(F.coalesce("doi", F.lit("")))).alias("doi"), normalize_title(F.col("title")).alias("title"))

    def prepared(texts: DataFrame, ident: str, p: str) -> DataFrame:
        words = F.filter(F.split("title", " "), lambda x: x != "")
        rows = texts.select(F.struct("g", "title").alias(ident), F.col("title").alias(f"{p}title"), words.alias(f"{p}words"))
        word = F.transform(F.array_distinct(f"{p}words"), lambda w: F.struct(F.col(f"{ident}.g").alias("g"), w.alias("w")))
        inner = F.transform(F.array_distinct(F.slice(f"{p}words", F.lit(2), F.greatest(F.size(f"{p}words") - 2, F.lit(0)))), lambda w: F.struct(F.col(f"{ident}.g").alias("g"), w.alias("w")))
        return rows.withColumns({f"{p}keys": word, f"{p}inner": F.when(F.size(f"{p}words") >= max(least, 3), inner), f"{p}n": F.size(f"{p}words"), f"{p}d": F.size(word)})

    left, right = keyed(wanted, "want_id"), keyed(served, "key")
    texts = right.where("title <> ''").groupBy("g", "title").agg(F.min("key").alias("least"))
    a, b = prepared(left.where("title <> ''").select("g", "title").distinct(), "a_id", "a_"), prepared(texts, "b_id", "b_")
    frequency = b.select(F.explode("b_keys").alias("w")).groupBy("w").agg(F.count("*").alias("n"))

    def rare(df: DataFrame, ident: str, p: str) -> DataFrame:
        each = df.select(ident, f"{p}d", F.explode(f"{p}keys").alias("w")).join(frequency, "w", "left")
        order = each.groupBy(ident, f"{p}d").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w"))).alias("o"))
        prefix = F.greatest(F.lit(1), F.col(f"{p}d") - F.ceil(F.col(f"{p}d") * jaccard).cast("int") + 1)
        return order.select(ident, f"{p}d", F.explode(F.slice("o", F.lit(1), prefix)).alias("x")).select(ident, f"{p}d", "x.w")

    def rarest(df: DataFrame, ident: str, p: str) -> DataFrame:
        inner = df.select(ident, f"{p}n", F.explode(f"{p}inner").alias("w")).join(frequency, "w", "left")
        return inner.groupBy(ident, f"{p}n").agg(F.min_by("w", F.struct(F.coalesce("n", F.lit(0)), "w")).alias("w"))

    a_words, b_words = a.select("a_id", "a_n", F.explode("a_keys").alias("w")), b.select("b_id", "b_n", F.explode("b_keys").alias("w"))
    alike = rare(a, "a_id", "a_").join(rare(b, "b_id", "b_"), "w").where((F.col("a_d") >= jaccard * F.col("b_d")) & (F.col("b_d") >= jaccard * F.col("a_d"))).select("a_id", "b_id")
    inside = rarest(a, "a_id", "a_").join(b_words, "w").where("a_n <= b_n").select("a_id", "b_id")
    around = rarest(b, "b_id", "b_").join(a_words, "w").where("b_n <= a_n").select("a_id", "b_id")
    pairs = alike.union(inside).union(around).distinct().join(a.select("a_id", "a_title", "a_words"), "a_id").join(b.select("b_id", "b_title", "b_words"), "b_id")
    shorter = F.when(F.size("a_words") <= F.size("b_words"), F.col("a_title")).otherwise(F.col("b_title"))
    longer = F.when(F.size("a_words") <= F.size("b_words"), F.col("b_title")).otherwise(F.col("a_title"))
    within = (F.least(F.size("a_words"), F.size("b_words")) >= least) & F.contains(longer, shorter)
    alike = pairs.where(within | (set_jaccard(F.col("a_words"), F.col("b_words")) >= jaccard)).select("a_id", "b_id")
    by_title = alike.join(texts.select(F.struct("g", "title").alias("b_id"), "least"), "b_id").groupBy("a_id").agg(F.min("least").alias("_by_title")).select("a_id.g", "a_id.title", "_by_title")
    by_doi = right.where("doi <> ''").groupBy("g", "doi").agg(F.min("key").alias("_by_doi"))
    hits = left.join(by_title, ["g", "title"], "left").join(by_doi, ["g", "doi"], "left").groupBy("want_id").agg(F.min(F.least("_by_title", "_by_doi")).alias("hit"))
    return wanted.select("want_id").join(hits, "want_id", "left")


def twin_candidates(new: DataFrame, library: DataFrame, title_ratio: float = 0.85, surnames: float = 0.7, years: int = 2) -> DataFrame:
    """(new_id, twin): the first library record (by pos) that is the journal or preprint twin of a new one.

    Exactly one side's identifier each: a new DOI against a library arXiv id, or the other way round. Verified by years,
    surname Jaccard and title ratio. Records of the same surnames are one class; classes meet if they share one of the
    rarest surnames, of each as many as the Jaccard cannot all miss. A new record goes through a class in order of pos, in
    rounds that look at twice as many records as the last, and stops at its first twin; only one without a twin is compared
    with all of a class. Joins are by sorting: what files hold in a few MB, as titles and names repeat, is far larger as the
    rows of a broadcast, the more so once they are exploded.
    """
    from lectern.functions.text import last_token_surname

    def prepared(df: DataFrame, ident: str, p: str) -> DataFrame:
        names = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("authors", F.array().cast("array<string>")), last_token_surname), lambda x: x != "")))
        has = [F.trim(F.coalesce(c, F.lit(""))) != "" for c in ("doi", "arxiv_id")]
        return df.select(F.col(ident), *([F.col("pos")] if p == "b_" else []), has[0].alias(f"{p}doi"), has[1].alias(f"{p}arxiv"), normalize_title(F.col("title")).alias(f"{p}title"), F.col("year").alias(f"{p}year"), names.alias(f"{p}names"))

    a = prepared(new, "new_id", "a_").where("a_doi <> a_arxiv AND a_title <> ''")
    b = prepared(library, "key", "b_").where("b_doi <> b_arxiv AND b_title <> ''")
    n = b.select(F.explode("b_names").alias("w")).groupBy("w").agg(F.count("*").alias("n"))

    def rare(df: DataFrame, p: str) -> DataFrame:
        own = [f"{p}names", f"{p}doi"]
        each = df.select(*own).distinct().select(*own, F.explode(f"{p}names").alias("w")).join(n.hint("merge"), "w", "left")
        order = each.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w"))).alias("o"))
        prefix = F.greatest(F.lit(1), F.size("o") - F.ceil(F.size("o") * surnames).cast("int") + 1)
        return order.select(*own, F.explode(F.slice("o", F.lit(1), prefix)).alias("x")).select(*own, "x.w")

    met = rare(a, "a_").join(rare(b, "b_").hint("merge"), "w").where((F.col("a_doi") != F.col("b_doi")) & (set_jaccard(F.col("a_names"), F.col("b_names")) >= surnames)).drop("w").distinct()
    place = ["b_names", "b_doi"]
    shelf = saved(ranked(b.select(*place, "key", "pos", "b_title", "b_year"), place, [F.col("pos"), F.col("key")], "at"), "library")
    sizes = shelf.groupBy(*place).agg(F.count("*").alias("size"))
    apart = a.join(met.join(sizes.hint("merge"), place).hint("merge"), ["a_names", "a_doi"]).select("new_id", "a_title", "a_year", *place, "size")
    open_, hits, low, width = saved(apart, "open"), [], 0, 16
    near = F.coalesce(F.col("a_year") == 0, F.lit(True)) | F.coalesce(F.col("b_year") == 0, F.lit(True)) | (F.abs(F.col("a_year") - F.col("b_year")) <= years)
    while True:
        each = open_.withColumn("at", F.explode(F.sequence(F.lit(low), F.least(F.col("size").cast("int"), F.lit(low + width)) - 1)))
        close = each.join(shelf.where((F.col("at") >= low) & (F.col("at") < low + width)).hint("merge"), [*place, "at"]).where(near)
        hit = saved(close.where(ratio_reaches(title_ratio)("a_title", "b_title")).groupBy("new_id", *place).agg(F.min(F.struct("pos", "key")).alias("twin")), "twins")
        hits.append(hit.select("new_id", "twin"))
        low, width = low + width, width * 2
        open_ = saved(open_.where(F.col("size") > low).join(hit.select("new_id", *place).hint("merge"), ["new_id", *place], "left_anti"), "open")
        if open_.isEmpty():
            return reduce(DataFrame.union, hits).groupBy("new_id").agg(F.min("twin").alias("twin")).select("new_id", F.col("twin.key").alias("twin"))


def title_to_doi(stubs: DataFrame, candidates: DataFrame, least: int = 25) -> DataFrame:
    """(stub_id, doi): the one DOI whose candidate agrees on title, authors and year; ambiguous stubs get none.

    candidates: rows (stub_id, doi, title, authors, year), as a search has returned them.
    """
    empty = F.array().cast("array<string>")

    def names(c: str) -> Column:
        return F.array_distinct(F.filter(F.transform(F.coalesce(c, empty), surname), lambda x: x != ""))

    a = stubs.select("stub_id", F.col("title").alias("a_title"), F.filter(F.transform(F.coalesce("authors", empty), surname), lambda x: x != "").alias("a_names"), F.col("year").alias("a_year")).where(F.length(normalize_title(F.col("a_title"))) >= least)
    b = candidates.select("stub_id", F.trim("doi").alias("doi"), F.col("title").alias("b_title"), names("authors").alias("b_names"), F.col("year").alias("b_year")).where("doi <> ''")
    pairs = a.join(b, "stub_id").withColumn("_ratio", sequence_ratio(normalize_title(F.col("a_title")), normalize_title(F.col("b_title"))))
    title = (F.col("_ratio") >= F.when(F.col("a_year").isNull(), 0.97).otherwise(0.92)) & (title_jaccard(F.col("a_title"), F.col("b_title")) >= 0.9)
    author = F.coalesce(F.array_contains("b_names", F.get("a_names", F.lit(0))), F.lit(False)) & (set_jaccard(F.col("a_names"), F.col("b_names")) >= 0.5)
    year = F.col("a_year").isNull() | F.coalesce(F.abs(F.col("a_year") - F.col("b_year")) <= 1, F.lit(False))
    agreed = pairs.where(title & author & year).groupBy("stub_id").agg(F.count_distinct(F.lower("doi")).alias("n"), F.min("doi").alias("doi"))
    return agreed.where("n = 1").select("stub_id", "doi")


def _given_match(a: list[list[str]], b: list[list[str]]) -> bool:
    """A perfect matching between given names of one family, initials agreeing with full names."""
    def fits(x: list[str], y: list[str]) -> bool:
        return all(p == q or p[0] == q[0] and 1 in (len(p), len(q)) for p, q in zip(x, y))

    owner: dict[int, int] = {}

    def place(i: int, seen: set[int]) -> bool:
        for j, y in enumerate(b):
            if j not in seen and fits(a[i], y):
                seen.add(j)
                if j not in owner or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return len(a) == len(b) and all(place(i, set()) for i in range(len(a)))


@F.pandas_udf(T.BooleanType())
def same_authors(a: pd.Series, b: pd.Series) -> pd.Series:
    """Same families, and within each a perfect matching of given names up to initials."""
    import unicodedata

    def families(names) -> dict[str, list[list[str]]]:
        out: dict[str, list[list[str]]] = {}
        for name in names if names is not None else []:
            family, _, given = name.partition(",") if "," in name else (name.split()[-1] if name.split() else "", "", " ".join(name.split()[:-1]))
            def key(x: str) -> str:
                return "".join(c for c in unicodedata.normalize("NFC", x).casefold() if c.isalnum())

            out.setdefault(key(family), []).append([k for k in map(key, given.replace(".", " ").split()) if k])
        return out

    def one(x, y) -> bool:
        p, q = families(x), families(y)
        return bool(p) and p.keys() == q.keys() and all(_given_match(p[k], q[k]) for k in p)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def strict_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id): equal normalised titles and authors, years equal when both known, no conflict of identifiers."""
    def side(df: DataFrame, ident: str, p: str) -> DataFrame:
        return df.select(F.col(ident), normalize_title(F.col("title")).alias("_t"), *[F.col(c).alias(f"{p}{c}") for c in ("authors", "year", "doi", "arxiv_id")]).where("_t <> ''")

    both = side(left, "left_id", "a_").join(side(right, "right_id", "b_"), "_t")
    def agree(c: str) -> Column:
        x, y = F.lower(F.coalesce(f"a_{c}", F.lit(""))), F.lower(F.coalesce(f"b_{c}", F.lit("")))
        return (x == "") | (y == "") | (x == y)

    year = F.coalesce(F.col("a_year") == F.col("b_year"), F.lit(True))
    return both.where(year & agree("doi") & agree("arxiv_id")).where(same_authors("a_authors", "b_authors")).select("left_id", "right_id")


def alias_chase(aliases: DataFrame, strict: bool = False) -> DataFrame:
    """(key, root, is_cycle) for every key of (key, target): its last target; of a cycle, or what leads into one, no root.

    Pointer jumping: the rounds, each written, grow with the logarithm of the longest chain. A round
    that ends no further chain leaves cycles only. With strict a cycle raises.
    """
    keys = aliases.select(F.col("key").alias("_k")).distinct()
    now, open_before = saved(aliases.select("key", F.col("target").alias("at")), "chase"), None
    while True:
        open_now = now.join(keys, F.col("at") == F.col("_k"), "left_semi").count()
        if not open_now or open_now == open_before:
            break
        step = now.select(F.col("key").alias("_k"), F.col("at").alias("_next"))
        now = saved(now.join(step, F.col("at") == F.col("_k"), "left").select("key", F.coalesce("_next", "at").alias("at")), "chase")
        open_before = open_now
    if strict and open_now:
        raise ValueError(f"{open_now} keys are in a cycle or lead into one")
    out = now.join(keys, F.col("at") == F.col("_k"), "left")
    return out.select("key", F.when(F.col("_k").isNull(), F.col("at")).alias("root"), F.col("_k").isNotNull().alias("is_cycle"))


def section_roots(sections: DataFrame, units: DataFrame) -> DataFrame:
    """(unit_id, root): follow parent pointers, as long as exactly one parent matches; in a cycle no root."""
    single = sections.join(units.select(F.col("unit_id").alias("parent_id")), "parent_id").groupBy("unit_id").agg(F.count_distinct("parent_id").alias("n"), F.min("parent_id").alias("target")).where("n = 1").select(F.col("unit_id").alias("key"), "target")
    roots = alias_chase(single)
    return units.select("unit_id").join(roots, F.col("unit_id") == F.col("key"), "left").select("unit_id", F.when(F.coalesce("is_cycle", F.lit(False)), F.lit(None)).otherwise(F.coalesce("root", "unit_id")).alias("root"))


def point_in_interval(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """start <= at < end, joined on cells, so that no pair of far rows is looked at.

    An interval lies in at most 9 cells: their width is `width` times a power of two, the first that is an eighth of its length or
    more. A point is in one cell of each width that intervals have, of which there are as many as lengths have binary digits.
    Intervals go first, so that the pairs of one follow each other, and points are met in shares: the same points follow each
    interval of a cell, and a columnar file stores a run that comes again in a fraction of the room if it is short.
    """
    spread = intervals.where(F.col(end) > F.col(start)).withColumn("_w", _cell_width(F.col(end) - F.col(start), width))
    spread = spread.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / F.col("_w")), F.floor((F.col(end) - 1) / F.col("_w")))))
    widths = intervals.where(F.col(end) > F.col(start)).select(_cell_width(F.col(end) - F.col(start), width).alias("_w")).distinct()
    placed = points.join(F.broadcast(widths)).withColumn("_b", F.floor(F.col(at) / F.col("_w")))  # at most 64 widths
    shares = [placed.where(F.pmod(F.xxhash64(at), F.lit(SHARES)) == k) for k in range(SHARES)]
    met = [spread.join(share.hint("merge"), ["_w", "_b"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_w", "_b") for share in shares]
    return reduce(DataFrame.union, met)


def _cell_width(length: Column, width: int) -> Column:
    """`width` times the least power of two of which eight reach over `length`."""
    times = F.ceil(length / (8 * width)).cast("long")
    return F.lit(width).cast("long") * F.when(times <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(times - 1))))


def either_key(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_key: str) -> DataFrame:
    """Rows that match on any of several left keys, each pair once: a union of equi-joins instead of an OR."""
    out = None
    for key in left_keys:
        one = left.join(right, F.col(key) == F.col(right_key))
        out = one if out is None else out.union(one)
    return out.distinct()


def illegal_citations(answers: DataFrame, legal: DataFrame) -> DataFrame:
    """Per qid: cited_count (repeats kept), and the sorted distinct keys that are not legal. answers: (qid, key)."""
    bad = answers.join(legal.select("key").distinct(), "key", "left_anti").groupBy("qid").agg(F.sort_array(F.collect_set("key")).alias("illegal"))
    return answers.groupBy("qid").agg(F.count("*").alias("cited_count")).join(bad, "qid", "left").withColumn("illegal", F.coalesce("illegal", F.array().cast("array<string>")))


def correspondence(doi_a: Column, doi_b: Column, arxiv_a: Column, arxiv_b: Column, ratio: Column, jaccard: Column, authors: Column, year_gap: Column) -> Column:
    """struct<decision, reasons>: CONTRADICTED by conflicting identifiers, RESOLVED by equal ones or by all of title, authors and year, else UNRESOLVED."""
    def conflict(a: Column, b: Column) -> Column:
        return F.coalesce((a != "") & (b != "") & (a != b), F.lit(False))

    def equal(a: Column, b: Column) -> Column:
        return F.coalesce((a != "") & (a == b), F.lit(False))

    against = F.array_compact(F.array(F.when(conflict(doi_a, doi_b), "doi_conflict"), F.when(conflict(arxiv_a, arxiv_b), "arxiv_conflict")))
    same = F.array_compact(F.array(F.when(equal(doi_a, doi_b), "doi"), F.when(equal(arxiv_a, arxiv_b), "arxiv")))
    text = F.coalesce((ratio >= 0.92) & (jaccard >= 0.9) & (authors >= 0.5) & (year_gap <= 1), F.lit(False))
    return F.when(F.size(against) > 0, F.struct(F.lit("CONTRADICTED").alias("decision"), against.alias("reasons"))).when(F.size(same) > 0, F.struct(F.lit("RESOLVED").alias("decision"), same.alias("reasons"))).when(
        text, F.struct(F.lit("RESOLVED").alias("decision"), F.array(F.lit("bibliographic")).alias("reasons"))
    ).otherwise(F.struct(F.lit("UNRESOLVED").alias("decision"), F.array().cast("array<string>").alias("reasons")))
