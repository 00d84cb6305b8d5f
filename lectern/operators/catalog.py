"""Catalog records: identities, candidate folds, closures over units, admission, forks and item judgements."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.python import plain_title
from lectern.functions.text import canonical_doi, normalize_arxiv, normalize_title, surname, title_overlap


def candidate_identity(doi: Column, arxiv: Column, source: Column, source_id: Column, title: Column) -> Column:
    """doi:, arxiv:, <source>: or sha256: of the normalised title, the first that is there."""
    d, a = canonical_doi(doi), normalize_arxiv(arxiv)
    return (
        F.when(d != "", F.concat(F.lit("doi:"), d)).when(a != "", F.concat(F.lit("arxiv:"), a))
        .when((F.coalesce(source, F.lit("")) != "") & (F.coalesce(source_id, F.lit("")) != ""), F.concat(F.lower(source), F.lit(":"), F.regexp_replace(source_id, "^0+(?=.)", "")))
        .otherwise(F.concat(F.lit("sha256:"), F.sha2(normalize_title(title), 256)))
    )


def canonical_identity(candidates: Column, current: Column) -> Column:
    """Of struct<rung, key> candidates the least; the current one stays if its rung is as good."""
    least = F.array_min(candidates)
    return F.when(current.isNotNull() & (current["rung"] <= least["rung"]), current).otherwise(F.coalesce(least, current))


def serving_key(title: Column, authors: Column, year: Column) -> Column:
    """struct<title, author, year> of a record's title without a leading 'the', first surname and year; null if any is missing."""
    t = F.regexp_replace(normalize_title(title), "^the ", "")
    a = surname(F.get(authors, F.lit(0)))
    return F.when((t != "") & (a != "") & year.isNotNull(), F.struct(t.alias("title"), a.alias("author"), year.alias("year")))


def record_verdict(title: Column, authors: Column, text: Column, head: int = 1500) -> Column:
    """MATCH if three fifths of the title's longer words and an author's surname are in the head of the text, MISMATCH, or UNKNOWN without words to look for."""
    share = title_overlap(title, text, head)
    start = F.lower(F.substring(text, 1, head))
    names = F.filter(F.transform(F.coalesce(authors, F.array().cast("array<string>")), surname), lambda x: F.length(x) > 1)
    author = (F.size(names) == 0) | F.exists(names, lambda x: F.contains(start, x))
    return F.when(share.isNull() | text.isNull(), "UNKNOWN").when((share >= 0.6) & author, "MATCH").otherwise("MISMATCH")


def abstract_document(title: Column, authors: Column, year: Column, venue: Column, abstract: Column, most: int = 6000) -> Column:
    """Labelled lines of a record's metadata and abstract, blank fields left out; null without an abstract."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(abstract, "<[^>]+>", " "), r"\s+", " "))
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))

    def line(label: str, value: Column) -> Column:
        text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
        return F.when(text != "", F.concat(F.lit(f"{label}: "), text))

    body = F.concat_ws("\n", line("Title", title), line("Authors", F.array_join(authors, ", ")), line("Year", year), line("Venue", venue), line("Abstract", F.substring(plain, 1, most)))
    return F.when(F.coalesce(plain, F.lit("")) != "", body)


@F.pandas_udf(T.StringType())
def labelled_abstract(text: pd.Series) -> pd.Series:
    """The section headed Abstract, up to the next heading or Introduction or Keywords; null if there is none."""
    found = re.compile(r"(?ims)^\W{0,6}abstract\b\W*(.+?)(?=^\W{0,6}(?:\d\.?\s*)?(?:introduction|key\s?words)\b|^#{1,6}\s|\Z)")

    def one(x: str | None) -> str | None:
        m = found.search(x or "")
        return " ".join(m.group(1).split()) or None if m else None

    return text.map(one)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("score", T.DoubleType())])))
def judged_items(reply: pd.Series) -> pd.Series:
    """Items {idx, score} of a model's reply: the JSON array, or else every object that can be read; scores clamped, odd ones 0."""

    def clean(x) -> float:
        try:
            v = float(x)
        except (TypeError, ValueError):
            return 0.0
        return min(1.0, max(0.0, v)) if math.isfinite(v) else 0.0

    def one(text: str | None) -> list[dict]:
        try:
            items = json.loads(text or "")
        except ValueError:
            items = []
            for m in re.finditer(r"\{[^{}]*\}", text or ""):
                try:
                    items.append(json.loads(m.group()))
                except ValueError:
                    continue
        items = items if isinstance(items, list) else [items]
        return [{"idx": int(x["idx"]), "score": clean(x.get("score"))} for x in items if isinstance(x, dict) and isinstance(x.get("idx"), int)]

    return reply.map(one)


def planned_terms(terms: Column, most: int = 8) -> Column:
    """A planner's search terms: trimmed, blanks out, each once by its normalised form, the first `most`; the cap comes last."""
    none = F.array().cast("array<string>")
    flat = F.filter(F.transform(F.coalesce(terms, none), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    keys = F.transform(flat, lambda x: F.lower(x))
    first = F.filter(F.transform(flat, lambda x, i: F.struct(x.alias("t"), (F.array_position(keys, F.lower(x)) == i + 1).alias("new"))), lambda s: s["new"])
    return F.slice(F.transform(first, lambda s: s["t"]), 1, most)


def facets(reply: Column, most: int = 5) -> Column:
    """array<struct<query, hl, ll>> of a reply, its first `most`; null if any part has another type."""
    kind = "array<struct<query:string,hl:array<string>,ll:array<string>>>"
    return F.slice(F.from_json(reply, kind), 1, most)


def candidate_preview(rows: DataFrame, identity: Column, text: Sequence[str]) -> DataFrame:
    """Candidates of one identity folded: place of the first, rrf summed, best rank, first text that is not blank.

    rows: pos, rank, rrf and the text columns.
    """
    first = [F.min(F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.struct("pos", F.col(c).alias("v")))).alias(f"_{c}") for c in text]
    out = rows.withColumn("identity", identity).groupBy("identity").agg(F.min("pos").alias("pos"), F.round(F.sum("rrf"), 12).alias("rrf"), F.min("rank").alias("rank"), F.count("*").alias("n"), *first)
    return out.select("identity", "pos", "rrf", "rank", "n", *[F.col(f"_{c}.v").alias(c) for c in text])


def source_health(calls: DataFrame, terms: int) -> DataFrame:
    """(backend, degraded): degraded only if every term's call was."""
    return calls.groupBy("backend").agg((F.count_if("degraded") == terms).alias("degraded"))


def duplicate_groups(rows: DataFrame, identity: str, key: str = "key") -> DataFrame:
    """Identities held by several records, with their keys in order; blank identities are none."""
    there = rows.where(F.trim(F.coalesce(identity, F.lit(""))) != "")
    return there.groupBy(identity).agg(F.sort_array(F.collect_list(key)).alias("keys")).where(F.size("keys") > 1)


def scope_closure(units: DataFrame, chosen: DataFrame) -> DataFrame:
    """unit_id of the chosen units, their parents, and all sections of either. units: (unit_id, parent_id)."""
    own = units.join(chosen.select("unit_id").distinct(), "unit_id", "left_semi")
    parents = own.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("unit_id"))
    roots = own.select("unit_id").union(parents).distinct()
    sections = units.join(roots.select(F.col("unit_id").alias("parent_id")), "parent_id", "left_semi").select("unit_id")
    return roots.union(sections).distinct().join(units.select("unit_id").distinct(), "unit_id", "left_semi")


def pending_inputs(inputs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Inputs for which no job has been made."""
    return inputs.select("unit_id", "revision").distinct().join(jobs, ["unit_id", "revision"], "left_anti")


def selected_derivations(requirements: DataFrame, selections: DataFrame, derivations: DataFrame) -> DataFrame:
    """Every requirement with the derivation selected for it and its state; null where none is."""
    return requirements.join(selections.select("requirement_id", "derivation_id"), "requirement_id", "left").join(derivations.select("derivation_id", F.col("state").alias("derivation_state")), "derivation_id", "left")


def promotion_gaps(generation: DataFrame, **parts: DataFrame) -> DataFrame:
    """(unit_id, missing): units of a generation that lack a row in some of the named parts."""
    out = generation.select("unit_id").distinct()
    for name, rows in parts.items():
        out = out.join(rows.select("unit_id").distinct().withColumn(f"_{name}", F.lit(True)), "unit_id", "left")
    missing = F.array_compact(F.array(*[F.when(F.col(f"_{n}").isNull(), n) for n in parts]))
    return out.select("unit_id", missing.alias("missing")).where(F.size("missing") > 0)


def fork_generation(rows: DataFrame, old: str, new: str, id_col: str) -> DataFrame:
    """Rows of one generation copied into another, with ids derived from both."""
    return rows.where(F.col("generation") == old).withColumns({id_col: F.md5(F.concat_ws("\x1f", F.lit(new), F.col(id_col).cast("string"))), "generation": F.lit(new)})


def next_revision(*candidates: Column) -> Column:
    return F.greatest(*[F.coalesce(c, F.lit(0)) for c in candidates]) + 1


def source_label(path: Column) -> Column:
    """struct<kind, key> of a chunk's path: paper/<key>, abstract/<key>, doc/<key>#sN, or other."""
    def key(p: str) -> Column:
        return F.regexp_extract(path, p, 1)

    return F.when(path.rlike("^paper/"), F.struct(F.lit("fulltext").alias("kind"), key("^paper/(.*)$").alias("key"))).when(path.rlike("^abstract/"), F.struct(F.lit("abstract_only").alias("kind"), key("^abstract/(.*)$").alias("key"))).when(
        path.rlike("^doc/"), F.struct(F.lit("canon").alias("kind"), key(r"^doc/([^#]*)").alias("key"))
    ).otherwise(F.struct(F.lit("other").alias("kind"), F.coalesce(path, F.lit("")).alias("key")))


def eta_seconds(pages: Column, waiting: Column, per_page: float = 3.0, fixed: float = 60.0) -> Column:
    """Seconds until an extract is there: its pages and those before it, and a fixed part."""
    return F.coalesce(pages, F.lit(0)) * per_page + F.coalesce(waiting, F.lit(0)) * per_page + fixed


def venue_tiers(rows: DataFrame, names: dict[str, float], prefixes: dict[str, float], low: str, weak_citations: int = 5) -> DataFrame:
    """rows with tier: 0.5 for low venues, else by exact name, near name (ratio 0.88), DOI prefix, 0.5 for weak evidence, else 1.

    The name's tier is found once for each distinct venue. names are lower-cased and without
    punctuation; `low` is a pattern.
    """
    from difflib import SequenceMatcher

    known = list(names.items())

    @F.pandas_udf(T.DoubleType())
    def by_name(venue: pd.Series) -> pd.Series:
        def one(v: str | None) -> float | None:
            stem = plain_title(v)
            if not stem or re.search(low, stem):
                return 0.5 if stem else None
            if stem in names:
                return names[stem]
            best = max(((SequenceMatcher(None, stem, n).ratio(), t) for n, t in known), default=(0.0, 1.0))
            return best[1] if best[0] >= 0.88 else None

        return venue.map(one).astype(float)

    tiers = rows.select("venue").distinct().withColumn("_name", by_name("venue"))
    both = rows.join(tiers.withColumnRenamed("venue", "_venue"), F.col("venue").eqNullSafe(F.col("_venue")), "left").drop("_venue")
    doi = F.lower(F.trim(F.coalesce("doi", F.lit(""))))
    prefix = F.lit(None).cast("double")
    for p, t in sorted(prefixes.items(), key=lambda x: x[1]):
        prefix = F.when(doi.startswith(p), F.lit(t)).otherwise(prefix)
    name = F.when(~F.isnan("_name"), F.col("_name"))
    weak = (F.trim(F.coalesce("venue", F.lit(""))) != "") & (doi == "") & (F.coalesce("arxiv_id", F.lit("")) == "") & (F.coalesce("citation_count", F.lit(0)) < weak_citations)
    return both.withColumn("tier", F.when(name == 0.5, 0.5).otherwise(F.coalesce(F.greatest(name, prefix), F.when(weak, 0.5), F.lit(1.0)))).drop("_name")
