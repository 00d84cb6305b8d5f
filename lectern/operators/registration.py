"""Registration of a batch in its order: a candidate may match what an earlier one of the same batch has made or filled in.

Decisions depend on each other, but only through what records hold from which position on. These holdings are worked out
block by block of positions, each block four times as long as all before it. Within a block, rounds decide its candidates by
what the round before lets the earlier ones add, until the additions stay the same: the first candidate is right after one
round, and each round more follow. Rounds write additions, never candidates; all decisions are made at the end, in one pass
over the holdings. Most values have a holder in the first blocks, so that the long blocks add little and settle at once.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.lineage import saved

FIELDS = ("doi", "arxiv", "title")
#: Candidates of the first block, and how many times as many each later one ends with; rows that a broadcast table may have.
FIRST, TIMES, FEW = 4096, 4, 1 << 18
_SLOT = ("record", "field", "value", "version", "since", "ord")


def _blank(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def _agree(a: str, b: str) -> Column:
    """Whether two observations may be one paper: DOIs decide where both have one; else neither arXiv ids nor versions may differ."""
    def both(f: str) -> Column:
        return F.col(f"{a}{f}").isNotNull() & F.col(f"{b}{f}").isNotNull()

    same = {f: F.col(f"{a}{f}") == F.col(f"{b}{f}") for f in ("doi", "arxiv", "version")}
    return F.when(both("doi"), same["doi"]).otherwise(~(both("arxiv") & ~same["arxiv"]) & ~(both("version") & ~same["version"]))


def _exploded(held: DataFrame) -> DataFrame:
    """(record, field, value, version, since, ord): all that was ever brought to a record. held: (record, ord, since, doi, arxiv, version, title)."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), (F.col("version") if f == "arxiv" else F.lit(None).cast("string")).alias("version")) for f in FIELDS])
    return held.select("record", "ord", "since", F.inline(parts)).where("value IS NOT NULL").select(*_SLOT)


def _earliest(brought: DataFrame) -> DataFrame:
    """The same, what each record holds: of each field, what was brought first."""
    return brought.groupBy("record", "field").agg(F.min(F.struct("since", "ord", "value", "version")).alias("s")).select("record", "field", "s.value", "s.version", "s.since", "s.ord")


def _slots(records: DataFrame, held: DataFrame) -> DataFrame:
    """What each record holds, of the records and what came to them."""
    return _earliest(_exploded(records.unionByName(held)))


def _bounded(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast where it is counted to have at most FEW rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def _met(rows: DataFrame, table: DataFrame, value: str, *more: str) -> DataFrame:
    """Left join on the columns named; rows without a value are spread by their places, not sent to one task."""
    rows = rows.withColumn("_salt", F.when(F.col(value).isNull(), F.col("pos")).otherwise(F.lit(-1).cast("long")))
    return rows.join(table.withColumn("_salt", F.lit(-1).cast("long")), [value, *more, "_salt"], "left").drop("_salt", *more)


def _aliased(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows with a_doi and a_arxiv: the records of the first aliases that agree.

    Aliases of one DOI agree. Of one arXiv id, those agree that have the candidate's DOI, or that share no DOI with it and no other
    version; for each such case the first is known beforehand, so that no alias meets a candidate but the first of its kind.
    """
    of_doi = aliases.where("x_doi IS NOT NULL").groupBy(F.col("x_doi").alias("doi")).agg(F.min_by("x_record", "ord").alias("a_doi"))

    def kind(c: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))

    kinds = aliases.where("x_arxiv IS NOT NULL").select(F.col("x_arxiv").alias("arxiv"), F.explode(F.array(kind("x_doi"), F.lit("*"))).alias("_d"), kind("x_version").alias("_v"), F.struct("ord", F.col("x_record").alias("record")).alias("_hit"))
    of_arxiv = kinds.withColumn("_v", F.explode(F.array("_v", F.lit("*")))).groupBy("arxiv", "_d", "_v").agg(F.min("_hit").alias("_hit"))
    out = _met(rows, _bounded(saved(of_doi, "aliases")), "doi")
    of_arxiv = _bounded(saved(of_arxiv, "aliases"))
    doi, version = F.col("doi").isNotNull(), F.col("version").isNotNull()
    other = F.when(doi, "").otherwise("*")
    asked = ((other, F.when(version, "").otherwise("*")), (other, F.when(version, kind("version"))), (F.when(doi, kind("doi")), F.lit("*")))
    for i, (d, v) in enumerate(asked):
        out = _met(out.withColumns({"_d": d, "_v": v}), of_arxiv, "arxiv", "_d", "_v").withColumnRenamed("_hit", f"_hit{i}")
    return out.withColumn("a_arxiv", F.least("_hit0", "_hit1", "_hit2")["record"]).drop("_hit0", "_hit1", "_hit2")


def _holders(slots: DataFrame) -> DataFrame:
    """(field, value, since, record, s_doi, s_arxiv): the first holder of each value, with its identifiers and when it got them."""
    first = slots.groupBy("field", "value").agg(F.min(F.struct("since", "ord", "record")).alias("h")).select("field", "value", "h.since", "h.record")
    state = slots.where("field <> 'title'").groupBy("record").agg(*[F.max(F.when(F.col("field") == f, F.struct("since", "value", "version"))).alias(f"s_{f}") for f in ("doi", "arxiv")])
    return first.join(state, "record", "left").select("field", "value", "since", "record", "s_doi", "s_arxiv")


def _decided(candidates: DataFrame, holders: DataFrame, settled: int) -> DataFrame:
    """Candidates with record, rung and open: whether a value of theirs had no holder at position `settled`."""
    rows, free = candidates, F.lit(False)
    led = F.concat(F.lit("new:"), F.col("id").cast("string"))
    for f in FIELDS:
        holder = holders.where(F.col("field") == f).select(F.col("value").alias(f), F.col("since").alias("_since"), F.col("record").alias("_record"), "s_doi", "s_arxiv")
        seen = _met(rows, holder, f)
        now = {x: F.when(F.col(f"s_{x}.since") < F.col("pos"), F.col(f"s_{x}.value")) for x in ("doi", "arxiv")}
        seen = seen.withColumns({"r_doi": now["doi"], "r_arxiv": now["arxiv"], "r_version": F.when(now["arxiv"].isNotNull(), F.col("s_arxiv.version"))})
        seen = seen.withColumns({f"m_{f}": F.when((F.col("_since") < F.col("pos")) & _agree("r_", ""), F.col("_record")), f"_free_{f}": F.col(f).isNotNull() & (F.coalesce("_since", F.col("pos")) > settled)})
        rows, free = seen.drop("_since", "_record", "s_doi", "s_arxiv", "r_doi", "r_arxiv", "r_version"), free | F.col(f"_free_{f}")
    rungs = [(f"{kind}{f}", c) for f in FIELDS for kind, c in (("alias_", f"a_{f}"), ("", f"m_{f}")) if c != "a_title"]
    record, rung = F.when(F.col("valid"), led), F.when(F.col("valid"), F.lit("new")).otherwise(F.lit("rejected"))
    for name, c in reversed(rungs):
        record, rung = F.when(F.col(c).isNotNull(), F.col(c)).otherwise(record), F.when(F.col(c).isNotNull(), F.lit(name)).otherwise(rung)
    return rows.select("id", "pos", "doi", "arxiv", "version", "title", record.alias("record"), rung.alias("rung"), free.alias("open"))


def _live(slots: DataFrame, aliases: DataFrame) -> DataFrame:
    """The slots of records that later candidates can still come to: first holders of a value, and those that aliases name."""
    first = slots.groupBy("field", "value").agg(F.min(F.struct("since", "ord", "record")).alias("h")).select("h.record")
    return slots.join(first.union(aliases.select("x_record")).distinct(), "record", "left_semi")


def _blocks(rows: DataFrame) -> list[tuple[int, int]]:
    """Positions (after, to) of blocks of FIRST candidates and then of TIMES as many as came before, about."""
    n = rows.count()
    ends = []
    while FIRST * TIMES ** len(ends) < n:
        ends.append(FIRST * TIMES ** len(ends) / n)
    lowest, highest, cuts = rows.agg(F.min("pos"), F.max("pos"), F.percentile_approx("pos", [*ends, 1.0], 100_000)).first()
    return list(pairwise(sorted({lowest - 1, *cuts[:-1], highest}))) if n else []


def registered(candidates: DataFrame, records: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, pos, record, rung): the record that each candidate goes to, and the rung that found it.

    candidates: (id, pos, doi, arxiv, version, title, valid), pos distinct, from 0 and in order; records: (record, ord, doi, arxiv, version,
    title); aliases: (ord, doi, arxiv, version, record), other names of records. Identifiers are given in normal form,
    null or empty where there are none. Rungs are tried in order: an alias of the DOI, the DOI, an alias of the arXiv id, the
    arXiv id, the title; each looks at the first record to hold the value at that moment, in alias rungs at the first
    alias that agrees, and passes where identities disagree (_agree()). A candidate that no rung takes becomes record `new:<id>`
    if it is valid, else it is rejected. A matched candidate fills what its record lacks, which later ones may match.

    Only the first holder of a value counts, so candidates that share a title or an alias never meet each other, and a
    record that is first in nothing is kept only if an alias names it.
    """
    blanks = [_blank(f).alias(f) for f in ("doi", "arxiv", "version", "title")]
    rows = candidates.select("id", F.col("pos").cast("long").alias("pos"), *blanks, F.coalesce("valid", F.lit(False)).alias("valid"))
    other = aliases.select("ord", _blank("doi").alias("x_doi"), _blank("arxiv").alias("x_arxiv"), _blank("version").alias("x_version"), F.col("record").cast("string").alias("x_record"))
    rows = saved(_aliased(rows, other), "candidates")
    base = records.select(F.col("record").cast("string").alias("record"), F.col("ord").cast("long").alias("ord"), F.lit(-1).cast("long").alias("since"), *blanks)
    lift = records.agg(F.coalesce(F.max(F.col("ord").cast("long")), F.lit(-1)).alias("n")).first()["n"] + 1
    ahead = F.lit(other.where("startswith(x_record, 'new:')").limit(1).count() > 0)  # aliases of records that the batch will make
    slots = saved(_live(_earliest(_exploded(base)), other), "slots")
    holders = _bounded(saved(_holders(slots), "holders"))
    for after, to in _blocks(rows):
        taken, added = _bounded(slots.select("record", "field")), None
        while True:
            seen = _decided(rows.where((F.col("pos") > after) & (F.col("pos") <= to)), holders, after)
            held = seen.where(F.col("record").isNotNull() & ((F.col("rung") != "new") | F.col("open") | ahead))
            brought = _exploded(held.select("record", (F.col("pos") + lift).alias("ord"), F.col("pos").alias("since"), "doi", "arxiv", "version", "title"))
            now = saved(_earliest(brought.join(taken, ["record", "field"], "left_anti")), "added")
            apart = now.union(added).groupBy(*_SLOT).count().where("count <> 2") if added else now
            same = not apart.limit(1).count()
            added = now
            if same:
                break
            holders = _bounded(saved(_holders(slots.union(added)), "holders"))
        slots = saved(_live(slots.union(added), other), "slots")
    return _decided(rows, holders, 0).select("id", "pos", "record", "rung")


def filled_records(candidates: DataFrame, records: DataFrame, decisions: DataFrame) -> DataFrame:
    """(record, doi, arxiv, version, title): all records after the batch, blanks filled by the candidates that came to them in order."""
    blanks = [_blank(f).alias(f) for f in ("doi", "arxiv", "version", "title")]
    base = records.select(F.col("record").cast("string").alias("record"), F.col("ord").cast("long").alias("ord"), F.lit(-1).cast("long").alias("since"), *blanks)
    held = candidates.select("id", F.col("pos").cast("long").alias("since"), *blanks).join(decisions.select("id", "record"), "id").where("record IS NOT NULL").select("record", F.col("since").alias("ord"), "since", "doi", "arxiv", "version", "title")
    slots = _slots(base, held)
    value = {f: F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS}
    return base.select("record").union(held.select("record")).distinct().join(slots.groupBy("record").agg(*value.values(), F.max("version").alias("version")), "record", "left").select("record", "doi", "arxiv", "version", "title")
