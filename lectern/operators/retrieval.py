"""Whole retrieval plans, put together from rank lists, fusion, caps and orders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.graphs import vector_top_k
from lectern.operators.lineage import saved
from lectern.operators.matching import alias_chase
from lectern.operators.ranking import bm25, fair_merge, fan_out, first_distinct, pool_bonus, ranked, ranked_all, round_robin, rrf, rrf_items, token_budget

#: Tiers of sources in the order they are served.
TIERS = ["canon", "fulltext", "abstract_only"]
#: Places for new papers, for library papers, and for library papers that searches vouch for.
EXTERNAL, LIBRARY, VOUCHED = 60, 45, 45


def paper_text(title: Column, venue: Column, abstract: Column, authors: Column, year: Column, most: int = 2000) -> Column:
    """What lexical search sees of a record: blanks are skipped, the abstract counts up to `most` characters."""
    def there(c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", c)

    names = F.array_join(F.coalesce(authors, F.array().cast("array<string>")), " ")
    known_year = F.when(F.coalesce(year, F.lit(0)) != 0, year.cast("string"))
    return F.concat_ws(" ", there(title), there(venue), there(F.substring(F.coalesce(abstract, F.lit("")), 1, most)), there(names), known_year)


def chunk_key(content: Column, path: Column) -> Column:
    """c: and the first 200 characters, else fp: and the path, else null."""
    body, place = F.substring(F.coalesce(content, F.lit("")), 1, 200), F.coalesce(path, F.lit(""))
    return F.when(body != "", F.concat(F.lit("c:"), body)).when(place != "", F.concat(F.lit("fp:"), place))


def entity_key(name: Column) -> Column:
    flat = F.trim(F.coalesce(name, F.lit("")))
    return F.when(flat != "", F.concat(F.lit("e:"), flat))


def relation_key(source: Column, target: Column) -> Column:
    """Directed: a relation and its reverse are two."""
    a, b = F.coalesce(source, F.lit("")), F.coalesce(target, F.lit(""))
    return F.when((a != "") | (b != ""), F.concat(F.lit("r:"), a, F.lit("\x1f"), b))


# Orders


def relevance_order(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """rank by score, vouching hits, external score, authority, year (null last), then key."""
    order = [F.col("score").desc(), F.coalesce("vouch", F.lit(0)).desc(), F.coalesce("external_rrf", F.lit(0.0)).desc(), F.coalesce("authority", F.lit(0.0)).desc(), F.coalesce("year", F.lit(0)).desc(), F.col("key")]
    return ranked(rows, by, order)


def recency_order(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ranked(rows, by, [F.col("score").desc(), F.coalesce("year", F.lit(0)).desc(), F.col("key")])


def importance_order(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ranked(rows, by, [F.col("score").desc(), F.coalesce("citation_count", F.lit(0)).desc(), F.col("key")])


def list_order(rows: DataFrame, limit: int) -> DataFrame:
    """The first `limit` records by year, citations and key; unknown years and counts as 0."""
    return rows.orderBy(F.coalesce("year", F.lit(0)).desc(), F.coalesce("citation_count", F.lit(0)).desc(), "key").limit(limit)


def tier_place(tier: Column) -> Column:
    """A tier's place in the order; unknown ones come last."""
    place = F.array_position(F.array(*map(F.lit, TIERS)), tier)
    return F.when(place > 0, place).otherwise(len(TIERS) + 1)


def tier_sorted(rows: DataFrame, by: Sequence[str], tier: str = "tier", rank: str = "rank", most: int | None = None) -> DataFrame:
    """`rank` anew by tier, inside a tier as before; unknown tiers come last."""
    return ranked(rows, by, [tier_place(F.col(tier)), F.col(rank)], "_new", most).drop(rank).withColumnRenamed("_new", rank)


def rerank(rows: DataFrame, score: Callable[[Column, Column], Column], by: Sequence[str], pool_cap: int = 0, top_n: int | None = None, query: str = "query", content: str = "content", rank: str = "rank") -> DataFrame:
    """Rows by a model's score of query and content, `rank` anew; ties in the order they had.

    The pool is cut in its original order, to the larger of pool_cap (0: not) and top_n; a top_n of 0
    or None keeps all. `score` gives a column, for instance a pandas UDF around a model.
    """
    pool = ranked(rows, by, [F.col(rank)], "_old", max(pool_cap, top_n or 0)) if pool_cap else ranked(rows, by, [F.col(rank)], "_old")
    scored = pool.withColumn("relevance_score", score(F.col(query), F.col(content)))
    return ranked(scored, by, [F.col("relevance_score").desc(), F.col("_old")], "_new", top_n or None).drop(rank, "_old").withColumnRenamed("_new", rank)


# Local search over vectors and a graph


def vector_lists(corpus: DataFrame, vectors: DataFrame, paper: DataFrame, first_only: bool, start: int, k: int = 60) -> DataFrame:
    """(list_idx, rank, key): for each query vector the papers of its k nearest rows, each at its first place.

    vectors: (idx, vector), idx 0 the query, others its concepts; corpus: (key, vector); paper: (key,
    paper). first_only takes the query's alone. Lists are numbered from `start`.
    """
    asked = vectors.where("idx = 0") if first_only else vectors
    near = vector_top_k(corpus, asked.select(F.col("idx").alias("qid"), "vector"), k)
    named = near.join(paper, "key").groupBy("qid", "paper").agg(F.min("rank").alias("at"))
    return ranked(named, ["qid"], [F.col("at"), F.col("paper")]).select((F.col("qid") + start).alias("list_idx"), "rank", F.col("paper").alias("key"))


def hybrid_local_search(lists: Sequence[DataFrame]) -> DataFrame:
    """(rank, key, rrf): papers by reciprocal ranks over all vector lists and the topology list, ties by key. lists: (rank, key)."""
    every = lists[0].select("rank", "key")
    for other in lists[1:]:
        every = every.unionByName(other.select("rank", "key"))
    return ranked_all(rrf(every), [-F.col("rrf"), F.col("key")]).select("rank", "key", "rrf")


# Answers


def fused_retrieval(lists: DataFrame, anchors: DataFrame, per_paper: int = 0, base: int = 60) -> DataFrame:
    """(qid, rank, key, paper, tier, fused): the chunks served for each question.

    lists: (qid, list_idx, rank, key, paper, tier), list 0 that of the question as a whole; anchors: (qid,
    band, sources) with the coverage of list 0 and the sources a planner expects, and, if there, facets, the
    number of parts it cut the question into. A question with empty or weak coverage, or without facets (another
    list, where anchors don't say), keeps list 0 as it is; facets that found nothing count. Else all lists fuse by reciprocal
    ranks, tiers come in their order, a paper gives per_paper chunks at most (0: any), and the fan-out
    for the expected sources, or `base` without such, cuts.
    """
    many = lists.where("list_idx > 0").select("qid").distinct().withColumn("_many", F.lit(True))
    several = F.coalesce(F.col("facets") > 0 if "facets" in anchors.columns else F.col("_many"), F.lit(False))
    gate = anchors.join(many, "qid", "left").select("qid", (~F.col("band").isin("empty", "weak") & several).alias("fused"), F.when(F.col("sources") > 0, fan_out(F.col("sources"))).otherwise(base).alias("_cap"))
    both = lists.join(gate, "qid")
    plain = both.where("NOT fused AND list_idx = 0").select("qid", "rank", "key", "paper", "tier", "fused")
    one = rrf_items(both.where("fused"), ["paper", "tier", "_cap"], ["qid"])
    order = [tier_place(F.col("tier")), F.col("rrf").desc(), F.col("place")]  # each task keeps but the first ones, a question's rows never meet
    kept = ranked(one, ["qid", "paper"], order, "_nth", per_paper) if per_paper else one
    cut = ranked(kept, ["qid"], order, "_new", 100).where("_new < _cap")
    return plain.unionByName(cut.select("qid", F.col("_new").alias("rank"), "key", "paper", "tier", F.lit(True).alias("fused")))


def references(served: DataFrame) -> DataFrame:
    """(qid, pos, paper, tier): each paper once, in the order its first chunk is served; blank papers are none."""
    first = served.where(F.coalesce("paper", F.lit("")) != "").groupBy("qid", "paper").agg(F.min(F.struct("rank", "tier")).alias("f"))
    return ranked(first.select("qid", "paper", "f.rank", "f.tier"), ["qid"], [F.col("rank")], "pos").drop("rank")


def standard_retrieval(lists: DataFrame, sizes: DataFrame, cap: int, budget: int = 130_000) -> DataFrame:
    """(qid, pos, key, tokens): lists fused and dealt in fair shares, the question's own first, up to a budget of tokens. sizes: (key, tokens)."""
    merged = fair_merge(lists, cap).join(sizes, "key")
    return token_budget(merged, budget, ["qid"], F.col("tokens"), "pos").select("qid", "pos", "key", "tokens")


def graph_part(lists: DataFrame, cap: int = 40) -> DataFrame:
    """(qid, pos, key): entities or relations in fair shares, at most `cap`."""
    return fair_merge(lists, cap)


# Pools


def canonical_records(library: DataFrame) -> DataFrame:
    """(key, canonical): each record and the one its aliases lead to; dangling and circular ones are dropped. library: (key, alias_key)."""
    links = library.where("alias_key IS NOT NULL").select("key", F.col("alias_key").alias("target"))
    roots = alias_chase(links).where("NOT is_cycle").select("key", "root")
    both = library.select("key", "alias_key").join(roots, "key", "left").select("key", F.when(F.col("alias_key").isNull(), F.col("key")).otherwise(F.col("root")).alias("canonical"))
    return both.join(library.select(F.col("key").alias("canonical")), "canonical", "left_semi").select("key", "canonical")


def library_pool(library: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records to serve, one for each identity; (key, served) of all that fold into them; (identity, key) of what is excluded.

    library: (key, alias_key, identity, identified, excluded, ...). Of several records with one
    identity the identified ones come first, then the least key.
    """
    named = canonical_records(library).join(library.select("key", F.col("identity").alias("_own")), "key")
    full = saved(named.join(library.withColumnRenamed("key", "canonical").drop("alias_key"), "canonical"), "canonical")
    gone = full.where("excluded").select(F.explode(F.array_distinct(F.array("_own", "identity"))).alias("identity"), F.col("canonical").alias("key")).groupBy("identity").agg(F.min("key").alias("key"))
    live = full.where("NOT excluded")
    head = live.groupBy("identity").agg(F.min_by("canonical", F.struct((~F.col("identified")).alias("last"), "key")).alias("served"))
    folds = live.join(head, "identity").select("key", "served", "_own", "identity").distinct()
    nodes = library.join(head.select(F.col("served").alias("key"), F.col("identity").alias("_i")), "key").drop("_i")
    return nodes, folds, gone


def pool_fusion(library: DataFrame, terms: DataFrame, kg: DataFrame, external: DataFrame, first_year: int | None = None, last_year: int | None = None, weight: float = 0.25, caps: tuple[int, int, int] = (EXTERNAL, LIBRARY, VOUCHED)) -> DataFrame:
    """(arm, pos, key): the pools that a search judges: new papers, library papers, and library papers that searches vouch for.

    library: see library_pool(), with text, year and authority; terms: (term_idx, term); kg: (rank, key)
    of a local search; external: (term_idx, rank, identity). Hits of excluded records are dropped. Hits of library
    records vouch for them; the others compete in a list a term. Library lists are BM25 a term and the
    local search, over records in the year window (unknown years are in it); with a weight the
    authority bonus joins their scores. Lists fuse by reciprocal ranks and are dealt in fair shares.
    """
    nodes, folds, gone = (saved(part, "pool") for part in library_pool(library))
    in_window = F.lit(True)
    if first_year is not None:
        in_window = in_window & (F.col("year").isNull() | (F.col("year") >= first_year))
    if last_year is not None:
        in_window = in_window & (F.col("year").isNull() | (F.col("year") <= last_year))
    corpus = nodes.where(in_window)
    # external hits, folded into library records by any identity of theirs
    names = folds.select(F.explode(F.array_distinct(F.array("_own", "identity"))).alias("identity"), "served").groupBy("identity").agg(F.min("served").alias("served"))
    hits = saved(external.join(gone.select("identity"), "identity", "left_anti").join(names, "identity", "left"), "hits")
    new = hits.where("served IS NULL").groupBy(F.col("term_idx").alias("list_idx"), F.col("identity").alias("key")).agg(F.min("rank").alias("at"))
    new_lists = ranked(new, ["list_idx"], [F.col("at"), F.col("key")]).select(F.lit(0).alias("qid"), "list_idx", "rank", "key")
    vouch = hits.where("served IS NOT NULL").groupBy(F.col("served").alias("key")).agg(F.count("*").alias("vouch"), F.round(F.sum(1 / (60 + F.col("rank"))), 12).alias("external_rrf"))
    # library lists
    lexical = bm25(corpus, terms).select(F.col("term_idx").alias("list_idx"), "rank", "key")
    local = kg.join(folds.select("key", "served").distinct(), "key").groupBy(F.col("served").alias("key")).agg(F.min("rank").alias("at")).join(corpus.select("key"), "key", "left_semi")
    last = terms.agg((F.max("term_idx") + 1).alias("list_idx"))
    placed = ranked_all(local, [F.col("at"), F.col("key")]).crossJoin(F.broadcast(last)).select("list_idx", "rank", "key")
    lists = saved(lexical.unionByName(placed), "lists")
    fused = rrf(lists).join(lists.groupBy("key").agg(F.min("rank").alias("best_rank")), "key").join(corpus.select("key", F.coalesce("authority", F.lit(0.0)).alias("authority")), "key")
    n_lists = lists.select("list_idx").distinct().count()
    scores = pool_bonus(fused, n_lists, weight).select("key", "fused") if weight > 0 else fused.select("key", F.col("rrf").alias("fused"))
    reordered = ranked(lists.join(scores, "key"), ["list_idx"], [F.col("fused").desc(), F.col("rank")], "_new").select(F.lit(0).alias("qid"), "list_idx", F.col("_new").alias("rank"), "key")
    outside = fair_merge(new_lists, caps[0]).select(F.lit("external").alias("arm"), "pos", F.col("key").cast("string").alias("key"))
    inside = saved(round_robin(reordered, caps[1]).select(F.lit("library").alias("arm"), "pos", F.col("key").cast("string").alias("key")), "inside")
    # vouched records that found no place
    free = vouch.join(corpus.select("key", "year", F.coalesce("authority", F.lit(0.0)).alias("authority"), F.coalesce("citation_count", F.lit(0)).alias("citation_count")), "key").join(inside.select(F.col("key")), "key", "left_anti")
    year = F.coalesce(F.when(F.col("year") != 0, F.col("year")), F.lit(0))
    if weight > 0:
        by_authority = ranked_all(free, [-F.col("authority"), -F.col("external_rrf"), -F.col("vouch"), -year, F.col("key")], "_a")
        order = [F.round(-(F.col("external_rrf") + 2.0 * weight / (60 + F.col("_a"))), 12), -F.col("vouch"), -F.col("authority"), -year, F.col("key")]
        supplement = ranked_all(by_authority, order, "pos")
    else:
        supplement = ranked_all(free, [-F.col("vouch"), -F.col("external_rrf"), -F.col("citation_count"), -year, F.col("key")], "pos")
    also = supplement.where(F.col("pos") < caps[2]).select(F.lit("vouched").alias("arm"), "pos", F.col("key").cast("string").alias("key"))
    return outside.unionByName(inside).unionByName(also)
