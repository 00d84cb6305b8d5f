"""Retrieval-evaluation statistics: per-question metrics, paired tests, gates and verdicts."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import harmonic
from lectern.operators.ranking import first_distinct


def recall_at(served: DataFrame, gold: DataFrame, n: int | None, distinct: bool, by: str = "qid") -> DataFrame:
    """(qid, recall): share of gold keys among the first n rows, the first n distinct keys, or all served (n None).

    The denominator is the gold size; questions without gold have no recall.
    """
    cut = served if n is None else first_distinct(served, n, [by], "key") if distinct else served.where(F.col("rank") < n)
    keys = cut.select(by, "key").distinct()
    hits = gold.select(by, "key").distinct().join(keys.withColumn("_hit", F.lit(1)), [by, "key"], "left")
    return hits.groupBy(by).agg((F.count("_hit") / F.count("*")).alias("recall"))


def hit_at(served: DataFrame, gold: DataFrame, n: int, by: str = "qid") -> DataFrame:
    return recall_at(served, gold, n, False, by).select(by, (F.col("recall") > 0).cast("int").alias("hit"))


def hallucinated(cited: DataFrame, served: DataFrame, by: str = "qid") -> DataFrame:
    """(qid, rate): distinct cited keys that were never served; no citation, no rate."""
    both = cited.select(by, "key", F.lit(True).alias("_c")).unionByName(served.select(by, "key", F.lit(False).alias("_c")))  # one aggregation, no join
    c = both.groupBy(by, "key").agg(F.max("_c").alias("_c"), F.min("_c").alias("_unserved")).where("_c")
    return c.groupBy(by).agg((F.count_if(F.col("_unserved") | F.col("key").isNull() | F.col(by).isNull()) / F.count("*")).alias("rate"))


def mean_metrics(rows: DataFrame, metrics: Sequence[str], population: Column | None = None) -> DataFrame:
    """Means over rows with a value; undefined values are left out, never counted as 0."""
    source = rows if population is None else rows.where(population)
    return source.agg(*[F.round(F.avg(m), 9).alias(m) for m in metrics])


def seed_mean(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and sample deviation over seeds; one seed has deviation 0."""
    return rows.groupBy(*by).agg(F.round(F.avg(value), 9).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 9).alias("sd"), F.count(value).alias("n"))


def majority(rows: DataFrame, by: Sequence[str], vote: str) -> DataFrame:
    """True if at least half of the votes are; ties count true."""
    return rows.groupBy(*by).agg((2 * F.count_if(F.coalesce(vote, F.lit(False))) >= F.count("*")).alias("majority"))


def pairwise_tally(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Verdict counts (a, b, tie) and the winner: more wins, then the balance weighted high 3, med 2, low 1, else tie."""
    w = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "med", 2).when(F.col("confidence") == "low", 1).otherwise(0)
    out = rows.groupBy(*by).agg(*[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("a", "b", "tie")], F.coalesce(F.sum(F.when(F.col("verdict") == "a", w).when(F.col("verdict") == "b", -w).otherwise(0)), F.lit(0)).alias("balance"))
    return out.withColumn("winner", F.when(F.col("n_a") > F.col("n_b"), "a").when(F.col("n_b") > F.col("n_a"), "b").when(F.col("balance") > 0, "a").when(F.col("balance") < 0, "b").otherwise("tie"))


def macro_precision(judged: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, precision): mean of ims / 100 over a question's judged chunks, 0 for none."""
    per = judged.groupBy("qid").agg((F.avg("ims") / 100).alias("precision"))
    return questions.select("qid").distinct().join(per, "qid", "left").withColumn("precision", F.round(F.coalesce("precision", F.lit(0.0)), 9))


def served_precision(rows: DataFrame, bar: float = 0.7, by: str = "qid") -> DataFrame:
    """Share of served rows whose score reaches the bar; nothing served, null."""
    return rows.groupBy(by).agg(F.avg((F.col("score") >= bar).cast("double")).alias("p_served"))


def noise_floor(runs: DataFrame) -> DataFrame:
    """One row: mean over questions of the sample deviation between runs, deviation and range of the run means. runs: (run, qid, value)."""
    per_q = runs.groupBy("qid").agg(F.stddev_samp("value").alias("sd")).agg(F.round(F.avg("sd"), 9).alias("mean_qid_sd"))
    means = runs.groupBy("run").agg(F.avg("value").alias("m"))
    return per_q.crossJoin(means.agg(F.round(F.stddev_samp("m"), 9).alias("run_sd"), F.round(F.max("m") - F.min("m"), 9).alias("run_range")))


def run_means(rows: DataFrame) -> DataFrame:
    return rows.groupBy("metric", "qid").agg(F.round(F.avg("value"), 9).alias("value"))


def headline(recall: DataFrame, nuggets: DataFrame) -> DataFrame:
    """(qid, headline): harmonic mean of recall and nugget recall where both are there."""
    return recall.join(nuggets, "qid").select("qid", F.round(harmonic(F.col("recall"), F.col("nugget_recall")), 9).alias("headline"))


def paired_deltas(baseline: DataFrame, variant: DataFrame) -> DataFrame:
    return baseline.select("qid", F.col("value").alias("a")).join(variant.select("qid", F.col("value").alias("b")), "qid").select("qid", "a", "b", (F.col("b") - F.col("a")).alias("delta"))


def _blocks(rounds: int, n: int, cells: int = 2_000_000) -> list[int]:
    """Rounds dealt into blocks of so many resampled numbers."""
    each = max(1, cells // max(n, 1))
    return [min(each, rounds - done) for done in range(0, rounds, each)]


def bca_interval(deltas: np.ndarray, rounds: int = 10_000, alpha: float = 0.05, rng: np.random.Generator | None = None) -> tuple[float, float]:
    """Bias-corrected, accelerated bootstrap interval of a mean; the mean itself for degenerate samples."""
    if not len(deltas):
        return float("nan"), float("nan")
    n, mean = len(deltas), float(np.mean(deltas))
    if np.ptp(deltas) <= 1e-12 * max(1.0, abs(mean)):
        return mean, mean
    rng = rng or np.random.default_rng(0)
    return _interval(np.concatenate([deltas[rng.integers(0, n, (k, n))].mean(1) for k in _blocks(rounds, n)]), deltas, alpha)


def _interval(means: np.ndarray, deltas: np.ndarray, alpha: float) -> tuple[float, float]:
    """The interval's ends from the means of the resamples: quantiles moved by bias and acceleration."""
    n, mean, rounds = len(deltas), float(np.mean(deltas)), len(means)
    normal = NormalDist()
    z0 = normal.inv_cdf(float(np.clip(np.mean(means < mean), 1 / rounds, 1 - 1 / rounds)))
    gone = (deltas.sum() - deltas) / (n - 1)
    gap = gone.mean() - gone
    spread = 6.0 * np.sum(gap**2) ** 1.5
    accel = float(np.sum(gap**3) / spread) if spread else 0.0
    ends = []
    for tail in (alpha / 2, 1 - alpha / 2):
        z = z0 + normal.inv_cdf(tail)
        ends.append(float(np.quantile(means, normal.cdf(z0 + z / (1 - accel * z)))))
    return ends[0], ends[1]


def lows_without(deltas: np.ndarray, drops: Sequence[int], rounds: int = 10_000, alpha: float = 0.05, seed: int = 0) -> np.ndarray:
    """The interval's lower end for the other deltas when one is left out, for each place in `drops`; one delta left stands for itself.

    All are resampled by the same draws. Moving the gap by one place changes a resample's sum in that place alone, so
    running sums serve every place, and what is held grows with the places times the rounds, not times the deltas.
    """
    n, at = len(deltas) - 1, np.asarray(drops, int)
    if n == 1:
        return deltas[1 - at]
    first, last = int(at.min()), int(at.max())
    rng, means, done = np.random.default_rng(seed), np.empty((rounds, len(at))), 0
    for k in _blocks(rounds, n):
        drawn = rng.integers(0, n, (k, n)) + n * np.arange(k)[:, None]
        counts = np.bincount(drawn.ravel(), minlength=k * n).reshape(k, n)
        moved = np.cumsum(counts[:, first:last] * (deltas[first:last] - deltas[first + 1 : last + 1]), 1)
        sums = (counts @ np.delete(deltas, first))[:, None] + np.concatenate([np.zeros((k, 1)), moved], 1)
        means[done : done + k] = sums[:, at - first] / n
        done += k
    out = np.empty(len(at))
    for j, place in enumerate(at):
        left = np.delete(deltas, place)
        mean = left.mean()
        out[j] = mean if np.ptp(left) <= 1e-12 * max(1.0, abs(mean)) else _interval(means[:, j], left, alpha)[0]
    return out


def gains_without(deltas: np.ndarray, rounds: int = 10_000, alpha: float = 0.05, seed: int = 0) -> np.ndarray:
    """For each place whether the other deltas gain: whether the end that lows_without() gives for it is above 0.

    One pass over the draws decides all places. Whether a quantile is above 0 follows from how many means are not, and only
    where it falls between the last of these and the first above 0 from the two themselves; its place follows from how many
    means are below the mean and from sums of powers. So a few numbers a place are held, and time grows with the deltas times the rounds.
    Of a few deltas many resamples are the deltas themselves, and rounding tells whether they are below the mean: those take the interval's end.
    """
    n = len(deltas) - 1
    if n < 64:
        return lows_without(deltas, range(n + 1), rounds, alpha, seed) > 0
    rest = deltas.sum() - deltas
    step, not_above, below = deltas[:-1] - deltas[1:], np.zeros(n + 1, int), np.zeros(n + 1, int)
    last, first = np.full(n + 1, -np.inf), np.full(n + 1, np.inf)
    rng = np.random.default_rng(seed)
    for k in _blocks(rounds, n):
        drawn = rng.integers(0, n, (k, n))
        drawn += n * np.arange(k)[:, None]
        counts = np.bincount(drawn.ravel(), minlength=k * n).reshape(k, n)
        sums = np.empty((k, n + 1))
        sums[:, 0] = counts @ deltas[1:]
        np.multiply(counts, step, out=sums[:, 1:])
        np.cumsum(sums, 1, out=sums)
        low = sums <= 0
        below += (sums < rest).sum(0)
        if low.any():
            not_above += low.sum(0)
            last = np.maximum(last, np.where(low, sums, -np.inf).max(0))
            sums[low] = np.inf
        first = np.minimum(first, sums.min(0))
    (accel, point), normal = _ends_without(deltas), NormalDist()
    z, out = normal.inv_cdf(alpha / 2), np.empty(n + 1, bool)
    bias = {b: normal.inv_cdf(float(np.clip(b / rounds, 1 / rounds, 1 - 1 / rounds))) for b in np.unique(below).tolist()}
    for j, b, a, one in zip(range(n + 1), below.tolist(), accel.tolist(), point.tolist(), strict=True):
        if one:
            out[j] = rest[j] > 0
            continue
        moved = bias[b] + z
        at = normal.cdf(bias[b] + moved / (1 - a * moved)) * (rounds - 1)
        before = int(at)
        # the means in order: not_above[j] that are not above 0, then the others
        out[j] = not_above[j] <= before or (not_above[j] == before + 1 and last[j] + (at - before) * (first[j] - last[j]) > 0)
    return out


def _ends_without(deltas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The acceleration of the others' mean, and whether the others lie in one point, when one delta is left out."""
    n = len(deltas) - 1
    order = np.sort(deltas)
    high, low = np.where(deltas == order[-1], order[-2], order[-1]), np.where(deltas == order[0], order[1], order[0])
    point = high - low <= 1e-12 * np.maximum(1.0, np.abs((deltas.sum() - deltas) / n))
    off = deltas - deltas.mean()
    squares, cubes, shift = np.sum(off**2), np.sum(off**3), -off / n
    second = squares - off**2 - n * shift**2
    third = cubes - off**3 - 3 * shift * (squares - off**2) + 2 * n * shift**3
    for j in np.flatnonzero(~point & (second <= 1e-6 * squares)):  # one far from all others: the difference of sums has no digits left
        left = np.delete(deltas, j)
        own = left - left.mean()
        second[j], third[j] = np.sum(own**2), np.sum(own**3)
    spread = 6.0 * np.maximum(second, 0) ** 1.5
    return np.divide(third, spread, out=np.zeros(n + 1), where=spread > 0), point


def sign_flip_p(deltas: np.ndarray, rounds: int = 10_000, rng: np.random.Generator | None = None) -> float:
    """Two-sided permutation p of a mean under sign flips: exact up to 20 deltas, else Monte Carlo with the observed one added."""
    n = len(deltas)
    if not n or np.allclose(deltas, 0):
        return 1.0
    seen = abs(deltas.mean()) - 1e-12
    if n <= 20:
        sums = np.zeros(1)
        for d in deltas:
            sums = np.concatenate([sums + d, sums - d])
        return float(np.mean(np.abs(sums) / n >= seen))
    rng = rng or np.random.default_rng(0)
    hits = sum(int((np.abs(((2.0 * rng.integers(0, 2, (k, n)) - 1) * deltas).mean(1)) >= seen).sum()) for k in _blocks(rounds, n))
    return (hits + 1) / (rounds + 1)


def compare_metrics(pairs: DataFrame, lower_is_better: Sequence[str] = (), alpha: float = 0.05, rounds: int = 10_000, seed: int = 0) -> DataFrame:
    """Per metric: means, interval, p and whether the variant improves. pairs: (metric, qid, a, b).

    A group is one metric's questions. Where lower is better the sign is turned for the decision and
    turned back for the report.
    """
    down = set(lower_is_better)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("qid")
        metric = group["metric"].iloc[0]
        d = (group["b"] - group["a"]).to_numpy(float)
        sign = -1.0 if metric in down else 1.0
        rng = np.random.default_rng(seed)
        low, high = bca_interval(sign * d, rounds, alpha, rng)
        p = sign_flip_p(sign * d, rounds, rng)
        ends = (low, high) if sign > 0 else (-high, -low)
        return pd.DataFrame({"metric": [metric], "n": [len(d)], "mean_a": [group["a"].mean()], "mean_b": [group["b"].mean()], "delta": [d.mean()], "ci_low": [ends[0]], "ci_high": [ends[1]], "p": [p], "improved": [bool(low > 0 and p < alpha)]})

    return pairs.groupBy("metric").applyInPandas(run, "metric string, n long, mean_a double, mean_b double, delta double, ci_low double, ci_high double, p double, improved boolean")


def jackknife(pairs: DataFrame) -> DataFrame:
    """Per metric: the smallest and largest mean delta when one question is left out, and whether their sign holds."""
    total = pairs.groupBy("metric").agg(F.sum(F.col("b") - F.col("a")).alias("_s"), F.count("*").alias("_n"))
    left = pairs.join(total, "metric").where("_n > 1").withColumn("_m", (F.col("_s") - (F.col("b") - F.col("a"))) / (F.col("_n") - 1))
    return left.groupBy("metric").agg(F.round(F.min("_m"), 9).alias("low"), F.round(F.max("_m"), 9).alias("high")).withColumn("stable", F.signum("low") == F.signum("high"))


def gates(values: DataFrame, rules: DataFrame, expected: DataFrame) -> DataFrame:
    """(metric, passed, reason): absolute gates on means; a metric with missing questions fails closed.

    values: (metric, qid, value); rules: (metric, low, high); expected: (qid).
    """
    n = expected.select("qid").distinct().agg(F.count("*").alias("_want"))
    have = values.join(expected.select("qid").distinct(), "qid", "left_semi").groupBy("metric").agg(F.avg("value").alias("_mean"), F.count_distinct(F.when(F.col("value").isNotNull(), F.col("qid"))).alias("_have"))
    both = rules.join(have, "metric", "left").crossJoin(F.broadcast(n))
    reason = F.when(F.col("_have").isNull() | (F.col("_have") < F.col("_want")), "missing").when(F.col("low").isNotNull() & (F.col("_mean") < F.col("low")), "below").when(F.col("high").isNotNull() & (F.col("_mean") > F.col("high")), "above").otherwise("")
    return both.select("metric", (reason == "").alias("passed"), reason.alias("reason"))


def verdict(comparison: DataFrame, stability: DataFrame, passed: DataFrame, metric: str, floor: float) -> DataFrame:
    """One row: ship only if the metric improves beyond the noise floor, keeps its sign, and all gates pass."""
    c = comparison.where(F.col("metric") == metric).agg(F.coalesce(F.bool_and("improved"), F.lit(False)).alias("improved"), F.coalesce(F.max("delta"), F.lit(0.0)).alias("delta"))
    s = stability.where(F.col("metric") == metric).agg(F.coalesce(F.bool_and("stable"), F.lit(False)).alias("stable"))
    g = passed.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("gates"))
    return c.crossJoin(s).crossJoin(g).withColumn("ship", F.col("improved") & (F.abs("delta") > floor) & F.col("stable") & F.col("gates"))


def judge_violations(rows: DataFrame) -> DataFrame:
    """Judgements out of their ranges or identities: (qid, problems)."""
    def out_of(c: str, low: float, high: float) -> Column:
        return ~F.coalesce(F.col(c).between(low, high), F.lit(True))

    checks = {"ims": out_of("ims", 0, 100), "nugget_recall": out_of("nugget_recall", 0, 1), "relevance": out_of("relevance", 0, 5), "claims": F.coalesce(F.col("n_claims_with_citation") > F.col("n_substantive_claims"), F.lit(False))}
    problems = F.array_compact(F.array(*[F.when(bad, name) for name, bad in checks.items()]))
    return rows.select("qid", problems.alias("problems")).where(F.size("problems") > 0)


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each stratum by a seeded digest of the key: the same sample on every run."""
    from lectern.operators.ranking import ranked

    return ranked(rows, [stratum], [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)], "_n", n).drop("_n")


# Runs


def served_metrics(results: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, recall, citation_recall, hallucinated) of every answerable question that was answered.

    results: (qid, served, cited, prose), arrays of keys, prose null without an answer's text; gold: (qid,
    gold_keys), empty for a trap. Recall counts gold among all that was served, citation recall among the
    cited; hallucinated is the share of citations in the prose that were not served (null without any),
    or, without prose, of the cited keys.
    """
    both = results.join(gold.where(F.size("gold_keys") > 0), "qid")
    want, served, cited = (F.array_distinct(c) for c in ("gold_keys", "served", "cited"))
    prose = F.array_distinct("prose")
    told = F.when(F.size(prose) > 0, F.size(F.array_except(prose, served)) / F.size(prose))
    plain = F.size(F.array_except(cited, served)) / F.greatest(F.lit(1), F.size(cited))
    return both.select("qid", (F.size(F.array_intersect(want, served)) / F.size(want)).alias("recall"), (F.size(F.array_intersect(want, cited)) / F.size(want)).alias("citation_recall"), F.when(F.col("prose").isNull(), plain).otherwise(told).alias("hallucinated"))


def run_evaluation(results: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: questions, traps, answerable ones, and the means of their metrics where these are defined.

    results: (qid, served, cited, answered); gold: (qid, gold_keys). A trap is violated if it is answered
    with a citation; an answerable question is overconfident if it cites nothing of its gold but something else.
    A result without gold raises.
    """
    both = results.join(gold, "qid", "left")
    known = both.withColumn("gold_keys", F.when(F.col("gold_keys").isNull(), F.raise_error(F.concat(F.lit("no gold for "), F.col("qid").cast("string"))).cast(both.schema["gold_keys"].dataType)).otherwise(F.col("gold_keys")))
    trap = F.size("gold_keys") == 0
    want, served, cited = (F.array_distinct(c) for c in ("gold_keys", "served", "cited"))
    hits = F.size(F.array_intersect(want, cited))
    per = known.select(
        trap.alias("trap"),
        F.when(~trap, F.size(F.array_intersect(want, served)) / F.size(want)).alias("recall"),
        F.when(~trap, hits / F.size(want)).alias("citation_recall"),
        F.when(~trap & (F.size(cited) > 0), F.size(F.array_except(cited, served)) / F.size(cited)).alias("hallucinated"),
        F.when(trap, (F.col("answered") & (F.size(cited) > 0)).cast("double")).alias("trap_violation"),
        F.when(~trap, ((F.size(cited) > 0) & (hits == 0)).cast("double")).alias("overconfident"),
    )
    means = [F.round(F.avg(c), 9).alias(c) for c in ("recall", "citation_recall", "hallucinated", "trap_violation", "overconfident")]
    return per.agg(F.count("*").alias("n"), F.count_if("trap").alias("n_traps"), F.count_if(~F.col("trap")).alias("n_answerable"), *means)


def recall_curve(served: DataFrame, gold: DataFrame, cuts: Sequence[int]) -> DataFrame:
    """(qid, cut, recall): the share of gold keys among the first rows, for all cuts from one join."""
    both = served.select("qid", "key", "rank", F.lit(False).alias("gold")).unionByName(gold.select("qid", "key", F.lit(None).cast(served.schema["rank"].dataType).alias("rank"), F.lit(True).alias("gold")))
    met = both.groupBy("qid", "key").agg(F.min("rank").alias("at"), F.max("gold").alias("gold")).where("gold")
    hits = met.withColumn("at", F.when(F.col("qid").isNotNull() & F.col("key").isNotNull(), F.col("at")))
    per = hits.groupBy("qid").agg(*[(F.count_if(F.coalesce(F.col("at") < c, F.lit(False))) / F.count("*")).alias(f"c{c}") for c in cuts])
    return per.select("qid", F.explode(F.array(*[F.struct(F.lit(c).alias("cut"), F.col(f"c{c}").alias("recall")) for c in cuts])).alias("x")).select("qid", "x.*")


def movable(pairs: DataFrame, least: float = 1e-9) -> DataFrame:
    """The questions that move: (metric, qid, a, b) with |b - a| above `least`."""
    return pairs.where(F.abs(F.col("b") - F.col("a")) > least)


def movers_left_out(pairs: DataFrame, lower_is_better: Sequence[str] = (), least: float = 1e-9, rounds: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(metric, dropped, survived): whether the other movers still gain when one is left out, of metrics with two movers or more.

    They do if the lower end of the interval of their mean gain is above 0; a single one left needs a gain above 0. Where
    lower is better gains are falls. A metric's movers are its questions, which one row holds and one task goes through once.
    """
    sign = F.when(F.col("metric").isin(*lower_is_better), -1.0).otherwise(1.0) if lower_is_better else F.lit(1.0)
    moved = movable(pairs, least).select("metric", F.struct("qid", (sign * (F.col("b") - F.col("a"))).alias("gain")).alias("m"))
    whole = moved.groupBy("metric").agg(F.sort_array(F.collect_list("m")).alias("m")).where("size(m) > 1")
    work = whole.select("metric", F.col("m.gain").alias("gains"), F.col("m.qid").alias("qids"))
    kind = pairs.schema["qid"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        (metric, gains, qids), = group.itertuples(index=False)
        return pd.DataFrame({"metric": metric, "dropped": list(qids), "survived": gains_without(np.asarray(gains, float), rounds, alpha, seed)})

    # a group each, so that a task never holds the gains of several metrics at once
    return work.groupBy("metric").applyInPandas(run, f"metric string, dropped {kind}, survived boolean")


def mover_jackknife(pairs: DataFrame, lower_is_better: Sequence[str] = (), least: float = 1e-9, rounds: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Per metric: questions, movers, and whether the gain survives without any one mover; with fewer than two movers it does not."""
    left = movers_left_out(pairs, lower_is_better, least, rounds, alpha, seed).groupBy("metric").agg(F.bool_and("survived").alias("survives"))
    n = pairs.groupBy("metric").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("b") - F.col("a")) > least).alias("n_movers"))
    return n.join(left, "metric", "left").select("metric", "n", "n_movers", F.coalesce("survives", F.lit(False)).alias("survives"))


def mean_gates(baseline: DataFrame, variant: DataFrame, rules: DataFrame) -> DataFrame:
    """(metric, regressed, evaluable, n_missing): absolute gates on means, failing closed.

    A metric regresses if its mean is worse by more than epsilon. Without a common question, or with
    one that the baseline has and the variant lacks, it cannot be evaluated and counts as regressed.
    baseline, variant: (metric, qid, value); rules: (metric, higher_is_better, epsilon).
    """
    both = baseline.select("metric", "qid", F.col("value").alias("a")).join(variant.select("metric", "qid", F.col("value").alias("b")), ["metric", "qid"], "left")
    per = both.groupBy("metric").agg(F.count("*").alias("_n"), F.count_if(F.col("b").isNull()).alias("n_missing"), F.avg(F.when(F.col("b").isNotNull(), F.col("a"))).alias("_a"), F.avg("b").alias("_b"))
    out = rules.join(per, "metric", "left")
    evaluable = F.coalesce(F.col("n_missing") == 0, F.lit(False))
    worse = F.when(F.col("higher_is_better"), F.col("_a") - F.col("_b")).otherwise(F.col("_b") - F.col("_a"))
    return out.select("metric", (~evaluable | F.coalesce(worse > F.col("epsilon"), F.lit(True))).alias("regressed"), evaluable.alias("evaluable"), F.coalesce("n_missing", F.lit(0)).alias("n_missing"))


def paired_gates(comparison: DataFrame, rules: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(metric, regressed): significantly worse, or worse in the mean by more than epsilon; a metric that was not compared regresses.

    comparison: from compare_metrics(); rules: (metric, higher_is_better, epsilon).
    """
    both = rules.join(comparison, "metric", "left")
    bad = F.when(F.col("higher_is_better"), F.col("ci_high") < 0).otherwise(F.col("ci_low") > 0) & (F.col("p") < alpha)
    worse = F.when(F.col("higher_is_better"), F.col("mean_a") - F.col("mean_b")).otherwise(F.col("mean_b") - F.col("mean_a"))
    return both.select("metric", F.coalesce(bad | (worse > F.col("epsilon")), F.lit(True)).alias("regressed"))


def breakdown(precision: DataFrame, intents: DataFrame, judged: DataFrame, served: DataFrame) -> DataFrame:
    """(type, n, precision, under_judged, unscored): means by a question's type, and those served more than was judged or not scored.

    precision: (qid, precision); intents: (qid, type); judged, served: (qid, n).
    """
    both = intents.join(precision, "qid", "left").join(judged.select("qid", F.col("n").alias("_j")), "qid", "left").join(served.select("qid", F.col("n").alias("_s")), "qid", "left")
    return both.groupBy(F.coalesce("type", F.lit("?")).alias("type")).agg(F.count("precision").alias("n"), F.round(F.avg("precision"), 9).alias("precision"), F.count_if(F.coalesce("_s", F.lit(0)) > F.coalesce("_j", F.lit(0))).alias("under_judged"), F.count_if(F.col("precision").isNull()).alias("unscored"))


def gold_problems(gold: DataFrame, known: DataFrame, bands: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """(qid, problem): what is wrong with gold entries, a row for each breach.

    gold: (qid, band, gold_keys, nuggets, relevance: map of key to label); known: (key). Keys must be
    known and distinct, labels of the list, a question stands once; a trap (band empty) has no gold,
    nuggets or directly answering paper, another question has gold, 3 to 7 nuggets, and as its gold
    exactly the directly answering papers.
    """
    keys, nuggets = F.coalesce("gold_keys", F.array().cast("array<string>")), F.coalesce("nuggets", F.array().cast("array<string>"))
    direct = F.map_keys(F.map_filter("relevance", lambda k, v: v == "directly-answering"))
    trap = F.col("band") == "empty"
    tests = {
        "bad band": ~F.coalesce(F.col("band").isin(*bands), F.lit(False)),
        "repeated gold key": F.size(F.array_distinct(keys)) < F.size(keys),
        "bad label": F.exists(F.map_values("relevance"), lambda v: ~v.isin(*labels)),
        "trap with gold": trap & (F.size(keys) > 0),
        "trap with nuggets": trap & (F.size(nuggets) > 0),
        "trap with an answering paper": trap & (F.size(direct) > 0),
        "no gold": ~trap & (F.size(keys) == 0),
        "number of nuggets": ~trap & ~F.size(nuggets).between(3, 7),
        "gold is not the answering papers": ~trap & (F.array_sort(F.array_distinct(keys)) != F.array_sort(direct)),
    }
    own = gold.select("qid", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in tests.items()]))).alias("problem"))
    twice = gold.groupBy("qid").agg(F.count("*").alias("n")).where("n > 1").select("qid", F.lit("repeated question").alias("problem"))
    named = gold.select("qid", F.explode(F.array_distinct(F.concat(keys, F.coalesce(F.map_keys("relevance"), F.array().cast("array<string>"))))).alias("key"))
    strange = named.join(known.select("key").distinct(), "key", "left_anti").select("qid", F.concat(F.lit("unknown key "), "key").alias("problem"))
    return own.unionByName(twice).unionByName(strange).distinct()


def must_find_recall(pools: DataFrame, served: DataFrame, failed: DataFrame) -> DataFrame:
    """(qid, recall, quarantined): the share of a pool's entries that a served row matches by DOI or title.

    Questions that failed or were served nothing are quarantined, without a recall. pools: (qid, want_id,
    title, doi); served: (qid, key, title, doi); failed: (qid).
    """
    from lectern.operators.matching import lenient_match

    wanted = pools.select(F.struct("qid", "want_id").alias("want_id"), "qid", "title", "doi")
    hits = lenient_match(wanted, served.select("qid", F.struct("qid", "key").alias("key"), "title", "doi"), by="qid")
    per = hits.select(F.col("want_id.qid").alias("qid"), "hit").groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))
    there = served.select("qid").distinct().join(failed.select("qid").distinct(), "qid", "left_anti").withColumn("_s", F.lit(True))
    return per.join(there, "qid", "left").select("qid", F.when(F.col("_s"), F.col("recall")).alias("recall"), F.col("_s").isNull().alias("quarantined"))
