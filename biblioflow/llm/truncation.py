"""Text cut off by field limits: right-censored length models per source, combined with ending evidence."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioflow.functions.damage import NOTE, OMITTED, OPEN, WHOLE, class_of, ending_text, ends_in_stop, let
from biblioflow.session import cut_lineage

#: Lengths up to here are counted one by one; longer ones in bins of one percent, so a source's histogram stays bounded.
EXACT_LENGTHS = 20_000
#: Full stops that may not end a sentence (fixed values): after a bare number, an abbreviation or an initial.
STUBS = {
    "stub_number": r"(?:^|[^.0-9])[0-9]{1,3}\.$",
    "stub_word": r"(?:^|[\s(\[])(?:e\.g|i\.e|cf|vs|approx|ca|resp|incl|Figs?|Eqs?|Refs?|Nos?|Dr|Prof|z\.\s?B|d\.\s?h|bzw|vgl|p\.\s?ex|т\.\s?е|напр)\.$",
    "stub_initial": r"(?:^|[\s(\[])[A-Z]\.$",
}
KINDS = (OMITTED, OPEN, *STUBS, WHOLE, NOTE)
#: A length is a candidate limit if this many texts, and this share of the source's suspicious ones, end there openly; so many
#: characters around it count together where a limit is filled up to whole words.
LIMIT_LEAST, LIMIT_SHARE, LIMIT_SPREAD = 3, 0.04, 8
#: Texts of all sources that stand behind a source's own endings, and the share and spread of lengths its log-normal does not explain.
POOLED_WEIGHT, STRAY_SHARE, STRAY_SPREAD = 200.0, 0.1, 4.0
#: Share of complete texts that is expected to end openly or in a mark of omission. It weighs as much as the source's own texts:
#: nothing in lengths and endings alone tells a source that never closes its texts from one that breaks many of them off.
OPEN_COMPLETE = 1e-4
#: Cut texts that the source's usual share of marks of omission counts for, at limits and elsewhere: one mechanism adds them, another does not.
MARK_WEIGHT = 20.0

_CELL_SCHEMA = "_source string, _len int, _kind string, n long, at_limit boolean, posterior double, mu double, sigma double"


def length_bin(c: Column) -> Column:
    """The length itself, or the lower edge of its one-percent bin beyond ``EXACT_LENGTHS``."""
    step = math.log(1.01)
    coarse = F.floor(F.exp(F.floor(F.log(c.cast("double")) / step) * step)).cast("int")
    return F.when(c <= EXACT_LENGTHS, c).otherwise(F.greatest(coarse, F.lit(EXACT_LENGTHS)))


def _tail(a: np.ndarray) -> np.ndarray:
    """Upper tail of the standard normal distribution."""
    return 0.5 * np.array([math.erfc(x / math.sqrt(2)) for x in a])


def censored_step(y: np.ndarray, n_whole: np.ndarray, n_cut: np.ndarray, mu: float, sigma: float) -> tuple[float, float]:
    """One step of expectation maximisation of a log-normal: ``n_whole`` log lengths ``y`` are known, ``n_cut`` are lower bounds."""
    total = n_whole.sum() + n_cut.sum()
    if not total:
        return mu, sigma
    a = (y - mu) / sigma
    hazard = np.exp(-0.5 * a * a) / math.sqrt(2 * math.pi) / np.maximum(_tail(a), 1e-12)
    hazard = np.where(a > 6, a + 1 / np.maximum(a, 1), hazard)
    first = mu + sigma * hazard
    second = mu * mu + 2 * mu * sigma * hazard + sigma * sigma * (1 + a * hazard)
    new_mu = float((y * n_whole).sum() + (first * n_cut).sum()) / total
    spread = float((y * y * n_whole).sum() + (second * n_cut).sum()) / total - new_mu * new_mu
    return new_mu, max(math.sqrt(max(spread, 0.0)), 0.05)


def fit_censored_lognormal(whole: np.ndarray, n_whole: np.ndarray, cut: np.ndarray, n_cut: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Maximum-likelihood ``mu, sigma`` of log lengths; cut lengths are only lower bounds."""
    y = np.log(np.maximum(np.concatenate([whole, cut]), 1))
    known, bound = np.concatenate([n_whole, np.zeros(len(cut))]), np.concatenate([np.zeros(len(whole)), n_cut])
    if not len(y):
        return 0.0, 1.0
    mu = float(np.average(y, weights=known + bound))
    sigma = max(float(np.sqrt(np.average((y - mu) ** 2, weights=known + bound))), 0.05)
    for _ in range(rounds):
        new = censored_step(y, known, bound, mu, sigma)
        done = abs(new[0] - mu) + abs(new[1] - sigma) < 1e-6
        mu, sigma = new
        if done:
            break
    return mu, sigma


def _densities(lens: np.ndarray, mu: float, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Per length, how probable it is for a complete text and for one that broke off at a random place.

    A complete length is log-normal, with a wide log-normal for texts of another kind (short notices, long
    reviews). A break at a random place of a text of length ``x`` is uniform below ``x``.
    """
    x = np.maximum(lens, 1.0)
    y, width = np.log(x), np.where(lens <= EXACT_LENGTHS, 1.0, lens * 0.01)
    normal = lambda s: np.exp(-0.5 * ((y - mu) / s) ** 2) / (x * s * math.sqrt(2 * math.pi))
    whole = (1 - STRAY_SHARE) * normal(sigma) + STRAY_SHARE * normal(STRAY_SPREAD * sigma)
    broken = math.exp(-mu + sigma * sigma / 2) * _tail((y - mu + sigma * sigma) / sigma)
    return whole * width, np.maximum(broken * width, 1e-300)


def _marked(endings: np.ndarray, kind: np.ndarray, cut: np.ndarray, usual: float) -> np.ndarray:
    """``endings`` of cut texts with the share that bears a mark of omission; ``usual``, the source's share, weighs as ``MARK_WEIGHT`` texts."""
    marked = (cut[kind == 0].sum() + MARK_WEIGHT * usual) / (cut.sum() + MARK_WEIGHT)
    return np.concatenate([[marked], (1 - marked) * endings[1:] / endings[1:].sum()])


def fit_source(histogram: pd.DataFrame, cut_endings: np.ndarray, whole_endings: np.ndarray, rounds: int = 40) -> pd.DataFrame:
    """Lengths, limits and endings of one source by expectation maximisation over its ``(_len, _kind, n)`` cells.

    Every cell is complete or cut. The prior odds of a cut are the source's rate of breaks, weighed by how
    probable the length is for a broken and for a complete text, and at a candidate limit besides what the
    length model does not expect there against what it expects. The ending then counts by its likelihood among cut texts
    (``cut_endings``: what the source's own whole texts show when they are cut inside a sentence) and among
    complete ones. Expected counts of each round refit lengths (cut ones as lower bounds), rate and endings.
    """
    lens, inverse = np.unique(histogram["_len"].to_numpy(np.int64), return_inverse=True)
    kind = np.array([KINDS.index(k) for k in histogram["_kind"]])
    n = histogram["n"].to_numpy(float)
    per_len = lambda w: np.bincount(inverse, weights=w, minlength=len(lens))
    first, last = np.searchsorted(lens, lens - LIMIT_SPREAD), np.searchsorted(lens, lens + LIMIT_SPREAD, side="right")
    near = lambda w: (sums := np.concatenate([[0.0], np.cumsum(w)]))[last] - sums[first]
    suspicious = n * np.isin(kind, (0, 1))
    marks = (suspicious[kind == 0].sum() + 0.5) / (suspicious.sum() + 1)
    bad, total, y = per_len(suspicious), per_len(n), np.log(np.maximum(lens, 1))
    pooled_whole = POOLED_WEIGHT * whole_endings / whole_endings.sum()
    ending_cut, ending_whole = np.stack([_marked(cut_endings, kind, suspicious, marks)] * 2), whole_endings / whole_endings.sum()
    mu, sigma = fit_censored_lognormal(lens.astype(float), total - bad, lens.astype(float), bad)
    rate = (bad.sum() + 0.5) / (n.sum() + 10)
    cut = suspicious / n
    at_limit = np.zeros(len(lens), bool)
    for _ in range(rounds):
        f, r = _densities(lens.astype(float), mu, sigma)
        expected = max((n * (1 - cut)).sum(), 1.0) * f
        least = max(LIMIT_LEAST, LIMIT_SHARE * bad.sum())
        exact = (bad >= least) & (bad > 3 * expected)
        others = ~exact * near(bad * ~exact)
        breaks = near(n.sum() * rate * r)
        blurred = (bad > 0) & (others >= 2 * least) & (others > 3 * breaks + 5 * np.sqrt(breaks))
        at_limit = exact | blurred
        odds = rate / (1 - rate) * r / np.maximum(f, 1e-300)
        for here, seen, usual in ((blurred, near(total * ~exact), near(expected * ~exact)), (exact, total, expected)):
            odds = odds + here * (np.maximum(seen - usual, 0) + 0.5) / (usual + 0.5)
        logit = np.log(odds)[inverse] + np.log(ending_cut[at_limit[inverse].astype(int), kind]) - np.log(ending_whole[kind])
        new = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        moved = float(np.abs((new - cut) * n).sum())
        cut = new
        elsewhere = n * ~at_limit[inverse]
        rate = float(np.clip(((elsewhere * cut).sum() + 0.5) / (elsewhere.sum() + 10), 1e-6, 1 - 1e-6))
        ending_cut = np.stack([_marked(cut_endings, kind, n * cut * (at_limit[inverse] == here), marks) for here in (False, True)])
        complete = np.bincount(kind, weights=n * (1 - cut), minlength=len(KINDS))
        ending_whole = (complete + pooled_whole) / (complete + pooled_whole).sum()
        ending_whole[:2] = (ending_whole[:2] + OPEN_COMPLETE / 2) / 2
        ending_whole /= ending_whole.sum()
        mu, sigma = censored_step(y, per_len(n * (1 - cut)), per_len(n * cut), mu, sigma)
        if moved < 1e-3:
            break
    return histogram.assign(at_limit=at_limit[inverse], posterior=cut, mu=mu, sigma=sigma)


def _stub_or(kind: Column, t: Column) -> Column:
    for name, pattern in reversed(STUBS.items()):
        kind = F.when(F.substring(t, -12, 12).rlike(pattern), F.lit(name)).otherwise(kind)
    return kind


def _trial(c: Column, place: Column) -> Column:
    """The kind of ending a text would have if it were cut at ``place``; NULL where that is the end of a sentence."""
    window = F.substr(c, F.greatest(place - 39, F.lit(1)), F.least(place, F.lit(40)) + 3)
    before, after = F.substr(window, F.lit(1), F.least(place, F.lit(40))), F.substr(window, F.least(place, F.lit(40)) + 1, F.lit(3))
    sentence_end = after.rlike(r"^(?:\s+[\p{Lu}\p{Lo}\p{N}<(\[«\"'“]|\p{Lo}|\s*$)")
    return F.when(~ends_in_stop(before), F.lit(OPEN)).when(~sentence_end, _stub_or(F.lit(WHOLE), before))


def observed_endings(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``(_key, _source, _len, _kind, _trial)`` of each text: its length, its ending, and the ending it would have if cut elsewhere.

    The trial cut is at a place that the hash of the text gives, in texts that end whole. Texts are read
    once; what is written for the two uses is as narrow as this.
    """
    c = F.col(text)
    place = 10 + F.pmod(F.xxhash64(c), F.greatest(F.length(c) - 20, F.lit(1))).cast("int")
    trial = lambda ending: F.when((ending == WHOLE) & (F.length(c) > 40), _trial(c, place))
    judged = let(ending_text(c), lambda t: let(class_of(t, c), lambda e: F.struct(F.when(e == WHOLE, _stub_or(e, t)).otherwise(e).alias("_kind"), trial(e).alias("_trial"))))
    seen = df.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.length(c).alias("_raw_len"), F.when(c.isNotNull(), judged).alias("_e"))
    narrow = cut_lineage(seen.select("_key", "_source", length_bin(F.col("_raw_len")).alias("_len"), "_e._kind", "_e._trial"))
    return narrow.where(F.col("_kind").isNotNull())


def scored_cells(observed: DataFrame) -> DataFrame:
    """One row per source, length and kind of ending: its texts, whether the length is a limit, and the posterior of a cut.

    Texts are counted into cells before anything reaches Python, so the input of a fit is bounded by the
    number of distinct lengths, whatever a source's share of the rows is. What reaches the driver is one
    count per kind of ending.
    """
    trials = F.count_if
    cells = observed.groupBy("_source", "_len", "_kind").agg(F.count(F.lit(1)).alias("n"), *[trials(F.col("_trial") == k).alias(f"_t_{k}") for k in (OPEN, *STUBS, WHOLE)])
    pooled = observed.agg(*[F.count_if(F.col("_kind") == k).alias(f"_k_{k}") for k in KINDS], *[trials(F.col("_trial") == k).alias(f"_t_{k}") for k in (OPEN, *STUBS, WHOLE)]).first()
    tried = np.array([pooled[f"_t_{k}"] if f"_t_{k}" in pooled else 0 for k in KINDS], float)
    tried = (tried + 0.1) / (tried + 0.1).sum()
    whole = np.array([pooled[f"_k_{k}"] for k in KINDS], float)
    whole = (whole + 0.1) / (whole + 0.1)[2:].sum()
    whole[:2] = OPEN_COMPLETE / 2

    def fit(histogram: pd.DataFrame) -> pd.DataFrame:
        own = np.array([histogram[f"_t_{k}"].sum() if f"_t_{k}" in histogram else 0 for k in KINDS], float) + POOLED_WEIGHT * tried
        fitted = fit_source(histogram, own / own.sum(), whole)
        return fitted[[c.split()[0] for c in _CELL_SCHEMA.split(", ")]]

    return cells.groupBy("_source").applyInPandas(fit, _CELL_SCHEMA)


def score_truncation(df: DataFrame, key: str = "paper_id", text: str = "abstract", source: str = "source") -> DataFrame:
    """``(key, source, ending, at_limit, posterior)`` for every row with text: the probability that it was cut inside a sentence.

    NULL and blank texts have no row; a NULL source is a source of its own; equal texts of one source have
    equal posteriors; other columns of ``df`` are ignored.
    """
    observed = observed_endings(df, key, text, source)
    return _joined(observed, scored_cells(observed), "left").select(F.col("_key").alias(key), F.col("_source").alias("source"), F.col("_kind").alias("ending"), "at_limit", "posterior")


def _joined(observed: DataFrame, cells: DataFrame, how: str) -> DataFrame:
    named = cells.select(F.col("_source").alias("_s"), F.col("_len").alias("_l"), F.col("_kind").alias("_k"), "at_limit", "posterior")
    return observed.join(named, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_len") == F.col("_l")) & (F.col("_kind") == F.col("_k")), how)


def truncated(df: DataFrame, key: str = "paper_id", text: str = "abstract", source: str = "source") -> DataFrame:
    """``(key)`` of the rows whose text was more probably cut inside a sentence than not."""
    observed = observed_endings(df, key, text, source)
    cut = scored_cells(observed).where(F.col("posterior") > 0.5)
    return _joined(observed, cut, "left_semi").select(F.col("_key").alias(key))


def truncation_report(df: DataFrame, key: str = "paper_id", text: str = "abstract", source: str = "source") -> DataFrame:
    """How often each source truncates: texts, cut texts, their share, and the limits its length model shows."""
    cells = scored_cells(observed_endings(df, key, text, source))
    is_cut = F.col("posterior") > 0.5
    limits = F.array_sort(F.collect_set(F.when(F.col("at_limit"), F.col("_len"))))
    counts = cells.groupBy(F.col("_source").alias("source")).agg(
        F.sum("n").alias("texts"), F.coalesce(F.sum(F.when(is_cut, F.col("n"))), F.lit(0)).alias("cut"), F.coalesce(F.sum(F.when(is_cut & F.col("at_limit"), F.col("n"))), F.lit(0)).alias("cut_at_limit"),
        F.round(F.max("mu"), 4).alias("mu"), F.round(F.max("sigma"), 4).alias("sigma"), F.array_join(F.transform(limits, lambda x: x.cast("string")), ",").alias("limits"),
    )
    return counts.select("source", "texts", "cut", "cut_at_limit", "mu", "sigma", "limits", F.round(F.col("cut") / F.col("texts"), 6).alias("cut_share"))
