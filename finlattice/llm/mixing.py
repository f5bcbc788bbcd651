"""Mixing sources to target weights by entropy balancing.

Document rates are the tilt exp(lambda of the source + beta of the size band), at most `most_copies`,
of the token distribution nearest to the corpus in relative entropy under two kinds of token
constraints: each source's taken words equal its target, and each band of document sizes (octaves
of words) keeps its share of the corpus's words.  The second kind overlaps the first and may clash
with it (a source may hold short documents only), so it is soft: beta is penalised by `slack`.

The convex dual is solved by Newton's method.  For given betas the sources' lambdas have a closed
form, as a source's words are piecewise linear in exp(lambda); so the iteration runs over the betas
alone, on the profile of the dual.  Each step is one distributed pass over the table of sources
(a row of band totals each, pre-aggregated from the documents): every task solves its sources and
adds up its part of value, gradient and Hessian, from which the other unknowns are eliminated.
What reaches the driver is a BANDS x BANDS sum, whatever the number of sources and documents.
Sources whose target is all of their copies are at the bound and leave the bands their rest.

solve_dual() is for any other constraints that overlap; there the whole Hessian is k x k.

Rates are rounded into whole copies without losing the token targets: sizes are binned (exact up
to EXACT_BINS words, then 64 bins an octave, so a source has a few thousand bins however large it
is), copies are dealt to a source's bins from the largest size down, each bin taking on the
rounding error so far, and within a bin the documents with the smallest hashes get the extra copy.
Bins are split by hash into buckets of about BUCKET_ROWS rows, so no task holds a hot source.

Defined results: null or empty texts have size 0 and are never a remainder; a source with no
words has target 0; sources are ranked by code point, null last; repeated rows count separately;
an empty table gives an empty mix.  Nothing is random: reruns agree.  Other columns are ignored by
mix() and kept by resample(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, unused

WORD = r"[^\x20\x09-\x0D]+"
EXACT_BINS = 1024
BUCKET_ROWS = 1000
#: Octaves of document sizes; a text has fewer than 2^31 words.
BANDS = 32
SLACK = 0.05
#: The dual of other overlapping constraints is solved on the driver, k x k; more constraints than this are refused.
MOST_CONSTRAINTS = 2000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sizes: list[int], weights: list[float], most_copies: float) -> list[float]:
    """Shares of the sizes' sum by weight, none above most_copies times its size; the excess goes to the others.

    source_targets() does the same for a table of sources.
    """
    total, targets = float(sum(sizes)), [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s > 0], total
    while open_:
        share = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if share * weights[i] > most_copies * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = share * weights[i]
            break
        for i in full:
            targets[i] = float(most_copies * sizes[i])
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def capped_share(sources: DataFrame, weights: tuple[float, ...], most_copies: int) -> float:
    """Words for a unit of weight, when sources (size, k: its weight's place) that this would take beyond most_copies stay there.

    Each round is an aggregation to a row a weight, of whole numbers only; shares grow, so what is
    at its cap stays there and the rounds end.
    """
    share, before = 0.0, -1
    w = F.array(*[F.lit(float(x)) for x in weights])[F.col("k")]
    while True:
        full = F.lit(share) * w > F.col("source_size") * most_copies
        sums = sources.where("source_size > 0").groupBy("k").agg(F.count_if(full).alias("full"), F.count_if(~full).alias("open"), F.sum("source_size").alias("size"), F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("held")).collect()
        now = sum(r["full"] for r in sums)
        if now == before or not any(r["open"] for r in sums):
            return share
        left = float(sum(r["size"] for r in sums) - most_copies * sum(r["held"] for r in sums))
        share, before = max(share, left / sum(weights[r["k"]] * r["open"] for r in sorted(sums))), now


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most_copies: int) -> DataFrame:
    """(source, source_size, target, full) of sizes (source, size); weights go round the sources by rank, null last.

    full: the target is all that most_copies allow.

    Ranks come in two levels: ranges of sources, and places in a range.
    """
    order = [F.col("source").isNull(), F.col("source")]
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = materialise(totals.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    first, begins = 0, []
    for r in sorted(ranges.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row a range
        begins += [F.lit(r.part), F.lit(first)]
        first += r.n
    begin = F.create_map(*begins)[F.col("part")] if begins else F.lit(0)
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + begin
    sources = materialise(ranges.select("source", "source_size", F.pmod(place, F.lit(len(weights))).cast("int").alias("k")), "mix-sources")
    share = capped_share(sources, weights, most_copies)
    wanted = F.lit(share) * F.array(*[F.lit(float(x)) for x in weights])[F.col("k")]
    target = F.when(F.col("source_size") > 0, F.least(wanted, (F.col("source_size") * most_copies).cast("double"))).otherwise(0.0)
    return sources.select("source", "source_size", target.alias("target"), (wanted >= F.col("source_size") * most_copies).alias("full"))


def solve_dual(cells: DataFrame, targets: list[float], tolerance: float = 1e-10, most_iterations: int = 60) -> np.ndarray:
    """lambda for cells (mass double, members array<int>: the constraints that hold for the cell).

    Every iteration sends sums over constraints and pairs of constraints to the driver: as many
    numbers as there are constraints and pairs of them in a cell, whatever the number of rows.
    """
    k = len(targets)
    if k > MOST_CONSTRAINTS:
        raise ValueError(f"{k} constraints; at most {MOST_CONSTRAINTS} are supported")
    t = np.asarray(targets)
    live = t > 0
    lam, step, last = np.zeros(k), np.zeros(k), np.inf
    pairs = F.explode(F.flatten(F.transform("members", lambda i: F.transform("members", lambda j: F.struct(i.alias("i"), j.alias("j"))))))

    for _ in range(most_iterations):
        multipliers = F.array(*[F.lit(float(x)) for x in lam])
        tilt = F.exp(F.aggregate("members", F.lit(0.0), lambda s, i: s + multipliers[i]))
        sums = cells.select((F.col("mass") * tilt).alias("m"), pairs.alias("p")).groupBy("p.i", "p.j").agg(F.sum("m").alias("m")).collect()
        hessian = np.zeros((k, k))
        for i, j, m in sums:
            hessian[i, j] = m
        gradient = np.where(live, hessian.diagonal() - t, 0.0)  # a constraint's own mass is its diagonal entry
        error = np.abs(gradient).max(initial=0.0) / max(t.max(initial=0.0), 1.0)
        if error < tolerance:
            break
        if error > last:  # overshot: go back half of the step
            step /= 2
            lam = lam - step
            continue
        last = error
        step = np.zeros(k)
        step[live] = -np.linalg.lstsq(hessian[np.ix_(live, live)], gradient[live], rcond=None)[0]
        step = np.clip(step, -4, 4)
        lam = lam + step
    return lam


def source_rates(mass: np.ndarray, target: np.ndarray, full: np.ndarray, beta: np.ndarray, cap: float) -> np.ndarray:
    """sources x bands: the rates min(cap, exp(lambda + beta)) that meet each source's target exactly.

    mass: words of each source in each band.  From the band of the largest beta on, bands reach
    the cap; the first number of capped bands that leaves the others room is the right one.
    """
    order = np.argsort(-beta, kind="stable")
    w, m = np.exp(beta[order]), mass[:, order]
    rest = np.cumsum((m * w)[:, ::-1], axis=1)[:, ::-1]  # of band k and those after it
    capped = np.cumsum(m, axis=1) - m  # words of the bands before k
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(rest > 0, (target[:, None] - cap * capped) / rest, np.inf)
    fits = a * w[None] <= cap * (1 + 1e-12)
    k = np.where(fits.any(axis=1), fits.argmax(axis=1), len(w) - 1)
    scale = a[np.arange(len(mass)), k]
    rates = np.empty_like(mass)
    rates[:, order] = np.minimum(cap, np.maximum(scale, 0)[:, None] * w[None])
    rates[full] = cap
    rates[target <= 0] = 0
    return rates


SOURCES = "source string, source_size long, target double, full boolean, mass array<double>"


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mass = batch.column(4).flatten().to_numpy().reshape(-1, BANDS)
    return mass, batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)


def _profile(beta: np.ndarray, cap: float):
    """Sources to their part of the profile's value, gradient and Hessian: (i, j, v); j is -1 for the gradient, -2 for the value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, gradient, hessian = 0.0, np.zeros(BANDS), np.zeros((BANDS, BANDS))
        for batch in batches:
            mass, target, full = _arrays(batch)
            rates = source_rates(mass, target, full, beta, cap)
            words = mass * rates
            gradient += words.sum(axis=0)
            live = (target > 0) & ~full
            r, m, t = rates[live], mass[live], target[live]
            free = r < cap * (1 - 1e-12)
            with np.errstate(divide="ignore", invalid="ignore"):
                u = np.where(r > 0, np.log(r), 0.0)  # lambda + beta of a free band
                lam = np.where(free.any(axis=1), np.nanmax(np.where(free, u - beta[None], -np.inf), axis=1), 0.0)
            above = lam[:, None] + beta[None] - np.log(cap)
            value += (m * np.where(free, r, cap * (1 + np.maximum(above, 0)))).sum() - (lam * t).sum()
            h = m * r * free
            hessian += np.diag(h.sum(axis=0)) - (h / np.maximum(h.sum(axis=1, keepdims=True), 1e-300)).T @ h
            value += cap * (mass[full] @ beta).sum()  # at the bound the words don't depend on beta
        i, j = np.nonzero(hessian)
        rows = [*zip(i.tolist(), j.tolist(), hessian[i, j].tolist(), strict=True), *((k, -1, float(g)) for k, g in enumerate(gradient)), (0, -2, value)]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], kind) for c, kind in enumerate((pa.int32(), pa.int32(), pa.float64()))], ["i", "j", "v"])

    return run


def balance(sources: DataFrame, most_copies: int, slack: float = SLACK, tolerance: float = 1e-9, most_iterations: int = 50) -> np.ndarray:
    """The betas of the size bands for sources (SOURCES): Newton's method on the profile of the dual."""
    sums = sources.select(F.posexplode("mass").alias("band", "m"), F.lit(0.0).alias("t")).groupBy("band").agg(F.sum("m").alias("m")).collect()
    shares, all_ = np.zeros(BANDS), sources.agg(F.sum("target")).first()[0] or 0.0
    for band, m in sums:
        shares[band] = m
    if not shares.sum() or not all_:
        return np.zeros(BANDS)
    wanted = shares / shares.sum() * all_
    there = shares > 0

    def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        parts = sources.mapInArrow(_profile(beta, float(most_copies)), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # BANDS * (BANDS + 1) + 1 rows at most
        value, gradient, hessian = 0.0, np.zeros(BANDS), np.zeros((BANDS, BANDS))
        for i, j, v in parts:
            if j == -2:
                value = v
            elif j == -1:
                gradient[i] = v
            else:
                hessian[i, j] = v
        return value - wanted @ beta + slack / 2 * (wanted @ beta**2), gradient - wanted + slack * wanted * beta, hessian + slack * np.diag(wanted)

    beta = np.zeros(BANDS)
    value, gradient, hessian = at(beta)
    for _ in range(most_iterations):
        if np.abs(gradient[there]).max() <= tolerance * all_:
            break
        step = np.zeros(BANDS)
        step[there] = -np.linalg.solve(hessian[np.ix_(there, there)], gradient[there])
        step *= min(1.0, 3.0 / max(np.abs(step).max(), 1e-300))
        for _ in range(30):  # until the dual falls
            new = at(beta + step)
            if new[0] <= value + 1e-4 * gradient @ step + 1e-12 * abs(value):
                break
            step = step / 2
        beta, (value, gradient, hessian) = beta + step, new
    return np.round(beta, 9)  # sums of floats may differ in their last digits between runs


def _rate_rows(beta: np.ndarray, cap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mass, target, full = _arrays(batch)
            rates = source_rates(mass, target, full, beta, cap)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rates) + 1) * BANDS, pa.int32()), pa.array(rates.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], ["s", "source_size", "target", "rates"])

    return run


def band_of(bin_: Column) -> Column:
    return F.when(bin_ <= EXACT_BINS, F.floor(F.log2(F.greatest(bin_, F.lit(1))))).otherwise(10 + F.floor((bin_ - EXACT_BINS - 1) / 64)).cast("int")


def _deal(bins: pd.DataFrame) -> pd.DataFrame:
    """Copies for one source's bins, from the largest size down, with the error carried on."""
    bins = bins.sort_values("bin", ascending=False)
    carry, extra = 0.0, []
    for n, words, rate in zip(bins.n, bins.words, bins.rate, strict=True):
        base = np.floor(rate + 1e-9)
        wanted = max(rate - base, 0.0) * words + carry
        k = int(np.clip(np.floor(wanted * n / words + 0.5), 0, n)) if words and rate - base > 1e-9 else 0
        carry = wanted - k * words / n
        extra.append(k)
    return bins.assign(base=np.floor(bins.rate + 1e-9).astype("int32"), extra=extra)[["source", "bin", "n", "base", "extra", "source_size", "target", "rate"]]


def size_bin(size: Column) -> Column:
    octave = F.floor(F.log2(F.greatest(size, F.lit(1)) / EXACT_BINS) * 64)
    return F.when(size <= EXACT_BINS, size).otherwise(EXACT_BINS + 1 + octave).cast("int")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most_copies: int = 3, id_: str = "doc_id", text: str = "text", source: str = "source", slack: float = SLACK) -> DataFrame:
    """(id, fp, source, size, source_size, target, rate, copies) for each row of docs; fp is a fingerprint of the text."""
    sizes = docs.select(F.col(id_).alias("id"), F.xxhash64(text).alias("fp"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")).withColumn("bin", size_bin(F.col("size")))
    sizes = materialise(sizes.withColumn("band", band_of(F.col("bin"))), "mix-sizes")
    bands = sizes.groupBy("source", "band").agg(F.sum("size").alias("m"))
    mass = bands.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("band", F.col("m").cast("double")))).alias("m"))  # at most BANDS entries
    filled = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0)))
    targets = source_targets(sizes, weights, most_copies).withColumnRenamed("source", "s")
    plan = mass.join(targets, F.col("source").eqNullSafe(F.col("s"))).select("source", "source_size", "target", "full", filled.alias("mass"))
    plan = materialise(plan, "mix-plan")
    beta = balance(plan, most_copies, slack)
    rates = plan.mapInArrow(_rate_rows(beta, float(most_copies)), "s string, source_size long, target double, rates array<double>")

    bins = sizes.groupBy("source", "bin", "band").agg(F.count("*").alias("n"), F.sum("size").cast("double").alias("words"))
    bins = bins.join(rates, F.col("source").eqNullSafe(F.col("s"))).select("source", "bin", "n", "words", "source_size", "target", F.element_at("rates", F.col("band") + 1).alias("rate"))
    dealt = materialise(bins.groupBy("source").applyInPandas(_deal, "source string, bin int, n long, base int, extra long, source_size long, target double, rate double"), "mix-bins")

    hash_ = F.xxhash64("id", "fp")
    rows = sizes.join(dealt.withColumnRenamed("source", "s").withColumnRenamed("bin", "b"), F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))).drop("s", "b")
    rows = rows.withColumn("bucket", F.pmod(hash_, F.ceil(F.col("n") / BUCKET_ROWS)))
    bucket = Window.partitionBy("source", "bin", "bucket")
    rank = F.row_number().over(bucket.orderBy(F.xxhash64("id", "fp", F.lit("rank")), "id", "fp"))
    shift = F.when(F.col("n") <= BUCKET_ROWS, 0.0).otherwise(F.pmod(F.xxhash64("source", "bin", "bucket"), F.lit(1 << 20)) / float(1 << 20))
    quota = F.floor(F.col("extra") * F.count("*").over(bucket) / F.col("n") + shift + 1e-9)
    rows = rows.withColumn("copies", (F.col("base") + (rank <= quota).cast("int")).cast("int"))
    return rows.select("id", "fp", "source", "size", "source_size", "target", "rate", "copies")


def resample(docs: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """docs with each row repeated as often as the mix takes it, columns unchanged.

    Rows that share id, source and text get all of their copies together, dealt in turn.
    """
    own = unused(docs, "_mix")
    copies = mix(docs, id_=id_, text=text, source=source, **how).groupBy("id", "source", "fp").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    copies = copies.where("copies > 0").select(*[F.col(c).alias(f"{own}_{c}") for c in copies.columns])
    on = F.col(id_).eqNullSafe(F.col(f"{own}_id")) & F.col(source).eqNullSafe(F.col(f"{own}_source")) & (F.xxhash64(text) == F.col(f"{own}_fp"))
    found = materialise(docs.join(copies, on), "mix-taken") if not copies.where(f"{own}_rows > 1").isEmpty() else docs.join(copies, on)
    one = found.where(f"{own}_rows = 1").withColumn(f"{own}_own", F.col(f"{own}_copies"))
    turn = F.row_number().over(Window.partitionBy(f"{own}_id", f"{own}_source", f"{own}_fp").orderBy(f"{own}_id"))
    several = found.where(f"{own}_rows > 1").withColumn(f"{own}_own", F.floor(F.col(f"{own}_copies") / F.col(f"{own}_rows")) + (turn <= F.col(f"{own}_copies") % F.col(f"{own}_rows")).cast("int"))
    taken = one.unionByName(several).where(f"{own}_own > 0")
    return taken.withColumn(f"{own}_n", F.explode(F.sequence(F.lit(1), F.col(f"{own}_own").cast("int")))).select(*docs.columns)
