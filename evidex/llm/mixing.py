"""Mixing sources to target weights by soft membership.

A classifier learned from labelled rows (multinomial naive Bayes over frequent
words) gives every document a posterior over the domains.  Nonnegative document
rates are then fitted, so that each domain's expected tokens (tokens times
posterior times rate, summed) meet its target: least squares by projected
gradient, every step one distributed sum of as many numbers as there are
domains.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

#: Bounds of the classifier: labelled rows of each domain, whose whole texts are counted where they lie, and words (broadcast);
#: more domains than MOST_DOMAINS are refused, as every domain is a column.
MOST_DOMAINS, SAMPLE_ROWS, FEATURES = 256, 1000, 4096
SALTS = 64  # a domain's rows are ranked in so many parts first
KAPPA = 24.0  # a longer text's evidence is scaled down to so many words, which keeps mixed texts' posteriors soft
STEPS, FOLD, TOLERANCE, STALLED = 200, 10, 1e-4, 0.05  # at most, steps folded into one table, error and relative gain that end the fit
BLANK = r"[\x20\x09-\x0D]+"
MARK = "\u0000"  # stands once in every document's words, so that none is lost


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def classifier(labelled: DataFrame, id_col: str, text_col: str, domain_col: str, among: DataFrame | None = None) -> tuple[list[str], list[float], DataFrame | None]:
    """Domains (by name), their log shares, and a table of words with their log probability under each domain."""
    rows = labelled.where(F.col(domain_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(domain_col).cast("string").alias("_d"))
    # ids first: a join by id then shuffles no text
    ids = rows.select("_id", "_d")
    if among is not None:
        ids = ids.join(among.select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi")
    found = ids.groupBy("_d").count().orderBy("_d").limit(MOST_DOMAINS + 1).collect()
    if len(found) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    domains = [r[0] for r in found]
    if not domains:
        return [], [], None
    total, size = sum(r[1] for r in found), {r[0]: r[1] for r in found}
    chosen = ids.withColumn("_h", F.xxhash64(F.col("_id").cast("string"))).withColumn("_salt", F.pmod("_h", F.lit(SALTS)))
    for by in (("_d", "_salt"), ("_d",)):
        chosen = chosen.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h", "_id"))).where(F.col("_r") <= SAMPLE_ROWS)
    chosen = written(chosen.select("_id", "_d").distinct(), "mix-sample")
    sample = rows.join(F.broadcast(chosen), ["_id", "_d"], "left_semi")
    counts = sample.select("_d", F.explode(words_of(F.lower("_text"))).alias("_w")).groupBy("_w").agg(*[F.sum(F.when(F.col("_d") == d, 1.0).otherwise(0.0)).alias(f"c{k}") for k, d in enumerate(domains)])
    often = written(counts.orderBy(F.desc(sum((F.col(f"c{k}") for k in range(len(domains))), F.lit(0.0))), "_w").limit(FEATURES), "mix-words")
    sums = often.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0.0)) for k in range(len(domains))]).first()
    words = often.select("_w", *[F.log((F.col(f"c{k}") + 0.5) / F.lit(sums[k] + 0.5 * FEATURES)).alias(f"l{k}") for k in range(len(domains))])
    mark = labelled.sparkSession.range(1).select(F.lit(MARK).alias("_w"), *[F.lit(0.0).alias(f"l{k}") for k in range(len(domains))])
    return domains, [math.log(size[d] / total) for d in domains], words.unionAll(mark)


def posteriors(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, domain_col: str, among: DataFrame | None = None) -> tuple[list[str], DataFrame]:
    """Domains, and for every row of docs _id, _n (tokens) and p0, p1, ... (posteriors)."""
    domains, prior, words = classifier(labelled, id_col, text_col, domain_col, among)
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), BLANK).alias("_s"))
    ends = (F.get("_s", F.lit(0)) == "").cast("bigint") + ((F.size("_s") > 1) & (F.element_at("_s", -1) == "")).cast("bigint")
    sized = rows.select("_row", "_id", (F.size("_s") - ends).cast("bigint").alias("_n"), "_s")
    if not domains:
        return [], sized.select("_id", "_n")
    each = sized.select("_row", "_id", "_n", F.explode(F.concat("_s", F.array(F.lit(MARK)))).alias("_w")).join(F.broadcast(words), "_w")
    sums = each.groupBy("_row").agg(F.first("_id").alias("_id"), F.first("_n").alias("_n"), F.count("*").alias("_hits"), *[F.sum(f"l{k}").alias(f"s{k}") for k in range(len(domains))])
    scale = F.least(F.lit(1.0), F.lit(KAPPA) / F.greatest(F.col("_hits") - 1, F.lit(1)))
    logit = sums.select("_id", "_n", *[(F.col(f"s{k}") * scale + prior[k]).alias(f"z{k}") for k in range(len(domains))])
    zs = [F.col(f"z{k}") for k in range(len(domains))]
    top = F.greatest(*zs) if len(zs) > 1 else zs[0]
    powers = logit.select("_id", "_n", *[F.exp(z - top).alias(f"e{k}") for k, z in enumerate(zs)])
    total = sum((F.col(f"e{k}") for k in range(1, len(domains))), F.col("e0"))
    return domains, powers.select("_id", "_n", *[(F.col(f"e{k}") / total).alias(f"p{k}") for k in range(len(domains))])


def _stepped(rate: Column, steps: list[list[float]], k: int, low: float) -> Column:
    """The rate after further gradient steps, each projected to at least `low`."""
    if not steps:
        return rate
    past = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in steps])
    return F.aggregate(past, rate, lambda r, g: F.greatest(F.lit(low), r - sum((g[i] * F.col(f"p{i}") for i in range(1, k)), g[0] * F.col("p0"))))


def mix_to_targets(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | float = 0.0, budget: float | None = None, min_rate: float = 0.0, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", among: DataFrame | None = None) -> DataFrame:
    """id_col, n_tokens, domain, confidence, rate and copies of every row of docs.

    labelled: rows with a text and its domain; `among`: a table of ids, to learn from
    its rows only.  weights: target share of each domain, or a power of the domains' expected shares
    (0: all alike, 1: as they are).  budget: tokens wanted in all; by default as many
    as there are, or with min_rate > 0 as few as let every domain keep min_rate of its
    own.  A named domain that nothing belongs to is left out, one without a weight
    gets 0.  rate >= min_rate: expected number of copies; `copies` rounds it up or
    down by a hash of the id, with the fraction as probability.

    A null or empty text has 0 tokens, the prior as posterior, and a rate like any
    text of that posterior; a very long one counts whole.  Null ids and ids that repeat
    are rows like others.  Without labelled rows rate is 1 everywhere and domain
    null.  Repeated rows count one by one; extra columns have no effect; an empty
    table gives an empty result.  Targets that no rates reach are met as nearly as
    least squares can.
    """
    domains, soft = posteriors(docs, labelled, id_col, text_col, domain_col, among)
    k = len(domains)
    key = F.col("_id").cast("string")
    if not k:
        return soft.select(F.col("_id").alias(id_col), F.col("_n").alias("n_tokens"), F.lit(None).cast("string").alias("domain"), F.lit(0.0).alias("confidence"), F.lit(1.0).alias("rate"), F.lit(1).cast("bigint").alias("copies"))
    soft = written(soft.withColumn("r", F.lit(max(1.0, min_rate))), "mix-soft")

    def totals(rate: Column) -> list[float]:
        row = soft.select("_n", *[f"p{i}" for i in range(k)], rate.alias("_r")).agg(*[F.coalesce(F.sum(F.col("_n") * F.col(f"p{i}") * F.col("_r")), F.lit(0.0)) for i in range(k)]).first()
        return [float(x) for x in row]

    have = totals(F.lit(1.0))
    everything = sum(have)
    if isinstance(weights, dict):
        share = [max(0.0, float(weights.get(d, 0.0))) if h > 0 else 0.0 for d, h in zip(domains, have, strict=True)]
    else:
        share = [(h / everything) ** weights if h > 0 else 0.0 for h in have]
    share = [s / sum(share) for s in share] if sum(share) > 0 else [0.0] * k
    if budget is None:
        budget = everything if min_rate <= 0 else max([min_rate * h / s for h, s in zip(have, share, strict=True) if s > 0], default=everything)
    target = [budget * s for s in share]
    # Squared errors weigh by 1 / tokens of the domain, rates by their tokens: then no step longer than 1 overshoots
    weigh = [1 / h if h > 0 else 0.0 for h in have]
    steps: list[list[float]] = []
    last = math.inf
    for at in range(STEPS):
        error = [t - w for t, w in zip(totals(_stepped(F.col("r"), steps, k, min_rate)), target, strict=True)]
        loss = sum(w * e * e for w, e in zip(weigh, error, strict=True))
        if max((abs(e) for e in error), default=0.0) <= TOLERANCE * max(budget, 1.0) or last - loss <= STALLED * loss:
            break  # met, or as near as rates of at least min_rate come
        last = loss
        steps.append([w * e for w, e in zip(weigh, error, strict=True)])
        if len(steps) == FOLD:
            then = written(soft.withColumn("r", _stepped(F.col("r"), steps, k, min_rate)), "mix-soft")
            dropped(soft)
            soft, steps = then, []
    else:
        raise RuntimeError(f"rates not settled after {STEPS} steps")
    rate = _stepped(F.col("r"), steps, k, min_rate)
    best = F.greatest(*[F.col(f"p{i}") for i in range(k)]) if k > 1 else F.col("p0")
    name = F.coalesce(*[F.when(F.col(f"p{i}") == best, F.lit(d)) for i, d in enumerate(domains)])
    uniform = F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = soft.select("_id", "_n", name.alias("domain"), best.alias("confidence"), rate.alias("rate"))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_tokens"), "domain", "confidence", "rate", (F.floor("rate") + (uniform < F.col("rate") - F.floor("rate")).cast("bigint")).cast("bigint").alias("copies"))


def repeated(docs: DataFrame, copies: DataFrame, id_col: str = "doc_id", most: int = 1_000_000) -> DataFrame:
    """Every row of docs as often as `copies` (of mix_to_targets) says; rows that share an id go by the highest of theirs.

    The table of copies is broadcast where it was counted to have at most `most` rows, else both sides are shuffled.
    """
    times = written(copies.groupBy(F.col(id_col).alias("_at")).agg(F.max("copies").alias("_times")), "mix-copies")
    own = docs.select(F.struct(*docs.columns).alias("_row"))
    joined = own.join(F.broadcast(times) if times.count() <= most else times, F.col(f"_row.`{id_col}`").eqNullSafe(F.col("_at")))
    many = F.explode(F.expr("if(_times > 0, sequence(1, _times), cast(array() as array<bigint>))"))
    return joined.select("_row", many.alias("_k")).select("_row.*")
