"""Scoring, explaining and ranking matches."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestrank.functions import columns as CO
from nestrank.functions import scoring as SC
from nestrank.functions.text import round_half_even, sealed
from nestrank.operators import filters as FL
from nestrank.operators.joins import with_latest
from nestrank.operators.signals import stage
from nestrank.session import cut_lineage
from nestrank.sources.profiles import Profile


def score_columns(p: Profile) -> dict[str, Column]:
    """``s_<criterion>`` for all 21 criteria."""
    return {f"s_{c.key}": c.rounded(p) for c in SC.CRITERIA}


def with_scores(df: DataFrame, p: Profile) -> DataFrame:
    """Listing columns plus one score per criterion, total points and percent."""
    values = {**score_columns(p), "points": SC.total_points(p)}
    scored = stage(df, p).select(*df.columns, sealed(values))
    return scored.withColumn("percent", SC.score_pct(F.col("points"), p.total_weight))


def with_points(df: DataFrame, p: Profile) -> DataFrame:
    """Listing columns plus total points: what ordering needs and no more."""
    return stage(df, p).select(*df.columns, sealed({"points": SC.total_points(p)}))


def components(p: Profile, weights: Mapping[str, float] | None = None, explained: bool = True) -> Column:
    """Scorecard array; ``ord`` keeps the criterion order, which decides ties.

    Without ``explained`` it has no evidence and confidence: ordering reads neither, and the
    planner cannot leave them out of an array.
    """
    weights = p.weights if weights is None else weights

    def texts(c: SC.Criterion) -> list[Column]:
        return [
            (c.evidence(p) if c.evidence else SC.no_evidence()).alias("evidence"),
            (c.confidence(p) if c.confidence else F.lit("medium")).alias("confidence"),
        ]

    return F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(c.key).alias("criterion"),
                c.rounded(p).alias("score"),
                F.lit(float(weights.get(c.key, 0) or 0)).alias("weight"),
                *(texts(c) if explained else []),
            )
            for i, c in enumerate(SC.CRITERIA)
        ]
    )


def label_of(criterion: Column) -> Column:
    pairs = [F.lit(v) for item in SC.LABELS.items() for v in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), criterion), criterion)


def contribution_order(scores: Column, keep) -> Column:
    """Entries ordered by contribution, largest first, earlier criteria first on ties."""
    weighed = F.transform(
        F.filter(scores, keep),
        lambda c: F.struct(
            (F.when(c.weight > 0, c.score / F.lit(10.0) * c.weight).otherwise(F.lit(0.0)) * F.lit(-1.0)).alias("neg"),
            c.ord.alias("ord"),
            c.criterion.alias("criterion"),
        ),
    )
    return F.sort_array(weighed)


def top_criteria(scores: Column, k: int = 3) -> Column:
    """The k criteria with the largest contribution (score/10 times weight)."""
    return F.transform(F.slice(contribution_order(scores, lambda c: F.lit(True)), 1, k), lambda c: c.criterion)


def bottom_criteria(scores: Column, k: int = 3) -> Column:
    """The k weighted criteria with the lowest scores."""
    weighed = F.transform(
        F.filter(scores, lambda c: c.weight > 0),
        lambda c: F.struct(c.score.alias("score"), c.ord.alias("ord"), c.criterion.alias("criterion")),
    )
    return F.transform(F.slice(F.sort_array(weighed), 1, k), lambda c: c.criterion)


def why_now() -> Column:
    """Why look now: a known reduction, else the latest change, else days on market.

    Reads price, is_price_reduced, price_reduction_amount, days_on_market and the
    latest event (``latest_type``, ``latest_percent``).
    """
    cut = F.nullif(F.col("price_reduction_amount"), F.lit(0.0))
    reduced = F.coalesce(F.col("is_price_reduced"), F.lit(False)) & cut.isNotNull()
    price = F.nullif(F.col("price"), F.lit(0.0))

    def dropped(percent: Column) -> Column:
        return F.concat(F.lit("Price dropped "), CO.whole(percent), F.lit("% recently"))

    days = F.col("days_on_market")
    percent = F.nullif(F.col("latest_percent"), F.lit(0.0))
    return (
        F.when(
            reduced,
            F.coalesce(dropped(cut / (price + cut) * 100), F.lit("Price dropped recently")),
        )
        .when(F.col("latest_type") == "price_drop", F.coalesce(dropped(percent), F.lit("Price dropped recently")))
        .when(F.col("latest_type") == "back_on_market", "Back on market")
        .when(days <= 7, F.concat(F.lit("New listing ("), days.cast("string"), F.lit(" DOM)")))
        .when(days >= 45, F.concat(F.lit("Overlooked at "), days.cast("string"), F.lit(" DOM")))
    )


def explain_matches(df: DataFrame, p: Profile, events: DataFrame | None = None) -> DataFrame:
    """Add the scorecard, reasons, trade-off, tier, texts and signals to scored rows.

    Meant for the rows that survive the limit: it recomputes the signals of those rows
    instead of carrying 60 columns through the sort.
    """
    staged = stage(df, p).withColumn("feature_scores", components(p))
    scores, points = F.col("feature_scores"), F.col("points")
    percent = SC.score_pct(points, p.total_weight)
    penalty = SC.price_penalty(F.col("price"), p.soft_caps.get("price_soft"), p.hard_filters.get("price_max"))
    best = F.slice(contribution_order(scores, lambda c: (c.weight > 0) & (c.score > 0)), 1, 3)
    lowest = F.element_at(bottom_criteria(scores, 1), 1) if any(p.weights.values()) else F.lit(None)

    def tenth(col: Column) -> Column:
        return round_half_even(col / F.lit(10.0), 1)

    found = F.size("_p_character") + F.size("_p_quality")
    out = staged.withColumns(
        {
            "match_score": round_half_even(percent, 1),
            "score_points": round_half_even(points, 1),
            "score_percent": SC.percent_text(points, p.total_weight),
            "score_tier": SC.tier(percent),
            "top_positives": F.transform(best, lambda c: label_of(c.criterion)),
            "key_tradeoff": F.when(penalty > 0, "Above ideal price")
            .when(SC.hoa_penalty(F.col("hoa_fee")) > 0, "High HOA")
            .otherwise(F.concat(F.lit("Low on "), label_of(lowest))),
            "signals": F.struct(
                tenth(F.col("_quiet")).alias("tranquility_score"),
                tenth(F.col("_light")).alias("light_potential"),
                tenth(F.col("visual_quality_score")).alias("visual_quality"),
                F.when(found > 0, SC.hit_score(found)).alias("nlp_character_score"),
            ),
        }
    )
    extra = ["match_score", "score_points", "score_percent", "score_tier", "feature_scores",
             "top_positives", "key_tradeoff", "signals", "why_now"]
    for name, kind in (("is_price_reduced", "boolean"), ("price_reduction_amount", "double")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    if events is not None:
        out = with_latest(out, events, "latest")
    else:
        out = out.withColumns(
            {"latest_type": F.lit(None).cast("string"), "latest_percent": F.lit(None).cast("double")}
        )
    out = out.withColumn("why_now", why_now())
    keep = [c for c in df.columns if c not in extra]
    return out.select(*keep, *extra)


def candidates(df: DataFrame, p: Profile) -> DataFrame:
    return FL.signal_filter(FL.hard_filter(df, p), p)


def candidate_points(df: DataFrame, p: Profile) -> DataFrame:
    """Candidates with their points: limits in the scan, then one scan of each text for both the
    disqualifying signals and the score."""
    staged = stage(FL.hard_filter(df, p), p)
    values = {"points": SC.total_points(p), "_keep": FL.staged_verdict(p)}
    return staged.select(*df.columns, sealed(values)).where("_keep").drop("_keep")


def top_points(df: DataFrame, p: Profile, limit: int = 100, min_score: float = 0.0) -> DataFrame:
    """The best ``limit`` candidates by points, then the percent threshold.

    Percent grows with points, so cutting before or after the limit keeps the same
    rows; after it, the filter cannot be pushed down and score the row twice.
    """
    top = candidate_points(df, p).orderBy(F.col("points").desc(), F.col("id")).limit(limit)
    if min_score <= 0:
        return top
    return top.filter(SC.score_pct(F.col("points"), p.total_weight) >= F.lit(float(min_score)))


def rank(df: DataFrame, p: Profile, limit: int = 100, min_score: float = 0.0, events: DataFrame | None = None) -> DataFrame:
    """Ranked and explained matches, best first.

    The winners (at most ``limit`` rows) are checkpointed: explaining them and picking
    their events would otherwise score the whole table once more each.
    """
    top = cut_lineage(top_points(df, p, limit, min_score))
    if events is not None:
        # at most ``limit`` rows: the event side is reduced to these listings
        events = events.join(F.broadcast(top.select(F.col("id").alias("listing_id"))), "listing_id", "left_semi")
    # the limit makes the last sort a top-n: no range bounds are sampled by a run of their own
    return explain_matches(top, p, events).orderBy(F.col("points").desc(), F.col("id")).limit(limit)


def rank_summary(df: DataFrame, p: Profile, limit: int = 100, min_score: float = 0.0) -> DataFrame:
    """How many listings were analysed (after the limits) and how many are shown."""
    analysed = FL.hard_filter(df, p).agg(F.count(F.lit(1)).alias("total_analyzed"))
    shown = top_points(df, p, limit, min_score).agg(F.count(F.lit(1)).alias("matches_shown"))
    both = analysed.withColumn("_k", F.lit(1)).join(shown.withColumn("_k", F.lit(1)), "_k").drop("_k")
    text = F.concat(
        F.lit("Analyzed "), F.format_number("total_analyzed", 0), F.lit(" listings. Showing "),
        F.col("matches_shown").cast("string"), F.lit(" that matter."),
    )
    return both.withColumn("summary", text)


def score_rows(df: DataFrame, p: Profile, min_pct: float = 0.0) -> DataFrame:
    """Every listing with its failure reasons, points, percent and ``passes``.

    Single-listing scoring: statuses are tested literally here.
    """
    scored = with_points(FL.with_signal_failures(df, p).withColumn("hard_failures", FL.hard_failures(p)), p)
    clean = (F.size("hard_failures") == 0) & (F.size("signal_failures") == 0)
    percent = SC.score_pct(F.col("points"), p.total_weight)
    return scored.withColumns(
        {
            "points": F.when(clean, F.col("points")),
            "percent": F.when(clean, percent),
            "passes": clean & (percent >= F.lit(float(min_pct))),
        }
    )


def criterion_rows(df: DataFrame, p: Profile) -> DataFrame:
    """One row per (listing, criterion) with the score and the criterion order."""
    scored = with_scores(df, p)
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(c.key).alias("criterion"),
                     F.col(f"s_{c.key}").alias("score"),
                     F.lit(float(p.weights.get(c.key, 0) or 0)).alias("weight"))
            for i, c in enumerate(SC.CRITERIA)
        ]
    )
    return scored.select("id", F.inline(entries))


# --- C30, R2: many weight vectors --------------------------------------------
CELLS = 64  # stretches of the listings of a group by their plain total, each with a bound of its own
STRETCH = 512  # listings of a stretch at least
BLOCK = 1 << 18  # points of a matrix product at once, which the cache of a core holds
ROWS, VECTORS = 20_000, 32_768  # listings and vectors of one group at most, on average
WINNER = "vector_id long, id long, points double"


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = table.column(column).combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _id_order(table: pa.Table) -> np.ndarray:
    return table.column("id").cast(pa.int64()).fill_null(-(2**63)).to_numpy()


def _band_rows(batches: Iterator[pa.RecordBatch], k: int, used: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """The listings of a partition without those that ``k`` others beat under every vector without
    negative weights: no score lower, no larger penalty, a smaller id.

    Points are computed by monotone steps, so this holds for the rounded values too.  Listings come
    by rising id, and one that is left out has ``k`` better ones among those kept or in its block.
    """
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    table = pa.Table.from_batches(found)
    table = table.take(np.argsort(_id_order(table), kind="stable"))
    ids, penalty = _id_order(table), table.column("penalty").to_numpy()
    values = np.column_stack([_matrix(table, "scores")[:, list(used)], -penalty])
    kept = np.empty(0, dtype=np.int64)
    for low in range(0, len(ids), 256):
        block = np.arange(low, min(low + 256, len(ids)))
        others = np.concatenate([kept, block])
        beats = ids[others][:, None] < ids[block]
        for j in range(values.shape[1]):
            beats &= values[others, j][:, None] >= values[block, j]
        kept = np.concatenate([kept, block[beats.sum(axis=0) < k]])
    yield from table.take(kept).to_batches()


def _band(scored: DataFrame, k: int, used: Sequence[int]) -> DataFrame:
    """Listings that can be among the ``k`` best of a vector without negative weights.

    Two rounds over pieces of at most ``ROWS`` listings: what is beaten in its piece is beaten.
    """
    for _ in range(2):
        pieces = max(1, -(-scored.count() // ROWS))
        scored = cut_lineage(scored.repartition(pieces, "id", "scores").mapInArrow(
            lambda batches: _band_rows(batches, k, used), scored.schema
        ))
    return scored


def _best_of(listings: pa.Table, vectors: pa.Table, k: int, digits: int | None, cells: int) -> pa.Table:
    """The k best listings of a group for each of its vectors, ties to smaller ids.

    A matrix product gives points but for their rounding; listings that come near a vector's k-th
    best get the exact sum.  A stretch that cannot reach it is left out by its extreme scores.
    """
    names = vectors.column("vector_id")
    parts = [(names.slice(0, 0), listings.column("id").slice(0, 0), np.empty(0))]
    if listings.num_rows and vectors.num_rows:
        plain = _matrix(listings, "scores").sum(axis=1) - listings.column("penalty").to_numpy()
        listings = listings.take(np.argsort(-plain, kind="stable"))
        scores, weights = _matrix(listings, "scores") / 10.0, _matrix(vectors, "weights")
        penalty, ids = listings.column("penalty").to_numpy(), _id_order(listings)
        count, slack = len(ids), 0.0 if digits is None else 10.0**-digits
        size = max(STRETCH, -(-count // cells))
        lifted = np.column_stack([weights, np.ones(len(weights))])
        step = max(1, BLOCK // max(size, k))
        for low in range(0, len(weights), step):
            part = weights[low:low + step]
            # room for the rounding of either sum
            room = 1e-12 * (np.abs(part) @ np.abs(scores).max(axis=0) + np.abs(penalty).max()) + slack
            reached = np.full(len(part), -np.inf)  # k-th best so far
            row, col, points = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
            for start in range(0, count, size):
                some, less = scores[start:start + size], penalty[start:start + size]
                most = np.maximum(part * some.max(axis=0), part * some.min(axis=0)).sum(axis=1) - less.min()
                live = np.flatnonzero(~(np.maximum(0.0, most) + room < reached))
                if not len(live):
                    continue
                # a vector's points lie side by side, penalties off, before those below zero are raised to it
                about = lifted[low + live] @ np.column_stack([some, -less]).T
                low_end = reached[live]
                if start == 0 and len(some) > k:
                    low_end = np.maximum(0.0, np.partition(about, len(some) - k, axis=1)[:, len(some) - k]) - room[live]
                least = low_end - room[live]
                of, near = np.nonzero(~(about < np.where(least > 0, least, -np.inf)[:, None]))
                near, of = near + start, live[of]
                exact = np.zeros(len(near))
                for j in range(scores.shape[1]):  # criterion order, as in the single-profile sum
                    exact += scores[near, j] * part[of, j]
                exact = np.maximum(0.0, exact - penalty[near])
                if digits is not None:
                    exact = np.rint(exact * 10.0**digits) / 10.0**digits
                row, col, points = np.concatenate([row, near]), np.concatenate([col, of]), np.concatenate([points, exact])
                # ties at the cut: smaller ids first, no more than k of a vector
                order = np.lexsort((ids[row], -points, col))
                row, col, points = row[order], col[order], points[order]
                place = np.arange(len(col)) - np.searchsorted(col, col)
                reached[col[place == k - 1]] = points[place == k - 1]
                row, col, points = row[place < k], col[place < k], points[place < k]
            parts.append((names.take(pa.array(low + col)), listings.column("id").take(pa.array(row)), points))
    tables = [pa.table({"vector_id": v, "id": i.cast(pa.int64()), "points": x}) for v, i, x in parts]
    return pa.concat_tables(tables)


def _winners(listings: DataFrame, vectors: DataFrame, rows: int, count: int, k: int, digits: int | None, cells: int) -> DataFrame:
    """The k best listings of each vector in each slice of the listings.

    Slices of the listings meet blocks of the vectors in groups of bounded size: a listing is
    repeated for the blocks, a vector for the slices.
    """
    slices, blocks = (F.lit(max(1, -(-n // most))).cast("long") for n, most in ((rows, ROWS), (count, VECTORS)))

    def every(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))

    left = listings.withColumn("slice", F.pmod(F.xxhash64("id"), slices)).withColumn("block", every(blocks))
    right = vectors.withColumn("block", F.pmod(F.xxhash64("vector_id"), blocks)).withColumn("slice", every(slices))
    return left.groupBy("slice", "block").cogroup(right.groupBy("slice", "block")).applyInArrow(
        lambda a, b: _best_of(a, b, k, digits, cells), WINNER
    )


def _top(winners: DataFrame, k: int) -> DataFrame:
    """The k best of each vector; the rank filter is applied in every task before the shuffle."""
    window = Window.partitionBy("vector_id").orderBy(F.col("points").desc(), F.col("id"))
    return winners.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def rank_per_user(
    df: DataFrame, p: Profile, user_weights: DataFrame, k: int = 100, min_score: float = 0.0, cells: int = CELLS,
    digits: int | None = None,
) -> DataFrame:
    """Top k matches of every user under the user's own weights.

    ``user_weights``: (user_id, criterion, weight).  Scores do not depend on the user, so each
    listing is scored once, and users with equal weights share a vector.  Vectors without negative
    weights meet only the listings that fewer than k others beat whatever the weights (see
    ``_band_rows``); the others meet all.  In a group, listings are cut into ``cells`` stretches by
    their plain total, and a stretch's extreme scores bound what any of its listings can reach under
    a vector.  Partial winners are ranked once more after the shuffle.  One way for any number of
    vectors; no vector and no listing passes the driver.  Points are those of ``rank``; ``digits``
    rounds them before they are ordered.
    """
    keys = [c.key for c in SC.CRITERIA]
    place = F.lit(None).cast("int")
    for j, key in enumerate(keys):
        place = F.when(F.col("criterion") == key, F.lit(j)).otherwise(place)
    # one number a criterion, combined before the shuffle; a criterion that a user has twice is an error
    entries = user_weights.filter(F.col("criterion").isin(*keys)).select("user_id", "weight", place.alias("_place")).groupBy("user_id").agg(
        *[F.max(F.when(F.col("_place") == j, F.col("weight"))).alias(f"_{j}") for j in range(len(keys))],
        F.count(F.lit(1)).alias("_rows"), F.bit_or(F.expr("shiftleft(1, _place)")).alias("_seen"),
    )
    weights = F.array(*[F.coalesce(f"_{j}", F.lit(0.0)) for j in range(len(keys))])
    entries = cut_lineage(entries.select(
        "user_id",
        F.when(F.col("_rows") == F.bit_count("_seen"), weights).otherwise(
            F.raise_error(F.lit("a user has several weights for a criterion"))
        ).alias("weights"),
    ))
    plain = F.forall("weights", lambda w: (w >= 0) & (w < float("inf")))
    vectors = cut_lineage(entries.groupBy("weights").agg(plain.alias("plain")).withColumn("vector_id", F.monotonically_increasing_id()))
    staged = stage(FL.hard_filter(df, p), p)
    scored = cut_lineage(staged.select("id", sealed({
        "scores": F.array(*[c.rounded(p) for c in SC.CRITERIA]), "penalty": SC.penalties(p), "_keep": FL.staged_verdict(p),
    })).where("_keep").drop("_keep"))

    weighed = [F.coalesce(F.max(F.col("weights")[j] != 0), F.lit(False)).alias(key) for j, key in enumerate(keys)]
    sides = {r["plain"]: r for r in vectors.groupBy("plain").agg(F.count(F.lit(1)).alias("_n"), *weighed).collect()}  # two rows
    winners = df.sparkSession.createDataFrame([], WINNER)
    for side, facts in sides.items():
        met = _band(scored, k, [j for j, key in enumerate(keys) if facts[key]]) if side else scored
        asked = vectors.where(F.col("plain") == side).select("vector_id", "weights")
        winners = winners.union(_winners(met, asked, met.count(), facts["_n"], k, digits, cells))
    final = _top(winners, k)
    total = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w)
    # sorted by a number first; arrays are compared where it is equal
    hashed, known = (side.withColumn("_hash", F.xxhash64("weights")) for side in (entries, vectors))
    users = hashed.join(known.hint("merge"), ["_hash", "weights"]).select(
        "user_id", "vector_id", F.when(total > 0, total).otherwise(F.lit(1.0)).alias("total")
    )
    out = users.join(final.hint("merge"), "vector_id").select(
        "user_id", "rank", "id", "points", (F.col("points") / F.col("total") * 100).alias("percent")
    )
    return out.filter(F.col("percent") >= F.lit(float(min_score))) if min_score > 0 else out
