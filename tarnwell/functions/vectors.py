"""Vector and score arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwell.functions.text import ColumnLike, bind, col
from tarnwell.settings import RETRIEVAL, RetrievalSettings

EPOCH = "1970-01-01 00:00:00"


def dot(left: ColumnLike, right: ColumnLike) -> Column:
    products = F.zip_with(col(left), col(right), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: ColumnLike) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine_distance(left: ColumnLike, right: ColumnLike) -> Column:
    """1 - cosine; null for a zero vector."""
    scale = norm(left) * norm(right)
    return F.when(scale > 0, F.lit(1.0) - dot(left, right) / scale)


def unit_vector(vector: ColumnLike) -> Column:
    return bind(
        F.struct(col(vector).alias("v"), norm(vector).alias("n")),
        lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x.cast("double") / s["n"])),
    )


def sanitize_vector(vector: ColumnLike) -> Column:
    """NaN, infinities and nulls become 0."""

    def finite(x: Column) -> Column:
        d = x.cast("double")
        bad = d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))
        return F.when(bad, F.lit(0.0)).otherwise(d)

    return F.transform(col(vector), finite)


def has_dim(vector: ColumnLike, dim: int) -> Column:
    """True for the right length, null for a null or empty vector, false otherwise."""
    size = F.size(col(vector))
    return F.when(size > 0, size == dim)


def check_dim(vector: ColumnLike, dim: int) -> Column:
    """The vector, null when null or empty; a wrong length stops the job."""
    size = F.size(col(vector))
    message = F.concat(F.lit(f"vector length is not {dim}: "), size.cast("string"))
    return F.when(size > 0, F.when(size == dim, col(vector)).otherwise(F.raise_error(message).cast("array<float>")))


def _multiplier(query_category: ColumnLike, row_category: ColumnLike, same: float, both: float, other: float) -> Column:
    wanted = F.lower(F.trim(F.coalesce(col(query_category), F.lit(""))))
    own = F.lower(F.trim(F.coalesce(col(row_category), F.lit(""))))
    factor = F.when(own == wanted, F.lit(same)).when(own == "both", F.lit(both)).otherwise(F.lit(other))
    return F.when(wanted.isin("", "both"), F.lit(1.0)).otherwise(factor)


def distance_multiplier(query_category: ColumnLike, row_category: ColumnLike, s: RetrievalSettings = RETRIEVAL) -> Column:
    return _multiplier(query_category, row_category, s.distance_match, s.distance_both, s.distance_other)


def rank_multiplier(query_category: ColumnLike, row_category: ColumnLike, s: RetrievalSettings = RETRIEVAL) -> Column:
    return _multiplier(query_category, row_category, s.rank_match, s.rank_both, s.rank_other)


def boost_distance(distance: ColumnLike, exact: ColumnLike, phrase: ColumnLike, s: RetrievalSettings = RETRIEVAL) -> Column:
    factor = F.when(col(exact), F.lit(s.exact_distance_factor)).when(
        col(phrase), F.lit(s.phrase_distance_factor)
    ).otherwise(F.lit(1.0))
    return col(distance) * factor


def bonus_rank(rank: ColumnLike, exact: ColumnLike, phrase: ColumnLike, exact_bonus: float, phrase_bonus: float) -> Column:
    return (
        col(rank)
        + F.when(col(exact), F.lit(exact_bonus)).otherwise(F.lit(0.0))
        + F.when(col(phrase), F.lit(phrase_bonus)).otherwise(F.lit(0.0))
    )


def retrieval_score(score: ColumnLike, distance: ColumnLike) -> Column:
    """Fused score, else closeness from the distance, else 0."""
    return F.coalesce(col(score), F.lit(1.0) / (F.lit(1.0) + F.greatest(col(distance), F.lit(0.0))), F.lit(0.0))


def tiebreak_score(score: ColumnLike, distance: ColumnLike) -> Column:
    return F.coalesce(col(score), -col(distance), F.lit(0.0))


def clamp01(value: ColumnLike) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(value).cast("double")))


def signal_count(*signals: ColumnLike) -> Column:
    total = F.lit(0)
    for signal in signals:
        total = total + col(signal).isNotNull().cast("int")
    return total


def confidence_value(
    winner: ColumnLike, runner_up: ColumnLike, signals: ColumnLike, exact: ColumnLike, phrase: ColumnLike
) -> Column:
    """Trust in a selected document from its score, its lead and its supporting signals."""
    best, second = col(winner), F.coalesce(col(runner_up), F.lit(0.0))
    gap = F.greatest(F.lit(0.0), best - second)
    strength = F.when(best > 0, best / (1.0 + best)).otherwise(0.0)
    margin = F.when(best > 0, gap / F.greatest(best, F.lit(1e-6))).otherwise(0.0)
    ratio = F.when((second <= 0) & (best > 0), F.lit(1.0)).otherwise(
        best / F.greatest(second, F.lit(1e-6)) - 1.0
    )
    total = (
        0.45 * clamp01(strength)
        + 0.25 * clamp01(margin)
        + 0.15 * clamp01(ratio / 1.5)
        + 0.15 * clamp01(col(signals) / 3.0)
    )
    lift = F.when(col(exact), F.lit(0.08)).when(col(phrase), F.lit(0.04)).otherwise(F.lit(0.0))
    return clamp01(total + lift)


def confidence_label(value: ColumnLike) -> Column:
    v = col(value)
    return (
        F.when(v >= 0.85, "very_high").when(v >= 0.70, "high").when(v >= 0.50, "medium")
        .when(v > 0.0, "low").otherwise("none")
    )


def epoch_default_utc(ts: ColumnLike) -> Column:
    return F.coalesce(col(ts).cast("timestamp"), F.lit(EPOCH).cast("timestamp"))


def duration_seconds(start: ColumnLike, end: ColumnLike) -> Column:
    micros = F.unix_micros(col(end).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp"))
    return F.greatest(micros / F.lit(1_000_000.0), F.lit(0.0))


def round_score(value: ColumnLike) -> Column:
    return F.bround(F.coalesce(col(value), F.lit(0.0)), 3)


def percentage(part: ColumnLike, whole: ColumnLike, digits: int) -> Column:
    """Share in percent, 0 when the whole is 0."""
    return F.when(col(whole) > 0, F.bround(col(part) * 100.0 / col(whole), digits)).otherwise(F.lit(0.0))
