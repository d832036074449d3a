"""Column functions over `array<double>` series, all of them Catalyst expressions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import errors


def _at(s: Column, i: Column) -> Column:
    return F.get(s, i)


def let(value: Column, body) -> Column:
    """body(value) with value made once for each row, however often body uses it: lambdas over arrays are
    evaluated anew for each use otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _positions(s: Column) -> Column:
    return F.sequence(F.lit(0), F.size(s) - 1)


def array_sum(s: Column) -> Column:
    return F.aggregate(s, F.lit(0.0), lambda a, x: a + x)


def array_mean(s: Column) -> Column:
    return array_sum(s) / F.size(s)


def array_std(s: Column) -> Column:
    """Population standard deviation."""

    def of(s: Column) -> Column:
        squares = lambda mean: F.aggregate(s, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        return F.sqrt(let(array_mean(s), squares) / F.size(s))

    return let(s, of)


def is_valid(s: Column) -> Column:
    """Not empty, and every value there and finite."""
    fine = F.forall(s, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(s) > 0) & fine, F.lit(False))


def z_normalize(s: Column) -> Column:
    """(x - mean) / population deviation; null for a constant series (preprocess() raises on one)."""

    def scaled(s: Column) -> Column:
        moments = F.struct(array_mean(s).alias("mean"), array_std(s).alias("std"))
        return let(moments, lambda m: F.when(m["std"] != 0, F.transform(s, lambda x: (x - m["mean"]) / m["std"])))

    return let(s, scaled)


def derivative(s: Column) -> Column:
    """Keogh-Pazzani slope of inner points, two values shorter; null if there are fewer than three."""

    def slopes(s: Column) -> Column:
        slope = lambda i: ((_at(s, i) - _at(s, i - 1)) + (_at(s, i + 1) - _at(s, i - 1)) / 2) / 2
        return F.when(F.size(s) >= 3, F.transform(F.sequence(F.lit(1), F.size(s) - 2), slope))

    return let(s, slopes)


NARROW = 3  # radii up to which a place's neighbours are looked at one by one


def _block_scans(s: Column, width: int, of) -> Column:
    """struct<left, right>: the extreme of each place's block so far, from the block's left end and from its right."""

    def scan(block: Column) -> Column:
        return F.aggregate(block, F.array().cast("array<double>"), lambda done, x: F.concat(done, F.array(of(F.get(done, F.size(done) - 1), x))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / width).cast("int")), lambda b: F.slice(s, b * width + 1, width))
    return let(blocks, lambda cut: F.struct(F.flatten(F.transform(cut, scan)).alias("left"), F.flatten(F.transform(cut, lambda x: F.reverse(scan(F.reverse(x))))).alias("right")))


def _sliding(s: Column, radius: int, of) -> Column:
    """The extreme of 2 radius + 1 neighbours, by two scans of blocks of that width: a window is the end of one block and the
    beginning of the next, so a place costs the same for every radius."""
    width = 2 * radius + 1

    def place(v: Column):
        def one(i: Column) -> Column:
            low, high = F.greatest(i - radius, F.lit(0)), F.least(i + radius, F.size(v["left"]) - 1)
            first = F.floor(low / width) == 0
            same = F.floor(low / width) == F.floor(high / width)
            left, right = F.get(v["left"], high), F.get(v["right"], low)
            return F.when((low == 0) & (first & same), left).when(same, right).otherwise(of(left, right))

        return one

    return let(_block_scans(s, width, of), lambda v: F.transform(_positions(v["left"]), place(v)))


def envelope(s: Column, radius: int | None) -> Column:
    """struct<upper, lower>: the largest and least value within radius of each place (of all, if None)."""

    def of(s: Column) -> Column:
        if radius is None:
            high, low = F.array_repeat(F.array_max(s), F.size(s)), F.array_repeat(F.array_min(s), F.size(s))
        elif radius > NARROW:
            high, low = _sliding(s, radius, F.greatest), _sliding(s, radius, F.least)
        else:
            first = lambda i: F.greatest(i - radius, F.lit(0))
            part = lambda i: F.slice(s, first(i) + 1, F.least(i + radius, F.size(s) - 1) - first(i) + 1)
            high = F.transform(_positions(s), lambda i: F.array_max(part(i)))
            low = F.transform(_positions(s), lambda i: F.array_min(part(i)))
        return F.struct(high.alias("upper"), low.alias("lower"))

    return let(s, of)


def _gap(x: Column, upper: Column, lower: Column) -> Column:
    return F.greatest(x - upper, lower - x, F.lit(0.0))


def lb_keogh(q: Column, env: Column) -> Column:
    """Distance of a series to an envelope, over the shorter of both lengths."""

    def of(v: Column) -> Column:
        n = F.least(F.size(v["q"]), F.size(v["e"]["upper"]))
        gaps = F.transform(F.sequence(F.lit(0), n - 1), lambda i: _gap(_at(v["q"], i), _at(v["e"]["upper"], i), _at(v["e"]["lower"], i)))
        return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda a, g: a + g * g))

    return let(F.struct(q.alias("q"), env.alias("e")), of)


def lb_improved_compat(q: Column, env_q: Column, c: Column, env_c: Column) -> Column:
    """The position-wise two-sided formula. It can exceed the distance, so nothing is pruned by it."""

    def of(v: Column) -> Column:
        n = F.least(F.size(v["q"]), F.size(v["c"]), F.size(v["eq"]["upper"]), F.size(v["ec"]["upper"]))

        def term(i: Column) -> Column:
            x, y = _at(v["q"], i), _at(v["c"], i)
            up, low = _at(v["ec"]["upper"], i), _at(v["ec"]["lower"], i)
            other = F.when(x > up, up).when(x < low, low).otherwise(y)
            first = _gap(x, up, low)
            second = _gap(other, _at(v["eq"]["upper"], i), _at(v["eq"]["lower"], i))
            return first * first + second * second

        return F.sqrt(F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), F.lit(0.0), lambda a, t: a + t))

    return let(F.struct(q.alias("q"), env_q.alias("eq"), c.alias("c"), env_c.alias("ec")), of)


def lb_two_pass(q: Column, c: Column, env_c: Column, radius: int | None) -> Column:
    """Lemire's bound: the series is clipped to the envelope, and the other's distance to the clipped series'
    envelope is added. Never above the banded distance of series of one length."""

    def of(v: Column) -> Column:
        x, e = v["q"], v["e"]
        clipped = F.transform(_positions(x), lambda i: F.greatest(F.least(_at(x, i), _at(e["upper"], i)), _at(e["lower"], i)))
        both = F.struct(lb_keogh(x, e).alias("a"), lb_keogh(v["c"], envelope(clipped, radius)).alias("b"))
        return let(both, lambda t: F.sqrt(t["a"] * t["a"] + t["b"] * t["b"]))

    return let(F.struct(q.alias("q"), c.alias("c"), env_c.alias("e")), of)


def gini(counts: Column) -> Column:
    total = array_sum(F.transform(counts, lambda x: x.cast("double")))
    return let(total, lambda n: F.when(n > 0, 1 - F.aggregate(counts, F.lit(0.0), lambda a, x: a + (x / n) * (x / n))).otherwise(0.0))


def entropy(counts: Column) -> Column:
    """In nats."""
    total = array_sum(F.transform(counts, lambda x: x.cast("double")))
    part = lambda n: lambda a, x: a - F.when(x > 0, (x / n) * F.ln(x / n)).otherwise(0.0)
    return let(total, lambda n: F.when(n > 0, F.aggregate(counts, F.lit(0.0), part(n))).otherwise(0.0))


def top_k(probabilities: Column, k: int) -> Column:
    """array<struct<class, probability>>, likeliest first; of ties the least class."""
    ranked = F.array_sort(F.transform(probabilities, lambda p, i: F.struct((-p).alias("minus"), i.alias("class"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: F.struct(s["class"].alias("class"), (-s["minus"]).alias("probability")))


def predicted_class(probabilities: Column) -> Column:
    """The likeliest class; of ties the greatest."""
    return F.array_max(F.transform(probabilities, lambda p, i: F.struct(p.alias("p"), i.alias("i"))))["i"]


def bin_index(edges: Column, value: Column) -> Column:
    """How many edges are less than the value."""
    return F.size(F.filter(edges, lambda e: e < value))


def quantile_edges(value: Column, bins: int) -> Column:
    """Aggregate: inner quantiles by linear interpolation, without repeats and strictly within the range."""
    low, high = F.min(value), F.max(value)
    found = F.percentile(value, F.array(*[F.lit(k / bins) for k in range(1, bins)]))
    return F.when(low < high, F.filter(F.array_distinct(found), lambda e: (e > low) & (e < high))).otherwise(F.array().cast("array<double>"))


def require_valid(df: DataFrame, series: str = "series", key: str = "id") -> DataFrame:
    """df, after a look for a series that is empty or not finite."""
    bad = df.filter(~is_valid(F.col(series))).select(key, series).head(1)
    if bad:
        raise (errors.NonFiniteValue if bad[0][series] else errors.EmptySeries)(id=bad[0][key])
    return df


def preprocess(df: DataFrame, normalize: bool = False, slope: bool = False, series: str = "series", key: str = "id") -> DataFrame:
    """Normalise, then derive, as asked. One constant (or too short) series fails the whole batch."""
    if normalize:
        df = df.withColumn(series, z_normalize(F.col(series)))
        bad = [r[key] for r in df.filter(F.col(series).isNull()).select(key).orderBy(key).head(5)]
        if bad:
            raise errors.ConstantSeries(ids=bad)
    if slope:
        df = df.withColumn(series, derivative(F.col(series)))
        bad = [r[key] for r in df.filter(F.col(series).isNull()).select(key).orderBy(key).head(5)]
        if bad:
            raise errors.TooShort(ids=bad)
    return df


def from_wide(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("series"))


def from_events(df: DataFrame, key: str, bucket: Column, value: Column, buckets: Column) -> DataFrame:
    """Series from events: the sum of each bucket, zero where there is none. buckets: an array of all of them,
    as a literal; one groupBy, no join: each key's sums are a map that the buckets look up."""
    sums = df.groupBy(F.col(key).alias("id"), bucket.alias("bucket")).agg(F.sum(value).alias("v"))
    maps = sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "v"))).alias("m"))
    return maps.select("id", F.transform(buckets, lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0))).alias("series"))
