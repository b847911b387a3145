"""Statistics of metadata and of dissimilarities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import key, uniform
from .relational import average_ranks

# -- distances between samples by metadata ---------------------------------------


def gower(meta: DataFrame, by: Sequence[str] | None = None, similarity: bool = False) -> DataFrame:
    """s1 < s2, value: mean over columns of range-scaled differences (numbers,
    times in days) or mismatches; null where two samples share no known column."""
    kinds = dict(meta.dtypes)
    by = [c for c in (by or meta.columns) if c != "sample"]
    if not by:
        raise ValueError("no columns are chosen")

    def as_number(c: str) -> Column | None:
        k = kinds[c]
        if k in ("timestamp", "timestamp_ntz", "date"):
            return F.unix_micros(F.col(c).cast("timestamp")) / F.lit(86_400_000_000.0)
        if k.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")):
            return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        return None

    numbers = {c: n for c in by if (n := as_number(c)) is not None}
    rows = meta.select("sample", *[numbers.get(c, F.col(c)).alias(c) for c in by])
    if numbers:  # one row of ranges
        spans = rows.agg(*[(F.max(c) - F.min(c)).alias(f"{c}_span") for c in numbers])
        rows = rows.join(F.broadcast(spans))
    a = rows.select(F.col("sample").alias("s1"), *[F.col(c).alias(f"{c}_1") for c in by], *[f"{c}_span" for c in numbers])
    b = rows.select(F.col("sample").alias("s2"), *[F.col(c).alias(f"{c}_2") for c in by])
    total, known = F.lit(0.0), F.lit(0)
    for c in by:
        x, y = F.col(f"{c}_1"), F.col(f"{c}_2")
        both = x.isNotNull() & y.isNotNull()
        d = F.when(F.coalesce(F.col(f"{c}_span"), F.lit(0.0)) > 0, F.abs(x - y) / F.col(f"{c}_span")).otherwise(F.lit(0.0)) if c in numbers else F.when(x == y, F.lit(0.0)).otherwise(F.lit(1.0))
        total, known = total + F.when(both, d).otherwise(F.lit(0.0)), known + F.when(both, 1).otherwise(0)
    value = F.try_divide(total, known)
    return a.join(b, F.col("s1") < F.col("s2")).select("s1", "s2", (F.lit(1.0) - value if similarity else value).alias("value"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("s1", "s2", "value").unionByName(pairs.select(F.col("s2").alias("s1"), F.col("s1").alias("s2"), "value"))


def average_rank(value: str, *partition: str) -> Column:
    w = Window.partitionBy(*partition)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, value)) - 1) / F.lit(2.0)


# -- Mantel ------------------------------------------------------------------------


def permutations(ids: DataFrame, n: int, seed: int, name: str = "sample") -> DataFrame:
    """it, sample, to: each iteration's relabelling."""
    rows = ids.select(F.col(name).alias("id")).distinct().join(ids.sparkSession.range(1, n + 1).select(F.col("id").alias("it")))
    place = rows.select("it", "id", F.row_number().over(Window.partitionBy("it").orderBy("id")).alias("n"))
    drawn = rows.select("it", F.col("id").alias("to"), F.row_number().over(Window.partitionBy("it").orderBy(key(F.lit(seed), "it", "id"), "id")).alias("n"))
    return place.join(drawn, ["it", "n"]).select("it", F.col("id").alias(name), "to")


def mantel(one: DataFrame, two: DataFrame, method: str = "spearman", n: int = 999, seed: int = 0) -> DataFrame:
    """stat, p of two sets of pairs (s1 < s2, value): 1 - r, or the mean absolute
    difference; p counts relabellings of the first that are as small. Ranks do
    not depend on labels and are made once."""
    rows = one.select("s1", "s2", F.col("value").alias("x")).join(two.select("s1", "s2", F.col("value").alias("y")), ["s1", "s2"])
    if method == "spearman":
        rows = average_ranks(average_ranks(rows, "x", "rx", "s1", "s2"), "y", "ry", "s1", "s2").select("s1", "s2", F.col("rx").alias("x"), F.col("ry").alias("y"))
    stat = F.avg(F.abs(F.col("x") - F.col("y"))) if method == "absDist" else F.lit(1.0) - F.corr("x", "y")
    observed = rows.agg(stat.alias("stat"))
    if n < 1:
        return observed.withColumn("p", F.lit(None).cast("double"))
    moves = permutations(rows.select(F.explode(F.array("s1", "s2")).alias("sample")), n, seed)
    moved = rows.select("s1", "s2", "x").join(moves.select("it", F.col("sample").alias("s1"), F.col("to").alias("t1")), "s1").join(moves.select("it", F.col("sample").alias("s2"), F.col("to").alias("t2")), ["it", "s2"])
    moved = moved.select("it", F.least("t1", "t2").alias("s1"), F.greatest("t1", "t2").alias("s2"), "x")
    null = moved.join(rows.select("s1", "s2", "y"), ["s1", "s2"]).groupBy("it").agg(stat.alias("null"))
    count = F.sum(F.when(F.round("null", 10) <= F.round("stat", 10), 1).otherwise(0))
    return null.join(F.broadcast(observed)).groupBy("stat").agg(((count + 1) / F.lit(n + 1.0)).alias("p"))


# -- PERMANOVA, one factor -----------------------------------------------------------


def permanova_oneway(pairs: DataFrame, groups: DataFrame, n: int = 0, seed: int = 0) -> DataFrame:
    """df, ss, ms, f, r2 of the factor and of the residual, and p: sums of squares
    from squared distances, in all and within groups."""
    g = groups.select("sample", F.col("grp").cast("string").alias("grp")).where("grp is not null")
    moves = permutations(g, n, seed).unionByName(g.select(F.lit(0).cast("long").alias("it"), "sample", F.col("sample").alias("to"))) if n else g.select(F.lit(0).cast("long").alias("it"), "sample", F.col("sample").alias("to"))
    named = moves.join(g.select(F.col("sample").alias("to"), "grp"), "to").select("it", "sample", "grp")
    d2 = pairs.select("s1", "s2", (F.col("value") * F.col("value")).alias("d2"))
    size = named.groupBy("it", "grp").agg(F.count(F.lit(1)).alias("n"))
    inside = d2.join(named.select("it", F.col("sample").alias("s1"), "grp"), "s1").join(named.select("it", F.col("sample").alias("s2"), F.col("grp").alias("grp2")), ["it", "s2"]).where("grp = grp2").groupBy("it", "grp").agg(F.sum("d2").alias("d2"))
    within = size.join(inside, ["it", "grp"], "left").groupBy("it").agg(F.sum(F.coalesce(F.col("d2") / F.col("n"), F.lit(0.0))).alias("ssw"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    rows = within.join(F.broadcast(d2.agg(F.sum("d2").alias("d2"))))
    sst = F.col("d2") / F.col("n")
    rows = rows.select("it", "n", "k", sst.alias("sst"), "ssw", F.try_divide((sst - F.col("ssw")) / (F.col("k") - 1), F.col("ssw") / (F.col("n") - F.col("k"))).alias("f"))
    obs = rows.where("it = 0")
    if n:
        null = rows.where("it > 0").select(F.col("f").alias("fn")).join(F.broadcast(obs.select(F.col("f").alias("fo")))).agg(((F.sum(F.when(F.round("fn", 10) >= F.round("fo", 10), 1).otherwise(0)) + 1) / F.lit(n + 1.0)).alias("p"))
    else:
        null = rows.sparkSession.range(1).select(F.lit(None).cast("double").alias("p"))
    both = obs.join(null)
    terms = F.array(
        F.struct(F.lit("group").alias("term"), (F.col("k") - 1).cast("double").alias("df"), (F.col("sst") - F.col("ssw")).alias("ss"), F.col("f").alias("f"), F.col("p").alias("p")),
        F.struct(F.lit("Residual").alias("term"), (F.col("n") - F.col("k")).cast("double").alias("df"), F.col("ssw").alias("ss"), F.lit(None).cast("double").alias("f"), F.lit(None).cast("double").alias("p")),
    )
    return both.select("sst", F.inline(terms)).select("term", "df", "ss", F.try_divide(F.col("ss"), F.col("df")).alias("ms"), "f", F.try_divide(F.col("ss"), F.col("sst")).alias("r2"), "p")


# -- correlations of metadata ----------------------------------------------------------


def column_kinds(meta: DataFrame, columns: Sequence[str] | None = None, most: int = 20) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns: texts and booleans are categories, and so
    are whole numbers with at most ``most`` values."""
    kinds = dict(meta.dtypes)
    columns = [c for c in meta.columns if c != "sample"] if columns is None else list(columns)
    whole = [c for c in columns if kinds[c] in ("tinyint", "smallint", "int", "bigint")]
    seen = meta.agg(*[F.count_distinct(c).alias(c) for c in whole]).first().asDict() if whole else {}
    categorical = [c for c in columns if kinds[c] in ("string", "boolean") or seen.get(c, most + 1) <= most]
    return [c for c in columns if c not in categorical], categorical


def coding(meta: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """a, b, kind, positive: what the sign of a category and a number's r says;
    of two levels r is positive where the first, in alphabetical order, has the
    larger numbers; eta has no sign."""
    cat = meta.select("sample", *[F.col(c).cast("string").alias(c) for c in categorical]).unpivot("sample", list(categorical), "a", "c").where("c is not null")
    levels = cat.groupBy("a").agg(F.count_distinct("c").alias("n"), F.min("c").alias("first"))
    two = F.col("n") == 2
    return levels.select("a", F.explode(F.array(*map(F.lit, numeric))).alias("b"), F.when(two, "point-biserial").otherwise("eta").alias("kind"), F.when(two, F.col("first")).alias("positive"))


def correlate(meta: DataFrame, columns: Sequence[str] | None = None, kinds: Sequence[str] | None = None, **how) -> DataFrame:
    """``correlations`` of the columns (all but sample), with their kinds, 'num'
    or 'cat', as given or as ``column_kinds`` finds them."""
    if kinds is None:
        numeric, categorical = column_kinds(meta, columns)
    else:
        if columns is None or len(columns) != len(kinds):
            raise ValueError("kinds must match columns")
        numeric, categorical = ([c for c, k in zip(columns, kinds, strict=True) if k == kind] for kind in ("num", "cat"))
    return correlations(meta, numeric, categorical, **how)


def correlations(meta: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), method: str = "spearman", n: int = 0, seed: int = 0) -> DataFrame:
    """a, b, kind, n, r and, with permutations, p and padj, for each pair of
    columns on samples that have both: Pearson or Spearman of numbers, Cramer's
    V of categories (corrected), point-biserial or eta of a category and a number.
    Null with fewer than three samples or where undefined."""
    num = meta.select("sample", *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot("sample", list(numeric), "col", "x").where("x is not null and not isnan(x)") if numeric else None
    cat = meta.select("sample", *[F.col(c).cast("string").alias(c) for c in categorical]).unpivot("sample", list(categorical), "col", "c").where("c is not null") if categorical else None
    spark = meta.sparkSession
    base = spark.range(0, n + 1).select(F.col("id").alias("it"))

    def shuffled(rows: DataFrame, value: str) -> DataFrame:
        """The second column's values permuted among the pair's samples."""
        rows = rows.join(F.broadcast(base))
        within = Window.partitionBy("it", "a", "b")
        place = rows.withColumn("k", F.row_number().over(within.orderBy("sample")))
        drawn = rows.select("it", "a", "b", F.col(value).alias("moved"), F.row_number().over(within.orderBy(F.when(F.col("it") == 0, F.lit("")).otherwise(key(F.lit(seed), "it", "a", "b", "sample")), "sample")).alias("k"))
        return place.drop(value).join(drawn, ["it", "a", "b", "k"]).withColumnRenamed("moved", value)

    parts = []
    if num is not None:
        a, b = num.select("sample", F.col("col").alias("a"), F.col("x")), num.select("sample", F.col("col").alias("b"), F.col("x").alias("y"))
        rows = shuffled(a.join(b, "sample").where("a < b"), "y")
        if method == "spearman":
            rows = rows.withColumn("x", average_rank("x", "it", "a", "b")).withColumn("y", average_rank("y", "it", "a", "b"))
        value = F.when((F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0), F.corr("x", "y"))
        parts.append(rows.groupBy("it", "a", "b").agg(F.count(F.lit(1)).alias("n"), value.alias("r")).withColumn("kind", F.lit(method)))
    if num is not None and cat is not None:
        rows = shuffled(cat.select("sample", F.col("col").alias("a"), "c").join(num.select("sample", F.col("col").alias("b"), F.col("x").alias("y")), "sample"), "y")
        cells = rows.groupBy("it", "a", "b", "c").agg(F.count(F.lit(1)).alias("m"), F.sum("y").alias("s"))
        whole = rows.groupBy("it", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd"), F.var_pop("y").alias("var"), F.min("c").alias("low"))
        each = cells.join(whole, ["it", "a", "b"]).withColumn("mean_c", F.col("s") / F.col("m"))
        agg = each.groupBy("it", "a", "b", "n", "sd", "var").agg(
            F.count(F.lit(1)).alias("levels"), F.min("m").alias("least"), F.sum(F.col("m") * F.pow(F.col("mean_c") - F.col("mean"), F.lit(2.0))).alias("ssb"),
            F.max(F.when(F.col("c") == F.col("low"), F.col("mean_c"))).alias("m1"), F.max(F.when(F.col("c") != F.col("low"), F.col("mean_c"))).alias("m2"), F.max(F.when(F.col("c") == F.col("low"), F.col("m"))).alias("n1"),
        )
        two = F.when((F.col("least") >= 2) & (F.col("sd") > 0), (F.col("m1") - F.col("m2")) / F.col("sd") * F.sqrt(F.col("n1") * (F.col("n") - F.col("n1")) / (F.col("n") * F.col("n")).cast("double")))
        eta = F.when(F.col("var") > 0, F.sqrt(F.col("ssb") / (F.col("var") * F.col("n"))))
        r = F.when(F.col("levels") == 2, two).when(F.col("levels") > 2, eta)
        parts.append(agg.select("it", "a", "b", "n", r.alias("r"), F.when(F.col("levels") == 2, F.lit("point-biserial")).otherwise(F.lit("eta")).alias("kind")))
    if cat is not None and len(categorical) > 1:
        a, b = cat.select("sample", F.col("col").alias("a"), F.col("c").alias("x")), cat.select("sample", F.col("col").alias("b"), F.col("c").alias("y"))
        rows = shuffled(a.join(b, "sample").where("a < b"), "y")
        keys = ["it", "a", "b"]
        n_ = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("x").alias("rr"), F.countDistinct("y").alias("kk"))
        xs, ys = rows.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("nx")), rows.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("ny"))
        seen = rows.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("o"))
        # Empty cells add their expectation, so the sum is over o^2 / e alone, less n.
        chi = seen.join(xs, [*keys, "x"]).join(ys, [*keys, "y"]).groupBy(*keys).agg(F.sum(F.col("o") * F.col("o") / (F.col("nx") * F.col("ny")).cast("double")).alias("q"))
        t = n_.join(chi, keys)
        m = F.greatest(F.lit(1), F.col("n") - 1)
        phi = F.greatest(F.lit(0.0), F.col("q") - 1 - (F.col("kk") - 1) * (F.col("rr") - 1) / m)
        rc, kc = F.col("rr") - F.pow(F.col("rr") - 1, F.lit(2.0)) / m, F.col("kk") - F.pow(F.col("kk") - 1, F.lit(2.0)) / m
        v = F.when((F.col("rr") >= 2) & (F.col("kk") >= 2), F.sqrt(phi / F.greatest(F.lit(1e-12), F.least(rc - 1, kc - 1))))
        parts.append(t.select(*keys, "n", v.alias("r"), F.lit("cramers-v").alias("kind")))
    rows = parts[0].select("it", "a", "b", "n", "r", "kind")
    for p in parts[1:]:
        rows = rows.unionByName(p.select("it", "a", "b", "n", "r", "kind"))
    rows = rows.withColumn("r", F.when(F.col("n") >= 3, F.col("r")))
    obs = rows.where("it = 0").select("a", "b", "kind", "n", "r")
    if not n:
        return obs
    null = rows.where("it > 0").select("a", "b", F.col("r").alias("rn")).join(obs.select("a", "b", F.col("r").alias("ro")), ["a", "b"])
    p = null.groupBy("a", "b").agg(F.when(F.first("ro").isNotNull(), (F.sum(F.when(F.round(F.abs("rn"), 10) >= F.round(F.abs("ro"), 10), 1).otherwise(0)) + 1) / F.lit(n + 1.0)).alias("p"))
    return benjamini_hochberg(obs.join(p, ["a", "b"], "left"))


def benjamini_hochberg(rows: DataFrame, p: str = "p") -> DataFrame:
    """With padj: p-values adjusted for their number; nulls stay null."""
    known = rows.where(F.col(p).isNotNull())
    every = Window.partitionBy()
    # A row for each pair of columns: few, however many samples there are.
    ranked = known.withColumn("_rank", F.row_number().over(Window.orderBy(p, "a", "b"))).withColumn("_m", F.count(F.lit(1)).over(every))
    adjusted = ranked.withColumn("padj", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(Window.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)))).drop("_rank", "_m")
    return adjusted.unionByName(rows.where(F.col(p).isNull()).withColumn("padj", F.lit(None).cast("double")))


# -- bootstrap of within and between distances -------------------------------------------


def bootstrap(pairs: DataFrame, meta: DataFrame, by: Sequence[str] | str, n: int = 1000, alpha: float = 0.05, seed: int = 0, return_boot: bool = False) -> DataFrame:
    """factor, part (within or between), mean, lo, hi, pairs: samples redrawn
    within crossed cells and told apart once, means over pairs of samples, and
    their percentiles over the redraws. With several factors 'Crossed' has cells.
    ``return_boot``: boot, factor, part, mean, pairs of each redraw instead."""
    by = [by] if isinstance(by, str) else list(by)
    cells = meta.select("sample", *[F.col(c).cast("string").alias(c) for c in by]).where(" and ".join(f"`{c}` is not null" for c in by))
    cells = cells.withColumn("Crossed", F.concat_ws("|", *by))
    within = Window.partitionBy("Crossed")
    cells = cells.withColumn("k", F.row_number().over(within.orderBy("sample")) - 1).withColumn("m", F.count(F.lit(1)).over(within))
    boots = meta.sparkSession.range(1, n + 1).select(F.col("id").alias("boot"))
    draws = cells.select("Crossed", "m", F.col("k").alias("draw")).join(boots).withColumn("k", F.floor(uniform(F.lit(seed), "boot", "Crossed", "draw") * F.col("m")).cast("int"))
    drawn = draws.select("boot", "Crossed", "k").distinct().join(cells.drop("m"), ["Crossed", "k"]).drop("k")
    names = [*by, *(["Crossed"] if len(by) > 1 else [])]
    one, two = drawn.select("boot", F.col("sample").alias("s1"), *[F.col(c).alias(f"{c}_1") for c in names]), drawn.select("boot", F.col("sample").alias("s2"), *[F.col(c).alias(f"{c}_2") for c in names])
    rows = pairs.join(one, "s1").join(two, ["boot", "s2"])
    tests = F.array(*[F.struct(F.lit(c).alias("factor"), F.when(F.col(f"{c}_1") == F.col(f"{c}_2"), F.lit("within")).otherwise(F.lit("between")).alias("part")) for c in names])
    each = rows.select("boot", "value", F.inline(tests)).groupBy("boot", "factor", "part").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("pairs"))
    if return_boot:
        return each
    q = F.percentile("mean", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return each.groupBy("factor", "part").agg(F.avg("mean").alias("mean"), q[0].alias("lo"), q[1].alias("hi"), F.floor(F.sum("pairs") / F.lit(n)).alias("pairs"))
