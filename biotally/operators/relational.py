"""Selecting, merging, renaming and thinning abundance tables.

Tables: tab (feature, sample, value > 0), meta (sample, ...), tax (feature,
ranks ...). Dropping absent features needs no step here: zeros are not rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import digests
from ..functions.rng import uniform


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once: in the checkpoint folder, if the session has one, or
    held by the executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None and (folder := df.sparkSession.conf.get("spark.checkpoint.dir", None)):
        sc.setCheckpointDir(folder)
    return df.checkpoint() if sc.getCheckpointDir() else df.persist()


#: Rows of a task, about, where tables say how many tasks they ask for.
ROWS = 1 << 18


def tasks_for(df: DataFrame) -> int:
    """How many tasks the rows of ``df`` ask for, the session's number at least.
    Rows are counted, so ``df`` should be as it is read."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS))


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to ``tasks``, so that a task's rows and memory do
    not grow with the table; without a number as the session deals."""
    return df if tasks is None else df.repartition(tasks, *keys)


def running(df: DataFrame, name: str, order: Sequence[Column | str], value: str | None = None, op: str = "sum") -> DataFrame:
    """``df`` with the sum (or the least: ``op`` min) of ``value`` over all rows up
    to and with each one in a global order; without ``value``, its place from 1.

    Rows are dealt to partitions by ranges of the order and sorted there; what
    the partitions before one amount to, a number each, is added. No task has
    more than a range. ``order`` should tell rows apart, as equal ones go to one
    range."""
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = settled(rows).withColumn("_part", F.shiftright("_id", 33))
    add = {"sum": lambda x, y: x + y, "min": F.least}[op]
    if value is None:
        rows = rows.withColumn(name, F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
        parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("own"))
    else:
        whole = {"sum": F.sum, "min": F.min}[op]
        rows = rows.withColumn(name, whole(value).over(Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)))
        parts = rows.groupBy("_part").agg(whole(value).alias("own"))
    before, total = [], None
    for part, own in sorted((r["_part"], r["own"]) for r in parts.collect()):  # a row a partition
        before.append((part, total))
        total = own if total is None else total + own if op == "sum" else min(total, own)
    kind = rows.schema[name].dataType.simpleString()
    offsets = spark.createDataFrame(before, f"_part long, _before {kind}")
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.when(F.col("_before").isNull(), F.col(name)).otherwise(add(F.col(name), F.col("_before")))).drop("_part", "_id", "_before")


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with the place of each row, from 1, in a global order."""
    return running(df, name, order)


def average_ranks(df: DataFrame, value: str, name: str, *ties: str) -> DataFrame:
    """``df`` with each value's rank among all; equal values share their mean
    place. ``ties`` tell rows of equal values apart, so that they can be dealt.
    Values are computed once: sums of doubles made again may differ in their last
    bit, and would not meet their own ranks."""
    df = settled(df)
    places = numbered(df.select(value, *ties), name, value, *ties).groupBy(value).agg(F.avg(name).alias(name))
    return df.join(places, value)


def natural_key(name: Column) -> Column:
    """Sorts ids with their numbers as numbers and before letters; texts without case."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))

    def part(p: Column) -> Column:
        digits = p.rlike(r"^\d+$")
        return F.struct((~digits).cast("int").alias("kind"), F.when(digits, p.cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")).alias("number"), F.when(digits, F.lit("")).otherwise(F.lower(p)).alias("text"))

    return F.transform(parts, part)


def with_order(features: DataFrame, name: str = "feature") -> DataFrame:
    """The ids with ord, their place in natural order."""
    return numbered(features.select(name).distinct(), "ord", natural_key(F.col(name)), name)


def subset_samples(tab: DataFrame, meta: DataFrame, by: str = "index", values: Sequence | None = None, exclude: bool = False) -> tuple[DataFrame, DataFrame]:
    """(tab, meta) of the chosen samples: by id or by a column's values (all that
    are not null, without values). ``exclude`` takes the others, nulls included."""
    col = F.col("sample" if by == "index" else by)
    chosen = col.isNotNull() if values is None else F.coalesce(col.isin(list(values)), F.lit(False))
    kept = meta.where(~chosen if exclude else chosen)
    return tab.join(kept.select("sample"), "sample", "left_semi"), kept


def subset_features(tab: DataFrame, features: DataFrame, exclude: bool = False, tasks: int | None = None) -> DataFrame:
    """Rows of the listed features (a column feature), or of the others."""
    return dealt(tab, tasks, "feature").join(features.select("feature").distinct(), "feature", "left_anti" if exclude else "left_semi")


def abundance_scores(tab: DataFrame, method: str = "sum") -> DataFrame:
    """feature, score in percent; means and frequencies are over all samples."""
    p = tab.where("value > 0").withColumn("p", F.col("value") / F.sum("value").over(Window.partitionBy("sample")))
    agg = {"sum": F.sum("p"), "mean": F.sum("p"), "max": F.max("p"), "frequency": F.count(F.lit(1)).cast("double")}
    if method not in agg:
        raise ValueError("method is sum, mean, max or frequency")
    rows = p.groupBy("feature").agg(agg[method].alias("score"))
    if method in ("mean", "frequency"):
        n = tab.agg(F.countDistinct("sample").alias("n"))  # one row
        rows = rows.join(F.broadcast(n)).select("feature", (F.col("score") / F.col("n")).alias("score"))
    return rows.select("feature", (F.col("score") * 100).alias("score"))


def subset_abundant(tab: DataFrame, n: int = 25, method: str = "sum", cutoff: float | None = None, exclude: bool = False) -> DataFrame:
    """Rows of the n best features by score, ties by id, or of those that reach a cutoff."""
    scores = abundance_scores(tab, method)
    top = scores.where(F.col("score") >= cutoff) if cutoff is not None else scores.withColumn("score", F.round("score", 10)).orderBy(F.desc("score"), "feature").limit(n)
    return subset_features(tab, top, exclude)


def taxa_match(tax: DataFrame, patterns: Sequence[str] | str, levels: Sequence[str] | str | None = None, *, case: bool = False, regex: bool = False, na: bool = False, match_type: str = "contains") -> Column:
    """Whether any level matches any pattern; blanks are null and match if ``na``."""
    patterns = [patterns] if isinstance(patterns, str) else list(patterns)
    if not patterns:
        raise ValueError("patterns must not be empty")
    names = {c.lower(): c for c in tax.columns if c != "feature"}
    wanted = list(names) if levels is None else [x.lower() for x in ([levels] if isinstance(levels, str) else levels)]
    if missing := [x for x in wanted if x not in names]:
        raise ValueError(f"no such levels: {missing}")
    union = "|".join(p if regex else "".join("\\" + c if not (c.isalnum() or c in "_ ") else c for c in p) for p in patterns)
    shape = {"contains": "(?:{})", "fullmatch": "^(?:{})$", "startswith": "^(?:{})", "endswith": "(?:{})$"}[match_type]
    pattern = ("" if case else "(?i)") + shape.format(union)
    out = F.lit(False)
    for level in wanted:
        c = F.col(names[level])
        out = out | F.when(c.isNull() | c.rlike(r"^\s*$"), F.lit(na)).otherwise(c.rlike(pattern))
    return out


def subset_taxa(tab: DataFrame, tax: DataFrame, patterns: Sequence[str] | str, levels: Sequence[str] | str | None = None, *, exclude: bool = False, allow_empty: bool = True, tasks: int | None = None, **how) -> DataFrame:
    """Rows of the features whose taxonomy matches, or of the others. Without
    ``allow_empty`` it raises if no feature is left, which takes an action."""
    mask = taxa_match(tax, patterns, levels, **how)
    out = subset_features(tab, tax.where(~mask if exclude else mask), tasks=tasks)
    if not allow_empty and out.isEmpty():
        raise ValueError("no features are left")
    return out


def group_key(by: Sequence[str]) -> Column:
    return F.col(by[0]).cast("string") if len(by) == 1 else F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in by])


def merge_samples(tab: DataFrame, meta: DataFrame, by: Sequence[str] | str, values: Sequence | None = None, method: str = "sum", weight: str | None = None, tasks: int | None = None) -> DataFrame:
    """tab of merged samples. Means divide by all samples of a group; weights
    are scaled to 1 within a group, whose total must not be zero."""
    by = [by] if isinstance(by, str) else list(by)
    m = meta
    if values is not None:
        mask = F.lit(False)
        for c in by:
            mask = mask | F.coalesce(F.col(c).cast("string").isin([str(v) for v in values]), F.lit(False))
        m = m.where(mask)
    m = m.select("sample", group_key(by).alias("grp"), *([F.col(weight).cast("double").alias("w")] if weight else [])).where("grp is not null")
    if weight:
        total = F.sum("w").over(Window.partitionBy("grp"))
        m = m.withColumn("w", F.when(total != 0, F.col("w") / total).otherwise(F.raise_error(F.lit("a group has a total weight of zero")).cast("double")))
        value = F.sum(F.col("value") * F.col("w"))
    elif method == "sum":
        value = F.sum("value")
    elif method == "mean":
        m = m.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("grp")))
        value = F.sum(F.col("value") / F.col("n"))
    else:
        raise ValueError("method is sum or mean")
    rows = dealt(dealt(tab, tasks, "sample").join(m, "sample"), tasks, "feature", "grp")
    return rows.groupBy("feature", F.col("grp").alias("sample")).agg(value.alias("value")).where("value > 0")


def merge_meta(meta: DataFrame, by: Sequence[str] | str, method: str = "sum") -> DataFrame:
    """meta of merged samples: numbers by ``method``, others the first sample's."""
    by = [by] if isinstance(by, str) else list(by)
    kinds = dict(meta.dtypes)
    number = re.compile("^(tinyint|smallint|int|bigint|float|double|decimal)")
    cols = [c for c in meta.columns if c != "sample" and c not in by]
    aggs = [(F.sum(c) if method == "sum" else F.avg(c)).alias(c) if number.match(kinds[c]) else F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("sample"))).alias(c) for c in cols]
    return meta.groupBy(group_key(by).alias("sample")).agg(F.count(F.lit(1)).alias("n_samples"), *aggs)


def rename_map(tab: DataFrame, name_type: str = "OTU") -> DataFrame:
    """feature -> new name by rank of mean relative abundance, ties by id."""
    scores = abundance_scores(tab, "sum").withColumn("score", F.round("score", 10))
    return numbered(scores, "n", F.desc("score"), "feature").select("feature", F.concat(F.lit(name_type), F.col("n").cast("string")).alias("new"))


def rename_features(tab: DataFrame, mapping: DataFrame) -> DataFrame:
    """Any table with a feature column, renamed by (feature, new)."""
    cols = [F.coalesce("new", "feature").alias("feature") if c == "feature" else F.col(c) for c in tab.columns]
    return tab.join(mapping, "feature", "left").select(*cols)


def summarize_taxa(tab: DataFrame, tax: DataFrame, tasks: int | None = None) -> DataFrame:
    """sample (and Total), features, reads and distinct taxa by rank."""
    ranks = [c for c in tax.columns if c != "feature"]
    counts = [F.count_distinct(c).alias(c) for c in ranks]
    rows = dealt(dealt(tab.where("value > 0"), tasks, "feature").join(tax, "feature", "left"), tasks, "sample")
    each = rows.groupBy("sample").agg(F.count(F.lit(1)).alias("features"), F.sum("value").alias("reads"), *counts)
    names = tax.agg(F.count(F.lit(1)).alias("features"), *counts)
    total = names.join(tab.agg(F.sum("value").alias("reads"))).select(F.lit("Total").alias("sample"), "features", "reads", *ranks)
    return each.unionByName(total)


def summary(tab: DataFrame) -> DataFrame:
    """features, samples, total, and smallest and largest sample."""
    each = tab.groupBy("sample").agg(F.sum("value").alias("v"))
    sizes = each.agg(F.count(F.lit(1)).alias("samples"), F.sum("v").alias("total"), F.min("v").alias("smallest"), F.max("v").alias("largest"))
    return sizes.join(tab.agg(F.countDistinct("feature").alias("features"))).select("features", "samples", "total", "smallest", "largest")


def faults(tab: DataFrame, tax: DataFrame | None = None, tree: DataFrame | None = None) -> DataFrame:
    """rule, id: what breaks the rules that tables must keep."""
    out = tab.groupBy("feature", "sample").count().where("count > 1").select(F.lit("repeated cell").alias("rule"), F.concat_ws("/", "feature", "sample").alias("id"))
    ids = tab.select("feature").distinct()
    if tax is not None:
        out = out.unionByName(ids.join(tax, "feature", "left_anti").select(F.lit("feature without taxonomy").alias("rule"), F.col("feature").alias("id")))
        out = out.unionByName(tax.groupBy("feature").count().where("count > 1").select(F.lit("repeated feature").alias("rule"), F.col("feature").alias("id")))
    if tree is not None:
        nodes = tree.select(F.col("node").alias("feature"))
        out = out.unionByName(ids.join(nodes, "feature", "left_anti").select(F.lit("feature outside of the tree").alias("rule"), F.col("feature").alias("id")))
        lost = tree.where("parent is not null").select(F.col("parent").alias("feature")).distinct().join(nodes, "feature", "left_anti")
        out = out.unionByName(lost.select(F.lit("parent that does not exist").alias("rule"), F.col("feature").alias("id")))
    return out


# -- thinning -------------------------------------------------------------------


def reads(tab: DataFrame) -> DataFrame:
    """One row for each read: feature, sample, i from 1."""
    whole = tab.withColumn("value", F.floor("value").cast("long")).where("value > 0")
    return whole.select("feature", "sample", F.explode(F.sequence(F.lit(1).cast("long"), F.col("value"))).alias("i"))


#: Parts of a sample's random order, by the first two hexadecimal digits of its
#: reads' keys.
PARTS = 256
#: Reads of a cell that are made in one row's place, and reads of a task, about.
CHUNK = 1 << 16
TASK = 1 << 22


def _dealt(tab: DataFrame) -> tuple[DataFrame, int]:
    """(feature, sample, c, value), tasks: cells in chunks of reads, those of a
    sample and place side by side, on so many tasks as their reads ask for. Small
    tables of many reads would be one task otherwise."""
    cells = tab.select("feature", "sample", F.floor("value").cast("long").alias("value")).where("value > 0")
    total = cells.agg(F.sum("value").alias("n")).first()["n"] or 0
    tasks = max(int(tab.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-total // TASK), 1 << 14))
    return cells.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(value - 1) div {CHUNK}")))).repartition(tasks, "sample", "c"), tasks


#: Reads that are keyed at once.
KEYED = 1 << 18


def _keyed(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of chunks (sample, feature, c, value), the place of each read's chunk, its i
    from 1 and its key's 16 bytes: the random order of a sample's reads (then
    feature and i). The first byte is its part of the order."""
    names = [f"{seed}:{':'.join(str(x) for x in r if x is not None)}:".encode() for r in zip(batch.column("sample").to_pylist(), batch.column("feature").to_pylist(), strict=True)]
    c, value = (batch.column(x).to_numpy() for x in ("c", "value"))
    n = np.minimum(value - c * CHUNK, CHUNK)
    ends = np.cumsum(n)
    for begin in range(0, int(ends[-1]) if len(n) else 0, KEYED):
        at = np.arange(begin, min(begin + KEYED, int(ends[-1])))
        which = np.searchsorted(ends, at, side="right")
        i = at - (ends - n)[which] + c[which] * CHUNK + 1
        yield which, i, digests.numbered(names, which, i)


def _part_sizes(chunks: DataFrame, seed: int) -> DataFrame:
    """sample, part, m: reads by part of their sample's order, a chunk's batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples = batch.column("sample").dictionary_encode()
            code = samples.indices.fill_null(len(samples.dictionary)).to_numpy().astype(np.int64)
            m = np.zeros((len(samples.dictionary) + 1) * PARTS, dtype=np.int64)
            for which, _, keys in _keyed(batch, seed):
                m += np.bincount(code[which] * PARTS + keys[:, 0], minlength=len(m))
            at = np.flatnonzero(m)
            names = pa.concat_arrays([samples.dictionary, pa.nulls(1, samples.dictionary.type)])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at // PARTS)), pa.array((at % PARTS).astype(np.int32)), pa.array(m[at])], names=["sample", "part", "m"])

    return chunks.select("sample", "feature", "c", "value").mapInArrow(run, f"sample {dict(chunks.dtypes)['sample']}, part int, m long").groupBy("sample", "part").agg(F.sum("m").alias("m"))


def _near(chunks: DataFrame, seed: int) -> DataFrame:
    """sample, end, feature, key, n of chunks with ``ends``, parts in ascending
    order: a read's end is the first that its part does not pass. Reads between
    two ends are given by number, those of a part with an end by their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = batch.column("ends")
            flat = np.repeat(np.arange(batch.num_rows), ends.value_lengths().to_numpy()) * PARTS + ends.flatten().to_numpy()
            flat = np.append(flat, batch.num_rows * PARTS)
            for which, i, keys in _keyed(batch, seed):
                part = keys[:, 0].astype(np.int64)
                end = flat[np.searchsorted(flat, which * PARTS + part)] - which * PARTS  # another row's: none
                own = np.flatnonzero(end == part)
                between = np.flatnonzero((end < PARTS) & (end != part))
                first = int(which[0])
                cell, n = np.unique((which[between] - first) * PARTS + end[between], return_counts=True)
                row = np.concatenate([cell // PARTS + first, which[own]])
                to = np.concatenate([cell % PARTS, end[own]]).astype(np.int32)
                text = keys[own].tobytes().hex()
                k = pa.array([None] * len(cell) + [text[x : x + 32] for x in range(0, len(text), 32)], pa.string())
                at = pa.array(np.concatenate([np.zeros(len(cell), dtype=np.int64), i[own]]))
                count = pa.array(np.concatenate([n, np.ones(len(own), dtype=np.int64)]))
                yield pa.RecordBatch.from_arrays([batch.column("sample").take(pa.array(row)), pa.array(to), batch.column("feature").take(pa.array(row)), k, at, count], names=["sample", "end", "feature", "k", "i", "n"])

    kinds = dict(chunks.dtypes)
    rows = chunks.select("sample", "feature", "c", "value", "ends").mapInArrow(run, f"sample {kinds['sample']}, end int, feature {kinds['feature']}, k string, i long, n long")
    return rows.select("sample", "end", "feature", F.when(F.col("k").isNotNull(), F.struct("k", "i")).alias("key"), "n")


def first_reads(tab: DataFrame, depths: DataFrame, seed: int, totals: DataFrame | None = None) -> DataFrame:
    """sample, depth, feature, n: how often a feature is among the ``depth``
    first reads of the sample's random order. ``depths`` has sample and depth,
    any number of them a sample, none above its reads.

    A sample of at most ``thinning.WHOLE`` reads is one row, whose reads are keyed
    and sorted in their task: nothing of a read is shuffled, and of the table its
    cells, if it is not dealt by samples. ``tab`` is read several times; ``totals``
    (``sample_depths``) spare one of them."""
    from . import thinning

    cells = tab.select("sample", "feature", F.floor("value").cast("long").alias("value")).where("value > 0")
    large = (sample_depths(tab.where("value > 0")) if totals is None else totals).where(F.col("total") > thinning.WHOLE).select("sample")
    small = cells
    if some := not large.isEmpty():
        large = settled(large)
        small = cells.join(large, "sample", "left_anti")
    wanted = depths.where("depth > 0").select("sample", F.col("depth").cast("long").alias("depth")).groupBy("sample").agg(F.sort_array(F.collect_set("depth")).alias("depths"))
    lists = small.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("feature", "value"))).alias("items")).join(wanted, "sample")
    out = thinning.in_order(lists.select("sample", F.col("items.feature").alias("names"), F.col("items.value").alias("counts"), "depths"), seed, keys=True)
    return out.unionByName(_first_by_parts(tab.join(large, "sample", "left_semi"), depths.join(large, "sample", "left_semi"), seed)) if some else out


def _first_by_parts(tab: DataFrame, depths: DataFrame, seed: int) -> DataFrame:
    """``first_reads`` of samples that are too large for a task.

    Reads are counted by part of the order, which says in which parts depths
    fall. Reads of the parts between are counted where they are made, once for
    all depths; only those of parts with a depth are ranked, once each. Every
    read is thus of the first depth that reaches it, and depths add up.
    """
    chunks, tasks = _dealt(tab)
    m = F.col("m")
    sizes = _part_sizes(chunks, seed)
    sizes = sizes.select("sample", "part", (F.sum("m").over(Window.partitionBy("sample").orderBy("part")) - m).alias("lo"))
    # A row for each sample and part, and one for each sample and depth.
    wanted = depths.where("depth > 0").select("sample", F.col("depth").cast("long").alias("depth")).distinct()
    cuts = sizes.select("sample", F.col("lo").alias("at"), F.struct("part", "lo").alias("cut"), F.lit(None).cast("long").alias("depth"))
    both = cuts.unionByName(wanted.select("sample", (F.col("depth") - 1).alias("at"), F.lit(None).cast(cuts.schema["cut"].dataType).alias("cut"), "depth"))
    order = Window.partitionBy("sample").orderBy("at", F.col("cut").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("cut", F.last("cut", ignorenulls=True).over(order)).where("depth is not null and cut is not null")
    last = last.groupBy("sample", F.col("cut.part").alias("end")).agg(F.sort_array(F.collect_list(F.struct((F.col("depth") - F.col("cut.lo")).alias("rest"), "depth"))).alias("marks"))
    # Parts with depths, and the first depth of the next such part.
    last = settled(last.withColumn("after", F.lead(F.col("marks")[0]["depth"]).over(Window.partitionBy("sample").orderBy("end"))))
    ends = last.groupBy("sample").agg(F.sort_array(F.collect_list("end")).alias("ends"))
    most = tab.groupBy("sample").agg(F.max(F.expr(f"(floor(value) - 1) div {CHUNK}")).cast("long").alias("most")).where("most >= 0")
    ends = ends.join(most, "sample").select("sample", "ends", F.explode(F.sequence(F.lit(0).cast("long"), "most")).alias("c")).repartition(tasks, "sample", "c")
    # One more pass: reads between add up where they are made, those of a part
    # with a depth keep their key.
    near = _near(chunks.join(ends, ["sample", "c"]), seed)
    counted = settled(near.groupBy("sample", "end", "feature", "key").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("sample", "end").orderBy("key.k", "feature", "key.i")
    ranked = counted.where("key is not null").withColumn("rank", F.row_number().over(order)).join(last, ["sample", "end"])
    first = F.coalesce(F.get(F.filter("marks", lambda x: x["rest"] >= F.col("rank")), F.lit(0))["depth"], "after")
    placed = ranked.select("sample", "feature", first.alias("depth"), "n").where("depth is not null")
    before = counted.where("key is null").join(last, ["sample", "end"]).select("sample", "feature", F.col("marks")[0]["depth"].alias("depth"), "n")
    sums = before.unionByName(placed).groupBy("sample", "feature", "depth").agg(F.sum("n").alias("n"))
    own = sums.groupBy("sample", "feature").agg(F.collect_list(F.struct("depth", "n")).alias("own"))
    every = last.select("sample", F.explode("marks").alias("mark")).groupBy("sample").agg(F.collect_list("mark.depth").alias("depths"))
    total = lambda d: F.aggregate(F.filter("own", lambda x: x["depth"] <= d), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    rows = own.join(every, "sample").withColumn("x", F.explode(F.transform("depths", lambda d: F.struct(d.alias("depth"), total(d).alias("n")))))
    return rows.where("x.n > 0").select("sample", "x.depth", "feature", F.col("x.n").cast("double").alias("n"))


def sample_depths(tab: DataFrame) -> DataFrame:
    return tab.withColumn("value", F.floor("value").cast("long")).groupBy("sample").agg(F.sum("value").alias("total"))


def interval_hits(draws: DataFrame, cells: DataFrame, keys: list[str], keep_at: bool = False) -> DataFrame:
    """keys, feature, n (and at, if kept): the draws (keys, at, n), each with the feature of the
    interval it falls into. ``cells`` has keys, feature, lo; intervals of a key
    follow each other without gaps. One sort of both, not a join by range."""
    starts = cells.select(*keys, F.col("lo").cast(draws.schema["at"].dataType).alias("at"), F.lit(0).cast("long").alias("n"), "feature")
    both = starts.unionByName(draws.select(*keys, "at", F.col("n").cast("long").alias("n"), F.lit(None).cast("string").alias("feature")))
    order = Window.partitionBy(*keys).orderBy("at", F.col("feature").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("feature", F.last("feature", ignorenulls=True).over(order)).where("n > 0").select(*keys, "feature", "n", *(["at"] if keep_at else []))


def drawn_reads(tab: DataFrame, depths: DataFrame, seed: int, method: str, totals: DataFrame | None = None) -> DataFrame:
    """sample, depth, feature, n, by the order of the reads' keys (``reads``,
    a row a read while counting) or on counts (``counts``)."""
    from .thinning import drawn

    if method not in ("reads", "counts"):
        raise ValueError("method is reads or counts")
    return drawn(tab, depths, seed) if method == "counts" else first_reads(tab, depths, seed, totals)


def rarefy(tab: DataFrame, depth: int | str = "min", seed: int = 0, replacement: bool = False, method: str = "reads") -> DataFrame:
    """The table thinned to ``depth`` reads a sample; smaller samples go. Without
    replacement, ``method`` "counts" draws on counts, in work that follows the
    table's cells and not its reads."""
    tab = settled(tab) if method == "counts" and not replacement else tab
    totals = settled(sample_depths(tab))
    least = totals.agg(F.min("total").alias("depth")) if depth == "min" else tab.sparkSession.range(1).select(F.lit(int(depth)).cast("long").alias("depth"))
    kept = totals.join(F.broadcast(least)).where("total >= depth")  # one row of depth
    if not replacement:
        return drawn_reads(tab, kept.select("sample", "depth"), seed, method, totals).select("feature", "sample", F.col("n").alias("value"))
    cells = tab.withColumn("value", F.floor("value").cast("long")).where("value > 0")
    hi = F.sum("value").over(Window.partitionBy("sample").orderBy("feature"))
    cells = cells.select("feature", "sample", (hi - F.col("value")).alias("lo"))
    draws = kept.select("sample", "total", F.explode(F.sequence(F.lit(1).cast("long"), F.col("depth"))).alias("i"))
    draws = draws.select("sample", F.floor(uniform(F.lit(seed), "sample", "i") * F.col("total")).alias("at"))
    hit = interval_hits(draws.groupBy("sample", "at").agg(F.count(F.lit(1)).alias("n")), cells, ["sample"])
    return hit.groupBy("feature", "sample").agg(F.sum("n").cast("double").alias("value"))


def rarefaction_curve(tab: DataFrame, q: float = 1, seed: int = 0, steps: int = 20, method: str = "reads", *, div_type: str = "naive", tree: DataFrame | None = None, node_leaf: DataFrame | None = None, distmat: DataFrame | None = None) -> DataFrame:
    """sample, depth, d at every total // steps reads, at all reads, and at 0 and
    1 (where d is 0 and 1); d is null where a number is not defined, as of one
    feature by its distances."""
    from .alpha import func_alpha, naive_alpha, phyl_alpha

    kinds = {"naive": lambda x, *by: naive_alpha(x, q, by=("sample", *by)), "phyl": lambda x: phyl_alpha(x, tree, node_leaf, q), "func": lambda x: func_alpha(x, distmat, q)}
    if div_type not in kinds:
        raise ValueError("div_type is naive, phyl or func")
    number = kinds[div_type]
    tab = settled(tab) if method == "counts" else tab
    totals = settled(sample_depths(tab)).withColumn("step", F.greatest(F.lit(1), F.floor(F.col("total") / steps))).where("total > 0")
    grid = totals.where("step < total").select("sample", F.explode(F.sequence("step", F.col("total") - 1, F.col("step"))).alias("depth"))
    counts = drawn_reads(tab, grid, seed, method, totals).withColumnRenamed("n", "value")
    if div_type == "naive":
        at = number(counts, "depth")
    else:
        keyed = counts.select("feature", F.concat_ws("\u0001", "sample", F.col("depth").cast("string")).alias("sample"), "value")
        at = number(keyed).select(F.split("sample", "\u0001")[0].alias("sample"), F.split("sample", "\u0001")[1].cast("long").alias("depth"), "d")
    full = number(tab.withColumn("value", F.floor("value"))).join(totals, "sample", "right").select("sample", F.col("total").alias("depth"), "d")
    if div_type != "naive":  # these say nothing of what they do not define
        at = grid.join(at, ["sample", "depth"], "left").select("sample", "depth", "d")
    start = totals.select("sample", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0.0).alias("d")), F.struct(F.lit(1).cast("long").alias("depth"), F.lit(1.0).alias("d")))).alias("x")).select("sample", "x.depth", "x.d")
    return at.unionByName(full).unionByName(start)


def octave(tab: DataFrame) -> DataFrame:
    """sample, k, n: features with 2^k to 2^(k+1) reads, zeros included."""
    rows = tab.where("value > 0").withColumn("k", F.floor(F.log2("value")).cast("int"))
    span = rows.agg(F.least(F.min("k"), F.lit(0)).alias("lo"), F.max("k").alias("hi"))
    grid = rows.select("sample").distinct().join(F.broadcast(span)).select("sample", F.explode(F.sequence("lo", "hi")).alias("k"))
    return grid.join(rows.groupBy("sample", "k").agg(F.count(F.lit(1)).alias("n")), ["sample", "k"], "left").select("sample", "k", F.coalesce("n", F.lit(0)).alias("n"))
