"""Several data sets over the same sequences: align, consensus, merge.

A data set is a dict with seq (feature, seq), tab (feature, sample, value) and,
if it has them, tax (feature, ranks) and meta (sample, ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import natural_key, numbered, settled
from .sequences import banded_column, containments


def _numbered(objects: list[dict]) -> DataFrame:
    """obj, ord, feature, seq: features by object, in natural order within each."""
    out = None
    for k, o in enumerate(objects):
        rows = o["seq"].select(F.lit(k).alias("obj"), "feature", "seq")
        out = rows if out is None else out.unionByName(rows)
    return numbered(out, "ord", "obj", natural_key(F.col("feature")), "feature", "seq")


def sequence_names(objects: list[dict], name_type: str = "SV", different_lengths: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """seq, new, canonical: a name for each distinct sequence, by where it is
    first seen. With ``different_lengths`` a sequence that holds, or is held by,
    a name's first sequence of an earlier object takes the first such name, and
    the longest sequence of a name (the first of these) is canonical. ``rows``:
    the objects' features if they are numbered already."""
    rows = _numbered(objects) if rows is None else rows
    first = rows.groupBy("seq").agg(F.min_by("obj", "ord").alias("obj"), F.min("ord").alias("id"))
    if not different_lengths:
        named = numbered(first, "n", "id")
        return named.select("seq", F.concat(F.lit(name_type), F.col("n").cast("string")).alias("new"), F.col("seq").alias("canonical"))
    first = settled(first)
    found = containments(first.select("id", "seq"))
    pairs = found.select(F.col("inner").alias("id"), F.col("outer").alias("other")).unionByName(found.select(F.col("outer").alias("id"), F.col("inner").alias("other")))
    # Only pairs of a later object with an earlier one count.
    objs = first.select("id", "obj")
    pairs = pairs.join(objs, "id").join(objs.select(F.col("id").alias("other"), F.col("obj").alias("other_obj")), "other").where("other_obj < obj")
    pairs = settled(pairs)
    # One round an object: sequences that meet no name become names.
    names = first.where("obj = 0").select("id", F.col("id").alias("root"))
    for k in range(1, len(objects)):
        roots = names.where("id = root").select(F.col("id").alias("other"))
        held = pairs.where(F.col("obj") == k).join(roots, "other", "left_semi").groupBy("id").agg(F.min("other").alias("root"))
        names = settled(names.unionByName(first.where(F.col("obj") == k).join(held, "id", "left").select("id", F.coalesce("root", "id").alias("root"))))
    roots = numbered(names.where("id = root").select("root"), "n", "root")
    known = first.join(names, "id").join(roots, "root")
    longest = known.groupBy("n").agg(F.max_by("seq", F.struct(F.length("seq"), -F.col("id"))).alias("canonical"))
    return known.join(longest, "n").select("seq", F.concat(F.lit(name_type), F.col("n").cast("string")).alias("new"), "canonical")


def _first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    cols = [c for c in df.columns if c not in (*keys, order)]
    return df.groupBy(*keys).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols])


def align(objects: list[dict], name_type: str = "SV", different_lengths: bool = False) -> list[dict]:
    """The data sets with features named by sequence; equal ones are summed,
    and their first taxonomy stands."""
    return _aligned(objects, _owners(objects, name_type, different_lengths))


def _owners(objects: list[dict], name_type: str, different_lengths: bool) -> DataFrame:
    """obj, feature, ord, new, canonical: features are numbered once, and named once."""
    rows = _numbered(objects)
    return settled(rows.join(sequence_names(objects, name_type, different_lengths, rows), "seq").select("obj", "feature", "ord", "new", "canonical"))


def _aligned(objects: list[dict], owners: DataFrame) -> list[dict]:
    out = []
    for k, o in enumerate(objects):
        own = owners.where(F.col("obj") == k).select("feature", "ord", "new", "canonical")
        made = dict(o)
        made["seq"] = own.groupBy(F.col("new").alias("feature")).agg(F.first("canonical").alias("seq"))
        if "tab" in o:
            made["tab"] = o["tab"].join(own.select("feature", "new"), "feature").groupBy(F.col("new").alias("feature"), "sample").agg(F.sum("value").alias("value"))
        if "tax" in o:
            made["tax"] = _first_by(o["tax"].join(own.select("feature", "ord", "new"), "feature").drop("feature"), ["new"], "ord").withColumnRenamed("new", "feature")
        out.append(made)
    return out


def _ranked(tab: DataFrame, name_type: str) -> DataFrame:
    """feature, new: names by rank of reads, ties in natural order."""
    totals = tab.groupBy("feature").agg(F.sum("value").alias("total"))
    return numbered(totals, "n", F.desc("total"), natural_key(F.col("feature")), "feature").select("feature", F.concat(F.lit(name_type), F.col("n").cast("string")).alias("new"))


def _shares(objects: list[dict], owners: DataFrame | None, keep_object: str | int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """obj, feature, total; the features that all have; info, as ``consensus`` has
    it; and which object is kept. Reads are added up by feature before they are
    named, so that no cell is shuffled for them."""
    sums = None
    for k, o in enumerate(objects):
        own = o["tab"].groupBy("feature").agg(F.sum("value").alias("total"))
        if owners is not None:
            own = own.join(owners.where(F.col("obj") == k).select("feature", "new"), "feature").groupBy(F.col("new").alias("feature")).agg(F.sum("total").alias("total"))
        own = own.select(F.lit(k).alias("obj"), "feature", "total")
        sums = own if sums is None else sums.unionByName(own)
    sums = settled(sums)
    common = None
    for k in range(len(objects)):
        own = sums.where(F.col("obj") == k).select("feature")
        common = own if common is None else common.intersect(own)
    common = settled(common.distinct())
    shares, count = None, common.agg(F.count(F.lit(1)).alias("n_common"))
    for k in range(len(objects)):
        met = sums.where(F.col("obj") == k).join(common.withColumn("kept", F.lit(1.0)), "feature", "left")
        pct = met.agg((F.sum(F.col("total") * F.coalesce("kept", F.lit(0.0))) / F.sum("total") * 100).alias("pct_reads"))
        row = pct.join(count).select(F.lit(k).alias("obj"), "n_common", "pct_reads")
        shares = row if shares is None else shares.unionByName(row)
    shares = settled(shares)
    # One of a few objects.
    keep = shares.orderBy(F.desc("pct_reads"), "obj").first()["obj"] if keep_object == "best" else int(keep_object)
    return sums, common, shares.withColumn("kept", F.col("obj") == keep), keep


def consensus_info(objects: list[dict], keep_object: str | int = "best", already_aligned: bool = False, name_type: str = "SV", different_lengths: bool = False) -> DataFrame:
    """The info of ``consensus`` alone: no table is aligned for it."""
    owners = None if already_aligned else _owners(objects, name_type, different_lengths)
    return _shares(objects, owners, keep_object)[2]


def consensus(objects: list[dict], keep_object: str | int = "best", already_aligned: bool = False, name_type: str = "SV", keep_cutoff: float = 0.2, different_lengths: bool = False) -> tuple[dict, DataFrame]:
    """(data set, info): features that all have, in the object where they hold
    most reads, with its own features above ``keep_cutoff`` percent of a
    sample; ranked by abundance and renamed. info: obj, n_common, pct_reads, kept."""
    owners = None if already_aligned else _owners(objects, name_type, different_lengths)
    sums, common, info, keep = _shares(objects, owners, keep_object)
    chosen = dict(objects[keep] if already_aligned else _aligned(objects, owners)[keep])
    tab = chosen["tab"] = settled(chosen["tab"])
    largest = tab.withColumn("ra", F.col("value") / F.sum("value").over(Window.partitionBy("sample")) * 100).groupBy("feature").agg(F.max("ra").alias("top"))
    features = common.union(largest.where(F.col("top") > keep_cutoff).select("feature")).distinct()
    totals = sums.where(F.col("obj") == keep).join(features, "feature", "left_semi")
    names = settled(_ranked(totals.select("feature", F.col("total").alias("value")), name_type))
    made = {k: v for k, v in chosen.items() if k == "meta"}
    for part in ("tab", "seq", "tax"):
        if part in chosen:
            cols = [F.col("new").alias("feature") if c == "feature" else F.col(c) for c in chosen[part].columns]
            made[part] = chosen[part].join(names, "feature").select(*cols)
    return made, info


def merge_objects(objects: list[dict], already_aligned: bool = False, name_type: str = "SV", different_lengths: bool = False) -> dict:
    """All data sets in one: samples suffixed by their object's number, first
    taxonomy that is not null, features ranked by reads and renamed."""
    aligned = objects if already_aligned else align(objects, name_type, different_lengths)
    parts: dict[str, DataFrame] = {}
    for k, o in enumerate(aligned):
        for part in ("tab", "seq", "tax", "meta"):
            if part in o:
                rows = o[part]
                if "sample" in rows.columns:
                    rows = rows.withColumn("sample", F.concat("sample", F.lit(f"_{k}")))
                rows = rows.withColumn("obj", F.lit(k))
                parts[part] = parts[part].unionByName(rows, allowMissingColumns=True) if part in parts else rows
    names = _ranked(parts["tab"], name_type)
    out = {"tab": parts["tab"].join(names, "feature").select(F.col("new").alias("feature"), "sample", "value")}
    for part in ("seq", "tax"):
        if part in parts:
            first = _first_by(parts[part], ["feature"], "obj")
            cols = [F.col("new").alias("feature") if c == "feature" else F.col(c) for c in first.columns]
            out[part] = first.join(names, "feature").select(*cols)
    if "meta" in parts:
        out["meta"] = parts["meta"].drop("obj")
    return out


#: Features of one sequence that are expanded at once, and partitions a side.
MEMBERS = 256
SIDES = 32


def sequence_distance(seq: DataFrame, band: int | None = None) -> DataFrame:
    """f1 < f2, distance, normalized: edits between sequences, and over the
    longer one's length. With ``band`` the edits are those of an alignment that
    keeps within that many of the diagonal: exact up to that distance. All pairs,
    by definition; ``sequences.similar`` makes the near ones alone.

    Features of equal sequences are held together, up to ``MEMBERS`` in a row:
    edits are counted once for two rows and then expanded. Rows meet partition by
    partition, so that no pair is shuffled."""
    tasks = int(seq.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = numbered(seq.select("seq", "feature"), "n", "seq", "feature").groupBy("seq", F.expr(f"(n - 1) div {MEMBERS}").alias("part")).agg(F.collect_list("feature").alias("features"), F.min("n").alias("id"))
    held = settled(rows.select("id", "seq", "features").repartition(min(SIDES, max(tasks, 1)), "id"))
    a, b = (held.select(F.col("id").alias(f"id{k}"), F.col("seq").alias(f"q{k}"), F.col("features").alias(f"m{k}")) for k in (1, 2))
    pairs = a.join(b.hint("shuffle_replicate_nl"), F.col("id1") <= F.col("id2"))
    d = F.levenshtein("q1", "q2") if band is None else banded_column("q1", "q2", band)
    pairs = pairs.select("id1", "id2", "m1", "m2", F.greatest(F.length("q1"), F.length("q2")).alias("n"), d.alias("distance"))
    pairs = pairs.select("id1", "id2", "m1", "m2", "distance", F.coalesce(F.try_divide(F.col("distance"), F.col("n")), F.lit(0.0)).alias("normalized"))
    wide = pairs.select("id1", "id2", "m2", "distance", "normalized", F.explode("m1").alias("x")).select("id1", "id2", "distance", "normalized", "x", F.explode("m2").alias("y"))
    wide = wide.where((F.col("x") < F.col("y")) | ((F.col("id1") < F.col("id2")) & (F.col("x") > F.col("y"))))
    return wide.select(F.least("x", "y").alias("f1"), F.greatest("x", "y").alias("f2"), "distance", "normalized")
