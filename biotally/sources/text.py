"""Readers and writers of the formats that count tables come in.

Readers take paths that Spark can read; only a header line comes to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import numbered, running, settled
from ..operators.taxonomy import PREFIX, prefix_of

RANKS = ("Domain", "Phylum", "Class", "Order", "Family", "Genus", "Species")
#: Kingdom is a rank where a file has it.
ALL_RANKS = ("Kingdom", *RANKS)


def sniff(lines: Sequence[str]) -> str:
    """The separator of a table's first lines; tabs win ties."""
    counts = {s: sum(line.count(s) for line in lines) for s in ("\t", ",", ";")}
    return max(counts, key=lambda s: (counts[s], s == "\t"))


def _head(spark: SparkSession, path: str, n: int = 5) -> list[str]:
    return [r[0] for r in spark.read.text(path).limit(n).collect()]


def _csv(spark: SparkSession, path: str, sep: str | None) -> DataFrame:
    head = _head(spark, path)
    comment = bool(head) and head[0].startswith("#") and "from biom" in head[0].lower()
    sep = sep or sniff(head[comment:])
    names = head[int(comment)].split(sep)
    schema = ", ".join(f"`c{k}` string" for k in range(len(names)))
    rows = spark.read.schema(schema).csv(path, sep=sep, header=False, quote='"')
    first = names[0].strip('"')
    rows = rows.where(~F.coalesce(F.col("c0") == first, F.lit(False)))
    if comment:
        rows = rows.where(~F.col("c0").startswith(head[0].split(sep)[0]))
    return rows.toDF(*["feature", *[n.strip().strip('"') for n in names[1:]]])


def read_tab(spark: SparkSession, path: str, sep: str | None = None, ranks: Sequence[str] = RANKS) -> tuple[DataFrame, DataFrame | None]:
    """(tab, tax): a count table with a column a sample; columns that name a
    rank are taxonomy. Cells that are no number raise."""
    wide = _csv(spark, path, sep)
    known = {r.lower() for r in (*ranks, *PREFIX)}
    tax_cols = [c for c in wide.columns[1:] if c.lower() in known]
    samples = [c for c in wide.columns[1:] if c not in tax_cols]
    long = wide.select("feature", *[F.col(f"`{c}`") for c in samples]).unpivot("feature", samples, "sample", "value")
    number = F.expr("try_cast(value as double)")
    value = F.when(F.col("value").isNull(), F.lit(0.0)).when(number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit("not a number: "), "value")).cast("double"))
    tab = long.select("feature", "sample", value.alias("value")).where("value > 0")
    return tab, wide.select("feature", *[F.col(f"`{c}`") for c in tax_cols]) if tax_cols else None


def read_tax(spark: SparkSession, path: str, sep: str | None = None, add_prefix: bool = True) -> DataFrame:
    tax = _csv(spark, path, sep)
    out = [F.col("feature")]
    for c in tax.columns[1:]:
        x = F.when((F.length(f"`{c}`") <= 1) | (F.lower(F.col(f"`{c}`")) == "nan"), F.lit(None)).otherwise(F.col(f"`{c}`"))
        out.append((F.when(x.isNotNull() & ~x.contains("__"), F.concat(F.lit(prefix_of(c)), x)).otherwise(x) if add_prefix else x).alias(c))
    return tax.select(*out)


def read_meta(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    sep = sep or sniff(_head(spark, path))
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=True)
    return df.withColumnRenamed(df.columns[0], "sample").withColumn("sample", F.col("sample").cast("string"))


def fasta_records(records: DataFrame, splitter: str | None = None) -> DataFrame:
    """value (text after a >) -> feature, seq; lines joined, letters upper as they are."""
    header = F.trim(F.split("value", r"\r?\n")[0])
    name = F.split(header, re.escape(splitter))[0] if splitter else header
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", "")
    return records.where(F.trim("value") != "").select(name.alias("feature"), seq.alias("seq"))


def read_fasta(spark: SparkSession, path: str, splitter: str | None = None) -> DataFrame:
    """Records split at a > that begins a line; the first record has it still."""
    lines = spark.read.option("lineSep", "\n>").text(path)
    return fasta_records(lines.select(F.regexp_replace("value", "^>", "").alias("value")), splitter)


def lineage_ranks(lineage: Column, keep_prefix: bool, missing: str | None) -> list[Column]:
    """The seven ranks of a lineage of prefixed names."""
    out = []
    for rank in RANKS:
        p = rank[0].lower()
        found = F.regexp_extract(lineage, f"(?:^|[;,]\\s*){p}__([^;,]*)", 1)
        held = lineage.rlike(f"(?:^|[;,]\\s*){p}__")
        value = F.concat(F.lit(f"{p}__"), F.trim(found)) if keep_prefix else F.trim(found)
        out.append(F.when(held, value).otherwise(F.lit(missing)).alias(rank))
    return out


def parse_gtdb(rows: DataFrame, feature: str = "user_genome", classification: str = "classification") -> DataFrame:
    """Ranks without prefixes; an empty rank is '', an absent one null."""
    c = F.col(classification)
    cols = [F.when(c.rlike(f"{r[0].lower()}__"), F.regexp_extract(c, f"{r[0].lower()}__([^;]*)", 1)).alias(r) for r in RANKS]
    return rows.select(F.col(feature).alias("feature"), *cols)


def read_gtdb(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    out = None
    for p in paths:
        own = parse_gtdb(spark.read.csv(p, sep="\t", header=True))
        out = own if out is None else out.unionByName(own)
    return out


def seen_ranks(text: DataFrame, column: str, behind: str, sep: str) -> tuple[str, ...]:
    """Of all ranks those that some row's letters name, ``behind`` the start or a
    ``sep`` and before what ``behind`` says; without any, the usual seven."""
    found = [F.max(F.col(column).rlike(f"(?:^|{sep}\\s*)(?i:{r[0]}){behind}")).alias(r) for r in ALL_RANKS]
    row = text.agg(*found).first()
    return tuple(r for r in ALL_RANKS if row[r]) or RANKS


def parse_qiime(rows: DataFrame, feature: str = "Feature ID", taxon: str = "Taxon", ranks: Sequence[str] = RANKS) -> DataFrame:
    """Ranks by prefix, without it, or by place among the seven usual ones where
    there are no prefixes; unknown is ''."""
    t = F.coalesce(F.col(f"`{taxon}`"), F.lit(""))
    parts = F.transform(F.split(t, ";"), lambda p: F.trim(p))
    prefixed = t.rlike("(?:^|;\\s*)[A-Za-z]+__")
    cols = []
    for rank in ranks:
        by_prefix = F.regexp_extract(t, f"(?:^|;\\s*)(?i:{rank[0]})__([^;]*)", 1)
        by_place = F.coalesce(F.get(parts, F.lit(RANKS.index(rank))), F.lit("")) if rank in RANKS else F.lit("")
        value = F.trim(F.when(prefixed, by_prefix).otherwise(by_place))
        cols.append(F.when(value.isin("", "_", "__", "Unassigned"), F.lit("")).otherwise(value).alias(rank))
    return rows.select(F.col(f"`{feature}`").alias("feature"), *cols)


def read_qiime(spark: SparkSession, path: str) -> DataFrame:
    """The ranks that the file has, Kingdom among them."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return parse_qiime(rows, ranks=seen_ranks(rows, "Taxon", "__", ";"))


def parse_sintax(rows: DataFrame, ranks: Sequence[str] = RANKS) -> DataFrame:
    """feature, text (fields after the id) -> ranks: what stands behind the
    first +, as d:Name,p:Name with : as __."""
    t = F.when(F.col("text").contains("+"), F.regexp_extract("text", r"\+\s*(.*)$", 1))
    cols = []
    for rank in ranks:
        p = rank[0].lower()
        found = F.regexp_extract(t, f"(?:^|,|\\s){p}:\"?([^,\"\\s]+)", 1)
        cols.append(F.when(found != "", F.concat(F.lit(f"{p}__"), found)).alias(rank))
    return rows.select("feature", *cols)


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n, line: lines that are not blank, numbered from 1 through all files,
    each file's in their order. A file is split and dealt like any text: where a
    split starts and a line's place within it give the order."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", r"\r$", "").alias("line"))
    # Ids are of the partitions that read; they are kept before rows move.
    return numbered(settled(read.where(F.trim("line") != "")), "n", "file", "start", "id").select("file", "n", "line")


def sintax_records(lines: DataFrame) -> DataFrame:
    """feature, text from file, n, line. A record is a line with tabs, or a line
    without and the next one of its file. Of lines without tabs in a row every
    other one is an id; a line is taken by the id before it if an odd number of
    lines without tabs stand right before it."""
    tabbed = F.col("line").contains("\t")
    # The last line with tabs up to each line; a file's start ends what was before.
    last = running(lines.withColumn("_at", F.when(tabbed, -F.col("n")).otherwise(F.lit(0))), "_last", ["n"], "_at", "min")
    first = lines.groupBy("file").agg(F.min("n").alias("_first"))
    before = lines.select((F.col("n") + 1).alias("n"), F.col("file").alias("_file"), tabbed.alias("_tabs"))
    after = last.select((F.col("n") - 1).alias("n"), F.col("file").alias("_next"), F.col("line").alias("_text"))
    through = last.select((F.col("n") + 1).alias("n"), F.col("_last").alias("_before"))
    rows = lines.join(first, "file").join(before, "n", "left").join(through, "n", "left").join(after, "n", "left")
    run = F.col("n") - 1 - F.greatest(F.coalesce(-F.col("_before"), F.lit(0)), F.col("_first") - 1)
    taken = (F.coalesce(F.col("_file") == F.col("file"), F.lit(False))) & (run % 2 == 1)
    rows = rows.where(~taken & (tabbed | (F.col("_next") == F.col("file"))))
    # What is left without tabs is an id whose next line is there.
    text = F.when(tabbed, F.col("line")).otherwise(F.col("_text"))
    return rows.select(F.regexp_replace(F.trim(F.split("line", r"\t")[0]), "^>", "").alias("feature"), text.alias("text"))


def read_sintax(spark: SparkSession, path: str) -> DataFrame:
    """Records of one line, or of two of which the second has the taxonomy; the
    ranks that the file has, Kingdom among them. Records without a + have no
    taxonomy: their ranks are null."""
    records = settled(sintax_records(file_lines(spark, path)))
    named = records.select(F.regexp_extract("text", r"\+\s*(.*)$", 1).alias("text"))
    return parse_sintax(records, seen_ranks(named, "text", ":", ","))


def coverm_table(long: DataFrame, threshold: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(feature, sample, measure, value) with measures ra, bases, length or
    fraction -> (tab, unmapped): features covered less than the threshold are
    absent; unmapped is (sample, pct)."""
    # One aggregation by cell; a pivot makes one by cell and measure before it.
    wide = long.groupBy("feature", "sample").agg(*[F.first(F.when(F.col("measure") == m, F.col("value")), ignorenulls=True).alias(m) for m in ("ra", "bases", "length", "fraction")])
    covered = F.coalesce(F.try_divide(F.col("bases"), F.col("length")), F.col("fraction"))
    if threshold > 0:
        covered = F.coalesce(covered, F.raise_error(F.lit("neither covered bases and length nor covered fraction")).cast("double"))
        wide = wide.withColumn("ra", F.when((F.lower("feature") != "unmapped") & (covered < threshold), F.lit(0.0)).otherwise(F.col("ra")))
    unmapped = wide.where(F.lower("feature") == "unmapped").select("sample", F.col("ra").alias("pct"))
    return wide.where((F.lower("feature") != "unmapped") & (F.col("ra") > 0)).select("feature", "sample", F.col("ra").alias("value")), unmapped


def coverm_columns(names: Sequence[str], first_sep: str = "", second_sep: str = " ", ra: str = "relative abundance") -> list[tuple[str, str, str]]:
    """(column, sample, measure) from a header: the sample stands between the separators."""
    measures = {"ra": ra.lower(), "bases": "covered bases", "length": "length", "fraction": "covered fraction"}
    out = []
    for name in names:
        for measure, text in measures.items():
            if text in name.lower():
                sample = name.split(first_sep, 1)[-1] if first_sep else name
                out.append((name, sample.split(second_sep, 1)[0] if second_sep else sample, measure))
                break
    return out


def read_coverm(spark: SparkSession, path: str, first_sep: str = "", second_sep: str = " ", ra: str = "relative abundance", threshold: float = 0.0) -> tuple[DataFrame, DataFrame]:
    wide = spark.read.csv(path, sep="\t", header=True)
    cols = coverm_columns(wide.columns[1:], first_sep, second_sep, ra)
    cells = F.array(*[F.struct(F.lit(s).alias("sample"), F.lit(m).alias("measure"), F.expr(f"try_cast(`{c}` as double)").alias("value")) for c, s, m in cols])
    return coverm_table(wide.select(F.col(f"`{wide.columns[0]}`").alias("feature"), F.inline(cells)), threshold)


def ebd_tables(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sample, lineage, ord, value) -> (tab, tax): features are OTU1, ... by
    column; a leading Root goes; None and NA are null; over seven ranks raise."""
    order = numbered(long.select("lineage", "ord").distinct(), "n", "ord", "lineage").withColumn("feature", F.concat(F.lit("OTU"), F.col("n").cast("string")))
    tab = long.join(order, ["lineage", "ord"]).select("feature", "sample", "value").where("value > 0")
    parts = F.transform(F.split("lineage", ";"), lambda p: F.trim(p))
    parts = F.when(F.get(parts, F.lit(0)) == "Root", F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    parts = F.when(F.size(parts) > 7, F.raise_error(F.lit("more than seven ranks")).cast("array<string>")).otherwise(parts)
    cols = [F.when(~F.get(parts, F.lit(k)).isin("", "None", "NA"), F.get(parts, F.lit(k))).alias(r) for k, r in enumerate(RANKS)]
    return tab, order.select("feature", *cols)


def read_ebd(spark: SparkSession, path: str, sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """Rows are samples and columns lineages; names are kept apart from Spark's
    own, as they hold dots and semicolons."""
    names = spark.read.text(path).limit(1).collect()[0][0].split(sep)
    schema = ", ".join(f"c{k} string" for k in range(len(names)))
    rows = spark.read.schema(schema).csv(path, sep=sep, header=True, enforceSchema=True)
    cells = F.array(*[F.struct(F.lit(n).alias("lineage"), F.lit(k).alias("ord"), F.expr(f"try_cast(c{k + 1} as double)").alias("value")) for k, n in enumerate(names[1:])])
    return ebd_tables(rows.select(F.col("c0").alias("sample"), F.inline(cells)))


def read_tree(spark: SparkSession, path: str, midpoint_root: bool = False) -> tuple[DataFrame, DataFrame]:
    """A Newick file -> (nodes, closure)."""
    from . import newick

    root = newick.parse("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    return newick.to_tables(spark, newick.reroot_midpoint(root) if midpoint_root else root)


def write_matrix(distmat: DataFrame, path: str) -> None:
    """The upper triangle of a symmetric matrix (f1, f2, d), as Parquet."""
    distmat.where("f1 < f2").select("f1", "f2", "d").write.mode("overwrite").parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Both triangles again."""
    from ..operators.trees import mirrored

    return mirrored(spark.read.parquet(path))


def save(path: str, *, tab: DataFrame | None = None, tax: DataFrame | None = None, meta: DataFrame | None = None, seq: DataFrame | None = None, newick: str | None = None, samples: Sequence[str] | None = None) -> list[str]:
    """Folders of text files below ``path``; the table pivoted to a column a sample."""
    done = []
    if tab is not None:
        tab.groupBy("feature").pivot("sample", list(samples) if samples else None).agg(F.first("value")).na.fill(0.0).write.mode("overwrite").csv(f"{path}_tab.csv", header=True)
        done.append(f"{path}_tab.csv")
    for name, df in (("tax", tax), ("meta", meta)):
        if df is not None:
            df.write.mode("overwrite").csv(f"{path}_{name}.csv", header=True)
            done.append(f"{path}_{name}.csv")
    if seq is not None:
        seq.select(F.concat(F.lit(">"), "feature", F.lit("\n"), "seq")).write.mode("overwrite").text(f"{path}_seq.fa")
        done.append(f"{path}_seq.fa")
    if newick is not None and (df := tab if tab is not None else seq if seq is not None else tax) is not None:
        df.sparkSession.createDataFrame([(newick,)], "value string").write.mode("overwrite").text(f"{path}_tree.nwk")
        done.append(f"{path}_tree.nwk")
    return done
