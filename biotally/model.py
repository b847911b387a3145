"""A community: five aligned tables and what can be done with them.

A ``Community`` is immutable; every method returns a new one or a DataFrame, and
nothing runs until an action. ``validate`` is an action and is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import alpha, beta, combine, relational, taxonomy, trees
from .sources import newick, text


@dataclass(frozen=True)
class Community:
    tab: DataFrame | None = None
    tax: DataFrame | None = None
    meta: DataFrame | None = None
    seq: DataFrame | None = None
    tree: DataFrame | None = None
    node_leaf: DataFrame | None = None

    # -- reading and writing

    @classmethod
    def load(cls, spark: SparkSession, *, tab: str | None = None, tax: str | None = None, meta: str | None = None, fasta: str | None = None, tree: str | None = None, path: str = "", sep: str | None = None, name_splitter: str | None = None, midpoint_root: bool = False, add_taxon_prefix: bool = True) -> Community:
        """From files; a taxonomy of its own replaces one that the table holds."""
        at = lambda name: f"{path}/{name}" if path else name
        out = cls()
        if tab:
            counts, held = text.read_tab(spark, at(tab), sep)
            out = replace(out, tab=counts, tax=held)
        if tax:
            out = replace(out, tax=text.read_tax(spark, at(tax), sep, add_taxon_prefix))
        if meta:
            out = replace(out, meta=text.read_meta(spark, at(meta), sep))
        if fasta:
            out = replace(out, seq=text.read_fasta(spark, at(fasta), name_splitter))
        if tree:
            nodes, leaves = text.read_tree(spark, at(tree), midpoint_root)
            out = replace(out, tree=nodes, node_leaf=leaves)
        return out.autocorrect()

    def add_sintax(self, spark: SparkSession, path: str) -> Community:
        return replace(self, tax=text.read_sintax(spark, path)).autocorrect()

    def add_qiime(self, spark: SparkSession, path: str) -> Community:
        return replace(self, tax=text.read_qiime(spark, path)).autocorrect()

    def add_gtdb(self, spark: SparkSession, *paths: str) -> Community:
        return replace(self, tax=text.read_gtdb(spark, paths)).autocorrect()

    def add_fasta(self, spark: SparkSession, path: str, name_splitter: str | None = None) -> Community:
        return replace(self, seq=text.read_fasta(spark, path, name_splitter)).autocorrect()

    def add_coverm(self, spark: SparkSession, path: str, **how) -> Community:
        """The abundance table, and in meta unmapped_reads_perc; without meta, it
        is made of the samples that the file tells this of."""
        tab, unmapped = text.read_coverm(spark, path, **how)
        share = unmapped.select("sample", F.col("pct").alias("unmapped_reads_perc"))
        meta = share if self.meta is None else self.meta.drop("unmapped_reads_perc").join(share, "sample", "left")
        # A file without the share says nothing of samples.
        if self.meta is None and share.isEmpty():
            meta = None
        return replace(self, tab=tab, meta=meta).autocorrect()

    def add_ebd(self, spark: SparkSession, path: str, sep: str = "\t") -> Community:
        """Abundances and taxonomy of a table of samples by lineages."""
        tab, tax = text.read_ebd(spark, path, sep)
        return replace(self, tab=tab, tax=tax).autocorrect()

    @classmethod
    def from_dict(cls, tables: dict[str, DataFrame]) -> Community:
        names = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in tables.items() if k in names})

    def to_dict(self) -> dict[str, DataFrame]:
        return {f.name: v for f in fields(self) if (v := getattr(self, f.name)) is not None}

    def save(self, path: str, samples: Sequence[str] | None = None) -> list[str]:
        tree = newick.write(newick.from_rows([tuple(r) for r in self.tree.orderBy("dist_to_root", "node").collect()])) if self.tree is not None else None
        return text.save(path, tab=self.tab, tax=self.tax, meta=self.meta, seq=self.seq, newick=tree, samples=samples)

    # -- rules

    def autocorrect(self) -> Community:
        """Features that tab, tax and seq share; samples that tab and meta share."""
        tab, tax, seq, meta = self.tab, self.tax, self.seq, self.meta
        for other in (tax, seq):
            if tab is not None and other is not None:
                tab = tab.join(other.select("feature").distinct(), "feature", "left_semi")
        if tab is not None:
            ids = tab.select("feature").distinct()
            tax = tax.join(ids, "feature", "left_semi") if tax is not None else None
            seq = seq.join(ids, "feature", "left_semi") if seq is not None else None
            if meta is not None:
                tab = tab.join(meta.select("sample").distinct(), "sample", "left_semi")
                meta = meta.join(tab.select("sample").distinct(), "sample", "left_semi")
        return replace(self, tab=tab, tax=tax, seq=seq, meta=meta)

    def validate(self) -> Community:
        """Raises on the first fault of the tables; else the community."""
        if self.tab is None:
            raise ValueError("there is no abundance table")
        if bad := relational.faults(self.tab, self.tax, self.tree).limit(1).collect():
            raise ValueError(f"{bad[0]['rule']}: {bad[0]['id']}")
        if not self.tab.limit(1).count():
            raise ValueError("the abundance table is empty")
        return self

    def info(self) -> DataFrame:
        return relational.summary(self.tab)

    def summarize_taxa(self) -> DataFrame:
        return relational.summarize_taxa(self.tab, self.tax)

    # -- selecting and changing

    def _with_tab(self, tab: DataFrame) -> Community:
        return replace(self, tab=tab).autocorrect()

    def subset_samples(self, by: str = "index", values: Sequence | None = None, exclude: bool = False) -> Community:
        tab, meta = relational.subset_samples(self.tab, self.meta, by, values, exclude)
        return replace(self, tab=tab, meta=meta).autocorrect()

    def subset_features(self, features: Sequence[str], exclude: bool = False) -> Community:
        ids = self.tab.sparkSession.createDataFrame([(f,) for f in features], "feature string")
        return self._with_tab(relational.subset_features(self.tab, ids, exclude))

    def subset_abundant(self, n: int = 25, method: str = "sum", cutoff: float | None = None, exclude: bool = False) -> Community:
        return self._with_tab(relational.subset_abundant(self.tab, n, method, cutoff, exclude))

    def subset_taxa(self, patterns: Sequence[str] | str, levels: Sequence[str] | str | None = None, **how) -> Community:
        out = self._with_tab(relational.subset_taxa(self.tab, self.tax, patterns, levels, **how))
        return out

    def merge_samples(self, by: Sequence[str] | str, values: Sequence | None = None, method: str = "sum", weight: str | None = None) -> Community:
        tab = relational.merge_samples(self.tab, self.meta, by, values, method, weight)
        return replace(self, tab=tab, meta=relational.merge_meta(self.meta, by, method)).autocorrect()

    def rename_features(self, name_type: str = "OTU", names: dict[str, str] | None = None) -> Community:
        """By rank of abundance, or by a dictionary; leaves follow."""
        if names is None:
            mapping = relational.rename_map(self.tab, name_type)
        else:
            mapping = self.tab.sparkSession.createDataFrame(list(names.items()), "feature string, new string")
        out = {k: relational.rename_features(getattr(self, k), mapping) for k in ("tab", "tax", "seq") if getattr(self, k) is not None}
        if self.tree is not None:
            m = mapping.withColumnRenamed("feature", "old")
            for k, cols in (("tree", ["node"]), ("node_leaf", ["node", "leaf"])):
                df = getattr(self, k)
                for c in cols:
                    rest = [x for x in df.columns if x != c]
                    df = df.join(m.select(F.col("old").alias(c), "new"), c, "left").select(F.coalesce("new", c).alias(c), *rest).select(*df.columns)
                out[k] = df
        return replace(self, **out)

    def tax_prefix(self, add: bool = True, custom: dict[str, str] | None = None) -> Community:
        return replace(self, tax=taxonomy.tax_prefix(self.tax, add, custom))

    def clean_tax(self) -> Community:
        return replace(self, tax=taxonomy.clean_taxonomy(self.tax))

    def rarefy(self, depth: int | str = "min", seed: int = 0, replacement: bool = False, method: str = "reads") -> Community:
        return self._with_tab(relational.rarefy(self.tab, depth, seed, replacement, method))

    def prune_tree(self, features: Sequence[str] | DataFrame | None = None, reroot: bool = False) -> Community:
        """The tree of the listed features (a list, or a table of feature), or of
        the table's."""
        if isinstance(features, DataFrame):
            keep = features.select("feature")
        else:
            keep = self.tab.select("feature").distinct() if features is None else self.tree.sparkSession.createDataFrame([(f,) for f in features], "feature string")
        pruned = relational.settled(trees.prune(self.tree, self.node_leaf, keep))
        if pruned.isEmpty():
            raise ValueError("no leaf of the tree is kept")
        if reroot:
            pruned = relational.settled(trees.reroot_midpoint(pruned, trees.closure(pruned)))
        leaves = relational.settled(trees.closure(pruned))
        return replace(self, tree=pruned.join(trees.dist_to_root(pruned), "node"), node_leaf=leaves)

    # -- measuring

    def alpha(self, q: float = 1, div_type: str = "naive", distmat: DataFrame | None = None, index: str | None = None) -> DataFrame:
        if div_type == "phyl":
            return alpha.phyl_alpha(self.tab, self.tree, self.node_leaf, q, index or "D")
        if div_type == "func":
            return alpha.func_alpha(self.tab, distmat, q, index or "FD")
        return alpha.naive_alpha(self.tab, q)

    def beta(self, q: float = 1, div_type: str = "naive", distmat: DataFrame | None = None, dis: bool = True, viewpoint: str = "regional") -> DataFrame:
        if div_type == "phyl":
            return beta.phyl_beta(self.tab, self.tree, self.node_leaf, q, dis, viewpoint)
        if div_type == "func":
            return beta.func_beta(self.tab, distmat, q, dis, viewpoint)
        if div_type.lower() == "bray":
            return beta.bray(self.tab)
        if div_type.lower() == "jaccard":
            return beta.jaccard(self.tab)
        return beta.naive_beta(self.tab, q, dis, viewpoint)

    @staticmethod
    def merge(objects: Sequence[Community], **how) -> Community:
        return Community.from_dict(combine.merge_objects([o.to_dict() for o in objects], **how))

    @staticmethod
    def consensus(objects: Sequence[Community], **how) -> tuple[Community, DataFrame]:
        made, info = combine.consensus([o.to_dict() for o in objects], **how)
        return Community.from_dict(made), info
