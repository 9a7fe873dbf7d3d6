"""Columns and small operators for labels, taxon names and tree text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def species_of(label: str | Column, mode: str = "full") -> Column:
    """The species in a leaf label: all of it, or what stands before or after the first ``_`` (all, where there is none)."""
    label = F.col(label) if isinstance(label, str) else label
    at = F.instr(label, "_")
    if mode == "full":
        return label
    part = F.substring_index(label, "_", 1) if mode == "before" else F.substring(label, at + 1, F.length(label))
    return F.when(at > 0, part).otherwise(label)


def strip_after_underscore(newick: str | Column, sections: str = "sect_nov_") -> Column:
    """Tree text with every taxon cut at its first ``_``; names of unnamed ``sections`` keep the field behind that."""
    return F.regexp_replace(newick, rf"(?<![^(),:;\s])({sections}[^_(),:;]*)(_[^(),:;]*)?|_[^(),:;]*", "$1")


def gene_tip(label: str) -> tuple[Column, Column]:
    """Species-tree leaf of a gene tip (without its last two ``_`` fields), and the copy index in it or null."""
    leaf = F.regexp_replace(label, r"_[^_]*_[^_]*$", "")
    return leaf, F.nullif(F.regexp_extract(leaf, r"_(\d+)$", 1), F.lit("")).cast("int")


def strip_internal_labels(newick: str | Column) -> Column:
    """Tree text without labels, support values or marks behind closing brackets."""
    return F.regexp_replace(F.regexp_replace(newick, r"\)[^(),:;]+", ")"), r"[*+]|<\d+>", "")


def repair_tree(newick: str | Column) -> Column:
    """Tree text without control characters and without a length of the root that is 0 or in scientific notation, ending in ``;``."""
    text = F.regexp_replace(newick, r"[\x00-\x09\x0B-\x1F\x7F]", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\)(\d*):0;", ")$1;"), r"\)(\d*):[\d.]+e[-+]\d+;", ")$1;")
    return F.when(F.trim(text) == "", "").when(F.rtrim(text).endswith(";"), text).otherwise(F.concat(F.trim(text), F.lit(";")))


def balanced(newick: str) -> Column:
    """Whether a tree text has as many closing as opening brackets."""
    return F.length(F.translate(newick, "(", "")) == F.length(F.translate(newick, ")", ""))


def strip_patterns(name: str | Column, patterns: Sequence[str] = (r"_[A-Z]{1,2}_?\d{5,8}(\.\d+)?$", r"_\d+$")) -> Column:
    """A name after each pattern, in order, has been removed from it."""
    out = F.col(name) if isinstance(name, str) else name
    for p in patterns:
        out = F.regexp_replace(out, p, "")
    return out


#: Letters of the pieces by which names are found in others.
PIECE = 3


def containing(short: DataFrame, names: DataFrame) -> DataFrame:
    """The names that contain a text: ``part`` (of ``short``) with ``other`` (of ``names``).

    An inverted index of the names' pieces of one to `PIECE` letters. A text is looked up by its rarest
    piece of the full size (itself, if it is shorter), and what that gives is verified; so a piece that
    most names share is only met where a text has no other. Empty texts are found nowhere.
    """
    texts = short.select("part").distinct().filter("part <> ''")
    every = names.select("other").distinct()
    at = lambda c, k: F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substring(c, i, F.lit(k)))
    sized = [F.when(F.length("other") >= k, at("other", k)).otherwise(F.array().cast("array<string>")) for k in range(1, PIECE + 1)]
    index = every.select("other", F.explode(F.array_distinct(F.concat(*sized))).alias("piece"))
    times = index.groupBy("piece").agg(F.count("*").alias("times"))
    asked = texts.select("part", F.explode(F.when(F.length("part") >= PIECE, F.array_distinct(at("part", PIECE))).otherwise(F.array("part"))).alias("piece"))
    # a piece that no name has rules its text out, so the look-up stops there
    rare = asked.join(times, "piece", "left").groupBy("part").agg(F.min_by("piece", F.struct(F.coalesce("times", F.lit(0).cast("long")), "piece")).alias("piece"))
    return rare.join(index, "piece").filter(F.col("other").contains(F.col("part"))).select("part", "other")


def substring_taxa(taxa: DataFrame) -> DataFrame:
    """Taxa that are part of other taxa: ``taxon, longer`` (sorted)."""
    met = containing(taxa.select(F.col("taxon").alias("part")), taxa.select(F.col("taxon").alias("other"))).filter("part <> other")
    return met.groupBy(F.col("part").alias("taxon")).agg(F.sort_array(F.collect_list("other")).alias("longer"))


def safe_names(problems: DataFrame, taxa: DataFrame) -> DataFrame:
    """A new name for each taxon, the first of ``<taxon>X, <taxon>X1, ...`` that no taxon contains.

    A taxon that contains ``<taxon>X`` and digits behind it rules out one name per digit, so as many
    numbers as are ruled out, and one more, are enough to find a free one.
    """
    base = F.concat("taxon", F.lit("X"))
    parts = problems.select("taxon").distinct().withColumn("part", base)
    met = parts.join(containing(parts, taxa.select(F.col("taxon").alias("other"))), "part")
    behind = met.select("taxon", F.explode(F.slice(F.split("other", F.concat(F.lit("\\Q"), base, F.lit("\\E"))), 2, 1 << 20)).alias("rest"))
    digits = behind.select("taxon", F.regexp_extract("rest", r"^\d*", 0).alias("d"))
    out = digits.select("taxon", F.explode(F.transform(F.sequence(F.lit(0), F.length("d")), lambda i: F.substring("d", F.lit(1), i))).alias("number"))
    ruled = out.filter("number = '' or number not like '0%'").groupBy("taxon").agg(F.collect_set("number").alias("ruled"))
    every = problems.select("taxon").distinct().join(ruled, "taxon", "left").withColumn("ruled", F.coalesce("ruled", F.array().cast("array<string>")))
    numbers = F.transform(F.sequence(F.lit(0), F.size("ruled")), lambda i: F.when(i > 0, i.cast("string")).otherwise(""))
    return every.select("taxon", F.concat(base, F.array_except(numbers, "ruled")[0]).alias("name"))


def rename(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Applies ``names(taxon, name)`` to a column; other values stay."""
    other = names.select(F.col("taxon").alias("__taxon"), F.col("name").alias("__name"))
    return df.join(other, df[column] == F.col("__taxon"), "left").withColumn(column, F.coalesce("__name", column)).drop("__taxon", "__name")


def merge_counts(counts: DataFrame, names: DataFrame) -> DataFrame:
    """Counts ``taxon, n`` under their new names; those of taxa that meet under one name are added: ``taxon, n``."""
    return rename(counts.select("taxon", "n"), "taxon", names.select("taxon", "name").distinct()).groupBy("taxon").agg(F.sum("n").alias("n"))


def number_copies(leaves: DataFrame) -> DataFrame:
    """Numbers the copies of each species in a tree by leaf order, in the forms ``k_species`` and ``species_k``."""
    k = F.row_number().over(W.partitionBy("tree_id", "species").orderBy("pos"))
    return leaves.withColumn("k", k).withColumns({"prefixed": F.concat_ws("_", F.col("k").cast("string"), "species"), "suffixed": F.concat_ws("_", "species", F.col("k").cast("string"))})


def taxon_map(copies: DataFrame) -> DataFrame:
    """Per species the names ``species_1 .. species_max`` over the corpus (``copies``: species, n)."""
    return copies.groupBy("species").agg(F.max("n").cast("int").alias("most")).select("species", F.transform(F.sequence(F.lit(1), "most"), lambda i: F.concat("species", F.lit("_"), i.cast("string"))).alias("names"))


def root_names(names: DataFrame) -> DataFrame:
    """Names grouped by what stands before ``_`` and digits at their end: ``root, names`` (sorted by number, then name); a name without is its own root."""
    root, number = F.regexp_extract("name", r"^(.+)_(\d+)$", 1), F.regexp_extract("name", r"^(.+)_(\d+)$", 2)
    rows = names.select("name").distinct().select(F.when(root != "", root).otherwise(F.col("name")).alias("root"), F.struct(F.when(root != "", number.cast("decimal(38,0)")).alias("k"), "name").alias("x"))
    return rows.groupBy("root").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["name"]).alias("names"))


def keep_listed(rows: DataFrame, listed: DataFrame, column: str = "species", drop: bool = False) -> DataFrame:
    """Rows of leaves or sequences whose taxon is listed, or with ``drop`` those whose is not: ``listed`` has ``taxon``; rows without a taxon are never listed."""
    known = listed.select(F.col("taxon").alias("__taxon")).distinct()
    return rows.join(known, rows[column] == F.col("__taxon"), "left_anti" if drop else "left_semi")


def level_of(config: str | Column) -> Column:
    """The level in the name of a configuration: low, medium, high, or Unknown."""
    name = F.lower(F.col(config) if isinstance(config, str) else config)
    return F.when(name.contains("low"), "low").when(name.contains("medium"), "medium").when(name.contains("high"), "high").otherwise("Unknown")


def tag_configs(df: DataFrame, tags: DataFrame, column: str = "config") -> DataFrame:
    """Adds the ``family`` and ``level`` of each row's configuration: those of ``tags`` (``config, family, level``), else from its name; a family that is not known is Unknown."""
    named = tags.select(F.col("config").alias(column), F.col("family").alias("__family"), F.col("level").alias("__level"))
    found = df.join(named, column, "left")
    return found.select(*df.columns, F.coalesce("__family", F.lit("Unknown")).alias("family"), F.coalesce("__level", level_of(column)).alias("level"))


def validate_trees(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """The first failing check of each tree, or ``ok``: tips, label form, known species, polytomies, root; with its zero-length branches."""
    marked = nodes.join(known.select(F.col("species").alias("label"), F.lit(1).alias("known")), "label", "left")
    children = nodes.filter("parent_lo is not null").groupBy("tree_id", "parent_lo").agg(F.count("*").alias("n"))
    shape = children.groupBy("tree_id").agg(F.max("n").alias("widest"), F.max(F.when(F.col("parent_lo") == 0, F.col("n"))).alias("root"))
    leaf = F.col("is_leaf")
    per = marked.groupBy("tree_id").agg(F.count(F.when(leaf, 1)).alias("tips"), F.count(F.when(leaf & ~F.col("label").rlike(r"^[\w.-]+$"), 1)).alias("odd"), F.count(F.when(leaf & F.col("known").isNull(), 1)).alias("unknown"), F.count(F.when((F.col("dist") == 0) & (F.col("depth") > 0), 1)).alias("zero_branches"))
    verdict = F.when(F.col("tips") < 2, "few tips").when(F.col("odd") > 0, "label form").when(F.col("unknown") > 0, "unknown species").when(F.col("widest") > 2, "polytomy").when(F.col("root") != 2, "unrooted").otherwise("ok")
    return per.join(shape, "tree_id", "left").select("tree_id", verdict.alias("verdict"), "zero_branches")


def draw(keys: Sequence[str], seed: str) -> Column:
    """A stable order of rows that looks random: the hash of seed and keys."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in keys)), 256)


def sample_trees(trees: DataFrame, n: int, seed: str, by: str = "sample_id") -> DataFrame:
    """n trees of each sample, the same on every run."""
    return trees.withColumn("k", F.row_number().over(W.partitionBy(by).orderBy(draw(["tree_id"], seed), "tree_id"))).filter(F.col("k") <= n).drop("k")


def split_part(key: str, seed: str, train: float = 0.8) -> Column:
    """``train`` or ``val`` by the hash of a key; a larger share keeps all of a smaller one."""
    return F.when(F.conv(F.substring(draw([key], seed), 1, 8), 16, 10).cast("double") / 2.0**32 < train, "train").otherwise("val")


def substitution_model(df: DataFrame, rates: Sequence[str], freqs: Sequence[str], alpha: str = "alpha", most: float = 3.0) -> Column:
    """Model text for a sequence simulator: six rates, four frequencies, and a gamma term unless alpha is over ``most`` or null."""
    number = lambda c: F.round(F.col(c), 4).cast("decimal(12,4)").cast("string")
    base = F.concat(F.lit("GTR{"), F.concat_ws("/", *map(number, rates)), F.lit("}+F{"), F.concat_ws("/", *map(number, freqs)), F.lit("}"))
    return F.concat(base, F.when(F.col(alpha) <= most, F.concat(F.lit("+G4{"), number(alpha), F.lit("}"))).otherwise(""))


def gene_species(genes: DataFrame, species: DataFrame) -> DataFrame:
    """The species whose name, with ``_`` behind it, is the longest prefix of a gene's name (null where none is)."""
    parts = F.split("gene", "_")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_"))
    tries = genes.select("gene").distinct().select("gene", F.explode(F.when(F.size(parts) > 1, heads).otherwise(F.array().cast("array<string>"))).alias("species"))
    hit = tries.join(species.select("species").distinct(), "species").groupBy("gene").agg(F.max_by("species", F.length("species")).alias("species"))
    return genes.select("gene").distinct().join(hit, "gene", "left")


def genus_prefixes(names: DataFrame, canonical: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """The prefix that a method's names have and canonical ones lack: ``method, prefix, names, support, matches``.

    ``names`` is ``method, name``, ``canonical`` ``name``. All prefixes of ``least`` letters or more are counted
    as in a trie: ``support`` names have one, and of ``matches`` what follows is canonical. Of those whose matches are at least the
    share ``share`` of the method's names the longest is taken (then the first in order). A method
    with a canonical name among its own, or with a single name, has none.
    """
    own = names.select("method", "name").distinct()
    known = canonical.select(F.col("name").alias("rest")).distinct()
    plain = own.join(known, own["name"] == known["rest"], "left_semi").select("method").distinct()
    size = own.groupBy("method").agg(F.count("*").alias("names")).filter("names > 1").join(plain, "method", "left_anti")
    cuts = F.when(F.length("name") > least, F.sequence(F.lit(least), F.length("name") - 1)).otherwise(F.array().cast("array<int>"))
    nodes = own.select("method", "name", F.explode(cuts).alias("k")).select("method", F.substring("name", F.lit(1), F.col("k")).alias("prefix"), F.substring("name", F.col("k") + 1, F.length("name")).alias("rest"))
    met = nodes.join(known.withColumn("hit", F.lit(1)), "rest", "left").groupBy("method", "prefix").agg(F.count("*").alias("support"), F.count("hit").alias("matches"))
    good = met.join(size, "method").filter(F.col("matches") >= share * F.col("names"))
    best = good.groupBy("method").agg(F.min_by(F.struct("prefix", "names", "support", "matches"), F.struct(-F.length("prefix"), "prefix")).alias("b"))
    return best.select("method", "b.*")


def harmonise(names: DataFrame, canonical: DataFrame, most: int = 4) -> DataFrame:
    """Maps names of a method to canonical ones, ``name, canonical``; the first rule that holds decides.

    The name itself; without 1 to ``most`` digits at its end, one more at a time: as it is, without
    ``_``, and without regard to case; the whole name without ``_`` and without regard to case; the
    name without the prefix that the names share (`genus_prefixes`); the only canonical name that
    starts with it, or with it less one or two digits; less one digit.
    """
    bare = lambda c: F.regexp_replace(c, "_", "")
    c = canonical.select(F.col("name").alias("canonical")).distinct()
    less = lambda n: F.regexp_extract("name", rf"^(.+)\d{{{n}}}$", 1)
    ways, rank = [("exact", 0, F.col("name"))], 1
    for n in range(1, most + 1):
        ways += [("exact", rank, less(n)), ("exact", rank + 1, bare(less(n))), ("folded", rank + 2, F.lower(bare(less(n))))]
        rank += 3
    ways += [("exact", rank, bare("name")), ("folded", rank + 1, F.lower(bare("name"))), ("exact", rank + 2, F.col("bare_of_genus")), ("prefix", rank + 3, bare("name")), ("prefix", rank + 4, bare(less(1))), ("prefix", rank + 5, bare(less(2)))]
    genus = genus_prefixes(names.select(F.lit(1).alias("method"), "name"), canonical).agg(F.first("prefix").alias("genus"))
    rest = F.when(F.col("name").startswith(F.col("genus")), F.substring("name", F.length("genus") + 1, F.length("name")))
    every = names.select("name").distinct().crossJoin(F.broadcast(genus)).withColumn("bare_of_genus", rest)  # one row
    tries = every.select("name", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(i).alias("rank"), x.alias("key")) for k, i, x in ways))).alias("t")).select("name", "t.*").filter("key <> ''")
    starts = c.select("canonical", F.explode(F.transform(F.sequence(F.lit(1), F.length("canonical")), lambda i: F.substring("canonical", F.lit(1), i))).alias("key"))
    only = starts.groupBy("key").agg(F.count("*").alias("n"), F.min("canonical").alias("canonical")).filter("n = 1")
    folded = c.groupBy(F.lower(bare("canonical")).alias("key")).agg(F.min("canonical").alias("canonical"))
    known = c.select(F.lit("exact").alias("kind"), F.col("canonical").alias("key"), "canonical").unionByName(folded.select(F.lit("folded").alias("kind"), "key", "canonical")).unionByName(only.select(F.lit("prefix").alias("kind"), "key", "canonical"))
    met = tries.join(known, ["kind", "key"]).groupBy("name").agg(F.min_by("canonical", "rank").alias("canonical"))
    last = names.select("name").distinct().join(met, "name", "left_anti").select("name", less(1).alias("canonical")).filter("canonical <> ''")
    return met.unionByName(last)
