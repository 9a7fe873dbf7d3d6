"""Readers of tree, sequence, report and metric files as declared DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TEXT = "value string"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, value``: one row per file."""
    return spark.read.schema(TEXT).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def split_newick(files: DataFrame, most: int | None = None) -> DataFrame:
    """Trees of each file, ``path, number, newick``: text between semicolons, blanks left out; the first ``most`` if given."""
    rows = files.select("path", F.posexplode(F.split("value", ";")).alias("at", "newick")).withColumn("newick", F.trim(F.regexp_replace("newick", r"^\s+|\s+$", ""))).filter("newick <> ''")
    rows = rows.withColumn("number", F.row_number().over(W.partitionBy("path").orderBy("at")) - 1).drop("at")
    return rows.filter(F.col("number") < most) if most is not None else rows


def read_newick(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    return split_newick(whole_files(spark, path), most)


def parse_nexus(files: DataFrame) -> DataFrame:
    """The tree text of NEXUS files (after ``=`` on a tree line), or of plain Newick files: ``path, newick``."""
    tree = F.regexp_extract("value", r"(?im)^\s*u?tree\b[^=]*=\s*(?:\[[^\]]*\]\s*)*([^;]*)", 1)
    return files.select("path", F.when(F.col("value").rlike(r"(?i)^\s*#nexus"), tree).otherwise(F.regexp_extract("value", r"\s*([^;]*)", 1)).alias("newick"))


def read_nexus(spark: SparkSession, path: str) -> DataFrame:
    return parse_nexus(whole_files(spark, path))


def parse_phylip(files: DataFrame) -> DataFrame:
    """Rows after the header, ``path, seq_id, sequence``."""
    lines = files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("at", "line")).filter("at > 0 and trim(line) <> ''")
    return lines.select("path", F.regexp_extract("line", r"^\s*(\S+)", 1).alias("seq_id"), F.regexp_replace(F.regexp_extract("line", r"^\s*\S+\s+(.*)$", 1), r"\s", "").alias("sequence"))


def parse_fasta(files: DataFrame) -> DataFrame:
    """Records of FASTA files, ``path, seq_id, sequence``; a record's lines are joined."""
    records = files.select("path", F.explode(F.split(F.concat(F.lit("\n"), "value"), r"\n>")).alias("record")).filter("record <> '' and record <> '\n'")
    return records.select("path", F.regexp_extract("record", r"^\s*(\S+)", 1).alias("seq_id"), F.regexp_replace(F.regexp_replace("record", r"^[^\n]*\n?", ""), r"\s", "").alias("sequence"))


def parse_reconciliation(files: DataFrame) -> DataFrame:
    """``path, duplications, losses`` of reconciliation reports that have both."""
    number = lambda name: F.regexp_extract("value", rf"(?i){name}:\s*(\d+)", 1)
    return files.select("path", *(F.when(number(k) != "", number(k)).cast("int").alias(k) for k in ("duplications", "losses"))).filter("duplications is not null and losses is not null")


def parse_durations(files: DataFrame) -> DataFrame:
    """``path, seconds`` of logs of completed runs: ``Duration: N seconds``, else ``Elapsed h:m:s``; over 0."""
    part = lambda i: F.regexp_extract("value", r"Elapsed[^\d]*(\d+):(\d+):(\d+)", i).try_cast("double")
    said = F.regexp_extract("value", r"Duration:\s*(\d+(?:\.\d+)?)\s*seconds", 1).try_cast("double")
    seconds = F.coalesce(said, part(1) * 3600 + part(2) * 60 + part(3))
    return files.filter(F.contains("value", F.lit("COMPLETED SUCCESSFULLY"))).select("path", seconds.alias("seconds")).filter("seconds > 0")


def parse_copy_table(files: DataFrame) -> DataFrame:
    """``path, species, copies`` of white-space tables; header and rows without a number left out."""
    lines = files.select("path", F.explode(F.split("value", r"\r?\n")).alias("line"))
    cells = F.split(F.trim("line"), r"\s+")
    return lines.select("path", F.try_element_at(cells, F.lit(1)).alias("species"), F.try_element_at(cells, F.lit(2)).try_cast("int").alias("copies")).filter("copies is not null")


def parse_result_tree(files: DataFrame) -> DataFrame:
    """``path, newick`` of method output: a ``multree:`` line, else a ``Newick:`` line, else the last field of the first data row."""
    named = lambda name: F.regexp_extract("value", rf"(?im)^\s*{name}:\s*(\S+)", 1)
    data = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    cell = F.element_at(F.split(F.try_element_at(data, F.lit(2)), "\t"), -1)
    return files.select("path", F.coalesce(F.nullif(named("multree"), F.lit("")), F.nullif(named("Newick"), F.lit("")), cell).alias("newick"))


def keys_from_path(files: DataFrame) -> DataFrame:
    """Adds network, config, method and replicate from ``.../<network>/results/<config>/<method>/replicate_<n>/...``."""
    part = lambda i: F.regexp_extract("path", r"([^/]+)/results/([^/]+)/([^/]+)/replicate_(\d+)", i)
    return files.select("*", part(1).alias("network"), part(2).alias("config"), part(3).alias("method"), part(4).try_cast("int").alias("replicate"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Long metric tables of many configs by a glob; the config is the name of the file's folder."""
    schema = "network string, method string, replicate int, metric string, value double, status string"
    return spark.read.schema(schema).csv(path, header=True).withColumn("config", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


METADATA = "n_species int, n_events_requested int, n_events_applied int, events array<struct<event_type string, target_clade array<string>, partner_clade array<string>>>, polyploid_species map<string, int>"


def parse_metadata(files: DataFrame) -> DataFrame:
    """Events of sample metadata in JSON: ``path, n_species, n_events_requested, n_events_applied, event_ix, event_type, target_clade, partner_clade``."""
    rows = files.select("path", F.from_json("value", METADATA).alias("m")).select("path", "m.n_species", "m.n_events_requested", "m.n_events_applied", F.posexplode_outer("m.events").alias("event_ix", "event"))
    return rows.select("*", "event.*").drop("event")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return parse_metadata(whole_files(spark, path))


#: Rates and base frequencies as reports of a model fit name them.
RATES, BASES = ("A-C", "A-G", "A-T", "C-G", "C-T", "G-T"), "ACGT"


def parse_model_report(files: DataFrame) -> DataFrame:
    """Fields of reports of a model fit: sequences, sites and their shares, six rates ``ac .. gt``, ``pi_a .. pi_t``, ``alpha``.

    Rates, frequencies and alpha are null where a rate or a frequency is missing.
    """
    number = lambda pattern, kind="double": F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")).try_cast(kind)
    real = r"([0-9.eE+-]+)"
    rates = {x.replace("-", "").lower(): number(rf"(?m)^\s*{x}:\s*{real}") for x in RATES}
    bases = {f"pi_{x.lower()}": number(rf"pi\({x}\)\s*=\s*{real}") for x in BASES}
    counts = {"n_sequences": number(r"Input data:\s+(\d+)\s+sequences?", "int"), "alignment_length": number(r"sequences?\s+with\s+(\d+)\s+nucleotide sites", "int"), "constant_sites": number(r"Number of constant sites:\s+(\d+)", "int"), "informative_sites": number(r"Number of parsimony informative sites:\s+(\d+)", "int")}
    read = files.select("path", *(c.alias(k) for k, c in {**counts, **rates, **bases, "alpha": number(rf"Gamma shape alpha:\s*{real}")}.items()))
    whole = F.lit(True)
    for c in (*rates, *bases):
        whole = whole & F.col(c).isNotNull()
    share = lambda c: F.try_divide(F.col(c) * F.lit(100.0), F.col("alignment_length"))
    model = [F.when(whole, F.col(c)).alias(c) for c in (*rates, *bases, "alpha")]
    return read.select("path", *counts, share("constant_sites").alias("constant_percentage"), share("informative_sites").alias("informative_percentage"), *model)


def task_keys(tasks: DataFrame, networks: DataFrame, replicates: int) -> DataFrame:
    """Adds network and replicate to numbered tasks, ``task_id``: replicates of the first network, then of the next (``networks``: position, network)."""
    at = tasks.withColumns({"position": F.floor(F.col("task_id") / replicates), "replicate": F.col("task_id") % replicates + 1})
    return at.join(networks, "position").drop("position")


RETENTION = "events array<struct<species: array<string>, q: double>>, copy_numbers map<string, map<string, bigint>>, removal map<string, struct<eligible: bigint, reduced: bigint>>"


def parse_retention(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Retention summaries ``network, replicate, value`` (one JSON text a replicate) as the tables behind them.

    Copies of polyploids, the species that an event names, ``network, replicate, species, n, genes`` (in how many genes a species
    has n copies); genes that could lose a copy and those that did, ``network, replicate, species, eligible, reduced``; and retention rates, ``network, replicate, q``, a row
    an event. A text that is no JSON, or lacks a part, has no rows of it.
    """
    rows = files.select("network", "replicate", F.from_json("value", RETENTION).alias("m"))
    events = rows.select("network", "replicate", F.explode("m.events").alias("e"))
    named = events.select("network", "replicate", F.explode("e.species").alias("species")).distinct()
    counted = rows.select("network", "replicate", F.explode("m.copy_numbers").alias("species", "of")).select("network", "replicate", "species", F.explode("of").alias("n", "genes"))
    copies = counted.select("network", "replicate", "species", F.col("n").cast("int").alias("n"), "genes").join(named, ["network", "replicate", "species"], "left_semi")
    removal = rows.select("network", "replicate", F.explode("m.removal").alias("species", "r")).select("network", "replicate", "species", F.coalesce("r.eligible", F.lit(0).cast("long")).alias("eligible"), F.coalesce("r.reduced", F.lit(0).cast("long")).alias("reduced"))
    return copies, removal, events.select("network", "replicate", "e.q")
