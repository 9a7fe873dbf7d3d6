"""Writers of summary tables, multisets and name maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_summary(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """A summary table as CSV with a header; partitioned Parquet where ``by`` names columns."""
    if by:
        df.write.partitionBy(*by).parquet(path)
    else:
        df.write.csv(path, header=True)


def write_taxon_map(names: DataFrame, path: str) -> None:
    """``taxon, name`` as sorted tab-separated values."""
    names.select("taxon", "name").orderBy("taxon").write.csv(path, sep="\t")


def copy_names_json(taxon_map: DataFrame) -> DataFrame:
    """One JSON object per sample of the copy names of each species (``species, names``)."""
    return taxon_map.select(F.to_json(F.map_from_entries(F.array(F.struct("species", "names")))).alias("json"))


def write_multiset(multiset: DataFrame, path: str) -> None:
    """Each species as often as it has copies, a line each, sorted, in a folder per sample."""
    multiset.select("sample_id", "species").repartition("sample_id").sortWithinPartitions("sample_id", "species").write.partitionBy("sample_id").text(path)
