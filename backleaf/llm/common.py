"""What the operators share: staged tables, words, column names that cannot clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backleaf.functions.batches import bound_batches, parts, small_batches  # noqa: F401  (likewise)
from backleaf.sources.scratch import delete, drop_run, new_folder, shared_dir  # noqa: F401  (used by way of this module)

#: A word, everywhere in this package: a longest run of characters other than ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def stage(df: DataFrame, label: str) -> DataFrame:
    """df as a written table in the run's folder (see drop_run): lineage ends there, lost executors cost nothing."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*staged: DataFrame) -> None:
    """Deletes tables made by stage() that no result needs any more."""
    for df in staged:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(spark, path)


def unit_hash(*columns: Column, seed: int) -> Column:
    """A signed 64-bit hash of the columns, as good as random, the same in every run."""
    return F.xxhash64(F.lit(seed), *columns)


def free_name(wanted: str, taken: list[str]) -> str:
    """wanted, with underscores added until it is not among taken (compared without case)."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted


def beside(names: list[str], made: tuple[str, ...] | list[str]) -> list[str]:
    """What an input's columns are called in a result that adds the columns `made`: as before, or with underscores where made has the name."""
    out: list[str] = []
    for i, n in enumerate(names):
        out.append(free_name(n, [*made, *out, *names[i + 1 :]]) if n.lower() in {m.lower() for m in made} else n)
    return out


def restored(out: DataFrame, names: list[str]) -> DataFrame:
    """The first columns of out under the given names, the others gone."""
    return out.select(*[out[c].alias(n) for c, n in zip(out.columns, names)])
