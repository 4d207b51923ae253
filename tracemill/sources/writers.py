"""Writers. Row counts come from observed metrics, not from a second pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from .shards import write_shards  # noqa: F401  (a sink like the others)



def _count_while(df: DataFrame, write) -> int:
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return seen.get["rows"]


def write_jsonl(df: DataFrame, path: str) -> int:
    """One JSON record per line, nulls kept, replacing what was there. Returns the row count."""
    return _count_while(
        df, lambda d: d.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    )


def write_table(df: DataFrame, path: str, overwrite: bool = True) -> int:
    """Parquet; without `overwrite`, existing output is an error."""
    mode = "overwrite" if overwrite else "errorifexists"
    return _count_while(df, lambda d: d.write.mode(mode).parquet(path))


def write_splits(
    df: DataFrame,
    path: str,
    splits: list[str],
    aliases: dict[str, str] | None = None,
    split_col: str = "split",
    file_format: str = "json",
) -> dict[str, tuple[str, int]]:
    """All splits of a labelled table in one pass, one directory each. Returns output name -> (path,
    rows); an alias is a further name for a split's files, not a copy."""
    seen = Observation()
    counts = [F.count_if(F.col(split_col) == s).alias(s) for s in splits]
    writer = df.observe(seen, *counts).write.mode("overwrite").partitionBy(split_col)
    if file_format == "json":
        writer = writer.option("ignoreNullFields", False)
    writer.format(file_format).save(path)
    rows = seen.get
    outputs = {s: (f"{path}/{split_col}={s}", rows[s]) for s in splits}
    return outputs | {alias: outputs[source] for alias, source in (aliases or {}).items()}


RESPONSE_ALIASES = {"hard": "test", "vae_train": "train", "vae_val": "val"}
STEPWISE_ALIASES = {"vae_train": "train", "vae_val": "val"}


def append_records(df: DataFrame, path: str, file_format: str = "json") -> int:
    """Add rows to a log."""
    return _count_while(df, lambda d: d.write.mode("append").format(file_format).save(path))


def write_evaluation(pairs: DataFrame, path: str) -> int:
    """The evaluation table (input, output) as JSON records."""
    return write_jsonl(pairs.select("input", "output"), path)
