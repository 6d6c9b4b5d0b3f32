"""Writes: ledgers as Parquet tables by run, registration with checks before and after, soft deletes, caches, sidecars.

Every write is a plan over whole tables. A table's rows are changed by writing the new version beside
the old one: a version is a folder, readers take the last complete one, so a lost executor or an
ended job leaves the version before.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.operators import relational as R
from frameloom.operators.vectors import _cut

#: Rows that are few enough for a fold.
FOLD = 200_000


def append_run(rows: DataFrame, uri: str, run_id: str) -> str:
    """Append rows as a partition of their own; a run that is there already gets -2, -3, .. behind its name, so nothing is overwritten."""
    spark = rows.sparkSession
    there = set()
    if exists(spark, uri):
        there = {r[0] for r in spark.read.parquet(uri).select("run_id").where(F.col("run_id").startswith(run_id)).distinct().collect()}  # one run's names
    name, turn = run_id, 1
    while name in there:
        turn += 1
        name = f"{run_id}-{turn}"
    rows.withColumn("run_id", F.lit(name)).write.mode("append").partitionBy("run_id").parquet(uri)
    return name


def exists(spark: SparkSession, uri: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def insertable(ledger: DataFrame, rows: DataFrame, *keys: list[str], order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, rows to skip) under several unique keys, one row after the other in the order of the columns ``order`` (all, by default).

    A row goes in if no key of it is taken, by the ledger or by an earlier row that went in; a row that is skipped takes none. A key
    with a null is taken by nobody. In rounds: a row goes in that is the first of the rows left for each of its keys, and the others
    of its keys go. A round settles at least the first row of each chain; the last FOLD rows are settled by one fold.
    """
    names = [f"__key{i}" for i in range(len(keys))]

    def keyed(df: DataFrame) -> list[Column]:
        return [F.when(reduce(Column.__and__, (F.col(c).isNotNull() for c in key)), F.to_json(F.struct(*(F.col(c).cast("string").alias(f"k{j}") for j, c in enumerate(key))))).alias(n) for n, key in zip(names, keys, strict=True)]

    rows = _cut(rows.withColumn("__id", F.monotonically_increasing_id()))
    left = rows.select(F.struct(*(order or [c for c in rows.columns if c != "__id"]), "__id").alias("__rank"), *keyed(rows))
    for n, c in zip(names, keyed(ledger), strict=True):
        left = left.join(ledger.select(c).distinct(), n, "left_anti")
    left, taken = _cut(left), []
    while left.count() > FOLD:
        marked = left
        for n in names:
            marked = marked.join(left.where(F.col(n).isNotNull()).groupBy(n).agg(F.min("__rank").alias(f"__first{n}")), n, "left")
        first = reduce(Column.__and__, (F.coalesce(F.col(f"__first{n}") == F.col("__rank"), F.lit(True)) for n in names))
        going = _cut(marked.where(first).select("__rank", *names))
        taken.append(going.select("__rank.__id"))
        left = left.join(going.select("__rank"), "__rank", "left_anti")
        for n in names:
            left = left.join(going.select(n), n, "left_anti")
        left = _cut(left)

    def fold(some: pd.DataFrame) -> pd.DataFrame:
        seen: list[set[str]] = [set() for _ in names]
        out = []
        for row in some.sort_values("place")[["id", *names]].itertuples(index=False):
            if not any(k is not None and k in s for k, s in zip(row[1:], seen, strict=True)):
                out.append(row[0])
                for k, s in zip(row[1:], seen, strict=True):
                    s.add(k)
        return pd.DataFrame({"__id": out})

    # Ranks compare as Spark compares them; the fold gets places.
    place = F.row_number().over(Window.partitionBy("all").orderBy("__rank")).alias("place")
    rest = left.withColumn("all", F.lit(0)).select("all", place, F.col("__rank.__id").alias("id"), *names)
    taken.append(rest.groupBy("all").applyInPandas(fold, "__id long"))
    ids = _cut(reduce(DataFrame.unionByName, taken))
    columns = [c for c in rows.columns if c != "__id"]
    return rows.join(ids, "__id", "left_semi").select(*columns), rows.join(ids, "__id", "left_anti").select(*columns)


def register(ledger: DataFrame, expected: DataFrame, batch: str, key: str, fields: list[str], *unique: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the ledger with the batches' missing rows, a row for each batch of what happened).

    A batch is refused as a whole if a row of it is there in other words, or is there twice: then nothing of it is written, and its
    differences stay to be reconciled. Of the others the rows whose key is missing are inserted, unless another unique key of theirs is taken.
    """
    owner = expected.select(key, batch).distinct()
    differs = R.reconcile(expected, ledger, key, fields).join(owner, key)
    conflicts = differs.groupBy(batch).agg(F.count_if(F.col("kind") == "mismatch").alias("mismatches"), F.count_if(F.col("kind") == "duplicate").alias("duplicates"), F.count_if(F.col("kind") == "missing").alias("missing"))
    state = expected.groupBy(batch).agg(F.count("*").alias("expected")).join(conflicts, batch, "left").fillna(0, ["mismatches", "duplicates", "missing"])
    state = _cut(state.withColumn("refused", (F.col("mismatches") > 0) | (F.col("duplicates") > 0)))
    missing = differs.where("kind = 'missing'").select(key).join(owner, key).join(state.where("not refused").select(batch), batch, "left_semi").select(key)
    inserted, _ = insertable(ledger, expected.join(missing, key, "left_semi"), [key], *unique, order=[key])
    done = inserted.groupBy(batch).agg(F.count("*").alias("inserted"))
    outcome = state.join(done, batch, "left").select(batch, "expected", "refused", "mismatches", F.when(F.col("refused"), 0).otherwise(F.col("expected") - F.col("missing")).alias("already"), F.coalesce("inserted", F.lit(0)).alias("inserted"))
    outcome = outcome.withColumn("skipped", F.when(F.col("refused"), 0).otherwise(F.col("expected") - F.col("already") - F.col("inserted")))
    return ledger.unionByName(inserted.select(*ledger.columns)), outcome


def soft_delete(table: DataFrame, ids: DataFrame, key: str, status: str = "rejected") -> DataFrame:
    """table with the status set for the ids; no row goes."""
    marked = ids.select(key).distinct().withColumn("__gone", F.lit(True))
    joined = table.join(marked, key, "left")
    return joined.withColumn("status", F.when(F.col("__gone"), status).otherwise(F.col("status"))).select(*table.columns)


def stale_texts(cache: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of wanted that the cache lacks or has with another text: those to embed anew."""
    known = cache.select(key, F.col(text).alias("__known"))
    return wanted.join(known, key, "left").where(~F.col("__known").eqNullSafe(F.col(text)) | F.col("__known").isNull()).select(*wanted.columns)


def merge_cache(cache: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """The cache with new rows in place of those of the same key."""
    return cache.join(made.select(key), key, "left_anti").unionByName(made)


def write_version(table: DataFrame, uri: str, version: int) -> None:
    table.write.mode("errorifexists").parquet(f"{uri}/version={version:06d}")


def write_sidecars(variants: DataFrame, uri: str, tables: dict[str, list[str]], done: str = "complete") -> None:
    """A table of chosen columns for each name, of the variants that are done."""
    for name, columns in tables.items():
        variants.where(F.col("state") == done).select("variant", *columns).write.mode("errorifexists").parquet(f"{uri}/{name}")


def duration_update(id_: Column, seconds: Column) -> Column:
    """The SQL text that sets a track's duration, for review."""
    return F.format_string("update music set duration_sec = %.6f where id = '%s';", seconds, F.replace(id_, F.lit("'"), F.lit("''")))
