"""Verdicts reused by content fingerprint, and the store they come from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.functions.text import fingerprint
from winnow.schemas import CONFIDENCES, PROMPT_VERSION, STORED, VERDICT_LABELS
from winnow.session import stage

# The column that names an entry's folder in a store: the first digits of its fingerprint, or, for
# what runs have appended since the store was compacted, one name for all.
PART = "part"
APPENDED = "appended"
MAX_DIGITS = 4


def add_fingerprint(
    findings: DataFrame,
    prompt_version: str = PROMPT_VERSION,
    compat_line_prefix: bool = False,
    include_callees: bool = False,
) -> DataFrame:
    """Add ``prompt_version`` and ``fingerprint``.

    The enclosing function enters as raw text, so unrelated edits above it keep the key.
    ``compat_line_prefix`` hashes its numbered text instead, which moves with the line numbers.
    ``include_callees`` adds the called functions' sources, so that their edits renew the key.
    """
    source = F.col("context")["containing_function_source"] if compat_line_prefix else F.col("function_text")
    if include_callees:
        callees = F.transform(F.col("context")["called_functions"], lambda call: call["source"])
        source = F.concat_ws("\n", source, F.array_join(callees, "\n"))
    return findings.withColumn("prompt_version", F.lit(prompt_version)).withColumn(
        "fingerprint",
        fingerprint(F.col("prompt_version"), F.col("rule_id"), F.col("file_path"), F.col("matched_code"), source),
    )


def usable_entries(store: DataFrame) -> DataFrame:
    """Entries with a complete verdict; corrupt or outdated ones count as absent."""
    verdict = F.col("verdict")
    return store.filter(
        F.col("fingerprint").isNotNull()
        & verdict["verdict"].isin(VERDICT_LABELS)
        & verdict["confidence"].isin(CONFIDENCES)
        & verdict["reasoning"].isNotNull()
        & verdict["suggested_action"].isNotNull()
    )


def latest_entries(store: DataFrame) -> DataFrame:
    """One entry per fingerprint, the last written; equal times are settled by content.

    An aggregate instead of a ranking window, so copies of one fingerprint are merged before the
    shuffle, however many there are.
    """
    payload = [c for c in store.columns if c not in ("fingerprint", "stored_at")]
    entry = F.struct(*payload)
    # Findings that shared a request are stored each; the one that was charged speaks for them.
    charged = F.coalesce("input_tokens", F.lit(-1).cast("long"))
    order = F.struct("stored_at", charged.alias("charged"), F.xxhash64(F.to_json(entry)).alias("content"))
    return (
        store.groupBy("fingerprint")
        .agg(F.max_by(entry, order).alias("_entry"), F.max("stored_at").alias("stored_at"))
        .select("fingerprint", *[F.col("_entry")[c].alias(c) for c in payload], "stored_at")
        .select(*store.columns)
    )


def reuse_verdicts(findings: DataFrame, store: DataFrame) -> DataFrame:
    """Left join of findings with the store: ``from_cache`` and the stored outcome as ``stored``.

    Of several entries for one fingerprint the latest counts, so a finding stays one row.

    The stored verdict meets the current finding, so line numbers in the result are current.
    """
    payload = [c for c in store.columns if c not in ("fingerprint", "stored_at")]
    # Keys first: of the store's payload only what some finding asks for is moved.
    asked = findings.select("fingerprint").distinct()
    entries = latest_entries(store.join(asked, "fingerprint", "left_semi")).select("fingerprint", F.struct(*payload).alias("stored"))
    return findings.join(entries, "fingerprint", "left").withColumn("from_cache", F.col("stored").isNotNull())


def work_list(findings: DataFrame, store: DataFrame) -> DataFrame:
    """Findings whose fingerprint the store does not hold."""
    return findings.join(store.select("fingerprint"), "fingerprint", "left_anti")


def store_rows(triaged: DataFrame, stored_at: Column) -> DataFrame:
    """Rows of a run that go into the store: fresh, usable replies, downgraded ones included."""
    return triaged.filter("reviewed AND synth_reason IS NULL AND NOT from_cache").select(
        *[F.col(c) if c != "stored_at" else stored_at.alias(c) for c in STORED.fieldNames()]
    )


def upsert(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """The store with ``fresh`` put in by key, last write wins."""
    return latest_entries(store.unionByName(fresh))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The latest usable entry of every fingerprint; a store that was never written is empty."""
    return latest_entries(_entries(spark, path).drop(PART))


def lookup_store(spark: SparkSession, path: str, findings: DataFrame) -> DataFrame:
    """The latest usable entries of the fingerprints of ``findings``, as :func:`read_store` has them.

    Of a compacted store only the folders that these fingerprints begin with are read, besides what
    runs have appended since: the wanted folders prune the scan when it starts, and a list of them is
    never longer than there are folders. Findings that ask for every folder read the whole store.
    """
    asked = stage(findings.select("fingerprint").distinct())
    entries = _entries(spark, path)
    digits = _digits(spark, path)
    if digits:
        # The comparison also drops null keys; a filter on this side is what lets Spark prune the other.
        wanted = asked.where("fingerprint > ''").select(F.substring("fingerprint", 1, digits).alias(PART)).distinct()
        wanted = wanted.unionByName(spark.range(1).select(F.lit(APPENDED).alias(PART)))
        entries = entries.join(F.broadcast(wanted), PART, "left_semi")
    return latest_entries(entries.drop(PART).join(asked, "fingerprint", "left_semi"))


def write_store(spark: SparkSession, path: str, fresh: DataFrame) -> None:
    """Append ``fresh`` to the Parquet store at ``path`` as one more delta.

    Nothing that is there is read or replaced, so runs at the same time keep each other's entries;
    of several for one fingerprint the latest counts when the store is read.
    """
    fresh.select(*STORED.fieldNames()).write.mode("append").parquet(f"{path.rstrip('/')}/{PART}={APPENDED}")


def compact_store(spark: SparkSession, path: str, target: str, folder_entries: int = 100_000) -> None:
    """Write the latest entry of every fingerprint to ``target``, a new store that may replace ``path``.

    Entries go into folders by the first digits of their fingerprint, as many (4 at most, 65,536
    folders) as give folders of about ``folder_entries``, which is what lets a lookup leave the
    others unread. Tasks write ranges of fingerprints, so a folder is not one task.
    """
    if path.rstrip("/") == target.rstrip("/"):
        raise ValueError("a store cannot be compacted into itself")
    latest = stage(read_store(spark, path))
    folders = latest.count() / folder_entries
    digits = next((d for d in range(1, MAX_DIGITS) if 16**d >= folders), MAX_DIGITS)
    (
        latest.withColumn(PART, F.substring("fingerprint", 1, digits))
        .repartitionByRange("fingerprint")
        .sortWithinPartitions(PART, "fingerprint")
        .write.mode("errorifexists")
        .partitionBy(PART)
        .parquet(target)
    )


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """All usable entries, with the folder they stand in: appended rows, compacted ones, and files without a folder."""
    path = path.rstrip("/")
    schema = T.StructType([*STORED.fields, T.StructField(PART, T.StringType())])
    parts = [spark.createDataFrame([], schema)]
    if _folders(spark, f"{path}/{PART}=*"):
        parts = [spark.read.schema(schema).option("basePath", path).parquet(f"{path}/{PART}=*")]
    if _folders(spark, f"{path}/*.parquet"):
        loose = spark.read.schema(STORED).parquet(f"{path}/*.parquet")
        parts.append(loose.withColumn(PART, F.lit(APPENDED)))
    return usable_entries(reduce(DataFrame.unionByName, parts))


def _digits(spark: SparkSession, path: str) -> int:
    """How many digits of a fingerprint name a folder of the store, 0 where it has none such."""
    for digits in range(1, MAX_DIGITS + 1):
        if _folders(spark, f"{path.rstrip('/')}/{PART}=" + "[0-9a-f]" * digits):
            return digits
    return 0


def _folders(spark: SparkSession, pattern: str) -> int:
    found = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return len(found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found) or [])
