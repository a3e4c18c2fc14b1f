"""File scans and sinks: binary files, the plane-hash manifest, portable anymap and raw plane bytes, comparison with an oracle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("rgba", "alpha")


def image_files(spark: SparkSession, path: str, most: int = 0xFFFFFFFE) -> DataFrame:
    """Regular .webp files of a folder, up to an inclusive size; length is pushed down, content read only for the rest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.webp").option("recursiveFileLookup", "false").load(path)
    return files.where(F.col("length") <= most)


def bad_path(path: Column) -> Column:
    """Empty, absolute or with a parent step, in POSIX or Windows syntax."""
    return (path == "") | path.rlike(r"^[/\\]") | path.rlike(r"^[A-Za-z]:") | path.rlike(r"(^|[/\\])\.\.([/\\]|$)")


def manifest_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines of file, kind and hash set apart by tabs -> file, kind, sha256, error. Empty lines and those that start with #
    are none; a line that doesn't have three fields, a known kind and a hash of 64 hex digits has an error."""
    f = F.split(F.col(line), "\t")
    of = lambda k: F.get(f, F.lit(k))
    error = F.when(F.size(f) != 3, "fields").when(bad_path(of(0)), "path").when(~of(1).isin(*KINDS), "kind").when(~of(2).rlike("^[0-9a-f]{64}$"), "hash")
    return lines.where((F.length(line) > 0) & ~F.startswith(F.col(line), F.lit("#"))).select(of(0).alias("file"), of(1).alias("kind"), of(2).alias("sha256"), error.alias("error"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The good rows of a manifest; a bad line fails the query that reads them. `manifest_lines` gives it as a row instead."""
    rows = manifest_lines(spark.read.text(path))
    told = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("bad manifest line: "), F.col("error")))).otherwise(F.col("file"))
    return rows.select(told.alias("file"), "kind", "sha256")


def write_manifest(hashes: DataFrame, path: str) -> None:
    """One sorted file, as its readers expect; it has a line per plane, so one task writes it."""
    hashes.select("file", "kind", "sha256").orderBy("file", "kind").coalesce(1).write.csv(path, sep="\t", mode="overwrite")


def verify_manifest(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Each expected row with ok, mismatch or missing."""
    both = expected.join(found.withColumnRenamed("sha256", "got"), ["file", "kind"], "left")
    return both.select("file", "kind", F.when(F.col("got").isNull(), "missing").when(F.col("got") == F.col("sha256"), "ok").otherwise("mismatch").alias("status"))


def compare(actual: DataFrame, oracle: DataFrame) -> DataFrame:
    """(file, status): bytes of both sides, columns file and content. A null content on a side is a file it failed on;
    what the oracle doesn't know is skipped."""
    both = actual.select("file", F.col("content").alias("a"), F.lit(True).alias("in_a")).join(oracle.select("file", F.col("content").alias("o"), F.lit(True).alias("in_o")), "file", "full")
    status = F.when(F.col("in_o").isNull(), "skipped").when(F.col("in_a").isNull() | F.col("a").isNull() | F.col("o").isNull(), "failed").when(F.col("a") == F.col("o"), "ok").otherwise("diff")
    return both.select("file", status.alias("status"))


def comparison(statuses: DataFrame) -> DataFrame:
    """One row: compared, skipped, failed, and whether it passed: something was compared and nothing differs or failed."""
    n = statuses.agg(F.count_if(F.col("status").isin("ok", "diff")).alias("compared"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status").isin("diff", "failed")).alias("failed"))
    return n.withColumn("passed", (F.col("compared") > 0) & (F.col("failed") == 0))


def pam(width: Column, height: Column, rgba: Column) -> Column:
    head = F.concat(F.lit("P7\nWIDTH "), width.cast("string"), F.lit("\nHEIGHT "), height.cast("string"), F.lit("\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n"))
    return F.concat(F.encode(head, "UTF-8"), rgba)


def sink(rows: DataFrame, folder: str, name: str = "file", content: str = "content") -> DataFrame:
    """Writes each row's bytes as a file of its own under a URI that all executors reach, and gives (file, bytes, error)
    once it is run. Names that leave the folder are refused; a task that runs again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            out = []
            for file, data, bad in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bad or data is None:
                    out.append((file, None, "InvalidCorpusPath" if bad else "MissingImageData"))
                    continue
                at = f"{base}/{file}"
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(at) as f:
                    f.write(data)
                out.append((file, len(data), None))
            columns = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["file", "bytes", "error"])

    return rows.select(F.col(name).cast("string").alias("file"), F.col(content).alias("content"), F.coalesce(bad_path(F.col(name).cast("string")), F.lit(True)).alias("bad")).mapInArrow(run, "file string, bytes long, error string")


__all__ = ["bad_path", "compare", "comparison", "image_files", "manifest", "manifest_lines", "pam", "sink", "verify_manifest", "write_manifest"]
