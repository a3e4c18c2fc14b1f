"""python -m tesserae MODE FOLDER [...]: scans a folder of images and prints or writes what a mode makes of them.

probe FOLDER                 a line per file: kind, format, size, error
decode FOLDER OUT            lossless stills as portable anymaps
alpha FOLDER OUT             alpha planes as raw bytes
yuv FOLDER OUT TABLES        lossy frames as raw YUV, with the probability tables of that CSV
remux FOLDER OUT             canonical files
hash FOLDER MANIFEST         hashes of lossless pixels
verify FOLDER MANIFEST       those hashes against a manifest; fails if one is missing or differs
compare ACTUAL ORACLE        files of two folders, byte by byte; fails if none is compared or one differs
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import alpha, demux, mux, vp8_frame, vp8_tables, vp8l
from .sources import files


def named(spark: SparkSession, folder: str) -> DataFrame:
    return files.image_files(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _as(rows: DataFrame, suffix: str, content) -> DataFrame:
    return rows.select(F.regexp_replace("file", r"\.webp$", suffix).alias("file"), content.alias("content"))


def _chunks(spark: SparkSession, folder: str, tag: str) -> DataFrame:
    """(n, file, width, height, payload) of the files that have such a chunk."""
    rows = demux.demux(named(spark, folder), "file", payloads=True)
    found = F.get(F.filter("chunks", lambda c: c["tag"] == tag), F.lit(0))["payload"]
    return rows.select(F.xxhash64("file").alias("n"), "file", F.col("width").cast("int"), F.col("height").cast("int"), found.alias("payload")).where("payload is not null")


def run(spark: SparkSession, mode: str, *at: str) -> tuple[DataFrame, bool]:
    """The mode's rows, and whether it passed."""
    if mode == "probe":
        return demux.demux(named(spark, at[0]), "file").select("file", "file_kind", "format", "width", "height", "has_alpha", "is_animation", "error"), True
    if mode == "decode":
        done = vp8l.decode_files(named(spark, at[0]), "file")
        return files.sink(_as(done.where("error is null"), ".pam", files.pam(F.col("width"), F.col("height"), F.col("pixels"))), at[1]), True
    if mode == "alpha":
        rows = _chunks(spark, at[0], "ALPH")
        return files.sink(_as(alpha.decode_planes(rows, "n").join(rows.select("n", "file"), "n"), ".alpha", F.col("plane")), at[1]), True
    if mode == "yuv":
        rows = _chunks(spark, at[0], "VP8 ")
        done = vp8_frame.decode_frames(rows, "n", vp8_tables.read_tables(spark, at[2])).select("n", "yuv")
        return files.sink(_as(done.join(rows.select("n", "file"), "n"), ".yuv", F.col("yuv")), at[1]), True
    if mode == "remux":
        rows = named(spark, at[0]).withColumn("n", F.xxhash64("file"))
        return files.sink(mux.remux_files(rows, "n").join(rows.select("n", "file"), "n"), at[1]), True
    if mode in ("hash", "verify"):
        done = vp8l.decode_files(named(spark, at[0]), "file").where("error is null")
        hashes = done.select("file", F.lit("rgba").alias("kind"), F.sha2("pixels", 256).alias("sha256"))
        if mode == "hash":
            files.write_manifest(hashes, at[1])
            return files.manifest(spark, at[1]), True
        status = files.verify_manifest(files.manifest(spark, at[1]).where("kind = 'rgba'"), hashes)
        return status, status.where("status <> 'ok'").isEmpty()
    if mode == "compare":
        any_file = lambda d: spark.read.format("binaryFile").load(d).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
        out = files.comparison(files.compare(any_file(at[0]), any_file(at[1])))
        return out, out.first().passed
    raise ValueError(f"no such mode: {mode}")


def main(arguments: list[str]) -> int:
    if len(arguments) < 2:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("tesserae").getOrCreate()
    rows, passed = run(spark, *arguments)
    for r in rows.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in r))
    return 0 if passed else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
