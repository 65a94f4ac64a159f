"""Results as documents: one file for each id, written by tasks and made visible by a commit.

Registered with `spark.dataSource.register(Documents)`; rows are `bucket`,
`name` and `text`, and each bucket is within one partition. Every attempt of a
task writes under a folder of its own that readers of the target don't look at.
Spark tells the driver which attempt of each task counts; the commit gives its
buckets, as folders, their places in one rename each, and drops all else, so
the driver sees buckets and never names. A failed, killed or repeated task
leaves nothing behind, and a run that is repeated leaves one file for each id.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Where attempts write, beneath the target.
HIDDEN = "_attempts"


def _at(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def file_name(name: str, suffix: str) -> str:
    """A document's file name: what a name may not hold becomes its code point in hex."""
    return re.sub(r"[^A-Za-z0-9._-]|^\.", lambda m: f"%{ord(m[0]):x}", name) + suffix


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    buckets: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.suffix = options.get("suffix", ".json")
        self.overwrite = overwrite
        self.run = f"{self.path}/{HIDDEN}/{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> _Written:
        """One attempt of one task: its files, in a folder that no other attempt uses."""
        folder = f"{self.run}/{uuid.uuid4().hex}"
        store, at = _at(folder)
        buckets: set[str] = set()
        for row in rows:
            bucket = f"bucket={row['bucket']:05d}"
            if bucket not in buckets:
                store.create_dir(f"{at}/{bucket}", recursive=True)
                buckets.add(bucket)
            with store.open_output_stream(f"{at}/{bucket}/{file_name(row['name'], self.suffix)}") as f:
                f.write((row["text"] or "").encode())
        return _Written(folder, sorted(buckets))

    def _held(self, store, to: str) -> list[str]:
        from pyarrow import fs

        if store.get_file_info(to).type != fs.FileType.Directory:
            return []
        return [f.base_name for f in store.get_file_info(fs.FileSelector(to)) if f.type == fs.FileType.Directory and f.base_name.startswith("bucket=")]

    def commit(self, messages: list[_Written | None]) -> None:
        """Gives the counted attempts' buckets their places; those of an earlier run go."""
        store, to = _at(self.path)
        store.create_dir(to, recursive=True)
        before = self._held(store, to)
        if before and not self.overwrite:
            self._forget()
            raise ValueError(f"{self.path} holds documents; write with overwrite")
        new = {bucket: m.folder for m in filter(None, messages) for bucket in m.buckets}
        for bucket in before:
            store.delete_dir(f"{to}/{bucket}")
        for bucket, folder in new.items():
            store.move(f"{_at(folder)[1]}/{bucket}", f"{to}/{bucket}")
        self._forget()

    def abort(self, messages: list[_Written | None]) -> None:
        self._forget()

    def _forget(self) -> None:
        from pyarrow import fs

        store, at = _at(self.run)
        if store.get_file_info(at).type == fs.FileType.Directory:
            store.delete_dir(at)
        _, hidden = _at(f"{self.path}/{HIDDEN}")
        if store.get_file_info(hidden).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(hidden)):
            store.delete_dir(hidden)


class Documents(DataSource):
    """Options: path (a folder) and suffix (of file names, .json)."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "bucket int, name string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)


def write(rows: DataFrame, folder: str, *, suffix: str = ".json", overwrite: bool = False, buckets: int = 64) -> None:
    """rows (name, text) as files in folders by a hash of the name, one for each name, in place of what the folder held.

    Of rows that share a name the largest text stands, found by a merging
    aggregate, so a repeated name is no hot group; nameless rows are left out.
    `buckets` should grow with the documents: a folder holds about a
    `buckets`-th of them, and a task writes one folder or more.
    """
    rows.sparkSession.dataSource.register(Documents)
    one = rows.filter("name is not null").groupBy("name").agg(F.max("text").alias("text"))
    dealt = one.select(F.pmod(F.xxhash64("name"), F.lit(buckets)).cast("int").alias("bucket"), "name", "text").repartition(buckets, "bucket")
    dealt.write.format("documents").option("path", folder).option("suffix", suffix).mode("overwrite" if overwrite else "append").save()


#: Columns of a single result as a document, in their order, with types.
RESULT = {
    "model_type": "string",
    "document_type": "string",
    "processing_time": "double",
    "raw_response": "string",
    "model_confidence": "double",
    "extracted_fields": "map<string,string>",
    "awk_fallback_used": "boolean",
    "highlights_detected": "int",
    "confidence_score": "double",
    "quality_grade": "string",
    "production_ready": "boolean",
    "ato_compliance_score": "double",
    "validation_passed": "boolean",
    "quality_flags": "array<string>",
    "recommendations": "array<string>",
    "errors": "array<string>",
}


def result_json(results: DataFrame, name: Column) -> DataFrame:
    """name and text: each result as a JSON object with the 16 keys of RESULT, nulls where it has no such column."""
    fields = [(F.col(c) if c in results.columns else F.lit(None)).cast(t).alias(c) for c, t in RESULT.items()]
    return results.select(name.cast("string").alias("name"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("text"))


def result_text(results: DataFrame, name: Column) -> DataFrame:
    """name and text: `field: value` lines of a result's fields, in their order, without empty ones and those that start with an underscore."""
    shown = F.filter(F.map_entries("extracted_fields"), lambda e: ~e["key"].startswith("_") & (F.coalesce(e["value"], F.lit("")) != ""))
    lines = F.transform(shown, lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return results.select(name.cast("string").alias("name"), F.array_join(lines, "\n").alias("text"))


def batch_json(results: DataFrame, analysis: DataFrame, batch: str, by: str, timestamp: Column) -> DataFrame:
    """name and text: `{results, analysis, timestamp}` of each batch, failed results with their error only.

    results has column `by`, which names batches of a size that one file may
    have; analysis has a row for each of them.
    """
    well = F.struct(*[F.col(c) for c in results.columns if c not in (by, "error")])
    ill = F.struct("doc_id", "success", "error")
    row = F.when(F.col("success"), F.to_json(well, {"ignoreNullFields": "false"})).otherwise(F.to_json(ill, {"ignoreNullFields": "false"}))
    listed = results.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("doc_id", row.alias("json")))).alias("rows"))
    told = analysis.select(by, F.to_json(F.struct(*[F.col(c) for c in analysis.columns if c != by])).alias("analysis"))
    text = F.concat(F.lit('{"results":['), F.array_join(F.transform("rows", lambda r: r["json"]), ","), F.lit('],"analysis":'), F.coalesce("analysis", F.lit("null")), F.lit(',"timestamp":"'), timestamp.cast("string"), F.lit('"}'))
    return listed.join(told, by, "left").select(F.concat(F.lit(f"{batch}_"), F.col(by).cast("string")).alias("name"), text.alias("text"))
