"""Mappings in YAML files as rows, a partition for each file.

Registered with `spark.dataSource.register(YamlMappings)` and read with
`spark.read.format("yaml_mapping").option("suffix", "_prompt").load(folder)`.
A file that is missing, broken or no mapping gives the fallback rows, if the
reader has any, and else a row that carries the error. PyYAML parses the files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, ord int, key string, value string, kind string, error string"


def _files(path: str) -> list[str]:
    """The YAML files at a path: itself, or those in a folder, by name; a path that leads nowhere stands for a missing file."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = store.get_file_info(at)
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    if info.type != fs.FileType.Directory:
        return [path]
    inside = store.get_file_info(fs.FileSelector(at, recursive=True))
    return [scheme + f.path for f in sorted(inside, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.endswith((".yaml", ".yml"))]


def _text(path: str) -> str:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with store.open_input_stream(at) as f:
        return f.read().decode("utf-8")


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.suffix = options.get("suffix", "")
        self.fallback = json.loads(options.get("fallback", "{}"))

    def partitions(self) -> list[_File]:
        return [_File(f) for p in self.paths for f in _files(p)]

    def _rows(self, path: str, mapping: dict, error: str | None) -> Iterator[tuple]:
        for i, (key, value) in enumerate(mapping.items()):
            kind = type(value).__name__
            text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)
            if not self.suffix or (str(key).endswith(self.suffix) and isinstance(value, str)):
                yield path, i, str(key), text, kind, error

    def read(self, partition: _File) -> Iterator[tuple]:
        """key and value of the file's mapping: strings as they stand, all else as JSON; with a suffix, only strings whose key ends with it."""
        try:
            import yaml

            mapping = yaml.safe_load(_text(partition.path))
            if not isinstance(mapping, dict):
                raise ValueError(f"not a mapping but {type(mapping).__name__}")
        except Exception as e:  # whatever is wrong with a file is told in its rows
            error = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
            if self.fallback:
                yield from self._rows(partition.path, self.fallback, error)
            else:
                yield partition.path, None, None, None, None, error
            return
        yield from self._rows(partition.path, mapping, None)


class YamlMappings(DataSource):
    """Options: path (files or folders, comma-separated), suffix (of keys to keep), fallback (a JSON object for files that can't be read)."""

    @classmethod
    def name(cls) -> str:
        return "yaml_mapping"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def mappings(spark: SparkSession, path: str, *, suffix: str = "", fallback: dict[str, str] | None = None) -> DataFrame:
    """file, ord, key, value, kind, error of the mappings at a path."""
    spark.dataSource.register(YamlMappings)
    return spark.read.format("yaml_mapping").option("suffix", suffix).option("fallback", json.dumps(fallback or {})).load(path)
