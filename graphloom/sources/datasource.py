"""RDF files as a Spark data source: ``spark.read.format("rdf")`` and ``df.write.format("rdf")``.

    spark.dataSource.register(RdfSource)
    spark.read.format("rdf").option("mode", "PERMISSIVE").load("/data/kg")

Files below the path are packed into partitions of about ``partitionBytes``; a
file's form is told by its suffix and, where that fails or says nothing, by trying
all. Rows are triples with their graph and file. A file that no form fits is an
error (``FAILFAST``) or one row whose ``error`` says why (``PERMISSIVE``);
``DROPMALFORMED`` leaves it out. Options: ``glob``, ``form`` (turtle, trig,
rdfxml, jsonld), ``mode``, ``partitionBytes``.

Writing gives one TriG file a task, moved to its place when the job commits, so a
task that is run again leaves nothing behind. Blank nodes keep their names.

Paths are opened by Arrow's file systems (local ones, HDFS, object stores). Where
only Spark can open a path, ``read_quads`` gives the same rows through its reader.
"""

from __future__ import annotations

import fnmatch
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from graphloom.plans.parser import QueryError
from graphloom.sources.quads import parse_jsonld, parse_trig, trig_line
from graphloom.sources.rdf import parse_turtle
from graphloom.sources.rdfxml import parse_rdfxml
from graphloom.terms import TRIPLE_FIELDS, TRIPLE_SCHEMA

FIELDS = [*TRIPLE_FIELDS, "graph", "file", "error"]
SCHEMA = f"{TRIPLE_SCHEMA}, graph string, file string, error string"
PARTITION_BYTES = 64 << 20
MODES = ("FAILFAST", "PERMISSIVE", "DROPMALFORMED")


def _plain(parse):
    return lambda text, name: [(*row, "") for row in parse(text, name)]


FORMS = {"turtle": _plain(parse_turtle), "trig": parse_trig, "rdfxml": _plain(parse_rdfxml), "jsonld": parse_jsonld}
SUFFIXES = {".ttl": "turtle", ".nt": "turtle", ".n3": "turtle", ".trig": "trig", ".rdf": "rdfxml", ".owl": "rdfxml", ".xml": "rdfxml", ".jsonld": "jsonld", ".json": "jsonld"}


def parse_file(text: str, name: str, form: str | None = None) -> list[tuple]:
    """Rows of a file: its given form only, else by its suffix first and then all others."""
    if form:
        return FORMS[form](text, name)
    first = SUFFIXES.get(posixpath.splitext(name)[1].lower())
    errors = []
    for one in dict.fromkeys([*([first] if first else []), *FORMS]):
        try:
            return FORMS[one](text, name)
        except (QueryError, IndexError) as e:
            errors.append(f"{one}: {e}")
    raise QueryError("syntax", "; ".join(errors))


def file_rows(text: str, name: str, mode: str, form: str | None = None) -> list[tuple]:
    try:
        return [(*row, name, None) for row in parse_file(text, name, form)]
    except QueryError as e:
        if mode == "FAILFAST":
            raise QueryError("syntax", f"{name}: {e}") from e
        return [(*[None] * (len(FIELDS) - 2), name, str(e))] if mode == "PERMISSIVE" else []


def _batches(rows: list[tuple], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(rows), most):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows[lo : lo + most])], FIELDS)


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (pafs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    names: list[str]


class RdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.mode, self.form = options.get("mode", "FAILFAST").upper(), options.get("form")
        self.limit = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        if self.mode not in MODES or (self.form and self.form not in FORMS):
            raise ValueError(f"mode must be one of {MODES}, form one of {tuple(FORMS)}")

    def partitions(self) -> list[Files]:
        """Files in order of their names, packed up to the limit; a larger file is a partition of its own."""
        fs, path = _opened(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        hidden = lambda f: any(p.startswith(("_", ".")) for p in f.path[len(path) :].split("/"))
        files = sorted((f for f in found if f.type == pafs.FileType.File and (f is info or not hidden(f)) and fnmatch.fnmatch(f.base_name, self.glob)), key=lambda f: f.path)
        parts, held = [Files([])], 0
        for f in files:
            if parts[-1].names and held + f.size > self.limit:
                parts, held = [*parts, Files([])], 0
            parts[-1].names.append(f.path)
            held += f.size
        return parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(self.path)
        for name in partition.names:
            with fs.open_input_stream(name, compression=None) as f:
                text = f.read().decode("utf-8", "replace")
            yield from _batches(file_rows(text, name, self.mode, self.form))


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class RdfWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, rows) -> Written:
        fs, path = _opened(self.path)
        name, out = f"part-{uuid.uuid4().hex}.trig", None
        try:
            for row in rows:
                if out is None:
                    fs.create_dir(f"{path}/_writing-{self.job}", recursive=True)
                    out = fs.open_output_stream(f"{path}/_writing-{self.job}/{name}")
                given = row.asDict()
                line = trig_line([given.get(c) or "" for c in [*TRIPLE_FIELDS, "graph"]])
                out.write((line + "\n").encode())
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None)

    def commit(self, messages: list[Written]) -> None:
        fs, path = _opened(self.path)
        fs.create_dir(path, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(path)):
                if f.type == pafs.FileType.File and f.extension == "trig":
                    fs.delete_file(f.path)
        for m in messages:
            if m is not None and m.name:
                fs.move(f"{path}/_writing-{self.job}/{m.name}", f"{path}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list[Written]) -> None:
        fs, path = _opened(self.path)
        if fs.get_file_info(f"{path}/_writing-{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{path}/_writing-{self.job}")


class RdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RdfReader:
        return RdfReader(self.options)

    def writer(self, schema, overwrite: bool) -> RdfWriter:
        return RdfWriter(self.options, overwrite)


def read_quads(spark: SparkSession, path: str, mode: str = "FAILFAST", glob: str = "*", form: str | None = None) -> DataFrame:
    """The same rows, read by Spark's own file reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                yield from _batches(file_rows(raw.decode("utf-8", "replace"), name, mode, form))

    return files.mapInArrow(run, SCHEMA)
