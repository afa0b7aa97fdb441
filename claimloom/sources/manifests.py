"""A data source of JSON lines under a manifest: written in two steps, read by parts, every part held to its digest.

Tasks write parts under names of their own; only when all have succeeded the driver puts the manifest in place, which names parts, rows and
digests. A reader sees what the manifest names. Digests add up rows' hashes, so they don't depend on the order of rows or parts; a
part that was changed, or a part that is missing, stops the read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MANIFEST = "_manifest.json"
#: Bytes of lines that are turned into rows at once.
BATCH_BYTES = 4 << 20
_MOD = 1 << 64


def line_digest(line: bytes) -> int:
    return int.from_bytes(hashlib.sha256(line).digest()[:8], "big")


def digest(lines: Iterator[bytes]) -> tuple[int, str]:
    """Number of lines and their digest, whatever their order; repeated lines count."""
    n = total = 0
    for line in lines:
        n, total = n + 1, (total + line_digest(line)) % _MOD
    return n, f"{total:016x}"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def manifest(path: str) -> dict:
    """The manifest under ``path``: schema, rows, digest and parts (name, rows, digest)."""
    files, root = _place(path)
    with files.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def vacuum(path: str) -> int:
    """Remove parts that the manifest doesn't name, as tasks leave them that still wrote when their job was given up; for times without a writer. The number of parts removed."""
    files, root = _place(path)
    named = {p["name"] for p in manifest(path)["parts"]}
    stray = [f.path for f in files.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("part-") and f.base_name not in named]
    for f in stray:
        files.delete_file(f)
    return len(stray)


@dataclass
class Part(InputPartition):
    name: str
    rows: int
    digest: str


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int
    digest: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[Part]:
        return [Part(**p) for p in manifest(self.path)["parts"]]

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # a manifest without parts
            return
        files, root = _place(self.path)
        schema = to_arrow_schema(self.schema)
        # first to check, so that nothing of a changed part gets out, then for its rows
        with files.open_input_stream(f"{root}/{part.name}") as raw:
            n, found = digest(_lines(raw))
        if (n, found) != (part.rows, part.digest):
            raise ValueError(f"{part.name} isn't what the manifest says: {n} rows with digest {found}, expected {part.rows} with {part.digest}")
        held, size = [], 0
        with files.open_input_stream(f"{root}/{part.name}") as raw:
            for line in _lines(raw):
                held.append(json.loads(line))
                size += len(line)
                if size > BATCH_BYTES:
                    yield _batch(held, schema)
                    held, size = [], 0
        if held:
            yield _batch(held, schema)


def _lines(raw) -> Iterator[bytes]:
    """Lines of a stream without their ends, a block at a time."""
    rest = b""
    while block := raw.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    columns = []
    for f in schema:
        values = [r.get(f.name) for r in rows]
        columns.append(pa.array(values, pa.string()).cast(f.type) if pa.types.is_timestamp(f.type) or pa.types.is_date(f.type) or pa.types.is_decimal(f.type) else pa.array(values, f.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite
        self.names = [f.name for f in schema.fields]
        self.run = uuid.uuid4().hex[:12]

    def write(self, rows: Iterator) -> Written:
        files, root = _place(self.path)
        files.create_dir(root, recursive=True)
        name = f"part-{self.run}-{uuid.uuid4().hex}.jsonl"
        out, n, total = None, 0, 0
        try:
            for row in rows:
                line = json.dumps(dict(zip(self.names, row.asDict(recursive=True).values(), strict=True)), ensure_ascii=False, separators=(",", ":"), default=str).encode()
                out = out or files.open_output_stream(f"{root}/{name}")
                out.write(line + b"\n")
                n, total = n + 1, (total + line_digest(line)) % _MOD
        except BaseException:
            if out:
                out.close()
                files.delete_file(f"{root}/{name}")
            raise
        if out:
            out.close()
        return Written(name if n else None, n, f"{total:016x}")

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _place(self.path)
        files.create_dir(root, recursive=True)
        parts = sorted((m for m in messages if m and m.name), key=lambda m: m.name)
        before = manifest(self.path)["parts"] if not self.overwrite and files.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File else []
        parts = before + [{"name": m.name, "rows": m.rows, "digest": m.digest} for m in parts]
        body = {"schema": self.schema.jsonValue(), "rows": sum(p["rows"] for p in parts), "digest": f"{sum(int(p['digest'], 16) for p in parts) % _MOD:016x}", "parts": parts}
        with files.open_output_stream(f"{root}/{MANIFEST}.{self.run}") as f:
            f.write(json.dumps(body).encode())
        files.move(f"{root}/{MANIFEST}.{self.run}", f"{root}/{MANIFEST}")
        self._sweep({p["name"] for p in parts})

    def abort(self, messages: list[Written | None]) -> None:
        """Remove what this run's tasks have left so far; what others of them still write is seen by no reader and goes with :func:`vacuum`."""
        files, root = _place(self.path)
        for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(f"part-{self.run}-"):
                files.delete_file(f.path)

    def _sweep(self, named: set[str]) -> None:
        """Remove parts that no manifest names: those of repeated tasks, and old ones after an overwrite."""
        files, root = _place(self.path)
        for f in files.get_file_info(fs.FileSelector(root)):
            if f.base_name.startswith("part-") and f.base_name not in named and (self.overwrite or f.base_name.startswith(f"part-{self.run}-")):
                files.delete_file(f.path)


class ManifestSource(DataSource):
    """``spark.read.format("manifest").load(path)`` and ``df.write.format("manifest").mode(..).save(path)``; register it with ``spark.dataSource.register``.

    Append adds parts, overwrite replaces all. Dates, timestamps and decimals are written as text and read back by the schema that the manifest holds. A folder
    without a manifest can't be read.
    """

    @classmethod
    def name(cls) -> str:
        return "manifest"

    def schema(self) -> StructType:
        return StructType.fromJson(manifest(self.options["path"])["schema"])

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema, overwrite)
