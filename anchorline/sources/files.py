"""Document files, the parts of containers, and block tables."""

from __future__ import annotations

import functools
import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.parts import MEDIA, TEXTS
from ..operators.routing import IMAGE_MIME

#: Bytes of one part and of all parts of a container, unpacked, beyond which it is an error.
MAX_PART_BYTES, MAX_TOTAL_BYTES = 256 * 1024 * 1024, 1024 * 1024 * 1024
#: Bytes of parts or files that are handed on together, and files.
BATCH_BYTES, BATCH_FILES = 8 << 20, 1000

#: What opening a file counts for, in bytes, where a task is given files; Spark's own 4 MB would put 32 small documents into a task.
OPEN_BYTES = 64 * 1024

#: Parts that are read as text; a mind map has no images that count.
_READ = re.compile(r"\.(xml|rels|json)$", re.I)
_BAD = (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError, OSError)
_TEXTS = pa.list_(pa.struct([("part_no", pa.int32()), ("part_path", pa.string()), ("text", pa.string())]))
_MEDIA = pa.list_(pa.struct([("part_no", pa.int32()), ("part_path", pa.string()), ("mime", pa.string()), ("sha", pa.string())]))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files as ``path, modificationTime, length, content, name, doc_id``; the id is a hash of the path. The driver lists them, so millions want :func:`read_listed`."""
    files = spark.read.format("binaryFile").load(path)
    return files.withColumns({"name": F.element_at(F.split("path", "/"), -1), "doc_id": F.xxhash64("path")})


def read_listed(paths: DataFrame) -> DataFrame:
    """The files of ``paths(path)`` as ``path, length, content, name, doc_id``; as :func:`read_documents`, for any number of files.

    Spark's own reader holds several kilobytes a file in the driver, which lists and deals them. Here the driver knows the tables of
    paths alone: paths are dealt evenly, once each, and tasks open the files by their URI and hand them on in bounded batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = functools.cache(_opened_folder)
        for batch in batches:
            at, found, size = [], [], 0
            for path in batch.column(0).to_pylist():
                folder, _, name = path.rpartition("/")
                to, root = opened(folder)
                with to.open_input_stream(f"{root}/{name}") as file:
                    content = file.read()
                at.append(path), found.append(content)
                size += len(content)
                if size >= BATCH_BYTES or len(at) >= BATCH_FILES:
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.string()), pa.array(found, pa.binary())], ["path", "content"])
                    at, found, size = [], [], 0
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.string()), pa.array(found, pa.binary())], ["path", "content"])

    dealt = paths.select("path").repartition(4 * paths.sparkSession.sparkContext.defaultParallelism, "path").dropDuplicates()
    files = dealt.mapInArrow(run, "path string, content binary")
    return files.select("path", F.octet_length("content").cast("long").alias("length"), "content", F.element_at(F.split("path", "/"), -1).alias("name"), F.xxhash64("path").alias("doc_id"))


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Jobs and streams that are started inside deal files to tasks by their size, so a task has many small ones, and list named files in a few tasks a core, not one a file."""
    wanted = {"spark.sql.files.openCostInBytes": OPEN_BYTES, "spark.sql.sources.parallelPartitionDiscovery.parallelism": 4 * spark.sparkContext.defaultParallelism}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _opened(content: bytes, part_bytes: int, total_bytes: int) -> tuple[zipfile.ZipFile, list[zipfile.ZipInfo]]:
    z = zipfile.ZipFile(io.BytesIO(content or b""))
    infos = [i for i in z.infolist() if not i.is_dir()]
    if any(i.file_size > part_bytes for i in infos) or sum(i.file_size for i in infos) > total_bytes:
        raise ValueError("container_too_large")
    return z, infos


def _image_mime(path: str) -> str | None:
    return IMAGE_MIME.get(path.rpartition(".")[2].lower()) if "." in path else None


def _package(content: bytes, part_bytes: int, total_bytes: int) -> tuple[list, list, str | None, int]:
    """Texts and images of a container, an error, and how many bytes of text. No content is a container that cannot be read."""
    if not content:
        return [], [], "bad_container: BadZipFile", 0
    texts, media, size = [], [], 0
    try:
        z, infos = _opened(content, part_bytes, total_bytes)
        with z:
            for k, info in enumerate(infos):
                if _READ.search(info.filename):
                    text = z.read(info).decode("utf-8", "replace")
                    texts.append((k, info.filename, text))
                    size += len(text)
                elif info.file_size and (mime := _image_mime(info.filename)):
                    digest = hashlib.sha256()
                    with z.open(info) as part:
                        while piece := part.read(1 << 20):
                            digest.update(piece)
                    media.append((k, info.filename, mime, digest.hexdigest()))
    except ValueError as e:
        return [], [], str(e), 0
    except _BAD as e:
        return [], [], f"bad_container: {type(e).__name__}", 0
    return texts, media, None, size


def unpack_packages(files: DataFrame, *keep: str, part_bytes: int = MAX_PART_BYTES, total_bytes: int = MAX_TOTAL_BYTES) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``texts``, ``media`` and ``error`` of ZIP containers ``files(doc_id, content)``, a row each.

    A container is unpacked where it is read. Of images only hashes come out; their bytes stay behind (:func:`image_bytes`).
    One container is held at a time, and rows are handed on in bounded batches. A container that cannot be read, or that is
    too large unpacked, is a row with an ``error``.
    """
    given = files.select("doc_id", *keep, "content")
    names = ["doc_id", *keep, "texts", "media", "error"]
    held = [k for k, f in enumerate(given.schema.fields[:-1]) if f.dataType.simpleString() == "binary"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts, media, errors, size = [], [], [], [], 0

            def told(batch=batch, at=at, texts=texts, media=media, errors=errors):
                rows = pa.array(at, pa.int64())
                out = [*(batch.column(c).take(rows) for c in range(1 + len(keep))), pa.array(texts, _TEXTS), pa.array(media, _MEDIA), pa.array(errors, pa.string())]
                return pa.RecordBatch.from_arrays(out, names)

            for k in range(batch.num_rows):
                own_texts, own_media, error, n = _package(batch.column(1 + len(keep))[k].as_py(), part_bytes, total_bytes)
                at.append(k), texts.append(own_texts), media.append(own_media), errors.append(error)
                size += n + sum(len(batch.column(c)[k].as_buffer() or b"") for c in held if batch.column(c)[k].is_valid)
                if size >= BATCH_BYTES:
                    yield told()
                    at.clear(), texts.clear(), media.clear(), errors.clear()
                    size = 0
            yield told()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{kinds}, texts {TEXTS}, media {MEDIA}, error string")


def image_bytes(files: DataFrame, part_bytes: int = MAX_PART_BYTES, total_bytes: int = MAX_TOTAL_BYTES) -> DataFrame:
    """``doc_id, part_path, mime, sha, content`` of the images in ZIP containers ``files(doc_id, content)``, one part at a time; those that cannot be read give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    z, infos = _opened(content.as_py(), part_bytes, total_bytes)
                    with z:
                        for info in infos:
                            if info.file_size and not _READ.search(info.filename) and (mime := _image_mime(info.filename)):
                                data = z.read(info)
                                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], pa.int64()), pa.array([info.filename]), pa.array([mime]), pa.array([hashlib.sha256(data).hexdigest()]), pa.array([data], pa.binary())], ["doc_id", "part_path", "mime", "sha", "content"])
                except (ValueError, *_BAD):
                    continue

    return files.select("doc_id", "content").mapInArrow(run, "doc_id long, part_path string, mime string, sha string, content binary")


def packed(packages: DataFrame) -> DataFrame:
    """``name, content``: ZIP containers of ``packages(name, texts, media)``, of texts by path and images ``(part_path, content)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, texts, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    for part in texts or []:
                        z.writestr(part["part_path"], part["text"] or "")
                    for part in media or []:
                        z.writestr(part["part_path"], part["content"] or b"")
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([out.getvalue()], pa.binary())], ["name", "content"])

    return packages.select("name", "texts", "media").mapInArrow(run, "name string, content binary")


def _opened_folder(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_files(files: DataFrame, folder: str, lists: str | None = None) -> int:
    """Write ``files(name, content)`` into a folder that tasks reach by its URI, and say how many. A file that is written again is the same file, and one of null content is empty.

    The paths go into the table ``lists``, where it is named, so that nobody has to list the folder (:func:`read_listed`).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, at = _opened_folder(folder)
        to.create_dir(at, recursive=True)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for name, content in zip(names, batch.column(1), strict=True):
                with to.open_output_stream(f"{at}/{name}") as out:
                    out.write(content.as_buffer() or b"")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}" for name in names], pa.string())], ["path"])

    written = files.select("name", "content").mapInArrow(run, "path string")
    if lists is None:
        return written.count()
    observed = Observation()
    written.observe(observed, F.count(F.lit(1)).alias("files")).write.mode("append").parquet(lists)
    return observed.get["files"]


def write_blocks(blocks: DataFrame, path: str, containers: DataFrame | None = None) -> None:
    """Block rows by document type; image bytes apart, under their hash, so that blocks stay light: those inside of texts, and those of ``containers(doc_id, content)``."""
    blocks.drop("content").write.mode("error").partitionBy("doc_type").parquet(f"{path}/blocks")
    images = image_content(blocks)
    if containers is not None:
        images = images.unionByName(image_bytes(containers).select("doc_id", "sha", "content"), allowMissingColumns=True)
    images.write.mode("error").parquet(f"{path}/image_content")


def image_content(blocks: DataFrame) -> DataFrame:
    """Images whose bytes are in their blocks."""
    return blocks.where("type = 'image' and content is not null").select("doc_id", "block_no", "id", "content", "sha")
