"""Notes on a file system: scan, list, read, write and append."""

from __future__ import annotations

import posixpath
import re
import threading
from collections import defaultdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTE = r"(?i)\.(md|txt)$"
_SCANNED = "path string, mtime_ms bigint, size bigint, content string"
_locks: defaultdict[str, threading.Lock] = defaultdict(threading.Lock)
_guard = threading.Lock()


def scan_vault(spark: SparkSession, vault_dir: str, with_content: bool = True) -> DataFrame:
    """(path, mtime_ms, size, content) of all notes below a directory; a missing one is empty.

    Paths are relative, with slashes. The extension decides, in any case. Without content only the listing is read.
    """
    if not _exists(spark, vault_dir):
        return spark.createDataFrame([], _SCANNED)
    return _scanned(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(vault_dir), vault_dir, with_content)


def _scanned(files: DataFrame, vault_dir: str, with_content: bool) -> DataFrame:
    text = F.decode("content", "UTF-8") if with_content else F.lit(None).cast("string")
    return files.filter(F.col("path").rlike(NOTE)).select(relative(vault_dir).alias("path"), F.floor(F.unix_micros("modificationTime") / 1000).alias("mtime_ms"), F.col("length").alias("size"), text.alias("content"))


def relative(vault_dir: str) -> F.Column:
    """Path of a scanned file below the vault; the scheme is dropped, blanks are kept as they are."""
    root = vault_dir.split(":", 1)[-1].rstrip("/") + "/"
    bare = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/")
    return F.substring(F.url_decode(F.regexp_replace(bare, r"\+", "%2B")), F.lit(len("/" + root.lstrip("/")) + 1), F.length(bare))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def list_notes(spark: SparkSession, vault_dir: str, prefix: str = "") -> DataFrame:
    """(path, size, mtime) of the notes whose path starts with ``prefix``; mtime in ISO form."""
    rows = scan_vault(spark, vault_dir, with_content=False)
    rows = rows.filter(F.col("path").startswith(prefix)) if prefix else rows
    return rows.select("path", "size", F.date_format(F.timestamp_millis("mtime_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("mtime"))


def read_note(spark: SparkSession, vault_dir: str, path: str) -> DataFrame:
    """(path, mtime_ms, size, content) of one note; raises if it is missing."""
    full, rel = safe_path(vault_dir, path)
    if not full.is_file():
        raise FileNotFoundError(rel)
    return scan_note(spark, vault_dir, rel)


def scan_note(spark: SparkSession, vault_dir: str, rel: str) -> DataFrame:
    """``scan_vault`` of one note by its relative path: no other file is listed or read; empty if it is missing."""
    at = f"{vault_dir.rstrip('/')}/{rel}"
    if not _exists(spark, at):
        return spark.createDataFrame([], _SCANNED)
    escaped = re.sub(r"([\\*?\[\]{}])", r"\\\1", at)
    return _scanned(spark.read.format("binaryFile").load(escaped), vault_dir, True)


def safe_path(vault_dir: str, path: str) -> tuple[Path, str]:
    """(full path, relative path); leading ``..`` are cut off, anything else outside the vault is refused."""
    bare = posixpath.normpath(path.replace("\\", "/"))
    while bare.startswith("../"):
        bare = bare[3:]
    root = Path(vault_dir).resolve()
    full = (root / bare).resolve()
    if full == root or not full.is_relative_to(root):
        raise ValueError(f"{path!r} is outside the vault")
    return full, full.relative_to(root).as_posix()


def lock(path: Path) -> threading.Lock:
    """The lock of one note."""
    with _guard:
        return _locks[str(path)]


def write_note(vault_dir: str, path: str, content: str, overwrite: bool = False) -> str:
    """Creates a note; refuses to replace one unless told to. Gives its relative path."""
    full, rel = safe_path(vault_dir, path)
    with lock(full):
        if full.exists() and not overwrite:
            raise FileExistsError(rel)
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text(content, encoding="utf-8", newline="")
    return rel


def append_note(vault_dir: str, path: str, content: str) -> str:
    """Appends to a note, after a line break or a blank line; creates it if it is missing."""
    full, rel = safe_path(vault_dir, path)
    with lock(full):
        full.parent.mkdir(parents=True, exist_ok=True)
        if full.exists():
            there = full.read_bytes().decode("utf-8")
            content = there + ("\n" if there.endswith("\n") else "\n\n") + content
        full.write_text(content, encoding="utf-8", newline="")
    return rel
