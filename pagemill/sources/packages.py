"""Packages as tables of files: scans of folders and archives, what a package is, and writing archives."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.paths import is_safe_package_path, path_key

FILES, ENTRY_BYTES, TOTAL_BYTES, RATIO = 1024, 64 << 20, 512 << 20, 200
#: Names of the files that make a package (fixed values).
ARTICLE, RESULT = "article.md", "mineru-result.json"
ENTRIES = "package_id string, path string, size long, crc32 long, content binary, problem string"


def normal_path(path: Column) -> Column:
    """Slashes forward, without one leading ``./``."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def scan_folder(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files of packages below a folder, one subfolder each: package_id, path, size, sha256, content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    inside = F.regexp_extract("path", r"/([^/]+/[^/].*)$", 1)
    root = F.lit(folder.rstrip("/") + "/")
    at = F.instr(F.col("path"), root)
    inside = F.when(at > 0, F.substring("path", at + F.length(root), F.length("path"))).otherwise(inside)
    return raw.select(
        F.split(inside, "/").getItem(0).alias("package_id"), normal_path(F.regexp_replace(inside, "^[^/]+/", "")).alias("path"),
        F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content",
    )


def path_collisions(files: DataFrame) -> DataFrame:
    """Paths of a package that are one file for a file system that folds case: package_id, key, paths."""
    keyed = files.select("package_id", "path", path_key(normal_path(F.col("path"))).alias("key")).distinct()
    return keyed.groupBy("package_id", "key").agg(F.array_sort(F.collect_list("path")).alias("paths")).filter(F.size("paths") > 1)


def read_archive(data: bytes, entry_bytes: int = ENTRY_BYTES, total_bytes: int = TOTAL_BYTES, files: int = FILES, ratio: int = RATIO) -> Iterator[tuple[str, bytes | None, int, str | None]]:
    """Entries of a ZIP archive: path, content, CRC-32, problem. An archive that breaks a rule as a whole gives one row with the problem."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        infos = [i for i in archive.infolist() if not i.is_dir()]
    except (zipfile.BadZipFile, ValueError, NotImplementedError):
        yield "", None, 0, "not-an-archive"
        return
    if len(infos) > files:
        yield "", None, 0, "too-many-files"
        return
    if sum(i.file_size for i in infos) > total_bytes:
        yield "", None, 0, "too-large"
        return
    seen: set[str] = set()
    for i in sorted(infos, key=lambda i: i.filename.encode("utf-16-be")):
        key = i.filename.lower()
        problem = (
            "encrypted" if i.flag_bits & 1 else "method" if i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)
            else "link" if (i.external_attr >> 16) & 0o170000 == 0o120000 else "too-large" if i.file_size > entry_bytes
            else "ratio" if i.file_size > 1 << 20 and i.file_size > ratio * max(1, i.compress_size) else "conflicting-path" if key in seen else None
        )
        seen.add(key)
        if problem:
            yield i.filename, None, i.CRC, problem
            continue
        try:
            with archive.open(i) as f:
                content = f.read(i.file_size + 1)
        except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError):
            yield i.filename, None, i.CRC, "damaged"
            continue
        ok = len(content) == i.file_size and zlib.crc32(content) == i.CRC
        yield i.filename, content if ok else None, i.CRC, None if ok else "damaged"


def archive_entries(archives: DataFrame) -> DataFrame:
    """Entries of ZIP archives (package_id, content): see ``ENTRIES``; unsafe paths are a problem too.

    A null content has no entries; an empty one is not an archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pid, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if data is None:
                    continue
                rows = [(pid, p, len(c) if c is not None else None, crc, c, why) for p, c, crc, why in read_archive(data)]
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
                cols = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in ENTRIES.split(", ")])

    out = archives.select("package_id", "content").mapInArrow(run, ENTRIES)
    unsafe = (F.col("problem").isNull()) & ~is_safe_package_path(F.col("path"))
    return out.withColumn("problem", F.when(unsafe, "invalid-path").otherwise(F.col("problem")))


_MARKDOWN = r"(?i)\.md$"
_README = r"(?i)(?:^|/)readme(?:\.[a-z-]+)?\.md$"


def detect_source(files: DataFrame) -> DataFrame:
    """What each package is, by its files: package_id, format, article, content_list.

    In this order: an article with an extraction result, an article, a Markdown file
    with a content list of its name (or the only Markdown with the only list), the
    only Markdown, the only HTML without Markdown; else unknown.
    """
    p = normal_path(F.col("path"))
    top = ~p.contains("/")
    per = files.groupBy("package_id").agg(F.collect_set(p).alias("all"), F.array_sort(F.collect_set(F.when(top, p))).alias("top"))
    keep = lambda pattern: F.filter("top", lambda x: x.rlike(pattern))
    md = F.filter("top", lambda x: x.rlike(_MARKDOWN) & ~x.rlike(_README))
    stable, second = keep(r"(?i)^(?:.+_)?content_list\.json$"), keep(r"(?i)^(?:.+_)?content_list_v2\.json$")
    per = per.select("package_id", "all", md.alias("md"), F.concat(stable, second).alias("lists"), stable.alias("stable"), second.alias("second"), keep(r"(?i)\.html?$").alias("html"))
    stem = lambda x: F.lower(F.concat(F.regexp_replace(x, r"(?i)_?content_list(?:_v2)?\.json$", ""), F.lit(".md")))
    own = F.filter("lists", lambda x: F.exists("md", lambda m: F.lower(m) == stem(x)))
    only = F.when((F.size("md") == 1) & (F.size("stable") == 1), F.get("stable", F.lit(0))).when((F.size("md") == 1) & (F.size("stable") == 0) & (F.size("second") == 1), F.get("second", F.lit(0)))
    lst = F.coalesce(F.get(own, F.lit(0)), only)
    article = F.coalesce(F.get(F.filter("md", lambda m: F.lower(m) == stem(lst)), F.lit(0)), F.get("md", F.lit(0)))
    has = lambda name: F.array_contains("all", name)
    return per.select(
        "package_id",
        F.when(has(ARTICLE) & has(RESULT), "extraction").when(has(ARTICLE), "article").when(lst.isNotNull(), "extraction")
        .when(F.size("md") == 1, "markdown").when((F.size("md") == 0) & (F.size("html") == 1), "html").otherwise("unknown").alias("format"),
        F.when(has(ARTICLE), ARTICLE).when(lst.isNotNull(), article).when(F.size("md") == 1, F.get("md", F.lit(0))).when((F.size("md") == 0) & (F.size("html") == 1), F.get("html", F.lit(0))).alias("article"),
        F.when(has(ARTICLE) & has(RESULT), RESULT).when(~has(ARTICLE), lst).alias("content_list"),
    )


def build_archives(files: DataFrame) -> DataFrame:
    """A ZIP archive of each package (package_id, path, content): package_id, files, sha256, content.

    Entries are sorted and have a fixed time, so equal files give equal bytes. A
    package has a bounded size, so one package is one task. Unsafe or colliding
    paths are an error.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
            names = sorted(pdf["path"], key=lambda p: p.encode("utf-16-be"))
            if len({n.lower() for n in names}) < len(names):
                raise ValueError(f"colliding paths in {pdf['package_id'].iloc[0]}")
            by = dict(zip(pdf["path"], pdf["content"]))
            for n in names:
                info = zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0))
                info.compress_type, info.external_attr, info.create_system = zipfile.ZIP_DEFLATED, 0o644 << 16, 3
                z.writestr(info, bytes(by[n]))
        data = out.getvalue()
        return pd.DataFrame({"package_id": [pdf["package_id"].iloc[0]], "files": [len(pdf)], "sha256": [hashlib.sha256(data).hexdigest()], "content": [data]})

    safe = files.select("package_id", F.when(is_safe_package_path(F.col("path")), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("unsafe path: "), F.col("path")))).alias("path"), "content")
    return safe.groupBy("package_id").applyInPandas(pack, "package_id string, files long, sha256 string, content binary")


def manifest_rows(files: DataFrame) -> DataFrame:
    """One manifest for each package (package_id, path, content): outputs sorted by path, as in the manifests table."""
    record = F.struct("path", F.octet_length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("sha256"))
    return files.groupBy("package_id").agg(F.sort_array(F.collect_list(record)).alias("outputs"))


def write_packages(files: DataFrame, target: str) -> None:
    """Writes the files as a table partitioned by package; an existing target is an error, never overwritten."""
    files.write.mode("errorifexists").partitionBy("package_id").parquet(target)
