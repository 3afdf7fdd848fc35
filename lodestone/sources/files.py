"""Source trees: discovery that honours ignore files, languages by extension, whole texts as rows."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions (case-sensitive) of each language.
EXTENSIONS = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp",
    "cs": "csharp", "rs": "rust", "py": "python", "pyi": "python", "go": "go", "java": "java", "php": "php",
}
LANGUAGES = sorted(set(EXTENSIONS.values()))


def language_of(path: Column) -> Column:
    """The language of a path by its extension, or null."""
    pairs = [F.lit(x) for pair in EXTENSIONS.items() for x in pair]
    return F.element_at(F.create_map(*pairs), F.regexp_extract(path, r"\.([^./]+)$", 1))


def parse_languages(text: str) -> list[str]:
    """Names between commas, trimmed; unknown ones are dropped, repeated ones kept."""
    return [x for x in (part.strip() for part in text.split(",")) if x in LANGUAGES]


class Ignored:
    """Patterns of the ignore files above a path; later and deeper ones win, ``!`` takes back."""

    def __init__(self, rules: list[tuple[str, str, bool, bool, bool]] | None = None):
        self.rules = rules or []

    def with_file(self, folder: str, lines: Iterable[str]) -> Ignored:
        rules = list(self.rules)
        for line in lines:
            line = line.rstrip("\n").rstrip()
            if not line or line.startswith("#"):
                continue
            back = line.startswith("!")
            line = line[back:]
            only_dirs = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            pattern = f"{folder}/{line.lstrip('/')}" if anchored else line
            rules.append((pattern.lstrip("/"), folder, back, only_dirs, anchored))
        return Ignored(rules)

    def drops(self, path: str, is_dir: bool) -> bool:
        dropped = False
        for pattern, folder, back, only_dirs, anchored in self.rules:
            if only_dirs and not is_dir:
                continue
            if folder and not path.startswith(folder + "/"):
                continue
            hit = _matches(path, pattern) if anchored else fnmatch.fnmatchcase(os.path.basename(path), pattern)
            if hit:
                dropped = not back
        return dropped


def _matches(path: str, pattern: str) -> bool:
    """Segments against segments; ``**`` stands for any number of them."""

    def at(p: list[str], q: list[str]) -> bool:
        if not q:
            return not p
        if q[0] == "**":
            return any(at(p[k:], q[1:]) for k in range(len(p) + 1))
        return bool(p) and fnmatch.fnmatchcase(p[0], q[0]) and at(p[1:], q[1:])

    return at(path.split("/"), pattern.split("/"))


def discover(root: str, languages: Iterable[str] | None = None) -> list[str]:
    """Paths below a local root, sorted, relative with ``/``: regular files of the languages, neither hidden nor ignored."""
    wanted = {e for e, lang in EXTENSIONS.items() if languages is None or lang in set(languages)}
    found: list[str] = []

    def walk(folder: str, rules: Ignored) -> None:
        here = os.path.join(root, folder)
        for name in (".gitignore", ".ignore"):
            if os.path.isfile(os.path.join(here, name)):
                with open(os.path.join(here, name), encoding="utf-8", errors="replace") as lines:
                    rules = rules.with_file(folder, lines)
        for entry in sorted(os.scandir(here), key=lambda e: e.name):
            path = f"{folder}/{entry.name}".lstrip("/")
            if entry.name.startswith(".") or rules.drops(path, entry.is_dir(follow_symlinks=False)):
                continue
            if entry.is_dir(follow_symlinks=False):
                walk(path, rules)
            elif entry.is_file() and entry.name.rpartition(".")[2] in wanted and "." in entry.name:
                found.append(path)

    walk("", Ignored())
    return sorted(found)


def relative(path: Column, root: str) -> Column:
    """A path below the root, relative to it, however Spark spells the scheme (file:/a and file:///a name the same place)."""
    local = root.removeprefix("file://")
    base = F.lit(root if "://" in root else f"file:{os.path.abspath(local)}")
    plain = F.regexp_replace(path, r"^([a-z0-9]+):/+", "/")
    start = F.regexp_replace(base, r"^([a-z0-9]+):/+", "/")
    return F.ltrim(F.substr(plain, F.length(start) + 1), F.lit("/"))


def file_rows(rows: DataFrame, root: str, repo_id: str = "") -> DataFrame:
    """``file`` rows, and what else there is, of binary files below a root (none: paths are relative): of known languages and valid UTF-8."""
    named = rows.withColumn("path", relative(F.col("path"), root) if root else F.col("path")).withColumn("language", language_of(F.col("path"))).where("language is not null")
    valid = named.where(F.is_valid_utf8(F.col("content").cast("string")))
    return valid.select("path", "language", F.lit(repo_id).alias("repo_id"), F.col("content").cast("string").alias("content"), *[c for c in rows.columns if c not in ("path", "content", "length")])


def local_folder(root: str) -> str | None:
    """The folder that a root names on this machine's file system, which executors must see as well; none for other roots."""
    local = root.removeprefix("file://")
    return os.path.abspath(local) if os.path.isdir(local) else None


def listing(spark: SparkSession, root: str, languages: Iterable[str] | None = None) -> DataFrame:
    """``path`` of the files of a tree, relative to its root: names alone, no contents are read.

    Ignore files are honoured for local roots.  Of other roots Spark lists the names, and
    leaves out those that begin with an underscore or a dot.
    """
    if local := local_folder(root):
        return spark.createDataFrame([(p,) for p in discover(local, languages)], "path string")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(relative(F.col("path"), root).alias("path"))
    language = language_of(F.col("path"))
    return rows.where(language.isin(list(languages)) if languages is not None else language.isNotNull())


def read_local(names: DataFrame, folder: str, max_bytes: int | None = None) -> DataFrame:
    """``(path, content)`` of files below a folder that every executor sees: opened by the tasks, one file at a time.

    A file that is gone by then, or is larger than ``max_bytes``, has no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    whole = os.path.join(folder, path)
                    if max_bytes is not None and os.path.getsize(whole) > max_bytes:
                        continue
                    with open(whole, "rb") as file:
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([file.read()], pa.binary())], ["path", "content"])
                except FileNotFoundError:
                    continue

    return names.select("path").mapInArrow(run, "path string, content binary")


def load(spark: SparkSession, root: str, languages: Iterable[str] | None = None, max_bytes: int | None = None, repo_id: str = "") -> DataFrame:
    """``file`` rows of a tree: the driver lists names, executors read texts.

    The root may be any path Spark reads (see :func:`listing` for what differs).  Files over
    ``max_bytes`` are left out before they are read, and files that aren't UTF-8 after.
    """
    kept = listing(spark, root, languages)
    if local := local_folder(root):
        return file_rows(read_local(kept, local, max_bytes), "", repo_id)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if max_bytes is not None:
        rows = rows.where(F.col("length") <= max_bytes)
    return file_rows(rows, root, repo_id).join(kept, "path", "left_semi").select("path", "language", "repo_id", "content")


# How test files, barrels and generated files are told.
TEST_NAME = (
    r"(?:_test\.(?:rs|go|py|cpp|cc)$|^test_.*\.(?:py|cpp|cc)$|^conftest\.py$|(?:Test|Tests|Spec)\.(?:java|cs)$|Test\.php$|_unittest\.cpp$|.Test\.cpp$|\.(?i:test|spec)\.)"
)
TEST_FOLDER = r"(?:^|/)(?:tests|test|__tests__|testing|testdata)/"
BARRELS = ["index.ts", "index.tsx", "index.js", "index.jsx", "mod.rs", "__init__.py"]
GENERATED = ["@generated", "Code generated by", "DO NOT EDIT", "GENERATED FILE", "automatically generated"]


def classify(files: DataFrame) -> DataFrame:
    """``file_classification`` rows."""
    from lodestone.functions.text import basename, in_first_lines

    base = basename(F.col("path"))
    is_test = base.rlike(TEST_NAME) | F.replace("path", F.lit("\\"), F.lit("/")).rlike(TEST_FOLDER)
    return files.select("path", is_test.alias("is_test"), base.isin(BARRELS).alias("is_barrel"), F.coalesce(in_first_lines(F.col("content"), GENERATED), F.lit(False)).alias("is_generated"))
