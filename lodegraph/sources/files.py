"""Sources: file trees, the corpus tables as files, and the predicates on paths."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names and extensions that are never read, whatever the configuration.
SAFETY_NAMES = (".git", ".env", ".env.local", ".env.production", "id_rsa", "id_ed25519", "node_modules", "target", ".DS_Store")
SAFETY_EXTENSIONS = ("pem", "key", "pfx", "p12", "lock", "exe", "dll", "so", "dylib", "bin")


#: Files that one task reads, at most.
FILES_A_TASK = 512


def listed(spark: SparkSession, folder: str, root: str = "main") -> DataFrame:
    """(root, path, address, size) of every file below a folder of any store, hidden ones too; no content is read.

    Names come from the file system's own listing, level by level: the folders of a level are spread over tasks only by
    being few; what is gathered is names.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(folder.rstrip("/"))
    system = top.getFileSystem(conf)
    base = system.makeQualified(top).toString().rstrip("/") + "/"
    rows, found = [], system.listFiles(top, True)
    while found.hasNext():
        status = found.next()
        address = status.getPath().toString()
        rows.append((root, address.removeprefix(base), address, status.getLen()))
    parts = max(1, -(-len(rows) // FILES_A_TASK))
    return spark.createDataFrame(rows, "root string, path string, address string, size long").repartition(parts)


def ignored(path: Column, patterns: list[tuple[str, str]]) -> Column:
    """Whether ignore lists drop a path. patterns: (folder of the list, line), those of outer folders first; the last that
    fits decides, `!` takes back, a pattern with a slash is tied to its folder, one that ends in a slash fits folders."""
    out = F.lit(False)
    for folder, raw in patterns:
        line = raw.rstrip("\r\n")
        line = line.rstrip() if not line.endswith("\\ ") else line
        if not line or line.startswith("#"):
            continue
        keep, line = line.startswith("!"), line.removeprefix("!")
        inside = line.endswith("/")
        body = line.strip("/")
        tied = "/" in line.rstrip("/")
        start = re.escape(folder + "/" if folder else "") + ("" if tied else "(?:.*/)?")
        out = F.when(path.rlike(f"^{start}{glob_pattern(body)}{'/' if inside else '(?:/|$)'}"), F.lit(not keep)).otherwise(out)
    return out


def glob_pattern(glob: str) -> str:
    """Java pattern of a glob: ** any folders, * and ? within a name, [...] characters."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif glob[k] == "[" and (shut := glob.find("]", k + 2)) > 0:
            out, k = out + "[" + glob[k + 1 : shut].replace("\\", "\\\\").replace("!", "^", 1) + "]", shut + 1
        else:
            c = glob[k]
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), k + 1
    return out


def walk(spark: SparkSession, folder: str, root: str = "main", extensions: tuple[str, ...] = (), globs: tuple[str, ...] = (), gitignore: bool = True, most_bytes: int | None = None, strict: bool = False) -> DataFrame:
    """(root, path, content, content_hash, artifact_class) of every allowed file below a folder of any store.

    Paths are filtered before any content is read. Files that can't be read are left out, or end the walk if `strict`.
    """
    found = listed(spark, folder, root)
    path = F.col("path")
    allowed = found.where(contained(path) & ~excluded(path, extensions, globs))
    if gitignore:
        lists = sorted((r.path.removesuffix(".gitignore").rstrip("/"), line) for r in read(found.where(path.rlike(r"(^|/)\.gitignore$"))).collect() for line in [bytes(r.content or b"").decode("utf-8", "replace")])
        allowed = allowed.where(~ignored(path, [(f, x) for f, text in lists for x in text.split("\n")]))
    if most_bytes is not None:
        allowed = allowed.where(F.col("size") <= most_bytes)
    got = read(allowed, strict)
    return got.where("content is not null").select("root", "path", "content", F.sha2("content", 256).alias("content_hash"), artifact_class(path).alias("artifact_class"))


def read(files: DataFrame, strict: bool = False) -> DataFrame:
    """(root, path, content) of listed files; content is null where a file has gone, unless `strict`.

    Spark's reader of files takes all but those whose names begin with a dot or an underscore, which it never lists: these are
    opened by their path where a store is a file system of the machines, else read by the driver, one after the other.
    """
    spark = files.sparkSession
    files = files.select("root", "path", "address")
    hidden = F.element_at(F.split("address", "/"), -1).rlike(r"^[._]")
    rows = files.select("address", hidden.alias("hidden")).collect()
    plain, odd = ([r["address"] for r in rows if r["hidden"] == h] for h in (False, True))
    parts = []
    if plain:
        there = plain if strict else [a for a in plain if _exists(spark, a)]
        escaped = [re.sub(r"([\[\]{}*?\\])", r"\\\1", a) for a in there]
        if strict and (lost := [a for a in there if not _exists(spark, a)]):
            raise FileNotFoundError(lost[0])
        content = spark.read.format("binaryFile").option("ignoreMissingFiles", not strict).load(escaped).select(F.col("path").alias("__a"), "content") if escaped else spark.createDataFrame([], "__a string, content binary")
        bare = lambda c: F.regexp_replace(c, r"^(?:([a-z]+):)?/+", "/")
        parts.append(files.where(~hidden).join(content, bare(F.col("address")) == bare(F.col("__a")), "left").select("root", "path", "content"))
    if odd and all(re.match(r"(file:)?/", a) for a in odd):
        parts.append(files.where(hidden).select("root", "path", "address").mapInArrow(_opened(strict), "root string, path string, content binary"))
    elif odd:
        held = files.where(hidden).collect()
        for k in range(0, len(held), FILES_A_TASK):
            parts.append(spark.createDataFrame([(r["root"], r["path"], _bytes(spark, r["address"], strict)) for r in held[k : k + FILES_A_TASK]], "root string, path string, content binary"))
    if not parts:
        return files.select("root", "path", F.lit(None).cast("binary").alias("content"))
    return reduce(DataFrame.unionByName, parts)


def _exists(spark: SparkSession, address: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(address)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _bytes(spark: SparkSession, address: str, strict: bool) -> bytes | None:
    if not strict and not _exists(spark, address):
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(address)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def _opened(strict: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                try:
                    with open(re.sub(r"^file:/+", "/", one.column(2)[0].as_py()), "rb") as file:
                        content = file.read()
                except OSError:
                    if strict:
                        raise
                    content = None
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), pa.array([content], pa.binary())], ["root", "path", "content"])

    return work


def snapshot(spark: SparkSession, folder: str, path: str, root: str = "main") -> dict | None:
    """One file: None where the path leads out of the folder, is excluded or isn't there."""
    one = spark.createDataFrame([(root, path, f"{folder.rstrip('/')}/{path}")], "root string, path string, address string")
    allowed = one.where(contained(F.col("path")) & ~excluded(F.col("path")))
    rows = read(allowed).where("content is not null").select("root", "path", "content", F.sha2("content", 256).alias("content_hash"), artifact_class(F.col("path")).alias("artifact_class")).collect() if not allowed.isEmpty() else []
    return rows[0].asDict() if rows else None


def size_of(spark: SparkSession, folder: str) -> int:
    """Bytes of all files below a folder."""
    return listed(spark, folder).agg(F.sum("size")).first()[0] or 0


def assets(spark: SparkSession, folder: str) -> DataFrame:
    """(name, bytes, files) of what lies below a folder, by the first part of its path: a cache of models, a store's tables."""
    name = F.split("path", "/")[0]
    return listed(spark, folder).groupBy(name.alias("name")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files"))


def watched(spark: SparkSession, folder: str, root: str = "main") -> DataFrame:
    """A stream of (root, ts, path, op) of files that appear in a folder tree, as Spark's file stream sees them."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)
    base = re.sub(r"^[a-z]+:/+", "/", folder.rstrip("/")) + "/"
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^" + re.escape(base), "")
    return found.select(F.lit(root).alias("root"), F.col("modificationTime").alias("ts"), path.alias("path"), F.lit("modify").alias("op"))


def contained(path: Column) -> Column:
    """Relative, without parents or drives; backslashes count as slashes."""
    plain = F.translate(path, "\\", "/")
    return (plain != "") & ~plain.startswith("/") & ~F.exists(F.split(plain, "/"), lambda x: (x == "..") | x.endswith(":"))


def excluded(path: Column, extensions: tuple[str, ...] = (), globs: tuple[str, ...] = ()) -> Column:
    """By a safety name as a segment, a safety or given extension, or a glob on the path or a segment."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    found = F.arrays_overlap(parts, F.array(*map(F.lit, SAFETY_NAMES))) | F.element_at(F.split(name, r"\."), -1).isin(*SAFETY_EXTENSIONS) & name.contains(".")
    for extension in extensions:
        found = found | name.endswith("." + extension)
    for glob in globs:
        pattern = f"^{glob_pattern(glob)}$"
        found = found | path.rlike(pattern) | F.exists(parts, _fits(pattern))
    return found


def _fits(pattern: str):
    return lambda x: x.rlike(pattern)


def artifact_class(path: Column) -> Column:
    """The first class that fits, in this order; the last is what nothing fits."""
    p = F.lower(F.translate(path, "\\", "/"))
    rules = (
        ("tests", r"^tests?/|/tests?/|_test\.rs$|\.(test|spec)\.ts$"),
        ("docs", r"\.md$|(^|/)(docs|book)/"),
        ("schema", r"/schema.*\.(toml|ya?ml|json)$|\.schema\.json$"),
        ("config", r"\.(toml|ya?ml|json)$"),
        ("ci", r"/\.(github|gitlab-ci)/"),
        ("infra", r"/(terraform|k8s)/|/docker"),
        ("data", r"\.sql$|/migrations/"),
        ("code", r"\.(rs|ts|js|go|py|c|cpp)$"),
    )
    out = F.when(p.rlike(rules[0][1]), rules[0][0])
    for name, pattern in rules[1:]:
        out = out.when(p.rlike(pattern), name)
    return out.otherwise("build")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, pages and conversation turns as files (root, path, content)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.lit("corpus").alias("root"), F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("text").alias("content"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lit("web").alias("root"), F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"))
    return docs.unionByName(pages)


def status_changes(lines: DataFrame) -> DataFrame:
    """(path, op) of `git status --porcelain` lines: M wins, then ? and A, then D."""
    code = F.substring("line", 1, 2)
    op = F.when(code.contains("M"), "modified").when(code.contains("?") | code.contains("A"), "added").when(code.contains("D"), "deleted")
    return lines.select(F.trim(F.expr("substring(line, 4)")).alias("path"), op.alias("op")).where("op is not null")


def diff_changes(lines: DataFrame) -> DataFrame:
    """(path, op) of `git diff --name-status` lines."""
    parts = F.split("line", "\t")
    op = F.when(parts[0].startswith("M"), "modified").when(parts[0].startswith("A"), "added").when(parts[0].startswith("D"), "deleted")
    return lines.select(F.element_at(parts, -1).alias("path"), op.alias("op")).where("op is not null")
