"""Folder scan and loaders."""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator
from itertools import groupby, islice, pairwise

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import bind
from ..functions.text import SUPPORTED, normalize_newlines, suffix
from ..session import scratch_dir
from .markdown import markdown_html


#: What a listing holds of each entry; ``modified`` in milliseconds.
ENTRY = "path STRING, folder BOOLEAN, length BIGINT, modified BIGINT"
#: Folders that one task lists if there are more than a few for each core.
LISTED = 2_000
#: Bytes of contents that a worker gathers before it hands them on.
HELD = 4 << 20


def scan_corpus(spark: SparkSession, root: str | list[str], glob: str | None = None) -> DataFrame:
    """Every regular file below ``root``, or of a list of paths, as a corpus row (M1).

    Select without ``content`` to list files without reading them. Empty files and names starting
    with ``.`` or ``_`` are left out. The files are those of the time of the call.

    Folders that are mounted are listed and read by tasks, and the list is kept in the scratch folder; of
    other stores Spark's reader lists all files on the driver and makes a task of every few.
    """
    roots = _mounted(spark, [root] if isinstance(root, str) else root)
    if roots is not None:
        return _rows(_walk(spark, roots, glob), F.timestamp_millis("modified"), _contents(F.col("path")))
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.load(root).withColumn("path", F.regexp_replace("path", r"\Afile:/+", "/"))
    return _rows(found, F.col("modificationTime"), F.col("content"))


def _rows(found: DataFrame, modified_at: Column, content: Column) -> DataFrame:
    path = F.col("path")
    return found.select(
        path.alias("file_path"), suffix(path).alias("suffix"), modified_at.alias("modified_at"), "length", content.alias("content"),
    )


def _mounted(spark: SparkSession, paths: list[str]) -> list[str] | None:
    """The paths without scheme, patterns replaced by what they match; None if Spark's reader has to look for them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    scheme = jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(conf).getScheme()
    if not (spark.sparkContext.master.startswith("local") or spark.conf.get("spark.checkpoint.dir", None)):
        return None  # there is no place for the list
    out = []
    for path in paths:
        bare = re.sub(r"\Afile:/(//)?(?!/)", "/", path)
        if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", bare) or bare == path and scheme != "file" or bare.startswith("//"):
            return None
        if re.search(r"(?<!\\)[{}\[\]*?]", bare):
            place = jvm.org.apache.hadoop.fs.Path(path)
            found = place.getFileSystem(conf).globStatus(place)
            out += [f.getPath().toUri().getPath() for f in found or []]
        else:
            out.append(os.path.abspath(re.sub(r"\\(.)", r"\1", bare)))
    # for what is missing Spark's reader has its own error
    return out if out and all(map(os.path.exists, out)) else None


def _walk(spark: SparkSession, roots: list[str], glob: str | None) -> DataFrame:
    """The files below ``roots``, as ``ENTRY`` rows. Each level of folders is dealt out and stored, whatever its number of entries."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hidden(name: str, folder: bool) -> bool:
            # the names that Spark's reader leaves out
            out = name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")
            return out and not (folder and name.startswith(("_common_metadata", "_metadata")))

        def below(place: str) -> Iterator[tuple[str, bool, int, int]]:
            try:
                inside = os.scandir(place)
            except NotADirectoryError:
                if not hidden(os.path.basename(place), False):
                    s = os.stat(place)
                    yield place, False, s.st_size, s.st_mtime_ns // 1_000_000
                return
            except FileNotFoundError:
                return
            with inside:
                for e in inside:
                    try:
                        e.name.encode()
                        folder, s = e.is_dir(), e.stat()
                    except (FileNotFoundError, UnicodeEncodeError):  # gone meanwhile, or a name that is no text
                        continue
                    if not hidden(e.name, folder) and (folder or stat.S_ISREG(s.st_mode)):
                        yield e.path, folder, s.st_size, s.st_mtime_ns // 1_000_000

        found = (x for b in batches for place in b.column(0).to_pylist() for x in below(place))
        while some := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), kinds)], names)

    names, kinds = ["path", "folder", "length", "modified"], [pa.string(), pa.bool_(), pa.int64(), pa.int64()]
    place, levels, files, size = scratch_dir(spark, "listing"), [], 0, 0
    folder, wanted = F.col("folder"), ~F.col("folder") & (F.col("length") > 0)
    if glob:
        pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
        wanted &= F.substring_index("path", "/", -1).rlike(rf"(?s)\A(?:{pattern})\z")
    cores = spark.sparkContext.defaultParallelism
    todo = spark.createDataFrame([(r,) for r in dict.fromkeys(roots)], "path STRING")
    while todo is not None:
        levels.append(f"{place}/{len(levels)}")
        todo.mapInArrow(entries, ENTRY).write.parquet(levels[-1])
        level = spark.read.schema(ENTRY).parquet(levels[-1])
        more, new, fresh = level.agg(F.count_if(folder), F.count_if(wanted), F.sum(F.when(wanted, F.col("length")))).first()
        files, size = files + new, size + (fresh or 0)
        todo = level.where(folder).select("path").repartition(min(more, max(4 * cores, more // LISTED))) if more else None
    found = spark.read.schema(ENTRY).parquet(*levels).where(wanted)
    if any(r != s and s.startswith(r.rstrip("/") + "/") for r, s in pairwise(sorted(roots, key=lambda r: r.split("/")))):
        found = found.dropDuplicates(["path"])
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return found.repartition(max(1, min(files, max(cores, size // split + 1))))


def _contents(path: Column) -> Column:
    """The bytes of mounted files."""
    held = HELD

    @F.arrow_udf("binary")
    def contents(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for paths in batches:
            read, size = [], 0
            for place in paths.to_pylist():
                with open(place, "rb") as file:
                    read.append(file.read())
                size += len(read[-1])
                if size >= held:
                    yield pa.array(read, pa.binary())
                    read, size = [], 0
            if read:
                yield pa.array(read, pa.binary())

    return contents(path)


#: Tasks that write single files.
WRITERS = 200


def _reachable(place: str) -> bool:
    """True if ``place`` is in a store that Arrow opens as well as Spark."""
    try:
        fs.FileSystem.from_uri(place)
    except (pa.ArrowException, OSError):
        return False
    return True


def write_files(texts: DataFrame, place: str, keys: list[str], text: str = "text") -> None:
    """One text file per value of the columns ``keys``, below a folder ``key=value`` for each, one line per row.

    The folders are those of Spark's partitioned writer, which is used where Arrow cannot open the
    store. For a file of one row that writer costs some tens of milliseconds on a local disk. Files are
    named after their folder alone, so a repeated task writes the same ones.
    """
    texts = texts.select(*keys, F.col(text).cast("string").alias(text))
    dealt = texts.repartition(WRITERS, *keys)
    if not _reachable(place):
        dealt.write.partitionBy(*keys).text(place)
        return
    folder = F.concat_ws("/", *(F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))) for k in keys))
    lines = dealt.select(folder.alias("folder"), F.coalesce(F.col(text), F.lit("")).alias("line")).sortWithinPartitions("folder", "line")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(place)
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        files = 0
        for where, group in groupby(rows, key=lambda r: r[0]):
            store.create_dir(f"{root}/{where}", recursive=True)
            with store.open_output_stream(f"{root}/{where}/lines.txt") as out:
                for _, line in group:
                    out.write(f"{line}\n".encode())
            files += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    lines.mapInArrow(save, "files BIGINT").agg(F.sum("files")).collect()


#: Changed files up to which a folder is read by path instead of as a whole.
PATHS = 10_000


class Folder:
    """A folder of files as a corpus, of which single files can be read."""

    def __init__(self, spark: SparkSession, root: str, glob: str | None = None):
        self.spark, self.root, self.glob = spark, root, glob
        self._rows: DataFrame | None = None

    def rows(self) -> DataFrame:
        return scan_corpus(self.spark, self.root, self.glob) if self._rows is None else self._rows

    def listed(self) -> Folder:
        """The folder with the files that it has now, listed once; contents are read when asked for."""
        now = Folder(self.spark, self.root, self.glob)
        now._rows = self.rows()
        return now

    def only(self, paths: DataFrame) -> DataFrame:
        """The files of the given ``file_path`` rows.

        Up to ``PATHS`` of them are opened by name. More than that are picked out of
        a scan of the whole folder, since their names are not gathered on the driver.
        """
        some = [r["file_path"] for r in paths.select("file_path").distinct().limit(PATHS + 1).collect()]
        if len(some) > PATHS:
            return self.rows().join(paths.select("file_path"), "file_path", "left_semi")
        if not some:
            return self.rows().limit(0)
        literal = [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in some]
        return scan_corpus(self.spark, literal)


def text_content(content: Column) -> Column:
    """S3: strictly decoded UTF-8 with newlines normalised; null if not valid UTF-8."""
    return normalize_newlines(F.try_validate_utf8(content.cast("string")))


def csv_content(text: Column) -> Column:
    """The text of a CSV file; cells joined by ``", "``, records by newline.

    A quote opens a cell only as its first character, a doubled quote stands for
    one, and what follows the closing quote is kept as it is. The loops of the
    cell pattern are possessive, so it neither backtracks nor recurses however
    long a quoted cell is.
    """
    # fixed values: cell and terminator of the CSV dialect
    cell = r'("[^"]*+(?:""[^"]*+)*+(?:"[^,\n]*+)?|[^",\n][^,\n]*+|)(,|\n|\z)'
    quoted = r'\A"([^"]*+(?:""[^"]*+)*+)(?:"(.*+))?\z'

    def clean(value: Column) -> Column:
        body = F.replace(F.regexp_extract(value, "(?s)" + quoted, 1), F.lit('""'), F.lit('"'))
        rest = F.regexp_extract(value, "(?s)" + quoted, 2)
        return F.when(value.startswith('"'), F.concat(body, rest)).otherwise(value)

    def join(found: Column) -> Column:
        cells, ends = found["cells"], found["ends"]
        whole = F.array_join(
            F.zip_with(cells, ends, lambda v, e: F.concat(clean(v), F.when(e == ",", F.lit(", ")).otherwise(e))), ""
        )
        # the search ends with an empty match; if a newline precedes that one, it
        # closes the last record and separates nothing
        closed = F.try_element_at(ends, F.lit(-2)) == "\n"
        return F.when(closed, F.regexp_replace(whole, r"\n\z", "")).otherwise(whole)

    found = F.struct(
        F.regexp_extract_all(text, F.lit(cell), F.lit(1)).alias("cells"),
        F.regexp_extract_all(text, F.lit(cell), F.lit(2)).alias("ends"),
    )
    return bind(found, join)


def load_documents(corpus: DataFrame, extractor=None, requested: DataFrame | None = None, texts: bool = True) -> DataFrame:
    """``(file_path, text, load_error)`` for every corpus row.

    The suffix picks the loader; a row that fails keeps a reason and an empty
    text, and the others go on. Contents are read once, whatever mix of suffixes
    there is. ``extractor`` (U3) turns PDF bytes into text. Paths in
    ``requested`` that the corpus does not hold are reported as missing. Without
    ``texts`` only the reasons are worked out and every text is empty.
    """
    kind = suffix(F.col("file_path"))
    raw = corpus.select("file_path", "content", kind.alias("_kind"))
    is_pdf = F.col("_kind") == ".pdf"
    magic = F.substring(F.col("content"), 1, 5) == F.lit(b"%PDF-")
    pdf = F.when(is_pdf, F.when(magic, "needs_extractor").otherwise("corrupt_pdf"))
    decoded = F.when(F.col("_kind").isin(".txt", ".md", ".csv"), text_content(F.col("content")))
    columns = ["file_path", "_kind", pdf.alias("_pdf"), decoded.alias("_text")]
    if extractor is not None:
        columns.append(extractor(F.when(is_pdf & magic, F.col("content"))).alias("_out"))
    read = raw.select(*columns)

    text = F.lit("")
    if texts:
        text = (
            F.when(F.col("_kind") == ".txt", F.col("_text"))
            .when(F.col("_kind") == ".md", markdown_html(F.col("_text")))
            .when(F.col("_kind") == ".csv", csv_content(F.col("_text")))
        )
    error = (
        F.when(~F.col("_kind").isin(*SUPPORTED), "unsupported")
        .when(F.col("_pdf") == "corrupt_pdf", "corrupt_pdf")
        .when((F.col("_kind") != ".pdf") & F.col("_text").isNull(), "bad_utf8")
    )
    if extractor is None:
        error = F.coalesce(error, F.col("_pdf"))
    else:
        text = F.coalesce(text, F.col("_out.text")) if texts else text
        error = F.coalesce(error, F.when(F.col("_out.error").isNotNull(), "corrupt_pdf"))
    loaded = read.select(
        "file_path", F.coalesce(text, F.lit("")).alias("text"), error.alias("load_error")
    )
    if requested is not None:
        missing = requested.select("file_path").join(corpus.select("file_path"), "file_path", "left_anti")
        loaded = loaded.unionByName(
            missing.select("file_path", F.lit("").alias("text"), F.lit("missing").alias("load_error"))
        )
    return loaded


def quarantine(loaded: DataFrame) -> DataFrame:
    """The rows that failed to load, with their reason."""
    return loaded.filter(F.col("load_error").isNotNull()).select("file_path", "load_error")
