"""Documents from tables and from files (.txt, .docx, .pdf) of any store that Spark reads."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import display_name, unique_names

KINDS = ("txt", "docx", "pdf")
# Fixed value: the namespace of word-processing XML.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def decode_text(raw: bytes) -> str:
    """UTF-8, else Windows-1252, else Latin-1, which takes everything."""
    for name in ("utf-8", "cp1252"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def docx_text(raw: bytes) -> str:
    """The body's paragraphs, one a line; tables and headers are left out."""
    with zipfile.ZipFile(io.BytesIO(raw)) as parts:
        body = ElementTree.fromstring(parts.read("word/document.xml")).find(f"{_W}body")
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "\n".join("".join(n.text or "" if n.tag == f"{_W}t" else marks.get(n.tag, "") for n in p.iter()) for p in body.findall(f"{_W}p"))


def pdf_text(raw: bytes) -> str:
    """The pages' texts, each with a line end; pages without text are left out. Needs the optional pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading .pdf files needs the optional package pypdf") from e
    return "".join(text + "\n" for page in PdfReader(io.BytesIO(raw)).pages if (text := page.extract_text()))


def _extract(kind: str):
    read = {"docx": docx_text, "pdf": pdf_text, "txt": decode_text}[kind]

    def run(contents: pa.Array) -> pa.Array:
        return pa.array([None if c is None else read(c) for c in contents.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


def with_text(files: DataFrame) -> DataFrame:
    """``text`` of (path, content). Valid UTF-8 is decoded in the JVM; an unknown extension fails."""
    kind, content = extension(F.col("path")), F.col("content")
    plain = F.is_valid_utf8(content.cast("string")) if not hasattr(F, "try_validate_utf8") else F.try_validate_utf8(content.cast("string")).isNotNull()
    files = files.withColumn("__kind", kind).withColumn("__plain", plain)
    text = (
        F.when((F.col("__kind") == "txt") & F.col("__plain"), content.cast("string"))
        .when(F.col("__kind") == "txt", _extract("txt")(F.when((F.col("__kind") == "txt") & ~F.col("__plain"), content)))
        .when(F.col("__kind") == "docx", _extract("docx")(F.when(F.col("__kind") == "docx", content)))
        .when(F.col("__kind") == "pdf", _extract("pdf")(F.when(F.col("__kind") == "pdf", content)))
        .otherwise(F.raise_error(F.concat(F.lit("Unsupported file type: "), F.col("path"))))
    )
    return files.withColumn("text", F.regexp_replace(text, "\r\n?", "\n")).drop("__kind", "__plain")


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """doc_id, ordinal, path, name, display, text, in the order of ``paths``, each of which is one file."""
    # One scan for all, however many; a path that is listed twice is two documents.
    files = spark.read.format("binaryFile").load(sorted(set(paths))).select("path", "content")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def qualified(path: str) -> str:
        where = fs.Path(path)
        return where.getFileSystem(conf).makeQualified(where).toString()

    places = spark.createDataFrame([(k + 1, qualified(p)) for k, p in enumerate(paths)], "ordinal int, __path string")
    listed = files.join(F.broadcast(places), F.col("path") == F.col("__path")).drop("__path")
    named = unique_names(with_text(listed).drop("content"))
    return named.select(F.col("ordinal").cast("long").alias("doc_id"), "ordinal", "path", "name", display_name(F.col("path")).alias("display"), "text")


def read_folder(spark: SparkSession, path: str, pattern: str = "*.{txt,docx,pdf}") -> DataFrame:
    """path, text of the files of a folder, of any number."""
    return with_text(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")).drop("content")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text of a Parquet table; only these columns are read."""
    return spark.read.parquet(path).select("doc_id", "text")
