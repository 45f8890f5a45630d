"""The stateless transforms over a folder that new files arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import ChunkConfig, CleanConfig
from ..operators.chunk import chunk
from ..operators.clean import clean
from ..sources.documents import with_text

BINARY = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str, pattern: str = "*.{txt,docx,pdf}") -> DataFrame:
    """path, text of files as they arrive."""
    return with_text(spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).load(path).select("path", "content")).drop("content")


def stream_chunks(files: DataFrame, cleaning: CleanConfig | None = None, cutting: ChunkConfig | None = None) -> DataFrame:
    """path, seq, chunk_key, text, n_chars, truncated of each file's cleaned text."""
    return chunk(clean(files, cleaning), cutting, "cleaned_text", key="path")
