"""Plain text files as documents, in any charset, and back."""

from __future__ import annotations

import codecs
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DocumentError
from ..functions.text import strip_bom

_JAVA_CHARSETS = "spark.sql.legacy.javaCharsets"


def check_charset(name: str) -> str:
    """The name as Java and Python know it; raises for an unknown one."""
    try:
        found = codecs.lookup(name).name.upper().replace("_", "-")
    except LookupError as e:
        raise DocumentError(f"unknown charset: {name}") from e
    return re.sub(r"^(UTF-(?:16|32))-([BL]E)$", r"\1\2", found.replace("ISO8859", "ISO-8859"))


def check_paths(source: str | None, target: str | None) -> None:
    """Raises unless the source is a file, and the target isn't a folder, isn't the source and lies in a folder that exists."""
    if source is not None and (not source or not os.path.isfile(source)):
        raise DocumentError(f"no such file: {source}")
    if target is not None:
        if not target or os.path.isdir(target) or not os.path.isdir(os.path.dirname(os.path.abspath(target))):
            raise DocumentError(f"can't write: {target}")
        if source is not None and os.path.realpath(source) == os.path.realpath(target):
            raise DocumentError("source and target are the same file")


def _is_utf8(charset: str) -> bool:
    return check_charset(charset) == "UTF-8"


def decode(content: Column, charset: str = "UTF-8") -> Column:
    """Bytes as text; what isn't valid becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string")) if _is_utf8(charset) else F.decode(content, check_charset(charset))


def encode(text: Column, charset: str = "UTF-8", source_charset: str = "UTF-8") -> Column:
    """Text as bytes. A byte order mark goes if the text was UTF-8 and the target is not."""
    if _is_utf8(charset):
        return F.encode(text, "UTF-8")
    return F.encode(strip_bom(text) if _is_utf8(source_charset) else text, check_charset(charset))


def read_texts(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """(path, text): a row a file. Charsets other than UTF-8 need Spark's setting for all of Java's, which is set here."""
    if not _is_utf8(charset):
        spark.conf.set(_JAVA_CHARSETS, "true")
    return spark.read.format("binaryFile").load(path).select("path", decode(F.col("content"), charset).alias("text"))


def write_texts(docs: DataFrame, path: str, text_col: str = "text") -> None:
    """A line a document, in Spark's text format; the folder must not exist."""
    docs.select(F.col(text_col).alias("value")).write.mode("errorifexists").text(path)
