"""Office and EPUB containers: the text of their parts converted, all else kept."""

from __future__ import annotations

import io
import os
import posixpath
import re
import uuid
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DocumentError

FORMATS = ("docx", "xlsx", "pptx", "odt", "ods", "odp", "epub")
# Where each format names its fonts (before, name), and the mark that stands for a name meanwhile.
_FONTS = {
    "docx": re.compile(r'(w:(?:eastAsia|ascii|hAnsi|cs)=")(.*?)(")'),
    "xlsx": re.compile(r'(val=")(.*?)(")'),
    "pptx": re.compile(r'(typeface=")(.*?)(")'),
    "odt": re.compile(r"""((?:style:font-name(?:-asian|-complex)?|svg:font-family|style:name)=['"])([^'"]+)(['"])"""),
    "epub": re.compile(r"""(font-family\s*:\s*)([^;"']+)"""),
}
_MARK = "__F_O_N_T_{}__"
_CELL = re.compile(r"<c\b[^>]*?(?:/>|>.*?</c>)", re.S)
_INLINE = re.compile(r"""^<c\b[^>]*\bt=["']inlineStr["']""")
_TEXT = re.compile(r"(<t\b[^>/]*>)(.+?)(</t>)", re.S)


def is_target(kind: str, name: str, wide: bool = False) -> bool:
    """Whether a part holds text to convert. ``wide``: masters, layouts and comments of slides too."""
    if kind == "docx":
        return name == "word/document.xml"
    if kind == "xlsx":
        return name == "xl/sharedStrings.xml" or (name.startswith("xl/worksheets/") and name.endswith(".xml"))
    if kind == "pptx":
        folders = ("ppt/slides/", "ppt/notesSlides/", *(("ppt/slideMasters/", "ppt/slideLayouts/", "ppt/comments/") if wide else ()))
        return name.startswith(folders) and name.endswith(".xml")
    if kind in ("odt", "ods", "odp"):
        return name == "content.xml"
    return kind == "epub" and name.lower().endswith((".xhtml", ".opf", ".ncx", ".html"))


def is_safe(name: str) -> bool:
    clean = name.replace("\\", "/")
    return bool(clean) and not clean.startswith("/") and not re.match(r"^[A-Za-z]:", clean) and ".." not in posixpath.normpath(clean).split("/")


def _convert_part(kind: str, name: str, text: str, convert: Callable[[str], str], keep_fonts: bool) -> str:
    if kind == "xlsx" and name != "xl/sharedStrings.xml":
        one = lambda m: m[0] if not _INLINE.match(m[0]) else _TEXT.sub(lambda t: t[1] + convert(t[2]) + t[3], m[0])
        return _CELL.sub(one, text)
    names: list[str] = []
    if keep_fonts:
        pattern = _FONTS.get("odt" if kind in ("ods", "odp") else kind)

        def hide(m: re.Match) -> str:
            names.append(m[2])
            return m[1] + _MARK.format(len(names) - 1) + (m[3] if m.re.groups > 2 else "")

        text = pattern.sub(hide, text)
    text = convert(text)
    for i, font in enumerate(names):
        text = text.replace(_MARK.format(i), font)
    return text


def convert_bytes(content: bytes, kind: str, convert: Callable[[str], str], keep_fonts: bool = True, wide: bool = False) -> tuple[bytes, int]:
    """The container with its text converted, and how many parts were. Raises if it isn't one, or has no such part. Parts with unsafe
    names are left out; an EPUB's mimetype comes first and is stored as it is."""
    if kind not in FORMATS:
        raise DocumentError(f"unsupported format: {kind}")
    try:
        source = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise DocumentError(f"not a container: {e}") from e
    out, done = io.BytesIO(), 0
    entries = [i for i in source.infolist() if is_safe(i.filename)]
    if kind == "epub":
        first = [i for i in entries if i.filename == "mimetype"]
        if not first:
            raise DocumentError("an EPUB without mimetype")
        entries = first + [i for i in entries if i.filename != "mimetype"]
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for info in entries:
            data = source.read(info)
            if not info.is_dir() and is_target(kind, info.filename, wide):
                try:
                    data = _convert_part(kind, info.filename, data.decode("utf-8"), convert, keep_fonts).encode("utf-8")
                except UnicodeDecodeError as e:
                    raise DocumentError(f"{info.filename}: {e}") from e
                done += 1
            stored = kind == "epub" and info.filename == "mimetype"
            target.writestr(info, data, zipfile.ZIP_STORED if stored else info.compress_type)
    if not done:
        raise DocumentError("no part to convert")
    return out.getvalue(), done


def kind_of(path: str) -> str:
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in FORMATS:
        raise DocumentError(f"unsupported format: {path}")
    return kind


def converted_name(path: str) -> str:
    stem, dot, end = path.rpartition(".")
    return f"{stem}_converted.{end}" if dot else f"{path}_converted"


def replace_file(path: str, content: bytes) -> None:
    """Writes beside ``path``, checks the container, and puts it in place at once; nothing is left of a failure."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with open(temporary, "wb") as f:
            f.write(content)
        if zipfile.ZipFile(temporary).testzip():
            raise DocumentError("the new container is damaged")
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)


def convert_files(files: DataFrame, make_convert: Callable[[], Callable[[str], str]], keep_fonts: bool = True, wide: bool = False) -> DataFrame:
    """``files`` (path, content), as ``binaryFile`` reads them, to (path, content, parts, success, message); a failure is a row, with null content."""

    @F.pandas_udf("content binary, parts int, success boolean, message string")
    def run(path: pd.Series, content: pd.Series) -> pd.DataFrame:
        convert, rows = make_convert(), []
        for p, c in zip(path, content, strict=True):
            try:
                data, n = convert_bytes(bytes(c), kind_of(p), convert, keep_fonts, wide)
                rows.append((data, n, True, f"{n} parts converted"))
            except (DocumentError, zipfile.BadZipFile, RuntimeError) as e:
                rows.append((None, 0, False, str(e)))
        return pd.DataFrame(rows, columns=["content", "parts", "success", "message"])

    return files.select("path", run("path", "content").alias("r")).select("path", "r.*")
