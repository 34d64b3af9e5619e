"""File scans into documents: plain text, Markdown, DOCX and, with its optional library, PDF.

documents: document_id, title, text, source, file_type, filename, extension, size_bytes, modified_at (seconds), page_count,
paragraph_count, domain. Files that cannot be parsed are rows of `failures`, not exceptions, when a directory is read.
"""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.functions import text as T
from rankforge.sources import storage

WORD_XML = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


@dataclass
class Ingested:
    documents: DataFrame
    failures: DataFrame


def extension(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"(\.[^./]+)$", 1))


def docx_paragraphs(content: bytes) -> list[str]:
    """The texts of the paragraphs that are not blank, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD_XML}body")
    out = []
    for p in body.findall(f"{WORD_XML}p") if body is not None else []:
        parts = [{"t": e.text or "", "tab": "\t", "br": "\n", "cr": "\n"}.get(e.tag.removeprefix(WORD_XML), "") for e in p.iter()]
        if "".join(parts).strip():
            out.append("".join(parts))
    return out


def pdf_pages(content: bytes) -> list[str]:
    """The layout text of each page; needs pypdf."""
    from pypdf import PdfReader

    return [page.extract_text(extraction_mode="layout") or "" for page in PdfReader(io.BytesIO(content)).pages]


def tidy(page: str) -> str:
    """What normalize_pdf_text does, for one page inside a parser."""
    t = unicodedata.normalize("NFKC", page)
    for pattern, new in ((r"[\ufffd\xad]", ""), (r"\r\n?", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"[\u200b-\u200f\u202a-\u202e\u2060\ufeff]", ""), (r" *\n *", "\n")):
        t = re.sub(pattern, new, t)
    return t.strip()


@dataclass(frozen=True)
class Loader:
    """How files of a kind become text: `parse` gives text, pages and paragraphs of the bytes; without it they are UTF-8 text and stay inside the JVM."""

    kind: str
    parse: Callable[[bytes], tuple[str, int | None, int | None]] | None = None


def _docx(content: bytes) -> tuple[str, int | None, int | None]:
    parts = docx_paragraphs(content)
    return "\n".join(parts), None, len(parts)


def _pdf(content: bytes) -> tuple[str, int | None, int | None]:
    pages = [tidy(p) for p in pdf_pages(content)]
    return "\f".join(pages), len(pages), None


LOADERS: dict[str, Loader] = {".txt": Loader("txt"), ".md": Loader("markdown"), ".markdown": Loader("markdown"), ".docx": Loader("docx", _docx), ".pdf": Loader("pdf", _pdf)}


def register_loader(suffix: str, loader: Loader) -> None:
    """A loader for another extension, such as ".rst"."""
    LOADERS[suffix.lower()] = loader


def _binary_parsed() -> Column:
    parsers = {e.kind: e.parse for e in LOADERS.values() if e.parse}

    @F.pandas_udf("struct<text:string,pages:int,paragraphs:int,error:string>")
    def parse(kind: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = []
        for k, c in zip(kind, content):
            try:
                rows.append((*parsers[k](c), None))
            except Exception as e:  # any malformed file is a failure of that file alone
                rows.append((None, None, None, f"{type(e).__name__}: {e}"[:500]))
        return pd.DataFrame(rows, columns=["text", "pages", "paragraphs", "error"]).astype({"pages": "Int32", "paragraphs": "Int32"})

    return parse("file_type", "content")


def domains(spark: SparkSession, root: str) -> list[str]:
    """The non-empty sub-directories of an ingestion root, by name."""
    return storage.folders(spark, root)


def _glob(extensions: Iterable[str]) -> str:
    """A file name pattern for the extensions in either case; the scan never opens other files."""
    letters = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e.lstrip("."))
    return "*.{" + ",".join(letters(e) for e in extensions) + "}"


def scan(spark: SparkSession, path: str, recursive: bool = True, extensions: Iterable[str] | None = None) -> DataFrame:
    """The files under a path whose extension has a loader, and is among `extensions` where these are given, with their content."""
    wanted = [e for e in LOADERS if extensions is None or e in {x.lower() for x in extensions}]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", _glob(wanted or [".none"]))
    kind = F.create_map(*[F.lit(x) for e in LOADERS for x in (e, LOADERS[e].kind)])[F.col("extension")]
    files = reader.load(str(path)).withColumn("extension", extension("path"))
    return files.where(F.col("extension").isin(*wanted)).withColumn("file_type", kind)


def ingest(spark: SparkSession, path: str, recursive: bool = True, root: str | None = None, extensions: Iterable[str] | None = None) -> Ingested:
    """Documents and failures of a directory. With a root, `domain` is the first directory below it, and if the
    root itself is read and has sub-directories, files directly in it are skipped. Rows come in no order; `source` is what they are ordered by.
    """
    files = scan(spark, path, recursive, extensions)
    plain = F.col("file_type").isin(*{e.kind for e in LOADERS.values() if e.parse is None})
    # text files stay inside the JVM
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    texts = files.where(plain).withColumn("parsed", F.struct(utf8.alias("text"), F.lit(None).cast("int").alias("pages"), F.lit(None).cast("int").alias("paragraphs"), F.when(utf8.isNull(), "UnicodeDecodeError: not UTF-8").alias("error")))
    binary = files.where(~plain).withColumn("parsed", _binary_parsed())
    rows = texts.unionByName(binary)
    local = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/*", "/")
    name = F.element_at(F.split(local, "/"), -1)
    text = F.col("parsed.text")
    domain = F.lit(None).cast("string")
    if root is not None:
        base = storage.resolved(spark, root).rstrip("/") + "/"
        below = F.when(F.startswith(local, F.lit(base)), F.substring(local, len(base) + 1, 1 << 20))
        domain = F.when(F.contains(below, F.lit("/")), F.split(below, "/")[0])
        if storage.resolved(spark, path).rstrip("/") + "/" == base and domains(spark, root):
            rows = rows.where(domain.isNotNull())
    good = rows.where("parsed.error is null").select(
        T.document_id(name, text).alias("document_id"), F.regexp_replace(name, r"\.[^.]+$", "").alias("title"), text.alias("text"), local.alias("source"), "file_type", name.alias("filename"), "extension",
        F.col("length").alias("size_bytes"), (F.unix_millis("modificationTime") / 1000).alias("modified_at"), F.col("parsed.pages").alias("page_count"), F.col("parsed.paragraphs").alias("paragraph_count"), domain.alias("domain"),
    )
    return Ingested(good, rows.where("parsed.error is not null").select(local.alias("source"), F.col("parsed.error").alias("error")))


def ingest_path(spark: SparkSession, path: str, recursive: bool = True, root: str | None = None, extensions: Iterable[str] | None = None) -> DataFrame:
    """Documents of a file or directory. A single file that is unsupported or unreadable raises; in a directory it is left out."""
    if not storage.exists(spark, path):
        raise FileNotFoundError(path)
    if storage.is_file(spark, path):
        suffix = "." + str(path).rpartition("/")[2].rpartition(".")[2].lower()
        if suffix not in LOADERS or extensions is not None and suffix not in {x.lower() for x in extensions}:
            raise ValueError(f"no loader for {path}")
        found = ingest(spark, path, recursive, root, extensions)
        if bad := found.failures.first():
            raise ValueError(f"{bad.source}: {bad.error}")
        return found.documents
    return ingest(spark, path, recursive, root, extensions).documents
