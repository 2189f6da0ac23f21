"""EPUB 3 books from parts of chapters: a batch sink of Spark's Python data source API.

Rows are (book, title, author, language, chapter, chapter_title, page, block, body,
cover); the parts of a chapter come in order of (page, block), and a row with a
cover brings the book's picture. Partition them by book and sort within
partitions: each task then streams the books it holds part by part, so neither a
book nor a chapter is ever in memory.

Books are written to a folder of this job beside the old ones and moved over
them when all tasks are done; a job that fails leaves the old books as they were.
The path must be a folder that the driver and all executors share, mounted or local.
"""

from __future__ import annotations

import html
import os
import re
import shutil
import subprocess
import uuid
import zipfile
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "book string, title string, author string, language string, chapter int, chapter_title string, page int, block int, body string, cover binary"
CSS = "html { direction: rtl; }\nbody { font-family: serif; line-height: 1.9; text-align: justify; }\n.verse .v { display: flex; justify-content: space-between; }\n.verse .m1, .verse .m2 { width: 48%; }\nsup { line-height: 0; }\ntable { border-collapse: collapse; }\ntd, th { border: 1px solid; padding: .2em .6em; }\n"
HEAD = '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang="{lang}" dir="rtl"><head><title>{title}</title><link rel="stylesheet" href="style.css"/></head><body>{body}</body></html>'
FONT = "@font-face { font-family: book; src: url(fonts/%s); }\nbody { font-family: book, serif; }\n"
STAMP = (1980, 1, 1, 0, 0, 0)  # equal input gives equal files


@dataclass
class Written(WriterCommitMessage):
    done: list  # (staged file, name of the book's file)


class Book:
    """One book's file, open for its parts."""

    def __init__(self, path: str, row, font: str | None = None, licence: str | None = None):
        self.path, self.row, self.font = path, row, None
        self.zip = zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED)
        self.lang, self.title = row.language or "fa", row.title or row.book
        self.names: list[tuple[str, str]] = []
        self.part, self.open, self.picture, self.extra = None, None, None, []
        self._put("mimetype", b"application/epub+zip", zipfile.ZIP_STORED)
        self._put("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        css = CSS
        if font:
            name = os.path.basename(font)
            css += FONT % name
            self._file("font", f"fonts/{name}", "font/otf" if name.lower().endswith(".otf") else "font/ttf", font)
            if licence:  # a font's licence goes where the font goes
                self._file("licence", f"fonts/{os.path.basename(licence)}", "text/plain", licence)
        self._put("OEBPS/style.css", css)

    def _put(self, name: str, data: str | bytes, how=zipfile.ZIP_DEFLATED) -> None:
        info = zipfile.ZipInfo(name, STAMP)
        info.compress_type = how
        self.zip.writestr(info, data)

    def _file(self, key: str, name: str, kind: str, path: str) -> None:
        with open(path, "rb") as f:
            self._put(f"OEBPS/{name}", f.read())
        self.extra.append(f'<item id="{key}" href="{name}" media-type="{kind}"/>')

    def add(self, row) -> None:
        if row.cover is not None:
            png = bytes(row.cover[:8]) == b"\x89PNG\r\n\x1a\n"
            self.picture = "cover.png" if png else "cover.jpg"
            self._end()
            self._put(f"OEBPS/{self.picture}", bytes(row.cover), zipfile.ZIP_STORED)
            self._put("OEBPS/cover.xhtml", HEAD.format(lang=self.lang, title=html.escape(self.title), body=f'<img src="{self.picture}" alt="{html.escape(self.title)}"/>'))
            return
        if self.part != row.chapter or self.open is None:
            self._begin(row)
        self.open.write((row.body or "").encode())

    def _begin(self, row) -> None:
        self._end()
        title = row.chapter_title or self.title
        name = f"chap_{len(self.names) + 1:03d}.xhtml"
        self.names.append((name, title))
        info = zipfile.ZipInfo(f"OEBPS/{name}", STAMP)
        info.compress_type = zipfile.ZIP_DEFLATED
        self.part, self.open = row.chapter, self.zip.open(info, "w")
        start, self.rest = HEAD.format(lang=self.lang, title=html.escape(title), body="\0").split("\0")
        own = "" if re.match(r"\s*<h1[ >]", row.body or "") else f"<h1>{html.escape(title, quote=False)}</h1>"
        self.open.write((start + own).encode())

    def _end(self) -> None:
        if self.open is not None:
            self.open.write(self.rest.encode())
            self.open.close()
            self.open = None

    def close(self) -> tuple[str, str]:
        self._end()
        e, lang = html.escape, self.lang
        links = "".join(f'<li><a href="{n}">{e(t, quote=False)}</a></li>' for n, t in self.names)
        self._put("OEBPS/nav.xhtml", HEAD.format(lang=lang, title=e(self.title), body=f'<nav epub:type="toc"><ol>{links}</ol></nav>'))
        uid = uuid.uuid5(uuid.NAMESPACE_URL, self.row.book)
        points = "".join(f'<navPoint id="n{i}" playOrder="{i}"><navLabel><text>{e(t)}</text></navLabel><content src="{n}"/></navPoint>' for i, (n, t) in enumerate(self.names, 1))
        self._put("OEBPS/toc.ncx", f'<?xml version="1.0" encoding="utf-8"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="{uid}"/></head><docTitle><text>{e(self.title)}</text></docTitle><navMap>{points}</navMap></ncx>')
        items = "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, (n, _) in enumerate(self.names, 1))
        spine = "".join(f'<itemref idref="c{i}"/>' for i in range(1, len(self.names) + 1))
        meta = ""
        if self.picture:
            kind = "image/png" if self.picture.endswith("png") else "image/jpeg"
            items += f'<item id="cover" href="cover.xhtml" media-type="application/xhtml+xml"/><item id="picture" href="{self.picture}" media-type="{kind}" properties="cover-image"/>'
            spine = '<itemref idref="cover"/>' + spine
            meta = '<meta name="cover" content="picture"/>'
        items += "".join(self.extra)
        self._put("OEBPS/content.opf", f'<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">urn:uuid:{uid}</dc:identifier><dc:title>{e(self.title)}</dc:title><dc:creator>{e(self.row.author or "Unknown")}</dc:creator><dc:language>{lang}</dc:language><meta property="dcterms:modified">1980-01-01T00:00:00Z</meta>{meta}</metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="css" href="style.css" media-type="text/css"/>{items}</manifest><spine toc="ncx" page-progression-direction="rtl"><itemref idref="nav"/>{spine}</spine></package>')
        self.zip.close()
        return self.path, re.sub(r'[\\/:*?"<>|\s]+', "-", self.row.book) + ".epub"


class Writer(DataSourceWriter):
    def __init__(self, options: dict):
        path = options["path"]
        if "://" in path and not path.startswith("file://"):
            raise ValueError(f"{path}: books need a mounted or local folder")
        self.root = path.removeprefix("file://").removeprefix("file:")
        self.stage = os.path.join(self.root, f".job-{uuid.uuid4().hex}")
        self.font, self.licence = options.get("font"), options.get("licence")

    def write(self, rows) -> Written:
        os.makedirs(self.stage, exist_ok=True)
        book, done = None, []
        for row in rows:
            if book is None or book.row.book != row.book:
                if book is not None:
                    done.append(book.close())
                book = Book(os.path.join(self.stage, uuid.uuid4().hex), row, self.font, self.licence)
            book.add(row)
        if book is not None:
            done.append(book.close())
        return Written(done)

    def commit(self, messages) -> None:
        for m in messages:
            for staged, name in m.done if m else ():
                os.replace(staged, os.path.join(self.root, name))
        shutil.rmtree(self.stage, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


class EpubSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self):
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options)


def write_epub(chapters: DataFrame, path: str, covers: DataFrame | None = None, font: str | None = None, licence: str | None = None) -> None:
    """One file per book in the shared folder `path`. Books are dealt out by key, parts sorted within tasks. `covers` is (book, cover), PNG or JPEG; `font` and `licence` are files in a folder all share.

    Rows without page and block are one part; a book without chapters gets no file, whatever its cover."""
    chapters.sparkSession.dataSource.register(EpubSource)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    none = {c: F.lit(None).cast(t) for c, t in (("page", "int"), ("block", "int"), ("cover", "binary"))}
    rows = chapters.select(*(none[c].alias(c) if c in none and c not in chapters.columns else F.col(c) for c in names))
    if covers is not None:
        first = rows.groupBy("book").agg(*(F.first(c).alias(c) for c in ("title", "author", "language")))
        rows = rows.unionByName(first.join(covers.where("cover IS NOT NULL").dropDuplicates(["book"]).select("book", "cover"), "book").select("book", "title", "author", "language", F.lit(-1).alias("chapter"), F.lit(None).cast("string").alias("chapter_title"), *(none[c].alias(c) for c in ("page", "block")), F.lit(None).cast("string").alias("body"), "cover"))
    out = rows.repartition("book").sortWithinPartitions("book", "chapter", "page", "block").write.format("epub").mode("append")
    for name, value in (("font", font), ("licence", licence)):
        out = out.option(name, value) if value else out
    out.save(path)


def checked(path: str, command: str = "epubcheck") -> tuple[bool, str] | None:
    """Whether a book passes the external checker and what that says; null where there is none."""
    found = shutil.which(command)
    if not found:
        return None
    run = subprocess.run([found, path], capture_output=True, text=True, timeout=600)
    return run.returncode == 0, run.stdout + run.stderr
