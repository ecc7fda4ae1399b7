"""Word documents as a token relation: one row for each piece of text, break, field or comment mark, tracked paragraph mark and
change of properties, with what surrounds it."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from refloom.sources.exports import files

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
# Fixed value: the gallery of content controls that hold a table of contents.
CONTENTS_GALLERY = "table of contents"
TOKENS = "doc string, part string, para int, pos long, kind string, text string, in_ins boolean, in_del boolean, in_move_from boolean, in_move_to boolean, in_fallback boolean, in_txbx boolean, pstyle string, error string"
_COLUMNS = [c.split()[0] for c in TOKENS.split(", ")]
_DECLARES = re.compile(rb"<!(?:DOCTYPE|ENTITY)", re.I)
_STRICT = b"http://purl.oclc.org/ooxml/wordprocessingml/main"
#: Bytes of an unpacked part; a larger one is reported, not read.
LARGEST_PART = 200 << 20
_MARKS = {f"{W}ins": 0, f"{W}del": 1, f"{W}moveFrom": 2, f"{W}moveTo": 3, f"{MC}Fallback": 4, f"{W}txbxContent": 5}

# Marks of comments, tracked changes of a table's geometry, changes of properties with their scope, and children of a
# scope that its record of change doesn't cover.
_COMMENT_MARKS = {f"{W}commentRangeStart": "cstart", f"{W}commentRangeEnd": "cend", f"{W}commentReference": "cref"}
_GEOMETRY = (f"{W}cellIns", f"{W}cellDel", f"{W}cellMerge")
_CHANGES = {f"{W}{x}Change": x for x in ("rPr", "pPr", "trPr", "tcPr", "tblPr", "tblGrid", "sectPr")}
_KEPT = {"pPr": (f"{W}rPr", f"{W}sectPr"), "rPr": (f"{W}ins", f"{W}del", f"{W}moveTo", f"{W}moveFrom")}


def _property(e) -> str:
    """A property as its name and values."""
    return "=".join([e.tag.rpartition("}")[2], *(v for _, v in sorted(e.attrib.items()))])


def _tokens(doc: str, part: str, root) -> Iterator[tuple]:
    """Tokens in document order, by a stack of what is still to be visited, so nesting may be as deep as it likes.

    A paragraph inside a text box has a number of its own; text after the box belongs to the outer paragraph again.
    """
    last, pos = -1, 0
    stack = [(root, (False,) * 6, -1, None)]
    while stack:
        e, marks, para, style = stack.pop()
        kind, text = None, None
        if e is None:
            yield (doc, part, max(last, 0), pos, "toc", "end", *marks, style, None)
            pos += 1
            continue
        if e.tag == f"{W}p":
            last += 1
            para = last
            s = e.find(f"{W}pPr/{W}pStyle")
            style = s.get(f"{W}val") if s is not None else None
            kind = "p"
        elif e.tag in (f"{W}t", f"{W}delText"):
            kind, text = ("t" if e.tag == f"{W}t" else "dt"), e.text or ""
        elif e.tag in (f"{W}instrText", f"{W}delInstrText"):
            kind, text = "instr", e.text or ""
        elif e.tag == f"{W}fldChar":
            kind, text = "fld", e.get(f"{W}fldCharType")
        elif e.tag == f"{W}fldSimple":
            kind, text = "fldsimple", e.get(f"{W}instr") or ""
        elif e.tag == f"{W}sdt":
            tag = e.find(f"{W}sdtPr/{W}tag")
            gallery = next((g.get(f"{W}val") or "" for x in ("docPartObj", "docPartList") if (g := e.find(f"{W}sdtPr/{W}{x}/{W}docPartGallery")) is not None), "")
            if gallery.strip().lower() == CONTENTS_GALLERY:
                kind, text = "toc", "begin"
                stack.append((None, marks, para, style))  # read again after all that is inside
            elif tag is not None and re.search("CSL_CITATION|MENDELEY_CITATION", tag.get(f"{W}val") or ""):
                kind, text = "sdt", tag.get(f"{W}val")
        elif e.tag == f"{W}tab":
            kind, text = "t", "\t"
        elif e.tag in (f"{W}br", f"{W}cr"):
            kind, text = "t", "\n"
        elif e.tag in _COMMENT_MARKS:
            kind, text = _COMMENT_MARKS[e.tag], e.get(f"{W}id")
        elif e.tag in _GEOMETRY:
            kind, text = "geom", e.tag.removeprefix(W)
        if e.tag in _MARKS:
            marks = tuple(m or i == _MARKS[e.tag] for i, m in enumerate(marks))
        if kind:
            yield (doc, part, max(para, 0), pos, kind, text, *marks, style, None)
            pos += 1
        if e.tag == f"{W}p" and (mark := e.find(f"{W}pPr/{W}rPr")) is not None and (tracked := [m for m in mark if m.tag in _MARKS]):
            own = tuple(m or any(_MARKS[t.tag] == i for t in tracked) for i, m in enumerate(marks))
            yield (doc, part, max(para, 0), pos, "pmark", None, *own, style, None)
            pos += 1
        if e.tag.endswith("Pr") or e.tag == f"{W}tblGrid":
            # the properties themselves are no content: only what they were before, and changes of a table's geometry
            for c in e.iter():
                if c.tag in _CHANGES:
                    scope = _CHANGES[c.tag]
                    owner = next((x for x in e.iter() if c in x), e)
                    now, prior = ([x for x in owner if x is not c and x.tag not in _KEPT.get(scope, ())], [x for x in c.find(f"{W}{scope}") or () if x.tag not in _KEPT.get(scope, ())])
                    yield (doc, part, max(para, 0), pos, "fmt", json.dumps({"scope": scope, "now": " ".join(map(_property, now)), "prior": " ".join(map(_property, prior))}), *marks, style, None)
                    pos += 1
                elif c.tag in _GEOMETRY:
                    yield (doc, part, max(para, 0), pos, "geom", c.tag.removeprefix(W), *marks, style, None)
                    pos += 1
        else:
            stack += [(c, marks, para, style) for c in reversed(e)]


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for name, raw in zip(frame.source_file, frame.content, strict=True):
            rows = []
            try:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for info in z.infolist():
                        if not re.fullmatch(r"word/(document|footnotes|endnotes|comments|header\d*|footer\d*)\.xml", info.filename):
                            continue
                        if info.file_size > LARGEST_PART:
                            raise ValueError("part too large")
                        part = z.read(info)
                        if _DECLARES.search(part[:4096]):
                            raise ValueError("document type declaration")
                        if _STRICT in part[:4096]:
                            raise ValueError("strict namespace: save the document in the usual (transitional) form")
                        rows += _tokens(name, info.filename, ElementTree.fromstring(part))
                    if "word/document.xml" not in z.namelist():
                        raise ValueError("no part word/document.xml")
            except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, RecursionError) as e:
                rows = [(name, None, None, None, None, None, *(None,) * 6, None, f"{type(e).__name__}: {e}")]
            yield pd.DataFrame(rows, columns=_COLUMNS).astype({"para": "Int32", "pos": "Int64"})


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of all documents under a path; a file that can't be read gives one row with its error."""
    return files(spark, path).mapInPandas(_read, TOKENS)


B = "{http://schemas.openxmlformats.org/officeDocument/2006/bibliography}"
SOURCES = "doc string, part string, place int, tag string, title string, doi string, year string, authors array<string>, error string"


def _sources(doc: str, part: str, root) -> Iterator[tuple]:
    """The sources of a store that have a tag, in order."""
    words = lambda e: " ".join((e.text or "").split()) if e is not None else ""
    for place, source in enumerate(root.iter(f"{B}Source")):
        if tag := words(source.find(f"{B}Tag")):
            doi = re.search(r"10\.\d{4,9}/[^\s\"<>']+", words(source.find(f"{B}DOI")))
            people = ((words(p.find(f"{B}Last")), words(p.find(f"{B}First"))) for p in source.iter(f"{B}Person"))
            authors = [f"{last} {''.join(w[0].upper() for w in first.split())}".strip() for last, first in people if last]
            yield doc, part, place, tag, words(source.find(f"{B}Title")) or None, doi[0].rstrip(".,);:]") if doi else None, words(source.find(f"{B}Year")) or None, authors, None


def _read_sources(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for name, raw in zip(frame.source_file, frame.content, strict=True):
            rows = []
            try:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for info in sorted(z.infolist(), key=lambda i: i.filename):
                        if not info.filename.endswith(".xml") or info.file_size > LARGEST_PART or b"Sources" not in (part := z.read(info)) or B[1:-1].encode() not in part:
                            continue
                        try:
                            if _DECLARES.search(part[:4096]):
                                raise ValueError("document type declaration")
                            rows += _sources(name, info.filename, ElementTree.fromstring(part))
                        except (ElementTree.ParseError, ValueError) as e:
                            rows.append((name, info.filename, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            except (zipfile.BadZipFile, ValueError) as e:
                rows = [(name, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SOURCES.split(", ")], dtype="object").astype({"place": "Int32"})


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Sources stored in the documents under a path, by tag; a store that can't be read gives one row with its error."""
    return files(spark, path).mapInPandas(_read_sources, SOURCES)
