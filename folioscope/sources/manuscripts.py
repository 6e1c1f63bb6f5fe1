"""Manuscript files as rows: Office Open XML documents and LaTeX sources.

Each file is one row of Spark's binaryFile source and is read by one Arrow batch function with the
standard library alone.  A damaged or oversized file gives one row of kind `hazard`, never an error;
what isn't understood gives a hazard with its text, so nothing is left out in silence.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of a file: bytes of the archive and of one part, and parts; beyond them it is a hazard.
MAX_BYTES, MAX_PART, MAX_PARTS = 100_000_000, 50_000_000, 5_000
_SCHEMA = pa.schema([("path", pa.string()), ("seq", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("text", pa.string())])
# Names of the two namespaces, and elements by what they mean.
_W, _M = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
_REL, _IN = "{http://schemas.openxmlformats.org/package/2006/relationships}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_TRACKED = ("ins", "del", "moveFrom", "moveTo", "rPrChange", "pPrChange")
_FIELDS = ("REF", "PAGEREF", "HYPERLINK", "SEQ", "PAGE", "NUMPAGES", "CITATION", "TOC", "ADDIN")
_CAPTION = re.compile(r"(?i)^\s*(fig(?:ure)?|table)\.?\s*\d")
_MARK = re.compile(r"\[\d+(?:\s*[-,–]\s*\d+)*\]")
_ABSTRACT = re.compile(r"(?i)^abstract\W*$")


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_W}t"))


def _paragraph(p: ElementTree.Element, targets: dict[str, str]) -> Iterator[tuple[str, str, str]]:
    """Rows of a paragraph: itself, then the marked, calculated and drawn things in it."""
    style = p.find(f"{_W}pPr/{_W}pStyle")
    label = style.get(f"{_W}val", "") if style is not None else ""
    text, low = _text(p), label.lower()
    kind = "heading" if low.startswith("heading") else "title" if low == "title" else "caption" if low == "caption" or _CAPTION.match(text) else "paragraph"
    yield kind, label, text
    for tag in _TRACKED:
        for change in p.iter(f"{_W}{tag}"):
            yield "hazard", "tracked change", "".join(x.text or "" for x in change.iter() if x.tag in (f"{_W}t", f"{_W}delText"))
    for math in p.iter(f"{_M}oMath"):
        yield "equation", "OMML", "".join(t.text or "" for t in math.iter(f"{_M}t"))
    codes = [(i.text or "").strip() for i in p.iter(f"{_W}instrText")] + [f.get(f"{_W}instr", "").strip() for f in p.iter(f"{_W}fldSimple")]
    for code in filter(None, codes):
        known = code.split(None, 1)[0].upper() in _FIELDS
        yield ("field", code.split(None, 1)[0], code) if known else ("hazard", "unknown field", code)
    for mark in _MARK.findall(text):
        yield "citation", "numeric", mark
    for drawn in p.iter():
        if (target := drawn.get(f"{_IN}embed")) is not None:
            yield "figure", target, targets.get(target, "")
    for _ in p.iter(f"{_W}object"):
        yield "hazard", "embedded object", text
    for ref, kind in ((f"{_W}footnoteReference", "footnote"), (f"{_W}endnoteReference", "endnote")):
        for r in p.iter(ref):
            yield "note reference", kind, r.get(f"{_W}id", "")


def _table(t: ElementTree.Element) -> str:
    """Rows of a table as lines, cells parted by bars; a table in a cell is part of its text."""
    return "\n".join(" | ".join(" ".join(filter(None, (_text(p) for p in c.iter(f"{_W}p")))) for c in r.findall(f"{_W}tc")) for r in t.findall(f"{_W}tr"))


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    body = z.read(name)
    if b"<!DOCTYPE" in body or b"<!ENTITY" in body:
        raise ValueError(name)
    return ElementTree.fromstring(body)


def docx_rows(content: bytes) -> list[tuple[str, str, str]]:
    """(kind, name, text) of a document's title, headings, paragraphs, captions, tables, equations, fields,
    citations, figures, notes, relationships and media, in order.

    The paragraphs between a heading Abstract and the next heading are its abstract.  Notes have their
    number as name; negative ones are separators and no notes.
    """
    if len(content) > MAX_BYTES:
        return [("hazard", "archive", "too large")]
    out: list[tuple[str, str, str]] = []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            parts, names = z.infolist(), set(z.namelist())
            if len(parts) > MAX_PARTS or any(p.file_size > MAX_PART for p in parts):
                return [("hazard", "archive", "too many or too large parts")]
            targets: dict[str, str] = {}
            if "word/_rels/document.xml.rels" in names:
                targets = {r.get("Id", ""): r.get("Target", "") for r in _part(z, "word/_rels/document.xml.rels").iter(f"{_REL}Relationship")}
            if "word/document.xml" in names:
                root = _part(z, "word/document.xml")
                body = root.find(f"{_W}body")
                in_abstract = False
                for node in body if body is not None else root:
                    if node.tag == f"{_W}p":
                        rows = list(_paragraph(node, targets))
                        if rows[0][0] == "heading" or _ABSTRACT.match(rows[0][2]):
                            in_abstract = bool(_ABSTRACT.match(rows[0][2]))
                        elif in_abstract and rows[0][0] == "paragraph":
                            rows[0] = ("abstract", *rows[0][1:])
                        out += rows
                    elif node.tag == f"{_W}tbl":
                        out.append(("table", "", _table(node)))
                    elif node.tag != f"{_W}sectPr":
                        out.append(("hazard", node.tag.rpartition("}")[2], "".join(node.itertext())))
            for name, kind in (("word/footnotes.xml", "footnote"), ("word/endnotes.xml", "endnote")):
                if name in names:
                    out += [("note", f"{kind} {number}", _text(n)) for n in _part(z, name).iter(f"{_W}{kind}") if not (number := n.get(f"{_W}id", "")).startswith("-")]
            out += [("relationship", k, v) for k, v in sorted(targets.items())]
            return out + [("image", p.filename, hashlib.sha256(z.read(p)).hexdigest()) for p in parts if p.filename.startswith("word/media/")]
    except ValueError as e:
        return [*out, ("hazard", str(e), "document type")]
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, RuntimeError, OSError) as e:
        return [*out, ("hazard", "archive", type(e).__name__)]


# LaTeX commands by what they hold, environments that are understood, commands without content.
_HELD = {"title": "title", "section": "heading", "subsection": "heading", "subsubsection": "heading", "caption": "caption", "label": "label", "includegraphics": "figure file", "input": "include", "include": "include"}
_CITES = ("cite", "citep", "citet", "citealp", "citeauthor", "citeyear")
_MATH = ("equation", "equation*", "align", "align*", "gather", "gather*", "displaymath", "eqnarray")
_KNOWN = ("document", "abstract", "figure", "figure*", "table", "table*", "tabular", "thebibliography", "itemize", "enumerate", "center", "quote", *_MATH)
_PLAIN = (
    "documentclass", "usepackage", "maketitle", "begin", "end", "author", "and", "date", "bibitem", "ref", "eqref", "pageref", "autoref", "textbf", "textit", "emph", "texttt", "item", "centering", "hline", "toprule",
    "midrule", "bottomrule", "bibliographystyle", "bibliography", "noindent", "newpage", "footnote", "alpha", "beta", "gamma", "delta", "lambda", "mu", "sigma", "times", "pm", "frac", "sum", "sqrt", "cdot", "leq", "geq", "infty", "left", "right", "quad",
)
_UNSAFE = ("write18", "openout", "openin", "immediate", "newcommand", "renewcommand", "def", "catcode", "special")
_TEX = re.compile(r"\\begin\s*\{(?P<env>[^{}]*)\}|\\(?P<cmd>[a-zA-Z]+\d*)\*?|(?<!\\)\$(?P<math>(?:[^$\\]|\\.)+)\$")
_GROUP = re.compile(r"\s*(?:\[[^\]]*\])?\s*\{((?:[^{}]|\{[^{}]*\})*)\}")


def tex_rows(content: bytes) -> list[tuple[str, str, str]]:
    """(kind, name, text) of a LaTeX source's objects in order, comments dropped: title, authors, headings,
    paragraphs, abstract, equations, tables, figures, captions, citations (one row a command, its keys in
    text), references, labels and includes.  Commands and environments that aren't known are hazards
    with their position as name."""
    if len(content) > MAX_BYTES:
        return [("hazard", "source", "too large")]
    text = re.sub(r"(?<!\\)%.*", "", content.decode("utf-8", errors="replace"))
    found: list[tuple[int, str, str, str]] = []
    shown = list(text)  # what is left for paragraphs

    def hide(a: int, b: int) -> None:
        shown[a:b] = ["\n" if c == "\n" else " " for c in text[a:b]]

    for m in _TEX.finditer(text):
        at, env, cmd = m.start(), m["env"], m["cmd"]
        if env is not None:
            end = text.find(f"\\end{{{env}}}", m.end())
            body = text[m.end() : end if end >= 0 else len(text)]
            if env in _MATH:
                found.append((at, "equation", env, re.sub(r"\\label\s*\{[^{}]*\}", "", body).strip()))
            elif env == "abstract":
                found.append((at, "abstract", "", body.strip()))
            elif env.rstrip("*") in ("figure", "table"):
                cells = re.search(r"\\begin\s*\{tabular\}(?:\s*\{[^{}]*\})?(.*?)\\end\s*\{tabular\}", body, re.S)
                found.append((at, env.rstrip("*"), env, re.sub(r"\s+", "", cells[1]) if cells else ""))
            elif env not in _KNOWN:
                found.append((at, "hazard", f"environment {env} at {at}", body.strip()))
            if env in _MATH or env.rstrip("*") in ("abstract", "figure", "table", "thebibliography") or env not in _KNOWN:
                hide(at, (end if end >= 0 else len(text)) + len(f"\\end{{{env}}}"))
            else:
                hide(at, m.end())
            continue
        if m["math"] is not None:
            found.append((at, "equation", "inline", m["math"].strip()))
            continue
        group = _GROUP.match(text, m.end())
        held = group[1].strip() if group else ""
        if cmd in _HELD:
            found.append((at, _HELD[cmd], cmd, held))
        elif cmd in _CITES:
            found.append((at, "citation", cmd, ",".join(k.strip() for k in held.split(","))))
        elif cmd == "author":
            found += [(at, "author", str(i), a.strip()) for i, a in enumerate(re.split(r"\\and\b", held))]
        elif cmd == "bibitem":
            stop = re.compile(r"\\bibitem\b|\\end\b").search(text, m.end())
            found.append((at, "reference", held, " ".join(text[group.end() if group else m.end() : stop.start() if stop else len(text)].split())))
        elif cmd in _UNSAFE:
            found.append((at, "hazard", f"unsafe at {at}", cmd))
        elif cmd not in _PLAIN:
            found.append((at, "hazard", f"command at {at}", cmd))
        if cmd not in _CITES and cmd not in ("textbf", "textit", "emph", "texttt", "footnote", "ref", "eqref"):
            hide(at, group.end() if group and cmd in (*_HELD, "author", "documentclass", "usepackage", "bibitem", "end", "date", "bibliographystyle", "bibliography") else m.end())
    at = 0
    for block in re.split(r"(\n\s*\n)", "".join(shown)):
        if re.search(r"[^\W_]", block):
            found.append((at + len(block) - len(block.lstrip()), "paragraph", "", " ".join(block.split())))
        at += len(block)
    return [(k, n, t) for _, k, n, t in sorted(found, key=lambda r: r[0])]


def read_manuscripts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, seq, kind, name, text) of all .docx and .tex files below a folder; others are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                read = docx_rows if path.lower().endswith(".docx") else tex_rows
                rows += [(path, i, *r) for i, r in enumerate(read(content.as_py() or b""))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_SCHEMA), _SCHEMA, strict=True)], schema=_SCHEMA)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.where(F.lower("path").rlike(r"\.(docx|tex)$")).select("path", "content")
    return files.mapInArrow(run, "path string, seq int, kind string, name string, text string")


def included(rows: DataFrame) -> DataFrame:
    """(path, target) of the files that LaTeX sources include; `ancestors` follows them and ends cycles."""
    target = F.when(F.endswith("text", F.lit(".tex")), F.col("text")).otherwise(F.concat("text", F.lit(".tex")))
    return rows.where("kind = 'include' and text != '' and not contains(text, '..') and not startswith(text, '/')").select("path", F.concat(F.regexp_extract("path", r"^(.*/)[^/]*$", 1), target).alias("target")).distinct()


def read_profiles(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rule profiles of JSON files, one per file, in a fixed schema; a file that breaks it fails the read."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(path)
