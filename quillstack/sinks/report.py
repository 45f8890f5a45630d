"""Reports: plain text, .docx and .pdf of a finished stack, and the tables' own text forms.

A report is one document for a reader, written by the driver from rows that have been brought to its size.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Sequence
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import title_case
from ..functions.text import strip

SURVEY = "Survey Summary"
RULE = "-" * 40
Sections = Sequence[tuple[str, str]]


def heading_of(key: str) -> str:
    return SURVEY if key == "paper" else key.title()


def body_text(sections: Sections) -> str:
    return "\n\n".join(f"{heading_of(k)}\n{t.strip()}" for k, t in sections).strip()


def survey_text(title: str, author: str, introduction: str, sections: Sections, conclusion: str, abstract: str = "") -> str:
    parts = [f"{title.strip()}\n{author.strip()}"]
    parts += [f"Abstract\n{abstract.strip()}"] if abstract.strip() else []
    parts.append(f"Introduction\n{introduction.strip()}")
    body = body_text(sections)
    parts += [body] if body else []
    return "\n\n".join([*parts, f"Conclusion\n{conclusion.strip()}"]) + "\n"


def survey_body(key: str = "key", text: str = "text", order: str = "seq") -> Column:
    """``body_text`` as an aggregate over rows of sections."""
    entry = F.concat(F.when(F.col(key) == "paper", F.lit(SURVEY)).otherwise(title_case(F.col(key))), F.lit("\n"), strip(F.col(text)))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), entry.alias("t"))))
    return strip(F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n"))


def headed(sections: DataFrame, key: str = "key") -> DataFrame:
    """``heading`` of every section row."""
    return sections.withColumn("heading", F.when(F.col(key) == "paper", F.lit(SURVEY)).otherwise(title_case(F.col(key))))


def key_blocks(key: str = "chunk_key", text: str = "text", order: str = "seq") -> Column:
    """Chunks or summaries in their file form, as an aggregate: key, a rule, the text, a blank line."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(F.col(key), F.lit(f"\n{RULE}\n"), F.col(text), F.lit("\n\n")).alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), "")


def context_text(combined: Column, name: str = "name", paper: str = "paper", order: str = "ordinal") -> Column:
    """What the introduction and the conclusion are written from, as an aggregate over documents: the stack's summary and theirs."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(F.col(name), F.lit(":\n"), strip(F.col(paper))).alias("t"))))
    return strip(F.concat(F.lit("Survey Synthesis:\n"), strip(combined), F.lit("\n\nIndividual Document Summaries:\n"), F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n")))


def _layout(title, author, introduction, sections: Sections, conclusion, abstract):
    """(style, text) of the parts: 0 title, 1 heading, 2 paragraph."""
    yield 0, title.strip()
    yield 2, author.strip()
    if abstract.strip():
        yield from ((1, "Abstract"), (2, abstract.strip()))
    yield from ((1, "Introduction"), (2, introduction.strip()))
    for key, text in sections:
        yield from ((1, heading_of(key)), (2, text.strip()))
    yield from ((1, "Conclusion"), (2, conclusion.strip()))


_DOCX = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}
_SIZES = {0: (40, True), 1: (28, True), 2: (24, False)}


def docx_bytes(*report, abstract: str = "") -> bytes:
    """report: title, author, introduction, sections, conclusion."""
    body = []
    for style, text in _layout(*report, abstract):
        size, bold = _SIZES[style]
        for line in text.split("\n"):
            body.append(f'<w:p><w:r><w:rPr>{"<w:b/>" if bold else ""}<w:sz w:val="{size}"/></w:rPr><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>')
    document = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{"".join(body)}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as parts:
        for name, content in (_DOCX | {"word/document.xml": document}).items():
            parts.writestr(name, content)
    return out.getvalue()


# Fixed values of the page: US letter, margins of an inch, leading, in points.
PAGE, MARGIN, LEADING = (612, 792), 72, 14
_PDF_STYLES = {0: ("F2", 16, 4), 1: ("F2", 14, 2), 2: ("F1", 12, 8)}


def _width(text: str, size: int) -> float:
    """Of a Times face, from classes of letters: narrow, wide and others."""
    return size * sum(0.28 if c in " .,;:!'|ijlt()[]" else 0.72 if c.isupper() or c in "mw@%" else 0.5 for c in text)


def pdf_bytes(*report, abstract: str = "") -> bytes:
    """report: title, author, introduction, sections, conclusion. Words wrap greedily; a page ends at its margin."""
    pages, lines, y = [], [], PAGE[1] - MARGIN
    for style, text in _layout(*report, abstract):
        font, size, gap = _PDF_STYLES[style]
        rows, row = [], ""
        for word in text.split():
            if row and _width(f"{row} {word}", size) >= PAGE[0] - 2 * MARGIN:
                rows.append(row)
                row = word
            else:
                row = f"{row} {word}".strip()
        for row in [*rows, row] if row else rows:
            safe = row.encode("cp1252", "replace").decode("cp1252").replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)")
            lines.append(f"BT /{font} {size} Tf {MARGIN} {y} Td ({safe}) Tj ET")
            y -= LEADING
            if y < MARGIN:
                pages.append(lines)
                lines, y = [], PAGE[1] - MARGIN
        y -= gap
    pages.append(lines)
    kids = " ".join(f"{5 + 2 * k} 0 R" for k in range(len(pages)))
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>"]
    objects += [f"<< /Type /Font /Subtype /Type1 /BaseFont /Times-{face} /Encoding /WinAnsiEncoding >>" for face in ("Roman", "Bold")]
    for k, page in enumerate(pages):
        stream = "\n".join(page)
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {PAGE[0]} {PAGE[1]}] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents {6 + 2 * k} 0 R >>")
        objects.append(f"<< /Length {len(stream.encode('cp1252'))} >>\nstream\n{stream}\nendstream")
    out, places = b"%PDF-1.4\n", []
    for k, x in enumerate(objects):
        places.append(len(out))
        out += f"{k + 1} 0 obj\n{x}\nendobj\n".encode("cp1252")
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


def export(path: str, kind: str, *report, abstract: str = "") -> None:
    if kind not in ("txt", "docx", "pdf"):
        raise ValueError("Unsupported file type")
    made = survey_text(*report, abstract=abstract).encode() if kind == "txt" else (docx_bytes if kind == "docx" else pdf_bytes)(*report, abstract=abstract)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "wb") as f:
        f.write(made)
