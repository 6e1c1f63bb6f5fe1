"""Manuscript readers on files made here."""

from __future__ import annotations

import io
import zipfile

from folioscope.sources.manuscripts import docx_rows, included, read_manuscripts, read_profiles, tex_rows

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_files_to_rows(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {W}><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Results</w:t></w:r></w:p><w:p><w:r><w:t>We </w:t></w:r><w:r><w:t>saw.</w:t></w:r></w:p></w:document>')
        z.writestr("word/media/i.png", b"x")
    with zipfile.ZipFile(tmp_path / "evil.docx", "w") as z:
        z.writestr("word/document.xml", "<!DOCTYPE x><x/>")
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    (tmp_path / "m.tex").write_text("\\section{Intro} % \\cite{no}\ntext \\cite{a,b} \\input{part} \\write18{rm}\n")
    (tmp_path / "part.tex").write_text("")
    (tmp_path / "x.txt").write_text("ignored")
    rows = read_manuscripts(spark, str(tmp_path)).collect()
    got = {(r.path.rsplit("/", 1)[1], r.seq, r.kind, r.text) for r in rows}
    image = "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"  # of b"x"
    assert got == {
        ("a.docx", 0, "heading", "Results"), ("a.docx", 1, "paragraph", "We saw."), ("a.docx", 2, "image", image), ("evil.docx", 0, "hazard", "document type"), ("bad.docx", 0, "hazard", "BadZipFile"),
        ("m.tex", 0, "heading", "Intro"), ("m.tex", 1, "paragraph", "text \\cite{a,b} {rm}"), ("m.tex", 2, "citation", "a,b"), ("m.tex", 3, "include", "part"), ("m.tex", 4, "hazard", "write18"),
    }
    assert [r.target.rsplit("/", 1)[1] for r in included(read_manuscripts(spark, str(tmp_path))).collect()] == ["part.tex"]


def test_objects_of_a_document():
    body = f"""<w:document {W} xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><w:body>
      <w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:t>A study</w:t></w:r></w:p><w:p><w:r><w:t>Abstract</w:t></w:r></w:p><w:p><w:r><w:t>We saw 6.</w:t></w:r></w:p>
      <w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Results</w:t></w:r></w:p><w:p><w:r><w:t>As in [1,3].</w:t></w:r><m:oMath><m:r><m:t>x=1</m:t></m:r></m:oMath><w:ins><w:r><w:t>new</w:t></w:r></w:ins></w:p>
      <w:p><w:fldSimple w:instr=" SEQ Figure "/><w:r><w:instrText>MAGIC 1</w:instrText></w:r><w:drawing r:embed="r1"/></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:odd>?</w:odd><w:sectPr/></w:body></w:document>"""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="media/i.png"/></Relationships>')
        z.writestr("word/footnotes.xml", f'<w:footnotes {W}><w:footnote w:id="-1"/><w:footnote w:id="2"><w:p><w:r><w:t>Note.</w:t></w:r></w:p></w:footnote></w:footnotes>')
    assert docx_rows(data.getvalue()) == [
        ("title", "Title", "A study"), ("paragraph", "", "Abstract"), ("abstract", "", "We saw 6."), ("heading", "Heading1", "Results"), ("paragraph", "", "As in [1,3].new"), ("hazard", "tracked change", "new"), ("equation", "OMML", "x=1"),
        ("citation", "numeric", "[1,3]"), ("paragraph", "", ""), ("hazard", "unknown field", "MAGIC 1"), ("field", "SEQ", "SEQ Figure"), ("figure", "r1", "media/i.png"), ("table", "", "A | 2"), ("hazard", "odd", "?"), ("note", "footnote 2", "Note."),
        ("relationship", "r1", "media/i.png"),
    ]


def test_objects_of_a_latex_source():
    source = r"""\documentclass{article} % no
\title{A study} \author{Ada A \and Lin B}
\begin{document}\maketitle
\begin{abstract}
We measured 42 samples.
\end{abstract}
\section{Results}
The response was 12.5\% \citep{a, b} and $E = mc^2$.

Second block.
\begin{equation}
y = 1 \label{eq:one}
\end{equation}
\begin{figure}\includegraphics[width=3cm]{s.png}\caption{Panel A.}\end{figure}
\begin{table}\caption{Values.}\begin{tabular}{cc}1 & 2\end{tabular}\end{table}
\begin{odd}kept\end{odd} \mystery{x}
\begin{thebibliography}{1}
\bibitem{a} Doe J. Work. 2025.
\bibitem{b} Roe R. Other. 2024.
\end{thebibliography}
\end{document}"""
    rows = tex_rows(source.encode())
    kinds = {k: [t for x, _, t in rows if x == k] for k in {x for x, _, _ in rows}}
    assert kinds["title"] == ["A study"] and kinds["author"] == ["Ada A", "Lin B"] and kinds["abstract"] == ["We measured 42 samples."] and kinds["heading"] == ["Results"]
    assert kinds["equation"] == ["E = mc^2", "y = 1"] and kinds["caption"] == ["Panel A.", "Values."] and kinds["table"] == ["1&2"] and kinds["figure file"] == ["s.png"] and kinds["citation"] == ["a,b"]
    assert kinds["reference"] == ["Doe J. Work. 2025.", "Roe R. Other. 2024."] and kinds["hazard"] == ["kept", "mystery"] and kinds["label"] == ["eq:one"]
    assert kinds["paragraph"][0].startswith("The response was 12.5") and kinds["paragraph"][1].startswith("Second block.")


def test_profiles(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"profile_id": "a",\n "rules": [{"rule_id": "x"}]}')
    assert read_profiles(spark, str(tmp_path), "profile_id string, rules array<struct<rule_id string>>").first().rules[0].rule_id == "x"
