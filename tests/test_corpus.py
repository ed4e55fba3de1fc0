"""Files of a small LaTeX corpus: scan, inclusion, listings, parts, labels and references."""

import pytest

from scriptorium.operators import refs
from scriptorium.sources import corpus

MAIN = r"""\documentclass{article} % the class
  \begin{document}
\section{One}\label{sec:one}
\input{chapters/a}
50\% of it % gone
   stays. See \cref{sec:one, eq:x} and \ref{nowhere}.

\subsection*{Two}
\input{absent}\lstinputlisting[language=C]{code.c}
\end{document} after"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("paper")
    (top / "chapters").mkdir()
    (top / "main.tex").write_text(MAIN)
    (top / "chapters/a.tex").write_text("A \\input{b} and \\label{eq:x} $1")
    (top / "chapters/b.tex").write_text("B")
    (top / "self.tex").write_text("x\\input{self}")
    (top / "code.c").write_text("int x; % kept")
    return top


def flat(spark, folder):
    files = corpus.latex_files(spark, str(folder))
    mains = files.where("path LIKE '%main.tex' OR path LIKE '%self.tex'").select("path")
    clean = files.withColumn("source", corpus.without_comments(files.source))
    return corpus.flattened(clean, mains, 4)


def test_flattened(spark, folder):
    got = {r["path"].rsplit("/")[-1]: r["source"] for r in flat(spark, folder).collect()}
    assert set(got) == {"main.tex", "self.tex"}
    assert got["self.tex"] == "xxxxx"
    assert "A B and \\label{eq:x} $1\n50\\% of it stays." in got["main.tex"]
    assert "absent" not in got["main.tex"] and "the class" not in got["main.tex"]


def test_parts(spark, folder):
    listings = corpus.latex_files(spark, str(folder), "*.c")
    whole = corpus.with_listings(flat(spark, folder).where("path LIKE '%main.tex'"), listings)
    bodies = corpus.parts(whole)
    row = bodies.first()
    assert row["preamble"].strip() == "\\documentclass{article}" and "after" not in row["body"]
    assert "\\begin{verbatim}\nint x; % kept\n\\end{verbatim}" in row["body"]
    assert [(r["level"], r["starred"], r["title"]) for r in corpus.headings(bodies).orderBy("pos").collect()] == [(1, False, "One"), (2, True, "Two")]
    labels, references = corpus.labels(bodies), corpus.references(bodies)
    assert [r["key"] for r in labels.orderBy("pos").collect()] == ["sec:one", "eq:x"]
    assert [r["key"] for r in refs.dangling(references.select("key"), labels.select("key").withColumnRenamed("key", "label"), "key", "label").collect()] == ["nowhere"]
    assert corpus.blocks(bodies).count() == 2
