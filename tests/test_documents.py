"""Document operators on literal fixtures."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from scrivana.functions import text as T
from scrivana.operators import highlights, quotes, related, segment
from scrivana.sources import epub, readers, sinks


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def words(n, stem="w"):
    return " ".join(f"{stem}{i}" for i in range(n))


def chunk_rows(spark, text, most):
    df = spark.createDataFrame([(1, text)], "id long, t string")
    return segment.numbered(df, segment.chunks(F.col("t"), most), "id").orderBy("n").collect()


def test_marked_text_is_consolidated(spark):
    text = "TITLE: x\n\n" + "=" * 40 + "\n\n" + "\n\n".join(f"## CHAPTER: C{i}\n\n{words(500)}" for i in range(12))
    found = chunk_rows(spark, text, 3000)
    assert 2 <= len(found) <= 4 and all(r.words <= 1.6 * 3000 for r in found)
    assert found[0].title == "C0 (+5 sections)" and found[0].file == "000-c0-5-sections.txt"
    assert found[0].body.startswith("## C0\n\nw0 ") and "## C5\n\n" in found[0].body


def test_long_single_text_is_windowed(spark):
    found = chunk_rows(spark, "\n\n".join(words(250) for _ in range(40)), 2000)
    assert len(found) == 5 and found[0].title == "Section (part 1/5)" and sum(r.words for r in found) == 10000
    giant = chunk_rows(spark, words(9000), 2000)
    assert [r.words for r in giant] == [2000, 2000, 2000, 2000, 1000]


def test_headings_and_preamble(spark):
    text = words(250) + "\n" + "\n".join(f"Chapter {i}\n{words(700)}" for i in range(1, 6))
    found = chunk_rows(spark, text, 2000)
    assert found[0].title.startswith("Front matter") and [r.n for r in found] == [1, 2, 3]
    short = chunk_rows(spark, "a few words\n" + "\n".join(f"Chapter {i}\n{words(700)}" for i in range(1, 6)), 2000)
    assert short[0].title.startswith("Chapter 1")


def test_ranges_keep_numbers(spark):
    index = spark.range(1, 11).toDF("n")
    assert [r.n for r in segment.chosen(index, "1-3, 7").orderBy("n").collect()] == [1, 2, 3, 7]


def test_consolidation_equals_a_plain_fold(spark):
    def plain(segments, target):
        out, group, total = [], [], 0
        for title, body in segments:
            n = len(body.split())
            if not n:
                continue
            if total and total + n > target and total >= target / 2:
                out, group, total = [*out, group], [], 0
            group, total = [*group, (title, body)], total + n
            if total >= target:
                out, group, total = [*out, group], [], 0
        return [*out, group] if group else out

    rng = random.Random(1)
    cases = [[(f"t{i}" if rng.random() < 0.8 else None, words(rng.choice([0, 1, 5, 20, 45, 70]))) for i in range(rng.randint(0, 9))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(cases)), "id int, s array<struct<title:string,body:string>>")
    got = {r.id: r.c for r in df.select("id", segment.consolidated(F.col("s"), 60).alias("c")).collect()}
    for k, case in enumerate(cases):
        want = plain(case, 60)
        assert len(got[k]) == len(want)
        for g, w in zip(got[k], want, strict=True):
            assert g.body == "\n\n".join(f"## {t}\n\n{b}" if t else b for t, b in w)
            assert g.title == (w[0][0] or "Section") + (f" (+{len(w) - 1} sections)" if len(w) > 1 else "")


CLIPPINGS = """Deep Work (Cal Newport)
- Your Highlight on page 12 | Location 120-125 | Added on Monday

Focus is the new IQ.
==========
Deep Work (Cal Newport)
- Your Note on page 12 | Location 125 | Added on Monday

remember this
==========
Other Book (Someone)
- Your Highlight on page 3 | Location 30 | Added on Monday

Unrelated.
==========
Deep Work (Cal Newport)
- Your Bookmark on page 14 | Location 140 | Added on Monday


==========
"""
MARKDOWN = """# Deep Work
## Metadata
- Author: Cal Newport
## Highlights
- Focus is the new IQ! ([Location 120](https://x.example/1))
- Shallow work is easy (page 9)
# Other Book
## Highlights
- Nothing here
"""


def test_highlights_merge(spark):
    kindle = highlights.clippings(spark.createDataFrame([("k", CLIPPINGS)], "path string, text string"), "Deep Work")
    got = kindle.collect()
    assert [(r.text, r.location, r.note, r.kind) for r in got] == [("Focus is the new IQ.", "Location 120-125", "remember this", "highlight")]
    export = highlights.markdown_highlights(spark.createDataFrame([("m", MARKDOWN)], "path string, text string"), "Deep Work", "Newport")
    assert sorted((r.text, r.location) for r in export.collect()) == [("Focus is the new IQ!", "Location 120"), ("Shallow work is easy", "page 9")]
    csv = spark.createDataFrame([("c", 0, "Deep Work", "A multi\nline cell", "7", "", ""), ("c", 1, "", "No title matches all", "", "page", "n"), ("c", 2, "Else", "x", "", "", "")], "path string, pos long, `Book Title` string, Highlight string, Location string, `Location Type` string, Note string")
    rows = highlights.csv_highlights(csv, "Deep Work").orderBy("pos").collect()
    assert [(r.text, r.location, r.note) for r in rows] == [("A multi\nline cell", "Location 7", ""), ("No title matches all", "", "n")]
    every = highlights.bag_union(kindle.select("path", "pos", "text", "location", "note", "kind"), export, highlights.csv_highlights(csv, "Deep Work"))
    unique = highlights.unique_highlights(every).collect()
    assert len(unique) == 4 and {r.text for r in unique} >= {"Focus is the new IQ."} and "Focus is the new IQ!" not in {r.text for r in unique}
    assert {r.src: (r.n, r.unique) for r in highlights.source_counts(every).collect()} == {0: (1, 1), 1: (2, 2), 2: (2, 2)}
    assert any(r.line == "> Focus is the new IQ. — Location 120-125\n    note: remember this" for r in highlights.rendered(kindle.withColumn("src", F.lit(0))).collect())


def test_orphan_and_repeated_notes(spark):
    rows = spark.createDataFrame([("p", 0, "n0", "note"), ("p", 1, "h1", "highlight"), ("p", 2, "a", "note"), ("p", 3, "b", "note"), ("p", 4, "h2", "highlight")], "path string, pos long, text string, kind string")
    assert sorted((r.text, r.note) for r in highlights.attach_notes(rows, "path").collect()) == [("h1", "b"), ("h2", "")]


NOTES = [
    ("v/Thinking.md", "---\ntitle: 'Thinking'\ntags: [Book/Psychology, habits]\n---\nx"),
    ("v/Money.md", "---\ntopics:\n  - finance\n  - habits\ntitle: Money Notes\n---\n"),
    ("v/Self.md", "---\ntags: [psychology, habits]\n---\n"),
    ("v/None.md", "no head"),
    ("v/.git/Hidden.md", "x"),
]


def test_notes_and_related(spark):
    notes = readers.notes(spark.createDataFrame(NOTES, "path string, text string"))
    rows = {r.basename: r for r in notes.collect()}
    assert set(rows) == {"Thinking", "Money", "Self", "None"}
    assert rows["Thinking"].tags == ["habits", "psychology"] and rows["Money"].tags == ["finance", "habits"] and rows["None"].title == "None"
    found = related.related(notes, ["psychology", "Habits"], "The Money Book", exclude="self").collect()
    assert [(r.basename, r.score) for r in found] == [("Thinking", 6), ("Money", 4)]
    assert related.related(notes, ["nothing"], "of the").count() == 0


SUMMARY = "intro\n> «La atención es escasa [...] y se entrena cada día» — 4.ª parte\n> \n\ntext\n> corta\n> «Una frase que no está en el libro» — x\n"


def test_quotes(spark):
    df = spark.createDataFrame([(1, SUMMARY)], "sid long, text string").select("sid", F.posexplode(quotes.blockquotes(F.col("text"))).alias("q", "text"))
    frags = quotes.quote_fragments(df, "sid", "q", full=True)
    assert sorted(r.frag for r in frags.collect())[0].startswith("corta") or frags.count() >= 3
    book = spark.createDataFrame([(1, 'Dice que "la atención es escasa" siempre, y se entrena   cada día.')], "doc_id long, text string")
    found = quotes.containment(frags.where("long_enough"), book, ["sid", "q", "frag_pos"], ["doc_id"], key=T.quote_key_full)
    said = {r.q: r for r in quotes.verdicts(frags, found, ["sid", "q"]).collect()}
    assert said[0].verdict == "PASS" and said[1].verdict == "FAIL"


def test_containment_equals_nested_loop(spark):
    rng = random.Random(2)
    docs = [" ".join(rng.choice("abcde") * rng.randint(1, 3) for _ in range(60)) for _ in range(30)]
    frags = []
    for k in range(60):
        d = rng.choice(docs)
        a = rng.randint(0, 60)
        frags.append((k, 0, d[a : a + rng.randint(3, 50)].strip(), True))
    got = quotes.containment(spark.createDataFrame(frags, "k int, frag_pos int, frag string, long_enough boolean").where("frag <> ''"), spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string"), ["k"], ["doc_id"])
    assert sorted((r.k, r.doc_id) for r in got.collect()) == sorted((k, i) for k, _, f, _ in frags if f for i, d in enumerate(docs) if f in d)


def test_text_functions(spark):
    lit = lambda x: F.lit(x)
    assert one(spark, T.strip_html(F.col("h")), h="<style>x</style><p>a&amp;lt; b<br/>c</p><p>d</p>") == "a&lt; b\nc\n\nd"
    assert one(spark, T.strip_html_full(F.col("h")), h="<p>caf&eacute; &#x41;</p>") == "café A"
    assert one(spark, T.slug(F.col("h")), h="  Café: el Año_1!  ") == "café-el-año-1" and one(spark, T.slug(lit("!!")), h="") == "section"
    assert one(spark, T.text_key(F.col("h")), h="Hé, (B)  c ") == "hé b c"
    assert one(spark, T.year_from(F.col("h")), h="c. 1498, then 1999") == 1999
    assert one(spark, T.task_slug(F.col("h")), h="Été à la Plage!") == "ete-a-la-plage" and one(spark, T.task_slug(lit("a" * 64)), h="") == "task"
    assert one(spark, T.ticket_key(F.col("h")), h=" ab_1-22 ") == "AB_1-22" and one(spark, T.ticket_key(lit("x")), h="") is None
    assert one(spark, T.label(F.col("h")), h="mainRegion_name") == "Main Region name"
    assert one(spark, T.quote_key_full(F.col("h")), h="“Ｈｉ” — ‘yo’") == "'hi' - 'yo'"
    assert one(spark, T.typed_location(lit("PAGE"), F.col("h")), h="9") == "Page 9"
    assert one(spark, T.lesson_tokens(F.col("h")), h="Use form.item, a b2!") == ["use", "form.item", "b2"]
    assert one(spark, T.title_matches(F.col("h"), lit("Thinking in Systems"), lit("Meadows")), h="Systems thinking by Meadows") is True
    assert one(spark, T.title_matches(F.col("h"), lit("Thinking in Systems"), lit("Nobody")), h="Systems thinking by Meadows") is False
    assert one(spark, T.title_matches(F.col("h"), lit("")), h="anything") is True


def book(opf, **files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<rootfile full-path="OEBPS/content.opf"/>')
        z.writestr("OEBPS/content.opf", opf)
        for name, text in files.items():
            z.writestr("OEBPS/" + name.replace("_", "."), text)
    return bytearray(out.getvalue())


OPF3 = """<package><metadata><dc:title>My &amp; Book</dc:title><dc:creator>A. Writer</dc:creator></metadata><manifest>
<item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/><item id="c1" href="c1.xhtml" media-type="application/xhtml+xml"/>
<item id="c2" href="c2.xhtml" media-type="application/xhtml+xml"/><item id="img" href="pics/cover.png" media-type="image/png" properties="cover-image"/></manifest>
<spine><itemref idref="c1"/><itemref idref="c2"/><itemref idref="gone"/></spine></package>"""
NAV = '<nav epub:type="toc"><ol><li><a href="c1.xhtml">One</a></li><li><a href="c2.xhtml#two">Two</a></li><li><a href="c2.xhtml#mid">Middle</a></li></ol></nav>'
C2 = '<html><body><p>before</p><p id="two">second text</p><p id="mid">middle text</p></body></html>'
OPF2 = OPF3.replace(' properties="nav"', "").replace('id="nav" href="nav.xhtml" media-type="application/xhtml+xml"', 'id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"')
NCX = '<navMap><navPoint><navLabel><text>Uno</text></navLabel><content src="c1.xhtml"/></navPoint></navMap>'


def test_epub(spark):
    three = book(OPF3, nav_xhtml=NAV, c1_xhtml="<html><body><h1>One</h1><p>first text</p></body></html>", c2_xhtml=C2)
    two = book(OPF2, toc_ncx=NCX, c1_xhtml="<p>uno</p>", c2_xhtml="<p>dos</p>")
    books = spark.createDataFrame([("three", three), ("two", two), ("none", bytearray(b"no zip"))], "path string, content binary")
    rows = {}
    for r in epub.chapters(books).orderBy("path", "n").collect():
        rows.setdefault(r.path, []).append((r.title, r.text))
    assert rows["three"] == [("One", "One\n\nfirst text"), (None, "before"), ("Two", "second text"), ("Middle", "middle text")]
    assert rows["two"] == [("Uno", "uno"), (None, "dos")] and "none" not in rows
    found = epub.members(books)
    packages = epub.package(found)
    assert epub.metadata(packages).where("path = 'three'").first().title == "My & Book"
    assert epub.cover(packages, epub.manifest(packages)).where("path = 'three'").first().file == "OEBPS/pics/cover.png"
    assert epub.extracted(books).where("path = 'three'").first().chapters == 3


def test_readers(spark):
    given = spark.createDataFrame([("a/x.TXT", bytearray(b"hello there")), ("a/y.html", bytearray(b"<p>hi &eacute;</p>")), ("a/z.rtf", bytearray(b"")), ("a/p.pdf", bytearray(b""))], "path string, content binary")
    read, rejects = readers.texts(given)
    assert {r.path: (r.text, r.words, r.note) for r in read.collect()} == {"a/x.TXT": ("hello there", 2, "sparse"), "a/y.html": ("hi é", 2, "sparse")}
    assert {r.path: r.reason for r in rejects.collect()} == {"a/z.rtf": "unsupported input", "a/p.pdf": "needs a converter"}
    works = spark.createDataFrame([("w", [("k1", None), ("k2", None), (None, "Plain"), (None, "")])], "work_id string, authors array<struct<key:string,name:string>>")
    assert readers.with_authors(works, spark.createDataFrame([("k1", "Ann")], "key string, name string")).first().authors == ["Ann", "k2", "Plain"]
    records = spark.createDataFrame([("w", "", "May 2001", ["p"] * 7, ["s"] * 20, ["i1"])], "work_id string, title string, publish_date string, publishers array<string>, subjects array<string>, isbns array<string>")
    r = readers.book_metadata(records).first()
    assert (r.title, r.year, len(r.publishers), len(r.subjects), r.isbn) == (None, 2001, 5, 12, "i1")
    a, b = spark.createDataFrame([("x", "first")], "work_id string, title string"), spark.createDataFrame([("x", "second"), ("y", "only")], "work_id string, title string")
    assert {r.work_id: r.title for r in readers.first_found(a, b).collect()} == {"x": "first", "y": "only"}


def test_sinks(spark, tmp_path):
    index = spark.createDataFrame([(1, 1, "000-a.txt", "A", "one", 1), (1, 2, "001-b.txt", None, "two", 1), (2, 1, "000-c.txt", "C", "three", 1)], "doc long, n long, file string, title string, body string, words long")
    sinks.write_chunks(index, str(tmp_path / "chunks"), "doc")
    sinks.write_chunks(index.where("doc = 2"), str(tmp_path / "chunks"), "doc")
    assert spark.read.text(str(tmp_path / "chunks")).count() == 3
    sinks.write_index(index, str(tmp_path / "index"))
    assert spark.read.json(str(tmp_path / "index")).columns == ["doc", "file", "n", "title", "words"]
    docs = spark.createDataFrame([("vault", "a", "x"), ("drive", "a", "x")], "target string, stem string, text string")
    for _ in range(2):
        sinks.publish(docs, str(tmp_path / "out"))
    published = spark.read.parquet(str(tmp_path / "out"))
    assert published.count() == 2 and sinks.existing(spark.createDataFrame([("a",), ("b",)], "stem string"), published).collect()[0].stem == "a"
    lines = spark.createDataFrame([(0, ""), (1, "# Books"), (2, ""), (3, "- [[beta]]"), (4, "- [[Alpha]]")], "pos long, line string")
    stems = spark.createDataFrame([("beta",), ("Gamma",)], "stem string")
    got = [r.line for r in sinks.upserted_links(lines, stems).orderBy("part", "pos").collect()]
    assert got == ["# Books", "", "- [[Alpha]]", "- [[beta]]", "- [[Gamma]]"]


@pytest.mark.parametrize("path, kind", [("a.epub", "epub"), ("A.Htm", "html"), ("x.docx", "docx"), ("noext", None)])
def test_kinds(spark, path, kind):
    assert one(spark, readers.kind_of(F.col("h")), h=path) == kind
