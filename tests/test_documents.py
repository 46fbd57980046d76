"""Document operators against results worked out by hand."""

from pyspark.sql import functions as F

from lodestack.functions.text import BLANK, BLANKS, clean_markup, render_image, render_table, strip, truncate_text
from lodestack.operators.chunks import extract_chunks, with_chunks
from lodestack.operators.documents import (
    apply_replacements,
    dedupe_logos,
    find_items,
    normalize_paragraphs,
    splice_fallbacks,
    with_items,
)
from lodestack.operators.embed import embed
from lodestack.operators.figures import figure_boxes, splice_figures
from lodestack.operators.table_functions import register_table_functions
from lodestack.plans.documents import chunk_documents, ingest_chunks


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def lines_of(spark, text):
    return normalize_paragraphs(docs(spark, text)).first().lines


def chunks_of(spark, *lines):
    df = spark.createDataFrame([(0, list(lines))], "doc_id bigint, lines array<string>")
    return with_chunks(df).first().chunks


def words(n, word="w"):
    return " ".join([word] * n)


def test_strip_takes_all_blanks_and_nothing_else(spark):
    points = [p for p in range(1, 0x3100) if not 0xD800 <= p < 0xE000]
    rows = spark.createDataFrame([(p, chr(p) * 2 + "a" + chr(p) + "b" + chr(p)) for p in points], "point int, text string")
    blank = F.col("text").rlike(rf"(?U)^{BLANK}{{2}}a")
    bare = F.when(blank, F.substring("text", 3, 3)).otherwise(F.col("text"))
    assert rows.where(strip(F.col("text")) != bare).isEmpty()
    assert rows.where(blank).count() == len(BLANKS) == len(set(BLANKS))
    odd = spark.createDataFrame([("",), (" \n\u3000",), (None,), ("\u2028é\u2028",)], "text string")
    assert [r[0] for r in odd.select(strip(F.col("text"))).collect()] == ["", "", None, "é"]


def test_clean_markup(spark):
    text = "a <!-- x\ny --> b  \n\n\n\n<p>  </p>c\t\nd"
    assert docs(spark, text).select(clean_markup(F.col("text"))).first()[0] == "a  b\n\nc\nd"


def test_truncate_keeps_the_limit(spark):
    row = docs(spark, "x" * 3000, "x" * 3001).select(truncate_text(F.col("text")).alias("t")).collect()
    assert row[0].t == "x" * 3000
    assert row[1].t == "x" * 3000 + "\n... [truncated]"


def test_paragraph_passes(spark):
    long = "This line is long enough to stand alone here."
    assert lines_of(spark, f"Intro:\nfirst\n{long}") == [f"Intro: first {long}"]
    assert lines_of(spark, f"Company Overview\n{long}") == [f"Company Overview {long}"]
    # A structural line is never pulled up, nor does it take the line after it unless that one is short.
    assert lines_of(spark, f"Intro:\n- item\n{long}") == ["Intro:", "- item", long]
    assert lines_of(spark, f"# Head\nshort.\n{long}") == ["# Head short.", long]
    # Sentences that end are kept apart, fragments shorter than 40 characters go up, but not into a block.
    assert lines_of(spark, f"{long}\n{long}\nshort") == [long, f"{long} short"]
    assert lines_of(spark, f"<pai>block</pai>\nshort.\n{long}") == ["<pai>block</pai>", "short.", long]
    # Four is no list number for merging.
    assert lines_of(spark, "one\n4. two\n3. three") == ["one 4. two", "3. three"]
    assert lines_of(spark, "  <P> a b </P>  \n\n\n<p>x <pai>y</pai></p>") == ["a b <p>x <pai>y</pai></p>"]
    assert lines_of(spark, "x" * 40 + ".\n" + "y" * 40 + "\n") == ["x" * 40 + ".", "y" * 40]
    assert lines_of(spark, "x" * 40 + ".\n" + "y" * 39) == ["x" * 40 + ". " + "y" * 39]


def test_dedupe_logos(spark):
    lines = ["<pai>[Logo: Acme] a</pai>", "text", " <pai> [LOGO:  acme ] b</pai>", "<pai>[Logo: Other]</pai>", "text"]
    df = spark.createDataFrame([(0, lines)], "doc_id bigint, lines array<string>")
    assert dedupe_logos(df).first().lines == [lines[0], "text", lines[3], "text"]


def test_items_in_order_with_scan_numbers(spark):
    text = "l0\n![a](x/y.png)\nl2\n<TABLE><th>H</th></tr></TABLE>\n|a|b|\n|--|--|\n|1|2|\nl7\n![](z/)"
    rows = find_items(docs(spark, text)).collect()
    assert [(r.item_type, r.identifier, r.line_number) for r in rows] == [
        ("image", "y.png", 1),
        ("table", "table-html-4", 3),
        ("table", "table-3", 4),
        ("image", "z", 8),
    ]
    assert rows[1].content == " [Header] H | \n"
    assert rows[2].context_before == ["l0", "![a](x/y.png)", "l2", "<TABLE><th>H</th></tr></TABLE>"]
    assert rows[2].context_after == ["![](z/)"]
    assert all(text[r.start_pos : r.end_pos] == r.original_match for r in rows)


def test_image_inside_a_table(spark):
    text = "<table><td>![i](p/i.png)</td></table> end"
    plain = chunk_documents(docs(spark, text)).first()
    assert plain.total_items == 2 and plain.processed.count("[Image: i.png]") == 1
    strict = chunk_documents(docs(spark, text), strict=True).first()
    assert strict.processed != plain.processed


def test_items_that_overlap_are_all_replaced(spark):
    text = "a <table>|x|\n![i](p/i.png) ![j](p/j.png)</table> b ![k](k.png)"
    items = find_items(docs(spark, text))
    marks = items.withColumn("replacement", F.concat(F.lit("{"), "identifier", F.lit("}")))
    got = apply_replacements(docs(spark, text), marks).first().text
    assert got == "a {table-html-4}\n{i.png}\n{j.png} b {k.png}"
    inner = apply_replacements(docs(spark, text), marks.where("inner")).first().text
    assert inner == "a <table>|x|\n{i.png} {j.png}</table> b ![k](k.png)"
    # A pipe table that begins in an HTML table and ends after it: the stretch reaches to the later end.
    text = "<table>\n|a|b|\n|c|d|</table>|\nend"
    marks = find_items(docs(spark, text)).withColumn("replacement", F.col("identifier"))
    assert [r.inner for r in marks.collect()] == [False, True]
    assert apply_replacements(docs(spark, text), marks).first().text == "table-html-2\ntable-1end"


def test_documents_without_items_or_text_keep_it(spark):
    frame = spark.createDataFrame([(0, ""), (1, None), (2, "plain")], "doc_id bigint, text string")
    marks = find_items(frame).withColumn("replacement", F.col("identifier"))
    assert {r.doc_id: r.text for r in apply_replacements(frame, marks).collect()} == {0: "", 1: None, 2: "plain"}
    assert {r.doc_id: r.text for r in splice_fallbacks(with_items(frame)).collect()} == {0: "", 1: None, 2: "plain"}


def test_rendered_blocks(spark):
    image = "struct<is_logo:boolean,logo_of:string,description:string,key_elements:array<string>>"
    rows = spark.createDataFrame(
        [("a", (True, "Acme", "d", [])), ("b", (False, None, "d", ["x", "y"])), ("c", None)], f"id string, a {image}"
    )
    assert [r[0] for r in rows.select(render_image(F.col("id"), F.col("a"))).collect()] == [
        "<pai>[Logo: Acme] d</pai>",
        "<pai>d Key elements: x, y</pai>",
        "<pai>[Image: c]</pai>",
    ]
    table = "struct<title:string,purpose:string,summary:string,key_data:array<string>>"
    rows = spark.createDataFrame([(("T", "p", "s", ["1"]),), (("", "p", "s", []),), (None,)], f"a {table}")
    assert [r[0] for r in rows.select(render_table(F.col("a"), F.lit("fallback"))).collect()] == [
        "<pai>[Table: T] p s Key data points: 1</pai>",
        "<pai>[Table] p s</pai>",
        "fallback",
    ]


def test_short_text_is_one_chunk(spark):
    assert chunks_of(spark, "# Title", "a b.", "c") == ["<p>Title a b. c</p>"]


def test_pending_text_lands_after_a_block(spark):
    assert chunks_of(spark, "a b c", "<pai>x</pai>", "d") == ["<pai>x</pai>", "<p>a b c d</p>"]
    # Fifty words are enough to be flushed before it.
    assert chunks_of(spark, words(50), "<pai>x</pai>", "d") == [f"<p>{words(50)}</p>", "<pai>x</pai>", "<p>d</p>"]


def test_short_rest_joins_the_last_paragraph_chunk(spark):
    big = words(60) + "."
    assert chunks_of(spark, "Start here.", big, "Next one.") == [f"<p>Start here. {big} Next one.</p>"]
    assert chunks_of(spark, words(50), "<p>q <pai>x</pai></p>", "- d") == [
        f"<p>{words(50)}</p>",
        "<p>q <pai>x</pai> d</p>",
    ]


def test_bullets_split_from_text(spark):
    assert chunks_of(spark, words(60), "- " + words(60, "b"), "1. " + words(60, "n"), words(60)) == [
        f"<p>{words(60)}</p>",
        f"<p>{words(60, 'b')} {words(60, 'n')}</p>",
        f"<p>{words(60)}</p>",
    ]


def test_oversize_needs_a_minimum(spark):
    a, b = "a" * 299, "b" * 900
    assert chunks_of(spark, a, b) == [f"<p>{a} {b}</p>"]
    a = words(150, "a")  # 299 characters and one more make the minimum
    assert chunks_of(spark, a + "a", words(500, "b")) == [f"<p>{a}a</p>", f"<p>{words(500, 'b')}</p>"]


def test_chunks_lose_no_words(spark):
    parts = [f"{words(i % 70 + 1, f'w{i}')}{'.' if i % 3 else ''}" for i in range(60)]
    marked = [("# " if i % 11 == 0 else "- " if i % 5 == 0 else "") + p for i, p in enumerate(parts)]
    text = " ".join(c[3:-4] for c in chunks_of(spark, *marked))
    assert sorted(text.split()) == sorted(" ".join(parts).split())


def test_extract_chunks_keeps_gaps(spark):
    text = "<p>a\n b</p><P> </P><pai>x</PAI><p>open<pai>no</p></pai>"
    rows = extract_chunks(docs(spark, text)).orderBy("chunk_order").collect()
    assert [(r.chunk_order, r.chunk, r.original_tag_type) for r in rows] == [
        (0, "a b", "p"),
        (2, "x", "pai"),
        (3, "open<pai>no", "p"),
    ]


def test_figures(spark):
    region = "array<struct<pageNumber:int,polygon:array<double>>>"
    schema = (
        f"doc_id bigint, file_hash string, analysis struct<content:string,figures:array<struct<id:string,boundingRegions:{region},"
        "spans:array<struct<offset:int,length:int>>>>,pages:array<struct<unit:string,width:double,height:double>>>"
    )
    box = [1.0, 2.0, 3.0, 2.0, 3.0, 4.0, 1.0, 4.0]
    figures = [
        ("f", [(1, box)], [(2, 3)]),
        (None, [(0, box)], [(7, 1), (8, 5)]),
        ("no-region", [], [(0, 1)]),
        ("bad-page", [(9, box)], [(0, 1)]),
        ("thin", [(1, box[:6])], [(0, 1)]),
    ]
    df = spark.createDataFrame([(1, "h", ("0123456789", figures, [("inch", 8.5, 11.0)]))], schema)
    rows = figure_boxes(df).orderBy("figure_no").collect()
    assert [(r.figure_id, r.x0, r.y1) for r in rows] == [("f", 72.0, 288.0), ("figure-2", 72.0, 288.0)]
    assert splice_figures(df).first().text == "01\n![f](images/h/f.png)\n56\n![figure-2](images/h/figure-2.png)\n89"


def test_table_function_of_odd_texts(spark):
    register_table_functions(spark)
    long = "a\n" * 50_000 + "![x](p/q.png)"
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "no items"), (4, "a\n![x](y.png)\nb"), (4, "![x](y.png)"), (5, long)], "id bigint, text string")
    got = spark.sql("SELECT id, kind, number, line_number, original_match, before, after FROM {docs}, LATERAL text_items(text)", docs=docs).collect()
    rows = sorted((r.id, r.line_number, r.original_match, tuple(r.before), tuple(r.after)) for r in got)
    assert rows == [(4, 0, "![x](y.png)", (), ()), (4, 1, "![x](y.png)", ("a",), ("b",)), (5, 50_000, "![x](p/q.png)", ("a",) * 5, ())]
    assert all(r.kind == "image" and r.number == 1 for r in got)
    assert spark.sql("SELECT * FROM {docs}, LATERAL text_items(text)", docs=docs.limit(0)).count() == 0


def test_chunks_are_embedded_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def letters(texts):
        seen.add(len(texts))
        return [[float(t.count("a")), float(t.count("b"))] for t in texts]

    pages = spark.createDataFrame([(f"h{i}", "<p>" + "a" * i + "</p> <p> </p><p>b</p>") for i in range(1, 4)], "file_hash string, processed string")
    points = spark.createDataFrame([("old", [0.0, 2.0])], "chunk_id string, vector array<double>")
    mappings = spark.createDataFrame([], "input_file_hash string, chunk_order int, chunk string, chunk_id string, original_tag_type string")
    done = ingest_chunks(pages, points, mappings, lambda df: embed(df, letters).withColumn("vector", F.col("vector").cast("array<double>")), 2)
    assert done.records.where("reused").count() == 3 and done.points.count() == 4
    assert sorted((r.chunk_order, r.chunk) for r in done.mappings.collect()) == [(0, "a"), (0, "aa"), (0, "aaa"), (2, "b"), (2, "b"), (2, "b")]
    assert seen.value == 6


def test_extracted_bodies_of_mixed_tags(spark):
    text = "<P>é\n \U0001f600</p><PaI> x <p>y</p> </pAi><p>z</pai></p><p></p>"
    rows = extract_chunks(docs(spark, text)).orderBy("chunk_order").collect()
    assert [(r.chunk_order, r.chunk, r.original_tag_type) for r in rows] == [(0, "é \U0001f600", "p"), (1, "x <p>y</p>", "pai"), (2, "z</pai>", "p")]
