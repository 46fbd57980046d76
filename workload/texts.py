"""Document text: cleaning, items, paragraphs, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions import text as tx
from lodestack.operators import chunks as ch
from lodestack.operators import documents as dc
from lodestack.operators.figures import figure_boxes as boxes
from lodestack.operators.figures import splice_figures as spliced
from lodestack.operators.table_functions import register_table_functions
from lodestack.plans.documents import chunk_documents, document_counts
from workload.registry import query, table

# The documents as Markdown: their whole text with a heading, a comment, bullets, both kinds of table and an image.
MARKDOWN_SQL = """SELECT doc_id, '# Doc ' || doc_id || chr(10) || '<!-- from ' || source || ' -->' || chr(10) || 'Overview:' || chr(10)
 || text || chr(10) || chr(10) || chr(10) || '- ' || lang || ' notes' || chr(10) || '- ' || source || ' notes' || chr(10) || chr(10)
 || '| key | value |' || chr(10) || '|---|---|' || chr(10) || '| chars | ' || n_chars || ' |' || chr(10)
 || '![figure](images/' || source || '/' || doc_id || '.png)' || chr(10)
 || '<table><tr><th>source</th><td>' || source || '</td></tr></table>' || chr(10) || '<p>' || lang || ' end</p>' AS text
FROM documents"""


def markdown(spark, sf_dir) -> DataFrame:
    n = F.lit("\n")
    parts = [
        F.lit("# Doc "), F.col("doc_id").cast("string"), n, F.lit("<!-- from "), F.col("source"), F.lit(" -->\nOverview:\n"),
        F.col("text"), F.lit("\n\n\n- "), F.col("lang"), F.lit(" notes\n- "), F.col("source"), F.lit(" notes\n\n"),
        F.lit("| key | value |\n|---|---|\n| chars | "), F.col("n_chars").cast("string"), F.lit(" |\n![figure](images/"),
        F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png)\n<table><tr><th>source</th><td>"),
        F.col("source"), F.lit("</td></tr></table>\n<p>"), F.col("lang"), F.lit(" end</p>"),
    ]
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(*parts).alias("text"))


CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({c},
 '<!--.*?-->', '', 'gs'), '<p>\s*</p>', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)[ \t]+$', '', 'g')"""


@query(f"SELECT page_id, {CLEAN.format(c='html')} AS cleaned FROM pages")
def clean_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.clean_markup(F.col("html")).alias("cleaned"))


@query(r"""
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INTEGER AS n_words FROM documents""")
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.count_words(F.col("text")).alias("n_words"))


@query("""
SELECT doc_id, CASE WHEN length(text) > 3000 THEN substring(text, 1, 3000) || chr(10) || '... [truncated]' ELSE text END AS text
FROM documents""")
def truncate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.truncate_text(F.col("text")).alias("text"))


@query(r"""
SELECT page_id, regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
 '<th[^>]*>', ' [Header] ', 'g'), '<td[^>]*>', ' [Cell] ', 'g'), '</t[hd]>', ' | ', 'g'), '</tr>', chr(10)), '<[^>]+>', '', 'g') AS table_text
FROM (SELECT page_id, replace(replace(replace(html, '<ul>', '<table><tr>'), '<li>', '<td class="x">'), '</li>', '</td>') AS html FROM pages)""")
def html_table_text(spark, sf_dir):
    html = F.col("html")
    for old, new in (("<ul>", "<table><tr>"), ("<li>", '<td class="x">'), ("</li>", "</td>")):
        html = F.replace(html, F.lit(old), F.lit(new))
    return table(spark, sf_dir, "pages").select("page_id", tx.html_table_text(html).alias("table_text"))


PREVIEW = r"array_to_string(list_filter(regexp_split_to_array(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '\s+'), lambda w: w <> '')[1:40], ' ')"


@query(f"""
SELECT page_id, array_to_string(list_filter(['<pai>[Table: content preserved]', {PREVIEW.format(c='url')}, {PREVIEW.format(c='html')}, '</pai>'],
 lambda p: p <> ''), ' ') AS block FROM pages""")
def table_fallback(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.table_fallback(F.col("url"), F.col("html")).alias("block"))


@query(r"""
SELECT page_id, (i - 1)::INTEGER AS chunk_order, trim(regexp_replace(bodies[i], '\s+', ' ', 'g')) AS chunk, 'p' AS original_tag_type
FROM (SELECT page_id, bodies, unnest(range(1, len(bodies) + 1)) AS i
      FROM (SELECT page_id, regexp_extract_all(html, '<p>(.*?)</p>', 1, 'is') AS bodies FROM pages))
WHERE trim(regexp_replace(bodies[i], '\s+', ' ', 'g')) <> ''""")
def extract_chunks(spark, sf_dir):
    return ch.extract_chunks(table(spark, sf_dir, "pages"), ["page_id"], "html")


STRUCTURAL = r"'^(<pai>|[#\-•·*]|[123]\.)'"
PARAGRAPHS_SQL = rf"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos
             FROM ({MARKDOWN_SQL})),
l0 AS (SELECT doc_id, pos, CASE WHEN contains(line, '<pai>') OR NOT regexp_matches(line, '(?i)^<p>(.*)</p>$') THEN line
         ELSE trim(regexp_extract(line, '(?i)^<p>(.*)</p>$', 1)) END AS line
       FROM (SELECT doc_id, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM raw) WHERE line <> ''),
f1 AS (SELECT *, lag(line) OVER w AS prev FROM l0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
g1 AS (SELECT *, sum(CASE WHEN (ends_with(prev, ':') OR regexp_matches(prev, '(?i)(Highlights|Overview|Summary)\s*$'))
         AND NOT regexp_matches(line, {STRUCTURAL}) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM f1),
l1 AS (SELECT doc_id, g AS pos, string_agg(line, ' ' ORDER BY pos) AS line FROM g1 GROUP BY doc_id, g),
f2 AS (SELECT *, lag(line) OVER w AS prev FROM l1 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
g2 AS (SELECT *, sum(CASE WHEN prev IS NOT NULL AND NOT regexp_matches(line, {STRUCTURAL}) AND NOT regexp_matches(prev, {STRUCTURAL})
         AND NOT regexp_matches(prev, '[.!?;]\s*$') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM f2),
l2 AS (SELECT doc_id, g AS pos, string_agg(line, ' ' ORDER BY pos) AS line FROM g2 GROUP BY doc_id, g),
f3 AS (SELECT *, lag(line) OVER w AS prev FROM l2 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
g3 AS (SELECT *, sum(CASE WHEN prev IS NOT NULL AND length(line) < 40 AND NOT regexp_matches(line, {STRUCTURAL})
         AND NOT starts_with(prev, '<pai>') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM f3)
SELECT doc_id, (g - 1)::INTEGER AS line_no, string_agg(line, ' ' ORDER BY pos) AS line FROM g3 GROUP BY doc_id, g"""


@query(PARAGRAPHS_SQL)
def normalize_paragraphs(spark, sf_dir):
    lines = dc.normalize_paragraphs(markdown(spark, sf_dir))
    return lines.select("doc_id", F.posexplode("lines").alias("line_no", "line"))


# Each document opens with the logo of its language, ends with the same logo spelt otherwise, and one of its source.
@query("""
WITH d AS (SELECT doc_id, ['<pai>[Logo: ' || lang || '] ' || n_chars || '</pai>'] || string_split(text, chr(10))
  || ['<pai>[Logo: ' || source || '] end</pai>'] AS lines FROM documents)
SELECT doc_id, (i - 1)::INTEGER AS line_no, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)""")
def dedupe_logos(spark, sf_dir):
    first = F.concat(F.lit("<pai>[Logo: "), "lang", F.lit("] "), F.col("n_chars").cast("string"), F.lit("</pai>"))
    again = F.concat(F.lit("<pai> [LOGO:  "), F.upper("lang"), F.lit(" ] again</pai>"))
    other = F.concat(F.lit("<pai>[Logo: "), "source", F.lit("] end</pai>"))
    lines = F.concat(F.array(first), F.split("text", "\n"), F.array(again, other))
    kept = dc.dedupe_logos(table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines")))
    return kept.select("doc_id", F.posexplode("lines").alias("line_no", "line"))


@query(f"""
SELECT doc_id, 3::BIGINT AS total_items, 1::BIGINT AS images_count, 2::BIGINT AS tables_count FROM documents""")
def document_counts_by_doc(spark, sf_dir):
    return document_counts(dc.find_items(markdown(spark, sf_dir)))


def _items(spark, sf_dir) -> DataFrame:
    docs = markdown(spark, sf_dir)
    return dc.find_items(docs.withColumn("text", tx.clean_markup(F.col("text"))))


ITEM_PARTS_SQL = rf"""
WITH m AS (SELECT doc_id, {CLEAN.format(c='text')} AS text FROM ({MARKDOWN_SQL})),
d AS (SELECT m.doc_id, m.text, source, n_chars, lang,
  '| key | value |' || chr(10) || '|---|---|' || chr(10) || '| chars | ' || n_chars || ' |' || chr(10) AS pipe,
  '![figure](images/' || source || '/' || m.doc_id || '.png)' AS image,
  '<table><tr><th>source</th><td>' || source || '</td></tr></table>' AS html FROM m JOIN documents USING (doc_id))"""
ITEMS_SQL = ITEM_PARTS_SQL + """,
i AS (
 SELECT doc_id, text, 'image' AS item_type, doc_id || '.png' AS identifier, doc_id || '.png' AS content, image AS original_match, 0 AS height FROM d
 UNION ALL SELECT doc_id, text, 'table', 'table-2', pipe, pipe, 3 FROM d
 UNION ALL SELECT doc_id, text, 'table', 'table-html-3', ' [Header] source |  [Cell] ' || source || ' | ' || chr(10), html, 0 FROM d),
p AS (SELECT *, instr(text, original_match) - 1 AS start_pos, string_split(text, chr(10)) AS lines FROM i),
q AS (SELECT *, length(substring(text, 1, start_pos)) - length(replace(substring(text, 1, start_pos), chr(10), '')) AS line FROM p)
SELECT doc_id, item_type, identifier, content, start_pos::INTEGER AS start_pos, (start_pos + length(original_match))::INTEGER AS end_pos,
  line::INTEGER AS line_number, array_to_string(lines[greatest(line - 4, 1):line], chr(10)) AS before,
  array_to_string(lines[line + height + 2:line + height + 6], chr(10)) AS after FROM q"""


@query(ITEMS_SQL)
def find_items(spark, sf_dir):
    return _items(spark, sf_dir).select(
        "doc_id", "item_type", "identifier", "content", "start_pos", "end_pos", "line_number",
        F.array_join("context_before", "\n").alias("before"), F.array_join("context_after", "\n").alias("after"),
    )


@query(f"SELECT * EXCLUDE (content) FROM ({ITEMS_SQL})")
def items_in_sql(spark, sf_dir):
    register_table_functions(spark)
    docs = markdown(spark, sf_dir).withColumn("text", tx.clean_markup(F.col("text")))
    return spark.sql(
        """SELECT doc_id, CASE kind WHEN 'image' THEN 'image' ELSE 'table' END AS item_type,
 CASE kind WHEN 'image' THEN doc_id || '.png' WHEN 'pipe' THEN 'table-' || number ELSE 'table-html-' || number END AS identifier,
 start_pos, end_pos, line_number, array_join(before, '\\n') AS before, array_join(after, '\\n') AS after
FROM {docs}, LATERAL text_items(text)""",
        docs=docs,
    )


@query(f"""
SELECT doc_id, identifier, 'Context:' || chr(10) || before || chr(10) || CASE item_type WHEN 'image' THEN '[IMAGE HERE]' ELSE '[TABLE HERE]' END
  || CASE WHEN after = '' AND n_after = 0 THEN '' ELSE chr(10) || after END || chr(10) || chr(10)
  || CASE item_type WHEN 'image' THEN 'Image reference: ' ELSE 'Table content:' || chr(10) END || content || chr(10) || chr(10) || 'Keep all numbers.' AS prompt
FROM (SELECT *, 1 AS n_after FROM ({ITEMS_SQL}))""")
def item_prompts(spark, sf_dir):
    prompt = dc.item_prompt(
        *[F.col(c) for c in ("item_type", "identifier", "content", "context_before", "context_after")], F.lit("Keep all numbers.")
    )
    return _items(spark, sf_dir).select("doc_id", "identifier", prompt.alias("prompt"))


@query(f"""
SELECT doc_id, identifier, CASE WHEN item_type = 'image' AND length(before) > 300 THEN '<pai>[Image: ' || identifier || ']</pai>'
  WHEN item_type = 'image' AND lang = 'en' THEN '<pai>[Logo: ' || source || '] ' || n_chars || ' characters</pai>'
  WHEN item_type = 'image' THEN '<pai>' || n_chars || ' characters Key elements: ' || lang || ', ' || source || '</pai>'
  WHEN identifier = 'table-2' THEN '<pai>[Table: ' || source || '] counts ' || n_chars || ' in all Key data points: ' || n_chars || '</pai>'
  ELSE '<pai>[Table] names ' || source || '</pai>' END AS replacement
FROM ({ITEMS_SQL}) JOIN documents USING (doc_id)""")
def render_items(spark, sf_dir):
    found = _items(spark, sf_dir).join(table(spark, sf_dir, "documents").drop("text"), "doc_id")
    chars = F.col("n_chars").cast("string")
    none = F.array().cast("array<string>")
    image = F.struct(
        (F.col("lang") == "en").alias("is_logo"),
        F.col("source").alias("logo_of"),
        F.concat(chars, F.lit(" characters")).alias("description"),
        F.array("lang", "source").alias("key_elements"),
    )
    pipe = F.col("identifier") == "table-2"
    grid = F.struct(
        F.when(pipe, F.col("source")).alias("title"),
        F.when(pipe, "counts").otherwise("names").alias("purpose"),
        F.when(pipe, F.concat(chars, F.lit(" in all"))).otherwise(F.col("source")).alias("summary"),
        F.when(pipe, F.array(chars)).otherwise(none).alias("key_data"),
    )
    near = F.length(F.array_join("context_before", "\n")) > 300
    given = found.withColumns({"image_analysis": F.when(~near, image), "table_analysis": grid})
    return dc.render_items(given).select("doc_id", "identifier", "replacement")


@query(f"""
SELECT doc_id, replace(replace(replace(text, pipe, '<pai>table ' || n_chars || '</pai>'), image, '<pai>image ' || source || '</pai>'),
  html, '<pai>html ' || lang || '</pai>') AS text
FROM ({ITEM_PARTS_SQL} SELECT * FROM d)""")
def apply_replacements(spark, sf_dir):
    docs = markdown(spark, sf_dir).withColumn("text", tx.clean_markup(F.col("text")))
    facts = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("string").alias("n"))
    items = dc.find_items(docs).join(facts, "doc_id")
    what = (
        F.when(F.col("item_type") == "image", F.concat(F.lit("image "), "source"))
        .when(F.col("identifier") == "table-2", F.concat(F.lit("table "), "n"))
        .otherwise(F.concat(F.lit("html "), "lang"))
    )
    return dc.apply_replacements(docs, items.withColumn("replacement", F.concat(F.lit("<pai>"), what, F.lit("</pai>"))))


# The chunker line by line: one recursion step per line over all documents at once. A close takes up to three places in a step.
def _closed(source: str, when: str, force: str) -> str:
    return f"""SELECT * EXCLUDE (go, chunks, more, n_pending, body, size, nw, nc, listing),
 CASE WHEN NOT go OR len(body) = 0 THEN chunks WHEN nc < 50 AND len(chunks) > 0 AND more THEN chunks[1:len(chunks) - 1] || [chunks[len(chunks)] || body] ELSE chunks || [body] END AS chunks,
 CASE WHEN go AND len(body) > 0 THEN true ELSE more END AS more, CASE WHEN go THEN 0 ELSE n_pending END AS n_pending, CASE WHEN go THEN []::INTEGER[] ELSE body END AS body,
 CASE WHEN go THEN 0 ELSE size END AS size, CASE WHEN go THEN 0 ELSE nw END AS nw, CASE WHEN go THEN 0 ELSE nc END AS nc, NOT go AND listing AS listing
 FROM (SELECT *, n_pending > 0 AND ({when}) AND NOT (len(body) > 0 AND nc < 50 AND NOT ({force})) AS go FROM ({source}))"""


_WORDS = r"len(list_filter(regexp_split_to_array({t}, '\s+'), lambda w: w <> ''))"
_BARE = r"regexp_replace(regexp_replace(regexp_replace({t}, '^#{{1,6}}\s+', ''), '^[•·\-*+]\s+', ''), '^\d+\.\s+', '')"
FACTS_SQL = rf"""SELECT doc_id, line_no AS i, line, kind, length(b) AS sz, {_WORDS.format(t='b')} AS w, {_WORDS.format(t='bare')} AS cw, regexp_matches(line, '[.!?]$') AS ends,
 coalesce(lead(regexp_matches(line, '^(?:\p{{Lu}}|[#\-•·*])')) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS next_opens, starts_with(line, '<p>') AS wrapped,
 CASE WHEN kind = 'block' THEN line ELSE bare END AS bare
 FROM (SELECT *, {_BARE.format(t='b')} AS bare FROM (SELECT *, CASE WHEN kind = 'heading' THEN trim(regexp_replace(line, '^#+', '')) ELSE line END AS b
  FROM (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN contains(line, '<pai>') THEN 'block' WHEN starts_with(line, '#') THEN 'heading'
   WHEN regexp_matches(line, '^(?:[-•·*]|\d+\.)\s+') THEN 'bullet' ELSE 'plain' END AS kind FROM lines)))"""
_STEP = "SELECT s.*, f.* EXCLUDE (doc_id, i, line, bare), f.i AS here FROM s JOIN f ON f.doc_id = s.doc_id AND f.i = s.i + 1"
_FIRST = _closed(_STEP, "kind IN ('block', 'heading', 'end') OR (kind IN ('plain', 'bullet') AND listing <> (kind = 'bullet'))", "kind NOT IN ('block', 'heading')")
_LISTED = f"SELECT * REPLACE (CASE WHEN kind = 'bullet' THEN true ELSE listing END AS listing), kind IN ('plain', 'bullet') AND size > 0 AND size + sz <= 1000 AS fits FROM ({_FIRST})"
_SECOND = _closed(_LISTED, "kind IN ('plain', 'bullet') AND size + sz > 1000 AND size >= 300", "true")
_ADDED = f"""SELECT * REPLACE (CASE WHEN kind = 'block' THEN chunks || [[here]] ELSE chunks END AS chunks, CASE WHEN kind = 'block' THEN wrapped ELSE more END AS more,
 n_pending + joins::INTEGER AS n_pending, CASE WHEN joins AND sz > 0 THEN body || [here] ELSE body END AS body,
 CASE WHEN joins THEN size + sz ELSE size END AS size, CASE WHEN joins THEN nw + w ELSE nw END AS nw, CASE WHEN joins THEN nc + cw ELSE nc END AS nc)
 FROM (SELECT *, kind IN ('heading', 'plain', 'bullet') AS joins FROM ({_SECOND}))"""
_THIRD = _closed(_ADDED, "fits AND ends AND nw >= 50 AND next_opens", "false")
CHUNKS_SQL = rf"""
WITH RECURSIVE lines AS MATERIALIZED (@LINES), facts AS MATERIALIZED ({FACTS_SQL}),
f AS MATERIALIZED (SELECT * FROM facts UNION ALL SELECT doc_id, (max(i) + 1)::INTEGER, '', 'end', 0, 0, 0, false, false, false, '' FROM facts GROUP BY doc_id),
s AS (SELECT doc_id, (-1)::INTEGER AS i, []::INTEGER[][] AS chunks, false AS more, 0 AS n_pending, []::INTEGER[] AS body, 0::BIGINT AS size, 0::BIGINT AS nw, 0::BIGINT AS nc, false AS listing
  FROM facts GROUP BY doc_id
 UNION ALL SELECT doc_id, here, chunks, more, n_pending, body, size::BIGINT, nw::BIGINT, nc::BIGINT, listing FROM ({_THIRD})),
done AS (SELECT s.doc_id, s.chunks FROM s JOIN f ON f.doc_id = s.doc_id AND f.i = s.i AND f.kind = 'end'),
c AS (SELECT doc_id, (n - 1)::INTEGER AS chunk_no, chunks[n] AS numbers FROM (SELECT doc_id, chunks, unnest(range(1, len(chunks) + 1)) AS n FROM done)),
e AS (SELECT doc_id, chunk_no, len(numbers) AS many, k, numbers[k] AS i FROM (SELECT *, unnest(range(1, len(numbers) + 1)) AS k FROM c)),
t AS (SELECT e.doc_id, chunk_no, any_value(many) AS many, bool_or(k = 1 AND kind = 'block') AS block, any_value(CASE WHEN k = 1 THEN bare END) AS lone,
  string_agg(CASE WHEN k = 1 AND kind = 'block' THEN substring(bare, 4, length(bare) - 7) ELSE bare END, ' ' ORDER BY k) AS body
  FROM e JOIN facts USING (doc_id, i) GROUP BY ALL)
SELECT doc_id, chunk_no, CASE WHEN block AND many = 1 THEN lone ELSE '<p>' || trim(regexp_replace(body, '\s+', ' ', 'g')) || '</p>' END AS chunk FROM t"""


@query(CHUNKS_SQL.replace("@LINES", PARAGRAPHS_SQL))
def make_chunks(spark, sf_dir):
    chunked = ch.with_chunks(dc.dedupe_logos(dc.normalize_paragraphs(markdown(spark, sf_dir))))
    return chunked.select("doc_id", F.posexplode("chunks").alias("chunk_no", "chunk"))


@query("""
SELECT doc_id, text || chr(10) || '<pai>table ' || lang || '</pai>' || chr(10) || '<pai>image ' || doc_id || '.png</pai>' || chr(10) || source AS text FROM documents""")
def apply_nested_replacements(spark, sf_dir):
    """An image in an HTML table after each document's text: both blocks are there, the image's after the table's."""
    path = F.concat(F.lit("![i](p/"), F.col("doc_id").cast("string"), F.lit(".png)"))
    grid = F.concat(F.lit("<table><td>"), path, F.lit("</td><td>"), "lang", F.lit("</td></table>"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat_ws("\n", "text", grid, "source").alias("text"))
    what = F.when(F.col("item_type") == "image", F.concat(F.lit("image "), "identifier")).otherwise(F.concat(F.lit("table "), "lang"))
    # Some texts hold pipe tables of their own, which stay.
    found = dc.find_items(docs, ("doc_id", "lang")).where((F.col("item_type") == "image") | F.col("identifier").startswith("table-html"))
    blocks = found.withColumn("replacement", F.concat(F.lit("<pai>"), what, F.lit("</pai>")))
    return dc.apply_replacements(docs.drop("lang"), blocks)


_NEAR = PREVIEW.format(c="before || ' ' || after")
SPLICED_SQL = rf"""
SELECT doc_id, substring(text, 1, s2) || b2 || substring(text, e2 + 1, s1 - e2) || b1 || substring(text, e1 + 1, s3 - e1) || b3 || substring(text, e3 + 1) AS text
FROM (SELECT doc_id, {', '.join(f"max(CASE WHEN n = {n} THEN {c} END) AS {a}{n}" for n in (1, 2, 3) for c, a in (('start_pos', 's'), ('end_pos', 'e'), ('block', 'b')))}
 FROM (SELECT doc_id, start_pos, end_pos, CASE WHEN item_type = 'image' THEN 1 WHEN identifier = 'table-2' THEN 2 ELSE 3 END AS n,
  CASE WHEN item_type = 'image' THEN '<pai>[Image: ' || identifier || ']</pai>' ELSE array_to_string(list_filter(['<pai>[Table: content preserved]', {_NEAR},
   {PREVIEW.format(c='content')}, '</pai>'], lambda p: p <> ''), ' ') END AS block FROM ({ITEMS_SQL})) GROUP BY doc_id)
JOIN (SELECT doc_id, {CLEAN.format(c='text')} AS text FROM ({MARKDOWN_SQL})) USING (doc_id)"""


@query(f"""
SELECT doc_id, any_value(text) AS text, 3::INTEGER AS total_items, 1::INTEGER AS images_count, 2::INTEGER AS tables_count,
 string_agg(chunk, chr(10) || chr(10) ORDER BY chunk_no) AS processed
FROM ({CHUNKS_SQL.replace("@LINES", PARAGRAPHS_SQL.replace(MARKDOWN_SQL, SPLICED_SQL))}) JOIN ({SPLICED_SQL}) USING (doc_id) GROUP BY doc_id""")
def document_job(spark, sf_dir):
    return chunk_documents(markdown(spark, sf_dir))


# A layout analysis per document: three figures on two pages, placed by its length.
def layouts(spark, sf_dir) -> DataFrame:
    n = F.length("text").cast("double")
    box = lambda x, y: F.array(x, y, x + 2, y, x + 2, y + 1, x, y + 1)
    region = lambda page, polygon: F.array(F.struct(F.lit(page).alias("pageNumber"), polygon.alias("polygon")))
    span = lambda start, length: F.array(F.struct(start.cast("int").alias("offset"), F.lit(length).alias("length")))
    figure = lambda name, page, polygon, spans: F.struct(
        F.lit(name).cast("string").alias("id"), region(page, polygon).alias("boundingRegions"), spans.alias("spans")
    )
    page = lambda unit: F.struct(F.lit(unit).alias("unit"), F.lit(850.0).alias("width"), F.lit(1100.0).alias("height"))
    point = F.struct(F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    figures = F.array(
        figure("chart", 1, box(n / 100, n / 200), span(F.lit(0), 5)),
        figure(None, 2, box(n / 10, n / 20), span(F.floor(n / 2) + 5, 3)),
        figure("lost", 3, box(n, n), span(F.lit(9), 4)),
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("file_hash"),
        F.struct(F.col("text").alias("content"), figures.alias("figures"), F.array(page("inch"), page("pixel")).alias("pages")).alias("analysis"),
        F.array(point, point).alias("page_points"),
    )


@query("""
WITH d AS (SELECT *, length(text) AS n FROM documents)
SELECT doc_id, 0 AS figure_no, 'chart' AS figure_id, 1 AS page, round(n / 100 * 72, 6) AS x0, round(n / 200 * 72, 6) AS y0,
  round((n / 100 + 2) * 72, 6) AS x1, round((n / 200 + 1) * 72, 6) AS y1 FROM d
UNION ALL SELECT doc_id, 1, 'figure-2', 2, round(n / 10 * (612 / 850), 6), round(n / 20 * (792 / 1100), 6),
  round((n / 10 + 2) * (612 / 850), 6), round((n / 20 + 1) * (792 / 1100), 6) FROM d""")
def figure_boxes(spark, sf_dir):
    found = boxes(layouts(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("x0", "y0", "x1", "y1")})


@query("""
SELECT doc_id, CASE WHEN n < 5 THEN text ELSE chr(10) || '![chart](images/' || source || '/chart.png)' || chr(10)
  || CASE WHEN h + 3 > n THEN substring(text, 6) ELSE substring(text, 6, h - 5) || chr(10)
  || '![figure-2](images/' || source || '/figure-2.png)' || chr(10) || substring(text, h + 4) END END AS text
FROM (SELECT *, length(text) AS n, length(text) // 2 + 5 AS h FROM documents)""")
def splice_figures(spark, sf_dir):
    return spliced(layouts(spark, sf_dir))
