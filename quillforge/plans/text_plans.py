"""Queries over texts: lengths, splitting, chunkers, markdown, markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunkers, markdown, toc
from . import sqltext as S
from .tables import table


def pack_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkers.pack_pieces(table(spark, sf_dir, "documents"), "\n", 50)


def pack_lines_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkers.pack_pieces(table(spark, sf_dir, "documents"), "\n", 50, 15)


def _pack_oracle(overlap: int) -> str:
    lines = S.LINES.format(n=S.words("piece"))
    return f"WITH RECURSIVE {S.pack(lines, 50, overlap, 'chr(10)')} SELECT k AS doc_id, CAST(row_number() OVER (PARTITION BY k ORDER BY st, en) - 1 AS BIGINT) AS pos, {S.words('content')} AS size, content FROM chunks"


def word_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.word_len(F.col("text")).alias("n_words"), T.char_len(F.col("text")).alias("n_characters"))


def page_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.word_len(F.col("html")).alias("n_words"), T.char_len(F.col("html")).alias("n_characters"))


def _split_query(keep: str | None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.split_keep(F.col("text"), ".", keep)).alias("pos", "piece"))
        return own.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "piece")

    return query


def _split_oracle(keep: str | None) -> str:
    piece = {"start": "CASE WHEN r > 1 THEN '.' || x ELSE x END", "end": "CASE WHEN r < n THEN x || '.' ELSE x END", None: "x"}[keep]
    return f"""WITH s AS (SELECT doc_id, unnest(string_split(text, '.')) AS x, generate_subscripts(string_split(text, '.'), 1) AS r, len(string_split(text, '.')) AS n FROM documents),
    t AS (SELECT doc_id, r, {piece} AS piece FROM s) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS BIGINT) AS pos, piece FROM t WHERE piece <> ''"""


def default_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    seps = T.default_separators(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(seps).cast("bigint").alias("n_separators"), F.array_join(seps, "|").alias("separators"))


_DEFAULT_SEPARATORS = f"""WITH m AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '\\s+')) AS runs FROM documents WHERE text IS NOT NULL),
 r AS (SELECT doc_id, unnest(runs) AS s FROM m),
 o AS (SELECT doc_id, string_agg(s, '|' ORDER BY length(s) DESC, s) AS t, count(*) AS n FROM r GROUP BY doc_id)
 SELECT m.doc_id, CAST(coalesce(n, 0) + {len(T.MARKS) + 1} AS BIGINT) AS n_separators, coalesce(t || '|', '') || '{"|".join(T.MARKS).replace("'", "''")}|' AS separators FROM m LEFT JOIN o USING (doc_id)"""


def chunk_one_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkers.chunk_by_characters(table(spark, sf_dir, "documents"), 50, 0, ["\n"])


def chunk_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkers.chunk_by_characters(table(spark, sf_dir, "documents"), 50, 10, ["\n", " "])


def _kept(text: str, sep: str, source: str, carry: str) -> str:
    """Pieces with the separator at their start, in order: (carry, r, x)."""
    return f"SELECT {carry}, r, CASE WHEN r > 1 THEN {sep} || x ELSE x END AS x FROM (SELECT {carry}, unnest(string_split({text}, {sep})) AS x, generate_subscripts(string_split({text}, {sep}), 1) AS r FROM {source}) WHERE r > 1 OR x <> ''"


_RUNS = f"""lines AS ({_kept("text", "chr(10)", "documents", "doc_id, text")}),
 sized AS (SELECT doc_id, r, x, {S.words("x")} AS n FROM lines),
 flagged AS (SELECT *, n >= 50 AS big, CASE WHEN n >= 50 OR lag(n) OVER (PARTITION BY doc_id ORDER BY r) >= 50 OR r = 1 THEN 1 ELSE 0 END AS fresh FROM sized),
 runs AS (SELECT doc_id, r, x, n, big, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY r) AS BIGINT) AS run FROM flagged)"""
_CHUNK_TAIL = f"""numbered AS (SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY run, st, en) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS m FROM everything)
 SELECT doc_id, CAST(pos AS BIGINT) AS pos, {S.words("c")} AS size, c AS content FROM (SELECT n.doc_id, pos, CASE WHEN m = 1 THEN d.text ELSE content END AS c FROM numbered n JOIN documents d USING (doc_id))
 UNION ALL SELECT doc_id, 0, 0, '' FROM documents WHERE text = ''"""
_GOOD = "SELECT doc_id * 1000000 + run AS k, CAST(row_number() OVER (PARTITION BY doc_id, run ORDER BY r) - 1 AS BIGINT) AS i, x AS piece, n FROM runs WHERE NOT big"
_ONE = f"""WITH RECURSIVE {_RUNS}, {S.pack(_GOOD, 50, 0, "''")},
 everything AS (SELECT k // 1000000 AS doc_id, k % 1000000 AS run, st, en, content FROM chunks UNION ALL SELECT doc_id, run, 0, 1, x FROM runs WHERE big), {_CHUNK_TAIL}"""
_WORDS = f"SELECT doc_id * 1000000 + run AS k, CAST(row_number() OVER (PARTITION BY doc_id, run ORDER BY r) - 1 AS BIGINT) AS i, x AS piece, {S.words('x')} AS n FROM ({_kept('t', chr(39) + ' ' + chr(39), '(SELECT doc_id, run, x AS t FROM runs WHERE big)', 'doc_id, run')})"
_TWO = f"""WITH RECURSIVE {_RUNS}, {S.pack(_GOOD + " UNION ALL " + _WORDS, 50, 10, "''")},
 everything AS (SELECT k // 1000000 AS doc_id, k % 1000000 AS run, st, en, content FROM chunks), {_CHUNK_TAIL}"""


def chunk_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event properties of each user as one JSON list, chunked at its values."""
    ev = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "props"))), lambda x: x["props"]), ",").alias("text"))
    return chunkers.chunk_json_strings(ev.select("user_id", F.concat(F.lit("["), F.col("text"), F.lit("]")).alias("text")), 20, 0, "user_id")


def lumber_llm_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkers.lumber_chunks(table(spark, sf_dir, "documents"), 256)


_JSON = f"""WITH e AS (SELECT user_id, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id, props) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
 c AS (SELECT user_id, CAST(i // 10 AS BIGINT) AS pos, string_agg(CASE WHEN i = 0 THEN '[' ELSE '' END || props || CASE WHEN i = n - 1 THEN ']' ELSE ',' END, '' ORDER BY i) AS content FROM e GROUP BY ALL)
 SELECT user_id, pos, {S.words("content")} AS size, content FROM c"""  # each value has two words, so ten fit


def lumber_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed to 32 words, numbered and grouped by windows of 256."""
    return chunkers.lumber_chunks(table(spark, sf_dir, "documents"), 256, 32, ["\n"])


_KEPT_LINES = f"SELECT doc_id AS k, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS BIGINT) AS i, x AS piece, {S.words('x')} AS n FROM ({_kept('text', 'chr(10)', 'documents', 'doc_id')})"
_LUMBER = f"""WITH RECURSIVE {S.pack(_KEPT_LINES, 32, 0, "''")},
 splits AS (SELECT k, content, row_number() OVER (PARTITION BY k ORDER BY st, en) - 1 AS i, count(*) OVER (PARTITION BY k) AS m FROM chunks),
 n AS (SELECT k, i, m, content, {S.words("'ID ' || i || ': ' || content")} AS n FROM splits),
 g AS (SELECT k, i, n AS held, 0 AS pos FROM n WHERE i = 0 UNION ALL SELECT n.k, n.i, CASE WHEN g.held >= 256 THEN n.n ELSE g.held + n.n END, CASE WHEN g.held >= 256 THEN g.pos + 1 ELSE g.pos END FROM g JOIN n ON n.k = g.k AND n.i = g.i + 1),
 o AS (SELECT k AS doc_id, CAST(pos AS BIGINT) AS pos, string_agg(content, ' ' ORDER BY i) AS content FROM g JOIN n USING (k, i) WHERE m > 1 GROUP BY ALL UNION ALL SELECT doc_id, 0, text FROM documents WHERE doc_id NOT IN (SELECT k FROM splits WHERE m > 1))
 SELECT doc_id, pos, {S.words("content")} AS size, content FROM o"""


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts split at lines that are packed again to 32 words."""
    return chunkers.split_texts(table(spark, sf_dir, "documents"), 32, ["\n"])


def flatten_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The separators that the flattener tries on each document: its runs of newlines first, the longer ones ahead, then its other runs of white space."""
    return chunkers.separators_of(table(spark, sf_dir, "documents"))


_FLATTEN_SEPARATORS = f"""WITH m AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\s+'))) AS s FROM documents),
 o AS (SELECT doc_id, string_agg(s, '|' ORDER BY trim(s, chr(10)) <> '', length(s) DESC, s) AS t FROM m GROUP BY doc_id)
 SELECT doc_id, coalesce(t || '|', '') || '{"|".join(T.MARKS).replace("'", "''")}|' AS separators FROM documents LEFT JOIN o USING (doc_id)"""


def parsed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as files: a third each as text with CR line ends, as CSV and as broken JSON; their nodes."""
    from ..sources import files

    n = table(spark, sf_dir, "nation")
    kind = F.col("n_nationkey") % 3
    end = F.when(kind == 0, "txt").when(kind == 1, "csv").otherwise("json")
    body = F.when(kind == 0, F.concat("n_name", F.lit("\r\nx\ry"))).when(kind == 1, F.concat(F.lit("id,name\n"), F.col("n_nationkey"), F.lit(","), F.col("n_name"), F.lit("\n"))).otherwise(F.concat(F.lit("{nope "), F.col("n_name")))
    path = F.concat(F.lit("/n/"), F.col("n_nationkey"), F.lit("."), end)
    own = n.select(F.col("n_nationkey").cast("string").alias("doc_id"), path.alias("path"), files.mime_column(path).alias("mimetype"), F.encode(body, "UTF-8").alias("content"))
    return files.parse_files(own).select("doc_id", "chunk_id", "parent_id", "ord", "ctype", "content", "error")


_PARSED = """WITH n AS (SELECT CAST(n_nationkey AS VARCHAR) AS d, n_nationkey % 3 AS k, n_name, n_nationkey FROM nation)
 SELECT d AS doc_id, d AS chunk_id, CAST(NULL AS VARCHAR) AS parent_id, 0 AS ord, 'root' AS ctype, CAST(NULL AS VARCHAR) AS content, CAST(NULL AS VARCHAR) AS error FROM n
 UNION ALL SELECT d, d || '/0', d, 0, 'div', CASE k WHEN 0 THEN n_name || chr(10) || 'x' || chr(10) || 'y' ELSE '{nope ' || n_name END, NULL FROM n WHERE k <> 1
 UNION ALL SELECT d, d || '/0', d, 0, 'table', '', NULL FROM n WHERE k = 1
 UNION ALL SELECT d, d || '/0.0', d || '/0', 0, 'tablerow', 'id,name', NULL FROM n WHERE k = 1
 UNION ALL SELECT d, d || '/0.1', d || '/0', 1, 'tablerow', n_nationkey || ',' || n_name, NULL FROM n WHERE k = 1"""


def cumulative_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words before each line of a document, lines numbered as a model is shown them."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    n = T.word_len(F.concat(F.lit("ID "), F.col("pos").cast("string"), F.lit(": "), F.col("line")))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.coalesce(F.sum(n).over(w), F.lit(0)).alias("words_before"))


_CUMULATIVE = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
 SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(coalesce(sum({S.words("'ID ' || pos || ': ' || line")}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS words_before FROM l"""


def root_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content ids of the documents and how many share each."""
    ids = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("root_id"))
    return ids.groupBy("root_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def underlined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as markdown whose first line, and a line of the source, are underlined."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("source"), F.lit("\n---\n"), F.regexp_replace("text", "^([^\n]*)", "$1\n==="), F.lit("\n```\na\n---\n```")).alias("text"))


def setext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.setext_to_atx(underlined(spark, sf_dir))


_SETEXT = """WITH m AS (SELECT doc_id, source || chr(10) || '---' || chr(10) || regexp_replace(text, '^([^\\n]*)', '\\1' || chr(10) || '===') || chr(10) || '```' || chr(10) || 'a' || chr(10) || '---' || chr(10) || '```' AS t FROM documents),
 l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS r FROM m),
 g AS (SELECT *, CASE WHEN starts_with(ltrim(line), '```') THEN 1 ELSE 0 END AS mark FROM l),
 h AS (SELECT *, (sum(mark) OVER (PARTITION BY doc_id ORDER BY r)) % 2 = 1 OR mark = 1 AS fenced FROM g),
 k AS (SELECT *, CASE WHEN NOT fenced AND trim(line) <> '' AND NOT lead(fenced) OVER w THEN CASE WHEN regexp_full_match(trim(lead(line) OVER w), '=+') THEN 1 WHEN regexp_full_match(trim(lead(line) OVER w), '-+') THEN 2 END END AS head FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY r)),
 o AS (SELECT *, lag(head) OVER (PARTITION BY doc_id ORDER BY r) IS NOT NULL AS gone FROM k)
 SELECT doc_id, string_agg(CASE WHEN head IS NOT NULL THEN repeat('#', head) || ' ' || line ELSE line END, chr(10) ORDER BY r) AS text FROM o WHERE NOT gone GROUP BY doc_id"""


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as markdown: an introduction, a heading of the source, and every third line a heading of level 2 or 3."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.when(i % 2 == 0, "## ").otherwise("### "), x)).otherwise(x))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("intro\n# "), F.col("source"), F.lit("\n"), F.array_join(lines, "\n")).alias("text"))


def md_heading_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.sections(headed(spark, sf_dir))


_HEADED = """d AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
 l AS (SELECT doc_id, i + 2 AS r, CASE WHEN i % 3 = 0 THEN (CASE WHEN i % 2 = 0 THEN '## ' ELSE '### ' END) || x ELSE x END AS line FROM d
   UNION ALL SELECT doc_id, 0, 'intro' FROM documents UNION ALL SELECT doc_id, 1, '# ' || source FROM documents),
 h AS (SELECT doc_id, r, line, CASE WHEN regexp_matches(line, '^#{1,6}([ \\t]|$)') THEN length(regexp_extract(line, '^(#{1,6})', 1)) END AS level FROM l),
 s AS (SELECT *, greatest(count(level) OVER (PARTITION BY doc_id ORDER BY r), 1) - 1 AS section FROM h),
 sec AS (SELECT doc_id, CAST(section AS BIGINT) AS section, CAST(max(level) AS BIGINT) AS level, max(CASE WHEN level IS NOT NULL THEN trim(line) END) AS heading, string_agg(line, chr(10) ORDER BY r) AS content FROM s GROUP BY doc_id, section)"""


def md_heading_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.level_parents(markdown.sections(headed(spark, sf_dir)).select("doc_id", "section", "level"), "doc_id", "section", "level")


def md_sections_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general splitter over the same texts; content keeps its last line end."""
    out = markdown.split_by_heading(headed(spark, sf_dir))
    return out.select("doc_id", "section", "level", "heading", F.regexp_replace("content", "\n$", "").alias("content"), "parent")


def md_combine_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that stay when sections below 30 words are combined with the next of their level."""
    return markdown.combine_sections(headed(spark, sf_dir), 30, None, rules=["combine"]).select("doc_id", "section")


def md_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a heading of level 1 and its one child of level 2, every other text before the child long enough to keep both: which headings stay."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# "), F.col("source"), F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", "\n", " ")).otherwise(""), F.lit("\n## part\n"), F.regexp_replace("text", "\n", " ")).alias("text"))
    return markdown.combine_sections(own, 40, None, rules=["collapse"])


_COMBINE = f"""WITH RECURSIVE {_HEADED}, z AS (SELECT doc_id, section, level, {S.words("content")} AS n FROM sec),
 f AS (SELECT doc_id, section, level, n AS held, true AS kept FROM z WHERE section = 0
   UNION ALL SELECT z.doc_id, z.section, CASE WHEN f.level = z.level AND f.held < 30 THEN f.level ELSE z.level END, CASE WHEN f.level = z.level AND f.held < 30 THEN f.held + z.n ELSE z.n END, NOT (f.level = z.level AND f.held < 30)
   FROM f JOIN z ON z.doc_id = f.doc_id AND z.section = f.section + 1)
 SELECT doc_id, section FROM f WHERE kept"""


def list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.range(1, 201).withColumnRenamed("id", "n")
    styles = [("Decimal", "Period"), ("LowerRoman", "OneParen"), ("UpperAlpha", "TwoParens"), ("UpperRoman", "Period"), ("LowerAlpha", "OneParen")]
    return n.select("n", *[T.list_marker(F.col("n"), s, d).alias(s.lower()) for s, d in styles])


_MARKERS = """WITH RECURSIVE v(k, v, s) AS (VALUES (1,1000,'M'),(2,900,'CM'),(3,500,'D'),(4,400,'CD'),(5,100,'C'),(6,90,'XC'),(7,50,'L'),(8,40,'XL'),(9,10,'X'),(10,9,'IX'),(11,5,'V'),(12,4,'IV'),(13,1,'I')),
 r AS (SELECT n, 0 AS k, n AS l, '' AS t FROM range(1, 201) x(n) UNION ALL SELECT r.n, r.k + 1, l % v, t || repeat(s, CAST(l // v AS INT)) FROM r JOIN v ON v.k = r.k + 1),
 a AS (SELECT n, n AS l, '' AS t FROM range(1, 201) x(n) UNION ALL SELECT n, (l - 1) // 26, chr(CAST(65 + (l - 1) % 26 AS INT)) || t FROM a WHERE l > 0)
 SELECT r.n, r.n || '. ' AS decimal, lower(r.t) || ') ' AS lowerroman, '(' || a.t || ') ' AS upperalpha, r.t || '. ' AS upperroman, lower(a.t) || ') ' AS loweralpha FROM r JOIN a ON a.n = r.n AND a.l = 0 WHERE r.k = 13"""


def fenced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Said:\n```json\n"), F.col("props"), F.lit("\n```\nend"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```\n{not json\n```"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", T.fenced_json(fenced).alias("body"))


def json_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.to_json(F.try_parse_json("props")).alias("json"))


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


def mime_by_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import mime_column

    paths = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/data/"), F.col("p_name"), F.get(F.array(*map(F.lit, [".PDF", ".md", ".ipynb", ".rst", ".html", ".csv", "", ".weird", ".jpg", ".docx"])), (F.col("p_partkey") % 10).cast("int"))).alias("path"))
    return paths.select("p_partkey", mime_column(F.col("path")).alias("mime"))


_MIME = """SELECT p_partkey, (['application/pdf','text/markdown','application/x-ipynb+json','text/x-rst','text/html','text/csv','application/octet-stream','application/octet-stream','image/jpeg','application/vnd.openxmlformats-officedocument.wordprocessingml.document'])[p_partkey % 10 + 1] AS mime FROM part"""


def hidden_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import is_hidden

    part = table(spark, sf_dir, "part")
    path = F.concat_ws("/", F.when(F.col("p_size") % 4 == 0, ".git").otherwise("src"), F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("."), F.col("p_name"))).otherwise(F.col("p_name")))
    return part.select("p_partkey", path.alias("path")).where(~is_hidden(F.col("path")))


_HIDDEN = "SELECT p_partkey, 'src/' || p_name AS path FROM part WHERE p_size % 4 <> 0 AND p_size % 7 <> 0"


def cell_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(T.number_cell(F.col("l_quantity")).alias("quantity"), T.number_cell(F.col("l_discount")).alias("discount")).agg(F.count("*").alias("n"))


_CELL = "CASE WHEN {0} IS NULL THEN '' WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
_CELLS = f"SELECT {_CELL.format('l_quantity')} AS quantity, {_CELL.format('l_discount')} AS discount, count(*) AS n FROM lineitem GROUP BY ALL"


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as rows of a CSV table, with a name that needs quotes."""
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.col("n_name"), F.lit(', "x"'))).otherwise(F.col("n_name"))
    row = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    return table(spark, sf_dir, "nation").select("n_regionkey", row.cast("bigint").alias("row_number"), T.csv_row(F.col("n_nationkey"), name).alias("content"))


_CSV = '''SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS BIGINT) AS row_number, n_nationkey || ',' || CASE WHEN n_nationkey % 2 = 0 THEN '"' || n_name || ', ""x"""' ELSE n_name END AS content FROM nation'''


def weighted_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    w, x = F.col("p_retailprice"), F.col("p_size").cast("double")
    mean = part.groupBy("p_brand").agg((F.sum(w * x) / F.sum(w)).alias("m"))
    out = part.join(mean, "p_brand").groupBy("p_brand").agg(F.sqrt(F.sum(w * (x - F.col("m")) ** 2) / F.sum(w)).alias("s"))
    return out.select("p_brand", F.round("s", 4).alias("std"), (F.col("s") > 0.15).alias("scattered"))


_STD = "WITH m AS (SELECT p_brand, sum(p_retailprice * p_size) / sum(p_retailprice) AS m FROM part GROUP BY p_brand) SELECT p_brand, round(sqrt(sum(p_retailprice * (p_size - m) * (p_size - m)) / sum(p_retailprice)), 4) AS std, sqrt(sum(p_retailprice * (p_size - m) * (p_size - m)) / sum(p_retailprice)) > 0.15 AS scattered FROM part JOIN m USING (p_brand) GROUP BY p_brand"

QUERIES = {
    "pack_lines": pack_lines, "pack_lines_overlap": pack_lines_overlap, "word_len": word_lengths, "page_len": page_lengths, "split_keep_start": _split_query("start"), "split_keep_end": _split_query("end"),
    "split_drop": _split_query(None), "default_separators": default_separators, "chunk_by_chars_one_level": chunk_one_level, "chunk_by_chars_two_level": chunk_two_levels, "chunk_json_string": chunk_json,
    "lumber_llm_off": lumber_llm_off, "lumber_lines": lumber_lines, "split_lines": split_lines, "flatten_separators": flatten_separators, "parsed_files": parsed_files, "cumulative_counts": cumulative_counts, "root_ids": root_ids, "setext_to_atx": setext, "md_heading_split": md_heading_split, "md_heading_parent": md_heading_parent,
    "md_sections_general": md_sections_general, "md_combine_small": md_combine_small, "md_collapse": md_collapse, "list_markers": list_markers, "fenced_json": fenced_json, "json_native": json_native, "preview": previews, "mime_by_ext": mime_by_ext,
    "hidden_filter": hidden_filter, "cell_convert": cell_convert, "csv_rows": csv_rows, "weighted_std": weighted_std,
}

ORACLES = {
    "pack_lines": _pack_oracle(0), "pack_lines_overlap": _pack_oracle(15),
    "word_len": f"SELECT doc_id, {S.words('text')} AS n_words, CAST(length(text) AS BIGINT) AS n_characters FROM documents",
    "page_len": f"SELECT page_id, {S.words('html')} AS n_words, CAST(length(html) AS BIGINT) AS n_characters FROM pages",
    "split_keep_start": _split_oracle("start"), "split_keep_end": _split_oracle("end"), "split_drop": _split_oracle(None), "default_separators": _DEFAULT_SEPARATORS,
    "chunk_by_chars_one_level": _ONE, "chunk_by_chars_two_level": _TWO, "cumulative_counts": _CUMULATIVE,
    "root_ids": "SELECT sha256(text) AS root_id, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1",
    "setext_to_atx": _SETEXT, "md_heading_split": f"WITH {_HEADED} SELECT doc_id, section, level, heading, content FROM sec",
    "md_heading_parent": f"WITH {_HEADED} SELECT s.doc_id, s.section, s.level, max(p.section) AS parent FROM sec s LEFT JOIN sec p ON p.doc_id = s.doc_id AND p.section < s.section AND p.level < s.level GROUP BY s.doc_id, s.section, s.level",
    "md_sections_general": f"WITH {_HEADED} SELECT s.doc_id, s.section, s.level, s.heading, s.content, max(p.section) AS parent FROM sec s LEFT JOIN sec p ON p.doc_id = s.doc_id AND p.section < s.section AND p.level < s.level GROUP BY ALL",
    "chunk_json_string": _JSON, "lumber_lines": _LUMBER, "flatten_separators": _FLATTEN_SEPARATORS, "parsed_files": _PARSED,
    "split_lines": f"WITH RECURSIVE {S.pack(_KEPT_LINES, 32, 0, chr(39) * 2)} SELECT k AS doc_id, CAST(row_number() OVER (PARTITION BY k ORDER BY st, en) - 1 AS BIGINT) AS pos, {S.words('content')} AS size, content FROM chunks",
    "md_collapse": f"""WITH d AS (SELECT doc_id, {S.words("'# ' || source || ' ' || CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END")} AS own, {S.words("'## part ' || text")} AS child FROM documents)
     SELECT doc_id, CAST(0 AS BIGINT) AS section, CAST(1 AS BIGINT) AS level FROM d UNION ALL SELECT doc_id, 1, 2 FROM d WHERE least(own, child) >= 40""",
    "md_combine_small": _COMBINE, "list_markers": _MARKERS, "fenced_json": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props END AS body FROM events",
    "json_native": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json(props) AS VARCHAR) AS json FROM events",
    "preview": f"SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 50) || '... (' || {S.words('substring(text, 51)')} || ' more words)' ELSE text END AS preview FROM documents",
    "mime_by_ext": _MIME, "hidden_filter": _HIDDEN, "cell_convert": _CELLS, "csv_rows": _CSV, "weighted_std": _STD,
}
