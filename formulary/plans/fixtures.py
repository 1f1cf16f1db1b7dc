"""Inputs for the queries, derived from the driver's tables: the same text serves Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

B = "chr(92)"
#: Fifteen templates by (l_orderkey + l_linenumber + l_partkey) mod 15.
TXT = f"""case (l_orderkey + l_linenumber + l_partkey) % 15
 when 0 then l_partkey || ' + ' || l_suppkey || ' = ' || (l_partkey + l_suppkey)
 when 1 then l_linenumber || '! = ' || l_partkey
 when 2 then 'x_' || l_linenumber || ' = ' || l_partkey
 when 3 then l_partkey || '/' || l_suppkey || ' = ' || l_linenumber
 when 4 then 'sin(' || l_linenumber || ') = 0'
 when 5 then 'plain words ' || l_partkey
 when 6 then {B} || 'int f(x) dx = ' || l_partkey
 when 7 then {B} || 'int_{{0}}^{{' || l_linenumber || '}} f = ' || l_partkey
 when 8 then {B} || 'sum ' || {B} || 'limits x = ' || l_partkey
 when 9 then {B} || 'partial f = ' || l_suppkey
 when 10 then {B} || 'int ' || {B} || 'sum x > 0'
 when 11 then {B} || 'left( x ' || {B} || 'right) = ' || l_partkey
 when 12 then 'x = 10^{{' || l_linenumber || '}}'
 when 13 then 'a := ' || l_partkey
 else 'q' end"""
LINE_COLUMNS = ("l_orderkey as doc_id", "l_linenumber as line_no", "l_partkey as pk", "l_suppkey as sk", f"{TXT} as txt")
LINES_SQL = f"formula_lines as (select {', '.join(LINE_COLUMNS)} from lineitem)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def formula_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*LINE_COLUMNS)


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the formula lines: a word a space-separated part, 12 units a character."""
    lines = formula_lines(spark, sf_dir).distinct()
    words = lines.selectExpr("doc_id", "line_no", "pk", "sk", "split(txt, ' ') as w").selectExpr("*", "posexplode(w) as (word_num, text)")
    return words.selectExpr(
        "doc_id", "cast(pk as int) as page", "cast(sk as int) as block_num", "1 as par_num", "cast(line_no as int) as line_num", "word_num", "text",
        "cast(12 * (length(array_join(slice(w, 1, word_num), ' ')) + case when word_num > 0 then 1 else 0 end) as int) as left", "cast(20 * line_no as int) as top",
        "cast(12 * length(text) as int) as width", "16 as height", "cast(case when (pk + word_num) % 7 = 0 then -1 else (pk + 13 * word_num) % 101 end as double) as conf",
    )


WORDS_SQL = (
    LINES_SQL
    + """, parts as (select distinct *, string_split(txt, ' ') as w from formula_lines),
 words as (select doc_id, pk as page, sk as block_num, line_no as line_num, k - 1 as word_num, w[k] as text,
   12 * (length(array_to_string(w[1:k - 1], ' ')) + case when k > 1 then 1 else 0 end) as "left", 20 * line_no as top, 12 * length(w[k]) as width, 16 as height,
   (case when (pk + k - 1) % 7 = 0 then -1 else (pk + 13 * (k - 1)) % 101 end)::double as conf
  from (select *, unnest(range(1, len(w) + 1)) as k from parts))"""
)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box a line item, on the order's page."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as doc_id", "1 as page", "cast(90 * (l_linenumber % 4) as double) as x0", "cast(5 * (l_linenumber - l_linenumber % 4) + l_suppkey % 4 as double) as y0",
        "cast(90 * (l_linenumber % 4) + 40 + l_partkey % 45 as double) as x1", "cast(5 * (l_linenumber - l_linenumber % 4) + l_suppkey % 4 + 4 + l_partkey % 13 as double) as y1",
    )


BOXES_SQL = """boxes as (select l_orderkey as doc_id, (90 * (l_linenumber % 4))::double as x0, (5 * (l_linenumber - l_linenumber % 4) + l_suppkey % 4)::double as y0,
  (90 * (l_linenumber % 4) + 40 + l_partkey % 45)::double as x1, (5 * (l_linenumber - l_linenumber % 4) + l_suppkey % 4 + 4 + l_partkey % 13)::double as y1 from lineitem)"""


def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page a line item; every fiftieth document has one that failed."""
    error = "case when l_orderkey % 50 = 0 and l_linenumber = 1 then 'broken' end as error"
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc_id", "l_linenumber as page", "l_partkey % 60 as text_len", "l_suppkey % 3 as n_images", error)


BLOCK_TEXT = f"case when l_suppkey % 5 = 0 then 'π  ' else '' end || case when l_partkey % 4 = 0 then replace({TXT}, ' = ', ' =' || chr(10)) else {TXT} end"
BLOCKS = ("l_orderkey as doc_id", "l_linenumber % 2 + 1 as page", "cast(l_linenumber as bigint) * 1000000000 + l_partkey * 10000 + l_suppkey as no", "cast(l_partkey % 97 as double) as y0", "cast(l_suppkey % 7 as double) as x0", f"{BLOCK_TEXT} as text")
READ_TEXT = "case when doc_id % 3 = 0 then '' else 'noise' || chr(10) || '7 - ' || doc_id % 9 || ' = ' || page end"


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of two pages a document, some of two lines, some with a sign that cleaning takes out."""
    return table(spark, sf_dir, "lineitem").selectExpr(*BLOCKS)


def registry_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a document: its text is the content."""
    return table(spark, sf_dir, "documents").selectExpr("lpad(cast(doc_id as string), 12, '0') as path", "concat('d', doc_id % 700, case when doc_id % 11 = 0 then '.txt' else '.pdf' end) as name", "md5(cast(text as binary)) as md5", "n_chars as size")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is registered already: every fifth document."""
    return table(spark, sf_dir, "documents").where("doc_id % 5 = 0").selectExpr("concat('r', doc_id, '.pdf') as name", "md5(cast(text as binary)) as hash", "n_chars as size")


FILES_SQL = """files as (select lpad(doc_id::varchar, 12, '0') as path, 'd' || (doc_id % 700) || case when doc_id % 11 = 0 then '.txt' else '.pdf' end as name, md5(text) as md5, n_chars as size from documents),
 registry as (select 'r' || doc_id || '.pdf' as name, md5(text) as hash, n_chars as size from documents where doc_id % 5 = 0)"""


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formula lines cut behind their first ``=`` or ``+`` into two lines, in order of line_no."""
    from pyspark.sql import functions as F

    lines = formula_lines(spark, sf_dir).withColumn("cut", F.regexp_instr("txt", F.lit("[=+]")))
    parts = F.when(F.col("cut") > 0, F.array(F.trim(F.expr("substring(txt, 1, cut)")), F.trim(F.expr("substring(txt, cut + 1)")))).otherwise(F.array("txt"))
    out = lines.select("doc_id", (F.col("line_no").cast("long") * 1_000_000_000 + F.col("pk") * 10_000 + F.col("sk")).alias("at"), F.posexplode(parts).alias("k", "line"))
    return out.where("line <> ''").select("doc_id", (F.col("at") * 2 + F.col("k")).alias("line_no"), "line")


SPLIT_SQL = (
    LINES_SQL
    + """, cuts as (select *, length(regexp_extract(txt, '^[^=+]*[=+]')) as cut from formula_lines),
 split_lines as (select * from (
   select doc_id, 2 * (line_no::bigint * 1000000000 + pk * 10000 + sk) as line_no, trim(case when cut > 0 then substr(txt, 1, cut) else txt end) as line from cuts
   union all select doc_id, 2 * (line_no::bigint * 1000000000 + pk * 10000 + sk) + 1, trim(substr(txt, cut + 1)) from cuts where cut > 0) where line <> '')"""
)
