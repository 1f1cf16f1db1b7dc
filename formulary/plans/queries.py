"""The library's queries over the driver's tables, each with the SQL that should give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import latex
from ..functions import text as T
from ..operators import corpus, dataset, extract, layout, lines, records
from ..sources import pdf
from . import fixtures as X
from . import pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEYS = ("doc_id", "line_no", "pk", "sk")
K = ", ".join(KEYS)


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- classes and numbers -----------------------------------------------------------------------

OPERATOR_SQL = r"""case when length(trim({0})) < 3 then null
  when (regexp_matches({0}, '\\(int|oint)\b'))::int + (regexp_matches({0}, '\\(sum|prod)\b'))::int + (regexp_matches({0}, '\\(partial|nabla|lim)\b|\\mathrm\{{d\}}'))::int > 1 then 'mixed'
  when regexp_matches({0}, '\\(int|oint)\b') then 'integral' when regexp_matches({0}, '\\(sum|prod)\b') then 'summation'
  when regexp_matches({0}, '\\(partial|nabla|lim)\b|\\mathrm\{{d\}}') then 'derivative_limit' else 'equation' end"""


@query(f"with {X.LINES_SQL} select class, count(*) as n from (select {OPERATOR_SQL.format('txt')} as class from formula_lines) where class is not null group by class")
def formula_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.classify(X.formula_lines(spark, sf_dir), "txt").groupBy("class").agg(F.count("*").alias("n"))


NORM_SQL = r"replace(replace(trim(regexp_replace(txt, '\s+', ' ', 'g')), chr(92) || ',', ''), '×', chr(92) || 'times')"
RIGHT_SQL = "trim(substr(s, strpos(s, '=') + 1))"
NUMBER_SQL = rf"not regexp_matches({RIGHT_SQL}, '[A-Za-z]') and regexp_full_match({RIGHT_SQL}, '10\^\{{\s*[+-]?[0-9]+\s*\}}|[+-]?([0-9]+(\.[0-9]+)?|\.[0-9]+)')"
RELATION_SQL = rf"""case when contains(s, ':=') or contains(s, chr(92) || 'equiv') or contains(s, '≡') then 'DEF_EQ'
  when contains(s, chr(92) || 'le') or contains(s, chr(92) || 'ge') or regexp_matches(s, '[≤≥<>]') then 'INEQ'
  when contains(s, '=') then case when {NUMBER_SQL} then 'EQ_NUM' else 'EQ_EXPR' end else 'OTHER' end"""
CLS_SQL = f"{X.LINES_SQL}, normal as (select {K}, {NORM_SQL} as s from formula_lines), cls as (select *, {RELATION_SQL} as cls from normal)"


@query(f"with {CLS_SQL} select cls, count(*) as n from cls group by cls")
def relation_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.formula_lines(spark, sf_dir).groupBy(T.relation_class(F.col("txt")).alias("cls")).agg(F.count("*").alias("n"))


@query(rf"with {CLS_SQL} select {K}, {RIGHT_SQL} as rhs, case when {RIGHT_SQL} like '10^%' then ('1e' || regexp_extract(s, '\{{\s*([+-]?[0-9]+)', 1))::double else {RIGHT_SQL}::double end as value from cls where cls = 'EQ_NUM'")
def numeric_rhs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.formula_lines(spark, sf_dir).select(*KEYS, T.normalize_latex(F.col("txt")).alias("s")).where(T.relation_of(F.col("s")) == "EQ_NUM")
    return out.select(*KEYS, T.right_of(F.col("s")).alias("rhs")).withColumn("value", T.value_of(F.col("rhs")))


@query(f"""with {CLS_SQL} select {K}, s as latex_norm, cls, case when cls = 'EQ_NUM' then {RIGHT_SQL} end as rhs,
  substr(sha1(doc_id || '|' || line_no || '|text_layer|' || s), 1, 24) as text_id, substr(sha1(doc_id || '|' || line_no || '|ocr|[' || pk || ', ' || sk || ', 9, 9]|' || s), 1, 24) as ocr_id from cls""")
def formula_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.normalize_latex(F.col("txt"))
    payload = T.bbox_payload(F.col("pk"), F.col("sk"), F.lit(9), F.lit(9), F.col("latex_norm"))
    out = X.formula_lines(spark, sf_dir).withColumn("latex_norm", s).withColumn("cls", T.relation_of(F.col("latex_norm")))
    ids = [T.formula_id(F.col("doc_id"), F.col("line_no"), F.lit(kind), p).alias(name) for kind, p, name in (("text_layer", F.col("latex_norm"), "text_id"), ("ocr", payload, "ocr_id"))]
    return out.select(*KEYS, "latex_norm", "cls", F.when(F.col("cls") == "EQ_NUM", T.right_of(F.col("latex_norm"))).alias("rhs"), *ids)


@query(f"""with {CLS_SQL} select cls, count(*) as n, count(distinct substr(sha1(doc_id || '|' || line_no || '|text_layer|' || s), 1, 24)) as n_ids,
  count(*) filter (cls = 'EQ_NUM') as n_numbers from cls group by cls""")
def text_layer_record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = X.formula_lines(spark, sf_dir).selectExpr("cast(doc_id as string) as doc_id", "concat(doc_id, '.pdf') as pdf_file", "cast(line_no as int) as page", "txt as latex_raw")
    return records.text_layer_records(hits).groupBy("cls").agg(F.count("*").alias("n"), F.countDistinct("formula_id").alias("n_ids"), F.count("rhs_number_float").alias("n_numbers"))


@query(f"""with {CLS_SQL} select substr(sha1(doc_id || '|' || line_no || '|ocr|[' || pk || ', ' || sk || ', 9, 9]|' || s), 1, 24) as formula_id, cls, case when cls = 'EQ_NUM' then {RIGHT_SQL} end as rhs,
  '[' || pk || ',' || sk || ',9,9]' as bbox, (pk % 101)::double as ocr_confidence from cls""")
def ocr_record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = X.formula_lines(spark, sf_dir).selectExpr("cast(doc_id as string) as doc_id", "concat(doc_id, '.pdf') as pdf_file", "line_no as page", "pk as x0", "sk as y0", "9 as x1", "9 as y1", "txt as latex_raw", "cast(pk % 101 as double) as mean_conf")
    return records.ocr_records(hits).select("formula_id", "cls", F.col("rhs_number_raw").alias("rhs"), F.to_json("bbox_px").alias("bbox"), "ocr_confidence")


@query(f"with {X.LINES_SQL} select length(trim(txt)) > 2 as long_enough, count(*) as n from formula_lines group by 1")
def long_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.formula_lines(spark, sf_dir).groupBy(T.long_enough(F.col("txt")).alias("long_enough")).agg(F.count("*").alias("n"))


@query(f"with {X.LINES_SQL} select {K}, txt, 'too short' as reason from formula_lines where length(trim(txt)) < 3")
def rejected_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.rejected(X.formula_lines(spark, sf_dir), "txt")


# --- pages and gates ------------------------------------------------------------------------------

PAGE_SQL = r"""pages_in as (select doc_id, length(trim(regexp_replace(replace(coalesce(text, ''), '−', '-'), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))) as n from documents),
 typed as (select *, case when n > 400 then 'text' when n > 50 then 'mixed' else 'scanned' end as page_type from pages_in)"""


@query(f"with {PAGE_SQL} select doc_id, n::bigint as n, page_type, page_type in ('scanned', 'mixed') as gated from typed")
def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length(T.normalize_spaces(F.col("text"))).cast("long")
    out = X.table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).withColumn("page_type", T.page_type(F.col("n")))
    return out.withColumn("gated", F.col("page_type").isin("scanned", "mixed"))


@query(f"with {PAGE_SQL} select page_type, count(*) as n from typed where page_type in ('scanned', 'mixed') group by 1")
def ocr_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.page_type(F.length(T.normalize_spaces(F.col("text"))))
    return X.table(spark, sf_dir, "documents").select(t.alias("page_type")).where(F.col("page_type").isin("scanned", "mixed")).groupBy("page_type").agg(F.count("*").alias("n"))


MARKS_SQL = " or ".join(f"contains(txt, {'chr(92) || ' if m[0] == chr(92) else ''}'{m.lstrip(chr(92))}')" for m in T.LATEX_MARKS)


@query(f"with {X.LINES_SQL} select {MARKS_SQL} or regexp_matches(txt, '[0-9]') as is_math, count(*) as n from formula_lines group by 1")
def math_latex_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.formula_lines(spark, sf_dir).groupBy(T.is_math_latex(F.col("txt")).alias("is_math")).agg(F.count("*").alias("n"))


SYMBOLS_SQL = " or ".join(f"contains(t, '{m}')" for m in T.MATH_SYMBOLS)


@query(rf"""with {X.LINES_SQL}, x as (select trim(txt) as t from formula_lines union all select trim(text, chr(32) || chr(9) || chr(10) || chr(13)) from benchmark),
 y as (select t, regexp_replace(t, '[ \n]', '', 'g') as c, length(regexp_replace(t, '[^a-zA-Zа-яА-Я]', '', 'g')) as l from x),
 z as (select *, length(c) as n, length(regexp_replace(c, '[^+\-/*^|]', '', 'g')) as o from y),
 r as (select case when t = '' then 'empty' when regexp_full_match(c, '[(\[]?[A-Za-z]?[0-9]+([.,\-][0-9]+)*[)\]]?[.,]?') then 'label' when n > 30 and l > 0.7 * n then 'prose'
   when {SYMBOLS_SQL} then 'symbol' when regexp_matches(t, '[=<>≈]') and l < 0.6 * (n + 1) then 'relation' when n > 5 and o > 0.1 * n then 'operators' else 'no sign' end as reason from z)
 select reason, reason in ('symbol', 'relation', 'operators') as is_math, count(*) as n from r group by 1, 2""")
def math_text_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.formula_lines(spark, sf_dir).select("txt").unionAll(X.table(spark, sf_dir, "benchmark").select("text"))
    return t.select(T.math_text(F.col("txt")).alias("r")).groupBy("r.reason", "r.is_math").agg(F.count("*").alias("n"))


# --- extraction ---------------------------------------------------------------------------------------


def _delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.B
    text = f"concat('see ', {b}, '( ', txt, ' ', {b}, ')  and $$', txt, '$$ or $', pk, ' = x$ ', {b}, '[', txt, {b}, ']', {b}, 'begin{{align}}', chr(10), txt, {b}, 'end{{align}}')"
    return X.formula_lines(spark, sf_dir).selectExpr(*KEYS, f"{text} as text")


def _hits(source: str, name: str, no: int, pattern: str) -> str:
    return f"select {K}, {no} as no, '{name}' as pattern, unnest(regexp_extract_all({source}, '{pattern}', 0, 's')) as latex_raw from d"


_B = "chr(92)"
DELIMITED_SQL = (
    f"with {X.LINES_SQL}, t as (select {K}, 'see ' || {_B} || '( ' || txt || ' ' || {_B} || ')  and $$' || txt || '$$ or $' || pk || ' = x$ ' || {_B} || '[' || txt || {_B} || ']' || {_B} || 'begin{{align}}' || chr(10) || txt || {_B} || 'end{{align}}' as raw from formula_lines), "
    + r"d as (select *, trim(regexp_replace(raw, '\s+', ' ', 'g')) as s from t) select "
    + K
    + ", pattern, latex_raw from ("
    + " union all ".join(
        [_hits("s", "inline_paren", 0, r"\\\((.+?)\\\)"), _hits("s", "display_bracket", 1, r"\\\[(.+?)\\\]"), _hits("s", "display_dollars", 2, r"\$\$(.+?)\$\$"), _hits("s", "inline_dollar", 3, r"\$(.+?)\$")]
        + [_hits("raw", "env", 4, rf"\\begin\{{{e}\}}(.+?)\\end\{{{e}\}}") for e in ("equation", "align", "gather")]
    )
    + ")"
)


@query(DELIMITED_SQL)
def text_layer_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.text_layer_latex(_delimited(spark, sf_dir)).select(*KEYS, "pattern", "latex_raw")


NUM = "[-+]?[0-9]+([.,][0-9]+)?"
#: The families as RE2 patterns over ASCII input, written out on their own.
FAMILY_SQL = {
    "factorial": rf"[0-9]+\s*!\s*=\s*{NUM}",
    "combinatorial": r"[CAP]\s*[(_]\s*[0-9]+\s*[,_^]\s*[0-9]+\s*[)_]?\s*=\s*[0-9]+",
    "trig": rf"(sin|cos|tan|tg|cot|ctg)\s*\(?[-+]?[0-9]+[°π/0-9\s]*\)?\s*=\s*{NUM}",
    "log": rf"(log_?[0-9]*|ln|lg)\s*\(?[^=\n]{{1,20}}\)?\s*=\s*{NUM}",
    "limit": rf"lim\s*[(_]?[^=\n]{{1,30}}[)_]?\s*=\s*{NUM}",
    "series": rf"(sum|∑|Σ)\s*[(_{{]?[^=\n]{{1,30}}[)_}}]?\s*=\s*{NUM}",
    "power": rf"[-+]?[0-9]*[a-zA-Z]?\s*\^\s*[0-9]+\s*=\s*{NUM}",
    "fraction": rf"[0-9]+\s*/\s*[0-9]+\s*=\s*{NUM}(\s*/\s*[0-9]+)?",
    "arithmetic": rf"{NUM}(\s*[-+*/]\s*{NUM})+\s*=\s*{NUM}",
    "variable": rf"[-+]?[0-9]*\s*[a-zA-Z][0-9A-Za-z_]*(\s*[-+*/^]\s*{NUM})?\s*=\s*{NUM}(\s*/\s*[0-9]+)?",
}
NUMBER_RIGHT_SQL = r"regexp_full_match(replace(trim(regexp_extract({0}, '=([^=]*)$', 1)), ',', '.'), '[-+]?[0-9]+(\.[0-9]+)?(\s*/\s*[0-9]+)?')"
# richer lines than the templates: every family occurs
INLINE_COLUMN = "case when pk % 7 = 0 then 'C(' || line_no || ', 2) = ' || sk when pk % 7 = 1 then 'log_2(' || pk || ') = 3 so ' || line_no || '^2 = ' || sk when pk % 7 = 2 then 'lim(x->0) = 1 and sum(i=1..9) = ' || sk when pk % 7 = 3 then 'x = ' || pk || '/' || sk || ' = 12/55' else txt end"


def _family_hits(line: str, names: list[str]) -> str:
    each = [f"select *, {k} as no, '{n}' as family, trim(unnest(regexp_extract_all({line}, '(?i){FAMILY_SQL[n]}', 0))) as formula from f" for k, n in enumerate(names)]
    return f"(select * from ({' union all '.join(each)}) where length(formula) >= 5 and {NUMBER_RIGHT_SQL.format('formula')})"


@query(f"with {X.LINES_SQL}, f as (select {K}, {INLINE_COLUMN} as line from formula_lines) select {K}, formula from {_family_hits('line', list(FAMILY_SQL))} group by all")
def inline_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.formula_lines(spark, sf_dir).selectExpr(*KEYS, f"{INLINE_COLUMN} as line")
    return f.select(*KEYS, F.explode(extract.inline_formulas(F.col("line"))).alias("formula"))


def _family(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = X.formula_lines(spark, sf_dir).selectExpr(*KEYS, f"{INLINE_COLUMN} as line")
        return f.select(*KEYS, F.explode(extract.inline_formulas(F.col("line"), (name,))).alias("formula"))

    run.__name__ = f"inline_formulas_{name}"
    query(f"with {X.LINES_SQL}, f as (select {K}, {INLINE_COLUMN} as line from formula_lines) select {K}, formula from {_family_hits('line', [name])} group by all")(run)


for _name in FAMILY_SQL:
    _family(_name)

LEFT_SQL = "(?i)[-+*/^√∑∫π]|\\b(sin|cos|tan|tg|cot|ctg)\\s*[0-9(°]|\\b(log|ln|lg)\\s*[0-9_(]|\\b(lim|sum|sqrt)\\b|[0-9]\\s*!|\\b[CA]\\s*[(_][0-9]|\\\\frac|\\\\sqrt|\\\\sum|\\\\lim"
FORMULA_LINE_SQL = rf"""(contains(line, '=') and length(line) <= 80 and length(trim(regexp_extract(line, '^(.*)=', 1))) >= 2
  and regexp_full_match(replace(replace(trim(regexp_extract(line, '=([^=]*)$', 1)), ',', '.'), ' ', ''), '[-+]?[0-9]+([.,][0-9]+)?|[-+]?[0-9]+/[0-9]+|∞|\\infty')
  and regexp_matches(regexp_extract(line, '^(.*)=', 1), '{LEFT_SQL}'))"""


@query(f"with {X.LINES_SQL}, f as (select {K}, {INLINE_COLUMN} as line from formula_lines) select {K}, line from f where {FORMULA_LINE_SQL}")
def formula_line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.formula_lines(spark, sf_dir).selectExpr(*KEYS, f"{INLINE_COLUMN} as line")
    return f.where(T.is_formula_line(F.col("line")))


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
 select doc_id, sum(length(trim(regexp_replace(regexp_replace(line, ' {2,}', ' ', 'g'), '[^\x20-\x7E\x{0400}-\x{04FF}\x{00B0}-\x{00FF}\x{2200}-\x{22FF}]', ' ', 'g'))))::bigint as n_clean,
   sum(length(regexp_replace(line, '[^.]', '', 'g')) + length(regexp_extract_all(line, '[0-9],[0-9]')))::bigint as n_points from l group by doc_id""")
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines_in = X.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    points = F.length(F.regexp_replace(T.latin_line(F.col("line")), "[^.]", ""))
    return lines_in.groupBy("doc_id").agg(F.sum(F.length(T.clean_line(F.col("line")))).alias("n_clean"), F.sum(points).alias("n_points"))


def _golden(rows: list[tuple], function: Callable, name: str, kind: str) -> None:
    """A query over all line items, each of which takes one of ``rows`` in turn, of a rule that RE2 can't state: what is
    expected is written out."""
    literal = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {literal(x)}, {literal(y)})" for k, (x, y) in enumerate(rows))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = F.array(*[F.lit(x).cast("string") for x, _ in rows])
        lines_in = X.table(spark, sf_dir, "lineitem").select(F.get(given, F.expr(f"cast((l_orderkey + l_linenumber + l_partkey) % {len(rows)} as int)")).alias("line"))
        return lines_in.withColumn("result", function(F.col("line"))).groupBy("line", "result").agg(F.count("*").alias("n"))

    run.__name__ = name
    query(f"select line, result, count(*) as n from lineitem join (values {values}) v(k, line, result) on (l_orderkey + l_linenumber + l_partkey) % {len(rows)} = k group by all")(run)


_golden(
    [
        ("2 + 3 = 5", True), ("2 + 3", False), ("1 + " * 25 + "1 = 26", False), ("x = 5", False), ("ab = 5", False), ("sin 30 = 0,5", True), ("lim f = ∞", True), ("C(5,2) = 10", True),
        ("A_5 = 20", True), ("5 ! = 120", True), ("log_2 8 = 3", True), ("1/2 = 1/2", True), ("a + b = c", False), ("a + b = 5 = 6", True), ("\\frac = 2", True), ("x^2 = 4", True),
        ("a + b = -3.5", True), ("a + b = 1e5", False), (None, False), ("π r = 3", True), ("tg 45 = 1", True), ("ab = \\infty", False), ("a+b = \\infty", True), ("a - b = 5.", False),
        ("ПУСТЬ 2 + 3 = 5", False), ("ИМЕЕМ 2 + 3 + 4 + 5 + 6 + 7 + 8 + 9 = 44", False), ("АБВГД 2 + 3 + 4 + 5 + 6 + 7 + 8 + 9 = 44", True), ("БУДЕМ 2 + 3 + 4 + 5 + 6 + 7 + 8 + 9 = 44", False),
        ("ЖЗИ 2 + 7 = 9", False), ("ЖЗ 12 + 77 = 89", True),
    ],
    T.is_formula_line, "formula_line_rules", "boolean",
)
_golden([("САРсаеоОхХу", "CAPcaeoOxXy"), ("1,2,3", "1.2,3"), ("0,5 и 12,25", "0.5 и 12.25"), ("С(5,2) = 10", "C(5.2) = 10"), ("a, b", "a, b"), ("БГДЁ", "БГДЁ"), ("", ""), (None, None)], T.latin_line, "latin_lines", "string")
_golden([("a  b\tc", "a b c"), ("π = 3", "= 3"), ("a π b", "a   b"), ("5−3", "5−3"), ("  Σ  ", ""), ("é ±  ∑ Ж", "é ± ∑ Ж"), ("a 中 b", "a   b"), ("", ""), (None, "")], T.clean_line, "cleaned_lines", "string")
_SIGNS = {"∑": r"\\sum", "Σ": r"\\sum", "∏": r"\\prod"}  # what the words' rules see again gets a second backslash
_WORDS = {"arctg": r"\\arctan", "ctg": r"\\cot", "tg": r"\\tan"}
_golden(
    [("a √ b", r"a \\sqrt{b}")] + [(f"a {sign} b", f"a {_SIGNS.get(sign, command)} b") for sign, command in latex.SYMBOLS if sign != "√"]
    + [(f"{word} y", f"{_WORDS.get(word, command)} y") for word, command in latex.FUNCTIONS if word != "sqrt"]
    + [
        ("SIN(x) + Ln y", r"\sin(x) + \ln y"), ("sinx + cosec", "sinx + cosec"), ("C_5^2", r"\binom{5}{2}"), ("C(7, 3)", r"\binom{7}{3}"), ("A_5^2", "A_{5}^{2}"), ("1/2 + 3 / 4", r"\frac{1}{2} + \frac{3}{4}"), ("1/2/3", "1/2/3"),
        ("{1/2", "{1/2"), ("a1/2", "a1/2"), ("sqrt(x + 1)", r"\sqrt{x + 1}"), ("√(x)", r"\\sqrt{x}"), ("sqrt y", r"\sqrt{y}"), ("x^2", "x^{2}"), ("x^10", "x^{1}0"), ("x^{2}", "x^{2}"), ("x_i + y_1", "x_{i} + y_{1}"),
        ("lim(x->0) f", r"\lim_{x \to 0} f"), ("lim(n->inf) f", r"\lim_{n \to \infty} f"), ("lim( x -> a + 1 )", r"\lim_{x \to a + 1}"), ("sum(i=1..n)", r"\sum_{i=1}^{n}"), ("  a    b ", "a b"), ("plain", "plain"), ("", ""), (None, None),
    ],
    latex.to_latex, "latex_rules", "string",
)

JOINED_SQL = r""", j as (select *, row_number() over w as pos, lag(line) over w as before from split_lines window w as (partition by doc_id order by line_no)),
 b as (select *, sum(case when before is null or not (regexp_matches(before, '[-+*/=^,(\\]$') or regexp_matches(line, '^[-+*/^),a-z]')) then 1 else 0 end) over (partition by doc_id order by pos) as island from j),
 merged as (select doc_id, min(line_no) as line_no, string_agg(line, ' ' order by pos) as line from b group by doc_id, island)"""
MERGED_SQL = X.SPLIT_SQL + JOINED_SQL


@query(f"with {MERGED_SQL} select doc_id, line_no, line from merged")
def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.merge_broken_lines(X.split_lines(spark, sf_dir))


@query(f"""with {MERGED_SQL}, f as (select doc_id, line_no, regexp_replace(line, '([0-9]),([0-9])', '\\1.\\2', 'g') as line from merged),
 c as (select doc_id, line as text from f where {FORMULA_LINE_SQL} union all select doc_id, formula from {_family_hits('line', list(FAMILY_SQL))} where not {FORMULA_LINE_SQL})
 select distinct doc_id, text from c where length(text) between 5 and 80""")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = lines.merge_broken_lines(X.split_lines(spark, sf_dir))
    found = extract.candidates(merged).select("doc_id", "text", "line_no", "ord")
    return lines.first_occurrences(found, ("doc_id", "text"), ("line_no", "ord")).select("doc_id", "text")


STRIP_SQL = r"regexp_replace({0}, '^[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+|[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+$', '', 'g')"
CLEAN_SQL = r"trim(regexp_replace(regexp_replace({0}, ' {{2,}}', ' ', 'g'), '[^\x20-\x7E\x{{0400}}-\x{{04FF}}\x{{00B0}}-\x{{00FF}}\x{{2200}}-\x{{22FF}}]', ' ', 'g'))"
DIGITAL_SQL = f"""with blocks as (select {', '.join(X.BLOCKS)} from lineitem),
 pg as (select doc_id, page, string_agg(text, chr(10) order by no) as text from blocks group by doc_id, page),
 routed as (select *, length({STRIP_SQL.format('text')}) >= 50 as own from pg),
 parts as (select doc_id, page, row_number() over (partition by doc_id, page order by round_even(y0 / 10, 0), x0, no) as block_no, blocks.text from blocks join routed using (doc_id, page) where own
   union all select doc_id, page, 0, {X.READ_TEXT} from routed where not own),
 l as (select doc_id, page, block_no, generate_subscripts(string_split(text, chr(10)), 1) as k, {CLEAN_SQL.format('unnest(string_split(text, chr(10)))')} as line from parts),
 found as (select * from l where line <> ''),
 whole as (select doc_id, page, block_no, k, line from found union all select doc_id, page, 0, 1, '1 + 1 = 2' from pg where doc_id not in (select doc_id from found)),
 split_lines as (select doc_id, row_number() over (partition by doc_id order by page, block_no, k) as line_no, line from whole)""" + JOINED_SQL


@query(f"""{DIGITAL_SQL}, f as (select doc_id, line_no, regexp_replace(line, '([0-9]),([0-9])', '\\1.\\2', 'g') as line from merged),
 c as (select doc_id, line as text from f where {FORMULA_LINE_SQL} union all select doc_id, formula from {_family_hits('line', list(FAMILY_SQL))} where not {FORMULA_LINE_SQL}),
 d as (select doc_id, trim(regexp_replace(text, '([0-9]),([0-9])', '\\1.\\2', 'g')) as text from c)
 select distinct doc_id, text from d where length(text) between 5 and 80""")
def digital_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digital route from blocks to candidates: routing, reading order, cleaning, the second reader, joining, two passes."""
    blocks = X.text_blocks(spark, sf_dir)
    pages = blocks.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("no", "text"))).alias("bs")).select("doc_id", "page", F.array_join(F.transform("bs", lambda b: b["text"]), "\n").alias("text"))
    read = pages.selectExpr("doc_id", "page", f"{X.READ_TEXT} as text")
    return pipelines.digital_candidates(pages, blocks, read, pages.select("doc_id", "page", F.lit("1 + 1 = 2").alias("text"))).select("doc_id", "text")


@query(f"""{DIGITAL_SQL} select doc_id, page, block_no::bigint as block_no, k::bigint - 1 as k, line from whole""")
def digital_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = X.text_blocks(spark, sf_dir)
    pages = blocks.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("no", "text"))).alias("bs")).select("doc_id", "page", F.array_join(F.transform("bs", lambda b: b["text"]), "\n").alias("text"))
    found = lines.digital_lines(pages, blocks, pages.selectExpr("doc_id", "page", f"{X.READ_TEXT} as text"), pages.select("doc_id", "page", F.lit("1 + 1 = 2").alias("text")))
    own = F.length(T.strip(F.col("text"))) >= 50  # ranks count from 1 in the SQL where a page gives its blocks
    return found.join(pages.select("doc_id", "page", own.alias("own")), [found["doc_id"] == pages["doc_id"], found["line_no.page"] == pages["page"]]).select(found["doc_id"], F.col("line_no.page").alias("page"), (F.col("line_no.block_no") + F.col("own").cast("int")).alias("block_no"), F.col("line_no.k").alias("k"), "line")


# --- layout ------------------------------------------------------------------------------------------

WORD_KEYS = ("doc_id", "page", "block_num", "par_num", "line_num")
TRIGGER_SQL = "regexp_matches({0}, '[=≠≈<>≤≥±×⋅∑∫√∞→↦∝]')"
OCR_SQL = (
    X.WORDS_SQL
    + """, ocr as (select doc_id, page, block_num, line_num, string_agg(text, ' ' order by word_num) as line_text, min("left") as x0, min(top) as y0, max("left" + width) as x1, max(top + height) as y1,
   sum(case when conf < 0 then 0 else conf end)::bigint as conf_sum, count(*) as n, bool_or("""
    + TRIGGER_SQL.format("text")
    + """) as hit from words group by all)"""
)


@query(f"with {OCR_SQL} select doc_id, page, block_num, line_num, line_text, x0, y0, x1, y1, conf_sum, n from ocr")
def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layout.lines_of_words(X.word_boxes(spark, sf_dir))
    cast = [F.col(c).cast("long").alias(c) for c in ("page", "block_num", "line_num", "x0", "y0", "x1", "y1")]
    n = F.size("words").cast("long")
    return out.select("doc_id", *cast, "line_text", F.round(F.col("mean_conf") * n).cast("long").alias("conf_sum"), n.alias("n"))


@query(f"with {OCR_SQL} select doc_id, page, block_num, line_num, line_text from ocr where conf_sum >= 30 * n and hit")
def math_line_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layout.math_lines(layout.lines_of_words(X.word_boxes(spark, sf_dir)))
    return out.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("page", "block_num", "line_num")), "line_text")


@query(f"""with {OCR_SQL}, a as (select doc_id, page, block_num, line_num, min(word_num) filter ({TRIGGER_SQL.format('text')}) as first, max(word_num) filter ({TRIGGER_SQL.format('text')}) as last from words group by all)
 select doc_id, page, block_num, line_num, greatest(0, min("left") - any_value(case when first is null then 0 else 8 end)) as x0, greatest(0, min(top) - any_value(case when first is null then 0 else 8 end)) as y0,
   max("left" + width) + any_value(case when first is null then 0 else 8 end) as x1, max(top + height) + any_value(case when first is null then 0 else 8 end) as y1
 from words join a using (doc_id, page, block_num, line_num) where first is null or word_num between first - 3 and last + 3 group by all""")
def refined_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layout.lines_of_words(X.word_boxes(spark, sf_dir)).withColumn("b", layout.refined_box(F.col("words")))
    return out.select("doc_id", *(F.col(c).cast("long").alias(c.split(".")[-1]) for c in ("page", "block_num", "line_num", "b.x0", "b.y0", "b.x1", "b.y1")))


BOX_FOLD_SQL = (
    X.BOXES_SQL
    + """, s as (select *, row_number() over (partition by doc_id order by y0, x0, x1, y1) as k from boxes),
 step as (select doc_id, k, 1 as box_no, x0, y0, x1, y1 from s where k = 1
   union all select s.doc_id, s.k, t.box_no + case when j then 0 else 1 end, case when j then least(t.x0, s.x0) else s.x0 end, case when j then least(t.y0, s.y0) else s.y0 end,
     case when j then greatest(t.x1, s.x1) else s.x1 end, case when j then greatest(t.y1, s.y1) else s.y1 end
   from step t join s on s.doc_id = t.doc_id and s.k = t.k + 1, lateral (select least(t.y1 - t.y0, s.y1 - s.y0) > 0
     and greatest(0.0::double, least(t.y1, s.y1) - greatest(t.y0, s.y0)) > 0.3::double * least(t.y1 - t.y0, s.y1 - s.y0) and s.x0 - t.x1 > -20 and s.x0 - t.x1 < 40 as j)),
 folded as (select doc_id, (box_no - 1)::int as box_no, max_by(x0, k) as x0, max_by(y0, k) as y0, max_by(x1, k) as x1, max_by(y1, k) as y1 from step group by doc_id, box_no)"""
)


@query(f"with recursive {BOX_FOLD_SQL} select * from folded")
def merged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.merge_boxes(X.boxes(spark, sf_dir)).drop("page")


@query(f"""with recursive {BOX_FOLD_SQL}, kept as (select * from folded where x1 - x0 <= 400 * 0.9::double and x1 - x0 >= 20.0::double / 3 and y1 - y0 >= 20.0::double / 3)
 select doc_id, box_no, greatest(x0 - 5, 0) as x0, greatest(y0 - 5, 0) as y0, least(x1 + 5, 400) as x1, least(y1 + 5, 60) as y1 from kept
 where least(x1 + 5, 400) > greatest(x0 - 5, 0) and least(y1 + 5, 60) > greatest(y0 - 5, 0)""")
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = layout.plausible_boxes(layout.merge_boxes(X.boxes(spark, sf_dir)), F.lit(400.0))
    return layout.clipped(kept, F.lit(400.0), F.lit(60.0), 5).drop("page")


# --- corpus ------------------------------------------------------------------------------------------

TYPES_SQL = """flags as (select l_orderkey as doc_id, l_partkey % 60 > 30 as t, l_suppkey % 3 > 0 as i, case when l_orderkey % 50 = 0 and l_linenumber = 1 then 'broken' end as error from lineitem),
 types as (select doc_id, count(*) as total_pages, count(*) filter (t and not i) as text_pages, count(*) filter (i and not t) as image_pages, count(*) filter (t and i) as mixed_pages,
   count(*) filter (not t and not i) as empty_pages, max(error) as error from flags group by doc_id),
 named as (select *, case when error is not null then 'ERROR' when 10 * image_pages > 8 * total_pages then 'SCAN' when 10 * image_pages > 2 * total_pages then 'MIXED' else 'DIGITAL' end as type from types)"""


@query(f"""with {TYPES_SQL} select doc_id, type, error, type in ('SCAN', 'MIXED') as needs_ocr, case when error is null then total_pages end as total_pages, case when error is null then text_pages end as text_pages,
  case when error is null then image_pages end as image_pages, case when error is null then mixed_pages end as mixed_pages, case when error is null then empty_pages end as empty_pages,
  case when error is null then image_pages::double / total_pages end as scan_ratio from named""")
def pdf_type_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.document_types(X.page_flags(spark, sf_dir))


@query(f"with {TYPES_SQL} select type, count(*) as n, (sum(total_pages) filter (type <> 'ERROR'))::bigint as pages, count(*) filter (type in ('SCAN', 'MIXED')) as n_needs_ocr from named group by type")
def pdf_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.document_types(X.page_flags(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"), F.sum("total_pages").alias("pages"), F.count_if("needs_ocr").alias("n_needs_ocr"))


@query(f"""with recursive {X.FILES_SQL}, f as (select *, row_number() over (order by path, name, md5) as k from files),
 step as (select 0::bigint as k, ''::varchar as status, (select coalesce(list(hash), []) from registry) as hashes, (select coalesce(list(name), []) from registry) as names
   union all select f.k, j.s, case when j.s = 'accepted' then list_append(hashes, f.md5) else hashes end, case when j.s = 'accepted' then list_append(names, f.name) else names end
   from step join f on f.k = step.k + 1, lateral (select case when lower(f.name) not like '%_.pdf' then 'bad_extension' when coalesce(list_contains(hashes, f.md5), false) then 'duplicate' when list_contains(names, f.name) then 'name_taken' else 'accepted' end as s) j)
 select path, name, status from f join step using (k)""")
def corpus_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.admit(X.registry_files(spark, sf_dir), X.registry(spark, sf_dir)).select("path", "name", "status")


@query(f"with {X.FILES_SQL} select md5, min(path) as path from files group by md5")
def corpus_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.distinct_contents(X.registry_files(spark, sf_dir)).select("md5", "path")


@query(f"with {X.FILES_SQL} select count(*) as n_files, sum(size)::bigint as total_size from registry")
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.totals(X.registry(spark, sf_dir))


@query(f"with {X.FILES_SQL} select path, exists (select 1 from files g where g.name = files.name and g.md5 = files.md5 and g.path <= '000000000300') as skipped from files")
def unchanged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = X.registry_files(spark, sf_dir).withColumnRenamed("md5", "sha1")
    state = files.where("path <= '000000000300'").select("name", "sha1")
    new, skipped = corpus.unchanged(files, state)
    return new.select("path", F.lit(False).alias("skipped")).unionByName(skipped.select("path", F.lit(True).alias("skipped")))


@query(r"""with n as (select page_id, regexp_extract(split_part(url, '/', -1), '^[^?]*') as n from pages)
 select page_id, regexp_replace(case when lower(n) like '%.pdf' then n else rtrim(n, '/') || '.pdf' end, '[^A-Za-z0-9\-_.]', '_', 'g') as name from n""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "pages").select("page_id", T.file_name(F.col("url")).alias("name"))


# --- dataset -------------------------------------------------------------------------------------------


PER_CLASS = 5000  # so that at the small sizes some classes have enough and some are filled up


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.formula_lines(spark, sf_dir).selectExpr("txt as text", "txt as latex", "concat('doc', doc_id % 5) as source", "concat_ws('|', doc_id, line_no, pk, sk) as key")
    return dataset.classify(f)


def _draw(what: str, lo: int, hi: int) -> str:
    return f"((('0x' || substr(md5('42|' || class || '|' || i || '|{what}'), 1, 8))::bigint % {hi - lo + 1}) + {lo})"


BALANCED_SQL = f"""with {X.LINES_SQL}, items as (select * from (select txt as text, txt as latex, 'doc' || (doc_id % 5) as source, {OPERATOR_SQL.format('txt')} as class, doc_id || '|' || line_no || '|' || pk || '|' || sk as key from formula_lines) where class is not null),
 vocab as (select * from (values ('integral', 0), ('summation', 1), ('derivative_limit', 2), ('equation', 3), ('mixed', 4)) v(class, class_no)),
 taken as (select text, latex, source, class, key from (select *, row_number() over (partition by class order by md5('42|' || key), key) as r from items) where r <= {PER_CLASS}),
 short as (select v.class, {PER_CLASS} - count(i.key) as shortage from vocab v left join items i on i.class = v.class group by v.class),
 made as (select class, unnest(range(0, greatest(shortage, 0))) as i from short),
 synthetic as (select case class when 'integral' then 'Интеграл от ' || {_draw('a', 0, 5)} || ' до ' || {_draw('b', 6, 10)} when 'summation' then 'Сумма до ' || {_draw('n', 10, 100)}
     when 'derivative_limit' then case i % 2 when 0 then 'Производная функции' else 'Предел на бесконечности' end when 'equation' then case i % 2 when 0 then 'Квадратное уравнение' else 'Неравенство' end
     else case i % 2 when 0 then 'Предел интеграла' else 'Интеграл суммы' end end as text,
   case class when 'integral' then '\\int_{{' || {_draw('a', 0, 5)} || '}}^{{' || {_draw('b', 6, 10)} || '}} f(x) dx = 0' when 'summation' then '\\sum_{{i=1}}^{{' || {_draw('n', 10, 100)} || '}} x_i = Y'
     when 'derivative_limit' then case i % 2 when 0 then '\\frac{{\\partial f}}{{\\partial x}} + \\frac{{\\partial f}}{{\\partial y}} = 0' else '\\lim_{{n \\to \\infty}} \\left( 1 + \\frac{{1}}{{n}} \\right)^n = e' end
     when 'equation' then case i % 2 when 0 then 'ax^2 + bx + c = 0' else 'x^2 + y^2 \\le R^2' end
     else case i % 2 when 0 then '\\lim_{{t \\to 0}} \\int_0^t f(x) dx = 0' else '\\int_{{\\Omega}} \\sum_{{i=1}}^n x_i d\\mu \\ge 0' end end as latex, 'synthetic' as source, class, 'synthetic|' || class || '|' || i as key from made),
 balanced as (select *, md5('42|shuffle|' || key) as position from (select * from taken union all select * from synthetic)) """


@query(BALANCED_SQL + "select text, latex, source, class, key, position from balanced")
def balanced_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.validate(dataset.balance(_items(spark, sf_dir), PER_CLASS))


@query(BALANCED_SQL + f"select class_no, class, count(key) as n, count(key) >= {PER_CLASS} as ok from vocab left join items using (class) group by all")
def class_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.class_status(_items(spark, sf_dir), PER_CLASS)


@query(BALANCED_SQL + "select source, count(*) as n, case when source = 'synthetic' then 'synthetic' else 'pdf' end as kind from balanced group by source")
def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.source_report(dataset.balance(_items(spark, sf_dir), PER_CLASS))


@query(BALANCED_SQL + "select 'class' as \"by\", class as name, count(*) as n from balanced group by class union all select 'source', source, count(*) from balanced group by source")
def dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.counts_by(dataset.balance(_items(spark, sf_dir), PER_CLASS))


@query(BALANCED_SQL + "select class, substr(arg_min(text, position), 1, 40) as text, substr(arg_min(latex, position), 1, 80) as latex from balanced group by class")
def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.examples(dataset.balance(_items(spark, sf_dir), PER_CLASS))


# --- LaTeX conversion -----------------------------------------------------------------------------------

CONVERT_COLUMN = "case when pk % 5 = 0 then 'sin(x) + cos(' || line_no || ') = √' || sk when pk % 5 = 1 then 'C_' || line_no || '^2 ≤ sqrt(' || pk || ')' when pk % 5 = 2 then 'sum(i=1..' || line_no || ') x_1^2' when pk % 5 = 3 then 'lim(x->' || line_no || ')  exp(y)' else 'A_5^2 × max(a_1)' end"
_steps = "line"
for _a, _b in (("√", r"\sqrt"), ("≤", r"\leq"), ("×", r"\times")):
    _steps = f"replace({_steps}, '{_a}', '{_b}')"
for _w in ("sin", "cos", "lim", "exp", "max", "sqrt", "sum"):
    _steps = rf"regexp_replace({_steps}, '(?i)\b{_w}\b', '\\{_w}', 'g')"
for _a, _b in (
    (r"\bC\s*_\s*([0-9]+)\s*\^\s*([0-9]+)", r"\\binom{\1}{\2}"), (r"\bA\s*_\s*([0-9]+)\s*\^\s*([0-9]+)", r"A_{\1}^{\2}"), (r"\\?sqrt\s*\(\s*([^)]+)\s*\)", r"\\sqrt{\1}"), (r"\\sqrt\s+([0-9A-Za-z_]+)", r"\\sqrt{\1}"),
    (r"\^([0-9a-zA-Z])", r"^{\1}"), (r"_([0-9a-zA-Z])", r"_{\1}"), (r"\\lim\s*\(\s*([a-zA-Z])\s*->\s*([^)]+?)\s*\)", r"\\lim_{\1 \\to \2}"),
    (r"\\?sum\s*\(\s*([a-zA-Z])\s*=\s*([0-9]+)\s*\.\.\s*([0-9A-Za-z_]+)\s*\)", r"\\sum_{\1=\2}^{\3}"), (r" {2,}", " "),
):
    _steps = f"regexp_replace({_steps}, '{_a}', '{_b}', 'g')"


@query(f"with {X.LINES_SQL}, f as (select {K}, {CONVERT_COLUMN} as line from formula_lines) select {K}, line, trim({_steps}) as latex from f")
def latex_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.formula_lines(spark, sf_dir).selectExpr(*KEYS, f"{CONVERT_COLUMN} as line")
    return latex.with_latex(f, "line")


# --- sources, routes and reports --------------------------------------------------------------------------

BLOCK_COLUMNS = "l_orderkey as doc_id, 1 as page, cast(l_partkey % 97 as double) as y0, cast(l_suppkey % 7 as double) as x0, 'b' || l_partkey || '-' || l_suppkey as text, case when l_linenumber % 5 = 0 then 1 else 0 end as kind"


@query(f"""with blocks as (select {BLOCK_COLUMNS} from lineitem)
 select doc_id, (row_number() over (partition by doc_id order by round_even(y0 / 10, 0), x0, text) - 1)::int as block_no, text from blocks where kind = 0""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = X.table(spark, sf_dir, "lineitem").selectExpr(*BLOCK_COLUMNS.split(", "))
    return lines.reading_order(blocks).select("doc_id", "block_no", "text")


@query(f"""with own as (select doc_id, coalesce(text, '') as text from documents),
 routed as (select doc_id, case when length({STRIP_SQL.format('text')}) >= 400 then text else 'read on' || chr(10) || ' page ' || doc_id end as text from own),
 l as (select doc_id, {STRIP_SQL.format('unnest(string_split(text, chr(10)))')} as line from routed)
 select doc_id, count(*) as n_lines, sum(length(line))::bigint as n_chars from l where line <> '' group by doc_id""")
def routed_page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = X.table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    read = own.select("doc_id", "page", F.concat(F.lit("read on\n page "), F.col("doc_id").cast("string")).alias("text"))
    found = lines.split_lines(pdf.routed_lines(own, read, 400))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query(f"with {X.LINES_SQL} select {K}, txt as line from formula_lines where doc_id % 3 <> 0 union all select {K}, 'second ' || txt from formula_lines where doc_id % 3 = 0")
def fallback_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.formula_lines(spark, sf_dir)
    return pdf.with_fallback(f.where("doc_id % 3 <> 0").selectExpr(*KEYS, "txt as line"), f.selectExpr(*KEYS, "'second ' || txt as line"))


@query(f"with {X.LINES_SQL}, {TYPES_SQL} select {K}, case when type = 'DIGITAL' then txt else 'ocr ' || txt end as line from formula_lines join named using (doc_id) where type <> 'ERROR'")
def routes_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.formula_lines(spark, sf_dir)
    return pdf.by_document_type(corpus.document_types(X.page_flags(spark, sf_dir)), f.selectExpr(*KEYS, "txt as line"), f.selectExpr(*KEYS, "'ocr ' || txt as line"))


@query(f"select case when is_math then 'ACCEPT' else 'REJECT' end as status, sum(n)::bigint as n from ({ORACLES['math_text_rule']}) group by 1")
def math_text_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.formula_lines(spark, sf_dir).select("txt").unionAll(X.table(spark, sf_dir, "benchmark").select("text"))
    return t.select(F.when(T.math_text(F.col("txt"))["is_math"], "ACCEPT").otherwise("REJECT").alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query(f"with {CLS_SQL} select doc_id::varchar as doc_id, cls, count(*) as n from cls group by all")
def document_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = X.formula_lines(spark, sf_dir).selectExpr("cast(doc_id as string) as doc_id", "concat(doc_id, '.pdf') as pdf_file", "cast(line_no as int) as page", "txt as latex_raw")
    return records.class_counts(records.text_layer_records(hits)).select("doc_id", F.explode("formula_counts").alias("cls", "n"))


@query("select 'd' || doc_id as name, md5(coalesce(text, '')) as hash, doc_id % 9 = 0 as fetched, round(n_chars / 1e3, 0)::bigint as size_kb from documents")
def registry_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry as parallel arrays, a hundred files to each, back to a row a file."""
    row = F.struct(F.expr("'d' || doc_id").alias("n"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"), F.expr("cast(round(n_chars / 1e3) as bigint)").alias("s"), F.when(F.expr("doc_id % 9 = 0"), "url").alias("u"))
    packed = X.table(spark, sf_dir, "documents").groupBy(F.expr("doc_id div 100")).agg(F.collect_list(row).alias("r"))
    part = lambda c: F.transform("r", lambda x: x[c])
    arrays = packed.select(part("n").alias("files"), part("h").alias("hashes"), part("n").alias("added_at"), part("s").alias("sizes_mb"), part("u").alias("urls"))
    return corpus.registry_rows(arrays).select("name", "hash", F.col("url").isNotNull().alias("fetched"), F.col("size_mb").alias("size_kb"))


@query("select doc_id, doc_id % 3 = 0 or starts_with(coalesce(text, ''), '%PDF') as is_pdf from documents")
def pdf_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.when(F.expr("doc_id % 3 = 0"), "%PDF-1.7\n").otherwise(""), F.coalesce("text", F.lit(""))).cast("binary")
    return X.table(spark, sf_dir, "documents").select("doc_id", corpus.is_pdf(content).alias("is_pdf"))


ITEM_COLUMNS = "case when l_partkey % 7 = 0 then '  ' when l_partkey % 11 = 0 then null else 't' || l_partkey end as text, 'x = ' || l_suppkey as latex, case when l_suppkey % 5 = 0 then '' else 's' || l_linenumber end as source, case l_linenumber % 3 when 0 then 'integral' when 1 then 'equation' else 'other' end as class"


@query(f"with items as (select {ITEM_COLUMNS} from lineitem) select text, latex, source, class from items where trim(text) <> '' and trim(source) <> '' and class <> 'other'")
def validated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.validate(X.table(spark, sf_dir, "lineitem").selectExpr(*ITEM_COLUMNS.split(", ")))


@query(BALANCED_SQL + "select text, latex, source, class, key from synthetic")
def synthetic_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = dataset.class_status(_items(spark, sf_dir))
    return dataset.synthetic(counts.select("class", (F.lit(PER_CLASS) - F.col("n")).alias("shortage")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formula_class_counts(spark, sf_dir)
