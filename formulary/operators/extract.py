"""Formulas out of text: delimited LaTeX, and ten families of inline formulas.

Each input row gives rows of its own with an explicit order (``ord``); nothing is shuffled. Null or
empty text gives no rows; repeated rows each give theirs; existing columns of the same names as the
new ones are replaced, others are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DECIMAL, is_formula_line, latin_line, normalize_spaces, rhs_is_plain_number, strip

# Delimiters, in order; delimiters stay part of a hit. The last is searched in the raw text.
DELIMITED = (
    ("inline_paren", r"\\\((.+?)\\\)"),
    ("display_bracket", r"\\\[(.+?)\\\]"),
    ("display_dollars", r"\$\$(.+?)\$\$"),
    ("inline_dollar", r"\$(.+?)\$"),
    ("env", r"\\begin\{(equation|align|gather)\}(.+?)\\end\{\1\}"),
)
# The families of inline formulas, in order; letters in either case.
EQUALS = r"\s*=\s*"
OVER = r"(?:\s*/\s*\d+)?"
FAMILIES = (
    ("factorial", r"\d+\s*!" + EQUALS + DECIMAL),
    ("combinatorial", r"[CAP]\s*[\(_]\s*\d+\s*[,_^]\s*\d+\s*[\)_]?" + EQUALS + r"\d+"),
    ("trig", r"(?:sin|cos|tan|tg|cot|ctg)\s*\(?[-+]?\d+(?:[°π/\d\s]*)\)?" + EQUALS + DECIMAL),
    ("log", r"(?:log_?\d*|ln|lg)\s*\(?[^=\n]{1,20}\)?" + EQUALS + DECIMAL),
    ("limit", r"lim\s*[\(_]?[^=\n]{1,30}[\)_]?" + EQUALS + DECIMAL),
    ("series", r"(?:sum|∑|Σ)\s*[\(_\{]?[^=\n]{1,30}[\)_\}]?" + EQUALS + DECIMAL),
    ("power", r"[-+]?\d*[a-zA-Z]?\s*\^\s*\d+" + EQUALS + DECIMAL),
    ("fraction", r"\d+\s*/\s*\d+" + EQUALS + DECIMAL + OVER),
    ("arithmetic", DECIMAL + r"(?:\s*[+\-*/]\s*" + DECIMAL + ")+" + EQUALS + DECIMAL),
    ("variable", r"[-+]?\d*\s*[a-zA-Z]\w*(?:\s*[+\-*/^]\s*" + DECIMAL + ")?" + EQUALS + DECIMAL + OVER),
)


def _found(text: Column, pattern: str, name: str, flags: str) -> Column:
    hits = F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(0))
    return F.transform(hits, lambda h: F.struct(F.lit(name).alias("pattern"), h.alias("hit")))


def text_layer_latex(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with pattern, latex_raw and ord for each delimited stretch, pattern by pattern."""
    kept = [c for c in df.columns if c not in ("ord", "pattern", "latex_raw")]
    df = df.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__raw"), normalize_spaces(F.col(text)).alias("__spaced"))
    hits = F.concat(*(_found(F.col("__raw" if name == "env" else "__spaced"), p, name, "(?sU)") for name, p in DELIMITED))
    return df.select(*kept, F.posexplode(hits).alias("ord", "h")).select(*kept, "ord", F.col("h.pattern").alias("pattern"), F.col("h.hit").alias("latex_raw"))


def inline_hits(line: Column, families: tuple[str, ...] | None = None) -> Column:
    """array<struct<pattern, hit>>: stripped hits of five characters or more with a number on the right."""
    each = [_found(line, p, name, "(?iU)") for name, p in FAMILIES if families is None or name in families]
    stripped = F.transform(F.concat(*each), lambda h: F.struct(h["pattern"].alias("pattern"), strip(h["hit"]).alias("hit")))
    return F.filter(stripped, lambda h: (F.length(h["hit"]) >= 5) & rhs_is_plain_number(h["hit"]))


def inline_formulas(line: Column, families: tuple[str, ...] | None = None) -> Column:
    """array<string>: the hits, each once, in order of family and place."""
    return F.array_distinct(F.transform(inline_hits(line, families), lambda h: h["hit"]))


def candidates(df: DataFrame, line: str = "line", passes: int = 1, min_len: int = 5, max_len: int = 80) -> DataFrame:
    """``df`` with ord and text: a formula line whole, of other lines their inline formulas. ``passes``
    beyond 1 normalise a candidate again (which matters: ``1,2,3`` needs two)."""
    clean = latin_line(F.coalesce(F.col(line), F.lit("")))
    kept = [c for c in df.columns if c not in ("ord", "text")]
    out = df.withColumn("__line", clean)
    found = F.when(is_formula_line(F.col("__line")), F.array("__line")).otherwise(inline_formulas(F.col("__line")))
    out = out.select(*kept, F.posexplode(found).alias("ord", "text"))
    for _ in range(passes - 1):
        out = out.withColumn("text", latin_line(F.col("text")))
    return out.withColumn("text", strip(F.col("text"))).where(F.length("text").between(min_len, max_len))
