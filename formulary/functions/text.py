"""Column functions over formula text: normalising, gates, relation and operator classes.

Nulls: normalising functions give the empty string, predicates false, classes as stated. Everything is
a built-in expression, so it stays in the JVM and streams as well as it batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\x1c-\x1f]"  # with (?U): white space as Unicode has it, and the four separators
DIGITS = r"[-+]?\d+"
DECIMAL = r"[-+]?\d+(?:[.,]\d+)?"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def contains_any(c: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def matches(c: Column, pattern: str) -> Column:
    """Whether the whole text matches."""
    return c.rlike(rf"(?U)\A(?:{pattern})\z")


def normalize_spaces(c: Column) -> Column:
    """Null to empty, U+2212 to ``-``, runs of white space to one space, stripped."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "\u2212", "-"), rf"(?U){BLANK}+", " "))


def normalize_latex(c: Column) -> Column:
    s = F.replace(normalize_spaces(c), F.lit("\\,"), F.lit(""))
    return F.replace(s, F.lit("\u00d7"), F.lit("\\times"))


def page_type(n_chars: Column) -> Column:
    """By the length of a page's space-normalised text."""
    return F.when(n_chars > 400, "text").when(n_chars > 50, "mixed").otherwise("scanned")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: as a lambda's variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_number(s: Column) -> Column:
    """Of a normalised text: no letter anywhere, and a power ``10^{k}`` or a decimal; what holds letters (also
    ``\\times`` and exponents) is never a number."""
    s = F.replace(s, F.lit("\\,"), F.lit(""))  # what the removal of others brought together
    return ~s.rlike("[A-Za-z\u0410-\u042f\u0430-\u044f]") & matches(s, r"\s*(?:10\^\{\s*[+\-]?\d+\s*\}|[+\-]?(?:\d+(?:\.\d+)?|\.\d+))\s*")


def rhs_is_number(c: Column) -> Column:
    return is_number(normalize_latex(c))


def after_first_equals(s: Column) -> Column:
    return F.substring(s, F.instr(s, "=") + 1, F.length(s))


# Signs of a definition, and of an inequality (plain substrings).
DEFINITIONS = (":=", "\\equiv", "\u2261")
INEQUALITIES = ("\\le", "\\ge", "\u2264", "\u2265", "<", ">")


def relation_of(s: Column) -> Column:
    """DEF_EQ, INEQ, EQ_NUM, EQ_EXPR or OTHER, tested in this order, of a normalised formula."""
    number = is_number(after_first_equals(s))
    return F.when(contains_any(s, DEFINITIONS), "DEF_EQ").when(contains_any(s, INEQUALITIES), "INEQ").when(s.contains("="), F.when(number, "EQ_NUM").otherwise("EQ_EXPR")).otherwise("OTHER")


def relation_class(c: Column) -> Column:
    """``relation_of`` any formula; it is normalised once."""
    return let(normalize_latex(c), relation_of)


def right_of(s: Column) -> Column:
    """Behind the first ``=`` of a normalised formula, stripped; null without one."""
    return F.when(s.contains("="), F.trim(after_first_equals(s)))


def rhs_text(c: Column) -> Column:
    return let(normalize_latex(c), right_of)


def value_of(s: Column) -> Column:
    """The number that a normalised right side is; null if it is none, or a power too large for a double."""
    power = F.regexp_extract(s, r"(?U)\A10\^\{\s*([+\-]?\d+)\s*\}\z", 1)
    value = F.when(power != "", F.concat(F.lit("1e"), power).try_cast("double")).otherwise(s.try_cast("double"))
    return F.when(is_number(s) & (F.abs(value) != float("inf")), value)


def rhs_value(c: Column) -> Column:
    return let(normalize_latex(c), value_of)


# What marks a recognised crop as mathematics.
LATEX_MARKS = ("=", "\\le", "\\ge", "<", ">", "\\neq", "\\approx", "\\times", "+", "-", "^", "_", "\\frac", "\\sqrt", "\\sum", "\\int", "(", ")", "[", "]")


def is_math_latex(c: Column) -> Column:
    s = F.coalesce(c, F.lit(""))
    return (s != "") & (contains_any(s, LATEX_MARKS) | s.rlike(r"(?U)\d"))


# Symbols that trigger a text line of optical recognition.
TRIGGERS = ("=", "\u2260", "\u2248", "<", ">", "\u2264", "\u2265", "\u00b1", "\u00d7", "\u22c5", "\u2211", "\u222b", "\u221a", "\u221e", "\u2192", "\u21a6", "\u221d")


def has_trigger(c: Column) -> Column:
    """Any trigger symbol; ``<=``, ``>=``, ``!=`` and ``==`` hold one each."""
    return F.coalesce(contains_any(c, TRIGGERS), F.lit(False))


# Symbols of higher mathematics in a box's text.
MATH_SYMBOLS = ("\u222b", "\u2211", "\u2202", "\u2206", "\u2207", "lim", "max", "min", "dx", "dy", "\u2208", "\u2282", "\u221e", "\u2248", "\u2260", "\u2264", "\u2265")
LABEL = r"[\(\[]?[A-Za-z]?\d+([.,\-]\d+)*[\)\]]?[.,]?"


def math_text(c: Column) -> Column:
    """struct(is_math, reason): ordered rules, the first that holds decides."""
    out = lambda flag, why: F.struct(F.lit(flag).alias("is_math"), F.lit(why).alias("reason"))

    def measured(t: Column) -> Column:
        clean = F.regexp_replace(t, "[ \n]", "")
        letters = F.length(F.regexp_replace(t, "[^a-zA-Z\u0430-\u044f\u0410-\u042f]", ""))
        return F.struct(t.alias("t"), clean.alias("clean"), F.length(clean).alias("n"), letters.alias("letters"))

    def judged(x: Column) -> Column:
        t, clean, n, letters = (x[k] for k in ("t", "clean", "n", "letters"))
        signs = F.length(F.regexp_replace(clean, r"[^+\-/*^|]", ""))
        return (
            F.when(t == "", out(False, "empty"))
            .when(matches(clean, LABEL), out(False, "label"))
            .when((n > 30) & (letters > 0.7 * n), out(False, "prose"))
            .when(contains_any(t, MATH_SYMBOLS), out(True, "symbol"))
            .when(contains_any(t, ("=", "<", ">", "\u2248")) & (letters < 0.6 * (n + 1)), out(True, "relation"))
            .when((n > 5) & (signs > 0.1 * n), out(True, "operators"))
            .otherwise(out(False, "no sign"))
        )

    return let(let(strip(F.coalesce(c, F.lit(""))), measured), judged)


def operator_class(c: Column) -> Column:
    """integral, summation, derivative_limit, equation or mixed by the commands a formula holds; a
    command ends at a word boundary (so ``\\int_`` doesn't count). Null below three characters."""

    def found(s: Column) -> Column:
        integral, total = s.rlike(r"(?U)\\(?:int|oint)\b"), s.rlike(r"(?U)\\(?:sum|prod)\b")
        change = s.rlike(r"(?U)\\(?:partial|nabla|lim)\b|\\mathrm\{d\}")
        some = s.contains("\\")  # all commands begin so
        return F.struct((F.length(strip(s)) < 3).alias("short"), (some & integral).alias("integral"), (some & total).alias("total"), (some & change).alias("change"))

    def named(f: Column) -> Column:
        several = f["integral"].cast("int") + f["total"].cast("int") + f["change"].cast("int") > 1
        return F.when(f["short"], None).when(several, "mixed").when(f["integral"], "integral").when(f["total"], "summation").when(f["change"], "derivative_limit").otherwise("equation")

    return let(let(F.coalesce(c, F.lit("")), found), named)


def long_enough(c: Column) -> Column:
    return F.coalesce(F.length(strip(c)) > 2, F.lit(False))


def formula_id(doc_id: Column, page: Column, source: Column, payload: Column) -> Column:
    """24 hex digits; null if a part is."""
    bar = F.lit("|")
    return F.substring(F.sha1(F.concat(doc_id.cast("string"), bar, page.cast("string"), bar, source, bar, payload).cast("binary")), 1, 24)


def bbox_payload(x0: Column, y0: Column, x1: Column, y1: Column, latex: Column) -> Column:
    return F.concat(F.lit("["), x0.cast("string"), F.lit(", "), y0.cast("string"), F.lit(", "), x1.cast("string"), F.lit(", "), y1.cast("string"), F.lit("]|"), latex)


def clean_line(c: Column) -> Column:
    """Runs of spaces collapse first; then what isn't ASCII, Cyrillic, upper Latin-1 or a mathematical
    operator becomes a space, so runs can come back."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), " {2,}", " ")
    return F.trim(F.regexp_replace(s, "[^\\x20-\\x7E\u0400-\u04ff\u00b0-\u00ff\u2200-\u22ff]", " "))


# Cyrillic letters and the Latin ones they look like.
CYRILLIC = "САРсаеоОхХу"
LATIN = "CAPcaeoOxXy"


def latin_line(c: Column) -> Column:
    """A comma between digits becomes a point (pairs don't overlap), look-alike letters Latin ones."""
    return F.translate(F.regexp_replace(c, r"(?U)(\d),(\d)", "$1.$2"), CYRILLIC, LATIN)


# Words of prose that no formula line holds.
STOP_WORDS = (
    "поэтому", "следовательно", "отсюда", "пусть", "дано", "условие", "пример", "решение", "ответ", "задача", "если", "тогда", "так", "как", "что", "это",
    "будем", "можно", "нужно", "должно", "вместо", "например", "итого", "всего", "остаток", "повторя", "используем", "применим", "получим", "запишем",
    "имеем", "заметим", "покажем", "докажем", "найдем", "вычислим",
)
# Patterns of which the left side of a formula line holds one.
LEFT_SIDES = (
    r"[+\-*/^√∑∫π]", r"\b(sin|cos|tan|tg|cot|ctg)\s*[\d(°]", r"\b(log|ln|lg)\s*[\d_(]", r"\b(lim|sum|sqrt)\b", r"\d+\s*[+\-*]\s*\d+", r"\d+\s*\^\s*\d+",
    r"\d+\s*!", r"\bC\s*[\(_]\d", r"\bA\s*[\(_]\d", r"[a-zA-Z]\s*\^\s*\d", r"\d+[a-zA-Z]\s*[+\-]", r"\\frac|\\sqrt|\\sum|\\lim",
)


def is_formula_line(c: Column) -> Column:
    """Seven tests: an ``=``; at most 80 characters; a quarter Cyrillic at most; no stop word; a left side
    (before the last ``=``) of two characters or more that looks like mathematics; a number on the right."""

    def sides(line: Column) -> Column:
        right = F.substring_index(line, "=", -1)
        return F.struct(line.alias("line"), strip(F.substring(line, F.lit(1), F.length(line) - F.length(right) - 1)).alias("left"), F.replace(F.translate(strip(right), ",", "."), F.lit(" "), F.lit("")).alias("value"))

    def judged(x: Column) -> Column:
        line, left, value = x["line"], x["left"], x["value"]
        cyrillic = F.length(F.regexp_replace(line, "[^а-яёА-ЯЁ]", ""))
        looks = latin_line(left).rlike("(?iU)" + "|".join(f"(?:{p})" for p in LEFT_SIDES))
        return (
            (F.length(left) >= 2) & matches(value, rf"{DIGITS}([.,]\d+)?|{DIGITS}/\d+|∞|\\infty")
            & (cyrillic <= 0.25 * F.length(F.replace(line, F.lit(" "), F.lit("")))) & ~contains_any(F.lower(line), STOP_WORDS) & looks
        )

    def tested(line: Column) -> Column:
        return F.when(line.contains("=") & (F.length(line) <= 80), let(let(line, sides), judged)).otherwise(False)

    return let(F.coalesce(c, F.lit("")), tested)


def rhs_is_plain_number(c: Column) -> Column:
    """Behind the last ``=``: a number, or a number over a number."""
    right = F.translate(strip(F.substring_index(c, "=", -1)), ",", ".")
    return c.contains("=") & matches(right, r"[-+]?\d+(?:\.\d+)?(?:\s*/\s*\d+)?")


def file_name(url: Column) -> Column:
    """The last part of a URL without its query, other characters than ``A-Za-z0-9-_.`` as ``_``, ending .pdf."""
    name = F.substring_index(F.substring_index(F.coalesce(url, F.lit("")), "/", -1), "?", 1)
    name = F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(F.rtrim(name, F.lit("/")), F.lit(".pdf")))
    return F.regexp_replace(name, r"[^A-Za-z0-9\-_.]", "_")
