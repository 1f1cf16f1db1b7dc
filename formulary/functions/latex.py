"""Plain text to LaTeX: rule tables folded into one chain of built-in replacements.

The order of rules is part of the result: rules see what earlier ones wrote, so ``tg`` becomes
``\\\\tan`` with two backslashes and ``x^10`` becomes ``x^{1}0``. Null stays null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

# Symbols and their commands, in order.
SYMBOLS = (
    ("√", r"\sqrt"), ("∞", r"\infty"), ("∑", r"\sum"), ("Σ", r"\sum"), ("∫", r"\int"), ("∏", r"\prod"), ("π", r"\pi"), ("α", r"\alpha"), ("β", r"\beta"),
    ("γ", r"\gamma"), ("δ", r"\delta"), ("θ", r"\theta"), ("λ", r"\lambda"), ("μ", r"\mu"), ("σ", r"\sigma"), ("φ", r"\phi"), ("ω", r"\omega"),
    ("≤", r"\leq"), ("≥", r"\geq"), ("≠", r"\neq"), ("±", r"\pm"), ("×", r"\times"), ("÷", r"\div"), ("·", r"\cdot"), ("°", r"^{\circ}"), ("²", r"^{2}"),
    ("³", r"^{3}"), ("½", r"\frac{1}{2}"), ("¼", r"\frac{1}{4}"), ("¾", r"\frac{3}{4}"), ("→", r"\to"), ("∈", r"\in"), ("∉", r"\notin"), ("⊂", r"\subset"),
    ("∩", r"\cap"), ("∪", r"\cup"), ("∅", r"\emptyset"),
)
# Words and their commands, in order, in either case.
FUNCTIONS = (
    ("arcsin", r"\arcsin"), ("arccos", r"\arccos"), ("arctg", r"\arctan"), ("arctan", r"\arctan"), ("arcctg", r"\text{arcctg}"), ("ctg", r"\cot"), ("tg", r"\tan"),
    ("sin", r"\sin"), ("cos", r"\cos"), ("tan", r"\tan"), ("cot", r"\cot"), ("sec", r"\sec"), ("csc", r"\csc"), ("sinh", r"\sinh"), ("cosh", r"\cosh"),
    ("tanh", r"\tanh"), ("ln", r"\ln"), ("lg", r"\lg"), ("log", r"\log"), ("lim", r"\lim"), ("exp", r"\exp"), ("max", r"\max"), ("min", r"\min"),
    ("mod", r"\bmod"), ("sqrt", r"\sqrt"), ("sum", r"\sum"), ("prod", r"\prod"), ("inf", r"\infty"),
)
# Patterns and templates ($n: group n) of combinations, fractions, roots, powers, indices, limits and sums.
STRUCTURES = (
    (r"\bC\s*_\s*(\d+)\s*\^\s*(\d+)", r"\binom{$1}{$2}"),
    (r"\bC\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)", r"\binom{$1}{$2}"),
    (r"\bA\s*_\s*(\d+)\s*\^\s*(\d+)", r"A_{$1}^{$2}"),
    (r"(?<![\\{/])\b(\d+)\s*/\s*(\d+)\b(?!/)", r"\frac{$1}{$2}"),
    (r"\\?sqrt\s*\(\s*([^)]+)\s*\)", r"\sqrt{$1}"),
    (r"\\sqrt\s+(\w+)", r"\sqrt{$1}"),
    (r"\^([0-9a-zA-Z])(?!\{)", r"^{$1}"),
    (r"_([0-9a-zA-Z])(?!\{)", r"_{$1}"),
    (r"\\lim\s*\(\s*([a-zA-Z])\s*->\s*[^)]*(?i:inf)[^)]*\)", r"\lim_{$1 \to \infty}"),
    (r"\\lim\s*\(\s*([a-zA-Z])\s*->\s*([^)]+?)\s*\)", r"\lim_{$1 \to $2}"),
    (r"\\?sum\s*\(\s*([a-zA-Z])\s*=\s*(\d+)\s*\.\.\s*(\w+)\s*\)", r"\sum_{$1=$2}^{$3}"),
    (r" {2,}", " "),
)


def replace_symbols(c: Column) -> Column:
    """One fold over the table, for texts that hold a sign of it."""
    table = F.array(*[F.struct(F.lit(sign).alias("sign"), F.lit(command).alias("command")) for sign, command in SYMBOLS])
    some = c.rlike("[" + "".join(sign for sign, _ in SYMBOLS) + "]")
    return F.when(some, F.aggregate(table, c, lambda text, rule: F.replace(text, rule["sign"], rule["command"]))).otherwise(c)


def replace_functions(c: Column) -> Column:
    """Rule by rule, for texts that hold a word of the table."""
    out = c
    for word, command in FUNCTIONS:
        out = F.regexp_replace(out, rf"(?iU)\b{word}\b", command.replace("\\", "\\\\"))
    return F.when(c.rlike(r"(?iU)\b(?:" + "|".join(word for word, _ in FUNCTIONS) + r")\b"), out).otherwise(c)


def convert_structures(c: Column) -> Column:
    """Rule by rule, for texts that hold a sign or a word which all rules but the last need one of, and runs of spaces."""
    out = c
    for pattern, template in STRUCTURES[:-1]:
        out = F.regexp_replace(out, f"(?U){pattern}", template.replace("\\", "\\\\"))
    out = F.when(c.rlike(r"[\^_/(]|sqrt"), out).otherwise(c)
    pattern, template = STRUCTURES[-1]
    return F.regexp_replace(out, pattern, template)


def to_latex(c: Column) -> Column:
    """All steps, each on the value of the one before, which is computed once."""
    out = let(let(let(c, replace_symbols), replace_functions), convert_structures)
    return F.regexp_replace(out, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def with_latex(df: DataFrame, text: str, name: str = "latex") -> DataFrame:
    """``df`` with ``to_latex`` of a column, each step a projection of its own."""
    df = df.withColumn(name, replace_symbols(F.col(text)))
    for step in (replace_functions, convert_structures):
        df = df.withColumn(name, step(F.col(name)))
    return df.withColumn(name, F.regexp_replace(name, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""))
