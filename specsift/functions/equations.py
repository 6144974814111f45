"""Expressions over equation lines and LaTeX."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from specsift import lexicons as L
from specsift.functions.text import col, strip


def _hits(c: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, (c.rlike(f"(?d){p}").cast("int") for p in patterns))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def _of(c: Column, chars: str) -> Column:
    """How many characters of c are among chars."""
    return F.length(c) - F.length(F.translate(c, chars, ""))


def is_equation(line: Column | str) -> Column:
    s = strip(line)
    words, prose, maths = F.size(_words(s)), _hits(s, L.PROSE), _hits(s, L.MATH)
    solid = F.replace(s, F.lit(" "), F.lit(""))
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    density = F.when(F.length(solid) > 0, 1 - letters / F.length(solid)).otherwise(0.0)
    yes = ((maths >= 1) & (density > 0.15)) | (F.contains(s, F.lit("=")) & (maths >= 2)) | ((_of(s, L.PHYSICS + L.OPERATORS) >= 3) & (words < 12))
    return (F.length(s) >= 3) & (words <= 25) & (prose < 2) & yes


def score(line: Column | str, before: Column | str, after: Column | str) -> Column:
    s = strip(line)
    subs = reduce(lambda a, b: a + b, (F.contains(s, F.lit(p)).cast("int") for p in L.SUBSCRIPTS))
    common = F.size(F.filter(_words(F.lower(s)), lambda w: w.isin(*L.EQUATION_COMMON)))
    lone = (strip(before) == "") & (strip(after) == "")
    total = (
        2 * _of(s, L.PHYSICS) + 2 * F.least(subs, F.lit(3)) + F.least(_of(s, L.OPERATORS), F.lit(5)) + F.when(s.rlike(L.EQUATION_NUMBER_END), 3).otherwise(0) + F.when(lone, 2).otherwise(0)
        + F.when(_of(s, "()") > 0.1 * F.length(s), 1).otherwise(0) + F.when(s.rlike(r"^[A-Za-z_]\w*\s*=\s*\S"), 3).otherwise(0) - F.when(s.rlike(L.EQUATION_PROSE_START), 5).otherwise(0)
        - F.when(common >= 3, 3).otherwise(0)
    )
    return F.greatest(total, F.lit(0)).cast("int")


def symbols(text: Column | str) -> Column:
    """Every spelling of a symbol by its canonical one, longest spelling first."""
    keys = sorted(L.SYMBOLS, key=lambda k: -len(k))
    return reduce(lambda x, k: F.regexp_replace(x, rf"(?U)\b{re.escape(k)}\b", L.SYMBOLS[k]), keys, col(text))


def variables(text: Column | str) -> Column:
    names = sorted(set(L.SYMBOLS.values()))
    return F.filter(F.array(*[F.when(col(text).rlike(rf"(?U)\b{n}\b"), F.lit(n)) for n in names]), lambda x: x.isNotNull())


def preprocess(text: Column | str) -> Column:
    """ASCII mathematics without equation numbers, leading words and trailing prose."""
    r = strip(F.regexp_replace(strip(text), L.EQUATION_NUMBER_END, ""))
    r = strip(F.regexp_replace(r, r"^\(\d+[\.\-]\d+\)\s*", ""))
    r = strip(F.regexp_replace(r, r"(?i)^(where|and|here|with|for|when)\b[,:]?\s*", ""))
    r = F.when(F.contains(r, F.lit("=")), strip(F.get(F.split(r, r"(?i)\s+(where|and|with|for|in which)\s+", 2), 0))).otherwise(r)
    r = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), L.ASCII_MATH, r)
    return strip(F.regexp_replace(r, r"\s+", " "))


def core_text(line: Column | str) -> Column:
    s = strip(F.regexp_replace(strip(line), L.EQUATION_NUMBER_END, ""))
    whole = r"(?d)^([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)\s*=\s*(.+)$"
    part = r"([A-Za-z_]\w*(?:\([^)]*\))?)\s*=\s*([^,\.;]+)"
    return F.when(s.rlike(whole), s).when(s.rlike(part), strip(F.regexp_extract(s, part, 0))).otherwise(s)


def latex_parts(text: Column | str) -> Column:
    """Everything in \\( \\), then in single dollars, then in double dollars."""
    t = col(text)
    inline = F.regexp_extract_all(t, F.lit(r"(?s)\\\((.+?)\\\)"), 1)
    single = F.regexp_extract_all(t, F.lit(r"(?<!\$)\$([^$]+?)\$(?!\$)"), 1)
    double = F.regexp_extract_all(t, F.lit(r"(?s)\$\$(.+?)\$\$"), 1)
    return F.concat(inline, single, double)


def merge_blocks(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"(?s)\$\$(.*?)\$\$\s*\n\s*\$\$(.*?)\$\$", r"\$\$$1 $2\$\$")


#: Rewrites of LaTeX to plain mathematics, in order, after the token table: pattern, replacement.
LATEX_REWRITES = (
    (r"_\{([^}]+)\}", "_$1"), (r"\^\{([^}]+)\}", "**($1)"), (r"\\frac\{(.*?)\}\{(.*?)\}", "($1)/($2)"), (r"_([a-zA-Z0-9]+),([a-zA-Z0-9]+)", "_$1_$2"), (r"\{", "("), (r"\}", ")"), (r"\[", "("),
    (r"\]", ")"), (r"\\", ""), (r"tag\(.*?\)", ""), (r"\([0-9]+\.[0-9]+[a-zA-Z]*\)$", ""), (r"exp\^\(([^)]+)\)", "exp($1)"), (r"exp\^([a-zA-Z0-9_]+)", "exp($1)"), (r"e\^\(([^)]+)\)", "exp($1)"),
    (r"e\^([a-zA-Z0-9_]+)", "exp($1)"), (r"\^", "**"), (r"begin\(cases\)", ""), (r"DeltaVth\s*\(DITS\)", "DeltaVth_DITS"), (r"[bB]igg?[lrm]?", ""), (r"\|", ""), (" and ", " "),
    (r"\)_([a-zA-Z0-9]+)", ")*$1"), (r"\)\s*\(", ")*("), (r"([A-Za-z]+_[A-Za-z0-9]+)\((.*?)\)", "$1_$2"), (r"(^|[(\s+\-*/=])(\d+)([a-zA-Z_]\w*)", "$1$2*$3"), ("'", ""), (r"\s+", " "),
)


def latex_to_text(text: Column | str) -> Column:
    out = reduce(lambda x, k: F.replace(x, F.lit(k), F.lit(L.LATEX[k])), sorted(L.LATEX, key=lambda k: -len(k)), col(text))
    return strip(reduce(lambda x, r: F.regexp_replace(x, *r), LATEX_REWRITES, out))


def classify(text: Column | str) -> Column:
    t = col(text)
    has = lambda *w: reduce(lambda a, b: a | b, (F.contains(t, F.lit(x)) for x in w))
    return F.when(has("tau", "dt", "dq"), "transient_equation").when(has("V_DD") & has("C_L"), "power_equation").when(has("i_", "v_", "V_", "Vth"), "transfer_equation").otherwise("general_equation")


def number_after(text: Column | str) -> Column:
    """The number in brackets within 30 characters after the first display block."""
    after = F.regexp_extract(col(text), r"(?s)\$\$.+?\$\$(.{0,30})", 1)
    return F.nullif(F.regexp_extract(after, r"\((\d+\.\d+[a-z]?)\)", 1), F.lit(""))
