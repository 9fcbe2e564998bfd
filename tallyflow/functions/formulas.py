"""Shapes of formula texts: what is left of a formula when its numbers and names are taken out.

``tax * 0.2 + base`` and ``vat*0.35+net`` have one shape, two numbers and two names. Plans are built for shapes, of which a model has few, and
run over any number of texts; numbers and names travel with the rows, as arrays.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?"
NAME = r"[A-Za-z_]\w*"
TOKEN = rf"('[^']*'|{NUMBER}|{NAME}\s*\(|{NAME}|<=>|<=|>=|<>|!=|==|\|\||\S)"
#: Words of the expression language that are no names.
KEYWORDS = ("and", "or", "not", "case", "when", "then", "else", "end", "null", "true", "false", "between", "in", "is", "like", "rlike", "div", "as", "distinct", "from")
#: Functions whose arguments need not be constants: numbers inside them are taken out as well.
VALUE_FUNCTIONS = (
    "abs", "acos", "asin", "atan", "atan2", "cbrt", "ceil", "ceiling", "coalesce", "cos", "cosh", "cot", "degrees", "exp", "expm1", "floor", "greatest",
    "hypot", "if", "ifnull", "least", "ln", "log", "log10", "log1p", "log2", "mod", "negative", "nullif", "nvl", "nvl2", "pmod", "positive", "pow", "power",
    "radians", "rint", "sign", "signum", "sin", "sinh", "sqrt", "tan", "tanh", "try_add", "try_divide", "try_multiply", "try_subtract",
)
NUMBER_MARK, NAME_MARK = "\ue000", "\ue001"  # not in any formula


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def _is_number(t: Column) -> Column:
    return t.rlike(f"^{NUMBER}$")


def _is_function(t: Column) -> Column:
    return t.rlike(rf"^{NAME}\s*\($")


def _marked(all_tokens: Column) -> Column:
    """array<struct<mark, token>>: mark is the token itself unless it is a number or a name."""
    foreign = F.exists(all_tokens, lambda t: _is_function(t) & ~F.lower(F.regexp_extract(t, f"^{NAME}", 0)).isin(*VALUE_FUNCTIONS))

    def mark(t: Column, i: Column) -> Column:
        a_type = F.coalesce(F.lower(F.get(all_tokens, i - 1)) == "as", F.lit(False))  # cast(x as double)
        name = t.rlike(f"^{NAME}$") & ~F.lower(t).isin(*KEYWORDS) & ~a_type
        kind = F.when(_is_number(t) & ~foreign, F.lit(NUMBER_MARK)).when(name, F.lit(NAME_MARK)).otherwise(t)
        return F.struct(kind.alias("mark"), t.alias("token"))

    return F.transform(all_tokens, mark)


def shape(text: Column) -> Column:
    """struct<shape, numbers, names> of a formula text; names are in lower case."""
    marked = _marked(tokens(text))

    def those(mark: str) -> Column:
        return F.transform(F.filter(marked, lambda m: m["mark"] == mark), lambda m: m["token"])

    return F.struct(
        F.array_join(F.transform(marked, lambda m: m["mark"]), " ").alias("shape"),
        F.transform(those(NUMBER_MARK), lambda t: t.cast("double")).alias("numbers"),
        F.transform(those(NAME_MARK), F.lower).alias("names"),
    )


def shape_sql(text: str, numbers: str, values: str) -> str | None:
    """SQL of a shape over the array columns ``numbers`` and ``values``; None for a text in quotes."""
    if text.startswith("'"):
        return None
    out, counts = [], {NUMBER_MARK: 0, NAME_MARK: 0}
    for part in text.split(" "):
        if part in counts:
            out.append(f"{numbers if part == NUMBER_MARK else values}[{counts[part]}]")
            counts[part] += 1
        else:
            out.append(part)
    return " ".join(out)


def names_in(text: str) -> set[str]:
    """Names of one formula, in lower case, for formulas that the caller holds."""
    found = re.findall(TOKEN, text)
    names = {t for k, t in enumerate(found) if re.fullmatch(NAME, t, re.ASCII) and not (k and found[k - 1].lower() == "as")}
    return {n.lower() for n in names if n.lower() not in KEYWORDS}


# -- linear formulas --------------------------------------------------------------------
LINEAR = r"^\s*[+-]?\s*TERM(\s*[+-]\s*TERM)*\s*$".replace("TERM", rf"(?:{NUMBER}(?:\s*\*\s*{NAME})?|{NAME}(?:\s*[*/]\s*{NUMBER})?)")


def is_linear(text: Column) -> Column:
    """A sum of names with number factors (or divisors) and of numbers?"""
    words = F.exists(tokens(text), lambda t: F.lower(t).isin(*KEYWORDS))
    return text.rlike(LINEAR) & ~words


def linear_terms(text: Column) -> Column:
    """array<struct<name, coefficient>> of a linear formula; the name of its constant is null. A name may come several times."""
    parts = F.regexp_extract_all(text, F.lit(rf"([+-]?\s*(?:{NUMBER}(?:\s*\*\s*{NAME})?|{NAME}(?:\s*[*/]\s*{NUMBER})?))"), F.lit(1))

    def term(p: Column) -> Column:
        sign = F.when(p.startswith("-"), -1.0).otherwise(1.0)
        bare = F.regexp_replace(p, r"^[+-]?\s*", "")
        name = F.regexp_extract(bare, rf"(?:^|\*\s*)({NAME})", 1)
        factor = F.regexp_extract(F.regexp_replace(bare, rf"(?:^|(?<=[*\s])){NAME}", ""), f"({NUMBER})", 1).try_cast("double")
        factor = F.when(F.regexp_extract(bare, rf"/\s*({NUMBER})$", 1) != "", F.try_divide(F.lit(1.0), factor)).otherwise(F.coalesce(factor, F.lit(1.0)))
        return F.struct(F.when(name != "", F.lower(name)).alias("name"), (sign * factor).alias("coefficient"))

    return F.transform(parts, term)
