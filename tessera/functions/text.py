"""Column expressions on text, all JVM-side: identifier-aware tokens, lines, styles, masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word and camel-case boundaries of the tokenizer, least length of a token.
WORD, BOUNDARY, LEAST = r"(?U)\w+", r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|_+", 2


def tokens(text: Column) -> Column:
    """Lower-case tokens: words, split at camel-case humps and underscores, of at least two characters. Null text has none."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?U)\W+|{BOUNDARY}", " ")
    return F.filter(F.split(F.lower(spaced), " "), lambda x: F.length(x) >= LEAST)


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def naming_style(name: Column) -> Column:
    """The first style that the whole name fits."""
    styles = [
        ("UPPER_SNAKE", r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$"), ("PascalCase", r"^[A-Z][a-z0-9]+([A-Z][a-z0-9]*)*$"), ("camelCase", r"^[a-z]+[a-z0-9]*([A-Z][a-z0-9]*)+$"),
        ("snake_case", r"^[a-z][a-z0-9]*(_[a-z0-9]+)+$"), ("kebab-case", r"^[a-z][a-z0-9]*(-[a-z0-9]+)+$"), ("lowercase", r"^[a-z][a-z0-9]*$"),
    ]
    out = F.lit("other")
    for label, pattern in reversed(styles):
        out = F.when(name.rlike(pattern), label).otherwise(out)
    return out


def normalised_url(url: Column) -> Column:
    """Without query, fragment and trailing slash; template holes become a star."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"\$\{[^}]*\}", "*")
    return F.regexp_replace(path, r"/+$", "")
