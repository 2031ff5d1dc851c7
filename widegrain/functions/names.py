"""Default table and column names, and the readings of column names."""

from __future__ import annotations

import re

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: Words that make a column an average or a rate (fixed values).
RATE_WORDS = {"per", "unit", "rate", "ratio", "pct", "percent", "avg", "average", "score", "rating", "grade"}


def pluralize(word: str) -> str:
    if re.search(r"(s|x|z|ch|sh)$", word):
        return word + "es"
    if re.search(r"[^aeiou]y$", word):
        return word[:-1] + "ies"
    return word + "s"


def default_table(name: str) -> str:
    return pluralize(name.lower())


def default_id(entity: str) -> str:
    return f"{entity.lower()}_id"


def label_output(entity: str) -> str:
    return f"{entity.lower()}_name"


def is_id_like(column: str) -> bool:
    return column.lower() == "id" or column.lower().endswith("_id") or bool(re.search(r"(Id|ID)$", column))


def id_stem(column: str) -> str | None:
    """`customer` of customer_id or customerID; None if there is no stem."""
    if column.lower().endswith("_id") and len(column) > 3:
        return column[:-3].lower()
    if len(column) > 2 and re.search(r"(Id|ID)$", column):
        return column[:-2].lower()
    return None


def stem_fits_table(stem: str, table: str) -> bool:
    stem, table = stem.lower(), table.lower()
    forms = {stem, stem + "s", stem + "es"}
    if stem.endswith("y"):
        forms.add(stem[:-1] + "ies")
    return table in forms or stem in (table + "s", table + "es")


def guess_nature(column: str) -> str:
    """non-additive if a word of the name says rate, else additive."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", column)
    return "non-additive" if RATE_WORDS & set(spaced.lower().split("_")) else "additive"
