"""Text and identifier functions, as Column expressions.

Null in, null out, unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that name no field.
NON_SEMANTIC = "root app container wrapper row col column grid flex item card clearfix active disabled selected open closed".split()
UTILITY = "flex grid block inline inline-block hidden visible relative absolute fixed sticky container wrapper clearfix".split()
UTILITY_PATTERNS = (
    r"^(?:m[trblxy]?|p[trblxy]?)-\d",
    r"^(?:w|h|min-w|max-w|min-h|max-h)-",
    r"^(?:bg|text|font|border|rounded|shadow|ring|opacity|z)-",
    r"^(?:items|justify|self|place|gap|space|overflow|object|cursor)-",
    r"^(?:transition|duration|ease|transform|scale|rotate|translate)-",
    r"^(?:top|right|bottom|left)-",
    r"^(?:row|col)-\d",
    r"^(?:sm|md|lg|xl|2xl)-",
)
GENERATED_PATTERNS = (
    r"(?i)^_[a-z0-9]*\d[a-z0-9]*$",
    r"(?i)^(?:css|jsx|sc)-[a-z0-9_-]+$",
    r"(?i)^[a-z]-[bcdfghjklmnpqrstvwxyz0-9]{3,}$",
)
CONTROL_KEYS = (
    "field value test testid test-id qa cy reactid reactroot state slot component controller action target turbo".split()
)
CONTROL_PREFIXES = ("radix-", "headlessui-")
_BLANK = r"(?U)[\s\x{FEFF}]"


#: Forms that the functions below leave as they are, each told by one pattern; possessive, so that matching doesn't recurse.
_COLLAPSED = r"^(?:[!-~]++(?: [!-~]++)*+)?\z"
_KEY = r"^[a-z0-9]++(?:-[a-z0-9]++)*+\z"


def trim(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, rf"^{_BLANK}+|{_BLANK}+$", "")


def collapse(x: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return apart(lambda x: F.when(x.rlike(_COLLAPSED), x).otherwise(trim(F.regexp_replace(x, rf"{_BLANK}+", " "))), x)


def normalize_identifier(x: Column) -> Column:
    """Lower-case letters a-z and digits only."""
    return F.regexp_replace(F.lower(trim(x)), "[^a-z0-9]+", "")


def normalize_simple(x: Column) -> Column:
    return F.lower(trim(x))


def normalize_path(x: Column) -> Column:
    """Trimmed, without one leading `$.`."""
    return F.regexp_replace(trim(x), r"^\$\.", "")


def normalize_key(x: Column) -> Column:
    """A label or attribute name as lower-case words joined by hyphens."""
    return apart(lambda x: F.when(x.rlike(_KEY), x).otherwise(_hyphened(x)), x)


def _hyphened(x: Column) -> Column:
    x = F.regexp_replace(trim(x), ":+$", "")
    x = F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1-$2")
    x = F.regexp_replace(x, rf"(?U)[_\s\x{{FEFF}}]+", "-")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}-]+", "-")
    x = F.regexp_replace(x, "-+", "-")
    return F.lower(F.regexp_replace(x, "^-|-$", ""))


def apart(fn, x: Column) -> Column:
    """fn(x), kept out of generated code: long chains of patterns would outgrow a method's limit."""
    return F.get(F.transform(F.array(x), fn), F.lit(0))


def is_generated(x: Column) -> Column:
    return trim(x).rlike("|".join(f"(?:{p})" for p in GENERATED_PATTERNS))


def is_utility(key: Column) -> Column:
    return key.isin(UTILITY) | key.rlike("|".join(UTILITY_PATTERNS))


def is_control_key(x: Column) -> Column:
    def found(key: Column) -> Column:
        return key.isin(CONTROL_KEYS) | key.startswith(CONTROL_PREFIXES[0]) | key.startswith(CONTROL_PREFIXES[1])

    return apart(found, normalize_key(x))


def is_semantic(x: Column) -> Column:
    """Whether an identifier can name a field; null: false."""

    def named(bare: Column, key: Column) -> Column:
        return (
            ~bare.contains(":") & ~is_generated(bare) & F.length(key).between(1, 100) & key.rlike(r"\p{L}")
            & ~key.isin(NON_SEMANTIC) & ~is_utility(key)
        )

    def good(full: Column) -> Column:
        bare = F.regexp_replace(full, ":+$", "")
        return F.length(full).between(1, 120) & apart(lambda both: named(both["bare"], both["key"]), F.struct(bare.alias("bare"), normalize_key(bare).alias("key")))

    return F.coalesce(F.when(x.isNotNull(), apart(good, trim(x))), F.lit(False))


def is_label(x: Column) -> Column:
    """Whether a text can be a label: 1 to 80 characters, at most 10 words, semantic."""
    fits = lambda text: F.length(text).between(1, 80) & (F.size(F.split(text, " ")) <= 10) & is_semantic(text)
    return F.coalesce(F.when(x.isNotNull(), apart(fits, collapse(x))), F.lit(False))


def json_path(base: Column, key: Column) -> Column:
    """base.key, or base["key"] where the key is no plain name."""
    quoted = F.regexp_replace(F.regexp_replace(F.to_json(F.struct(key.alias("k"))), r'^\{"k":', "["), r"\}$", "]")
    return F.concat(base, F.when(key.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$"), F.concat(F.lit("."), key)).otherwise(quoted))


def snippet(x: Column, length: int = 50) -> Column:
    return F.substring(x, 1, length)


def escape_attribute(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
