"""Scalar text functions as Spark columns: all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript has it, which is wider than Java's or RE2's.
SPACES = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE_CLASS = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"


def trim(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def trim_if_edged(c: Column) -> Column:
    """Trimmed if an end is a space, line feed or tab; else as it is. Null becomes empty."""
    return F.coalesce(F.when(c.rlike("^[ \\n\\t]|[ \\n\\t]\\z"), trim(c)).otherwise(c), F.lit(""))


def clean_docc(c: Column) -> Column:
    """Without directives, comments and runs of blank lines; links to symbols become their names."""
    c = F.regexp_replace(c, f"@Metadata{SPACE_CLASS}*\\{{[^}}]*\\}}", "")
    c = F.regexp_replace(c, f"@Options\\([^)]*\\){SPACE_CLASS}*\\{{[^}}]*\\}}", "")
    c = F.regexp_replace(c, "<doc:([^>]+)>", "$1")
    c = F.regexp_replace(c, "(?s)<!--.*?-->", "")
    return trim(F.regexp_replace(c, "\\n{3,}", "\n\n"))


def slugify(c: Column) -> Column:
    """Lower case, ASCII word characters, and a hyphen for each run of white space or hyphens."""
    c = F.regexp_replace(F.lower(c), f"(?!{SPACE_CLASS})[^A-Za-z0-9_-]", "")
    return trim(F.regexp_replace(F.regexp_replace(c, f"{SPACE_CLASS}+", "-"), "-+", "-"))


def strip_fences(c: Column) -> Column:
    """Without the marks of fenced blocks; tags other than sql and json stay as text."""
    for mark in ("```sql", "```json", "```"):
        c = F.replace(c, F.lit(mark), F.lit(""))
    return trim(c)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_extension(path: Column) -> Column:
    """What follows the last dot of the whole path, in lower case; empty without a dot."""
    return F.lower(F.when(F.instr(path, ".") > 0, F.substring_index(path, ".", -1)).otherwise(""))


def title_from_path(path: Column) -> Column:
    return F.regexp_replace(file_name(path), "\\.md\\z", "")


def id_from_path(path: Column) -> Column:
    return F.regexp_replace(F.lower(title_from_path(path)), f"{SPACE_CLASS}+", "-")


_LANGUAGES = (
    ("javascript", [["const "], ["let "], ["async "]]),
    ("swift", [["func "], ["let ", ":"]]),
    ("python", [["def "], ["import ", "from "]]),
    ("kotlin", [["public class"], ["private val"]]),
    ("csharp", [["class ", "{"], ["using "]]),
    ("dart", [["void "], ["Future<"]]),
)


def infer_language(code: Column) -> Column:
    """The first language of which a mark occurs; `code` if none does."""
    out = None
    for name, ways in _LANGUAGES:
        test = F.lit(False)
        for marks in ways:
            whole = F.lit(True)
            for m in marks:
                whole &= F.contains(code, F.lit(m))
            test |= whole
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("code")


def front_matter(raw: Column) -> Column:
    """The key: value lines between --- marks at the very start, as a map; later keys win, values are strings."""
    body = F.regexp_extract(raw, "(?s)\\A---\\n(.*?)\\n---", 1)
    pairs = F.transform(
        F.filter(F.split(body, "\n", -1), lambda line: F.instr(line, ":") > 1),
        lambda line: F.struct(trim(F.substring_index(line, ":", 1)).alias("key"), trim(F.substr(line, F.instr(line, ":") + F.lit(1))).alias("value")),
    )
    return last_wins(pairs)


def last_wins(pairs: Column) -> Column:
    """A map of an array of (key, value): keys in the order of their first mention, with their last values."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    value = lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, value))


def first_replaced(text: Column, mark: str, by: Column) -> Column:
    """With the first occurrence of a mark replaced; signs in the replacement mean themselves."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), by, F.substr(text, at + F.lit(len(mark))))).otherwise(text)


def or_default(c: Column, default: Column | str) -> Column:
    """The default for null and for the empty string."""
    return F.coalesce(F.nullif(c, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def long_date(d: Column) -> Column:
    return F.date_format(d, "MMMM d, yyyy")
