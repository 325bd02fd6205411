"""Text operators as Column expressions: nothing here leaves the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines that are page furniture, each with whether case counts.
METADATA_PATTERNS = [
    (r"^page\s+\d+\s*(of\s+\d+)?$", False),
    (r"^downloaded\s+from", False),
    (r"^accessed\s+on", False),
    (r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", True),
    (r"^view\s+table\s+of\s+contents", False),
    (r"^terms\s+(and|&)\s+conditions", False),
    (r"^copyright\s+", False),
    (r"^some\s+figures\s+may\s+appear", False),
    (r"^https?:\/\/\S+$", True),
    (r"^doi:\s", False),
    (r"^published\s+online", False),
    (r"^available\s+at\s", False),
    (r"^journal\s+homepage", False),
]
# Phrases of boilerplate lines.
BOILERPLATE_PHRASES = [
    "all rights reserved",
    "this article is licensed under",
    "creative commons",
    "open access",
    "peer review",
    "received:",
    "accepted:",
    "published:",
    "revised:",
    "corresponding author",
]
# Cross-reference patterns, in order.
REFERENCE_PATTERNS = [
    ("citation", r"(?i)(?:see|refer\s+to|as\s+shown\s+in|according\s+to)\s+(?:Table|Figure|Fig\.|Equation|Eq\.)\s*(?:\d+(?:\.\d+)?)"),
    ("numeric_citation", r"\[(?:\d+(?:,\s*\d+)*)\]"),
    ("direct_reference", r"(?i)(?:Table|Figure|Fig\.|Equation|Eq\.)\s*(?:\d+(?:\.\d+)?)"),
]
# Beginnings and words of figure captions.
FIGURE_PATTERNS = [
    r"^Figure\s+\d+",
    r"^Fig\.\s*\d+",
    r"^Scheme\s+\d+",
    r"^Diagram\s+\d+",
    r"^Chart\s+\d+",
    r"^Plot\s+\d+",
    r"^Graph\s+\d+",
    r"^Image\s+\d+",
]
CAPTION_WORDS = ["shows", "displays", "illustrates", "depicts", "presents"]
# Marks of formulas.
LATEX_MARKERS = ["\\(", "\\[", "$$", "\\begin{equation}"]
MATH_KEYWORDS = ["equation", "=", "∫", "∑", "∂", "≈", "≤", "≥"]
# Phrases that make a message a core fact.
CORE_PHRASES = ["name is", "i am", "my name", "remember that", "don't forget"]

# What a sentence is, and how a tool call is tagged.
SENTENCE = r"[^.!?]+[.!?]+\s?|[^.!?]+$"
TOOL_CALL = r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


#: The characters of Unicode's White_Space property.
WHITE_SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trimmed(text: Column) -> Column:
    """Without white space of any script at either end (trim() alone strips U+0020)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def sentences(text: Column) -> Column:
    """Sentences of a text, as an array; a text without one is itself."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), trimmed), lambda x: x != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def token_estimate(text: Column) -> Column:
    """1.3 tokens a white-space word, rounded up; an empty text counts one word."""
    return F.ceil(F.size(F.split(text, r"(?U)\s+")) * F.lit(1.3)).cast("long")


def metadata_test(own: Column, low: Column, patterns: list[tuple[str, bool]] | None = None, phrases: list[str] | None = None) -> Column:
    """Whether a trimmed line (low: in lower case) is metadata. Patterns that begin a line share one anchor,
    so a long line isn't tried at each of its places; phrases are found as plain bytes."""
    shapes = [p if cased else f"(?i:{p})" for p, cased in (METADATA_PATTERNS if patterns is None else patterns)]
    first = [re.sub(r"^((?:\(\?i:)?)\^", r"\1", p) for p in shapes if re.match(r"(\(\?i:)?\^", p) and "|^" not in p]
    other = [p for p in shapes if not re.match(r"(\(\?i:)?\^", p) or "|^" in p]
    tests = [own.rlike("|".join(x)) for x in ([f"^(?:{'|'.join(first)})"] if first else [], other) if x]
    return (own != "") & any_of([*tests, *(low.contains(x.lower()) for x in (BOILERPLATE_PHRASES if phrases is None else phrases))])


def is_metadata_line(line: Column, patterns: list[tuple[str, bool]] | None = None, phrases: list[str] | None = None) -> Column:
    return metadata_test(trimmed(line), F.lower(line), patterns, phrases)


def without_metadata(text: Column, patterns: list[tuple[str, bool]] | None = None, phrases: list[str] | None = None) -> Column:
    """The text without its metadata lines; blank lines stay. Each line is trimmed once."""
    each = F.transform(F.split(text, "\n"), lambda line: F.struct(line.alias("line"), trimmed(line).alias("own"), F.lower(line).alias("low")))
    kept = F.filter(each, lambda x: ~metadata_test(x["own"], x["low"], patterns, phrases))
    return trimmed(F.array_join(kept["line"], "\n"))


def references(text: Column) -> Column:
    """array<struct<ref_type, ref_text>> of all patterns, in their order; a citation's target also
    counts as a direct reference."""

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("ref_type"), x.alias("ref_text")))

    return F.concat(*(found(kind, p) for kind, p in REFERENCE_PATTERNS))


def is_table(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(r"\|")) > 2) | trimmed(text).rlike(r"(?i)^Table\b")


def is_formula(text: Column) -> Column:
    hits = reduce(lambda a, b: a + b, (F.when(text.contains(k), 1).otherwise(0) for k in MATH_KEYWORDS))
    return any_of([text.contains(m) for m in LATEX_MARKERS]) | (hits >= 2)


def content_type(text: Column, item_type: Column | None = None) -> Column:
    """table, formula or text; a known item type decides first."""
    kind = F.lower(F.coalesce(item_type, F.lit("paragraph"))) if item_type is not None else F.lit("paragraph")
    return (
        F.when(kind == "table", "table")
        .when(kind.isin("math", "formula", "equation"), "formula")
        .when(is_table(text), "table")
        .when(is_formula(text), "formula")
        .otherwise("text")
    )


def table_caption(text: Column) -> Column:
    """A numbered caption, else the first line that isn't a row of cells, else ''."""
    caption = trimmed(F.regexp_extract(text, r"(?i)Table\s+\d+\.?\d*\s*:\s*[^\n|]+", 0))
    lines = F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: (x != "") & ~x.contains("|"))
    return F.when(caption != "", caption).otherwise(F.coalesce(F.get(lines, F.lit(0)), F.lit("")))


def is_figure_caption(text: Column, patterns: list[str] | None = None) -> Column:
    own = trimmed(text)
    named = any_of([own.rlike(f"(?i){p}") for p in (FIGURE_PATTERNS if patterns is None else patterns)])
    ratio = F.try_divide(F.regexp_count(text, F.lit(r"[\\=+\-_^{}\[\]$]")), F.length(text))
    return named | ((ratio < 0.05) & own.rlike("^[A-Z]") & any_of([F.lower(own).contains(w) for w in CAPTION_WORDS]))


def tool_calls(text: Column) -> Column:
    """array<struct<name, arguments>> of tagged calls (arguments as JSON text); broken JSON and calls
    without a name are left out."""
    bodies = F.regexp_extract_all(text, F.lit(TOOL_CALL), F.lit(1))
    parsed = F.transform(bodies, lambda x: F.struct(F.get_json_object(x, "$.name").alias("name"), F.coalesce(F.get_json_object(x, "$.arguments"), F.lit("{}")).alias("arguments")))
    return F.filter(parsed, lambda x: x["name"].isNotNull() & (x["name"] != ""))


def without_tool_calls(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"(?s)<tool_call>\s*.*?\s*</tool_call>", ""))


def native_arguments(arguments: Column) -> Column:
    """A native call's arguments as JSON text; what doesn't parse counts as none."""
    return F.coalesce(F.get_json_object(arguments, "$"), F.lit("{}"))


def is_core_fact(text: Column) -> Column:
    return any_of([F.lower(text).contains(x) for x in CORE_PHRASES])


def truncated(text: Column, most: int = 20_000) -> Column:
    """A workspace file's text as a prompt takes it."""
    # the mark is a fixed value
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit(f"\n\n[... truncated at {most} chars]")))


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, as an array."""
    return F.filter(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]+"), lambda x: x != "")


def word_set(text: Column) -> Column:
    """Distinct lower-case white-space tokens."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both), F.lit(0.0))
