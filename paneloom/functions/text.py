"""Prompt blocks and free-text pattern columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Demographic fields in the order a profile lists them.
PROFILE_ORDER = [
    "age_raw", "age", "gender_raw", "gender", "ethnicity_raw", "ethnicity",
    "country_of_residency_code", "country_of_residency", "country_of_origin_code",
    "country_of_origin", "student_status_raw", "student_status", "employment_status_raw",
    "employment_status", "occupation_field", "highest_qualification_raw",
    "highest_qualification",
]

# Personal-data patterns, strongest first. Unicode classes throughout.
PII_PATTERNS = [
    ("email", r"(?U)\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b"),
    ("phone", r"(?U)(?<!\d)(?:\+?\d[\d\s().-]{8,}\d)(?!\d)"),
    ("url", r"(?U)https?://\S+|www\.\S+"),
    ("social_handle", r"(?U)(?<![\w@])@[A-Za-z][\w.]{2,}\b"),
    ("uk_postcode", r"(?U)\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b"),
    ("uk_nino", r"(?U)\b[A-CEGHJ-PR-TW-Z]{2}\d{6}[A-D]\b"),
    ("long_digit_run", r"(?U)(?<!\d)\d{9,}(?!\d)"),
    ("date_of_birth", r"(?iU)\b(?:born|dob|date of birth)\b[^.\n]{0,30}\d{4}"),
    ("self_names_me", r"(?iU)\b(?:my name is|i am called|call me|i'm called)\b"),
    ("names_employer", r"(?iU)\b(?:i work (?:at|for)|my employer|my company|my boss)\b"),
    ("names_location", r"(?iU)\b(?:i live in|i'm from|i am from|my address|my postcode)\b"),
    ("prolific_mention", r"(?iU)\bprolific\b"),
]

# What a text must hold for a pattern to match at all: tests that are cheap, made once per text, and shared by patterns.
_HINTS = [
    (("email", "social_handle"), lambda text: text.contains("@")),
    (("phone", "uk_postcode", "uk_nino", "long_digit_run"), lambda text: text.rlike(r"(?U)\d")),
    (("url",), lambda text: text.contains("://") | text.contains("www.")),
    (("date_of_birth",), lambda text: text.rlike(r"(?iU)\b(?:born|dob|date of birth)\b")),
    (("self_names_me", "names_employer", "names_location", "prolific_mention"),
     lambda text: text.rlike(r"(?iU)\b(?:my (?:[naepcb])|i(?:'m| am| work| live) |call me|prolific)")),
]


def pattern_hints(text: Column) -> Column:
    """A bit per hint that the text gives; without its bit no pattern of a hint can match."""
    return sum([F.when(test(text), 1 << i).otherwise(0) for i, (_, test) in enumerate(_HINTS)], F.lit(0))


def pattern_found(text: Column, hints: Column, name: str, pattern: str) -> Column:
    """Whether a pattern matches; its expression runs only on texts whose hints allow it."""
    bits = sum(1 << i for i, (names, _) in enumerate(_HINTS) if name in names)
    return (hints.bitwiseAND(bits) != 0) & text.rlike(pattern) if bits else text.rlike(pattern)


def profile_block(fields: dict[str, Column]) -> Column:
    """'name: value' lines, known names first in their fixed order, the rest sorted."""
    known = [n for n in PROFILE_ORDER if n in fields]
    rest = sorted(n for n in fields if n not in PROFILE_ORDER)
    lines = [F.concat(F.lit(f"{n}: "), F.coalesce(fields[n].cast("string"), F.lit("None")))
             for n in known + rest]
    return F.concat_ws("\n", *lines) if lines else F.lit("No demographic data provided.")


def personality_block(items: Column) -> Column:
    """'key: value' lines by the number at the end of the key; keys without one go last."""
    def place(entry):
        found = F.regexp_extract(entry["key"], r"big(\d+)$", 1)
        return F.coalesce(F.nullif(found, F.lit("")).cast("int"), F.lit(999))

    ordered = F.array_sort(F.transform(
        F.map_entries(items),
        lambda e: F.struct(place(e).alias("place"), e["key"].alias("key"), e["value"].alias("value"))))
    lines = F.transform(ordered, lambda e: F.concat(
        e["key"], F.lit(": "), F.coalesce(e["value"].cast("string"), F.lit("None"))))
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, "No personality data provided.").otherwise(
        F.array_join(lines, "\n"))


def comments_block(messages: Column) -> Column:
    """Numbered comments from an array of message structs."""
    return F.array_join(F.transform(messages, lambda m: F.concat(
        F.lit("Comment "), m["shown_comment_id"].cast("string"), F.lit(":\n"),
        F.trim(F.coalesce(m["text"], F.lit(""))))), "\n\n")


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Fill every {name} in one pass, so braces inside a value are never filled again."""
    pairs = []
    for name, value in values.items():
        pairs += [F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("None"))]
    filled = F.create_map(*pairs)
    pieces = F.split(template, r"(?=\{[a-z0-9_]+\})|(?<=\})")
    return F.array_join(
        F.transform(pieces, lambda p: F.coalesce(F.try_element_at(filled, p), p)), "")


def redacted_hit(text: Column, pattern: str, width: int = 55) -> Column:
    """The first hit masked, with up to `width` characters of context on each side."""
    start = F.regexp_instr(text, F.lit(pattern))
    hit = F.regexp_substr(text, F.lit(pattern))
    size = F.length(hit)
    left_from = F.greatest(F.lit(1), start - width)
    left = F.replace(text.substr(left_from, start - left_from), F.lit("\n"), F.lit(" "))
    right = F.replace(text.substr(start + size, F.lit(width)), F.lit("\n"), F.lit(" "))
    masked = F.when(size > 4, F.concat(
        F.substring(hit, 1, 2), F.repeat(F.lit("*"), F.greatest(F.lit(0), size - 3)), F.right(hit, F.lit(1)))
    ).otherwise("***")
    return F.when(hit.isNotNull(), F.concat(
        F.lit("..."), left, F.lit("["), masked, F.lit("]"), right, F.lit("...")))
