"""Column functions: coercion, decoding, polarity, binning, display."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The nine characters a file name must not hold.
UNSAFE_NAME_CHARS = '<>:"/\\|?*'

# Topic keywords, first matching rule wins.
TOPIC_KEYWORDS = [
    ("UBI", ["ubi", "universal basic income"]),
    ("Penalty", ["penalty", "shootout"]),
    ("Weight Loss", ["ozempic", "weight loss"]),
]

# Age bin edges, left-closed and right-closed.
AGE_EDGES_LEFT = [18, 25, 35, 45, 55, 65, 200]
AGE_EDGES_RIGHT = [0, 35, 55, 100]


def tidy(text: Column) -> Column:
    """Trim; an empty string is null."""
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def not_nan(value: Column) -> Column:
    """NaN means missing, as null does."""
    return F.when(F.isnan(value), None).otherwise(value)


def lenient_int(text: Column) -> Column:
    """Read as a number, cut the fraction off; null when unreadable or beyond 64 bits. Exact, not by way of a double."""
    return tidy(text).try_cast("decimal(38,9)").try_cast("bigint")


def strict_int(text: Column) -> Column:
    """Only numbers without a fraction; null otherwise."""
    number = text.cast("string").try_cast("decimal(38,9)")
    return F.when(number == F.floor(number), number).try_cast("bigint")


def number(text: Column) -> Column:
    """Numeric coercion; null when unreadable."""
    return not_nan(text.cast("string").try_cast("double"))


def literal_map(mapping: dict) -> Column:
    parts = []
    for key, value in mapping.items():
        parts += [F.lit(key), F.lit(value)]
    return F.create_map(*parts)


def decode(code: Column, mapping: dict[int, str]) -> Column:
    """Code to label; an unknown code becomes its own text, null stays null."""
    as_int = lenient_int(code.cast("string"))
    return F.coalesce(F.try_element_at(literal_map(mapping), as_int), as_int.cast("string"))


def decode_or_keep(value: Column, mapping: dict[str, str]) -> Column:
    """Label by map; a value outside the map passes through."""
    return F.coalesce(F.try_element_at(literal_map(mapping), value), value)


def polarity(statement: Column, positive: list[str], negative: list[str]) -> Column:
    """+1 or -1 by wording; a wording in neither list stops the job."""
    return (
        F.when(statement.isin(positive), 1)
        .when(statement.isin(negative), -1)
        .otherwise(F.raise_error(F.concat(F.lit("unknown statement wording: "),
                                          F.coalesce(statement, F.lit("null")))).cast("int"))
    )


def topic_by_keyword(statement: Column, rules=TOPIC_KEYWORDS) -> Column:
    low = F.lower(statement)
    out = None
    for label, words in rules:
        hit = F.lit(False)
        for word in words:
            hit = hit | low.contains(word)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("Other")


def bins_left(value: Column, edges: list[int]) -> Column:
    """Left-closed bins, labelled 'a-b'; outside all bins is null."""
    out = F.lit(None).cast("string")
    for low, high in reversed(list(zip(edges, edges[1:]))):
        out = F.when((value >= low) & (value < high), f"{low}-{high - 1}").otherwise(out)
    return out


def bins_right(value: Column, edges: list[int]) -> Column:
    """Right-closed bins, labelled '(a,b]'; outside all bins is null."""
    out = F.lit(None).cast("string")
    for low, high in reversed(list(zip(edges, edges[1:]))):
        out = F.when((value > low) & (value <= high), f"({low},{high}]").otherwise(out)
    return out


def safe_name(text: Column) -> Column:
    """Each unsafe character becomes an underscore, ends trimmed."""
    swapped = F.translate(text, UNSAFE_NAME_CHARS, "_" * len(UNSAFE_NAME_CHARS))
    return F.regexp_replace(swapped, r"^\s+|\s+$", "")


def excerpt(text: Column, limit: int) -> Column:
    """Head and tail of a long text with the number of omitted characters between."""
    n = F.length(text)
    omitted = (n - 2 * limit).cast("string")
    cut = F.concat(
        F.substring(text, 1, limit), F.lit("\n\n...["), omitted,
        F.lit(" characters omitted]...\n\n"), F.right(text, F.lit(limit)),
    )
    return F.when(n <= 2 * limit, text).otherwise(cut)


def stars(p: Column) -> Column:
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*")
            .when(p.isNotNull(), "").otherwise(None))


def p_text(p: Column) -> Column:
    """Four decimals with a floor of 0.0001."""
    return F.when(p < 1e-4, "<0.0001").otherwise(F.format_string("%.4f", p))


def plain_number(value: Column) -> Column:
    """Four decimals, and no minus sign on a zero."""
    rounded = F.round(value, 4)
    return F.format_string("%.4f", F.when(rounded == 0, F.lit(0.0)).otherwise(rounded))


def trait_scores(items: list[Column], keys: dict) -> dict[str, Column]:
    """Trait name to score; `items` holds item 1 first."""
    return {
        trait: (a_sign * items[a - 1] + b_sign * items[b - 1]) / 2 + 3
        for trait, ((a_sign, a), (b_sign, b)) in keys.items()
    }


def sized(name: Column) -> Column:
    """The name; one that states no size stops the job, for neither family nor size can be read from it."""
    stop = F.raise_error(F.concat(F.lit("no size in the source name: "), F.coalesce(name, F.lit("null")))).cast("string")
    return F.when(F.coalesce(name.rlike(r"\d(?:\.\d+)?B"), F.lit(False)), name).otherwise(stop)


def size_fields(name: Column) -> dict[str, Column]:
    """Family, stated and active size (billions) as a source name states them.

    'fam-35B-A3B' stores 35 and uses 3; 'fam-E2B' states an effective size, so
    its total comes from a measured checkpoint; otherwise both are equal.
    """
    token = F.regexp_extract(name, r"(E?)(\d+(?:\.\d+)?)B", 0)
    effective = F.regexp_extract(name, r"(E?)(\d+(?:\.\d+)?)B", 1) == "E"
    stated = F.nullif(F.regexp_extract(name, r"(E?)(\d+(?:\.\d+)?)B", 2), F.lit("")).cast("double")
    active = F.nullif(F.regexp_extract(name, r"-A(\d+(?:\.\d+)?)B", 1), F.lit("")).cast("double")
    return {
        "family": F.regexp_extract(name, r"^(.+?)-E?\d+(?:\.\d+)?B(?:-|$)", 1),
        "has_size": token != "",
        "is_effective": effective,
        "stated_b": stated,
        "active_b": F.when(effective, stated).otherwise(F.coalesce(active, stated)),
    }


# A term that holds all of the first is called the second; the first rule that fits counts.
TERM_RULES = [
    (("initial_belief",), "Initial Belief"),
    (("familiarity",), "Familiarity"),
    (("topic", "Penalty"), "Topic: Penalty (vs UBI)"),
    (("topic", "Weight Loss"), "Topic: Weight Loss (vs UBI)"),
]


def term_parts(term: Column) -> tuple[Column, Column]:
    """Variable and level of 'C(variable)[T.level]', where both wrappings may be missing; no level is null."""
    head = F.substring_index(term, "[", 1)
    name = F.when(F.startswith(head, F.lit("C(")), F.substring_index(F.substr(head, F.lit(3)), ")", 1)).otherwise(
        F.substring_index(head, ")", 1))
    inside = F.substr(term, F.length(head) + 2, F.length(term) - F.length(head) - 2)
    marked = F.when(F.startswith(inside, F.lit("T.")), F.substr(inside, F.lit(3))).otherwise(inside)
    return name, F.when(F.contains(term, F.lit("[")) & F.endswith(term, F.lit("]")), F.trim(marked))


def term_label(term: Column, reference: dict[str, str], rules=TERM_RULES) -> Column:
    """Readable name of a regression term.

    A numbered level is 'Reference' (0) or 'Other'; a level such as 1.0 is no number here and keeps its text.
    """
    name, level = term_parts(term)
    against = F.coalesce(F.try_element_at(literal_map(reference), name), F.lit("reference"))
    numbered = F.when(level == "0", "Reference").otherwise(F.concat(F.lit("Other (vs "), against, F.lit(")")))
    named = F.concat(level, F.lit(" (vs "), against, F.lit(")"))
    shown = F.when(level.isNull(), F.replace(name, F.lit("_centered"))).otherwise(
        F.concat(name, F.lit(" = "), F.when(level.rlike(r"^\.?[0-9]+$"), numbered).otherwise(named)))
    for needles, label in reversed([(("Intercept",), "Intercept")] + list(rules)):
        holds = F.lit(True)
        for needle in needles:
            holds = holds & (term == needle if label == "Intercept" else
                             F.contains(F.lower(term) if needle.islower() else term, F.lit(needle)))
        shown = F.when(holds, label).otherwise(shown)
    return shown
