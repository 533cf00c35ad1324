"""String expressions: raw-field parsing, identity hashes, display text. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values -------------------------------------------------------------------------
NULL_WORDS = ["", "na", "n/a", "null", "none", "-", "--", "---", "nan"]
CONTROL_CHARACTERS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
PROGRAM_PATTERN = r"(?i)^(.+?)\s*\((\d+)\s*Years?,\s*(.+?)\)$"
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# keyword -> desirability; the first keyword found in the programme name decides
BRANCH_DESIRABILITY = [
    ("computer science", 1.00),
    ("artificial intelligence", 0.98),
    ("machine learning", 0.96),
    ("data science", 0.95),
    ("mathematics and computing", 0.94),
    ("electronics and communication", 0.88),
    ("electronics", 0.84),
    ("electrical", 0.78),
    ("information technology", 0.86),
    ("mechanical", 0.64),
    ("chemical", 0.58),
    ("civil", 0.52),
    ("metallurgical", 0.48),
    ("mining", 0.44),
]
BRANCH_DEFAULT = 0.55
IDENTITY_FIELDS = [
    "institute", "institute_type", "program", "quota", "category", "gender", "is_pwd", "round",
]


def _case(pairs, default) -> Column:
    """when/otherwise chain from (condition, value) pairs, first hit wins."""
    chain = None
    for condition, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def null_words_to_null(c: Column) -> Column:
    # a constant array keeps the generated code short when many columns are cleaned at once
    return F.when(F.array_contains(F.lit(NULL_WORDS), F.lower(F.trim(c))), F.lit(None)).otherwise(c)


def rank_text(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit(","), F.lit(""))


def rank_has_suffix(text: Column) -> Column:
    """True for ranks of the preparatory kind, written as digits followed by P."""
    return F.coalesce(text.rlike(r"(?i)^\d+P$"), F.lit(False))


def rank_number(text: Column) -> Column:
    """Number of a rank text: the digits before a P suffix, or any plain number; else NULL.

    One chain that names its input once: the optimizer copies it into filters.
    """
    bare = F.regexp_replace(text, r"(?i)^(\d+)P$", "$1")
    return F.regexp_extract(bare, PLAIN_NUMBER, 0).try_cast("double")


def cut_to_whole(number: Column) -> Column:
    """Towards zero; NULL stays NULL and numbers too large for a rank become NULL."""
    return number.try_cast("bigint")


def institute_type(name: Column, accept_abbreviation: bool = True) -> Column:
    n = F.upper(name)
    third = n.contains("INDIAN INSTITUTE OF INFORMATION TECHNOLOGY")
    if accept_abbreviation:
        third = third | n.contains("IIIT")
    return _case(
        [
            (n.contains("INDIAN INSTITUTE OF TECHNOLOGY"), "IIT"),
            (n.contains("NATIONAL INSTITUTE OF TECHNOLOGY"), "NIT"),
            (third, "IIIT"),
        ],
        "GFTI",
    )


def _seat(c: Column) -> Column:
    return F.upper(F.trim(c))


def seat_is_pwd(c: Column) -> Column:
    return F.coalesce(_seat(c).rlike(r"\(PWD\)|(^|\s)PWD(\s|$)"), F.lit(False))


def seat_base(c: Column) -> Column:
    """Seat type without its PwD marker."""
    return F.trim(F.regexp_replace(_seat(c), r"\s*\(?\s*PWD\s*\)?\s*", ""))


def seat_category(base: Column) -> Column:
    return _case(
        [
            (base.startswith("OPEN") | base.startswith("GEN"), "OPEN"),
            (base.startswith("OBC"), "OBC-NCL"),
            (base.startswith("SC"), "SC"),
            (base.startswith("ST"), "ST"),
            (base.startswith("EWS"), "EWS"),
        ],
        "OPEN",
    )


def seat_is_defence(c: Column) -> Column:
    s = F.upper(c)
    return F.coalesce(s.contains("DEFENCE") | s.contains("DS"), F.lit(False))


def gender_label(c: Column) -> Column:
    return F.when(F.lower(c).contains("female"), "Female-only").otherwise("Gender-Neutral")


def quota_label(c: Column) -> Column:
    q = F.upper(F.trim(c))
    return (
        F.when(q.isNull() | (q == ""), "AI").when(q.isin("AI", "HS", "OS"), q).otherwise("STATE")
    )


def quota_home_or_all_india(c: Column) -> Column:
    return F.when(c == "HS", "HS").otherwise("AI")


def program_parts(c: Column) -> dict[str, Column]:
    """programme text -> cleaned name, discipline, duration in years, degree."""
    raw = F.trim(c)
    hit = raw.rlike(PROGRAM_PATTERN)
    name = F.when(hit, F.trim(F.regexp_extract(raw, PROGRAM_PATTERN, 1))).otherwise(raw)
    return {
        "program": F.coalesce(name, F.lit("")),
        "discipline": name,
        "duration_years": F.when(
            hit, F.regexp_extract(raw, PROGRAM_PATTERN, 2).try_cast("bigint")
        ),
        "degree_type": F.when(hit, F.trim(F.regexp_extract(raw, PROGRAM_PATTERN, 3))),
    }


def branch_score(program: Column) -> Column:
    p = F.lower(program)
    return _case([(p.contains(k), v) for k, v in BRANCH_DESIRABILITY], BRANCH_DEFAULT)


def stable_choice_id(fields=None) -> Column:
    """Order-independent id of a seat pool: 24 hex digits of a SHA-256 over folded fields."""
    parts = [
        F.lower(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))))
        for f in (fields or IDENTITY_FIELDS)
    ]
    return F.concat(
        F.lit("choice-"), F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 24)
    )


def fingerprint(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, length)


def clean_text(c: Column, limit: int = 500) -> Column:
    spaced = F.regexp_replace(c, CONTROL_CHARACTERS, " ")
    return F.substring(F.trim(F.regexp_replace(spaced, r"\s+", " ")), 1, limit)


def excerpt(c: Column, limit: int = 300) -> Column:
    tidy = F.trim(F.regexp_replace(F.regexp_replace(c, CONTROL_CHARACTERS, " "), r"\s+", " "))
    return F.when(
        F.length(tidy) > limit, F.concat(F.substring(tidy, 1, limit), F.lit("..."))
    ).otherwise(tidy)


def xml_text(c: Column, limit: int) -> Column:
    """Trimmed, cut, with & < > escaped (ampersand first)."""
    spaced = F.regexp_replace(c, CONTROL_CHARACTERS, " ")
    cut = F.substring(F.regexp_replace(spaced, r"^\s+|\s+$", ""), 1, limit)
    out = F.replace(cut, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def display_name(institute: Column, program: Column) -> Column:
    return F.when(
        institute.isNull() & program.isNull(), F.lit("—")
    ).otherwise(F.concat_ws(" — ", institute, program))


def contains_ignoring_case(haystack: Column, needle: Column) -> Column:
    """Literal (not pattern) substring test; NULL text counts as no match."""
    return F.coalesce(F.contains(F.lower(haystack), F.lower(needle)), F.lit(False))


def thousands(c: Column) -> Column:
    return F.format_number(c.cast("bigint"), 0)


def percent_text(probability: Column) -> Column:
    """Probability as percent with one decimal, e.g. 87.5."""
    return F.format_string("%.1f", F.bround(probability * 100, 1))


def explanation(
    institute: Column, program: Column, predicted: Column, rank: Column,
    probability: Column, label: Column,
) -> Column:
    """One deterministic sentence per scored choice, picked by label and margin sign."""
    margin = predicted - rank
    name = F.concat_ws(" — ", institute, program)
    cut, gap, pct = thousands(predicted), thousands(F.abs(margin)), percent_text(probability)
    safe = F.concat(
        name, F.lit(" is a Safe choice. The predicted closing rank ("), cut, F.lit(") is "), gap,
        F.lit(" places beyond your rank; the model's uncalibrated admission-likelihood estimate is "),
        pct, F.lit("% based on simulated closing cutoffs, not individual outcomes."),
    )
    moderate_in = F.concat(
        name, F.lit(" is a Moderate choice. Your rank is within "), gap,
        F.lit(" ranks of the predicted cutoff ("), cut,
        F.lit("), and the model's uncalibrated admission-likelihood estimate is "), pct,
        F.lit("% from simulated closing cutoffs; the actual cutoff remains uncertain."),
    )
    moderate_out = F.concat(
        name, F.lit(" is a Moderate choice. Your rank is "), gap,
        F.lit(" places outside the predicted cutoff ("), cut,
        F.lit("); the model's uncalibrated admission-likelihood estimate is "), pct,
        F.lit("% from simulated closing cutoffs, not individual outcomes."),
    )
    ambitious = F.concat(
        name, F.lit(" is an Ambitious reach. The predicted cutoff ("), cut, F.lit(") is "), gap,
        F.lit(" ranks tighter than your rank; the model's uncalibrated admission-likelihood estimate is "),
        pct, F.lit("% from simulated closing cutoffs, not an individual admission probability."),
    )
    return (
        F.when(label == "Safe", safe)
        .when((label == "Moderate") & (margin > 0), moderate_in)
        .when(label == "Moderate", moderate_out)
        .otherwise(ambitious)
    )
