"""Masking of personal and health identifiers. Native expressions only: map-side, no shuffle."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from caretide import settings as S
from caretide.functions.text import unicode_regex

REDACTIONS = "array<struct<type:string,count:int>>"

# Cheap tests a match cannot do without. A word boundary is slow to test at every character, so patterns that can
# only begin with certain characters look for those first; patterns with a literal word run only where it occurs.
_BEGINS = {"SSN": r"\d", "PHONE": r"[+(\d]"}
_NEEDS = {
    "MRN": ["MRN", "mrn"],
    "EMAIL": ["@"],
    "DOB": ["DOB", "dob", "Date of Birth", "date of birth"],
    "PATIENT_NAME": ["atient", "Pt", "pt"],
    "PROVIDER_NAME": ["Dr", "MD", "NP", "PA", "RN"],
}


def _regex(name: str, pattern: str) -> Column:
    ahead = f"(?={_BEGINS[name]})" if name in _BEGINS else ""
    return F.lit(unicode_regex(ahead + pattern))


def _hits(text: Column, name: str, pattern: str) -> Column:
    hits = F.regexp_count(text, _regex(name, pattern))
    if name in _NEEDS and "(?i)" not in pattern:
        possible = reduce(lambda a, b: a | b, [text.contains(w) for w in _NEEDS[name]])
        hits = F.when(possible, hits)
    return F.coalesce(hits, F.lit(0))


def mask(df: DataFrame, column: str, patterns: list[tuple[str, str]], tag: str, prefix: str) -> DataFrame:
    """Adds ``{prefix}text`` and one count ``{prefix}n_<TYPE>`` per pattern.

    Each pattern sees the text already masked by the ones before it. The replacement runs only where
    something was found, so clean rows pay one scan per pattern.
    """
    text, steps = F.col(column), []
    for name, pattern in patterns:
        n, masked = f"{prefix}n_{name}", f"__{prefix}{name}"
        df = df.withColumn(n, _hits(text, name, pattern))
        replaced = F.regexp_replace(text, _regex(name, pattern), F.lit(tag))
        df = df.withColumn(masked, F.when(F.col(n) > 0, replaced).otherwise(text))
        text = F.col(masked)
        steps.append(masked)
    return df.withColumn(f"{prefix}text", text).drop(*steps)


def _with_lists(df: DataFrame, patterns: list[tuple[str, str]], prefix: str, flag: str, clean: str, first: list[str]) -> DataFrame:
    """Counts folded into ``{prefix}redactions`` and ``{prefix}flags``."""
    counts = [(name, F.col(f"{prefix}n_{name}")) for name, _ in patterns]
    any_found = reduce(lambda a, b: a | b, [n > 0 for _, n in counts])
    found = F.array(*[F.when(n > 0, F.struct(F.lit(name).alias("type"), n.alias("count"))) for name, n in counts])
    flags = F.array(*[F.lit(f) for f in first], *[F.when(n > 0, F.lit(flag + name)) for name, n in counts])
    return df.withColumns(
        {
            f"{prefix}redactions": F.array_compact(found).cast(REDACTIONS),
            f"{prefix}flags": F.when(any_found, F.array_compact(flags)).otherwise(F.array(F.lit(clean))),
        }
    ).drop(*[f"{prefix}n_{name}" for name, _ in patterns])


def scan_pii(df: DataFrame, column: str, any_case: bool = False, prefix: str = "pii_") -> DataFrame:
    """Adds ``pii_text``, ``pii_redactions``, ``pii_flags``."""
    patterns = S.PII_PATTERNS_ANY_CASE if any_case else S.PII_PATTERNS
    return _with_lists(mask(df, column, patterns, S.PII_TAG, prefix), patterns, prefix, "PII_MASKED_", "PII_CLEAN", [])


def strip_phi(df: DataFrame, column: str, prefix: str = "phi_") -> DataFrame:
    """Adds ``phi_text``, ``phi_redactions``, ``phi_flags``."""
    masked = mask(df, column, S.PHI_PATTERNS, S.PHI_TAG, prefix)
    return _with_lists(masked, S.PHI_PATTERNS, prefix, "PHI_STRIPPED_", "PHI_CLEAN", ["PHI_REDACTED"])


def redaction_summary(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Occurrences and texts per group and redaction type.

    Counts are summed as columns in one partial aggregation; only the group totals are turned into rows,
    so no row per match is ever made.
    """
    counted = mask(df, column, S.PII_PATTERNS, S.PII_TAG, "__")
    names = [name for name, _ in S.PII_PATTERNS]
    sums = [F.sum(f"__n_{n}").alias(f"m_{n}") for n in names] + [F.count_if(F.col(f"__n_{n}") > 0).alias(f"t_{n}") for n in names]
    totals = counted.groupBy(*by).agg(*sums)
    rows = F.array(
        *[F.struct(F.lit(n).alias("type"), F.col(f"m_{n}").alias("n_matches"), F.col(f"t_{n}").alias("n_texts")) for n in names]
    )
    return totals.select(*by, F.explode(rows).alias("r")).select(*by, "r.*").filter("n_texts > 0")
