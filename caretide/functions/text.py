"""Column expressions over free text."""

from functools import reduce

from pyspark.sql import Column, functions as F

from caretide import settings as S
from caretide.functions.binding import let


def unicode_regex(pattern: str) -> str:
    """Character classes and word boundaries follow Unicode on every JDK."""
    return "(?U)" + pattern


def length_ok(text: Column) -> Column:
    return F.char_length(text).between(S.MIN_TEXT_CHARS, S.MAX_TEXT_CHARS)


def has_injection(text: Column) -> Column:
    return text.rlike("(?iU)(?:" + "|".join(S.INJECTION_PATTERNS) + ")")


def contains_any(lowered: Column, words: list[str]) -> Column:
    """Substring (not word) match against lower-cased text."""
    return reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])


def has_critical_keyword(text: Column) -> Column:
    return let(F.lower(text), lambda lowered: contains_any(lowered, S.CRITICAL_KEYWORDS))


def is_scanner_agent(user_agent: Column) -> Column:
    return user_agent.rlike("(?i)(" + "|".join(S.SCANNER_AGENTS) + ")")


def summary(text: Column) -> Column:
    return F.substring(text, 1, S.SUMMARY_CHARS)


def blank_to(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(default))


def retrieval_text(chief_complaint: Column, symptoms: Column) -> Column:
    """``complaint. Symptoms: a, b``; NULL when there is nothing to search for."""
    listed = F.array_join(F.transform(symptoms, lambda s: F.coalesce(s["description"], F.lit(""))), ", ")
    tail = let(listed, lambda t: F.when(t != "", F.concat(F.lit(". Symptoms: "), t)).otherwise(""))
    text = F.concat(F.coalesce(chief_complaint, F.lit("")), F.coalesce(tail, F.lit("")))
    return let(text, lambda t: F.when(F.trim(t) != "", t))


def embed_text(title: Column, content: Column, separator: str = ". ") -> Column:
    return F.concat(title, F.lit(separator), content)
