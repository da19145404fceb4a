"""Report labels: confidence, cost, duration, model family, colour bands, reasoning text."""

from pyspark.sql import Column, functions as F

from caretide import settings as S
from caretide.functions.numbers import fixed


def confidence_label(value: Column) -> Column:
    return F.concat(fixed(value * 100, 0, ties="up"), F.lit("%"))


def cost_label(usd: Column) -> Column:
    return F.concat(F.lit("$"), F.when(usd < 0.01, fixed(usd, 5, ties="up")).otherwise(fixed(usd, 4, ties="up")))


def duration_label(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(fixed(ms, 0, ties="up"), F.lit("ms"))).otherwise(
        F.concat(fixed(ms / 1000, 1, ties="up"), F.lit("s"))
    )


def date_label(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, hh:mm a")


def model_family(model: Column) -> Column:
    return (
        F.when(model.contains("opus"), "Opus")
        .when(model.contains("sonnet"), "Sonnet")
        .when(model.contains("haiku"), "Haiku")
        .otherwise(model)
    )


def level_band(level: Column) -> Column:
    bands = ["red", "orange", "yellow", "green"]
    out = F
    for name, colour in zip(S.TRIAGE_LEVELS, bands):
        out = out.when(level == name, colour)
    return out.otherwise("gray")


def confidence_band(value: Column) -> Column:
    return F.when(value >= 0.85, "green").when(value >= 0.70, "yellow").when(value.isNotNull(), "red")


def status_band(status: Column) -> Column:
    return F.when(status == "pending", "yellow").when(status == "approved", "green").when(status == "rejected", "red")


def category_label(category: Column) -> Column:
    return F.replace(category, F.lit("_"), F.lit(" "))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").otherwise("No")


def joined(items: Column, separator: str = ", ") -> Column:
    return F.array_join(F.coalesce(items, F.array().cast("array<string>")), separator)


def symptom_list(symptoms: Column) -> Column:
    return joined(F.transform(symptoms, lambda s: F.coalesce(s["description"], F.lit(""))))


def medication_list(medications: Column) -> Column:
    """``name dose`` pairs; a missing dose prints nothing. ``None`` when there are no medications."""
    text = joined(F.transform(medications, lambda m: F.concat_ws(" ", m["name"], m["dose"])))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("None"))
