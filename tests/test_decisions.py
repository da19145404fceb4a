import pytest
from pyspark.sql import functions as F

from caretide import settings as S
from caretide.functions import decisions as D


@pytest.mark.parametrize(
    "text,category,confidence,tier,reason,override",
    [
        ("Severe CHEST PAIN now", "routine_vitals", 0.99, 2, "Critical keyword safety override", True),
        ("Patient has mild headache", "routine_vitals", 0.95, 0, None, False),
        ("Patient reports headache", "symptom_assessment", 0.90, 1, None, False),
        ("Something unusual", "unknown_category", 0.90, 1, "Unknown category fallback", False),
        ("Routine check", "routine_vitals", 0.60, 1, "Confidence 0.60 below threshold 0.65", False),
        ("Patient reports symptoms", "symptom_assessment", 0.50, 2, "Confidence 0.50 below threshold 0.55", False),
        ("Patient in distress", "critical_emergency", 0.40, 2, None, False),
        ("no keyword", "chronic_management", 0.65, 1, None, False),
        ("no keyword", "chronic_management", 0.595, 1, f"Confidence {0.595:.2f} below threshold 0.6", False),
    ],
)
def test_route(spark, text, category, confidence, tier, reason, override):
    df = spark.createDataFrame([(text, category, confidence)], "t string, c string, x double")
    row = df.select(D.route(F.col("t"), F.col("c"), F.col("x")).alias("r")).first()["r"]
    assert (row["selected_model"], row["escalation_reason"], row["safety_override"]) == (S.MODEL_TIERS[tier], reason, override)


def test_every_keyword_and_category(spark):
    words = spark.createDataFrame([(w.title(),) for w in S.CRITICAL_KEYWORDS], "t string")
    assert words.select(D.route(F.col("t"), F.lit("routine_vitals"), F.lit(0.99))["safety_override"].alias("o")).filter("o").count() == 12
    cats = spark.createDataFrame([(c,) for c in S.CATEGORY_ROUTING], "c string")
    got = dict(cats.select("c", D.route(F.lit("x"), F.col("c"), F.lit(0.95))["selected_model"]).collect())
    assert got == {c: S.MODEL_TIERS[r[0]] for c, r in S.CATEGORY_ROUTING.items()}


@pytest.mark.parametrize(
    "h,c,v,m,tripped,reasons",
    [
        (0.05, 0.90, True, True, False, 0),
        (0.30, 0.90, True, True, True, 1),
        (0.05, 0.60, True, True, True, 1),
        (0.15, 0.85, True, True, False, 0),
        (0.05, 0.90, False, False, False, 2),
    ],
)
def test_breaker(spark, h, c, v, m, tripped, reasons):
    check = D.safety_check(F.lit(h), F.lit(c), F.lit(v), F.lit(m), F.lit(False))
    row = spark.range(1).select(check.alias("s")).first()["s"]
    assert (row["circuit_breaker_tripped"], row["passed"], len(row["failure_reasons"])) == (tripped, not tripped, reasons)


def test_cost(spark):
    cost = D.call_cost(F.lit(S.MIDDLE_TIER), F.lit(1250), F.lit(480))
    other = D.call_cost(F.lit("unknown"), F.lit(1250), F.lit(480))
    assert list(spark.range(1).select(cost, other).first()) == [0.01095, 0.0]


@pytest.mark.parametrize(
    "count,direction,flag",
    [
        (50, "output", "OK"), (3, "output", "SUSPICIOUSLY_SHORT"), (99_999, "output", "SUSPICIOUSLY_LONG"), (100, "input", "OK"),
        (1, "input", "SUSPICIOUSLY_SHORT"), (10, "output", "OK"), (9, "output", "SUSPICIOUSLY_SHORT"), (8192, "output", "OK"),
        (8193, "output", "SUSPICIOUSLY_LONG"), (5, "input", "OK"), (50_000, "input", "OK"), (50_001, "input", "SUSPICIOUSLY_LONG"),
    ],
)
def test_token_guard(spark, count, direction, flag):
    row = spark.range(1).select(D.token_guard(F.lit(count), direction).alias("g")).first()["g"]
    assert row["flag"] == f"TOKEN_{direction.upper()}_{flag}"
    assert (row["error"] is None) == (flag == "OK")


def test_misroute(spark):
    rows = [("a", "b", True), ("a", "a", False), ("a", "", False), ("a", None, False), (None, "b", True), ("", "b", True)]
    df = spark.createDataFrame([r[:2] for r in rows], "o string, c string")
    assert [r[0] for r in df.select(D.is_misroute(F.col("o"), F.col("c"))).collect()] == [r[2] for r in rows]


def test_escalation_and_cause(spark):
    ages = [0, 3600, 3601, 40_000, 86_400, 86_401]
    df = spark.createDataFrame([(float(a),) for a in ages], "a double")
    got = [r[0] for r in df.select(D.escalation_stage(F.col("a"))).collect()]
    stages = [s for _, s in S.ESCALATION_STAGES]
    assert got == [stages[0], stages[0], stages[1], stages[2], stages[3], S.ESCALATION_BREACH]
    causes = [
        (503, None, "consumer_down"), (400, None, "invalid_payload"), (None, "Missing encounter_id in audit event", "invalid_payload"),
        (200, "Quota exceeded", "write_failure"), (403, None, "authentication"), (None, "DNS resolution failure", "network"), (None, "?", "unknown"),
    ]
    df = spark.createDataFrame([c[:2] for c in causes], "s int, m string")
    assert [r[0] for r in df.select(D.dlq_root_cause(F.col("s"), F.col("m"))).collect()] == [c[2] for c in causes]


def test_vitals_contradiction(spark):
    df = spark.createDataFrame([("Non-Urgent", "190/100"), ("Urgent", "190/100"), ("Non-Urgent", "120/80"), ("Non-Urgent", "n/a"), ("Non-Urgent", None)], "l string, b string")
    assert [r[0] for r in df.select(D.vitals_contradiction(F.col("l"), F.col("b"))).collect()] == [True, False, False, False, False]
