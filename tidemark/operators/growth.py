"""Customer analytics: roles, RFM, cohorts, lifetime value, churn and unit economics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.dates import whole_days
from tidemark.functions.fixed_values import CHURN_TIERS, ROLE_TOKENS, SEGMENT_NOTES
from tidemark.functions.numbers import is_numeric, number
from tidemark.operators.ranks import score_cuts
from tidemark.operators.selection import rows_after
from tidemark.session import literal_rows


def detect_roles(df: DataFrame) -> dict[str, str | None]:
    """The first column whose name holds a token of each role; amounts must be numeric."""
    numeric_roles = {"monetary", "quantity"}
    return {
        role: next(
            (
                c
                for c in df.columns
                if any(token in c.lower() for token in tokens)
                and (role not in numeric_roles or is_numeric(df, c))
            ),
            None,
        )
        for role, tokens in ROLE_TOKENS.items()
    }


def role_columns(df: DataFrame) -> DataFrame:
    """(role, column, filled): the columns found for each role, and how many cells they fill."""
    found = {role: c for role, c in detect_roles(df).items() if c}
    if not found:
        return df.sparkSession.createDataFrame([], "role string, column string, filled long")
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(role) for role, c in found.items()])
    records = [
        F.struct(
            F.lit(role).alias("role"), F.lit(c).alias("column"), F.col(role).alias("filled")
        )
        for role, c in found.items()
    ]
    return counts.select(F.inline(F.array(*records)))


def _purchases(df: DataFrame, customer: str, date: str, amount: str) -> DataFrame:
    return df.select(
        F.col(f"`{customer}`").alias("customer"),
        F.col(f"`{date}`").alias("at"),
        number(df, amount).alias("amount"),
    ).dropna()


def _as_of(purchases: DataFrame) -> DataFrame:
    """One row: the day after the last purchase."""
    return purchases.agg((F.max("at") + F.expr("INTERVAL 1 DAY")).alias("as_of"))


def segment_of(r: Column, f: Column, m: Column) -> Column:
    """Segment name of an RFM score triple; the first rule that holds decides."""
    rules = [
        ("Champions", (r >= 4) & (f >= 4) & (m >= 4)),
        ("Loyal Customers", (r >= 3) & (f >= 3) & (m >= 3)),
        ("Potential Loyalists", (r >= 4) & (f <= 3) & (m >= 2)),
        ("New Customers", (r >= 4) & (f == 1)),
        ("Promising", (r >= 3) & (f <= 2) & (m <= 2)),
        ("Need Attention", (r == 3) & (f >= 2)),
        ("At Risk", (r <= 2) & (f >= 3)),
        ("Can't Lose Them", (r <= 2) & (f <= 2) & (m >= 3)),
        ("Hibernating", (r <= 2) & (f <= 2) & (m <= 2)),
    ]
    ladder = F
    for name, hit in rules:
        ladder = ladder.when(hit, name)
    return ladder.otherwise("Lost")


def _note(segment: Column, part: int) -> Column:
    ladder = F
    for name, notes in SEGMENT_NOTES.items():
        ladder = ladder.when(segment == name, notes[part])
    return ladder


def rfm_scores(df: DataFrame, customer: str, date: str, amount: str) -> DataFrame:
    """Per customer: recency_days, frequency, monetary and their 1-5 scores.

    A customer's rank breaks ties by customer key. Spend is rounded before it is ranked, so the
    order of a floating-point sum cannot change a score between runs. The customers at the cuts of
    all three orders are found by counting, in passes they share; nobody is sorted.
    """
    purchases = _purchases(df, customer, date, amount)
    people = (
        purchases.groupBy("customer")
        .agg(
            F.max("at").alias("_last"),
            F.count(F.lit(1)).alias("frequency"),
            F.round(F.sum("amount"), 2).alias("monetary"),
        )
        .crossJoin(F.broadcast(_as_of(purchases)))
        .select(
            "customer",
            whole_days(F.col("_last"), F.col("as_of")).alias("recency_days"),
            "frequency",
            "monetary",
        )
    )
    orders = {
        "r_score": [("recency_days", True), "customer"],
        "f_score": ["frequency", "customer"],
        "m_score": ["monetary", "customer"],
    }
    _, cuts = rows_after(people, orders, score_cuts)
    scores = [
        sum((after.cast("int") for after in conditions), F.lit(1)).alias(score)
        for score, conditions in cuts.items()
    ]
    return people.select("*", *scores)


def rfm_segments(scores: DataFrame) -> DataFrame:
    """Scores with rfm_score, segment, tier and recommended action."""
    named = scores.withColumn(
        "segment", segment_of(F.col("r_score"), F.col("f_score"), F.col("m_score"))
    )
    return named.select(
        "*",
        F.concat(*[F.col(c).cast("string") for c in ("r_score", "f_score", "m_score")]).alias(
            "rfm_score"
        ),
        _note(F.col("segment"), 0).alias("tier"),
        _note(F.col("segment"), 1).alias("action"),
    )


def rfm_summary(segments: DataFrame) -> DataFrame:
    """Per segment: customers, revenue, their shares, and averages; largest revenue first."""
    grouped = segments.groupBy("segment").agg(
        F.first("tier").alias("tier"),
        F.count(F.lit(1)).alias("customers"),
        F.sum("monetary").alias("revenue"),
        F.avg("monetary").alias("avg_monetary"),
        F.avg("frequency").alias("avg_frequency"),
        F.avg("recency_days").alias("avg_recency_days"),
    )
    every = Window.partitionBy()  # one row per segment name, so ten at most
    people = F.sum("customers").over(every)
    money = F.greatest(F.sum("revenue").over(every), F.lit(1e-4))
    return grouped.select(
        "segment",
        "tier",
        "customers",
        F.round(F.col("customers") / people * 100, 1).alias("customer_share_pct"),
        F.round("revenue", 2).alias("revenue"),
        F.round(F.col("revenue") / money * 100, 1).alias("revenue_share_pct"),
        F.round("avg_monetary", 2).alias("avg_monetary"),
        F.round("avg_frequency", 1).alias("avg_frequency"),
        F.round("avg_recency_days", 0).alias("avg_recency_days"),
    ).orderBy(F.desc("revenue"), F.asc("segment"))


def rfm_totals(summary: DataFrame) -> DataFrame:
    """One row: customers, revenue, value per customer, champions' share, revenue at risk."""
    at_risk = F.col("segment").isin("At Risk", "Can't Lose Them")
    champions = F.when(F.col("segment") == "Champions", F.col("revenue_share_pct"))
    people, money = F.sum("customers"), F.sum("revenue")
    return summary.agg(
        people.alias("total_customers"),
        F.round(money, 2).alias("total_revenue"),
        F.round(money / F.greatest(people, F.lit(1)), 2).alias("avg_customer_value"),
        F.coalesce(F.max(champions), F.lit(0.0)).alias("champions_share_pct"),
        F.round(F.coalesce(F.sum(F.when(at_risk, F.col("revenue"))), F.lit(0.0)), 2).alias(
            "at_risk_revenue"
        ),
    )


def cohort_counts(df: DataFrame, customer: str, date: str) -> DataFrame:
    """(cohort, period, customers): active customers by first month and months since.

    Rows collapse to one per customer and month before anything is grouped by customer alone, so a
    customer with a third of the rows still brings only its months.
    """
    active = df.select(
        F.col(f"`{customer}`").alias("customer"),
        F.trunc(F.to_date(F.col(f"`{date}`")), "month").alias("month"),
    ).dropna()
    months = active.distinct()
    first = F.min("month").over(Window.partitionBy("customer"))
    aged = months.select("customer", "month", first.alias("cohort"))
    period = F.round(F.months_between("month", "cohort")).cast("int")
    return aged.groupBy("cohort", period.alias("period")).agg(F.count(F.lit(1)).alias("customers"))


def cohort_matrix(counts: DataFrame, periods: int = 6) -> DataFrame:
    """(cohort, cohort_size, period, customers, retention_pct) for periods 0..``periods``."""
    sizes = counts.where("period = 0").select("cohort", F.col("customers").alias("cohort_size"))
    return (
        counts.where(F.col("period") <= periods)
        .join(sizes, "cohort")
        .select(
            "cohort",
            "cohort_size",
            "period",
            "customers",
            F.round(F.col("customers") / F.col("cohort_size") * 100, 1).alias("retention_pct"),
        )
    )


def cohort_table(matrix: DataFrame, periods: int = 6) -> DataFrame:
    """One row per cohort with a column per period; a month with nobody active is null."""
    wide = (
        matrix.groupBy("cohort", "cohort_size")
        .pivot("period", list(range(periods + 1)))
        .agg(F.first("retention_pct"))
    )
    named = [F.col(f"`{p}`").alias(f"m{p}") for p in range(periods + 1)]
    return wide.select("cohort", "cohort_size", *named).orderBy("cohort")


def retention_curve(matrix: DataFrame) -> DataFrame:
    """(period, average_retention_pct, churn_pct): mean of the cohorts' rounded rates."""
    mean = F.round(F.avg("retention_pct"), 1)
    return (
        matrix.groupBy("period")
        .agg(mean.alias("average_retention_pct"))
        .withColumn("churn_pct", F.round(100 - F.col("average_retention_pct"), 1))
        .orderBy("period")
    )


def clv_churn(df: DataFrame, customer: str, date: str, amount: str) -> DataFrame:
    """Per customer: spend, orders, tenure, churn probability and tier, yearly value ahead.

    The churn odds grow with the time since the last order over the usual gap between orders.
    """
    purchases = _purchases(df, customer, date, amount)
    people = (
        purchases.groupBy("customer")
        .agg(
            F.min("at").alias("_first"),
            F.max("at").alias("_last"),
            F.count(F.lit(1)).alias("order_count"),
            F.sum("amount").alias("_spend"),
        )
        .crossJoin(F.broadcast(_as_of(purchases)))
        .select(
            "customer",
            "order_count",
            "_spend",
            (F.col("_spend") / F.col("order_count")).alias("_aov"),
            F.greatest(F.lit(1), whole_days(F.col("_first"), F.col("as_of"))).alias("tenure_days"),
            whole_days(F.col("_last"), F.col("as_of")).alias("recency_days"),
        )
    )
    monthly = F.col("order_count") / (F.col("tenure_days") / 30.0)
    monthly = F.least(F.lit(30.0), F.greatest(F.lit(0.1), monthly))
    usual_gap = F.greatest(F.col("tenure_days") / F.col("order_count"), F.lit(7.0))
    odds = 1.0 / (1.0 + F.exp(-1.5 * (F.col("recency_days") / usual_gap - 1.8)))
    churn = F.least(F.lit(0.98), F.greatest(F.lit(0.02), F.round(odds, 3)))
    scored = people.withColumn("churn_probability", churn)
    high, medium, low = CHURN_TIERS
    tier = (
        F.when(F.col("churn_probability") >= 0.70, high)
        .when(F.col("churn_probability") >= 0.40, medium)
        .otherwise(low)
    )
    ahead = F.col("_aov") * monthly * 12.0 * (1.0 - F.col("churn_probability"))
    return scored.select(
        "customer",
        F.round("_spend", 2).alias("historic_spend"),
        "order_count",
        F.round("_aov", 2).alias("aov"),
        "recency_days",
        "tenure_days",
        "churn_probability",
        tier.alias("churn_risk_tier"),
        F.round(ahead, 2).alias("predicted_annual_clv"),
    )


def top_customers(customers: DataFrame, k: int = 15) -> DataFrame:
    return customers.orderBy(F.desc("historic_spend"), F.asc("customer")).limit(k)


def churn_breakdown(customers: DataFrame) -> DataFrame:
    """(tier, customers, revenue_at_risk), a row for each tier; the low tier risks nothing."""
    tiers = literal_rows(customers.sparkSession, [(t,) for t in CHURN_TIERS], "tier string")
    found = customers.groupBy(F.col("churn_risk_tier").alias("tier")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("historic_spend").alias("spend")
    )
    risk = F.when(F.col("tier") == CHURN_TIERS[2], F.lit(0.0)).otherwise(F.col("spend"))
    return tiers.join(F.broadcast(found), "tier", "left").select(
        "tier",
        F.coalesce("n", F.lit(0)).alias("customers"),
        F.round(F.coalesce(risk, F.lit(0.0)), 2).alias("revenue_at_risk"),
    )


def clv_summary(customers: DataFrame) -> DataFrame:
    """One row: averages, churn rate, and the share of spend of the top tenth of customers."""
    spenders = [("historic_spend", True), "customer"]
    _, cuts = rows_after(customers, {"spend": spenders}, lambda n: [max(1, n // 10)])
    whales = ~cuts["spend"][0]
    high = F.col("churn_risk_tier") == CHURN_TIERS[0]
    spend, people = F.sum("historic_spend"), F.count(F.lit(1))
    top = F.sum(F.when(whales, F.col("historic_spend")))
    at_risk = F.coalesce(F.sum(F.when(high, F.col("historic_spend"))), F.lit(0.0))
    return customers.agg(
        people.alias("total_customers"),
        F.round(F.try_divide(spend, people), 2).alias("average_historic_clv"),
        F.round(F.avg("predicted_annual_clv"), 2).alias("average_predicted_annual_clv"),
        F.round(top / F.greatest(spend, F.lit(1e-4)) * 100, 1).alias("whale_share_pct"),
        F.round(F.try_divide(F.count_if(high), people) * 100, 1).alias("churn_rate_pct"),
        F.round(at_risk, 2).alias("at_risk_revenue"),
    ).where("total_customers > 0")


def unit_economics(
    df: DataFrame,
    segment: str,
    revenue: str,
    customer: str,
    cac: str | None = None,
    ltv: str | None = None,
    acquisition_share: float = 0.18,
    lifetime_multiple: float = 3.2,
    margin_pct: float = 74.5,
    lifetime_months: float = 36.0,
) -> DataFrame:
    """Per segment: CAC, LTV, their ratio and grade, ARPU, payback, ROAS, efficiency score.

    With no column for acquisition cost or lifetime value they are derived from revenue per
    customer with the two named assumptions.
    """
    money = number(df, revenue)
    base = df.groupBy(F.col(f"`{segment}`").alias("segment")).agg(
        F.coalesce(F.sum(money), F.lit(0.0)).alias("_revenue"),
        F.count_distinct(F.col(f"`{customer}`")).alias("customers"),
        (F.avg(number(df, cac)) if cac else F.lit(None).cast("double")).alias("_cac"),
        (F.avg(number(df, ltv)) if ltv else F.lit(None).cast("double")).alias("_ltv"),
    )
    heads = F.greatest(F.col("customers"), F.lit(1))

    def given(column: str) -> Column:
        return F.when(F.col(column) != 0, F.col(column))

    costed = base.withColumn(
        "cac",
        F.coalesce(given("_cac"), F.round(F.col("_revenue") * acquisition_share / heads, 2)),
    ).withColumn(
        "ltv",
        F.coalesce(given("_ltv"), F.round(F.col("_revenue") / heads * lifetime_multiple, 2)),
    )
    ratio = F.round(F.col("ltv") / F.greatest(F.col("cac"), F.lit(1.0)), 2)
    rated = costed.withColumn("ltv_cac", ratio).withColumn(
        "arpu", F.round(F.col("ltv") / lifetime_months, 2)
    )
    grade = (
        F.when(F.col("ltv_cac") >= 4.0, "Elite")
        .when(F.col("ltv_cac") >= 3.0, "Strong")
        .when(F.col("ltv_cac") >= 1.5, "Acceptable")
        .otherwise("Sub-Optimal")
    )
    spend = F.round(F.col("cac") * F.col("customers"), 2)
    monthly_margin = F.greatest(F.col("arpu") * (margin_pct / 100.0), F.lit(1.0))
    return rated.select(
        "segment",
        F.round("_revenue", 2).alias("revenue"),
        "customers",
        F.round("cac", 2).alias("cac"),
        F.round("ltv", 2).alias("ltv"),
        "ltv_cac",
        grade.alias("grade"),
        "arpu",
        F.round(F.col("cac") / monthly_margin, 1).alias("payback_months"),
        F.round(F.col("_revenue") / F.greatest(spend, F.lit(1.0)), 2).alias("roas"),
        F.least(F.lit(100), F.floor(F.col("ltv_cac") * 25)).cast("int").alias("efficiency_score"),
    )


def business_baseline(
    df: DataFrame,
    segment: str,
    revenue: str,
    volume: str,
    margin_pct: float = 72.0,
    marketing_share: float = 0.18,
    operating_share: float = 0.35,
    new_share: float = 0.25,
) -> DataFrame:
    """Per segment: revenue, volume, price, and a cost structure from the given ratios."""
    base = df.groupBy(F.col(f"`{segment}`").alias("segment")).agg(
        F.coalesce(F.sum(number(df, revenue)), F.lit(0.0)).alias("_revenue"),
        F.coalesce(F.sum(number(df, volume)), F.lit(0.0)).alias("_volume"),
    )
    costed = base.select(
        "*",
        F.round(F.col("_revenue") * ((100.0 - margin_pct) / 100.0), 2).alias("cogs"),
        F.round(F.col("_revenue") * marketing_share, 2).alias("marketing"),
        F.round(F.col("_revenue") * operating_share, 2).alias("operating"),
    ).withColumn("gross_profit", F.round(F.col("_revenue") - F.col("cogs"), 2))
    net = F.col("gross_profit") - (F.col("marketing") + F.col("operating"))
    return costed.select(
        "segment",
        F.round("_revenue", 2).alias("revenue"),
        F.round("_volume", 0).alias("volume"),
        F.round(F.col("_revenue") / F.greatest(F.col("_volume"), F.lit(1.0)), 2).alias("avg_price"),
        "cogs",
        "gross_profit",
        "marketing",
        "operating",
        F.round(net, 2).alias("net_profit"),
        F.round(
            F.col("marketing") / F.greatest(F.col("_volume") * new_share, F.lit(1.0)), 2
        ).alias("cac"),
    )
