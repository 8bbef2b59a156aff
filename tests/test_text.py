import pytest
from pyspark.sql import functions as F

from impactspark import fixed
from impactspark.functions import text as tx
from impactspark.operators import bills


def of(spark, text, build):
    return spark.createDataFrame([(text,)], "t string").select(build(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "compat", "strict"),
    [
        ("pay $1,250.50 now", [1250.5], [1250.5]),
        ("$7.6 billion", [7.0], [7.6e9]),
        ("$3 million and $2 Billion", [3e6, 2e9], [3e6, 2e9]),
        ("$8,000 Minimum", [8e9], [8000.0]),
        ("$5 b", [5.0], [5e9]),
        ("$5 by", [5.0], [5.0]),
        ("$, none", [], []),
        ("", [], []),
    ],
)
def test_money(spark, text, compat, strict):
    assert of(spark, text, tx.money_amounts) == compat
    assert of(spark, text, lambda t: tx.money_amounts(t, "strict")) == strict


def test_money_before_capital_m_counts_as_million(spark):
    assert of(spark, "$8,000 Most", tx.money_amounts) == [8e9]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("10 percent, 2.5% and 3 percentage points", [10.0, 2.5, 3.0]),
        ("4 % of 7", [4.0]),
        ("no number percent", []),
    ],
)
def test_percent(spark, text, want):
    assert of(spark, text, tx.percentages) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The funding will fall by 10 percent as a cut", -10.0),
        ("Budget: 5% increase", 5.0),
        ("FUNDING grows, increase. The allocation has 4% to add", 4.0),
        ("funding is cut by 10 percent", None),  # the number must lie before the verb
        ("budget of 3% for additional staff", 3.0),
        ("funding of 3%" + " x" * 60 + " cut", None),  # too far apart
        ("fundİng of 6% cut", -6.0),
        ("", None),
    ],
)
def test_funding(spark, text, want):
    assert of(spark, text, tx.funding_change) == want


def test_cap_reads_the_whole_text_or_near(spark):
    text = "Grants grow 9 percent. A tuition cap of 4% holds."
    assert of(spark, text, tx.tuition_cap) == 9.0
    assert of(spark, text, lambda t: tx.tuition_cap(t, near=True)) == 4.0
    assert of(spark, "9 percent of tuition", tx.tuition_cap) is None


def test_types(spark):
    assert of(spark, "State University and community colleges", tx.institution_types) == ["public", "community"]
    assert of(spark, "nobody", tx.institution_types) == ["public", "private", "community"]


def test_clean(spark):
    raw = "  Page 1 of 20 Senate Bill 5\nan  in-\ncrease of\x1cpay  "
    assert of(spark, raw, tx.clean_text) == "an in- crease of pay"
    assert of(spark, raw, lambda t: tx.clean_text(t, repair_hyphens=True)) == "an increase of pay"


def test_records(spark):
    long = "The minimum wage of $12 is set to rise. " + "word " * 200
    df = spark.createDataFrame([(1, long), (2, " \n "), (3, None), (4, "budget 5% cut, wage $9 to, tuition limit")],
                               "bill_id long, text string")
    rows = {r.bill_id: r for r in bills.process_bills(df).collect()}
    assert rows[1].min_wage_change == 12.0 and rows[1].confidence_score == 40.0
    assert len(rows[1].bill_text_sample) == 500
    for empty in (2, 3):
        assert rows[empty].affected_types is None and rows[empty].confidence_score is None
    assert (rows[4].funding_change_pct, rows[4].tuition_cap_pct, rows[4].confidence_score) == (-5.0, 5.0, 80.0)
    review = bills.needs_review(bills.process_bills(df))
    assert sorted(r.bill_id for r in review.collect()) == [1, 2, 3]


def test_overrides_touch_unsure_bills_only(spark):
    df = spark.createDataFrame([(1, "nothing"), (4, "budget 5% cut, wage $9 to, tuition limit")], "bill_id long, text string")
    outside = spark.createDataFrame(
        [(1, 3.0, None, []), (4, 8.0, 1.0, ["private"])],
        "bill_id long, funding_change_pct double, tuition_cap_pct double, affected_types array<string>",
    )
    rows = {r.bill_id: r for r in bills.process_bills(df, outside).collect()}
    assert rows[1].funding_change_pct == 3.0 and rows[1].confidence_score == 85.0
    assert rows[1].affected_types == ["public", "private", "community"]
    assert rows[4].funding_change_pct == -5.0 and rows[4].extraction_method == "rule_based"


def test_texts_are_searched_once_and_from_the_first_word_on(spark):
    """Parameters are those of patterns over the whole text, though the patterns
    begin at the first word they need, and types are looked for once."""
    pad = "Σς ſtraße 🙂 K 𝒳 " * 3
    texts = [
        f"{pad}FUNDING for all: a cut of 4%, then {pad} budget raise by 7 percent",
        f"{pad}MINIMUM WAGE of $9.50 set to rise; min wage $8 to $7 increase", f"{pad}wage {pad} to $3", "wage $2 to",
        f"{pad}child care $40 and $50 as grant {pad} CHILDCARE of $2 million support", f"3% {pad} Tuition Cap of 5%", "tuition  cap 5%",
        "\u0130 m\u0131n\u0131mum wage $1 to; fund\u0131ng falls 9% cut", f"{pad}ch\u0131ldcare $6 grant; FUND\u0130NG 3% add", "", None, pad,
        f"{pad}Community College and public university", "wage " * 30 + "$5 to", f"{pad}minimum wage{' ' * 120}$1 to minimum wage $2 to",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "bill_id int, text string")
    t = F.col("text")

    def first(context, value):
        return F.get(F.array_compact(F.transform(tx.matches(t, context), value)), F.lit(0))

    def signed(m):
        size = F.abs(F.get(tx.percentages(m), F.lit(0)))
        return F.when(F.lower(m).rlike(fixed.FUNDING_DOWN), -size).otherwise(size)

    def amount(m):
        return F.get(tx.money_amounts(m), F.lit(0))

    whole = df.select(
        "bill_id",
        first(fixed.FUNDING_CONTEXT, signed).alias("funding_change_pct"),
        first(fixed.WAGE_CONTEXT, amount).alias("min_wage_change"),
        first(fixed.CHILDCARE_CONTEXT, amount).alias("childcare_subsidy"),
        F.when(t.rlike(tx.FLAGS + fixed.CAP_PHRASE), F.get(tx.percentages(t), F.lit(0))).alias("tuition_cap_pct"),
    )
    found = bills.extract(df)
    assert sorted(map(str, found.select(whole.columns).collect())) == sorted(map(str, whole.collect()))
    assert whole.filter("funding_change_pct is not null").count() >= 2 and whole.filter("min_wage_change is not null").count() >= 4
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("community college") == 1 and plan.count("\u0130") == 1
