import pytest

from impactspark.operators import impact
from impactspark.plans import master, scenario
from impactspark.sources import sinks, tables
from impactspark.sources.scan import csv_reader, read_csv
from impactspark.sources.split_csv import read_csv_split
from impactspark.streaming import watch

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def people(spark):
    return tables.institutions(spark, FOLDER).cache()


def test_run_publishes_and_records(spark, people, tmp_path):
    out = str(tmp_path)
    policies = tables.catalogue(spark).filter("scenario = 'min_wage_15'").drop("scenario")
    done = scenario.run_scenario(spark, "wage", policies, people, out, analysis=True)
    assert done["current_summary"].startswith(sinks.current_folder(spark, out))
    current = csv_reader(spark).csv(done["current_predicted_impact"])
    assert current.count() == people.count()
    assert "students_affected" in current.columns
    summary = spark.read.json(done["current_summary"]).first()
    assert summary.scenario_name == "wage" and summary.total_colleges_affected == people.count()
    assert {"statistics", "correlations", "state_vulnerability", "equity_gaps"} <= set(done)
    assert spark.read.json(done["statistics"]).count() > 5

    class Broken:
        def __call__(self, df):
            raise ValueError("no predictions today")

    with pytest.raises(ValueError):
        scenario.run_scenario(spark, "bad", policies, people, out, predict=Broken())
    runs = {r.scenario: (r.status, r.error) for r in sinks.latest_runs(spark, out).collect()}
    assert runs == {"wage": ("success", None), "bad": ("error", "no predictions today")}


def test_profile_has_every_part(people):
    parts = master.profile(people)
    assert {"overview", "missing", "completeness", "statistics", "duplicate_ids", "key_nulls"} <= set(parts)
    assert parts["completeness"].first().quality_rating in {"Excellent", "Good"}


def test_master_file_reads_back(spark, tmp_path):
    names = [' said "hi", \\ ok ', "two\nlines", "plain", ""]
    a = spark.createDataFrame(list(enumerate(names)) + [(None, "a"), (None, "b")], "institution_id long, name string")
    b = spark.createDataFrame([(i, 1.5 * i) for i in range(4)] + [(None, 2.0)] * 3, "institution_id long, grad_rate double")
    table = master.build_master({"a": a, "b": b}, str(tmp_path)).table
    for back in (read_csv(spark, f"{tmp_path}/master.csv", table.schema), read_csv_split(spark, f"{tmp_path}/master.csv", table.schema)):
        assert sorted(map(str, back.collect())) == sorted(map(str, table.collect()))
    assert {names[0], names[1]} <= {r.name for r in table.collect()}
    assert table.filter("institution_id IS NULL").count() == 3  # two names apart, equal rows once


def test_master_without_folder(spark):
    a = spark.createDataFrame([(1, 5.0), (2, None), (2, None)], "institution_id long, `Net Price` double")
    b = spark.createDataFrame([(2, 0.4), (3, 0.9)], "institution_id long, grad_rate double")
    built = master.build_master({"a": a, "b": b})
    rows = {r.institution_id: r for r in built.table.collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[2].net_price == 5.0 and rows[3].grad_rate == 90.0 and rows[1].grad_rate == 0.0
    assert built.quality()["score"].first().overall_quality_score == 100


def put(folder, name, text):
    (folder / name).write_text(text)


def run(spark, inbox, people, out):
    arriving = watch.file_bills(spark, str(inbox))
    watch.watch(arriving, people, f"{out}/out", f"{out}/checkpoint").awaitTermination()


def test_each_file_is_published_once(spark, people, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    put(inbox, "first.txt", "The funding falls 10 percent,\nthis cut hits each community college.")
    put(inbox, "ignored.pdf", "budget 5% cut")
    run(spark, inbox, people, tmp_path)
    put(inbox, "second.txt", "The budget has 4% to add for every private college.")
    put(inbox, "empty.txt", " \n")
    run(spark, inbox, people, tmp_path)
    run(spark, inbox, people, tmp_path)
    params = {r.scenario: r for r in spark.read.parquet(f"{tmp_path}/out/params").collect()}
    assert set(params) == {"first_0", "second_1", "empty_1"}
    assert params["first_0"].funding_change_pct == -10.0
    assert params["second_1"].affected_types == ["private"]
    summary = {r.scenario: r for r in spark.read.parquet(f"{tmp_path}/out/summary").collect()}
    assert set(summary) == {"first_0", "second_1"}
    current = watch.current(spark, f"{tmp_path}/out", "summary")
    assert {r.scenario for r in current.collect()} == {"second_1"}
    put(inbox, "third.txt", "The funding falls 10 percent: this cut hits a community college again.")
    put(inbox, "fourth.txt", "The budget has 7% to add for every private college.")
    run(spark, inbox, people, tmp_path)
    # the third asks for what the first did: one policy meets institutions, two bills are published
    newest = lambda kind: watch.current(spark, f"{tmp_path}/out", kind)
    assert newest("impact").select("policy_id").distinct().count() == newest("policies").count() == 1
    assert {r.scenario for r in newest("summary").collect()} == {"third_2", "fourth_2"}
    every = {r.scenario: r for r in spark.read.parquet(f"{tmp_path}/out/summary").collect()}
    assert every["third_2"].total_students_impacted == every["first_0"].total_students_impacted
    pairs = watch.predictions(spark, f"{tmp_path}/out")
    assert pairs.select("policy_id").distinct().count() == 3
    runs = [(r.scenario, r.status) for r in spark.read.parquet(f"{tmp_path}/out/runs").collect()]
    assert sorted(runs) == [("empty_1", "error"), ("first_0", "success"), ("fourth_2", "success"), ("second_1", "success"), ("third_2", "success")]


def test_a_failing_batch_is_recorded(spark, people, tmp_path):
    batch = spark.createDataFrame([("b", "b.txt", "budget 5% cut")], "bill_id string, source_name string, text string")

    def broken(df):
        raise ValueError("model is gone")

    with pytest.raises(ValueError):
        watch.publish_batch(batch, 3, people, str(tmp_path), broken)
    row = spark.read.parquet(f"{tmp_path}/runs").first()
    assert (row.scenario, row.status, row.error) == ("b_3", "error", "model is gone")
    # repeated after the repair, the same batch replaces what the failure left
    watch.publish_batch(batch, 3, people, str(tmp_path))
    assert [r.status for r in spark.read.parquet(f"{tmp_path}/runs").collect()] == ["success"]


def test_bills_of_one_part_are_read_by_many_tasks(spark, people, tmp_path):
    rows = [(f"b{i}", "b.parquet", f"The budget has {i % 3}% to add. Bill {i}.") for i in range(300)] + [(None, None, None)]
    batch = spark.createDataFrame(rows, "bill_id string, source_name string, text string").coalesce(1)
    watch.publish_batch(batch, 0, people, str(tmp_path))
    params = spark.read.parquet(f"{tmp_path}/params")
    assert params.select("_metadata.file_path").distinct().count() >= spark.sparkContext.defaultParallelism
    assert params.count() == 301
    assert {r.policy_id: r.funding_change_pct for r in params.collect() if r.scenario} == {
        r.policy_id: r.funding_change_pct for r in spark.read.parquet(f"{tmp_path}/policies").collect()
    }
    assert spark.read.parquet(f"{tmp_path}/summary").count() == 300


def test_bills_share_their_policies(spark, people):
    texts = ["The funding falls 10 percent, a cut for each community college.", "Funding is cut by 10 percent at a community college.", None, "Nothing."]
    bills = spark.createDataFrame([(i, texts[i % 4]) for i in range(40)], "bill_id long, text string")
    params = scenario.with_policy_id(scenario.process_bills(bills))
    assert scenario.distinct_policies(params).count() < 4
    pairs = scenario.scenario_impact(people, scenario.distinct_policies(params))
    one_by_one = scenario.predict_impact(bills, people)
    assert pairs.count() * 5 <= one_by_one.count()
    by_policy = {r.bill_id: r.total_students_impacted for r in scenario.summarize_bills(bills, people).collect()}
    by_bill = {r.bill_id: r.total_students_impacted for r in impact.impact_summary(one_by_one, ["bill_id"]).collect()}
    assert by_policy == by_bill and len(by_bill) >= 20
