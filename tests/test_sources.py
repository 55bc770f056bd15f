import json

import pytest
from pyspark.sql import functions as F

from asfiled import fixed
from asfiled.durable import fresh_path, write_partitioned
from asfiled.plans import universe
from asfiled.sources import readers, writers


def observation(**more):
    return {"start": "2015-01-01", "end": "2015-12-31", "val": 5, "accn": "X-1", "fy": 2015,
            "fp": "FY", "form": "10-K", "filed": "2016-02-01", **more}


def test_filing_documents_are_flattened(spark, tmp_path):
    document = {"cik": 1, "facts": {
        "dei": {"Assets": {"units": {"USD": [observation()]}}},
        "us-gaap": {
            "Revenues": {"label": "x", "units": {
                "USD": [observation(), observation(fy=2009), observation(fy=None),
                        observation(filed="not a date", val=7.5)],
                "CNY": [observation(start=None)]}},
            "Assets": {"units": {"USD": [observation(start=None, frame="CY2015Q4I")]}},
            "Unmapped": {"units": {"USD": [observation()]}}}}}
    (tmp_path / "CIK0000000042.json").write_text(json.dumps(document, indent=1))
    (tmp_path / "CIK0000000043.json").write_text(json.dumps({"facts": {}}))
    rows = readers.flatten_filings(readers.read_documents(spark, str(tmp_path))).collect()
    assert {r.entity_id for r in rows} == {"0000000042"}
    told = sorted((r.concept, r.tag_priority, r.unit, r.value, str(r.period_start),
                   str(r.filed_date)) for r in rows)
    assert told == [
        ("revenue", 2, "CNY", 5.0, "None", "2016-02-01"),
        ("revenue", 2, "USD", 5.0, "2015-01-01", "2016-02-01"),
        ("revenue", 2, "USD", 7.5, "2015-01-01", "None"),
        ("total_assets", 0, "USD", 5.0, "None", "2016-02-01")]


@pytest.fixture
def companies(spark):
    listed = [(1652044, "GOOGL", "Alphabet"), (1652044, "GOOG", "Alphabet"), (320193, "AAPL", "Apple")]
    payload = {str(i): {"cik_str": c, "ticker": t, "title": n} for i, (c, t, n) in enumerate(listed)}
    return readers.companies_from_map(
        spark.createDataFrame([(json.dumps(payload),)], "payload string"))


def test_share_classes_keep_a_row_each(companies):
    rows = companies.collect()
    assert {r.ticker for r in rows} == {"GOOGL", "GOOG", "AAPL"}
    assert {r.entity_id for r in rows} == {"0001652044", "0000320193"}


def test_selection_matches_before_it_reduces(spark, companies):
    asked = spark.createDataFrame([("GOOG",), ("AAPL",), ("GONE",)], "ticker string")
    chosen = universe.select_companies(companies, asked).collect()
    assert {(r.entity_id, r.ticker) for r in chosen} == {
        ("0001652044", "GOOG"), ("0000320193", "AAPL")}
    assert [r.ticker for r in universe.missing_tickers(companies, asked).collect()] == ["GONE"]


def test_universes(spark, tmp_path):
    (tmp_path / "sp500.csv").write_text("ticker,company_name\nAAPL,Apple\nge ,GE\nWFC,Wells\n\n")
    full = universe.named_universe(spark, "full", str(tmp_path))
    names = [r.ticker for r in full.orderBy("_list", "position").collect()]
    assert names[:3] == ["AAPL", "GE", "WFC"] and len(names) == len(set(names)) == 9
    assert set(dict(fixed.CASE_STUDIES)) <= set(names)
    pilot = [r.ticker for r in universe.named_universe(spark, "pilot").collect()]
    assert len(pilot) == len(set(pilot)) == 24 and {"AAPL", "LKNCY"} <= set(pilot)
    assert universe.named_universe(spark, "sp500", str(tmp_path)).count() == 3
    with pytest.raises(ValueError):
        universe.named_universe(spark, "nothing")


def test_seeds_survive_the_round_trip(spark):
    folder = fresh_path(spark, "seeds")
    writers.write_seeds(spark, folder)
    notes = {r.ticker: r.case_study_note
             for r in readers.read_case_studies(spark, f"{folder}/case_studies").collect()}
    assert notes == dict(fixed.CASE_STUDIES)
    events = readers.read_events(spark, f"{folder}/backtest_events")
    assert events.groupBy("event_label").count().collect()[0]["count"] == 7
    concepts = readers.read_concepts(spark, f"{folder}/concepts").collect()
    assert {c.concept for c in concepts if c.combine == "sum"} == {"cogs"}
    assert sum(c.required for c in concepts) == 6


def test_facts_are_laid_out_by_concept(spark, facts):
    path = fresh_path(spark, "facts")
    table = facts({}, {"concept": "cfo", "source_tag": "N"})
    names = spark.createDataFrame([("0000000001", "AAA", "A Co")],
                                  "entity_id string, ticker string, company_name string")
    writers.write_facts(table.drop("ticker", "company_name"), names, path)
    back = readers.read_facts(spark, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, table.collect()))
    plan = back.filter("concept = 'cfo'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(concept" in plan


def test_vendor_frames(spark):
    history = spark.sql("select 'A' as ticker, timestamp'2020-01-02 00:00:00' as Date, 3 as Close")
    assert [tuple(map(str, r)) for r in readers.price_frame(history).collect()] == [
        ("A", "2020-01-02", "3.0")]
    page = spark.sql("select 'BRK.B' as Symbol, 'B' as Security, 'Fin' as `GICS Sector`")
    assert tuple(readers.constituents(page).first()) == ("BRK-B", "B", "Fin")


def test_screener_csv_coercion(spark, tmp_path):
    head = ",".join([*readers.schemas.SCREENER.names, "detail_key"])
    (tmp_path / "d.csv").write_text(
        head + '\n0000000001,A,"A ""B"", C",,True,,2015,2015-12-31,-1.5,,,3,neutral,True,,False,1,2,k\n')
    row = readers.read_screener(spark, str(tmp_path)).first()
    assert (row.company_name, row.gics_sector, row.is_case_study) == ('A "B", C', None, True)
    assert (row.m_score, row.z_score, row.z_score_flag, row.f_score_flag) == (-1.5, None, None, False)


def test_readers_do_not_share_a_growing_schema(spark, tmp_path):
    assert "detail_key" not in readers.schemas.SCREENER.names
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_a_list_keeps_its_order_over_files_and_splits(spark, tmp_path):
    names = [f"N{i:05}" for i in range(3000)]
    folder = tmp_path / "long.csv"
    folder.mkdir()
    for k, part in enumerate((names[:1400], names[1400:] + names[5:25] + [" n00001 ", ""])):
        (folder / f"part-{k}.csv").write_text("ticker\n" + "\n".join(part) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        listed = universe.named_universe(spark, "long", str(tmp_path))
        assert listed.rdd.getNumPartitions() > 8
        ranked = universe.ranked(listed).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert [r.ticker for r in sorted(ranked)] == names
    assert sorted(r["rank"] for r in ranked) == list(range(1, 3001))


def test_partitioned_writes_make_few_files(spark, tmp_path):
    """200 tasks of input; one value holds a third of the rows."""
    rows = spark.range(0, 60_000, numPartitions=200).selectExpr(
        "id", "if(id % 3 = 0, 'hot', concat('c', id % 20)) as concept", "repeat(md5(cast(id as string)), 3) as t")
    write_partitioned(rows, str(tmp_path / "out"), ("concept",))
    files = {f.name: len(list(f.glob("*.parquet"))) for f in (tmp_path / "out").iterdir() if f.is_dir()}
    assert len(files) == 21 and max(files.values()) <= 2
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        write_partitioned(rows, str(tmp_path / "split"), ("concept",))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "split" / "concept=hot").glob("*.parquet"))) > 3
    assert spark.read.parquet(str(tmp_path / "split")).count() == 60_000


def test_documents_in_folders_of_their_companies(spark, tmp_path):
    docs = spark.createDataFrame([("0000000007", '{"a": 1}'), ("0000000042", "x")], "entity_id string, p string")
    docs.write.partitionBy("entity_id").text(str(tmp_path / "d"))
    got = {r.entity_id: r.payload.strip() for r in readers.read_documents(spark, str(tmp_path / "d")).collect()}
    assert got == {"0000000007": '{"a": 1}', "0000000042": "x"}
