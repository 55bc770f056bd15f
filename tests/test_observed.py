from asfiled.plans import observed, quality
from asfiled.plans import screener as screen


def table(spark, rows):
    return spark.createDataFrame(
        rows, "entity_id string, ticker string, period_fiscal_year int, red_flag_count int, "
              "models_scored int")


ROWS = [("1", "A", 2020, 1, 2), ("1", None, 2021, 0, 3), (None, "B", 2020, 5, 3),
        ("2", "C", 2019, 2, 1), ("3", "D", 2022, 0, 0), ("3", "D", 2023, None, 1)]


def test_counts_of_the_write_equal_separate_counts(spark, tmp_path):
    df = table(spark, ROWS).repartition(3)
    back, found = observed.write_checked(df, "screener", str(tmp_path / "t"))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert found.pop("rows") == len(ROWS)
    assert found.pop("inconsistent flag counts") == quality.inconsistent_flag_counts(df).count() == 2
    apart = {r.column: r.n_null for r in
             quality.null_counts(df, quality.REQUIRED["screener"]).collect()}
    assert found == {f"null {c}": n for c, n in apart.items()} and found["null entity_id"] == 1


def test_partitioned_writes_and_empty_tables_are_counted(spark, tmp_path):
    df = table(spark, ROWS)
    back, found = observed.write_checked(df, "screener", str(tmp_path / "p"),
                                         ("period_fiscal_year",))
    assert found["rows"] == back.count() == len(ROWS) and found["null ticker"] == 1
    _, found = observed.write_checked(df.limit(0), "screener", str(tmp_path / "e"))
    assert set(found.values()) == {0}


def test_company_counts_need_no_expand(spark):
    df = table(spark, ROWS)
    for build in (screen.fleet_figures, screen.span_and_share_labels):
        assert "Expand" not in build(df)._jdf.queryExecution().toString()
    got = screen.fleet_figures(df).first()
    assert (got.companies_screened, got.companies_flagged, got.company_years) == (3, 2, 6)
    assert got.red_flag_rate == 0.5 and got.avg_red_flags == 8 / 5
    assert screen.fleet_figures(df.limit(0)).first().company_years == 0
    assert screen.span_and_share_labels(df).first().any_flag_share == "67% of screened fleet"
