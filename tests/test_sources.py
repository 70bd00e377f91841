"""The sales table follows its input; bad CSV fields fail; reports are lazy."""

import shutil

import pytest

from tests.conftest import SF_SMOKE, have_data
from tillroll import __main__ as cli
from tillroll.plans import study_reports
from tillroll.sources.sales import STUDY_SCHEMA, prepare_sales, read_sales, sales, sales_upkeep

ROW = "1,2023-01-02,07:00:00,2,3,Astoria,5,3.50,Bakery,Scone,Plain Scone"
HEADER = ",".join(f.split()[0] for f in STUDY_SCHEMA.replace("decimal(10,2)", "decimal").split(", "))


@pytest.fixture
def inputs(tmp_path):
    if not have_data(SF_SMOKE):
        pytest.skip("no smoke data")
    for name in ("region", "nation", "customer", "orders", "part"):
        shutil.copy(f"{SF_SMOKE}/{name}.parquet", tmp_path / f"{name}.parquet")
    (tmp_path / "lineitem.parquet" / "day=1").mkdir(parents=True)
    shutil.copy(f"{SF_SMOKE}/lineitem.parquet", tmp_path / "lineitem.parquet" / "day=1" / "a.parquet")
    return tmp_path


def test_rows_appended_in_a_sub_folder_are_seen(spark, inputs):
    before, files = sales(spark, str(inputs)).count(), sales_upkeep(spark, str(inputs)).files()
    assert sales_upkeep(spark, f"file://{inputs}").files() == files
    shutil.copy(f"{SF_SMOKE}/lineitem.parquet", inputs / "lineitem.parquet" / "day=1" / "b.parquet")
    assert sales_upkeep(spark, str(inputs)).files() != files
    assert sales(spark, str(inputs)).count() == 2 * before


def test_bad_csv_fields_fail(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text(f"{HEADER}\n{ROW}\n")
    bad.write_text(f"{HEADER}\n{ROW}\n{ROW.replace('2023-01-02', '01/02/2023').replace('3.50', '$3.50')}\n")
    assert read_sales(spark, str(good), "csv").count() == 1
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        read_sales(spark, str(bad), "csv").collect()


def test_columns_of_the_wrong_type_are_refused(spark):
    with pytest.raises(TypeError, match="revenue"):
        prepare_sales(spark.createDataFrame([("x",)], "revenue string"))


def test_reports_are_built_on_access_only(spark, tmp_path, monkeypatch):
    frame, cut = type(spark.range(1)), []
    plain = frame.checkpoint

    def counted(self, *args, **kw):
        cut.append(1)
        return plain(self, *args, **kw)

    monkeypatch.setattr(frame, "checkpoint", counted)
    source = tmp_path / "sales.csv"
    source.write_text(f"{HEADER}\n{ROW}\n")
    assert cli.run(spark, str(source), str(tmp_path / "out"), "csv", only=["row_count"]) == ["row_count"]
    reports = study_reports(read_sales(spark, str(source), "csv"))
    assert "product_rank_in_group" in reports and not cut
    assert reports["product_rank_in_group"].count() == 1
    assert cut
