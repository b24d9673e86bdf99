from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from criticlens.operators.products import product_features
from criticlens.plans import jobs, registry
from criticlens.sources import products, reviews

HEADER = "Id,ProductId,UserId,ProfileName,HelpfulnessNumerator,HelpfulnessDenominator,Score,Time,Summary,Text\n"
CSV = HEADER + '''1,P1,U1,"Ann ""A""",1,2,5,1104537600,Good,"Great taste, really
two lines"
2,P1,U2,Bob,0,0,1,1104537600,,"Awful boxes and a broken box. Boxes!"
3,P2,U2,Bob,0,,2,1107216000,Meh,"Bad smell, broken box"
4,P2,U3,Cid,0,0,4,1107216000,No text,
'''


@pytest.fixture
def csv_path(tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text(CSV)
    return str(path)


def test_read_reviews_csv(spark, csv_path):
    rows = {r["id"]: r for r in reviews.read_reviews_csv(spark, csv_path).collect()}
    assert len(rows) == 4
    assert rows[1]["text"] == "Great taste, really\ntwo lines" and rows[1]["profile_name"] == 'Ann "A"'
    assert str(rows[1]["review_time"]) == "2005-01-01 00:00:00"
    assert rows[2]["summary"] is None and rows[3]["helpfulness_denominator"] is None and rows[4]["text"] is None


def test_csv_round_trip(spark, csv_path, tmp_path):
    first = reviews.read_reviews_csv(spark, csv_path)
    reviews.write_reviews_csv(first, str(tmp_path / "out"))
    again = reviews.read_reviews_csv(spark, str(tmp_path / "out"))
    assert sorted(first.collect()) == sorted(again.collect())


def test_cleaning_job_and_negative_report(spark, csv_path, tmp_path):
    out = str(tmp_path / "cleaned")
    words = {"great": 1, "awful": -1, "bad": -1, "broken": -1}
    cleaned = jobs.run_cleaning(spark, csv_path, out, polarity=words)
    assert cleaned.count() == 3
    # existing output is kept unless asked otherwise
    again = jobs.run_cleaning(spark, csv_path, out, polarity={"great": -1})
    assert again.where("id = 1").first()["sentiment_score"] > 0.5
    replaced = jobs.run_cleaning(spark, csv_path, out, overwrite=True, polarity={"great": -1, **words, "taste": -1})
    assert replaced.count() == 3
    report = jobs.run_negative_analysis(spark, out, str(tmp_path / "report"))
    keywords = {r["keyword"]: (r["frequency"], r["category"]) for r in report["keywords"].collect()}
    assert keywords["box"] == (4, "packaging") and keywords["smell"] == (1, "smell")
    issues = {r["product_id"]: r for r in report["products"].collect()}
    assert issues["P1"]["top_issues"][0] == "box" and issues["P1"]["negative_review_count"] == 1
    written = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "report" / "top_negative_products"))
    assert json.loads(written.where("product_id = 'P1'").first()["top_issues"])[0] == "box"
    assert {r["keyword"]: r["frequency"] for r in report["product_keywords"].where("product_id = 'P1'").collect()}["box"] == 3
    with pytest.raises(ValueError):
        jobs.run_cleaning(spark, csv_path, out)


def test_read_cleaned_requires_columns(spark, tmp_path):
    path = str(tmp_path / "few")
    spark.range(1).selectExpr("id AS product_id").write.parquet(path)
    with pytest.raises(ValueError, match="text_cleaned"):
        reviews.read_cleaned(spark, path)


def test_listed_keywords(spark):
    rows = [("['a', \"it's\", 'b, c']",), ("[]",), (None,), (r"['a\'b']",)]
    df = spark.createDataFrame(rows, "k string")
    assert [r[0] for r in df.select(reviews.parse_listed(F.col("k"))).collect()] == [["a", "it's", "b, c"], [], [], ["a'b"]]


def test_read_cleaned_csv(spark, tmp_path):
    path = tmp_path / "cleaned.csv"
    path.write_text('Id,ProductId,Score,Helpfulness index,Text_cleaned,keywords,sentiment_score\n1,P,2,0.5,a b,"[\'a\', \'b\']",0.25\n')
    row = reviews.read_cleaned_csv(spark, str(path)).first()
    assert (row["product_id"], row["score"], row["keywords"], row["sentiment_score"]) == ("P", 2, ["a", "b"], 0.25)
    assert row["helpfulness_index"] == "0.5"


DOCUMENT = {
    "product_title": "Tea", "byline_info": "Shop", "product_description": "Fine", "category": ["Food", "Tea"],
    "alt_images": ["a", "b"], "product_detail": {"Customer Reviews": "4.5 out of 5 stars 1,234 ratings", "x.y": "z"},
    "important_information": {}, "rating": {"score": "4.5 out of 5", "dist": {f"{i} star": f"{i * 10}%" for i in range(1, 6)}},
    "top_comments": [
        {"date": "August 27, 2025", "title": "T", "score": "5.0 out of 5 stars", "text": "good", "helpfulness": "One"},
        {"date": "August 28, 2025", "title": "U", "score": "4.0 out of 5 stars", "text": "fine", "helpfulness": "1,234"},
        {"date": "August 29, 2025", "title": "V", "score": "3.0 out of 5 stars", "text": "fair", "helpfulness": "0"},
    ],
}


def test_product_json(spark, tmp_path):
    folder = tmp_path / "products"
    folder.mkdir()
    (folder / "B001.json").write_text(json.dumps(DOCUMENT, indent=2))
    (folder / "B002.json").write_text("{}")
    (folder / "B003.json").write_text(json.dumps({**DOCUMENT, "rating": None, "product_detail": {}}, indent=2))
    loaded = products.read_products(spark, str(folder))
    rows = {r["product_id"]: r for r in product_features(loaded).collect()}
    assert set(rows) == {"B001", "B003"}
    assert (rows["B001"]["score"], rows["B001"]["num_ratings"], rows["B001"]["is_food"]) == (4.5, 1234, True)
    assert rows["B001"]["score_distribution"] == [10.0, 20.0, 30.0, 40.0, 50.0]
    assert (rows["B003"]["score"], rows["B003"]["num_ratings"]) == (None, -1)
    products.write_products(loaded, str(tmp_path / "lines"))
    again = products.read_products(spark, str(tmp_path / "lines"), one_per_file=False)
    as_json = F.to_json(F.struct("*"))
    assert sorted(r[0] for r in loaded.select(as_json).collect()) == sorted(r[0] for r in again.select(as_json).collect())


def test_pending_products(spark):
    wanted = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "product_id string")
    existing = spark.createDataFrame([("a",)], "product_id string")
    assert [r[0] for r in products.pending_products(wanted, existing).collect()] == ["b"]
    assert sorted(r[0] for r in products.pending_products(wanted, existing, replace=True).collect()) == ["a", "b"]


def test_product_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """A table of pages in one split: its documents are extracted and written over the whole width of the shuffle."""
    html = F.concat(F.lit("<html><h1>Title "), F.col("id"), F.lit('</h1><ul><li><a href="/a">Menu</a></li></ul><p>Body</p></html>'))
    spark.range(200).select(F.col("id").alias("page_id"), html.alias("html")).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    spark.range(1).write.parquet(str(tmp_path / "labels.parquet"))  # the view names a column so, and tables are found by name
    monkeypatch.setattr(registry, "scratch_path", lambda _, name: str(tmp_path / name))
    loaded = registry.product_files_load(spark, str(tmp_path))
    written = {p.name.split("-")[1] for p in (tmp_path / "product-files").glob("part-*")}
    assert len(written) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    titles = {r[0] for r in loaded.select("product_title").collect()}
    assert titles >= {f"Title {i}" for i in range(200) if i % 10 not in (4, 9)} and loaded.where("named").count() == len(titles)
    assert not titles & {f"Title {i}" for i in range(4, 200, 10)}


def test_small_files_share_tasks(spark, tmp_path):
    """Two hundred documents in as many tasks as there are cores, not in a task for each few files; the session stays as it is."""
    for i in range(200):
        whole = json.dumps(DOCUMENT | {"product_title": f"Title {i}"})
        (tmp_path / f"B{i:03d}.json").write_text("{}" if i % 10 == 4 else whole[:-5] if i % 10 == 9 else whole)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
        loaded = products.read_products(spark, str(tmp_path))
        assert loaded.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        found = {r["product_id"]: r["product_title"] for r in loaded.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {f"B{i:03d}": f"Title {i}" for i in range(200) if i % 10 not in (4, 9)}
    assert loaded.sparkSession is spark and spark.conf.get("spark.sql.files.openCostInBytes") == before
    assert not [t for t in spark.catalog.listTables("global_temp") if t.name.startswith("handed_over")]


def test_product_files_have_no_files_beside_them(spark, tmp_path, monkeypatch):
    html = F.concat(F.lit("<html><h1>Title "), F.col("id"), F.lit("</h1><p>Body</p></html>"))
    spark.range(20).select(F.col("id").alias("page_id"), html.alias("html")).write.parquet(str(tmp_path / "pages.parquet"))
    spark.range(1).write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(registry, "scratch_path", lambda _, name: str(tmp_path / name))
    loaded = registry.product_files_load(spark, str(tmp_path))
    names = [p.name for p in (tmp_path / "product-files").iterdir()]
    assert len([n for n in names if n.startswith("part-")]) == 20 and not [n for n in names if n.endswith(".crc") and "part-" in n]
    assert sorted(r[0] for r in loaded.select("product_title").collect()) == sorted(f"Title {i}" for i in range(20) if i % 10 not in (4, 9))
