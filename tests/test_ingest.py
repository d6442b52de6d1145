"""Nested exports to tables: lineage, duplicates, constraints, publishing."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import ingest, reviews as rv
from tallyspark.operators.checks import ContractError
from tallyspark.sources import readers, sinks

BRANCH = {
    "brand": "A", "branch_id": "b1", "title": "T", "city": "C", "neighbourhood": "N", "branch_label": "L", "scrapedAt": "2026-06-30T00:00:00.000Z",
    "totalScore": 4.5, "reviewsCount": 10, "categories": ["cafe", "bakery"], "reviewsDistribution": {"oneStar": 1, "fiveStar": 9},
    "openingHours": [{"day": "Mon", "hours": "9-5"}], "popularTimesHistogram": {"Mo": [{"hour": 9, "occupancyPercent": 40}, {"hour": 10, "occupancyPercent": 60}]},
    "additionalInfo": {"Service": [{"Delivery": True}, {"Dine-in": False}]}, "placesTags": [{"title": "cozy", "count": 3}], "reviewsTags": [{"title": "tea"}],
}
REVIEW = {
    "brand": "A", "branch_id": "b1", "branch_label": "L", "city": "C", "review_id": "r1", "reviewer_id": "u1", "stars": 5,
    "publishedAtDate": "2026-06-01T10:00:00.000Z", "scrapedAt": "2026-06-30T00:00:00.000Z", "text": "Great", "isLocalGuide": True,
    "reviewContext": {"Meal": "Lunch", "Price": 3, "Wait": None, "Ok": True, "Tags": [1], "More": {"a": 1}, "Rate": 1.5},
    "reviewDetailedRating": {"الطعام": 4, "الخدمة": 5}, "categories": ["cafe"],
}


def export(folder, change=None):
    branches = {x: [dict(BRANCH, brand=x, branch_id=f"b{x}", branch_label=f"L{x}")] for x in "ABC"}
    reviews = {
        x: [dict(REVIEW, brand=x, branch_id=f"b{x}", branch_label=f"L{x}", review_id=f"{x}{i}", reviewer_id=f"u{i}", stars=i + 1) for i in range(3)]
        for x in "ABC"}
    reviews["B"].append(copy.deepcopy(reviews["B"][0]))  # an exact copy
    menus = {x: {"Hot": {"Tea": 2.5, "Coffee": None}, "Cold": {"Ice": 1}} for x in "ABC"}
    if change:
        change(branches, reviews, menus)
    for x in branches:
        (folder / f"{x}_branches.json").write_text(json.dumps(branches[x], ensure_ascii=False), encoding="utf-8")
        (folder / f"{x}_reviews.json").write_text(json.dumps(reviews[x], ensure_ascii=False, indent=1), encoding="utf-8")
    (folder / "menus.json").write_text(json.dumps(menus), encoding="utf-8")
    return str(folder)


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("ok")
    (base / "in").mkdir()
    tables = ingest.ingest(spark, export(base / "in"))
    return ingest.publish(spark, tables, str(base / "out")), base


def test_all_tables_and_counts(published):
    tables, _ = published
    assert len(tables) == 21
    n = {k: v.count() for k, v in tables.items()}
    assert (n["brands"], n["branches"], n["source_review_records"], n["reviews"], n["menu_items"]) == (3, 3, 10, 9, 9)
    assert n["branch_categories"] == 6 and n["branch_review_distribution"] == 6 and n["branch_attributes"] == 6
    assert n["review_detailed_ratings"] == 18 and n["review_context"] == 63 and n["ingestion_manifest"] == 7


def test_duplicates_stay_in_lineage_only(published):
    tables, _ = published
    copies = tables["source_review_records"].where("is_exact_duplicate").collect()
    assert [(r.source_file, r.source_ordinal, r.review_id) for r in copies] == [("B_reviews.json", 3, "B0")]
    raw = tables["source_review_records"].where("review_id = 'A0'").first()
    assert json.loads(raw.raw_json)["reviewDetailedRating"]["الطعام"] == 4 and len(raw.payload_sha256) == 64


def test_nested_values(published):
    tables, _ = published
    types = {r.context_key: r.value_type for r in tables["review_context"].where("review_id = 'A0'").collect()}
    assert types == {"Meal": "str", "Price": "int", "Wait": "NoneType", "Ok": "bool", "Tags": "list", "More": "dict", "Rate": "float"}
    stars = {(r.stars, r.review_count) for r in tables["branch_review_distribution"].where("branch_id = 'bA'").collect()}
    assert stars == {(1, 1), (5, 9)}
    hours = [(r.weekday, r.ordinal, r.hour) for r in tables["branch_popular_times"].where("branch_id = 'bA'").orderBy("ordinal").collect()]
    assert hours == [("Mo", 0, 9), ("Mo", 1, 10)]
    first = tables["reviews"].where("review_id = 'A0'").first()
    assert first.likes_count == 0 and first.is_local_guide and not first.is_advertisement
    menu = {(r.section_ordinal, r.section_name, r.item_ordinal, r.item_name, r.price) for r in tables["menu_items"].where("brand_name = 'A'").collect()}
    assert menu == {(0, "Cold", 0, "Ice", 1.0), (1, "Hot", 0, "Coffee", None), (1, "Hot", 1, "Tea", 2.5)}


def test_published_tables_feed_the_benchmark(spark, published):
    tables, _ = published
    r = ingest.analysis_reviews(tables["reviews"])
    overlap = rv.reviewer_overlap(r, tables["brands"]).collect()
    assert [(o.brand_a, o.brand_b, o.shared_reviewers, o.shared_reviewers_at_all_brands) for o in sorted(overlap)] == [
        ("A", "B", 3, 3), ("A", "C", 3, 3), ("B", "C", 3, 3)]
    rated = rv.overlap_ratings(r, tables["brands"], tables["review_detailed_ratings"]).first()
    assert rated.a_food_subrating_mean == 4.0 and rated.a_overall_stars_mean == 2.0
    quality = {q.counter: q.value for q in rv.data_quality(r, tables["branches"], tables["source_review_records"]).collect()}
    assert quality["exact_duplicate_source_rows"] == 1 and quality["orphan_reviews"] == 0


def test_publishing_is_all_or_nothing(spark, published):
    tables, base = published
    with pytest.raises(FileExistsError):
        ingest.publish(spark, tables, str(base / "out"))
    broken = dict(tables, reviews=tables["reviews"].limit(2))
    with pytest.raises(ContractError):
        ingest.publish(spark, broken, str(base / "broken"))
    assert not (base / "broken").exists() and not (base / "broken.staging").exists()


@pytest.mark.parametrize("change, message", [
    (lambda b, r, m: r["A"][0].pop("stars"), "missing required fields"),
    (lambda b, r, m: b["A"][0].pop("city"), "branches: missing required fields"),
    (lambda b, r, m: r["A"][0].update(publishedAtDate="June"), "not ISO-8601"),
    (lambda b, r, m: r["A"][0].update(stars=6), "domain"),
    (lambda b, r, m: r["B"][3].update(text="other"), "conflicting payloads"),
    (lambda b, r, m: r["A"][0].update(branch_id="nowhere"), "orphan review"),
    (lambda b, r, m: r["A"][0].update(city="elsewhere"), "disagrees with its branch"),
    (lambda b, r, m: m.update(Z={"S": {"i": 1}}), "unknown brand"),
    (lambda b, r, m: b["A"].append(dict(b["A"][0])), "not unique"),
])
def test_bad_exports_are_refused(spark, tmp_path, change, message):
    with pytest.raises(ContractError, match=message):
        ingest.ingest(spark, export(tmp_path, change))


def test_file_counts_and_roots(spark, tmp_path):
    folder = export(tmp_path)
    (tmp_path / "D_reviews.json").write_text("[]")
    with pytest.raises(ContractError, match="Expected 3 files"):
        ingest.ingest(spark, folder)
    (tmp_path / "D_reviews.json").unlink()
    (tmp_path / "A_reviews.json").write_text('{"a": 1}')
    with pytest.raises(ContractError, match="JSON array"):
        ingest.ingest(spark, folder)


def test_line_ordinals_survive_file_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for name in ("one", "two"):
            (tmp_path / f"{name}.json").write_text("\n".join(json.dumps({"i": i, "pad": "x" * 40}) for i in range(60)) + "\n")
        rows = readers.json_records(spark, str(tmp_path), lines=True)
        blocks = spark.read.text(str(tmp_path)).select("_metadata.file_name", "_metadata.file_block_start").distinct()
        assert blocks.count() > 4
        got = rows.select("source_ordinal", F.variant_get("record", "$.i", "long").alias("i"))
        assert got.count() == 120 and got.where("source_ordinal <> i").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_bad_lines_are_reported_and_strict_reading_fails(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a":1}\n\n{"a":\n{"a":2}\n')
    bad = readers.bad_json_lines(spark, str(tmp_path), "a long").collect()
    assert [(r.source_file, r.line) for r in bad] == [("x.json", '{"a":')]
    loose = readers.json_lines(spark, str(tmp_path), "a long", strict=False).collect()
    assert sorted((r.a, r._bad) for r in loose if r._bad is None) == [(1, None), (2, None)]
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path), "a long").collect()


def test_ordered_lines_and_reports(spark, tmp_path):
    sinks.write_json_lines(spark.range(50).orderBy(F.rand(1)), str(tmp_path / "l"), ["id"])
    parts = sorted((tmp_path / "l").glob("part-*.json"))
    ids = [json.loads(x)["id"] for p in parts for x in p.read_text().splitlines()]
    assert ids == list(range(50))
    sinks.write_report(spark.createDataFrame([(1, None)], "b int, a string"), str(tmp_path / "r"))
    assert next((tmp_path / "r").glob("part-*")).read_text().strip() == '{"a":null,"b":1}'
    with pytest.raises(FileExistsError):
        sinks.refuse_existing(spark, [str(tmp_path / "r"), str(tmp_path / "none")])


def test_iso_forms(spark):
    from tallyspark.operators import checks

    good = ["2026-07-01", "20260701", "2026-07-01T10:00:00Z", "2026-07-01 10:00", "2026-07-01T10:00:00.123+03:00"]
    bad = ["2026", "2026-07", "2026-7-1", "T10:00", "2026-13-01", "no", ""]
    df = spark.createDataFrame([(x,) for x in good + bad], "at string")
    assert {r.at for r in checks.invalid_iso8601(df, "at").collect()} == set(bad)


def test_iso_forms_are_those_of_the_standard_library(spark):
    from datetime import datetime

    forms = ["2026-07-20", "20260720", "20260701T101112", "2026-W29-1", "2026W291", "2026-W29", "2026W29", "2026-07-20T1000", "2026-07-20x10:00",
             "2026-07-20T10:00:00+05:30:15", "2026-07-20T10:00:00.1234567890", "2026-07-20T10:00:00,5Z", "2026-07-20 10", "2026-07-20T10:00Z",
             "2026-07-20T10:00:00-0330", "2020-W53-7", "2021-W53", "2026-W00", "2026-W29-8", "2026-W29-0", "2026-02-29", "2024-02-29", "2026-13-01",
             "2026-00-10", "2026-04-31", "2026-07-20T24:00", "2026-07-20T10:60", "2026-07-20T10:00:60", "2026-07-20T10:00+24:00", "0000-01-01", "2026-07",
             "2026", "10:00", "2026-7-20", "2026-07-20T", "2026-07-20T1", "2026-07-20T10:0", "2026-07-20T10:00:00.", "", "yesterday", "2026-07-2010:00",
             "2026-0720", "2026-07-20T10:00:00+5", "2026-07-20\u00e910:00", "2026-07-20T100000.5+0100"]

    def good(value):
        try:
            datetime.fromisoformat(value.replace("Z", "+00:00"))
            return True
        except ValueError:
            return False

    from tallyspark.operators import checks

    df = spark.createDataFrame([(f,) for f in forms] + [(None,)], "at string")
    assert {r["at"] for r in checks.invalid_iso8601(df, "at").collect()} == {f for f in forms if not good(f)} | {None}
    assert None not in {r["at"] for r in checks.invalid_iso8601(df, "at", nullable=True).collect()}


def test_line_numbers_hold_over_splits_and_blank_lines(spark, tmp_path):
    from tallyspark.sources import readers

    lines = ["" if k % 17 == 3 else '{"a": ' if k % 13 == 0 else f'{{"a": {k}}}' for k in range(4000)]
    (tmp_path / "one.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "two.jsonl").write_text('{"a": 1}\n\nbad')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        got = readers.bad_json_lines(spark, str(tmp_path), "a long")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        found = sorted((r.source_file.rsplit("/", 1)[-1], r.line_number, r.line) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [("one.jsonl", k + 1, x) for k, x in enumerate(lines) if x == '{"a": '] + [("two.jsonl", 3, "bad")]
    assert found == want


def test_line_numbers_need_no_shuffle_of_records(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables above it
    (tmp_path / "a.txt").write_text("".join(f'{{"i":{i}}}\n' for i in range(50)))
    records = readers.json_records(spark, str(tmp_path), "*.txt", lines=True)
    assert "BroadcastHashJoin" in records._jdf.queryExecution().sparkPlan().toString()
    assert sorted(r.source_ordinal for r in records.collect()) == list(range(50))
    lines = readers.numbered_lines(spark, str(tmp_path))
    assert "BroadcastHashJoin" in lines._jdf.queryExecution().sparkPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_manifest_hashes_bytes_without_holding_a_file(spark, tmp_path):
    import gzip
    import hashlib

    contents = {
        "a": b"one\ntwo\n", "b": b"one\ntwo", "c": b"\n", "d": b"\n\n", "e": b"\xef\xbb\xbfmark\r\nx", "f": b"\xef\xbb\xbfmark\n", "g": b"\xff\x00\xfe\n\xc3",
        "big": b"".join(b"%d line %s\n" % (i, b"x" * (i % 700)) for i in range(9000)), "h.gz": gzip.compress(b"packed\n")}
    for k, v in contents.items():
        (tmp_path / k).write_bytes(v)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")  # the big file takes several splits
    try:
        found = readers.file_manifest(spark, str(tmp_path))
        assert {r.file_name: r.sha256 for r in found.collect()} == {k: hashlib.sha256(v).hexdigest() for k, v in contents.items()}
        (tmp_path / "h.gz").unlink()
        plain = readers.file_manifest(spark, str(tmp_path))
        assert "sha2(content" not in plain._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
