from datetime import datetime

from ticketloom.operators.references import bloom_words, orphan_references, orphan_report

SCHEMA = "issue_id long, linked_issue_ids string, duplicate_issue_ids string, loaded_at timestamp_ntz, maybe string"
FIELDS = ["linked_issue_ids", "duplicate_issue_ids"]
T = datetime


def find(spark, rows, gone=(), **options):
    r = spark.createDataFrame([(*x, "clash") for x in rows], SCHEMA)
    d = spark.createDataFrame(list(gone), "issue_id long, deleted_at timestamp_ntz")
    return sorted(map(tuple, orphan_references(r, d, FIELDS, **options).collect()), key=str)


def test_missing_later_and_deleted(spark):
    rows = [
        (1, "A-2||x7||n/a||", None, T(2024, 1, 5)), (2, "  3 ||#4", "", T(2024, 1, 9)), (3, None, "1", T(2024, 2, 1)), (4, "", "1", T(2024, 1, 31, 23)),
    ]
    gone = [(1, T(2024, 1, 31, 23, 59)), (1, T(2025, 1, 1)), (1, T(2024, 1, 31, 23, 59))]
    assert find(spark, rows, gone) == [
        (1, "linked_issue_ids", 7, "2024-01"), (2, "linked_issue_ids", 3, "2024-01"), (3, "duplicate_issue_ids", 1, "2024-02"), (4, "duplicate_issue_ids", 1, "2024-01")]


def test_a_tiny_filter_changes_nothing(spark):
    rows = [(k, f"{k + 1}||{k + 5000}", None, T(2024, 1, 1)) for k in range(300)]
    assert find(spark, rows, most_words=2) == find(spark, rows) and len(find(spark, rows)) == 301


def test_the_filter_follows_the_keys(spark):
    assert [bloom_words(n) for n in (0, 1, 1000, 10_000_000, 10**12)] == [64, 64, 256, 1 << 21, 1 << 22]
    report = {}
    rows = [(k, f"{k + 100_000}", None, T(2024, 1, 1)) for k in range(2000)]
    assert len(find(spark, rows, report=report)) == 2000 and report["n_keys"] == report["n_references"] == 2000 and report["n_proven"] > 1900


def test_repeats_nulls_and_reloads(spark):
    row = (1, "9||9||99999999999999999999", None, T(2024, 1, 1))
    assert find(spark, [row, row, (1, "9", None, T(2024, 3, 1)), (None, "1", None, None)]) == [(1, "linked_issue_ids", 9, "2024-01"), (1, "linked_issue_ids", 9, "2024-03")]


def test_empty_tables(spark):
    assert find(spark, []) == []


def test_report(spark):
    r = spark.createDataFrame([(1, "1||9", "9", T(2024, 1, 1), "")], SCHEMA)
    d = spark.createDataFrame([], "issue_id long, deleted_at timestamp_ntz")
    got = sorted(map(tuple, orphan_report(orphan_references(r, d, FIELDS, keep_sound=True)).collect()))
    assert got == [("duplicate_issue_ids", "2024-01", 1, 1, 1), ("linked_issue_ids", "2024-01", 2, 1, 1)]
