"""Containment of items in documents: one pass for items that fit in a task, equal to the joins, and to SQL."""

import duckdb
import pytest

from gradus.operators import contamination
from gradus.plans import catalogue

ITEMS = ["one two three four five", "six seven", "", None, "One two, three four six", "six seven", "a a a a a", "one two three four", "kilo K", "İstanbul", "naïve café", "_x", "...", "six", "seven eight nine"]
DOCS = ["x ONE two three four five y", "six; seven", "sixseven", "one two three four", None, "one two three four six seven eight", "onesix seven eight", "", "a " * 9, "KILO K", "i stanbul i̇stanbul", "naïve café, na ve", "é_X é", "one two three fourfive six", "!?", "b a a a a"]


@pytest.fixture()
def frames(spark):
    return spark.createDataFrame([*enumerate(DOCS)], "id long, text string"), spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(ITEMS)], "item_id string, text string")


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_scan_finds_what_the_joins_find(frames, monkeypatch, piece):
    monkeypatch.setattr(contamination, "_PIECE", piece)
    d, i = frames
    by_scan, by_keys, by_shuffle = (sorted(tuple(r) for r in contamination.contained(d, i, *most).collect()) for most in ((1000,), (1000, 0), (0,)))
    assert by_scan == by_keys == by_shuffle and {(5, "i4"), (5, "i7"), (8, "i6"), (9, "i8"), (10, "i9"), (11, "i10"), (12, "i11"), (13, "i13")} <= set(by_scan) and not any(k in (2, 4, 6, 7, 14, 15) and x != "i14" for k, x in by_scan)


def test_pieces_of_a_long_text(monkeypatch):
    words = [b"w%d" % (k * k % 97) for k in range(400)]
    items = contamination._Items([b" ".join(words[k : k + n]) for k in range(0, 390, 3) for n in (1, 2, 3, 4, 5, 9)])
    whole = items.within(b", ".join(words))
    monkeypatch.setattr(contamination, "_PIECE", 5)
    assert items.within(b", ".join(words)) == whole == set(range(130 * 6))


def test_no_shuffle_of_documents(spark):
    df = catalogue.benchmark_containment(spark, "/root/testdata/sf0.001")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_repeated_and_unnamed_documents_as_in_sql(spark, tmp_path):
    docs = spark.createDataFrame([(1, "p q r s t"), (1, "p q r s t"), (None, "q r"), (2, "q")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "q r"), (7, "Q R"), (8, "p q r s")], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(catalogue.ORACLES["benchmark_containment"]).fetchall()
    assert sorted(map(repr, map(tuple, catalogue.benchmark_containment(spark, str(tmp_path)).collect()))) == sorted(map(repr, want)) and len(want) == 8


def test_empty_sides(spark, frames):
    d, i = frames
    assert contamination.contained(d.limit(0), i).collect() == contamination.contained(d, i.limit(0)).collect() == []
