"""Ingest cases on hand-written TSV quarters (FIXTURES.md §4)."""

import datetime as dt
import os
from decimal import Decimal

import pytest

from factlake.plans.ingest import ingest_quarters
from factlake.sources.lake import LakeTables, current_snapshot
from factlake.sources.tsv import parse_quarter, quarters_in_range
from tsvdata import (COLUMNS, num_row, pre_row, sub_row, tag_row, write_quarter,
                     write_table)


def _load(spark, scratch, quarters):
    return ingest_quarters(spark, f"{scratch}/raw", f"{scratch}/lake", quarters)


def _lake(spark, scratch):
    return LakeTables(spark, f"{scratch}/lake")


def test_cleaning_rules(spark, scratch):
    write_quarter(
        f"{scratch}/raw", "2024q1",
        [sub_row("A1", changed="abc", afs="NA", sic="\\N")],
        [tag_row("Revenues"), tag_row("Other", version="")],
        [num_row("A1"), num_row("A1", tag="Bad", ddate="20241399"),
         num_row("A1", tag="Far", ddate="29240101"), num_row("A1", tag="Seven", ddate="2024011"),
         num_row("A1", tag="V1", value="1.23456"), num_row("A1", tag="V2", value="2.50E7"),
         num_row("A1", tag="V3", value="abc"), num_row("A1", tag="NoUom", uom=""),
         num_row("A1", tag="Dup", value="999"), num_row("A1", tag="Dup")],
        [pre_row("A1")])
    res = _load(spark, scratch, ["2024q1"])
    assert res.failed == {}
    t = _lake(spark, scratch)
    s = t.sub.first()
    assert s["changed"] is None and s["afs"] is None and s["sic"] is None
    assert s["filed"] == dt.date(2024, 2, 15) and s["accepted"] == dt.datetime(2024, 2, 15, 16, 1)
    nums = {r["tag"]: r for r in t.num.collect()}
    assert set(nums) == {"Revenues", "V1", "V2", "V3", "Dup"}
    assert nums["V1"]["value"] == Decimal("1.2346")
    assert nums["V2"]["value"] == Decimal("25000000.0000")
    assert nums["V3"]["value"] is None
    assert nums["Revenues"]["segments"] == "" and nums["Revenues"]["coreg"] == ""
    assert nums["Dup"]["value"] == Decimal("999.0000")      # the first listed wins
    assert [r["tag"] for r in t.tag.collect()] == ["Revenues"]   # empty version dropped
    audit = {r["table_name"]: r for r in res.audit.collect() if r["quarter"] == "2024q1"}
    assert audit["num"]["rows_read"] == 10 and audit["num"]["dropped_null_key"] == 4
    assert audit["num"]["rows_in_lake"] == 5


def test_replace_by_filing_first_wins_and_rerun(spark, scratch):
    raw = f"{scratch}/raw"
    write_quarter(raw, "2024q1", [sub_row("A1"), sub_row("A2", cik="200")],
                  [tag_row("Revenues", tlabel="First")],
                  [num_row("A1", value="1"), num_row("A2", value="2")],
                  [pre_row("A1"), pre_row("A2")])
    write_quarter(raw, "2024q2", [sub_row("A1", name="Acme Amended", filed="20240601")],
                  [tag_row("Revenues", tlabel="Second")],
                  [num_row("A1", value="10"), num_row("A2", value="20")],
                  [pre_row("A1", line="5")])
    _load(spark, scratch, ["2024q1", "2024q2"])
    t = _lake(spark, scratch)
    assert {r["adsh"]: r["name"] for r in t.sub.collect()} == {"A1": "Acme Amended", "A2": "Acme Corp"}
    # A1 replaced by the later filing; A2 not relisted -> the first row stays
    assert {r["adsh"]: r["value"] for r in t.num.collect()} == {"A1": Decimal(10), "A2": Decimal(2)}
    assert sorted((r["adsh"], r["line"]) for r in t.pre.collect()) == [("A1", 5), ("A2", 1)]
    assert [r["tlabel"] for r in t.tag.collect()] == ["First"]
    counts = {k: v.count() for k, v in t.as_dict().items()}
    snap1 = current_snapshot(spark, f"{scratch}/lake")
    # rerun of the same quarter on the existing lake: identical counts
    _load(spark, scratch, ["2024q2"])
    assert current_snapshot(spark, f"{scratch}/lake") != snap1
    t2 = _lake(spark, scratch)
    assert {k: v.count() for k, v in t2.as_dict().items()} == counts
    assert {r["adsh"]: r["value"] for r in t2.num.collect()} == {"A1": Decimal(10), "A2": Decimal(2)}


def test_bad_quarter_does_not_block_others(spark, scratch):
    raw = f"{scratch}/raw"
    write_quarter(raw, "2024q1", [sub_row("A1")], [tag_row("Revenues")], [num_row("A1")],
                  [pre_row("A1")])
    write_quarter(raw, "2024q2", [sub_row("B1"), sub_row("B1")], [], [num_row("B1")], [])
    write_quarter(raw, "2024q3", [sub_row("C1")], [], [num_row("C1")], [], skip=("pre",))
    write_quarter(raw, "2024q4", [sub_row("D1", cik="")], [], [num_row("D1")], [])
    res = _load(spark, scratch, ["2024q1", "2024q2", "2024q3", "2024q4"])
    assert set(res.failed) == {"2024q2", "2024q3", "2024q4"}
    assert "missing" in res.failed["2024q3"]
    t = _lake(spark, scratch)
    assert [r["adsh"] for r in t.sub.collect()] == ["A1"]
    assert [r["adsh"] for r in t.num.collect()] == ["A1"]


def test_long_short_lines_utf8_and_header_order(spark, scratch):
    raw = f"{scratch}/raw"
    cols = list(reversed(COLUMNS["num"])) + ["extra"]
    write_table(raw, "2024q1", "num", [dict(num_row("A1"), extra="x")], columns=cols,
                extra_lines=["\t".join(["1"] * (len(cols) + 2)),      # too many fields, no date
                             "\t".join(["", "7", "", "", "USD", "4", "20231231", "us-gaap/2023",
                                        "Long", "A1", "x", "one too many"]),
                             "\t".join(["", "", "", "", "USD", "4", "20231231", "us-gaap/2023",
                                        "Short", "A1"])])            # one field short
    header = "\t".join(COLUMNS["sub"]).encode()
    row = sub_row("A1")
    row["name"] = "Bad\udcffName"
    line = "\t".join(str(row.get(c, "")) for c in COLUMNS["sub"])
    body = line.encode("utf-8", "surrogateescape")
    write_table(raw, "2024q1", "sub", [], raw_bytes=header + b"\n" + body + b"\n")
    write_table(raw, "2024q1", "tag", [tag_row("Revenues")])
    write_table(raw, "2024q1", "pre", [pre_row("A1")])
    res = _load(spark, scratch, ["2024q1"])
    assert res.failed == {}
    t = _lake(spark, scratch)
    assert t.sub.first()["name"] == "Bad�Name"
    nums = sorted(r["tag"] for r in t.num.collect())
    assert nums == ["Long", "Revenues", "Short"]      # a long line keeps its first fields
    assert {r["tag"]: r["value"] for r in t.num.collect()}["Long"] == Decimal(7)
    audit = {r["table_name"]: r for r in res.audit.collect()}
    assert audit["num"]["long_lines"] == 2 and audit["num"]["dropped_null_key"] == 1


def test_missing_column_or_required_value_fails_the_quarter(spark, scratch):
    raw = f"{scratch}/raw"
    write_quarter(raw, "2024q1", [sub_row("A1")], [tag_row("Revenues")], [num_row("A1")], [pre_row("A1")])
    for q, adsh in (("2024q2", "B1"), ("2024q3", "C1"), ("2024q4", "D1")):
        write_quarter(raw, q, [sub_row(adsh)], [tag_row("Other")], [num_row(adsh)], [pre_row(adsh)])
    write_table(raw, "2024q2", "num", [dict(num_row("B1"), valu="5")],
                columns=[c if c != "value" else "valu" for c in COLUMNS["num"]])
    write_table(raw, "2024q3", "tag", [tag_row("Other", custom="")])
    write_table(raw, "2024q4", "pre", [pre_row("D1", rfile="NA")])
    res = _load(spark, scratch, ["2024q1", "2024q2", "2024q3", "2024q4"])
    assert res.failed["2024q2"] == "missing columns: num: value"
    assert res.failed["2024q3"] == "missing required value in tag"
    assert res.failed["2024q4"] == "missing required value in pre"
    assert [r["adsh"] for r in _lake(spark, scratch).num.collect()] == ["A1"]


def test_part_files_bind_by_their_own_headers(spark, scratch):
    from factlake.sources.tsv import read_tsv

    os.makedirs(f"{scratch}/f")
    for name, text in (("part-0", "a\tb\n1\t2\n"), ("part-1", "b\ta\n10\t20\n"), ("part-2", "")):
        with open(f"{scratch}/f/{name}", "w") as f:
            f.write(text)
    rows = sorted((r["a"], r["b"]) for r in read_tsv(spark, f"{scratch}/f", ["a", "b"]).collect())
    assert rows == [("1", "2"), ("20", "10")]
    with pytest.raises(ValueError, match="lacks"):
        read_tsv(spark, f"{scratch}/f", ["a", "c"])


def test_failed_commit_and_concurrent_load_leave_the_lake(spark, scratch):
    from pyspark.sql import functions as F

    from factlake.sources import lake

    raw, lk = f"{scratch}/raw", f"{scratch}/lake"
    write_quarter(raw, "2024q1", [sub_row("A1")], [tag_row("Revenues")], [num_row("A1")], [pre_row("A1")])
    first = _load(spark, scratch, ["2024q1"]).snapshot
    assert not os.path.exists(f"{lk}/snapshots/{first}/_stage")
    bad = spark.range(1).select(F.raise_error(F.lit("audit")).cast("string").alias("quarter"))
    with pytest.raises(Exception, match="audit"):
        lake.commit_snapshot(spark, lk, "99990101T000000000000Z", bad, base=first)
    assert current_snapshot(spark, lk) == first
    with pytest.raises(lake.ConcurrentLoad):
        lake.commit_snapshot(spark, lk, "99990102T000000000000Z", spark.range(1), base=None)
    assert current_snapshot(spark, lk) == first


def test_quarter_bounds_list_only_their_folders(spark, scratch):
    raw = f"{scratch}/raw"
    write_quarter(raw, "2024q1", [sub_row("A1")], [tag_row("Revenues")], [num_row("A1")], [pre_row("A1")])
    write_quarter(raw, "2024q2", [sub_row("B1")], [tag_row("Revenues")], [num_row("B1")], [pre_row("B1")])
    _load(spark, scratch, ["2024q1", "2024q2"])
    t = LakeTables(spark, f"{scratch}/lake", quarters=["2024q2"])
    assert all("quarter=2024q2" in f for f in t.num.inputFiles()) and t.num.first()["adsh"] == "B1"


def test_quarter_labels():
    assert quarters_in_range("2021q3", "2022q2") == ["2021q3", "2021q4", "2022q1", "2022q2"]
    assert parse_quarter("2024Q1") == (2024, 1)
    with pytest.raises(ValueError):
        parse_quarter("2021q5")
    with pytest.raises(ValueError):
        quarters_in_range("2022q1", "2021q4")


def test_export_roundtrip_matches_fixture(spark, scratch):
    """Fixture tables -> quarterly TSV -> ingest -> lake equals the fixture
    (facts deduplicated on the natural key)."""
    from factlake.sources.export import write_quarter_files
    from factlake.sources.fixtures import fixture_tables
    from factlake.sources.tsv import SPARK_LAYOUT

    fx = fixture_tables(spark, "/root/testdata/sf0.001")
    quarters = write_quarter_files(fx, f"{scratch}/raw")
    res = ingest_quarters(spark, f"{scratch}/raw", f"{scratch}/lake", quarters, layout=SPARK_LAYOUT)
    assert res.failed == {}
    t = _lake(spark, scratch)
    assert t.sub.count() == fx.sub.count()
    keys = ["adsh", "tag", "version", "ddate", "qtrs", "uom", "segments", "coreg"]
    assert t.num.count() == fx.num.select(*keys).distinct().count()
    assert t.pre.count() == fx.pre.select("adsh", "report", "line").distinct().count()
    cols = ["adsh", "cik", "name", "sic", "form", "period", "filed"]
    assert t.sub.select(*cols).exceptAll(fx.sub.select(*cols)).count() == 0
    assert os.path.isdir(f"{scratch}/lake/snapshots")


def test_incremental_load_rewrites_only_affected_partitions(spark, scratch):
    from factlake.sources.lake import read_manifest

    raw, lk = f"{scratch}/raw", f"{scratch}/lake"
    write_quarter(raw, "2024q1", [sub_row("A1"), sub_row("A2", cik="200")],
                  [tag_row("Revenues")], [num_row("A1", value="1"), num_row("A2", value="2")],
                  [pre_row("A1"), pre_row("A2")])
    write_quarter(raw, "2024q2", [sub_row("B1", cik="300")], [tag_row("Assets")],
                  [num_row("B1", tag="Assets", value="3")], [pre_row("B1")])
    write_quarter(raw, "2024q3", [sub_row("A1", name="Acme Restated", filed="20240901")],
                  [tag_row("Revenues", tlabel="Later label")],
                  [num_row("A1", value="11")], [pre_row("A1", line="9")])
    first = ingest_quarters(spark, raw, lk, ["2024q1", "2024q2"]).snapshot
    second = ingest_quarters(spark, raw, lk, ["2024q3"]).snapshot
    entries = read_manifest(spark, lk, second)
    where = {(t, q): path for t, q, path in entries}
    # 2024q2 shares nothing with the new quarter: carried by reference
    for t in ("sub", "num", "pre", "tag"):
        assert f"/snapshots/{first}/" in where[(t, "2024q2")]
    # 2024q1 holds the relisted filing A1: rewritten in the new snapshot
    for t in ("sub", "num", "pre"):
        assert f"/snapshots/{second}/" in where[(t, "2024q1")]
    incremental = LakeTables(spark, lk)
    inc = {k: sorted(map(tuple, v.collect())) for k, v in incremental.as_dict().items()}

    full = ingest_quarters(spark, raw, f"{scratch}/lake2", ["2024q1", "2024q2", "2024q3"])
    assert full.failed == {}
    once = LakeTables(spark, f"{scratch}/lake2")
    assert {k: sorted(map(tuple, v.collect())) for k, v in once.as_dict().items()} == inc
    assert {r["adsh"]: r["value"] for r in incremental.num.collect()} == {
        "A1": Decimal(11), "A2": Decimal(2), "B1": Decimal(3)}


def test_presentation_key_loaded_twice_fails_the_later_quarter(spark, scratch):
    raw = f"{scratch}/raw"
    write_quarter(raw, "2024q1", [sub_row("A1")], [tag_row("Revenues")], [num_row("A1")],
                  [pre_row("A1")])
    # 2024q2 does not relist A1 but repeats its presentation key: the plain
    # insert of the original loader fails, so the whole quarter is rolled back
    write_quarter(raw, "2024q2", [sub_row("B1", cik="300")], [tag_row("Assets")],
                  [num_row("B1", tag="Assets")], [pre_row("A1"), pre_row("B1")])
    write_quarter(raw, "2024q3", [sub_row("C1", cik="400")], [], [num_row("C1", value="9")],
                  [pre_row("C1")])
    res = _load(spark, scratch, ["2024q1", "2024q2", "2024q3"])
    assert set(res.failed) == {"2024q2"} and "presentation" in res.failed["2024q2"]
    t = _lake(spark, scratch)
    assert sorted(r["adsh"] for r in t.sub.collect()) == ["A1", "C1"]
    assert sorted(r["adsh"] for r in t.num.collect()) == ["A1", "C1"]
    assert sorted(r["tag"] for r in t.tag.collect()) == ["Revenues"]


def _repeating_tables(spark, folder):
    """Orders and line items of which some come twice, two line items of one filing that share
    a presentation key, and an order without a date."""
    day = dt.datetime(1996, 2, 1)
    orders = [(1, 10, "F", 1.0, day, "1-URGENT"), (2, 20, "O", 1.0, day.replace(month=8), "2-HIGH"),
              (3, 30, "F", 1.0, dt.datetime(1997, 5, 1), "2-HIGH"), (4, 40, "F", 1.0, None, "2-HIGH")]
    line = (1, 16, 3, 1, 10.0, 100.0, 0.1, 0.1, "A", "F", day)
    lines = [line, (1, 17, 4, 2, 10.0, 200.0, 0.1, 0.1, "N", "F", day), (2, 18, 5, 1, 10.0, 300.0, 0.1, 0.1, "R", "F", day),
             (3, 19, 6, 1, 10.0, 400.0, 0.1, 0.1, "A", "F", day), (4, 20, 7, 1, 10.0, 500.0, 0.1, 0.1, "A", "F", day),
             (1, 16, 103, 1, 10.0, 600.0, 0.1, 0.1, "A", "F", day)]
    spark.createDataFrame([*orders, orders[0], orders[1]], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                          "o_orderdate timestamp_ntz, o_orderpriority string").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([*lines, line], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                          "l_shipdate timestamp_ntz").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")


@pytest.mark.parametrize("name, quarters", [("ingest_roundtrip", ["1996q1", "1996q3", "1997q2"]),
                                            ("ingest_incremental", ["1996q3", "2099q1"]), ("lake_statistics", None)])
def test_load_queries_on_repeated_keys(spark, scratch, name, quarters):
    from factlake.plans.operator_queries import operator_queries

    _repeating_tables(spark, scratch)
    rows = operator_queries()[name](spark, scratch).collect()
    if quarters is None:
        assert {r.table_name: r.n_rows for r in rows} == {"sub": 3, "num": 5, "pre": 4, "tag": 5}
        return
    of = {t: sorted((r.quarter, r.row_text.split("|")[0].removeprefix("Amended ")) for r in rows if r.table_name == t) for t in ("sub", "num", "pre")}
    assert [a for _, a in sorted(of["sub"], key=lambda x: x[1])] == ["1", "2", "3"]
    assert sorted({q for q, _ in of["sub"]}) == quarters
    assert [a for _, a in sorted(of["num"], key=lambda x: x[1])] == ["1", "1", "1", "2", "3"]
    assert [a for _, a in sorted(of["pre"], key=lambda x: x[1])] == ["1", "1", "2", "3"]


def _filings(spark, folder):
    """Tables of 40 filings with three lines each, as the fixture views read them."""
    day = [(dt.date(1995, 5, 3), dt.date(1996, 2, 3), dt.date(1996, 8, 3), dt.date(1997, 4, 3))[i % 4] for i in range(40)]
    orders = [(i, 10 * i, day[i], "2-HIGH", "FPO"[i % 3]) for i in range(40)]
    items = [(i, 7 * i + n, i + n, n, Decimal(n), Decimal(100 * i + n), Decimal(n % 2), "ANR"[n % 3], "F", day[i])
             for i in range(40) for n in range(1, 4)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string, o_orderstatus string") \
        .write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity decimal(15,2), "
                          "l_extendedprice decimal(15,2), l_tax decimal(15,2), l_returnflag string, l_linestatus string, l_shipdate date") \
        .write.parquet(f"{folder}/lineitem.parquet")


def _run_load(spark, scratch, monkeypatch, query, share_bytes):
    """Rows of a query on these tables; what its files were when it had read them; what it leaves."""
    from factlake.operators import upsert
    from factlake.plans import operator_queries as Q
    from factlake.sources import lake
    from factlake.sources.fixtures import fixture_tables

    if not os.path.exists(f"{scratch}/tables"):
        _filings(spark, f"{scratch}/tables")
    work, files, delete = f"{scratch}/{query}-{share_bytes}", [], lake.remove

    def seen(session, path):
        files.extend(n for _, _, names in os.walk(path) for n in names if path.startswith(work) and "/lake/" not in path and n.startswith("part-"))
        delete(session, path)

    monkeypatch.setattr(upsert, "SHARE_BYTES", share_bytes)
    monkeypatch.setattr(upsert, "MOST_SHARES", 3)
    monkeypatch.setattr(Q, "_load_folder", lambda _: work)
    monkeypatch.setattr(lake, "remove", seen)
    out = sorted(tuple(r) for r in getattr(Q, query)(fixture_tables(spark, f"{scratch}/tables")).collect())
    monkeypatch.undo()
    return out, files, os.listdir(work)


def _whole_and_in_shares(spark, scratch, monkeypatch, query):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    rows, files, left = _run_load(spark, scratch, monkeypatch, query, 1 << 40)
    assert files and all(f.endswith(".gz") for f in files) and left == ["lake"]
    shared, more, left = _run_load(spark, scratch, monkeypatch, query, 1)
    assert shared == rows and len(more) > len(files) and left == ["lake"]
    assert spark.conf.get(name, None) == before
    return rows


def test_roundtrip_keeps_little_on_disk(spark, scratch, monkeypatch):
    """Files are compressed and go once they are read; written in shares of the filings, the rows are the same."""
    rows = _whole_and_in_shares(spark, scratch, monkeypatch, "ingest_roundtrip")
    assert [sum(r[0] == t for r in rows) for t in ("sub", "num", "pre")] == [40, 120, 120]


def test_dirty_load_keeps_little_on_disk(spark, scratch, monkeypatch):
    rows = _whole_and_in_shares(spark, scratch, monkeypatch, "ingest_dirty")
    assert sum(r[0] == "audit" for r in rows) == 4 and any("missing files: pre" in r[2] for r in rows)


def test_incremental_keeps_little_on_disk(spark, scratch, monkeypatch):
    """Also the second load, which reads its own files and resolves against the lake."""
    rows = _whole_and_in_shares(spark, scratch, monkeypatch, "ingest_incremental")
    assert sum(r[0] == "num" for r in rows) == 120 and any(r[1] == "2099q1" and "Amended" in r[2] for r in rows)


def test_statistics_of_a_lake_written_in_shares(spark, scratch, monkeypatch):
    rows = _whole_and_in_shares(spark, scratch, monkeypatch, "lake_statistics")
    assert {r[0]: r[1] for r in rows if r[0] != "tag"} == {"sub": 40, "num": 120, "pre": 120}
