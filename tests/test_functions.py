import datetime as dt
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillet import functions as Q
from quillet.operators.pages import PageSelection, pages_of_spec, parse_range
from quillet.operators.rules import Validation


def one(spark, *columns):
    return spark.range(1).select(*columns).collect()[0]


@pytest.mark.parametrize("n,letters", [(1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (702, "ZZ"), (703, "AAA"), (16384, "XFD"), (0, None), (16385, None)])
def test_column_letters(spark, n, letters):
    assert one(spark, Q.column_letters(F.lit(n)))[0] == letters
    if letters:
        assert one(spark, Q.column_number(F.lit(letters.lower())))[0] == n


@pytest.mark.parametrize("address,row,col", [("A1", 1, 1), ("xfd1048576", 1048576, 16384), ("B", None, 2), ("12", None, None), ("A0", None, 1), ("", None, None)])
def test_addresses(spark, address, row, col):
    assert tuple(one(spark, Q.a1_row(F.lit(address)), Q.a1_column(F.lit(address)))) == (row, col)


def test_addresses_beyond_a_sheet(spark, tmp_path):
    """a1() knows the sheet's end; the queries address a table's rows beyond it, as their SQL does."""
    assert tuple(one(spark, Q.a1(F.lit(1_048_576), F.lit(16_384)), Q.a1(F.lit(1_048_577), F.lit(1)), Q.a1(F.lit(0), F.lit(1), rows=None), Q.a1(F.lit(2**31), F.lit(1), rows=None))) == ("XFD1048576", None, None, "A2147483648")
    keys = [0, 1_048_574, 1_048_575, 1_048_576, 8_999_999, 2**31 - 2]
    spark.createDataFrame([(k, k % 900_000) for k in keys], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
        for name in ("a1_address", "a1_parse"):
            got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).orderBy("o_orderkey").collect()]
            assert got == duck.execute(entry.oracle_sql()[name] + " ORDER BY o_orderkey").fetchall() and len(got) == len(keys)


@pytest.mark.parametrize("value,days", [("2026-01-15 14:30:45", 46037.6046875), ("1899-12-31 12:00:00", 1.5), ("1900-03-01 00:00:00", 61.0)])
def test_serials(spark, value, days):
    r = one(spark, Q.serial(F.lit(value)), Q.from_serial(F.lit(days)), Q.from_serial(F.lit(days - 1462), date1904=True))
    assert r[0] == days and r[1] == r[2] == dt.datetime.fromisoformat(value)
    assert one(spark, Q.from_serial(F.lit(1e10)))[0] is None


@pytest.mark.parametrize(
    "id,code,date",
    [(14, None, True), (22, None, True), (45, None, True), (1, "0", False), (0, "yyyy", True), (100, "yyyy", False), (164, "yyyy-mm-dd", True), (165, '"yard" 0', False), (166, "[h]:mm", True), (167, "[Red]0.0", False), (168, "[White]0", False), (169, "[$-en-US]0", False), (170, "\\d0", False), (171, "General", False), (172, "", False)],
)
def test_date_formats(spark, id, code, date):
    assert Q.is_date_format(id, code) is date
    assert one(spark, Q.is_date_format_column(F.lit(id), F.lit(code).cast("string")))[0] is date


def test_halves_go_to_even(spark):
    assert list(one(spark, *[Q.half_even_int(F.lit(x)) for x in (0.5, 1.5, 2.5, -0.5, 1e10)])) == [0, 2, 2, 0, None]


def test_templates(spark):
    r = one(spark, Q.fill_template(F.lit("{{A}} {{b}} {{B}}"), {"A": "{{B}}", "B": "x"}), Q.fill_template(F.lit("{{B}}{{A}}"), {"B": "{{A}}", "A": "y"}), Q.has_placeholder(F.lit("a {{\n}} b")), Q.has_placeholder(F.lit("}} {{")))
    assert list(r) == ["x {{b}} x", "yy", True, False]


def test_audit(spark):
    assert one(spark, Q.audit_line(F.lit("a\tb\r\nc"), F.lit(None), F.lit(3)))[0] == "a b  c\t\t3"
    assert one(spark, Q.iso_instant(F.lit("2024-05-06 07:08:09.123456").cast("timestamp_ntz")))[0] == "2024-05-06T07:08:09.1234560"


def test_colors(spark):
    assert one(spark, Q.hex_color(F.lit("#ff00Aa")), Q.hex_color(F.lit(None).cast("string")))[0:2] == ("FF00AA", None)
    for bad in ("##ff00aa", "ff00a", "gg0000"):
        with pytest.raises(Exception, match="not a color"):
            one(spark, Q.hex_color(F.lit(bad)))


def test_password_hash_is_iterated():
    h = hashlib.sha512(b"s" * 16 + "pw".encode("utf-16-le")).digest()
    for i in range(3):
        h = hashlib.sha512(h + i.to_bytes(4, "little")).digest()
    import base64

    assert Q.password_hash("pw", b"s" * 16, 3)["hashValue"] == base64.b64encode(h).decode()


@pytest.mark.parametrize("spec,n,pages", [("1-3, 5", 10, [1, 2, 3, 5]), ("7", 10, [7]), ("9-11", 10, [9, 10]), (" 2 - 4 , 2 ", 10, [2, 3, 4]), ("", 5, []), ("5,1", 5, [1, 5])])
def test_page_ranges(spark, spec, n, pages):
    assert one(spark, PageSelection.range(spec).resolve(F.lit(n)))[0] == pages
    assert one(spark, pages_of_spec(F.lit(spec), F.lit(n)))[0] == pages


@pytest.mark.parametrize("spec", ["0-3", "5-2", "abc", "3-"])
def test_broken_page_ranges(spark, spec):
    with pytest.raises(ValueError):
        parse_range(spec)
    with pytest.raises(Exception, match="not a page range"):
        one(spark, pages_of_spec(F.lit(spec), F.lit(9)))


@pytest.mark.parametrize("selection,pages", [(PageSelection.all(), [1, 2, 3, 4, 5]), (PageSelection.none(), []), (PageSelection.odd(), [1, 3, 5]), (PageSelection.even(), [2, 4]), (PageSelection.current(9), []), (PageSelection.first(2), [1, 2]), (PageSelection.last(2), [4, 5]), (PageSelection.explicit(5, 1, 5, 8), [1, 5]), (PageSelection.range("2-3"), [2, 3])])
def test_page_selections(spark, selection, pages):
    assert one(spark, selection.resolve(F.lit(5)))[0] == pages
    assert PageSelection.parse(str(selection)) == selection


def test_validations_without_bounds_and_with_blanks(spark):
    v = Validation.decimal_number()
    assert list(one(spark, v.holds(F.lit(0)), v.holds(F.lit(1)), v.holds(F.lit(None).cast("int")), Validation.list("a", allow_blank=False).holds(F.lit(None).cast("string")))) == [True, False, True, False]
    with pytest.raises(ValueError):
        Validation.list("x" * 256)
