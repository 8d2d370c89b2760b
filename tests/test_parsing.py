import csv

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from panelmill.operators.parsing import KLINE_FIELDS, invalid_rows, parse_klines, valid_bars

GOOD = "1735689600000,1,2,.5,1.5,10,1735689899999,15,3,5,7.5,0"


def reasons(spark, lines):
    df = spark.createDataFrame([(i, x, "clash", 1) for i, x in enumerate(lines)], "line_id long, raw_line string, fields string, reason int")
    p = parse_klines(df)
    return {r["line_id"]: (r["reason"], list(r["errors"])) for r in p.collect()}


CASES = {
    GOOD: None,
    GOOD + "\r": None,
    GOOD.replace(",", " ,\t"): None,
    ",".join(f'"{x}"' for x in GOOD.split(",")): None,
    GOOD[:-1] + "0.00": None,
    GOOD[:-1] + "0e5": None,
    GOOD.replace("1735689600000", "1735689600000000").replace("1735689899999", "1735689899999000"): None,
    GOOD.replace("1.5,10", "1.5e-3,1E1"): None,
    GOOD[:-1] + "1": "value",
    GOOD[:-1] + "-0": "value",
    GOOD[:-1] + "": "value",
    GOOD[:-1] + "1e-400": "value",
    GOOD.replace("1735689600000", "17356896000"): "value",
    GOOD.replace("1735689600000", "1735689600000000"): "value",
    GOOD.replace("1735689899999", "1735689500000"): "value",
    GOOD.replace(",3,", ",3.0,"): "value",
    GOOD.replace(",10,", ",+10,"): "value",
    GOOD.replace(",10,", ",-10,"): "value",
    GOOD.replace(",10,", ",1e999,"): "value",
    GOOD.replace(",10,", ",NaN,"): "value",
    GOOD.replace(",10,", ",1_0,"): "value",
    GOOD.replace(",10,", ',"1,0",'): "value",
    GOOD.replace(",10,", ',"1""0",'): "value",
    GOOD.replace("1735689600000", "１735689600000"): "value",
    GOOD + "\n": "value",
    GOOD + "\r\n": "value",
    GOOD + "\r\r": "value",
    GOOD + "\u2028": "value",
    GOOD + "\x85": "value",
    GOOD.replace(",3,", ",3\n,"): "value",
    GOOD.replace("1735689600000,", "1735689600000\n,"): "value",
    GOOD + ",": "column_count",
    GOOD.rsplit(",", 1)[0]: "column_count",
    "": "column_count",
    "   ": "column_count",
    GOOD.replace(",", ";"): "column_count",
    GOOD.replace(",10,", ',"10,'): "quoting",
    GOOD.replace(",10,", ',1"0,'): "quoting",
    GOOD.replace(",10,", ',"10"x,'): "quoting",
    GOOD.replace(",10,", ', "10",'): "quoting",
    GOOD + '"': "quoting",
    '"': "quoting",
    '""': "column_count",
    '"""': "quoting",
}


def test_each_case(spark):
    got = reasons(spark, [*CASES, None])
    assert {x: got[i][0] for i, x in enumerate(CASES)} == CASES
    assert got[len(CASES)][0] == "column_count"
    assert got[list(CASES).index(GOOD[:-1] + "1")][1] == ["value:ignore"]


def test_headers_are_left_out(spark):
    header = ",".join(KLINE_FIELDS)
    assert reasons(spark, [header, header.upper(), "﻿" + header, header + "\r", ",".join(f'"{f}"' for f in KLINE_FIELDS)]) == {}


def test_long_lines_and_empty_tables(spark):
    long = '"' + 'ab""' * 50_000 + '"'
    assert [r[0] for r in reasons(spark, [long, "," * 100_000, '"' * 100_001]).values()] == ["column_count", "column_count", "quoting"]
    assert reasons(spark, []) == {}


def test_valid_lines_are_typed(spark):
    df = spark.createDataFrame([(1, GOOD), (2, GOOD), (3, "bad")], "line_id long, raw_line string")
    rows = valid_bars(parse_klines(df)).orderBy("line_id").collect()
    assert [r["line_id"] for r in rows] == [1, 2] and str(rows[0]["timestamp"]) == "2025-01-01 00:00:00" and rows[0]["trade_count"] == 3
    assert invalid_rows(parse_klines(df)).count() == 1
    wide = spark.createDataFrame([(1, GOOD), (2, GOOD.replace(",3,", ",12345678901234567890,")), (3, GOOD.replace(",3,", "," + "9" * 60 + ","))], df.schema)
    got = {r["line_id"]: (r["trade_count"], r["trade_count_overflow"]) for r in valid_bars(parse_klines(wide)).collect()}
    assert got == {1: (3, None), 2: (None, "12345678901234567890"), 3: (None, "9" * 60)}


def machine(line):
    """Character by character: fields, or None for broken quoting."""
    fields, i = [], 0
    while True:
        if i < len(line) and line[i] == '"':
            i, buf = i + 1, ""
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        buf, i = buf + '"', i + 2
                        continue
                    i += 1
                    break
                buf, i = buf + line[i], i + 1
            fields.append(buf)
            if i < len(line) and line[i] != ",":
                return None
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            if '"' in line[i:j]:
                return None
            fields.append(line[i:j])
            i = j
        if i >= len(line):
            return fields
        i += 1


@given(st.lists(st.text('",a ', max_size=12), min_size=30, max_size=30))
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_splitting_matches_a_state_machine(spark, lines):
    got = reasons(spark, lines)
    for i, line in enumerate(lines):
        fields = machine(line)
        assert got[i][0] == ("quoting" if fields is None else "column_count" if len(fields) != 12 else "value"), line


def test_reader_agreement():
    line = '1,"a,b",,"c""d"'
    assert machine(line) == next(csv.reader([line]))

