"""Delimited lines: valid rows typed, invalid rows kept apart with their reasons.

One narrow projection without any shuffle.  Every field is first a nullable text; a list of
vectorised rules then fills an array of errors per line, and the lines split by whether that
array is empty.  The quoting rules are evaluated without a regular expression over the whole
line (a backtracking engine would overflow its stack on very long lines): splitting at the
double quotes puts quoted text at the odd places, and each rule is a test of one piece.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions.scalar import micros_to_ntz, settle

BOM = "﻿"
#: Stands for a comma inside quotes while the line is split at the others.
HELD_COMMA = "\x01"
#: The very end, ``z``, is meant; a dollar sign would also stand before a last line break.
NUMBER = r"^([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
ZERO = r"^(0+\.?0*|\.0+)([eE][+-]?[0-9]+)?\z"
EPOCH = r"^([0-9]{13}|[0-9]{16})\z"
DIGITS = r"^[0-9]+\z"

#: The fields of a kline line, in order.
KLINE_FIELDS = [
    "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume",
    "trade_count", "taker_buy_volume", "taker_buy_quote_volume", "ignore",
]
KLINE_NUMBERS = ["open", "high", "low", "close", "volume", "quote_volume", "taker_buy_volume", "taker_buy_quote_volume"]


@dataclass(frozen=True)
class Rule:
    """A named constraint; ``broken`` is true or null where the row violates it."""

    name: str
    broken: Column


def kline_rules() -> list[Rule]:
    """The value rules of a kline line, over its trimmed text fields."""
    t, end = F.col("open_time"), F.col("close_time")
    rules = [
        Rule("open_time", ~t.rlike(EPOCH)),
        Rule("close_time", ~end.rlike(EPOCH) | (F.length(end) != F.length(t)) | (end < t)),
        Rule("trade_count", ~F.col("trade_count").rlike(DIGITS)),
        Rule("ignore", ~F.col("ignore").rlike(ZERO)),
    ]
    return rules + [Rule(f, ~(F.col(f).rlike(NUMBER) & (F.col(f).try_cast("double") < F.lit(float("inf"))))) for f in KLINE_NUMBERS]


def split_quoted(df: DataFrame, line: str, keep: list[str]) -> DataFrame:
    """``keep`` with ``fields`` (array of text) and ``misquoted`` (boolean) of a comma-separated line."""
    given = F.coalesce(F.col(line), F.lit(""))
    bare = F.when(given.endswith("\r"), F.left(given, F.length(given) - 1)).otherwise(given)  # one carriage return belongs to the line end
    pieces = settle(
        settle(df, keep, text=bare),
        [*keep, "text"],
        pieces=F.when(F.contains(F.col("text"), F.lit('"')), F.split("text", '"', -1)),
    )
    last = F.size("pieces") - 1

    def broken(piece: Column, i: Column) -> Column:
        before = piece.endswith(",") | (i == last)  # what precedes an opening quote
        after = piece.startswith(",") | (i == 0)  # what follows a closing quote
        return (i % 2 == 0) & (piece != "") & ~(before & after)

    def outside(piece: Column, i: Column) -> Column:
        doubled = (i > 0) & (i < last) & (piece == "")
        return F.when(i % 2 == 1, F.translate(piece, ",", HELD_COMMA)).when(doubled, F.lit('"')).otherwise(piece)

    cut = F.transform(F.split(F.array_join(F.transform("pieces", outside), ""), ",", -1), lambda x: F.translate(x, HELD_COMMA, ","))
    return settle(
        pieces,
        keep,
        misquoted=F.coalesce((last % 2 == 1) | (F.size(F.filter("pieces", broken)) > 0), F.lit(False)),
        fields=F.when(F.col("pieces").isNull(), F.split("text", ",", -1)).otherwise(cut),
    )


def parse_klines(lines: DataFrame, line: str = "raw_line", keep: list[str] = ["line_id"]) -> DataFrame:  # noqa: B006
    """Every data line with its text fields, an ``errors`` array and ``reason`` (its first error's class).

    ``reason`` is null for a valid line, else the first that applies of ``quoting``,
    ``column_count`` and ``value``; ``errors`` names each broken rule (``value:<field>``).

    Defined cases: a null or empty line has one empty field, so ``column_count``; one carriage
    return at the end belongs to the line end; spaces and tabs around a value are trimmed; a line
    whose first field is ``open_time`` in any case, also after a byte order mark, is a header and is
    left out; repeated lines are judged one by one; columns not in ``keep`` are dropped, so their
    names cannot clash; an empty table gives an empty result.
    """
    base = lines.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keep)], F.col(line).alias("__line"))
    kept = [f"__k{i}" for i in range(len(keep))]
    cut = split_quoted(base, "__line", kept)
    first = F.lower(F.btrim(F.regexp_replace(F.get("fields", F.lit(0)), f"^{BOM}", ""), F.lit(' \t"')))
    data = cut.where(F.coalesce(first != "open_time", F.lit(True)))
    texts = data.select(
        *kept,
        "misquoted",
        F.size("fields").alias("n_fields"),
        *[F.btrim(F.get("fields", F.lit(i)), F.lit(" \t")).alias(f) for i, f in enumerate(KLINE_FIELDS)],
    )
    well_formed = ~F.col("misquoted") & (F.col("n_fields") == len(KLINE_FIELDS))
    errors = F.array_compact(
        F.array(
            F.when(F.col("misquoted"), F.lit("quoting")),
            F.when(F.col("n_fields") != len(KLINE_FIELDS), F.lit("column_count")),
            *[F.when(well_formed & F.coalesce(r.broken, F.lit(True)), F.lit(f"value:{r.name}")) for r in kline_rules()],
        )
    )
    return settle(texts, [*kept, *KLINE_FIELDS], errors=errors).select(
        *[F.col(f"__k{i}").alias(k) for i, k in enumerate(keep)],
        *KLINE_FIELDS,
        "errors",
        F.substring_index(F.get("errors", F.lit(0)), ":", 1).alias("reason"),
    )


def invalid_rows(parsed: DataFrame) -> DataFrame:
    """The lines with errors."""
    return parsed.where(F.size("errors") > 0)


def valid_bars(parsed: DataFrame) -> DataFrame:
    """The lines without errors, typed; 13-digit times are milliseconds, 16-digit ones microseconds.

    A trade count beyond 64 bits is null and stands, as text, in ``trade_count_overflow``, null otherwise.
    """

    def micros(c: str) -> Column:
        return F.when(F.length(c) == 13, F.col(c).try_cast("bigint") * 1000).otherwise(F.col(c).try_cast("bigint"))

    rest = [c for c in parsed.columns if c not in {*KLINE_FIELDS, "errors", "reason"}]
    return parsed.where(F.size("errors") == 0).select(
        *rest,
        micros_to_ntz(micros("open_time")).alias("timestamp"),
        micros_to_ntz(micros("close_time")).alias("available_time"),
        *[F.col(f).try_cast("double").alias(f) for f in ["open", "high", "low", "close", "volume", "quote_volume"]],
        F.col("trade_count").try_cast("bigint").alias("trade_count"),
        F.when(F.col("trade_count").try_cast("bigint").isNull(), F.col("trade_count")).alias("trade_count_overflow"),
        *[F.col(f).try_cast("double").alias(f) for f in ["taker_buy_volume", "taker_buy_quote_volume"]],
    )
