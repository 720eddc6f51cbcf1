import datetime as dt
import hashlib

from pyspark.sql import functions as F

from assayer.functions import cleaning as cl
from assayer.functions import sales
from assayer.functions.hashing import NULL_KEY, row_hash, row_json, surrogate_key


def test_trim_strips_all_unicode_space_and_blank_is_null(column):
    values = ["\t Web \n", "   ", " x　", " ", None, "", "a b"]
    assert column(cl.text, values) == ["Web", None, "x", None, None, None, "a b"]
    spaces = list(cl.WHITESPACE)
    edges = [s + "a" + t for s in spaces for t in spaces] + ["é", " é\u00a0", "\x7f", "~", "!", "\u200b"]
    expected = ["a"] * len(spaces) ** 2 + ["é", "é", "\x7f", "~", "!", "\u200b"]
    assert column(cl.text, edges) == expected
    assert column(cl.lower_text, ["\t Web \n", "PROSPECCIÓN"]) == ["web", "prospección"]
    assert column(cl.upper_text, [" mx "]) == ["MX"]


def test_safe_date_takes_full_dates_only(column):
    values = ["2026-04-22", "2026-04", "2026-04-22T09:00:00", "x", "2026-4-2", "2026-02-30", " 2026-04-22 ", None]
    day = dt.date(2026, 4, 22)
    assert column(cl.safe_date, values) == [day, None, None, None, dt.date(2026, 4, 2), None, day, None]


def test_safe_timestamp_needs_a_full_date(column):
    values = ["2026-04-22T09:00:00Z", "12:30:00", "2026", "2026-04-22", "2026-04-22 09:00:00+02:00", "T", "2026-04-22 9:5:1.25"]
    assert column(lambda c: F.date_format(cl.safe_timestamp(c), "yyyy-MM-dd HH:mm:ss.SSS"), values) == [
        "2026-04-22 09:00:00.000",
        None,
        None,
        "2026-04-22 00:00:00.000",
        "2026-04-22 07:00:00.000",
        None,
        "2026-04-22 09:05:01.250",
    ]


def test_title_case_starts_words_after_punctuation(column):
    values = ["on_hold-now", "CRUISE line", "a\tb", "éa.ñb", "(x) [y]", None, ""]
    assert column(cl.title_case, values) == ["On_Hold-Now", "Cruise Line", "A\tB", "Éa.Ñb", "(X) [Y]", None, ""]


def test_title_case_matches_brute_force(column):
    delimiters = set(cl.TITLE_DELIMITERS) | set(" \t\n")
    texts = [f"ab{d}cD{d}{d}e" for d in sorted(delimiters)] + ["".join(sorted(delimiters)) + "zZ"]

    def brute(text):
        out, start = [], True
        for ch in text:
            out.append(ch.upper() if start else ch.lower())
            start = ch in delimiters
        return "".join(out)

    assert column(cl.title_case, texts) == [brute(t) for t in texts]


def test_agent_names(column):
    values = ["agent_7", "AGENT-07", "agent_123", "bob", None, "Agent 5", "my agent3 x9", "agents 4"]
    expected = ["Agent 07", "Agent 07", "Agent 12", "bob", None, "Agent 05", "Agent 03", "agents 4"]
    assert column(sales.normalize_agent, values) == expected


def test_stage_and_product_names(column):
    values = [*sales.STAGE_ALIASES, "GANADO", "on_hold-now", None]
    assert column(sales.normalize_stage, values) == [*sales.STAGE_ALIASES.values(), "Won", "On_Hold-Now", None]
    values = [*sales.PRODUCT_ALIASES, "VUELO", "bus_tour", None]
    assert column(sales.normalize_product, values) == [*sales.PRODUCT_ALIASES.values(), "Flight", "Bus_Tour", None]


def test_probability_is_zero_for_unknown_stages(column):
    assert column(sales.win_probability, [*sales.STAGE_ORDER, "Other", None]) == [0.1, 0.25, 0.45, 0.7, 1.0, 0.0, 0.0, 0.0]


def test_close_buckets_and_bands(column):
    days = [-1, 0, 7, 8, 30, 31, None]
    expected = ["Overdue", "This Week", "This Week", "This Month", "This Month", "Later", "Later"]
    assert column(sales.close_bucket, days, "c int") == expected
    rates = [100.0, 40.0, 39.99, 20.0, 19.99, 0.0]
    assert column(sales.win_rate_band, rates, "c double") == ["high", "high", "medium", "medium", "low", "low"]
    assert column(sales.low_win_rate, rates, "c double") == [False, False, False, False, True, True]


def test_row_json_keeps_nulls_and_microseconds(spark):
    df = spark.sql("SELECT 'x' AS a, CAST(NULL AS STRING) AS b, TIMESTAMP '2024-01-01 00:00:00.000001' AS t")
    text = df.select(row_json(df.columns)).first()[0]
    assert text == '{"a":"x","b":null,"t":"2024-01-01T00:00:00.000001Z"}'
    assert df.select(row_hash(df.columns)).first()[0] == hashlib.md5(text.encode()).hexdigest()


def test_rows_differing_in_microseconds_have_different_hashes(spark):
    df = spark.sql("SELECT timestamp_micros(id) AS t FROM range(3)")
    assert df.select(row_hash(["t"])).distinct().count() == 3


def test_surrogate_key_tells_null_from_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", "b")], "x string, y string")
    keys = [r[0] for r in df.select(surrogate_key("x", "y")).collect()]
    expected = [hashlib.md5(t.encode()).hexdigest() for t in (f"a-{NULL_KEY}", "a-", "a-b")]
    assert keys == expected
