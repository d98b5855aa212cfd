import pytest

from kelvane.model import KeyOrder
from kelvane.plans.dialect import KeyBetween, KeyEquals, ParseError, Select, parse
from kelvane.plans.planner import format_rows, plan, query

ROWS = [("alder", "12"), ("birch", "7"), ("cedar", "12"), ("elm", "30"), ("yew", "7")]


@pytest.fixture(scope="module")
def live(spark):
    return spark.createDataFrame([(bytearray(k.encode()), bytearray(v.encode()), 1) for k, v in ROWS], "key binary, value binary, version long")


# Where an error lies and how its message begins. The queries are this test's own.
@pytest.mark.parametrize("text, at, message", [
    ("", 0, "expected SELECT, found the end of the query"),
    ("DELETE key", 0, "expected SELECT, found DELETE"),
    ("SELECT DISTINCT", 15, "expected '*', key or value, found the end of the query"),
    ("SELECT age", 7, "expected '*', key or value, found AGE"),
    ("SELECT value, key", 12, "unexpected ','"),
    ("SELECT key ORDER", 11, "expected WHERE or the end, found ORDER"),
    ("SELECT value WHERE *", 19, "expected key"),
    ("SELECT key WHERE key", 20, "expected '=' or BETWEEN, found the end of the query"),
    ("SELECT key WHERE key = BETWEEN", 23, "expected a string in single quotes"),
    ("SELECT key WHERE key BETWEEN 'elm'", 34, "expected AND"),
    ("SELECT key WHERE key BETWEEN 'a' AND key", 37, "expected a string in single quotes"),
    ("SELECT key WHERE key = 'yew", 23, "string is never closed"),
    ("SELECT key WHERE key = 'ü' 'v'", 28, "expected the end, found a string"),
])
def test_parse_errors(text, at, message):
    with pytest.raises(ParseError) as e:
        parse(text)
    assert e.value.at == at and e.value.message.startswith(message)


@pytest.mark.parametrize("text", ["SELECT DISTINCT *", "SELECT value", "SELECT * WHERE key = 'o''c'", "SELECT key WHERE key BETWEEN 'a' AND 'ü'"])
def test_round_trip(text):
    assert str(parse(text)) == text and parse(str(parse(text))) == parse(text)


def test_words_in_any_case():
    assert parse("select distinct VALUE where KEY between '' and 'z'") == Select("value", KeyBetween(b"", b"z"), True)
    assert parse("SELECT*WHERE key='a'") == Select("*", KeyEquals(b"a"))


@pytest.mark.parametrize("text, hashed, ordered", [
    ("SELECT *", "FullScan (fold: every row)\n", None),
    ("SELECT DISTINCT value", "Distinct\n  Project value\n    FullScan (fold: every row)\n", None),
    ("SELECT DISTINCT key", "Project key\n  FullScan (fold: every row)\n", None),
    ("SELECT DISTINCT *", "FullScan (fold: every row)\n", None),
    ("SELECT DISTINCT value WHERE key = 'elm'", "Project value\n  Get 'elm' (get: one lookup)\n", None),
    ("SELECT * WHERE key BETWEEN 'a' AND 'c'", "Filter key BETWEEN 'a' AND 'c'\n  FullScan (fold: every row)\n", "RangeScan 'a' .. 'c' (scan: sorted keydir)\n"),
])
def test_plans(text, hashed, ordered):
    assert str(plan(parse(text))) == hashed
    assert str(plan(parse(text), KeyOrder.SORTED)) == (ordered or hashed)


@pytest.mark.parametrize("order", list(KeyOrder))
@pytest.mark.parametrize("text", ["SELECT *", "SELECT key", "SELECT value", "SELECT DISTINCT value", "SELECT DISTINCT *", "SELECT value WHERE key = 'oak'",
                                  "SELECT DISTINCT value WHERE key = 'elm'", "SELECT * WHERE key BETWEEN 'a' AND 'c'", "SELECT key WHERE key BETWEEN 'z' AND 'a'", "SELECT DISTINCT value WHERE key BETWEEN 'a' AND 'd'"])
def test_results_by_definition(live, text, order):
    s = parse(text)
    rows = [(k.encode(), v.encode()) for k, v in ROWS if s.where is None or s.where.holds(k.encode())]
    rows = [tuple(r["key value".split().index(c)] for c in s.columns) for r in rows]
    rows = sorted(set(rows) if s.distinct else rows)
    df = query(live, text, order)
    got = [tuple(bytes(x) for x in r) for r in df.collect()]
    assert sorted(got) == rows and tuple(df.columns) == s.columns
    if order is KeyOrder.SORTED and isinstance(s.where, KeyBetween) and "key" in s.columns:
        assert got == rows


def test_table_printer():
    assert format_rows([(b"elm", b"30")], ("key", "value")) == "\n".join([" key | value", "-----+-------", " elm | 30", "(1 row)"])
    assert format_rows([], ("key",)).endswith("(0 rows)")


def test_no_distinct_and_no_shuffle_for_one_key(live):
    plan_text = query(live, "SELECT DISTINCT value WHERE key = 'elm'")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan_text and "Aggregate" not in plan_text
