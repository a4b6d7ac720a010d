import pytest

from sensitext.functions.patterns import to_spark_regex
from sensitext.functions.rules import BUILTIN, Rules


@pytest.mark.parametrize(
    "pattern, expected",
    [
        (r"\bEMP-\d{6}", r"EMP(?<!\wEMP)-\d{6}"),
        (r"\b\d{3}-", r"\d(?<!\w\d)\d{2}-"),
        (r"\b\dx", r"\d(?<!\w\d)x"),
        (r"\b(?:10\.)", r"(?:10(?<!\w10)\.)"),
        (r"\b(?:10|/a)", r"(?:(?=\w)(?<!\w)|(?!\w)(?<=\w))(?:10|/a)"),
        (r"\b[A-Z]+x", r"(?<!\w)[A-Z]+x"),
        (r"\bab?", r"a(?<!\wa)b?"),
        (r"\ba?b", r"(?:(?=\w)(?<!\w)|(?!\w)(?<=\w))a?b"),
        (r"\b\d*b", r"(?:(?=\w)(?<!\w)|(?!\w)(?<=\w))\d*b"),
        (r"\b\d{0,2}b", r"(?:(?=\w)(?<!\w)|(?!\w)(?<=\w))\d{0,2}b"),
        (r"a\sb", "a[\\t\\n\\f\\r ]b"),
        (r"[\s-]x", "[\\t\\n\\f\\r -]x"),
        (r"[^\s]x", "[^\\t\\n\\f\\r ]x"),
        (r"(?P<id>\d+)$", r"(?<id>\d+)\z"),
        (r"(?i)ab", "(?iu)ab"),
        (r"(?m)^a$", "(?d)(?m)^a$"),
        (r"[[:alpha:]]+", r"[\p{Alpha}]+"),
        (r"[a[b]", r"[a\[b]"),
        (r"\Qa.b\E\s", "\\Qa.b\\E[\\t\\n\\f\\r ]".replace("\\Qa.b", "\\Qa.b")),
    ],
)
def test_translation(pattern, expected):
    got = to_spark_regex(pattern)
    assert got.removeprefix("(?d)") == expected.removeprefix("(?d)")


def test_ungreedy_flag_is_refused():
    with pytest.raises(ValueError):
        to_spark_regex("(?U)a+")


def test_bad_or_empty_custom_rules_are_errors(spark):
    for pattern in ("[invalid", "a*", "(?=a)|", "(unclosed"):
        with pytest.raises(ValueError):
            Rules().add("BAD", pattern, spark)


def test_rules_are_values(spark):
    rules = Rules().add("emp_id", r"EMP-\d{6}", spark)
    assert rules.active[-1].type == "emp_id" and len(Rules().active) == len(BUILTIN) == 18
    assert "emp_id" not in rules.disable("emp_id").types
    assert "emp_id" in rules.disable("EMP_ID").types
    assert Rules().disable("X").add("X", "x", spark).types == Rules().types


def test_ascii_semantics(spark):
    cases = [
        (r"\bab\b", "üabß", ["ab"]),
        (r"\Bb", "ab b", ["b"]),
        (r"\b(?:1|-)x", "1x a1x -x a-x", ["1x", "-x"]),
        (r"\bü", "aü ü", ["ü"]),
        (r"\bcat", "cat concat ücat", ["cat", "cat"]),
        (r"\b\d{2}", "123 a12 12", ["12", "12"]),
        (r"a\sb", "a\x0bb a\tb", ["a\tb"]),
        (r"(?i)k", "k \u212a", ["k", "\u212a"]),
        (r"a$", "a\na", ["a"]),
        (r"a.", "a\rb", ["a\r"]),
        (r"\d+", "\u0661 1", ["1"]),
        (r"[\S]+", "a\x0bb c", ["a\x0bb", "c"]),
    ]
    for pattern, text, want in cases:
        regex = to_spark_regex(pattern)
        got = spark.sql("SELECT regexp_extract_all(:t, :p, 0) AS v", args={"t": text, "p": regex}).head().v
        assert got == want, (pattern, regex)
