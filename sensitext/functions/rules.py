"""Detection rules: an ordered, immutable list of (type, pattern) with cheap gates.

A *gate* is a condition every text with a match must meet: it holds all ``literals``, one of ``any_of``, a match of
``gate`` (or one of ``gate_start``, which is tied to the start of the text). Gates decide, inside generated code, whether a
text is worth the exact pattern, so most texts never reach a look-around.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .patterns import check_pattern, to_spark_regex

# Gates shared by several rules (regular expressions that hold wherever the rule can match).
DIGIT_GROUPS = r"[0-9][0-9\t\n\f\r .()-]{8}"
# A run of 40 after some other character or at the start of the text; one range holds all characters of
# the run, and testing for what comes before it skips the inside of shorter runs.
LONG_RUN = r"[^+-z][+-z]{40}"
LONG_START = r"\A[+-z]{40}"


@dataclass(frozen=True)
class Rule:
    type: str
    pattern: str
    literals: tuple[str, ...] = ()
    gate: str | None = None
    any_of: tuple[str, ...] = ()
    gate_start: str | None = None
    # What every match starts with: tested first, so that most places need no look at both sides.
    starts: str = ""

    @cached_property
    def regex(self) -> str:
        return (f"(?={self.starts})" if self.starts else "") + to_spark_regex(self.pattern)

    def may_match(self, text: Column) -> Column:
        """Necessary condition for a match; the exact pattern itself if the rule has no gate."""
        tests = [text.contains(word) for word in self.literals]
        if self.any_of:
            tests.append(reduce(lambda a, b: a | b, [text.contains(word) for word in self.any_of]))
        if self.gate:
            inside = text.rlike(self.gate)
            if self.gate_start:
                inside = inside | text.rlike(self.gate_start)
            tests.append(inside)
        if not tests:
            tests.append(text.rlike(self.regex))
        return reduce(lambda a, b: a & b, tests)

    @property
    def gate_key(self) -> tuple:
        gates = (self.literals, self.gate, self.any_of)
        return gates if any(gates) else (self.regex,)


# The built-in types and patterns, in rule order (order decides ties between rules).
BUILTIN = (
    Rule("SSN", r"\b\d{3}-\d{2}-\d{4}\b", gate=DIGIT_GROUPS),
    Rule("CREDIT_CARD", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", gate=DIGIT_GROUPS),
    Rule("EMAIL", r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b", literals=("@",)),
    Rule("PHONE", r"\b(?:\+1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b", gate=DIGIT_GROUPS, starts=r"[+(0-9]"),
    Rule("API_KEY", r"\bsk-[a-zA-Z0-9]{20,}\b", literals=("sk-",)),
    Rule("API_KEY", r"\bghp_[a-zA-Z0-9]{36,}\b", literals=("ghp_",)),
    Rule("API_KEY", r"\bgho_[a-zA-Z0-9]{36,}\b", literals=("gho_",)),
    Rule("API_KEY", r"\bglpat-[a-zA-Z0-9\-_]{20,}\b", literals=("glpat-",)),
    Rule("API_KEY", r"\bxoxb-[a-zA-Z0-9\-]+\b", literals=("xoxb-",)),
    Rule("API_KEY", r"\bAIza[a-zA-Z0-9_\-]{35}\b", literals=("AIza",)),
    Rule("API_KEY", r"\b[A-Z0-9]{20}:[a-zA-Z0-9/+]{40}\b", gate=LONG_RUN, gate_start=LONG_START),
    Rule("SECRET", r"\b[A-Za-z0-9+/]{40,}={0,2}\b", gate=LONG_RUN, gate_start=LONG_START),
    Rule("PASSWORD", r"""(?i)(?:password|passwd|pwd)\s*[:=]\s*["']?([^\s"']+)["']?""",
         gate=r"[wW](?:[oO][rR])?[dD][\t\n\f\r ]*[:=]"),
    Rule("PATH", r"""(?i)[A-Z]:\\Users\\[^\\]+\\[^\s"']+""", literals=(":\\",)),
    Rule("PATH", r"""(?:/home/|/Users/)[a-zA-Z0-9._\-]+/[^\s"']+""", any_of=("/home/", "/Users/")),
    Rule("IP_ADDR", r"\b(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3})\b", literals=("10.",)),
    Rule("IP_ADDR", r"\b(?:192\.168\.\d{1,3}\.\d{1,3})\b", literals=("192.168.",)),
    Rule("IP_ADDR", r"\b(?:172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3})\b", literals=("172.",), starts="1"),
)


@dataclass(frozen=True)
class Rules:
    """The built-in rules plus added ones, minus disabled types. Every change returns a new object."""

    rules: tuple[Rule, ...] = BUILTIN
    disabled: frozenset[str] = frozenset()
    # Texts in which most rules match are scanned in Arrow batches (``batches.py``); results are the same.
    batched: bool = False

    def in_batches(self) -> Rules:
        return replace(self, batched=True)

    def add(self, type: str, pattern: str, spark: SparkSession | None = None) -> Rules:
        """Appends a rule; its name becomes the type as written. A bad pattern is a ValueError here."""
        if "[" in type or "]" in type:
            raise ValueError(f"a rule named {type!r} would give placeholders that cannot be told from text")
        rule = Rule(type, pattern)
        check_pattern(spark or SparkSession.getActiveSession(), rule.regex)
        return replace(self, rules=self.rules + (rule,))

    def disable(self, *types: str) -> Rules:
        """Drops every rule of these types, also ones added later (exact, case-sensitive names)."""
        return replace(self, disabled=self.disabled | frozenset(types))

    def only(self, *types: str) -> Rules:
        return replace(self, rules=tuple(r for r in self.rules if r.type in types))

    @property
    def active(self) -> tuple[Rule, ...]:
        return tuple(r for r in self.rules if r.type not in self.disabled)

    @property
    def types(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(r.type for r in self.active))
