"""Turns published detection patterns into patterns Spark's regex functions read the same way.

The published patterns use the RE2 dialect, where ``\\b``, ``\\w``, ``\\d`` and ``\\s`` are ASCII,
``\\s`` leaves out the vertical tab, ``$`` is the very end of the text and ``(?i)`` folds Unicode
letters. Spark runs Java patterns, which differ in exactly those places.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

SPACE = r"\t\n\f\r "
# The look-aheads come first: they fail fastest where there is no boundary.
BOUNDARY = r"(?:(?=\w)(?<!\w)|(?!\w)(?<=\w))"
NOT_BOUNDARY = r"(?:(?<!\w)(?!\w)|(?<=\w)(?=\w))"
BEFORE_WORD = r"(?<!\w)"

# What may follow \b: a run of digits, a literal word, or a class of word characters only.
_DIGITS = re.compile(r"\\d(?:\{(\d+)\})?(?![*+?{])")
_WORD = re.compile(r"[A-Za-z0-9_]+(?![*+?{])")
_WORD_CLASS = re.compile(r"(?:\\w|\[(?:A-Z|a-z|0-9|_|\\w|\\d)+\])(?![*?]|\{0)")
_FLAGS = re.compile(r"\(\?([a-zA-Z]*)(-[a-zA-Z]+)?([:)])")
_UNESCAPED = {"b": BOUNDARY, "B": NOT_BOUNDARY, "s": f"[{SPACE}]", "S": f"[^{SPACE}]", "v": r"\x0B", "C": r"[\s\S]"}
_IN_CLASS = {"s": SPACE, "S": r"\S\x0B", "v": r"\x0B"}


def _posix(negated: str, name: str) -> str:
    """A named ASCII class inside brackets."""
    if name == "word":
        return r"\W" if negated else r"\w"
    return r"\%s{%s}" % ("P" if negated else "p", "XDigit" if name == "xdigit" else "ASCII" if name == "ascii" else name.capitalize())


def _optional(pattern: str, opening: int) -> bool:
    """Whether the group that opens there may be left out, by what follows its closing parenthesis."""
    depth, i, in_class = 0, opening, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
            i += len(re.match(r"\[\^?\]?", pattern[i:]).group()) - 1
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
            if depth == 0:
                return bool(re.match(r"[?*]|\{0*[,}]", pattern[i + 1 :]))
        i += 1
    return True


# What the dialect refuses, though Java reads it: look-around, atomic groups, back references, possessive repeats.
_REFUSED = (
    (re.compile(r"\(\?(?:[=!>]|<[=!])"), "look-around and atomic groups"),
    (re.compile(r"\\(?:[1-9]|k[<{'])"), "back references"),
    (re.compile(r"(?:[*+?]|\{\d+(?:,\d*)?\})\+"), "possessive repetition"),
    (re.compile(r"\\[GZRXhHVNuceKy]"), "an escape of another dialect"),
)


def _bare(pattern: str) -> str:
    """The pattern with literal text, escaped backslashes and the insides of classes blanked out."""
    bare = re.sub(r"\\Q.*?(?:\\E|$)", "", pattern, flags=re.DOTALL)
    bare = bare.replace("\\\\", "..")
    bare = re.sub(r"\\[*+?{}()\[\]|.^$]", "..", bare)
    return re.sub(r"\[\^?\]?(?:\[:\^?\w+:\]|\\.|[^\]])*\]", "x", bare)


def _word_start(pattern: str, i: int) -> tuple[str, int]:
    """The boundary at ``pattern[i:]`` and what follows it, if that has to be a word character.

    The look-behind goes behind the first literal or digit where possible, so that the matcher tests
    the cheap part first. Gives ("", i) if the boundary has to be tested on both sides.
    """
    start = i
    # Opening groups may be stepped over only if no alternative could start with something else, and if the
    # group has to be there.
    while "|" not in pattern and pattern.startswith("(?:", i) and not _optional(pattern, i):
        i += 3
    opened = pattern[start:i]
    if found := _DIGITS.match(pattern, i):
        rest = int(found.group(1) or 1) - 1
        if rest >= 0:
            tail = "" if rest == 0 else r"\d{%d}" % rest
            return f"{opened}\\d(?<!\\w\\d){tail}", found.end()
    if found := _WORD.match(pattern, i):
        return f"{opened}{found.group()}(?<!\\w{found.group()})", found.end()
    if _WORD_CLASS.match(pattern, i):
        return BEFORE_WORD + opened, i
    return "", start


def to_spark_regex(pattern: str) -> str:
    """The Java pattern that matches what ``pattern`` matches in the RE2 dialect; ValueError for what that dialect lacks."""
    bare = _bare(pattern)
    for refused, what in _REFUSED:
        if refused.search(bare):
            raise ValueError(f"{what} in {pattern!r}: not part of this dialect")
    multiline = any("m" in flags for flags, _, _ in _FLAGS.findall(pattern))
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            if pattern[i + 1 : i + 2] == "Q" and not in_class:
                end = pattern.find("\\E", i)
                end = len(pattern) if end < 0 else end + 2
                out.append(pattern[i:end])
                i = end
                continue
            code = pattern[i + 1 : i + 2]
            if code == "b" and not in_class:
                checked, end = _word_start(pattern, i + 2)
                if checked:
                    out.append(checked)
                    i = end
                    continue
            script = re.match(r"\\([pP])\{(\^?)([A-Za-z_]{3,})\}", pattern[i:])
            if script:  # a script; categories have one or two letters
                negated = (script.group(1) == "P") != bool(script.group(2))
                out.append(r"\%s{Is%s}" % ("P" if negated else "p", script.group(3)))
                i += script.end()
                continue
            out.append((_IN_CLASS if in_class else _UNESCAPED).get(code, ch + code))
            i += 2
        elif in_class:
            posix = re.match(r"\[:(\^?)(\w+):\]", pattern[i:])
            if posix:
                out.append(_posix(*posix.groups()))
                i += posix.end()
                continue
            in_class = ch != "]"
            out.append({"[": r"\[", "&": r"\&"}.get(ch, ch))
            i += 1
        elif ch == "[":
            opening = re.match(r"\[\^?\]?", pattern[i:]).group()
            out.append(opening.replace("]", r"\]"))
            in_class = True
            i += len(opening)
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
        elif flags := _FLAGS.match(pattern, i):
            on, off, close = flags.groups()
            if "U" in on:
                raise ValueError("the ungreedy flag (?U) has no Spark counterpart")
            out.append(f"(?{on.replace('i', 'iu')}{off or ''}{close}")
            i = flags.end()
        else:
            out.append(r"\z" if ch == "$" and not multiline else ch)
            i += 1
    # (?d): only \n ends a line, for the dot as for the anchors.
    needs_unix_lines = "." in pattern or multiline
    return ("(?d)" if needs_unix_lines else "") + "".join(out)


def check_pattern(spark: SparkSession, java_pattern: str) -> None:
    """Raises ValueError if Spark cannot compile the pattern or if it can match nothing at all, in an empty text or
    between the characters of another."""
    probe = "SELECT '' RLIKE :p OR exists(regexp_extract_all(' a0_-\n@b. c', :p, 0), m -> m = '') AS hit"
    try:
        empty = spark.sql(probe, args={"p": java_pattern}).head().hit
    except Exception as error:
        raise ValueError(f"invalid pattern {java_pattern!r}") from error
    if empty:
        raise ValueError(f"pattern {java_pattern!r} matches the empty text")
