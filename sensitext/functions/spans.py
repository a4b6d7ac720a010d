"""Column expressions for matches inside one text: find, resolve overlaps, number, replace, restore.

A match is ``struct<start:int,end:int,type:string,value:string>`` with half-open character offsets.
Everything here is a row-local expression: no shuffle, and no Python worker unless the rules say ``in_batches``. Scan, numbering and replacement go
into a DataFrame one after the other (``operators/base.py: with_tokens``): nested into one expression they
would need more passes of the analyzer than it makes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import empty_array, let, remembered, running_max, running_sum
from .batches import readable, resolved_tokens_batches, scan_batches, tokens_batches
from .rules import Rule, Rules

MATCH = "struct<start:int,end:int,type:string,value:string>"
TOKENIZED = "struct<start:int,end:int,type:string,value:string,token:string,token_type:string,ordinal:int>"

# Placeholder as written into redacted text: [TYPE_n].
ANY_PLACEHOLDER = r"\[[^\[\]]+_[0-9]+\]"

# Set around matches to cut a text at them.
_MARK = "\x00"

# Texts are cut into blocks of so many characters, so that each piece is read near its place.
_BLOCK = 4096


def _pieces(text: Column, regex: str) -> Column:
    """The text cut at the matches of one rule: text before, match, text before, match, ..., rest.

    Matches are set between marks and the text is split at the marks, so that the pattern runs once. A text
    that holds the mark itself is matched and split in two runs.
    """
    marked = F.split(F.regexp_replace(text, regex, f"{_MARK}$0{_MARK}"), _MARK, -1)
    pairs = F.arrays_zip(F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0)))
    named = pairs.cast("array<struct<gap:string,value:string>>")
    # The rest of the text has no match after it.
    two_runs = F.array_compact(F.flatten(F.transform(named, lambda p: F.array(p["gap"], p["value"]))))
    return F.when(text.contains(_MARK), two_runs).otherwise(marked)


def _candidates(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Per rule the pieces of the text; null where the rule's gate says there is no match."""
    return F.array(*[F.when(rule.may_match(text), _pieces(text, rule.regex)) for rule in rules])


def _located(text: Column, candidates: Column, rules: tuple[Rule, ...]) -> Column:
    """Turns the pieces of all rules into matches with positions.

    The pieces of one rule add up to the text, so one running sum over all pieces gives the positions in
    the k-th listed rule after k text lengths are taken off.
    """
    types = F.lit([rule.type for rule in rules])
    listed = F.filter(
        F.transform(candidates, lambda pieces, i: F.struct(i.alias("rule"), pieces.alias("pieces"))),
        lambda r: F.size(r["pieces"]) > 1,
    )
    items = F.flatten(
        F.transform(
            listed,
            lambda r, k: F.transform(
                r["pieces"],
                lambda p, j: F.struct(
                    r["rule"].alias("rule"), k.alias("nth"), F.length(p).alias("size"),
                    F.when(j % 2 == 1, p).alias("value"),
                ),
            ),
        )
    )

    def placed(its: Column) -> Column:
        def with_ends(args: Column) -> Column:
            def match(it: Column, i: Column) -> Column:
                end = F.get(args["ends"], i) - it["nth"] * args["length"]
                return F.struct(
                    (end - it["size"]).alias("start"), (-end).alias("neg_end"), it["rule"].alias("rule"),
                    F.get(types, it["rule"]).alias("type"), it["value"].alias("value"),
                )

            return F.filter(F.transform(its, match), lambda m: m["value"].isNotNull())

        ends = running_sum(F.transform(its, lambda it: it["size"]))
        return let(F.struct(ends.alias("ends"), F.length(text).alias("length")), with_ends)

    return let(items, placed)


def _as_match(raw: Column) -> Column:
    return F.struct(
        raw["start"].alias("start"),
        (-raw["neg_end"]).alias("end"),
        raw["type"].alias("type"),
        raw["value"].alias("value"),
    )


def _first_per_span(raw: Column) -> Column:
    """Sorted candidates; the same value at the same place is kept for the first rule only."""

    def is_first(m: Column, i: Column) -> Column:
        last = F.get(raw, i - 1)
        return (i == 0) | (m["start"] != last["start"]) | (m["neg_end"] != last["neg_end"])

    return F.transform(F.filter(raw, is_first), _as_match)


def _fold_cluster(cluster: Column) -> Column:
    """Keeps what starts after the last kept match ends; only integers travel through the fold."""
    first_end = F.get(cluster, F.lit(0))["end"]

    def step(acc: Column, m: Column) -> Column:
        taken = F.struct(m["end"].alias("end"), F.concat(acc["kept"], F.array(m["i"])).alias("kept"))
        return F.when(m["start"] >= acc["end"], taken).otherwise(acc)

    # Whatever starts inside the first match goes at once, which is most of a large cluster.
    later = F.filter(
        F.transform(cluster, lambda m, i: F.struct(m["start"].alias("start"), m["end"].alias("end"), i.alias("i"))),
        lambda m: m["start"] >= first_end,
    )
    kept = F.aggregate(
        later,
        F.struct(first_end.alias("end"), F.array(F.lit(0)).alias("kept")),
        step,
        lambda acc: acc["kept"],
    )
    return F.transform(kept, lambda i: F.get(cluster, i))


def _without_overlaps(matches: Column) -> Column:
    """Earliest first, longest first on ties; a match starting inside a kept one is dropped whole.

    Where a match starts at or after every earlier end, nothing before it matters: such places cut the
    list into clusters, and only clusters of several matches need the sequential rule.
    """

    def with_reach(args: Column) -> Column:
        ms, reach = args["ms"], args["reach"]

        def starts_cluster(i: Column) -> Column:
            return (i == 0) | (F.get(ms, i)["start"] >= F.get(reach, i - 1))

        def clusters(bounds: Column) -> Column:
            def cluster(b: Column, k: Column) -> Column:
                size = F.coalesce(F.get(bounds, k + 1), F.size(ms)) - b
                part = F.slice(ms, b + 1, size)
                return F.when(size == 1, part).otherwise(let(part, _fold_cluster))

            resolved = F.flatten(F.transform(bounds, cluster))
            return F.when(F.size(bounds) == F.size(ms), ms).otherwise(resolved)

        places = F.sequence(F.lit(0), F.size(ms) - 1)
        return let(F.filter(places, starts_cluster), clusters)

    def prepared(ms: Column) -> Column:
        reach = running_max(F.transform(ms, lambda m: m["end"]))
        made = F.struct(ms.alias("ms"), reach.alias("reach"))
        return F.when(F.size(ms) > 1, let(made, with_reach)).otherwise(ms)

    return let(matches, prepared)


def resolve_overlaps(matches: Column) -> Column:
    """Applies the overlap rule to ordered matches, for example those of ``scan_text(overlaps=True)``."""
    return _without_overlaps(matches)


def scan_text(text: Column, rules: Rules = Rules(), overlaps: bool = False) -> Column:
    """Matches of all active rules in ``text``, in order of position.

    With ``overlaps=True`` matches that lose against an earlier or longer one are kept too.
    """
    active = rules.active
    if not active:
        return empty_array(MATCH)
    gates = {rule.gate_key: rule for rule in active}
    candidate = reduce(lambda a, b: a | b, [rule.may_match(text) for rule in gates.values()])
    def resolve(raw: Column) -> Column:
        if overlaps:
            return _first_per_span(raw)
        return _without_overlaps(F.transform(raw, _as_match))

    found = let(F.sort_array(_located(text, _candidates(text, active), active)), resolve)
    return F.when(candidate, found).otherwise(empty_array(MATCH))


def in_batches(rules: Rules) -> bool:
    return rules.batched and readable(rules)


@remembered
def scan_column(text: str, rules: Rules, overlaps: bool = False) -> Column:
    """``scan_text`` of a column given by name, in batches if the rules say so."""
    return (scan_batches if in_batches(rules) else scan_text)(F.col(text), rules, overlaps)


@remembered
def tokens_column(text: str, rules: Rules, distinct: bool = False) -> Column:
    """The numbered matches of a text given by name, by rules in batches; ``distinct`` leaves each value once."""
    return tokens_batches(F.col(text), rules, distinct)


@remembered
def numbered_column(matches: str) -> Column:
    """``number_matches`` of a column given by name."""
    return number_matches(F.col(matches))


@remembered
def resolved_tokens_column(matches: str) -> Column:
    """``number_matches`` of ``resolve_overlaps`` of a column given by name, in batches."""
    return resolved_tokens_batches(F.col(matches))


def match_types(matches: Column) -> Column:
    """Distinct types in order of first appearance."""
    return F.array_distinct(F.transform(matches, lambda m: m["type"]))


def number_matches(matches: Column) -> Column:
    """Adds the placeholder of each match for the scope of this one text.

    A value gets a token when it first appears, numbered within the type it has there, and keeps it
    even where a later match gives it another type. Two sorted passes, so long lists stay cheap.
    """

    def same(field: str, items: Column, m: Column, i: Column) -> Column:
        return (i > 0) & (F.get(items, i - 1)[field] == m[field])

    def mark_first(items: Column) -> Column:
        """In the order of (value, start): the start and type of each value's first appearance."""
        firsts = running_max(F.transform(items, lambda m, i: F.when(same("value", items, m, i), -1).otherwise(i)))

        def marked(places: Column) -> Column:
            def row(m: Column, i: Column) -> Column:
                first = F.get(items, F.get(places, i))
                return F.struct(
                    first["type"].alias("token_type"), first["start"].alias("first"), m["start"].alias("start"),
                    m["end"].alias("end"), m["type"].alias("type"), m["value"].alias("value"),
                )

            return F.transform(items, row)

        return let(firsts, marked)

    def number(items: Column) -> Column:
        """In the order of (token type, first appearance): values counted within their type."""
        counted = running_sum(
            F.transform(
                items,
                lambda m, i: F.when(same("token_type", items, m, i) & same("first", items, m, i), 0).otherwise(1),
            )
        )
        type_starts = running_max(
            F.transform(items, lambda m, i: F.when(same("token_type", items, m, i), -1).otherwise(i))
        )

        def numbered(args: Column) -> Column:
            def row(m: Column, i: Column) -> Column:
                at_start = F.get(args["counted"], F.get(args["type_starts"], i))
                ordinal = F.get(args["counted"], i) - at_start + 1
                return F.struct(
                    m["start"].alias("start"), m["end"].alias("end"), m["type"].alias("type"),
                    m["value"].alias("value"), placeholder(m["token_type"], ordinal).alias("token"),
                    m["token_type"].alias("token_type"), ordinal.alias("ordinal"),
                )

            return F.sort_array(F.transform(items, row))

        return let(F.struct(counted.alias("counted"), type_starts.alias("type_starts")), numbered)

    def by_value(ms: Column) -> Column:
        return F.sort_array(
            F.transform(
                ms,
                lambda m: F.struct(
                    m["value"].alias("value"), m["start"].alias("start"),
                    m["end"].alias("end"), m["type"].alias("type"),
                ),
            )
        )

    return let(
        matches,
        lambda ms: F.when(
            F.size(ms) > 0,
            let(F.sort_array(let(by_value(ms), mark_first)), number).cast(f"array<{TOKENIZED}>"),
        ).otherwise(empty_array(TOKENIZED)),
    )


def placeholder(type_: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("["), type_, F.lit("_"), ordinal.cast("string"), F.lit("]"))


def replace_spans(text: Column, spans: Column, put: str) -> Column:
    """Text with each span replaced by its ``put`` field."""

    def build(args: Column) -> Column:
        spans_, blocks, width = args["spans"], args["blocks"], args["width"]

        def cut(a: Column, b: Column) -> Column:
            first = F.floor(a / width).cast("int")
            last = F.floor((b - 1) / width).cast("int")
            return (
                F.when(b <= a, F.lit(""))
                .when(first == last, F.substring(F.get(blocks, first), a - first * width + 1, b - a))
                .otherwise(
                    F.concat(
                        F.substring(F.get(blocks, first), a - first * width + 1, width),
                        F.array_join(F.slice(blocks, first + 2, last - first - 1), ""),
                        F.substring(F.get(blocks, last), F.lit(1), b - last * width),
                    )
                )
            )

        def piece(span: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(spans_, i - 1)["end"])
            return F.concat(cut(before, span["start"]), span[put])

        tail = cut(F.get(spans_, F.size(spans_) - 1)["end"], args["length"])
        return F.concat(F.array_join(F.transform(spans_, piece), ""), tail)

    def prepare(spans_: Column) -> Column:
        return F.struct(
            spans_.alias("spans"),
            F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _BLOCK), F.lit(0)).alias("blocks"),
            F.lit(_BLOCK).alias("width"),
            F.length(text).alias("length"),
        )

    return let(
        spans,
        lambda s: F.when(F.size(s) > 0, let(prepare(s), build)).otherwise(text),
    )


def redact_text(text: Column, tokenized: Column) -> Column:
    """``text`` with every match replaced by its placeholder."""
    return replace_spans(text, tokenized, "token")


def token_mapping(tokenized: Column) -> Column:
    """Map from token to value. Within a text each value has one token and each token one value, so both lists of
    distinct ones follow first appearance; lists of strings are hashed, lists of structs compared pair by pair."""
    return F.map_from_arrays(F.array_distinct(tokenized["token"]), F.array_distinct(tokenized["value"]))


def placeholders_in(text: Column) -> Column:
    """Placeholder-like pieces of a text, as matches of the type ``TOKEN``."""
    rules = (Rule("TOKEN", ANY_PLACEHOLDER, literals=("[",)),)
    return F.transform(_located(text, _candidates(text, rules), rules), _as_match)


def restore_text(text: Column, token_map: Column) -> Column:
    """Replaces each placeholder found in ``token_map`` by its value, in one pass over the text."""

    def with_map(tokens: Column) -> Column:
        found = F.transform(
            placeholders_in(text),
            lambda p: F.struct(
                p["start"].alias("start"),
                p["end"].alias("end"),
                F.coalesce(F.element_at(tokens, p["value"]), p["value"]).alias("value"),
            ),
        )
        return replace_spans(text, found, "value")

    return F.when(F.size(token_map) > 0, let(token_map, with_map)).otherwise(text)


@remembered
def redaction(text: str, tokenized: str) -> dict[str, Column]:
    """The columns every redacting operator adds, from a text and its numbered matches."""
    return {
        "redacted": redact_text(F.col(text), F.col(tokenized)),
        "items": F.size(tokenized),
        "types": match_types(F.col(tokenized)),
        "ambiguous": has_placeholder(F.col(text)),
    }


def has_placeholder(text: Column) -> Column:
    """True where the input already holds placeholder-like text, which cannot round-trip."""
    return F.coalesce(text.contains("[") & text.rlike(ANY_PLACEHOLDER), F.lit(False))
