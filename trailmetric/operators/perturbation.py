"""Controlled perturbations: candidates, deterministic value mutations, structural ones, placebos, checks, evaluation units.

Every choice comes from a hash of seed, key and salt, so a mutation is the same in any plan.
A mutation gives struct(value, method); a null value says that it does not apply.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import impact_from_criticality

# Classes and the families each may have, families and their types.
FAMILIES = {
    "placebo": ("data_reference", "parameter"),
    "fine_grained": ("data_reference", "parameter", "tool_selection"),
    "coarse_grained": ("tool_selection", "structural", "terminal_flag"),
}
TYPES = {
    "data_reference": ("wrong_value", "off_by_one", "typo_in_id", "wrong_field", "copied_value_error", "paraphrase", "formatting", "synonym"),
    "parameter": ("threshold_shift", "query_drift", "wrong_parameter", "paraphrase", "formatting", "reorder_args"),
    "tool_selection": ("near_neighbor_tool", "wrong_tool_family"),
    "structural": ("wrong_plan", "wrong_branch", "hallucinated_dependency"),
    "terminal_flag": ("premature_termination", "false_terminal"),
}
PLACEBO_TYPES = ("paraphrase", "formatting", "synonym", "reorder_args", "trivial_rename")
# Fixed values of the mutations.
LINE_SHIFTS = {"off_by_minus_1": -1, "off_by_plus_1": 1, "off_by_minus_5": -5, "off_by_plus_5": 5, "off_by_minus_10": -10, "off_by_plus_10": 10}
FLOAT_SCALES = (0.9, 1.1, 0.95, 1.05)
QUERY_WORDS = ("base", "large", "small", "v2", "latest", "old", "new")
ENTITY_SWAPS = {"bert": "gpt", "gpt": "bert", "base": "large", "large": "base", "python": "java", "java": "python", "linux": "windows", "windows": "linux", "v1": "v2", "v2": "v1"}
EXTENSIONS = {"py": "pyx", "js": "jsx", "ts": "tsx", "c": "cpp", "h": "hpp"}
DOMAIN_TYPOS = {"google": "gogle", "github": "gitub", "stackoverflow": "stackoverfow"}


def draw(seed: int, key: Column, salt: str, n: int | Column) -> Column:
    """0 .. n - 1, by the MD5 of seed, key and salt."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(salt)))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), n if isinstance(n, Column) else F.lit(n)).cast("int")


def _made(value: Column, method: str | Column) -> Column:
    return F.struct(value.cast("string").alias("value"), (F.lit(method) if isinstance(method, str) else method).alias("method"))


def _first(*options: tuple[Column, Column]) -> Column:
    """The value of the first condition that holds."""
    out = F.when(options[0][0], options[0][1])
    for condition, value in options[1:]:
        out = out.when(condition, value)
    return out


def pick(seed: int, key: Column, salt: str, options: list[Column]) -> Column:
    return F.get(F.array(*options), draw(seed, key, salt, len(options)))


def swapped(text: Column, at: Column) -> Column:
    """The text with the characters at the 0-based place and after it changed over."""
    return F.concat(F.substring(text, F.lit(1), at), F.substring(text, at + 2, F.lit(1)), F.substring(text, at + 1, F.lit(1)), F.substring(text, at + 3, F.length(text)))


def _number(value: Column) -> Column:
    """A whole number: text of digits alone."""
    return F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), value.try_cast("bigint"))


def wrong_integer(value: Column, seed: int, key: Column) -> Column:
    """One, two or ten up or down, or two neighbouring digits changed over (one digit: one up)."""
    n, how, up = _number(value), draw(seed, key, "int", 4), draw(seed, key, "sign", 2) * 2 - 1
    offset = up * F.get(F.array(F.lit(1), F.lit(2), F.lit(10)), how)
    digits = F.abs(n).cast("string")
    turned = swapped(digits, draw(seed, key, "digit", F.greatest(F.length(digits) - 1, F.lit(1)))).cast("bigint") * F.when(n < 0, -1).otherwise(1)
    shifted = _made(n + offset, F.concat(F.lit("offset_"), F.when(offset > 0, "+").otherwise(""), offset.cast("string")))
    return _first((n.isNull(), _made(F.lit(None), "skip_unparseable")), (how < 3, shifted), (F.length(digits) >= 2, _made(turned, "digit_swap"))).otherwise(_made(n + 1, "offset_+1"))


def off_by_one(value: Column, seed: int, key: Column) -> Column:
    n = _number(value)
    return _made(n + draw(seed, key, "obo", 2) * 2 - 1, "off_by_one")


def wrong_line(value: Column, seed: int, key: Column) -> Column:
    n, how = _number(value), draw(seed, key, "line", len(LINE_SHIFTS))
    shift, name = F.get(F.array(*map(F.lit, LINE_SHIFTS.values())), how), F.get(F.array(*map(F.lit, LINE_SHIFTS)), how)
    return F.when(n.isNull(), _made(value, "no_mutation")).otherwise(_made(F.greatest(F.lit(1), n + shift), name))


def wrong_float(value: Column, seed: int, key: Column) -> Column:
    """Up to a tenth off, scaled, or rounded."""
    x, how, scale = value.try_cast("double"), draw(seed, key, "float", 3), draw(seed, key, "scale", len(FLOAT_SCALES))
    by = F.get(F.array(*map(F.lit, FLOAT_SCALES)), scale)
    offset = F.when(x == 0, 0.01).otherwise((draw(seed, key, "share", 2001) - 1000) / 10000 * F.abs(x))
    return _first((x.isNull(), _made(value, "no_mutation")), (how == 0, _made(F.bround(x + offset, 4), "small_offset")), (how == 1, _made(F.bround(x * by, 4), F.concat(F.lit("scale_"), by.cast("string"))))).otherwise(_made(F.bround(x, 1), "reduce_precision"))


def wrong_path(value: Column, seed: int, key: Column) -> Column:
    """A character moved on, another extension, two folders changed over, or an underscore in a wrong place."""
    how, base, ext = draw(seed, key, "path", 4), F.regexp_extract(value, r"(?s)^(.*)\.([^.]*)$", 1), F.regexp_extract(value, r"(?s)^(.*)\.([^.]*)$", 2)
    dotted, parts = F.contains(value, F.lit(".")), F.split(value, "/")
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))), lambda i: F.substring(value, i, F.lit(1)).rlike("[A-Za-z0-9]"))
    at = F.get(places, draw(seed, key, "char", F.greatest(F.size(places), F.lit(1))))
    ch = F.substring(value, at, F.lit(1))
    code = F.ascii(ch)
    other = F.when(ch.rlike("[0-9]"), ((ch.cast("int") + 1) % 10).cast("string")).when(F.lower(ch) < "z", F.char(code + 1)).otherwise(F.char(code - 1))
    moved = F.concat(F.substring(value, F.lit(1), at - 1), other, F.substring(value, at + 1, F.length(value)))
    renamed = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), ext), F.concat(ext, F.lit("x")))
    i = draw(seed, key, "folder", F.greatest(F.size(parts) - 2, F.lit(1)))
    turned = F.array_join(F.transform(parts, lambda p, k: F.when(k == i, F.get(parts, i + 1)).when(k == i + 1, F.get(parts, i)).otherwise(p)), "/")
    return _first(
        ((how == 0) & (F.length(value) > 3) & (F.size(places) > 0), _made(moved, "char_substitution")),
        ((how == 1) & dotted, _made(F.concat_ws(".", base, renamed), "extension_change")),
        ((how == 2) & (F.size(parts) >= 3), _made(turned, "dir_swap")),
        (F.contains(value, F.lit("_")), _made(F.regexp_replace(value, r"^([^.]*)\.", "$1_"), "underscore_typo")),
        (dotted, _made(F.concat(base, F.lit("_."), ext), "trailing_underscore")),
    ).otherwise(_made(F.concat(value, F.lit("_")), "append_underscore"))


def query_drift(value: Column, seed: int, key: Column) -> Column:
    """A word more, one less, an entity for its like, or a word a little changed."""
    words, how = F.filter(F.split(F.trim(value), r"\s+"), lambda w: w != ""), draw(seed, key, "query", 4)
    n = F.size(words)
    at, gap = draw(seed, key, "word", F.greatest(n, F.lit(1))), draw(seed, key, "gap", n + 1)
    more = F.concat(F.slice(words, F.lit(1), gap), F.array(pick(seed, key, "more", [F.lit(w) for w in QUERY_WORDS])), F.slice(words, gap + 1, n + 1))
    word = F.get(words, at)
    joined = lambda x: F.array_join(x, " ")
    put = lambda new: joined(F.transform(words, lambda w, k: F.when(k == at, new).otherwise(w)))
    swaps = F.create_map(*[F.lit(x) for kv in ENTITY_SWAPS.items() for x in kv])
    known = F.filter(F.transform(words, lambda w, k: F.when(F.map_contains_key(swaps, F.lower(w)), k)), lambda k: k.isNotNull())
    entity = F.get(words, F.get(known, 0))
    like = F.element_at(swaps, F.lower(entity))
    like = F.when(F.substring(entity, 1, 1) != F.lower(F.substring(entity, 1, 1)), F.initcap(like)).otherwise(like)
    for_entity = joined(F.transform(words, lambda w, k: F.when(k == F.get(known, 0), like).otherwise(w)))
    shorter = F.substring(word, F.lit(1), F.length(word) - 1)
    return _first(
        (n == 0, _made(F.concat(value, F.lit(" extra")), "append_word")),
        ((how == 0) | (n == 1), _made(joined(more), "add_word")),
        ((how == 1) & (n > 2), _made(joined(F.concat(F.slice(words, F.lit(1), at), F.slice(words, at + 2, n))), F.concat(F.lit("remove_word_"), word))),
        ((how == 2) & (F.size(known) > 0), _made(for_entity, F.concat(F.lit("swap_entity_"), F.lower(entity), F.lit("_to_"), like))),
        (how == 2, _made(put(F.when(F.endswith(word, F.lit("s")), shorter).otherwise(F.concat(word, F.lit("s")))), "pluralize_word")),
    ).otherwise(_made(put(F.when(F.length(word) > 2, shorter).otherwise(F.concat(word, F.lit("s")))), F.concat(F.lit("modify_word_"), word)))


def wrong_identifier(value: Column, seed: int, key: Column) -> Column:
    """A digit or number at the end, or a number in it one up or down."""
    how, digit, number, by = draw(seed, key, "ident", 3), draw(seed, key, "digit", 10), draw(seed, key, "number", 99) + 1, draw(seed, key, "by", 2) * 2 - 1
    tail, inner = F.regexp_extract(value, r"(\d+)$", 1), F.regexp_extract(value, r"(\d+)", 1)
    step = lambda x: (x.try_cast("bigint") + by).cast("string")
    at = F.instr(value, inner)
    embedded = F.concat(F.substring(value, F.lit(1), at - 1), step(inner), F.substring(value, at + F.length(inner), F.length(value)))
    return _first(
        ((how == 0) & (tail != ""), _made(F.concat(value, digit), "append_digit")),
        (how == 0, _made(F.concat(value, F.lit("_"), number), "append_number")),
        ((how == 1) & (tail != ""), _made(F.concat(F.substring(value, F.lit(1), F.length(value) - F.length(tail)), step(tail)), "increment_suffix")),
        (how == 1, _made(F.concat(value, F.lit("_1")), "add_suffix_number")),
        (inner != "", _made(embedded, "change_embedded_number")),
    ).otherwise(_made(F.concat(value, F.lit("_v2")), "append_version"))


def wrong_entity(value: Column, seed: int, key: Column) -> Column:
    digit = draw(seed, key, "entity", 9) + 1
    named = F.when(F.contains(value, F.lit("_")), "append_digit_to_name").when(value.rlike("(?s)^.+[A-Z]"), "append_version").otherwise("append_digit")
    return _made(F.when(named == "append_version", F.concat(value, F.lit("V2"))).otherwise(F.concat(value, digit)), named)


def wrong_url(value: Column, seed: int, key: Column) -> Column:
    """A path segment cut by a sign, a usual slip in the host, or one more parameter."""
    how, parts = draw(seed, key, "url", 3), F.split(value, "/")
    at = F.lit(3) + draw(seed, key, "segment", F.greatest(F.size(parts) - 3, F.lit(1)))
    cut = lambda p: F.when(F.length(p) > 1, F.substring(p, F.lit(1), F.length(p) - 1)).when(p != "", F.concat(p, F.lit("s"))).otherwise(p)
    path = F.array_join(F.transform(parts, lambda p, k: F.when(k == at, cut(p)).otherwise(p)), "/")
    hosts = [((how == 1) & F.contains(F.lower(value), F.lit(right)), _made(F.replace(value, F.lit(right), F.lit(wrong)), f"domain_typo_{right}")) for right, wrong in DOMAIN_TYPOS.items()]
    return _first(((how == 0) & F.contains(value, F.lit("/")), _made(path, "path_typo")), *hosts, (F.contains(value, F.lit("?")), _made(F.concat(value, F.lit("&extra=1")), "add_param"))).otherwise(_made(F.concat(value, F.lit("?v=1")), "add_query_param"))


def wrong_ipv4(value: Column, seed: int, key: Column) -> Column:
    parts = F.split(value, r"\.")
    last = (_number(F.get(parts, 3)) + draw(seed, key, "ip", 10) + 1) % 256
    return F.when((F.size(parts) == 4) & last.isNotNull(), _made(F.concat_ws(".", F.slice(parts, 1, 3), last.cast("string")), "change_last_octet")).otherwise(_made(F.concat(value, F.lit(".1")), "append_octet"))


def wrong_date(value: Column, seed: int, key: Column) -> Column:
    """Day, month or year of an ISO date moved; other dates don't apply."""
    how, part = draw(seed, key, "date", 3), lambda g: F.regexp_extract(value, r"^(\d{4})-(\d{2})-(\d{2})", g).try_cast("int")
    year, month, day = part(1), part(2), part(3)
    made = lambda y, m, d: F.format_string("%04d-%02d-%02d", y, m, d)
    new_day, new_month = (day + draw(seed, key, "days", 5)) % 28 + 1, (month + draw(seed, key, "months", 3)) % 12 + 1
    return _first(
        (year.isNull(), _made(F.lit(None), "skip_unparseable_date")),
        (how == 0, _made(made(year, month, new_day), "change_day")),
        (how == 1, _made(made(year, new_month, day), "change_month")),
    ).otherwise(_made(made(year + draw(seed, key, "years", 2) * 2 - 1, month, day), "change_year"))


def flipped(value: Column) -> Column:
    low = F.lower(value)
    return F.when(low.isin("true", "false"), _made(F.when(low == "true", "false").otherwise("true"), "flip_boolean_string")).otherwise(_made(value, "no_mutation"))


def wrong_text(value: Column, seed: int, key: Column) -> Column:
    """Two neighbouring characters changed over, another case, or the last character gone."""
    how, n = draw(seed, key, "text", 3), F.length(value)
    other = F.when(value == F.lower(value), F.upper(value)).when(value == F.upper(value), F.lower(value)).otherwise(F.translate(value, _LOWER + _UPPER, _UPPER + _LOWER))
    lower, upper = (value == F.lower(value)) & value.rlike("[a-z]"), (value == F.upper(value)) & value.rlike("[A-Z]")
    named = F.when(lower, "to_upper").when(upper, "to_lower").otherwise("swap_case")
    return _first(
        (n == 0, _made(F.lit("_"), "replace_empty")),
        ((how == 0) & (n > 2), _made(swapped(value, draw(seed, key, "place", F.greatest(n - 1, F.lit(1)))), "adjacent_char_swap")),
        (how == 1, _made(other, named)),
        (n > 3, _made(F.substring(value, F.lit(1), n - 1), "truncate_last")),
    ).otherwise(_made(F.concat(value, F.lit("_")), "append_underscore"))


_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def typo(value: Column, seed: int, key: Column) -> Column:
    """Two neighbouring characters changed over; texts under 3 don't apply."""
    n = F.length(value)
    return _made(F.when(n >= 3, swapped(value, draw(seed, key, "typo", F.greatest(n - 1, F.lit(1))))), "adjacent_char_swap")


# Names of arguments that are thresholds or queries (a name in a longer one counts), and words that stand for their opposite.
THRESHOLDS = ("top_k", "top_n", "limit", "max_results", "count", "num_results", "k", "n", "threshold", "max", "min", "batch_size", "page_size")
QUERIES = ("query", "q", "search", "search_query", "text", "prompt", "keywords", "terms", "filter")
OPPOSITES = (("bert", "gpt"), ("gpt", "bert"), ("true", "false"), ("false", "true"), ("yes", "no"), ("no", "yes"), ("enabled", "disabled"), ("disabled", "enabled"))


def _named_like(slot: Column, names: tuple[str, ...]) -> Column:
    last = F.lower(F.substring_index(slot, ".", -1))
    return reduce(lambda a, b: a | b, [F.contains(last, F.lit(n)) for n in names])


# The next four take what the type has for a value as ``otherwise``, where a caller has it already.
def is_threshold(slot: Column, value_type: Column) -> Column:
    return F.coalesce(value_type.isin("integer", "float") & _named_like(slot, THRESHOLDS), F.lit(False))


def is_query(slot: Column, value_type: Column) -> Column:
    return F.coalesce(value_type.isin("search_query", "string") & _named_like(slot, QUERIES), F.lit(False))


def wrong_value(value_type: Column, value: Column, seed: int, key: Column, otherwise: Column | None = None) -> Column:
    """A whole number off by a fifth, at least 2; a word of a text by its opposite; else as the type has it."""
    n, up = _number(value), draw(seed, key, "fifth", 2) * 2 - 1
    offset = up * F.greatest(F.lit(2), F.floor(F.abs(n) / 5))
    other = _made(n + offset, F.concat(F.lit("wrong_value_offset_"), offset.cast("string")))
    swaps = [F.when((value_type == "string") & F.contains(F.lower(value), F.lit(a)), _made(F.replace(value, F.lit(a), F.lit(b)), f"wrong_value_swap_{a}_to_{b}")) for a, b in OPPOSITES]
    return F.coalesce(F.when((value_type == "integer") & n.isNotNull(), other), *swaps, (mutated(value_type, value, seed, key) if otherwise is None else otherwise))


def off_by(value_type: Column, value: Column, seed: int, key: Column, otherwise: Column | None = None) -> Column:
    """A whole number one up or down, 0 at least; a fraction a tenth or one off; an identifier by its number; else as the type has it."""
    n, up, by = _number(value), draw(seed, key, "obo", 2) * 2 - 1, F.get(F.array(*map(F.lit, (-0.1, 0.1, -1.0, 1.0))), draw(seed, key, "off", 4))
    whole = _made(F.greatest(F.lit(0), n + up), F.when(up > 0, "off_by_one_+1").otherwise("off_by_one_-1"))
    part = _made(F.bround(value.try_cast("double") + by, 4), F.concat(F.lit("off_by_"), by.cast("string")))
    return F.coalesce(
        F.when(value_type.isin("integer", "line_number") & n.isNotNull(), whole),
        F.when((value_type == "float") & value.try_cast("double").isNotNull(), part),
        F.when(value_type == "identifier", wrong_identifier(value, seed, key)),
        (mutated(value_type, value, seed, key) if otherwise is None else otherwise),
    )


def typo_in_id(value_type: Column, value: Column, seed: int, key: Column) -> Column:
    """The first dot of a path as an underscore; the number at a name's end one up, or two neighbours changed over; else a typo."""
    tail, n = F.regexp_extract(value, r"(\d+)$", 1), F.length(value)
    dotted = F.concat(F.substring_index(value, ".", 1), F.lit("_"), F.substring(value, F.length(F.substring_index(value, ".", 1)) + 2, n))
    raised = F.concat(F.substring(value, F.lit(1), n - F.length(tail)), (tail.try_cast("decimal(38,0)") + 1).cast("string"))
    return F.coalesce(
        F.when((value_type == "filepath") & F.contains(value, F.lit(".")), _made(dotted, "typo_dot_to_underscore")),
        F.when(value_type.isin("identifier", "entity_name") & (tail != ""), _made(raised, "typo_increment_suffix")),
        F.when(value_type.isin("identifier", "entity_name") & (n >= 2), _made(swapped(value, draw(seed, key, "swap", F.greatest(n - 1, F.lit(1)))), "typo_char_swap")),
        typo(value, seed, key),
    )


def threshold_shift(value_type: Column, value: Column, seed: int, key: Column, otherwise: Column | None = None) -> Column:
    """Ten times as much or a tenth; from zero to ten, a fraction to one."""
    n, x, more = _number(value), value.try_cast("double"), draw(seed, key, "shift", 2) == 0
    named = lambda up: F.when(more, f"threshold_shift_scale_{up}x").otherwise("threshold_shift_scale_0.1x")
    whole = F.when(n == 0, _made(F.lit(10), "threshold_shift_from_zero")).otherwise(_made(F.when(more, n * 10).otherwise((n * 0.1).cast("bigint")), named("10")))
    part = F.when(x == 0, _made(F.lit(1.0), "threshold_shift_from_zero")).otherwise(_made(F.bround(F.when(more, x * 10).otherwise(x * 0.1), 4), named("10.0")))
    return F.coalesce(F.when((value_type == "integer") & n.isNotNull(), whole), F.when((value_type == "float") & x.isNotNull(), part), (mutated(value_type, value, seed, key) if otherwise is None else otherwise))


def wrong_parameter(value_type: Column, value: Column, seed: int, key: Column, otherwise: Column | None = None) -> Column:
    """The other truth value; a usual wrong number, or twice or half as much; two neighbours of a text changed over, one or two signs twice."""
    n = _number(value)
    usual = F.filter(F.array(*[F.lit(x).cast("bigint") for x in (0, 1, -1, 100, 1000)], n * 2, F.floor(n / 2)), lambda x: x != n)
    number = _made(F.get(usual, draw(seed, key, "usual", F.greatest(F.size(usual), F.lit(1)))), "wrong_common_value")
    text = F.when(F.length(value) >= 3, typo(value, seed, key)).otherwise(_made(F.concat(value, value), "char_duplicate"))
    return F.coalesce(F.when(value_type == "boolean", flipped(value)), F.when((value_type == "integer") & n.isNotNull(), number), F.when(value_type == "string", text), (mutated(value_type, value, seed, key) if otherwise is None else otherwise))


def mutated(value_type: Column, value: Column, seed: int, key: Column) -> Column:
    """struct(value, method) by the slot's type."""
    out = F.when(value_type == "integer", wrong_integer(value, seed, key))
    for kinds, made in (
        (("line_number",), wrong_line(value, seed, key)),
        (("float", "latitude", "longitude"), wrong_float(value, seed, key)),
        (("filepath",), wrong_path(value, seed, key)),
        (("search_query",), query_drift(value, seed, key)),
        (("identifier",), wrong_identifier(value, seed, key)),
        (("entity", "entity_name"), wrong_entity(value, seed, key)),
        (("url", "api_endpoint"), wrong_url(value, seed, key)),
        (("ipv4",), wrong_ipv4(value, seed, key)),
        (("date",), wrong_date(value, seed, key)),
        (("boolean",), flipped(value)),
        (("string",), wrong_text(value, seed, key)),
    ):
        out = out.when(value_type.isin(*kinds), made)
    return out.otherwise(typo(value, seed, key))


def pick_text(seed: int, key: Column, salt: str, options: tuple[str, ...]) -> Column:
    return pick(seed, key, salt, [F.lit(o) for o in options])


def copied_values(slots: DataFrame) -> DataFrame:
    """Adds ``copied``: the value of the first other step's slot of the same type with another value, or null.

    That is the type's first value, or for slots that have it themselves the first that differs from it: two window values
    instead of a join of a type's slots with themselves.
    """
    kind = Window.partitionBy("trajectory_id", "value_type")
    order = F.struct("step_index", "slot")
    known = slots.filter(F.col("value").isNotNull()).groupBy("trajectory_id", "value_type", "value").agg(F.min(order).alias("_at"))
    ranked = known.withColumn("_rank", F.row_number().over(kind.orderBy("_at"))).filter("_rank <= 2")
    two = ranked.groupBy("trajectory_id", "value_type").agg(F.min_by("value", "_rank").alias("_first"), F.max_by("value", "_rank").alias("_second"), F.count(F.lit(1)).alias("_n"))
    copied = F.when(F.col("value") != F.col("_first"), F.col("_first")).when((F.col("_n") > 1) & (F.col("value") == F.col("_first")), F.col("_second"))
    return slots.join(two, ["trajectory_id", "value_type"], "left").withColumn("copied", copied).select(*slots.columns, "copied")


def near_tool(slots: DataFrame, substitutes: DataFrame) -> DataFrame:
    """Tool slots with the best substitute of their tool."""
    best = substitutes.filter("rank = 1").select(F.col("tool").alias("value"), F.col("substitute").alias("perturbed_value"))
    return slots.filter("value_type = 'tool'").join(best, "value")


# Plans of the wrong kind and their signs.
PLANS = ("First, I will skip verification and answer at once.", "I will start with the last step and work backwards.", "I will use the first result without checking it.", "I will repeat the same call until it succeeds.")


def wrong_plan(text: Column, seed: int, key: Column) -> Column:
    return _made(F.when(F.length(text) > 0, pick_text(seed, key, "plan", PLANS)), "template_plan")


def false_terminal(text: Column) -> Column:
    """The step claims that the task is done."""
    return _made(F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit(" The task is now complete.")), "false_terminal")


def truncated(steps: Column, keep: Column) -> Column:
    """Premature termination: the first ``keep`` steps."""
    return F.slice(steps, F.lit(1), keep)


def with_step(steps: Column, index: Column, field: str, value: Column) -> Column:
    """The array with a field of the 1-based step set."""
    return F.transform(steps, lambda s, i: F.when(i + 1 == index, s.withField(field, value)).otherwise(s))


# Pairs of words, of which the second may stand for the first.
SYNONYMS = (
    ("retrieve", "fetch"), ("search", "look up"), ("find", "locate"), ("examine", "inspect"), ("check", "verify"), ("create", "generate"), ("delete", "remove"), ("modify", "alter"),
    ("update", "change"), ("execute", "run"), ("start", "begin"), ("finish", "complete"), ("get", "obtain"), ("put", "place"), ("send", "transmit"), ("receive", "accept"),
    ("read", "access"), ("write", "save"), ("open", "access"), ("close", "terminate"), ("analyze", "examine"), ("compute", "calculate"), ("display", "show"), ("output", "return"),
    ("input", "provide"), ("validate", "verify"), ("error", "issue"), ("problem", "issue"), ("contains", "includes"), ("using", "with"), ("via", "through"),
)
#: Marks of a step's parts, which stay as they are.
PROTECTED = ("Action:", "Action Input:", "Observation:", "Thought:", "Final Answer:", "Finish", "Tool:", "Tool Input:", "Tool Output:")


#: A mark, a word, or any other sign; marks first, the longer before those that begin them.
_PIECES = "|".join([*sorted(PROTECTED, key=len, reverse=True), r"[\p{L}\p{N}_]++", r"[^\p{L}\p{N}_]"])


def with_synonyms(text: Column) -> Column:
    """The text with every word of a pair as its other, case kept and marks left alone; null if there is none. A word of several pairs takes the last one's."""
    pairs = {word: other for a, b in SYNONYMS for word, other in ((a, b), (b, a))}
    known = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])

    def piece(t: Column) -> Column:
        new = F.when(~t.isin(*PROTECTED), F.try_element_at(known, F.lower(t)))
        initial, capital = F.substring(t, 1, 1), F.concat(F.upper(F.substring(new, 1, 1)), F.lower(F.substring(new, F.lit(2), F.length(new))))
        shouted = (t == F.upper(t)) & (t != F.lower(t))
        return F.when(new.isNull(), t).when(shouted, F.upper(new)).when((initial == F.upper(initial)) & (initial != F.lower(initial)), capital).otherwise(new)

    made = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), piece), "")
    return F.get(F.transform(F.array(made), lambda m: F.when(m != text, m)), 0)


def placebo(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the text with synonyms."""
    return df.withColumn(out, with_synonyms(F.col(text)))


def reformatted(document: Column) -> Column:
    """JSON text with other blanks between its parts; null if it has no place for one."""
    other = F.regexp_replace(F.regexp_replace(document, r":\s*(?=[\"\d{\[tfn-])", ": "), r",\s*(?=\")", ",  ")
    return F.when(F.try_parse_json(document).isNotNull() & (other != document), other)


def reordered(df: DataFrame, document: str, out: str) -> DataFrame:
    """Adds ``out``: a JSON object's text with its keys the other way round; null with fewer than two. On the text, whose key order counts."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def one(value):
        try:
            found = json.loads(value)
        except (TypeError, ValueError):
            return None
        return json.dumps(dict(reversed(found.items())), ensure_ascii=False) if isinstance(found, dict) and len(found) > 1 else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{out: [one(v) for v in frame[document]]})

    return df.mapInPandas(run, schema)


def equivalent(before: Column, after: Column) -> Column:
    """Numbers and paths of the first are all in the second."""
    of = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(0))
    inside = lambda p: F.size(F.array_except(of(before, p), of(after, p))) == 0
    return inside(r"\b\d+(?:\.\d+)?\b") & inside(r"(?:/[\w.-]+)+")


def candidates(slots: DataFrame, steps: DataFrame) -> DataFrame:
    """Slots and three kinds of pseudo-slots (tool, plan, ending) with score = criticality + 0.3 + 0.2 per family."""
    real = slots.select("trajectory_id", "step_index", "slot", "value_type", "value")
    pseudo = steps.select("trajectory_id", "step_index", "step_role", "tool_name", "raw_text", "is_terminal_step")
    tool = pseudo.filter("step_role = 'tool_call'").select("trajectory_id", "step_index", F.lit("tool_name").alias("slot"), F.lit("tool").alias("value_type"), F.col("tool_name").alias("value"))
    plan = pseudo.filter("step_role = 'planning'").select("trajectory_id", "step_index", F.lit("plan").alias("slot"), F.lit("plan").alias("value_type"), F.col("raw_text").alias("value"))
    ending = pseudo.filter("not is_terminal_step").select("trajectory_id", "step_index", F.lit("ending").alias("slot"), F.lit("ending").alias("value_type"), F.col("raw_text").alias("value"))
    every = real.unionByName(tool).unionByName(plan).unionByName(ending)
    families = F.when(F.col("value_type") == "tool", 1).when(F.col("value_type").isin("plan", "ending"), 1).when(F.col("value_type").isin("filepath", "line_number", "integer"), 2).otherwise(1)
    kind = F.when(F.col("value_type").isin("plan", "ending"), "coarse_grained").otherwise("fine_grained")
    scored = every.join(steps.select("trajectory_id", "step_index", "critical_path_score"), ["trajectory_id", "step_index"])
    return scored.withColumns({"perturbation_class": kind, "score": F.bround(F.col("critical_path_score") + 0.3 + 0.2 * families, 3)})


def valid_pair(cls: Column, family: Column) -> Column:
    return F.coalesce(*[F.when(cls == c, family.isin(*f)) for c, f in FAMILIES.items()], F.lit(False))


def valid_type(family: Column, kind: Column) -> Column:
    return F.coalesce(*[F.when(family == f, kind.isin(*t)) for f, t in TYPES.items()], F.lit(False))


def quality_check(df: DataFrame) -> DataFrame:
    """Adds qc_failed (names of failed checks), qc_status (valid, borderline with one, invalid) and derived_impact."""
    fail = lambda bad, name: F.when(F.coalesce(bad, F.lit(True)), name)
    placebo_ = F.col("perturbation_class") == "placebo"
    failed = F.array_compact(
        F.array(
            fail(F.col("perturbation_id").isNull() | F.col("original_trajectory_id").isNull(), "schema"),
            fail(F.col("original_value").eqNullSafe(F.col("perturbed_value")), "no_change"),
            fail(F.coalesce(F.col("perturbed_value").rlike(r"(?i)_(old|mutated|wrong|modified|perturbed)\b"), F.lit(False)), "synthetic_marker"),
            fail(placebo_ & ~equivalent(F.col("original_value"), F.col("perturbed_value")), "placebo_changes_meaning"),
            fail(~valid_pair(F.col("perturbation_class"), F.col("perturbation_family")), "class_family"),
            fail(~valid_type(F.col("perturbation_family"), F.col("perturbation_type")), "family_type"),
        )
    )
    n = F.size("qc_failed")
    impact = impact_from_criticality(F.col("critical_path_score"), F.col("affects_final_answer"), F.col("recoverable_if_wrong"), F.col("perturbation_class"))
    return df.withColumn("qc_failed", failed).withColumns({"qc_status": F.when(n == 0, "valid").when(n == 1, "borderline").otherwise("invalid"), "derived_impact": impact})


def qc_statistics(df: DataFrame) -> DataFrame:
    """(kind, value, n): statuses, failed checks and derived impacts, those from 0 to 3 without rows included."""
    part = lambda kind, c: df.select(F.lit(kind).alias("kind"), c.alias("value"))
    rows = part("status", F.col("qc_status")).unionByName(df.select(F.lit("failed").alias("kind"), F.explode("qc_failed").alias("value"))).unionByName(part("impact", F.col("derived_impact").cast("string")))
    zero = df.sparkSession.range(4).select(F.lit("impact").alias("kind"), F.col("id").cast("string").alias("value"), F.lit(0).alias("w"))
    return rows.withColumn("w", F.lit(1)).unionByName(zero).groupBy("kind", "value").agg(F.sum("w").alias("n"))


# -- evaluation units ----------------------------------------------------------
def reconstructed(perturbed: Column, index: Column, field: str, original: Column) -> Column:
    """The baseline's steps from the perturbed ones: the inverse of a slot's change."""
    return with_step(perturbed, index, field, original)


def with_ids(steps: Column, source: Column) -> Column:
    """Steps with canonical ids and display numbers."""
    return F.transform(steps, lambda s, i: F.struct(F.format_string("%s::step::%d", source, i + 1).alias("canonical_step_id"), (i + 1).alias("display_step_index"), s.alias("step")))


#: Fields of a unit's denormalised view.
CACHE_FIELDS = (
    "baseline_outcome", "baseline_num_steps", "perturbed_num_steps", "perturbation_class", "perturbation_family", "perturbation_type", "target_step_canonical_id", "expected_impact",
    "expected_detectability",
)


def _cached_now() -> dict[str, Column]:
    """The view's fields from a unit's own: baseline_outcome, baseline and perturbed (steps), original_trajectory_id, target_step_index and the perturbation's."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    now = {
        "baseline_outcome": F.coalesce("baseline_outcome", F.lit(0.0)),
        "baseline_num_steps": size("baseline"),
        "perturbed_num_steps": size("perturbed"),
        "target_step_canonical_id": F.format_string("%s::step::%d", text("original_trajectory_id"), F.coalesce("target_step_index", F.lit(0)).cast("int")),
        "expected_impact": F.coalesce("expected_impact", F.lit(0)).cast("int"),
        "expected_detectability": F.coalesce("expected_detectability", F.lit(1)).cast("int"),
    } | {c: text(c) for c in ("perturbation_class", "perturbation_family", "perturbation_type")}
    return {c: now[c] for c in CACHE_FIELDS}


def derived_cache(df: DataFrame) -> DataFrame:
    """Adds ``derived_cache``, the unit's denormalised view; built again from the unit, never edited."""
    return df.withColumn("derived_cache", F.struct(*[v.alias(c) for c, v in _cached_now().items()]))


def cache_mismatches(df: DataFrame) -> DataFrame:
    """Adds ``mismatches``: fields in which the cache is not what the unit says."""
    return df.withColumn("mismatches", F.array_compact(F.array(*[F.when(~F.col(f"derived_cache.{c}").eqNullSafe(v), c) for c, v in _cached_now().items()])))


def unit_errors(df: DataFrame) -> DataFrame:
    """Adds ``errors``: id, structure, step identity, tier and blinding of a unit."""
    wrong = lambda bad, name: F.when(F.coalesce(bad, F.lit(True)), name)
    same = lambda a, b: F.transform(a, lambda s: s["canonical_step_id"]) == F.transform(b, lambda s: s["canonical_step_id"])
    return df.withColumn(
        "errors",
        F.array_compact(
            F.array(
                wrong(~F.col("unit_id").rlike(r"^eval::.+::\d{3,}$"), "id"),
                wrong(F.col("baseline").isNull() | F.col("perturbed").isNull() | (F.size("baseline") == 0), "structure"),
                wrong(~same(F.slice("baseline", 1, F.size("perturbed")), F.slice("perturbed", 1, F.size("baseline"))), "identity"),
                wrong(~F.coalesce(F.col("replay_tier").isin(1, 2, 3), F.lit(True)), "tier"),
                wrong(F.col("is_a_baseline").isNull(), "blinding"),
            )
        ),
    )


def unit_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({"is_placebo": F.col("perturbation_class") == "placebo", "is_high_impact": F.col("expected_impact") == 3, "is_subtle": F.col("expected_detectability") <= 1})
