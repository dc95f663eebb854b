"""The classifiers and money forms as SQL functions (g01): each body is one expression, so the optimizer sees through it."""

from __future__ import annotations

from pyspark.sql import SparkSession

from dealspark.functions import lexicons as L

_WORDS = "size(filter(split(t, r'[ \\t\\n\\r\\f]+'), x -> x <> ''))"
_PADDED = "concat(' ', trim(regexp_replace(lower(t), r\"[^\\p{L}\\p{N}']+\", ' ')), ' ')"
_AMOUNT = r"([$₹]?)([0-9][0-9,]*(?:\.[0-9]+)?)\s*(K|M|B|thousand|million|billion|crore|lakh)\b"
_SCALES = {"k": "1e3", "thousand": "1e3", "m": "1e6", "million": "1e6", "b": "1e9", "bn": "1e9", "billion": "1e9", "crore": "1e7", "lakh": "1e5"}


def text(term: str) -> str:
    return f'r"{term}"' if "'" in term else f"r'{term}'"


def _scale(unit: str) -> str:
    return f"case lower({unit}) " + " ".join(f"when '{k}' then {v}D" for k, v in _SCALES.items()) + " else 1D end"


def _let(name: str, value: str, body: str) -> str:
    """body with the value worked out once a row (functions.text.let)."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _net() -> str:
    weighted = "array(" + ", ".join(f"named_struct('term', {text(t)}, 'weight', {w}D)" for t, w in {**L.POSITIVE, **L.NEGATIVE}.items()) + ")"
    times = "((length(low) - length(replace(low, x.term, ''))) div length(x.term))"
    return _let("low", "lower(t)", f"aggregate(filter({weighted}, x -> contains(low, x.term)), 0D, (total, x) -> total + {times} * x.weight)")


def _risk() -> str:
    counts = _let("low", "lower(t)", "array(" + ", ".join(f"regexp_count(low, {text(p)})" for _, p, _ in L.RISKS) + ")")
    weights = [(s, L.RISK_WEIGHTS[level]) for level, _, s in L.RISKS]
    weight = " + ".join(f"n[{i}] * {w}" for i, (_, w) in enumerate(weights))
    total = " + ".join(f"n[{i}] * {s}D * {w}" for i, (s, w) in enumerate(weights))
    return _let("n", counts, f"round(case when {weight} > 0 then least(1D, ({total}) / ({weight})) else 0D end, 6)")


def _intent() -> str:
    hits = lambda terms: "(" + " + ".join(f"cast(contains(p, {text(f' {t} ')}) as int)" for t in terms) + ")"
    yes, no = f"{hits(L.INTERESTED)} * 2", f"{hits(L.NOT_INTERESTED)} * 3"
    return f"(select case when n > y and n > 0 then 'not_interested' when y > 0 then 'interested' else 'pending' end from (select {yes} as y, {no} as n from (select {_PADDED} as p)))"


def _context() -> str:
    counts = _let("low", "lower(t)", "array(" + ", ".join("(" + " + ".join(f"cast(low rlike {text(chr(92) + 'b(' + p + ')' + chr(92) + 'b')} as int)" for p in ps) + ")" for _, ps in L.CONTEXTS) + ")")
    first = " ".join(f"when n[{i}] = array_max(n) then '{name}'" for i, (name, _) in enumerate(L.CONTEXTS))
    return _let("n", counts, f"case when array_max(n) = 0 then 'general' {first} end")


def _numbers() -> str:
    part = lambda i: f"regexp_extract(m, r'(?i){_AMOUNT}', {i})"
    value = f"try_cast(regexp_replace({part(2)}, ',', '') as decimal(20,4)) * cast({_scale(part(3))} as decimal(12,0))"
    spelled = f"concat(case when lower({part(3)}) in ('crore', 'lakh') then '₹' else {part(1)} end, format_number({value}, 0))"
    found = f"array_sort(array_distinct(regexp_extract_all(t, r'(?i)({_AMOUNT})', 1)), (a, b) -> length(b) - length(a))"
    return f"aggregate({found}, t, (text, m) -> replace(text, m, {spelled}))"


def fixed(v: str, digits: int) -> str:
    """`functions.text.fixed` in SQL, for v of 0 and more."""
    if digits == 0:
        return f"case when {v} < {2**53}D then cast(cast(rint({v}) as bigint) as string) else format_string('%.0f', {v}) end"
    t = f"(cast(({v} - floor({v})) * {2**58}D as bigint) * 10)"
    q, r = f"shiftright({t}, 58)", f"({t} & {2**58 - 1})"
    n = f"(cast(floor({v}) as bigint) * 10 + {q} + cast({r} > {2**57} or {r} = {2**57} and {q} % 2 = 1 as bigint))"
    return f"case when {v} < {2**53}D then concat({n} div 10, '.', {n} % 10) else format_string('%.1f', {v}) end"


def money_text() -> str:
    """x21 as the body of a function of v."""
    shown = lambda sign, by, digits: f"concat('$', {fixed(f'(v / {by}D)', digits)}, '{sign}')"
    return f"case when v >= 1e9 then {shown('B', '1e9', 1)} when v >= 1e6 then {shown('M', '1e6', 1)} when v >= 1e3 then {shown('K', '1e3', 0)} else concat('$', cast(floor(v + 0.5D) as bigint)) end"


def create_functions(spark: SparkSession) -> None:
    """sentiment_score (c01), risk_score (c02), email_intent (c04), context_type (c08), normal_numbers (x06), money_value (x20)
    for the session."""
    bare = "lower(regexp_replace(t, '[$₹, ]', ''))"
    bodies = {
        "sentiment_score": ("double", f"coalesce({_let('words', _WORDS, f'case when words > 0 then round(greatest(-1D, least(1D, ({_net()}) / (words * 0.1D))), 3) end')}, 0D)"),
        "risk_score": ("double", _risk()),
        "email_intent": ("string", _intent()),
        "context_type": ("string", _context()),
        "normal_numbers": ("string", _numbers()),
        "money_value": ("double", f"try_cast(nullif(regexp_extract({bare}, r'^([0-9]+(?:\\.[0-9]+)?)', 1), '') as double) * {_scale(f"regexp_extract({bare}, r'^[0-9.]+([a-z]*)$', 1)")}"),
    }
    for name, (kind, body) in bodies.items():
        spark.sql(f"create or replace temporary function {name}(t string) returns {kind} return {body}")
