"""Personal data: four base kinds by rule, and candidate gradient boosting for further kinds. DataFrame functions only.

Base kinds (leftmost non-overlapping matches of each, whole texts): email, ip (parts up to 255), card (16 to 19 digits that
pass Luhn), phone (8 to 15 digits). Matches that fail the test after the pattern are dropped without another try.

Further kinds (secret, national phone, social number, bank account): generators with high recall propose spans, which may
overlap; boosted trees score each by its format and its context; spans at or above a threshold, calibrated for `PRECISION`
on made-up examples held back from training, are selected. Of those that overlap no base span, the best first, each is
selected if it overlaps none selected before. The trees are trained on the driver on `EXAMPLES` made-up examples and become one SQL expression.

Positions are code points, ends exclusive. Null and empty texts have no spans. Repeated rows are answered each. Candidates of one
score are taken by start, end and kind. An empty table gives an empty table; columns named like an output or lg_ helpers raise an
error. Many matches in one text: positions, overlaps and selection go by blocks of the square root of their number.

To keep matching linear and free of recursion on very long texts, patterns run on a text of equal length in which
separators that no match can hold are replaced, and a match may begin only where a run of its characters begins or the
match before it has ended (a match that began later could have begun there).
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import gbt
from .common import check_free, table

BASE = ("email", "ip", "card", "phone")
EXAMPLES, PRECISION, CONTEXT = 4_000, 0.97, 24
#: The words whose presence before a span speaks for each further kind.
HINTS = {"secret": "token|secret|passw|pwd|key", "natphone": "tel|phone|call|mobile|fax", "social": "ssn|social|insurance", "account": "iban|account|konto|cuenta|compte"}
GENERATORS = {
    "secret": r"[A-Za-z0-9_/+=-]{16,}",
    "natphone": r"\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}",
    "social": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "account": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4} ?[A-Z0-9]{4} ?[A-Z0-9]{2,4}[A-Z0-9 ]{0,22}",
}
FEATURES = ["size", "digits", "uppers", "seps", "kinds", "hint", "quoted", "glued_left", "glued_right", *[f"is_{k}" for k in GENERATORS]]


def sql(text: str) -> str:
    return "r'" + text + "'"


_numbers = itertools.count()


def let(value: str, body) -> str:
    """SQL: body(name) with a name for value, which is computed once."""
    name = f"v{next(_numbers)}"
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def scan(values: str, op: str, zero: str) -> str:
    """SQL: for each element of an array of ints, op (of a and x) over those before it, from zero on.

    Arrays can only be appended to by copying, so this goes by blocks of the square root of the size.
    """

    def plain(xs: str, start: str) -> str:
        a, x = f"a{next(_numbers)}", f"x{next(_numbers)}"
        return f"slice(aggregate({xs}, array({start}), ({a}, {x}) -> concat({a}, array({op.format(a=f'element_at({a}, -1)', x=x)}))), 1, size({xs}))"

    def blocked(v: str) -> str:
        i, b, o, a, x = (f"{c}{next(_numbers)}" for c in "ibocx")
        blocks = let(f"cast(sqrt(size({v})) as int)", lambda n: f"transform(sequence(0, size({v}) - 1, {n}), {i} -> slice({v}, {i} + 1, {n}))")
        totals = lambda bs: f"transform({bs}, {b} -> aggregate({b}, {zero}, ({a}, {x}) -> {op.format(a=a, x=x)}))"
        return let(blocks, lambda bs: let(totals(bs), lambda t: f"flatten(zip_with({bs}, {plain(t, zero)}, ({b}, {o}) -> {plain(b, o)}))"))

    return let(values, lambda v: f"if(size({v}) <= 64, {plain(v, zero)}, {blocked(v)})")


def spans(text: str, pattern: str) -> str:
    """SQL: array of (s, e, x) for the matches of pattern in the expression text."""
    i, x, y = (f"{c}{next(_numbers)}" for c in "ixy")

    def placed(m: str, g: str) -> str:
        sizes = f"zip_with({m}, slice({g}, 1, size({m})), ({x}, {y}) -> length({x}) + length({y}))"
        one = lambda at: f"named_struct('s', {at}[{i}] + length({g}[{i}]), 'e', {at}[{i}] + length({g}[{i}]) + length({m}[{i}]), 'x', {m}[{i}])"
        return let(scan(sizes, "{a} + {x}", "0"), lambda at: f"transform(sequence(0, size({m}) - 1), {i} -> {one(at)})")

    found = let(f"split({text}, {sql(pattern)}, -1)", lambda g: placed("{m}", g))
    return let(f"regexp_extract_all({text}, {sql(pattern)}, 0)", lambda m: f"if(size({m}) = 0, {NONE}, {found.replace('{m}', m)})")


NONE = "cast(array() as array<struct<s:int,e:int,x:string>>)"
LUHN = "aggregate(transform(split(reverse(d), ''), (c, i) -> if(i % 2 = 0, int(c), if(2 * int(c) > 9, 2 * int(c) - 9, 2 * int(c)))), 0, (s, v) -> s + v) % 10 = 0"


def base_exprs(text: str) -> dict[str, str]:
    """SQL of the base spans of a non-null text expression."""
    dots = rf"regexp_replace({text}, {sql(r'(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])')}, '%')"  # other dots cannot be in a domain; % stands in for them in a local part
    seps = rf"regexp_replace({text}, {sql(r'(?<![0-9])[ -]|[ -](?![0-9])')}, '_')"
    email = spans("t", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+")
    ip = spans(text, r"(?:(?<![0-9])|\G)[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
    card = spans("t", r"[0-9][0-9 -]*[0-9]")
    phone = spans(text, r"\+[0-9][\x20().0-9-]+[0-9]")
    one = lambda value, body: f"transform(array({value}), t -> {body})[0]"
    ok_ip = "not exists(split(m.x, '[.]'), p -> length(ltrim('0', p)) > 3 or int(right(p, 3)) > 255)"
    ok_card = f"transform(array(translate(m.x, ' -', '')), d -> if(length(d) between 16 and 19, {LUHN}, false))[0]"
    ok_phone = "length(regexp_replace(m.x, '[^0-9]', '')) between 8 and 15"
    return {
        "email": f"if(instr({text}, '@') > 0, {one(dots, email)}, {NONE})",
        "ip": f"if({text} rlike {sql('[0-9][.][0-9]')}, filter({ip}, m -> {ok_ip}), {NONE})",
        "card": f"if({text} rlike {sql('[0-9](?:[ -]?[0-9]){15}')}, filter({one(seps, card)}, m -> {ok_card}), {NONE})",
        "phone": f"if(instr({text}, '+') > 0, filter({phone}, m -> {ok_phone}), {NONE})",
    }


def features_sql(text: str, kind: str) -> str:
    """SQL: the features of a span c of the text, as a struct."""
    left = f"substring({text}, greatest(c.s - {CONTEXT} + 1, 1), least(c.s, {CONTEXT}))"
    has = lambda p: f"int(c.x rlike {sql(p)})"
    values = {
        "size": "length(c.x)", "digits": "length(regexp_replace(c.x, '[^0-9]', '')) / length(c.x)", "uppers": "length(regexp_replace(c.x, '[^A-Z]', '')) / length(c.x)",
        "seps": "length(regexp_replace(c.x, '[^ ().-]', ''))", "kinds": f"{has('[a-z]')} + {has('[A-Z]')} + {has('[0-9]')}", "hint": f"int(lower({left}) rlike '{HINTS[kind]}')",
        "quoted": f"int({left} rlike {sql(r'[=:]\s*[^A-Za-z0-9\s]?$')})", "glued_left": f"int({left} rlike '[A-Za-z0-9]$')", "glued_right": f"int(substring({text}, c.e + 1, 1) rlike '[A-Za-z0-9]')",
    } | {f"is_{k}": str(int(k == kind)) for k in GENERATORS}
    return "named_struct(" + ", ".join(f"'{n}', cast({values[n]} as double)" for n in FEATURES) + ")"


def features(text: str, s: int, e: int, kind: str) -> list[float]:
    """The same features in Python, for training."""
    import re

    x, left = text[s:e], text[max(0, s - CONTEXT) : s]
    has = lambda p: float(bool(re.search(p, x)))
    share = lambda p: len(re.findall(p, x)) / len(x)
    own = [len(x), share("[0-9]"), share("[A-Z]"), len(re.findall("[ ().-]", x)), has("[a-z]") + has("[A-Z]") + has("[0-9]"), float(bool(re.search(HINTS[kind], left.lower()))), float(bool(re.search(r"[=:]\s*[^A-Za-z0-9\s]?$", left))), float(bool(re.search("[A-Za-z0-9]$", left))), float(bool(re.search("[A-Za-z0-9]", text[e : e + 1])))]
    return own + [float(k == kind) for k in GENERATORS]


def examples(seed: int = 7, count: int = EXAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """Made-up spans with their features and labels."""
    import re

    rng = np.random.default_rng(seed)
    pick = lambda s, n: "".join(rng.choice(list(s), n))
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = lambda: pick(lower, int(rng.integers(2, 9)))
    hint = {"secret": ["token", "api_key", "secret", "password"], "natphone": ["tel", "phone", "call", "mobile"], "social": ["ssn", "social no"], "account": ["iban", "account", "konto"]}
    rows, labels = [], []
    while len(rows) < count:
        kind = str(rng.choice(list(GENERATORS)))
        real = bool(rng.random() < 0.5)
        if kind == "secret":
            x = pick(*((("0123456789abcdef", int(rng.integers(24, 65))),) if rng.random() < 0.5 else ((digits + lower + upper + "_-", int(rng.integers(20, 50))),))[0]) if real else str(rng.choice([pick(lower, int(rng.integers(16, 40))), "=" * int(rng.integers(16, 40)), pick(digits, int(rng.integers(16, 24))), "-".join(word() for _ in range(4)), "/".join(word() for _ in range(4))]))
        elif kind == "natphone":
            x = f"({pick(digits, 3)}) {pick(digits, 3)}-{pick(digits, 4)}" if rng.random() < 0.5 else "-".join(pick(digits, n) for n in (3, 3, 4))
        elif kind == "social":
            x = f"{pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}"
        else:
            x = pick(upper, 2) + pick(digits, 2) + " " + " ".join(pick(digits, 4) for _ in range(4)) if real else pick(upper, 2) + pick(digits, 2) + pick(upper + digits, 12)
        lead = f"{word()} {word()} "
        if real and rng.random() < (0.7 if kind == "secret" else 0.95):
            lead += str(rng.choice(hint[kind])) + str(rng.choice([" = \"", ": ", " ", "=", ": "]))
        if not real and rng.random() < 0.4:
            lead = lead.rstrip() + str(rng.choice([pick(digits, 2), word(), "#", "no. "]))
        tail = (" " if real or rng.random() < 0.6 else pick(digits + lower, 2)) + word()
        text = lead + x + tail
        m = next((m for m in re.finditer(GENERATORS[kind], text) if m.start() < len(lead) + len(x) and m.end() > len(lead)), None)
        if m:
            rows.append(features(text, m.start(), m.end(), kind))
            labels.append(float(real))
    return np.array(rows), np.array(labels)


@functools.cache
def model() -> tuple[gbt.Forest, float]:
    """The forest and the margin at or above which a candidate is selected."""
    x, y = examples()
    cut = len(y) * 3 // 4
    forest = gbt.fit(x[:cut], y[:cut], trees=24, depth=3, rate=0.3)
    return forest, gbt.threshold_for(forest.margin(x[cut:]), y[cut:], PRECISION)


def added_expr(text: str) -> str:
    """SQL: selected spans of further kinds, given the column lg_base with all base spans."""
    forest, least = model()
    score = forest.sql([f"f.{n}" for n in FEATURES])
    parts = []
    for kind, pattern in GENERATORS.items():
        seen = f"if({text} rlike {sql(pattern)}, {spans(text, pattern)}, {NONE})"
        parts.append(f"transform({seen}, c -> transform(array({features_sql(text, kind)}), f -> named_struct('kind', '{kind}', 's', c.s, 'e', c.e, 'm', {score}))[0])")
    return f"filter(concat({', '.join(parts)}), c -> c.m >= {least:.8f}D)"


SPANS = "array<struct<kind:string,s:int,e:int,m:double>>"


def apart(c: str, blocks: str) -> str:
    """SQL: whether the span c overlaps none of the spans in blocks (s, e, items)."""
    return f"not exists({blocks}, k -> k.s < {c}.e and {c}.s < k.e and exists(k.items, d -> d.s < {c}.e and {c}.s < d.e))"


def blocks_of(sorted_spans: str) -> str:
    """SQL: spans in order of start as blocks of about the square root of their number, with the first start and the last end."""
    pick = lambda v, n: f"transform(sequence(0, size({v}) - 1, {n}), i -> slice({v}, i + 1, {n}))"
    whole = lambda v: let(f"cast(sqrt(size({v})) as int)", lambda n: f"transform({pick(v, n)}, q -> named_struct('s', q[0].s, 'e', array_max(transform(q, d -> d.e)), 'items', q))")
    return let(sorted_spans, lambda v: f"if(size({v}) = 0, null, {whole(v)})")


def greedy(candidates: str) -> str:
    """SQL: of candidates (kind, s, e, m), best first, those that overlap none selected before. Ties go to the first start, end and kind.

    Candidates are cut into runs that do not touch each other, which are settled by themselves.
    """
    rank = "named_struct('r', -c.m, 's', c.s, 'e', c.e, 'kind', c.kind, 'm', c.m)"
    free = "not exists(a, d -> d.s < c.e and c.s < d.e)"
    one = f"aggregate(transform(array_sort(transform(run, c -> {rank})), c -> named_struct('kind', c.kind, 's', c.s, 'e', c.e, 'm', c.m)), cast(array() as {SPANS}), (a, c) -> if({free}, concat(a, array(c)), a))"

    def runs(v: str) -> str:
        heads = lambda ends: f"filter(sequence(0, size({v}) - 1), i -> {v}[i].s >= {ends}[i])"
        cut = lambda at: f"transform({at}, (i, j) -> slice({v}, i + 1, coalesce(get({at}, j + 1), size({v})) - i))"
        return let(scan(f"transform({v}, c -> c.e)", "greatest({a}, {x})", "0"), lambda ends: let(heads(ends), cut))

    by_start = f"transform(array_sort(transform({candidates}, c -> named_struct('s', c.s, 'e', c.e, 'kind', c.kind, 'm', c.m))), c -> named_struct('kind', c.kind, 's', c.s, 'e', c.e, 'm', c.m))"
    return let(by_start, lambda v: f"if(size({v}) <= 1, {v}, flatten(transform({runs(v)}, run -> {one})))")


def find(docs: DataFrame, name: str = "pii") -> DataFrame:
    """Adds a struct to docs: counts (n_ip and so on, n_added), and base and added, arrays of (kind, s, e)."""
    check_free(docs, name, "lg_text", "lg_base", "lg_added", "lg_blocks", *[f"lg_{k}" for k in BASE])
    own = docs.columns
    out = docs.withColumn("lg_text", F.coalesce("text", F.lit("")))
    out = out.withColumns({f"lg_{k}": F.expr(e) for k, e in base_exprs("lg_text").items()})
    out = out.withColumn("lg_base", F.concat(*[F.expr(f"transform(lg_{k}, m -> named_struct('kind', '{k}', 's', m.s, 'e', m.e))") for k in BASE]))
    out = out.withColumn("lg_added", F.expr(added_expr("lg_text")))
    out = out.withColumn("lg_blocks", F.expr(f"if(size(lg_added) = 0, null, {blocks_of('array_sort(transform(lg_base, c -> named_struct(' + chr(39) + 's' + chr(39) + ', c.s, ' + chr(39) + 'e' + chr(39) + ', c.e)))')})"))
    out = out.withColumn("lg_added", F.expr(f"if(lg_blocks is null, lg_added, filter(lg_added, c -> {apart('c', 'lg_blocks')}))"))
    added = F.expr(f"if(size(lg_added) = 0, cast(array() as array<struct<kind:string,s:int,e:int>>), transform({greedy('lg_added')}, c -> named_struct('kind', c.kind, 's', c.s, 'e', c.e)))")
    out = out.withColumn("lg_added", added)
    counts = [F.expr(f"cast(size(lg_{k}) as bigint)").alias(f"n_{k}") for k in (*BASE, "added")]
    return out.select(*own, F.struct(*counts, F.col("lg_base").alias("base"), F.col("lg_added").alias("added")).alias(name))


def joined(spans_: str) -> str:
    return f"array_join(transform({spans_}, m -> concat(m.kind, ':', m.s, ':', m.e)), ',')"


def redact(docs: DataFrame, mask: str = "pii") -> DataFrame:
    """docs with its own columns, every selected span of text replaced by <kind>."""
    found = find(docs, mask)
    cuts = f"array_sort(transform(concat({mask}.base, {mask}.added), m -> named_struct('s', m.s, 'e', m.e, 'kind', m.kind)))"
    step = "if(m.e <= a.at, a, named_struct('at', m.e, 'out', concat(a.out, substring(text, a.at + 1, greatest(m.s - a.at, 0)), '<', m.kind, '>')))"
    body = f"aggregate({cuts}, named_struct('at', 0, 'out', ''), (a, m) -> {step}, a -> concat(a.out, substring(text, a.at + 1, length(text) - a.at)))"
    return found.withColumn("text", F.expr(f"if(text is null, null, {body})")).select(docs.columns)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "pii.n_email", "pii.n_ip", "pii.n_card", "pii.n_phone", "pii.n_added", F.expr(f"sha2(cast({joined('pii.base')} as binary), 256)").alias("base_sha256"), F.expr(joined("concat(pii.base, pii.added)")).alias("spans"))
