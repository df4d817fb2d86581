"""Personal data in texts, by DataFrame functions alone: generators, boosted trees over candidates, thresholds.

Base spans are the valid matches of four fixed patterns. Beside them, high-recall generators propose spans that may
overlap: addresses with spaces or a bracketed `at`, hosts with spaced or bracketed dots, and runs of digits with up to
two separators between them, each as a card and as a phone number. Format and context features are small integers, so
the corpus is one aggregate of at most CELLS feature cells.

What a tree learns from. Positives are base spans, and the forms that such a span would have in another writing (without
`+`, as a national number, with dots, brackets or wider gaps, `(at)` for `@`, `[.]` for dots), in the span's real
context: their truth is known, and they are what the generators could add. A rewritten form weighs PRIOR of a span over
all its forms. Negatives are proposals apart from all base spans that lack a cue (a word such as `phone` before them),
or have one and can't be valid. A proposal with a cue that might be valid is evidence of neither and is not counted.

Trees of depth two are boosted under the logistic loss on the driver, from the texts whose crc32 modulo HELD_OUT isn't 0.
On the other texts' cells each kind's threshold is calibrated: the least score from which on the share of positives
among what could be added, smoothed by half a rewritten form, is at least PRECISION; a kind without such a score adds
nothing. The trees are compiled into one SQL expression.

Added spans overlap no base span and no other added one: addresses come first, then hosts, cards and phone numbers.

Long texts. A match's place is the sum of the lengths of the matches and gaps before it; overlaps are found by sorting
spans and candidates together, with the farthest end before and the nearest start after each. All such running values
are taken by blocks of BLOCK, so that a text of a hundred thousand spans takes seconds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import table

KINDS = ("email", "ip", "card", "phone")
BLOCK = 64
PRECISION = 0.98
PRIOR = 0.1
HELD_OUT = 5
ROUNDS = 24
RATE = 0.3
NEAR = 24  # characters before a candidate that may hold a cue

# A match can't begin within a run of its first class unless the match before ended there (\G); possessive runs are
# safe where what follows is outside the run's class. Neither changes what matches; both keep the search linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Proposals beside the base patterns.
LOOSE = {
    "address": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:\x20?[(\[]at[)\]]\x20?|\x20?@\x20?)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "host": r"(?:\G|(?<![0-9]))[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)|\x20\.\x20?|\.\x20)[0-9]{1,3}+){3}(?![0-9])",
    "number": r"(?:\G|(?<![0-9]))[0-9](?:[\x20().\x2d]{0,2}[0-9]){6,}+",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "contains(__t, '@')", "phone": "contains(__t, '+')", "address": r"rlike(__t, r'@|[(\[]at[)\]]')", "host": r"rlike(__t, r'[0-9](?:[\[(]|\x20\.|\.\x20)')"}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CUES = (
    "(?i)(?:e-?mail|mail to|contact|write to|adresse|correo)",
    "(?i)(?:\\bip\\b|host|server|addr)",
    "(?i)(?:card|visa|mastercard|amex|karte|carte|tarjeta|payment|credit)",
    "(?i)(?:phone|tel|call|mobile|fax|whatsapp|anruf|appel|llam)",
)
#: What may stand between a cue and what it names: the rest of its word, signs, and words that say that a value follows.
DIRECT = r"[\w-]*(?:[\s:;.,#=*>(\[-]|\b(?:is|no|nr|number|address|at|via|ist|nummer|est|es|n\u00fam|num[e\u00e9]ro)\b)*[+(\[]?$"
#: Feature names and their numbers of values; their product bounds the cells.
FEATURES = {"kind": 4, "digits": 8, "groups": 4, "plus": 2, "form": 3, "valid": 2, "dots": 3, "cue": 3, "edge": 2}
#: Features that say nothing of how a candidate is written: where it stands, and how long it is.
BESIDE = ("cue", "edge", "digits")
CELLS = math.prod(FEATURES.values())


def _q(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with `name` bound to value, which is computed once; the optimiser inlines no lambda's variable."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _find(df: DataFrame, name: str, pattern: str, when: str) -> DataFrame:
    """Adds array __name of struct(start, end, value, before, after), in code points, of all leftmost non-overlapping
    matches; before and after are of the gaps, and hold no part of another match."""
    add = "0L, (a, x) -> a + x"
    ends = f"p[cast(i div {BLOCK} as int)] + aggregate(slice(l, cast((i div {BLOCK}) * {BLOCK} + 1 as int), cast(i % {BLOCK} + 1 as int)), {add})"
    out = f"transform(m, (x, i) -> named_struct('start', e[i] - length(x), 'end', e[i], 'value', x, 'before', right(g[i], {NEAR}), 'after', left(g[i + 1], 1)))"
    out = _let("e", f"transform(m, (x, i) -> {ends})", out)
    out = _let("p", f"transform(s, (x, i) -> aggregate(slice(s, 1, i + 1), {add}) - x)", out)  # before each block
    out = _let("s", f"transform(sequence(0, (size(l) - 1) div {BLOCK}), b -> aggregate(slice(l, cast(b * {BLOCK} + 1 as int), {BLOCK}), {add}))", out)
    out = _let("l", "transform(m, (x, i) -> cast(length(x) + length(g[i]) as bigint))", out)
    out = _let("g", f"split(__t, {_q(pattern)}, -1)", out)
    out = _let("m", f"if({when}, regexp_extract_all(__t, {_q(pattern)}, 0), array())", f"if(size(m) > 0, {out}, array())")
    return df.withColumn(f"__{name}", F.expr(out))


DIGITS = "regexp_replace(x.value, '[^0-9]', '')"
LUHN = (
    "aggregate(sequence(1, length(d)), 0, (a, i) -> a + element_at(array(0,1,2,3,4,5,6,7,8,9,0,2,4,6,8,1,3,5,7,9),"
    " cast(substring(d, length(d) - i + 1, 1) as int) + if(i % 2 = 0, 11, 1))) % 10 = 0"
)


def _luhn(digits: str) -> str:
    return f"exists(array({digits}), d -> length(d) between 14 and 19 and {LUHN})"


VALID = {
    "email": "true",
    "ip": "rlike(x.value, " + _q("^" + r"\.".join([PART] * 4) + "$") + ")",
    "card": _luhn(DIGITS),
    "phone": f"length({DIGITS}) between 10 and 15",
}



def base_spans(docs: DataFrame) -> DataFrame:
    """docs with __t (the text, null as empty), the raw matches __email, ..., and __base: valid ones, by start, kind, with what
    they match and stand between."""
    df = docs.withColumn("__t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = df.withColumn("__any", F.expr(r"rlike(__t, r'[0-9@]|[(\[]at[)\]]')"))
    for kind, pattern in PATTERNS.items():
        df = _find(df, kind, pattern, f"__any and {NEEDS.get(kind, 'true')}")
    parts = [
        f"transform(filter(__{kind}, x -> {VALID[kind]}), x -> named_struct('start', x.start, 'no', {no}, 'end', x.end, 'kind', '{kind}', 'value', x.value, 'before', x.before, 'after', x.after))"
        for no, kind in enumerate(KINDS)
    ]
    return df.withColumn("__base", F.expr(f"if(__any, array_sort(concat({', '.join(parts)})), array())"))


def _running(array: str, start: str, merge: str) -> str:
    """SQL: for each element x of the array, `start` merged with a value of all elements before it.

    merge is over the value a so far and the element's own value x; elements are their own values.
    """
    k = f"cast(i div {BLOCK} as int)"
    whole = f"transform(sequence(0, (size(w) - 1) div {BLOCK}), j -> aggregate(slice(w, cast(j * {BLOCK} + 1 as int), {BLOCK}), {start}, (a, x) -> {merge}))"
    ahead = f"transform(h, (y, j) -> aggregate(slice(h, 1, j), {start}, (a, x) -> {merge}))"
    out = f"transform(w, (y, i) -> aggregate(slice(w, cast({k} * {BLOCK} + 1 as int), cast(i % {BLOCK} as int)), q[{k}], (a, x) -> {merge}))"
    return f"if(size({array}) > 0, " + _let("w", array, _let("h", whole, _let("q", ahead, out))) + ", array())"


MOST = "9223372036854775807L"
SPANS = "transform(__base, x -> named_struct('start', x.start, 'no', x.no, 'end', x.end, 'kind', x.kind))"


def _apart(cands: str, spans: str) -> str:
    """SQL: those of the array of cands that overlap none of the array of spans (both with start and end)."""
    both = "array_sort(concat(transform(u, x -> named_struct('start', x.start, 'c', 0, 'end', x.end, 'at', -1)), transform(v, (x, i) -> named_struct('start', x.start, 'c', 1, 'end', x.end, 'at', i))))"
    ended = _running("transform(s, x -> if(x.c = 0, x.end, -1L))", "-1L", "greatest(a, x)")
    begun = _running(f"transform(reverse(s), x -> if(x.c = 0, x.start, {MOST}))", MOST, "least(a, x)")
    free = "filter(transform(s, (x, i) -> if(x.c = 1 and before[i] <= x.start and behind[size(s) - 1 - i] >= x.end, x.at, -1)), x -> x >= 0)"
    found = "transform(" + _let("s", both, _let("before", ended, _let("behind", begun, free))) + ", x -> v[x])"
    return _let("u", spans, _let("v", cands, f"if(size(u) = 0 or size(v) = 0, v, {found})"))


# ---------------------------------------------------------------- candidates


def _proposals(df: DataFrame) -> DataFrame:
    """Adds __address, __host and __number, the generators' matches, and __cands: (kind, start, end, value, before, after)
    of every proposal, as often as there are kinds that it may be."""
    for name, pattern in LOOSE.items():
        df = _find(df, name, pattern, f"__any and {NEEDS.get(name, 'true')}")
    kinds = (("address", 0, "true"), ("host", 1, "true"), ("number", 2, f"length({DIGITS}) between 13 and 19"), ("number", 3, f"length({DIGITS}) between 7 and 16"))
    raw = [f"transform(filter(__{name}, x -> {fits}), x -> named_struct('kind', {kind}, 'start', x.start, 'end', x.end, 'value', x.value, 'before', x.before, 'after', x.after))" for name, kind, fits in kinds]
    return df.withColumn("__cands", F.expr(f"if(__any, concat({', '.join(raw)}), array())")).drop(*(f"__{x}" for x in LOOSE))


def _features(c: str = "c") -> str:
    """SQL: the fields of a candidate's features, after its kind."""
    v, before, after = f"{c}.value", f"{c}.before", f"{c}.after"
    d = f"regexp_replace({v}, '[^0-9]', '')"
    made = {
        "digits": f"case when {c}.kind < 2 then 0 when length({d}) < 10 then 1 when length({d}) = 10 then 2 when length({d}) = 11 then 3 when length({d}) < 14 then 4 when length({d}) < 16 then 5 when length({d}) = 16 then 6 else 7 end",
        "groups": f"if({c}.kind < 2, 0, least(size(regexp_extract_all({v}, '[0-9]+', 0)), 4) - 1)",
        "plus": f"cast(startswith({v}, '+') or endswith({before}, '+') as int)",
        "form": f"case when rlike({v}, '[(\\\\[]') or endswith({before}, '(') then 1 when rlike({v}, if({c}.kind < 2, ' ', '[^0-9]{{2}}')) then 2 else 0 end",
        "valid": f"cast(case {c}.kind when 0 then rlike({v}, '[.][A-Za-z]{{2,}}$') when 1 then forall(regexp_extract_all({v}, '[0-9]+', 0), p -> cast(p as bigint) <= 255) when 2 then {_luhn(d)} else length({d}) between 9 and 15 end as int)",
        "dots": f"if({c}.kind = 1, 0, least(size(regexp_extract_all({v}, '[.]', 0)), 2))",
        "cue": f"case {c}.kind " + " ".join(f"when {i} then if(rlike({before}, {_q(cue)}), if(rlike({before}, {_q(cue + DIRECT)}), 2, 1), 0)" for i, cue in enumerate(CUES)) + " end",
        "edge": f"cast(rlike({after}, '[A-Za-z0-9_]') or rlike({before}, '[A-Za-z0-9_]$') as int)",
    }
    return ", ".join(f"'{k}', {x}" for k, x in made.items())


#: Other writings of a valid base span's value x.value, by kind, and the whole generator's match that each must be.
REWRITTEN = (
    ("array(replace(x.value, '@', ' (at) '), replace(x.value, '@', '[at]'), replace(x.value, '@', ' @ '))", "address"),
    ("array(replace(x.value, '.', '[.]'), replace(x.value, '.', '. '), replace(x.value, '.', ' . '))", "host"),
    (f"array(regexp_replace({DIGITS}, '([0-9]{{4}})(?=[0-9])', '$1.'), regexp_replace({DIGITS}, '([0-9]{{4}})(?=[0-9])', '$1  '))", "number"),
    (
        "array(substring(x.value, 2), concat('0', regexp_replace(substring(x.value, 2), '^[0-9]{2}[^0-9]*', '')), regexp_replace(substring(x.value, 2), '[^0-9]+', '.'),"
        " regexp_replace(substring(x.value, 2), '^([0-9]{2,4}?)[^0-9]*', '$1) '))",
        "number",
    ),
)


def _evidence(df: DataFrame) -> DataFrame:
    """Rows (features, plain, rewritten, wrong, unsure): what each text has to say of a cell; df is of _proposals(base_spans()).

    A proposal apart from all base spans is wrong, unless it may be valid and a cue stands directly before it: then it is
    unsure, and train() decides.
    """
    of = "named_struct('kind', x.no, 'value', {value}, 'before', x.before, 'after', x.after, 'plain', {plain}, 'rewritten', {rewritten}, 'wrong', 0.0D)"
    forms = "case x.no " + " ".join(f"when {no} then filter({made}, r -> rlike(r, {_q('^(?:' + LOOSE[whole] + ')$')}))" for no, (made, whole) in enumerate(REWRITTEN)) + " end"
    again = _let("r", forms, f"transform(r, y -> {of.format(value='y', plain='0.0D', rewritten=f'{PRIOR}D / size(r)')})")
    parts = [f"transform(__base, x -> {of.format(value='x.value', plain='1.0D', rewritten='0.0D')})", f"flatten(transform(__base, x -> {again}))"]
    wrong = f"transform({_apart('__cands', '__base')}, x -> named_struct('kind', x.kind, 'value', x.value, 'before', x.before, 'after', x.after, 'plain', 0.0D, 'rewritten', 0.0D, 'wrong', 1.0D))"
    rows = df.select((F.crc32(F.encode("__t", "UTF-8")) % HELD_OUT == 0).alias("held"), F.expr(f"if(size(__cands) > 0 or size(__base) > 0, concat({', '.join(parts)}, {wrong}), array())").alias("e"))
    # neither an inner explode nor a filter: both would be pushed below and compute all of e, or its features, twice
    rows = rows.select("held", F.explode_outer("e").alias("c")).select("held", F.expr(f"named_struct('kind', c.kind, {_features()})").alias("k"), "c.plain", "c.rewritten", "c.wrong")
    neither = (F.col("k.cue") == 2) & (F.col("k.valid") == 1)
    return rows.select("held", "k.*", "plain", "rewritten", F.when(neither, 0.0).otherwise(F.col("wrong")).alias("wrong"), F.when(neither, F.col("wrong")).otherwise(0.0).alias("unsure"))


@dataclass
class PiiModel:
    trees: list[tuple]  # (feature, cut, left, right), a leaf is a number: left if feature <= cut
    thresholds: tuple[float, ...]  # by kind


def boost(cells: list[tuple[tuple[int, ...], float, float]], rounds: int = ROUNDS) -> list[tuple]:
    """Trees of depth two by Newton steps over weighted cells (features, candidates, positives)."""
    score = [0.0] * len(cells)
    trees = []

    def split(rows: list[int], g: list[float], h: list[float]) -> tuple[float, int, int] | None:
        tg, th = sum(g[i] for i in rows), sum(h[i] for i in rows)
        best = None
        for f in range(len(FEATURES)):
            by: dict[int, list[float]] = {}
            for i in rows:
                x = by.setdefault(cells[i][0][f], [0.0, 0.0])
                x[0] += g[i]
                x[1] += h[i]
            lg = lh = 0.0
            for cut in sorted(by)[:-1]:
                lg, lh = lg + by[cut][0], lh + by[cut][1]
                gain = lg * lg / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - tg * tg / (th + 1)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, cut)
        return best

    def leaf(rows: list[int], g: list[float], h: list[float]) -> float:
        return round(-RATE * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1), 6)

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [c[1] * q - c[2] for c, q in zip(cells, p, strict=True)]
        h = [c[1] * q * (1 - q) for c, q in zip(cells, p, strict=True)]

        def grow(rows: list[int], depth: int):
            at = split(rows, g, h) if depth else None  # noqa: B023
            if at is None or at[0] <= 1e-6:
                return leaf(rows, g, h)  # noqa: B023
            _, f, cut = at
            return (f, cut, grow([i for i in rows if cells[i][0][f] <= cut], depth - 1), grow([i for i in rows if cells[i][0][f] > cut], depth - 1))

        tree = grow(list(range(len(cells))), 2)
        trees.append(tree)
        score = [s + value(tree, c[0]) for s, c in zip(score, cells, strict=True)]
    return trees


def value(tree, features: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


def _sql(tree, names: list[str]) -> str:
    if not isinstance(tree, tuple):
        return f"{tree}D"
    return f"if(k.{names[tree[0]]} <= {tree[1]}, {_sql(tree[2], names)}, {_sql(tree[3], names)})"


def train(docs: DataFrame) -> PiiModel:
    """Trees and thresholds from the evidence of all rows (text); at most twice CELLS rows reach the driver.

    An unsure proposal is wrong if it is written as no base span of the corpus is rewritten; else it is left out, as it
    would be counted against what may well be personal data. Null and empty texts say nothing; repeated rows count as
    often as they occur. No evidence gives a model that adds none.
    """
    names = list(FEATURES)
    sums = [F.sum(c).alias(c) for c in ("plain", "rewritten", "wrong", "unsure")]
    rows = _evidence(_proposals(base_spans(docs.select("text")))).groupBy("held", *names).agg(*sums).collect()
    written = lambda r: tuple(r[n] for n in names if n not in BESIDE)
    known = {written(r) for r in rows if r["rewritten"]}
    cells: dict[bool, list] = {True: [], False: []}
    for r in rows:
        if r["kind"] is None:  # of texts without candidates
            continue
        wrong = r["wrong"] + (0.0 if written(r) in known else r["unsure"])
        if r["plain"] + r["rewritten"] + wrong:
            cells[r["held"]].append((tuple(int(r[n]) for n in names), float(r["plain"]), float(r["rewritten"]), float(wrong)))
    learnt = [(f, plain + again + wrong, plain + again) for f, plain, again, wrong in sorted(cells[False])]
    trees = boost(learnt) if learnt else []
    return PiiModel(trees, tuple(calibrated([c for c in cells[True] if c[0][0] == kind], trees) for kind in range(len(KINDS))))


def calibrated(cells: list[tuple], trees: list[tuple]) -> float:
    """The least score that keeps the precision over cells (features, plain, rewritten, wrong); infinite if none does."""
    by: dict[float, list[float]] = {}
    for features, _, again, wrong in cells:
        x = by.setdefault(round(sum(value(t, features) for t in trees), 9), [0.0, 0.0])
        x[0], x[1] = x[0] + again, x[1] + wrong
    least, right, false = math.inf, 0.0, 0.0
    for score in sorted(by, reverse=True):
        right, false = right + by[score][0], false + by[score][1]
        if right / (right + false + PRIOR / 2) >= PRECISION:
            least = score
    return least


def detected(docs: DataFrame, model: PiiModel) -> DataFrame:
    """(row, text, base, spans): each row of docs whole, whatever its columns are named, and its arrays of spans.

    A span is (start, no, end, kind), in order of start and the kind's number; null and empty texts have none, and their
    text stays as it is. Repeated rows keep their number; an empty table gives no rows.
    """
    df = base_spans(docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text")))
    if all(math.isinf(t) for t in model.thresholds):
        return df.select("row", "text", F.expr(SPANS).alias("base"), F.expr(SPANS).alias("spans"))
    df = _proposals(df)
    total = " + ".join(_sql(t, list(FEATURES)) for t in model.trees) or "0.0D"
    least = "case k.kind " + " ".join(f"when {i} then {'9e9D' if math.isinf(t) else f'{t - 1e-6!r}D'}" for i, t in enumerate(model.thresholds)) + " end"
    # each step refers once to the one before, so that a filter on the result, which the optimiser pushes down through
    # all of them, computes it twice and not twice a step
    new = f"transform(filter(transform({_apart('__cands', 'b')}, c -> named_struct('start', c.start, 'end', c.end, 'kind', c.kind, {_features()})), k -> ({total}) >= {least}), k -> named_struct('start', k.start, 'no', k.kind, 'end', k.end))"
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    df = df.withColumn("__s", F.expr(_let("b", "__base", f"named_struct('base', {SPANS.replace('__base', 'b')}, 'new', {new})")))
    df = df.withColumn("__s", F.expr(_let("s", "__s", "named_struct('base', s.base, 'new', s.new, 'kept', filter(s.new, x -> x.no = 0))")))
    for no in range(1, len(KINDS)):
        kept = f"concat(o.kept, {_apart(f'filter(o.new, x -> x.no = {no})', 'o.kept')})"
        df = df.withColumn("__s", F.expr(_let("o", "__s", f"named_struct('base', o.base, 'new', o.new, 'kept', {kept})")))
    added = f"transform(s.kept, x -> named_struct('start', x.start, 'no', x.no, 'end', x.end, 'kind', {names}[x.no]))"
    df = df.withColumn("__s", F.expr(_let("s", "__s", f"named_struct('base', s.base, 'spans', if(size(s.kept) > 0, array_sort(concat(s.base, {added})), s.base))")))
    return df.select("row", "text", F.col("__s.base").alias("base"), F.col("__s.spans").alias("spans"))


def detect(docs: DataFrame, model: PiiModel) -> DataFrame:
    """All columns of docs, and pii_base and pii_spans, which replace columns of these names."""
    held = [f"row.{c}" for c in docs.columns if c not in ("pii_base", "pii_spans")]
    return detected(docs, model).select(*held, F.col("base").alias("pii_base"), F.col("spans").alias("pii_spans"))


def redact(docs: DataFrame, model: PiiModel) -> DataFrame:
    """docs with each span of its texts replaced by its kind in brackets; overlapping spans become one, of the first's kind.

    Texts without a span, null and empty ones too, stay as they are; rows keep their number.
    """
    ended = _running("transform(spans, x -> x.end)", "0L", "greatest(a, x)")  # the farthest end before each span
    firsts = "filter(transform(spans, (x, i) -> if(e[i] <= x.start, i, -1)), x -> x >= 0)"
    last = "aggregate(spans, 0L, (a, x) -> greatest(a, x.end))"
    merged = f"transform(f, (x, i) -> named_struct('start', spans[x].start, 'end', if(i + 1 < size(f), e[f[i + 1]], {last}), 'kind', spans[x].kind))"
    df = detected(docs, model).withColumn("__m", F.expr(f"if(size(spans) > 0, {_let('e', ended, _let('f', firsts, merged))}, array())"))
    # the text in as many parts as there are spans in a part, so that each piece is cut out of a short string
    per = "cast(ceil(sqrt(size(__m))) as int)"
    begin = "cast(if(p = 0, 0, __m[p * n - 1].end) as int)"
    end = "cast(least((p + 1) * n, size(__m)) as int)"
    piece = "concat(substring(z, cast(if(i = 0, 0, b[i - 1].end - o) + 1 as int), cast(s.start - if(i = 0, o, b[i - 1].end) as int)), '[', upper(s.kind), ']')"
    part = _let("z", f"substring(text, {begin} + 1, cast(__m[{end} - 1].end as int) - {begin})", _let("o", begin, _let("b", f"slice(__m, cast(p * n + 1 as int), {end} - cast(p * n as int))", f"array_join(transform(b, (s, i) -> {piece}), '')")))
    parts = _let("n", per, f"array_join(transform(sequence(0, (size(__m) - 1) div n), p -> {part}), '')")
    text = f"if(size(__m) > 0, concat({parts}, substring(text, cast(element_at(__m, -1).end + 1 as int))), text)"
    return df.withColumn("__out", F.expr(text)).select(*[F.col("__out").alias("text") if c == "text" else f"row.{c}" for c in docs.columns])


def op5(spark, sf_dir: str) -> DataFrame:
    """detect() over the table documents by a model of its own texts; rows as there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = detect(docs, train(docs))
    joined = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(pii_base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.expr(joined.format("pii_base")), 256).alias("base_sha256"),
        F.expr(joined.format("pii_spans")).alias("spans"),
    )
