"""Personal data by weak supervision, in DataFrame and SQL functions only.

Base spans come from one pattern a kind, leftmost and non-overlapping, with a
check of each match. Further candidates (long mixed tokens, local telephone
numbers) come from wider patterns. Every candidate gets votes (1 for, -1
against, 0 none) of five labelers: a strict pattern, a gazetteer, the words
before it, its neighbours' characters, and its shape. Expectation-maximisation
on the counts of vote patterns estimates each labeler's reliability by kind,
and a naive Bayes span classifier is trained on the posteriors with surface
features beside the votes. Base spans always stay; other candidates become
spans if the classifier gives them one half or more and they overlap no base
span.

Texts are read once; candidates stay arrays of their row, so nothing is
joined or shuffled but the counts of vote and feature patterns, whose number is
bounded by the product of their few values; those reach the driver.

Offsets are code points, ends exclusive. Null texts count as empty. Patterns
take runs of characters whole, and offsets and overlaps come from sums and maxima
over parts of a text's matches, so a text costs time in proportion to its length and its
matches (100 000 of them in one text: seconds).
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import store

KINDS = ("email", "ip", "card", "phone")
ADDED = ("phone_local", "secret")

# Same matches as the contract's patterns. Runs are taken whole (possessive)
# and start at their first character or where the last match ended (\G), as a
# later start could match only what an earlier one has matched already.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "phone_local": r"(?:\G|(?<![0-9+]))(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
    "secret": r"(?:\G|(?<![A-Za-z0-9]))(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+",
}
# Cheap tests without which a pattern cannot match.
GATES = {"email": "contains({t}, '@')", "phone": "contains({t}, '+')"}
SPAN = "array<struct<kind:string,s:bigint,e:bigint,m:string,l:string,r:string>>"
CONTEXT = 24
PART = 256  # elements of an array that are scanned by appending

# Gazetteers.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info", "eu")
SECRET_PREFIXES = ("AKIA", "ASIA", "ghp", "gho", "sk", "pk", "xox", "AIza", "eyJ")
WORDS = {
    "email": "e-?mail|mail|contact|write|adresse|correo|courriel",
    "ip": "ip|host|server|address|addr|from|login",
    "card": "card|visa|credit|pay|iban|carte|karte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|whatsapp",
    "phone_local": "phone|tel|call|mobile|fax|whatsapp",
    "secret": "token|secret|key|api|passw|auth|bearer",
}
AGAINST = "version|section|isbn|issn|page|fig|commit|sha|md5|uuid"


def _quote(s: str) -> str:
    return "r\"" + s + "\""


def _found(kind: str, text: str) -> list[str]:
    """SQL: arrays of the gaps before the matches and of the matches. Gaps and matches are
    taken in turn, the last gap ends the text, so lengths add up to offsets."""
    pat = _quote("([\\s\\S]*?)(" + PATTERNS[kind] + "|\\z)")
    gate = GATES.get(kind, "digits").format(t=text)
    g, m = f"regexp_extract_all({text}, {pat}, 1)", f"regexp_extract_all({text}, {pat}, 2)"
    return [f"if({gate}, {g}, array('')) as g_{kind}", f"if({gate}, {m}, array('')) as m_{kind}"]


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _scan(values: str, zero: str, op) -> str:
    """SQL: for each element of an array of longs, ``op`` over the elements before it.

    Appending to an array copies it, so elements are taken in parts of ``PART``: each
    part is scanned by itself, then the totals of the parts, whose number is what grows."""
    def line(array, value):
        return (f"aggregate({array}, named_struct('p', {zero}, 'o', cast(array() as array<bigint>)), (a, x) -> "
                f"named_struct('p', {op('a.p', value)}, 'o', concat(a.o, array(a.p))))")
    parts = (f"transform(sequence(0, greatest(size(vs) - 1, 0) div {PART}), b -> {line(f'slice(vs, b * {PART} + 1, {PART})', 'x')})")
    return _let(values, "vs", _let(parts, "ps", f"flatten(zip_with(ps, {line('ps', 'x.p')}.o, (w, f) -> transform(w.o, v -> {op('f', 'v')})))"))


def _spans(kind: str) -> str:
    g, m = f"g_{kind}", f"m_{kind}"
    index = f"slice(sequence(1, size({g})), 1, size({g}) - 1)"
    before = _scan(f"transform({index}, i -> cast(length(element_at({g}, i)) + length(element_at({m}, i)) as bigint))",
                   "0L", lambda p, q: f"{p} + {q}")
    return f"""filter(zip_with({index}, {before}, (i, p) -> named_struct('kind', '{kind}',
      's', p + length(element_at({g}, i)), 'e', p + length(element_at({g}, i)) + length(element_at({m}, i)),
      'm', element_at({m}, i), 'l', right(element_at({g}, i), {CONTEXT}), 'r', left(element_at({g}, i + 1), 1))),
      x -> x.m <> '')"""


def _clear_of_base() -> str:
    """SQL: the added spans that overlap no base span. All spans stand in order
    of start; an added one overlaps a base span if one before it ends, or one
    after it starts, inside."""
    far = "9223372036854775807L"
    flat = ("array_sort(concat(transform(base, x -> struct(x.s as s, 0 as added, x.e as e, x as x)), "
            "transform(added, x -> struct(x.s as s, 1 as added, x.e as e, x as x))), "
            "(p, q) -> if(p.s <> q.s, if(p.s < q.s, -1, 1), if(p.added <> q.added, p.added - q.added, if(p.e < q.e, -1, if(p.e > q.e, 1, 0)))))")
    ends = _scan("transform(sp, y -> if(y.added = 0, y.e, 0L))", "0L", lambda p, q: f"greatest({p}, {q})")
    starts = _scan(f"transform(reverse(sp), y -> if(y.added = 0, y.s, {far}))", far, lambda p, q: f"least({p}, {q})")
    kept = (f"transform(filter(zip_with(zip_with(sp, {ends}, (y, n) -> struct(y as y, n as n)), reverse({starts}), "
            "(z, k) -> struct(z.y.x as x, z.y.added = 1 and z.n <= z.y.s and k >= z.y.e as ok)), w -> w.ok), w -> w.x)")
    in_order = "array_sort(kp, (p, q) -> if(p.kind <> q.kind, if(p.kind < q.kind, -1, 1), if(p.s < q.s, -1, if(p.s > q.s, 1, 0))))"
    return f"if(size(base) = 0 or size(added) = 0, added, {_let(flat, 'sp', _let(kept, 'kp', in_order))})"


def luhn(d: str) -> str:
    """SQL: whether the digit string passes Luhn."""
    digit = f"cast(substring({d}, i, 1) as int)"
    return (f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + if((length({d}) - i) % 2 = 0, {digit}, "
            f"element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), {digit} + 1))) % 10 = 0")


CHECKS = {
    "email": "true",
    "ip": r"forall(split(x.m, '[.]'), o -> length(regexp_replace(o, '^0+', '')) <= 3 "
          r"and coalesce(try_cast(regexp_replace(o, '^0+', '') as int), 0) <= 255)",
    "card": "if(length(x.m) <= 37 and length(regexp_replace(x.m, '[ -]', '')) between 13 and 19, "
            + luhn("regexp_replace(x.m, '[ -]', '')") + ", false)",
    "phone": "length(regexp_replace(x.m, '[^0-9]', '')) between 9 and 15",
    "phone_local": "true",
    "secret": "true",
}


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added (arrays of spans with context) of every row."""
    d = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("t"))
    d = d.withColumn("digits", F.col("t").rlike("[0-9]"))
    kinds = [*KINDS, *ADDED]
    d = d.selectExpr("doc_id", *[e for k in kinds for e in _found(k, "t")])
    d = d.selectExpr("doc_id", *[f"{_spans(k)} as c_{k}" for k in kinds])
    d = d.selectExpr("doc_id", *[f"filter(c_{k}, x -> {CHECKS[k]}) as c_{k}" for k in kinds])
    d = d.selectExpr("doc_id", f"concat({', '.join('c_' + k for k in KINDS)}) as base",
                     f"concat({', '.join('c_' + k for k in ADDED)}) as added")
    return d.withColumn("added", F.expr(_clear_of_base()))


def _case(branches: list[tuple[str, str]], other: str) -> str:
    return "case " + " ".join(f"when {c} then {v}" for c, v in branches) + f" else {other} end"


def votes(x: str = "x") -> list[str]:
    """SQL of the five labelers' votes on span ``x``."""
    m, left, right = f"{x}.m", f"{x}.l", f"{x}.r"
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    strict = _case([
        (f"{x}.kind = 'email'", f"if({m} rlike '^[A-Za-z0-9][A-Za-z0-9._%+-]*@([A-Za-z0-9-]+[.])+[A-Za-z]{{2,}}$', 1, -1)"),
        (f"{x}.kind = 'ip'", f"if({m} rlike '^(0|[1-9][0-9]*)([.](0|[1-9][0-9]*)){{3}}$', 1, -1)"),
        (f"{x}.kind = 'card'", f"if({m} rlike '^[0-9]{{13,19}}$|^([0-9]{{4}}[ -]){{3}}[0-9]{{4}}$', 1, -1)"),
        (f"{x}.kind = 'phone'", f"if({m} rlike '^[+][0-9]{{1,3}}[ .-]?[(]?[0-9]{{2,4}}[)]?([ .-]?[0-9]{{2,4}}){{2,4}}$', 1, -1)"),
        (f"{x}.kind = 'phone_local'", f"if({m} rlike '^[(]?[2-9][0-9]{{2}}[)]?[ .-]+[2-9]', 1, -1)"),
    ], f"if({m} rlike '^([0-9a-f]{{32}}|[0-9a-f]{{40}}|[0-9a-f]{{64}}|AKIA[0-9A-Z]{{16}})$', 1, -1)")
    tops, heads = "|".join(TOP_DOMAINS), "|".join(SECRET_PREFIXES)
    gazetteer = _case([
        (f"{x}.kind = 'email'", f"if({m} rlike '[.]({tops})$', 1, 0)"),
        (f"{x}.kind = 'ip'", f"if({m} rlike '^(0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])[.]', -1, 1)"),
        (f"{x}.kind = 'card'", f"if({digits} rlike '^(4|5[1-5]|2[2-7]|3[47]|6011|65)', 1, 0)"),
        (f"{x}.kind in ('phone', 'phone_local')", f"if({m} rlike '[(][2-9][0-9]{{2}}[)]', 1, 0)"),
    ], f"if({m} rlike '^({heads})', 1, 0)")
    context = _case([(f"lower({left}) rlike '({AGAINST})[^a-z]*$'", "-1")]
                    + [(f"{x}.kind = '{k}' and lower({left}) rlike '({w})[^a-z]{{0,8}}$'", "1") for k, w in WORDS.items()], "0")
    edges = (f"if({left} = '' or {left} rlike '[^A-Za-z0-9]$', if({right} = '' or {right} rlike '[^A-Za-z0-9]', 1, -1), -1)")
    shape = _case([
        (f"{x}.kind = 'secret'", f"if(length({digits}) * 10 between length({m}) * 2 and length({m}) * 9, 1, -1)"),
        (f"{x}.kind = 'card'", f"if(length({digits}) in (15, 16), 1, 0)"),
        (f"{x}.kind in ('phone', 'phone_local')", f"if(length({digits}) between 10 and 12, 1, 0)"),
        (f"{x}.kind = 'ip'", f"if(length({m}) >= 9, 1, 0)"),
    ], f"if(length({m}) <= 64, 1, -1)")
    return [strict, gazetteer, context, edges, shape]


def features(x: str = "x") -> list[str]:
    """SQL of the classifier's surface features, small integers."""
    m = f"{x}.m"
    return [
        f"least(8, cast(length({m}) / 8 as int))",
        f"cast(length(regexp_replace({m}, '[^0-9]', '')) * 4 / length({m}) as int)",
        f"if({x}.l = '', 0, if({x}.l rlike '[ \\n]$', 1, if({x}.l rlike '[\"=:]$', 2, 3)))",
        f"if({x}.r = '', 0, if({x}.r rlike '[ \\n]', 1, if({x}.r rlike '[\".,;]', 2, 3)))",
        f"if({m} rlike '[a-z]', if({m} rlike '[A-Z]', 2, 1), 0)",
    ]


def fit_em(patterns: list[tuple], rounds: int = 30):
    """{kind: (prior, [{vote: (p for, p against)} by labeler])} and the
    posterior of every pattern, from (kind, votes, count) rows. The two classes
    share no labels but the start, where a vote is held right more often."""
    by = defaultdict(list)
    for kind, vote, n in patterns:
        by[kind].append((tuple(vote), n))
    out, post = {}, {}
    for kind, rows in by.items():
        k = len(rows[0][0])
        prior = 0.5
        rel = [{1: (0.6, 0.2), 0: (0.3, 0.3), -1: (0.1, 0.5)} for _ in range(k)]
        total = sum(n for _, n in rows)
        for _ in range(rounds):
            share = {}
            for vote, _n in rows:
                a = math.log(prior) + sum(math.log(rel[j][v][0]) for j, v in enumerate(vote))
                b = math.log(1 - prior) + sum(math.log(rel[j][v][1]) for j, v in enumerate(vote))
                share[vote] = 1 / (1 + math.exp(min(700.0, b - a)))
            pos = sum(share[v] * n for v, n in rows)
            prior = (pos + 1) / (total + 2)
            new = []
            for j in range(k):
                table = {}
                for v in (1, 0, -1):
                    p = sum(share[vote] * n for vote, n in rows if vote[j] == v)
                    q = sum((1 - share[vote]) * n for vote, n in rows if vote[j] == v)
                    # prior counts keep the meaning of a vote when a kind has few spans
                    table[v] = ((p + {1: 6, 0: 3, -1: 1}[v]) / (pos + 10),
                                (q + {1: 2, 0: 3, -1: 5}[v]) / (total - pos + 10))
                new.append(table)
            rel = new
        out[kind] = (prior, rel)
        post.update({(kind, vote): share[vote] for vote, _ in rows})
    return out, post


def train(cands: DataFrame):
    """Log odds of the span classifier: {kind: (bias, [{value: weight}])} over
    the votes and the surface features."""
    spans = cands.select(F.explode(F.concat("base", "added")).alias("x"))
    cols = [*votes(), *features()]
    names = [f"f{i}" for i in range(len(cols))]
    coded = spans.selectExpr("x.kind as kind", *[f"cast({c} as int) as {n}" for c, n in zip(cols, names)])
    rows = coded.groupBy("kind", *names).agg(F.count(F.lit(1)).alias("n")).collect()
    k = len(votes())
    patterns = defaultdict(int)
    for r in rows:
        patterns[(r["kind"], tuple(r[n] for n in names[:k]))] += r["n"]
    _, post = fit_em([(kind, vote, n) for (kind, vote), n in sorted(patterns.items())])
    mass = defaultdict(lambda: [1.0, 1.0])
    part = defaultdict(lambda: [0.5, 0.5])
    for r in rows:
        p = post[(r["kind"], tuple(r[n] for n in names[:k]))]
        for y, w in ((0, p * r["n"]), (1, (1 - p) * r["n"])):
            mass[r["kind"]][y] += w
            for j, n in enumerate(names):
                part[(r["kind"], j, r[n])][y] += w
    model = {}
    for kind, (a, b) in mass.items():
        weights = [{} for _ in names]
        for (kd, j, v), (p, q) in part.items():
            if kd == kind:
                weights[j][v] = math.log(p / a) - math.log(q / b)
        model[kind] = (math.log(a) - math.log(b), weights)
    return model


def log_odds(model, x: str = "x") -> str:
    """SQL of the classifier's log odds on span ``x``."""
    cols = [*votes(x), *features(x)]
    branches = []
    for kind in sorted(model):
        bias, weights = model[kind]
        if kind not in ADDED:
            continue
        terms = [f"{bias!r}D"]
        for c, table in zip(cols, weights):
            whens = " ".join(f"when {v} then {w!r}D" for v, w in sorted(table.items()))
            terms.append(f"(case cast({c} as int) {whens} else 0D end)")
        branches.append((f"{x}.kind = '{kind}'", " + ".join(terms)))
    return _case(branches, "-1D") if branches else "-1D"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added: arrays of accepted spans (kind, s, e)."""
    cands = store(candidates(docs, id_col, text_col), "pii-spans")
    odds = log_odds(train(cands))
    flat = "transform({c}, x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e))"
    return cands.selectExpr("doc_id", flat.format(c="base") + " as base",
                            flat.format(c=f"filter(added, x -> {odds} >= 0D)") + " as added")


def digest(spans: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, base_sha256 and spans."""
    text = "array_join(transform({c}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"
    return spans.selectExpr(
        "doc_id", *[f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint) as n_{k}" for k in KINDS],
        f"sha2({text.format(c='base')}, 256) as base_sha256",
        f"{text.format(c='concat(base, added)')} as spans")
