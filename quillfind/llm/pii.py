"""Personal data by weak supervision. DataFrame functions only on the executors.

Candidates are found by patterns: e-mail addresses, IP addresses, payment cards and phone numbers (the base kinds,
kept whatever the votes), and bank accounts (IBAN), social security numbers and secrets, which the method adds. On
each candidate a pattern labeler, a gazetteer labeler, a context labeler, a boundary labeler and a placeholder labeler
vote for, against or not at all. The votes of all candidates are counted by pattern (a table of bounded size, the
only thing the driver sees); expectation-maximisation on these counts estimates each labeler's reliability and every
pattern's posterior; a logistic span classifier is trained on the posteriors, from the votes and the span's shape, and
is applied to every candidate as a column expression.

Positions are in code points, end exclusive. They come from the lengths of the pieces between a pattern's leftmost
non-overlapping matches. Patterns use possessive repeats and anchored beginnings: linear time, no deep recursion, on
texts of any length.

Defined results: null and empty texts have no spans; every row gives one row, repeated rows too; an empty table gives
an empty table; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import session, stored

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
LABELERS = ("pattern", "gazetteer", "context", "boundary", "placeholder")
SHAPES = ("long", "separated", "capitals")
ROUNDS, THRESHOLD = 60, 0.5

_LOCAL = "[A-Za-z0-9._%+-]"
#: kind: (cheap test that a text must pass, pattern)
PATTERNS = {
    "email": ("@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[ -]?[0-9]){12}", r"[0-9](?:[ -]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    "iban": (r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "secret": (r"[A-Za-z0-9_-]{20}", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"),
}

# Words that stand near each kind of data.
CONTEXT = {
    "email": "mail email e-mail contact kontakt correo courriel write",
    "ip": "ip host server address adresse dirección client login",
    "card": "card visa mastercard amex credit debit karte carte tarjeta payment",
    "phone": "phone tel telephone telefon teléfono téléphone call mobile fax whatsapp",
    "iban": "iban account konto compte cuenta bank transfer",
    "ssn": "ssn social security",
    "secret": "token secret password passwd pwd key apikey api_key auth bearer credential",
}
# Country calling codes, and IBAN countries with lengths.
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 220 234 254 255 256 351 352 353 354 355 356 357 358 359 370 371 372 380 381 385 386 420 421 852 880 886 961 962 965 966 971 972 974"
IBAN_LENGTH = "AT20 BE16 CH21 CZ24 DE22 DK18 ES24 FI18 FR27 GB22 GR27 HU28 IE22 IT27 LU20 NL18 NO15 PL28 PT25 SE24"
TOP_DOMAINS = "com org net edu gov mil info biz io de fr es it nl uk us ca au at ch be se no dk fi pl pt ru cn jp in br mx eu"


def matches(text: str, hits: str) -> Column:
    """array<struct<s, e, v>> from the columns `text` (pieces between the matches) and `hits` (the matches)."""
    empty = "cast(array() as array<struct<s:int,e:int,v:string>>)"
    step = f"named_struct('pos', a.pos + length({text}[i - 1]) + length({hits}[i - 1]), 'out', concat(a.out, array(named_struct('s', a.pos + length({text}[i - 1]), 'e', a.pos + length({text}[i - 1]) + length({hits}[i - 1]), 'v', {hits}[i - 1]))))"
    return F.expr(f"case when size({hits}) = 0 then {empty} else aggregate(sequence(1, size({hits})), named_struct('pos', 0, 'out', {empty}), (a, i) -> {step}, a -> a.out) end")


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def luhn(v: str) -> str:
    """SQL: the digits of v pass the check-digit rule."""
    d = _digits(v)
    digit = f"cast(substring({d}, length({d}) - i + 1, 1) as int)"
    twice = f"(2 * {digit} - case when {digit} > 4 then 9 else 0 end)"
    return f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + case when i % 2 = 0 then {twice} else {digit} end) % 10 = 0"


def _valid() -> dict[str, str]:
    """SQL over a match x: the tests that base kinds and added kinds must pass to be candidates."""
    octet = "(length(ltrim('0', p)) <= 3 and cast(concat('0', right(ltrim('0', p), 3)) as int) <= 255)"
    letters = "aggregate(sequence(1, length(w)), 0, (a, i) -> case when substring(w, i, 1) between '0' and '9' then (a * 10 + cast(substring(w, i, 1) as int)) % 97 else (a * 100 + ascii(substring(w, i, 1)) - 55) % 97 end) = 1"
    moved = "concat(substring(replace(x.v, ' ', ''), 5), left(replace(x.v, ' ', ''), 4))"
    return {
        "email": "true",
        "ip": f"forall(split(x.v, '[.]'), p -> {octet})",
        "card": f"case when length({_digits('x.v')}) between 13 and 19 then {luhn('x.v')} else false end",
        "phone": f"length({_digits('x.v')}) between 9 and 15",
        "iban": f"exists(array({moved}), w -> {letters})",
        "ssn": "substring(x.v, 1, 3) not in ('000', '666') and substring(x.v, 1, 1) <> '9' and substring(x.v, 5, 2) <> '00' and substring(x.v, 8) <> '0000'",
        "secret": "x.v rlike '[0-9]' and x.v rlike '[A-Za-z]'",
    }


def _words(names: str) -> str:
    return "(?i)(?:" + "|".join(names.split()) + ")"


def _votes(kind: str) -> list[str]:
    """SQL over a match x with l, r (the text before and behind): votes 1, 0 or -1 in the order of LABELERS."""
    d = _digits("x.v")
    pattern = {
        "email": r"case when x.v rlike '^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9]' then 1 else -1 end",
        "ip": "case when x.v rlike '(^|[.])0[0-9]' then -1 else 1 end",
        "card": f"case when length({d}) in (15, 16) then 1 else 0 end",
        "phone": f"case when length({d}) between 10 and 13 then 1 else 0 end",
        "iban": "1", "ssn": "1",
        "secret": "case when x.v rlike '^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$' or x.v rlike '^[^A-Z]*+[A-Z][^0-9]*+[0-9][^a-z]*+[a-z]|^[^0-9]*+[0-9][^a-z]*+[a-z][^A-Z]*+[A-Z]' then 1 when x.v rlike '^[0-9-]+$' then -1 else 0 end",
    }
    gazetteer = {
        "email": f"case when lower(regexp_extract(x.v, '[.]([A-Za-z0-9-]+)$', 1)) in ({', '.join(repr(t) for t in TOP_DOMAINS.split())}) then 1 else -1 end",
        "ip": "case when x.v rlike '^(?:0|255|22[4-9]|2[34][0-9])[.]' then -1 else 1 end",
        "card": f"case when {d} rlike '^(?:4|5[1-5]|2[2-7]|3[47]|36|6011|65|35)' then 1 else -1 end",
        "phone": f"case when {d} rlike '^(?:{'|'.join(CALLING.split())})' then 1 else -1 end",
        "iban": f"case when concat(left(x.v, 2), length(replace(x.v, ' ', ''))) in ({', '.join(repr(t) for t in IBAN_LENGTH.split())}) then 1 else -1 end",
        "ssn": "0",
        "secret": "case when x.v rlike '^(?:gh[pousr]_|sk-|pk_|AKIA|xox[abp]-|AIza)' then 1 else 0 end",
    }
    repeated = f"{d} rlike '([0-9])\\\\1{{7}}' or {d} rlike '0123456|1234567|9876543'"
    placeholder = {
        "email": "case when x.v rlike '(?i)^(?:no-?reply|user|name|test|foo)@' then -1 else 0 end",
        "ip": "case when x.v rlike '^(?:127[.]|0[.]0[.]|255[.]255|1[.]2[.]3[.]4$)' then -1 else 0 end",
        "card": f"case when {repeated} then -1 else 0 end", "phone": f"case when {repeated} then -1 else 0 end",
        "iban": "0", "ssn": "case when x.v in ('123-45-6789', '078-05-1120') then -1 else 0 end",
        "secret": "case when x.v rlike '(?i)example|xxxx|your|placeholder' then -1 else 0 end",
    }
    context = f"case when l rlike '{_words(CONTEXT[kind])}' then 1 else 0 end"
    boundary = r"case when l rlike '[\\p{L}\\p{N}]$' or r rlike '^[\\p{L}\\p{N}]' then -1 else 1 end"
    return [pattern[kind], gazetteer[kind], context, boundary, placeholder[kind]]


def _shapes() -> list[str]:
    return ["case when length(x.v) >= 16 then 1 else 0 end", "case when x.v rlike '[ ()-]' then 1 else 0 end", "case when x.v rlike '[A-Z]' then 1 else 0 end"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, the kept columns and `found`: array<struct<kind, rank, s, e, f>>; f holds the votes and the shape."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *(keep or []), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("pii text"))
    valid, parts = _valid(), []
    for kind, (test, pattern) in PATTERNS.items():
        gated = F.when(F.col("pii text").contains(test) if test == "@" else F.col("pii text").rlike(test), F.col("pii text")).otherwise("")
        rows = rows.withColumn("pii gate", gated).withColumn(f"pii p {kind}", F.split("pii gate", pattern, -1)).withColumn(f"pii h {kind}", F.regexp_extract_all("pii gate", F.lit(pattern), F.lit(0))).drop("pii gate")
    for kind in PATTERNS:
        rows = rows.withColumn(f"pii m {kind}", matches(f"`pii p {kind}`", f"`pii h {kind}`")).drop(f"pii p {kind}", f"pii h {kind}")
        numbers = ", ".join(f"cast({v} as tinyint)" for v in _votes(kind) + _shapes())
        left, right = "substring(`pii text`, greatest(x.s - 40, 0) + 1, least(x.s, 40))", "substring(`pii text`, x.e + 1, 4)"
        made = f"named_struct('kind', '{kind}', 'rank', {KINDS.index(kind)}, 's', x.s, 'e', x.e, 'f', transform(array(array({left}, {right})), c -> array({numbers.replace('l rlike', 'c[0] rlike').replace('r rlike', 'c[1] rlike')}))[0])"
        made = made.replace("gc[0]", "gl").replace("gc[1]", "gr")
        parts.append(F.expr(f"transform(filter(`pii m {kind}`, x -> {valid[kind]}), x -> {made})"))
    return rows.select("doc_id", *(keep or []), F.concat(*parts).alias("found"))


def expectation_maximisation(counts: dict[tuple[int, ...], float], rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], list[dict[int, tuple[float, float]]], float]:
    """From vote patterns and their counts: each pattern's posterior of being true, each labeler's probabilities of a
    vote given true and false, and the prior. Labelers are taken as independent given the truth; one pseudo-count."""
    post = {v: 1 / (1 + math.exp(-1.5 * sum(v))) for v in counts}
    width = len(next(iter(counts), ()))
    rates: list[dict[int, tuple[float, float]]] = []
    prior = 0.5
    for _ in range(rounds if counts else 0):
        yes = sum(n * post[v] for v, n in counts.items())
        no = sum(counts.values()) - yes
        prior = (yes + 1) / (yes + no + 2)
        rates = []
        for j in range(width):
            got = {x: [1 / 3, 1 / 3] for x in (-1, 0, 1)}
            for v, n in counts.items():
                got[v[j]][0] += n * post[v]
                got[v[j]][1] += n * (1 - post[v])
            rates.append({x: (a / (yes + 1), b / (no + 1)) for x, (a, b) in got.items()})
        for v in counts:
            logit = math.log(prior / (1 - prior)) + sum(math.log(rates[j][x][0] / rates[j][x][1]) for j, x in enumerate(v))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))
    return post, rates, prior


def span_classifier(rows: list[tuple[tuple[int, ...], float, float]], steps: int = 300) -> list[float]:
    """Logistic regression (bias first) on feature rows with posteriors as soft labels and counts as weights."""
    width = len(rows[0][0]) + 1
    w, total = [0.0] * width, sum(n for _, _, n in rows)
    for _ in range(steps):
        g = [0.01 * x for x in w]
        for f, p, n in rows:
            x = (1, *f)
            e = n / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x)))))) - p)
            for j in range(width):
                g[j] += e * x[j]
        w = [a - 1.0 * b for a, b in zip(w, g)]
    return w


def train(found: DataFrame) -> dict[str, list[float]]:
    """Each kind's classifier weights (bias, votes, shape), learned from all candidates' vote patterns."""
    patterns = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.f").agg(F.count("*").alias("n")).collect()
    weights = {}
    for kind in KINDS:
        mine = sorted((tuple(r["f"]), r["n"]) for r in patterns if r["kind"] == kind)
        if not mine:
            continue
        counts: dict[tuple[int, ...], float] = {}
        for f, n in mine:
            counts[f[: len(LABELERS)]] = counts.get(f[: len(LABELERS)], 0) + n
        post, _, _ = expectation_maximisation(counts)
        weights[kind] = span_classifier([(f, post[f[: len(LABELERS)]], n) for f, n in mine])
    return weights


def accepted(weights: dict[str, list[float]]) -> Column:
    """`found` without the added candidates that the classifier rejects, or that lie in a base span."""
    width = 1 + len(LABELERS) + len(SHAPES)
    table = F.array(*[F.array(*[F.lit(float(x)) for x in weights.get(k, [0.0] * width)]) for k in KINDS])
    base = len(BASE_KINDS)

    def score(c: Column) -> Column:
        return F.aggregate(F.zip_with(table[c["rank"]], F.concat(F.array(F.lit(1).cast("tinyint")), c["f"]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    inside = lambda c: F.exists("found", lambda b: (b["rank"] < base) & (b["s"] < c["e"]) & (c["s"] < b["e"]))
    return F.filter("found", lambda c: (c["rank"] < base) | ((score(c) >= math.log(THRESHOLD / (1 - THRESHOLD))) & ~inside(c)))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, the kept columns and `spans`: array<struct<rank, s, e, kind>>, by kind as in KINDS, then start. Without
    kept columns the candidates are stored between the two uses; with them (texts, say) they are found twice, which
    costs less than storing what is kept."""
    session(docs)
    found = candidates(docs, id_col, text_col, keep)
    found = found if keep else stored(found, "pii")
    spans = F.array_sort(F.transform(accepted(train(found)), lambda c: F.struct(c["rank"].alias("rank"), c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"))))
    return found.select("doc_id", *(keep or []), spans.alias("spans"))


def digest(spans: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""
    line = lambda c: F.concat_ws(":", c["kind"], c["s"], c["e"])
    base = F.filter("spans", lambda c: c["rank"] < len(BASE_KINDS))
    of_kind = lambda k: F.size(F.filter("spans", lambda c: c["rank"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)]
    return spans.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"))


def redacted(text: str = "text", spans: str = "spans") -> Column:
    """The text with every span (overlapping ones as one) replaced by its kind in brackets."""
    ordered = f"array_sort({spans}, (a, b) -> case when a.s < b.s then -1 when a.s > b.s then 1 when a.e > b.e then -1 when a.e < b.e then 1 else 0 end)"
    step = f"case when c.s >= a.pos then named_struct('pos', c.e, 'out', concat(a.out, array(substring({text}, a.pos + 1, c.s - a.pos), concat('[', upper(c.kind), ']')))) else named_struct('pos', greatest(a.pos, c.e), 'out', a.out) end"
    return F.expr(f"case when size({spans}) > 0 then aggregate({ordered}, named_struct('pos', 0, 'out', cast(array() as array<string>)), (a, c) -> {step}, a -> concat(array_join(a.out, ''), substring({text}, a.pos + 1))) else {text} end")
