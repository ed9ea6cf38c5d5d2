"""Personal data by weak supervision, with built-in functions only.

Candidates are the matches of four strict patterns and of some looser ones.  Regular-expression,
gazetteer and context labelers vote on each (1 personal, -1 not, 0 no opinion).  Votes are counted with
the traits of the candidates over the whole table, which leaves at most ``kinds * 3 ** labelers * 2 ** traits``
rows whatever its size; on these expectation-maximisation estimates how reliable each labeler is for each
kind, and the posteriors train a logistic span classifier on votes and on traits, of which the labelers see
nothing.  The classifier, written as a column expression, decides which loose candidates are added; strict
matches always stay.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .spans import apart, bound, digits, find_spans, joined, luhn, part, pieces, scanned

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("email_loose", "phone_loose", "iban", "national_id")
KINDS = BASE_KINDS + ADDED_KINDS
LABELERS = ("form", "structure", "gazetteer", "context")
#: Traits of a span's text, as SQL conditions on ``s.value``.
TRAITS = {
    "long": "length(s.value) > 16", "spaced": "rlike(s.value, '[ ()]')", "even": "rlike(s.value, '([0-9A-Za-z])\\\\1{3}')",
    "numeric": "2 * length(regexp_replace(s.value, '[^0-9]', '')) >= length(s.value)",
}
_SPAN = "struct<start:int,ord:int,end:int,kind:string,votes:array<int>,traits:array<int>>"

_BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "contains(text, '.')"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "length(text) >= 12"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains(text, '+')"),
}
_LOOSE = {
    "email_loose": (r"(?i)[A-Z0-9._%+-]{1,64}+ ?[\[(](?:at|@)[\])] ?[A-Z0-9-]++(?: ?(?:[\[(](?:dot|\.)[\])]|\.) ?[A-Z0-9-]++)++", "contains(text, '(') or contains(text, '[')"),
    "phone_loose": (r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])", "contains(text, '-') or contains(text, '.')"),
    "iban": (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", "length(text) >= 15"),
    "national_id": (r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "contains(text, '-')"),
}

#: The gazetteers.
TOP_DOMAINS = "com|org|net|edu|gov|int|info|biz|io|eu|de|fr|es|it|nl|be|ch|at|uk|ie|se|no|dk|fi|pl|pt|us|ca|mx|br|ar|au|nz|jp|cn|in|kr|ru|ua|za"
IBAN_LANDS = "AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM|TR"
NEAR = {
    "email": "mail|contact|write|reach|correo|courriel|kontakt", "ip": r"\bip\b|address|host|server|client|login", "card": "card|visa|master|amex|credit|debit|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|cell|fax|contact|telefon|appel|llam", "iban": "iban|account|konto|compte|cuenta|bank", "national_id": r"\bssn\b|social|security|tax|passport",
}
NOT_NEAR = r"version|release|order|invoice|isbn|issn|doi|article|figure|section|chapter|serial|part no|example"
_REACH = 40


def _context(kind: str) -> str:
    near = NEAR[kind.removesuffix("_loose")]
    before = part("cut", f"greatest(0, s.start - {_REACH})", f"least(s.start, {_REACH})")
    return f"case when rlike({before}, r'(?i){NOT_NEAR}') then -1 when rlike({before}, r'(?i){near}') then 1 else 0 end"


def _votes(kind: str) -> str:
    """SQL for the array of votes of all labelers on span ``s`` of the text in pieces ``cut``."""
    around = f"concat(if(s.start > 0, {part('cut', 's.start - 1', '1')}, ' '), {part('cut', 's.end', '1')})"
    form = f"if(rlike({around}, '[A-Za-z0-9_@]'), -1, 1)"
    n = f"length({digits('s.value')})"
    structure = {
        "email": "if(rlike(s.value, r'(?i)^[a-z0-9][^@]*+@[a-z0-9]') and rlike(s.value, r'(?i)\\.[a-z]{2,24}$'), 1, -1)",
        "ip": "if(rlike(s.value, r'^(0|127|255)\\.|\\b0[0-9]'), -1, 1)",
        "card": f"if(rlike({digits('s.value')}, '^([0-9])\\\\1+$'), -1, 1)",
        "phone": f"if({n} between 10 and 13, 1, 0)",
        "email_loose": "if(rlike(s.value, r'(?i)[a-z]{2,24}$'), 1, -1)",
        "phone_loose": "if(rlike(s.value, r'^\\(?[2-9]'), 1, -1)",
        "iban": _iban(),
        "national_id": "if(rlike(s.value, r'^(000|666|9)|-00-|-0000$'), -1, 1)",
    }[kind]
    gazetteer = {
        "email": f"if(rlike(s.value, r'(?i)\\.({TOP_DOMAINS})$'), 1, 0)",
        "ip": "if(rlike(s.value, r'^(10|192\\.168|172\\.(1[6-9]|2[0-9]|3[01]))\\.'), 0, 1)",
        "card": f"if(rlike({digits('s.value')}, '^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)'), 1, -1)",
        "phone": "if(rlike(s.value, r'^\\+(1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])'), 1, 0)",
        "email_loose": f"if(rlike(s.value, r'(?i)({TOP_DOMAINS})$'), 1, 0)",
        "phone_loose": "if(rlike(s.value, r'[2-9][0-9]{2}.[0-9]{4}$'), 1, -1)",
        "iban": f"if(rlike(s.value, '^({IBAN_LANDS})'), 1, -1)",
        "national_id": "if(rlike(s.value, '^(078-05-1120|219-09-9999|457-55-5462|123-45-6789)$'), -1, 0)",
    }[kind]
    return f"array({form}, {structure}, {gazetteer}, {_context(kind)})"


def _iban() -> str:
    """Letters as two digits, first four characters last, remainder 1 by 97."""
    bare = "replace(s.value, ' ', '')"
    turned = f"concat(substring({bare}, 5), substring({bare}, 1, 4))"
    value = "if(ascii(c) >= 65, ascii(c) - 55, cast(c as int))"
    return f"if(aggregate(split({turned}, ''), 0L, (a, c) -> (a * if(ascii(c) >= 65, 100, 10) + {value}) % 97) = 1, 1, -1)"


def with_spans(rows: DataFrame) -> DataFrame:
    """Adds ``base`` and ``loose`` spans of the non-null column ``text``, each ``(start, ord, end, kind, votes, traits)``."""
    own = rows.columns
    rows = rows.withColumn("has_digit", F.expr("rlike(text, '[0-9]')"))
    spans = {}
    for ord_, kind in enumerate(KINDS):
        pattern, gate = (_BASE | _LOOSE)[kind]
        spans[kind] = find_spans("text", pattern, kind, ord_, gate if "email" in kind else f"has_digit and ({gate})")
    rows = rows.withColumns(spans)
    rows = rows.withColumns({
        "ip": F.expr("filter(ip, s -> not exists(split(s.value, r'\\.'), p -> length(ltrim('0', p)) > 3 or cast(p as int) > 255))"),
        "card": F.expr(f"filter(card, s -> length({digits('s.value')}) between 12 and 19 and {luhn('s.value')})"),
        "phone": F.expr(f"filter(phone, s -> length({digits('s.value')}) between 9 and 15)"),
    })
    traits = "array(" + ", ".join(f"cast({t} as int)" for t in TRAITS.values()) + ")"
    voted = lambda kind: f"transform({kind}, s -> named_struct('start', s.start, 'ord', s.ord, 'end', s.end, 'kind', s.kind, 'votes', {_votes(kind)}, 'traits', {traits}))"
    judged = lambda kinds: F.expr(
        f"if({' + '.join(f'size({k})' for k in kinds)} = 0, cast(array() as array<{_SPAN}>), " + bound(pieces("text"), "cut", f"sort_array(concat({', '.join(map(voted, kinds))}))") + ")"
    )
    return rows.select(*own, *KINDS).select(*own, judged(BASE_KINDS).alias("base"), judged(ADDED_KINDS).alias("loose"))


def candidate_spans(docs: DataFrame) -> DataFrame:
    """``doc_id`` (long) with the ``base`` and ``loose`` spans of its text; null texts count as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return with_spans(rows).drop("text")


def estimate_reliability(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 40) -> dict[tuple[str, tuple[int, ...]], float]:
    """Posterior that a candidate of a kind with these votes is personal data.

    ``counts`` holds (kind, votes, number of candidates).  For each kind one coin and, for each labeler
    and truth, the shares of its three votes are estimated by expectation-maximisation, started from
    the majority vote and smoothed with one pseudo-count that trusts the labelers.
    """
    out: dict[tuple[str, tuple[int, ...]], float] = {}
    for kind in sorted({k for k, _, _ in counts}):
        own = [(v, n) for k, v, n in counts if k == kind]
        belief = [0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else 0.5 for v, _ in own]
        for _ in range(rounds):
            total = sum(n for _, n in own)
            prior = (sum(b * n for b, (_, n) in zip(belief, own)) + 1) / (total + 2)
            share = {}
            for j in range(len(LABELERS)):
                for truth in (1, 0):
                    weight = {x: 1.0 + 3.0 * (x == (1 if truth else -1)) for x in (-1, 0, 1)}
                    for b, (v, n) in zip(belief, own):
                        weight[v[j]] += n * (b if truth else 1 - b)
                    for x in weight:
                        share[j, truth, x] = weight[x] / sum(weight.values())
            belief = []
            for v, _ in own:
                odds = log(prior / (1 - prior)) + sum(log(share[j, 1, x] / share[j, 0, x]) for j, x in enumerate(v))
                belief.append(1 / (1 + exp(-max(-30.0, min(30.0, odds)))))
        out |= {(kind, v): b for (v, _), b in zip(own, belief)}
    return out


def _features(kind: str, votes: tuple[int, ...], traits: tuple[int, ...]) -> list[float]:
    return [1.0, *[float(kind == k) for k in KINDS], *[float(x > 0) for x in votes], *[float(x < 0) for x in votes], *map(float, traits)]


def train_span_classifier(counts: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], steps: int = 400, rate: float = 1.0) -> list[float]:
    """Logistic weights for :func:`_features`, fitted to the posteriors; ``counts`` holds (kind, votes, traits, number)."""
    by_votes: dict[tuple[str, tuple[int, ...]], int] = {}
    for k, v, _, n in counts:
        by_votes[k, v] = by_votes.get((k, v), 0) + n
    posterior = estimate_reliability([(*kv, n) for kv, n in sorted(by_votes.items())])
    rows = [(_features(k, v, t), posterior[k, v], log(1 + n)) for k, v, t, n in sorted(counts)]
    weights = [0.0] * len(_features(KINDS[0], (0,) * len(LABELERS), (0,) * len(TRAITS)))
    scale = sum(w for *_, w in rows) or 1.0
    for _ in range(steps if rows else 0):
        slope = [0.002 * w for w in weights]
        for x, target, weight in rows:
            miss = 1 / (1 + exp(-sum(a * b for a, b in zip(weights, x)))) - target
            for i, value in enumerate(x):
                slope[i] += weight * miss * value / scale
        weights = [w - rate * s for w, s in zip(weights, slope)]
    return weights


def _score(weights: list[float]) -> str:
    """SQL for the classifier's linear score of span ``s``."""
    tests = [f"s.kind = '{k}'" for k in KINDS] + [f"s.votes[{j}] > 0" for j in range(len(LABELERS))] + [f"s.votes[{j}] < 0" for j in range(len(LABELERS))]
    tests += [f"s.traits[{j}] = 1" for j in range(len(TRAITS))]
    return " + ".join([repr(weights[0]) + "D", *[f"if({t}, {w!r}D, 0D)" for t, w in zip(tests, weights[1:])]])


def _trained(found: DataFrame) -> list[float]:
    votes = found.select(F.explode(F.concat("base", "loose")).alias("s")).groupBy("s.kind", "s.votes", "s.traits").count().collect()
    return train_span_classifier([(r["kind"], tuple(r["votes"]), tuple(r["traits"]), r["count"]) for r in votes])


def _added(weights: list[float]) -> Column:
    """The loose spans that the classifier takes and that overlap no strict one."""
    return F.expr(f"filter({apart('loose', 'base', _SPAN)}, s -> {_score(weights)} > 0)")


def personal_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, base, added``: strict spans and added ones."""
    found = cut(candidate_spans(docs))
    return found.withColumn("added", _added(_trained(found))).select("doc_id", "base", "added")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added``.

    Base spans are the leftmost non-overlapping matches of each of four patterns (email, ip with parts
    of at most 255, card of 12 to 19 digits that pass the Luhn test, phone of 9 to 15 digits); they are
    counted and digested, and always part of ``spans``.  The method adds spans of other kinds.

    Null and empty texts have no spans (``spans`` is empty, ``base_sha256`` that of the empty string).
    Very long texts are searched whole; repeated rows and null doc_ids are each judged by their text;
    other columns are ignored.  Spans that start together are ordered by kind as listed.  An empty
    table gives no rows.
    """
    plain = lambda c: f"transform({c}, s -> named_struct('start', s.start, 'ord', s.ord, 'end', s.end, 'kind', s.kind))"
    return personal_spans(docs).select(
        "doc_id",
        *[F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.expr(joined("base")), 256).alias("base_sha256"),
        F.expr(joined(f"sort_array({plain('concat(base, added)')})")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def masked(text: str, spans: str) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; a span that starts inside an earlier one is merged into it."""
    reached = scanned("spans", "0", "int", "greatest(a.s, x.end)", "a.s")
    before = part("cut", "reached[i]", "(s.start - reached[i])")
    written = f"array_join(transform(spans, (s, i) -> if(s.start < reached[i], '', concat({before}, '<', s.kind, '>'))), '')"
    end = "array_max(transform(spans, s -> s.end))"
    whole = f"concat({written}, {part('cut', end, f'(length({text}) - {end})')})"
    return F.expr(bound(f"sort_array({spans})", "spans", bound(pieces(text), "cut", bound(reached, "reached", whole))))


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with every strict and added span of ``text`` replaced by its kind; ``n_chars``, if there, is set anew.

    The spans are those of :func:`find_personal_data`.  Texts without spans, null and empty ones stay as they are.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    added = _added(_trained(candidate_spans(docs)))
    rows = with_spans(rows).withColumn("spans", F.concat("base", added))
    rows = rows.withColumn("masked", F.when(F.size("spans") > 0, masked("text", "spans")).otherwise(F.col("row.text")))
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("masked")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.size("spans") > 0, F.length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return rows.select(*[v.alias(c) for c, v in out.items()])
