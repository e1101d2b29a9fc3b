"""Personal data by weak supervision, with DataFrame functions only.

Candidates are the base matches and wider ones (other long numbers, masked
e-mail addresses). Three labelers vote on every candidate or abstain: the
format (regex), lists of known beginnings and endings (gazetteer), and words
before the candidate (context). Expectation-maximisation over the counts of
vote patterns estimates how reliable each labeler is; the resulting posteriors
are the soft labels on which a logistic span classifier is trained. Base
matches always stay; wider candidates are added where the classifier says so.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxcohort.llm.common import kept
from rxcohort.llm.spans import by_start, clear_of, count_of, listed, with_matches

KINDS = ["email", "ip", "card", "phone"]
WIDE = ["masked_email", "number"]

# Possessive forms of the base patterns; runs are entered at their start, or
# where the last match of the kind ended (\G).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "masked_email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
    "number": r"(?<![0-9+.])(?<![0-9+][\x20().-])[0-9](?:[\x20.-]?[0-9]){8,18}+(?![\x20.-]?[0-9])",
}
HINTS = {"email": "@", "phone": "+", "masked_email": "at"}

# Issuer beginnings, calling codes, and endings of domain names.
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|35|6011|65)"
CALLING = r"^\+(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ENDINGS = r"(?i)\.(com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at|be|us|ca)$"

# Words before a value that speak for or against personal data.
CUES = r"(?i)(mail|contact|write|reach|tel|phone|call|mobile|fax|card|visa|account|iban|ssn|ip|addr|host|from)[^\p{L}]*$"
AGAINST = r"(?i)(version|isbn|issn|doi|serial|build|ref|page|v|no\.|nr\.|#|=)\s*$"

FEATURES = ["separated", "cue", "against", "listed", "long", "glued", "zeros"]
VOTES = ["by_format", "by_list", "by_context"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(turned, i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _is_card(value: Column) -> Column:
    digits = _digits(value)
    return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))


def _valid(kind: str, s: Column) -> Column:
    value = s["value"]
    if kind == "ip":
        part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return _is_card(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "number":
        return ~_is_card(value)
    return F.lit(True)


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_base`` and ``_wide``: the base spans, and wider candidates clear of them."""
    found = with_matches(docs, text, PATTERNS, HINTS)
    checked = found.withColumns({f"_{k}": F.filter(f"_{k}", partial(_valid, k)) for k in PATTERNS})
    joined = checked.withColumns(
        {"_base": F.concat(*[f"_{k}" for k in KINDS]), "_others": F.concat(*[f"_{k}" for k in WIDE])}
    ).drop(*[f"_{k}" for k in PATTERNS])
    return joined.withColumn("_wide", clear_of(F.col("_others"), F.col("_base"))).drop("_others")


def signals(s: Column) -> Column:
    """What labelers and classifier see of a candidate: its kind, votes and 0/1 features."""
    kind, value, before = s["kind"], s["value"], s["before"]
    digits = _digits(value)
    cue, against = before.rlike(CUES), before.rlike(AGAINST)
    issuer = digits.rlike(ISSUERS) & F.length(digits).isin(15, 16)
    numeric = kind.isin("card", "number")
    known = (
        F.when(numeric, issuer)
        .when(kind == "phone", value.rlike(CALLING))
        .when(kind == "ip", ~value.rlike(r"^0*(0|22[4-9]|2[34][0-9]|25[0-5])\."))
        .otherwise(value.rlike(ENDINGS))
    )
    separated = value.rlike(r"[0-9][\x20.()-]+[0-9]")
    wrong = (kind == "number") & F.length(digits).between(13, 19)
    flag = lambda c: c.cast("int")
    return F.struct(
        kind.alias("kind"),
        F.when(wrong, -1).when(kind.isin("email", "ip", "card", "phone", "masked_email"), 1).when(separated, 1).otherwise(0).alias(
            "by_format"
        ),
        F.when(known, 1).when(kind.isin("email", "masked_email", "ip"), -1).otherwise(0).alias("by_list"),
        F.when(cue, 1).when(against, -1).otherwise(0).alias("by_context"),
        flag(separated).alias("separated"),
        flag(cue).alias("cue"),
        flag(against).alias("against"),
        flag(known).alias("listed"),
        flag(F.length(digits) >= 13).alias("long"),
        flag(before.rlike(r"[\p{L}\p{N}_/]$")).alias("glued"),
        flag(digits.rlike("0000")).alias("zeros"),
    )


@dataclass(frozen=True)
class SpanModel:
    """Reliability of each labeler, and the span classifier's weights."""

    reliability: dict[str, float]
    prior: float
    weights: dict[str, float]
    bias: float

    def score(self, signal: Column) -> Column:
        z = F.lit(self.bias)
        for name in FEATURES:
            z = z + F.lit(self.weights[name]) * signal[name]
        for kind in [*KINDS, *WIDE]:
            z = z + F.when(signal["kind"] == kind, self.weights[kind]).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def estimate(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 100) -> tuple[list[float], float]:
    """Expectation-maximisation: the reliability of each labeler, and the share of true candidates.

    ``patterns`` are votes (1, -1, 0 to abstain) with their counts. A
    labeler is right with its reliability whenever it votes. Weak priors keep
    estimates off 0 and 1 and make every labeler start better than chance.
    """
    count = len(patterns[0][0]) if patterns else 0
    right, share = [0.8] * count, 0.5
    for _ in range(rounds):
        agree, voted, true, total = [4.0] * count, [5.0] * count, 1.0, 2.0
        for votes, n in patterns:
            p = posterior(votes, right, share)
            true, total = true + p * n, total + n
            for j, v in enumerate(votes):
                if v:
                    voted[j] += n
                    agree[j] += n * (p if v > 0 else 1 - p)
        right = [min(max(a / v, 0.05), 0.99) for a, v in zip(agree, voted)]
        share = true / total
    return right, share


def posterior(votes: tuple[int, ...], right: list[float], share: float) -> float:
    """Probability that a candidate with these votes is true."""
    z = math.log(share / (1 - share))
    for v, r in zip(votes, right):
        z += v * math.log(r / (1 - r))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def fit_logistic(rows: list[tuple[list[int], float, float]], steps: int = 400, ridge: float = 1e-2) -> list[float]:
    """Gradient steps of a logistic fit to (features, probability, count); the last weight is the bias.

    A few hundred distinct rows at most, so this is a small loop on the driver.
    """
    size = len(rows[0][0]) + 1 if rows else 1
    w, total = [0.0] * size, sum(n for _, _, n in rows) or 1.0
    for _ in range(steps):
        slope = [ridge * x for x in w[:-1]] + [0.0]
        for x, p, n in rows:
            z = w[-1] + sum(a for a, on in zip(w, x) if on)
            miss = (1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) - p) * n / total
            for j, on in enumerate(x):
                if on:
                    slope[j] += miss
            slope[-1] += miss
        w = [a - 2.0 * b for a, b in zip(w, slope)]
    return w


def fit(candidates: DataFrame) -> SpanModel:
    """Train on all candidates of ``candidates`` (as of ``with_candidates``).

    The corpus is read through counts of distinct signals, a few hundred rows
    whatever its size. Without candidates the model adds nothing.
    """
    each = candidates.select(F.explode(F.concat("_base", "_wide")).alias("s")).select(signals(F.col("s")).alias("g"))
    counted = each.groupBy("g").count().collect()
    by_votes: dict[tuple, float] = {}
    for row in counted:
        votes = tuple(row.g[v] for v in VOTES)
        by_votes[votes] = by_votes.get(votes, 0.0) + row["count"]
    right, share = estimate(sorted(by_votes.items()))
    kinds = [*KINDS, *WIDE]
    rows = [
        (
            [int(r.g[f]) for f in FEATURES] + [int(r.g["kind"] == k) for k in kinds],
            posterior(tuple(r.g[v] for v in VOTES), right, share),
            float(r["count"]),
        )
        for r in sorted(counted, key=lambda r: tuple(map(str, r.g)))
    ]
    weights = fit_logistic(rows) if rows else [0.0] * (len(FEATURES) + len(kinds)) + [-1.0]
    return SpanModel(dict(zip(VOTES, right)), share, dict(zip([*FEATURES, *kinds], weights)), weights[-1])


def with_spans(candidates: DataFrame, model: SpanModel) -> DataFrame:
    """``candidates`` with ``_added``: the wider candidates that the classifier accepts."""
    return candidates.withColumn("_added", F.filter("_wide", lambda s: model.score(signals(s)) >= 0.5)).drop("_wide")


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Rows with null ids, repeated rows and empty tables are treated like any
    others; a null text is empty and has no spans; other columns are not
    looked at. spans lists the base spans by kind and start, then added ones.
    """
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    table = kept(with_candidates(chosen).drop("text"), "candidates")
    out = with_spans(table, fit(table))
    return out.select(
        "doc_id",
        *[count_of("_base", k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat("_base", "_added")).alias("spans"),
        F.size("_added").cast("long").alias("n_added"),
    )


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by the kind in angle brackets.

    Overlapping spans are replaced together, under the kind that starts first;
    of several that start together the first in the order of kinds. A null text
    stays null, an empty one empty; long texts are replaced whole. Repeated
    rows and rows without an id are rows like others, an empty table stays
    empty. Patterns are matched in the pass that trains the classifier and in
    the one that replaces, so no text is written in between. Other columns
    pass through, whatever their names.
    """
    names = docs.columns
    own = [f"c{i}" for i in range(len(names))]
    body = own[names.index(text)]
    numbered = docs.select(*[F.col(f"`{name}`").alias(c) for name, c in zip(names, own)])
    table = with_candidates(numbered, body)
    found = with_spans(table, fit(table))
    ordered = by_start(F.concat("_base", "_added"), [*KINDS, *WIDE])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.col(body)

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(whole, state["at"] + 1, F.greatest(F.lit(0), s["start"] - state["at"]))
        fresh = F.concat(state["out"], F.array(gap, F.concat(F.lit("<"), s["kind"], F.lit(">"))))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(s["start"] >= state["at"], fresh).otherwise(state["out"]).alias("out"),
        )

    def close(state: Column) -> Column:
        rest = F.substring(whole, state["at"] + 1, F.length(whole))
        return F.concat(F.array_join(state["out"], ""), rest)

    replaced = F.aggregate("_ordered", start, step, close)
    done = found.withColumn("_ordered", ordered).withColumn(body, F.when(F.size("_ordered") > 0, replaced).otherwise(whole))
    return done.select(*[F.col(c).alias(name) for name, c in zip(names, own)])
