"""Personal data by weak supervision, with DataFrame functions only.

Candidates are the strict matches of four kinds (email, ip, card, phone) and
looser shapes of the same kinds. Three labelers vote on each: a regex labeler
(strict shape and checksum), a gazetteer labeler (known top-level domains, card
issuer prefixes, dialling plans, reserved networks) and a context labeler (cue
words before the candidate). Spark counts the votes and span features of the
whole corpus (the number of different rows is fixed by their values, not by
the data). Expectation-maximisation over the votes estimates, for each kind,
how reliable each labeler is per class; its posteriors are the targets of a
logistic span classifier per kind, which sees what a span looks like (length,
share of digits, parts, what stands before it), its gazetteer entry and its
context, but not the regex vote. Strict matches always stay; looser candidates
that overlap none of them are added where two labelers at least vote and the
classifier is sure.

Defined results: a null text counts as empty and has no spans; overlapping
strict matches of different kinds all stay; rows are independent but for the
model, so equal texts give equal spans; an empty table gives no rows. Columns
other than the two that are named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import checkpointed, id_and_text
from tracemill.llm.spans import all_matches, apart, joined, let, part, pieces, positions, replaced, tagged

KINDS = ("email", "ip", "card", "phone")
#: The least probability at which the classifier adds a span.
SURE = 0.9
ROUNDS = 30

# Each pattern matches from the left end of a run, or where the last match ended, which is where a
# leftmost search would start; possessive loops keep it linear in the text.
_RUN = r"(?:\G|(?<![{0}]))"
EMAIL = _RUN.format("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = _RUN.format("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
LOOSE_EMAIL = _RUN.format("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\(AT\)|\[AT\]) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,}+)++"
LOOSE_IP = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
LOOSE_PHONE = r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z.-])"

# fixed values: gazetteers and cue words
TLDS = "com|org|net|edu|gov|mil|int|info|biz|io|co|de|fr|es|uk|it|nl|eu|us|ca|au|ch|at|be|jp|cn|ru|br|mx|ar|se|no|dk|fi|pl|pt"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65|35)"
RESERVED = r"^(?:0+|127|25[0-5]|2[4-9][0-9])\."
CUES = {
    "email": "mail|contact|write|address|correo|kontakt|courriel",
    "ip": "host|server|client|login|address|connect|ip",
    "card": "card|visa|master|amex|credit|debit|pay|karte|carte|tarjeta",
    "phone": "tel|phone|mobile|cell|call|fax|handy|fon|móvil|llam|appel",
}
AGAINST = "version|isbn|issn|order|invoice|serial|sku|section|article|figure|part no"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int") * (F.lit(1) + (n - i) % 2)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i) - F.when(value(i) > 9, 9).otherwise(0)) % 10 == 0


def _octets(c: Column) -> Column:
    return c.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$")


def _strict_card(c: Column) -> Column:
    return let(_digits(c), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))


_STRICT = {"email": lambda c: F.lit(True), "ip": _octets, "card": _strict_card, "phone": lambda c: F.length(_digits(c)).between(10, 15)}


def _gazetteer(kind: str, c: Column) -> Column:
    known = {
        "email": F.lower(c).rlike(rf"(?:\.|dot[)\]]) ?(?:{TLDS})$"),
        "ip": ~c.rlike(RESERVED),
        "card": _digits(c).rlike(ISSUERS),
        "phone": c.startswith("+") & c.rlike(r"^\+[1-9]") | _digits(c).rlike(r"^(?:1?[2-9][0-9]{2}[2-9][0-9]{6}|0[1-9][0-9]{7,12})$"),
    }[kind]
    return F.when(known, 1).otherwise(-1)


def _context(kind: str, before: Column) -> Column:
    return F.when(before.rlike(AGAINST), -1).when(before.rlike(rf"(?:{CUES[kind]})[^a-z]{{0,6}}$|(?:^|[^a-z])(?:{CUES[kind]})[^a-z]"), 1).otherwise(0)


def _features(text: Column, before: Column) -> dict[str, Column]:
    """What a span looks like, each as one of a few small numbers."""
    step = lambda c, *limits: sum((F.when(c >= x, 1).otherwise(0) for x in limits), F.lit(0))
    share = F.length(_digits(text)) / F.length(text)
    edge = F.right(before, F.lit(1))
    return {
        "size": step(F.length(text), 10, 16, 24), "digits": step(share, 0.01, 0.5, 0.8), "parts": step(F.size(F.split(text, "[^A-Za-z0-9]+")), 2, 3, 4),
        "edge": F.when((edge == "") | edge.rlike(r"\s"), 0).when(edge.rlike("[A-Za-z0-9]"), 2).otherwise(1),
    }


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base (strict matches) and loose (other candidates, with the votes); both ordered by kind."""
    text = F.col("_text")
    out = id_and_text(docs, id_col, text_col).withColumn("_text", F.coalesce(text, F.lit("")))
    digit = text.rlike("[0-9]")
    shapes = {
        "email": (EMAIL, F.contains(text, F.lit("@"))),
        "ip": (IP, digit), "card": (CARD, digit),
        "phone": (PHONE, F.contains(text, F.lit("+"))),
        "loose_email": (LOOSE_EMAIL, F.contains(F.lower(text), F.lit("at)")) | F.contains(F.lower(text), F.lit("at]"))),
        "loose_ip": (LOOSE_IP, digit & F.contains(text, F.lit(":"))),
        "loose_phone": (LOOSE_PHONE, digit),
    }
    out = out.withColumns({f"m_{n}": all_matches(text, p, gate) for n, (p, gate) in shapes.items()})
    out = out.withColumns({f"s_{n}": positions(text, p, F.col(f"m_{n}")) for n, (p, _) in shapes.items()}).drop(*(f"m_{n}" for n in shapes))

    def only_strict(kind: str) -> Column:
        return F.filter(F.col(f"s_{kind}"), lambda s: _STRICT[kind](s["text"]))

    strict = {k: only_strict(k) for k in KINDS}
    # a card-like number without a valid check digit is a loose candidate too
    weak = {
        "email": F.col("s_loose_email"), "ip": F.col("s_loose_ip"), "phone": F.col("s_loose_phone"),
        "card": F.filter("s_card", lambda s: F.length(_digits(s["text"])).between(14, 19) & ~_strict_card(s["text"])),
    }
    out = out.withColumn("base", F.concat(*(tagged(strict[k], i, k) for i, k in enumerate(KINDS))))
    out = out.withColumn("other", F.concat(*(tagged(weak[k], i, k) for i, k in enumerate(KINDS))))
    out = out.withColumn("other", apart(F.col("other"), F.col("base")))

    def voted(spans: str, regex: Callable[[Column], Column]) -> Column:
        def one(s: Column, before: Column) -> Column:
            gaz, ctx = F.lit(0), F.lit(0)
            for k in KINDS:
                gaz = F.when(s["kind"] == k, _gazetteer(k, s["text"])).otherwise(gaz)
                ctx = F.when(s["kind"] == k, _context(k, before)).otherwise(ctx)
            own = {n: s[n] for n in ("start", "order", "end", "kind")} | {"regex": regex(s), "gazetteer": gaz, "context": ctx} | _features(s["text"], before)
            return F.struct(*(c.alias(n) for n, c in own.items()))

        before = lambda cut, s: F.lower(part(cut, F.greatest(s["start"] - 40, F.lit(0)), s["start"]))
        every = let(pieces(text), lambda cut: F.transform(spans, lambda s: let(before(cut, s), lambda b: one(s, b))))
        return F.when(F.size(spans) > 0, every).otherwise(F.array().cast(VOTED))

    return out.select(F.col("_id").alias(id_col), voted("base", lambda s: F.lit(1)).alias("base"), voted("other", lambda s: F.when(s["kind"] == "card", -1).otherwise(0)).alias("other"))


LABELERS = ("regex", "gazetteer", "context")
LOOKS = ("size", "digits", "parts", "edge")
SEEN = ("gazetteer", "context", *LOOKS)  # what the classifier sees
VOTED = f"array<struct<start:int,order:int,end:int,kind:string,{','.join(f'{n}:int' for n in (*LABELERS, *LOOKS))}>>"


@dataclass
class Votes:
    """A kind's prior and the reliabilities P(vote | class) of its labelers."""

    prior: float
    reliability: dict[tuple[str, int, int], float]

    def probability(self, votes: dict[str, int]) -> float:
        """That a candidate is personal data, given who voted how (0: no vote)."""
        yes, no = self.prior, 1 - self.prior
        for n, v in votes.items():
            if v:
                yes, no = yes * self.reliability[n, v, 1], no * self.reliability[n, v, 0]
        return yes / (yes + no)


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> Votes:
    """EM over counted vote patterns.

    The prior that a labeler is right seven times in ten is worth ten candidates, so the
    class names stay fixed and rare votes do not run off to 0 or 1.
    """
    pseudo = {(n, v, c): 7.0 if (v > 0) == bool(c) else 3.0 for n in LABELERS for v in (-1, 1) for c in (0, 1)}
    model = Votes(0.5, {k: x / 10 for k, x in pseudo.items()})
    size = sum(n for _, n in patterns)
    for _ in range(rounds):
        yes = {p: model.probability(dict(zip(LABELERS, p, strict=True))) for p, _ in patterns}
        own = dict(pseudo)
        for p, n in patterns:
            for name, v in zip(LABELERS, p, strict=True):
                if v:
                    own[name, v, 1] += n * yes[p]
                    own[name, v, 0] += n * (1 - yes[p])
        model = Votes((5 + sum(n * yes[p] for p, n in patterns)) / (10 + size), {(name, v, c): x / (own[name, -1, c] + own[name, 1, c]) for (name, v, c), x in own.items()})
    return model


@dataclass
class Classifier:
    """Logistic weights of a kind's span features."""

    bias: float
    weights: dict[tuple[str, int], float]

    def logit(self, seen: tuple[int, ...]) -> float:
        return self.bias + sum(self.weights.get(k, 0.0) for k in zip(SEEN, seen, strict=True))


def classifier(examples: list[tuple[tuple[int, ...], float, int]], rounds: int = 300) -> Classifier:
    """Logistic regression on (features, target probability, count), by gradient steps with a slight pull to zero."""
    merged: dict[tuple[int, ...], list[float]] = {}
    for seen, target, n in examples:
        held = merged.setdefault(seen, [0.0, 0.0])
        held[0] += n * target
        held[1] += n
    model = Classifier(0.0, {k: 0.0 for seen in merged for k in zip(SEEN, seen, strict=True)})
    size = sum(n for _, n in merged.values()) or 1.0
    for _ in range(rounds):
        slope_b, slope = 0.0, dict.fromkeys(model.weights, 0.0)
        for seen, (yes, n) in merged.items():
            error = (yes - n / (1 + math.exp(-max(-30.0, min(30.0, model.logit(seen)))))) / size
            slope_b += error
            for k in zip(SEEN, seen, strict=True):
                slope[k] += error
        model = Classifier(model.bias + slope_b, {k: w + slope[k] - 1e-4 * w for k, w in model.weights.items()})
    return model


def train(found: DataFrame) -> dict[str, Classifier]:
    """A classifier per kind, from all candidates: their votes give the targets, their features the examples."""
    every = found.select(F.explode(F.concat("base", "other")).alias("c"))
    names = ("kind", *LABELERS, *LOOKS)
    counted = every.groupBy(*(F.col(f"c.{n}").alias(n) for n in names)).count().collect()  # 4 x 27 x 192 rows at most
    out = {}
    for kind in KINDS:
        rows = sorted(r for r in counted if r["kind"] == kind)
        patterns: dict[tuple[int, ...], int] = {}
        for r in rows:
            votes = tuple(r[n] for n in LABELERS)
            patterns[votes] = patterns.get(votes, 0) + r["count"]
        model = fit(sorted(patterns.items()))
        out[kind] = classifier([(tuple(r[n] for n in SEEN), model.probability({n: r[n] for n in LABELERS}), r["count"]) for r in rows])
    return out


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sure: float = SURE) -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, all_spans (array)."""
    found = checkpointed(candidates(docs, id_col=id_col, text_col=text_col))
    models = train(found)

    def logit(s: Column) -> Column:
        out = F.lit(0.0)
        for kind, m in models.items():
            own = sum((F.when(s[n] == v, w).otherwise(0.0) for (n, v), w in sorted(m.weights.items())), F.lit(m.bias))
            out = F.when(s["kind"] == kind, own).otherwise(out)
        return out

    least = math.log(sure / (1 - sure))
    out = found.withColumn("added", F.filter("other", lambda s: (logit(s) >= least) & (sum((F.abs(s[n]) for n in LABELERS), F.lit(0)) >= 2)))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    whole = F.concat("base", "added")
    return out.select(
        id_col, *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(whole).alias("spans"),
        F.size("added").cast("bigint").alias("n_added"), F.transform(whole, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("all_spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    return replaced(text, spans, lambda s: F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
