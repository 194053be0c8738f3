"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, and a
logistic classifier trained on the weighed votes decides. Spans of the four base kinds that pass their checks always stay.

All text work is Spark expressions. What reaches the driver is one row per pattern of votes, whose number is bounded by
the labelers (3 ** 5 per kind), never by the data.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.session import materialise

# The patterns of the base kinds. In the comments: the pattern as specified. In the code: the same matches
# without repeated work on long runs. A run's first character is where its leftmost match starts, or else the place where
# the match before ended (\G); nothing that follows a possessive part could be matched by giving back characters.
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts at most 255
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+, 14 to 19 digits, Luhn
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9], 10 to 15 digits
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds that only the method finds: key-like tokens, addresses written out, numbers without a country code, identity numbers.
EXTRA = {
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+",
    "spelled_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[\[({](?:at|AT)[\])}] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[({](?:dot|DOT)[\])}]) ?[A-Za-z0-9-]++)++",
    "local_phone": r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "identity": r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7})(?![0-9A-Za-z-])",
}
#: A cheap test that a text can hold the kind at all.
HINT = {
    "email": "instr(text, '@') > 0",
    "ip": r"text RLIKE '[0-9]\\.[0-9]'",
    "card": r"text RLIKE '[0-9][ -]?[0-9]'",
    "phone": r"text RLIKE '[+][0-9]'",
    "secret": r"text RLIKE '[A-Za-z_-][0-9]|[0-9][A-Za-z_-]'",
    "spelled_email": r"text RLIKE '[\\[({](at|AT)[\\])}]'",
    "local_phone": r"text RLIKE '[0-9][.-][0-9]'",
    "identity": r"text RLIKE '[0-9]-[0-9]|[A-Z][0-9]'",
}
KINDS = [*BASE, *EXTRA]
# Gazetteers of the labelers.
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "ch", "at", "it", "nl", "pl")
CUES = {
    "email": "mail|e-mail|contact|correo|courriel|kontakt",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|mastercard|amex|karte|carte|tarjeta|account|konto",
    "phone": "phone|tel|call|fax|mobile|cell|t[ée]l[ée]phone|telefon|tel[ée]fono",
    "secret": "token|key|secret|password|passwd|api|auth|bearer|credential",
    "spelled_email": "mail|e-mail|contact|correo|courriel|kontakt",
    "local_phone": "phone|tel|call|fax|mobile|cell|telefon",
    "identity": "ssn|social|iban|passport|identity|tax|steuer",
}
AGAINST = "version|page|isbn|doi|figure|table|order|line|sha|commit|release|chapter"
CONTEXT = 32


def _bound(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(kind: str, pattern: str) -> Column:
    """Array of ``start, end, found, before, after`` of the pattern's matches in ``text``, in code points.

    The pieces between the matches and the matches themselves add up to the text, so their lengths give every place.
    """
    item = "array<struct<start:int,end:int,found:string,before:string,after:string>>"

    def placed(s: Column) -> Column:
        gaps = F.transform(s["found"], lambda m, i: F.struct(F.length(F.get(s["pieces"], i)).alias("gap"), m.alias("found"), F.right(F.get(s["pieces"], i), F.lit(CONTEXT)).alias("before"), F.left(F.get(s["pieces"], i + 1), F.lit(1)).alias("after")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(item).alias("out"))

        def add(acc: Column, g: Column) -> Column:
            start = acc["at"] + g["gap"]
            end = start + F.length(g["found"])
            one = F.struct(start.alias("start"), end.alias("end"), g["found"].alias("found"), g["before"].alias("before"), g["after"].alias("after"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one).cast(item)).alias("out"))

        return F.aggregate(gaps, zero, add, lambda acc: acc["out"])

    parts = F.struct(F.split("text", pattern, -1).alias("pieces"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(F.expr(HINT[kind]), _bound(parts, placed)).otherwise(F.array().cast(item))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit holds."""
    n = F.length(digits)
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return total + F.coalesce(doubled, F.lit(0))

    return F.aggregate(at, F.lit(0), add) % 10 == 0


def passes(kind: str, found: Column) -> Column:
    """The check of a base kind; true for the others, which have none."""
    n = F.length(_digits(found))
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$"))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(found))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def votes(kind: str, s: Column) -> Column:
    """The labelers' votes on a candidate, each -1, 0 or 1: pattern, gazetteer, context, shape, edges."""
    found, before, after = s["found"], F.lower(s["before"]), s["after"]
    n, text = F.length(_digits(found)), F.lower(found)
    pattern = F.when(passes(kind, found), F.lit(1 if kind in BASE else 0)).otherwise(F.lit(-1))
    if kind in ("email", "spelled_email"):
        gazetteer = F.when(F.regexp_extract(text, "([a-z0-9-]+)$", 1).isin(*TOP_LEVEL), 1).otherwise(0)
    else:
        gazetteer = F.when(before.rlike(f"(?:{CUES[kind]})[^a-z0-9]*$"), 1).otherwise(0)
    context = F.when(before.rlike(f"(?:^|[^a-z])(?:{CUES[kind]})"), 1).when(before.rlike(f"(?:^|[^a-z])(?:{AGAINST})[^a-z]*$"), -1).otherwise(0)
    if kind == "secret":  # keys mix digits and letters evenly; words with a number at the end do not
        letters = F.length(F.regexp_replace(found, "[^A-Za-z]", ""))
        shape = F.when((n >= 4) & (letters >= 2) & found.rlike("[0-9][A-Za-z]+[0-9]"), 1).otherwise(-1)
    elif kind in ("email", "spelled_email"):
        shape = F.when(F.length(found) <= 254, 1).otherwise(-1)
    else:
        shape = F.when(F.length(F.array_join(F.array_distinct(F.split(_digits(found), "")), "")) >= 4, 1).otherwise(-1)
    edges = F.when(F.right(before, F.lit(1)).rlike("[a-z0-9]") | after.rlike("[A-Za-z0-9]"), -1).otherwise(1)
    return F.array(*[v.cast("int") for v in (pattern, gazetteer, context, shape, edges)])


LABELERS = 5


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, spans``: every candidate of every kind, as an array in order of kind and place, with ``votes`` and ``sure``.

    ``docs`` needs ``doc_id`` and ``text``; a null text counts as empty. One row per row.
    """
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = whole.select("doc_id", *[matches(k, p).alias(k) for k, p in (BASE | EXTRA).items()])

    def judged(rank: int, kind: str) -> Column:
        def one(s: Column) -> Column:
            sure = passes(kind, s["found"]) if kind in BASE else F.lit(False)
            place = [s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")]
            return F.struct(*place, votes(kind, s).alias("votes"), sure.alias("sure"))

        return F.transform(kind, one)

    kinds = [judged(rank, kind) for rank, kind in enumerate(KINDS)]
    return found.select("doc_id", F.concat(*kinds).alias("spans"))


Pattern = tuple[str, tuple[int, ...]]


def reliabilities(counts: dict[Pattern, int], rounds: int = 60, prior: float = 0.5) -> dict[Pattern, float]:
    """Posterior that a candidate with these votes is personal data, by expectation-maximisation per kind.

    Each labeler has a distribution over its three votes for either class; the start trusts positive votes. Counts are
    smoothed by one, so a labeler that always says the same has no weight.
    """
    out: dict[Pattern, float] = {}
    for kind in {k for k, _ in counts}:
        own = {v: n for (k, v), n in counts.items() if k == kind}
        post = {v: 1 / (1 + exp(-1.0 * sum(v))) for v in own}
        share = prior
        for _ in range(rounds):
            total = sum(own.values())
            yes = sum(n * post[v] for v, n in own.items())
            share = (yes + 1) / (total + 2)
            tables = []
            for j in range(LABELERS):
                hit, miss = {-1: 1.0, 0: 1.0, 1: 1.0}, {-1: 1.0, 0: 1.0, 1: 1.0}
                for v, n in own.items():
                    hit[v[j]] += n * post[v]
                    miss[v[j]] += n * (1 - post[v])
                tables.append(({x: c / (yes + 3) for x, c in hit.items()}, {x: c / (total - yes + 3) for x, c in miss.items()}))
            for v in own:
                odds = log(share / (1 - share)) + sum(log(t[0][x] / t[1][x]) for t, x in zip(tables, v))
                post[v] = 1 / (1 + exp(-max(-30.0, min(30.0, odds))))
        out |= {(kind, v): p for v, p in post.items()}
    return out


def train(counts: dict[Pattern, int], posterior: dict[Pattern, float], rounds: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> dict[str, list[float]]:
    """Weights of the span classifier, ``intercept, labelers...`` per kind: logistic regression of the posteriors."""
    weights = {}
    for kind in KINDS:
        own = [((1.0, *map(float, v)), n, posterior[k, v]) for (k, v), n in counts.items() if k == kind]
        w = [-1.0] + [1.0] * LABELERS  # without candidates: what most labelers say
        total = sum(n for _, n, _ in own)
        for _ in range(rounds if own else 0):
            slope = [ridge * x for x in w]
            for x, n, p in own:
                miss = 1 / (1 + exp(-sum(a * b for a, b in zip(w, x)))) - p
                for j, a in enumerate(x):
                    slope[j] += n / total * miss * a
            w = [a - rate * b for a, b in zip(w, slope)]
        weights[kind] = w
    return weights


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, spans`` (array of ``start, rank, end, kind, probability, sure`` in order of place and kind).

    ``sure`` spans are base matches that pass their check. Others are kept where the classifier gives at least
    ``threshold`` and they overlap no sure span. Nulls count as empty texts; empty tables give empty ones; repeated rows
    and null ids are rows like any other; extra columns are ignored.
    """
    found = materialise(candidates(docs), "candidates")
    seen = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").agg(F.count(F.lit(1)).alias("n"))
    counts = {(r["kind"], tuple(r["votes"])): r["n"] for r in seen.collect()}  # at most 3 ** 5 rows per kind
    weights = train(counts, reliabilities(counts))

    def probability(s: Column) -> Column:
        by_kind = F.element_at(F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.array(*map(F.lit, w)))]), s["kind"])
        z = F.aggregate(F.transform(s["votes"], lambda v, j: v * F.get(by_kind, j + 1)), F.get(by_kind, F.lit(0)), lambda a, b: a + b)
        return 1 / (1 + F.exp(-z))

    scored = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), probability(s).alias("probability"), s["sure"].alias("sure")))

    def chosen(spans: Column) -> Column:
        sure = F.filter(spans, lambda s: s["sure"])
        more = F.filter(
            spans,
            lambda s: ~s["sure"] & (s["probability"] >= threshold) & ~F.exists(sure, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])),
        )
        return F.sort_array(F.concat(sure, more))

    return found.select("doc_id", _bound(scored, chosen).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``: counts and hash of the sure spans, and all spans."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    sure = F.filter("spans", lambda s: s["sure"])

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["sure"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")

    counts = [number(kind) for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(sure), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
