"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a classifier decides.

Base spans are found by fixed rules. Beside them stand candidates that only look like personal data:
written-out addresses, telephone numbers without a country, grouped id numbers, card-like numbers
that fail their check digit. On all spans four labelers vote for, against or not at all: the shape
of the match, its check digits, a gazetteer of prefixes and endings, and cue words before it.

Expectation maximisation takes the counts of the vote patterns, of which there are at most 81 a kind,
and gives every labeler's reliability and every pattern's probability. These probabilities
train the span classifier, a naive Bayes model over features of the span, from one more aggregate of
bounded size. Candidates that it accepts are added; base spans stay.

Everything on data is column expressions: matches and the text between them come from the same
pattern, so lengths add up to places. The text is read once; only spans are written and read again.

Defined cases: a missing text is an empty one; equal rows get equal rows; with no span at all
nothing is estimated and nothing added; an empty table gives none; only ``doc_id`` and ``text`` are
read. Places are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_rows

# The base kinds in their order, with patterns that match the same as
#   email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)        parts at most 255
#   card   [0-9]([\x20-]?[0-9])+                       13 to 19 digits that pass Luhn's check
#   phone  \+[0-9][\x20().0-9-]+[0-9]                  9 to 15 digits
# but start only where a run starts, so that long runs are read once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

# Shapes of candidates.
WIDE = {
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}\x20?[\[(](?:at|AT|@)[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(](?:dot|DOT|\.)[\])])\x20?[A-Za-z0-9-]{2,63}){1,4}",
    "local_phone": r"(?<![0-9+.-])(?<![0-9+]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\x20.-]?[0-9])",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}

# A candidate kind is judged with the base kind that it resembles; failed cards are "number".
FAMILY = {"email": "email", "address": "email", "ip": "ip", "card": "card", "number": "card", "phone": "phone", "local_phone": "phone", "id_number": "id"}
BASE = list(PATTERNS)
ADDED = ["address", "number", "local_phone", "id_number"]

CUES = {
    "email": "mail|contact|write|reach|address",
    "ip": r"\bip\b|host|server|login|address|from",
    "card": "card|visa|master|credit|debit|amex|pay",
    "phone": r"tel|phone|call|mobile|fax|dial|cell",
    "id": r"ssn|social|security|tax|passport|licen[cs]e|\bid\b",
}
COUNTER_CUES = r"version|isbn|issn|order|invoice|serial|part no|chapter|section|page"
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[\])])\x20?(com|org|net|edu|gov|io|info|de|fr|es|it|uk|nl|eu)$",
    "ip": r"^(?!0\.|127\.|255\.)",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^(1[2-9]|[2-9])",
    "id": r"^(?!000|666|9)",
}

_SPAN = "struct<kind:string,start:int,end:int,hit:string,before:string>"
_CUE_CHARS = 40


def _matches(text: Column, kind: str, pattern: str, guard: Column) -> Column:
    """Spans of all matches; ``guard`` says cheaply whether there can be any."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    none = F.array().cast(f"array<{_SPAN}>")

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        before = F.right(pair["gap"], F.lit(_CUE_CHARS))
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), pair["hit"].alias("hit"), before.alias("before"))
        return F.struct(end.alias("at"), F.when(pair["hit"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(span))).alias("found"))

    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda acc: acc["found"])
    return F.when(guard, walked).otherwise(none)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        parts = F.split(hit, r"\.")
        return F.forall(parts, lambda p: F.regexp_replace(p, "^0+", "").rlike("^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.call_function("luhn_check", _digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _is_valid(kind: str):
    return lambda span: _valid(kind, span["hit"])


def _is_kind(kind: str):
    return lambda span: span["kind"] == kind


def found_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, base, wide``: arrays of base spans and of other candidates."""
    rows = text_rows(docs)
    text = F.col("text")
    digit = text.rlike("[0-9]")
    guards = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+"))}
    rows = rows.select("doc_id", *(_matches(text, kind, pattern, guards[kind]).alias(kind) for kind, pattern in PATTERNS.items()), *(
        _matches(text, kind, pattern, text.rlike(r"[\[(](?:at|AT|@)[\])]") if kind == "address" else digit).alias(kind) for kind, pattern in WIDE.items()
    ))
    base = F.concat(*(F.filter(kind, _is_valid(kind)) for kind in BASE))
    failed = F.transform(F.filter("card", lambda s: ~_valid("card", s["hit"])), lambda s: s.withField("kind", F.lit("number")))
    rows = rows.select("doc_id", base.alias("base"), F.concat(failed, *WIDE).alias("wide"))
    apart = F.filter("wide", lambda w: ~F.exists("base", lambda b: (w["start"] < b["end"]) & (b["start"] < w["end"])))
    return rows.select("doc_id", "base", F.when(F.size("wide") > 0, apart).otherwise(F.col("wide")).alias("wide"))


def _by_family(span: Column, choose) -> Column:
    """``choose(family)`` of the span's family."""
    families = defaultdict(list)
    for kind, family in FAMILY.items():
        families[family].append(kind)
    out = F.lit(None)
    for family, kinds in families.items():
        out = F.when(span["kind"].isin(kinds), choose(family)).otherwise(out)
    return out


def _votes(span: Column) -> Column:
    """Four digits: 1 for, 0 against, 2 no vote."""
    digits, vote = _digits(span["hit"]), lambda yes: F.when(yes, "1").otherwise("0")
    shape = vote(span["kind"].isin(BASE))
    check = F.when(span["kind"].isin("card", "number"), vote(F.call_function("luhn_check", digits))).when(span["kind"].isin("phone", "local_phone"), vote(F.length(digits).between(9, 15))).otherwise("2")
    listed = _by_family(span, lambda f: vote((span["hit"] if f in ("email", "ip") else digits).rlike(GAZETTEER[f])))
    before = F.lower(span["before"])
    cue = F.when(before.rlike(COUNTER_CUES), "0").when(_by_family(span, lambda f: before.rlike(CUES[f])), "1").otherwise("2")
    return F.concat(shape, check, listed, cue)


def _features(span: Column) -> Column:
    """``name=value`` texts from a small fixed set of values."""
    digits = F.length(_digits(span["hit"]))
    separated = span["hit"].rlike(r"[0-9][\x20.()-]+[0-9]")
    parts = {
        "kind": span["kind"],
        "digits": F.least(digits, F.lit(20)).cast("string"),
        "length": F.least(F.floor(F.length(span["hit"]) / 8), F.lit(8)).cast("string"),
        "separated": separated.cast("string"),
        "votes": F.substring(_votes(span), 2, 3),
    }
    family = _by_family(span, F.lit)
    return F.array(*(F.concat(family, F.lit(f":{name}="), value) for name, value in parts.items()))


def estimate(patterns: dict[tuple[str, str], int], rounds: int = 50) -> dict[tuple[str, str], float]:
    """Probability of every ``(family, votes)``, by expectation maximisation over their counts."""
    out: dict[tuple[str, str], float] = {}
    for family in sorted({f for f, _ in patterns}):
        rows = sorted((votes, n) for (f, votes), n in patterns.items() if f == family)
        chance = {v: (1 + v.count("1")) / (2 + v.count("1") + v.count("0")) for v, _ in rows}
        for _ in range(rounds):
            share = sum(chance[v] * n for v, n in rows) + 1
            total = sum(n for _, n in rows) + 2
            # How often a labeler votes "for", given the truth; smoothed towards being better than chance.
            yes = {}
            for labeler in range(4):
                for truth in (1, 0):
                    weight = {v: chance[v] if truth else 1 - chance[v] for v, _ in rows}
                    voted = sum(weight[v] * n for v, n in rows if v[labeler] != "2")
                    agreed = sum(weight[v] * n for v, n in rows if v[labeler] == "1")
                    yes[labeler, truth] = (agreed + (3 if truth else 1)) / (voted + 4)
            for votes, _ in rows:
                odds = math.log(share / (total - share))
                for labeler, vote in enumerate(votes):
                    if vote != "2":
                        a, b = yes[labeler, 1], yes[labeler, 0]
                        odds += math.log(a / b) if vote == "1" else math.log((1 - a) / (1 - b))
                chance[votes] = 1 / (1 + math.exp(-max(min(odds, 30), -30)))
        out |= {(family, votes): chance[votes] for votes, _ in rows}
    return out


def _mapped(values: dict[str, float], key: Column, otherwise: float) -> Column:
    if not values:
        return F.lit(otherwise)
    table = F.create_map(*(F.lit(x) for pair in sorted(values.items()) for x in pair))
    return F.coalesce(F.try_element_at(table, key), F.lit(otherwise))


def train(found: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Log odds of every feature, and of every family."""
    spans = found.select(F.explode(F.concat("base", "wide")).alias("span"))
    family = _by_family(F.col("span"), F.lit)
    counts = spans.groupBy(family.alias("family"), _votes(F.col("span")).alias("votes")).count().collect()
    chance = estimate({(r["family"], r["votes"]): r["count"] for r in counts})
    weight = _mapped({f"{f}:{v}": p for (f, v), p in chance.items()}, F.concat(family, F.lit(":"), _votes(F.col("span"))), 0.5)
    features = spans.select(family.alias("family"), F.explode(_features(F.col("span"))).alias("feature"), weight.alias("p"))
    # Features have fixed sets of values, so this is a few hundred rows at most.
    sums = features.groupBy("family", "feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    total: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for row in sums:
        if row["feature"].startswith(f"{row['family']}:kind="):
            total[row["family"]][0] += row["yes"]
            total[row["family"]][1] += row["no"]
    prior = {family: math.log((yes + 1) / (no + 1)) for family, (yes, no) in total.items()}
    odds = {r["feature"]: math.log((r["yes"] + 0.5) / (total[r["family"]][0] + 1)) - math.log((r["no"] + 0.5) / (total[r["family"]][1] + 1)) for r in sums}
    return odds, prior


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, base counts, ``base_sha256, spans, n_added`` for every document."""
    found = materialise(found_spans(docs), "spans")
    odds, prior = train(found)

    def accepted(span: Column) -> Column:
        score = F.aggregate(_features(span), _mapped(prior, _by_family(span, F.lit), 0.0), lambda acc, f: acc + _mapped(odds, f, 0.0))
        return score > 0

    kept = F.filter("wide", accepted)
    # By kind as listed, then by place.
    added = F.concat(*(F.filter(F.array_sort(kept, lambda a, b: a["start"] - b["start"]), _is_kind(kind)) for kind in ADDED))
    added = F.when(F.size("wide") > 0, added).otherwise(F.col("wide"))
    rows = found.select("doc_id", "base", added.alias("added"))
    counts = [F.size(F.filter("base", _is_kind(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return rows.select("doc_id", *counts, F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
