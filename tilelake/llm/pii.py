"""PII spans by weak supervision: labelers vote, expectation-maximisation rates them, and a span classifier is trained.

Patterns find base spans and, beyond them, candidates: near misses of the same kinds (numbers of a card's length that
fail its checksum, addresses out of range, national phone numbers, spelt-out e-mail addresses; the bounds on lengths in
their patterns and in _TESTS are what near means: longer ones are no candidates). On each candidate four
labelers vote yes, no or nothing: the kind's rule, its shape, a gazetteer (top-level domains, issuers' prefixes, country
codes, public networks) and the words before it. Votes are counted over all documents by kind and pattern; from these
counts expectation-maximisation estimates each labeler's reliability and, for each pattern, how likely it is personal
data. With those weights a naive Bayes classifier over span features is trained, again from counts over all documents;
candidates that it holds likelier personal than not, and that touch no base span, are added.

All of it is DataFrame functions. Texts are read once and never shuffled: what is found is written to the shared folder,
one narrow row for each document, and counted there. Only counts by pattern and by feature come to the driver: at most
4 x 3^4 and a few hundred rows.

Defined results: a null or empty text has no spans; repeated rows have equal spans; null ids pass through; an empty table
gives no rows and adds nothing; extra columns are ignored.
"""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilelake.llm.common import stage, table
from tilelake.llm.spans import MARK, blocks, cut, find, free, joined, let, marked

KINDS = ("email", "ip", "card", "phone")
#: Base patterns, on texts in which separators within a match are marked: single-character loops never recurse.
EMAIL_DOT, CARD_GAP = r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", r"(?<=[0-9])[\x20-](?=[0-9])"
EMAIL = rf"(?:(?<![A-Za-z0-9._%+{MARK}-])|\G)[A-Za-z0-9._%+{MARK}-]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]++"
IP, PART = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CARD = rf"[0-9][0-9{MARK}]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates beyond the base patterns.
SPELT_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}\x20?(?:\[dot\]|\(dot\)|\x20dot\x20|\.)\x20?[A-Za-z]{2,12}(?![A-Za-z])"
NATIONAL_PHONE = r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"
#: Gazetteers and context words, by kind.
GAZETTEER = {
    "email": r"(?i)(?:\.|\bdot\)? ?|\[dot\] ?)(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$",
    "ip": r"^(?!0|127|22[4-9]|2[3-5][0-9])",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^(?:\+(?:1|33|34|44|49|39|31|41|43|32|351)(?![0-9]{10,})|\(?[2-9][0-9]{2})",
}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|correo|adresse)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|from|client)\b",
    "card": r"(?i)\b(?:card|visa|credit|mastercard|karte|carte|tarjeta|pay)\b",
    "phone": r"(?i)\b(?:phone|tel|call|fax|mobile|telefon|tel[ée]fono)\b",
}
AGAINST = r"(?i)\b(?:version|isbn|order|invoice|build|id|no|nr|token|hash|page|section)\b[^A-Za-z0-9]*$"
CONTEXT_CHARS = 40
LABELERS, ROUNDS, SMOOTH = ("rule", "shape", "gazetteer", "context"), 50, 1.0
#: Every labeler starts as right so often.
START = 0.8


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with email, ip, card and phone, and with near misses of ip, card and phone as ip_, card_ and phone_."""
    t, digit = F.col("text"), F.col("text").rlike("[0-9]")
    out = docs.withColumn("__email", F.when(F.contains(t, F.lit("@")), marked(t, EMAIL_DOT))).withColumn("__card", F.when(digit, marked(t, CARD_GAP)))
    out = find(out, "email", "__email", EMAIL)
    out = find(out, "ip_", "text", IP, digit)
    out = find(out, "card_", "__card", CARD)
    out = find(out, "phone_", "text", PHONE, F.contains(t, F.lit("+")))
    for kind, (test, near) in _TESTS.items():
        out = out.withColumn(kind, F.filter(f"{kind}_", test)).withColumn(f"{kind}_", _others(f"{kind}_", test, near))
    out = find(out, "email_", "text", SPELT_EMAIL, t.rlike(r"(?:\[at\]|\(at\)|\x20at\x20)"))
    out = find(out, "__national", "text", NATIONAL_PHONE, digit)
    return out.withColumn("phone_", F.concat("phone_", "__national")).drop("__email", "__card", "__national")


def _others(column: str, test, near) -> Column:
    return F.filter(column, lambda s: ~test(s) & near(s))


#: For each kind, the rule of base spans and what is near enough to it to be voted on.
_TESTS = {
    "ip": (lambda s: s["text"].rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"), lambda s: F.length(s["text"]) <= 23),
    "card": (lambda s: F.length(_digits(s["text"])).between(12, 19) & F.call_function("luhn_check", _digits(s["text"])), lambda s: F.length(_digits(s["text"])).between(12, 19)),
    "phone": (lambda s: F.length(_digits(s["text"])).between(9, 15), lambda s: F.length(_digits(s["text"])).between(7, 17)),
}
_SHAPES = {
    "email": r"^[A-Za-z][A-Za-z0-9._%+-]{0,63}(?:@|.{0,2}at)",
    "ip": r"^(?:(?:0|[1-9][0-9]{0,2})(?:\.(?!$)|$)){4}$",
    "card": rf"^(?:[0-9]{{4}}{MARK}?){{3}}[0-9]{{1,7}}$",
    "phone": r"^(?:\+[0-9]{1,3}\x20)?(?:\([0-9]{2,4}\)\x20?)?[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,4}$",
}


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 for yes, 0 for no (all else, unless no is given), - for neither."""
    return F.when(yes, "1").otherwise("0") if no is None else F.when(yes, "1").when(no, "0").otherwise("-")


def _class(char: Column) -> Column:
    kinds = lambda c: F.when(c == "", "none").when(c.rlike("[0-9]"), "digit").when(c.rlike(r"\s"), "space").when(c.rlike(r"[A-Za-z\u0080-\uffff]"), "letter").otherwise("mark")
    return let(char, kinds)


def _candidate(kind: str, base: bool):
    """A span as a candidate: its votes, in the order of LABELERS, and its features."""

    def of(s: Column) -> Column:
        t, start, end = s["text"], s["start"], s["end"]
        key = _digits(t) if kind == "card" else t
        marks = F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(t, "[A-Za-z0-9]", ""), ""))), "")

        def voted(before: Column) -> Column:
            votes = F.concat(F.lit("1" if base else "0"), _vote(t.rlike(_SHAPES[kind])), _vote(key.rlike(GAZETTEER[kind])), _vote(before.rlike(CONTEXT[kind]), before.rlike(AGAINST)))
            return let(votes, lambda v: described(before, v))

        def described(before: Column, votes: Column) -> Column:
            features = [F.concat(F.lit("long "), F.least(F.length(t), F.lit(40)).cast("string")), F.concat(F.lit("marks "), marks)]
            features += [F.concat(F.lit("after "), _class(F.right(before, F.lit(1)))), F.concat(F.lit("before "), _class(cut(F.col("__blocks"), end, end + 1)))]
            features += [F.concat(F.lit(f"{name} "), F.substring(votes, k + 1, 1)) for k, name in enumerate(LABELERS) if k]
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.lit(base).alias("base"), votes.alias("votes"), F.array(*features).alias("features"))

        return let(cut(F.col("__blocks"), F.greatest(start - CONTEXT_CHARS, F.lit(0)), start), voted)

    return of


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and all candidates of each document, base spans among them."""
    out = base_spans(docs.select("doc_id", "text"))
    out = out.withColumn("__blocks", F.when(sum((F.size(c) for k in KINDS for c in (k, f"{k}_")), F.lit(0)) > 0, blocks("text")))
    return out.select("doc_id", F.concat(*chain.from_iterable((F.transform(k, _candidate(k, True)), F.transform(f"{k}_", _candidate(k, False))) for k in KINDS)).alias("found"))


def reliabilities(counts: dict[tuple[str, str], int], kind: str) -> tuple[dict[str, float], list[tuple[float, float]], float]:
    """By expectation-maximisation over the counts of a kind's vote patterns: how likely each pattern is personal data,
    each labeler's shares of yes where it is and where it isn't, and the share of personal data."""
    own = {votes: n for (k, votes), n in counts.items() if k == kind}
    rates, share = [(START, 1 - START)] * len(LABELERS), 0.5
    likely: dict[str, float] = {}
    for _ in range(ROUNDS):
        for votes in own:
            yes, no = share, 1 - share
            for vote, (a, b) in zip(votes, rates):
                if vote != "-":
                    yes, no = yes * (a if vote == "1" else 1 - a), no * (b if vote == "1" else 1 - b)
            likely[votes] = yes / (yes + no)
        total = sum(own.values())
        share = (sum(n * likely[v] for v, n in own.items()) + SMOOTH) / (total + 2 * SMOOTH)
        rates = []
        for k in range(len(LABELERS)):
            sums = [[SMOOTH * (1 - START), SMOOTH * START], [SMOOTH * START, SMOOTH * (1 - START)]]  # by class, then vote
            for v, n in own.items():
                if v[k] != "-":
                    sums[1][v[k] == "0"] += n * likely[v]
                    sums[0][v[k] == "0"] += n * (1 - likely[v])
            rates.append((sums[1][0] / sum(sums[1]), sums[0][0] / sum(sums[0])))
    return likely, rates, share


def classifier(found: DataFrame) -> dict[str, float]:
    """Weights of the span classifier by 'kind feature', and of each kind alone, from all candidates."""
    each = found.select(F.explode("found").alias("c")).select("c.kind", "c.votes", "c.features")
    counts = {(r["kind"], r["votes"]): r["count"] for r in each.groupBy("kind", "votes").count().collect()}  # 4 x 3^4 at most
    likely = {(k, v): p for k in KINDS for v, p in reliabilities(counts, k)[0].items()}
    if not likely:
        return {}
    p = F.coalesce(F.create_map(*chain.from_iterable((F.lit(f"{k} {v}"), F.lit(x)) for (k, v), x in likely.items()))[F.concat_ws(" ", "kind", "votes")], F.lit(0.5))
    sums = each.select("kind", p.alias("p"), F.explode("features").alias("f")).groupBy("kind", "f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    out: dict[str, float] = {}
    totals = {k: (sum(n * likely[k, v] for (q, v), n in counts.items() if q == k), sum(n * (1 - likely[k, v]) for (q, v), n in counts.items() if q == k)) for k in KINDS}
    for k, (yes, no) in totals.items():
        out[k] = math.log((yes + SMOOTH) / (no + SMOOTH))
    for r in sums.collect():  # lengths, sets of marks, classes and votes: a few hundred
        yes, no = totals[r["kind"]]
        out[f"{r['kind']} {r['f']}"] = math.log((r["yes"] + SMOOTH) / (yes + 2 * SMOOTH)) - math.log((r["no"] + SMOOTH) / (no + 2 * SMOOTH))
    return out


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans by pattern) and added (candidates that the classifier accepts), as kind, start, end."""
    found = stage(candidates(docs))
    weights = classifier(found)
    named = F.create_map(*chain.from_iterable((F.lit(k), F.lit(w)) for k, w in weights.items())) if weights else F.create_map(F.lit(""), F.lit(0.0))
    weigh = lambda c: F.aggregate(c["features"], F.coalesce(named[c["kind"]], F.lit(0.0)), lambda s, f: s + F.coalesce(named[F.concat_ws(" ", c["kind"], f)], F.lit(0.0)))
    out = found.select("doc_id", F.filter("found", lambda c: c["base"]).alias("base"), F.filter("found", lambda c: ~c["base"] & (weigh(c) > 0)).alias("others"))
    out = out.withColumn("others", free("others", "base"))
    return out.select("doc_id", *(F.transform(x, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))).alias(n) for x, n in (("base", "base"), ("others", "added"))))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_spans(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.concat("base", "added"), KINDS).alias("spans"))
