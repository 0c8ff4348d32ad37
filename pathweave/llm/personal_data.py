"""Personal data by weak supervision: labelers vote on candidate spans. DataFrame functions only.

Candidates are all matches of the four base patterns, and of looser ones for forms that these don't know: spelled signs in
addresses, numbers in groups with other signs between. Five labelers vote on each: the strict pattern with its checks, a
gazetteer, the words before the span, its borders, and its form. The votes are counted over all documents by pattern of
votes and of the span's features; expectation-maximisation on these counts estimates each labeler's reliability and how
likely each pattern of votes is personal data, and a logistic span classifier is trained on votes and features. Base spans that
pass their checks always stay; the classifier adds other candidates that it is sure of.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.llm.cluster import materialize

KINDS = ("email", "ip", "card", "phone")

# Base patterns. They are anchored and possessive only so that each character is tried once; the matches are those of
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+     ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card [0-9]([\x20-]?[0-9])+                                   phone \+[0-9][\x20().0-9-]+[0-9]
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",  # a match is a whole run of digits; shorter ones fail the check of 13 digits
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser forms. Repeats are possessive or bounded, so that a text of any length is matched in a bounded depth.
_AT = r"(?:\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20at\x20)"
_DOT = r"(?:\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20|\.)"
LOOSE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{2,63}}+){{1,8}}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\x20?(?:\.|[(\[{]\x20?(?:\.|dot)\x20?[)\]}]|\x20dot\x20)\x20?[0-9]{1,3}+){3}(?![0-9.])",
    "card": r"(?<![0-9./_-])[0-9]{4}(?:[./_]|\x20?[\u2010-\u2014-]\x20?|\x20\x20)[0-9]{4}(?:[./_]|\x20?[\u2010-\u2014-]\x20?|\x20\x20)[0-9]{4}(?:[./_]|\x20?[\u2010-\u2014-]\x20?|\x20\x20)[0-9]{1,7}+(?![0-9])",
    "phone": r"(?<![0-9+().-])(?:00[1-9][0-9]{0,2}+[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-]?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
LOOSE_GUARD = {"email": r"(?:[(\[{]\x20?|\x20)at(?:\x20?[)\]}]|\x20)", "ip": r"[0-9]\x20?(?:[(\[{]|\x20?\.\x20|\x20\.|\x20dot)", "card": r"[0-9]{4}.{1,3}[0-9]{4}.{1,3}[0-9]{4}", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}

# Gazetteers and cue words: fixed values.
TOP_LEVEL = ("com", "net", "org", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "at", "ch", "it", "nl")
CARD_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|36)"
CALLING_CODES = r"^\+?(?:1|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b",
    "ip": r"(?i)\b(?:ip|ipv4|host|server|address|login|logged|from)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|account|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|cell)\b",
}
COUNTER_CUES = r"(?i)\b(?:version|isbn|issn|order|invoice|serial|build|section)\b"

LABELERS = ("strict", "gazetteer", "context", "border", "form")
#: What the classifier sees of a span besides the votes: whether a number passes its arithmetic check (1 yes, 0 no, -1 not a number), and
#: whether signs are spelled or unusual (1) or not (0).
FEATURES = ("check", "spelled")
#: Votes: yes, no, and no opinion.
YES, NO, NONE = 1, 0, -1
#: Probability from which a candidate outside the base is added.
SURE = 0.95


#: Spans that are folded over at once. Folds append to an array, which costs its square; so they run inside pieces of this size.
PIECE = 256
#: Code points before a span that labelers see.
BEFORE = 30
SPAN = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value found once a row, also where ``use`` names it inside other lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pieces(items: Column) -> Column:
    """An array cut into arrays of ``PIECE`` items."""
    numbers = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PIECE).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: F.slice(items, i * PIECE + 1, F.lit(PIECE)))


def pieces_of(items: Column) -> Column:
    return let(items, pieces)


def _end_of(text: Column) -> Column:
    return F.substring(text, -BEFORE, BEFORE)


def match_spans(text: Column, pattern: str, guard: Column) -> Column:
    """All matches, leftmost and apart, as structs of start, end (code points, end exclusive), the matched text, and what stands before and after it.

    Offsets are sums of the lengths of gaps and matches: inside pieces of the list of matches, and over the pieces. Nothing is cut
    from the whole text, so the work grows with the text and not with the square of its matches.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def after(m: Column, g: Column) -> Column:
        """The code point behind each match: the first one of the next gap, or of the next match where that is empty."""
        return F.zip_with(F.slice(g, F.lit(2), F.size(m)), F.slice(m, F.lit(2), F.size(m)), lambda gap, match: F.substring(F.concat(gap, F.coalesce(match, F.lit(""))), 1, 1))

    def measured(m: Column, g: Column) -> Column:
        sized = F.zip_with(m, F.slice(g, F.lit(1), F.size(m)), lambda match, gap: F.struct(F.length(gap).alias("gap"), F.length(match).alias("len"), match.alias("match"), _end_of(gap).alias("end_of_gap")))
        return F.zip_with(sized, after(m, g), lambda x, c: x.withField("after", c))

    state = lambda at, tail: F.struct(at.alias("at"), tail.alias("tail"))
    nothing = state(F.lit(0), F.lit(""))
    passed = lambda acc, x: state(acc["at"] + x["gap"] + x["len"], _end_of(F.concat(acc["tail"], x["end_of_gap"], _end_of(x["match"]))))

    def begins(parts: Column) -> Column:
        """Where each piece begins, and what stands before it."""
        totals = F.transform(parts, lambda part: F.aggregate(part, nothing, passed))
        first = F.struct(nothing.alias("now"), F.expr("cast(array() as array<struct<at:int,tail:string>>)").alias("out"))

        def step(acc: Column, total: Column) -> Column:
            now = state(acc["now"]["at"] + total["at"], _end_of(F.concat(acc["now"]["tail"], total["tail"])))
            return F.struct(now.alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out"))

        return F.aggregate(totals, first, step, lambda acc: acc["out"])

    def placed(part: Column, begin: Column) -> Column:
        first = F.struct(begin.alias("now"), F.expr(f"cast(array() as {SPAN})").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["now"]["at"] + x["gap"]
            span = F.struct(start.alias("start"), (start + x["len"]).alias("end"), x["match"].alias("match"), _end_of(F.concat(acc["now"]["tail"], x["end_of_gap"])).alias("before"), x["after"].alias("after"))
            return F.struct(passed(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(part, first, step, lambda acc: acc["out"])

    spans = let(found, lambda m: let(gaps, lambda g: let(pieces_of(measured(m, g)), lambda parts: F.flatten(F.zip_with(parts, begins(parts), placed)))))
    return F.when(guard, spans).otherwise(F.expr(f"cast(array() as {SPAN})"))


def apart(spans: Column, others: Column) -> Column:
    """Spans that overlap none of ``others``; both in order. A piece of spans looks only at the others that reach into it."""

    def kept(part: Column) -> Column:
        low, high = F.get(part, F.lit(0))["start"], F.element_at(part, -1)["end"]
        near = F.filter(others, lambda o: (o["start"] < high) & (low < o["end"]))
        return let(near, lambda ns: F.filter(part, lambda s: ~F.exists(ns, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))))

    return F.flatten(F.transform(pieces_of(spans), kept))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check; longer ones don't."""
    number = F.when(F.length(number) <= 19, number).otherwise("1")
    places = F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1)))

    def value(i: Column) -> Column:
        d = F.substring(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        doubled = 2 * d
        return F.when(i % 2 == 0, F.when(doubled > 9, doubled - 9).otherwise(doubled)).otherwise(d)

    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    """The checks that a base match must pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(match, "[.]"), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        number = digits(match)
        return F.when(F.length(number).between(13, 19), luhn(number)).otherwise(False)
    return F.length(digits(match)).between(9, 15)


def _votes(kind: str, span: Column, strict: Column) -> list[Column]:
    vote = lambda yes, no=None: F.when(yes, YES).when(F.lit(True) if no is None else no, NO).otherwise(NONE)
    match = span["match"]
    before = span["before"]
    edge = F.concat(F.substring(before, -1, 1), span["after"])
    gazetteer = {
        "email": vote(F.lower(F.regexp_extract(match, r"([A-Za-z0-9-]+)$", 1)).isin(*TOP_LEVEL)),
        "ip": vote(F.regexp_extract(match, r"^([0-9]+)", 1).rlike(r"^(?:[1-9][0-9]?|1[0-9][0-9]|2[01][0-9]|22[0-3])$")),
        "card": vote(digits(match).rlike(CARD_ISSUERS)),
        "phone": vote(match.rlike(CALLING_CODES), match.startswith("+")),
    }[kind]
    spelled = F.regexp_replace(match, r"[(\[{]\x20?dot\x20?[)\]}]|\x20dot\x20", ".")
    form = {
        "email": vote(match.rlike(r"^[A-Za-z0-9]")),
        "ip": vote(passes("ip", F.regexp_replace(spelled, r"[^0-9.]", ""))),
        "card": vote(F.length(digits(match)).isin(15, 16) & luhn(digits(match)), ~F.length(digits(match)).between(13, 19) | ~luhn(digits(match))),
        "phone": vote(F.length(digits(match)).between(10, 13), ~F.length(digits(match)).between(9, 15)),
    }[kind]
    context = F.when(before.rlike(CUES[kind]), YES).when(before.rlike(COUNTER_CUES), NO).otherwise(NONE)
    return [strict, gazetteer, context, vote(~edge.rlike(r"[\p{L}0-9_]")), form]


def candidates(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``row`` (a struct of the columns of ``keep``, if any) and per kind an array of candidate spans with their votes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = [F.struct(*keep).alias("row")] if keep else []
    out = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *row)
    guards = {
        "email": F.contains("text", F.lit("@")),
        "ip": F.col("text").rlike(r"[0-9]\.[0-9]"),
        "card": F.col("text").rlike(r"[0-9][\x20-]?[0-9]"),
        "phone": F.contains("text", F.lit("+")),
    }
    out = out.withColumns({f"{k}_base": match_spans(F.col("text"), BASE[k], guards[k]) for k in KINDS})
    out = out.withColumns({f"{k}_loose": match_spans(F.col("text"), LOOSE[k], F.col("text").rlike(LOOSE_GUARD[k])) for k in LOOSE})

    def voted(kind: str, column: str, base: bool) -> Column:
        def one(span: Column) -> Column:
            ok = passes(kind, span["match"]) if base else F.lit(False)
            strict = F.when(ok, YES).otherwise(NO) if base else F.lit(NONE)
            votes = _votes(kind, span, strict)
            number = digits(span["match"])
            check = luhn(number).cast("byte") if kind == "card" else F.lit(-1).cast("byte")
            return F.struct(
                span["start"].alias("start"), span["end"].alias("end"), ok.alias("base"), *[v.cast("byte").alias(n) for v, n in zip(votes, LABELERS)], check.alias("check"), F.lit(int(not base)).cast("byte").alias("spelled")
            )

        spans = F.col(column)
        if not base:  # a loose match that a base match overlaps is no candidate of its own
            spans = apart(spans, F.col(f"{kind}_base"))
        return F.transform(spans, one)

    both = {k: F.concat(voted(k, f"{k}_base", True), voted(k, f"{k}_loose", False)) if k in LOOSE else voted(k, f"{k}_base", True) for k in KINDS}
    return out.select("doc_id", *(["row"] if keep else []), *[both[k].alias(k) for k in KINDS])


def vote_counts(spans: DataFrame) -> list[tuple[str, tuple[int, ...], int]]:
    """How often each pattern of votes and features occurs, by kind: at most 4 * 3^5 * 6 rows reach the driver."""
    rows = None
    for kind in KINDS:
        part = spans.where(F.size(kind) > 0).select(F.lit(kind).alias("kind"), F.explode(kind).alias("s"))
        part = part.groupBy("kind", *[F.col(f"s.{n}").alias(n) for n in LABELERS + FEATURES]).count()
        rows = part if rows is None else rows.unionByName(part)
    return sorted((r["kind"], tuple(r[n] for n in LABELERS + FEATURES), r["count"]) for r in rows.collect())


def reliabilities(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """Expectation-maximisation over patterns, of which the votes come first: the probability that such a span is personal data.

    Each labeler has, by class, a distribution over its three votes, shared by all kinds; each kind has a share of
    personal data. Starts from the majority of votes and from labelers that are mostly right; smoothed by one span.
    """
    if not counts:
        return {}
    belief = {}
    for kind, votes, _ in counts:
        cast = votes[: len(LABELERS)]
        yes, no = cast.count(YES), cast.count(NO)
        belief[kind, votes] = min(0.95, max(0.05, 0.5 + 0.15 * (yes - no)))
    for _ in range(rounds):
        prior = {k: [1.0, 1.0] for k in KINDS}
        table = [[{v: 1.0 for v in (YES, NO, NONE)} for _ in LABELERS] for _ in range(2)]
        for kind, votes, n in counts:
            p = belief[kind, votes]
            for c, weight in ((1, p * n), (0, (1 - p) * n)):
                prior[kind][c] += weight
                for j, v in enumerate(votes[: len(LABELERS)]):
                    table[c][j][v] += weight
        for kind, votes, _ in counts:
            score = math.log(prior[kind][1] / prior[kind][0])
            for j, v in enumerate(votes[: len(LABELERS)]):
                score += math.log(table[1][j][v] / sum(table[1][j].values())) - math.log(table[0][j][v] / sum(table[0][j].values()))
            belief[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))
    return belief


def train_classifier(counts: list[tuple[str, tuple[int, ...], int]], belief: dict, steps: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> dict[tuple, float]:
    """Logistic regression on votes, features and kind, fitted to the estimated probabilities, each pattern weighed by its count."""
    weights = {("kind", k): 0.0 for k in KINDS} | {(n, v): 0.0 for n, v in product(LABELERS + FEATURES, (YES, NO, NONE))}
    total = sum(math.log1p(n) for _, _, n in counts) or 1.0
    for _ in range(steps):
        gradient = dict.fromkeys(weights, 0.0)
        for kind, votes, n in counts:
            active = [("kind", kind), *zip(LABELERS + FEATURES, votes)]
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[a] for a in active)))))
            for a in active:
                gradient[a] += math.log1p(n) / total * (belief[kind, votes] - p)
        for a in weights:
            weights[a] += rate * (gradient[a] - ridge * weights[a]) * 4
    return weights


def _probability(weights: dict[tuple, float], kind: str, span: Column) -> Column:
    score = F.lit(weights["kind", kind])
    for n in LABELERS + FEATURES:
        score = score + F.when(span[n] == YES, weights[n, YES]).when(span[n] == NO, weights[n, NO]).otherwise(weights[n, NONE])
    return 1 / (1 + F.exp(-score))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), sure: float = SURE) -> DataFrame:
    """Personal data of every document: ``doc_id``, ``row`` with the columns of ``keep``, if any, and per kind (``email, ip, card, phone``) an
    array of spans (start, end, base), one row per input row.

    Offsets count code points of the whole text, end exclusive. Spans with ``base`` are the base matches that pass their
    checks; the others are added by the classifier, and overlap no base match of their kind. A match that fails its
    check is dropped without a retry. Null and empty texts have no spans; repeated rows and ids stay as they are; an
    empty table gives an empty result.
    """
    spans = materialize(candidates(docs, id_col, text_col, keep))
    counts = vote_counts(spans)
    weights = train_classifier(counts, reliabilities(counts))

    def chosen(kind: str) -> Column:
        # A candidate that fails its check is no personal data of this kind, whatever the other votes.
        sure_of = lambda s: s["base"] | ((s["strict"] != NO) & (_probability(weights, kind, s) >= sure))
        # A candidate that fails a check of arithmetic is none either: a card number without a valid check digit is misread.
        kept = F.transform(F.filter(kind, lambda s: sure_of(s) & (s["base"] | (s["check"] != NO))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
        return F.array_sort(kept)

    return spans.select("doc_id", *(["row"] if keep else []), *[chosen(k).alias(k) for k in KINDS])


def span_list(only_base: bool) -> Column:
    """``kind:start:end`` of all spans, by kind and start, joined by commas."""

    def listed(kind: str) -> Column:
        spans = F.filter(kind, lambda s: s["base"]) if only_base else F.col(kind)
        return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))

    return F.array_join(F.concat(*[listed(k) for k in KINDS]), ",")


def summary(found: DataFrame) -> DataFrame:
    """Counts of base spans, the digest of their list, and the list of all spans."""
    counts = [F.size(F.filter(k, lambda s: s["base"])).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_list(True), 256).alias("base_sha256"), span_list(False).alias("spans"))


def masked(text: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first and longest stands."""

    def marks(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(f"[{kind.upper()}]").alias("mark")))

    tagged = F.array_sort(F.concat(*[marks(k) for k in KINDS]))
    first = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def piece(acc: Column, part: Column) -> Column:
        """A piece's marks and the text before each, cut from the part of the text that it spans."""
        low, high = acc["at"], F.array_max(F.transform(part, lambda s: -s["back"]))
        begin = F.struct(low.alias("at"), F.lit("").alias("out"))

        def over(span_text: Column) -> Column:
            def step(now: Column, s: Column) -> Column:
                ahead = s["start"] >= now["at"]
                more = F.concat(now["out"], F.substring(span_text, now["at"] - low + 1, s["start"] - now["at"]), s["mark"])
                return F.struct(F.when(ahead, -s["back"]).otherwise(now["at"]).alias("at"), F.when(ahead, more).otherwise(now["out"]).alias("out"))

            return F.aggregate(part, begin, step)

        return let(let(F.substring(text, low + 1, F.greatest(high - low, F.lit(0))), over), lambda done: F.struct(done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out")))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(tagged) > 0, F.aggregate(pieces_of(tagged), first, piece, rest)).otherwise(text)
