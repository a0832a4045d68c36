"""Personal data by weak supervision, in DataFrame operations only.

Base matches come from fixed patterns and always stay. Wider patterns propose further candidates. Labelers of three
sorts vote on every candidate: regex labelers (checksum, digit groups), gazetteers (issuer digits, mail domains, field
names) and context labelers (words before, characters around). Expectation-maximisation over the counts of the vote patterns
estimates each labeler's reliability without labels; the posteriors train a naive Bayes span classifier on the
candidates' features, and candidates it accepts become spans.

Scale: both passes are narrow scans. Only counts by (kind, votes, features) reach the driver; votes and features take few
values each, so their number is bounded whatever the corpus is.
"""

from __future__ import annotations

import operator
from collections import defaultdict
from collections.abc import Callable
from functools import partial
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in the order in which spans of one start are listed.
KINDS = ["email", "ip", "card", "phone", "secret"]
# Possessive forms of the base patterns: they match the same spans and cannot backtrack. A match begins where a run of its
# characters begins (or where the last match ended), so no run is scanned again from each of its characters.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?)[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?i)(?<![a-z0-9_])(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth)\x20?[=:]\x20?[\"']?[a-z0-9_/+=-]{12,}+[\"']?",
}
IP_PARTS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|(?<=0))(?:\.|$)){4}$"
ISSUERS = "^[3-6]"
DOMAINS = r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$"
WORDS_BEFORE = {
    "email": r"(?i)(?:mail|contact|write|reach|@)",
    "ip": r"(?i)(?:ip|address|host|server|from)",
    "card": r"(?i)(?:card|credit|visa|account|iban|number|pay)",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell)",
    "secret": r"(?i)(?:key|config|export|env|set)",
}


SPAN = "struct<start:int,end:int,text:string,left:string,right:string>"
#: Stands around matches while a text is cut. No pattern can match it, so where a text holds it another such character may stand for it.
CUT, ALIKE = "\ufdd0", "\ufdd1"
FAR = 1 << 30


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, also where use needs it for every element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running join (sum, greatest, least) of an array: log2(n) rounds, each over the array once."""
    before = lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= F.call_function("shiftleft", F.lit(1), k), join(x, F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)))).otherwise(x))
    return let(values, lambda v: F.when(F.size(v) < 2, v).otherwise(F.aggregate(F.sequence(F.lit(0), F.floor(F.log2(F.size(v) - F.lit(0.5))).cast("int")), v, before)))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, text, left, right) of the leftmost non-overlapping matches, in code points; linear but for a logarithm.

    Matches and gaps alternate and add up to the text, so the running sum of their lengths gives the positions.
    """
    pieces = F.split(F.regexp_replace(F.replace(text, F.lit(CUT), F.lit(ALIKE)), F.lit(f"({pattern})"), F.lit(f"{CUT}$1{CUT}")), CUT, -1)

    def spans(p: Column, ends: Column) -> Column:
        span = lambda k: F.struct(F.get(ends, 2 * k).alias("start"), F.get(ends, 2 * k + 1).alias("end"), F.get(p, 2 * k + 1).alias("text"), F.call_function("right", F.get(p, 2 * k), F.lit(24)).alias("left"), F.call_function("left", F.get(p, 2 * k + 2), F.lit(1)).alias("right"))
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / 2).cast("int") - 1), span)

    return let(pieces, lambda p: F.when(F.size(p) < 3, F.array().cast(f"array<{SPAN}>")).otherwise(let(running(F.transform(p, F.length), lambda a, b: a + b), lambda ends: spans(p, ends))))


def clear_of(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others, by start: the furthest end before a span and the nearest start after it decide."""
    tag = lambda own: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(own).alias("own"), F.when(F.lit(own), s).alias("span"))
    far = lambda e: F.when(e["own"], -1).otherwise(e["end"])
    near = lambda e: F.when(e["own"], FAR).otherwise(e["start"])
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], a["end"] - b["end"]).otherwise(a["own"].cast("int") - b["own"].cast("int"))

    def clear(both: Column) -> Column:
        ends, starts = running(F.transform(both, far), F.greatest), F.reverse(running(F.reverse(F.transform(both, near)), F.least))
        rated = F.zip_with(F.zip_with(both, ends, lambda e, x: F.struct(e.alias("e"), x.alias("x"))), starts, lambda e, y: F.struct(e["e"].alias("e"), (e["e"]["own"] & (e["x"] <= e["e"]["start"]) & (y >= e["e"]["end"])).alias("clear")))
        return F.transform(F.filter(rated, lambda r: r["clear"]), lambda r: r["e"]["span"])

    both = lambda v: F.array_sort(F.concat(F.transform(v["spans"], tag(True)), F.transform(v["others"], tag(False))), order)
    return let(F.struct(spans.alias("spans"), others.alias("others")), lambda v: F.when((F.size(v["spans"]) == 0) | (F.size(v["others"]) == 0), v["spans"]).otherwise(let(both(v), clear)))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s["text"].rlike(IP_PARTS)
    if kind == "card":
        d = digits(s["text"])
        return F.length(d).between(14, 19) & F.call_function("luhn_check", d)
    if kind == "phone":
        return F.length(digits(s["text"])).between(10, 15)
    return F.lit(True)


def _is(kind: str, s: Column) -> Column:
    return s["kind"] == kind


def _tagged(kind: str, spans: Column, base: bool) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["text"].alias("text"), s["left"].alias("left"), s["right"].alias("right"), F.lit(base).alias("base")))


EMPTY = "array<struct<start:int,rank:int,end:int,kind:string,text:string,left:string,right:string,base:boolean>>"


def with_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with __base (base matches) and __more (candidates that overlap no base match), both arrays of spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(EMPTY)
    raw = docs.withColumn("__text", text)
    raw = raw.withColumn("__digit", F.col("__text").rlike("[0-9]"))
    digit = F.col("__digit")
    conditions = {"email": F.contains("__text", F.lit("@")), "ip": digit & F.col("__text").rlike(r"[0-9]\.[0-9]"), "card": digit & F.col("__text").rlike(r"[0-9][\x20-]?[0-9]"), "phone": digit & F.contains("__text", F.lit("+"))}
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        raw = raw.withColumn(f"__{kind}", F.when(conditions[kind], _tagged(kind, matches(F.col("__text"), pattern), True)).otherwise(none))
    wide = {"email": F.col("__text").rlike(r"(?i)[\[(]\x20?at\x20?[\])]"), "phone": digit & F.col("__text").rlike(r"[0-9]{3}[)\x20.-]"), "secret": F.col("__text").rlike(r"[=:]")}
    for kind, condition in wide.items():
        raw = raw.withColumn(f"__{kind}2", F.when(condition, _tagged(kind, matches(F.col("__text"), WIDE[kind]), False)).otherwise(none))
    good = [F.filter(f"__{k}", partial(_valid, k)) for k in KINDS[:4]]
    # Base matches that fail their check are candidates still, where their digits are as many as the kind has.
    failed_card = F.filter("__card", lambda s: F.length(digits(s["text"])).between(13, 19) & ~_valid("card", s))
    failed_ip = F.filter("__ip", lambda s: ~_valid("ip", s))
    raw = raw.withColumn("__base", F.array_sort(F.concat(*good))).withColumn("__more", F.concat(failed_card, failed_ip, "__email2", "__phone2", "__secret2"))
    dropped = ["__digit", *(f"__{k}" for k in KINDS[:4]), *(f"__{k}2" for k in wide)]
    return raw.withColumn("__more", clear_of(F.col("__more"), F.col("__base"))).drop(*dropped)


def votes(s: Column) -> Column:
    """The labelers' votes on a span as one character each: 1 personal data, 0 not, - abstains."""
    d, kind = F.length(digits(s["text"])), s["kind"]
    say = lambda yes, no: F.when(yes, "1").when(no, "0").otherwise("-")
    regex_check = F.when(s["base"], "1").when(kind == "card", say(F.call_function("luhn_check", digits(s["text"])), F.lit(False))).when(kind == "ip", "0").otherwise("-")
    groups = F.when(kind == "card", say(d.isin(15, 16), ~d.isin(14, 15, 16))).when(kind == "phone", say(d.isin(10, 11, 12), d > 13)).when(kind == "secret", say(d >= 4, d == 0)).when(kind == "ip", say(~s["text"].rlike(r"(?:^|\.)0[0-9]"), F.lit(True))).otherwise("1")
    gazetteer = F.when(kind == "card", say(digits(s["text"]).rlike(ISSUERS), F.lit(False))).when(kind == "email", say(s["text"].rlike(DOMAINS), F.lit(False))).when(kind == "secret", "1").otherwise("-")
    before = F.lit("-")
    for k in KINDS:
        before = F.when((kind == k) & s["left"].rlike(WORDS_BEFORE[k]), "1").otherwise(before)
    around = say((s["left"].rlike(r"(?:^|[\s:(,;|])$")) & s["right"].rlike(r"^(?:$|[^A-Za-z0-9_.=-]|\.$)"), s["left"].rlike(r"[A-Za-z0-9_.=\"-]$") | s["right"].rlike(r"^[A-Za-z0-9_=]"))
    return F.concat(regex_check, groups, gazetteer, before, around)


def features(s: Column) -> Column:
    """Bounded description of a span: digits, length, separators, characters on both sides."""
    side = lambda c: F.when(c == "", "^").when(c.rlike(r"\s"), "_").when(c.rlike("[A-Za-z]"), "a").when(c.rlike("[0-9]"), "9").otherwise(".")
    return F.concat_ws("|", s["kind"], F.least(F.length(digits(s["text"])), F.lit(20)).cast("string"), F.least(F.length(s["text"]).cast("int") / F.lit(8), F.lit(8)).cast("int").cast("string"), F.when(s["text"].rlike(r"[\x20().-]"), "s").otherwise("-"), side(F.call_function("right", s["left"], F.lit(1))), side(s["right"]))


def estimate(counts: list[tuple[str, str, int]], rounds: int = 50) -> dict[str, float]:
    """Posterior that a vote pattern ("kind:votes") is personal data, by EM with labelers independent given the truth."""
    out: dict[str, float] = {}
    for kind in sorted({k for k, _, _ in counts}):
        rows = [(v, n) for k, v, n in counts if k == kind]
        width = len(rows[0][0])
        prior, hit, false = 0.5, [0.8] * width, [0.2] * width
        post: list[float] = []
        for _ in range(rounds):
            post = []
            for v, _n in rows:
                odds = log(prior / (1 - prior))
                for i, c in enumerate(v):
                    if c != "-":
                        odds += log(hit[i] / false[i]) if c == "1" else log((1 - hit[i]) / (1 - false[i]))
                post.append(1 / (1 + exp(-max(-60.0, min(60.0, odds)))))
            total = sum(n for _, n in rows)
            prior = min(max((sum(p * n for p, (_, n) in zip(post, rows, strict=True)) + 1) / (total + 2), 0.02), 0.98)
            for i in range(width):
                # Beta priors keep every labeler better than chance, which also fixes which class is which.
                seen = [(p, n, v[i] == "1") for p, (v, n) in zip(post, rows, strict=True) if v[i] != "-"]
                hit[i] = min(max((sum(p * n for p, n, y in seen if y) + 8) / (sum(p * n for p, n, _ in seen) + 10), 0.55), 0.99)
                false[i] = min(max((sum((1 - p) * n for p, n, y in seen if y) + 2) / (sum((1 - p) * n for p, n, _ in seen) + 10), 0.01), 0.45)
        out |= {f"{kind}:{v}": p for (v, _), p in zip(rows, post, strict=True)}
    return out


class SpanClassifier:
    """Naive Bayes over the fields of features(), trained on EM posteriors; accepted lists the feature strings that pass."""

    def __init__(self, counts: list[tuple[str, str, str, int]], threshold: float = 0.5):
        """counts: (kind, votes, features, spans)."""
        by_votes: dict[tuple[str, str], int] = defaultdict(int)
        for kind, v, _, n in counts:
            by_votes[kind, v] += n
        self.posterior = estimate([(k, v, n) for (k, v), n in sorted(by_votes.items())])
        weight: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        field: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for kind, v, f, n in counts:
            p = self.posterior[f"{kind}:{v}"]
            for y, w in ((1, p * n), (0, (1 - p) * n)):
                weight[kind][y] += w
                for i, value in enumerate(f.split("|")[1:]):
                    field[kind, i, value][y] += w
        self.accepted: list[str] = []
        for f in sorted({f for _, _, f, _ in counts}):
            kind, *values = f.split("|")
            odds = log((weight[kind][1] + 1) / (weight[kind][0] + 1))
            for i, value in enumerate(values):
                x = field[kind, i, value]
                odds += log((x[1] + 0.5) / (weight[kind][1] + 5)) - log((x[0] + 0.5) / (weight[kind][0] + 5))
            if 1 / (1 + exp(-max(-60.0, min(60.0, odds)))) >= threshold:
                self.accepted.append(f)


def fit_pii(docs: DataFrame, *, text_col: str = "text") -> SpanClassifier:
    """Counts votes and features over all documents' candidates and fits the classifier; no rows are sampled.

    Null and empty texts have no candidates; ties and repeated rows count each; of an empty table no candidate is accepted. Other columns
    are not read.
    """
    spans = with_spans(docs.select(text_col), text_col).select(F.explode(F.concat("__base", "__more")).alias("s"))
    counted = spans.select(F.col("s.kind").alias("kind"), votes(F.col("s")).alias("v"), features(F.col("s")).alias("f")).groupBy("kind", "v", "f").agg(F.count("*").alias("n"))
    return SpanClassifier([(r.kind, r.v, r.f, r.n) for r in counted.collect()])


def find_pii(docs: DataFrame, model: SpanClassifier, *, text_col: str = "text") -> DataFrame:
    """docs with __base and __spans: base matches, and with them the accepted candidates, sorted by start and kind.

    An accepted candidate that overlaps one of an earlier-listed kind is left out. Null and empty texts have no spans.
    """
    found = with_spans(docs, text_col)
    if model.accepted:
        accepted = F.filter("__more", lambda s: features(s).isin(model.accepted))
        ranked = lambda add, rank, test: F.filter(add, lambda s: test(s["rank"], F.lit(rank)))
        clear = lambda add: F.concat(ranked(add, 0, operator.eq), *(clear_of(ranked(add, r, operator.eq), ranked(add, r, operator.lt)) for r in range(1, len(KINDS))))
        found = found.withColumn("__spans", F.when(F.size("__more") == 0, F.col("__base")).otherwise(let(accepted, lambda add: F.array_sort(F.concat(F.col("__base"), clear(add))))))
    else:
        found = found.withColumn("__spans", F.col("__base"))
    return found.drop("__more")


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report_pii(docs: DataFrame, model: SpanClassifier | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base matches by kind, base_sha256, spans, and n_added.

    A null text is empty; null or repeated ids give a row per row; empty tables give an empty result; extra columns are not read.
    """
    model = fit_pii(docs, text_col=text_col) if model is None else model
    found = find_pii(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    counts = [F.size(F.filter("__base", partial(_is, k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("__base")), 256).alias("base_sha256"), listed(F.col("__spans")).alias("spans"), (F.size("__spans") - F.size("__base")).cast("long").alias("n_added"))


def redact_pii(docs: DataFrame, model: SpanClassifier, *, text_col: str = "text") -> DataFrame:
    """docs with their columns, each span of the text replaced by its kind in brackets; overlapping spans are replaced as one.

    Of overlapping spans the first gives the kind. A null text stays null, a text without spans stays as it is; null ids, ties and repeated
    rows are kept row by row; an empty table stays empty.
    """
    found = find_pii(docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text")), model)
    block = 4096

    def cut(blocks: Column, start: Column, end: Column) -> Column:
        """Code points from start to end, out of the blocks that hold them."""
        lo, hi = F.floor(start / block).cast("int"), F.floor(end / block).cast("int")
        return F.call_function("substring", F.array_join(F.slice(blocks, lo + 1, hi - lo + 1), ""), start - lo * block + 1, end - start)

    def redact(blocks: Column, spans: Column, ends: Column) -> Column:
        done = lambda i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1))  # noqa: E731  how far the spans before have come
        parts = F.transform(spans, lambda s, i: F.when(s["start"] >= done(i), F.concat(cut(blocks, done(i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
        return F.concat(F.array_join(parts, ""), cut(blocks, F.get(ends, F.size(ends) - 1), F.lit(FAR)))

    blocks = F.regexp_extract_all(F.col("__text"), F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    redacted = let(F.struct(blocks.alias("b"), F.col("__spans").alias("s"), running(F.transform("__spans", lambda s: s["end"]), F.greatest).alias("e")), lambda v: redact(v["b"], v["s"], v["e"]))
    return found.select(F.col("row").withField(f"`{text_col}`", F.when(F.size("__spans") > 0, redacted).otherwise(F.col("text"))).alias("row")).select("row.*")
