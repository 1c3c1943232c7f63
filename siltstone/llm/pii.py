"""Personal data by weak supervision, in DataFrame and SQL functions only.

Strict patterns give base spans, looser ones give further candidates: spelled-out addresses, numbers grouped as
telephone numbers, digits that miss a strict test, and runs that look like secrets. Four labelers vote on every
candidate (for, against, or not at all): a regex labeler, a gazetteer of issuers, country codes, top-level domains,
address ranges and names of secrets, and two context labelers for what stands before and after. Expectation-maximisation over the
counts of vote patterns, of which there are a bounded number, estimates each labeler's reliability and the
probability of each pattern; those probabilities are the soft labels from whose feature counts a naive Bayes
span classifier is trained. Candidates that it accepts are added to the base spans, which all stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

#: Kinds with base patterns, and one that the method alone finds.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = 4

#: Base patterns. A quantifier that what follows can never need back is possessive, which changes no match and
#: keeps the matcher from recursing; an address starts where the run of its characters does, or at the last match's end.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Further candidates: spelled-out addresses, and numbers grouped as telephone numbers without a country code.
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++"
GROUPED = r"(?<![0-9+.(-])(?<!\+[0-9][\x20-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"
#: Runs of a secret's characters with letters and digits in them.
SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+(?![A-Za-z0-9+/_=-])"

#: Gazetteers.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|me|app|dev|ai|at|au|be|br|ca|ch|cl|cn|cz|de|dk|es|eu|fi|fr|gr|hu|ie|il|in|it|jp|kr|mx|nl|no|nz|pl|pt|ro|ru|se|sg|sk|tr|ua|uk|us|za"
COUNTRY_CODES = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98|2[1-6][0-9]|29[0-9]|3[578][0-9]|42[0-9]|50[0-9]|59[0-9]|6[7-9][0-9]|80[08]|85[0-9]|88[0-8]|96[0-8]|97[0-9]|99[2-8]"
SECRET_NAMES = "token|secret|password|passwd|passphrase|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|client[_ -]?secret|credential|credentials|authorization|auth|bearer|jwt|session[_ -]?id"
CUES = {
    "email": "mail|e-mail|contact|write|reach|address",
    "ip": "ip|host|address|server|login|from",
    "card": "card|visa|mastercard|amex|credit|payment|account",
    "phone": "phone|tel|call|mobile|fax|contact|reach",
    "secret": SECRET_NAMES,
}
CONTEXT = 24


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    places = F.sequence(F.lit(1), F.length(digits))
    value = F.transform(places, lambda i: F.substr(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(value, F.lit(0), lambda total, v: total + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def ip_ok(s: Column) -> Column:
    """Four parts of at most 255 each, whatever zeros lead them."""
    return F.forall(F.split(s, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(s, r"\."), lambda p: F.right(p, F.lit(3)).cast("int") <= 255)


def located(text: Column, pattern: str, chunk: int = 256) -> Column:
    """start, end and string of every match, leftmost and not overlapping, in code points with the end exclusive.
    The same pattern splits the text; the lengths of gaps and matches add up to the places. They are added up in
    chunks, as an array that grows match by match would be copied each time."""
    none, empty = F.array().cast("array<int>"), F.array().cast("array<struct<start:int,end:int,string:string>>")

    def begin(acc: Column, part: Column) -> Column:
        size = F.aggregate(part, F.lit(0), lambda total, p: total + p["g"] + F.length(p["m"]))
        return F.struct((acc["at"] + size).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["g"]
        end = start + F.length(p["m"])
        return F.struct(end.alias("at"), F.array_append(acc["spans"], F.struct(start.alias("start"), end.alias("end"), p["m"].alias("string"))).alias("spans"))

    def once(value: Column, then) -> Column:
        """then of a value that is computed once, however often it is used"""
        return F.transform(F.array(value), then)[0]

    def paired(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        return F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))

    def chunked(pairs: Column) -> Column:
        first = F.sequence(F.lit(1), F.size(pairs), F.lit(chunk))
        return F.transform(first, lambda i: F.slice(pairs, i, F.lit(chunk)))

    def placed(chunks: Column) -> Column:
        starts = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), none.alias("starts")), begin)["starts"]
        return F.flatten(F.zip_with(chunks, starts, lambda part, at: F.aggregate(part, F.struct(at.alias("at"), empty.alias("spans")), step)["spans"]))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return once(found, lambda f: F.when(F.size(f) > 0, once(once(paired(f), chunked), placed)).otherwise(empty))


def _candidates(text: Column) -> Column:
    """All candidates of a text: kind, start, end, string, and whether they are base spans."""
    none = F.array().cast("array<struct<kind:int,start:int,end:int,string:string,base:boolean>>")

    def of(kind: str, needs: Column, pattern: str, base, keep) -> Column:
        spans = F.transform(located(text, pattern), lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["string"].alias("string"), base(s["string"]).alias("base")))
        return F.when(needs, F.filter(spans, lambda s: s["base"] | keep(s["string"]))).otherwise(none)

    def n(s: Column) -> Column:
        return F.length(digits_of(s))

    yes, no = (lambda s: F.lit(True)), (lambda s: F.lit(False))
    return F.concat(
        of("email", F.contains(text, F.lit("@")), EMAIL, yes, no),
        of("email", F.lower(text).contains("at]") | F.lower(text).contains("at)"), SPELLED, no, yes),
        of("ip", text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), IP, ip_ok, lambda s: F.length(s) <= 19),
        of("card", text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), CARD, lambda s: n(s).between(14, 19) & luhn(digits_of(s)), lambda s: n(s).between(13, 19)),
        of("phone", F.contains(text, F.lit("+")), PHONE, lambda s: n(s).between(10, 15), lambda s: n(s).between(8, 9)),
        of("phone", text.rlike(r"[0-9]{3}[.-][0-9]{4}"), GROUPED, no, yes),
        of("secret", text.rlike(r"[A-Za-z0-9+/_=-]{20}"), SECRET, no, yes),
    )


def _described(text: Column, c: Column) -> Column:
    """A candidate with its labelers' votes and the classifier's features; its string is kept no longer."""
    kind, s = c["kind"], c["string"]
    digits = digits_of(s)
    before = F.lower(F.substr(text, F.greatest(F.lit(1), c["start"] - CONTEXT + 1), F.least(F.lit(CONTEXT), c["start"])))
    after = F.substr(text, c["end"] + 1, F.lit(1))
    plus = s.startswith("+")

    def by_kind(email: Column, ip: Column, card: Column, phone: Column, secret: Column) -> Column:
        return F.when(kind == 0, email).when(kind == 1, ip).when(kind == 2, card).when(kind == 3, phone).otherwise(secret)

    def vote(yes: Column, otherwise: int = -1) -> Column:
        return F.when(yes, 1).otherwise(otherwise)

    first = F.regexp_extract(s, r"^0*([0-9]{1,3})", 1)
    regex = by_kind(vote(c["base"], 0), vote(c["base"]), vote(c["base"]), F.when(c["base"], 1).when(plus, -1).otherwise(0), F.when(s.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") | (s.rlike("[0-9]") & s.rlike("[a-z]") & s.rlike("[A-Z]")), 1).when(s.rlike("[/_=-].*[/_=-]"), -1).otherwise(0))
    gazetteer = by_kind(
        vote(F.lower(s).rlike(rf"(?:\.|dot[\])]\x20?)(?:{DOMAINS})$")),
        vote(first.rlike("^[0-9]{1,3}$") & ~first.isin("0", "127") & (F.lpad(first, 3, "0") < "224")),
        vote(digits.rlike("^[3-6]")),
        F.when(~plus, 0).otherwise(vote(digits.rlike(f"^(?:{COUNTRY_CODES})"))),
        F.when(before.rlike(rf"\b(?:{SECRET_NAMES})\b"), 1).otherwise(0),
    )
    cue = by_kind(*[before.rlike(rf"\b(?:{CUES[k]})\b[^a-z0-9]*$") for k in KINDS])
    left = F.when(cue | ((kind == 4) & before.rlike(r"[=:]\s*[\"']$")), 1).when(before.rlike(r"[\p{L}0-9_=#\"/.-]$"), -1).otherwise(0)
    right = F.when((after == "") | after.rlike(r"[\s,;:!?)\].\"']"), 1).otherwise(-1)
    return F.struct(
        kind.alias("kind"),
        c["start"].alias("start"),
        c["end"].alias("end"),
        c["base"].alias("base"),
        F.concat_ws("", *[F.element_at(F.array(F.lit("-"), F.lit("0"), F.lit("+")), v + 2) for v in (regex, gazetteer, left, right)]).alias("votes"),
        F.array(
            F.concat(F.lit("digits="), F.least(F.length(digits), F.lit(20)).cast("string")),
            F.concat(F.lit("marks="), F.substring(F.array_join(F.array_distinct(F.split(F.regexp_replace(s, r"[\p{L}0-9]", ""), "")), ""), 1, 4)),
            F.concat(F.lit("before="), F.when(before == "", "edge").when(before.rlike(r"\s$"), "blank").when(before.rlike(r"[\p{L}0-9]$"), "letter").otherwise("mark")),
            F.concat(F.lit("after="), F.when(after == "", "edge").when(after.rlike(r"\s"), "blank").when(after.rlike(r"[\p{L}0-9]"), "letter").otherwise("mark")),
            F.concat(F.lit("strict="), c["base"].cast("string")),
        ).alias("features"),
    )


def estimate(counts: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], list[dict[str, tuple[float, float]]]]:
    """Probability of each vote pattern, and each labeler's chance of each vote on true and on false spans.

    Dawid and Skene's model with two classes and labelers independent given the class, started from the balance
    of votes; counts are smoothed by one so that a vote never seen decides nothing for sure.
    """
    value = {"-": -1, "0": 0, "+": 1}
    belief = {p: 1 / (1 + math.exp(-1.5 * sum(value[v] for v in p))) for p in counts}
    chances: list[dict[str, tuple[float, float]]] = []
    for _ in range(rounds):
        yes = sum(n * belief[p] for p, n in counts.items())
        no = sum(n * (1 - belief[p]) for p, n in counts.items())
        chances = []
        for k in range(max(map(len, counts), default=0)):
            seen = {v: [1.0, 1.0] for v in value}
            for p, n in counts.items():
                seen[p[k]][0] += n * belief[p]
                seen[p[k]][1] += n * (1 - belief[p])
            chances.append({v: (a / (yes + 3), b / (no + 3)) for v, (a, b) in seen.items()})
        prior = math.log((yes + 1) / (no + 1))
        belief = {p: 1 / (1 + math.exp(-max(-30, min(30, prior + sum(math.log(chances[k][v][0] / chances[k][v][1]) for k, v in enumerate(p)))))) for p in counts}
    return belief, chances


def train(found: DataFrame) -> dict[str, float]:
    """Log odds by 'kind|feature', with 'kind|' for the prior. found has column spans, an array for each text.

    Only counts of vote patterns and of features return to the driver; both have a bounded number of values.
    """
    spans = found.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.features")
    counts: dict[int, dict[str, int]] = {}
    rows = spans.select("kind", "votes", F.explode(F.array_append("features", F.lit(""))).alias("feature")).groupBy("kind", "votes", "feature").agg(F.count(F.lit(1)).alias("n")).collect()
    for r in rows:
        if r["feature"] == "":
            counts.setdefault(r["kind"], {})[r["votes"]] = r["n"]
    belief = {k: estimate(c)[0] for k, c in counts.items()}
    soft: dict[tuple[int, str], list[float]] = {}
    for r in rows:
        p = belief[r["kind"]][r["votes"]]
        pair = soft.setdefault((r["kind"], r["feature"]), [0.0, 0.0])
        pair[0] += r["n"] * p
        pair[1] += r["n"] * (1 - p)
    odds = {}
    for (kind, feature), (yes, no) in soft.items():
        total = soft[kind, ""]
        odds[f"{kind}|{feature}"] = math.log((yes + 1) / (no + 1)) if not feature else math.log((yes + 1) / (total[0] + 2)) - math.log((no + 1) / (total[1] + 2))
    return odds


def find_pii(docs: DataFrame, *, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans, base_spans for every row of docs: arrays of kind, start, end by start, then kind.

    Texts are searched whole, very long ones too; null counts as empty and has no spans, nor has an empty table any
    rows. Rows are treated one by one, repeated or not; null ids stay. Other columns are not read.
    """
    text = F.col("text")
    found = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).select("doc_id", F.transform(_candidates(text), lambda c: _described(text, c)).alias("spans"))
    found = materialize(found, "candidates")
    odds = train(found)
    table = F.create_map(*[F.lit(x) for pair in odds.items() for x in pair]) if odds else F.create_map(F.lit(""), F.lit(0.0))

    def accepted(s: Column) -> Column:
        keys = F.transform(F.array_append(s["features"], F.lit("")), lambda f: F.concat(s["kind"].cast("string"), F.lit("|"), f))
        score = F.aggregate(keys, F.lit(0.0), lambda total, k: total + F.coalesce(F.try_element_at(table, k), F.lit(0.0)))
        return s["base"] | (score >= math.log(threshold / (1 - threshold)))

    def placed(spans: Column) -> Column:
        return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))

    base = placed(F.filter("spans", lambda s: s["base"]))
    return found.select("doc_id", F.array_distinct(placed(F.filter("spans", accepted))).alias("spans"), base.alias("base_spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of base spans, all spans as text, and their number."""

    def count(kind: int) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:BASE_KINDS])]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), F.size(F.filter("spans", lambda s: s["kind"] == BASE_KINDS)).cast("long").alias("n_secret"))
