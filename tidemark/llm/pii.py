"""Operator 6: personal data by weak supervision, with DataFrame operations only.

Patterns propose candidate spans: the four base kinds, which stay when they pass their test, and five kinds of the
method's own, proposed broadly: every long run of letters and digits may be a secret, every long number an account,
every pair of capitalised words a name. Four labelers vote on each candidate, for or against: its shape (regular
expressions and check digits), gazetteers (issuers, networks, digest sizes, key prefixes, given names), the words before
it, and its edges. The votes of the whole corpus are counted by kind and pattern, a table of bounded size;
expectation-maximisation over it estimates for each kind how reliable each labeler is and how likely each pattern is to
be personal data, and these posteriors train the final span classifier, a logistic model whose weights become SQL
literals. What it turns down isn't a span.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

# Patterns. Those of the base kinds match what the plain patterns match; look-behinds and possessive
# repeats only keep a long run of letters or digits from being tried from each of its places.
BASE = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z\p{L}_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[0-9A-Za-z_+/-]{16,}+(?!\p{L})",
    "local_phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "hidden_email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?[\[({]\x20?at\x20?[\])}]\x20?[a-z0-9-]++(?:\x20?(?:[\[({]\x20?dot\x20?[\])}]|\.)\x20?[a-z0-9-]++)++",
    "name": r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++){1,2}+(?![\p{L}\p{N}])",
}
#: Kinds in the order of the output; account: a run of digits as for a card that fails the card's test.
KINDS = (*BASE, "secret", "account", "local_phone", "hidden_email", "name")
#: A text without this can't have the kind; spares the longer pattern.
HINTS = {"hidden_email": r"(?i)[\[({]\x20?at\x20?[\])}]", "email": "@", "phone": r"\+[0-9]"}

# Gazetteers and context words.
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
RESERVED_IPS = r"^(?:0|10|127|169\.254|192\.168|255|172\.(?:1[6-9]|2[0-9]|3[01]))\."
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|62)"
COUNTRY_CODES = r"^\+(?:1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
MAIL_HOSTS = r"(?i)@.*(?:mail|example|yahoo|outlook|proton|icloud|web|online)"
DIGEST_SIZES = (32, 40, 56, 64, 96, 128)
KEY_PREFIXES = r"^(?:AKIA|ASIA|AIza|eyJ|gh[opsu]_|glpat-|sk[_-]|pk[_-]|xox[abp]-)"
GIVEN_NAMES = (
    "Adam Alice Andrew Anna Anne Anthony Barbara Charles Christopher Daniel David Elizabeth Emily Emma George Helen Henry Jack James Jennifer Jessica John "
    "Joseph Karen Kevin Laura Linda Lisa Margaret Mark Mary Michael Nancy Oliver Patricia Paul Peter Richard Robert Sarah Susan Thomas William "
    "Andreas Claudia Dieter Erika Frank Gabriele Günter Hans Heike Jürgen Karl Katharina Klaus Manfred Markus Monika Petra Sabine Stefan Ursula Uwe Wolfgang "
    "André Antoine Camille Céline Claire Élise François Françoise Guillaume Hélène Henri Isabelle Jacques Jean Julien Louis Luc Marie Michel Nathalie Nicolas Philippe Pierre Sophie "
    "Alejandro Ana Antonio Carlos Carmen Diego Elena Fernando Francisco Isabel Javier Jorge José Juan Lucía Luis Manuel María Miguel Pablo Pedro Rafael Rosa Sofía Teresa"
)
PERSON_CUES = r"(?:\bmr|\bmrs|\bms|\bdr|\bprof|\bherr|\bfrau|\bseñora?|\bsra?|\bmonsieur|\bmadame|\bmme|\bname|\bnom|\bnombre|\bnamens|\bauthor|\bautor|\bauteur|\bsigned|\bcontact|\bkontakt|\bdear|\bi am|\bmy name is)\W{0,3}$"
CUES = r"(?:tel|fon|phone|call|mobil|fax|mail|contact|kontakt|correo|ip|server|host|card|visa|kredit|credit|account|iban|konto|cuenta|compte|token|secret|key|password|passw|pwd|auth)\W*\w{0,3}\W*$"
OTHER_CUES = r"(?:version|release|licen[cs]e|isbn|issn|doi|chapter|section|page|fig|table|sha1?|sha256|md5|commit|digest|checksum|build|serial|part|order|figure|volume|under the)\W{0,3}$"

#: Characters before a span that the context labeler reads.
BEFORE = 24
#: Spans of a text that are placed at once; keeps the work nearly linear in their number.
AT_ONCE = 128


SPAN = "array<struct<start: int, end: int, value: string, before: string, after: string>>"


def places(pieces: Column, found: Column) -> Column:
    """(start, end, value, before, after) of matches, in code points, from the pieces between them.

    before: the end of the piece before the match, with the match before that; after: the next character. Both come from
    the pieces, as reading at a place of a long text costs as much as the way there.
    """
    count = F.size(found)
    gaps = F.zip_with(F.slice(pieces, 1, count), found, lambda p, v: F.struct(F.length(p).alias("gap"), v.alias("value"), F.substring(p, -BEFORE, BEFORE).alias("before")))
    earlier = F.concat(F.array(F.lit("")), F.slice(found, 1, count - 1))
    gaps = F.zip_with(gaps, earlier, lambda g, v: F.struct(g["gap"].alias("gap"), g["value"].alias("value"), F.lower(F.substring(F.concat(F.substring(v, -BEFORE, BEFORE), g["before"]), -BEFORE, BEFORE)).alias("before")))
    gaps = F.zip_with(gaps, F.slice(pieces, 2, count), lambda g, p: F.struct(g["gap"].alias("gap"), g["value"].alias("value"), g["before"].alias("before"), F.substring(p, 1, 1).alias("after")))
    # gaps is bound to a variable: an expression inside a lambda is worked out again for each element
    parts = F.transform(F.array(gaps), lambda g: F.transform(F.sequence(F.lit(0), F.floor((count - 1) / AT_ONCE).cast("int")), lambda k: F.slice(g, k * AT_ONCE + 1, F.lit(AT_ONCE))))[0]
    none = F.expr(f"cast(array() as {SPAN})")
    one = lambda at, x: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + F.length(x["value"])).alias("end"), *[x[n].alias(n) for n in ("value", "before", "after")])
    inner = lambda part, at: F.aggregate(
        part, F.struct(at.alias("at"), none.alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["gap"] + F.length(x["value"])).alias("at"), F.concat(acc["out"], F.array(one(acc["at"], x))).alias("out")),
    )
    outer = F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.array(none).alias("out")),
        lambda acc, part: F.transform(F.array(inner(part, acc["at"])), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))[0],
    )
    return F.when(count > 0, F.flatten(outer["out"])).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(number)
    digit = lambda i: F.ascii(F.substring(turned, i, F.lit(1))) - 48
    worth = lambda i: F.when(i % 2 == 0, F.when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2)).otherwise(digit(i))
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The test of a base kind."""
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits(value)).between(16, 19) & luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def votes(kind: Column, value: Column, before: Column, after: Column) -> Column:
    """The four votes on a candidate as signs: + for personal data, - against it, 0 for none."""
    sign = lambda good, bad=None: F.when(good, "+").otherwise(F.lit("0") if bad is None else F.when(bad, "-").otherwise("0"))
    number = digits(value)
    first, second = F.substring_index(value, " ", 1), F.regexp_extract(value, r"\x20(\S+)", 1)
    shape = (
        F.when(kind.isin("email", "hidden_email"), sign(value.rlike(r"(?i)[a-z]{2,24}$"), F.lit(True)))
        .when(kind == "ip", sign(value.rlike(r"^(?:[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$"), F.lit(True)))
        .when(kind == "card", F.lit("+"))
        .when(kind == "account", sign(F.length(number).isin(13, 15, 16, 19), F.lit(True)))
        .when(kind == "phone", sign(F.length(number).between(10, 13)))
        .when(kind == "secret", sign(value.rlike("^[0-9a-f]{20,}$|^[0-9A-F]{20,}$") | value.rlike("[0-9].*[0-9].*[0-9]") & value.rlike("[a-z].*[a-z].*[a-z]") & value.rlike("[A-Z].*[A-Z].*[A-Z]"), F.lit(True)))
        .when(kind == "local_phone", sign(value.rlike(r"^\(?[2-9]"), F.lit(True)))
        .when(kind == "name", F.when((first == second) | (F.length(first) < 3) | (F.length(second) < 3), "-").otherwise("0"))
        .otherwise(F.lit("+"))
    )
    listed = (
        F.when(kind.isin("email", "hidden_email"), sign(value.rlike(MAIL_HOSTS)))
        .when(kind == "ip", sign(~value.rlike(RESERVED_IPS), F.lit(True)))
        .when(kind.isin("card", "account"), sign(number.rlike(ISSUERS) & (F.length(number) > 12), kind == "account"))
        .when(kind == "phone", sign(value.rlike(COUNTRY_CODES)))
        .when(kind == "secret", sign(value.rlike(KEY_PREFIXES) | F.length(value).isin(*DIGEST_SIZES) & value.rlike("^[0-9A-Fa-f]+$"), F.lit(True)))
        .when(kind == "name", sign(first.isin(*GIVEN_NAMES.split()), F.lit(True)))
        .otherwise(F.lit("0"))
    )
    context = F.when(kind == "name", sign(before.rlike(PERSON_CUES), before.rlike(OTHER_CUES))).otherwise(sign(before.rlike(CUES), before.rlike(OTHER_CUES)))
    edges = sign(before.rlike(r"(?:^|[\s\"'(\[<:=,;|])$") & after.rlike(r"^(?:$|[\s\"')\]>,;|.!?*#$%&])"), before.rlike(r"[0-9A-Za-z]$") | after.rlike(r"^[0-9A-Za-z]"))
    # two capitalised words that begin a sentence, or stand in a row of such words, are seldom a name
    edges = F.when(kind == "name", F.when(before.rlike(r"(?:^|[.!?]\s)$") | before.rlike(r"\n$"), "-").otherwise("0")).otherwise(edges)
    return F.concat(shape, listed, context, edges)


CANDIDATE = "array<struct<kind: string, start: int, end: int, base: boolean, votes: string, size: int>>"


def candidates(docs: DataFrame, text_col: str, carry: Sequence[str | Column]) -> DataFrame:
    """carried (a struct of columns), pii_text, and found: the candidate spans of each text, by kind as listed and start."""
    rows = docs.select(F.struct(*carry).alias("carried"), F.col(text_col).alias("pii_text"))
    text = F.coalesce(F.col("pii_text"), F.lit(""))
    rows = rows.withColumns({
        f"m_{k}": F.when(text.rlike(HINTS[k]), F.regexp_extract_all(text, F.lit(p), F.lit(0))) if k in HINTS else F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in PATTERNS.items()
    })
    rows = rows.withColumns({f"p_{k}": F.when(F.size(f"m_{k}") > 0, F.split(text, p, -1)) for k, p in PATTERNS.items()})
    none = F.expr(f"cast(array() as {SPAN})")
    rows = rows.withColumns({f"s_{k}": F.coalesce(F.when(F.size(f"m_{k}") > 0, places(F.col(f"p_{k}"), F.col(f"m_{k}"))), none) for k in PATTERNS})

    def of(kind: str) -> Column:
        spans = F.col(f"s_{'card' if kind == 'account' else kind}")
        if kind in BASE:
            spans = F.filter(spans, lambda s: passes(kind, s["value"]))
        elif kind == "account":
            spans = F.filter(spans, lambda s: F.length(digits(s["value"])).between(9, 19) & ~passes("card", s["value"]))
        else:
            spans = F.filter(spans, lambda s: F.lit(True))
        if kind not in BASE:
            taken = F.concat(*[F.col(f"b_{k}") for k in BASE])
            spans = F.filter(spans, lambda s: ~F.exists(taken, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        voted = lambda s: votes(F.lit(kind), s["value"], s["before"], s["after"])
        return F.transform(
            spans,
            lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind in BASE).alias("base"), voted(s).alias("votes"), F.least((s["end"] - s["start"]) / 8, F.lit(8)).cast("int").alias("size")),
        )

    rows = rows.withColumns({f"b_{k}": of(k) for k in BASE})
    found = F.concat(*[F.col(f"b_{k}") if k in BASE else of(k) for k in KINDS]).cast(CANDIDATE)
    return rows.withColumn("found", found).drop(*[f"{x}_{k}" for x in "mps" for k in PATTERNS], *[f"b_{k}" for k in BASE])


Pattern = tuple[str, str, int]  # kind, votes, size


#: What is assumed before any vote, in candidates of each kind: a labeler is right four times in five.
ASSUMED, RIGHT = 10.0, 0.8
#: (personal data, candidates) that each kind is assumed to begin with: names are proposed so broadly that few are any.
SHARES = {"name": (1.0, 20.0)}
USUAL_SHARE = (5.0, 10.0)


def posteriors(counts: dict[Pattern, int], rounds: int = 50) -> dict[tuple[str, str], float]:
    """P(personal data) of each kind and votes, by expectation-maximisation over the labelers' reliabilities.

    A labeler says + or - with a chance that depends on the kind and the truth alone; its silence says nothing. Each
    kind has a share of personal data of its own. The first guess is the part of + votes.
    """
    seen: dict[tuple[str, str], int] = {}
    for (kind, signs, _), n in counts.items():
        seen[kind, signs] = seen.get((kind, signs), 0) + n
    said = lambda s: [x for x in s if x != "0"]
    truth = {k: (sum(x == "+" for x in k[1]) + 0.5) / (len(said(k[1])) + 1) for k in seen}
    for _ in range(rounds):
        plus: dict[tuple[str, int], list[float]] = {}
        both: dict[tuple[str, int], list[float]] = {}
        share: dict[str, list[float]] = {}
        for (kind, signs), n in seen.items():
            p = truth[kind, signs]
            total = share.setdefault(kind, list(SHARES.get(kind, USUAL_SHARE)))
            total[0], total[1] = total[0] + n * p, total[1] + n
            for t, weight in ((1, p), (0, 1 - p)):
                said_plus = plus.setdefault((kind, t), [ASSUMED * (RIGHT if t else 1 - RIGHT)] * 4)
                said_any = both.setdefault((kind, t), [ASSUMED] * 4)
                for j, x in enumerate(signs):
                    if x != "0":
                        said_any[j] += n * weight
                        said_plus[j] += n * weight * (x == "+")
        for kind, signs in truth:
            odds = math.log(share[kind][0]) - math.log(share[kind][1] - share[kind][0])
            for j, x in enumerate(signs):
                if x != "0":
                    chance = [plus[kind, t][j] / both[kind, t][j] for t in (0, 1)]
                    odds += math.log(chance[1] if x == "+" else 1 - chance[1]) - math.log(chance[0] if x == "+" else 1 - chance[0])
            truth[kind, signs] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return truth


def features(pattern: Pattern) -> list[str]:
    kind, signs, size = pattern
    return ["bias", kind, f"size={size}", *(f"{kind}:{j}{x}" for j, x in enumerate(signs) if x != "0")]


def trained(counts: dict[Pattern, int], truth: dict[tuple[str, str], float], steps: int = 500) -> dict[str, float]:
    """Weights of a logistic model of the posteriors, by gradient steps over the counted patterns."""
    weights = {f: 0.0 for p in counts for f in features(p)}
    # kinds weigh alike, whatever their numbers: a pattern by its part of its kind
    of_kind: dict[str, int] = {}
    for (kind, _, _), n in counts.items():
        of_kind[kind] = of_kind.get(kind, 0) + n
    past = dict.fromkeys(weights, 1e-6)
    for _ in range(steps):
        slope = {f: 1e-4 * w for f, w in weights.items()}
        for p, n in counts.items():
            z = sum(weights[f] for f in features(p))
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - truth[p[0], p[1]]) * n / of_kind[p[0]]
            for f in features(p):
                slope[f] += error
        for f, g in slope.items():
            past[f] += g * g
            weights[f] -= 0.3 * g / math.sqrt(past[f])
    return weights


def classifier(found: DataFrame) -> dict[str, float]:
    """The span classifier's weights from the votes of all candidates of the corpus."""
    spans = found.select(F.explode("found").alias("s")).groupBy("s.kind", "s.votes", "s.size").count()
    counts = {(kind, signs, size): n for kind, signs, size, n in sorted(spans.collect())}
    return trained(counts, posteriors(counts)) if counts else {}


def accepted(weights: dict[str, float]) -> Column:
    """The base spans, and those of the method's own that the classifier accepts."""
    weight = lambda name: F.lit(float(weights.get(name, 0.0)))

    def keep(s: Column) -> Column:
        z = F.lit(0.0)
        for kind in KINDS[len(BASE) :]:
            own = weight(kind)
            for j in range(4):
                vote = F.substring(s["votes"], j + 1, 1)
                own = own + F.when(vote == "+", weight(f"{kind}:{j}+")).when(vote == "-", weight(f"{kind}:{j}-")).otherwise(0.0)
            z = F.when(s["kind"] == kind, own).otherwise(z)
        for size in range(9):
            z = z + F.when(s["size"] == size, weight(f"size={size}")).otherwise(0.0)
        return s["base"] | (z + weight("bias") > 0)

    return F.filter("found", keep)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and base_sha256 are of the base spans; spans lists all, as kind:start:end in code points, by kind in the
    order of KINDS and then start. An added span never overlaps a base one. A null or empty text has no spans; repeated
    rows each give a row; a null id stays null. An empty table gives no rows and other columns are ignored.
    """
    found = candidates(docs, text_col, [id_col]).drop("pii_text")
    found = stored(found, "pii-candidates", waves=4)
    base = F.filter("found", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("carried")[id_col].cast("long").alias("doc_id"), *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(accepted(classifier(found))).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with each span of personal data replaced by its kind in capitals and brackets; n_chars follows.

    Spans that overlap give one replacement, named after the first. A null text stays null and an empty one empty;
    repeated rows each stay; null ids and further columns of any name stay as they are. An empty table gives no rows.
    """
    columns = docs.columns
    found = stored(candidates(docs, "text", [c for c in columns if c != "text"] or [F.lit(0).alias("none")]), "pii-candidates", waves=4)
    text = F.col("pii_text")
    ordered = F.array_sort(F.transform(accepted(classifier(found)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    cut = F.aggregate(
        ordered, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out"))
        ),
    )
    rows = found.withColumn("cut", F.when(F.size("found") > 0, cut))
    rows = rows.withColumn("clean", F.when(F.size("found") > 0, F.concat(F.array_join("cut.out", ""), F.substring(text, F.col("cut.at") + 1, F.length(text)))).otherwise(text))
    own = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long") if "n_chars" not in columns else F.coalesce(F.length("clean").cast("long"), F.col("carried.n_chars").cast("long"))}
    return rows.select(*[own[c].alias(c) if c in own else F.col("carried")[c].alias(c) for c in columns])
