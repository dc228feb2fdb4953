"""Operator 9: personal data by weak supervision, by SQL functions alone on the corpus.

Patterns propose spans. A format labeler, a gazetteer labeler and a context labeler vote on each
(1 personal, -1 not, 0 abstains). Spans are counted by their votes and features; the table of counts
has at most ``3^3 * features`` rows whatever the corpus, and expectation-maximisation over it gives
the labelers' reliabilities and each vote pattern's posterior. A naive Bayes span classifier is then
trained on those posteriors and decides over the added kinds; spans of the base kinds always stay.

Defined cases: a null text is empty; rows with equal ids are rows of their own; where no span is
found nothing is trained and nothing added; a very long text is one row and must fit a task; ``detect``
gives its id and spans alone and ``redact`` keeps all columns, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, gathered, once, table, text_of
from tessera.llm.spans import free_of, listed, matches

#: Dots between label characters and separators between digits are marked by these, so that a run is one character class and no group is repeated.
SEP, DOT, OTHER = "\x01", "\x02", "\x03"
LOCAL = rf"A-Za-z0-9._%+{DOT}-"
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]+{DOT}[A-Za-z0-9{DOT}-]*",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)",
    "card": rf"[0-9][0-9{SEP}]+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ADDED = {
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "person": r"(?<![\p{L}])(?!(?:Dear|Signed|Contact|Author)\x20)(?:(?:Mr|Mrs|Ms|Dr|Prof)\.\x20)?\p{Lu}\p{Ll}{1,20}\x20\p{Lu}\p{Ll}{1,20}(?![\p{L}])",
}
KINDS = [*BASE, *ADDED]
#: Given names, and the words near personal data.
GIVEN_NAMES = ["James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda", "David", "Elizabeth", "William", "Barbara", "Richard", "Susan", "Joseph", "Jessica", "Thomas", "Sarah", "Charles", "Karen", "Maria", "Anna", "Peter", "Paul", "Hans", "Marie", "Pierre", "Jean", "Carlos", "Juan", "Jose", "Luis"]
TITLES = r"^(?:Mr|Mrs|Ms|Dr|Prof)\."
PROVIDERS = r"(?i)@(?:gmail|yahoo|hotmail|outlook|mail|example)[.]|[.](?:com|org|net|edu|gov|de|fr|es)$"
CUES = {
    "email": "mail|contact|write|@",
    "ip": r"\bip\b|addr|host|server",
    "card": "card|visa|credit|pay|iban",
    "phone": "phone|tel|call|mobile|fax|contact",
    "ssn": "ssn|social|security",
    "iban": "iban|account|bank",
    "person": "name|dear|from|by|signed|contact|author",
}
#: What stands right before a name that isn't known.
INTRODUCED = r"(?i)(?:\b(?:full\s)?name\s*[:=]|\bdear|\bsigned\s*[:,]|\bsincerely,|\bregards,|\bcontact\s*:|\bauthor\s*:)\s{0,3}$"
#: The beginnings of card numbers by issuer, country calling codes, and country codes of bank accounts.
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
CALLING_CODES = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
BANK_COUNTRIES = "^(?:AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK)"
CONTEXT, MAX_ROUNDS = 40, 50


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(number), i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(number)), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    n = F.char_length(digits(value))
    if kind == "ip":  # a part of up to three digits after its zeros
        part = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def votes(kind: str, value: Column, before: Column) -> dict[str, Column]:
    """The labelers' votes on one span."""
    vote = lambda yes, no=F.lit(False): F.when(yes, 1).when(no, -1).otherwise(0)
    form = {
        "email": vote(value.rlike(r"\.[A-Za-z]{2,8}$"), value.rlike(r"\.[0-9]+$")),
        "ip": vote(~value.rlike(r"(^|\.)0[0-9]"), value.rlike(r"^0|^127\.|^255\.")),
        "card": vote(value.rlike("^[3-6]"), value.rlike("^0")),
        "phone": vote(value.rlike(r"^\+[1-9]"), value.rlike(r"^\+0")),
        "ssn": vote(~value.rlike("^(000|666|9)|-00-|-0000$"), value.rlike("^(000|666|9)|-00-|-0000$")),
        "iban": vote(F.char_length(value).between(15, 34) & value.rlike("[0-9]{6}"), ~value.rlike("[0-9]{6}")),
        "person": vote(value.rlike(TITLES), value.rlike(r"^(?:The|This|That|These|And|But|For|With|From|New|United)\x20")),
    }[kind]
    gazetteer = {
        "email": vote(value.rlike(PROVIDERS)),
        "ip": vote(F.lit(False), value.rlike(r"^(10|192\.168)\.")),
        "card": vote(value.rlike(ISSUERS), ~value.rlike(ISSUERS)),
        "phone": vote(value.rlike(CALLING_CODES), ~value.rlike(CALLING_CODES)),
        "iban": vote(value.rlike(BANK_COUNTRIES), ~value.rlike(BANK_COUNTRIES)),
        # a name that the list doesn't hold may be one all the same
        "person": vote(F.regexp_replace(value, r"^\w+\.\x20", "").rlike(rf"^(?:{'|'.join(GIVEN_NAMES)})\x20")),
    }.get(kind, F.lit(0))
    context = vote(before.rlike(f"(?i)(?:{CUES[kind]})[^\\n]{{0,15}}$"), before.rlike(r"[0-9]\.?\x20?$") if kind != "person" else before.rlike(r"[.!?]\s*$"))
    return {"form": form, "gazetteer": gazetteer, "context": context}


def features(kind: str, value: Column, before: Column) -> list[Column]:
    """The classifier's features, a few values each."""
    n = F.char_length(value)
    return [
        F.lit(kind),
        F.concat(F.lit(kind), F.when(n < 12, "s").when(n < 20, "m").otherwise("l")),
        F.concat(F.lit(kind), F.when(before == "", "start").when(before.rlike(r"\s$"), "space").when(before.rlike(r"[\p{L}0-9]$"), "word").otherwise("mark")),
        F.concat(F.lit(kind), F.when(before.rlike(r"[:=]\s*$"), "colon").otherwise("none")),
    ]


def candidates(text: Column) -> Column:
    """Proposed spans: array of struct<start, order, kind, end, base, votes, features>, by start and kind."""
    plain = F.translate(text, SEP + DOT, OTHER + OTHER)
    views = {
        "email": F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT),
        "card": F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", SEP),
    }

    def kind(name: str, pattern: str) -> Column:
        found = matches(views.get(name, plain), pattern, CONTEXT)
        restored = lambda s: F.translate(s["value"], SEP + DOT, " .")
        found = F.filter(found, lambda s: valid(name, restored(s)))
        if name == "person":  # where a title, a known name or what introduces it proposes it: two capitalised words alone are prose
            found = F.filter(found, lambda s: s["value"].rlike(TITLES) | s["value"].rlike(rf"^(?:{'|'.join(GIVEN_NAMES)})\x20") | s["before"].rlike(INTRODUCED))
        return F.transform(
            found,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(KINDS.index(name)).alias("order"), F.lit(name).alias("kind"), s["end"].alias("end"), F.lit(name in BASE).alias("base"),
                F.array(*(v.cast("int") for v in votes(name, restored(s), s["before"]).values())).alias("votes"), F.array(*features(name, restored(s), s["before"])).alias("features"),
            ),
        )

    base = F.concat(*(kind(k, p) for k, p in BASE.items()))
    more = F.concat(*(kind(k, p) for k, p in ADDED.items()))
    both = F.transform(
        F.array(F.struct(base.alias("base"), more.alias("more"))),
        lambda x: F.sort_array(F.concat(x["base"], F.filter(x["more"], lambda s: free_of(s, x["base"]) & ~F.exists(x["more"], lambda o: (o["order"] < s["order"]) & (o["start"] < s["end"]) & (s["start"] < o["end"]))))),
    )
    return both[0]


def learn(counts: list[tuple[tuple[int, ...], tuple[str, ...], int]]) -> tuple[float, dict[str, float], list[dict[int, tuple[float, float]]]]:
    """From (votes, features, number of spans): the classifier's bias and weights, and each labeler's likelihood of a vote under (not personal, personal)."""
    if not counts:
        return 0.0, {}, []
    labelers = range(len(counts[0][0]))
    belief = {v: 1 / (1 + math.exp(-sum(v))) for v, _, _ in counts}
    reliability: list[dict[int, tuple[float, float]]] = []
    for _ in range(MAX_ROUNDS):
        yes = sum(n * belief[v] for v, _, n in counts)
        total = sum(n for _, _, n in counts)
        prior = (yes + 1) / (total + 2)
        reliability = []
        for i in labelers:
            seen = {k: [1.0, 1.0] for k in (-1, 0, 1)}
            seen[1][1] += 2  # a labeler is taken to be better than chance until the spans say otherwise
            seen[-1][0] += 2
            for v, _, n in counts:
                seen[v[i]][0] += n * (1 - belief[v])
                seen[v[i]][1] += n * belief[v]
            no_all, yes_all = sum(x[0] for x in seen.values()), sum(x[1] for x in seen.values())
            reliability.append({k: (x[0] / no_all, x[1] / yes_all) for k, x in seen.items()})
        after = {v: 1 / (1 + math.exp(-max(-500, min(500, math.log(prior / (1 - prior)) + sum(math.log(reliability[i][v[i]][1] / reliability[i][v[i]][0]) for i in labelers))))) for v in belief}
        moved, belief = max(abs(after[v] - belief[v]) for v in belief), after
        if moved < 1e-6:
            break
    yes = sum(n * belief[v] for v, _, n in counts)
    no = sum(n for _, _, n in counts) - yes
    weights: dict[str, list[float]] = {}
    for v, fs, n in counts:
        for f in [*fs, *(f"vote{i}:{x}" for i, x in enumerate(v))]:
            w = weights.setdefault(f, [0.0, 0.0])
            w[0] += n * (1 - belief[v])
            w[1] += n * belief[v]
    return math.log((yes + 1) / (no + 1)), {f: math.log((w[1] + 1) / (yes + 2)) - math.log((w[0] + 1) / (no + 2)) for f, w in weights.items()}, reliability


def chooser(found: DataFrame, spans: str):
    """From a column of candidates: the function that keeps of a row's candidates the base ones and those that the trained classifier takes."""
    # at most 3^labelers times the features' combinations of rows, whatever the corpus
    counts = found.select(F.explode(spans).alias("s")).groupBy("s.votes", "s.features").agg(F.count(F.lit(1)).alias("n")).collect()
    bias, weights, _ = learn(sorted((tuple(r["votes"]), tuple(r["features"]), r["n"]) for r in counts))
    table_of = F.create_map(*(F.lit(x) for pair in sorted(weights.items()) for x in pair)) if weights else F.create_map(F.lit(""), F.lit(0.0))

    def score(s: Column) -> Column:
        named = F.concat(s["features"], F.transform(s["votes"], lambda v, i: F.concat(F.lit("vote"), i.cast("string"), F.lit(":"), v.cast("string"))))
        return F.aggregate(named, F.lit(bias), lambda total, f: total + F.coalesce(F.try_element_at(table_of, f), F.lit(0.0)))

    def choose(candidates_: Column) -> Column:
        taken = F.filter(candidates_, lambda s: s["base"] | (score(s) > 0))
        return F.transform(taken, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base")))

    return choose


def detect(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each text: doc and spans, array of struct<start, order, kind, end, base>."""
    read = checkpointed(df.select(F.col(doc), text_of(text).alias("_text")).select(doc, candidates(F.col("_text")).alias("_found")))
    return read.select(doc, chooser(read, "_found")(F.col("_found")).alias("spans"))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with each span of its texts replaced by its kind in brackets; texts without spans are as they were."""
    t = text_of(text)
    choose = chooser(df.select(candidates(t).alias("_found")), "_found")

    def masked(spans: Column) -> Column:
        def step(at: Column, s: Column) -> tuple:
            fresh = F.concat(F.substring(t, at + 1, s["start"] - at), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.greatest(at, s["end"]), fresh, s["start"] >= at  # a span that overlaps the one before is part of its mask

        return once(gathered(spans, "string", step), lambda done: F.concat(F.array_join(done["found"], ""), F.substring(t, done["at"] + 1, F.char_length(t))))

    return df.withColumn(text, F.transform(F.array(choose(candidates(t))), lambda spans: F.when(F.size(spans) > 0, masked(spans)).otherwise(F.col(text)))[0])


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = detect(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *(F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
