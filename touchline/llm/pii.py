"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier of spans decides.

Base spans (e-mail, IP, payment card, phone) are exact rules and always stay. Further candidates come from looser
patterns. Every candidate, base ones included, gets the votes of five labelers: the strict rule, a gazetteer, cue words
around it, its shape and its borders; each says yes, no or nothing. Expectation-maximisation over the counts of vote
patterns estimates each labeler's reliability and the probability of each pattern. A logistic classifier of kind and
votes is trained on those probabilities, over all candidates, and admits further spans from one half on. Numbers that
only fail the card checksum are candidates for the estimation; they are never admitted.

Only built-in functions touch the texts. The driver sees vote patterns with their counts, at most KINDS * 3**5 rows.

Defined cases: null text is empty text without spans; further spans never overlap a base span or each other; rows with one
id are judged alone; without candidates, or in an empty table, nothing is fitted and nothing added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm import spans as S
from touchline.llm.common import table, texts
from touchline.session import written

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: (kind, pattern, substring that each match has). A run of a mail's first characters is tried from its start only.
BASE = [
    ("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "."),
    ("card", r"[0-9](?:[ -]?[0-9])++", None),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+"),
]
#: Looser patterns for the labelers to judge.
LOOSE = [
    ("email", rf"(?<!{_LOCAL}){_LOCAL}++ ?[\[(](?:at|AT)[\])] ?{_LABEL}++(?: ?[\[(](?:dot|DOT)[\])] ?{_LABEL}++)++", None),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", ":"),
    ("phone", r"(?<![0-9+)(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])", None),
    ("id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
    ("name", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Sra|Mme)\.? [A-Z][a-z]++(?: [A-Z][a-z]++)?", None),
]
LOOSE_RANK = 10
KINDS = ["email", "ip", "card", "phone", "id", "name"]
LABELERS = ["rule", "gazetteer", "context", "shape", "border"]
_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
CUES = {
    "email": "mail|contact|write|schreib|correo|courriel", "ip": "ip|host|server|address|adresse|login", "card": "card|visa|credit|pay|karte|tarjeta|carte",
    "phone": "call|phone|tel|fax|mobil|handy|whatsapp", "id": "ssn|social|insurance|id", "name": "dear|name|signed|regards|hola|liebe|cher",
}
TOP_DOMAINS = "com|org|net|edu|gov|io|info|de|fr|es|uk|eu|us|co|ch|at|it"
GIVEN_NAMES = "James|Mary|John|Anna|Maria|Peter|Paul|Laura|Hans|Marie|Jean|Carlos|Juan|Sofia|Emma|Lucas|David|Sarah|Thomas|Julia"
CONTEXT = 40


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    back = F.reverse(_digits(v))

    def add(acc, i):
        x = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    fits = F.length(back).between(14, 19)
    return fits & (F.aggregate(F.when(fits, F.sequence(F.lit(1), F.length(back))).otherwise(F.array().cast("array<int>")), F.lit(0), add) % 10 == 0)


#: What a match of a base pattern must be; other matches are dropped.
HOLDS = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: F.regexp_like(s["value"], F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$")),
    "card": lambda s: _luhn(s["value"]),
    "phone": lambda s: F.length(_digits(s["value"])).between(10, 15),
}


def found(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its base spans, and all candidates with the text around them."""
    text = F.col("text")
    df = texts(docs, id_col, text_col)
    for rank, (kind, pattern, sub) in enumerate(BASE):
        df = df.withColumn(f"_b{rank}", S.find_spans(text, pattern, kind, rank, F.contains(text, F.lit(sub)) if sub else None))
    good = [F.filter(f"_b{k}", HOLDS[kind]) for k, (kind, _, _) in enumerate(BASE)]
    df = df.withColumn("base", F.array_sort(F.concat(*good)))
    # Card-like numbers that fail the checksum help to judge the labelers, but are never admitted.
    near = F.filter("_b2", lambda s: F.length(_digits(s["value"])).between(14, 19) & ~_luhn(s["value"]))
    loose = [S.find_spans(text, pattern, kind, LOOSE_RANK + k, F.contains(text, F.lit(sub)) if sub else None) for k, (kind, pattern, sub) in enumerate(LOOSE)]
    df = df.withColumn("_loose", F.concat(near, *loose)).withColumn("loose", S.without_overlaps(S.apart(F.col("_loose"), F.col("base"))))

    def around(s, strict):
        left = F.greatest(s["start"] - CONTEXT, F.lit(0))
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), s["value"].alias("value"),
                        F.lit(strict).alias("strict"), F.substring(text, left + 1, s["start"] - left).alias("left"),
                        F.substring(text, s["end"] + 1, F.lit(CONTEXT)).alias("right"))

    both = F.concat(F.transform("base", lambda s: around(s, True)), F.transform("loose", lambda s: around(s, False)))
    return df.select("doc_id", "base", F.when((F.size("base") > 0) | (F.size("loose") > 0), both).alias("candidates"))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(c: Column) -> dict[str, Column]:
    """1 yes, -1 no, 0 nothing, by labeler."""
    v, kind, digits = c["value"], c["kind"], F.length(_digits(c["value"]))
    cue = F.lit(False)
    for k in KINDS:
        near = F.lower(F.concat_ws(" ", c["left"], c["right"]))
        cue = cue | ((kind == k) & F.regexp_like(near, F.lit(rf"\b(?:{CUES[k]})")))
    listed = F.when(kind == "email", F.regexp_like(v, F.lit(rf"\.(?:{TOP_DOMAINS})$"))).when(kind == "card", F.regexp_like(v, F.lit("^[3-6]"))) \
        .when(kind == "ip", ~F.regexp_like(v, F.lit(r"^(?:0|255)\."))).when(kind == "phone", F.regexp_like(v, F.lit(r"^\+(?:[17]|2[0-9]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8|9)"))) \
        .when(kind == "id", ~F.regexp_like(v, F.lit("^(?:000|666|9)"))).otherwise(F.regexp_like(v, F.lit(rf" (?:{GIVEN_NAMES})\b")))
    usual = F.when(kind == "email", F.length(v).between(6, 80)).when(kind == "card", digits.between(15, 16)).when(kind == "ip", F.length(v).between(7, 39)) \
        .when(kind == "phone", digits.between(10, 13)).otherwise(F.length(v) < 60)
    glued = F.regexp_like(c["left"], F.lit(r"[\p{L}0-9_/=+-]$")) | F.regexp_like(c["right"], F.lit(r"^[\p{L}0-9_/=+]"))
    return {"rule": _vote(c["strict"], ~c["strict"]), "gazetteer": _vote(listed, ~listed), "context": _vote(cue, F.lit(False)),
            "shape": _vote(usual, ~usual), "border": _vote(~glued, glued)}


def pattern_of(c: Column) -> Column:
    return F.concat_ws(",", c["kind"], *[v.cast("string") for v in votes(c).values()])


def reliabilities(patterns: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], dict[str, tuple[float, float]]]:
    """Probability of each vote pattern, and each labeler's (share right when it is one, share right when it is not)."""
    rows = {p: [int(x) for x in p.split(",")[1:]] for p in patterns}
    belief = {p: 1 / (1 + math.exp(-sum(v))) for p, v in rows.items()}  # of the majority, to begin with
    rates = {}
    for _ in range(rounds):
        prior = (sum(n * belief[p] for p, n in patterns.items()) + 1) / (sum(patterns.values()) + 2)
        for k, name in enumerate(LABELERS):
            cast = [(belief[p], n, rows[p][k]) for p, n in patterns.items() if rows[p][k]]
            right = [sum(b * n for b, n, v in cast if v > 0), sum((1 - b) * n for b, n, v in cast if v < 0)]
            all_ = [sum(b * n for b, n, _ in cast), sum((1 - b) * n for b, n, _ in cast)]
            rates[name] = tuple((r + 4) / (a + 5) for r, a in zip(right, all_))  # a labeler is thought good before it is seen
        for p, v in rows.items():
            log = math.log(prior / (1 - prior))
            for k, name in enumerate(LABELERS):
                se, sp = rates[name]
                log += math.log(se / (1 - sp)) if v[k] > 0 else math.log((1 - se) / sp) if v[k] < 0 else 0.0
            belief[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, log))))
    return belief, rates


def train_classifier(patterns: dict[str, int], belief: dict[str, float], rounds: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> dict[str, float]:
    """Logistic weights of kinds and of yes and no votes, by descent on the soft labels of all candidates."""
    def names(p):
        kind, *v = p.split(",")
        return ["one", kind, *[f"{n}{x}" for n, x in zip(LABELERS, v) if x != "0"]]

    total, w = sum(patterns.values()), {}
    for _ in range(rounds):
        slope = {}
        for p, n in patterns.items():
            y = 1 / (1 + math.exp(-sum(w.get(f, 0.0) for f in names(p))))
            for f in names(p):
                slope[f] = slope.get(f, 0.0) + (belief[p] - y) * n / total
        for f, s in slope.items():
            w[f] = w.get(f, 0.0) + rate * (s - ridge * w.get(f, 0.0))
    return w


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added): arrays of spans with their values."""
    seen = written(found(docs, id_col=id_col, text_col=text_col), "pii")
    rows = seen.where("candidates IS NOT NULL").select(F.explode("candidates").alias("c"))
    counted = rows.groupBy(pattern_of(F.col("c")).alias("p")).agg(F.count("*").alias("n")).collect()  # at most 6 * 3**5 rows
    patterns = {r["p"]: r["n"] for r in sorted(counted)}
    weights = train_classifier(patterns, reliabilities(patterns)[0]) if patterns else {}

    def admitted(c):
        score = F.lit(weights.get("one", 0.0))
        for k in KINDS:
            score = score + F.when(c["kind"] == k, F.lit(weights.get(k, 0.0))).otherwise(0.0)
        for name, v in votes(c).items():
            score = score + F.when(v > 0, F.lit(weights.get(f"{name}1", 0.0))).when(v < 0, F.lit(weights.get(f"{name}-1", 0.0))).otherwise(0.0)
        return ~c["strict"] & (c["rank"] >= LOOSE_RANK) & (score >= 0)

    kept = F.transform(F.filter("candidates", admitted), lambda c: F.struct(
        c["start"].alias("start"), c["rank"].alias("rank"), c["kind"].alias("kind"), c["end"].alias("end"), c["value"].alias("value")))
    return seen.select("doc_id", "base", F.coalesce(kept, S.no_spans()).alias("added"))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    got = personal_data(table(spark, sf_dir, "documents"))
    return got.select("doc_id", *[S.count_of(F.col("base"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
                      F.sha2(S.joined(F.col("base")), 256).alias("base_sha256"), S.joined(F.array_sort(F.concat("base", "added"))).alias("spans"))
