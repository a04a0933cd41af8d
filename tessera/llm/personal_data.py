"""Personal data by weak-supervision aggregation, in DataFrame functions only.

1. Patterns find candidates in the whole text. The base kinds (email, ip, card, phone) are exact rules and always stay; the loose
   kinds (tel: a phone number without country code; ssn; iban) are only candidates.
2. Labelers vote on each candidate, yes (1), no (0) or nothing (2): shape rules, gazetteers of cue words in the text before it, and its surroundings.
3. Candidates are counted by kind and vote pattern. There are at most kinds * 3**labelers = 7 * 729 such rows, whatever the corpus, so
   these counts come to the driver. There expectation-maximisation (a Dawid-Skene model with two classes) estimates, for each kind, how reliable each
   labeler is, and gives each pattern its posterior.
4. A logistic span classifier is trained on the posteriors. Besides the votes and the kind it has features of its own, which no labeler sees: the
   characters at either side, a hash of the word before, and the length. It is fitted on TRAIN_PATTERNS distinct (kind, votes, features) with
   their counts, picked by hash; the counts of step 3 cover all candidates. Its weights go into literal arrays, and loose candidates
   with a probability of one half or more, and no base span in them, become spans.

Texts are read once: candidates are written to the shared folder and steps 3 and 4 read that. Nothing is shuffled but the counts.

Positions. A pattern's matches and the gaps between them (split) have lengths that add up to the positions. The sums run over chunks of CHUNK
matches, so that a text with very many matches costs time in proportion, and the characters around a match are carried along
instead of being looked up by position. Overlaps are found by two sweeps over the sorted spans. Patterns are
anchored and possessive so that long junk costs one pass and no deep recursion; none of that changes what is found:
- a run of characters of an address without @ fails from its first character on, so later starts inside it are not tried, except
  right behind a match (\\G);
- a digit chain is card-sized only as a whole: it starts where neither a digit nor a digit and one separator precede it.

Defined results: null text counts as empty and has no spans; rows are independent, so repeated rows and ids give a row each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import materialise, spans_text
from tessera.llm.weak_labels import reliabilities

# Fixed values ----------------------------------------------------------------------------------------------------------
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "tel": r"(?<![0-9A-Za-z+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])",
}
KINDS = (*BASE, *LOOSE)
#: Cue words for personal data, and for numbers and names that only look like it.
CUES = "phone|tel|telefon|teléfono|téléphone|mobile|call|fax|mail|e-mail|email|correo|courriel|contact|kontakt|contacto|address|adresse|dirección|ssn|social security|iban|konto|card|karte|tarjeta|carte|visa|reach"
OTHER = "version|build|release|isbn|issn|sku|order|invoice|serial|token|secret|key|sha|hash|port|localhost|figure|table|page|chapter"
#: Digits of an address range that no person holds.
RESERVED = r"^(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."
CONTEXT = 32
#: Matches that are placed in one go.
CHUNK = 512
#: Distinct patterns that the classifier is fitted on, at most.
TRAIN_PATTERNS = 20_000
#: Sizes of the classifier's own features: character before, character behind, hash of the word before, length.
SIZES = {"before": 5, "behind": 5, "word": 64, "long": 41}


def _needs(kind: str, text: Column) -> Column:
    """A cheap test that a text without any match of the kind fails."""
    return {"email": text.contains("@"), "phone": text.contains("+"), "ssn": text.contains("-")}.get(kind, F.lit(True))


def scanned(items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """emit(state, x) of each x in order, where state starts at zero and becomes step(state, x). Arrays grow by chunks, so the cost is linear."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda k: F.slice(items, k * CHUNK + 1, F.lit(CHUNK)))

    def inner(acc: Column, chunk: Column) -> Column:
        return F.aggregate(
            chunk,
            F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out")),
            lambda own, x: F.struct(step(own["state"], x).alias("state"), F.array_append(own["out"], emit(own["state"], x)).alias("out")),
            lambda own: F.struct(own["state"].alias("state"), F.array_append(acc["parts"], own["out"]).alias("parts")),
        )

    start = F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("parts"))
    empty = F.array().cast(f"array<{kind}>")
    return F.when(F.size(items) > 0, F.aggregate(chunks, start, inner, lambda acc: F.flatten(acc["parts"]))).otherwise(empty)


_PLACED = "struct<start:int,end:int,m:string,left:string,right:string>"


def _matched(matches: Column, gaps: Column) -> Column:
    """array<struct<gap, m, right>>: each match, the gap before it and the first character behind it."""
    n = F.size(matches)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), n), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    behind = F.zip_with(F.slice(gaps, F.lit(2), n), F.slice(F.concat(matches, F.array(F.lit(""))), F.lit(2), n), lambda g, m: F.substring(F.when(g != "", g).otherwise(m), 1, 1))
    return F.zip_with(pairs, behind, lambda p, r: F.struct(p["gap"].alias("gap"), p["m"].alias("m"), r.alias("right")))


def _placed(items: Column) -> Column:
    """array of _PLACED from a pattern's matches in order: positions and the CONTEXT characters before."""

    def near(state: Column, x: Column) -> Column:
        return F.right(F.concat(state["tail"], x["gap"]), F.lit(CONTEXT))

    def step(state: Column, x: Column) -> Column:
        to = state["to"] + F.length(x["gap"]) + F.length(x["m"])
        return F.struct(to.alias("to"), F.right(F.concat(state["tail"], x["gap"], x["m"]), F.lit(CONTEXT)).alias("tail"))

    def emit(state: Column, x: Column) -> Column:
        start = state["to"] + F.length(x["gap"])
        return F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("m"), near(state, x).alias("left"), x["right"].alias("right"))

    return scanned(items, F.struct(F.lit(0).alias("to"), F.lit("").alias("tail")), step, emit, _PLACED)


def clear_of(df: DataFrame, base: str, loose: str) -> DataFrame:
    """df with `clear`: its loose spans (start, end, kind) that share no character with a base span (start, end), by start. Two sweeps over the sorted spans.
    Each step is a column of its own, as scanned() names its array more than once."""
    kind = "struct<start:int,loose:int,end:int,kind:string,hit:boolean>"
    both = F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("loose"), s["end"].alias("end"), F.lit("").alias("kind"))),
        F.transform(loose, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("loose"), s["end"].alias("end"), s["kind"].alias("kind"))),
    )

    def told(s: Column, hit: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["loose"].alias("loose"), s["end"].alias("end"), s["kind"].alias("kind"), hit.alias("hit"))

    none = F.array().cast("array<struct<start:int,loose:int,end:int,kind:string>>")
    df = df.withColumn("sorted", F.when(F.size(loose) > 0, F.array_sort(both)).otherwise(none))
    forward = scanned(F.col("sorted"), F.lit(0), lambda reach, s: F.when(s["loose"] == 0, F.greatest(reach, s["end"])).otherwise(reach), lambda reach, s: told(s, reach > s["start"]), kind)
    df = df.withColumn("turned", F.reverse(forward)).drop("sorted")
    far = F.lit((1 << 31) - 1)
    back = scanned(F.col("turned"), far, lambda nearest, s: F.when(s["loose"] == 0, s["start"]).otherwise(nearest), lambda nearest, s: told(s, s["hit"] | (nearest < s["end"])), kind)
    return df.withColumn("clear", F.reverse(F.filter(back, lambda s: (s["loose"] == 1) & ~s["hit"]))).drop("turned")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of m pass the Luhn check."""
    backwards = F.reverse(_digits(m))
    values = F.transform(F.sequence(F.lit(1), F.length(backwards)), lambda i: (F.substring(backwards, i, F.lit(1)).cast("int") * (2 - i % 2)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    """The exact rule of a base kind, on top of its pattern."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _votes(kind: str, m: Column, left: Column, right: Column) -> list[Column]:
    """What each labeler says of a candidate: 1 yes, 0 no, 2 nothing."""
    if kind == "email":
        shape = m.rlike(r"^[A-Za-z0-9].*\.[A-Za-z]{2,24}$").cast("int")
    elif kind == "ip":
        shape = F.when(m.rlike(RESERVED), 0).otherwise(1)
    elif kind == "ssn":
        shape = (~m.rlike(r"^(?:000|666|9)|-00-|-0000$")).cast("int")
    elif kind == "iban":
        shape = (F.length(m).between(15, 34) & m.rlike("[0-9]{6}")).cast("int")
    elif kind == "tel":
        shape = (~_digits(m).rlike("^[01]|^...[01]")).cast("int")
    else:
        shape = F.lit(1)
    before = F.lower(left)
    cue = F.when(before.rlike(rf"(?<![\p{{L}}])(?:{CUES})(?![\p{{L}}])"), 1).otherwise(2)
    other = F.when(before.rlike(rf"(?<![\p{{L}}])(?:{OTHER})(?![\p{{L}}])"), 0).otherwise(2)
    alone = ((left == "") | left.rlike(r"[\s(\[{<\"'>:;,]$")) & ((right == "") | right.rlike(r"^[\s)\]}>\"'<:;,.!?]"))
    joined = left.rlike(r"[A-Za-z0-9_/=#-]$") | right.rlike(r"^[A-Za-z0-9_/=#-]")
    varied = F.size(F.array_distinct(F.split(F.regexp_replace(m, "[^0-9A-Za-z]", ""), ""))) >= 4
    return [shape, cue, other, F.when(alone, 1).otherwise(2), F.when(joined, 0).otherwise(2), varied.cast("int")]


LABELERS = ("shape", "cue", "other", "alone", "joined", "varied")
#: The middle four only ever speak for one side; for the prior they are as good as silent.
EXPECTED = [(0, 1), (2, 2), (2, 2), (2, 2), (2, 2), (0, 1)]


def _features(m: Column, left: Column, right: Column) -> list[Column]:
    """The classifier's own features, numbers below SIZES."""

    def of(c: Column) -> Column:
        return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^[0-9]"), 2).when(c.rlike(r"^\p{L}"), 3).otherwise(4)

    word = F.lower(F.regexp_extract(left, r"(\p{L}+)[^\p{L}]*$", 1))
    return [of(F.right(left, F.lit(1))), of(right), F.pmod(F.xxhash64(word), F.lit(SIZES["word"])).cast("int"), F.least(F.length(m), F.lit(SIZES["long"] - 1))]


def candidates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and, per kind, its candidates with start, end, vote pattern and features. Reads each text once."""
    text = F.col("pd_text")
    found = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("pd_text"))
    patterns = {**BASE, **LOOSE}
    none = F.array().cast("array<string>")
    found = found.select("doc_id", "pd_text", *[F.when(_needs(k, text), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"pd_{k}") for k, p in patterns.items()])
    gaps = [F.when(F.size(f"pd_{k}") > 0, F.split(text, p, -1)).otherwise(none).alias(f"gaps_{k}") for k, p in patterns.items()]
    found = found.select("doc_id", *[f"pd_{k}" for k in patterns], *gaps)
    found = found.select("doc_id", *[_matched(F.col(f"pd_{k}"), F.col(f"gaps_{k}")).alias(f"pd_{k}") for k in patterns])
    found = found.select("doc_id", *[_placed(F.col(f"pd_{k}")).alias(f"pd_{k}") for k in patterns])

    def judged(kind: str) -> Column:
        def one(x: Column) -> Column:
            votes = _votes(kind, x["m"], x["left"], x["right"])
            own = _features(x["m"], x["left"], x["right"])
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.concat(*[v.cast("string") for v in votes]).alias("votes"), *[v.alias(k) for k, v in zip(SIZES, own, strict=True)])

        return F.transform(F.filter(F.col(f"pd_{kind}"), lambda x: _valid(kind, x["m"])), one)

    return found.select("doc_id", *[judged(k).alias(k) for k in patterns])


class SpanClassifier:
    """A logistic model on kind, votes and the candidates' own features; each of them counts alone and with the kind."""

    def __init__(self, rows: list[tuple], rounds: int = 300, rate: float = 0.5, ridge: float = 1e-3):
        """rows: (kind, votes, features, count, target)."""
        self.at: dict[tuple, int] = {}
        places = np.array([[self.at.setdefault(f, len(self.at)) for f in self.names(*r[:3])] for r in rows], np.int64).reshape(len(rows), 2 + 2 * (len(LABELERS) + len(SIZES)))
        self.weights = np.zeros(max(1, len(self.at)))
        n = np.array([r[3] for r in rows], float)
        target = np.array([r[4] for r in rows], float)
        n = n / max(n.sum(), 1.0)
        for _ in range(rounds if rows else 0):
            gap = n * (target - 1 / (1 + np.exp(-np.clip(self.weights[places].sum(axis=1), -50, 50))))
            step = np.bincount(places.reshape(-1), weights=np.repeat(gap, places.shape[1]), minlength=len(self.weights))
            self.weights += rate * (step - ridge * self.weights)

    @staticmethod
    def names(kind: str, votes: str, own: tuple[int, ...]) -> list[tuple]:
        each = [*zip(LABELERS, votes, strict=True), *zip(SIZES, own, strict=True)]
        return [("bias",), ("kind", kind), *each, *[(kind, *x) for x in each]]

    def weight(self, *name) -> float:
        return float(self.weights[self.at[name]]) if name in self.at else 0.0

    def score(self, kind: str, votes: str, own: tuple[int, ...]) -> float:
        return sum(self.weight(*f) for f in self.names(kind, votes, own))

    def column(self, kind: str, x: Column) -> Column:
        """The same score in DataFrame functions, from arrays of weights."""
        total = F.lit(self.weight("bias") + self.weight("kind", kind))
        for i, labeler in enumerate(LABELERS):
            values = F.array(*[F.lit(self.weight(labeler, v) + self.weight(kind, labeler, v)) for v in "012"])
            total = total + F.element_at(values, F.substring(x["votes"], i + 1, 1).cast("int") + 1)
        for name, size in SIZES.items():
            values = F.array(*[F.lit(self.weight(name, v) + self.weight(kind, name, v)) for v in range(size)])
            total = total + F.element_at(values, x[name] + 1)
        return total


def posteriors(counts: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
    """The probability of personal data for each (kind, votes): expectation-maximisation of its own for every kind."""
    out = {}
    for kind in KINDS:
        patterns = {v: float(n) for (k, v), n in counts.items() if k == kind}
        out |= {(kind, v): p for v, p in reliabilities(patterns, EXPECTED)[0].items()}
    return out


def trained(found: DataFrame, train_patterns: int = TRAIN_PATTERNS) -> SpanClassifier:
    """The classifier, from all candidates' votes and a bounded number of distinct patterns."""

    def of(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["votes"].alias("votes"), *[x[k].alias(k) for k in SIZES]))

    each = F.explode(F.flatten(F.array(*[of(k) for k in KINDS])))
    patterns = materialise(found.select(each.alias("c")).select("c.*").groupBy("kind", "votes", *SIZES).agg(F.count("*").alias("n")), "personal-data-patterns")
    counts = {(r["kind"], r["votes"]): r["n"] for r in patterns.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()}  # at most 7 * 729 rows
    post = posteriors(counts)
    few = patterns.orderBy(F.xxhash64("kind", "votes", *SIZES), "kind", "votes", *SIZES).limit(train_patterns).collect()
    return SpanClassifier([(r["kind"], r["votes"], tuple(r[k] for k in SIZES), r["n"], post[r["kind"], r["votes"]]) for r in few])


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end) by kind as listed, then start. Added spans overlap no base span."""
    found = materialise(candidates(docs), "personal-data")
    model = trained(found)

    def named(kind: str, column: Column) -> Column:
        return F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    def likely(kind: str) -> Column:
        return named(kind, F.filter(F.col(kind), lambda x: model.column(kind, x) >= 0))

    def of(kind: str) -> Column:
        return named(kind, F.filter("clear", lambda s: s["kind"] == kind))

    base = F.concat(*[named(k, F.col(k)) for k in BASE])
    good = F.concat(*[likely(k) for k in LOOSE])
    judged = found.select("doc_id", base.alias("base"), good.alias("good"))
    sure = clear_of(judged, "base", "good")
    return sure.select("doc_id", "base", F.concat(*[of(k) for k in LOOSE]).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """The counts, the hash of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
