import hashlib
import re

import pytest

from tessera.llm import personal_data
from tessera.llm.queries import op10_personal_data
from tessera.llm.shared import masked_documents
from tessera.llm.weak_labels import reliabilities

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    counts = tuple(sum(k == kind for k, _, _ in out) for kind in PATTERNS)
    return (*counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in out).encode()).hexdigest())


def digest(r):
    return r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]


CASES = [
    "a@b.c_d@e.f a.b@c.d-", "1.2.3.400.5.6.7 300.1.2.3.4.5.6.7 001.2.3.04 1.2.3.4.5.6.7.8", "+1 (555) 123-4567 +12 +1..2 +1-800-555-0199 ext", "4111 1111 1111 1111 x 4111-1111-1111-1112",
    "12345678901234567890 4111 1111 1111 1111-", "x@@y.z a@b a@b.c.d@e.f", "😀 a@b.co 😀 1.1.1.1 é +49 (30) 1234567", "a" * 30000, "1 2-3 " * 5000, "1" * 20000, "1." * 10000, "a@" * 3000, "4111111111111111" * 2,
    "0000000000000000000000000001.2.3.4 99999999999.1.1.1", "@x.y %@%.% -@-.-", "+" * 500 + "1" * 12,
]


def test_base_rules(make, clashing, odd_rows):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(100 + k, t) for k, (_, t) in enumerate(odd_rows)]
    docs = clashing(make(rows), "email", "ip", "card", "base", "added", "pd_text")
    got = {r["doc_id"]: r for r in personal_data.digest(personal_data.spans(docs)).collect()}
    for i, t in rows:
        assert digest(got[i]) == brute(t), (t or "")[:60]


def test_loose_kinds_are_added_by_their_surroundings(make):
    rows = [(i, f"my phone: (212) 555-0{i:03d} or tel 646-555-1{i:03d}, ssn 123-45-6{i:03d}, mail me at name{i}@mail.example") for i in range(100, 160)]
    rows += [(1000 + i, f"version_{i}-212-555-1234x and 000-12-345{i}") for i in range(5)]
    got = {r["doc_id"]: r for r in personal_data.digest(personal_data.spans(make(rows))).collect()}
    assert all(r["n_email"] == 1 and r["n_added"] == 3 and r["spans"].startswith("email:") for i, r in got.items() if i < 1000)
    assert all(r["n_added"] == 0 for i, r in got.items() if i >= 1000)


def test_very_many_matches_in_one_text(make):
    from time import perf_counter

    addresses = "".join(f"n{i}@h{i % 7}.example " for i in range(100_000))
    mixed = "".join(f"n{i}@h{i % 7}.example call +1 (555) 123-{i % 10000:04d} or ssn: 123-45-{i % 9000 + 1000}, " for i in range(5_000))
    began = perf_counter()
    got = {r["doc_id"]: r for r in personal_data.digest(personal_data.spans(make([(1, addresses), (2, mixed)]))).collect()}
    assert perf_counter() - began < 60
    assert digest(got[1]) == brute(addresses) and digest(got[2]) == brute(mixed)
    assert got[1]["n_email"] == 100_000 and got[2]["n_phone"] == got[2]["n_added"] == 5_000
    (row,) = personal_data.candidates(make([(1, mixed)])).select("ssn").collect()
    for x in row[0]:
        assert mixed[x["start"] - 5 : x["start"]] == "ssn: " and mixed[x["end"]] == ","


def test_positions_and_surroundings_of_matches(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, 2, 511, 512, 513, 1300):
        text = "".join(f"é{i}" + "x" * (i % 50) + f"<{i}>" * (1 + i % 2) for i in range(n)) + ("" if n % 2 else "end")
        df = spark.createDataFrame([(text,)], "t string").select("t", F.regexp_extract_all("t", F.lit("<[0-9]+>"), F.lit(0)).alias("m"), F.split("t", "<[0-9]+>", -1).alias("g"))
        (row,) = df.select(personal_data._placed(personal_data._matched(F.col("m"), F.col("g")))).collect()
        want = [(m.start(), m.end(), m[0], text[max(0, m.start() - personal_data.CONTEXT) : m.start()], text[m.end() : m.end() + 1]) for m in re.finditer("<[0-9]+>", text)]
        assert [tuple(x) for x in row[0]] == want


def test_overlaps_against_brute_force(spark):
    import random

    from pyspark.sql import functions as F

    rows = []
    for seed in range(60):
        r = random.Random(seed)
        pick = lambda n: [(a, a + r.randint(1, 12)) for a in sorted(r.sample(range(120), n))]  # noqa: E731, B023
        rows.append((seed, [(*s, "b") for s in pick(r.randint(0, 8))], [(*s, r.choice("xy")) for s in pick(r.randint(1, 15))]))
    span = "array<struct<start:int,end:int,kind:string>>"
    df = spark.createDataFrame(rows, f"i int, base {span}, loose {span}")
    got = {x["i"]: [(s["start"], s["end"], s["kind"]) for s in x["c"]] for x in personal_data.clear_of(df, "base", "loose").select("i", F.col("clear").alias("c")).collect()}
    for i, base, loose in rows:
        assert got[i] == sorted(s for s in loose if not any(b[0] < s[1] and s[0] < b[1] for b in base)), i


def test_classifier_is_the_same_in_columns_and_uses_its_own_features(spark):
    from pyspark.sql import functions as F

    import random

    r = random.Random(1)
    rows = [("tel", "".join(r.choice("012") for _ in personal_data.LABELERS), (r.randrange(5), r.randrange(5), r.randrange(64), r.randrange(41))) for _ in range(300)]
    model = personal_data.SpanClassifier([(*x, 1 + k % 3, float(x[2][2] < 20)) for k, x in enumerate(rows)], rounds=3000)
    assert sum((model.score(*x) > 0) == (x[2][2] < 20) for x in rows) > 280
    df = spark.createDataFrame([(k, (v, *own)) for k, (_, v, own) in enumerate(rows)], "i int, x struct<votes:string,before:int,behind:int,word:int,long:int>")
    got = {x["i"]: x["s"] for x in df.select("i", model.column("tel", F.col("x")).alias("s")).collect()}
    assert all(got[k] == pytest.approx(model.score(*x)) for k, x in enumerate(rows))


def test_reliabilities_are_of_each_kind():
    counts = {("tel", "111111"): 500, ("tel", "002000"): 480, ("tel", "121111"): 30, ("ssn", "011111"): 500, ("ssn", "102000"): 480, ("ssn", "111111"): 5}
    post = personal_data.posteriors(counts)
    assert post["tel", "111111"] > 0.9 and post["tel", "002000"] < 0.1 and post["ssn", "011111"] > 0.9 and post["ssn", "102000"] < 0.1


def test_plan_is_native(make):
    plan = personal_data.candidates(make([(1, "x")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_em_finds_reliable_labelers():
    truth = {"111": 300.0, "110": 40.0, "011": 35.0, "000": 250.0, "001": 120.0, "100": 20.0}
    post, tables, share = reliabilities(truth, [(0, 1)] * 3)
    assert post["111"] > 0.95 > 0.05 > post["000"] and 0.3 < share < 0.7
    assert tables[1][1][1] > 0.8 and tables[1][0][0] > 0.8
    assert reliabilities({}, []) == ({}, [], 0.5)


def test_silence_may_say_nothing():
    post, _, _ = reliabilities({"11": 50.0, "00": 50.0, "12": 1.0, "02": 1.0}, [(0, 1)] * 2, silence=False)
    assert post["12"] > 0.9 and post["02"] < 0.1


def test_empty(make):
    assert personal_data.digest(personal_data.spans(make([]))).count() == 0


@pytest.mark.parametrize("query", [op10_personal_data])
def test_query_against_brute_force(query, spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = query(spark, small).collect()
    assert len(got) == len(texts) and all(digest(r) == brute(texts[r["doc_id"]]) for r in got)


def test_masking(make):
    docs = make([(1, "é mail a@b.co or +1 (555) 123-4567, 4111 1111 1111 1111."), (2, "nothing"), (3, None), (4, "1.2.3.4")])
    got = {r["doc_id"]: r["text"] for r in masked_documents(docs, personal_data.spans(docs)).collect()}
    assert got == {1: "é mail [EMAIL] or [PHONE], [CARD].", 2: "nothing", 3: None, 4: "[IP]"}


def python_votes(kind, m, left, right):
    """The labelers again, in plain Python."""
    digits = re.sub("[^0-9]", "", m)
    shape = {
        "email": lambda: int(bool(re.search(r"^[A-Za-z0-9].*\.[A-Za-z]{2,24}$", m))), "ip": lambda: int(not re.search(personal_data.RESERVED, m)), "ssn": lambda: int(not re.search(r"^(?:000|666|9)|-00-|-0000$", m)),
        "iban": lambda: int(15 <= len(m) <= 34 and bool(re.search("[0-9]{6}", m))), "tel": lambda: int(not re.search("^[01]|^...[01]", digits)),
    }.get(kind, lambda: 1)()
    letter = r"[^\W\d_]"
    says = lambda words: re.search(rf"(?<!{letter})(?:{words})(?!{letter})", left.lower())
    alone = (not left or re.search(r"[\s(\[{<\"'>:;,]$", left)) and (not right or re.search(r"^[\s)\]}>\"'<:;,.!?]", right))
    joined = re.search(r"[A-Za-z0-9_/=#-]$", left) or re.search(r"^[A-Za-z0-9_/=#-]", right)
    varied = int(len(set(re.sub("[^0-9A-Za-z]", "", m))) >= 4)
    return "".join(map(str, [shape, 1 if says(personal_data.CUES) else 2, 0 if says(personal_data.OTHER) else 2, 1 if alone else 2, 0 if joined else 2, varied]))


def test_added_spans_against_brute_force(spark, small, make):
    extra = make([(10**6 + i, f"phone 212-555-0{100 + i}, build 1.0 415-555-0{100 + i}x (646) 555-1{200 + i}; ssn 123-45-6{100 + i} id=000-12-3456 +1 (212) 555-0{100 + i} DE8937040044053201300{i % 10}") for i in range(40)])
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(extra.select("doc_id", "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    found = personal_data.materialise(personal_data.candidates(docs), "t")
    model = personal_data.trained(found)
    want, counts = {}, {}
    for r in found.collect():
        text, loose = texts[r["doc_id"]], []
        base = [(k, x["start"], x["end"]) for k in personal_data.BASE for x in r[k]]
        for kind in personal_data.KINDS:
            for x in r[kind]:
                m, left, right = text[x["start"] : x["end"]], text[max(0, x["start"] - personal_data.CONTEXT) : x["start"]], text[x["end"] : x["end"] + 1]
                assert x["votes"] == python_votes(kind, m, left, right), (kind, m, left, right)
                counts[kind, x["votes"]] = counts.get((kind, x["votes"]), 0) + 1
                if kind in personal_data.LOOSE and model.score(kind, x["votes"], tuple(x[f] for f in personal_data.SIZES)) >= 0 and not any(a < x["end"] and x["start"] < b for _, a, b in base):
                    loose.append((kind, x["start"], x["end"]))
        want[r["doc_id"]] = loose
        for kind, pattern in personal_data.LOOSE.items():
            assert [(x["start"], x["end"]) for x in r[kind]] == [m.span() for m in re.finditer(pattern.replace("++", "+"), text)]
    got = {r["doc_id"]: [tuple(s) for s in r["added"]] for r in personal_data.spans(docs).collect()}
    assert got == want and sum(map(len, want.values())) >= 80
    post = personal_data.posteriors(counts)
    assert set(post) == set(counts) and all(0 <= p <= 1 for p in post.values())
