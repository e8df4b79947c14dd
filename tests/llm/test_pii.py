import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import regex
from llm_fixtures import DOCS, SF

from lectern.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def spans(text):
    out = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), n, m.end()))
    return sorted(out)


def row(doc, text):
    s = spans(text)
    names = list(PLAIN)
    listed = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in s)
    return (doc, *[sum(k == n for _, k, _ in s) for n in range(4)], hashlib.sha256(listed.encode()).hexdigest())


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, spans string, row int")
    return pii.report(df, **options)


FIXED = [
    "", None, "a@b.c_d@e.f", "x@y", "x@y.", "a@b@c.d", "é@ö.de a.b%c@d-e.f.g.", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.255",
    "0001.02.3.4", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "+1 (456) 555-2186 x",
    "+1", "+12345678", "+123456789 +1234567890123456", "𝒳 mail: 𝒳a@b.cd 𝒳 +49 30 1234567", "+1 234 567 890 +1((((( 5", "00000000000000",
    "1 1 1 1 1 1 1 1 1 1 1 1", "a@b.c" * 50, "@.@.@", "+1-800-555-01234567890",
]


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(1)
    pieces = ["@", ".", "a", "b1", "+", "+4", " ", "-", "(", ")", "12", "255", "9" * 7, "4111111111111111", "é", "𝒳", "x@y.z", "1.2.3.4", "_", "\n"]
    rows = list(enumerate(FIXED)) + [(100 + i, "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))) for i in range(1500)]
    rows += [(9000, " ".join(["mail a@b.cd", "1.2.3.4 +1 456 555 2186"] * 700)), (None, "a@b.cd")]
    got = {r["doc_id"]: tuple(r)[:6] for r in run(spark, rows).collect()}
    for doc, text in rows:
        assert got[doc] == row(doc, text), (text, got[doc])
    assert run(spark, []).collect() == []


def test_long_runs_are_linear(spark):
    rows = [(1, "9" * 300_000), (2, "a" * 300_000 + "@"), (3, "1 " * 100_000), (4, "1.1." * 20_000), (5, "+1(" + "(" * 300_000), (6, "a." * 150_000 + "@b")]
    got = {r["doc_id"]: r for r in run(spark, rows).collect()}
    assert got[4]["n_ip"] == 10_000 and got[1]["n_card"] == 0


def test_terms_that_give_an_entity_away(spark):
    rng = random.Random(2)
    filler = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "am") for b in ("em", "um", "or", "et", "is", "a")]

    def text(*inner):
        return " ".join(rng.choices(filler, k=25) + list(inner) + rng.choices(filler, k=25))

    rows = [(i, text("Zaphod", "p@q.org", "speaks")) for i in range(5)]  # only ever beside that address
    rows += [(10 + i, text("speaks")) for i in range(200)]  # everywhere
    rows += [(300, text("Trillian", "t@q.org")), (301, text("Trillian"))]  # met once
    copy = text("Marvin", "m@q.org")
    rows += [(400 + i, copy) for i in range(30)]  # one surrounding, many copies
    got = {r["doc_id"]: r["spans"] for r in run(spark, rows).collect()}
    for doc, t in rows:
        want = []
        for m in re.finditer(r"\S+@q\.org|Zaphod", t):
            want.append(f"{'term' if m.group() == 'Zaphod' else 'email'}:{m.start()}:{m.end()}")
        assert got[doc] == ",".join(want), doc
    df = spark.createDataFrame([(d, t, None, None, 0) for d, t in rows], DOCS)
    out = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert all("[REDACTED] [EMAIL] speaks" in out[i] for i in range(5)) and "Trillian [EMAIL]" in out[300]
    assert out[10] == rows[5][1] and out[400].count("[EMAIL]") == 1


def mask(text, found):
    tags, out, at = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]"], "", 0
    for a, k, b in found:
        if a >= at:
            out += text[at:a] + tags[k]
        at = max(at, b)
    return out + text[at:]


def test_sanitised_text_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(FIXED)] + [(900, " x ".join(["a@b.cd", "1.2.3.4", "+1 456 555 2186"] * 400)), (901, "+4111 1111 1111 1111 1 1 1 y"), (None, "a@b.cd")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOCS)
    out = pii.sanitised(df, contexts=10**6)
    assert out.columns == df.columns and out.count() == len(rows)
    for r in out.collect():
        text = dict(rows)[r["doc_id"]]
        want = None if text is None else mask(text, spans(text))
        assert r["text"] == want and r["n_chars"] == (None if want is None else len(want))


def test_no_python_on_the_main_path(spark):
    plan = pii.report(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_query_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = {r["doc_id"]: r for r in queries.op9_pii(spark, SF).collect()}
    assert len(got) == len(rows)
    for doc, text in rows:
        assert tuple(got[doc])[:6] == row(doc, text)
        names = list(PLAIN)
        assert set(f"{names[k]}:{a}:{b}" for a, k, b in spans(text)) <= set(filter(None, got[doc]["spans"].split(",")))




def brute_terms(texts, contexts=3, generalise=0.8):
    """Term spans of each distinct text, by counting over whole documents."""
    term = regex.compile(pii.TERM)
    texts = sorted({t or "" for t in texts})
    words = {t: set(term.findall(t.lower())) for t in texts}
    seen = {}
    for t in texts:
        for kind, pattern in PLAIN.items():
            found = list(re.finditer(pattern, t))
            good = {(a, b) for a, n, b in spans(t) if list(PLAIN)[n] == kind}
            for i, m in enumerate(found):
                if m.span() in good:
                    left = t[found[i - 1].end() if i else 0 : m.start()][-120:]
                    right = t[m.end() : found[i + 1].start() if i + 1 < len(found) else len(t)][:120]
                    plain = m.group().lower() if kind == "email" else m.group() if kind == "ip" else re.sub("[^0-9]", "", m.group())
                    seen.setdefault((t, f"{kind}:{plain}"), (left, right))
    n, df = len(texts), Counter(w for t in texts for w in words[t])
    entities = {}
    for (t, e), c in seen.items():
        entities.setdefault(e, []).append((t, c))
    flagged = {}
    for e, where in entities.items():
        df_e = len({c for _, c in where})
        if df_e < contexts or df_e >= n:
            continue
        pairs = {}
        for t, c in where:
            for w in words[t]:
                pairs.setdefault(w, set()).add(c)
        for w, cs in pairs.items():
            share = math.log2(n * len(cs) / (df_e * df[w])) / math.log2(n / df_e)
            if len(cs) >= contexts and share >= generalise:
                flagged.setdefault(e, {})[w] = share
    out = {}
    for t in texts:
        held = {w for (u, e) in seen if u == t for w in flagged.get(e, ())}
        base = spans(t)
        out[t] = [
            (m.start(), m.end()) for m in term.finditer(t)
            if m.group().lower() in held and not any(a < m.end() and b > m.start() for a, _, b in base)
        ]
    return out


def test_term_spans_equal_brute_force_over_whole_documents(spark):
    rng = random.Random(5)
    filler = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(120)]
    people = [("Zaphod", "p@q.org"), ("Arthur-Dent", "+44 20 7946 0958"), ("Ford", "10.0.0.7"), ("Marvin42", "m@q.org")]
    texts = []
    for i in range(150):
        body = rng.choices(filler, k=rng.randrange(5, 400))
        for name, entity in people:
            if rng.random() < 0.08:
                body.insert(rng.randrange(len(body)), entity)
                if rng.random() < 0.9:
                    body[rng.randrange(len(body)) : 0] = [name, name.lower()]
        texts.append(" ".join(body))
    texts += [texts[0]] * 40 + [None, "", texts[1] + " Zaphod p@q.org"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    want = brute_terms(texts)
    assert sum(map(len, want.values())) > 20
    for r in run(spark, rows).collect():
        got = [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("term:")]
        assert got == want[dict(rows)[r["doc_id"]] or ""], r["doc_id"]


def test_a_word_far_from_its_entity_is_found_and_replaced_everywhere(spark):
    rng = random.Random(6)
    filler = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(60)]
    rows = []
    for i in range(4):
        gap = rng.choices(filler, k=300)
        rows.append((i, " ".join(["Heimlich", *gap, "x@y.org", *rng.choices(filler, k=200), "heimlich", f"end{i}"])))
    rows += [(10 + i, " ".join(rng.choices(filler, k=300))) for i in range(100)]
    df = spark.createDataFrame([(d, t, None, None, 0) for d, t in rows], DOCS)
    out = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert all("eimlich" not in out[i] and out[i].count("[REDACTED]") == 2 for i in range(4))
    assert all(out[10 + i] == rows[4 + i][1] for i in range(100))
