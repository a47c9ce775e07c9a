import hashlib
import re

from factloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes_luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and passes_luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(kind, m.start(), m.end()) for kind, pattern in PLAIN.items() for m in re.finditer(pattern, text or "") if valid(kind, m[0])]


TEXTS = [
    None, "", "nothing here", "a@b.c@d.e f@g.h_x@y.org", "é😀 ana@mail5.example.com, +1 (743) 555-3824\n10.0.0.255", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.4 1.2.3",
    "4994226020900891 4994 2260 2090 0891 4994-2260-2090-0892", "+1234567 +12345678 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "++1-555-555-5555- x@y x@y. @a.b a@@b.c", "\x01a@b.cc\x02 1.1.1.1",
    "1 " * 30_000, "9" * 50_000, "a" * 100_000, "a." * 40_000 + "@b.c", "x@" + "b." * 40_000 + "c", "1." * 30_000 + "1", "+1" + " " * 50_000, "+1(" * 20_000, "- " * 40_000 + "4994226020900891",
]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS)], "doc_id long, text string, __base string")
    rows = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    for k, text in enumerate(TEXTS):
        spans = brute(text)
        expected = ",".join(f"{a}:{b}:{c}" for a, b, c in spans)
        assert rows[k].base_sha256 == hashlib.sha256(expected.encode()).hexdigest(), (k, expected[:200], rows[k].spans[:200])
        assert set(filter(None, expected.split(","))) <= set(rows[k].spans.split(",")) | {""}
        assert [rows[k][f"n_{kind}"] for kind in PLAIN] == [sum(s[0] == kind for s in spans) for kind in PLAIN]


def test_the_trees_add_what_context_shows_and_leave_the_rest(spark):
    texts = ["please call 555-123-4567 today", "my ssn 123-45-6789.", "write me: bob at mail dot com", "order 555-123-4567 shipped", "serial 123-45-6789", "we met at noon dot then left", "released version 555.123.4567"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = [r.spans for r in pii.find_pii(docs).orderBy("doc_id").collect()]
    assert spans[0] == "phone:12:24" and spans[1] == "id:7:18" and spans[2].startswith("email:10:")
    assert spans[3:] == ["", "", "", ""]


#: Forms that neither fitting nor calibration has seen.
FRESH = (
    ("give us a call: ###-###-####", pii.PHONE), ("tel. no. (###) ###-####", pii.PHONE), ("by phone, ###.###.####", pii.PHONE), ("dial 00############", pii.PHONE),
    ("tracking ###-###-####", pii.NONE), ("@ @ @ ###.###.#### @", pii.NONE), ("reference ### ### ####", pii.NONE),
    ("her ssn: ###-##-####", pii.ID), ("iban no. NL## #### #### #### ####", pii.ID), ("@ @ @ ###-##-#### @", pii.NONE), ("model GH## #### #### ####", pii.NONE),
    ("email: kim at @ dot net", pii.EMAIL), ("we stood at last dot then @", pii.NONE),
    ("amex card 3#############^", pii.CARD), ("@ 6############~ @ @", pii.NONE), ("serial 3############^", pii.NONE),
    ("host: 2001:0db8:####:####:####:####:####:####", pii.IP), ("@ @ 0#:2#:1#:3#:5#:1#:2#:4# @", pii.NONE),
    ("password: &&&&&&&&&&&&w2", pii.SECRET), ("secret_token=%%%%%%%%%%%%%%%%%%%%%%%%%%b3", pii.SECRET), ("api key = '&&&&&&&&&&&&&&&&&&&&K1'", pii.SECRET), ("checksum %%%%%%%%%%%%%%%%%%%%%%%%%%%%%%b3", pii.NONE), ("@ &&&&&&&&&&&&&&&&u5 @ @", pii.NONE),
)


def test_calibrated_precision_and_recall_hold_on_forms_never_seen(spark):
    trees, limits = pii.model(spark)
    rows = pii.training_rows(spark, FRESH, 2300)
    x = rows.select("kind", pii.F.explode(pii.candidates(pii.cleaned(pii.F.col("text")))).alias("x"))
    x = x.select((pii.F.col("kind") == pii.F.col("x.k")).alias("label"), pii.features(pii.F.col("x")).alias("f"))
    seen = {k: [0, 0, 0] for k in range(len(pii.KINDS))}
    for r in x.collect():
        chosen = sum(pii.value(t, tuple(r.f)) for t in trees) >= limits[r.f["kind"]]
        if chosen or r.label:
            seen[r.f["kind"]][0 if chosen and r.label else 1 if chosen else 2] += 1
    right, wrong, _ = (sum(n) for n in zip(*seen.values(), strict=True))
    assert wrong <= 0.02 * right, seen
    assert all(n[0] >= 0.9 * (n[0] + n[2]) and n[0] + n[2] > 50 for n in seen.values()), seen


def test_secrets_are_found_and_replaced(spark):
    texts = ['so token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"### x', "ndble password=b7db7aa4a5fcc78305 or", 'N!! A,!! TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" y', "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff is fine", "the token ring of a network"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_secret for r in pii.find_pii(docs).orderBy("doc_id").collect()] == [1, 1, 1, 0, 0]
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()] == ['so token = "[SECRET]"### x', "ndble password=[SECRET] or", 'N!! A,!! TOKEN = "[SECRET]" y', texts[3], texts[4]]


def test_many_spans_in_one_text(spark):
    """As many blocks of spans as it takes: the same spans, and the same text without them, as one by one."""
    text = " ".join(f"a{k}@b.cc é +1 (743) 555-{k % 10000:04d} 10.0.0.{k % 300} 4994226020900891 call 555-123-{k % 10000:04d}" for k in range(1500))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.find_pii(docs).first()
    spans = [tuple(x.split(":")) for x in row.spans.split(",")]
    assert hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in brute(text)).encode()).hexdigest() == row.base_sha256 and len(spans) == row.n_spans > 5000
    out, at = "", 0
    for s, _, e, kind in sorted((int(s), pii.KINDS.index(kind), int(e), kind) for kind, s, e in spans):
        if s >= at:
            out += text[at:s] + f"[{kind.upper()}]"
        at = max(at, e)
    assert pii.redact(docs).first().text == out + text[at:]


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail é a@b.cc or +1 (743) 555-3824.", 5), (2, None, 6), (3, "clean", 7)], "doc_id long, text string, n_chars long").withColumn("__spans", pii.F.lit("own"))
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[1].text == "mail é [EMAIL] or [PHONE]." and out[2].text is None and out[3].text == "clean" and out[3].n_chars == 7 and out[1]["__spans"] == "own"


def test_empty_table(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0
