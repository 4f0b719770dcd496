"""Personal data against a plain re search."""

import hashlib
import re

from lexweave.llm import pii

RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(RAW.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


CASES = [
    None, "", "x", "a@b.c", "é😀 a.b+c@d-e.f.g, 1.2.3.4 256.1.1.1 001.002.003.0255 1.2.3.4.5.6.7.8.9", "a@b.c.d_e@f.g@h.i", "@a.b x@y x@y. x@y.z.",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111  1111", "+1 (234) 567-8901, +1 ((((, +123456789 0123456789, ++12345678901", "0" * 40 + " 00000000000000",
    "aa" * 3000 + "@x.y " + "9" * 3000, " ".join(f"u{k}@h.org" for k in range(700)), "1.1.1.1.1@a.b 4111111111111111@a.b\n5.5.5.5",
]


def test_base_spans_equal_plain_search(spark):
    docs = spark.createDataFrame([(k, t, "s", "b") for k, t in enumerate(CASES)], "doc_id long, text string, spans string, base string")
    got = {r.doc_id: r for r in pii.digest_of(pii.find(docs)).collect()}
    for k, t in enumerate(CASES):
        want = plain(t)
        line = ",".join(f"{pii.KINDS[q]}:{a}:{b}" for a, q, b in want)
        assert got[k].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (k, got[k].spans[:200], line[:200])
        assert [got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone] == [sum(q == i for _, q, _ in want) for i in range(4)]
    assert pii.find(docs.where("false")).count() == 0


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.base_sha256 for r in pii.digest_of(pii.find(docs)).collect()}
    for r in docs.collect():
        line = ",".join(f"{pii.KINDS[q]}:{a}:{b}" for a, q, b in plain(r.text))
        assert got[r.doc_id] == hashlib.sha256(line.encode()).hexdigest()


def test_terms_that_reveal(spark):
    rows = [(k, f"filler{chr(97 + k)} text Zanzibar wrote to bob@x.org about thing{chr(97 + k)}") for k in range(5)]
    rows += [(10, "Zanzibar again, Zanzibarish"), (11, "nothing here about text"), (12, "text wrote about to"), *((20 + k, f"text wrote about number {k}") for k in range(400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find(docs)
    got = {r.doc_id: r.spans for r in pii.digest_of(found).collect()}
    assert got[10] == "term:0:8"
    assert got[0] == "term:13:21,email:31:40"
    assert got[11] == got[12] == got[25] == ""
    clean = {r.doc_id: r.text for r in pii.sanitised(found).collect()}
    assert clean[10] == "<term> again, Zanzibarish" and "<email> about" in clean[0] and clean[11] == rows[6][1]


def test_term_beside_several_entities_reveals_each(spark):
    rows = [(k, f"{w} Zanzibar {w} bob@x.org or +1 234 567 8901 or 10.1.2.3") for k, w in enumerate(("one", "two", "three"))]
    docs = spark.createDataFrame(rows + [(10, "Zanzibar"), *((20 + k, "plain words") for k in range(400))], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in pii.digest_of(pii.find(docs)).collect()}[10] == "term:0:8"


def test_copies_count_alike_on_both_sides(spark):
    rows = [(k, f"{w} Zanzibar {w} bob@x.org") for k, w in enumerate(("one", "two", "three", "four", "five")) for _ in range(20)]
    docs = spark.createDataFrame(rows + [(10, "Zanzibar"), *((20 + k, "plain words") for k in range(6000))], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in pii.digest_of(pii.find(docs)).collect()}[10] == "term:0:8"


def test_odd_rows(spark):
    """Null ids, repeated rows and columns that clash with what the operator makes."""
    text = "call +1 234 567 8901 or bob@x.org"
    rows = [(None, text), (4, text), (4, text), (5, None)]
    docs = spark.createDataFrame([(d, t, "k", "p", 1, "t", "r") for d, t in rows], "doc_id long, text string, key string, pattern string, row long, term string, base string")
    got = sorted(((r.doc_id, r.spans) for r in pii.digest_of(pii.find(docs)).collect()), key=str)
    assert got == sorted([(d, "phone:5:20,email:24:33" if t else "") for d, t in rows], key=str)
