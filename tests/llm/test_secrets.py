import hashlib
import re

from awardry.llm.secrets import EVERYTHING, RULES, listed, op1_secret_scans, redacted, scan_secrets, trigram_query
from pyspark.sql import functions as F

from .helpers import docs

KEY = "AKIA" + "A1B2" * 5
TEXTS = [
    None, "", "plain", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x', "PassWord: hunter22, é secret:abc token=abcdefgh",
    "secret: token: abcdefgh", f"é{KEY} {KEY}x AKIAshort", "f" * 23 + " " + "0" * 24, "api_key='abc.def' apikey=ghijkl",
    "ghp_" + "a1" * 20, "tokENtoken==abcdef\ntoken =\tabcdef", "日本 " * 500 + "passwd=" + "q" * 5000, "-----BEGIN RSA PRIVATE KEY-----",
    "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123\n\n" + "Ab1+/" * 20 + "\nQQ==\n-----END RSA PRIVATE KEY----- after",
    "-----BEGIN PRIVATE KEY----- and then prose without a stop goes on and on", "-----BEGIN PRIVATE KEY-----\n" + ("Ab1+" * 16 + "\n") * 300 + "prose, more",
    "a -----BEGIN PRIVATE KEY-----\nMIIEvQ+/=\nabc\n-----END PRIVATE KEY----- b", "-----BEGIN EC PRIVATE KEY-----\nMIIE é",
]


def brute(text):
    out = []
    for rank, r in enumerate(RULES):
        for m in re.finditer(r.pattern, text or ""):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), rank, r.kind, m.end()))
    return sorted(out)


def test_equals_full_scan(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3]), (3, TEXTS[3]), (3, TEXTS[4])]
    found = scan_secrets(docs(spark, rows).withColumn("secrets", F.lit(1))).select("doc_id", "text", "secrets").collect()
    assert len(found) == len(rows)
    for r in found:
        assert [tuple(s) for s in r.secrets] == brute(r.text), r.text


def test_digest(spark, tmp_path):
    docs(spark, list(enumerate(TEXTS))).write.parquet(f"{tmp_path}/documents.parquet")
    for r in op1_secret_scans(spark, str(tmp_path)).collect():
        spans = [f"{k}:{a}:{b}" for a, rank, k, b in brute(TEXTS[r.doc_id]) if rank < 3]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex"))


def test_queries_are_mandatory():
    assert trigram_query("[0-9a-f]{24,}") == EVERYTHING
    assert trigram_query("AKIA[A-Z0-9]+") == {frozenset({"aki", "kia"})}
    assert trigram_query("(abcd|xyz)+q?") == {frozenset({"abc", "bcd"}), frozenset({"xyz"})}
    assert trigram_query("ab?c?") == EVERYTHING


def test_redaction(spark):
    df = scan_secrets(docs(spark, [(1, "é token=abcdefgh z"), (2, "clean"), (3, "token=" + "a" * 30 + " t")]))
    got = {r[0]: r[1] for r in df.select("doc_id", redacted(F.col("text"), F.col("secrets"))).collect()}
    assert got == {1: "é [SECRET] z", 2: "clean", 3: "[SECRET] t"}


def test_empty(spark):
    assert scan_secrets(docs(spark, []).limit(0)).count() == 0


def test_keys_go_with_their_body(spark):
    df = scan_secrets(docs(spark, [(1, TEXTS[-2])]))
    assert df.select(redacted(F.col("text"), F.col("secrets"))).first()[0] == "a [SECRET] b"


def test_many_candidates_and_rows_without_id(spark, monkeypatch):
    """Beyond the bound of a broadcast the candidates are joined; rows without id keep their secrets."""
    from awardry.llm import secrets

    monkeypatch.setattr(secrets, "BROADCAST_ROWS", 1)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, t) for t in TEXTS] * 2
    found = scan_secrets(docs(spark, rows)).select("text", "secrets").collect()
    assert len(found) == len(rows) and all([tuple(s) for s in r.secrets] == brute(r.text) for r in found)


def test_private_keys_with_header_lines_and_without_an_end():
    pem = {t: [(a, b) for a, _, k, b in brute(t) if k == "pem"] for t in TEXTS if t and "BEGIN" in t}
    inner = [t[a:b] for t, spans in pem.items() for a, b in spans]
    assert any(x.endswith("QQ==\n-----END RSA PRIVATE KEY-----") and "DEK-Info" in x for x in inner)  # the key itself is in it
    assert "-----BEGIN PRIVATE KEY-----" in inner and not any("and then prose" in x for x in inner)
    assert any(len(x) > 19_000 and "prose" not in x[:-5] for x in inner)


def test_parsed_form_of_expressions_is_as_supposed():
    """Queries are derived from Python's parsed form of expressions, which is no public module: an update that changes it fails here."""
    assert trigram_query("ab(?:cd|ef)g") == frozenset([frozenset(["abc", "bcd", "cdg"]), frozenset(["abe", "bef", "efg"])])
