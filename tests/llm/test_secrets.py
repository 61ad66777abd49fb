import hashlib
import re

from tallyfield.llm import plans
from tallyfield.llm.secrets import DIGIT, LETTER, OPAQUE, find_spans, joined_spans, scan_secrets
from tests.llm.cases import SF_DIR, real_documents

ASSIGN = re.compile(
    "(" + "|".join(
        "".join(f"[{c}{c.upper()}]" if c.isalpha() else c + "?" for c in w)
        for w in ("password", "passwd", "secret", "token", "api_key")
    ) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)


def base(text):
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(spans, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


LIVE = "Zx81kQp93mLs02vTy77aW"
COPIED = "Exampl3Examp1eExamplE1"
ROWS = (
    [(1, f"use {LIVE} here", "s1", "r1"), (2, f"é {LIVE}", "s1", "r1")]
    + [(10 + i, f"see {COPIED}", f"o{i}", f"o{i}/x") for i in range(6)]
    + [
        (20, None, "s1", None), (21, "", None, None), (22, "TOKEN: 'abc' API_KEY=abcdef passwd = \"x.y.z.12\"", None, None),
        (23, "password=token: abcdefgh", "s", "r"), (24, "AKIA" + "B" * 15 + " AKIA" + "C7" * 9, "s", "r"),
        (25, "0123456789abcdef01234567 " * 3, "s", "r"), (25, "0123456789abcdef01234567 " * 3, "s", "r"),
        (None, "secret='0123456789abcdef0123456789'", None, None), (26, "ſecret=abcdefgh toKen=abcdefgh", "s", "r"),
    ]
)
SCHEMA = "doc_id long, text string, owner string, repository string"


def test_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    found = scan_secrets(df)
    got = found.select("doc_id", joined_spans(found.secrets).alias("spans")).collect()
    assert len(got) == len(ROWS)
    spans = {r.doc_id: r.spans for r in got}
    assert spans[1] == "live:4:25" and spans[2] == "live:2:23"
    assert all(spans[10 + i] == "" for i in range(6))
    for doc_id, text, *_ in ROWS[8:]:
        assert spans[doc_id] == ",".join(f"{k}:{a}:{b}" for k, a, b in base(text)), doc_id
    assert spans[23] == ""  # the short match takes the second word with it
    live = {r.doc_id: [s.live for s in r.secrets] for r in found.collect()}
    assert live[25] == [True] * 3


def test_copied_base_span_is_kept_and_not_live(spark):
    rows = [(i, "token = abcdef123456", f"o{i}", f"r{i}") for i in range(5)]
    got = scan_secrets(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all([s.kind for s in r.secrets] == [0] and not r.secrets[0].live for r in got)


def test_empty(spark):
    assert scan_secrets(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    got = {r.doc_id: r for r in plans.op2_secrets(spark, SF_DIR).collect()}
    docs = real_documents()
    assert len(got) == len(docs)
    for doc_id, text, *_ in docs:
        want, row = base(text), got[doc_id]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        kinds = [k for k, *_ in want]
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        assert ",".join(s for s in row.spans.split(",") if not s.startswith("live")) == joined


def test_opaque_words_keep_off_base_spans():
    """Many spans of both sorts in one text, against comparing each with each."""
    bits = ["password=abc1234 ", "Zx9Qw" * 8 + " ", "token: " + "aB3" * 11, " x ", "deadbeef" * 4 + "Zz" * 9, "AKIA" + "A1B2" * 5 + "\n"]
    text = "".join(bits[i * i % 7 % 6] for i in range(3000))
    spans = find_spans(text)
    base = [(a, b) for k, a, b, _ in spans if k < 3]
    want = [
        m.span() for m in OPAQUE.finditer(text)
        if DIGIT.search(m[0]) and LETTER.search(m[0]) and not any(a < m.end() and m.start() < b for a, b in base)
    ]
    assert [(a, b) for k, a, b, _ in spans if k == 3] == want and want and base
