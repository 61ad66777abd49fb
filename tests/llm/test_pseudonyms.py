import datetime
import re

import regex
from pyspark.sql import functions as F

from tallyfield.llm import plans
from tallyfield.llm.pseudonyms import ANY, permuted_digits, pseudonymise
from tests.llm.cases import SF_DIR, documents, real_documents, with_clashes


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_digits_are_permuted(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    out = [r[0] for r in df.select(permuted_digits(F.col("d"), "k", "t")).collect()]
    assert sorted(out) == [f"{i:03d}" for i in range(1000)] and out != sorted(out)


def test_formats(spark):
    rows = [
        (1, "4111 1111 1111 1111 and 4111111111111111"), (2, "+1 (017) 555-7713"), (3, "169.122.221.182 300.1.1.1"),
        (4, "2024-02-29 30/02/2024 29.02.2024"), (5, "a.b9@x.example.com"), (6, None), (7, ""), (8, "plain 12 text"),
        (None, "169.122.221.182"), (1, "4111 1111 1111 1111 and 4111111111111111"), (9, "a" * 100_000),
    ]
    got = pseudonymise(with_clashes(documents(spark, rows)), "key").collect()
    assert len(got) == len(rows)
    text = {r.doc_id: r.text for r in got}
    a, b = text[1].split(" and ")
    assert a.replace(" ", "") == b != "4111111111111111" and luhn(b) and re.fullmatch(r"(\d{4} ){3}\d{4}", a)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", text[2]) and text[2] != rows[1][1]
    address, kept = text[3].split(" ")
    assert kept == "300.1.1.1" and address == text[None] != "169.122.221.182"
    assert all(int(x) < 256 for x in address.split("."))
    first, wrong, last = text[4].split(" ")
    assert wrong == "30/02/2024" and first != "2024-02-29"
    assert datetime.date.fromisoformat(first).strftime("%d.%m.%Y") == last
    assert text[5].endswith("@x.example.com") and "a.b9" not in text[5]
    assert (text[6], text[7], text[8], text[9]) == (None, "", "plain 12 text", "a" * 100_000)
    assert pseudonymise(documents(spark, []), "key").count() == 0


def test_further_layouts(spark):
    values = [
        "(555) 123-4567", "555-123-4567", "+1 555-123-4567", "+44 20 7946 0958", "020 7946 0958", "3782 822463 10005", "1/2/2020",
        "3 May 2021", "May 03, 2021", "123-45-6789", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "2001:db8::ff00:42:8329",
        "+33 1 23 45 67 89", "+15551234567", "2001:0db8:0:0:0:ff00:42:8329", "666-45-6789", "1/2020", "std::cout 12:30:45 +5 100",
    ]
    rows = [(i, f"so {v}, then") for i, v in enumerate(values)]
    got = {r.doc_id: r.text for r in pseudonymise(documents(spark, rows), "key").collect()}
    new = [got[i][3:-6] for i in range(len(values))]
    assert all(got[i] == f"so {n}, then" for i, n in enumerate(new))
    assert [n == v for n, v in zip(new, values, strict=True)] == [False] * 16 + [True] * 3
    digits = ["".join(c for c in n if c.isdigit()) for n in new]
    assert digits[0] == digits[1] == digits[2][1:] == digits[14][1:] and new[3].startswith("+44 ") and new[4].startswith("0")
    assert luhn(digits[5]) and new[12] == new[15] and len(new[12].split(":")) == 8
    a, b = (datetime.datetime.strptime(n, f) for n, f in ((new[7], "%d %B %Y"), (new[8], "%B %d, %Y")))
    assert a == b and datetime.datetime.strptime(new[6], "%d/%m/%Y")
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", new[9])
    for n in (new[10].replace(" ", ""), new[11]):
        assert int("".join(str(int(c, 36)) for c in n[4:] + n[:4])) % 97 == 1


def test_no_python(spark):
    plan = plans.op5_pseudonyms(spark, SF_DIR)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_only_values_change_and_alike_everywhere(spark):
    """Values found in whole texts by another matcher: each is replaced, all between them stays."""
    got = {r.doc_id: r for r in plans.op5_pseudonyms(spark, SF_DIR).collect()}
    new_of, old_of, n = {}, {}, 0
    for doc_id, text, *_ in real_documents():
        between, values = regex.split(ANY, text), [m.group() for m in regex.finditer(ANY, text)]
        new = regex.fullmatch("(.*)".join(map(regex.escape, between)), got[doc_id].text, regex.DOTALL)
        assert new, doc_id
        assert got[doc_id].n_replaced == sum(a != b for a, b in zip(values, new.groups(), strict=True))
        for old, other in zip(values, new.groups(), strict=True):
            assert new_of.setdefault(old, other) == other and old_of.setdefault(other, old) == old
            n += old != other
    assert n > 10


def test_what_stays_is_not_counted(spark):
    rows = [(1, "300.1.1.1 and 30/02/2024 and 01/2023"), (2, "at 10.0.0.1\n\nor 10.0.0.1,\r\n10.0.0.2\n"), (3, "\n")]
    got = {r.doc_id: r for r in pseudonymise(documents(spark, rows), "key").collect()}
    assert (got[1].n_replaced, got[1].text) == (0, rows[0][1])
    assert got[2].n_replaced == 3 and got[2].text.count("\n") == 4 and got[2].text.startswith("at ") and got[2].text[-1] == "\n"
    assert (got[3].n_replaced, got[3].text) == (0, "\n")


def test_long_texts_of_every_kind_end(spark):
    """No pattern may use up the stack or look at a run again from each of its places."""
    units = ["b.", ".1", "a:", "12 ", " ", "7", "1-", "a@", "0 ", "+1", "A1 ", "1.1.", "::", "(0", "é1"]
    rows = [(i, "a@" * (u == "b.") + "1" * (u == ".1") + u * (1_000_000 // len(u)) + "com") for i, u in enumerate(units)]
    got = {r.doc_id: r.n for r in pseudonymise(documents(spark, rows), "key").selectExpr("doc_id", "length(text) AS n").collect()}
    assert len(got) == len(rows)
    assert got[4] == len(rows[4][1]) and got[0] >= len(rows[0][1]) - 10
