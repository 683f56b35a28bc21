import json
import re

from evenhand.operators import privacy as R


def apply(spark, fn, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(fn("t")).collect()]


def test_tokens_are_consistent_and_leave_the_rest(spark):
    a, b, c, d = apply(
        spark,
        lambda c: R.tokenise(c, "k"),
        "mail bob@x.org or bob@x.org.",
        "bob@x.org",
        "call (830) 555-5433, +1 (743) 555-3824 or 123-45-6789",
        "nothing here 12-34",
    )
    token = b
    assert re.fullmatch(r"tok_[0-9a-f]{24}", token)
    assert a == f"mail {token} or {token}."
    assert len(re.findall("tok_", c)) == 3 and "555" not in re.sub("tok_[0-9a-f]{24}", "", c)
    assert d == "nothing here 12-34"
    other = apply(spark, lambda c: R.tokenise(c, "other"), "bob@x.org")[0]
    assert other != token


def test_address_within_an_address(spark):
    short, both = apply(spark, lambda c: R.tokenise(c, "k"), "b@x.org", "ab@x.org b@x.org")
    assert both.endswith(" " + short) and both.count("tok_") == 2


def test_mask(spark):
    got = apply(spark, lambda c: R.mask(c), "ssn 123-45-6789 end", None)
    assert got == ["ssn *********** end", None]


def test_features_at_any_depth(spark):
    value = {
        "mail@key.org": 'say "bob@x.org"\nbob@x.org \\ end',
        "n": 5,
        "deep": {"er": {"phone": "(830) 555-5433", "ok": "plain"}},
        "list": ["bob@x.org", 7],
        "odd": 'a:"b": \\"',
        "none": None,
    }
    out = json.loads(apply(spark, lambda c: R.tokenise_features(c, "k"), json.dumps(value))[0])
    token = apply(spark, lambda c: R.tokenise(c, "k"), "bob@x.org")[0]
    assert out["mail@key.org"] == f'say "{token}"\n{token} \\ end'
    assert out["n"] == 5 and out["none"] is None and out["odd"] == value["odd"]
    assert out["deep"]["er"]["phone"].startswith("tok_") and out["deep"]["er"]["ok"] == "plain"
    assert out["list"] == [token, 7]


def test_long_text_with_many_escapes(spark):
    text = json.dumps({"t": 'x"\n\\' * 50000 + "bob@x.org"})
    out = json.loads(apply(spark, lambda c: R.tokenise_features(c, "k"), text)[0])
    assert out["t"].endswith(apply(spark, lambda c: R.tokenise(c, "k"), "bob@x.org")[0])


def test_scan_and_checksum(spark):
    df = spark.createDataFrame(
        [(1, "4111 1111 1111 1111 and 1234-5678-9012-3456"), (2, "12 Main Street, A12345678, a@b.co"), (3, None)],
        "id int, text string",
    )
    found = R.scan_text(df, ["id"], "text").collect()
    assert {(r["id"], r["info_type"], r["checksum_ok"]) for r in found} == {
        (1, "CREDIT_CARD_NUMBER", True),
        (1, "CREDIT_CARD_NUMBER", False),
        (2, "STREET_ADDRESS", None),
        (2, "PASSPORT", None),
        (2, "EMAIL_ADDRESS", None),
    }
    summary = {r["info_type"]: (r["findings"], r["rows"]) for r in R.scan_summary(df, ["text"]).collect()}
    assert summary["CREDIT_CARD_NUMBER"] == (2, 1)
