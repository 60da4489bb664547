import pytest
from pyspark.sql import functions as F

from quillspark.functions import scores, sealing, text
from quillspark.operators.vectors import from_bytes, to_bytes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "word, stem",
    [("running", "run"), ("stopped", "stop"), ("connections", "connection"), ("parties", "party"), ("classes", "class"), ("boss", "boss"), ("missed", "miss"), ("lies", "lie"), ("as", "as")],
)
def test_stem(spark, word, stem):
    assert one(spark, text.stem(F.lit(word))) == stem


def test_tokens(spark):
    assert one(spark, text.stems(F.lit("Power & Justice — a, list.of\nthings"))) == ["power", "justice", "a", "list", "of", "thing"]
    assert one(spark, text.tokens(F.lit("a_b\tc $d"))) == ["a", "b\tc", "$d"]
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []


def test_match_weight(spark):
    w = lambda q, t: one(spark, text.match_weight(F.lit(q), F.lit(t)))
    assert w("stoic", "stoic") == 1
    assert w("stoic", "stoicism") == pytest.approx(0.375 * 8 / (8 + 0.3 * 3))
    assert w("nietzche", "nietzsche") == pytest.approx(0.45 * 9 / 10)
    assert w("cafe", "café") == pytest.approx(0.45 * 4 / 5)
    assert w("ab", "ac") == 0


def test_normalized(spark):
    assert one(spark, text.normalized(F.lit("  ﬁne  Day\u0085!? "))) == "fine day"
    assert one(spark, text.normalized(F.lit("A  b.."), unicode=False)) == "a b"


def test_isbn_slug_truthy(spark):
    assert one(spark, text.normalize_isbn(F.lit("0-306-40615-x"))) == "030640615X"
    assert one(spark, text.normalize_isbn(F.lit("978-0-306"))) is None
    assert one(spark, text.slug(F.lit("  The Good & Bad "), "custom_")) == "custom_the_good_bad"
    for json, yes in (("true", True), ("1", True), ("0", False), ('"false"', False), ('"no"', True), ('""', False), ("null", False), ("[1]", False)):
        assert one(spark, text.truthy(F.lit(json))) is yes, json


def test_json_strings_and_token(spark):
    assert one(spark, text.string_items(F.lit('["a", 1, null, "b"]'))) == ["a", "b"]
    assert one(spark, text.string_items(F.lit("nonsense"))) == []
    assert one(spark, text.token_subject(F.lit("h.eyJzdWIiOiJ1LTEifQ.s"))) == "u-1"
    assert one(spark, text.remap_tags(F.array(*map(F.lit, "abca")), {"b": "a", "c": "z"})) == ["a", "z"]


def test_importance_and_vectors(spark):
    got = one(spark, scores.importance(F.lit(0.7), F.lit(2), F.lit(True), F.lit(1)))
    assert got == pytest.approx(0.7 * 2 ** (-1.0 / 1.5) + 1.0)
    v = F.array(F.lit(3.0).cast("float"), F.lit(4.0).cast("float"))
    assert one(spark, scores.normalize(v)) == pytest.approx([0.6, 0.8])
    assert one(spark, scores.normalize(F.array(F.lit(0.0)))) is None
    assert one(spark, from_bytes(to_bytes(v), 2)) == [3.0, 4.0]
    assert one(spark, from_bytes(to_bytes(v), 3)) is None


def test_sealing(spark):
    key, iv = bytes(range(32)), F.lit(bytes(12))
    for note in (None, F.lit("n1")):
        sealed = sealing.seal_text(F.lit("hello"), key, iv, note)
        assert one(spark, sealed).startswith("enc:v1:" if note is None else "enc:v2:")
        assert one(spark, sealing.open_text(sealed, key, F.lit("n1"))) == "hello"
    assert one(spark, sealing.open_text(sealed, key, F.lit("n2"))) is None
    shown, failed = sealing.readable(F.lit("plain"), key, F.lit("n"))
    assert (one(spark, shown), one(spark, failed)) == ("plain", False)
    shown, failed = sealing.readable(F.lit("enc:v2:xx.yy"), key, F.lit("n"))
    assert (one(spark, shown), one(spark, failed)) == (None, True)
    raw = sealing.seal_bytes(F.lit(b"abc"), key, iv, F.lit("emb:1"))
    assert bytes(one(spark, sealing.open_bytes(raw, key, F.lit("emb:1")))) == b"abc"


def test_known_digests(spark):
    import hashlib
    import hmac

    assert one(spark, sealing.hmac_sha256(b"k" * 64, F.lit(b"m"))) == hmac.new(b"k" * 64, b"m", hashlib.sha256).hexdigest()
    # RFC 5869, test case 3
    assert sealing.hkdf(bytes([11] * 22), b"", 42, b"").hex().startswith("8da4e775a563c18f715f802a063c5a31")


def test_vault(spark):
    vault, key = sealing.Vault(spark, bytes(range(32))), bytes([7] * 32)
    blob = vault.wrap(key, bytes(12))
    assert sealing.Vault.unlock(spark, [vault.wrap(bytes(32), bytes(12)), blob], key).master == bytes(range(32))
    assert sealing.Vault.unlock(spark, [blob], bytes(32)) is None


def test_vault_moves_between_devices(spark):
    vault = sealing.Vault.generate(spark, b"wrap")
    first, second = vault.wrap_with_secret(b"one"), vault.wrap_with_secret(b"two")
    broken = sealing.Blob("!", "?", "*")
    assert sealing.Vault.unlock_with_secret(spark, [broken, first, second], b"two", b"wrap").master == vault.master
    assert sealing.Vault.unlock_with_secret(spark, [first], b"one", b"other") is None
    moved = vault.wrap_with_pin("1234")
    assert sealing.Vault.redeem_pin_transfer(spark, moved, "1234").master == vault.master
    assert sealing.Vault.redeem_pin_transfer(spark, moved, "4321") is None
    assert vault.wrap_with_secret(b"one") != first and len(vault.master) == 32
