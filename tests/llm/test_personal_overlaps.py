"""Selected candidates that hold or overlap base spans."""

from corpusmill.llm import pii


def test_a_secret_around_a_card_is_replaced_whole(spark):
    card = "4539148803436467"
    secret = f"a8Kd9Qz{card}Lm3Xw7Rt2Yb5"
    text = f'api key = "{secret}" end'
    df = spark.createDataFrame([(1, text), (2, f"card {card} end"), (3, "token=04dbebab91ab85687d33@mail.example.com")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.pii_report(df).collect()}
    at = text.index(secret)
    assert rows[1]["n_card"] == 1
    assert f"card:{at + 7}:{at + 23}" in rows[1]["spans"].split(",") and f"secret:{at}:{at + len(secret)}" in rows[1]["spans"].split(",")
    assert rows[2]["spans"] == "card:5:21"
    out = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert out == {1: 'api key = "[SECRET]" end', 2: "card [CARD] end", 3: out[3]}
    assert "04dbebab" not in out[3] and "example" not in out[3]
