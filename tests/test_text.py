"""Masking, policy, notices and number formats."""

import pytest
from conftest import UPLOADED, rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tillsight.functions.numeric import rounded
from tillsight.functions.text import fixed, fmt, plain_number, strip, text_lines
from tillsight.operators.notices import mask_pii, notice_checklist, notice_summary, policy_flags, require_policy_safe

LINES = "3월 20일까지 POS 배너 반영 필수\n신메뉴 프로모션은 3월 21일부터 적용\n점주 확인 후 포인트 2배 적립 룰 제출 필요"


def one(spark, value, column=lambda c: c, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("전화 010-1234-5678 입니다", "전화 010-****-5678 입니다"),
        ("02-123-4567", "02-****-4567"),
        ("mail a@b.com now", "mail ***@*** now"),
        ("900101-1234567", "******-*******"),
        ("a@b.com으로", "a@b.com으로"),
        ("éa@b.com", "éa@b.com"),
        ("nothing", "nothing"),
        (None, None),
    ],
)
def test_mask(spark, text, expected):
    table = spark.createDataFrame([(text,)], "t string")
    assert mask_pii(table, "t").first()["t"] == expected
    assert mask_pii(table, "t", enabled=False).first()["t"] == text


def test_policy(spark):
    table = spark.createDataFrame([("Fraudulent claim",), ("fine",), (None,)], "t string")
    assert [r["policy_violation"] for r in policy_flags(table, "t").collect()] == [True, False, False]
    assert [r["policy_violation"] for r in policy_flags(table, "t", ["fine"]).collect()] == [False, True, False]
    with pytest.raises(PySparkException, match="Policy violation"):
        require_policy_safe(table, "t").collect()


def notices(spark, *texts):
    data = [(f"n{i}.txt", text, UPLOADED) for i, text in enumerate(texts)]
    return spark.createDataFrame(data, "source_name string, notice_text string, uploaded_at string")


def test_notice_checklist(spark):
    found = rows(notice_checklist(notices(spark, LINES, "first\n\n second", "", None)), "source_name", "position")
    assert [(r["source_name"], r["position"]) for r in found] == [("n0.txt", 0), ("n0.txt", 1), ("n0.txt", 2), ("n1.txt", 0)]
    assert found[3]["item"] == "first"
    assert {(r["deadline"], r["assignee"]) for r in found} == {("확인 필요", "store_owner")}


def test_notice_summary(spark):
    found = rows(notice_summary(notices(spark, LINES, "  a \r\n\t\r\n b\x0bc", "", "x" * 300, "call 010-1234-5678")), "source_name")
    assert found[0]["summary"] == "3월 20일까지 POS 배너 반영 필수 신메뉴 프로모션은 3월 21일부터 적용"
    assert found[1]["summary"] == "a b"
    assert found[2]["summary"] == "공지 내용이 비어 있습니다."
    assert found[3]["summary"] == "x" * 180
    assert found[4]["summary"] == "call 010-****-5678"
    assert found[0]["ocr_confidence"] == 0.95
    assert found[0]["evidence"][0]["value"] == f"{len(LINES)}자"
    assert found[0]["version"]["model_version"] == "ocr-rule-0.1.0"


def test_notice_policy_modes(spark):
    table = notices(spark, "a steal of a deal")
    with pytest.raises(PySparkException, match="Policy violation"):
        notice_summary(table).collect()
    assert notice_summary(table, policy="flag").first()["policy_violation"] is True


@pytest.mark.parametrize("text", ["a\nb", "a\r\nb", "a\rb", "a\x0bb", "a\x0cb", "a\x1cb", "a\x85b", "a b", "\xa0a\x1f\n　b \n"])
def test_lines_split_and_strip_like_plain_text_tools(spark, text):
    assert one(spark, text, text_lines) == [line.strip() for line in text.splitlines() if line.strip()]
    assert one(spark, text, strip) == text.strip()


@pytest.mark.parametrize("x", [0.3125, 2.675, 0.125, -0.125, 0.25, -0.04, 1234567.5, 17.425, 1e15, -2.5, 0.0, 63.5, 1.005])
@pytest.mark.parametrize("places", [0, 1, 2, 4])
def test_numbers_follow_exact_rounding(spark, x, places):
    assert one(spark, x, lambda c: rounded(c, places), "double") == round(x, places)
    assert one(spark, x, lambda c: fixed(c, places), "double") == f"{x:.{places}f}"
    assert one(spark, x, lambda c: fixed(c, places, ","), "double") == f"{x:,.{places}f}"
    assert one(spark, x, lambda c: fixed(c, places, "+"), "double") == f"{x:+.{places}f}"


def test_formats(spark):
    assert one(spark, 1234567, lambda c: fmt("%,d명 %s %.1f%%", c, F.lit("a"), F.lit(12.25)), "long") == "1,234,567명 a 12.2%"
    with pytest.raises(ValueError):
        fmt("%s %s", F.lit(1))


@pytest.mark.parametrize("x, text", [(10.0, "10.0"), (0.29, "0.29"), (12345678.5, "12345678.5"), (4e7, "40000000.0")])
def test_plain_number(spark, x, text):
    assert one(spark, x, plain_number, "double") == text == str(x)
