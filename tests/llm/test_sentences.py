import pytest

from strataloom.llm.sentences import fit, labelled, sentences, spans

TEXTS = [
    "See Fig. 58 and Sec. 2.6.10 for the gasket seat. Before closing the cover, the crew shall measure it.",
    "Siehe Abb. 4 bzw. Abschn. 9.1.15 für JGN-40049. Die Prüfung dauert mind. 10 min.\nSchrauben sind z. B. kreuzweise anzuziehen.",
    "焊缝应全数检查，返修不超过两次！按8.7.12条的要求，冷却管需要重新紧固。",
    "Is the guide key dry?\nSee Fig. 43 and Sec. 3.5.1 for it.",
    "Clean the gasket seat.\nThe pump stops. 它停了。",
    "The crew is here. Siehe Abb. 3 und Nr. 5. The gap is 3.5 mm.\nThe pump runs.",
]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(f"{i}-{k}", t.replace("58", str(k))) for k in range(12) for i, t in enumerate(TEXTS)]
    return fit(spark.createDataFrame(rows, "id string, text string"))


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("See Fig. 7 and Sec. 2.6.1 for the seat. Before closing the cover, measure it.", ["See Fig. 7 and Sec. 2.6.1 for the seat.", "Before closing the cover, measure it."]),
        ("交底会上强调：“未经清理，不得封闭！”关于此事，另行通知。", ["交底会上强调：“未经清理，不得封闭！”", "关于此事，另行通知。"]),
        ("记录写着“应当更换！不得拖延。”，班长已经签收。", ["记录写着“应当更换！不得拖延。”，班长已经签收。"]),
        ("6.9.20 除氧器安装与检查\n安装时注意以下各点：\n1）甲；\n2）乙。", ["6.9.20 除氧器安装与检查", "安装时注意以下各点：", "1）甲；", "2）乙。"]),
        ("图41所示为滑销，\n其长度约为3.16m。检查两次！", ["图41所示为滑销，\n其长度约为3.16m。", "检查两次！"]),
        ("验收合格……但疏水口尚待打磨。", ["验收合格……但疏水口尚待打磨。"]),
        ("  焊缝​应检查。 \n", ["焊缝​应检查。"]),
        ("", []), ("​ \n", []),
    ],
)
def test_spans(model, text, wanted):
    assert [text[a:b] for a, b in spans(text, model)] == wanted


def test_table(spark, model):
    df = spark.createDataFrame([("a", "甲。乙。", 1), ("a", "甲。乙。", 2), ("b", None, 3), ("c", "", 4)], "id string, text string, start_char int")
    assert sorted(tuple(r) for r in sentences(df, ["id"], model).collect()) == [("a", 0, 2), ("a", 2, 4)]
    assert sentences(df.limit(0), ["id"]).count() == 0


def test_training_is_bounded_and_labels_cover_all(spark):
    rows = [(f"{k}", f"Check pump ABC-{k} now. Der Spalt beträgt ca. {k} mm. XYZ-{k} runs.") for k in range(400)]
    texts = spark.createDataFrame(rows, "id string, text string")
    told = labelled(texts).collect()
    # Tags and numbers behind a mark are one context each, however many there are.
    assert len(told) < 20 and sum(r["n"] for r in told) == 4 * 400
    assert all(r["y"] == 0 for r in told if r["before"] == "ca")
    assert fit(texts, most=3).any() and not fit(texts.limit(0)).any()
