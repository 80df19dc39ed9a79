import pytest

from tests.conftest import rows
from tidemark.llm.sentences import sentences, split_sentences


def cut(text):
    return [text[a:b] for a, b in sentences(text)]


@pytest.mark.parametrize(
    "parts",
    [
        ["The U.S. session sold into the gap.", "Volume is thin in the U.S.", "The desk waits."],
        ["In the U.S. MAZEQ trades thinly, in the E.U. it does not.", "At 4 p.m. NINIX was back.", "It was filled at 7 p.m.", "A thin book held."],
        ["See fig. 6 and tbl. 7 vs. approx. 2% of vol. 3.", "It closed at 94729.91.", "30 bars later it was gone."],
        ["Bodies, wicks, etc. were left out.", "We checked gaps, etc.", "The rest is stale."],
        ["“Wait for the close.", "Then look at the gap.”", "The note says \"No longs. No adds.\" and nothing else."],
        ["\"Cut it.\" was all that bot_48 wrote.", "\"Is 17 the floor?\" asked bot_2 here.", "It held… until it broke.", "No way!!!", "RENQ broke out?!"],
        ["(The market maker left before the close.)", "The R.R. of 8.8 is clean.", "iLVL was late again.", "Mind the gap @ .845 (cf. rank_out.json, l. 34)."],
        ["Am 4. Mai schloss REZOJ bei 163,69.", "Heute gilt der 3. Versuch als letzter!", "Siehe Abb. 1 u. Tab. 54 zu TUTOK.", "Der Bot fragt: „Was jetzt?“", "Das Volumen stieg bzw. fiel."],
        ["Le niveau tient-il vraiment ?", "Le M. Niveau a noté la zone.", "« On sort ! » a écrit anon_1.", "On garde un stop, p. ex. à 24 021,07."],
        ["Según EE. UU. el volumen fue de 21.", "«¿Salimos?» preguntó user_2.", "¡Qué cierre!", "El Sr. Nivel marcó la pág. 20."],
        ["Комиссии, спреды и т. д. не учтены.", "«Выходим!» — написал user_4.", "См. рис. 4 и табл. 39."],
        ["Κρατάει άραγε το 546,15;", "Ο όγκος ήταν μικρός· τα υπόλοιπα αργότερα.", "Τέλος."],
        ["Բայց մակարդակը մնաց։", "Ի՞նչ է լինելու վաղը։"],
        ["ገበያው ዛሬ ተዘግቷል።", "ለምን ወረደ፧"],
        ["डॉ. स्तर चुप रहा।", "लक्ष्य 0.73 है।", "कल रु. 0.99 है|"],
        ["هل يصمد المتوسط فعلا؟", "كتب desk_1 «لا تشتروا الآن.» ثم خرج.", "يقول د. مستوى كلاما."],
        ["저항이 버틸까?", "\"지금은 기다리자.\"라고 tape_1가 적었다.", "글쎄... 다시 보자.", "(자세한 것은 그림 1.2 참고.)"],
        ["พรุ่งนี้ค่อยว่ากันใหม่", "เมื่อวานราคาปิดที่ 495 ดอลลาร์ แต่แรงซื้อยังน้อย", "ตอนนี้ให้ขยับแนวรับไปที่ 5 ก่อนนะครับ"],
    ],
)
def test_spaced_scripts(parts):
    assert cut(" ".join(parts)) == parts


@pytest.mark.parametrize(
    "parts",
    [
        ["目标417.506。", "“止损先走。”desk_81说。", "谁还信？！", "user_79写道：“先看收盘。不要追。”然后就下线了。", "（详见图3.1。）", "再等等……还没到。"],
        ["反発したが遅かった（笑）。", "「損切りを先に。」とbotが書いていた。", "まさか！？", "３５．１を下回る。"],
        ["勢いは続かなかった．", "目標は37．7だ．"],
    ],
)
def test_dense_scripts(parts):
    assert cut("".join(parts)) == parts


def test_lines():
    text = "# 4. Open points\nBy contrast, it held. It broke.\n\n1. raise the stop\n2. approx. 5%\n- fixed rounding\n\n| S1 | 34. No | approx. 2% |\n| S2 | 5 |\n\n[19:57] tape_9: No way! Out.\n<bot_1> brb\n"
    assert cut(text) == [
        "# 4. Open points", "By contrast, it held.", "It broke.", "1. raise the stop", "2. approx. 5%", "- fixed rounding", "| S1 | 34. No | approx. 2% |", "| S2 | 5 |", "[19:57] tape_9: No way!", "Out.", "<bot_1> brb",
    ]


def test_wrapped_prose():
    lines = ["The dump from fetch.daily.csv ended in less than an hour. Expect", "26.27% either way, per the v4.9.2 run. A patient buyer wrote", "\"ZOBUV is convincing\" late on Tuesday."]
    assert len(cut("\n".join(lines))) == 3


def test_no_capitals():
    assert cut("volume is still thin in the U.S. the desk held. bodies, wicks, etc. were left out. it broke.") == ["volume is still thin in the U.S.", "the desk held.", "bodies, wicks, etc. were left out.", "it broke."]


@pytest.mark.parametrize("text", [None, "", " \n \t", "　"])
def test_nothing(text):
    assert sentences(text) == []


@pytest.mark.parametrize("text", ["a" * 200_000, "No. " * 20_000, "\"" * 5000, "(" * 5000, "…" * 3000, "「" * 300 + "。", ".", "|", "’“”", "x‍.​ y", "😀!".encode("utf-16", "surrogatepass").decode("utf-16")])
def test_every_character_once(text):
    at = 0
    for a, b in sentences(text):
        assert a >= at and not text[at:a].strip() and text[a:b] == text[a:b].strip() != ""
        at = b
    assert not text[at:].strip()


def test_table(spark):
    df = spark.createDataFrame([(1, "A b. C d.", 0), (2, None, 0), (None, "X.", 0), (3, " ", 0)], "doc_id bigint, text string, start_pos int")
    assert rows(split_sentences(df)) == sorted([(1, 0, 4), (1, 5, 9), (None, 0, 2)], key=str)
    assert split_sentences(df.limit(0)).collect() == []
