"""Sentence boundaries: hand-marked texts ("|" is a boundary) and invariants."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from marketgrain.llm.sentences import sentence_spans, sentences

MARKED = [
    "Офертата важи до 14.04.2026 г. включително.|Струва ли си?|Цената падна от 9,9 на 8,8 лв. за една седмица!",
    "Гответе на слаб огън ок. 12 мин., докато омекне.|Опаковката е 2 гр., т.е. стига.|Т.нар. „суперхрани“ са ориз.|Слагам лук и др.|Добре.",
    "В кв. Слънчев, до бл. 16, го има.|Магазинът на ул. Орехова 17 работи до 21.30 ч. през деня.|Вит. D идва от тофу.",
    "„Много е вкусно!“, каза тя.|Тя попита: „Има ли сирене?“|Според брошурата от 03.04. насам е така.|Етикетът твърди, че е „без захар“.|Да.",
    "Трудно е да се каже…|Изплакнете (не повече от 9 пъти!) и сварете.|Порция дава 2 г фибри и т.н.|Край.",
    "The U.S. style pack holds 9 oz. of tofu.|We drove to St. Elm Road.|Around 10.30 a.m. Grandma froze bread.|The label says \"no sugar.\"|\"Don't buy it!\" said my neighbour.",
    "Well... it depends.|Fat is 3.8% vs. 1.2%.|(It is sold out.)|See fig. 3, e.g. there.|It ends at 22:00.|What?!|Yes.",
    "Das Angebot gilt bis zum 3. Mai.|Man nimmt z. B. Reis.|Am 3. Montag kam er, d. h. spät.|Es sind ca. 9 kg, Zwiebeln usw.|Das Salz unter 1,60 g.|Gut.",
    "«Очень вкусно!» — сказала соседка.|Беру крупы, овощи и т. д.|Стоит ли?|См. рис. 9 на упаковке.|Это рис.|На 100 г, т. е. мало.",
    "Αξίζει το φέτα;|«Πολύ νόστιμο!» είπε η πωλήτρια.|Πήρα όσπρια, π.χ. φακές.|Κλείνει στις 9.30 μ.μ. κάθε μέρα.",
    "दाम घटा!|डॉ. की सलाह है।|“बहुत स्वादिष्ट है!” दुकानदार ने कहा।|ठीक है?",
    "قالت البائعة: «لذيذ جدا!» ثم ابتسمت.|هل يستحق؟|العرض سار؛ لا تتأخر.",
]
TIGHT = [
    "“太好吃了！”店员笑着说。|她问：“有没有？”|我更喜欢扁豆……因为更耐饿。|价格从9.9降到了8.8！",
    "よく分からない……|兄は「塩なしはありますか。」と聞いてみた。|「おいしい！」と言いました。|買った？",
]


def split(text):
    return [text[a:b] for a, b in sentence_spans(text)]


@pytest.mark.parametrize("marked", MARKED)
def test_marked(marked):
    for text in (marked,):
        assert split(text.replace("|", " ")) == text.split("|")
        assert split(text.replace("|", "\n")) == text.split("|")


@pytest.mark.parametrize("marked", TIGHT)
def test_without_blanks(marked):
    assert split(marked.replace("|", "")) == marked.split("|")


def test_without_case():
    for text in ("около 10.30 ч. баба купи хляб за 2 лв. с карта.|съжали.|трудно е…|от 03.04. насам.|сол под 9,9 г.|да.", "We paid 3 lv. in cash.|See no. 4."):
        for t in (text.lower(), text.upper()):
            assert split(t.replace("|", " ")) == t.split("|")


def test_missing_blanks_and_web():
    assert split("Поне така чух.Около 10 ч. дойде.Повече има на listovki.example/b/28 всяка сряда.") == ["Поне така чух.", "Около 10 ч. дойде.", "Повече има на listovki.example/b/28 всяка сряда."]


def test_paragraphs_and_lines():
    assert split("Списък\n\nЕдно\nдве.\n \nТри") == ["Списък", "Едно\nдве.", "Три"]


def test_thai():
    assert split("ร้านปิดตอนสามทุ่ม ราคาลดลงจาก 4.43 เหลือ 3.54 เลฟ ต้ม ยี่ห้อ Kerirken คุ้มไหม") == ["ร้านปิดตอนสามทุ่ม", "ราคาลดลงจาก 4.43 เหลือ 3.54 เลฟ", "ต้ม", "ยี่ห้อ Kerirken คุ้มไหม"]


@given(st.text(alphabet="аБ.!?… \n\n„“\"(),;1г้ไ。我」「«»'a​", max_size=60))
def test_spans_cover_all_but_blanks(text):
    spans = sentence_spans(text)
    at = 0
    for a, b in spans:
        assert not text[at:a].strip() and a < b and text[a:b] == text[a:b].strip()
        at = b
    assert not text[at:].strip()


LONG = "very long words, and more. " * 30
SCRIPTS = ["ខ្ញុំ។|អ្នក។", "Ողջույն։|Ինչպես։", "བོད།|ཡིག།", "ᠮᠣᠩ᠃|ᠭᠣᠯ᠃", "ꦱ꧉|ꦏ꧉", "A﹒B﹗|C", "ሰላም።|እንዴት፧|ደህና።", "آج۔|کل؟|ہاں۔"]


@pytest.mark.parametrize("marked", SCRIPTS)
def test_terminators_of_all_scripts(marked):
    assert split(marked.replace("|", " ")) == marked.split("|")


@pytest.mark.parametrize(("lang", "marked"), [
    ("en", "We sold part z.|It was late."), (None, "He bought vitamin d.|Then he left."), ("EN", "The plant is on main st.|The other is not."),
    ("en-GB", "We drove to St. Elm Road.|Yes."), ("de", "Man nimmt z. B. Reis.|Gut."), ("xx", "Das ist z. B. Reis für die Oma.|Gut."), (None, "Цена 9 лв.|Да."),
])
def test_abbreviations_by_language(lang, marked):
    text = marked.replace("|", " ")
    assert [text[a:b] for a, b in sentence_spans(text, lang)] == marked.split("|")


def test_quotations_of_any_length():
    assert split(f'He said "{LONG}so it is." Then he left. It rained.') == [f'He said "{LONG}so it is."', "Then he left.", "It rained."]
    assert split(f"He said „{LONG}so it is. Then he left.")[0].startswith("He said „very")  # never closed: no quotation


def test_batches_do_not_matter(spark):
    """A text gives the same sentences whatever stands before and after it in a batch."""
    texts = [m.replace("|", " ") for m in [*MARKED, *TIGHT, *SCRIPTS]] + ["abc", ".", "Вит", "D. E", "9.", "9"]
    rows = [(i, t, None) for i, t in enumerate(texts * 3)]
    got = {}
    for r in sentences(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)).collect():
        got.setdefault(r["doc_id"], []).append((r["char_from"], r["char_until"]))
    assert {i: sorted(x) for i, x in got.items()} == {i: sentence_spans(t) for i, t, _ in rows if sentence_spans(t)}


def test_table(spark):
    df = spark.createDataFrame([(1, "A. b C? D"), (2, None), (3, ""), (4, " \n "), (5, "x" * 200000 + ". Y"), (1, "A. b C? D")], "doc_id long, text string")
    got = sorted(tuple(r) for r in sentences(df.withColumnRenamed("text", "text")).collect())
    assert got == [(1, 0, 7), (1, 0, 7), (1, 8, 9), (1, 8, 9), (5, 0, 200001), (5, 202 - 202 + 200002, 200003)] or (5, 200002, 200003) in got
    assert sentences(df.limit(0)).collect() == []
