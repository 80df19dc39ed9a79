"""Hand-labelled sentences in many scripts, texts of any size and shape, and the time they take."""

import time

import pytest

from tidemark.llm.sentences import sentences


def cut(text):
    return [text[a:b] for a, b in sentences(text)]


SAMPLE = {
    "english": ["I bought fig.", "It was good.", "He hit p.", "Then stopped.", "The art.", "Then the ref.", "Later on.", "Dr. Smith met Mrs. Jones at 5 p.m. on Friday.", "They paid $3.50 each."],
    "english references": ["See fig. 3, sec. IV and vol. B of the report.", "Prof. Lee edited eq. 7 with care.", "It cost approx. Two hundred agreed."],
    "german": ["Der Kurs stieg z. B. am 3. Mai um ca. 4 % und fiel danach.", "Hr. Weber war u. a. in Bonn.", "Das war alles usw.", "Danach kam nichts."],
    "french": ["Mme Durand a vu M. Petit hier soir dans la rue.", "Est-ce vrai ?", "Voir la fig. 2 et les notes, p. ex. celles de la page 4.", "Il est parti."],
    "spanish": ["El Sr. Gómez y la Sra. Ruiz llegaron a las 3.", "¿Qué hora es?", "¡Vaya!", "Véase la pág. 4 del libro."],
    "russian": ["Он приехал в 1990 г. из Москвы.", "Проф. Иванов, т. е. мой сосед, молчал.", "А что дальше?"],
    "greek": ["Τι ώρα είναι;", "Ο κ. Παππάς έφυγε.", "Δηλαδή τίποτα."],
    "khmer": ["ខ្ញុំទៅផ្សារ។", "គាត់ទៅផ្ទះ។"],
    "burmese": ["ကျွန်တော် ဈေးသွားတယ်၊ ပြန်လာတယ်။", "သူ အိမ်ပြန်တယ်။"],
    "tibetan": ["བོད་ཀྱི་སྐད་ཡིག།", "ང་བོད་པ་ཡིན།"],
    "n'ko": ["ߒ ߓߍ߫ ߕߊ߯߹", "ߊ߬ ߣߊ߬ ߘߊ߫߹"],
    "syriac": ["ܫܠܡܐ ܥܠܝܟ܂", "ܐܝܟܢܐ ܐܢܬ܂"],
    "meetei mayek": ["ꯑꯩ ꯆꯠꯂꯤ꯫", "ꯃꯍꯥꯛ ꯂꯥꯛꯂꯤ꯫"],
    "mongolian": ["ᠪᠢ ᠢᠷᠡᠯᠡ᠃", "ᠲᠡᠷᠡ ᠶᠠᠪᠤᠯᠠ᠃"],
    "urdu": ["یہ کتاب ہے۔", "وہ کہاں ہے؟"],
    "amharic": ["ሰላም ነው።", "እንዴት ነህ፧"],
    "hindi": ["मैं घर जा रहा हूँ।", "डॉ. शर्मा आए।"],
    "armenian": ["Նա եկավ։", "Ես գնացի։"],
    "sundanese": ["ᮃᮊᮥ ᮃᮀᮊᮒ᭾", "ᮙᮔᮦᮂ ᮓᮒᮀ᭾"],
}


@pytest.mark.parametrize("name", SAMPLE)
def test_sample(name):
    assert cut(" ".join(SAMPLE[name])) == SAMPLE[name]


def test_sample_without_spaces():
    assert cut("今日は寒い。明日は？わからない！") == ["今日は寒い。", "明日は？", "わからない！"]
    assert cut("他说：“我不去。你去吧。”然后走了。门关上了。") == ["他说：“我不去。你去吧。”然后走了。", "门关上了。"]


@pytest.mark.parametrize("size", [5, 200, 2000])
def test_quotations_of_any_length(size):
    said = "We wait. " * size
    assert len(cut(f'He said “{said.strip()}” and left. Then it rained.')) == 2
    assert len(cut(f"“{said.strip()}”")) == size


def test_a_greek_question_of_any_length():
    assert cut("Κρατάει " + "12345 678, " * 100 + "USD; Όχι.")[1:] == ["Όχι."]


def wrapped(width, words):
    lines, line = [], ""
    for w in words:
        if line and len(line) + 1 + len(w) > width:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return "\n".join([*lines, line])


@pytest.mark.parametrize("width", [30, 44, 60, 80, 125, 140, 200])
def test_columns_of_any_width(width):
    words = ("the desk that opened the book before the auction and kept it while nobody else was there to see what became of it " * 12).split() + ["closed."]
    assert len(cut(wrapped(width, words))) == 1
    at = len(words) // 2
    with_address = words[:at] + ["https://example.org/" + "a" * width] + words[at:]
    assert len(cut(wrapped(width, with_address))) == 1


def test_lines_that_are_no_column():
    lines = ["Levels for today", "Support near the open", "Bodies", "A wide book with nothing in it", "Fees", "Late in the day the book was thin again and stayed so"]
    assert cut("\n".join(lines)) == lines
    assert cut("shorter line here\nand another longer one here\ntiny\nfour words are here") == ["shorter line here", "and another longer one here", "tiny", "four words are here"]


UNITS = ["He left. — then she stayed on. ", "\"a ", "“ a. ", "„a“. ", "(a. ", "a.b. ", "a.", "; α ", "1;", "α1;", "etc. ", "in the u.s. a ", "ก ข ", "ก1 ", "x\n", "- a\n", "ab cd ef\n", "。", "“甲。", ". ", "|", "क 1| ", "3. a ", "No. 4 ", "— ", "! \" ", "Ա: ", "(.)", "​. "]


@pytest.mark.parametrize("unit", UNITS)
def test_time_grows_with_the_text(unit):
    def seconds(size):
        text, began = unit * (size // len(unit)), time.perf_counter()
        sentences(text)
        return time.perf_counter() - began

    few, many = min(seconds(60_000) for _ in range(2)), seconds(480_000)
    assert many < 24 * few + 0.5
