"""Names of no list, known by what stands around them."""

import pytest

from pagemill.llm import personal

#: Family names that no list of the module holds (it holds none at all).
FAMILIES = "Smith Jones Okafor Nguyen Kowalski Patel Fischer Schmidt Wagner Yılmaz Dubois Lefebvre Moreau Traoré Lopez Navarro Ibarra Castro Rossi Novak".split()
FORMS = ["Mr {}", "Ms. {}", "Dr. {}", "Herr {}", "Frau {}", "Mme {}", "Sra. {}", "Sr. {}"]


def names(text):
    return [text[a:b] for a, b, kind in personal.find(text) if kind == "name"]


def test_recall_on_held_out_names():
    cases = [(f"Yesterday {form.format(name)} wrote to us about it.", name) for name in FAMILIES for form in FORMS]
    cases += [(f"The page was checked by {initial} {name} last week.", f"{initial} {name}") for name in FAMILIES for initial in ("K.", "A.")]
    cases += [(f"The page was checked by {given} {name} last week.", f"{given} {name}") for name in FAMILIES for given in ("Laura", "Stefan", "Pedro")]
    found = sum(names(text) == [name] for text, name in cases)
    print(f"held-out names: {found} of {len(cases)}")
    assert found == len(cases)


def test_unlisted_given_name():
    assert names("Reviewed by Oluchi Wexlow today") == ["Oluchi Wexlow"] and names("Mr Zbigniew Kowalski called") == ["Zbigniew Kowalski"]


@pytest.mark.parametrize(
    "text", ["The Miss Universe page", "Plan B. The rest", "vitamin C. Bananas follow", "z. B. Montag", "Mark Complete", "12 Oak Dr Springfield has", "San José Airport", "Laura Street", "Frau Doktor", "Build with A. Please"]
)
def test_common_words_are_no_names(text):
    assert names(text) == []


@pytest.mark.parametrize("text,want", [
    ("Son passeport est 12AB34567.", "12AB34567"), ("Ausweis C01X00T47 liegt vor", "C01X00T47"), ("pasaporte AAB123456 del cliente", "AAB123456"), ("build 12AB34567 and sku AAB123456", None),
])
def test_identity_numbers_with_letters(text, want):
    assert [text[a:b] for a, b, kind in personal.find(text) if kind == "id_number"] == ([want] if want else [])
