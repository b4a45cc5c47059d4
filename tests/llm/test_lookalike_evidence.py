"""What a spoofed word may and may not prove."""

import pytest

from pagemill.llm import lookalike as L

ENGLISH = "hot cocoa drinks buy a new phone page the chocolate copy paper coax occasion scope open space care ocean".split()


def scored(spark, texts):
    return L.bigrams(spark.createDataFrame([(t,) for t in texts], "text string"))


def test_repeated_spoofs_are_no_evidence(spark):
    score = scored(spark, [" ".join(ENGLISH)] + ["сосоа"] * 50 + [f"сосо{x}" for x in "аеорсх"])
    assert L.canonical("Hot сосоа drinks", score) == "Hot cocoa drinks"
    assert not any(script == "cyrillic" for script, _ in score.counts)


@pytest.mark.parametrize("title", ["Погода в Москве", "Новости", "Купить iPhone в Москве", "Θάλασσα και ουρανός", "α-версия", "Version β"])
def test_true_words_stay_without_evidence(spark, title):
    assert L.canonical(title, scored(spark, [" ".join(ENGLISH)])) == title


def test_words_of_doubles_alone_follow_their_text(spark):
    score = scored(spark, [" ".join(ENGLISH), "красная река, широкая дорога, русская сказка, морская рыба, старая карта, хорошая пара"])
    assert L.canonical("Красная рака и роса", score) == "Красная рака и роса"


@pytest.mark.parametrize("spoof,plain", [
    ("а page", "a page"), ("Buy а new phone", "Buy a new phone"), ("Ꭺ page", "A page"), ("neѡ phone", "new phone"), ("ɡood page", "good page"), ("ᴀ pᴀge", "a page"), ("ꓐuy phone", "Buy phone"),
])
def test_wider_doubles(spark, spoof, plain):
    assert L.canonical(spoof, scored(spark, [" ".join(ENGLISH)])) == plain
