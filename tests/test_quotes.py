"""Quotes: hand-written cases, and transcripts against SQL."""

import pytest

from storyweft.operators.quotes import extract_quotes


def who(text):
    return [(q["speaker"], q["how"]) for q in extract_quotes(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ('"We are ready to hold the vote," IEBC chair Erastus Ethekon said.', [("Erastus Ethekon", "named")]),
        ('"We will not accept this at all," said Jane Doe. "They have to pay us now," she added.', [("Jane Doe", "named"), ("Jane Doe", "pronoun")]),
        ('Ruto met Raila Odinga. Cabinet Secretary Alice Wendot noted the delay. "A mausoleum is not merely a structure," she said.', [("Alice Wendot", "pronoun")]),
        ('Deputy President Kithure Kindiki arrived. Governor Irungu Kang\'ata waited. "We shall build the road soon," the DP said.', [("Kithure Kindiki", "pronoun")]),
        ('"Nobody was hurt in the raid," the ministry said.', [("the ministry", "described")]),
        ('"Nobody was hurt in the raid," police said.', [("police", "described")]),
        ('According to IEBC chairperson Erastus Ethekon, "the register is clean and ready".', [("Erastus Ethekon", "named")]),
        ('Jane Doe said: "We will go to court."\n"We will win the case there."', [("Jane Doe", "named"), ("Jane Doe", "continued")]),
        ('"Nothing at all is known here."', [(None, "none")]),
        ('The plan is called "Adequate Housing for All" by the state.', []),
        ('The "so called" plan', []),
        ("He lashed out. ‘This was never the deal’, Peter Otieno lashed out.", [("Peter Otieno", "named")]),
        ("Don't say it's theirs' and John's “four words are here” said Mary Atieno.", [("Mary Atieno", "named")]),
        ("", []),
        (None, []),
    ],
)
def test_attribution(text, want):
    assert who(text) == want


def test_long_quote_is_cut_and_language_told():
    q = extract_quotes("“" + "maneno " * 200 + "” Jane Doe said.")[0]
    assert len(q["quote"]) == 400 and q["language"] == "other" and q["verb"] == "say"
    assert extract_quotes("“the state of the union is good” said Jane Doe")[0]["language"] == "en"


def test_no_speaker_from_too_far_back():
    far = 'Jane Doe said so. One went by. Two went by. Three went by. "These four words stand alone here."'
    assert who(far) == [(None, "none")]
    assert who('Jane Doe said so. One went by. "These four words stand alone here."') == [("Jane Doe", "continued")]
